"""Language identification.

A text is the average of the embeddings of its hashed subwords (all runs of 3 and of 4
UTF-8 bytes of the lower-cased text, over the whole text); a linear softmax maps that to
the languages. Both are trained by stochastic gradient descent in numpy on a bounded
sample of labelled rows (`most`), by one task that gets counts by bucket; the driver only
gets the model. About a fifth of the sample is held back to calibrate a temperature and two
rejections:

* by the score, half way from chance to the least score of a held row that is predicted right
  (but for one in a thousand);
* by coverage, the share of the text's runs of 4 letters or spaces that stand in two or more
  of the rows learned from, whatever their language, so that a text of several of them is
  kept. Held rows show how much of a text of these languages is covered; what the other
  languages cover of them (runs that are in a language's rows at least a twentieth as often
  as in any's, as rows may hold passages of another language), and what is covered of them
  once their letters are exchanged by a cipher, shows how much is of another. The limit is
  half way from the latter (all but a twentieth) to the least of the former (but for one in
  200). A short text is given its sampling error.

Null text and text without a letter are `und` with score 0 and rejected. With no labelled
row, nothing is learned and all rows are `und` and rejected. Ties go to the language that
sorts first. Texts without a run of 4 letters are judged by the score alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.bpe import by_size
from tidewater.llm.common import slices, tidy

BITS = 13
BUCKETS = 1 << BITS
#: Hashed runs for coverage.
RUN_BITS = 20
#: Bytes of letters and spaces; text is in lower case.
_letters = np.zeros(256, bool)
_letters[[32, *range(97, 123), *range(128, 256)]] = True
#: Exchanges the letters a to z.
CIPHER = bytes.maketrans(b"abcdefghijklmnopqrstuvwxyz", b"qazwsxedcrfvtgbyhnujmikolp")
GAP = b"   "
UNKNOWN = "und"
letter = regex.compile(r"\p{L}").search


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the texts, one text after the other, and where each text starts (two buckets stand for each byte)."""
    data = np.frombuffer(GAP.join([*texts, b""]), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(GAP)
    wide = np.zeros(len(data) + 3, np.uint32)
    wide[: len(data)] = data
    three = wide[:-3] << 16 | wide[1:-2] << 8 | wide[2:-1]
    four = three << 8 | wide[3:]
    out = np.empty(2 * len(data), np.int64)
    out[::2] = (three * np.uint32(0x9E3779B1)) >> (32 - BITS)
    out[1::2] = ((four ^ four >> 15) * np.uint32(0x85EBCA77)) >> (32 - BITS)
    return out, 2 * (np.cumsum(sizes) - sizes)


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of four bytes of each text, one text after the other; which are of letters and spaces alone; where each text starts."""
    data = np.frombuffer(GAP.join([*texts, b""]), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(GAP)
    wide = np.zeros(len(data) + 3, np.uint32)
    wide[: len(data)] = data
    four = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    word = _letters[wide]
    some = word[:-3] & word[1:-2] & word[2:-1] & word[3:] & ((four & 0xFFFF) != 0x2020)  # the gap between texts makes no runs
    return ((four ^ four >> 15) * np.uint32(0x85EBCA77) >> (32 - RUN_BITS)).astype(np.int64), some, np.cumsum(sizes) - sizes


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # of each bucket: embedding times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    known: np.ndarray | None = None  # a bit for each hashed run
    covered: float = 0.0

    def strange(self, texts: list[bytes]) -> np.ndarray:
        """Texts of which too little is covered."""
        found, some, starts = runs(texts)
        hit = some & (self.known[found >> 3] >> (found & 7) & 1).astype(bool)
        n = np.add.reduceat(some, starts, dtype=np.int64)
        share = np.add.reduceat(hit, starts, dtype=np.int64) / np.maximum(n, 1)
        return (n > 0) & (share + 1 / np.sqrt(np.maximum(n, 1)) < self.covered)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        buckets, starts = grams(texts)
        sums = np.add.reduceat(self.weights[buckets], starts, axis=0)
        return sums / np.diff(np.append(starts, len(buckets)))[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        x = logits / self.temperature
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (at, n) in enumerate(rows):
        x[i, at] = n / n.sum()
    return x


Counts = tuple[np.ndarray, np.ndarray]


def train(rows: list[Counts], labels: list[str], held: np.ndarray, words: list[Counts], ciphered: list[Counts], width: int = 16, steps: int = 900, rate: float = 20.0, batch: int = 32) -> Model:
    """As many steps for a small sample as for a large one. rows: buckets and their counts in each text; words: the same of its runs; ciphered: of the runs of the ciphered text, for held rows."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    y = np.array([langs.index(x) for x in labels])
    draw = np.random.default_rng(1)
    if held.all():
        held = np.zeros(len(rows), bool)
    fit, held = np.flatnonzero(~held), np.flatnonzero(held)
    embed = draw.normal(0, 0.5, (BUCKETS, width)).astype(np.float32)
    out, bias = np.zeros((width, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    epochs = -(-steps * batch // max(1, len(fit)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        fit = draw.permutation(fit)
        for k in range(0, len(fit), batch):
            now = fit[k : k + batch]
            x = _dense([rows[i] for i in now])
            hidden = x @ embed
            z = hidden @ out + bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            error = e / e.sum(axis=1, keepdims=True)
            error[np.arange(len(now)), y[now]] -= 1
            error /= len(now)
            back = error @ out.T
            out -= step / 10 * (hidden.T @ error)
            bias -= step / 100 * error.sum(axis=0)
            used = np.flatnonzero(x.any(axis=0))
            embed[used] -= step * (x[:, used].T @ back)
    model = Model(langs, embed @ out, bias)
    often = np.zeros((len(langs), 1 << RUN_BITS), np.uint16)
    for i in fit:
        often[y[i], words[i][0]] += 1
    seen = often.sum(axis=0, dtype=np.int64) > 1
    model.known = np.packbits(seen, bitorder="little")
    rate = often / np.maximum(np.bincount(y[fit], minlength=len(langs)), 1)[:, None]
    typical = seen & (rate > 0) & (rate >= rate.max(axis=0) / 20)
    if len(held):
        z = np.concatenate([_dense([rows[i] for i in held[k : k + 64]]) @ model.weights + bias for k in range(0, len(held), 64)])
        right = y[held]

        def loss(t: float) -> float:
            model.temperature = t
            return -float(np.log(np.maximum(model.probabilities(z)[np.arange(len(held)), right], 1e-9)).mean())

        model.temperature = min((0.25 * 1.25**i for i in range(20)), key=loss)
        p = model.probabilities(z)
        sure = np.sort(p.max(axis=1)[p.argmax(axis=1) == right])
        if len(sure):
            model.threshold = (1 / len(langs) + float(sure[len(sure) // 1000])) / 2

        def share(counts: Counts, of: np.ndarray) -> float:
            return float(of[counts[0]] @ counts[1] / counts[1].sum())

        own, other = [], []
        for i in held:
            if words[i][1].sum() >= 100:
                own.append(share(words[i], seen))
                other.append(share(ciphered[i], seen))
                if len(langs) > 1:
                    other.append(share(words[i], np.delete(typical, y[i], axis=0).any(axis=0)))
        if own:
            least, most = np.sort(own)[len(own) // 200], np.sort(other)[int(0.95 * len(other))]
            model.covered = float(min(most, least) + (least - min(most, least)) / 2)
    return model


def _counts(hashes: np.ndarray) -> Counts:
    at, n = np.unique(hashes, return_counts=True)
    return at.astype(np.int32), n.astype(np.int32)


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = 3000) -> Model:
    """df: labelled rows. Of them, the `most` with the smallest hashes of their keys are learned from, by one task."""
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    drawn = labelled.withColumn("draw", F.xxhash64("key"))
    cut = drawn.select("draw").orderBy("draw").limit(most).agg(F.max("draw")).first()[0]
    if cut is None:
        return train([], [], np.zeros(0, bool), [], [])
    sample = drawn.where(F.col("draw") <= F.lit(cut).cast("bigint")).select("draw", "key", "text", "lang")
    lists = [f"{x}_{y}" for x in ("rows", "words", "ciphered") for y in ("at", "n")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = []
            for held, value in zip(batch.column(0).to_numpy() % 5 == 0, pc.utf8_lower(batch.column(2)).to_pylist(), strict=True):
                data = value.encode()
                row = [*_counts(grams([data])[0])]
                for x in (data, data.translate(CIPHER) if held else b""):
                    hashes, some, _ = runs([x])
                    row += _counts(hashes[some])
                found.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *(pa.array([r[i] for r in found], pa.list_(pa.int32())) for i in range(6))], ["draw", "key", "lang", *lists])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws, langs, counts = [], [], [[], [], []]
        for batch in batches:
            draws += batch.column(0).to_pylist()
            langs += batch.column(2).to_pylist()
            for k in range(3):
                at, n = batch.column(3 + 2 * k), batch.column(4 + 2 * k)
                counts[k] += [(at[i].values.to_numpy(), n[i].values.to_numpy()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(counts[0], langs, np.array(draws, np.int64) % 5 == 0, counts[1], counts[2]))], pa.binary())], ["model"])

    counted = sample.mapInArrow(tidy(count), f"draw bigint, key {df.schema[key].dataType.simpleString()}, lang string, {', '.join(f'{x} array<int>' for x in lists)}")
    rows = counted.orderBy("draw", "key", "lang", "rows_at").limit(most)
    return pickle.loads(rows.mapInArrow(tidy(learn), "model binary").collect()[0].model)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred, score (calibrated probability) and rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = batch.column(len(keep)).to_pylist()
            lowered = [x or b"" for x in pc.utf8_lower(batch.column(len(keep))).cast(pa.binary()).to_pylist()]
            for start, end in by_size(lowered, 500_000):
                some = np.array([x is not None and letter(x) is not None for x in values[start:end]])
                if model.langs:
                    p = model.probabilities(model.logits(lowered[start:end]))
                    best, score = p.argmax(axis=1), np.where(some, p.max(axis=1), 0.0)
                    strange = model.strange(lowered[start:end])
                    names = [model.langs[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                else:
                    score, names, strange = np.zeros(end - start), [UNKNOWN] * (end - start), np.ones(end - start, bool)
                columns = [batch.column(i).slice(start, end - start) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(score.astype(float)), pa.array(~some | strange | (score < model.threshold))], [*keep, "lang_pred", "score", "rejected"])

    fields = [df.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double, rejected boolean"
    return df.select(*[df[c] for c in keep], df[text].cast("string").alias("__text")).mapInArrow(tidy(run), schema)
