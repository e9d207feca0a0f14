"""Personal data: fixed forms, and what their contexts lead to.

Base spans come from four forms (email, ip, card, phone). They are the seeds of a
bootstrap. A pattern is what stands around a span: the two words before it and the word
after, or either alone, in lower case with digits as 0. An instance is a value that is
shaped like an identifier (`candidates`) or a base span. Of a word of more than REACH
characters, those nearest to the span stand for it.

Spark scores the graph of patterns and instances round by round. Seeds have confidence 1 in
their kind. A pattern's score for a kind is the sum of its distinct instances' confidences
over their number and one; it is trusted once `support` of its instances have any, its score
is `sure` or more and the share that has any isn't luck (the lower end of its 95 % interval
is `share` or more). Instances without a confidence get that of the best pattern that was
trusted in the round, and support other patterns from the next round on, so that confidence
fades with each step away from the seeds. Rounds end when no pattern is added. Scores are
whole millionths, so that sums don't depend on their order. Candidates beside trusted patterns
become spans of the kind `ctx_` and the pattern's kind. All patterns with `support` instances
are in the graph, whatever these are; it is a table, and so are scores: none is collected.

Positions are code points, ends exclusive. Null text counts as empty and has no spans.
Rows that repeat each get their spans, and count as one instance.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import slices, tidy, written

KINDS = ("email", "ip", "card", "phone")
_domain = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Candidates: a word that holds 4 digits or more among letters, digits and signs; neighbouring groups of digits; `name at host dot domain`, in brackets or not.
WORD = re.compile(r"(?<!\S)(?=\S*\d)[\w#./:(),+-]++(?!\S)")
_group = r"\(?\+?\d[\d()./-]*+(?=[^\w\s]*+(?!\S))"
GROUPS = re.compile(rf"(?<![\w.,/()+-]){_group}(?:[^\S\r\n]{_group})+")
#: Names of mailboxes have 64 characters at most, labels of hosts 63 (RFC 5321, RFC 1035); so no word is gone over more often than that.
OBFUSCATED = re.compile(r"(?<![\w.-])[A-Za-z0-9._-]{1,64} ?[(\[]? ?at ?[)\]]? ?[A-Za-z0-9-]{1,63}(?: ?[(\[]? ?dot ?[)\]]? ?[A-Za-z0-9-]++)++(?!\w)")
_digit = re.compile(r"\d")
_word = re.compile(r"\S+")
#: Characters that stand for a longer word.
REACH = 60


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+` finds them, in linear time: from each @ back over the run before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _local_char(text[start - 1]):
            start -= 1
        found = _domain.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_local_char = _LOCAL.__contains__


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start, end; by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if not re.search("[0-9]", text):
        return out
    out += [("ip", m.start(), m.end()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _card.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _phone.finditer(text) if 8 <= sum(map("0123456789".__contains__, m[0])) <= 15]
    return out


def words_of(text: str) -> tuple[list[int], list[int]]:
    """Where words start and end."""
    spans = [m.span() for m in _word.finditer(text)]
    return [a for a, _ in spans], [b for _, b in spans]


def contexts(text: str, start: int, end: int, words: tuple[list[int], list[int]] | None = None) -> list[str]:
    """Patterns L (up to two words before), R (what follows, up to a word with a letter or digit) and B. Of a word of more than REACH characters those nearest to the span stand for it."""
    starts, ends = words or words_of(text)
    shape = lambda w: re.sub(r"\d", "0", w.lower())
    k = bisect_left(starts, start)
    before = [shape(text[max(starts[i], min(ends[i], start) - REACH) : min(ends[i], start)]) for i in range(max(0, k - 2), k)]
    k = bisect_right(ends, end)
    after = []
    for i in range(k, min(k + 2, len(starts))):
        a = max(starts[i], end)
        after.append(shape(text[a : min(ends[i], a + REACH)]))
        if any(map(str.isalnum, after[-1])):
            break
    out = []
    if before:
        out.append(f"L {' '.join(before)}")
        if after:
            out.append(f"B {' '.join(before)} _ {after[0]}")
    if after and any(map(str.isalnum, after[-1])):  # a full stop alone marks nothing
        out.append(f"R {' '.join(after)}")
    return out


def _obfuscated(text: str) -> bool:
    """Whether the text can hold an obfuscated address."""
    return "at" in text and "dot" in text


def candidates(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, bool]]:
    """Spans shaped like identifiers that touch no base span, and whether each is whole, not part of a longer one."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(a: int, b: int) -> bool:
        k = bisect_right(ends, a)
        return k == len(ends) or starts[k] >= b

    enough = lambda a, b: sum(map(str.isdigit, text[a:b])) >= 4
    found = set()
    for m in OBFUSCATED.finditer(text) if _obfuscated(text) else ():
        if free(*m.span()):
            found.add(m.span())
    for m in WORD.finditer(text) if _digit.search(text) else ():
        a, b = m.start(), m.start() + len(m[0].rstrip(".:,)"))
        if enough(a, b) and free(a, b):
            found.add((a, b))
    for m in GROUPS.finditer(text):
        for there, run in groupby((w.span() for w in _word.finditer(text, *m.span())), lambda w: free(*w)):
            run = list(run)
            a, b = run[0][0], run[-1][1]
            b = a + len(text[a:b].rstrip("./-()"))
            if text[b : b + 1] == ")" and text.rfind("(", a, b) > text.rfind(")", a, b):
                b += 1
            if there and len(run) > 1 and enough(a, b):
                found.add((a, b))
    reach = 0
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        yield a, b, b > reach
        reach = max(reach, b)


GRAPH = "pattern string, instance string, kind string, row string, start int, end int, whole boolean"


def _instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each span or candidate its contexts; kind is null for candidates. row: digest of the text, as equal texts have equal spans."""
    for batch in slices(batches):
        rows = []
        for text in batch.column(0).to_pylist():
            if not text or "@" not in text and not _digit.search(text) and not _obfuscated(text):
                continue
            base = base_spans(text)
            row = words = None
            for kind, a, b, whole in [*((*s, True) for s in base), *((None, *s) for s in candidates(text, base))]:
                row = row or hashlib.sha256(text.encode()).hexdigest()[:32]
                words = words or words_of(text)
                value = hashlib.sha256(text[a:b].lower().encode()).hexdigest()[:24]
                rows += [(c, value, kind, row, a, b, whole) for c in contexts(text, a, b, words)]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, [*[pa.string()] * 4, pa.int32(), pa.int32(), pa.bool_()], strict=True)], ["pattern", "instance", "kind", "row", "start", "end", "whole"])


#: Confidence of a seed.
ONE = 1_000_000


def least_share(some: Column, n: Column) -> Column:
    """Lower end of Wilson's 95 % interval."""
    z2 = 1.96**2
    p = some / n
    return (p + z2 / (2 * n) - F.sqrt(z2 * (p * (1 - p) / n + z2 / (4 * n * n)))) / (1 + z2 / n)


def bootstrap(df: DataFrame, text: str = "text", support: int = 5, sure: float = 0.6, share: float = 0.55) -> DataFrame:
    """Spans that trusted patterns find: row (digest of the text), kind, start, end."""
    spark = df.sparkSession
    seen = written(spark, df.select(df[text].cast("string")).mapInArrow(tidy(_instances), GRAPH), "pii-graph")
    edges = seen.where("whole").groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))  # a value is an instance of a pattern once, and a part of it isn't another
    edges = written(spark, edges, "pii-edges")
    size = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    graph = written(spark, edges.join(size, "pattern").select("pattern", "instance", "n"), "pii-patterns")
    known = edges.where("kind IS NOT NULL").groupBy("instance").agg(F.max("kind").alias("of")).select("instance", "of", F.lit(ONE).cast("bigint").alias("p"))
    known = written(spark, known, "pii-known")
    trusted = None
    while True:
        scores = graph.join(known, "instance").groupBy("pattern", "of").agg(F.count("*").alias("some"), F.max("n").alias("n"), (F.sum("p") / (F.max("n") + 1)).cast("bigint").alias("score"))
        new = scores.where((F.col("some") >= support) & (F.col("score") >= int(sure * ONE)) & (least_share(F.col("some"), F.col("n")) >= share)).groupBy("pattern").agg(F.max(F.struct("score", "of")).alias("best")).select("pattern", "best.of", "best.score")
        new = written(spark, new if trusted is None else new.join(trusted, "pattern", "left_anti"), "pii-trusted")
        if new.isEmpty():
            break
        trusted = new if trusted is None else written(spark, trusted.unionByName(new), "pii-trusted")
        found = graph.join(new, "pattern").groupBy("instance").agg(F.max(F.struct("score", "of")).alias("best")).select("instance", "best.of", F.col("best.score").alias("p"))
        known = written(spark, known.unionByName(found.join(known, "instance", "left_anti")), "pii-known")
    spans = seen.where(F.col("kind").isNull()).join(new if trusted is None else trusted, "pattern")
    return spans.groupBy("row", "start", "end").agg(F.max(F.struct("score", "of")).alias("best")).select("row", F.concat(F.lit("ctx_"), "best.of").alias("kind"), "start", "end")


def find(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), method: bool = True) -> DataFrame:
    """The kept columns with n_email, n_ip, n_card, n_phone, base_sha256 and spans."""
    rows = df.select(*[df[c] for c in keep], df[text].cast("string").alias("__text"))
    extra = None
    if method:
        extra = bootstrap(df, text).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("__extra")).withColumnRenamed("row", "__row")
        extra = written(df.sparkSession, extra, "pii-spans")
        if extra.isEmpty():
            extra = None  # nothing to join
        else:
            rows = rows.withColumn("__row", F.substring(F.sha2(F.col("__text").cast("binary"), 256), 1, 32))

    fields = [df.schema[c] for c in keep]
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema = f"{named}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, __base string, __row string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: list[list[int]] = [[], [], [], []]
            digests, listed, k = [], [], len(keep)
            for value in batch.column(k).to_pylist():
                spans = base_spans(value or "")
                for i, kind in enumerate(KINDS):
                    counts[i].append(sum(s[0] == kind for s in spans))
                joined = ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)
                listed.append(joined)
                digests.append(hashlib.sha256(joined.encode()).hexdigest())
            marks = batch.column(k + 1) if batch.num_columns > k + 1 else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(listed, pa.string()), marks], [*keep, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "__base", "__row"])

    base = rows.mapInArrow(tidy(run), schema)
    if extra is None:
        return base.withColumnRenamed("__base", "spans").drop("__row")
    more = F.array_join(F.transform("__extra", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return base.join(extra, "__row", "left").withColumn("spans", F.concat_ws(",", F.when(F.col("__base") != "", F.col("__base")), more)).drop("__base", "__row", "__extra")


def redact(text: str, spans: str) -> str:
    """The text with each span, merged where they overlap, replaced by its kind in angle brackets."""
    found = sorted(((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in spans.split(",") if s)), key=lambda s: (s[0], -s[1]))
    out, at = [], 0
    for a, b, kind in found:
        if a >= at:
            out += [text[at:a], f"<{kind.removeprefix('ctx_').upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_frame(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df with all spans in their texts replaced by their kinds. Null text stays null."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != text]
    packed = df.select(F.struct(F.lit(0).alias("__"), *rest).alias("row"), F.col(f"`{text}`").alias("text"))
    found = find(packed, "text", ("row", "text")).select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, spans = batch.column(1), batch.column(2).to_pylist()
            if any(spans):
                texts = pa.array([redact(t, s) if s else t for t, s in zip(texts.to_pylist(), spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["row", "text"])

    done = found.select("row", "text", "spans").mapInArrow(tidy(run), packed.schema)
    return done.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])
