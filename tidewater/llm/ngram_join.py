"""Join of near-equal documents on sets of n-word shingles, by parity sketches.

A document's shingles are dealt by hash into the segments of a sketch, each segment the
XOR of its shingles' 64-bit hashes. One shingle more or less changes one segment, so the
number of segments in which two sketches differ never exceeds the symmetric difference of
the sets. That is at most d for a link, so of d + 1 + v segments v + 1 at least are equal
(pigeonhole), and each equal segment is a key that both documents have.

Sizes are cut into bands that double, as all sketches compared must have the same number
of segments; a document that can link into the next band is in that band too. Empty
segments say nothing and are not keys, unless a document has too few others; then all its
segments are keys. Only the first d + 1 + v keys of a document are
needed: what comes before the (v + 1)-th equal key of a pair is at most d changed and v
equal ones. The keys thus lose no link, whatever the data.

Documents of one set are one node, found by a digest of the set (64 bits), and meet as
one. Keys of few nodes give pairs at once, with the number of such keys that they share;
a pair that can't share v + 1 keys even if all its other keys are shared goes. Pairs that share
none of these share v + 1 keys of many nodes; in an order by number of nodes, one of them
isn't among the last v of either node, so that each node leaves its last v out. What is
left of a key of many nodes is cut into blocks, where nodes meet as bit sketches: the
parity of the shingles in each of 32 cells a shingle that may differ. Their Hamming
distance never exceeds the symmetric difference either, so a pair above d is none. At
first a block only makes the pairs of its nearest spanning forest, one for a node at most;
once these have been compared and their components joined, it makes all pairs of different
components that are still possible. Comparisons are exact, on the shingles themselves.

Texts without words have an empty set and are linked with nothing; texts with fewer words
than a shingle have all their words as one shingle. Null text counts as empty.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.bpe import by_size
from tidewater.llm.common import raw, remove, shuffle_partitions, slices, tidy, work_dir

_BASE = 0x5DEECE66D2B3A6B5
#: Keys of so many nodes give pairs at once; larger ones go to blocks.
FEW = 16
#: Nodes of a block.
BLOCK = 2048
MOST_CELLS = 1 << 16
#: Members that meet one copy of their centre.
MEMBERS = 256


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % (1 << 64))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@dataclass(frozen=True)
class Limit:
    """Two sets link if 100 * intersection >= percent * union."""

    percent: int = 85

    def differ(self, a: int, b: int) -> int:
        """Largest symmetric difference of linked sets of these sizes."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)


@dataclass(frozen=True)
class Band:
    """Sizes from 2 ** low on, up to twice that."""

    low: int
    limit: Limit

    @property
    def top(self) -> int:
        return (2 << self.low) - 1

    @property
    def spare(self) -> int:
        """v: keys that a pair shares beyond the first. Many, so that texts that only share a passage don't share enough."""
        return self.limit.differ(self.top, self.top) // 4

    @property
    def cells(self) -> int:
        """Bits of a sketch, whole 64-bit words. Beyond MOST_CELLS the bound holds as before, but says less."""
        return min(MOST_CELLS, -(-32 * (self.limit.differ(self.top, self.top) + 1) // 64) * 64)

    @property
    def segments(self) -> int:
        need = self.limit.differ(self.top, self.top) + 1 + self.spare
        return need + (18 * need + 99) // 100 + 1

    def needed(self, sizes: np.ndarray) -> np.ndarray:
        partner = np.minimum(100 * sizes // self.limit.percent, self.top)
        return (100 - self.limit.percent) * (sizes + partner) // (100 + self.limit.percent) + 1 + self.spare


def votes(sizes: np.ndarray, limit: Limit) -> np.ndarray:
    """Keys that a set of this size shares with any that it links with, at least."""
    of_band = np.array([Band(b, limit).spare + 1 for b in range(40)])
    return of_band[np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)]


class Shingler:
    """Distinct shingle hashes of many texts at once."""

    def __init__(self, words: int):
        self.words = words
        self.power = self.inverse = np.ones(1, np.uint64)

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, by text; and how many each text has."""
        # a gap after each text keeps words apart
        data = np.frombuffer(b" ".join([*(t.lower() for t in texts), b""]), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        if len(self.power) <= len(data):
            self.power = np.cumprod(np.append(np.uint64(1), np.full(len(data), _BASE, np.uint64)))
            self.inverse = np.cumprod(np.append(np.uint64(1), np.full(len(data), pow(_BASE, -1, 1 << 64), np.uint64)))
        inside = np.append(False, ~((data == 32) | ((data >= 9) & (data <= 13))))
        change = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = change[::2], change[1::2]
        sums = np.append(np.uint64(0), np.cumsum((data + np.uint64(1)) * self.power[: len(data)]))
        word = mix((sums[stop] - sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))
        of = np.searchsorted(ends, start, side="right")
        count = np.bincount(of, minlength=len(texts))
        first = np.cumsum(count) - count
        shingles = np.where(count == 0, 0, np.maximum(1, count - self.words + 1))
        text = np.repeat(np.arange(len(texts)), shingles)
        at = np.arange(len(text)) + np.repeat(first - np.cumsum(shingles) + shingles, shingles)
        hashes = np.zeros(len(text), np.uint64)
        for k in range(self.words):
            there = at + k < (first + count)[text]
            hashes = mix(hashes + np.where(there, word[np.minimum(at + k, len(word) - 1)], np.uint64(7)), k) if len(word) else hashes
        order = np.argsort(hashes)
        order = order[np.argsort(text[order].astype(np.uint16) if len(texts) < 1 << 16 else text[order], kind="stable")]
        hashes, text = hashes[order], text[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])) if len(text) else np.zeros(0, bool)
        return hashes[new], np.bincount(text[new], minlength=len(texts))


def nodes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Digest of each set, whatever its order."""
    sums = np.append(np.uint64(0), np.cumsum(mix(hashes, 11)))
    ends = np.cumsum(sizes)
    return mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64) * np.uint64(_BASE), 12).view(np.int64)


def keys(hashes: np.ndarray, sizes: np.ndarray, band: Band) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sets that are all in the band, and the set that each belongs to."""
    n, wide = len(sizes), band.segments
    of = np.repeat(np.arange(n), sizes)
    cell = of * wide + (mix(hashes, 21) % np.uint64(wide)).astype(np.int64)
    count = np.bincount(cell, minlength=n * wide).reshape(n, wide)
    order = np.argsort(cell, kind="stable")
    ends = np.cumsum(count.reshape(-1))
    xor = np.append(np.uint64(0), np.bitwise_xor.accumulate(mix(hashes, 22)[order]))
    value = (xor[ends] ^ xor[ends - count.reshape(-1)]).reshape(n, wide)
    good, need = count > 0, band.needed(sizes)[:, None]
    few = good.sum(axis=1, keepdims=True) < need
    sent = few | (good & (np.cumsum(good, axis=1) <= need))
    row, segment = np.nonzero(sent)
    key = mix(value[row, segment] + np.uint64(band.low), 23) * np.uint64(2 * wide + 1) + segment.astype(np.uint64)
    return key & ~np.uint64(63) | np.uint64(band.low), row  # the last six bits tell the band


def bits(hashes: np.ndarray, sizes: np.ndarray, band: Band) -> np.ndarray:
    """Parity of the shingles in each cell, for sets that are all in the band; a row of 64-bit words for each."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    cell = of * band.cells + (mix(hashes, 31) % np.uint64(band.cells)).astype(np.int64)
    odd = np.bincount(cell, minlength=len(sizes) * band.cells).reshape(len(sizes), band.cells) & 1
    return np.packbits(odd.astype(bool), axis=1).view(np.uint64)


def _flat_keys(hashes: np.ndarray, sizes: np.ndarray, limit: Limit) -> tuple[np.ndarray, np.ndarray]:
    out, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    low = np.zeros(len(sizes), np.int64)
    low[sizes > 0] = np.floor(np.log2(sizes[sizes > 0])).astype(np.int64)
    next_too = 100 * sizes >= limit.percent * (2 << low)
    of = np.repeat(np.arange(len(sizes)), sizes)
    alone = limit.differ(sizes, 100 * sizes // limit.percent) == 0  # only equal sets link
    for b in np.unique(np.concatenate([low, low[next_too] + 1])):
        chosen = (sizes > 0) & ~alone & ((low == b) | (next_too & (low + 1 == b)))
        if chosen.any():
            which = np.flatnonzero(chosen)
            k, row = keys(hashes[chosen[of]], sizes[which], Band(int(b), limit))
            out.append(k)
            rows.append(which[row])
    return np.concatenate(out).view(np.int64), np.concatenate(rows)


def shingles(text: bytes, words: int) -> set[bytes]:
    found = text.lower().split()
    if not found:
        return set()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


class _Work:
    """Tables of one join in a folder of their own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, work_dir(spark, "ngram-join"), 0
        self.tables: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def only(self, *tables: DataFrame) -> None:
        """Removes all other tables; shuffle files go once the driver has collected its garbage."""
        kept = []
        for table, path in self.tables:
            if any(table is t for t in tables):
                kept.append((table, path))
            else:
                remove(self.spark, path)
        self.tables = kept
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def components(work: _Work, links: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """links: a, b; label: node and label so far. Returns node, label; label is the smallest node of the component.

    Each vertex joins its smallest neighbour, and edges are contracted to what then still lies between
    vertices, so that each round has less to do.
    """
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    fresh = ends if label is None else ends.join(label, "node", "left_anti")
    fresh = fresh.select("node", F.col("node").alias("label"))
    label = work.put(fresh if label is None else label.unionByName(fresh), "labels")

    def contract(edges: DataFrame, to: DataFrame) -> DataFrame:
        """to: v, low."""
        x = edges.join(to, F.col("a") == F.col("v")).select(F.col("low").alias("a"), "b")
        x = x.join(to, F.col("b") == F.col("v")).select("a", F.col("low").alias("b")).where("a <> b")
        return work.put(x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")

    edges = contract(links.select("a", "b"), label.select(F.col("node").alias("v"), F.col("label").alias("low")))
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        low = work.put(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("low")), "lows")
        label = work.put(label.join(low, F.col("label") == F.col("v"), "left").select("node", F.coalesce("low", "label").alias("label")), "labels")
        edges = contract(edges, low)
    return label


def _compare(work: _Work, pairs: DataFrame, texts: DataFrame, words: int, limit: Limit) -> DataFrame:
    """pairs: a, b. texts: node, text. Returns a, b, linked. Members go to where their centre a is, to one of several copies of it if they are many."""
    parts = shuffle_partitions(work.spark)
    many = pairs.groupBy("a").agg(F.count("*").alias("members"))
    dealt = work.put(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / MEMBERS)).alias("copy")), "dealt")
    sent = dealt.select("a", "copy", F.col("b").alias("node"), F.lit(True).alias("member")).unionByName(dealt.select("a", "copy", F.col("a").alias("node"), F.lit(False).alias("member")).distinct())
    rows = texts.join(sent, "node").select("a", "copy", "member", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base = None, set()
        for batch in slices(batches, 128):
            a, b, linked = [], [], []
            for centre, copy, member, node, text in zip(*(batch.column(i).to_pylist() for i in range(4)), raw(batch.column(4)), strict=True):
                own = shingles(text, words)
                if not member:
                    now, base = (centre, copy), own
                elif now == (centre, copy):
                    shared = len(base & own)
                    a.append(centre)
                    b.append(node)
                    linked.append(100 * shared >= limit.percent * (len(base) + len(own) - shared))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return work.put(rows.repartition(parts, "a", "copy").sortWithinPartitions("a", "copy", "member").mapInArrow(tidy(run), "a bigint, b bigint, linked boolean"), "compared")


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) of each row."""
    found = _grouped(df, key, text, words, percent)
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """The rows of df, of each group only the one with the smallest key (of equal keys that with the smallest digest of its text). Texts without words are no group and stay, but for repeated rows. Columns may have any names."""
    found = _grouped(df, key, text, words, percent)
    chosen = found.where((F.col("n") > 0) & F.col("id").eqNullSafe(F.col("least"))).groupBy("label").agg(F.min(F.struct("id", "text_key")).alias("first")).select("first.*")
    chosen = chosen.unionByName(found.where("n = 0").select("id", "text_key").distinct())
    chosen = chosen.select(F.col("id").alias("first_id"), F.col("text_key").alias("first_key"))
    rows = df.select(df[key].cast("bigint").alias("id"), F.xxhash64(_content(df, text)).alias("text_key"), F.struct(*[df[c] for c in df.columns]).alias("row"))
    kept = rows.join(chosen, rows["id"].eqNullSafe(chosen["first_id"]) & (rows["text_key"] == chosen["first_key"]))
    once = kept.withColumn("nth", F.row_number().over(Window.partitionBy("first_id", "first_key").orderBy(F.lit(0))))
    return once.where("nth = 1").select("row.*")


def near_links(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """key and n_links, the number of other rows that each row links with, exactly. Equal sets are counted, not compared; of different sets all links are found, so a group of near copies costs the square of its different sets."""
    work, limit, described, rows, texts = _prepared(df, key, text, words, percent)
    pairs = _pairs_of_few(work, rows)
    hot = _sketched(work, rows, texts, words, limit)
    pairs = work.put(pairs.unionByName(_pairs_of_many(hot, None, limit, True)).distinct(), "pairs")
    linked = _compare(work, pairs, texts, words, limit).where("linked")
    copies = work.put(described.groupBy("node").agg(F.count("*").alias("copies")), "copies")
    ends = linked.select(F.explode(F.array(F.struct(F.col("a").alias("of"), F.col("b").alias("node")), F.struct(F.col("b").alias("of"), F.col("a").alias("node")))).alias("e")).select("e.*")
    others = ends.join(copies, "node").groupBy(F.col("of").alias("node")).agg(F.sum("copies").alias("others"))
    counted = described.join(copies, "node").join(others, "node", "left")
    out = work.put(counted.select("id", F.when(F.col("n") == 0, F.lit(0)).otherwise(F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("bigint").alias("n_links")), "links")
    work.only(out)
    return out.select(F.col("id").alias(key), "n_links")


def _content(df: DataFrame, text: str) -> Column:
    return F.coalesce(df[text].cast("string"), F.lit(""))


def _useful(rows: DataFrame) -> DataFrame:
    """Rows of nodes that have as many keys as a link needs, and of keys that then still hold more than one node."""
    for _ in range(2):
        own = rows.groupBy("node").agg(F.count("*").alias("own"), F.max("votes").alias("needs")).where("own >= needs").select("node")
        rows = rows.join(own, "node", "left_semi")
        rows = rows.join(rows.groupBy("key").agg(F.count("*").alias("nodes")).where("nodes > 1").select("key"), "key", "left_semi")
    return rows


def _prepared(df: DataFrame, key: str, text: str, words: int, percent: int) -> tuple[_Work, Limit, DataFrame, DataFrame, DataFrame]:
    """Rows described by id, text_key, node and n; keys that nodes share, with the number of their nodes; a text of each of these nodes."""
    spark, limit = df.sparkSession, Limit(percent)
    work = _Work(spark)
    content = _content(df, text)
    rows = df.select(df[key].cast("bigint").alias("id"), F.xxhash64(content).alias("text_key"), content.alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches, 4096):
            values = raw(batch.column(2))
            for start, end in by_size(values):
                hashes, sizes = shingler.sets(values[start:end])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start), pa.array(nodes(hashes, sizes)), pa.array(sizes, pa.int64())], ["id", "text_key", "node", "n"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys of sets that the task hasn't seen."""
        shingler, seen = Shingler(words), set()
        for batch in slices(batches, 4096):
            values = raw(batch.column(0))
            for start, end in by_size(values):
                hashes, sizes = shingler.sets(values[start:end])
                found = nodes(hashes, sizes)
                new = np.zeros(len(found), bool)
                for i, node in enumerate(found.tolist()):
                    new[i] = node not in seen
                    seen.add(node)
                if len(seen) > 1_000_000:
                    seen.clear()
                hashes, sizes, found = hashes[np.repeat(new, sizes)], sizes[new], found[new]
                key_, row = _flat_keys(hashes, sizes, limit)
                yield pa.RecordBatch.from_arrays([pa.array(key_), pa.array(found[row]), pa.array(votes(sizes, limit)[row], pa.int64())], ["key", "node", "votes"])

    described = work.put(rows.mapInArrow(tidy(describe), "id bigint, text_key bigint, node bigint, n bigint"), "documents")
    dealt = rows.select("text").mapInArrow(tidy(emit), "key bigint, node bigint, votes bigint")
    same = Window.partitionBy("key")
    between = dealt.withColumn("low", F.min("node").over(same)).withColumn("high", F.max("node").over(same)).where("low < high").drop("low", "high")
    shared = work.put(between.distinct(), "shared")
    work.only(described, shared)
    active = work.put(_useful(shared), "keys")
    members = work.put(active.groupBy("key").agg(F.count("*").alias("members")), "members")
    counted = work.put(active.join(members, "key"), "counted")
    work.only(described, counted)

    # texts of nodes that share a key, one for each
    first = described.groupBy("node").agg(F.min(F.struct("id", "text_key")).alias("first")).select("node", "first.id", "first.text_key")
    wanted = first.join(counted.select("node").distinct(), "node")
    texts = work.put(rows.join(wanted, rows["id"].eqNullSafe(wanted["id"]) & (rows["text_key"] == wanted["text_key"])).select("node", "text").dropDuplicates(["node"]), "texts")
    work.only(described, counted, texts)
    return work, limit, described, counted, texts


def _pairs_of_few(work: _Work, rows: DataFrame) -> DataFrame:
    """a, b: pairs that share keys of few nodes, and could share as many keys as a link needs."""
    few = rows.where(F.col("members") <= FEW).select("key", "node", "votes")
    hot = rows.where(F.col("members") > FEW).groupBy("node").agg(F.count("*").alias("hot"))
    x, y = few.alias("x"), few.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")))
    met = met.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("x.votes", "y.votes")).alias("votes"))
    for end in ("a", "b"):
        met = met.join(hot.select(F.col("node").alias(end), F.col("hot").alias(f"hot_{end}")), end, "left")
    return met.where(F.col("shared") + F.least(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0))) >= F.col("votes")).select("a", "b")


def _sketched(work: _Work, rows: DataFrame, texts: DataFrame, words: int, limit: Limit) -> DataFrame:
    """Of the keys of many nodes, without each node's last v: key, members, node, n, sketch."""
    ranked = rows.where(F.col("members") > FEW).withColumn("left", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("members"), F.desc("key"))))
    kept = ranked.where(F.col("left") >= F.col("votes")).groupBy("node").agg(F.collect_list(F.struct("key", "members")).alias("keys"))  # a document's own keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches, 128):
            values = raw(batch.column(1))
            for start, end in by_size(values):
                hashes, sizes = shingler.sets(values[start:end])
                of = np.repeat(np.arange(len(sizes)), sizes)
                node, lists = batch.column(0).slice(start, end - start).to_numpy(), batch.column(2).slice(start, end - start)
                flat = lists.flatten()
                key, members = flat.field("key").to_numpy(), flat.field("members").to_numpy()
                row = np.repeat(np.arange(len(sizes)), lists.value_lengths().to_numpy())
                for low in np.unique(key & 63).tolist():
                    at = np.flatnonzero(key & 63 == low)
                    sets, place = np.unique(row[at], return_inverse=True)
                    inside = np.zeros(len(sizes), bool)
                    inside[sets] = True
                    sketch = bits(hashes[inside[of]], sizes[sets], Band(low, limit))
                    step = max(1, 8_000_000 // sketch[0].nbytes)
                    for k in range(0, len(at), step):
                        now = at[k : k + step]
                        sent = sketch[place[k : k + step]]
                        ends = pa.array(np.arange(len(now) + 1, dtype=np.int32) * sent[0].nbytes)
                        packed = pa.Array.from_buffers(pa.binary(), len(now), [None, ends.buffers()[1], pa.py_buffer(sent.tobytes())])
                        yield pa.RecordBatch.from_arrays([pa.array(key[now]), pa.array(members[now]), pa.array(node[row[now]]), pa.array(sizes[row[now]], pa.int64()), packed], ["key", "members", "node", "n", "sketch"])

    return work.put(texts.join(kept, "node").select("node", "text", "keys").mapInArrow(tidy(run), "key bigint, members bigint, node bigint, n bigint, sketch binary"), "sketches")


def possible(sketch: np.ndarray, n: np.ndarray, label: np.ndarray, chunk: np.ndarray, limit: Limit, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block whose Hamming distance allows a link, between labels (and, if there are two chunks, between these): all of them, or those of a spanning forest of the nearest."""
    g, across = len(n), len(np.unique(chunk)) > 1
    step = max(1, 2_000_000 // (g * sketch.shape[1]))
    far = np.full((g, g), np.inf, np.float32) if not every else None
    out = [np.zeros((0, 2), np.int64)]
    for a in range(0, g, step):
        z = min(g, a + step)
        most = (100 - limit.percent) * (n[a:z, None] + n[None]) // (100 + limit.percent)
        distance = np.bitwise_count(sketch[a:z, None] ^ sketch[None]).sum(axis=2, dtype=np.int32)
        fine = (distance <= most) & (label[a:z, None] != label[None])
        if across:
            fine &= chunk[a:z, None] != chunk[None]
        if every:
            i, j = np.nonzero(fine)
            out.append(np.stack([i + a, j], axis=1)[i + a < j])
        else:
            far[a:z] = np.where(fine, (distance + 1) / (most + 1), np.inf)
            far[a:z][label[a:z, None] == label[None]] = 0
    if every:
        found = np.concatenate(out)
        return found[:, 0], found[:, 1]
    a, b = [], []
    away, by, free = np.full(g, np.inf, np.float32), np.zeros(g, np.int64), np.ones(g, bool)
    for _ in range(g):  # Prim's algorithm
        k = int(np.where(free, away, np.inf).argmin())
        if not free[k] or away[k] == np.inf:
            k = int(free.argmax())
        elif away[k] > 0:
            a.append(by[k])
            b.append(k)
        free[k] = False
        nearer = free & (far[k] < away)
        away[nearer], by[nearer] = far[k][nearer], k
    return np.array(a, np.int64), np.array(b, np.int64)


def _pairs_of_many(hot: DataFrame, label: DataFrame | None, limit: Limit, every: bool) -> DataFrame:
    """a < b: pairs of different labels that blocks of keys of many nodes find possible."""
    marked = hot.withColumn("label", F.col("node")) if label is None else hot.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    chunks = F.ceil(F.col("members") / BLOCK)
    cut = marked.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
    cut = cut.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "label", "n", "sketch")

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        chunk, node, names, n = (table.column(k).to_numpy() for k in range(3, 7))
        a = b = np.zeros(0, np.int64)
        if len(np.unique(names)) > 1:
            sketch = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint64).reshape(len(n), -1)
            a, b = possible(sketch, n, names, chunk, limit, every)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in slices(batches, 4096):
            place = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)], strict=True):
                if parts and now != tuple(place[a]):
                    yield block(parts)
                    parts = []
                now = tuple(place[a])
                parts.append(batch.slice(a, z - a))
        if parts:
            yield block(parts)

    return cut.repartition(shuffle_partitions(hot.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(tidy(run), "a bigint, b bigint").distinct()


def _grouped(df: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """id, text_key, n, label, least of each row."""
    work, limit, described, rows, texts = _prepared(df, key, text, words, percent)
    few = work.put(_pairs_of_few(work, rows), "pairs")
    hot = _sketched(work, rows, texts, words, limit)
    work.only(described, texts, few, hot)
    pairs = work.put(few.unionByName(_pairs_of_many(hot, None, limit, False)).distinct(), "pairs")
    tested = _compare(work, pairs, texts, words, limit)
    work.only(described, texts, hot, tested)
    label = components(work, tested.where("linked"))
    left = _pairs_of_many(hot, label, limit, True).join(tested.select("a", "b"), ["a", "b"], "left_anti")
    left = work.put(left, "pairs")
    if not left.isEmpty():
        label = components(work, _compare(work, left, texts, words, limit).where("linked"), label)
    work.only(described, label)
    placed = described.join(label, "node", "left").select("id", "text_key", "n", F.coalesce("label", "node").alias("label"))
    least = work.put(placed.groupBy("label").agg(F.min("id").alias("least")), "least")  # a table, so that its join can split a large component
    out = work.put(placed.join(least, "label"), "groups")
    work.only(out)
    return out
