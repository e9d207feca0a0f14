"""Document fingerprints from Lempel-Ziv phrases.

Each text's UTF-8 bytes are parsed into dictionary phrases: the longest phrase met before
and one more byte make a new phrase. The set of phrases is hashed, and the 64 smallest
distinct 32-bit hashes are the fingerprint, 8 hex digits each in ascending order. The
likeness of two fingerprints is the part of the smallest hashes of both together that both
hold: an estimate of the Jaccard similarity of the phrase sets, exact for sets of up to 64.

Null text counts as empty; its fingerprint is the empty string. Two empty fingerprints are
alike (1.0), an empty and another are not (0.0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import range_of, ranges, shuffle_partitions, slices, tidy

#: Hashes of a fingerprint.
KEPT = 64
#: Bytes of text parsed before their phrases are hashed together.
AT_ONCE = 1_000_000
NONE = np.uint64(1 << 32)
LOWEST = -(1 << 63)


def parse(data: bytes, phrases: dict[int, int], node: int = 0, fresh: int = 256) -> tuple[int, int]:
    """Adds the phrases of data: (parent's number | byte) to own number, numbers being multiples of 256 from 256 on. Returns where it stands, to go on from there."""
    put = phrases.setdefault
    for byte in data:
        node = put(node | byte, fresh)
        if node == fresh:
            fresh += 256
            node = 0
    return node, fresh


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    return (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row for each phrase set, as its keys in order of making: the smallest hashes, then NONE."""
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.full((len(sets), KEPT), NONE, np.uint64)
    if not counts.sum():
        return out
    keys = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), counts)
    parent = (keys >> 8) + np.repeat(np.cumsum(counts) - counts, counts) - 1
    top = keys < 256
    byte = (keys & 255).astype(np.uint64)
    hashes = np.zeros(len(keys), np.uint64)
    hashes[top] = _mix(byte[top] + np.uint64(1))
    done, left = top.copy(), np.flatnonzero(~top)
    while len(left):
        ready = done[parent[left]]
        now = left[ready]
        hashes[now] = _mix(hashes[parent[now]] * np.uint64(257) + byte[now] + np.uint64(1))
        left = left[~ready]
        done[now] = True
    each = np.unique(of.astype(np.uint64) << np.uint64(32) | hashes >> np.uint64(32))
    row = (each >> np.uint64(32)).astype(np.int64)
    place = np.arange(len(each)) - np.searchsorted(row, row)
    small = place < KEPT
    out[row[small], place[small]] = each[small] & np.uint64(0xFFFFFFFF)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != NONE)
    new = ~again & (both != NONE)
    rank = np.cumsum(new, axis=1)
    union = np.minimum(new.sum(axis=1), KEPT)
    shared = (again & (rank <= KEPT)).sum(axis=1)
    return np.where(union == 0, 1.0, shared / np.maximum(union, 1))


def as_text(sketch: np.ndarray) -> str:
    return sketch[sketch != NONE].astype(">u4").tobytes().hex()


def fingerprint(text: str | None) -> str:
    phrases: dict[int, int] = {}
    parse((text or "").encode(), phrases)
    return as_text(sketches([np.fromiter(phrases, np.int64, len(phrases))])[0])


def fingerprint_frame(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns and the fingerprint, whose name must be new."""
    if out in df.columns:
        raise ValueError(f"there is a column {out}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(fingerprint, batch.column(batch.schema.get_field_index(text)).to_pylist()), pa.string())], [*batch.schema.names, out])

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def compare_neighbours(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = 128_000_000) -> DataFrame:
    """For each row its fingerprint, that of its edited text, and their likeness with the next row's.

    The next row is that of the next smaller key (nulls last, equal keys by text); after the last comes
    the first. Ranges of keys of up to `most` bytes of text are for one task each; the rows of a range's
    greatest key are also sent to the range before, whose last row needs them. Each text is shuffled once.
    Rows of one key, null among them, are in one range.
    """
    rows = df.select(F.coalesce(df[key].cast("bigint"), F.lit(LOWEST)).alias("id"), df[key].isNull().alias("no_id"), F.coalesce(df[text], F.lit("")).alias("text"))
    sizes = rows.select(F.col("id").alias("at"), (F.octet_length("text") + 100).cast("bigint").alias("n"))
    starts = ranges(sizes, most, shuffle_partitions(df.sparkSession))
    greatest = np.zeros(len(starts), np.int64)
    for k, at in sizes.groupBy(range_of(F.col("at"), starts).alias("k")).agg(F.max("at")).collect() if len(starts) else ():
        greatest[k] = at

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at = np.searchsorted(starts, ids, side="right") - 1
            first = np.flatnonzero(greatest[at] == ids)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.zeros(len(ids), bool)), *batch.columns], ["bucket", "tail", *batch.schema.names])
            if len(first):
                again = batch.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([pa.array((at[first] + 1) % len(starts), pa.int32()), pa.array(np.ones(len(first), bool)), *again.columns], ["bucket", "tail", *batch.schema.names])

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def judge(chunk: list[tuple]) -> pa.RecordBatch:
        """Results for all rows of the chunk but the last, and but those from the next bucket."""
        sets, edited, plain = [], {}, []
        for i, (bucket, tail, id_, no_id, value) in enumerate(chunk):
            on = i + 1 < len(chunk) and not tail and chunk[i + 1][0] == bucket
            half = len(value) // 2 if on else 0
            head = value[: len(value) - half].encode()
            phrases: dict[int, int] = {}
            node, fresh = parse(head, phrases)
            if on:
                put = chunk[i + 1][4][:half].encode()
                other = dict(phrases)
                parse(put, other, node, fresh)
                edited[i] = len(sets), hashlib.sha256(head + put).hexdigest()
                sets.append(np.fromiter(other, np.int64, len(other)))
            if half:
                parse(value[len(value) - half :].encode(), phrases, node, fresh)
            plain.append(len(sets))
            sets.append(np.fromiter(phrases, np.int64, len(phrases)))
        found = sketches(sets)
        mine = np.fromiter(edited, np.int64, len(edited))
        plain = np.array(plain)
        a, b, c = found[plain[mine]], found[[edited[i][0] for i in edited]] if edited else found[:0], found[plain[mine + 1]] if edited else found[:0]
        values = [[None if chunk[i][3] else chunk[i][2] for i in edited], [len(chunk[i][4]) for i in edited], [edited[i][1] for i in edited], [as_text(x) for x in a], [as_text(x) for x in b], likeness(a, b), likeness(a, c)]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total = [], 0
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chunk.append(row)
                total += len(row[4])
                if total > AT_ONCE and len(chunk) > 1:
                    yield judge(chunk)
                    chunk, total = chunk[-1:], len(row[4])
        if chunk:
            yield judge(chunk)

    dealt = rows.mapInArrow(tidy(deal), "bucket int, tail boolean, id bigint, no_id boolean, text string")
    return dealt.repartitionById(max(1, len(starts)), "bucket").sortWithinPartitions("bucket", "tail", F.desc("id"), "text").mapInArrow(tidy(run), schema)
