"""Conversations as one formatted text each, and back.

A turn is START role MIDDLE text END. Texts and roles may hold any control string: a
backslash after its first character makes it ordinary text, one more if backslashes stand
there already, so that reading removes exactly what formatting added. No control string's
first character occurs in the rest of one, so escapes never overlap.

Rows are shuffled by conversation and sorted by turn (nulls first; equal turns by role,
then text). Batches of turns are assembled column-wise: lengths of all segments, their
running sum as places in the output, and one gather from a pool of headers and contents
into a buffer that becomes the Arrow column as it is. The loss mask is the list of code
point ranges of the assistant's texts in the formatted text.

Null texts and roles are empty. Rows whose conversation is null form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidewater.llm.bpe import spread
from tidewater.llm.common import shuffle_partitions, slices, tidy

START, MIDDLE, END = "<|turn|>", "<|says|>", "<|done|>"
#: Control strings of this template and of others: first character and rest.
CONTROL = (("<", "|"), ("<", "s>"), ("<", "/s>"), ("[", "INST]"), ("[", "/INST]"))
_rests = {a: "|".join(re.escape(r) for f, r in CONTROL if f == a) for a, _ in CONTROL}
_plain = re.compile("|".join(rf"(?<={re.escape(a)})(\\*+)(?={r})" for a, r in _rests.items()))
_marked = re.compile("|".join(rf"(?<={re.escape(a)})\\(\\*+)(?={r})" for a, r in _rests.items()))
_turn = re.compile(re.escape(START) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return _plain.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _marked.sub(lambda m: m[0][1:], text)


def _escaped(column: pa.Array) -> pa.Array:
    """Most texts hold no control string, with or without backslashes, and stay as they are."""
    column = pc.fill_null(column.cast(pa.string()), "")
    doubtful = pc.match_substring_regex(column, "|".join(rf"{re.escape(a)}\\*(?:{r})" for a, r in _rests.items())).to_numpy(zero_copy_only=False)
    if doubtful.any():
        values = column.to_pylist()
        for i in np.flatnonzero(doubtful):
            values[i] = escape(values[i])
        column = pa.array(values, pa.string())
    return column


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The column's bytes, where each value starts, and its length."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets)


def assemble(roles: pa.Array, texts: pa.Array, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Formatted conversations from escaped turns; ends: number of turns up to the end of each. Also where each turn's text starts, in bytes of the whole output."""
    heads = [np.frombuffer(x.encode(), np.uint8) for x in (START, MIDDLE, END)]
    role, role_at, role_n = _bytes(roles)
    text, text_at, text_n = _bytes(texts)
    pool = np.concatenate([*heads, role, text])
    place = np.cumsum([0, *map(len, heads), len(role)])
    n = len(roles)
    lengths, sources = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    for k, (at, size) in enumerate(((place[0], len(heads[0])), (place[3] + role_at, role_n), (place[1], len(heads[1])), (place[4] + text_at, text_n), (place[2], len(heads[2])))):
        sources[:, k], lengths[:, k] = at, size
    total = np.cumsum(lengths.reshape(-1))
    out = pool[spread(sources.reshape(-1), lengths.reshape(-1))]
    offsets = np.append(0, total[5 * ends - 1]).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])
    return whole, total.reshape(n, 5)[:, 2]


FORMATTED = "n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"


def format_frame(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant", at_once: int = 4_000_000) -> DataFrame:
    """conv_id, n_turns, formatted, loss."""
    spark = df.sparkSession
    rows = df.select(df[conv].cast("bigint").alias("conv"), df[turn].alias("turn"), df[role].cast("string").alias("role"), df[text].cast("string").alias("text"))

    def finish(convs: list, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        """convs: a number for each row that changes with the conversation."""
        table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        change = np.flatnonzero(np.diff(np.asarray(convs)))
        ends = np.append(change + 1, table.num_rows)
        roles, texts = table.column(1), table.column(2)
        marked = _escaped(texts)
        whole, text_at = assemble(_escaped(roles), marked, ends)
        data = np.frombuffer(whole.buffers()[2], np.uint8) if len(whole) else np.zeros(0, np.uint8)
        points = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # code points before each byte
        starts = np.append(0, ends[:-1])
        begun = np.frombuffer(whole.buffers()[1], np.int64)
        of = np.repeat(np.arange(len(ends)), ends - starts)
        size = _bytes(marked)[2]
        first = points[text_at] - points[begun[of]]
        last = points[text_at + size] - points[begun[of]]
        learn = np.flatnonzero(pc.fill_null(pc.equal(roles, trained), False).to_numpy(zero_copy_only=False))
        cuts = np.searchsorted(learn, np.append(starts, table.num_rows))
        spans = pa.StructArray.from_arrays([pa.array(first[learn], pa.int64()), pa.array(last[learn], pa.int64())], ["start", "end"])
        loss = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans)
        return pa.RecordBatch.from_arrays([table.column(0).take(pa.array(starts)), pa.array(ends - starts, pa.int64()), whole.cast(pa.string()), loss], ["conv_id", "n_turns", "formatted", "loss"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finishes all conversations but the last when enough has come together."""
        parts, convs, number, last, total = [], [], 0, (), 0
        for batch in slices(batches, 4096):
            for value in batch.column(0).to_pylist():
                number += (value,) != last
                last = (value,)
                convs.append(number)
            parts.append(pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3)], ["conv", "role", "text"]))
            total += batch.column(3).nbytes
            if total > at_once and convs[0] != number:
                cut = len(convs) - convs[::-1].index(number - 1) if convs[-1] != convs[0] else 0
                whole = pa.Table.from_batches(parts)
                yield finish(convs[:cut], whole.slice(0, cut).to_batches())
                parts, convs = whole.slice(cut).to_batches(), convs[cut:]
                total = sum(p.column(2).nbytes for p in parts)
        if convs:
            yield finish(convs, parts)

    sorted_rows = rows.repartition(shuffle_partitions(spark), "conv").sortWithinPartitions("conv", "turn", "role", "text")
    return sorted_rows.mapInArrow(tidy(run), f"conv_id bigint, {FORMATTED}")


def read(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation: role, text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _turn.finditer(formatted)]


def read_frame(df: DataFrame) -> DataFrame:
    """Digests of what is read back from formatted conversations and their loss masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows = []
            for formatted, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read(formatted)
                whole = hashlib.sha256()
                for role, text in turns:
                    whole.update(f"{role}\n{text}\n".encode())
                learned = "".join(unescape(formatted[x["start"] : x["end"]]) for x in loss)
                rows.append((len(turns), whole.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
            n, digest, chars, learned, size = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(chars, pa.int64()), pa.array(learned, pa.string()), pa.array(size, pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return df.select("conv_id", "formatted", "loss").mapInArrow(tidy(run), "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
