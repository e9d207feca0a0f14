"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a byte string the table holds the one token that ends the prefix's
encoding. Encodings of prefixes nest: what precedes the last token is the encoding of
the shorter prefix. So a string is encoded by filling the table from left to right and
walking it backwards, an append only fills further cells, and an edit keeps all cells
before it.

Whether token `t` may follow the last token `s` of a shorter prefix depends on `s` and
`t` alone. Merges run in the order of their ranks, as a merge only makes pairs of later
ranks. Up to a rank, the token at the right edge of `s` and that at the left edge of `t`
are therefore known; `t` may follow unless two such edge tokens, present at the same
time, merge before either is merged inside its own token.

Null text is encoded as empty. Bytes that aren't UTF-8 are replaced by U+FFFD, as the
regular expression that splits the text works on characters.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewater.llm.common import raw, slices, tidy

#: Rank above all others.
NEVER = 1 << 60
#: Pairs of tokens that an encoder remembers.
PAIRS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixBPE:
    """Encoder for one vocabulary; `append` and `edit` continue a table that `table` began."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self._edges: dict[int, tuple | None] = {}
        self._follows: dict[int, bool] = {}
        self._steps: dict[int, int] = {}
        self._ends: dict[int, int] = {}

    def _edge(self, rank: int) -> tuple | None:
        """Tokens at the token's left and right edge over time, each with the rank that ends it; None if merges never make the token."""
        if rank in self._edges:
            return self._edges[rank]
        token = self.token[rank]
        if len(token) == 1:
            edge = (((token, NEVER),), ((token, NEVER),))
        else:
            parts = [token[i : i + 1] for i in range(len(token))]
            if any(p not in self.ranks for p in parts):
                parts = []
            left, right = [(parts[0], NEVER)] if parts else [], [(parts[-1], NEVER)] if parts else []
            while len(parts) > 1:
                at, k = min(((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1)), default=(NEVER, 0))
                if at == NEVER:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                if k == 0:
                    left[-1] = (left[-1][0], at)
                    left.append((parts[0], NEVER))
                if k == len(parts) - 1:
                    right[-1] = (right[-1][0], at)
                    right.append((parts[-1], NEVER))
            edge = (tuple(left), tuple(right)) if len(parts) == 1 else None
        self._edges[rank] = edge
        return edge

    def _judge(self, s: int, t: int) -> bool:
        a, b = self._edge(s), self._edge(t)
        if not a or not b:
            return False
        get = self.ranks.get
        for x, until_x in a[1]:
            for y, until_y in b[0]:
                at = get(x + y)
                # of equal ranks the leftmost pair merges first
                if at is not None and at < until_x and at <= until_y:
                    return False
        return True

    def follows(self, s: int, t: int) -> bool:
        """Whether the encoding of the bytes of s and t is s, t."""
        key = s << 32 | t
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) >= PAIRS:
                self._follows.clear()
            known = self._follows[key] = self._judge(s, t)
        return known

    def _grow(self) -> None:
        """Trie of all tokens: (node | byte) to the next node; nodes are multiples of 256."""
        steps, ends, size = {}, {}, 256
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                key = node | byte
                node = steps.get(key)
                if node is None:
                    node = steps[key] = size
                    size += 256
            ends[node] = rank
        self._steps, self._ends = steps, ends

    def table(self, data: bytes, cells: list[int] | None = None) -> list[int]:
        """cells[i]: last token of data[:i], -1 for the empty prefix; given cells are kept and the rest filled in."""
        if not self._steps:
            self._grow()
        step, end, known, follows = self._steps.get, self._ends.get, self._follows.get, self.follows
        size = len(data)
        first = len(cells) if cells else 1
        cells = [*cells, *[None] * (size + 1 - first)] if cells else [-1, *[None] * size]
        for j in range(max(0, first - self.longest), size):
            before = cells[j]
            if before is None:
                raise ValueError(f"no token for byte {data[j - 1]}")
            node = 0
            for i in range(j, size):
                node = step(node | data[i])
                if node is None:
                    break
                if cells[i + 1] is None:
                    t = end(node)
                    if t is not None:
                        if j:
                            valid = known(before << 32 | t)
                            if valid is None:
                                valid = follows(before, t)
                        else:
                            valid = self._edge(t) is not None
                        if valid:
                            cells[i + 1] = t
        if size and cells[size] is None:
            raise ValueError(f"no token for byte {data[size - 1]}")
        return cells

    def ids(self, cells: list[int]) -> list[int]:
        out, i = [], len(cells) - 1
        while i:
            out.append(cells[i])
            i -= len(self.token[cells[i]])
        out.reverse()
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        """As the library does it: a piece that is a token is that token, whether or not merges make it."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.ids(self.table(data))

    def append(self, data: bytes, cells: list[int], more: bytes) -> tuple[bytes, list[int]]:
        return data + more, self.table(data + more, cells)

    def edit(self, data: bytes, cells: list[int], start: int, end: int, put: bytes) -> tuple[bytes, list[int]]:
        """Replaces data[start:end]. Cells up to start stay as they are; those after the edit, once as many as the longest token's bytes are what they were, as a cell depends on no others."""
        shift = len(put) - (end - start)
        data = data[:start] + put + data[end:]
        new, at = cells[: start + 1], start + len(put)
        while True:
            at = min(len(data), at + self.longest)
            new = self.table(data[:at], new)
            low = at - self.longest + 1
            if at == len(data):
                return data, new
            if low >= start + len(put) and new[low:] == cells[low - shift : at + 1 - shift]:
                return data, new + cells[at + 1 - shift :]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Document:
    """A text with its pieces and their tables, kept right under appends and edits.

    An edit splits the text anew from the first piece that could see it, until a piece starts where
    one did before; of these pieces only what differs is encoded. The pattern may look one
    character ahead of a piece, and nothing back.
    """

    def __init__(self, bpe: PrefixBPE, pattern: str, text: str = ""):
        self.bpe, self.match, self.text = bpe, regex.compile(pattern).finditer, ""
        self.spans: list[tuple[int, int]] = []
        self.tables: list[list[int]] = []
        self.edit(0, 0, text)

    def ids(self) -> list[int]:
        out: list[int] = []
        for (a, b), cells in zip(self.spans, self.tables, strict=True):
            whole = self.bpe.ranks.get(self.text[a:b].encode())  # a piece that is a token is that token
            out += [whole] if whole is not None else self.bpe.ids(cells)
        return out

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, put: str) -> int:
        """Replaces text[start:end]; returns how many pieces were encoded."""
        old, shift = self.text, len(put) - (end - start)
        self.text = old[:start] + put + old[end:]
        first = next((k for k, (_, b) in enumerate(self.spans) if b >= start - 1), len(self.spans))
        begin = self.spans[first][0] if first < len(self.spans) else min(start, self.spans[-1][1] if self.spans else 0)
        again = {a + shift: k for k, (a, _) in enumerate(self.spans) if k >= first and a >= end}
        spans, tables, after = [], [], len(self.spans)
        for m in self.match(self.text, begin):
            if m.start() in again and m.start() >= start + len(put):
                after = again[m.start()]
                break
            if m.start() == m.end():
                continue
            data = m[0].encode()
            cells = [-1]
            if (k := first + len(spans)) < len(self.spans):  # what the old piece at this place begins with
                was = old[slice(*self.spans[k])].encode()
                same = next((i for i, (x, y) in enumerate(zip(was, data, strict=False)) if x != y), min(len(was), len(data)))
                cells = self.tables[k][: same + 1]
            spans.append(m.span())
            tables.append(cells if len(cells) == len(data) + 1 else self.bpe.table(data, cells))
        self.spans[first:] = [*spans, *((a + shift, b + shift) for a, b in self.spans[after:])]
        self.tables[first:] = [*tables, *self.tables[after:]]
        return len(spans)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0] + 1, ... (lengths[0] of them), starts[1], ..."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


LETTER, NUMBER, SPACE, OTHER = range(4)
#: The Unicode property White_Space.
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Pattern whose pieces `Splitter` finds by classes of characters.
CLASSED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Splitter:
    """Where the pieces of many texts start. Runs of one class of characters are pieces, but for three rules of the pattern:
    a space goes with what follows, the last of several white spaces stands alone before other text, and endings like 's are pieces."""

    def __init__(self, pattern: str):
        self.find = None if pattern == CLASSED else regex.compile(pattern).findall
        if self.find is None:
            every = "".join(map(chr, [*range(0xD800), *[0xFFFD] * 0x800, *range(0xE000, 0x110000)]))
            self.kind = np.full(0x110000, OTHER, np.uint8)
            for kind, cls in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
                for m in regex.finditer(cls, every):
                    self.kind[m.start() : m.end()] = kind
            self.kind[list(WHITE_SPACE)] = SPACE

    def starts(self, texts: list[str], points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """texts: none empty; points: their code points; firsts: where each text starts."""
        if self.find is not None:
            lengths = np.fromiter((len(p) for t in texts for p in self.find(t)), np.int64)
            return np.cumsum(lengths) - lengths
        n, kind = len(points), self.kind[points]
        first = np.zeros(n + 3, bool)
        first[firsts] = first[n:] = True
        start = first.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        runs = np.flatnonzero(start[:n])
        ends = np.append(runs[1:], n)
        of = kind[runs]
        last = ends[(of == SPACE) & ~first[ends]] - 1
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        mark = runs[(of == OTHER) & (ends == runs + 1) & (points[runs] == 39) & start[runs] & ~first[ends]]
        padded = np.append(points, [0, 0, 0])
        one, two = padded[mark + 1], np.where(first[mark + 2], 0, padded[mark + 2])
        short = mark[np.isin(one, [115, 116, 109, 100])]
        long = mark[(np.isin(one, [114, 118]) & (two == 101)) | ((one == 108) & (two == 108))]
        start[short + 1] = start[long + 1] = False
        start[short + 2] = start[long + 3] = True
        return np.flatnonzero(start[:n])


class _Pairs:
    """Which tokens may follow which: an open-addressed table of the pairs judged so far."""

    BITS = 21

    def __init__(self, bpe: PrefixBPE):
        self.bpe = bpe
        self._empty()

    def _empty(self) -> None:
        self.keys, self.yes, self.used = np.full((1 << self.BITS) + 64, -1, np.int64), np.zeros((1 << self.BITS) + 64, bool), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def follow(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        keys = s.astype(np.int64) << 32 | t
        out, left, slot = np.zeros(len(keys), bool), np.arange(len(keys)), self._slot(keys)
        unknown = []
        for _ in range(64):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.yes[slot[hit]]
            unknown.append(left[there == -1])
            on = ~hit & (there != -1)
            if not on.any():
                left = left[:0]
                break
            left, slot = left[on], slot[on] + 1
        unknown = np.concatenate([*unknown, left])
        if len(unknown):
            new, where = np.unique(keys[unknown], return_inverse=True)
            judged = np.fromiter((self.bpe._judge(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()), bool, len(new))
            out[unknown] = judged[where]
            if self.used + len(new) > 1 << (self.BITS - 1):
                self._empty()
            for k, slot, yes in zip(new.tolist(), self._slot(new).tolist(), judged.tolist(), strict=True):
                for at in range(slot, slot + 64):
                    if self.keys[at] == -1:
                        self.keys[at], self.yes[at] = k, yes
                        self.used += 1
                        break
        return out


class _Steps:
    """The trie's steps in an open-addressed table: (node, byte) to the next node, 0 for none."""

    def __init__(self, steps: dict[int, int]):
        self.bits = max(4, (4 * len(steps)).bit_length())
        self.keys, self.to = np.full((1 << self.bits) + 64, -1, np.int64), np.zeros((1 << self.bits) + 64, np.int32)
        keys, to = np.fromiter(steps, np.int64, len(steps)), np.fromiter(steps.values(), np.int64, len(steps)) >> 8
        for key, slot, node in zip(keys.tolist(), self._slot(keys).tolist(), to.tolist(), strict=True):
            while self.keys[slot] != -1:
                slot += 1
            self.keys[slot], self.to[slot] = key, node

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        keys = node.astype(np.int64) << 8 | byte
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.to[slot], 0)
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            slot[left] += 1
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.to[slot[left[hit]]]
            left = left[~hit & (there != -1)]
        return out


class TextEncoder:
    """Encodes many texts at once: splits all, then fills the prefix tables of their distinct pieces cell by cell, one column for each piece."""

    #: Pieces of more bytes are encoded one by one.
    WIDE = 48

    def __init__(self, path: str, pattern: str):
        self.bpe = PrefixBPE(load_ranks(path))
        self.split = Splitter(pattern)
        self.pairs = _Pairs(self.bpe)
        self.bpe._grow()
        self.steps = _Steps(self.bpe._steps)
        self.ends = np.full(len(self.bpe._steps) + 1, -1, np.int32)
        self.ends[np.fromiter(self.bpe._ends, np.int64, len(self.bpe._ends)) >> 8] = np.fromiter(self.bpe._ends.values(), np.int32, len(self.bpe._ends))
        self.bpe._steps, self.bpe._ends = {}, {}  # the arrays take their place; a long piece brings them back
        self.size = np.fromiter(map(len, self.bpe.token), np.int64, len(self.bpe.token))
        self.place = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(self.bpe.token), np.uint8)
        self.made = np.fromiter((self.bpe._edge(r) is not None for r in range(len(self.bpe.token))), bool, len(self.bpe.token)) if self.bpe.token else np.zeros(0, bool)
        self.odd = {t for t, r in self.bpe.ranks.items() if not self.made[r]}
        self.bpe._edges.clear()  # only those of tokens that occur come back
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            base = 0x5DEECE66D2B3A6B5
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)))
                self.inverse = np.cumprod(np.append(np.uint64(1), np.full(n, pow(base, -1, 1 << 64), np.uint64)))

    def _distinct(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that stand for all equal ones, and which one stands for each."""
        self._powers(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.append(np.uint64(0), np.cumsum((data + np.uint64(1)) * self.power[: len(data)]))
            key = (sums[starts + lengths] - sums[starts]) * self.inverse[starts]
            key = (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + lengths.astype(np.uint64)
        _, chosen, which = np.unique(key, return_index=True, return_inverse=True)
        same = lengths[chosen][which] == lengths
        if same.all():
            same = data == data[spread(starts[chosen][which], lengths)]
        if not same.all():  # two pieces with one key
            return np.arange(len(starts)), np.arange(len(starts))
        return chosen, which

    def _columns(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after the other, and how many each has."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        wide = int((lengths > self.WIDE).sum())
        slow = {k: self.bpe.encode_piece(data[starts[k] : starts[k] + lengths[k]].tobytes()) for k in range(wide)}
        begin, size = starts[wide:], lengths[wide:]
        for k in range(len(begin)) if self.odd else ():
            if (piece := data[begin[k] : begin[k] + size[k]].tobytes()) in self.odd:
                slow[wide + k] = self.bpe.encode_piece(piece)
        m = len(begin)
        cells = np.full((int(size[0]) + 1 if m else 1, m), -1, np.int32)
        for j in range(len(cells) - 1):
            live = np.arange(int(np.searchsorted(-size, -j)))
            node, before, i = np.zeros(len(live), np.int32), cells[j], j
            while len(live):
                node = self.steps.next(node, data[begin[live] + i])
                on = node > 0
                live, node = live[on], node[on]
                i += 1
                token = self.ends[node]
                open_ = np.flatnonzero((token >= 0) & (cells[i, live] < 0))
                to, token = live[open_], token[open_]
                fits = self.made[token] if j == 0 else self.pairs.follow(before[to], token)
                cells[i, to[fits]] = token[fits]
                on = size[live] > i
                live, node = live[on], node[on]
        last, at, columns, ids = size.copy(), np.arange(m), [], []
        count = np.zeros(m, np.int64)
        while len(at):
            token = cells[last[at], at]
            if (token < 0).any():
                raise ValueError("a byte has no token")
            columns.append(at)
            ids.append(token)
            count[at] += 1
            last[at] -= self.size[token]
            at = at[last[at] > 0]
        total = np.append(np.zeros(wide, np.int64), count)
        for k, found in slow.items():
            total[k] = len(found)
        flat, to = np.zeros(int(total.sum()), np.uint32), np.cumsum(total) - total
        for back, (at, token) in enumerate(zip(columns, ids, strict=True)):
            flat[to[wide:][at] + total[wide:][at] - 1 - back] = token
        for k, found in slow.items():
            flat[to[k] : to[k] + len(found)] = found
        out = np.empty(len(order), np.int64)
        out[order] = total
        place = np.empty(len(order), np.int64)
        place[order] = to
        return flat[spread(place, out)], out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        full = [t for t in texts if t]
        if not full:
            return [np.zeros(0, "<u4")] * len(texts)
        whole = "".join(full)
        points, data = np.frombuffer(whole.encode("utf-32-le"), "<u4"), np.frombuffer(whole.encode(), np.uint8)
        sizes = np.fromiter(map(len, full), np.int64, len(full))
        firsts = np.cumsum(sizes) - sizes
        starts = self.split.starts(full, points, firsts)
        of_text = np.searchsorted(starts, np.append(firsts, len(points)))
        if len(data) > len(points):
            at = np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))
            starts = np.where(starts > 0, at[starts - 1], 0)
        lengths = np.diff(np.append(starts, len(data)))
        chosen, which = self._distinct(data, starts, lengths)
        flat, count = self._columns(data, starts[chosen], lengths[chosen])
        place = np.cumsum(count) - count
        each = count[which]
        ids = flat[spread(place[which], each)].astype("<u4", copy=False)
        cuts = np.append(0, np.cumsum(each))[of_text]
        found = iter(np.split(ids, cuts[1:-1]))
        return [next(found) if t else np.zeros(0, "<u4") for t in texts]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_array(self, ids: np.ndarray) -> bytes:
        return self.pool[spread(self.place[ids], self.size[ids])].tobytes() if len(ids) else b""

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.decode_array(np.fromiter(ids, np.int64))


#: Bytes of text that are encoded at once.
AT_ONCE = 1_000_000


def by_size(values: list[bytes], most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of values of about so many bytes, one value at least."""
    start, total = 0, 0
    for i, value in enumerate(values):
        if total and total + len(value) > most:
            yield start, i
            start, total = i, 0
        total += len(value)
    if values:
        yield start, len(values)


def encode_frame(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """The kept columns with n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids.

    Null text counts as empty: no tokens and the digests of nothing. Rows that repeat are encoded each; no row is lost.
    """
    fields = [df.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in slices(batches):
            encoder = encoder or TextEncoder(path, pattern)
            values = raw(batch.column(len(keep)))
            for start, end in by_size(values):
                found = encoder.encode_all([v.decode("utf-8", "replace") for v in values[start:end]])
                columns = [batch.column(i).slice(start, end - start) for i in range(len(keep))]
                columns.append(pa.array([len(x) for x in found], pa.int64()))
                columns.append(pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in found], pa.string()))
                columns.append(pa.array([hashlib.sha256(encoder.decode_array(x)).hexdigest() for x in found], pa.string()))
                if ids:
                    columns.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * ids])

    return df.select(*[df[c] for c in keep], df[text].cast("string").alias("__text")).mapInArrow(tidy(run), schema)
