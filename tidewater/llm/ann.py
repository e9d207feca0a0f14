"""Nearest neighbours by inner product.

Vectors are cut into pairs of components, each coded in four bits by 16 centres. Centres
and codes minimise a score-aware loss: the residual's part along the vector, which is
what changes large inner products, weighs `eta` times its other parts (anisotropic
quantisation, by coordinate descent over the pairs). A query adds its 16 products with
each pair's centres from tables, two codes at a time. The `depth` best of each block, with
all that tie with the last, are scored again exactly in double precision; then so are all
whose approximate score comes within two standard errors of the k-th exact one, however
many they are.

Centres are fitted on the driver to a bounded sample (`most` vectors with the smallest
hashes of their ids, fewer if they are long); every row is indexed. Rows are dealt by a
hash of their ids into blocks; each block meets all queries, which stream past it in
batches, so that a task holds one block and one batch. Blocks have about `block` rows until
there is one for each shuffle partition; then they grow up to eight times that, as each more
is another copy of all queries. Equal vectors
of a block count once, with their smallest ids.

Vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do those of another length than most have, nor rows without an id. An id's own rows
are no candidates for it; rows that repeat an id and vector count once. Ties go to the
smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import shuffle_partitions, slices, tidy

CENTRES = 16
#: A residual's part along the vector weighs as if inner products from this share of the norms on count.
SHARE = 0.2


def eta(dim: int) -> float:
    return max(1.0, SHARE**2 / (1 - SHARE**2) * (dim - 1))


def _pairs(x: np.ndarray) -> np.ndarray:
    """n x m x 2, m even, with zeros at the end."""
    pad = -x.shape[1] % 4
    return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, 2)


def _sweep(x: np.ndarray, along: np.ndarray, centres: np.ndarray, codes: np.ndarray, weight: float) -> np.ndarray:
    """Chooses each pair's centre anew, given the others; returns what remains along each vector."""
    n, m, _ = x.shape
    rest = ((x - centres[np.arange(m), codes]) * along).sum(axis=(1, 2))
    for k in range(m):
        off = x[:, k, None, :] - centres[k]
        part = off[:, :, 0] * along[:, k, :1] + off[:, :, 1] * along[:, k, 1:]
        others = rest - part[np.arange(n), codes[:, k]]
        loss = (off * off).sum(axis=2) + (weight - 1) * (others[:, None] + part) ** 2
        codes[:, k] = loss.argmin(axis=1)
        rest = others + part[np.arange(n), codes[:, k]]
    return rest


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([((x[:, k, None, :] - centres[k]) ** 2).sum(axis=2).argmin(axis=1) for k in range(x.shape[1])], axis=1)


def fit(sample: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Centres, pairs x 16 x 2."""
    x = _pairs(sample.astype(np.float32))
    norm = np.sqrt((x * x).sum(axis=(1, 2), keepdims=True))
    along, weight = x / norm, eta(sample.shape[1])
    draw = np.random.default_rng(5)
    picks = draw.integers(0, len(x), (x.shape[1], CENTRES))
    centres = np.stack([x[picks[k], k] for k in range(x.shape[1])])
    codes = _nearest(x, centres)
    for _ in range(rounds):
        rest = _sweep(x, along, centres, codes, weight)
        for k in range(x.shape[1]):
            u, now = along[:, k], codes[:, k]
            others = rest - ((x[:, k] - centres[k][now]) * u).sum(axis=1)
            want = x[:, k] + (weight - 1) * u * (others + (x[:, k] * u).sum(axis=1))[:, None]
            for c in range(CENTRES):
                at = now == c
                if at.any():
                    a = np.eye(2) * at.sum() + (weight - 1) * u[at].T @ u[at]
                    centres[k, c] = np.linalg.solve(a, want[at].sum(axis=0))
            rest = others + ((x[:, k] - centres[k][now]) * u).sum(axis=1)
    return centres


class Block:
    """Coded vectors with the originals and ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, centres: np.ndarray, keep: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, which = np.unique(vectors.view([("", vectors.dtype)] * vectors.shape[1]).ravel(), return_index=True, return_inverse=True)
        self.vectors = vectors[first].astype(np.float64)
        members = np.argsort(which, kind="stable")  # by vector, then id
        of, found = which[members], ids[members]
        new = np.append(True, (of[1:] != of[:-1]) | (found[1:] != found[:-1]))
        of, found = of[new], found[new]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        of, self.ids = of[place < keep], found[place < keep]
        self.starts = np.searchsorted(of, np.arange(len(first) + 1))
        x = _pairs(vectors[first].astype(np.float32))
        codes = _nearest(x, centres)
        norm = np.sqrt((x * x).sum(axis=(1, 2), keepdims=True))
        for _ in range(2):
            _sweep(x, x / norm, centres, codes, eta(vectors.shape[1]))
        self.codes = (codes[:, ::2] << 4 | codes[:, 1::2]).astype(np.uint8)
        self.centres = centres

    def scan(self, queries: np.ndarray) -> np.ndarray:
        """Approximate products, vectors x queries."""
        q = _pairs(queries.astype(np.float32))
        tables = np.einsum("mcd,qmd->mcq", self.centres, q)
        out = np.zeros((len(self.codes), len(q)), np.float32)
        for k in range(self.codes.shape[1]):
            both = (tables[2 * k][:, None, :] + tables[2 * k + 1][None, :, :]).reshape(CENTRES * CENTRES, -1)
            out += both[self.codes[:, k]]
        return out

    def _exact(self, rows: np.ndarray, query: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of these vectors."""
        exact = (self.vectors[rows] * query).sum(axis=1)
        sizes = self.starts[rows + 1] - self.starts[rows]
        members = np.repeat(self.starts[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        found, score = self.ids[members], np.repeat(exact, sizes)
        return found[found != own], score[found != own]

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its id and the ids and exact scores of the block's best, k at most, without its own rows."""
        scores = self.scan(queries)
        n = len(scores)
        least = np.partition(scores, n - depth, axis=0)[n - depth] if n > depth else np.full(len(ids), -np.inf, np.float32)
        some = np.arange(0, n, max(1, n // 64))
        margin = 2 * float(np.std(self.vectors[some] @ queries.T.astype(np.float64) - scores[some]))
        for i, query in enumerate(queries.astype(np.float64)):
            rows = np.flatnonzero(scores[:, i] >= least[i])
            found, score = self._exact(rows, query, ids[i])
            if len(rows) < n and len(score) >= k:
                # whatever may be among the best if its approximate score is off by the margin
                bound = np.partition(score, len(score) - k)[len(score) - k] - margin
                if bound < least[i]:
                    found, score = self._exact(np.flatnonzero(scores[:, i] >= bound), query, ids[i])
            best = np.lexsort((found, -score))[:k]
            yield int(ids[i]), found[best], score[best]


def valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vector of the rows that take part."""
    v = F.col("vector")
    fine = F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(df[key].cast("bigint").alias("id"), df[vector].alias("vector")).where(fine)
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (common.n if common else 0))


def search(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, depth: int = 100, block: int = 8192, most: int = 8192) -> DataFrame:
    """For each row of queries its k nearest rows of df: query_id, rank, vec_id, score."""
    rows = valid(df, key, vector)
    n = rows.count()
    out = "query_id bigint, vec_id bigint, score double"
    if not n:
        found = df.sparkSession.createDataFrame([], out)
    else:
        width = rows.select(F.size("vector")).first()[0]
        drawn = rows.select(F.xxhash64("id").alias("h"), "id", "vector").orderBy("h", "id").limit(max(CENTRES, min(most, 4_000_000 // width)))
        sample = drawn.select("vector").toArrow().column(0).combine_chunks()
        centres = fit(sample.values.to_numpy().reshape(-1, width))
        blocks = max(1, min(round(n / block), max(round(n / (8 * block)), shuffle_partitions(df.sparkSession))))
        asked = valid(queries, key, vector).where(F.size("vector") == width)
        dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.lit(False).alias("asks"), "id", "vector").unionByName(
            asked.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), F.lit(True).alias("asks"), "id", "vector")
        )

        def matrix(batch: pa.RecordBatch) -> np.ndarray:
            values = batch.column(3)
            return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, ids, vectors, ready = None, [], [], None
            for batch in slices(batches, 128):
                names, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero((np.diff(names) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(names)], strict=True):
                    part = batch.slice(a, b - a)
                    if names[a] != now:
                        now, ids, vectors, ready = names[a], [], [], None
                    if not asks[a]:
                        ids.append(part.column(2).to_numpy())
                        vectors.append(matrix(part))
                        continue
                    if ready is None and ids:
                        ready = Block(np.concatenate(ids), np.concatenate(vectors), centres, k + 1)
                    if ready is None:
                        continue
                    found = list(ready.search(part.column(2).to_numpy(), matrix(part), k, depth))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in found], [len(x) for _, x, _ in found])), pa.array(np.concatenate([x for _, x, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))], ["query_id", "vec_id", "score"])

        found = dealt.repartition(max(blocks, shuffle_partitions(df.sparkSession)), "block").sortWithinPartitions("block", "asks").mapInArrow(tidy(run), out)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
