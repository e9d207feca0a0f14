"""What the operators of this subpackage share: reading tables, working folders, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where unset (tests, a laptop), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidewater-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_dir(spark: SparkSession, what: str) -> str:
    return f"{work_root(spark)}/{what}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, read again."""
    path = work_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches: bounds what a worker holds at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def tidy(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, after which the worker gives back what it no longer uses: Spark keeps workers for later tasks, beside other stages' workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return run


_SIGN = np.uint64(1 << 63)


def ranges(sizes: DataFrame, most: int, least: int = 1) -> np.ndarray:
    """sizes: at and n (bigint). First values of ranges of `at` whose n sum up to `most` or less, `least` ranges if there are values enough; only a single value may exceed that.

    The ranges depend on the rows alone, not on how they are dealt. They come from sums over bins,
    16 for a range, and again over the bins that hold too much; only those sums reach the driver.
    """
    low, high, total = sizes.agg(F.min("at"), F.max("at"), F.sum("n")).first()
    if low is None:
        return np.zeros(0, np.int64)
    most = max(1, min(most, total // least))
    heavy, leaves = [(low + (1 << 63), high + (1 << 63))], []
    while heavy:
        bins = max(16, 16 * -(-total // most) // len(heavy))
        starts, ends = (np.array(x, np.uint64) for x in zip(*heavy, strict=True))
        widths = np.array([(b - a) // bins + 1 for a, b in heavy], np.uint64)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, n = batch.column(0).to_numpy().view(np.uint64) ^ _SIGN, batch.column(1).to_numpy()  # noqa: B023
                k = np.searchsorted(starts, at, side="right") - 1  # noqa: B023
                inside = (k >= 0) & (at <= ends[k])  # noqa: B023
                at, n, k = at[inside], n[inside], k[inside]
                code, which = np.unique(k * bins + ((at - starts[k]) // widths[k]).astype(np.int64), return_inverse=True)  # noqa: B023
                sums = np.zeros(len(code), np.int64)
                np.add.at(sums, which, n)
                yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(sums)], ["code", "n"])

        found = sizes.select("at", "n").mapInArrow(tidy(add), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()
        again = []
        for code, n in sorted(found):
            k, place = divmod(code, bins)
            a = heavy[k][0] + place * int(widths[k])
            b = min(heavy[k][1], a + int(widths[k]) - 1)
            if n > most and a < b:
                again.append((a, b))
            else:
                leaves.append((a, n))
        heavy = again
    cuts, now = [], None
    for a, n in sorted(leaves):
        if now is None or now + n > most:
            cuts.append(a - (1 << 63))
            now = 0
        now += n
    return np.array(cuts, np.int64)


def range_of(at: Column, starts: np.ndarray) -> Column:
    """Number of the range that a value is in."""

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, values.to_numpy(), side="right") - 1)

    return place(at)
