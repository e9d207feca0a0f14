"""Tables of a data directory as tables of a format, in a folder of their own; made once for a session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.model import FILE_COLUMNS, Change, Table
from tidewater.sources import open_source, open_target
from tidewater.sync import Controller, Dataset

_made: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    """Below the shared folder that the session names; a temporary one where it names none and runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidewater-")
    return f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"


def once(spark: SparkSession, key: tuple, make: Callable[[str], None]) -> str:
    key = (spark.sparkContext.applicationId, *key)
    if key not in _made:
        path = f"{folder(spark)}/t"
        make(path)
        _made[key] = path
    return _made[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def directory(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> str:
    """A Parquet directory of the table, with Hive partitions if by is given."""

    def make(path: str) -> None:
        rows = table(spark, sf_dir, name)
        (rows.repartition(by).write.partitionBy(by) if by else rows.write).parquet(path)

    return once(spark, (sf_dir, name, by), make)


def synced(spark: SparkSession, sf_dir: str, name: str, format: str, by: str | None = None) -> str:
    """The directory, brought to the format."""
    path = directory(spark, sf_dir, name, by)

    def sync(_: str) -> None:
        for r in Controller(spark).sync(Dataset(path, "PARQUET", (format,), table_name=name)).values():
            if r.error:
                raise RuntimeError(r.error)

    once(spark, (sf_dir, name, by, format), sync)
    return path


class Log:
    """A Delta table that grows commit by commit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.n = spark, path, 0
        self.target = open_target(spark, "DELTA", path)

    def commit(self, rows: DataFrame | None = None, remove: DataFrame | None = None, partitions: tuple = ()) -> None:
        """rows become a file of their own; remove: files to drop."""
        files, known = None, None
        if rows is not None:
            where = f"{self.path}/data-{self.n}"
            rows.coalesce(1).write.parquet(where)
            found = open_source(self.spark, "PARQUET", where).snapshot()
            files, known = found.files.withColumn("op", F.lit("ADD")).select("op", *FILE_COLUMNS), found.table
        if remove is not None:
            gone = remove.withColumn("op", F.lit("REMOVE")).select("op", *FILE_COLUMNS)
            files = gone if files is None else gone.unionByName(files)
        self.n += 1
        schema = known.schema if known else open_source(self.spark, "DELTA", self.path).table().schema
        now = Table("t", "DELTA", self.path, schema, partitions, 1_000 * self.n)
        self.target.commit_changes([Change(str(self.n), now.instant, now, files)])
