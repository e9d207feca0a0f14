"""Rows of a table in any format, and its files, history and changes as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import paths
from tidewater.model import FILES, TableError, mapped, physical
from tidewater.operators.files import prune
from tidewater.sources import open_source

_OPERATORS = {"=": "__eq__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def scan(spark: SparkSession, path: str, format: str, version: str | None = None, where: Iterable[tuple[str, str, Any]] = ()) -> DataFrame:
    """The rows of the live files, in the table's schema.

    where: conditions (column, operator, value) that first drop files by partition values and bounds,
    then filter rows. Files' rows are read by Spark's own Parquet reader, so projections and further
    filters reach them. Partition columns come from the metadata where the files lack them.
    """
    snapshot = open_source(spark, format, path).snapshot(version)
    return rows_of(spark, snapshot.table.schema, snapshot.table.partition_columns, snapshot.files, where)


#: Partitions that are read each with its values as literals, and bytes of a file list that is broadcast, where directories don't tell the values.
FEW, SMALL = 32, 16 << 20


def rows_of(spark: SparkSession, schema: T.StructType, partition_columns: list[str], files: DataFrame, where: Iterable[tuple[str, str, Any]] = ()) -> DataFrame:
    where = list(where)
    chosen = prune(files, schema, where).select("path", "file_format", "partition_values", F.col("dv").isNotNull().alias("deleted")).collect()  # paths are what a scan is planned from
    if any(r.deleted for r in chosen):
        raise TableError("files have deletion vectors, which scans don't apply")
    if other := {r.file_format for r in chosen} - {"PARQUET"}:
        raise TableError(f"files of format {other.pop()} aren't scanned")
    plain = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    if not chosen:
        return spark.createDataFrame([], plain)
    stored = physical(schema)
    found = {f.name: s for f, s in zip(schema, stored, strict=True)}  # a column's field in the files
    names = [re.sub("^file:/+", "/", r.path) for r in chosen]
    values = [tuple((r.partition_values or {}).get(c) for c in partition_columns) for r in chosen]
    root = _root(names)

    def named(rows: DataFrame, known: dict[str, Column] | None = None) -> DataFrame:
        """The table's columns; known: partition values, for columns that the files lack."""
        column = lambda f: F.col(f"`{found[f.name].name}`").cast(f.dataType) if found[f.name] != plain[f.name] else F.col(f"`{f.name}`")
        return rows.select(*[(F.coalesce(column(f), known[f.name].cast(f.dataType)) if f.name in (known or {}) else column(f)).alias(f.name) for f in plain])

    if not partition_columns:
        rows = named(spark.read.schema(stored).parquet(*names))
    elif not mapped(schema) and all(_hive(n, root) == dict(zip(partition_columns, v, strict=True)) for n, v in zip(names, values, strict=True)):
        # directories tell the values: Spark prunes by them, and no row is joined
        rows = spark.read.schema(plain).option("basePath", root).parquet(*names).select(*[F.col(f"`{f.name}`") for f in plain])
    elif len(set(values)) <= FEW:
        parts = []
        for v in sorted(set(values), key=str):
            read = spark.read.schema(stored).option("recursiveFileLookup", "true").parquet(*[n for n, x in zip(names, values, strict=True) if x == v])
            parts.append(named(read, {c: F.lit(x).cast("string") for c, x in zip(partition_columns, v, strict=True)}))
        rows = reduce(DataFrame.unionAll, parts)
    else:
        listed = pa.table({"__path": names, "__values": pa.array([list(v) for v in values], pa.list_(pa.string()))})
        small = spark.createDataFrame(listed)
        small = F.broadcast(small) if listed.nbytes <= SMALL else small.hint("merge")
        raw = spark.read.schema(stored).option("recursiveFileLookup", "true").parquet(*names).withColumn("__path", paths.local_form(paths.decoded(F.col("_metadata.file_path"))))
        rows = named(raw.join(small, "__path"), {c: F.col("__values")[i] for i, c in enumerate(partition_columns)})
    for column, op, value in where:
        rows = rows.where(getattr(F.col(f"`{column}`"), _OPERATORS[op])(F.lit(value)))
    return rows


def _hive(path: str, root: str) -> dict[str, str | None] | None:
    """Values of the `k=v` directories below the root; None if a name comes twice or a value is empty, which Spark reads as null."""
    out: dict[str, str | None] = {}
    for part in path[len(root) :].split("/")[:-1]:
        key, eq, value = part.partition("=")
        if eq:
            if unquote(key) in out or not value:
                return None
            out[unquote(key)] = None if value == "__HIVE_DEFAULT_PARTITION__" else unquote(value)
    return out


def _root(names: list[str]) -> str:
    """The deepest folder above all files that isn't a `k=v` directory."""
    parts = names[0].split("/")[:-1]
    for n in names[1:]:
        other = n.split("/")
        k = 0
        while k < len(parts) and k < len(other) - 1 and parts[k] == other[k]:
            k += 1
        parts = parts[:k]
    while parts and "=" in parts[-1]:
        parts.pop()
    return "/".join(parts) or "/"


def files(spark: SparkSession, path: str, format: str, version: str | None = None) -> DataFrame:
    return open_source(spark, format, path).snapshot(version).files


def history(spark: SparkSession, path: str, format: str) -> DataFrame:
    return spark.createDataFrame(open_source(spark, format, path).history(), "version string, instant bigint")


def changes(spark: SparkSession, path: str, format: str, since: int = -1) -> DataFrame:
    """version, instant, op and the columns of FILES of all commits after an instant."""
    out = None
    for c in open_source(spark, format, path).changes_since(since):
        rows = c.files.select(F.lit(c.version).alias("version"), F.lit(c.instant).cast("bigint").alias("instant"), "op", *FILES.fieldNames())
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        shape = T.StructType([T.StructField("version", T.StringType()), T.StructField("instant", T.LongType()), T.StructField("op", T.StringType()), *FILES])
        return spark.createDataFrame([], shape)
    return out


def inspect(spark: SparkSession, path: str, format: str) -> dict[str, Any]:
    """What a table is, without its files."""
    snapshot = open_source(spark, format, path).snapshot()
    t = snapshot.table
    total = snapshot.files.agg(F.count("*").alias("files"), F.sum("record_count").alias("records"), F.sum("size_bytes").alias("bytes")).first()
    fields = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in t.schema]
    return {"name": t.name, "format": t.format, "base_path": t.base_path, "latest_commit_time": t.instant, "source_id": snapshot.source_id, "schema": fields, "partition_fields": t.partition_columns, "files": total.files, "records": total.records or 0, "bytes": total.bytes or 0}
