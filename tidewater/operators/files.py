"""Replay, diffs, partitions, statistics and pruning of file lists, as DataFrame operations.

None of them collects files: each is one shuffle on the key it names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.model import FILE_COLUMNS


def latest_action(actions: DataFrame, key: str = "key") -> DataFrame:
    """actions: the key, version, pos, op and file. The files whose last action is ADD."""
    last = actions.groupBy(key).agg(F.max_by(F.struct("op", "file"), F.struct("version", "pos")).alias("last"))
    return last.where(F.col("last.op") == "ADD").select("last.file.*")


def one_per_path(files: DataFrame) -> DataFrame:
    return files.groupBy("path").agg(F.max_by(F.struct(*FILE_COLUMNS), F.coalesce("last_modified", F.lit(0))).alias("f")).select("f.*")


def diff_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """op and the columns of FILES, sorted by path, a removal before an addition. A file with another size, record count or deletion vector is both."""
    whole = F.struct(*FILE_COLUMNS)
    a, b = one_per_path(old).select("path", whole.alias("old")), one_per_path(new).select("path", whole.alias("new"))
    both = a.join(b, "path", "full_outer")
    same = lambda c: F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    kept = F.col("old").isNotNull() & F.col("new").isNotNull() & same("size_bytes") & same("record_count") & same("dv")
    ops = F.array_compact(F.array(F.when(F.col("old").isNotNull(), F.struct(F.lit(0).alias("turn"), F.lit("REMOVE").alias("op"), F.col("old").alias("file"))), F.when(F.col("new").isNotNull(), F.struct(F.lit(1).alias("turn"), F.lit("ADD").alias("op"), F.col("new").alias("file")))))
    return both.where(~kept).select(F.explode(ops).alias("c")).orderBy("c.file.path", "c.turn").select("c.op", "c.file.*")


def apply_diff(base: DataFrame, changes: DataFrame) -> DataFrame:
    """base without removed files, with added ones; changes: op and FILES."""
    gone = changes.select("path").distinct()
    kept = base.join(gone, "path", "left_anti").select(*FILE_COLUMNS)
    return kept.unionByName(one_per_path(changes.where(F.col("op") == "ADD").select(*FILE_COLUMNS)))


def monotone(raw: Column, order: Column | str) -> Column:
    """Strictly growing times: the raw one, or one more than the time before, from 1 on."""
    by = Window.orderBy(order)
    i = F.row_number().over(by)
    return i + F.greatest(F.lit(0), F.max(F.coalesce(raw, F.lit(0)) - i).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def column_stats(files: DataFrame, schema: T.StructType) -> DataFrame:
    """A row for each file and column with statistics, bounds in columns of their kinds (the others null)."""
    kinds = {f.name: f.dataType for f in schema}
    rows = files.select("path", "record_count", F.explode("stats").alias("field_path", "s"))
    typed = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
    names = lambda test: [n for n, k in kinds.items() if test(k)]
    whole = F.col("field_path").isin(names(lambda k: type(k) in typed) or [""])
    real = F.col("field_path").isin(names(lambda k: isinstance(k, T.FloatType | T.DoubleType | T.DecimalType)) or [""])
    out = ["path", "field_path"]
    for end in ("min", "max"):
        out += [F.when(whole, F.expr(f"try_cast(s.{end} as bigint)")).alias(f"{end}_l"), F.when(real, F.expr(f"try_cast(s.{end} as double)")).alias(f"{end}_d"), F.when(~whole & ~real, F.col(f"s.{end}")).alias(f"{end}_s")]
    return rows.select(*out, F.col("s.nulls").alias("nulls"), F.col("s.nans").alias("nans"), F.coalesce("s.total", "record_count").alias("total"))


def table_stats(files: DataFrame, schema: T.StructType) -> DataFrame:
    """Bounds and counts of each column over all files."""
    rows = column_stats(files, schema)
    return rows.groupBy("field_path").agg(*[f(c).alias(c) for f, c in ((F.min, "min_l"), (F.max, "max_l"), (F.min, "min_d"), (F.max, "max_d"), (F.min, "min_s"), (F.max, "max_s"), (F.sum, "nulls"), (F.sum, "total"))])


_COMPARE: dict[str, Callable[[Column, Column, Column], Column]] = {
    "=": lambda low, high, v: (low <= v) & (high >= v),
    "<": lambda low, high, v: low < v,
    "<=": lambda low, high, v: low <= v,
    ">": lambda low, high, v: high > v,
    ">=": lambda low, high, v: high >= v,
}


def prune(files: DataFrame, schema: T.StructType, conditions: Iterable[tuple[str, str, Any]]) -> DataFrame:
    """Files that may hold rows meeting all conditions (column, operator, value), by partition values and bounds. A file without the statistics stays."""
    kinds = {f.name: f.dataType for f in schema}
    for column, op, value in conditions:
        kind = kinds[column].simpleString()
        cast = lambda c: F.expr(f"try_cast({c} as {kind})")  # noqa: B023, E731
        v = F.lit(value).cast(kind)
        part = f"partition_values['{column}']"
        by_part = ~F.coalesce(F.map_contains_key("partition_values", F.lit(column)), F.lit(False)) | F.coalesce(_COMPARE[op](cast(part), cast(part), v), F.lit(False))
        low, high = cast(f"stats['{column}'].min"), cast(f"stats['{column}'].max")
        empty = F.coalesce(F.expr(f"stats['{column}'].nulls") == F.coalesce(F.expr(f"stats['{column}'].total"), F.col("record_count")), F.lit(False))
        files = files.where(by_part & ~empty & F.coalesce(_COMPARE[op](low, high, v), F.lit(True)))
    return files


def partitions_of(files: DataFrame, columns: list[str]) -> DataFrame:
    """values (one for each column) and location: where the last file of the partition by path lies."""
    values = F.array(*[F.col("partition_values")[c] for c in columns])
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.select(values.alias("values"), folder.alias("location"), "path").groupBy("values").agg(F.max_by("location", "path").alias("location"))


def diff_partitions(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """event (ADD, UPDATE where the location moved, DROP), values, location; sorted by event, then values."""
    a, b = existing.select("values", F.col("location").alias("was")), desired.select("values", F.col("location").alias("now"))
    both = a.join(b, "values", "full_outer")
    event = F.when(F.col("was").isNull(), "ADD").when(F.col("now").isNull(), "DROP").when(F.col("was") != F.col("now"), "UPDATE")
    found = both.select(event.alias("event"), "values", F.coalesce("now", "was").alias("location"))
    return found.where(F.col("event").isNotNull()).orderBy("event", "values")


def in_batches(rows: Iterable[Any], size: int, act: Callable[[list[Any]], None]) -> list[Exception]:
    """Acts on batches of rows; goes on after an error, and returns all errors."""
    errors, batch = [], []

    def flush() -> None:
        try:
            act(batch)
        except Exception as e:
            errors.append(e)

    for row in rows:
        batch.append(row)
        if len(batch) == size:
            flush()
            batch = []
    if batch:
        flush()
    return errors
