"""Mixing sources to target weights that vary over training.

Each source has a schedule: its weight at points of training time from 0 to 1, linear
between them. Its integral is the source's weight in the whole mix; targets share the
budget by weight, but stop at `cap` times the source's size, the excess going to the
others. Documents of a source stand in the order of a digest of their keys; pass after
pass over them is taken until the target's whole words are. A word at some place of that
demand belongs to the moment when the source's cumulative weight reaches that place: the
schedule's integral inverted gives each document its training position, and the mix is
range-sorted by it.

Running sums over a source come in two steps, over ranges of the digest and within each
range, so that a source of any size is spread over many tasks: 4,096 ranges, or 16 or 256
times as many once a source could have more than 100,000 documents in one. A range's start
is a row that stands before its documents, so that these are joined to nothing. Only DataFrame
functions are used, and the one table that a single task sees has a row for each source.
Rows that repeat a key share a range, as null keys of a source do.

Null text has size 0 and is never taken; null is a source of its own, after all others.
Repeated rows are documents of their own. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (time, weight) points; sources take the three in turn. Their integrals are 1, 2 and 3.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 2.0), (1.0, 4.0)))
WORD = r"[^\x20\x09-\x0D]+"

Schedule = Sequence[tuple[float, float]]


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def _pieces(schedule: Schedule) -> Column:
    """Each linear piece with the weight integrated before it."""
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        if t1 > t0:
            out.append(F.struct(F.lit(t0).alias("t"), F.lit(w0).alias("w"), F.lit((w1 - w0) / (t1 - t0)).alias("slope"), F.lit(before).alias("before")))
            before += (t1 - t0) * (w0 + w1) / 2
    return F.array(*out)


def moment(pieces: Column, demand: Column) -> Column:
    """When the integrated schedule reaches this demand."""
    piece = F.element_at(F.filter(pieces, lambda p: p["before"] <= demand), -1)
    rest = demand - piece["before"]
    root = F.sqrt(F.greatest(F.lit(0.0), piece["w"] * piece["w"] + F.lit(2.0) * piece["slope"] * rest))
    return F.when(rest <= 0, piece["t"]).otherwise(piece["t"] + F.lit(2.0) * rest / (piece["w"] + root))


def targets(sizes: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, cap: int = 3, budget: float = 1.0) -> DataFrame:
    """sizes: source, source_size. Adds weight, pieces (the schedule) and target, in words."""
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(schedules)
    pick = lambda values: F.element_at(F.array(*values), F.col("__turn") + 1)
    weighed = sizes.withColumn("__turn", turn).select("source", "source_size", pick([F.lit(float(integral(s))) for s in schedules]).alias("weight"), pick([_pieces(s) for s in schedules]).alias("pieces"))
    capped = weighed.withColumn("__cap", F.col("source_size") * cap)
    every, before = Window.partitionBy(), Window.orderBy(F.col("__cap") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    # sources that reach their caps come first; for each, what is left of the budget and of the weights if all before it are capped
    left = F.sum("source_size").over(every) * F.lit(budget) - F.coalesce(F.sum("__cap").over(before), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = capped.withColumn("__left", left).withColumn("__weights", weights)
    level = level.withColumn("__full", F.col("__left") * F.col("weight") > F.col("__cap") * F.col("__weights"))
    water = F.min_by(F.struct("__left", "__weights"), F.when(~F.col("__full"), F.struct(F.col("__cap") / F.col("weight"), F.col("source").isNull(), F.col("source")))).over(every)
    level = level.withColumn("__water", water)
    target = F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(F.col("weight") * F.col("__water.__left") / F.col("__water.__weights"))
    return level.withColumn("target", target).select("source", "source_size", "weight", "pieces", "target")


def digits(rows: int, each: int = 100_000) -> int:
    """Hexadecimal digits that name enough ranges for so many rows."""
    n = 3
    while rows > each * 16**n:
        n += 1
    return n


def plan(df: DataFrame, size: Column, key: str = "doc_id", source: str = "source", schedules: Sequence[Schedule] = SCHEDULES, cap: int = 3, budget: float = 1.0) -> DataFrame:
    """The row as a struct `__row`, size, source_size, target, taken, times (passes that take any of it) and the positions of these."""
    names, wide = df.columns, digits(df.count())
    rows = df.select(F.struct(*[df[c] for c in names]).alias("__row"), size.alias("size"), df[source].alias("__source"), df[key].alias("__key"))
    rows = rows.withColumn("__digest", F.md5(F.coalesce(F.col("__key").cast("string"), F.lit("")).cast("binary"))).withColumn("__range", F.substring("__digest", 1, wide))
    narrow = df.select(df[source].alias("source"), size.alias("size"), F.substring(F.md5(F.coalesce(df[key].cast("string"), F.lit("")).cast("binary")), 1, wide).alias("range"))
    ranges = narrow.groupBy("source", "range").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("before", F.coalesce(before, F.lit(0)))
    goals = targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")), schedules, cap, budget)
    starts = ranges.alias("r").join(goals.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select(F.col("r.source").alias("__source"), F.col("r.range").alias("__range"), F.struct("before", "source_size", "weight", "pieces", "target").alias("__start"), F.lit(0).alias("__turn"))
    # what a range starts with is its first row, so that whole rows meet it in the exchange that they need anyway
    inside = Window.partitionBy("__source", "__range").orderBy("__turn", "__digest", "__key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__turn", F.lit(1)).unionByName(starts, allowMissingColumns=True).withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("__of", F.first("__start").over(inside))
    joined = placed.where(F.col("__turn") == 1).select("__row", "size", "__in", "__of.*")
    at, whole = F.col("before") + F.col("__in"), F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    partly = F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("__passes") * F.col("source_size") - F.col("__at")))
    out = joined.withColumn("__at", at).withColumn("__passes", passes).withColumn("__partly", partly)
    out = out.withColumn("taken", F.col("__passes") * F.col("size") + F.col("__partly")).withColumn("times", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("__passes") + (F.col("__partly") > 0).cast("int")).cast("bigint"))
    place = lambda k: moment(F.col("pieces"), F.col("weight") * ((k * F.col("source_size") + F.col("__at")) / F.col("target")))
    positions = F.when(F.col("times") > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1), place))
    return out.withColumn("positions", positions).select("__row", "size", "source_size", "target", "taken", "times", "positions")


def mix(df: DataFrame, size: Column, key: str = "doc_id", source: str = "source", **settings) -> DataFrame:
    """The training sequence: a row for each time that a document is taken, range-sorted by training position, with the columns of the documents whatever their names."""
    planned = plan(df, size, key, source, **settings)
    each = planned.where(F.col("times") > 0).select("__row", F.explode("positions").alias("position"))
    return each.repartitionByRange("position").sortWithinPartitions("position").select("__row.*")


#: The mix of `documents` in DuckDB SQL.
SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS room, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS weights,
  row_number() OVER (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST) AS place
  FROM s WINDOW b AS (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT room, weights FROM o WHERE NOT room * w > cap * weights ORDER BY place LIMIT 1),
t AS (SELECT o.source, o.source_size, o.w, CASE WHEN o.room * o.w > o.cap * o.weights THEN o.cap::DOUBLE ELSE o.w::DOUBLE * l.room::DOUBLE / l.weights::DOUBLE END AS target FROM o LEFT JOIN l ON true),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.w, floor(t.target)::BIGINT AS whole,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS passes FROM p),
x AS (SELECT *, (passes * size + greatest(0, least(size, whole - passes * source_size - begun)))::BIGINT AS taken,
  w * (begun / target) AS a, CASE w WHEN 1 THEN 1.5 WHEN 2 THEN 2.0 ELSE 2.0 END::DOUBLE AS w0, CASE w WHEN 1 THEN -1.0 WHEN 2 THEN 0.0 ELSE 2.0 END::DOUBLE AS slope FROM q)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN CASE WHEN a <= 0 THEN 0.0 ELSE round(2.0 * a / (w0 + sqrt(greatest(0.0, w0 * w0 + 2.0 * slope * a))), 9) END END::DOUBLE AS position
FROM x
"""
