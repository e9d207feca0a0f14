"""Queries over tables that are first converted to a table format, with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater import scan as scans
from tidewater.functions import bounds, schemas
from tidewater.model import FILES
from tidewater.operators import files as op
from tidewater.plans.staging import Log, directory, folder, once, synced, table
from tidewater.sources import open_source, open_target
from tidewater.streaming import feed
from tidewater.streaming.changes import added_rows, follow
from tidewater.sync import Controller, Dataset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


# --- rows through each format --------------------------------------------------------------

for _format in ("parquet", "delta", "iceberg", "hudi", "paimon"):

    @query("SELECT * FROM lineitem", f"scan_{_format}_lineitem")
    def _(spark: SparkSession, sf_dir: str, format: str = _format) -> DataFrame:
        return scans.scan(spark, synced(spark, sf_dir, "lineitem", format, "l_returnflag"), format)

    @query(
        """SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc
           FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
        f"pricing_via_{_format}",
    )
    def _(spark: SparkSession, sf_dir: str, format: str = _format) -> DataFrame:
        rows = scans.scan(spark, synced(spark, sf_dir, "lineitem", format, "l_returnflag"), format).where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(revenue), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))


@query("SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS s FROM events GROUP BY 1")
def agg_via_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scans.scan(spark, synced(spark, sf_dir, "events", "delta", "event_type"), "delta")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("s"))


@query("SELECT o_orderpriority, count(*)::BIGINT AS n, round(sum(l_extendedprice), 2) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def join_delta_iceberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = scans.scan(spark, synced(spark, sf_dir, "orders", "delta"), "delta")
    lines = scans.scan(spark, synced(spark, sf_dir, "lineitem", "iceberg", "l_returnflag"), "iceberg")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("s"))


# --- files, statistics and pruning ----------------------------------------------------------


@query("SELECT l_returnflag, count(*)::BIGINT AS records FROM lineitem GROUP BY 1")
def files_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans.files(spark, synced(spark, sf_dir, "lineitem", "delta", "l_returnflag"), "delta")
    return found.groupBy(F.col("partition_values")["l_returnflag"].alias("l_returnflag")).agg(F.sum("record_count").alias("records"))


_BOUNDS = """SELECT 'l_orderkey' AS field_path, min(l_orderkey)::DOUBLE AS low, max(l_orderkey)::DOUBLE AS high, (count(*) - count(l_orderkey))::BIGINT AS nulls, count(*)::BIGINT AS total FROM lineitem
UNION ALL SELECT 'l_quantity', min(l_quantity), max(l_quantity), (count(*) - count(l_quantity))::BIGINT, count(*)::BIGINT FROM lineitem
UNION ALL SELECT 'l_linenumber', min(l_linenumber)::DOUBLE, max(l_linenumber)::DOUBLE, (count(*) - count(l_linenumber))::BIGINT, count(*)::BIGINT FROM lineitem"""


def _bounds(spark: SparkSession, sf_dir: str, format: str) -> DataFrame:
    snapshot = open_source(spark, format, synced(spark, sf_dir, "lineitem", format, "l_returnflag")).snapshot()
    rows = op.table_stats(snapshot.files, snapshot.table.schema).where(F.col("field_path").isin("l_orderkey", "l_quantity", "l_linenumber"))
    return rows.select("field_path", F.coalesce(F.col("min_l").cast("double"), "min_d").alias("low"), F.coalesce(F.col("max_l").cast("double"), "max_d").alias("high"), "nulls", "total")


@query(_BOUNDS)
def column_stats_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the binary bounds of manifests and back."""
    return _bounds(spark, sf_dir, "iceberg")


@query(_BOUNDS)
def footer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds(spark, sf_dir, "parquet")


def _by_key(spark: SparkSession, sf_dir: str) -> str:
    """Orders in a Delta table, four files with ranges of keys."""

    def make(path: str) -> None:
        log, rows = Log(spark, path), table(spark, sf_dir, "orders")
        cuts = [-1, *rows.approxQuantile("o_orderkey", [0.25, 0.5, 0.75], 0.01), 1 << 60]
        for low, high in zip(cuts, cuts[1:], strict=False):
            log.commit(rows.where((F.col("o_orderkey") > low) & (F.col("o_orderkey") <= high)))

    return once(spark, (sf_dir, "orders by key"), make)


@query("SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders WHERE o_orderkey <= 500 GROUP BY 1")
def prune_by_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan(spark, _by_key(spark, sf_dir), "delta", where=[("o_orderkey", "<=", 500)]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT 4::BIGINT AS files, 1::BIGINT AS kept")
def files_kept_by_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = open_source(spark, "delta", _by_key(spark, sf_dir)).snapshot()
    least = table(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    kept = op.prune(snapshot.files, snapshot.table.schema, [("o_orderkey", "<=", least)]).select("path", F.lit(True).alias("kept"))
    return snapshot.files.join(kept, "path", "left").agg(F.count("*").alias("files"), F.count("kept").alias("kept"))


# --- history --------------------------------------------------------------------------------


def _thirds(spark: SparkSession, sf_dir: str) -> str:
    """Events in three appends by event_id mod 3, then the first removed."""

    def make(path: str) -> None:
        log, rows = Log(spark, path), table(spark, sf_dir, "events")
        for k in range(3):
            log.commit(rows.where(F.col("event_id") % 3 == k))
        first = open_source(spark, "delta", path).snapshot("0").files
        log.commit(remove=first)

    return once(spark, (sf_dir, "thirds"), make)


@query("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE event_id % 3 > 0 GROUP BY 1")
def replay_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan(spark, _thirds(spark, sf_dir), "delta").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE event_id % 3 <= 1 GROUP BY 1")
def time_travel_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan(spark, _thirds(spark, sf_dir), "delta", "1").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT (event_id % 3)::VARCHAR AS version, 'ADD' AS op, count(*)::BIGINT AS records FROM events WHERE event_id % 3 > 0 GROUP BY 1 UNION ALL SELECT '3', 'REMOVE', 0::BIGINT")
def changes_since_v0(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans.changes(spark, _thirds(spark, sf_dir), "delta", since=1000)
    return found.groupBy("version", "op").agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"))


@query("SELECT * FROM (VALUES ('0', 1000::BIGINT), ('1', 2000::BIGINT), ('2', 3000::BIGINT), ('3', 4000::BIGINT)) t(version, instant)")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.history(spark, _thirds(spark, sf_dir), "delta")


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'REMOVE' ELSE 'ADD' END AS op, count(*)::BIGINT AS records FROM events GROUP BY 1")
def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = open_source(spark, "delta", _thirds(spark, sf_dir))
    found = op.diff_files(source.snapshot("0").files, source.snapshot().files)
    return found.groupBy("op").agg(F.sum("record_count").alias("records"))


@query("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE event_id % 3 > 0 GROUP BY 1")
def apply_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = open_source(spark, "delta", _thirds(spark, sf_dir))
    first, now = source.snapshot("0"), source.snapshot()
    live = op.apply_diff(first.files, op.diff_files(first.files, now.files))
    return scans.rows_of(spark, now.table.schema, [], live).groupBy("event_type").agg(F.count("*").alias("n"))


for _format in ("iceberg", "hudi", "paimon"):

    @query("SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS s FROM events WHERE event_id % 3 > 0 GROUP BY 1", f"incremental_delta_to_{_format}")
    def _(spark: SparkSession, sf_dir: str, format: str = _format) -> DataFrame:
        """A full sync of two commits, then the others one by one: an append and a removal."""

        def make(path: str) -> None:
            log, rows = Log(spark, path), table(spark, sf_dir, "events")
            sync = lambda: [r for r in Controller(spark).sync(Dataset(path, "DELTA", (format,))).values()][0]
            for k in range(2):
                log.commit(rows.where(F.col("event_id") % 3 == k))
            first = sync()
            log.commit(rows.where(F.col("event_id") % 3 == 2))
            log.commit(remove=open_source(spark, "delta", path).snapshot("0").files)
            second = sync()
            if (first.error or second.error) or (first.mode, second.mode, second.commits) != ("FULL", "INCREMENTAL", 2):
                raise RuntimeError(f"{first} {second}")

        path = once(spark, (sf_dir, "incremental", format), make)
        return scans.scan(spark, path, format).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("s"))


@query("WITH RECURSIVE e AS (SELECT event_id, (event_id * 7919) % 101 AS raw, row_number() OVER (ORDER BY event_id) AS i FROM events), c AS (SELECT i, event_id, greatest(raw, 1)::BIGINT AS t FROM e WHERE i = 1 UNION ALL SELECT e.i, e.event_id, (CASE WHEN e.raw > c.t THEN e.raw ELSE c.t + 1 END)::BIGINT FROM c JOIN e ON e.i = c.i + 1) SELECT event_id, t FROM c")
def monotone_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 7919) % 101).alias("raw"))
    return rows.select("event_id", op.monotone(F.col("raw"), "event_id").cast("bigint").alias("t"))


# --- schemas and partitions -----------------------------------------------------------------


@query("SELECT event_id, user_id, NULL::DOUBLE AS value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, user_id, value FROM events WHERE event_id % 2 = 1")
def schema_evolution_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(path: str) -> None:
        rows = table(spark, sf_dir, "events")
        rows.where("event_id % 2 = 0").select("event_id", "user_id").write.parquet(path)
        rows.where("event_id % 2 = 1").select("event_id", "user_id", "value").write.mode("append").parquet(path)

    return scans.scan(spark, once(spark, (sf_dir, "generations"), make), "parquet")


@query("SELECT year(o_orderdate)::BIGINT AS year, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def partition_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = once(spark, (sf_dir, "orders by year"), lambda p: table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate")).repartition("year").write.partitionBy("year").parquet(p))
    return scans.scan(spark, path, "parquet").groupBy("year").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT CASE WHEN l_returnflag = 'A' THEN 'ADD' ELSE 'UPDATE' END AS event, l_returnflag AS value FROM lineitem UNION ALL SELECT 'DROP', 'gone'")
def partition_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    desired = op.partitions_of(scans.files(spark, directory(spark, sf_dir, "lineitem", "l_returnflag"), "parquet"), ["l_returnflag"])
    existing = desired.where(F.col("values")[0] != "A").withColumn("location", F.lit("elsewhere"))
    existing = existing.unionByName(spark.createDataFrame([(["gone"], "nowhere")], existing.schema))
    return op.diff_partitions(existing, desired).select("event", F.col("values")[0].alias("value"))


#: A column of each type, and what bounds survive.
KINDS = (("b", "boolean", "true"), ("i", "int", "-7"), ("l", "bigint", "9000000000"), ("f", "float", "1.5"), ("d", "double", "-2.25"), ("s", "string", "zé"), ("day", "date", "2024-02-29"), ("ts", "timestamp", "2024-02-29T01:02:03.000004Z"), ("nt", "timestamp_ntz", "2024-02-29T01:02:03"), ("dec", "decimal(12,2)", "-123.45"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}', true, '{v}')" for n, k, v in KINDS) + ") t(name, type, same_type, bound)")
def type_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type through the schemas of all formats, and a bound through its binary form."""
    schema = T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k, _ in KINDS))
    through = [schemas.from_delta(schemas.to_delta(schema)), schemas.from_iceberg(schemas.to_iceberg(schema)[0]), schemas.from_avro(schemas.to_avro(schema, "t")), schemas.from_paimon(schemas.to_paimon(schema, []))]
    rows = [(n, k, all(s[n].dataType == schema[n].dataType for s in through), bounds.decode(schema[n].dataType, bounds.encode(schema[n].dataType, v, True))) for n, k, v in KINDS]
    return spark.createDataFrame(rows, "name string, type string, same_type boolean, bound string")


# --- streams --------------------------------------------------------------------------------


@query("SELECT event_id, event_type FROM events")
def stream_added_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each commit's files, appended commit by commit."""
    path, out = _thirds(spark, sf_dir), folder(spark)
    added_rows(spark, path, "delta", lambda rows, version: rows.select("event_id", "event_type").write.mode("append").parquet(out))
    return spark.read.parquet(out)


@query("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE event_id % 3 > 0 GROUP BY 1")
def stream_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of commits that keeps an Iceberg target in step."""
    path = _thirds(spark, sf_dir)

    def make(_: str) -> None:
        stream = follow(spark, "delta", "iceberg", path, f"{folder(spark)}/checkpoint")
        stream.awaitTermination()  # it ends when it has caught up
        if stream.exception():
            raise RuntimeError(str(stream.exception()))

    once(spark, (sf_dir, "followed"), make)
    return scans.scan(spark, path, "iceberg").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id % 3 AS version, 'ADD' AS op, count(*)::BIGINT AS records FROM events GROUP BY 1 UNION ALL SELECT 3, 'REMOVE', 0::BIGINT")
def stream_version_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by version from a stream source, with a watermark, in windows of a second."""
    path, out = _thirds(spark, sf_dir), folder(spark)

    def make(_: str) -> None:
        found = feed.changes(spark, path).withWatermark("time", "1 hour")
        stream = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder(spark)}/checkpoint").start()
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()

    make(path)
    rows = spark.read.parquet(out).groupBy(F.window("time", "1 second"), "version", "op").agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"))
    return rows.select("version", "op", "records")


@query("SELECT l_returnflag, count(*)::BIGINT AS records FROM lineitem GROUP BY 1")
def side_car_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the Parquet target's manifest lists."""
    path = synced(spark, sf_dir, "lineitem", "delta", "l_returnflag")

    def make(_: str) -> None:
        Controller(spark).sync(Dataset(path, "DELTA", ("PARQUET",)))

    once(spark, (sf_dir, "side-car"), make)
    found = open_target(spark, "parquet", path).files().select(*FILES.fieldNames())
    return found.groupBy(F.col("partition_values")["l_returnflag"].alias("l_returnflag")).agg(F.sum("record_count").alias("records"))
