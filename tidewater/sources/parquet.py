"""Directories of Parquet files, with Hive partitions: footers are read by tasks, once for schema and statistics."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import bounds, paths, schemas, stores
from tidewater.model import FILES, STAT, Change, PartitionField, Snapshot, SyncState, Table, TableError, read_state, state_properties
from tidewater.operators.files import apply_diff
from tidewater.sources import base

SIDE = "_table_metadata"
_FOOTER = "path string, record_count bigint, schema string, stats map<string, struct<min:string,max:string,nulls:bigint,nans:bigint,total:bigint>>, error string"


def _leaf_stats(meta) -> dict[str, dict]:
    """Of each leaf column that has no list or map above it, by dotted path, over all row groups."""
    out: dict[str, dict] = {}
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            column = group.column(c)
            if meta.schema.column(c).max_repetition_level:
                continue
            s = out.setdefault(column.path_in_schema, {"low": [], "high": [], "nulls": 0, "total": 0, "bounded": True})
            s["total"] += column.num_values
            stats = column.statistics if column.is_stats_set else None
            if stats is None or not stats.has_null_count:
                s["nulls"] = None
            elif s["nulls"] is not None:
                s["nulls"] += stats.null_count
            full = stats is not None and stats.has_null_count and stats.null_count == column.num_values
            if stats is not None and stats.has_min_max and column.physical_type != "INT96":
                s["low"].append(stats.min)
                s["high"].append(stats.max)
            elif not full and column.num_values:
                s["bounded"] = False  # bounds of some rows only aren't bounds
    found = {}
    for path, s in out.items():
        fine = s["bounded"] and s["low"] and not any(x != x for x in [*s["low"], *s["high"]])  # NaN isn't a bound
        low, high = (min(s["low"]), max(s["high"])) if fine else (None, None)
        found[path] = {"min": bounds.canonical(low), "max": bounds.canonical(high), "nulls": s["nulls"], "nans": None, "total": s["total"]}
    return found


def _spark_schema(arrow: pa.Schema) -> T.StructType:
    from pyspark.sql.pandas.types import from_arrow_schema

    def plain(kind: pa.DataType) -> pa.DataType:
        if pa.types.is_dictionary(kind):
            return plain(kind.value_type)
        if pa.types.is_timestamp(kind):
            return pa.timestamp("us", "UTC" if kind.tz else None)
        if pa.types.is_unsigned_integer(kind):
            return {8: pa.int16(), 16: pa.int32(), 32: pa.int64(), 64: pa.decimal128(20, 0)}[kind.bit_width]
        if pa.types.is_struct(kind):
            return pa.struct([pa.field(f.name, plain(f.type), f.nullable) for f in kind])
        if pa.types.is_list(kind) or pa.types.is_large_list(kind):
            return pa.list_(pa.field("element", plain(kind.value_type), kind.value_field.nullable))
        if pa.types.is_map(kind):
            return pa.map_(plain(kind.key_type), pa.field("value", plain(kind.item_type), kind.item_field.nullable))
        return kind

    return from_arrow_schema(pa.schema([pa.field(f.name, plain(f.type), f.nullable) for f in arrow]), prefer_timestamp_ntz=True)


def _footers(batches: Iterator[pa.RecordBatch], known: dict[str, str]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            try:
                system, inner = stores.open_store(path, known)
                with system.open_input_file(inner) as f:
                    footer = pq.ParquetFile(f)
                    rows.append((path, footer.metadata.num_rows, _spark_schema(footer.schema_arrow).json(), list(_leaf_stats(footer.metadata).items()), None))
            except Exception as e:
                rows.append((path, None, None, None, f"{path}: {e}"))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.struct([("min", pa.string()), ("max", pa.string()), ("nulls", pa.int64()), ("nans", pa.int64()), ("total", pa.int64())])), pa.string()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["path", "record_count", "schema", "stats", "error"])


class Source(base.Source):
    format = "PARQUET"

    def listed(self) -> list:
        found = [f for f in self.store.walk() if f.name.endswith(".parquet") and not paths.is_metadata_path(f.name)]
        if not found:
            raise TableError(f"{self.base} has no Parquet files")
        return found

    def _read(self) -> tuple[Table, DataFrame]:
        found = self.listed()
        rows = self.spark.createDataFrame([(f.path, f.name, f.size, f.modified) for f in found], "path string, relative string, size_bytes bigint, last_modified bigint")
        spread = rows.repartition(max(1, min(len(found), 8 * self.spark.sparkContext.defaultParallelism)))
        footers = spread.select("path").mapInArrow(partial(_footers, known=stores.settings(self.spark)), _FOOTER).persist()
        self._kept = [*getattr(self, "_kept", ()), footers]
        # one row for each different schema, from its newest file; footers themselves stay with the tasks
        seen = footers.join(rows, "path").groupBy("schema").agg(F.max(F.struct("last_modified", "path")).alias("newest"), F.min("error").alias("error")).collect()
        if bad := [r.error for r in seen if r.error]:
            raise TableError(f"unreadable footer: {bad[0]}")
        seen.sort(key=lambda r: (-r.newest.last_modified, r.newest.path))
        schema = schemas.merge([(r.newest.path, T.StructType.fromJson(json.loads(r.schema))) for r in seen])
        values = rows.withColumn("partition_values", paths.hive_values("relative"))
        each = values.select(F.posexplode(F.map_entries("partition_values")).alias("pos", "e")).select("pos", "e.key", F.coalesce("e.value", F.lit("")).alias("value"))
        observed = each.groupBy("key", "value").agg(F.min("pos").alias("pos"))
        observed = observed.groupBy("key").agg(F.min("pos").alias("pos"), F.collect_set("value").alias("values")).orderBy("pos").collect()
        fields = []
        for o in observed:
            there = next((f for f in schema if f.name == o["key"]), None) or next((f for f in schema if f.name.lower() == o["key"].lower()), None)
            if there is None:
                schema = schema.add(T.StructField(o["key"], schemas.partition_type(o["values"]), True))
            elif bad := [v for v in o["values"] if v and not isinstance(there.dataType, T.StringType) and bounds.encode(there.dataType, v, True) is None]:
                raise TableError(f"partition value {bad[0]!r} of {o['key']} isn't of type {there.dataType.simpleString()}")
            fields.append(PartitionField(there.name if there else o["key"]))
        rename = {p.source.lower(): p.source for p in fields}
        pairs = F.transform(F.map_entries("partition_values"), lambda e: F.struct(F.coalesce(F.create_map(*[F.lit(x) for kv in rename.items() for x in kv])[F.lower(e["key"])], e["key"]).alias("key"), e["value"].alias("value"))) if rename else F.map_entries("partition_values")
        files = values.join(footers, "path").select("path", F.lit("PARQUET").alias("file_format"), "size_bytes", "record_count", F.map_from_entries(pairs).alias("partition_values"), "last_modified", F.lit(None).cast(FILES["dv"].dataType).alias("dv"), F.col("stats").cast(T.MapType(T.StringType(), STAT)).alias("stats"))
        return Table(self.name, self.format, self.base, schema, tuple(fields), max(f.modified for f in found)), files

    def close(self) -> None:
        for footers in getattr(self, "_kept", ()):
            footers.unpersist()
        self._kept = []

    def history(self) -> list[tuple[str, int]]:
        newest = max(f.modified for f in self.listed())
        return [(str(newest), newest)]

    def _only_now(self, version: str | None) -> None:
        if version is not None and version != self.history()[0][0]:
            raise TableError(f"a Parquet directory has no version {version}, only the present one")

    def table(self, version: str | None = None) -> Table:
        self._only_now(version)
        return self._read()[0]

    def snapshot(self, version: str | None = None) -> Snapshot:
        self._only_now(version)
        table, files = self._read()
        return Snapshot(table, files, str(table.instant))

    def changes_since(self, instant: int) -> list[Change]:
        """The whole directory as additions, as it keeps no history."""
        now = self.snapshot()
        if now.table.instant <= instant:
            return []
        return [Change(now.source_id, now.table.instant, now.table, now.files.withColumn("op", F.lit("ADD")).select("op", *FILES.fieldNames()))]

    def safe_from(self, instant: int) -> bool:
        return False


class Target(base.Target):
    """A JSON side-car beside the data files: the manifest of live files and the state of the sync."""

    format = "PARQUET"

    def sync_state(self) -> SyncState | None:
        return read_state(json.loads(self.store.text(f"{SIDE}/sync_metadata.json"))) if self.store.exists(f"{SIDE}/sync_metadata.json") else None

    def files(self) -> DataFrame:
        """Live files as the side-car has them."""
        return self.spark.read.schema(FILES).json(self.store.full(self._manifest()["data_files"]))

    def _manifest(self) -> dict:
        return json.loads(self.store.text(f"{SIDE}/manifest.json"))

    def _head(self, table: Table) -> dict:
        return {"version": "1.0", "manifest_id": str(uuid.uuid4()), "timestamp": int(time.time() * 1000), "schema": json.loads(table.schema.json()), "partition_fields": table.partition_columns}

    def _publish(self, table: Table, source_id: str, files: DataFrame) -> None:
        self._check(files)
        name = f"{SIDE}/files-{uuid.uuid4()}.json"
        files.orderBy("path").write.json(self.store.full(name))
        self.store.write(f"{SIDE}/manifest.json", json.dumps(self._head(table) | {"data_files": name}).encode())
        self.store.write(f"{SIDE}/sync_metadata.json", json.dumps(state_properties(base.state_of(table, source_id))).encode())

    def commit_snapshot(self, snapshot: Snapshot) -> None:
        self._publish(snapshot.table, snapshot.source_id, snapshot.files.select(*FILES.fieldNames()))

    def commit_changes(self, changes: list[Change]) -> None:
        for c in changes:
            name = f"{SIDE}/change-{uuid.uuid4()}.json"
            c.files.write.json(self.store.full(name))
            self.store.write(f"{SIDE}/change_{c.version}.json", json.dumps(self._head(c.table) | {"snapshot_id": c.version, "changes": name}).encode())
            live = self.files() if self.store.exists(f"{SIDE}/manifest.json") else self.spark.createDataFrame([], FILES)
            self._publish(c.table, c.version, apply_diff(live, c.files))
