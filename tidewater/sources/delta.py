"""Delta Lake: the log as rows of actions."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from functools import cache

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import paths, schemas
from tidewater.model import DV, FILE_COLUMNS, FILES, PHYSICAL, STAT, Change, PartitionField, Snapshot, SyncState, Table, TableError, read_state, state_properties
from tidewater.operators.files import diff_files, latest_action
from tidewater.sources import base

LOG = "_delta_log"
_DV = "struct<storageType:string,pathOrInlineDv:string,offset:bigint,sizeInBytes:bigint,cardinality:bigint>"
ACTIONS = (
    "protocol struct<minReaderVersion:int,minWriterVersion:int,readerFeatures:array<string>>, "
    "metaData struct<id:string,name:string,schemaString:string,partitionColumns:array<string>,configuration:map<string,string>,createdTime:bigint>, "
    f"add struct<path:string,partitionValues:map<string,string>,size:bigint,modificationTime:bigint,stats:string,deletionVector:{_DV}>, "
    f"remove struct<path:string,deletionVector:{_DV}>, "
    "commitInfo struct<timestamp:bigint,operation:string>"
)


@cache
def _actions_schema() -> T.StructType:
    return T.StructType.fromDDL(ACTIONS)


#: Reader features that change nothing here, or that are read.
FEATURES = frozenset({"deletionVectors", "columnMapping", "timestampNtz", "vacuumProtocolCheck", "v2Checkpoint"})
STATS = "numRecords bigint, minValues map<string,string>, maxValues map<string,string>, nullCount map<string,string>"


def _dv(column: Column) -> Column:
    return F.when(column.isNotNull(), F.struct(column["storageType"].alias("storage_type"), column["pathOrInlineDv"].alias("path_or_inline"), column["offset"].alias("offset"), column["sizeInBytes"].alias("size"), column["cardinality"].alias("cardinality")).cast(DV))


class Source(base.Source):
    format = "DELTA"

    def _listed(self) -> tuple[dict | None, list[tuple[int, str]]]:
        """The last checkpoint, and the commits after it."""
        files = self.store.list(LOG)
        checkpoint = json.loads(self.store.text(f"{LOG}/_last_checkpoint")) if any(f.name == "_last_checkpoint" for f in files) else None
        after = checkpoint["version"] if checkpoint else -1
        commits = sorted((int(f.name[:-5]), f.path) for f in files if re.fullmatch(r"\d+\.json", f.name) and int(f.name[:-5]) > after)
        if not checkpoint and not commits:
            raise TableError(f"{self.base} has no Delta log")
        if not checkpoint and commits[0][0] > 0:
            raise TableError(f"the log of {self.base} is truncated: it starts at {commits[0][0]} without a checkpoint")
        numbers = [v for v, _ in commits]
        if commits and numbers != list(range(after + 1, after + 1 + len(numbers))):
            raise TableError(f"the log of {self.base} has a gap after {after}")
        return checkpoint, commits

    def _checkpoint(self, checkpoint: dict) -> DataFrame:
        """Rows of a checkpoint as actions before any commit."""
        v, n = checkpoint["version"], checkpoint.get("parts")
        names = [f"{LOG}/{v:020d}.checkpoint.{i:010d}.{n:010d}.parquet" for i in range(1, n + 1)] if n else [f"{LOG}/{v:020d}.checkpoint.parquet"]
        if not n and not self.store.exists(names[0]):  # version 2: a name of its own, told by the hint or found in the log
            told = ((checkpoint.get("v2Checkpoint") or {}).get("path") or "").rpartition("/")[2]
            there = [f.name for f in self.store.list(LOG) if re.fullmatch(rf"{v:020d}\.checkpoint\..+\.(parquet|json)", f.name)]
            names = [f"{LOG}/{x}" for x in ([told] if told in there else there[:1])] or names
        for name in names:
            if not self.store.exists(name):
                raise TableError(f"checkpoint {name} of {self.base} is missing")
        rows = self._checkpoint_rows(list(map(self.store.full, names)))
        if "sidecar" in rows.columns:
            side = [r.path for r in rows.where("sidecar IS NOT NULL").select("sidecar.path").collect()]  # a file of many actions each
            rows = rows.drop("sidecar")
            if side:
                rows = rows.unionByName(self._checkpoint_rows([self.store.full(f"{LOG}/_sidecars/{x}") if "/" not in x else x for x in side]).drop("sidecar"), allowMissingColumns=True)
        return rows.withColumn("version", F.lit(v).cast("bigint")).withColumn("pos", F.lit(0).cast("bigint"))

    def _checkpoint_rows(self, names: list[str]) -> DataFrame:
        """Actions, and in version 2 the names of further files; read by name, as writers differ in what they keep."""
        wanted = [f for f in _actions_schema() if f.name in ("protocol", "metaData", "add")]
        wanted.append(T.StructField("sidecar", T.StructType([T.StructField("path", T.StringType())])))
        if names[0].endswith(".json"):
            return self.spark.read.schema(T.StructType(wanted)).json(names)
        raw = self.spark.read.parquet(*names)
        return self.spark.read.schema(T.StructType([f for f in wanted if f.name in raw.columns])).parquet(*names)

    def _commits(self, files: list[str]) -> DataFrame:
        """version, pos and the actions of these commits. Lines are split among tasks; pos grows within a commit."""
        text = self.spark.read.text(files).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("bigint").alias("version"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("pos"))
        lines = text.where(F.trim("value") != "")
        return lines.select("version", "pos", F.from_json("value", _actions_schema()).alias("a")).select("version", "pos", "a.*")

    def _actions(self, listed: tuple[dict | None, list[tuple[int, str]]]) -> DataFrame:
        """version, pos and the actions of the checkpoint and of the commits after it."""
        checkpoint, commits = listed
        rows = self._commits([p for _, p in commits]) if commits else self.spark.createDataFrame([], T.StructType([T.StructField("version", T.LongType()), T.StructField("pos", T.LongType()), *_actions_schema()]))
        return rows.unionByName(self._checkpoint(checkpoint), allowMissingColumns=True) if checkpoint else rows

    def _versions(self) -> tuple[int, int]:
        checkpoint, commits = self._listed()
        return (checkpoint["version"] if checkpoint else 0), (commits[-1][0] if commits else checkpoint["version"])

    def _version(self, version: str | None, listed: tuple[dict | None, list[tuple[int, str]]]) -> int:
        checkpoint, commits = listed
        first = checkpoint["version"] if checkpoint else 0
        last = commits[-1][0] if commits else first
        at = last if version is None else int(version)
        if not first <= at <= last:
            raise TableError(f"version {version} of {self.base} isn't among {first} to {last}")
        return at

    def _heads(self, listed: tuple[dict | None, list[tuple[int, str]]]) -> dict[int, Row]:
        """What describes each version, in one pass over the log: raw time, metaData, protocol and operation, if it has them."""
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
        rows = self._actions(listed).where("add IS NULL AND remove IS NULL").groupBy("version")
        found = rows.agg(F.max("commitInfo.timestamp").alias("raw"), F.max("commitInfo.operation").alias("operation"), last("metaData").alias("meta"), last("protocol").alias("protocol"))
        return {r.version: r for r in found.collect()}

    def _clock(self, listed: tuple[dict | None, list[tuple[int, str]]], heads: dict[int, Row]) -> list[tuple[int, int]]:
        """Strictly growing times of the commits, from 1 on (`monotone` over rows that are on the driver)."""
        out, now = [], 0
        for v, _ in listed[1]:
            now = max((heads[v].raw if v in heads else None) or 0, now + 1)
            out.append((v, now))
        return out

    def history(self) -> list[tuple[str, int]]:
        listed = self._listed()
        return [(str(v), t) for v, t in self._clock(listed, self._heads(listed))]

    def _table_at(self, heads: dict[int, Row], at: int, instant: int) -> Table:
        known = sorted(v for v in heads if v <= at)
        metas, protocols = ([heads[v][k] for v in known if heads[v][k] is not None] for k in ("meta", "protocol"))
        if not metas:
            raise TableError(f"{self.base} has no metaData up to version {at}")
        if protocols:
            reader, features = protocols[-1].minReaderVersion or 1, set(protocols[-1].readerFeatures or ())
            if reader > 3 or features - FEATURES:
                raise TableError(f"{self.base} needs a reader of version {reader} with {', '.join(sorted(features - FEATURES)) or 'unknown features'}")
        meta = metas[-1]
        schema = schemas.from_delta(meta.schemaString)
        columns = list(meta.partitionColumns or ())
        for c in columns:
            if c not in schema.fieldNames():
                schema = schema.add(c, T.StringType())
        return Table(meta.name or self.name, self.format, self.base, schema, tuple(PartitionField(c) for c in columns), instant, dict(meta.configuration or {}))

    def table(self, version: str | None = None) -> Table:
        listed = self._listed()
        at, heads = self._version(version, listed), self._heads(listed)
        return self._table_at(heads, at, dict(self._clock(listed, heads)).get(at, 0))

    def _files(self, actions: DataFrame, schema: T.StructType) -> DataFrame:
        """version, pos, op, key and file of adds and removes; partition values and statistics by the schema's names."""
        of_file = {f.metadata[PHYSICAL]: f.name for f in schema if (f.metadata or {}).get(PHYSICAL, f.name) != f.name}

        def renamed(pairs: Column) -> Column:
            if not of_file:
                return F.map_from_entries(pairs)
            names = F.create_map(*[F.lit(x) for pair in of_file.items() for x in pair])
            return F.map_from_entries(F.transform(pairs, lambda e: e.withField("key", F.coalesce(names[e["key"]], e["key"]))))

        stats = F.from_json(F.col("add.stats"), STATS)
        names = F.array_distinct(F.concat(F.coalesce(F.map_keys("s.minValues"), F.array()), F.coalesce(F.map_keys("s.nullCount"), F.array())))
        each = F.transform(names, lambda n: F.struct(n.alias("key"), F.struct(F.col("s.minValues")[n].alias("min"), F.col("s.maxValues")[n].alias("max"), F.expr("try_cast(null as bigint)").alias("nulls"), F.lit(None).cast("bigint").alias("nans"), F.col("s.numRecords").alias("total")).withField("nulls", F.col("s.nullCount")[n].try_cast("bigint")).cast(STAT).alias("value")))
        rows = actions.where(F.col("add").isNotNull() | F.col("remove").isNotNull()).withColumn("s", stats)
        added = F.struct(
            paths.resolved(F.col("add.path"), self.base).alias("path"),
            F.lit("PARQUET").alias("file_format"),
            F.col("add.size").alias("size_bytes"),
            F.col("s.numRecords").alias("record_count"),
            renamed(F.map_entries(F.coalesce("add.partitionValues", F.create_map().cast("map<string,string>")))).alias("partition_values"),
            F.col("add.modificationTime").alias("last_modified"),
            _dv(F.col("add.deletionVector")).alias("dv"),
            F.when(F.col("s").isNotNull(), renamed(each)).alias("stats"),
        ).cast(FILES)
        removed = F.struct(paths.resolved(F.col("remove.path"), self.base).alias("path"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in FILES[1:6]], _dv(F.col("remove.deletionVector")).alias("dv"), F.lit(None).cast(FILES["stats"].dataType).alias("stats")).cast(FILES)
        file = F.when(F.col("add").isNotNull(), added).otherwise(removed)
        rows = rows.select("version", "pos", F.when(F.col("add").isNotNull(), "ADD").otherwise("REMOVE").alias("op"), file.alias("file"))
        # a deletion vector makes another logical file of the same path
        vector = F.coalesce(F.concat_ws("|", "file.dv.storage_type", "file.dv.path_or_inline", F.col("file.dv.offset").cast("string")), F.lit(""))
        return rows.withColumn("key", F.struct("file.path", vector.alias("vector")))

    def snapshot(self, version: str | None = None) -> Snapshot:
        listed = self._listed()
        at, heads = self._version(version, listed), self._heads(listed)
        table = self._table_at(heads, at, dict(self._clock(listed, heads)).get(at, 0))
        upto = listed[0], [c for c in listed[1] if c[0] <= at]
        return Snapshot(table, latest_action(self._files(self._actions(upto), table.schema)), str(at))

    def _changes(self, wanted: Callable[[int, int], bool]) -> list[Change]:
        """Changes of the commits whose version and time are wanted, each of which reads its own file only; removals carry the path and vector."""
        listed = self._listed()
        heads, names, out = self._heads(listed), dict(listed[1]), []
        for v, t in self._clock(listed, heads):
            if wanted(v, t):
                table = self._table_at(heads, v, t)
                rows = self._files(self._commits([names[v]]), table.schema)
                out.append(Change(str(v), t, table, rows.orderBy("pos").select("op", "file.*"), (heads[v].operation if v in heads else None) or ""))
        return out

    def changes_since(self, instant: int) -> list[Change]:
        return self._changes(lambda _, t: t > instant)

    def change(self, version: str) -> Change:
        found = self._changes(lambda v, _: str(v) == version)
        if not found:
            raise TableError(f"{self.base} has no change {version}")
        return found[0]

    def safe_from(self, instant: int) -> bool:
        listed = self._listed()
        if not listed[1]:
            return False
        v, path = listed[1][0]
        first = self._commits([path]).agg(F.max("commitInfo.timestamp")).first()[0] or 0
        return 0 < first <= instant


def _stats_json(schema: T.StructType) -> Column:
    """Statistics with bounds as JSON values of their types; no infinite ones."""

    def bound(f: T.StructField, end: str) -> Column | None:
        text = F.expr(f"stats['{f.name}'].{end}")
        if isinstance(f.dataType, T.StringType | T.DateType | T.TimestampType | T.TimestampNTZType):
            return text.alias(f.name)
        if isinstance(f.dataType, T.FloatType | T.DoubleType):
            number = text.try_cast("double")
            return F.when(F.abs(number) < float("inf"), number).alias(f.name)
        if isinstance(f.dataType, T.NumericType | T.BooleanType):
            return text.try_cast(f.dataType).alias(f.name)
        return None

    parts = [F.coalesce("record_count", F.lit(0)).alias("numRecords")]
    for title, end in (("minValues", "min"), ("maxValues", "max")):
        if columns := [b for f in schema if (b := bound(f, end)) is not None]:
            parts.append(F.struct(*columns).alias(title))
    if len(schema):
        parts.append(F.struct(*[F.expr(f"stats['{f.name}'].nulls").alias(f.name) for f in schema]).alias("nullCount"))
    return F.to_json(F.struct(*parts))


class Target(base.Target):
    format = "DELTA"

    def _source(self) -> Source | None:
        return Source(self.spark, self.base) if self.store.list(LOG) else None

    def sync_state(self) -> SyncState | None:
        source = self._source()
        return read_state(source.table().properties) if source else None

    def _path(self) -> Column:
        """Relative where the file lies below the table, with escapes."""
        local = paths.local_form(F.col("path"))
        root = paths.comparable(self.base).rstrip("/") + "/"
        below = F.when(local.startswith(root), F.substring(local, len(root) + 1, F.length(local))).otherwise(F.col("path"))
        return F.replace(F.replace(F.replace(below, F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20")), F.lit("?"), F.lit("%3F"))

    def _lines(self, table: Table, source_id: str, files: DataFrame, meta_id: str, vectors: bool) -> Iterator[bytes]:
        """files: op and FILES, removals first."""
        now = int(time.time() * 1000)
        state = state_properties(base.state_of(table, source_id))
        line = lambda **x: (json.dumps(x, separators=(",", ":")) + "\n").encode()
        protocol = {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["deletionVectors"], "writerFeatures": ["deletionVectors"]} if vectors else {"minReaderVersion": 1, "minWriterVersion": 2}
        yield line(commitInfo={"timestamp": table.instant or now, "operation": "SYNC", "operationParameters": {}})
        yield line(protocol=protocol)
        yield line(metaData={"id": meta_id, "name": self.name, "format": {"provider": "parquet", "options": {}}, "schemaString": schemas.to_delta(table.schema), "partitionColumns": table.partition_columns, "configuration": state, "createdTime": now})
        vector = F.when(F.col("dv").isNotNull(), F.struct(F.coalesce("dv.storage_type", F.lit("u")).alias("storageType"), F.col("dv.path_or_inline").alias("pathOrInlineDv"), F.col("dv.offset").cast("int").alias("offset"), F.col("dv.size").alias("sizeInBytes"), F.col("dv.cardinality").alias("cardinality")))
        values = F.coalesce("partition_values", F.create_map().cast("map<string,string>"))
        add = F.struct(self._path().alias("path"), values.alias("partitionValues"), F.coalesce("size_bytes", F.lit(0)).alias("size"), F.coalesce("last_modified", F.lit(0)).alias("modificationTime"), F.lit(True).alias("dataChange"), _stats_json(table.schema).alias("stats"), vector.alias("deletionVector"))
        remove = F.struct(self._path().alias("path"), F.lit(now).cast("bigint").alias("deletionTimestamp"), F.lit(True).alias("dataChange"), vector.alias("deletionVector"))
        rows = files.orderBy(F.when(F.col("op") == "REMOVE", 0).otherwise(1), "path")
        for row in rows.select(F.when(F.col("op") == "ADD", F.to_json(F.struct(add.alias("add")))).otherwise(F.to_json(F.struct(remove.alias("remove")))).alias("line")).toLocalIterator(prefetchPartitions=True):
            yield row.line.encode() + b"\n"

    def _commit(self, table: Table, source_id: str, files: DataFrame) -> None:
        vectors = not files.where("dv IS NOT NULL").isEmpty()

        def commit() -> None:
            source = self._source()
            version = int(source._versions()[1]) + 1 if source else 0
            meta_id = str(uuid.uuid5(uuid.NAMESPACE_URL, self.base))
            self.store.create(f"{LOG}/{version:020d}.json", self._lines(table, source_id, files, meta_id, vectors))

        self._retried(commit)

    def commit_snapshot(self, snapshot: Snapshot) -> None:
        """Adds what is new and removes what has gone since the last commit."""
        source = self._source()
        now = snapshot.files.select(*FILE_COLUMNS)
        changes = diff_files(source.snapshot().files, now.withColumn("path", paths.local_form(F.col("path")))) if source else now.withColumn("op", F.lit("ADD"))
        self._commit(snapshot.table, snapshot.source_id, changes)

    def commit_changes(self, changes: list[Change]) -> None:
        for c in changes:
            self._commit(c.table, c.version, c.files)
