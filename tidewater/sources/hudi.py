"""Apache Hudi, table versions up to 6: the timeline's commits as rows."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import paths, schemas
from tidewater.model import DV, FILE_COLUMNS, STAT, Change, PartitionField, Snapshot, SyncState, Table, TableError, read_state, state_properties
from tidewater.operators.files import diff_files
from tidewater.sources import base
from tidewater.sources.storage import Exists

DIR = ".hoodie"
NEWEST = 6
COMMIT = "partitionToWriteStats map<string,array<struct<fileId:string,path:string,numWrites:bigint,numDeletes:bigint,totalWriteBytes:bigint,fileSizeInBytes:bigint>>>, partitionToReplaceFileIds map<string,array<string>>, extraMetadata map<string,string>, operationType string"
_completed = re.compile(r"(\d{14,17})(?:_\d+)?\.(commit|deltacommit|replacecommit)")
#: Property names of the format.
NAME, KIND, VERSION, FILE_FORMAT, PARTITIONS, SCHEMA = "hoodie.table.name", "hoodie.table.type", "hoodie.table.version", "hoodie.table.base.file.format", "hoodie.table.partition.fields", "hoodie.table.schema"


def parse_properties(text: str) -> dict[str, str]:
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!" and (m := re.match(r"((?:[^=:\\]|\\.)*)\s*[=:]\s*(.*)", line)):
            out[re.sub(r"\\(.)", r"\1", m[1].strip())] = re.sub(r"\\([:=#!\\ ])", r"\1", m[2])
    return out


def instant_ms(instant: str) -> int:
    try:
        whole = datetime.strptime(instant[:14], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
    except ValueError as e:
        raise TableError(f"not a Hudi instant: {instant}") from e
    return int(whole.timestamp()) * 1000 + int(instant[14:17] or 0)


def to_instant(ms: int) -> str:
    return (datetime.fromtimestamp(ms // 1000, timezone.utc)).strftime("%Y%m%d%H%M%S") + f"{ms % 1000:03d}"


class Source(base.Source):
    format = "HUDI"

    def properties(self) -> dict[str, str]:
        if not self.store.exists(f"{DIR}/hoodie.properties"):
            raise TableError(f"{self.base} has no Hudi table")
        found = parse_properties(self.store.text(f"{DIR}/hoodie.properties"))
        version = found.get(VERSION, "").strip()
        if version.isdigit() and int(version) > NEWEST:
            raise TableError(f"Hudi table version {version} of {self.base} isn't read; up to {NEWEST} are")
        return found

    def _timeline(self) -> list[tuple[str, str, str]]:
        """Instant, action, path of completed commits, in order."""
        return sorted((m[1], m[2], f.path) for f in self.store.list(DIR) if (m := _completed.fullmatch(f.name)))

    def history(self) -> list[tuple[str, int]]:
        self.properties()
        out, now = [], 0
        for instant, _, _ in self._timeline():
            now = max(instant_ms(instant), now + 1)
            out.append((instant, now))
        return out

    def _at(self, version: str | None) -> list[tuple[str, str, str]]:
        line = self._timeline()
        if version is None:
            return line
        if version not in [i for i, _, _ in line]:
            raise TableError(f"{self.base} has no instant {version}")
        return [x for x in line if x[0] <= version]

    def table(self, version: str | None = None) -> Table:
        properties, line = self.properties(), self._at(version)
        columns = [c for c in properties.get(PARTITIONS, "").split(",") if c]
        text = None
        for _, _, path in reversed(line):
            commit = json.loads(self.store.text(path))
            if text := (commit.get("extraMetadata") or {}).get("schema"):
                break
        text = text or properties.get(SCHEMA)
        schema = schemas.from_avro(json.loads(text), self.lenient) if text else T.StructType()
        schema = T.StructType([f for f in schema if not f.name.startswith("_hoodie_")])
        for c in columns:
            if c not in schema.fieldNames():
                schema = schema.add(c, T.StringType())
        instant = dict(self.history()).get(line[-1][0], 0) if line else 0
        return Table(properties.get(NAME) or self.name, self.format, self.base, schema, tuple(PartitionField(c.split(":")[0]) for c in columns), instant, properties)

    def _commits(self, line: list[tuple[str, str, str]]) -> DataFrame:
        """instant and the parsed commit; one that can't be parsed is an error."""
        text = self.spark.read.text([p for _, _, p in line], wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).alias("instant"))
        return text.select("instant", F.from_json(F.when(F.trim("value") == "", F.lit("{}")).otherwise(F.col("value")), COMMIT, {"mode": "FAILFAST"}).alias("c"))

    def _files(self, line: list[tuple[str, str, str]], columns: list[str]) -> DataFrame:
        if not line:
            return self._no_files()
        commits = self._commits(line)
        name = lambda p: F.substring_index(p, "/", -1)
        writes = commits.select("instant", F.explode("c.partitionToWriteStats").alias("partition", "stats")).select("instant", "partition", F.explode("stats").alias("w"))
        group = F.coalesce(F.when(F.col("w.fileId") != "", F.col("w.fileId")), F.regexp_extract(name(F.col("w.path")), r"^([^_]+)", 1))
        # the group of a log file's name stands between its dot and the first underscore
        group = F.regexp_replace(group, r"^\.", "")
        writes = writes.select("instant", "partition", group.alias("group"), "w", name(F.col("w.path")).rlike(r"^\.|\.log\.").alias("log"))
        based, logged = F.when(~F.col("log"), F.col("instant")), F.when(F.col("log"), F.col("instant"))
        last = writes.groupBy("partition", "group").agg(F.max_by("w", based).alias("w"), F.max("instant").alias("instant"), F.max(based).alias("based"), F.max(logged).alias("logged"))
        replaced = commits.select("instant", F.explode("c.partitionToReplaceFileIds").alias("partition", "groups")).select(F.col("instant").alias("at"), F.col("partition").alias("p"), F.explode("groups").alias("g"))
        # a commit replaces groups before it writes its own
        live = last.join(replaced, (F.col("partition") == F.col("p")) & (F.col("group") == F.col("g")) & (F.col("at") > F.col("instant")), "left_anti")
        if not self.lenient and any(action == "deltacommit" for _, action, _ in line) and not live.where("logged >= coalesce(based, '')").isEmpty():
            raise TableError(f"{self.base} has log files that aren't compacted; what they change would be lost")
        live = live.where("based IS NOT NULL")
        segments = F.split("partition", "/")
        values = F.create_map().cast("map<string,string>")
        if columns:
            part = lambda i: F.get(segments, F.lit(i))
            value = lambda i, c: F.when(part(i).startswith(f"{c}="), paths.decoded(F.substring_index(part(i), "=", -1))).otherwise(paths.decoded(part(i)))
            whole = paths.decoded(F.col("partition")) if len(columns) == 1 else None
            texts = [F.when(F.col("partition").startswith(f"{c}="), value(0, c)).otherwise(whole) if whole is not None else value(i, c) for i, c in enumerate(columns)]
            values = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.when(t != "__HIVE_DEFAULT_PARTITION__", t) for t in texts]))
        return live.select(paths.resolved(F.col("w.path"), self.base).alias("path"), F.lit("PARQUET").alias("file_format"), F.coalesce("w.fileSizeInBytes", "w.totalWriteBytes").alias("size_bytes"), F.col("w.numWrites").alias("record_count"), values.alias("partition_values"), F.lit(None).cast("bigint").alias("last_modified"), F.lit(None).cast(DV).alias("dv"), F.lit(None).cast(T.MapType(T.StringType(), STAT)).alias("stats"))

    def snapshot(self, version: str | None = None) -> Snapshot:
        table, line = self.table(version), self._at(version)
        return Snapshot(table, self._files(line, table.partition_columns), line[-1][0] if line else "")

    def changes_since(self, instant: int) -> list[Change]:
        """Each instant's live files against those before it."""
        line, out = self._timeline(), []
        for k, (version, t) in enumerate(self.history()):
            if t > instant:
                table = self.table(version)
                now, then = self._files(line[: k + 1], table.partition_columns), self._files(line[:k], table.partition_columns)
                out.append(Change(version, t, table, diff_files(then, now), line[k][1]))
        return out


class Target(base.Target):
    format = "HUDI"

    def _source(self) -> Source | None:
        return Source(self.spark, self.base) if self.store.exists(f"{DIR}/hoodie.properties") else None

    def sync_state(self) -> SyncState | None:
        source = self._source()
        if not source:
            return None
        line = source._timeline()
        latest = (json.loads(self.store.text(line[-1][2])).get("extraMetadata") or {}) if line else {}
        return read_state(latest) or read_state(source.properties())

    def _commit(self, table: Table, source_id: str, changes: DataFrame) -> None:
        """changes: op and FILES. File groups are named after their paths, so that a later commit can replace them."""
        self._check(changes.where("op = 'ADD'"))
        source = self._source()
        if not source and self.store.list(DIR):
            raise TableError(f"{self.base} has a timeline without readable properties")
        properties = source.properties() if source else {}
        line = source._timeline() if source else []
        root = paths.comparable(self.base).rstrip("/") + "/"
        local = paths.local_form(F.col("path"))
        columns = table.partition_columns
        rel = F.when(local.startswith(root), F.substring(local, len(root) + 1, F.length(local)))
        below = changes.withColumn("rel", rel)
        if outside := below.where("rel IS NULL").select("path").first():
            raise TableError(f"{outside.path} isn't below {self.base}")
        pieces = [F.concat(F.lit(f"{c}="), F.coalesce(F.replace(F.url_encode(F.col("partition_values")[c]), F.lit("+"), F.lit("%20")), F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in columns]
        partition = F.concat_ws("/", *pieces) if columns else F.lit("")
        group = F.concat(F.lower(F.hex(F.xxhash64("rel"))), F.lit("-0"))
        escaped = F.replace(F.replace("rel", F.lit("%"), F.lit("%25")), F.lit("?"), F.lit("%3F"))
        rows = below.where("op = 'ADD'").select(partition.alias("partition"), F.struct(group.alias("fileId"), escaped.alias("path"), F.coalesce("record_count", F.lit(0)).alias("numWrites"), F.coalesce("size_bytes", F.lit(0)).alias("totalWriteBytes"), F.coalesce("size_bytes", F.lit(0)).alias("fileSizeInBytes")).alias("w"))
        gone = below.where("op = 'REMOVE'").select(group.alias("g"))
        state = state_properties(base.state_of(table, source_id))
        avro = schemas.to_avro(table.schema, self.name, f"hoodie.{self.name}")
        replaced: dict[str, list[str]] = {}
        if source and line:
            # removals carry paths only: the live groups tell their partitions
            live = source._commits(line).select(F.explode("c.partitionToWriteStats").alias("partition", "stats")).select("partition", F.explode("stats").alias("w")).select("partition", F.col("w.fileId").alias("g")).distinct()
            for r in live.join(gone.distinct(), "g").orderBy("partition", "g").toLocalIterator():
                replaced.setdefault(r.partition, []).append(r.g)
        writes: dict[str, list[dict]] = {}
        for r in rows.orderBy("partition", "w.path").toLocalIterator():
            writes.setdefault(r.partition, []).append(r.w.asDict())
        commit = {"partitionToWriteStats": writes, "extraMetadata": state | {"schema": json.dumps(avro)}, "operationType": "UPSERT"}
        if replaced:
            commit |= {"partitionToReplaceFileIds": replaced, "operationType": "INSERT_OVERWRITE"}
        now = int(datetime.now(timezone.utc).timestamp() * 1000)
        if line:
            now = max(now, instant_ms(line[-1][0]) + 1)
        if [x[0] for x in (source._timeline() if source else ())] != [x[0] for x in line]:
            raise Exists(f"another commit of {self.base}")  # what it replaces is read again
        self.store.create(f"{DIR}/{to_instant(now)}.{'replacecommit' if replaced else 'commit'}", json.dumps(commit).encode())
        properties |= {NAME: self.name, KIND: "COPY_ON_WRITE", VERSION: str(NEWEST), FILE_FORMAT: "PARQUET", SCHEMA: json.dumps(avro)} | state
        if columns:
            properties[PARTITIONS] = ",".join(columns)
        escape = lambda s: s.replace("\\", "\\\\")
        self.store.write(f"{DIR}/hoodie.properties", "".join(f"{k}={escape(v)}\n" for k, v in sorted(properties.items())).encode())

    def commit_snapshot(self, snapshot: Snapshot) -> None:
        def commit() -> None:
            source = self._source()
            files = snapshot.files.select(*FILE_COLUMNS)
            if source and source._timeline():
                old, new = source.snapshot().files, files.withColumn("path", paths.local_form(F.col("path")))
                self._commit(snapshot.table, snapshot.source_id, diff_files(old, new))
            else:
                self._commit(snapshot.table, snapshot.source_id, files.withColumn("op", F.lit("ADD")))

        self._retried(commit)

    def commit_changes(self, changes: list[Change]) -> None:
        for c in changes:
            self._retried(lambda c=c: self._commit(c.table, c.version, c.files))
