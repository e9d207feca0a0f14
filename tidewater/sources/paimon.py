"""Apache Paimon with JSON manifests: snapshots of a base and a delta manifest list."""

from __future__ import annotations

import json
import re
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import paths, schemas
from tidewater.model import DV, FILE_COLUMNS, FILES, STAT, Change, PartitionField, Snapshot, SyncState, Table, TableError, read_state, state_properties
from tidewater.operators.files import diff_files, latest_action, one_per_path
from tidewater.sources import base

ENTRY = "entries array<struct<_KIND:int,_PARTITION:map<string,string>,_BUCKET:int,_TOTAL_BUCKETS:int,_FILE:struct<_FILE_NAME:string,_FILE_SIZE:bigint,_ROW_COUNT:bigint,_SCHEMA_ID:bigint,_LEVEL:int,_CREATION_TIME:bigint,_FILE_FORMAT:string>>>"
#: Entries of one manifest; manifests of a list until live files are written anew.
MANIFEST_FILES, MANY = 10_000, 500


class Source(base.Source):
    format = "PAIMON"

    def _versions(self, folder: str, prefix: str) -> dict[int, str]:
        found = {int(m[1]): f.path for f in self.store.list(folder) if (m := re.fullmatch(rf"{prefix}(\d+)", f.name))}
        return dict(sorted(found.items()))

    def _snapshots(self) -> dict[int, dict[str, Any]]:
        return {i: json.loads(self.store.text(p)) for i, p in self._versions("snapshot", "snapshot-").items()}

    def _latest(self) -> int | None:
        """The hint if its snapshot is there, else the greatest."""
        found = list(self._versions("snapshot", "snapshot-"))
        if self.store.exists("snapshot/LATEST"):
            hint = self.store.text("snapshot/LATEST").strip()
            if hint.isdigit() and int(hint) in found:
                return int(hint)
        return found[-1] if found else None

    def history(self) -> list[tuple[str, int]]:
        out, now = [], 0
        for i, s in self._snapshots().items():
            now = max(s["timeMillis"], now + 1)
            out.append((str(i), now))
        return out

    def _pick(self, version: str | None) -> dict[str, Any] | None:
        known = self._snapshots()
        at = self._latest() if version is None else int(version)
        if version is not None and at not in known:
            raise TableError(f"{self.base} has no snapshot {version}")
        return known.get(at) if at is not None else None

    def _table(self, snapshot: dict[str, Any] | None, instant: int) -> Table:
        known = self._versions("schema", "schema-")
        if not known:
            raise TableError(f"{self.base} has no Paimon schema")
        raw = json.loads(self.store.text(known.get((snapshot or {}).get("schemaId", -1)) or list(known.values())[-1]))
        schema = schemas.from_paimon(raw, self.lenient)
        return Table(self.name, self.format, self.base, schema, tuple(PartitionField(c) for c in raw.get("partitionKeys") or ()), instant, dict((snapshot or {}).get("properties") or {}))

    def table(self, version: str | None = None) -> Table:
        found = self._pick(version)
        return self._table(found, dict(self.history()).get(str(found["id"]), 0) if found else 0)

    def _entries(self, lists: list[tuple[int, str]]) -> DataFrame:
        """version (0 base, 1 delta), pos, op and file of the lists' manifests."""
        named = [(turn, k, m["_FILE_NAME"]) for turn, name in lists for k, m in enumerate(json.loads(self.store.text(f"manifest/{name}")).get("manifests") or ())]
        if not named:
            return self.spark.createDataFrame([], T.StructType([T.StructField("version", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("op", T.StringType()), T.StructField("file", FILES)]))
        order = self.spark.createDataFrame(named, "version int, nth int, name string")
        text = self.spark.read.text([self.store.full(f"manifest/{n}") for _, _, n in named], wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
        rows = text.join(order, "name").select("version", "nth", F.from_json("value", ENTRY, {"mode": "FAILFAST"}).alias("m")).select("version", "nth", F.posexplode("m.entries").alias("at", "e"))
        file = F.struct(
            paths.resolved(F.col("e._FILE._FILE_NAME"), self.base).alias("path"),
            F.upper(F.coalesce("e._FILE._FILE_FORMAT", F.lit("parquet"))).alias("file_format"),
            F.col("e._FILE._FILE_SIZE").alias("size_bytes"),
            F.col("e._FILE._ROW_COUNT").alias("record_count"),
            F.coalesce("e._PARTITION", F.create_map().cast("map<string,string>")).alias("partition_values"),
            F.col("e._FILE._CREATION_TIME").alias("last_modified"),
            F.lit(None).cast(DV).alias("dv"),
            F.lit(None).cast(T.MapType(T.StringType(), STAT)).alias("stats"),
        )
        return rows.select("version", (F.col("nth").cast("bigint") * (1 << 32) + F.col("at")).alias("pos"), F.when(F.col("e._KIND") == 1, "REMOVE").otherwise("ADD").alias("op"), file.alias("file"))

    def _files(self, snapshot: dict[str, Any]) -> DataFrame:
        lists = [(i, n) for i, n in ((0, snapshot.get("baseManifestList")), (1, snapshot.get("deltaManifestList"))) if n]
        return latest_action(self._entries(lists).withColumn("key", F.col("file.path")))

    def snapshot(self, version: str | None = None) -> Snapshot:
        found = self._pick(version)
        if found is None:
            return Snapshot(self._table(None, 0), self._no_files(), "")
        return Snapshot(self.table(str(found["id"])), self._files(found), str(found["id"]))

    def changes_since(self, instant: int) -> list[Change]:
        """Appends from their delta manifests; after an overwrite, live files against those before."""
        known, out, before = self._snapshots(), [], None
        for (version, t), s in zip(self.history(), known.values(), strict=True):
            if t > instant:
                table = self._table(s, t)
                if s.get("commitKind") == "APPEND":
                    files = self._entries([(1, s["deltaManifestList"])]).orderBy("pos").select("op", "file.*")
                else:
                    files = diff_files(self._files(before) if before else self._no_files(), self._files(s))
                out.append(Change(version, t, table, files, s.get("commitKind", "")))
            before = s
        return out


class Target(base.Target):
    format = "PAIMON"

    def _source(self) -> Source:
        return Source(self.spark, self.base)

    def sync_state(self) -> SyncState | None:
        found = self._source()._pick(None)
        return read_state(found.get("properties") or {}) if found else None

    def _schema_id(self, table: Table) -> int:
        """Schemas never change; an equal one is used again."""
        known = self._source()._versions("schema", "schema-")
        new = schemas.to_paimon(table.schema, table.partition_columns)
        same = lambda s: (s["fields"], s.get("partitionKeys") or []) == (new["fields"], new["partitionKeys"])
        for i, path in known.items():
            if same(json.loads(self.store.text(path))):
                return i
        new["id"] = max(known, default=-1) + 1
        self.store.create(f"schema/schema-{new['id']}", json.dumps(new).encode())
        return new["id"]

    def _list(self, changes: DataFrame | None, schema_id: int) -> str:
        """Writes manifests of at most MANIFEST_FILES entries, and the list that names them."""
        name, metas, entries = uuid.uuid4(), [], []

        def flush() -> None:
            data = json.dumps({"entries": entries}).encode()
            path = f"manifest-{name}-{len(metas)}"
            self.store.create(f"manifest/{path}", data)
            removed = sum(e["_KIND"] for e in entries)
            metas.append({"_FILE_NAME": path, "_FILE_SIZE": len(data), "_NUM_ADDED_FILES": len(entries) - removed, "_NUM_DELETED_FILES": removed, "_SCHEMA_ID": schema_id})
            entries.clear()

        for r in changes.orderBy(F.desc("op"), "path").toLocalIterator() if changes is not None else ():
            part = dict(r.partition_values or {})
            file = {"_FILE_NAME": paths.relative(r.path, self.base).replace("%", "%25"), "_FILE_SIZE": r.size_bytes or 0, "_ROW_COUNT": r.record_count or 0, "_SCHEMA_ID": schema_id, "_LEVEL": 0, "_CREATION_TIME": r.last_modified or 0, "_FILE_FORMAT": (r.file_format or "PARQUET").lower()}
            entries.append({"_KIND": int(r.op == "REMOVE"), "_PARTITION": part, "_BUCKET": 0, "_TOTAL_BUCKETS": 1, "_FILE": file})
            if len(entries) == MANIFEST_FILES:
                flush()
        if entries:
            flush()
        listed = f"manifest-list-{name}-0"
        self.store.create(f"manifest/{listed}", json.dumps({"manifests": metas}).encode())
        return listed

    def _base(self, before: dict[str, Any] | None, live: DataFrame | None, schema_id: int) -> str:
        """The list of what was there before: the manifests of the last snapshot's two lists, by name. If they have become many, live files are written anew."""
        metas = [m for n in ("baseManifestList", "deltaManifestList") if before and before.get(n) for m in json.loads(self.store.text(f"manifest/{before[n]}")).get("manifests") or ()]
        if len(metas) > MANY and live is not None:
            return self._list(live.withColumn("op", F.lit("ADD")), schema_id)
        listed = f"manifest-list-{uuid.uuid4()}-0"
        self.store.create(f"manifest/{listed}", json.dumps({"manifests": metas}).encode())
        return listed

    def _commit(self, table: Table, source_id: str, before: dict[str, Any] | None, changes: DataFrame, kind: str) -> None:
        """before: the snapshot that the changes are made to; null for none."""
        self._check(changes.where("op = 'ADD'"))
        schema_id = self._schema_id(table)
        live = self._source()._files(before) if before else None
        # a removal that carries no sizes takes those of the live file, so that totals stay right
        if live is not None and not changes.where("op = 'REMOVE'").isEmpty():
            own = live.select("path", F.struct(*FILE_COLUMNS).alias("known"))
            gone = changes.where("op = 'REMOVE'").select("path").join(own, "path").select(F.lit("REMOVE").alias("op"), "known.*")
            changes = gone.unionByName(changes.where("op = 'ADD'").select("op", *FILE_COLUMNS))
        add = F.when(F.col("op") == "ADD", F.coalesce("record_count", F.lit(0))).otherwise(-F.coalesce("record_count", F.lit(0)))
        delta = changes.agg(F.sum(add)).first()[0] or 0
        total = delta + ((before.get("totalRecordCount") or 0) if before else 0)
        lists = self._base(before, live, schema_id), self._list(changes, schema_id)
        known = self._source()._versions("snapshot", "snapshot-")
        number = max(known, default=0) + 1
        snapshot = {"version": 3, "id": number, "schemaId": schema_id, "baseManifestList": lists[0], "deltaManifestList": lists[1], "commitUser": "tidewater", "commitIdentifier": number, "commitKind": kind, "timeMillis": int(time.time() * 1000), "totalRecordCount": total, "deltaRecordCount": delta, "properties": state_properties(base.state_of(table, source_id))}
        self.store.create(f"snapshot/snapshot-{number}", json.dumps(snapshot).encode())
        if number == 1:
            self.store.write("snapshot/EARLIEST", b"1")
        self.store.write("snapshot/LATEST", str(number).encode())

    def commit_snapshot(self, snapshot: Snapshot) -> None:
        files = one_per_path(snapshot.files).withColumn("op", F.lit("ADD"))
        self._retried(lambda: self._commit(snapshot.table, snapshot.source_id, None, files, "OVERWRITE"))

    def commit_changes(self, changes: list[Change]) -> None:
        for c in changes:

            def commit(c: Change = c) -> None:
                self._commit(c.table, c.version, self._source()._pick(None), c.files, "APPEND")

            self._retried(commit)
