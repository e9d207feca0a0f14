"""Apache Iceberg: metadata JSON on the driver, manifests as rows made by tasks."""

from __future__ import annotations

import json
import random
import re
import time
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import avro, bounds, paths, schemas
from tidewater.model import FILE_COLUMNS, FILES, Change, PartitionField, Snapshot, SyncState, Table, TableError, field_by_path, read_state, state_properties
from tidewater.operators.files import apply_diff, diff_files, one_per_path
from tidewater.sources import base

DIR = "metadata"
#: Files that one manifest lists.
MANIFEST_FILES = 10_000
_name = re.compile(r"(?:v(\d+)|(\d+)-[0-9a-fA-F-]+)(?:\.gz)?\.metadata\.json")
MAPPING = "schema.name-mapping.default"
MINIMUM, MAXIMUM = 1, 2


def metadata_version(name: str) -> int | None:
    m = _name.fullmatch(name)
    return int(m[1] or m[2]) if m else None


def _stat_map(name: str, field_id: int, key_id: int, value: str) -> dict[str, Any]:
    record = {"type": "record", "name": f"k{key_id}_v{key_id + 1}", "fields": [{"name": "key", "field-id": key_id, "type": "int"}, {"name": "value", "field-id": key_id + 1, "type": value}]}
    return {"name": name, "field-id": field_id, "type": ["null", {"type": "array", "logicalType": "map", "items": record}], "default": None}


def manifest_schema(partition: list[dict[str, Any]]) -> dict[str, Any]:
    """Names and field ids of manifest entries. partition: fields of the partition record."""
    maybe = lambda name, field_id, kind: {"name": name, "field-id": field_id, "type": ["null", kind], "default": None}
    data = [
        {"name": "content", "field-id": 134, "type": "int"},
        {"name": "file_path", "field-id": 100, "type": "string"},
        {"name": "file_format", "field-id": 101, "type": "string"},
        {"name": "partition", "field-id": 102, "type": {"type": "record", "name": "r102", "fields": partition}},
        {"name": "record_count", "field-id": 103, "type": "long"},
        {"name": "file_size_in_bytes", "field-id": 104, "type": "long"},
        _stat_map("value_counts", 109, 119, "long"),
        _stat_map("null_value_counts", 110, 121, "long"),
        _stat_map("nan_value_counts", 137, 138, "long"),
        _stat_map("lower_bounds", 125, 126, "bytes"),
        _stat_map("upper_bounds", 128, 129, "bytes"),
    ]
    entry = [{"name": "status", "field-id": 0, "type": "int"}, maybe("snapshot_id", 1, "long"), maybe("sequence_number", 3, "long"), maybe("file_sequence_number", 4, "long"), {"name": "data_file", "field-id": 2, "type": {"type": "record", "name": "r2", "fields": data}}]
    return {"type": "record", "name": "manifest_entry", "fields": entry}


#: Names, field ids and types of a manifest list's records.
LIST_FIELDS = (
    ("manifest_path", 500, "string"),
    ("manifest_length", 501, "long"),
    ("partition_spec_id", 502, "int"),
    ("content", 517, "int"),
    ("sequence_number", 515, "long"),
    ("min_sequence_number", 516, "long"),
    ("added_snapshot_id", 503, "long"),
    ("added_files_count", 504, "int"),
    ("existing_files_count", 505, "int"),
    ("deleted_files_count", 506, "int"),
    ("added_rows_count", 512, "long"),
    ("existing_rows_count", 513, "long"),
    ("deleted_rows_count", 514, "long"),
)
LIST_SCHEMA = {"type": "record", "name": "manifest_file", "fields": [{"name": n, "field-id": i, "type": t} for n, i, t in LIST_FIELDS]}

#: Avro types of identity partition values.
_PARTITION = {T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.DateType: {"type": "int", "logicalType": "date"}, T.TimestampType: {"type": "long", "logicalType": "timestamp-micros", "adjust-to-utc": True}, T.TimestampNTZType: {"type": "long", "logicalType": "timestamp-micros", "adjust-to-utc": False}}


def _partition_value(kind: T.DataType, text: str | None) -> Any:
    if text is None:
        return None
    if isinstance(kind, T.StringType):
        return text
    data = bounds.encode(kind, text, False)
    if data is None:
        raise TableError(f"partition value {text!r} isn't of type {kind.simpleString()}")
    if isinstance(kind, T.BooleanType):
        return data == b"\x01"
    if isinstance(kind, T.FloatType | T.DoubleType):
        return float(text)
    return int.from_bytes(data, "little", signed=True)


def _partition_text(kind: T.DataType, value: Any) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(kind, T.DateType):
        return bounds.decode(kind, int(value).to_bytes(4, "little", signed=True))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return bounds.decode(kind, int(value).to_bytes(8, "little", signed=True))
    return bounds.canonical(value)


class Source(base.Source):
    format = "ICEBERG"

    def _metadata_files(self) -> list[tuple[int, str]]:
        """Versions in order; of equal ones the last name counts. The hint isn't trusted."""
        found = {v: f.path for f in self.store.list(DIR) if (v := metadata_version(f.name)) is not None}
        return sorted(found.items())

    def metadata(self) -> dict[str, Any]:
        found = self._metadata_files()
        if not found:
            raise TableError(f"{self.base} has no Iceberg metadata")
        meta = json.loads(self.store.text(found[-1][1]))
        if not MINIMUM <= meta.get("format-version", 0) <= MAXIMUM:
            raise TableError(f"Iceberg version {meta.get('format-version')} of {self.base} isn't read; {MINIMUM} to {MAXIMUM} are")
        return meta

    @staticmethod
    def _schemas(meta: dict[str, Any]) -> dict[int, dict[str, Any]]:
        return {s.get("schema-id", 0): s for s in meta.get("schemas") or [meta["schema"]]}

    @staticmethod
    def _specs(meta: dict[str, Any]) -> dict[int, list[dict[str, Any]]]:
        if "partition-specs" in meta:
            return {s["spec-id"]: s.get("fields") or [] for s in meta["partition-specs"]}
        return {0: meta.get("partition-spec") or []}

    def _table(self, meta: dict[str, Any], snapshot: dict[str, Any] | None, instant: int) -> Table:
        known = self._schemas(meta)
        raw = known.get((snapshot or {}).get("schema-id", meta.get("current-schema-id", 0))) or known.get(meta.get("current-schema-id", 0)) or next(iter(known.values()))
        schema = schemas.from_iceberg(raw, self.lenient)
        names = {f["id"]: f["name"] for f in raw["fields"]}
        fields = []
        for f in self._specs(meta).get(meta.get("default-spec-id", 0), []):
            if f["transform"] == "void":
                continue
            if f["source-id"] in names:
                fields.append(PartitionField(names[f["source-id"]], f["transform"], f["name"]))
        return Table(self.name, self.format, self.base, schema, tuple(fields), instant, dict(meta.get("properties") or {}))

    def _snapshots(self, meta: dict[str, Any]) -> list[tuple[dict[str, Any], int]]:
        """The current line of snapshots, oldest first, with growing instants; parents that expired end it."""
        by_id = {s["snapshot-id"]: s for s in meta.get("snapshots") or ()}
        current = meta.get("current-snapshot-id")
        at = by_id.get(current) if current not in (None, -1) else (meta["snapshots"][-1] if meta.get("snapshots") else None)
        line: list[dict[str, Any]] = []
        seen: set[int] = set()
        while at and at["snapshot-id"] not in seen:
            seen.add(at["snapshot-id"])
            line.append(at)
            at = by_id.get(at.get("parent-snapshot-id"))
        out, now = [], 0
        for s in reversed(line):
            now = max(s["timestamp-ms"], now + 1)
            out.append((s, now))
        return out

    def history(self) -> list[tuple[str, int]]:
        return [(str(s["snapshot-id"]), t) for s, t in self._snapshots(self.metadata())]

    def _find(self, meta: dict[str, Any], version: str | None) -> tuple[dict[str, Any] | None, int]:
        line = self._snapshots(meta)
        if version is None:
            return line[-1] if line else (None, meta.get("last-updated-ms", 0))
        found = [x for x in line if str(x[0]["snapshot-id"]) == version]
        found = found or [(s, s["timestamp-ms"]) for s in meta.get("snapshots") or () if str(s["snapshot-id"]) == version]
        if not found:
            raise TableError(f"{self.base} has no snapshot {version}")
        return found[0]

    def table(self, version: str | None = None) -> Table:
        meta = self.metadata()
        return self._table(meta, *self._find(meta, version))

    def _files(self, meta: dict[str, Any], snapshot: dict[str, Any], table: Table, added: bool = False) -> DataFrame:
        """Live data files, or only those that the snapshot added: a task for each manifest; manifests of delete files aren't opened."""
        if "manifest-list" in snapshot:
            _, entries = avro.load(self.store.read(snapshot["manifest-list"]))
            if any(e.get("content") == 1 for e in entries) and not self.lenient:
                raise TableError(f"{self.base} has delete files; rows that they delete would come back")
            manifests = [(e["manifest_path"], e.get("partition_spec_id", 0)) for e in entries if e.get("content", 0) == 0 and (not added or e.get("added_snapshot_id") in (None, snapshot["snapshot-id"]))]
        else:
            manifests = [(p, 0) for p in snapshot.get("manifests") or ()]
        if not manifests:
            return self._no_files()
        types, names = {}, {}
        for raw in self._schemas(meta).values():
            for f, s in zip(raw["fields"], schemas.from_iceberg(raw, True), strict=True):
                types[f["id"]], names[f["id"]] = s.dataType, f["name"]
        for f in table.schema:
            names[f.metadata.get("field_id")] = f.name  # renamed columns carry today's name
        specs = {k: {p["name"]: p for p in v} for k, v in self._specs(meta).items()}
        of_manifest = {paths.comparable(p): spec for p, spec in manifests}
        number = snapshot["snapshot-id"]

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    header, entries = avro.load(content)
                    spec = specs.get(int(header.get("partition-spec-id", of_manifest.get(paths.comparable(path), 0))), {})
                    rows = []
                    for e in entries:
                        d = e["data_file"]
                        if e["status"] == 2 or d.get("content", 0) != 0 or added and (e["status"] != 1 or e.get("snapshot_id") not in (None, number)):
                            continue
                        maps = {k: {x["key"]: x["value"] for x in d.get(k) or ()} for k in ("value_counts", "null_value_counts", "nan_value_counts", "lower_bounds", "upper_bounds")}
                        ids = sorted({i for m in maps.values() for i in m} & names.keys())
                        stats = [(names[i], {"min": bounds.decode(types[i], maps["lower_bounds"].get(i)) if i in types else None, "max": bounds.decode(types[i], maps["upper_bounds"].get(i)) if i in types else None, "nulls": maps["null_value_counts"].get(i), "nans": maps["nan_value_counts"].get(i), "total": maps["value_counts"].get(i)}) for i in ids]
                        values = []
                        for name, value in (d.get("partition") or {}).items():
                            field = spec.get(name)
                            if field and field["transform"] == "identity" and field["source-id"] in names:
                                values.append((names[field["source-id"]], _partition_text(types[field["source-id"]], value)))
                        kind = d["file_format"].upper()
                        rows.append((d["file_path"], kind if kind in ("ORC", "AVRO") else "PARQUET", d["file_size_in_bytes"], d["record_count"], values, None, None, stats))
                    yield _file_batch(rows)

        content = self.spark.read.format("binaryFile").load([p for p, _ in manifests]).select("path", "content")
        return content.repartition(max(1, min(len(manifests), 1000))).mapInArrow(read, FILES)

    def snapshot(self, version: str | None = None) -> Snapshot:
        meta = self.metadata()
        found, instant = self._find(meta, version)
        table = self._table(meta, found, instant)
        return Snapshot(table, self._files(meta, found, table) if found else self._no_files(), str(found["snapshot-id"]) if found else "")

    def changes_since(self, instant: int) -> list[Change]:
        """What an append added, by its own manifests' entries; of other snapshots, live files against the parent's."""
        meta = self.metadata()
        line = self._snapshots(meta)
        out = []
        for k, (s, t) in enumerate(line):
            if t <= instant:
                continue
            table = self._table(meta, s, t)
            operation = (s.get("summary") or {}).get("operation", "")
            if operation == "append" and "manifest-list" in s and (k or s.get("parent-snapshot-id") is None):
                files = self._files(meta, s, table, True).withColumn("op", F.lit("ADD")).select("op", *FILE_COLUMNS)
                out.append(Change(str(s["snapshot-id"]), t, table, files, operation))
                continue
            now = self._files(meta, s, table)
            if k:
                files = diff_files(self._files(meta, line[k - 1][0], table), now)
            elif s.get("parent-snapshot-id") is not None:
                raise TableError(f"the parent of snapshot {s['snapshot-id']} of {self.base} has expired")
            else:
                files = now.withColumn("op", F.lit("ADD")).select("op", *FILE_COLUMNS)
            out.append(Change(str(s["snapshot-id"]), t, table, files, operation))
        return out


_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("file_format", pa.string()),
        ("size_bytes", pa.int64()),
        ("record_count", pa.int64()),
        ("partition_values", pa.map_(pa.string(), pa.string())),
        ("last_modified", pa.int64()),
        ("dv", pa.struct([("storage_type", pa.string()), ("path_or_inline", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("cardinality", pa.int64())])),
        ("stats", pa.map_(pa.string(), pa.struct([("min", pa.string()), ("max", pa.string()), ("nulls", pa.int64()), ("nans", pa.int64()), ("total", pa.int64())]))),
    ]
)


def _file_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW, strict=True)], _ARROW.names)


class Target(base.Target):
    format = "ICEBERG"

    def _source(self) -> Source | None:
        source = Source(self.spark, self.base, lenient=True)
        return source if source._metadata_files() else None

    def sync_state(self) -> SyncState | None:
        source = self._source()
        return read_state(source.metadata().get("properties") or {}) if source else None

    def _manifests(self, files: DataFrame, schema: dict[str, Any], table: Table, spec: dict[str, Any], snapshot_id: int, sequence: int) -> list[dict[str, Any]]:
        """Encodes manifests in tasks, all at the same time, sorted by path; the driver then writes one after the other."""
        ids = {f["name"]: f["id"] for f in schema["fields"]}
        kinds = {f.name: f.dataType for f in table.schema}
        columns = {f["name"]: next(n for n, i in ids.items() if i == f["source-id"]) for f in spec["fields"]}
        record = [{"name": f["name"], "field-id": f["field-id"], "type": ["null", _PARTITION[type(kinds[columns[f["name"]]])]], "default": None} for f in spec["fields"]]
        shape = manifest_schema(record)
        header = {"schema": json.dumps(schema), "schema-id": str(schema["schema-id"]), "partition-spec": json.dumps(spec["fields"]), "partition-spec-id": str(spec["spec-id"]), "format-version": "2", "content": "data"}

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, MANIFEST_FILES):
                    entries, rows = [], 0
                    for f in batch.slice(at, MANIFEST_FILES).to_pylist():
                        values, stats = dict(f["partition_values"] or ()), dict(f["stats"] or ())
                        known = {n: s for n, s in stats.items() if n in ids and s is not None}
                        pairs = lambda get: sorted(({"key": ids[n], "value": v} for n, s in known.items() if (v := get(n, s)) is not None), key=lambda x: x["key"]) or None  # noqa: B023, E731
                        rows += f["record_count"] or 0
                        data = {
                            "content": 0,
                            "file_path": f["path"],
                            "file_format": f["file_format"] or "PARQUET",
                            "partition": {name: _partition_value(kinds[c], values.get(c)) for name, c in columns.items()},
                            "record_count": f["record_count"] or 0,
                            "file_size_in_bytes": f["size_bytes"] or 0,
                            "value_counts": pairs(lambda n, s: s["total"] if s["total"] is not None else f["record_count"]),  # noqa: B023
                            "null_value_counts": pairs(lambda n, s: s["nulls"]),
                            "nan_value_counts": pairs(lambda n, s: s["nans"]),
                            "lower_bounds": pairs(lambda n, s: bounds.encode(kinds[n], s["min"], True)),
                            "upper_bounds": pairs(lambda n, s: bounds.encode(kinds[n], s["max"], False)),
                        }
                        entries.append({"status": 1, "snapshot_id": snapshot_id, "sequence_number": None, "file_sequence_number": None, "data_file": data})
                    if entries:
                        yield pa.RecordBatch.from_arrays([pa.array([avro.dump(shape, entries, header)], pa.binary()), pa.array([len(entries)], pa.int64()), pa.array([rows], pa.int64())], ["data", "files", "rows"])

        parts = max(1, -(-files.count() // MANIFEST_FILES))
        sorted_files = files.select(*FILE_COLUMNS).repartitionByRange(parts, "path").sortWithinPartitions("path")
        out, encoded = [], sorted_files.mapInArrow(encode, "data binary, files bigint, rows bigint").persist()
        encoded.count()  # else one task would run after the other
        for k, row in enumerate(encoded.toLocalIterator()):
            path = self.store.create(f"{DIR}/{uuid.uuid4()}-m{k}.avro", bytes(row.data))
            counts = {"added_files_count": row.files, "existing_files_count": 0, "deleted_files_count": 0, "added_rows_count": row.rows, "existing_rows_count": 0, "deleted_rows_count": 0}
            out.append({"manifest_path": path, "manifest_length": len(row.data), "partition_spec_id": spec["spec-id"], "content": 0, "sequence_number": sequence, "min_sequence_number": sequence, "added_snapshot_id": snapshot_id} | counts)
        encoded.unpersist()
        return out

    def _rewritten(self, entries: list[dict[str, Any]], changed: DataFrame, snapshot_id: int, sequence: int) -> list[dict[str, Any]]:
        """Entries of a manifest list without the changed paths: manifests that hold none stay as they are; the others are written anew by tasks, with what goes marked as deleted and the rest as existing."""
        if not entries:
            return []
        known = {paths.comparable(e["manifest_path"]): e for e in entries}

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for manifest, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = [e["data_file"]["file_path"] for e in avro.load(content)[1] if e["status"] != 2]
                    yield pa.RecordBatch.from_arrays([pa.array([manifest] * len(found), pa.string()), pa.array(found, pa.string())], ["manifest", "path"])

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for manifest, content, gone in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    header, old = avro.load(content)
                    gone, of, out, sums = set(gone), known[paths.comparable(manifest)], [], [0, 0, 0, 0]
                    for e in old:
                        if e["status"] == 2:
                            continue
                        goes = e["data_file"]["file_path"] in gone
                        numbers = {k: e.get(k) if e.get(k) is not None else of["sequence_number"] for k in ("sequence_number", "file_sequence_number")}
                        owner = snapshot_id if goes else e["snapshot_id"] if e.get("snapshot_id") is not None else of["added_snapshot_id"]
                        out.append(e | numbers | {"status": 2 if goes else 0, "snapshot_id": owner})
                        sums[2 * goes] += 1
                        sums[2 * goes + 1] += e["data_file"]["record_count"]
                    rest = {k: v for k, v in header.items() if k not in ("avro.schema", "avro.codec")}
                    yield pa.RecordBatch.from_arrays([pa.array([avro.dump(json.loads(header["avro.schema"]), out, rest)], pa.binary()), pa.array([manifest]), *(pa.array([x], pa.int64()) for x in sums)], ["data", "manifest", "files", "rows", "gone", "gone_rows"])

        names = [e["manifest_path"] for e in entries]
        content = self.spark.read.format("binaryFile").load(names).select(F.col("path").alias("manifest"), "content").repartition(max(1, min(len(names), 1000)))
        held = content.mapInArrow(named, "manifest string, path string").join(changed.select("path").distinct(), "path").groupBy("manifest").agg(F.collect_set("path").alias("gone"))  # a manifest's own paths
        done = content.join(held, "manifest").mapInArrow(write, "data binary, manifest string, files bigint, rows bigint, gone bigint, gone_rows bigint")
        new = {}
        for r in done.toLocalIterator():
            path = self.store.create(f"{DIR}/{uuid.uuid4()}-m.avro", bytes(r.data))
            counts = {"added_files_count": 0, "added_rows_count": 0, "existing_files_count": r.files, "existing_rows_count": r.rows, "deleted_files_count": r.gone, "deleted_rows_count": r.gone_rows}
            old = known[paths.comparable(r.manifest)]
            new[old["manifest_path"]] = old | {"manifest_path": path, "manifest_length": len(r.data), "sequence_number": sequence, "added_snapshot_id": snapshot_id} | counts
        return [new.get(e["manifest_path"], e) for e in entries]

    def _commit(self, table: Table, source_id: str, files: DataFrame, operation: str, changed: DataFrame | None = None) -> None:
        """files: what is added. changed: the files whose entries go; the rest of the table stays. None: nothing stays."""
        self._check(files)
        source = self._source()
        before = source.metadata() if source else {}
        version = source._metadata_files()[-1][0] + 1 if source else 1
        old = list(before.get("schemas") or ())
        current = next((s for s in old if s["schema-id"] == before.get("current-schema-id")), None)
        full = T.StructType(list(table.schema.fields))  # the table's own schema is shared
        for c in table.partition_columns:
            if field_by_path(full, c) is None:
                full = full.add(c, T.StringType())
        known = {f["name"]: f["id"] for f in current["fields"]} if current else {}
        schema, last = schemas.to_iceberg(full, max((s["schema-id"] for s in old), default=-1) + 1, before.get("last-column-id", 0), known)
        if current and current["fields"] == schema["fields"]:
            schema = current
        else:
            old.append(schema)
        ids = {f["name"]: f["id"] for f in schema["fields"]}
        if other := [p.transform for p in table.partition_fields if p.transform != "identity"]:
            raise TableError(f"only identity partitions are written to Iceberg, not {other[0]}")
        fields = [{"source-id": ids[c], "field-id": 1000 + i, "name": c, "transform": "identity"} for i, c in enumerate(table.partition_columns)]
        specs = list(before.get("partition-specs") or ())
        spec = next((s for s in specs if s["fields"] == fields), None)
        if spec is None:
            spec = {"spec-id": max((s["spec-id"] for s in specs), default=-1) + 1, "fields": fields}
            specs.append(spec)
        now, snapshot_id, sequence = int(time.time() * 1000), random.SystemRandom().getrandbits(62) + 1, before.get("last-sequence-number", 0) + 1
        target = Table(table.name, table.format, self.base, full, table.partition_fields)
        manifests, parent = [], before.get("current-snapshot-id")
        if changed is not None and source and (now_at := source._find(before, None)[0]):
            kept = [{n: e.get(n) or 0 for n, _, _ in LIST_FIELDS} for e in avro.load(self.store.read(now_at["manifest-list"]))[1]]
            kept = [e for e in kept if e["added_files_count"] + e["existing_files_count"]]  # those whose files had all gone
            manifests = self._rewritten(kept, changed, snapshot_id, sequence)
        manifests = [*self._manifests(files, schema, target, spec, snapshot_id, sequence), *manifests]
        header = {"snapshot-id": str(snapshot_id), "sequence-number": str(sequence), "format-version": "2"} | ({"parent-snapshot-id": str(parent)} if parent else {})
        listed = self.store.create(f"{DIR}/snap-{snapshot_id}-0-{uuid.uuid4()}.avro", avro.dump(LIST_SCHEMA, manifests, header))
        total, rows = (sum(m[f"added_{k}_count"] + m[f"existing_{k}_count"] for m in manifests) for k in ("files", "rows"))
        stamp = max(now, before.get("last-updated-ms", 0) + 1)
        snapshot = {"snapshot-id": snapshot_id, "sequence-number": sequence, "timestamp-ms": stamp, "manifest-list": listed, "summary": {"operation": operation, "total-data-files": str(total), "total-records": str(rows)}, "schema-id": schema["schema-id"]} | ({"parent-snapshot-id": parent} if parent else {})
        properties = dict(before.get("properties") or {}) | state_properties(base.state_of(table, source_id)) | {MAPPING: json.dumps(schemas.name_mapping(schema))}
        meta = {
            "format-version": 2,
            "table-uuid": before.get("table-uuid") or str(uuid.uuid4()),
            "location": self.base,
            "last-sequence-number": sequence,
            "last-updated-ms": stamp,
            "last-column-id": last,
            "current-schema-id": schema["schema-id"],
            "schemas": old,
            "default-spec-id": spec["spec-id"],
            "partition-specs": specs,
            "last-partition-id": max(999 + len(fields), before.get("last-partition-id", 999)),
            "default-sort-order-id": 0,
            "sort-orders": [{"order-id": 0, "fields": []}],
            "properties": properties,
            "current-snapshot-id": snapshot_id,
            "refs": {"main": {"snapshot-id": snapshot_id, "type": "branch"}},
            "snapshots": [*(before.get("snapshots") or ()), snapshot],
            "snapshot-log": [*(before.get("snapshot-log") or ()), {"timestamp-ms": stamp, "snapshot-id": snapshot_id}],
            "metadata-log": list(before.get("metadata-log") or ()),
        }
        self.store.create(f"{DIR}/v{version}.metadata.json", json.dumps(meta).encode())
        self.store.write(f"{DIR}/version-hint.text", str(version).encode())

    def commit_snapshot(self, snapshot: Snapshot) -> None:
        self._retried(lambda: self._commit(snapshot.table, snapshot.source_id, snapshot.files, "overwrite"))

    def commit_changes(self, changes: list[Change]) -> None:
        """Each costs what it changes: manifests that list none of its files stay as they are."""
        for c in changes:

            def commit(c: Change = c) -> None:
                added = one_per_path(c.files.where("op = 'ADD'").select(*FILE_COLUMNS))
                source = self._source()
                meta = source.metadata() if source else {}
                if meta and (meta["format-version"] != MAXIMUM or any("manifest-list" not in s for s in meta.get("snapshots") or ())):
                    self._commit(c.table, c.version, apply_diff(source.snapshot().files, c.files), "overwrite")
                    return
                self._commit(c.table, c.version, added, "append" if c.files.where("op = 'REMOVE'").isEmpty() else "overwrite", c.files)

            self._retried(commit)
