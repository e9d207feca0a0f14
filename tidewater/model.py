"""Canonical model: tables, live files and changes of any format.

Files are rows of a DataFrame with the schema FILES; what describes a table is small and
lives on the driver.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FORMATS = ("DELTA", "ICEBERG", "HUDI", "PAIMON", "PARQUET")

STAT = T.StructType([T.StructField("min", T.StringType()), T.StructField("max", T.StringType()), T.StructField("nulls", T.LongType()), T.StructField("nans", T.LongType()), T.StructField("total", T.LongType())])
DV = T.StructType([T.StructField("storage_type", T.StringType()), T.StructField("path_or_inline", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("size", T.LongType()), T.StructField("cardinality", T.LongType())])
FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("file_format", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("partition_values", T.MapType(T.StringType(), T.StringType())),
        T.StructField("last_modified", T.LongType()),
        T.StructField("dv", DV),
        T.StructField("stats", T.MapType(T.StringType(), STAT)),
    ]
)
FILE_COLUMNS = tuple(f.name for f in FILES)


class TableError(ValueError):
    """A table that can't be read or written as asked."""


def parse_format(name: str) -> str:
    found = name.strip().upper()
    if found not in FORMATS:
        raise TableError(f"unknown table format {name!r}; known: {', '.join(FORMATS)}")
    return found


@dataclass(frozen=True)
class PartitionField:
    """source: column; transform: only `identity` is written."""

    source: str
    transform: str = "identity"
    name: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    format: str
    base_path: str
    schema: T.StructType
    partition_fields: tuple[PartitionField, ...] = ()
    instant: int = 0
    properties: dict[str, str] = field(default_factory=dict)

    @property
    def partition_columns(self) -> list[str]:
        return [p.source for p in self.partition_fields]


@dataclass(frozen=True)
class Snapshot:
    table: Table
    files: DataFrame
    source_id: str


@dataclass(frozen=True)
class Change:
    """One commit: files are rows of FILES with a column op (ADD or REMOVE); instants grow strictly."""

    version: str
    instant: int
    table: Table
    files: DataFrame
    operation: str = ""


def field_by_path(schema: T.StructType, path: str) -> T.StructField | None:
    """The field of a dotted path: exact names first, then without regard to case; descends structs only."""
    now: T.DataType = schema
    found = None
    for name in path.split("."):
        if not isinstance(now, T.StructType):
            return None
        found = next((f for f in now if f.name == name), None) or next((f for f in now if f.name.lower() == name.lower()), None)
        if found is None:
            return None
        now = found.dataType
    return found


def all_fields(schema: T.StructType) -> list[tuple[str, T.StructField]]:
    """All fields with their paths, level by level, structs only."""
    out, level = [], [(f.name, f) for f in schema]
    while level:
        out += level
        level = [(f"{p}.{c.name}", c) for p, f in level if isinstance(f.dataType, T.StructType) for c in f.dataType]
    return out


#: Fixed value: where a field keeps its name in data files.
PHYSICAL = "delta.columnMapping.physicalName"


def physical(kind: T.DataType) -> T.DataType:
    """The type with the names that data files have, all nullable."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField((f.metadata or {}).get(PHYSICAL, f.name), physical(f.dataType), True) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(physical(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(physical(kind.keyType), physical(kind.valueType), True)
    return kind


def mapped(schema: T.StructType) -> bool:
    """Whether data files have other names."""

    def names(kind: T.DataType) -> list:
        if isinstance(kind, T.StructType):
            return [(f.name, names(f.dataType)) for f in kind]
        return [names(k) for k in vars(kind).values() if isinstance(k, T.DataType)]

    return names(physical(schema)) != names(schema)


# What targets keep of the last sync. The names are read by other tools.
KEY_INSTANT = "xtable_last_instant_synced"
KEY_FORMAT = "xtable_source_format"
KEY_STATE = "XTABLE_METADATA"
STATE_VERSION = 0


@dataclass(frozen=True)
class SyncState:
    instant: int
    source_format: str = ""
    source_id: str = ""
    pending: tuple[int, ...] = ()


def to_iso(millis: int) -> str:
    base = datetime.fromtimestamp(millis // 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    return f"{base}.{millis % 1000:03d}".rstrip("0") + "Z" if millis % 1000 else f"{base}Z"


def from_iso(text: str) -> int:
    m = re.fullmatch(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d+))?(Z|[+-]\d\d:\d\d)", text)
    if not m:
        raise TableError(f"not an instant: {text!r}")
    digits = (m[2] or "").rstrip("0")
    if len(digits) > 3:
        raise TableError(f"{text!r} is finer than a millisecond")
    whole = datetime.fromisoformat(m[1] + m[3].replace("Z", "+00:00"))
    return int(whole.timestamp()) * 1000 + int(digits.ljust(3, "0") or 0)


def state_properties(state: SyncState) -> dict[str, str]:
    """Both forms: flat keys and one JSON value."""
    whole = {"lastInstantSynced": to_iso(state.instant), "instantsToConsiderForNextSync": [to_iso(x) for x in state.pending], "version": STATE_VERSION}
    if state.source_format:
        whole["sourceTableFormat"] = state.source_format
    if state.source_id:
        whole["sourceIdentifier"] = state.source_id
    out = {KEY_INSTANT: str(state.instant), KEY_STATE: json.dumps(whole, separators=(",", ":"))}
    if state.source_format:
        out[KEY_FORMAT] = state.source_format
    return out


def read_state(properties: dict[str, str]) -> SyncState | None:
    """The JSON form wins; malformed or of a newer version, the flat keys do; without either there was no sync."""
    try:
        whole = json.loads(properties.get(KEY_STATE) or "{}")
        if isinstance(whole, dict) and whole.get("lastInstantSynced") and int(whole.get("version", 0)) <= STATE_VERSION:
            return SyncState(from_iso(whole["lastInstantSynced"]), whole.get("sourceTableFormat", ""), whole.get("sourceIdentifier", ""), tuple(map(from_iso, whole.get("instantsToConsiderForNextSync") or ())))
    except (ValueError, TypeError):
        pass
    flat = properties.get(KEY_INSTANT, "")
    return SyncState(int(flat), properties.get(KEY_FORMAT, "")) if re.fullmatch(r"-?\d+", flat) else None
