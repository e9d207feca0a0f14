"""Schemas of each format to and from Spark's StructType.

Field ids travel in field metadata under `field_id`, comments under `comment`. Unknown
types are an error unless `lenient`, which makes them strings.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from typing import Any

from pyspark.sql import types as T

from tidewater.model import TableError

ID = "field_id"


def _unknown(what: object, lenient: bool) -> T.DataType:
    if lenient:
        return T.StringType()
    raise TableError(f"unknown type {what!r}")


def _comment(f: T.StructField) -> str | None:
    return (f.metadata or {}).get("comment")


def _meta(field_id: int | None = None, comment: str | None = None) -> dict[str, Any]:
    return ({ID: field_id} if field_id else {}) | ({"comment": comment} if comment else {})


# --- Delta: Spark's own JSON --------------------------------------------------------------


def to_delta(schema: T.StructType) -> str:
    return schema.json()


def from_delta(text: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(text))


# --- Iceberg ------------------------------------------------------------------------------

_ICEBERG = {T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.BinaryType: "binary", T.DateType: "date", T.TimestampType: "timestamptz", T.TimestampNTZType: "timestamp"}
_FROM_ICEBERG = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "uuid": T.StringType(), "binary": T.BinaryType(), "date": T.DateType(), "timestamptz": T.TimestampType(), "timestamp": T.TimestampNTZType()}


class _Ids:
    """Keeps ids that fields bring along and gives new ones beyond the greatest of them."""

    def __init__(self, schema: T.StructType, last: int):
        self.last = max([last, *self._there(schema)])

    def _there(self, kind: T.DataType) -> Iterable[int]:
        if isinstance(kind, T.StructType):
            for f in kind:
                yield from [v for k, v in (f.metadata or {}).items() if k in (ID, "element_id", "key_id", "value_id")]
                yield from self._there(f.dataType)
        elif isinstance(kind, T.ArrayType):
            yield from self._there(kind.elementType)
        elif isinstance(kind, T.MapType):
            yield from self._there(kind.keyType)
            yield from self._there(kind.valueType)

    def take(self, kept: int | None) -> int:
        if kept:
            return kept
        self.last += 1
        return self.last


def to_iceberg(schema: T.StructType, schema_id: int = 0, last: int = 0, known: dict[str, int] | None = None) -> tuple[dict[str, Any], int]:
    """Schema JSON and the greatest id. known: ids of top-level columns in the table so far."""
    ids = _Ids(schema, max([last, *(known or {}).values()]))

    def convert(kind: T.DataType, meta: dict[str, Any]) -> Any:
        if isinstance(kind, T.StructType):
            return {"type": "struct", "fields": fields(kind, None)}
        if isinstance(kind, T.ArrayType):
            return {"type": "list", "element-id": ids.take(meta.get("element_id")), "element": convert(kind.elementType, {}), "element-required": not kind.containsNull}
        if isinstance(kind, T.MapType):
            return {"type": "map", "key-id": ids.take(meta.get("key_id")), "key": convert(kind.keyType, {}), "value-id": ids.take(meta.get("value_id")), "value": convert(kind.valueType, {}), "value-required": not kind.valueContainsNull}
        if isinstance(kind, T.DecimalType):
            return f"decimal({kind.precision}, {kind.scale})"
        if type(kind) in _ICEBERG:
            return _ICEBERG[type(kind)]
        raise TableError(f"{kind.simpleString()} has no Iceberg type")

    def fields(struct: T.StructType, top: dict[str, int] | None) -> list[dict[str, Any]]:
        named = [(f, ids.take((f.metadata or {}).get(ID) or (top or {}).get(f.name))) for f in struct]
        return [{"id": i, "name": f.name, "required": not f.nullable, "type": convert(f.dataType, f.metadata or {})} | ({"doc": _comment(f)} if _comment(f) else {}) for f, i in named]

    out = {"type": "struct", "schema-id": schema_id, "fields": fields(schema, known or {})}
    return out, ids.last


def from_iceberg(schema: dict[str, Any], lenient: bool = False) -> T.StructType:
    def convert(kind: Any) -> tuple[T.DataType, dict[str, Any]]:
        if isinstance(kind, str):
            if m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", kind):
                return T.DecimalType(int(m[1]), int(m[2])), {}
            if re.fullmatch(r"fixed\[\d+\]", kind):
                return T.BinaryType(), {"fixed": kind}
            return _FROM_ICEBERG.get(kind) or _unknown(kind, lenient), {}
        if kind["type"] == "struct":
            return from_iceberg(kind, lenient), {}
        if kind["type"] == "list":
            return T.ArrayType(convert(kind["element"])[0], not kind["element-required"]), {"element_id": kind["element-id"]}
        if kind["type"] == "map":
            return T.MapType(convert(kind["key"])[0], convert(kind["value"])[0], not kind["value-required"]), {"key_id": kind["key-id"], "value_id": kind["value-id"]}
        return _unknown(kind, lenient), {}

    out = []
    for f in schema["fields"]:
        kind, more = convert(f["type"])
        out.append(T.StructField(f["name"], kind, not f["required"], _meta(f["id"], f.get("doc")) | more))
    return T.StructType(out)


def name_mapping(schema: dict[str, Any]) -> list[dict[str, Any]]:
    """The default name mapping of an Iceberg schema."""

    def below(kind: Any) -> list[dict[str, Any]]:
        if isinstance(kind, str):
            return []
        if kind["type"] == "struct":
            return name_mapping(kind)
        if kind["type"] == "list":
            return [node("element", kind["element-id"], kind["element"])]
        return [node("key", kind["key-id"], kind["key"]), node("value", kind["value-id"], kind["value"])]

    def node(name: str, field_id: int, kind: Any) -> dict[str, Any]:
        inner = below(kind)
        return {"field-id": field_id, "names": [name]} | ({"fields": inner} if inner else {})

    return [node(f["name"], f["id"], f["type"]) for f in schema["fields"]]


# --- Avro, as Hudi keeps it ---------------------------------------------------------------

_AVRO = {T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.BinaryType: "bytes"}
_LOGICAL = {T.DateType: ("int", "date"), T.TimestampType: ("long", "timestamp-micros"), T.TimestampNTZType: ("long", "local-timestamp-micros")}
_FROM_AVRO = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), "enum": T.StringType(), "fixed": T.BinaryType(), "null": T.StringType()}
_FROM_LOGICAL = {"date": T.DateType(), "timestamp-micros": T.TimestampType(), "timestamp-millis": T.TimestampType(), "local-timestamp-micros": T.TimestampNTZType(), "local-timestamp-millis": T.TimestampNTZType(), "uuid": T.StringType()}


def to_avro(schema: T.StructType, name: str, namespace: str | None = None) -> dict[str, Any]:
    def convert(kind: T.DataType, name: str) -> Any:
        if isinstance(kind, T.StructType):
            return to_avro(kind, name)
        if isinstance(kind, T.ArrayType):
            return {"type": "array", "items": maybe(convert(kind.elementType, f"{name}_element"), kind.containsNull)}
        if isinstance(kind, T.MapType):
            if not isinstance(kind.keyType, T.StringType):
                raise TableError(f"Avro maps have string keys only, not {kind.keyType.simpleString()}")
            return {"type": "map", "values": maybe(convert(kind.valueType, f"{name}_value"), kind.valueContainsNull)}
        if isinstance(kind, T.DecimalType):
            return {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
        if type(kind) in _LOGICAL:
            return dict(zip(("type", "logicalType"), _LOGICAL[type(kind)], strict=True))
        if type(kind) in _AVRO:
            return _AVRO[type(kind)]
        raise TableError(f"{kind.simpleString()} has no Avro type")

    maybe = lambda kind, nullable: ["null", kind] if nullable else kind
    fields = [{"name": f.name, "type": maybe(convert(f.dataType, f"{name}_{f.name}"), f.nullable)} | ({"default": None} if f.nullable else {}) | ({"doc": _comment(f)} if _comment(f) else {}) for f in schema]
    return {"type": "record", "name": re.sub(r"\W", "_", name) or "record", "fields": fields} | ({"namespace": namespace} if namespace else {})


def from_avro(schema: Any, lenient: bool = False) -> T.StructType:
    def convert(kind: Any) -> tuple[T.DataType, bool]:
        if isinstance(kind, list):
            others = [k for k in kind if k != "null"]
            return (convert(others[0])[0] if len(others) == 1 else _unknown(kind, lenient)), "null" in kind
        if isinstance(kind, str):
            return _FROM_AVRO.get(kind) or _unknown(kind, lenient), False
        if (logical := kind.get("logicalType")) == "decimal":
            return T.DecimalType(kind["precision"], kind.get("scale", 0)), False
        if logical in _FROM_LOGICAL:
            return _FROM_LOGICAL[logical], False
        if kind["type"] == "record":
            return from_avro(kind, lenient), False
        if kind["type"] == "array":
            return T.ArrayType(*convert(kind["items"])), False
        if kind["type"] == "map":
            return T.MapType(T.StringType(), *convert(kind["values"])), False
        return convert(kind["type"])

    out = []
    for f in schema["fields"]:
        kind, nullable = convert(f["type"])
        out.append(T.StructField(f["name"], kind, nullable, _meta(comment=f.get("doc"))))
    return T.StructType(out)


# --- Paimon -------------------------------------------------------------------------------

_PAIMON = {T.BooleanType: "BOOLEAN", T.ByteType: "INT", T.ShortType: "INT", T.IntegerType: "INT", T.LongType: "BIGINT", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.StringType: "STRING", T.BinaryType: "BYTES", T.DateType: "DATE", T.TimestampType: "TIMESTAMP(6) WITH LOCAL TIME ZONE", T.TimestampNTZType: "TIMESTAMP(6)"}
_FROM_PAIMON = {"BOOLEAN": T.BooleanType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "VARCHAR": T.StringType(), "CHAR": T.StringType(), "BYTES": T.BinaryType(), "BINARY": T.BinaryType(), "VARBINARY": T.BinaryType(), "DATE": T.DateType()}


def paimon_type(kind: T.DataType, nullable: bool = True) -> str:
    if isinstance(kind, T.StructType):
        text = f"ROW<{', '.join(f'`{f.name}` {paimon_type(f.dataType, f.nullable)}' for f in kind)}>"
    elif isinstance(kind, T.ArrayType):
        text = f"ARRAY<{paimon_type(kind.elementType, kind.containsNull)}>"
    elif isinstance(kind, T.MapType):
        text = f"MAP<{paimon_type(kind.keyType, False)}, {paimon_type(kind.valueType, kind.valueContainsNull)}>"
    elif isinstance(kind, T.DecimalType):
        text = f"DECIMAL({kind.precision}, {kind.scale})"
    elif type(kind) in _PAIMON:
        text = _PAIMON[type(kind)]
    else:
        raise TableError(f"{kind.simpleString()} has no Paimon type")
    return text if nullable else f"{text} NOT NULL"


def _parts(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()] if text.strip() else out


def from_paimon_type(text: str, lenient: bool = False) -> tuple[T.DataType, bool]:
    """Type and nullability."""
    text = text.strip()
    nullable = not text.upper().endswith("NOT NULL")
    if not nullable:
        text = text[: -len("NOT NULL")].strip()
    upper = text.upper()
    if m := re.fullmatch(r"(ARRAY|MAP|ROW)\s*<(.*)>", text, re.I | re.S):
        parts = _parts(m[2])
        if m[1].upper() == "ARRAY":
            return T.ArrayType(*from_paimon_type(parts[0], lenient)), nullable
        if m[1].upper() == "MAP":
            return T.MapType(from_paimon_type(parts[0], lenient)[0], *from_paimon_type(parts[1], lenient)), nullable
        fields = [re.match(r"(?:`([^`]+)`|(\S+))\s+(.*)", p, re.S) for p in parts]
        return T.StructType([T.StructField(f[1] or f[2], *from_paimon_type(f[3], lenient)) for f in fields if f]), nullable
    if m := re.fullmatch(r"(?:DECIMAL|NUMERIC)\s*(?:\((\d+)\s*(?:,\s*(\d+))?\))?", upper):
        return T.DecimalType(int(m[1] or 10), int(m[2] or 0)), nullable
    if upper.startswith("TIMESTAMP"):
        return (T.TimestampType() if "LOCAL TIME ZONE" in upper or upper.startswith("TIMESTAMP_LTZ") else T.TimestampNTZType()), nullable
    return _FROM_PAIMON.get(re.sub(r"\s*\(.*", "", upper)) or _unknown(text, lenient), nullable


def to_paimon(schema: T.StructType, partition_keys: list[str], schema_id: int = 0) -> dict[str, Any]:
    ids = _Ids(schema, 0)
    fields = [{"id": ids.take((f.metadata or {}).get(ID)), "name": f.name, "type": paimon_type(f.dataType, f.nullable)} | ({"description": _comment(f)} if _comment(f) else {}) for f in schema]
    return {"id": schema_id, "fields": fields, "highestFieldId": ids.last, "partitionKeys": partition_keys, "primaryKeys": [], "options": {}}


def from_paimon(schema: dict[str, Any], lenient: bool = False) -> T.StructType:
    return T.StructType([T.StructField(f["name"], *from_paimon_type(f["type"], lenient), _meta(f.get("id"), f.get("description"))) for f in schema["fields"]])


# --- catalogs -----------------------------------------------------------------------------


def hive_columns(schema: T.StructType, partition_columns: list[str]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Columns with Hive types: data columns, then partition columns."""
    of = lambda f: (f.name, f.dataType.simpleString().replace("timestamp_ntz", "timestamp"))
    return [of(f) for f in schema if f.name not in partition_columns], [of(f) for n in partition_columns for f in schema if f.name == n]


# --- merging and inference ----------------------------------------------------------------


def merge(parts: list[tuple[str, T.StructType]], parent: str = "") -> T.StructType:
    """Union of the files' columns. parts: name and schema, the file whose order counts first. Types must be equal, structs are merged; a column that a file lacks is nullable."""
    order: dict[str, list[tuple[str, T.StructField]]] = {}
    for name, schema in parts:
        for f in schema:
            order.setdefault(f.name, []).append((name, f))
    out = []
    for column, found in order.items():
        path = f"{parent}.{column}" if parent else column
        first_name, first = found[0]
        kind = first.dataType
        if all(isinstance(f.dataType, T.StructType) for _, f in found):
            kind = merge([(n, f.dataType) for n, f in found], path)
        else:
            for name, f in found[1:]:
                if f.dataType != kind:
                    raise TableError(f"column {path} is {kind.simpleString()} in {first_name} but {f.dataType.simpleString()} in {name}")
        out.append(T.StructField(column, kind, len(found) < len(parts) or any(f.nullable for _, f in found), first.metadata))
    return T.StructType(out)


def partition_type(values: Iterable[str | None]) -> T.DataType:
    """Of directory values: all whole numbers long, all numbers double, all ISO dates date, else (or with a null or empty value) string."""
    seen = list(values)
    if not seen or any(not v for v in seen):
        return T.StringType()
    if all(re.fullmatch(r"[+-]?\d{1,18}", v) for v in seen):
        return T.LongType()
    if all(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v) for v in seen):
        return T.DoubleType()
    if all(re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])", v) for v in seen):
        return T.DateType()
    return T.StringType()
