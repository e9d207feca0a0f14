"""Avro object container files: a codec for the schemas that table metadata use.

Supports null, boolean, int, long, float, double, bytes, string, fixed, enum, array, map,
record and union, and the codecs null and deflate. Unions of null and one type are plain
values, None for null.
"""

from __future__ import annotations

import io
import json
import os
import struct
import zlib
from collections.abc import Callable
from typing import Any

MAGIC = b"Obj\x01"
BLOCK = 4000


def _write_long(out: bytearray, n: int) -> None:
    n = (n << 1) ^ (n >> 63)
    while n & ~0x7F:
        out.append((n & 0x7F) | 0x80)
        n >>= 7
    out.append(n)


def _read_long(data: io.BytesIO) -> int:
    shift = n = 0
    while True:
        byte = data.read(1)
        if not byte:
            raise EOFError("Avro data are cut off")
        n |= (byte[0] & 0x7F) << shift
        if not byte[0] & 0x80:
            return (n >> 1) ^ -(n & 1)
        shift += 7


def _write_bytes(out: bytearray, value: bytes) -> None:
    _write_long(out, len(value))
    out += value


def _read_bytes(data: io.BytesIO) -> bytes:
    n = _read_long(data)
    value = data.read(n)
    if len(value) != n:
        raise EOFError("Avro data are cut off")
    return value


class Codec:
    """Encoder and decoder for one schema."""

    def __init__(self, schema: Any):
        self.names: dict[str, Any] = {}
        self._writers: dict[str, Any] = {}
        self.schema = schema
        self._learn(schema)

    def _learn(self, schema: Any) -> None:
        if isinstance(schema, list):
            for s in schema:
                self._learn(s)
        elif isinstance(schema, dict):
            if schema["type"] in ("record", "fixed", "enum"):
                self.names[schema["name"]] = schema
            for s in (schema.get("items"), schema.get("values"), *(f["type"] for f in schema.get("fields", ()))):
                if s is not None:
                    self._learn(s)
            if isinstance(schema["type"], dict | list):
                self._learn(schema["type"])

    def _kind(self, schema: Any) -> tuple[str, Any]:
        if isinstance(schema, list):
            return "union", schema
        if isinstance(schema, str):
            return self._kind(self.names[schema]) if schema in self.names else (schema, schema)
        return (schema["type"], schema) if isinstance(schema["type"], str) and schema["type"] not in self.names else self._kind(schema["type"])

    def _fits(self, schema: Any, value: Any) -> bool:
        kind, _ = self._kind(schema)
        return {"null": value is None, "boolean": isinstance(value, bool), "int": isinstance(value, int) and not isinstance(value, bool), "long": isinstance(value, int) and not isinstance(value, bool), "float": isinstance(value, float), "double": isinstance(value, float), "bytes": isinstance(value, bytes), "fixed": isinstance(value, bytes), "string": isinstance(value, str), "enum": isinstance(value, str), "array": isinstance(value, list), "map": isinstance(value, dict), "record": isinstance(value, dict)}[kind]

    def writer(self, schema: Any) -> Callable[[bytearray, Any], None]:
        """Appends values of the schema; made once for each schema, so that records aren't looked up type by type."""
        kind, s = self._kind(schema)
        if kind == "union":
            each = [self.writer(x) for x in s]
            heads = [bytearray() for _ in s]
            for i, head in enumerate(heads):
                _write_long(head, i)
            if len(s) == 2 and "null" in s:  # a value or none
                none = s.index("null")

                def maybe(out: bytearray, value: Any) -> None:
                    if value is None:
                        out += heads[none]
                    else:
                        out += heads[1 - none]
                        each[1 - none](out, value)

                return maybe

            def union(out: bytearray, value: Any) -> None:
                at = next((i for i, x in enumerate(s) if self._fits(x, value)), None)
                if at is None:
                    raise TypeError(f"{value!r} fits none of {s}")
                out += heads[at]
                each[at](out, value)

            return union
        if kind == "null":
            return lambda out, value: None
        if kind == "boolean":
            return lambda out, value: out.append(1 if value else 0)
        if kind in ("int", "long"):
            return _write_long
        if kind in ("float", "double"):
            pack = struct.Struct("<f" if kind == "float" else "<d").pack
            return lambda out, value: out.extend(pack(value))
        if kind == "bytes":
            return _write_bytes
        if kind == "string":
            return lambda out, value: _write_bytes(out, value.encode())
        if kind == "fixed":
            return lambda out, value: out.extend(value)
        if kind == "enum":
            return lambda out, value: _write_long(out, s["symbols"].index(value))
        if kind in ("array", "map"):
            item = self.writer(s["items" if kind == "array" else "values"])

            def items(out: bytearray, value: Any) -> None:
                if value:
                    _write_long(out, len(value))
                    for x in value.items() if kind == "map" else value:
                        if kind == "map":
                            _write_bytes(out, x[0].encode())
                        item(out, x[1] if kind == "map" else x)
                out.append(0)

            return items
        if s["name"] in self._writers:  # a record that holds itself
            return lambda out, value: self._writers[s["name"]](out, value)
        self._writers[s["name"]] = None
        fields = [(f["name"], f.get("default"), self.writer(f["type"])) for f in s["fields"]]

        def record(out: bytearray, value: Any) -> None:
            for name, default, write in fields:
                write(out, value[name] if name in value else default)

        self._writers[s["name"]] = record
        return record

    def read(self, data: io.BytesIO, schema: Any) -> Any:
        kind, s = self._kind(schema)
        if kind == "union":
            return self.read(data, s[_read_long(data)])
        if kind == "null":
            return None
        if kind == "boolean":
            return data.read(1) == b"\x01"
        if kind in ("int", "long"):
            return _read_long(data)
        if kind in ("float", "double"):
            return struct.unpack("<f" if kind == "float" else "<d", data.read(4 if kind == "float" else 8))[0]
        if kind == "bytes":
            return _read_bytes(data)
        if kind == "string":
            return _read_bytes(data).decode()
        if kind == "fixed":
            return data.read(s["size"])
        if kind == "enum":
            return s["symbols"][_read_long(data)]
        if kind in ("array", "map"):
            out: list = []
            while n := _read_long(data):
                if n < 0:  # then the block's bytes follow
                    n = -n
                    _read_long(data)
                for _ in range(n):
                    out.append((_read_bytes(data).decode(), self.read(data, s["values"])) if kind == "map" else self.read(data, s["items"]))
            return dict(out) if kind == "map" else out
        return {f["name"]: self.read(data, f["type"]) for f in s["fields"]}


def dump(schema: Any, records: list[dict], meta: dict[str, str] | None = None) -> bytes:
    """A container file, deflated. The schema is written as it is, with attributes that Avro doesn't know."""
    write, sync, out = Codec(schema).writer(schema), os.urandom(16), bytearray(MAGIC)
    head = {"avro.schema": json.dumps(schema), "avro.codec": "deflate"} | (meta or {})
    shape = {"type": "map", "values": "bytes"}
    Codec(shape).writer(shape)(out, {k: v.encode() for k, v in head.items()})
    out += sync
    for i in range(0, len(records), BLOCK):
        block = bytearray()
        for record in records[i : i + BLOCK]:
            write(block, record)
        pack = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = pack.compress(block) + pack.flush()
        _write_long(out, len(records[i : i + BLOCK]))
        _write_bytes(out, packed)
        out += sync
    return bytes(out)


def load(data: bytes) -> tuple[dict[str, str], list[dict]]:
    """Header and records of a container file."""
    if data[:4] != MAGIC:
        raise ValueError("not an Avro container file")
    stream = io.BytesIO(data)
    stream.seek(4)
    shape = {"type": "map", "values": "bytes"}
    meta = {k: v.decode("utf-8", "replace") for k, v in Codec(shape).read(stream, shape).items()}
    sync, schema = stream.read(16), json.loads(meta["avro.schema"])
    codec, out, packed = Codec(schema), [], meta.get("avro.codec", "null")
    if packed not in ("null", "deflate"):
        raise ValueError(f"unknown Avro codec {packed}")
    while stream.tell() < len(data):
        n, block = _read_long(stream), _read_bytes(stream)
        rows = io.BytesIO(zlib.decompress(block, -15) if packed == "deflate" else block)
        out += [codec.read(rows, schema) for _ in range(n)]
        if stream.read(16) != sync:
            raise ValueError("an Avro block doesn't end with the sync marker")
    return meta, out
