"""Column bounds as binary single values, and as the canonical text of FILES.stats."""

from __future__ import annotations

import math
import struct
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal, InvalidOperation

from pyspark.sql import types as T

EPOCH = date(1970, 1, 1)


def _micros(text: str) -> int:
    t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def encode(kind: T.DataType, text: str | None, lower: bool) -> bytes | None:
    """None where there is no bound: null, NaN, nested types, or a text that isn't of the type. Zeros widen the range: -0.0 below, 0.0 above."""
    if text is None:
        return None
    try:
        if isinstance(kind, T.BooleanType):
            return {"true": b"\x01", "false": b"\x00"}.get(text.lower())
        if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType):
            return struct.pack("<i", int(text))
        if isinstance(kind, T.LongType):
            return struct.pack("<q", int(text))
        if isinstance(kind, T.FloatType | T.DoubleType):
            x = float(text)
            if math.isnan(x):
                return None
            x = (-0.0 if lower else 0.0) if x == 0 else x
            return struct.pack("<f" if isinstance(kind, T.FloatType) else "<d", x)
        if isinstance(kind, T.StringType):
            return text.encode()
        if isinstance(kind, T.BinaryType):
            return bytes.fromhex(text)
        if isinstance(kind, T.DateType):
            return struct.pack("<i", (date.fromisoformat(text[:10]) - EPOCH).days)
        if isinstance(kind, T.TimestampType | T.TimestampNTZType):
            return struct.pack("<q", _micros(text))
        if isinstance(kind, T.DecimalType):
            n = int(Decimal(text).scaleb(kind.scale).to_integral_exact())
            return n.to_bytes(max(1, (n.bit_length() + 8) // 8), "big", signed=True)
    except (ValueError, OverflowError, InvalidOperation, struct.error):
        return None
    return None


def decode(kind: T.DataType, data: bytes | None) -> str | None:
    """Canonical text; None where the bytes can't be a value of the type."""
    if data is None:
        return None
    sizes = {T.BooleanType: 1, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8}
    if type(kind) in sizes and len(data) != sizes[type(kind)]:
        if isinstance(kind, T.LongType | T.DoubleType) and len(data) == 4:  # written before the column was widened
            return decode(T.IntegerType() if isinstance(kind, T.LongType) else T.FloatType(), data)
        return None
    if isinstance(kind, T.BooleanType):
        return "true" if data != b"\x00" else "false"
    if isinstance(kind, T.IntegerType):
        return str(struct.unpack("<i", data)[0])
    if isinstance(kind, T.LongType):
        return str(struct.unpack("<q", data)[0])
    if isinstance(kind, T.FloatType | T.DoubleType):
        return repr(struct.unpack("<f" if isinstance(kind, T.FloatType) else "<d", data)[0])
    if isinstance(kind, T.StringType):
        return data.decode("utf-8", "replace")
    if isinstance(kind, T.BinaryType):
        return data.hex()
    if isinstance(kind, T.DateType):
        return (EPOCH + timedelta(days=struct.unpack("<i", data)[0])).isoformat()
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        t = datetime(1970, 1, 1) + timedelta(microseconds=struct.unpack("<q", data)[0])
        return t.isoformat() + ("Z" if isinstance(kind, T.TimestampType) else "")
    if isinstance(kind, T.DecimalType):
        return str(Decimal(int.from_bytes(data, "big", signed=True)).scaleb(-kind.scale))
    return None


def canonical(value: object) -> str | None:
    """A Python value of a footer as canonical text; NaN has none."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, bytes):
        return value.hex()
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat() + ("Z" if value.tzinfo else "")
    return value.isoformat() if isinstance(value, date) else str(value)
