"""Table formats: each module reads (source) and writes (target) one of them."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import SparkSession

from tidewater.model import TableError, parse_format
from tidewater.sources.base import Source, Target


def open_source(spark: SparkSession, format: str, path: str, **options) -> Source:
    return _module(format).Source(spark, path, **options)


def open_target(spark: SparkSession, format: str, path: str, name: str = "", **options) -> Target:
    return _module(format).Target(spark, path, name, **options)


def _module(format: str):
    return import_module(f"tidewater.sources.{parse_format(format).lower()}")


def detect_format(spark: SparkSession, path: str) -> str:
    """By the metadata that lie there; Parquet if none does. Several are an error."""
    from tidewater.sources.storage import Storage

    store = Storage(spark, path)
    found = [f for f, where in (("DELTA", "_delta_log"), ("ICEBERG", "metadata"), ("HUDI", ".hoodie"), ("PAIMON", "snapshot")) if store.exists(where)]
    if len(found) > 1:
        raise TableError(f"{path} holds several formats: {', '.join(found)}")
    return found[0] if found else "PARQUET"
