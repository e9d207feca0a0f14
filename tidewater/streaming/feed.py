"""A stream source that hands out a table's changes, version by version.

    spark.dataSource.register(ChangeFeed)
    spark.readStream.format("tidewater_changes").option("path", "/lake/orders").load()

The offset is a version of the Delta log, so that a query goes on after the last version that it
committed. Each commit is a partition of a batch, read by a task line by line. A start before the
oldest commit that is still there is an error, as changes would be missing. Commits without a time
take the one before; times take watermarks and windows like any column.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any
from urllib.parse import unquote

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewater.functions import stores
from tidewater.model import TableError

NAME = "tidewater_changes"


class Commit(InputPartition):
    def __init__(self, version: int):
        super().__init__(version)
        self.version = version


class ChangeFeed(DataSource):
    """Options: path; startingVersion, the first version wanted (0); settings, as `stores.settings` gives them, in JSON."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "version bigint, time timestamp, operation string, op string, path string, partition_values map<string,string>, size_bytes bigint, record_count bigint"

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return Reader(self.options)


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise TableError("a stream of changes needs a path")
        self.base, self.start = options["path"].rstrip("/"), int(options.get("startingVersion", "0"))
        self.settings = json.loads(options.get("settings", "{}"))

    def _log(self) -> tuple[pafs.FileSystem, str]:
        return stores.open_store(f"{self.base}/_delta_log", self.settings)

    def _known(self) -> list[int]:
        system, folder = self._log()
        found = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return sorted(int(m[1]) for f in found if (m := re.fullmatch(r"(\d+)\.json", f.base_name)))

    def initialOffset(self) -> dict:
        return {"version": self.start}

    def latestOffset(self) -> dict:
        """One beyond the last commit before a gap: what another writer is still renaming comes with a later batch."""
        known = [v for v in self._known() if v >= self.start]
        end = self.start
        while known and known[0] == end:
            known.pop(0)
            end += 1
        return {"version": end}

    def partitions(self, start: dict, end: dict) -> list[Commit]:
        known = set(self._known())
        wanted = range(start["version"], end["version"])
        if missing := [v for v in wanted if v not in known]:
            raise TableError(f"the log of {self.base} has lost version {missing[0]}, which the stream hasn't read")
        return [Commit(v) for v in wanted]

    def _lines(self, version: int) -> Iterator[dict]:
        system, folder = self._log()
        with system.open_input_stream(f"{folder}/{version:020d}.json") as raw:
            for line in io.TextIOWrapper(io.BufferedReader(raw), "utf-8"):
                if line.strip():
                    yield json.loads(line)

    def _time(self, version: int) -> tuple[datetime, str]:
        operation = ""
        for v in range(version, -1, -1):
            try:
                told = next((x["commitInfo"] for x in self._lines(v) if "commitInfo" in x), {})
            except FileNotFoundError:
                break
            operation = (told.get("operation") or "") if v == version else operation
            if told.get("timestamp"):
                return datetime.fromtimestamp(told["timestamp"] / 1000, timezone.utc), operation
        return datetime.fromtimestamp(0, timezone.utc), operation

    def read(self, partition: Commit) -> Iterator[tuple]:
        time, operation = self._time(partition.version)
        absolute = re.compile(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:/)").match
        for line in self._lines(partition.version):
            for op in ("add", "remove"):
                if file := line.get(op):
                    path = unquote(file["path"])
                    stats = json.loads(file.get("stats") or "{}")
                    values = {k: v for k, v in (file.get("partitionValues") or {}).items()}
                    yield (partition.version, time, operation, op.upper(), path if absolute(path) else f"{self.base}/{path}", values, file.get("size"), stats.get("numRecords"))

    def commit(self, end: dict) -> None:
        """Nothing is kept for what has been read."""


def changes(spark: SparkSession, path: str, start: int = 0):
    """The stream, with the session's settings for object stores."""
    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format(NAME).option("path", path).option("startingVersion", str(start)).option("settings", json.dumps(stores.settings(spark))).load()
