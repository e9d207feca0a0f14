"""AWS Glue as a catalog, by its JSON protocol."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewater.catalog import TARGETS, format_of, targets_of
from tidewater.functions import schemas
from tidewater.functions.signing import Credentials, signed
from tidewater.model import Snapshot, TableError
from tidewater.operators.files import diff_partitions, in_batches, partitions_of
from tidewater.sync import Dataset

#: How many partitions a request takes, and Hive's classes for Parquet.
CREATED, UPDATED, DELETED = 100, 100, 25
PARQUET = {"InputFormat": "org.apache.hadoop.hive.ql.io.parquet.MapredParquetInputFormat", "OutputFormat": "org.apache.hadoop.hive.ql.io.parquet.MapredParquetOutputFormat", "SerdeInfo": {"SerializationLibrary": "org.apache.hadoop.hive.ql.io.parquet.serde.ParquetHiveSerDe"}}
MISSING = "__HIVE_DEFAULT_PARTITION__"


class GlueError(TableError):
    def __init__(self, action: str, kind: str, message: str):
        super().__init__(f"Glue's {action}: {kind}: {message}")
        self.kind = kind


class GlueCatalog:
    """Tables are named `name_format`, so that formats of one table don't overwrite one another."""

    def __init__(self, spark: SparkSession, region: str, database: str = "default", credentials: Credentials | Callable[[], Credentials] = Credentials.of_environment, endpoint: str = "", catalog_id: str = "", timeout: float = 30):
        self.spark, self.region, self.database, self.credentials, self.timeout = spark, region, database, credentials, timeout
        self.endpoint, self.catalog_id = endpoint or f"https://glue.{region}.amazonaws.com/", catalog_id

    def _call(self, action: str, **body: Any) -> dict[str, Any]:
        data = json.dumps(({"CatalogId": self.catalog_id} if self.catalog_id else {}) | body).encode()
        headers = {"Content-Type": "application/x-amz-json-1.1", "X-Amz-Target": f"AWSGlue.{action}"}
        request = urllib.request.Request(self.endpoint, data, signed("POST", self.endpoint, headers, data, self.region, "glue", self.credentials), method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.loads(answer.read() or b"{}")
        except urllib.error.HTTPError as e:
            try:
                told = json.loads(e.read())
            except ValueError:
                told = {}
            raise GlueError(action, str(told.get("__type", e.code)).rpartition("#")[2], told.get("Message") or told.get("message") or "") from e

    def _pages(self, action: str, key: str, **body: Any) -> Iterator[dict[str, Any]]:
        token = None
        while True:
            found = self._call(action, **body, **({"NextToken": token} if token else {}))
            yield from found.get(key) or ()
            token = found.get("NextToken")
            if not token:
                return

    def _table(self, name: str) -> dict[str, Any]:
        return self._call("GetTable", DatabaseName=self.database, Name=name)["Table"]

    @staticmethod
    def name(snapshot: Snapshot) -> str:
        return f"{snapshot.table.name}_{snapshot.table.format}".lower()

    def register(self, snapshot: Snapshot) -> None:
        """Creates the table or brings it up to date; other parameters of one that is there stay."""
        t, name = snapshot.table, self.name(snapshot)
        data, parts = schemas.hive_columns(t.schema, t.partition_columns)
        columns = lambda pairs: [{"Name": n.lower(), "Type": k} for n, k in pairs]
        parameters = {"EXTERNAL": "TRUE", "table_type": t.format, "source_id": snapshot.source_id}
        try:
            parameters = (self._table(name).get("Parameters") or {}) | parameters
            there = True
        except GlueError as e:
            if e.kind != "EntityNotFoundException":
                raise
            there = False
        table = {"Name": name, "TableType": "EXTERNAL_TABLE", "Parameters": parameters, "PartitionKeys": columns(parts), "StorageDescriptor": PARQUET | {"Columns": columns(data), "Location": t.base_path}}
        self._call("UpdateTable" if there else "CreateTable", DatabaseName=self.database, TableInput=table)
        if t.partition_columns:
            self.sync_partitions(name, partitions_of(snapshot.files, t.partition_columns))

    def drop(self, name: str) -> None:
        try:
            self._call("DeleteTable", DatabaseName=self.database, Name=name)
        except GlueError as e:
            if e.kind != "EntityNotFoundException":
                raise

    def resolve(self, name: str) -> tuple[str, str]:
        """Format and location."""
        found = self._table(name)
        return format_of(found.get("Parameters") or {}), found["StorageDescriptor"]["Location"]

    def partitions(self, name: str) -> DataFrame:
        """values and location of each."""
        text = lambda v: None if v == MISSING else v
        rows = [([text(v) for v in p["Values"]], (p.get("StorageDescriptor") or {}).get("Location", "")) for p in self._pages("GetPartitions", "Partitions", DatabaseName=self.database, TableName=name)]
        return self.spark.createDataFrame(rows, "values array<string>, location string")

    def sync_partitions(self, name: str, desired: DataFrame) -> None:
        """Tries all events, in requests of as many as Glue takes; then tells all errors at once."""
        events = diff_partitions(self.partitions(name), desired).persist()
        descriptor, at = self._table(name)["StorageDescriptor"], {"DatabaseName": self.database, "TableName": name}
        values = lambda r: [v if v is not None else MISSING for v in r["values"]]
        whole = lambda r: {"Values": values(r), "StorageDescriptor": descriptor | {"Location": r.location}}

        def told(found: dict[str, Any]) -> None:
            if bad := found.get("Errors"):
                raise TableError("; ".join(f"{e.get('PartitionValues') or e.get('PartitionValueList')}: {(e.get('ErrorDetail') or {}).get('ErrorMessage', '')}" for e in bad))

        acts = {
            "ADD": (CREATED, lambda rows: told(self._call("BatchCreatePartition", **at, PartitionInputList=[whole(r) for r in rows]))),
            "UPDATE": (UPDATED, lambda rows: told(self._call("BatchUpdatePartition", **at, Entries=[{"PartitionValueList": values(r), "PartitionInput": whole(r)} for r in rows]))),
            "DROP": (DELETED, lambda rows: told(self._call("BatchDeletePartition", **at, PartitionsToDelete=[{"Values": values(r)} for r in rows]))),
        }
        errors = [e for event, (size, act) in acts.items() for e in in_batches(events.where(events["event"] == event).toLocalIterator(), size, act)]
        events.unpersist()
        if errors:
            raise TableError("; ".join(map(str, errors)))

    def discover(self, marker: str = TARGETS) -> Iterator[Dataset]:
        """All tables of the database that name their targets."""
        for t in self._pages("GetTables", "TableList", DatabaseName=self.database):
            known = t.get("Parameters") or {}
            if known.get(marker, "").strip():
                yield Dataset(t["StorageDescriptor"]["Location"], format_of(known), targets_of(known, marker), t["Name"])
