"""What every format offers."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.model import FILES, Change, Snapshot, SyncState, Table, TableError
from tidewater.sources.storage import Exists, Storage

#: How often a commit that another writer beat is tried again.
TRIES = 5


class Source(ABC):
    format = ""

    def __init__(self, spark: SparkSession, path: str, name: str = "", lenient: bool = False):
        self.spark, self.base, self.lenient = spark, path.rstrip("/"), lenient
        self.name = name or self.base.rpartition("/")[2]
        self.store = Storage(spark, self.base)

    @abstractmethod
    def history(self) -> list[tuple[str, int]]:
        """Versions with their instants (ms), oldest first; instants grow strictly."""

    @abstractmethod
    def table(self, version: str | None = None) -> Table: ...

    @abstractmethod
    def snapshot(self, version: str | None = None) -> Snapshot: ...

    @abstractmethod
    def changes_since(self, instant: int) -> list[Change]:
        """Commits after the instant, oldest first."""

    def change(self, version: str) -> Change:
        found = [c for c in self.changes_since(-1) if c.version == version]
        if not found:
            raise TableError(f"{self.base} has no change {version}")
        return found[0]

    def safe_from(self, instant: int) -> bool:
        """Whether all commits after the instant are still known."""
        found = self.history()
        return bool(found) and 0 < found[0][1] <= instant

    def close(self) -> None:
        """Lets go of what the source keeps for its DataFrames."""

    def _no_files(self) -> DataFrame:
        return self.spark.createDataFrame([], FILES)


class Target(ABC):
    format = ""

    def __init__(self, spark: SparkSession, path: str, name: str = "", allow_deletion_vectors: bool = False):
        self.spark, self.base, self.allow = spark, path.rstrip("/"), allow_deletion_vectors
        self.name = name or self.base.rpartition("/")[2]
        self.store = Storage(spark, self.base)

    @abstractmethod
    def sync_state(self) -> SyncState | None: ...

    @abstractmethod
    def commit_snapshot(self, snapshot: Snapshot) -> None: ...

    @abstractmethod
    def commit_changes(self, changes: list[Change]) -> None: ...

    def _check(self, files: DataFrame) -> None:
        """Without their deletion vectors, deleted rows would come back."""
        if not self.allow and not files.where("dv IS NOT NULL").isEmpty():
            raise TableError(f"{self.format} can't carry deletion vectors; rows that they delete would come back")

    def _retried(self, commit: Callable[[], None]) -> None:
        for left in reversed(range(TRIES)):
            try:
                return commit()
            except Exists:
                if not left:
                    raise


def state_of(table: Table, source_id: str) -> SyncState:
    return SyncState(table.instant, table.format, source_id)
