"""A table's commits as a stream, and the daemon that syncs datasets again and again.

A stream of commit files triggers the sync; what is synced is decided by the target's own
properties, whatever the checkpoint says: a batch that was committed before a crash finds
nothing left to do when it comes again.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.model import FILES, TableError, parse_format
from tidewater.scan import rows_of
from tidewater.sources import open_source, open_target
from tidewater.sync import Controller, Dataset, Result

#: Where each format's commits appear, and their names.
COMMITS = {"DELTA": ("_delta_log", "*.json"), "ICEBERG": ("metadata", "*.metadata.json"), "HUDI": (".hoodie", "*commit"), "PAIMON": ("snapshot", "snapshot-*")}


def commits(spark: SparkSession, path: str, format: str) -> DataFrame:
    """A stream with a row for each commit file, once each: name and content. Spark's file stream keeps its offsets."""
    format = parse_format(format)
    if format not in COMMITS:
        raise TableError(f"{format} has no commits to follow")
    folder, names = COMMITS[format]
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", names).load(f"{path.rstrip('/')}/{folder}")
    return files.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("time"), "value")


def added_rows(spark: SparkSession, path: str, format: str, sink: Callable[[DataFrame, str], None], since: int = -1) -> int:
    """Gives the rows of each commit's added files after an instant to the sink, in order; returns the last instant."""
    for c in open_source(spark, format, path).changes_since(since):
        files = c.files.where("op = 'ADD'").select(*FILES.fieldNames())
        sink(rows_of(spark, c.table.schema, c.table.partition_columns, files), c.version)
        since = c.instant
    return since


def follow(spark: SparkSession, source_format: str, target_format: str, path: str, checkpoint: str, name: str = "", once: bool = True):
    """Starts a stream that brings each commit of the source to the target; with once it ends when it has caught up."""
    def bring(batch: DataFrame, number: int) -> None:
        target = open_target(spark, target_format, path, name)
        state = target.sync_state()
        source = open_source(spark, source_format, path, name=name)
        if state is None or not source.safe_from(state.instant):
            target.commit_snapshot(source.snapshot())
            return
        if found := source.changes_since(state.instant):
            target.commit_changes(found)

    writer = commits(spark, path, source_format).writeStream.foreachBatch(bring).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


class Daemon:
    """Syncs all datasets at once and then every so many seconds, until stopped. A dataset that fails doesn't stop the others."""

    def __init__(self, spark: SparkSession, datasets: Sequence[Dataset], interval: float = 30.0, tell: Callable[[Dataset, dict[str, Result], str], None] | None = None):
        self.controller, self.datasets, self.interval, self.tell = Controller(spark), list(datasets), interval, tell
        self._stop = threading.Event()

    def pass_once(self) -> None:
        for d in self.datasets:
            results, error = {}, ""
            try:
                results = self.controller.sync(d)
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
            if self.tell:
                self.tell(d, results, error)

    def run(self) -> None:
        while not self._stop.is_set():
            self.pass_once()
            self._stop.wait(self.interval)

    def stop(self) -> None:
        self._stop.set()
