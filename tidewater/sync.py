"""Keeping targets in step with a source: full or incremental, with results for each target."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import SparkSession

from tidewater.model import Change, Snapshot, Table, TableError, mapped, parse_format
from tidewater.sources import open_source, open_target
from tidewater.sources.base import Source, Target

MODES = ("INCREMENTAL", "FULL")


@dataclass(frozen=True)
class Dataset:
    """One table to sync. data_path: where data files lie, if not below the base path. source_catalog: a catalog, or its configuration, that tells the path and format of table_name. catalogs: those that targets are registered in."""

    base_path: str
    source_format: str
    target_formats: tuple[str, ...]
    table_name: str = ""
    data_path: str = ""
    mode: str = "INCREMENTAL"
    catalogs: tuple[Any, ...] = ()
    source_catalog: Any = None

    @property
    def name(self) -> str:
        return self.table_name or self.base_path.rstrip("/").rpartition("/")[2]

    def checked(self) -> Dataset:
        if not self.base_path:
            raise TableError("a dataset needs a base path")
        if not self.target_formats:
            raise TableError(f"{self.name} has no target formats")
        mode = self.mode.strip().upper()
        if mode not in MODES:
            raise TableError(f"unknown sync mode {self.mode!r}; known: {', '.join(MODES)}")
        return replace(self, source_format=parse_format(self.source_format), target_formats=tuple(map(parse_format, self.target_formats)), mode=mode)


def load_config(text: str) -> list[Dataset]:
    """Datasets from JSON, or YAML where a parser is installed: {"datasets": [...]} or one dataset."""
    try:
        whole = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise TableError("the configuration isn't JSON, and no YAML parser is installed") from e
        whole = yaml.safe_load(text)
    found = whole.get("datasets", [whole]) if isinstance(whole, dict) else whole
    out = []
    for d in found:
        name = lambda *keys: next((d[k] for k in keys if d.get(k)), "")  # noqa: B023, E731
        formats = name("target_formats", "targetFormats")
        out.append(Dataset(name("base_path", "basePath", "tableBasePath"), name("source_format", "sourceFormat"), tuple(formats.split(",") if isinstance(formats, str) else formats), name("table_name", "tableName"), name("data_path", "tableDataPath"), name("mode", "syncMode") or "INCREMENTAL", tuple(d.get("catalogs") or d.get("targetCatalogs") or ()), name("source_catalog", "sourceCatalog") or None))
    return out


@dataclass
class Result:
    target: str
    status: str = "SUCCESS"
    mode: str = "FULL"
    no_op: bool = False
    fallback: str = ""
    error: str = ""
    instant: int = 0
    commits: int = 0
    seconds: float = 0.0
    catalog_errors: list[str] = field(default_factory=list)

    @property
    def verdict(self) -> str:
        return "FAILED" if self.status == "ERROR" else "NO_OP" if self.no_op else "SUCCESS"


def _named(table: Table) -> None:
    if mapped(table.schema):
        raise TableError(f"columns of {table.name} have other names in its files; scans read them, but other formats can't be told")


class _Once:
    """The source's snapshot and changes, each read once for all targets, and only if one needs it."""

    def __init__(self, source: Source):
        self.source, self.error = source, None
        self._snapshot: Snapshot | None = None
        self._changes: dict[int, list[Change]] = {}
        self._lock = threading.Lock()  # targets ask at the same time

    def _read(self, read: Callable[[], Any]) -> Any:
        try:
            return read()
        except Exception as e:
            self.error = self.error or e
            raise

    def snapshot(self) -> Snapshot:
        with self._lock:
            if self._snapshot is None:
                found = self._read(self.source.snapshot)
                self._snapshot = replace(found, files=found.files.persist())
            return self._snapshot

    def changes(self, instant: int) -> list[Change]:
        with self._lock:
            if instant not in self._changes:
                self._changes[instant] = self._read(lambda: self.source.changes_since(instant))
            return self._changes[instant]

    def safe_from(self, instant: int) -> bool:
        with self._lock:
            return self._read(lambda: self.source.safe_from(instant))

    def close(self) -> None:
        if self._snapshot is not None:
            self._snapshot.files.unpersist()
        self.source.close()


class Controller:
    def __init__(self, spark: SparkSession, catalogs: Callable[[Any], Any] | None = None):
        self.spark, self.catalogs = spark, catalogs

    def _catalog(self, config: Any) -> Any:
        if self.catalogs:
            return self.catalogs(config)
        from tidewater.catalog import client

        return client(self.spark, config)

    def sync(self, dataset: Dataset, dry_run: bool = False) -> dict[str, Result]:
        """A failing target doesn't stop the others; a source that can't be read raises."""
        if dataset.source_catalog is not None:
            found, path = self._catalog(dataset.source_catalog).resolve(dataset.table_name)
            dataset = replace(dataset, source_format=dataset.source_format or found, base_path=dataset.base_path or path)
        dataset = dataset.checked()
        source = open_source(self.spark, dataset.source_format, dataset.data_path or dataset.base_path, name=dataset.name)
        once = _Once(source)
        targets = [f for f in dict.fromkeys(dataset.target_formats) if f != dataset.source_format]
        try:
            with ThreadPoolExecutor(max(1, len(targets))) as pool:
                results = dict(zip(targets, pool.map(lambda f: self._target(dataset, once, f, dry_run), targets), strict=True))
            if once.error:
                raise once.error
            return results
        finally:
            once.close()

    def _target(self, dataset: Dataset, once: _Once, format: str, dry_run: bool) -> Result:
        result, began = Result(format), time.time()
        try:
            target = open_target(self.spark, format, dataset.base_path, dataset.name)
            self._bring(dataset, once, target, result, dry_run)
            if not dry_run:
                self._register(dataset, format, result)
        except Exception as e:
            result.status, result.error = "ERROR", f"{type(e).__name__}: {e}"
        result.seconds = time.time() - began
        return result

    def _bring(self, dataset: Dataset, once: _Once, target: Target, result: Result, dry_run: bool) -> None:
        state = target.sync_state()
        if dataset.mode == "INCREMENTAL":
            if state is None or state.instant <= 0:
                result.fallback = "there was no sync before"
            elif not once.safe_from(state.instant):
                result.fallback = f"the source's history doesn't reach back to {state.instant}"
            else:
                result.mode = "INCREMENTAL"
        if result.mode == "INCREMENTAL":
            found = once.changes(state.instant)
            result.no_op, result.commits, result.instant = not found, len(found), found[-1].instant if found else state.instant
            for c in found:
                _named(c.table)
            if found and not dry_run:
                target.commit_changes(found)
            return
        snapshot = once.snapshot()
        _named(snapshot.table)
        result.commits, result.instant = 1, snapshot.table.instant
        if not dry_run:
            target.commit_snapshot(snapshot)

    def _register(self, dataset: Dataset, format: str, result: Result) -> None:
        """Errors of catalogs are told, but the table was synced."""
        for config in dataset.catalogs:
            try:
                snapshot = open_source(self.spark, format, dataset.base_path, name=dataset.name).snapshot()
                self._catalog(config).register(snapshot)
            except Exception as e:
                result.catalog_errors.append(f"{type(e).__name__}: {e}")


def as_json(dataset: Dataset, results: dict[str, Result], error: str = "") -> dict[str, Any]:
    """What a sync did, as the command line and the service tell it."""
    return {"table": dataset.name, "basePath": dataset.base_path, "sourceFormat": dataset.source_format, "error": error, "targets": [asdict(r) | {"verdict": r.verdict} for r in results.values()]}
