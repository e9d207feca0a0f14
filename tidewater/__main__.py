"""python -m tidewater sync | inspect | serve | version"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tidewater import __version__
from tidewater.scan import inspect
from tidewater.service import Service
from tidewater.streaming.changes import Daemon
from tidewater.sync import Controller, Dataset, as_json, load_config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewater")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("sync")
    s.add_argument("--config")
    s.add_argument("--base-path")
    s.add_argument("--source-format")
    s.add_argument("--target-formats")
    s.add_argument("--table-name", default="")
    s.add_argument("--mode", default="INCREMENTAL")
    s.add_argument("--dry-run", action="store_true")
    i = sub.add_parser("inspect")
    i.add_argument("--base-path", required=True)
    i.add_argument("--format", required=True)
    v = sub.add_parser("serve")
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--port", type=int, default=8080)
    v.add_argument("--config")
    v.add_argument("--interval", type=float, default=30.0)
    sub.add_parser("version")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "version":
        print(__version__)
        return 0
    spark = spark or SparkSession.builder.appName("tidewater").getOrCreate()
    if a.command == "inspect":
        print(json.dumps(inspect(spark, a.base_path, a.format), indent=2))
        return 0
    read = lambda path: load_config(open(path).read())  # noqa: E731, SIM115
    if a.command == "serve":
        if a.config:
            import threading

            threading.Thread(target=Daemon(spark, read(a.config), a.interval).run, daemon=True).start()
        Service(spark, a.host, a.port).run()
        return 0
    datasets = read(a.config) if a.config else [Dataset(a.base_path or "", a.source_format or "", tuple((a.target_formats or "").split(",")) if a.target_formats else (), a.table_name, mode=a.mode)]
    failed, out = False, []
    for d in datasets:
        try:
            results = Controller(spark).sync(d, a.dry_run)
            out.append(as_json(d, results))
            failed |= any(r.verdict == "FAILED" for r in results.values())
        except Exception as e:
            out.append(as_json(d, {}, f"{type(e).__name__}: {e}"))
            failed = True
    print(json.dumps({"tables": out}, indent=2))
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
