"""A small HTTP service: health, conversions (at once or in the background), their state, and inspection."""

from __future__ import annotations

import json
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from tidewater import __version__
from tidewater.model import TableError
from tidewater.scan import inspect
from tidewater.sync import Controller, as_json, load_config


class Service:
    """Background conversions are kept until `keep` newer ones have come."""

    def __init__(self, spark: SparkSession, host: str = "127.0.0.1", port: int = 0, keep: int = 1000):
        self.spark, self.controller, self.keep = spark, Controller(spark), keep
        self._jobs: dict[str, dict[str, Any]] = {}
        self._lock = threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def _answer(self, status: int, body: Any) -> None:
                data = json.dumps(body).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def _body(self) -> dict[str, Any]:
                return json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")

            def do_GET(self) -> None:
                path = urlparse(self.path).path.rstrip("/")
                if path in ("/health", "/v1/health"):
                    return self._answer(200, {"status": "UP", "version": __version__})
                if path.startswith("/v1/conversion/table/"):
                    job = outer.job(path.rpartition("/")[2])
                    return self._answer(200, job) if job else self._answer(404, {"error": "no such conversion"})
                return self._answer(404, {"error": "no such path"})

            def do_POST(self) -> None:
                path = urlparse(self.path).path.rstrip("/")
                try:
                    body = self._body()
                    if path == "/v1/conversion/table":
                        if "respond-async" in (self.headers.get("Prefer") or ""):
                            return self._answer(202, outer.start(body))
                        return self._answer(200, outer.convert(body))
                    if path == "/v1/inspect/table":
                        return self._answer(200, inspect(outer.spark, body["basePath"], body["format"]))
                except (TableError, ValueError, KeyError) as e:
                    return self._answer(400, {"error": f"{type(e).__name__}: {e}"})
                except Exception as e:
                    return self._answer(500, {"error": f"{type(e).__name__}: {e}"})
                return self._answer(404, {"error": "no such path"})

            def log_message(self, *args: Any) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)

    @property
    def port(self) -> int:
        return self.server.server_address[1]

    def convert(self, body: dict[str, Any]) -> dict[str, Any]:
        dataset = load_config(json.dumps(body))[0]
        return as_json(dataset, self.controller.sync(dataset, bool(body.get("dryRun"))))

    def start(self, body: dict[str, Any]) -> dict[str, Any]:
        job = {"id": uuid.uuid4().hex, "status": "RUNNING"}
        load_config(json.dumps(body))[0].checked()
        with self._lock:
            self._jobs[job["id"]] = dict(job)
            while len(self._jobs) > self.keep:
                del self._jobs[next(iter(self._jobs))]

        def run() -> None:
            try:
                done = {"status": "DONE", "result": self.convert(body)}
            except Exception as e:
                done = {"status": "FAILED", "error": f"{type(e).__name__}: {e}"}
            with self._lock:
                if job["id"] in self._jobs:
                    self._jobs[job["id"]] |= done

        threading.Thread(target=run, daemon=True).start()
        return job

    def job(self, number: str) -> dict[str, Any] | None:
        with self._lock:
            return dict(found) if (found := self._jobs.get(number)) else None

    def run(self) -> None:
        self.server.serve_forever()

    def stop(self) -> None:
        self.server.shutdown()
        self.server.server_close()
