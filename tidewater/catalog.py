"""Catalogs: the session's own, and Iceberg REST catalogs over HTTP; `glue` has AWS Glue.

A catalog registers a snapshot under a name for each format, so that formats of one table
don't overwrite one another, and keeps its partitions in step.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewater.functions import schemas
from tidewater.functions.signing import Credentials, signed
from tidewater.model import Snapshot, TableError, parse_format
from tidewater.operators.files import diff_partitions, in_batches, partitions_of
from tidewater.sync import Dataset

#: Tables opt in to discovery by naming their targets here.
TARGETS = "target_formats"
#: Where the session's catalog keeps a table's format; `table_type` is reserved there.
FORMAT = "source_table_format"


MISSING = "__HIVE_DEFAULT_PARTITION__"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def format_of(properties: dict[str, str]) -> str:
    """table_type, else the provider that Spark notes."""
    return parse_format(properties.get("table_type") or properties.get("spark.sql.sources.provider") or "")


def targets_of(properties: dict[str, str], marker: str = TARGETS) -> tuple[str, ...]:
    return tuple(parse_format(x) for x in properties.get(marker, "").split(",") if x.strip())


def data_location(format: str, base: str, properties: dict[str, str]) -> str:
    if format == "ICEBERG":
        return properties.get("write.data.path") or properties.get("write.folder-storage.path") or f"{base.rstrip('/')}/data"
    return base


class SessionCatalog:
    """Registers tables as external Parquet tables of a Spark database."""

    def __init__(self, spark: SparkSession, database: str = "default", batch: int = 1000):
        self.spark, self.database, self.batch = spark, database, batch

    def _name(self, snapshot: Snapshot) -> str:
        return f"`{self.database}`.`{snapshot.table.name}_{snapshot.table.format.lower()}`"

    def register(self, snapshot: Snapshot) -> None:
        t, name = snapshot.table, self._name(snapshot)
        properties = {FORMAT: t.format, "source_id": snapshot.source_id}
        listed = ", ".join(f"{_quoted(k)}={_quoted(v)}" for k, v in properties.items())
        if not self.spark.catalog.tableExists(name.replace("`", "")):
            data, parts = schemas.hive_columns(t.schema, t.partition_columns)
            columns = ", ".join(f"`{n}` {k}" for n, k in [*data, *parts])
            by = f"PARTITIONED BY ({', '.join(f'`{n}`' for n, _ in parts)})" if parts else ""
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {by} LOCATION {_quoted(t.base_path)} TBLPROPERTIES ({listed})")
        else:
            self.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({listed})")
        if t.partition_columns:
            self.sync_partitions(name, t.partition_columns, partitions_of(snapshot.files, t.partition_columns))

    def drop(self, snapshot: Snapshot) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(snapshot)}")

    def partitions(self, name: str, columns: list[str]) -> DataFrame:
        """values and location of each, in one call of the catalog."""
        jvm, parts = self.spark.sparkContext._jvm, name.replace("`", "").split(".")
        java = jvm.scala.jdk.javaapi.CollectionConverters.asJava
        table = jvm.org.apache.spark.sql.catalyst.TableIdentifier(parts[1], jvm.scala.Option.apply(parts[0]))
        rows = []
        for p in java(self.spark._jsparkSession.sessionState().catalog().listPartitions(table, jvm.scala.Option.empty())):
            values = dict(java(p.spec()))
            location = p.storage().locationUri()
            rows.append(([None if values[c] == MISSING else values[c] for c in columns], urllib.parse.unquote(location.get().toString()).removeprefix("file:") if location.isDefined() else ""))
        return self.spark.createDataFrame(rows, "values array<string>, location string")

    @staticmethod
    def _spec(columns: list[str], values: list[str | None]) -> str:
        return "PARTITION (" + ", ".join(f"`{c}`={_quoted(v if v is not None else MISSING)}" for c, v in zip(columns, values, strict=True)) + ")"

    def sync_partitions(self, name: str, columns: list[str], desired: DataFrame) -> None:
        """Tries all events, additions and removals in statements of a batch each; then tells all errors at once."""
        events = diff_partitions(self.partitions(name, columns), desired).persist()
        run = lambda text: self.spark.sql(f"ALTER TABLE {name} {text}")
        acts: dict[str, Callable[[list[Any]], Any]] = {
            "ADD": lambda rows: run("ADD IF NOT EXISTS " + " ".join(f"{self._spec(columns, r['values'])} LOCATION {_quoted(r.location)}" for r in rows)),
            "UPDATE": lambda rows: [run(f"{self._spec(columns, r['values'])} SET LOCATION {_quoted(r.location)}") for r in rows],
            "DROP": lambda rows: run("DROP IF EXISTS " + ", ".join(self._spec(columns, r["values"]) for r in rows)),
        }
        errors = [e for event, act in acts.items() for e in in_batches(events.where(events["event"] == event).toLocalIterator(), self.batch, act)]
        events.unpersist()
        if errors:
            raise TableError("; ".join(map(str, errors)))

    def resolve(self, name: str) -> tuple[str, str]:
        """Format and location."""
        at = f"`{self.database}`.`{name}`"
        properties = {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {at}").collect()}
        facts = {r.col_name: r.data_type for r in self.spark.sql(f"DESCRIBE TABLE EXTENDED {at}").collect()}
        return parse_format(properties.get(FORMAT) or facts.get("Provider", "")), facts["Location"].removeprefix("file:")

    def discover(self, marker: str = TARGETS) -> list[Dataset]:
        """All tables of the database that name their targets."""
        out = []
        for t in self.spark.catalog.listTables(self.database):
            rows = self.spark.sql(f"SHOW TBLPROPERTIES `{self.database}`.`{t.name}`").collect()
            properties = {r.key: r.value for r in rows}
            if properties.get(marker, "").strip():
                told = self.spark.sql(f"DESCRIBE TABLE EXTENDED `{self.database}`.`{t.name}`").collect()
                facts = {r.col_name: r.data_type for r in told}
                source = parse_format(properties.get(FORMAT) or facts.get("Provider", ""))
                out.append(Dataset(facts["Location"].removeprefix("file:"), source, targets_of(properties, marker), t.name))
        return out


class RestCatalog:
    """Client of an Iceberg REST catalog. token: a bearer token, or a function that returns one; sign: makes a request's headers from its method, URL, headers and body."""

    def __init__(self, uri: str, warehouse: str = "", token: str | Callable[[], str] = "", headers: dict[str, str] | None = None, database: str = "default", timeout: float = 30, sign: Callable[[str, str, dict[str, str], bytes], dict[str, str]] | None = None):
        self.sign = sign
        self.uri, self.warehouse, self.token, self.headers, self.database, self.timeout = uri.rstrip("/"), warehouse, token, dict(headers or {}), database, timeout
        self._config: dict[str, Any] | None = None

    @classmethod
    def with_client_credentials(cls, uri: str, credential: str, endpoint: str = "", scope: str = "catalog", **more: Any) -> RestCatalog:
        """OAuth2: credential is `id:secret` or a secret alone; tokens are renewed 30 s before they expire."""
        import time

        state = {"token": "", "until": 0.0}

        def token() -> str:
            if time.time() >= state["until"]:
                client, _, secret = credential.rpartition(":")
                form = {"grant_type": "client_credentials", "client_secret": secret, "scope": scope} | ({"client_id": client} if client else {})
                request = urllib.request.Request(endpoint or f"{uri.rstrip('/')}/v1/oauth/tokens", urllib.parse.urlencode(form).encode(), {"Content-Type": "application/x-www-form-urlencoded"})
                with urllib.request.urlopen(request, timeout=30) as answer:
                    got = json.load(answer)
                state["token"], state["until"] = got["access_token"], time.time() + float(got.get("expires_in", 3600)) - 30
            return state["token"]

        return cls(uri, token=token, **more)

    @classmethod
    def with_entra(cls, uri: str, tenant: str, client: str, secret: str, scope: str = "https://storage.azure.com/.default", authority: str = "https://login.microsoftonline.com", **more: Any) -> RestCatalog:
        """Microsoft Entra's client credentials."""
        return cls.with_client_credentials(uri, f"{client}:{secret}", f"{authority.rstrip('/')}/{tenant}/oauth2/v2.0/token", scope, **more)

    @classmethod
    def with_signatures(cls, uri: str, region: str, service: str = "glue", credentials: Any = Credentials.of_environment, **more: Any) -> RestCatalog:
        """Requests signed as AWS asks for."""
        return cls(uri, sign=lambda method, url, headers, body: signed(method, url, headers, body, region, service, credentials), **more)

    def _call(self, method: str, path: str, body: dict[str, Any] | None = None, prefix: bool = True, headers: dict[str, str] | None = None, **query: str) -> tuple[int, dict[str, Any]]:
        at = f"{self.uri}/v1" + (f"/{p}" if prefix and (p := self.prefix()) else "") + path
        if query := {k.replace("_", "-") if k == "page_token" else k: v for k, v in query.items() if v}:
            at += "?" + urllib.parse.urlencode({"pageToken" if k == "page-token" else k: v for k, v in query.items()})
        token = self.token() if callable(self.token) else self.token
        sent = {"Content-Type": "application/json"} | self.headers | (headers or {}) | ({"Authorization": f"Bearer {token}"} if token else {})
        data = json.dumps(body).encode() if body is not None else None
        if self.sign:
            sent = self.sign(method, at, sent, data or b"")
        request = urllib.request.Request(at, data, sent, method=method)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                data = answer.read()
                return answer.status, json.loads(data) if data else {}
        except urllib.error.HTTPError as e:
            data = e.read()
            try:
                return e.code, json.loads(data) if data else {}
            except ValueError:
                return e.code, {"error": {"message": data.decode("utf-8", "replace")}}

    def config(self) -> dict[str, Any]:
        """Asked for once; a catalog without the endpoint has an empty one. A failure isn't kept."""
        if self._config is None:
            status, found = self._call("GET", "/config", prefix=False, warehouse=self.warehouse)
            if status in (404, 405):
                if self.warehouse and self._call("GET", "/config", prefix=False)[0] == 200:
                    raise TableError(f"the catalog {self.uri} doesn't know the warehouse {self.warehouse}")
                found = {}
            elif status != 200:
                raise TableError(f"the catalog {self.uri} answered {status} for its configuration")
            self._config = found
        return self._config

    def prefix(self) -> str:
        found = self.config()
        return (found.get("overrides") or {}).get("prefix") or (found.get("defaults") or {}).get("prefix") or ""

    def _writable(self) -> None:
        known = self.config().get("endpoints")
        if known and not any(e.startswith("POST ") and e.endswith("/tables") for e in known):
            raise TableError(f"the catalog {self.uri} is read-only")

    def _space(self, namespace: str) -> str:
        return "/namespaces/" + urllib.parse.quote(namespace.replace(".", "\x1f"), safe="")

    def _fail(self, status: int, body: dict[str, Any], what: str) -> TableError:
        return TableError(f"{what}: the catalog answered {status} {(body.get('error') or {}).get('message', '')}".strip())

    def register(self, snapshot: Snapshot) -> None:
        """Creates the table, or sets the properties of one that is there."""
        self._writable()
        t = snapshot.table
        properties = {"table_type": t.format, "source_id": snapshot.source_id}
        schema, _ = schemas.to_iceberg(t.schema)
        status, body = self._call("POST", f"{self._space(self.database)}/tables", {"name": t.name, "location": t.base_path, "schema": schema, "properties": properties})
        if status == 409:
            update = {"requirements": [], "updates": [{"action": "set-properties", "updates": properties}]}
            status, body = self._call("POST", f"{self._space(self.database)}/tables/{urllib.parse.quote(t.name, safe='')}", update)
        if status not in (200, 204):
            raise self._fail(status, body, f"{t.name} wasn't registered")

    def drop(self, name: str) -> None:
        status, body = self._call("DELETE", f"{self._space(self.database)}/tables/{urllib.parse.quote(name, safe='')}")
        if status not in (200, 204, 404):
            raise self._fail(status, body, f"{name} wasn't dropped")

    def load(self, name: str, namespace: str | None = None) -> dict[str, Any]:
        """location, metadata_location, properties, and credentials that the catalog lends."""
        status, body = self._call("GET", f"{self._space(namespace or self.database)}/tables/{urllib.parse.quote(name, safe='')}", headers={"X-Iceberg-Access-Delegation": "vended-credentials"})
        if status != 200:
            raise self._fail(status, body, f"{name} wasn't loaded")
        meta, at = body.get("metadata") or {}, body.get("metadata-location") or ""
        location = meta.get("location") or at.rpartition("/metadata/")[0]
        return {"location": location, "metadata_location": at, "properties": meta.get("properties") or {}, "credentials": body.get("config") or {}}

    def resolve(self, name: str) -> tuple[str, str]:
        """Format and location."""
        found = self.load(name)
        return parse_format(found["properties"].get("table_type") or "ICEBERG"), found["location"]

    def _pages(self, path: str, key: str) -> Iterator[Any]:
        page = ""
        while True:
            status, body = self._call("GET", path, page_token=page)
            if status != 200:
                raise self._fail(status, body, f"{path} wasn't listed")
            yield from body.get(key) or ()
            page = body.get("next-page-token") or ""
            if not page:
                return

    def discover(self, marker: str = TARGETS, namespace: str | None = None) -> Iterator[Dataset]:
        """Tables whose properties name their targets; each is loaded to know."""
        spaces = [namespace] if namespace else [".".join(n) for n in self._pages("/namespaces", "namespaces")]
        for space in spaces:
            for t in self._pages(f"{self._space(space)}/tables", "identifiers"):
                found = self.load(t["name"], space)
                if found["properties"].get(marker, "").strip():
                    yield Dataset(found["location"], found["properties"].get("table_type") or "ICEBERG", targets_of(found["properties"], marker), t["name"])


def client(spark: SparkSession, config: Any) -> Any:
    """A catalog from its configuration: {"type": "session", "rest" or "glue"} and what its class takes; a catalog is itself. auth of a REST catalog: "entra" or "sigv4", with what these take."""
    if not isinstance(config, dict):
        return config
    more = dict(config)
    kind = str(more.pop("type", "session")).lower()
    if kind == "session":
        return SessionCatalog(spark, **more)
    if kind == "rest":
        make = {"": RestCatalog, "oauth2": RestCatalog.with_client_credentials, "entra": RestCatalog.with_entra, "sigv4": RestCatalog.with_signatures}
        auth = str(more.pop("auth", "")).lower()
        if auth not in make:
            raise TableError(f"unknown authentication {auth!r} of a catalog; known: {', '.join(x for x in make if x)}")
        return make[auth](**more)
    if kind == "glue":
        from tidewater.glue import GlueCatalog

        return GlueCatalog(spark, **more)
    raise TableError(f"unknown catalog {kind!r}; known: session, rest, glue")
