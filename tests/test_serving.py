"""Catalogs, service, command line, streams and the entry point."""

import datetime
import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tidewater import __main__ as cli
from tidewater import scan
from tidewater.catalog import RestCatalog, SessionCatalog, client, targets_of
from tidewater.functions.signing import Credentials, signed
from tidewater.model import TableError
from tidewater.plans import catalogue
from tidewater.plans.staging import Log
from tidewater.service import Service
from tidewater.sources import open_source
from tidewater.streaming import feed
from tidewater.streaming.changes import Daemon, added_rows, follow
from tidewater.sync import Controller, Dataset, load_config


@pytest.fixture()
def table(spark, tmp_path):
    path = str(tmp_path / "shop")
    spark.range(12).withColumn("c", (F.col("id") % 3).cast("string")).withColumn("c", F.concat(F.lit("k"), "c")).repartition(1).write.partitionBy("c").parquet(path)
    return path


def test_config_forms():
    one = load_config('{"basePath": "/t", "sourceFormat": "delta", "targetFormats": ["hudi"], "syncMode": "full"}')[0].checked()
    assert (one.name, one.source_format, one.target_formats, one.mode) == ("t", "DELTA", ("HUDI",), "FULL")
    many = load_config('{"datasets": [{"base_path": "/a", "source_format": "delta", "target_formats": "iceberg,hudi"}, {"base_path": "/b", "source_format": "x", "target_formats": ["hudi"]}]}')
    assert many[0].checked().target_formats == ("ICEBERG", "HUDI")
    for bad in (many[1], Dataset("", "delta", ("hudi",)), Dataset("/a", "delta", ()), Dataset("/a", "delta", ("hudi",), mode="x")):
        with pytest.raises(TableError):
            bad.checked()


def test_session_catalog_and_discovery(spark, table):
    catalog = SessionCatalog(spark)
    result = Controller(spark).sync(Dataset(table, "parquet", ("delta",), catalogs=(catalog,)))["DELTA"]
    assert result.verdict == "SUCCESS" and result.catalog_errors == []
    assert spark.table("default.shop_delta").groupBy("c").count().count() == 3
    snapshot = open_source(spark, "delta", table).snapshot()
    spark.sql("ALTER TABLE default.shop_delta DROP PARTITION (c='k1')")
    catalog.register(snapshot)
    assert spark.sql("SHOW PARTITIONS default.shop_delta").count() == 3
    assert not [d for d in catalog.discover() if d.base_path.endswith("/shop")]
    spark.sql("ALTER TABLE default.shop_delta SET TBLPROPERTIES ('target_formats'='iceberg, hudi')")
    found = [d for d in catalog.discover() if d.base_path.endswith("/shop")]
    assert found[0].source_format == "DELTA" and found[0].target_formats == ("ICEBERG", "HUDI")
    catalog.drop(snapshot)
    assert not spark.catalog.tableExists("default.shop_delta") and targets_of({}) == ()


def test_rest_catalog(spark, table):
    seen = []

    class Stub(BaseHTTPRequestHandler):
        def _do(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            seen.append((self.command, self.path, json.loads(body) if body and body[:1] == b"{" else body.decode(), self.headers.get("Authorization")))
            path, answer, status = self.path, {}, 200
            if path.startswith("/v1/oauth"):
                answer = {"access_token": "tok", "expires_in": 60}
            elif path.startswith("/v1/config"):
                answer = {"defaults": {"prefix": "d"}, "overrides": {"prefix": "p"}}
            elif self.command == "POST" and path == "/v1/p/namespaces/default/tables":
                status = 409
            elif self.command == "DELETE":
                status = 404
            elif path == "/v1/p/namespaces":
                answer = {"namespaces": [["default"]]}
            elif path.startswith("/v1/p/namespaces/default/tables?pageToken=2"):
                answer = {"identifiers": [{"namespace": ["default"], "name": "b"}]}
            elif path == "/v1/p/namespaces/default/tables":
                answer = {"identifiers": [{"namespace": ["default"], "name": "a"}], "next-page-token": "2"}
            elif path.endswith("/tables/b"):
                answer = {"metadata-location": "s3://w/b/metadata/v1.metadata.json", "metadata": {"properties": {"target_formats": "delta"}}, "config": {"k": "v"}}
            elif path.endswith("/tables/a"):
                answer = {"metadata": {"location": "s3://w/a", "properties": {}}}
            data = json.dumps(answer).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _do

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        c = RestCatalog.with_client_credentials(f"http://127.0.0.1:{server.server_address[1]}", "me:secret")
        c.register(open_source(spark, "parquet", table).snapshot())
        assert seen[-1][2]["updates"][0]["action"] == "set-properties" and seen[-1][3] == "Bearer tok"
        c.drop("x")
        assert [(d.name, d.base_path, d.target_formats) for d in c.discover()] == [("b", "s3://w/b", ("DELTA",))]
        assert c.load("b")["credentials"] == {"k": "v"} and len([s for s in seen if s[1].startswith("/v1/config")]) == 1
    finally:
        server.shutdown()


def serve(answer):
    """A server that answers requests with answer(method, path, headers, body): status and JSON."""

    class Stub(BaseHTTPRequestHandler):
        def _do(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, found = answer(self.command, self.path, self.headers, body)
            data = json.dumps(found).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _do

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_address[1]}"


KEYS = Credentials("AKIDEXAMPLE", "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY")


def test_signatures():
    """The published example of a plain request."""
    at = datetime.datetime(2015, 8, 30, 12, 36, tzinfo=datetime.timezone.utc)
    out = signed("GET", "https://example.amazonaws.com/", {}, b"", "us-east-1", "service", KEYS, at)
    assert out["Authorization"] == "AWS4-HMAC-SHA256 Credential=AKIDEXAMPLE/20150830/us-east-1/service/aws4_request, SignedHeaders=host;x-amz-date, Signature=5fa00fa31553b73ebf1942676e86291e8372ff2a2260956d9b8aae1d763fbf31"
    again = lambda **x: signed(**{"method": "GET", "url": "https://e.com/a b?x=1&a=%2F", "headers": {"B": " two  words "}, "body": b"", "region": "r", "service": "s", "credentials": lambda: Credentials("a", "b", "tok"), "now": at} | x)
    assert again()["x-amz-security-token"] == "tok" and "SignedHeaders=b;host;x-amz-date;x-amz-security-token" in again()["Authorization"]
    assert again()["Authorization"] == again(headers={"B": "two words"})["Authorization"] != again(body=b"x")["Authorization"]


def test_glue(spark, table):
    tables, parts, seen = {}, {}, []

    def answer(method, path, headers, body):
        action, b = headers["X-Amz-Target"].removeprefix("AWSGlue."), json.loads(body)
        seen.append((action, b))
        assert headers["Authorization"].startswith("AWS4-HMAC-SHA256 Credential=AKIDEXAMPLE/") and "/eu-west-1/glue/" in headers["Authorization"]
        if action == "GetTable":
            return (200, {"Table": tables[b["Name"]]}) if b["Name"] in tables else (400, {"__type": "com.x#EntityNotFoundException", "Message": "no"})
        if action in ("CreateTable", "UpdateTable"):
            tables[b["TableInput"]["Name"]] = b["TableInput"]
        if action == "GetTables":
            names = sorted(tables)
            at = int(b.get("NextToken", 0))
            return 200, {"TableList": [tables[names[at]]]} | ({"NextToken": str(at + 1)} if at + 1 < len(names) else {})
        if action == "GetPartitions":
            return 200, {"Partitions": list(parts.values())}
        if action == "BatchCreatePartition":
            parts.update({tuple(p["Values"]): p for p in b["PartitionInputList"]})
        if action == "BatchUpdatePartition":
            parts.update({tuple(p["PartitionValueList"]): p["PartitionInput"] for p in b["Entries"]})
        if action == "BatchDeletePartition":
            for p in b["PartitionsToDelete"]:
                if p["Values"] == ["locked"]:
                    return 200, {"Errors": [{"PartitionValues": p["Values"], "ErrorDetail": {"ErrorMessage": "it is locked"}}]}
                parts.pop(tuple(p["Values"]))
        if action == "DeleteTable":
            return (200, {}) if tables.pop(b["Name"], None) else (400, {"__type": "EntityNotFoundException"})
        return 200, {}

    server, uri = serve(answer)
    try:
        config = {"type": "glue", "region": "eu-west-1", "endpoint": f"{uri}/", "credentials": KEYS, "database": "db"}
        result = Controller(spark).sync(Dataset(table, "parquet", ("delta", "iceberg"), catalogs=(config,)))
        assert [r.catalog_errors for r in result.values()] == [[], []] and set(tables) == {"shop_delta", "shop_iceberg"}
        assert tables["shop_delta"]["PartitionKeys"] == [{"Name": "c", "Type": "string"}] and tables["shop_delta"]["StorageDescriptor"]["Columns"] == [{"Name": "id", "Type": "bigint"}]
        assert set(parts) == {("k0",), ("k1",), ("k2",)} and parts[("k1",)]["StorageDescriptor"]["Location"].endswith("/c=k1")
        glue = client(spark, config)
        tables["shop_delta"]["Parameters"]["target_formats"] = "hudi"
        parts[("k0",)]["StorageDescriptor"]["Location"] = "elsewhere"
        parts[("old",)] = {"Values": ["old"], "StorageDescriptor": {"Location": "x"}}
        parts.pop(("k2",))
        seen.clear()
        glue.register(open_source(spark, "delta", table, name="shop").snapshot())
        assert set(parts) == {("k0",), ("k1",), ("k2",)} and parts[("k0",)]["StorageDescriptor"]["Location"].endswith("/c=k0")
        assert [a for a, _ in seen if a.startswith("Batch")] == ["BatchCreatePartition", "BatchUpdatePartition", "BatchDeletePartition"]
        assert [(d.name, d.source_format, d.target_formats) for d in glue.discover()] == [("shop_delta", "DELTA", ("HUDI",))]
        assert glue.resolve("shop_delta") == ("DELTA", table)
        parts[("locked",)] = {"Values": ["locked"], "StorageDescriptor": {"Location": "x"}}
        with pytest.raises(TableError, match="it is locked"):
            glue.register(open_source(spark, "delta", table, name="shop").snapshot())
        dataset = load_config(json.dumps({"tableName": "shop_delta", "targetFormats": ["paimon"], "sourceCatalog": {k: v for k, v in config.items() if k != "credentials"}}))[0]
        assert Controller(spark, lambda c: glue).sync(dataset)["PAIMON"].verdict == "SUCCESS"
        glue.drop("shop_delta")
        glue.drop("shop_delta")
        assert set(tables) == {"shop_iceberg"}
        with pytest.raises(TableError, match="EntityNotFound"):
            glue.resolve("shop_delta")
    finally:
        server.shutdown()


def test_rest_catalogs_that_ask_for_signatures_or_entra(spark):
    seen = []

    def answer(method, path, headers, body):
        seen.append((path, headers.get("Authorization"), body.decode()))
        return 200, {"access_token": "tok", "expires_in": 60} if path.endswith("/token") else {"metadata": {"location": "s3://w/a", "properties": {"table_type": "DELTA"}}}

    server, uri = serve(answer)
    try:
        assert client(spark, {"type": "rest", "auth": "sigv4", "uri": uri, "region": "eu-west-1", "credentials": KEYS}).resolve("a") == ("DELTA", "s3://w/a")
        assert "/eu-west-1/glue/aws4_request" in seen[-1][1]
        assert client(spark, {"type": "rest", "auth": "entra", "uri": uri, "authority": uri, "tenant": "t", "client": "me", "secret": "s"}).resolve("a")[0] == "DELTA"
        token = next(x for x in seen if x[0] == "/t/oauth2/v2.0/token")
        assert "client_id=me" in token[2] and "scope=https%3A%2F%2Fstorage.azure.com%2F.default" in token[2] and seen[-1][1] == "Bearer tok"
    finally:
        server.shutdown()
    for bad in ({"type": "other"}, {"type": "rest", "auth": "other", "uri": "x"}):
        with pytest.raises(TableError):
            client(spark, bad)


def test_partitions_of_the_session_catalog(spark, tmp_path):
    """Added, moved and dropped in few statements, whatever their values hold."""
    path = str(tmp_path / "odd's")
    values = ["a'b", "c d", "x/y", None, "100%"]
    spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, c string").repartition(1).write.partitionBy("c").parquet(path)
    catalog, snapshot = SessionCatalog(spark), open_source(spark, "parquet", path, name="odd").snapshot()
    catalog.register(snapshot)
    name = "`default`.`odd_parquet`"
    try:
        assert {r[0][0] for r in catalog.partitions(name, ["c"]).collect()} == set(values)
        assert {(r.id, r.c) for r in spark.table("default.odd_parquet").collect()} == set(enumerate(values))
        before = {tuple(r) for r in map(lambda r: (r[0][0], r[1]), catalog.partitions(name, ["c"]).collect())}
        spark.sql(f"ALTER TABLE {name} ADD PARTITION (c='gone') LOCATION '{tmp_path}/gone'")
        spark.sql(f"ALTER TABLE {name} PARTITION (c='c d') SET LOCATION '{tmp_path}/moved'")
        catalog.register(snapshot)
        assert {(r[0][0], r[1]) for r in catalog.partitions(name, ["c"]).collect()} == before
        assert catalog.resolve("odd_parquet")[0] == "PARQUET"
    finally:
        catalog.drop(snapshot)


def test_service(spark, table):
    service = Service(spark)
    threading.Thread(target=service.run, daemon=True).start()
    url = f"http://127.0.0.1:{service.port}"

    def call(path, body=None, **headers):
        try:
            with urllib.request.urlopen(urllib.request.Request(url + path, json.dumps(body).encode() if body else None, headers)) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert call("/health")[1]["status"] == "UP"
        body = {"basePath": table, "sourceFormat": "parquet", "targetFormats": ["delta"]}
        status, job = call("/v1/conversion/table", body, Prefer="respond-async")
        assert status == 202
        for _ in range(300):
            told = call(f"/v1/conversion/table/{job['id']}")[1]
            if told["status"] != "RUNNING":
                break
            threading.Event().wait(0.2)
        assert told["status"] == "DONE" and told["result"]["targets"][0]["verdict"] == "SUCCESS"
        assert call("/v1/inspect/table", {"basePath": table, "format": "delta"})[1]["records"] == 12
        assert call("/v1/conversion/table", {"basePath": table, "sourceFormat": "?", "targetFormats": ["delta"]})[0] == 400
        assert call("/v1/conversion/table/none")[0] == 404
    finally:
        service.stop()


def test_command_line(spark, table, capsys):
    assert cli.main(["version"]) == 0
    assert cli.main(["sync", "--base-path", table, "--source-format", "parquet", "--target-formats", "delta,paimon"], spark) == 0
    assert cli.main(["inspect", "--base-path", table, "--format", "paimon"], spark) == 0
    assert '"records": 12' in capsys.readouterr().out
    assert cli.main(["sync", "--base-path", table + "x", "--source-format", "delta", "--target-formats", "hudi"], spark) == 1


def test_streams_follow(spark, tmp_path):
    path = str(tmp_path / "t")
    log = Log(spark, path)
    log.commit(spark.range(5))
    seen = []
    last = added_rows(spark, path, "delta", lambda df, v: seen.append((v, df.count())))
    log.commit(spark.range(5, 9))
    added_rows(spark, path, "delta", lambda df, v: seen.append((v, df.count())), last)
    assert seen == [("0", 5), ("1", 4)]
    for n in (9, 12):
        stream = follow(spark, "delta", "iceberg", path, str(tmp_path / "cp"))
        stream.awaitTermination(120)
        assert scan.scan(spark, path, "iceberg").count() == n
        log.commit(spark.range(n, 12))
    told = []
    daemon = Daemon(spark, [Dataset(path, "delta", ("paimon",)), Dataset(path + "none", "delta", ("paimon",))], tell=lambda d, r, e: told.append((r["PAIMON"].verdict if r else "", bool(e))))
    daemon.pass_once()
    assert told == [("SUCCESS", False), ("", True)]


def test_change_feed_waits_until_the_stream_ends(monkeypatch):
    asked = []

    class Slow:
        def awaitTermination(self, timeout=None):
            asked.append(timeout)
            return None if timeout is None else False

        def exception(self):
            return None

    monkeypatch.setattr(catalogue, "_thirds", lambda spark, sf_dir: "/t")
    monkeypatch.setattr(catalogue, "folder", lambda spark: "/f")
    monkeypatch.setattr(catalogue, "follow", lambda *a, **k: Slow())
    monkeypatch.setattr(catalogue, "once", lambda spark, key, make: make("/t"))
    monkeypatch.setattr(catalogue.scans, "scan", lambda *a: (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        catalogue.stream_change_feed(None, "/sf")
    assert asked == [None]


def test_entry_point(spark, tmp_path):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 30


def test_changes_by_version_as_a_stream(spark, tmp_path):
    """Each version once, also after a restart; windows and watermarks; a gap is an error."""
    path, checkpoint, out = str(tmp_path / "t"), str(tmp_path / "c"), str(tmp_path / "out")
    log = Log(spark, path)
    log.commit(spark.range(3))
    log.commit(spark.range(4))

    def bring():
        stream = feed.changes(spark, path).withWatermark("time", "10 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()
        return sorted((r.version, r.op, r.record_count, r.time.timestamp()) for r in spark.read.parquet(out).collect())

    assert bring() == [(0, "ADD", 3, 1.0), (1, "ADD", 4, 2.0)]
    log.commit(remove=open_source(spark, "delta", path).snapshot("0").files)
    assert bring() == [(0, "ADD", 3, 1.0), (1, "ADD", 4, 2.0), (2, "REMOVE", None, 3.0)]
    counted = feed.changes(spark, path, 1).withWatermark("time", "0 seconds").groupBy(F.window("time", "1 second")).agg(F.count("*").alias("n"))
    stream = counted.writeStream.format("memory").queryName("windows").outputMode("append").start()
    stream.processAllAvailable()
    stream.stop()
    assert [(r.window.start.timestamp(), r.n) for r in spark.table("windows").collect()] == [(2.0, 1)]
    (tmp_path / "t" / "_delta_log" / f"{1:020d}.json").unlink()
    reader = feed.Reader({"path": path})
    assert reader.latestOffset() == {"version": 1}
    with pytest.raises(TableError, match="lost version 1"):
        reader.partitions({"version": 0}, {"version": 3})
