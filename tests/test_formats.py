"""Formats end to end: what a target wrote is read back by its source and by Spark's own Parquet reader."""

import datetime
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater import scan
from tidewater.functions import avro
from tidewater.model import FILE_COLUMNS, FILES, Change, PartitionField, Snapshot, Table, TableError
from tidewater.operators import files as op
from tidewater.plans import catalogue
from tidewater.plans.staging import Log
from tidewater.sources import delta, detect_format, open_source, open_target
from tidewater.sources.storage import Exists, Storage
from tidewater.sync import Controller, Dataset

ALL = ("delta", "iceberg", "hudi", "paimon")


def rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("people") / "t")
    df = spark.createDataFrame([(i, f"n {i}", ["US", "DE", "a b%", None][i % 4], None if i % 5 == 0 else i / 2) for i in range(40)], "id bigint, name string, country string, score double")
    df.repartition(1).write.partitionBy("country").parquet(path)
    results = Controller(spark).sync(Dataset(path, "parquet", ALL))
    assert [r.error for r in results.values()] == [""] * 4
    return path, df


@pytest.mark.parametrize("format", ("parquet", *ALL))
def test_rows_are_the_same_through_each_format(spark, people, format):
    path, df = people
    assert rows(scan.scan(spark, path, format).select(*df.columns)) == rows(df)
    found = scan.inspect(spark, path, format)
    assert (found["files"], found["records"], found["partition_fields"]) == (4, 40, ["country"])


@pytest.mark.parametrize("source", ALL)
def test_each_format_to_each_other(spark, people, source):
    """No-op where the target is in step already, full for the side-car."""
    path, df = people
    results = Controller(spark).sync(Dataset(path, source, (*[f for f in ALL if f != source], "parquet")), dry_run=True)
    assert [r.error for r in results.values()] == [""] * 4
    full = Controller(spark).sync(Dataset(path, source, ("parquet",), mode="full"))
    assert full["PARQUET"].verdict == "SUCCESS"
    side = open_target(spark, "parquet", path).files()
    assert {r.path for r in side.collect()} == {r.path for r in scan.files(spark, path, source).collect()}


@pytest.mark.parametrize("format", ("parquet", "delta", "iceberg"))
def test_bounds_survive(spark, people, format):
    path, _ = people
    s = open_source(spark, format, path).snapshot()
    found = {r.field_path: r for r in op.table_stats(s.files, s.table.schema).collect()}
    assert (found["id"].min_l, found["id"].max_l, found["score"].min_d, found["score"].max_d, found["score"].nulls) == (0, 39, 0.5, 19.5, 8)


def test_pruning_keeps_rows(spark, people):
    path, df = people
    assert rows(scan.scan(spark, path, "iceberg", where=[("country", "=", "DE"), ("id", ">", 20)]).select(*df.columns)) == rows(df.where("country = 'DE' AND id > 20"))
    s = open_source(spark, "iceberg", path).snapshot()
    assert op.prune(s.files, s.table.schema, [("country", "=", "DE")]).count() == 1
    assert op.prune(s.files, s.table.schema, [("id", ">", 39)]).count() == 0
    bare = s.files.withColumn("stats", F.lit(None).cast(FILES["stats"].dataType))
    assert op.prune(bare, s.table.schema, [("id", ">", 39)]).count() == 4  # nothing known, nothing dropped


def test_scan_pushes_filters_down(spark, people):
    path, _ = people
    plan = scan.scan(spark, path, "delta").where("id > 3").select("id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in plan


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """v0, v1: appends; v2: a column more; v3: v0's file removed."""
    path = str(tmp_path_factory.mktemp("log") / "t")
    it = Log(spark, path)
    df = spark.range(30).withColumn("k", F.col("id") % 3)
    for k in (0, 1):
        it.commit(df.where(F.col("k") == k))
    it.commit(df.where("k = 2").withColumn("extra", F.lit("x")))
    it.commit(remove=open_source(spark, "delta", path).snapshot("0").files)
    return path, df


def test_history_travel_and_changes(spark, log):
    path, df = log
    source = open_source(spark, "delta", path)
    assert source.history() == [("0", 1000), ("1", 2000), ("2", 3000), ("3", 4000)]
    assert scan.scan(spark, path, "delta", "1").count() == 20 and scan.scan(spark, path, "delta").count() == 20
    assert source.table("1").schema.fieldNames() == ["id", "k"] and source.table().schema.fieldNames() == ["id", "k", "extra"]
    found = source.changes_since(1000)
    assert [(c.version, c.instant, c.table.schema.fieldNames()) for c in found] == [("1", 2000, ["id", "k"]), ("2", 3000, ["id", "k", "extra"]), ("3", 4000, ["id", "k", "extra"])]
    assert source.safe_from(1000) and not source.safe_from(999)
    with pytest.raises(TableError):
        source.snapshot("9")
    assert source.change("3").files.collect()[0].op == "REMOVE"


@pytest.mark.parametrize("format", ("iceberg", "hudi", "paimon"))
def test_incremental_brings_adds_and_removes(spark, tmp_path, format):
    path = str(tmp_path / "t")
    it, df = Log(spark, path), spark.range(30).withColumn("k", F.col("id") % 3)
    it.commit(df.where("k = 0"))
    c = Controller(spark)
    first = c.sync(Dataset(path, "delta", (format,)))[format.upper()]
    assert (first.mode, first.verdict, first.fallback) == ("FULL", "SUCCESS", "there was no sync before")
    again = c.sync(Dataset(path, "delta", (format,)))[format.upper()]
    assert (again.mode, again.verdict) == ("INCREMENTAL", "NO_OP")
    it.commit(df.where("k = 1"))
    it.commit(df.where("k = 2").withColumn("extra", F.lit("x")), remove=open_source(spark, "delta", path).snapshot("0").files)
    dry = c.sync(Dataset(path, "delta", (format,)), dry_run=True)[format.upper()]
    assert (dry.mode, dry.commits) == ("INCREMENTAL", 2) and scan.scan(spark, path, format).count() == 10
    second = c.sync(Dataset(path, "delta", (format,)))[format.upper()]
    assert (second.mode, second.commits, second.error) == ("INCREMENTAL", 2, "")
    assert rows(scan.scan(spark, path, format).select("id", "k", "extra")) == rows(scan.scan(spark, path, "delta"))
    history = open_source(spark, format, path).history()
    assert len(history) == 3 and scan.scan(spark, path, format, history[1][0]).count() == 20
    ops = [sorted(r.op for r in x.files.collect()) for x in open_source(spark, format, path).changes_since(history[0][1])]
    assert ops == [["ADD"], ["ADD", "REMOVE"]]
    forced = c.sync(Dataset(path, "delta", (format,), mode="FULL"))[format.upper()]
    assert forced.mode == "FULL" and scan.scan(spark, path, format).count() == 20


def test_resync_removes_what_has_gone(spark, people, tmp_path):
    path, _ = people
    t = Table("t", "PARQUET", str(tmp_path), T.StructType.fromDDL("id bigint"), (), 5)
    files = spark.createDataFrame([(f"{tmp_path}/{i}.parquet", "PARQUET", 1, 1, {}, 1, None, None) for i in range(3)], FILES)
    for format in ("delta", "hudi"):
        target = open_target(spark, format, str(tmp_path))
        target.commit_snapshot(Snapshot(t, files, "a"))
        target.commit_snapshot(Snapshot(t, files.where("path NOT LIKE '%/1.parquet'"), "b"))
        assert sorted(r.path[-9:] for r in scan.files(spark, str(tmp_path), format).collect()) == ["0.parquet", "2.parquet"]


def delta_log(path, *commits):
    (path / "_delta_log").mkdir(parents=True, exist_ok=True)
    for v, lines in commits:
        (path / "_delta_log" / f"{v:020d}.json").write_text("\n".join(json.dumps(x) for x in lines) + "\n")


META = {"metaData": {"id": "x", "format": {"provider": "parquet", "options": {}}, "schemaString": '{"type":"struct","fields":[{"name":"id","type":"long","nullable":true,"metadata":{}}]}', "partitionColumns": [], "configuration": {}}}


def add(name, **more):
    return {"add": {"path": name, "partitionValues": {}, "size": 1, "modificationTime": 1, "dataChange": True} | more}


def test_delta_clock_truncation_and_checkpoints(spark, tmp_path):
    info = lambda t: {"commitInfo": {"timestamp": t}}
    delta_log(tmp_path / "a", (0, [META, info(10), add("a%20b.parquet")]), (1, [info(10), add("b.parquet")]), (2, [add("c.parquet")]), (3, [info(5), {"remove": {"path": "b.parquet"}}]))
    s = open_source(spark, "delta", str(tmp_path / "a"))
    assert [t for _, t in s.history()] == [10, 11, 12, 13]
    assert sorted(r.path for r in s.snapshot().files.collect()) == [f"{tmp_path}/a/a b.parquet", f"{tmp_path}/a/c.parquet"]
    delta_log(tmp_path / "b", (3, [add("x.parquet")]))
    with pytest.raises(TableError, match="truncated"):
        open_source(spark, "delta", str(tmp_path / "b")).snapshot()
    # a checkpoint at 1 stands for the commits before it
    c = tmp_path / "c"
    delta_log(c, (2, [add("z.parquet"), info(50)]))
    ddl = "metaData struct<id:string,name:string,schemaString:string,partitionColumns:array<string>,configuration:map<string,string>,createdTime:bigint>, add struct<path:string,partitionValues:map<string,string>,size:bigint,modificationTime:bigint,stats:string>"
    data = [((META["metaData"]["id"], None, META["metaData"]["schemaString"], [], {}, None), None), (None, ("y.parquet", {}, 7, 1, '{"numRecords":3}'))]
    spark.createDataFrame(data, ddl).coalesce(1).write.parquet(str(tmp_path / "cp"))
    part = next((tmp_path / "cp").glob("part-*.parquet"))
    (c / "_delta_log" / f"{1:020d}.checkpoint.parquet").write_bytes(part.read_bytes())
    (c / "_delta_log" / "_last_checkpoint").write_text('{"version":1,"size":2}')
    s = open_source(spark, "delta", str(c))
    assert sorted((r.path[-9:], r.record_count) for r in s.snapshot().files.collect()) == [("y.parquet", 3), ("z.parquet", None)]
    assert len(s.snapshot("1").files.collect()) == 1
    with pytest.raises(TableError):
        s.snapshot("0")
    (c / "_delta_log" / f"{1:020d}.checkpoint.parquet").unlink()
    with pytest.raises(TableError, match="missing"):
        s.snapshot()


def test_deletion_vectors_are_files_of_their_own_and_refused(spark, tmp_path):
    dv = {"storageType": "u", "pathOrInlineDv": "ab", "offset": 1, "sizeInBytes": 2, "cardinality": 3}
    delta_log(tmp_path, (0, [META, add("a.parquet")]), (1, [add("a.parquet", deletionVector=dv), {"remove": {"path": "a.parquet", "dataChange": True}}]))
    source = open_source(spark, "delta", str(tmp_path))
    live = source.snapshot().files.collect()
    assert len(live) == 1 and live[0].dv.cardinality == 3
    result = Controller(spark).sync(Dataset(str(tmp_path), "delta", ("iceberg", "hudi")))
    assert all("deletion vectors" in r.error and r.verdict == "FAILED" for r in result.values())
    with pytest.raises(TableError):
        scan.scan(spark, str(tmp_path), "delta")


def test_version_gates(spark, tmp_path):
    (tmp_path / "i/metadata").mkdir(parents=True)
    (tmp_path / "i/metadata/v1.metadata.json").write_text('{"format-version": 3}')
    (tmp_path / "h/.hoodie").mkdir(parents=True)
    (tmp_path / "h/.hoodie/hoodie.properties").write_text("hoodie.table.version=9\n")
    for format, name in (("iceberg", "i"), ("hudi", "h"), ("paimon", "none"), ("delta", "none"), ("parquet", "h")):
        with pytest.raises((TableError, Exception)):
            open_source(spark, format, str(tmp_path / name)).snapshot()
    assert detect_format(spark, str(tmp_path / "i")) == "ICEBERG" and detect_format(spark, str(tmp_path / "h")) == "HUDI"


def test_commits_never_overwrite(spark, tmp_path):
    target = open_target(spark, "delta", str(tmp_path))
    target.store.create("_delta_log/x", b"1")
    with pytest.raises(Exists):
        target.store.create("_delta_log/x", b"2")


def test_replaced_groups(spark, tmp_path):
    """A replacecommit drops groups written before it, not its own."""
    h = tmp_path / ".hoodie"
    h.mkdir()
    (h / "hoodie.properties").write_text("hoodie.table.version=6\nhoodie.table.partition.fields=city\nhoodie.table.schema=" + json.dumps({"type": "record", "name": "r", "fields": [{"name": "id", "type": "long"}]}) + "\n")
    w = lambda g, p: {"fileId": g, "path": p, "numWrites": 1, "fileSizeInBytes": 5}
    (h / "20240101000000000.commit").write_text(json.dumps({"partitionToWriteStats": {"city=a": [w("g1", "city=a/g1_0_1.parquet")], "city=b": [w("", "city=b/g1_0_1.parquet")]}}))
    (h / "20240102000000123.replacecommit").write_text(json.dumps({"partitionToWriteStats": {"city=a": [w("g1", "city=a/g1_0_2.parquet")]}, "partitionToReplaceFileIds": {"city=a": ["g1"], "city=b": ["g1"]}}))
    s = open_source(spark, "hudi", str(tmp_path))
    live = s.snapshot().files.collect()
    assert [(r.path, r.partition_values) for r in live] == [(f"{tmp_path}/city=a/g1_0_2.parquet", {"city": "a"})]
    assert s.history()[1][1] % 1000 == 123
    (h / "20240103000000000.commit").write_text("{broken")
    with pytest.raises(Exception):
        s.snapshot().files.collect()


def test_hudi_log_files_are_refused(spark, tmp_path):
    """Until a compaction writes a base file after them, whether or not the group has one before."""
    h = tmp_path / ".hoodie"
    h.mkdir()
    (h / "hoodie.properties").write_text("hoodie.table.version=6\nhoodie.table.type=MERGE_ON_READ\nhoodie.table.schema=" + json.dumps({"type": "record", "name": "r", "fields": [{"name": "id", "type": "long"}]}) + "\n")
    w = lambda g, p: {"fileId": g, "path": p, "numWrites": 1, "fileSizeInBytes": 5}
    put = lambda name, *stats: (h / name).write_text(json.dumps({"partitionToWriteStats": {"": list(stats)}}))
    files = lambda: sorted(r.path.rsplit("/", 1)[1] for r in open_source(spark, "hudi", str(tmp_path)).snapshot().files.collect())
    put("20240101000000000.deltacommit", w("g1", "g1_0_1.parquet"))
    assert files() == ["g1_0_1.parquet"]
    put("20240102000000000.deltacommit", w("", ".g1_1.log.1_0-1-1"))
    with pytest.raises(TableError, match="log files"):
        files()
    with pytest.raises(TableError, match="log files"):
        scan.scan(spark, str(tmp_path), "hudi")
    with pytest.raises(TableError, match="log files"):
        Controller(spark).sync(Dataset(str(tmp_path), "hudi", ("delta",)))
    put("20240103000000000.commit", w("g1", "g1_0_3.parquet"))
    assert files() == ["g1_0_3.parquet"]
    put("20240104000000000.deltacommit", w("g2", ".g2_4.log.1_0-1-1"))
    with pytest.raises(TableError, match="log files"):
        files()
    (h / "20240105000000000.replacecommit").write_text(json.dumps({"partitionToWriteStats": {"": [w("g3", "g3_0_5.parquet")]}, "partitionToReplaceFileIds": {"": ["g2"]}}))
    assert files() == ["g1_0_3.parquet", "g3_0_5.parquet"]


def _files(spark, items):
    return spark.createDataFrame([(p, "PARQUET", s, s, {}, 1, None, None) for p, s in items], FILES)


def test_random_histories_replay_diff_and_apply(spark):
    """Against dictionaries: replay of the log, the diff of two states, and applying it."""
    draw = random.Random(4)
    for _ in range(4):
        live, log, states = {}, [], []
        for v in range(6):
            for pos in range(5):
                p = f"f{draw.randint(0, 6)}"
                if p in live and draw.random() < 0.4:
                    del live[p]
                    log.append((p, v, pos, "REMOVE", (p, "PARQUET", None, None, None, None, None, None)))
                else:
                    live[p] = draw.randint(1, 9)
                    log.append((p, v, pos, "ADD", (p, "PARQUET", live[p], live[p], {}, 1, None, None)))
            states.append(dict(live))
        shape = T.StructType([T.StructField("key", T.StringType()), T.StructField("version", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("op", T.StringType()), T.StructField("file", FILES)])
        replayed = op.latest_action(spark.createDataFrame(log, shape))
        assert {r.path: r.size_bytes for r in replayed.collect()} == live
        old, new = states[2], states[5]
        a, b = _files(spark, old.items()), _files(spark, new.items())
        found = op.diff_files(a, b).collect()
        assert [(r.path, r.op) for r in found] == sorted([(p, "REMOVE") for p in old if old[p] != new.get(p)] + [(p, "ADD") for p in new if new[p] != old.get(p)], key=lambda x: (x[0], x[1] == "ADD"))
        assert {r.path: r.size_bytes for r in op.apply_diff(a, op.diff_files(a, b)).collect()} == new


def test_monotone_clock(spark):
    draw = random.Random(9)
    for _ in range(3):
        raws = [draw.choice([None, -3, 0, 5, 5, 9, 100]) for _ in range(15)]
        want, now = [], 0
        for r in raws:
            now = max(r or 0, now + 1)
            want.append(now)
        df = spark.createDataFrame(list(enumerate(raws)), "v int, raw bigint")
        assert [r.t for r in df.select("v", op.monotone(F.col("raw"), "v").alias("t")).orderBy("v").collect()] == want


def test_monotone_clock_query_has_all_events(spark):
    raws = {r.event_id: r.event_id * 7919 % 101 for r in spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("event_id").collect()}
    want, now = {}, 0
    for i in sorted(raws):
        want[i] = now = max(raws[i], now + 1)
    found = catalogue.QUERIES["monotone_clock"](spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(raws) and {r.event_id: r.t for r in found} == want


def test_partition_events_and_batches(spark):
    part = lambda items: spark.createDataFrame([([k], v) for k, v in items], "values array<string>, location string")
    found = op.diff_partitions(part([("a", "1"), ("b", "1"), ("c", "1")]), part([("b", "1"), ("c", "2"), ("d", "1")])).collect()
    assert [(r.event, r["values"][0]) for r in found] == [("ADD", "d"), ("DROP", "a"), ("UPDATE", "c")]
    seen = []

    def act(batch):
        seen.append(list(batch))
        if 3 in batch:
            raise ValueError("three")

    assert len(op.in_batches(range(7), 3, act)) == 1 and seen == [[0, 1, 2], [3, 4, 5], [6]]


def test_outside_files_are_refused(spark, tmp_path):
    t = Table("t", "PARQUET", str(tmp_path), T.StructType.fromDDL("id bigint"), (PartitionField("id"),), 5)
    for format in ("hudi", "paimon"):
        with pytest.raises(TableError):
            open_target(spark, format, str(tmp_path)).commit_changes([Change("1", 1, t, _files(spark, [("/elsewhere/a.parquet", 1)]).withColumn("op", F.lit("ADD")).select("op", *FILE_COLUMNS))])


# --- commits that cost what they change -----------------------------------------------------


def _manifests(spark, path):
    source = open_source(spark, "iceberg", path)
    meta = source.metadata()
    return [(e["manifest_path"], e["added_files_count"], e["existing_files_count"], e["deleted_files_count"]) for e in avro.load(source.store.read(meta["snapshots"][-1]["manifest-list"]))[1]]


def test_commits_leave_old_manifests_as_they_are(spark, tmp_path):
    path = str(tmp_path / "t")
    log, rows_ = Log(spark, path), spark.range(300)
    sync = lambda: [r.error for r in Controller(spark).sync(Dataset(path, "DELTA", ("ICEBERG", "PAIMON"))).values()]
    log.commit(rows_.where("id < 100"))
    assert sync() == ["", ""]
    log.commit(rows_.where("id between 100 and 199"))
    assert sync() == ["", ""]
    before = _manifests(spark, path)
    assert [m[1:] for m in before] == [(1, 0, 0), (1, 0, 0)]
    paimon = open_source(spark, "paimon", path)
    listed = lambda: [m["_FILE_NAME"] for m in json.loads(paimon.store.text(f"manifest/{paimon._pick(None)['baseManifestList']}"))["manifests"]]
    first = listed()
    log.commit(rows_.where("id >= 200"), remove=open_source(spark, "delta", path).snapshot("0").files)
    assert sync() == ["", ""]
    after = _manifests(spark, path)
    assert before[0][0] in [m[0] for m in after] and sorted(m[1:] for m in after) == [(0, 0, 1), (1, 0, 0), (1, 0, 0)]
    assert set(first) < set(listed())
    for format in ("iceberg", "paimon"):
        assert {r.id for r in scan.scan(spark, path, format).collect()} == set(range(100, 300))
    log.commit(rows_.where("id < 50"))
    assert sync() == ["", ""]
    assert len(_manifests(spark, path)) == 3  # the one whose file had gone is dropped
    got = open_source(spark, "iceberg", path).changes_since(-1)
    assert [sorted((r.op, r.record_count) for r in c.files.collect()) for c in got] == [[("ADD", 100)], [("ADD", 100)], [("ADD", 100), ("REMOVE", 100)], [("ADD", 50)]]
    assert open_source(spark, "paimon", path)._pick(None)["totalRecordCount"] == 250


def test_rewritten_manifests_keep_who_added_what(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).select("id", F.col("id").alias("k")).repartition(4).write.partitionBy("k").parquet(path)
    assert Controller(spark).sync(Dataset(path, "parquet", ("iceberg",)))["ICEBERG"].error == ""
    source = open_source(spark, "iceberg", path)
    table, files, first = source.table(), source.snapshot().files, source.metadata()["current-snapshot-id"]
    gone = files.where(F.col("partition_values")["k"] == "2").withColumn("op", F.lit("REMOVE")).select("op", *FILE_COLUMNS)
    open_target(spark, "iceberg", path).commit_changes([Change("1", 5000, table, gone)])
    (manifest, *counts), = _manifests(spark, path)
    assert counts == [0, 3, 1]
    entries = avro.load(source.store.read(manifest))[1]
    assert sorted((e["status"], e["snapshot_id"] == first, e["sequence_number"]) for e in entries) == [(0, True, 1)] * 3 + [(2, False, 1)]
    assert {r.id for r in scan.scan(spark, path, "iceberg").collect()} == {0, 1, 3}


def test_overwriting_takes_one_step(spark, tmp_path):
    store = Storage(spark, str(tmp_path))
    for text in (b"one", b"two", b""):
        store.write("a/hint", text)
        assert store.read("a/hint") == text
    assert [f.name for f in store.list("a") if not f.name.endswith(".crc")] == ["hint"]


def test_no_op_opens_no_snapshot(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    Log(spark, path).commit(spark.range(3))
    sync = lambda: Controller(spark).sync(Dataset(path, "delta", ("iceberg", "hudi")))
    assert [r.verdict for r in sync().values()] == ["SUCCESS"] * 2
    monkeypatch.setattr(delta.Source, "snapshot", None)
    assert [r.verdict for r in sync().values()] == ["NO_OP"] * 2
    monkeypatch.undo()
    (tmp_path / "empty").mkdir()
    with pytest.raises(TableError):
        Controller(spark).sync(Dataset(str(tmp_path / "empty"), "delta", ("iceberg",)))


# --- scans without a join --------------------------------------------------------------------


def test_scans_of_partitions_join_nothing(spark, people):
    path, df = people
    out = scan.scan(spark, path, "delta").where("country = 'DE'")
    plan = out._jdf.queryExecution().toString()
    assert "Join" not in plan and "PartitionFilters: [isnotnull(country" in plan and rows(out.select(*df.columns)) == rows(df.where("country = 'DE'"))


@pytest.mark.parametrize("few", [32, 1])
@pytest.mark.parametrize("small", [1 << 20, 0])
def test_partition_values_that_no_directory_tells(spark, tmp_path, monkeypatch, few, small):
    """As literals, or joined to a list that is broadcast only if it is small."""
    monkeypatch.setattr(scan, "FEW", few)
    monkeypatch.setattr(scan, "SMALL", small)
    path = str(tmp_path / "t")
    schema = T.StructType.fromDDL("id bigint, day date, part string")
    files = None
    for k, (day, part) in enumerate([("2024-01-01", "x y"), ("2024-01-02", None), (None, "z")]):
        where = f"{path}/data-{k}"
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.parquet(where)
        values = F.create_map(F.lit("day"), F.lit(day).cast("string"), F.lit("part"), F.lit(part).cast("string"))
        found = open_source(spark, "parquet", where).snapshot().files.withColumn("partition_values", values)
        files = found if files is None else files.unionByName(found)
    table = Table("t", "DELTA", path, schema, (PartitionField("day"), PartitionField("part")), 1000)
    open_target(spark, "delta", path).commit_snapshot(Snapshot(table, files.select(*FILE_COLUMNS), "1"))
    out = scan.scan(spark, path, "delta", where=[("id", "<", 25)])
    want = Counter((i, [datetime.date(2024, 1, 1), datetime.date(2024, 1, 2), None][i // 10], ["x y", None, "z"][i // 10]) for i in range(25))
    assert rows(out) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("Join" in plan) == (few == 1) and ("BroadcastHashJoin" in plan) == (few == 1 and small > 0) and "BuildLeft" not in plan


# --- logs of other writers -------------------------------------------------------------------


def _write_log(path, *commits):
    log = path / "_delta_log"
    log.mkdir(parents=True)
    for v, lines in enumerate(commits):
        (log / f"{v:020d}.json").write_text("\n".join(json.dumps(x) for x in lines) + "\n")


def _meta(fields, columns=(), **configuration):
    return {"metaData": {"id": "x", "name": None, "description": None, "format": {"provider": "parquet", "options": {}}, "schemaString": json.dumps({"type": "struct", "fields": fields}), "partitionColumns": list(columns), "createdTime": 1, "configuration": configuration}}


def test_log_with_fields_that_are_not_known(spark, tmp_path):
    """Tags, transactions, domains, statistics without some columns, null values, a removal without sizes."""
    path = tmp_path / "t"
    fields = [{"name": "id", "type": "long", "nullable": False, "metadata": {}}, {"name": "region", "type": "string", "nullable": False, "metadata": {}}, {"name": "amount", "type": "double", "nullable": True, "metadata": {}}]
    add = lambda name, region, n: {"add": {"path": f"region={region}/{name}.parquet", "partitionValues": {"region": region}, "size": 100 + n, "modificationTime": 5, "dataChange": True, "stats": json.dumps({"numRecords": n, "minValues": {"id": 1}, "maxValues": {"id": n}, "nullCount": {"id": 0, "amount": 1}}), "tags": None, "baseRowId": None, "clusteringProvider": None}}
    _write_log(
        path,
        [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, _meta(fields, ["region"]), add("a", "east", 3), add("b", "west", 4), {"commitInfo": {"timestamp": 10, "operation": "WRITE", "operationParameters": {"mode": "Append"}, "engineInfo": "other", "clientVersion": "1"}}],
        [{"txn": {"appId": "s", "version": 3}}, {"domainMetadata": {"domain": "d", "configuration": "{}", "removed": False}}, add("c", "east", 5), {"commitInfo": {"timestamp": 10, "operation": "WRITE"}}],
        [{"remove": {"path": "region=west/b.parquet", "dataChange": True, "deletionTimestamp": 7, "extendedFileMetadata": False}}, {"commitInfo": {"timestamp": 9, "operation": "DELETE"}}],
    )
    source = open_source(spark, "delta", str(path))
    assert source.history() == [("0", 10), ("1", 11), ("2", 12)]
    found = {r.path.rpartition("/")[2]: (r.record_count, r.partition_values, r.stats["id"].max, r.stats["amount"].nulls) for r in source.snapshot().files.collect()}
    assert found == {"a.parquet": (3, {"region": "east"}, "3", 1), "c.parquet": (5, {"region": "east"}, "5", 1)}
    assert [(c.version, c.operation, [(r.op, r.path.rpartition("/")[2]) for r in c.files.collect()]) for c in source.changes_since(10)] == [("1", "WRITE", [("ADD", "c.parquet")]), ("2", "DELETE", [("REMOVE", "b.parquet")])]
    assert source.change("1").instant == 11
    with pytest.raises(TableError):
        source.change("9")


def test_lines_of_a_commit_keep_their_order_when_it_is_split(spark, tmp_path):
    path = tmp_path / "t"
    add = lambda i: {"add": {"path": f"f{i}.parquet", "partitionValues": {}, "size": i, "modificationTime": 1, "dataChange": True, "stats": "{}"}}
    _write_log(path, [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, _meta([{"name": "id", "type": "long", "nullable": True, "metadata": {}}]), *(add(i) for i in range(3000))])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        source = open_source(spark, "delta", str(path))
        assert source._commits([f.path for f in source.store.list("_delta_log") if f.name.endswith(".json")]).rdd.getNumPartitions() > 5
        assert [r.size_bytes for r in source.changes_since(-1)[0].files.collect()] == list(range(3000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_mapped_columns_are_read_by_their_names_in_files(spark, tmp_path):
    path = tmp_path / "t"
    inner = {"type": "struct", "fields": [{"name": "x", "type": "long", "nullable": True, "metadata": {"delta.columnMapping.id": 4, "delta.columnMapping.physicalName": "col-x"}}]}
    field = lambda name, kind, i: {"name": name, "type": kind, "nullable": True, "metadata": {"delta.columnMapping.id": i, "delta.columnMapping.physicalName": f"col-{i}"}}
    for day in ("2024-01-01", "2024-01-02"):
        spark.range(5).select(F.col("id").alias("col-1"), F.struct(F.col("id").alias("col-x")).alias("col-3")).coalesce(1).write.parquet(str(path / day))
    adds = [{"add": {"path": str(f.relative_to(path)), "partitionValues": {"col-2": f.parent.name}, "size": 9, "modificationTime": 1, "dataChange": True, "stats": json.dumps({"numRecords": 5, "minValues": {"col-1": 0}, "maxValues": {"col-1": 4}, "nullCount": {"col-1": 0}})}} for f in sorted(path.glob("*/*.parquet"))]
    protocol = {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["columnMapping"], "writerFeatures": ["columnMapping"]}
    _write_log(path, [{"protocol": protocol}, _meta([field("id", "long", 1), field("day", "date", 2), field("s", inner, 3)], ["day"], **{"delta.columnMapping.mode": "name"}), *adds])
    out = scan.scan(spark, str(path), "delta", where=[("id", ">=", 3), ("day", "=", datetime.date(2024, 1, 2))])
    assert out.columns == ["id", "day", "s"] and out.schema["s"].dataType.fieldNames() == ["x"]
    assert rows(out) == Counter({(3, datetime.date(2024, 1, 2), (3,)): 1, (4, datetime.date(2024, 1, 2), (4,)): 1})
    assert "names in its files" in Controller(spark).sync(Dataset(str(path), "delta", ("iceberg",)))["ICEBERG"].error


@pytest.mark.parametrize("protocol", [{"minReaderVersion": 4}, {"minReaderVersion": 3, "readerFeatures": ["somethingNew"]}])
def test_unknown_reader_features_are_refused(spark, tmp_path, protocol):
    _write_log(tmp_path / "t", [{"protocol": protocol | {"minWriterVersion": 7}}, _meta([{"name": "id", "type": "long", "nullable": True, "metadata": {}}])])
    with pytest.raises(TableError, match="reader"):
        open_source(spark, "delta", str(tmp_path / "t")).snapshot()


@pytest.mark.parametrize("kind", ["json", "parquet"])
def test_checkpoints_of_version_2(spark, tmp_path, kind):
    """Actions stand in sidecars; the checkpoint names them, and has a name of its own."""
    path = tmp_path / "t"
    field = [{"name": "id", "type": "long", "nullable": True, "metadata": {}}]
    add = lambda i: {"add": {"path": f"f{i}.parquet", "partitionValues": {}, "size": i, "modificationTime": 1, "dataChange": True, "stats": json.dumps({"numRecords": i})}}
    protocol = {"protocol": {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["v2Checkpoint"], "writerFeatures": ["v2Checkpoint"]}}
    _write_log(path, [protocol, _meta(field), add(1), add(2), add(3)], [{"remove": {"path": "f2.parquet", "dataChange": True}}], [add(4), {"commitInfo": {"timestamp": 77}}])
    log = path / "_delta_log"
    adds = spark.createDataFrame([(add(i)["add"],) for i in (1, 3)], "add struct<path:string,partitionValues:map<string,string>,size:bigint,modificationTime:bigint,stats:string>")
    adds.coalesce(1).write.parquet(str(tmp_path / "side"))
    (log / "_sidecars").mkdir()
    next((tmp_path / "side").glob("*.parquet")).rename(log / "_sidecars" / "s1.parquet")
    name = f"{1:020d}.checkpoint.80a083e8-7026.{kind}"
    top = [json.dumps(protocol), json.dumps(_meta(field)), json.dumps({"sidecar": {"path": "s1.parquet", "sizeInBytes": 5, "modificationTime": 1}}), json.dumps({"checkpointMetadata": {"version": 1}})]
    if kind == "json":
        (log / name).write_text("\n".join(top) + "\n")
    else:
        (tmp_path / "top.json").write_text("\n".join(top))
        shape = "protocol struct<minReaderVersion:int,minWriterVersion:int,readerFeatures:array<string>>, metaData struct<id:string,schemaString:string,partitionColumns:array<string>,configuration:map<string,string>>, sidecar struct<path:string,sizeInBytes:bigint>, checkpointMetadata struct<version:bigint>"
        spark.read.schema(shape).json(str(tmp_path / "top.json")).coalesce(1).write.parquet(str(tmp_path / "top"))
        next((tmp_path / "top").glob("*.parquet")).rename(log / name)
    (log / "_last_checkpoint").write_text(json.dumps({"version": 1, "size": 5, "v2Checkpoint": {"path": name}}))
    for v in (0, 1):
        (log / f"{v:020d}.json").unlink()
    source = open_source(spark, "delta", str(path))
    assert sorted(r.record_count for r in source.snapshot().files.collect()) == [1, 3, 4] and source.history() == [("2", 77)]
    (log / "_sidecars" / "s1.parquet").unlink()
    with pytest.raises(Exception):
        source.snapshot().files.count()
