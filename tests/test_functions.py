"""Paths, schemas, bounds, the Avro codec and sync state: no Spark jobs but where an independent reader needs one."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tidewater.functions import avro, bounds, paths, schemas, stores
from tidewater.model import SyncState, TableError, all_fields, field_by_path, from_iso, parse_format, read_state, state_properties, to_iso


def test_format_names():
    assert parse_format(" Delta ") == "DELTA"
    with pytest.raises(TableError):
        parse_format("csv")


def test_field_lookup_exact_then_folded(spark):
    s = T.StructType.fromDDL("a int, A string, n struct<X:int,y:struct<z:date>>")
    assert field_by_path(s, "A").dataType == T.StringType()
    assert field_by_path(s, "N.x").dataType == T.IntegerType()
    assert field_by_path(s, "n.y.z").dataType == T.DateType()
    assert field_by_path(s, "n.q") is None and field_by_path(s, "a.b") is None
    assert [p for p, _ in all_fields(s)] == ["a", "A", "n", "n.X", "n.y", "n.y.z"]


def test_state_both_forms_and_fallbacks():
    state = SyncState(1_700_000_000_123, "DELTA", "7", (5,))
    props = state_properties(state)
    assert read_state(props) == state
    assert json.loads(props["XTABLE_METADATA"])["instantsToConsiderForNextSync"] == ["1970-01-01T00:00:00.005Z"]
    assert read_state(props | {"XTABLE_METADATA": "{bad"}) == SyncState(state.instant, "DELTA")
    assert read_state(props | {"XTABLE_METADATA": '{"lastInstantSynced":"2020-01-01T00:00:00Z","version":9}'}) == SyncState(state.instant, "DELTA")
    assert read_state({}) is None and read_state({"xtable_last_instant_synced": "x"}) is None
    assert to_iso(1000) == "1970-01-01T00:00:01Z" and from_iso("1970-01-01T00:00:01.5Z") == 1500
    with pytest.raises(TableError):
        from_iso("1970-01-01T00:00:01.0005Z")


def test_metadata_paths():
    for p in ("_delta_log/1.parquet", ".hoodie/x", "metadata/v1.parquet", "a/schema/x.parquet", "snapshot/1", "manifest/m"):
        assert paths.is_metadata_path(p), p
    for p in ("region=metadata/x.parquet", "a/b.parquet", "metadata2/x.parquet"):
        assert not paths.is_metadata_path(p), p


def test_relative_paths():
    assert paths.relative("s3a://b/t/x/1.parquet", "s3://b/t") == "x/1.parquet"
    assert paths.relative("file:///t/a", "/t") == "a"
    assert paths.relative("wasbs://c@a.blob.core.windows.net/t/f", "abfss://c@a.dfs.core.windows.net/t/") == "f"
    for bad in ("/table2/f", "/table", "s3://other/table/f"):
        with pytest.raises(TableError):
            paths.relative(bad, "/table")
    assert paths.resolve("a%20b/c.parquet", "/t") == "/t/a b/c.parquet"
    assert paths.resolve("abfss://c@a/x", "/t") == "abfss://c@a/x"


def test_partition_types():
    of = lambda *v: schemas.partition_type(v)
    assert of("1", "-2") == T.LongType() and of("1", "2.5") == T.DoubleType()
    assert of("2024-01-31") == T.DateType() and of("2024-13-01") == T.StringType()
    assert of("1", None) == T.StringType() and of("") == T.StringType() and of() == T.StringType()


def test_merge_of_generations(spark):
    old, new = T.StructType.fromDDL("id bigint, name string, s struct<a:int>"), T.StructType.fromDDL("id bigint, name string, s struct<a:int,b:int>, score double")
    old["id"].nullable = new["id"].nullable = False
    merged = schemas.merge([("new", new), ("old", old)])
    assert merged.fieldNames() == ["id", "name", "s", "score"]
    assert not merged["id"].nullable and merged["score"].nullable and merged["s"].dataType["b"].nullable
    with pytest.raises(TableError, match="bigint in new but int in old"):
        schemas.merge([("new", new), ("old", T.StructType.fromDDL("id int"))])


FULL = ("b boolean, i int, l bigint, f float, d double, s string, x binary, day date, t timestamp, n timestamp_ntz, c decimal(10,2), a array<struct<p:int,q:array<string>>>, m map<string,struct<v:double>>, r struct<u:string,w:struct<z:int>>")


def test_schemas_round_trip(spark):
    full = T.StructType.fromDDL(FULL)
    plain = lambda s: json.loads(s.json().replace('"metadata":{}', '"metadata":{}'))

    def bare(kind):
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name, bare(f.dataType), f.nullable) for f in kind])
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(bare(kind.elementType), kind.containsNull)
        if isinstance(kind, T.MapType):
            return T.MapType(bare(kind.keyType), bare(kind.valueType), kind.valueContainsNull)
        return kind

    assert plain(schemas.from_delta(schemas.to_delta(full))) == plain(full)
    for out in (schemas.from_iceberg(schemas.to_iceberg(full)[0]), schemas.from_avro(schemas.to_avro(full, "t", "n")), schemas.from_paimon(schemas.to_paimon(full, []))):
        assert bare(out) == full


def test_iceberg_ids_are_kept_and_never_meet():
    s = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType(), metadata={"field_id": 1}), T.StructField("c", T.ArrayType(T.LongType()))])
    out, last = schemas.to_iceberg(s)
    ids = [out["fields"][0]["id"], out["fields"][1]["id"], out["fields"][2]["id"], out["fields"][2]["type"]["element-id"]]
    assert ids[1] == 1 and len(set(ids)) == 4 and last == max(ids)
    again, _ = schemas.to_iceberg(schemas.from_iceberg(out))
    assert again == out
    assert schemas.name_mapping(out)[2] == {"field-id": ids[2], "names": ["c"], "fields": [{"field-id": ids[3], "names": ["element"]}]}


def test_unknown_types_are_errors_unless_lenient():
    for read, what in ((schemas.from_iceberg, {"fields": [{"id": 1, "name": "a", "required": False, "type": "geometry"}]}), (schemas.from_paimon, {"fields": [{"id": 1, "name": "a", "type": "MULTISET"}]})):
        with pytest.raises(TableError):
            read(what)
        assert read(what, True)["a"].dataType == T.StringType()


@pytest.mark.parametrize("kind,text", [("boolean", "true"), ("int", "-5"), ("bigint", "9999999999"), ("float", "1.5"), ("double", "-2.25"), ("string", "é"), ("date", "1969-12-31"), ("timestamp_ntz", "2024-01-01T00:00:00.000001"), ("decimal(10,2)", "-1.23"), ("binary", "00ff")])
def test_bounds_round_trip(spark, kind, text):
    k = T.StructType.fromDDL(f"c {kind}")["c"].dataType
    assert bounds.decode(k, bounds.encode(k, text, True)) == text


def test_bounds_that_are_none():
    d = T.DoubleType()
    assert bounds.encode(d, "nan", True) is None and bounds.encode(T.IntegerType(), "1.5", True) is None
    assert math.copysign(1, float(bounds.decode(d, bounds.encode(d, "0.0", True)))) == -1
    assert math.copysign(1, float(bounds.decode(d, bounds.encode(d, "-0.0", False)))) == 1
    assert bounds.decode(T.IntegerType(), b"\x00") is None and bounds.decode(T.LongType(), b"\x01\x00\x00\x00") == "1"


SHAPE = {"type": "record", "name": "r", "fields": [{"name": "i", "type": "long", "field-id": 3}, {"name": "s", "type": ["null", "string"], "default": None}, {"name": "a", "type": {"type": "array", "items": "bytes"}}, {"name": "m", "type": {"type": "map", "values": "double"}}, {"name": "b", "type": "boolean"}]}
ROW = st.fixed_dictionaries({"i": st.integers(-(2**63), 2**63 - 1), "s": st.none() | st.text(), "a": st.lists(st.binary()), "m": st.dictionaries(st.text(), st.floats(allow_nan=False)), "b": st.booleans()})


@settings(deadline=None, max_examples=60)
@given(st.lists(ROW, max_size=20))
def test_avro_round_trip(rows):
    meta, back = avro.load(avro.dump(SHAPE, rows, {"k": "v"}))
    assert back == rows and meta["k"] == "v" and json.loads(meta["avro.schema"])["fields"][0]["field-id"] == 3


def test_avro_against_the_jvm(spark, tmp_path):
    rows = [{"i": i, "s": None if i % 2 else f"é{i}", "a": [b"x"] * (i % 3), "m": {"k": i / 2}, "b": i % 2 == 0} for i in range(9000)]
    (tmp_path / "f.avro").write_bytes(avro.dump(SHAPE, rows))
    jvm = spark.sparkContext._jvm
    reader = jvm.org.apache.avro.file.DataFileReader(jvm.java.io.File(str(tmp_path / "f.avro")), jvm.org.apache.avro.generic.GenericDatumReader())
    n = 0
    while reader.hasNext():
        r = reader.next()
        if n < 50:
            assert r.get("i") == n and (r.get("s") is None) == bool(n % 2)
        n += 1
    assert n == 9000


def test_avro_refuses_damage():
    data = avro.dump(SHAPE, [{"i": 1, "s": "x", "a": [], "m": {}, "b": True}])
    with pytest.raises(ValueError):
        avro.load(b"no" + data)
    with pytest.raises((ValueError, EOFError)):
        avro.load(data[:-3])


def test_stores_by_hadoops_names():
    """Settings of a bucket come before those of all; schemes of one store are one."""
    known = {"fs.s3a.access.key": "a", "fs.s3a.secret.key": "b", "fs.s3a.bucket.own.access.key": "c", "fs.s3a.endpoint": "http://127.0.0.1:9000", "fs.s3a.path.style.access": "true", "fs.azure.account.key.acc.dfs.core.windows.net": "k"}
    s3 = {"access_key": "a", "secret_key": "b", "endpoint_override": "127.0.0.1:9000", "scheme": "http", "force_virtual_addressing": False}
    assert stores.arguments("s3a://other/x y%20/z.parquet", known) == ("s3", s3, "other/x y%20/z.parquet")
    assert stores.arguments("s3n://own/z", known) == ("s3", s3 | {"access_key": "c"}, "own/z")
    azure = ("azure", {"account_name": "acc", "account_key": "k"}, "box/a/b")
    assert stores.arguments("wasbs://box@acc.blob.core.windows.net/a/b", known) == stores.arguments("abfss://box@acc.dfs.core.windows.net/a/b", known) == azure
    assert stores.arguments("abfs://box@free.dfs.core.windows.net/a", known)[1] == {"account_name": "free"}
    assert stores.arguments("gs://box/a", known) == ("gcs", {}, "box/a")
    assert stores.arguments("file:///a b/c%", known) == stores.arguments("/a b/c%", known) == ("local", {}, "/a b/c%")
    system, path = stores.open_store("s3a://other/x", known)
    assert system.type_name == "s3" and path == "other/x"


def test_settings_of_the_session_reach_workers(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    names = ["fs.s3a.access.key", "fs.s3a.bucket.own.secret.key", "fs.azure.account.key.acc.dfs.core.windows.net"]
    for k in names:
        conf.set(k, f"of {k}")
    try:
        found = stores.settings(spark)
        assert {k: found[k] for k in names} == {k: f"of {k}" for k in names}
        assert not any("hadoop" in k or "yarn" in k for k in found)
    finally:
        for k in names:
            conf.unset(k)
