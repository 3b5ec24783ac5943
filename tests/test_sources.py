import datetime
import http.server
import os
import threading
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import engines, scratch
from tessera.sources import dml, external
from tessera.sources.dictionary import dictionary
from tessera.streaming import incremental
from tessera.table import table
from tessera.types import created_at, t


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("fmt", ["CSVWithNames", "TSV", "JSONEachRow", "Parquet", "ORC"])
def test_formats_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a,b\t"), (2, None)], "k int, s string")
    external.write(df, str(tmp_path / fmt), fmt)
    assert rows(external.file(spark, str(tmp_path / fmt), fmt, "k Int32, s Nullable(String)")) == rows(df)


def test_other_formats(spark, tmp_path):
    (tmp_path / "c.json").write_text('[1, "a"]\n[2, null]\n')
    assert rows(external.read(spark, str(tmp_path / "c.json"), "JSONCompact", {"k": "Int32", "s": "String"})) == [(1, "a"), (2, None)]
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f, pa.ipc.new_file(f, pa.schema([("k", pa.int64())])) as w:
        w.write_table(pa.table({"k": [1, 2]}))
    assert rows(external.read(spark, str(tmp_path / "x.arrow"), "Arrow")) == [(1,), (2,)]
    with pytest.raises(ValueError):
        external.read(spark, "x", "CSV")
    with pytest.raises(ValueError):
        external.read(spark, "x", "Native")
    external.write(spark.range(3), "", "Null")


def test_gzip(spark, tmp_path):
    external.write(spark.range(5), str(tmp_path / "z"), "JSONEachRow", compression="gzip")
    assert list((tmp_path / "z").glob("*.gz")) and external.read(spark, str(tmp_path / "z"), "JSONEachRow", {"id": "Int64"}).count() == 5


def test_url(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,s\n1,x\n")
    handler = lambda *a: http.server.SimpleHTTPRequestHandler(*a, directory=str(tmp_path))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        out = external.url(spark, f"http://127.0.0.1:{server.server_port}/a.csv", columns="k Int32, s String")
        assert rows(out) == [(1, "x")]
    finally:
        server.shutdown()


def test_options_of_remote_sources():
    made = external.jdbc_options("postgresql", "h", "d", "t", "u", "p", numPartitions=4)
    assert made["url"] == "jdbc:postgresql://h:5432/d" and made["numPartitions"] == "4"
    from tessera.streaming.incremental import kafka_options

    assert kafka_options(engines.kafka_engine("b:9092", "topic", "g"), max_offsets=10)["maxOffsetsPerTrigger"] == "10"


def test_generated_tables(spark):
    assert [r["number"] for r in external.numbers(spark, 3, 5).collect()] == [5, 6, 7]
    shape = "a Int32, s String, d Float64, xs Array(Int8), t DateTime, b Bool, m Map(String, Int16)"
    one, two = (external.generate_random(spark, shape, 50, seed=3) for _ in range(2))
    assert one.collect() == two.collect() and one.schema["xs"].dataType.simpleString() == "array<tinyint>"
    assert external.generate_random(spark, shape, 50, seed=4).collect() != one.collect()
    assert rows(external.values(spark, [(1, "a")], "k Int32, s String")) == [(1, "a")]


@pytest.fixture
def spec(tmp_path):
    columns = {"id": t.uuid().auto_generate(7).primary_key(), "kind": t.enum8(["a", "b"]).default("a"), "n": t.uint8().default(1), "note": t.string().nullable(), "createdAt": created_at("created_at"), "twice": t.int32().materialized("n * 2"), "loud": t.string().nullable().alias("upper(note)")}
    return table("things", columns, order_by="id", path=str(tmp_path / "things"), append_only=False)


def test_insert_fills_defaults(spark, spec):
    out = dml.insert(spark, spec).values([{"note": "x"}, {"kind": "b", "n": 7}]).returning().execute()
    stored = spec.read(spark).collect()
    assert sorted(r["n"] for r in stored) == [1, 7] and sorted(r["twice"] for r in stored) == [2, 14] and {r["loud"] for r in stored} == {"X", None}
    assert sorted(r["id"] for r in out.collect()) == sorted(r["id"] for r in stored) and all(r["id"][14] == "7" for r in stored) and all(isinstance(r["created_at"], datetime.datetime) for r in stored)


def test_insert_checks_values(spark, spec):
    for bad in ({"kind": "z"}, {"n": 256}, {"n": -1}):
        with pytest.raises(Exception, match="allowed|range"):
            dml.insert(spark, spec).values(bad).execute()
    with pytest.raises(ValueError):
        dml.insert(spark, spec).values({"nope": 1}).execute()
    dml.insert(spark, spec).skip_validation().values({"kind": "z"}).execute()
    assert spec.read(spark).count() == 1


def test_insert_of_a_frame(spark, spec):
    out = dml.insert(spark, spec).values(spark.createDataFrame([(3,), (4,)], "n int")).returning().execute()
    assert sorted(r["id"] for r in out.collect()) == sorted(r["id"] for r in spec.read(spark).collect())


def test_insert_many_and_batcher(spark, spec):
    assert dml.insert_many(spark, spec, ({"n": i} for i in range(25)), block=10) == 25
    with dml.Batcher(spark, spec, rows=3, seconds=1e9) as b:
        for i in range(4):
            b.append({"n": i})
        assert spec.read(spark).count() == 28
    assert spec.read(spark).count() == 29
    assert dml.insert(spark, spec).values({"n": 9}).returning_one()["n"] == 9


def test_update_and_delete(spark, spec):
    dml.insert(spark, spec).values([{"n": 1}, {"n": 2}, {"n": 3, "note": "keep"}]).execute()
    dml.update(spark, spec, {"note": F.concat(F.lit("n"), F.col("n"))}, F.col("note").isNull())
    assert sorted(r["note"] for r in spec.read(spark).collect()) == ["keep", "n1", "n2"]
    dml.delete(spark, spec, "n < 2")
    assert sorted(r["n"] for r in spec.read(spark).collect()) == [2, 3]
    dml.delete(spark, spec, "note = null")  # a null condition deletes nothing
    assert spec.read(spark).count() == 2
    with pytest.raises(Exception, match="allowed"):
        dml.update(spark, spec, {"kind": "z"}, "n = 2")
    assert spec.read(spark).count() == 2


def test_guards(spark, spec, tmp_path):
    from dataclasses import replace

    with pytest.raises(ValueError):
        dml.update(spark, spec, {"n": 1}, None)
    with pytest.raises(ValueError):
        dml.update(spark, spec, {}, "n = 1")
    with pytest.raises(ValueError):
        dml.delete(spark, spec, None)
    with pytest.raises(PermissionError):
        dml.delete(spark, replace(spec, append_only=True), "n = 1")
    with pytest.raises(PermissionError):
        dml.insert(spark, replace(spec, read_only=True))


def test_uuid_versions():
    for kind in ("uuid1", "uuid4", "uuid6", "uuid7"):
        assert dml.generated(kind)[14] == kind[-1]
    assert dml.generated("uuid7")[:8] <= dml.generated("uuid7")[:8]


def test_ip_trie(spark):
    nets = spark.createDataFrame([("10.0.0.0/8", "a"), ("10.1.0.0/16", "b"), ("0.0.0.0/0", "c"), ("10.1.2.3", "d")], "net string, name string")
    asked = spark.createDataFrame([("10.9.9.9",), ("10.1.9.9",), ("10.1.2.3",), ("8.8.8.8",), ("x",), (None,)], "ip string")
    out = dictionary("nets", nets, "net", layout="ip_trie").get(asked, "ip", "name")
    assert {r["ip"]: r["name"] for r in out.collect()} == {"10.9.9.9": "a", "10.1.9.9": "b", "10.1.2.3": "d", "8.8.8.8": "c", "x": None, None: None}


def test_hierarchy(spark):
    tree = spark.createDataFrame([(1, None, "root"), (2, 1, "x"), (3, 2, "y"), (4, 1, "z")], "k int, up int, name string")
    d = dictionary("tree", tree, "k", parent="up")
    asked = spark.createDataFrame([(3,), (1,), (9,)], "id int")
    assert {r["id"]: r["children"] for r in d.get_children(asked, "id").collect()} == {3: [], 1: [2, 4], 9: []}
    assert [{r["id"]: r["ancestor"] for r in d.get_ancestor(asked, "id", n).collect()} for n in (1, 3)] == [{3: 3, 1: 1, 9: None}, {3: 1, 1: None, 9: None}]
    assert tuple(asked.select(d.literal(F.col("id"), "name", "none").alias("x")).toPandas()["x"]) == ("y", "root", "none")
    assert d.to_sql().startswith("CREATE DICTIONARY tree")
    with pytest.raises(ValueError):
        dictionary("d", tree, "k", layout="range_hashed")
    with pytest.raises(ValueError):
        dictionary("d", tree, "nope")


def test_missing_default_differs_from_null_value(spark):
    d = dictionary("d", spark.createDataFrame([(1, None), (2, "b")], "k int, v string"), "k")
    out = d.get_or_default(spark.createDataFrame([(1,), (3,)], "id int"), "id", "v", "none")
    assert {r["id"]: r["v"] for r in out.collect()} == {1: None, 3: "none"}


def test_times_of_inserts(spark, tmp_path):
    at = table("times", {"id": t.int32(), "at": t.datetime(), "many": t.array(t.datetime())}, order_by="id", path=str(tmp_path / "times"))
    flat = table("flat", {"id": t.int32(), "at": t.datetime()}, order_by="id", path=str(tmp_path / "flat"))
    now = datetime.datetime(2024, 5, 6, 7, 8, 9)
    dml.insert(spark, flat).values({"id": 1, "at": now}).execute()
    dml.insert(spark, at).values({"id": 1, "at": now, "many": [now]}).execute()
    assert flat.read(spark).first()["at"] == at.read(spark).first()["at"] == at.read(spark).first()["many"][0] == now


def test_batcher_writes_what_is_old(spark, spec):
    b = dml.Batcher(spark, spec, rows=1000, seconds=0.2)
    b.append({"n": 1})
    for _ in range(100):
        time.sleep(0.1)
        if os.path.exists(spec.path) and spec.read(spark).count() == 1:
            break
    assert spec.read(spark).count() == 1
    b.seconds = 0.05
    b.append({"nothing": 1})
    time.sleep(1)
    with pytest.raises(ValueError, match="nothing"):
        b.append({"n": 2})


def test_ip_trie_of_both_versions(spark):
    import ipaddress

    nets = ["10.0.0.0/8", "10.1.0.0/16", "192.168.1.7", "2001:db8::/32", "2001:db8:1::/48", "::1", "fe80::1:2/128", "::ffff:172.16.0.0/108", "junk/8"]
    asked = ["10.1.2.3", "10.2.0.1", "192.168.1.7", "2001:db8::5", "2001:DB8:1:0::9", "::1", "fe80::1:2", "172.16.5.5", "::ffff:10.2.0.1", "8.8.8.8", "1::2::3", "12345::", "x", "1:2:3", None]
    d = dictionary("nets", spark.createDataFrame([(n, n) for n in nets], "net string, name string"), "net", layout="ip_trie")

    def number(text):
        a = ipaddress.ip_address(text)
        return int(a) if a.version == 6 else int(a) + (0xFFFF << 32)

    def best(ip):
        try:
            at = number(ip)
        except ValueError:
            return None
        held = []
        for n in nets[:-1]:
            net, _, size = n.partition("/")
            bits = (int(size) if size else 128 if ":" in net else 32) + (0 if ":" in net else 96)
            if number(net) >> (128 - bits) == at >> (128 - bits):
                held.append((bits, n))
        return max(held)[1] if held else None

    out = d.get(spark.createDataFrame([(i,) for i in asked], "ip string"), "ip", "name")
    assert {r["ip"]: r["name"] for r in out.collect()} == {i: None if i is None else best(i) for i in asked}


def test_formats_of_messages(spark):
    raw = lambda *v: spark.createDataFrame([(x.encode(),) for x in v], "value binary")
    got = lambda m, f: [tuple(r) for r in incremental.messages(m, "a Int32, b String", f).collect()]
    assert got(raw('{"a": 1, "b": "x"}', "junk"), "JSONEachRow") == [(1, "x"), (None, None)]
    assert got(raw('[1, "x"]'), "JSONCompactEachRow") == [(1, "x")] and got(raw("1,x"), "CSV") == [(1, "x")] and got(raw("1\tx"), "TSV") == [(1, "x")]
    assert [tuple(r) for r in incremental.messages(raw("line"), "a String", "LineAsString").collect()] == [("line",)]
    with pytest.raises(ValueError, match="Protobuf"):
        incremental.messages(raw("x"), "a Int32", "Protobuf")


def test_a_folder_that_all_share_is_needed_off_one_machine(spark):
    from types import SimpleNamespace

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://there", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_dir(fake)
    assert scratch.exists(spark, scratch.application_dir(spark))


def test_arrays_without_nulls(spark, tmp_path):
    spec = table("tagged", {"n": t.int32(), "tags": t.array(t.string())}, order_by="n", path=str(tmp_path / "tagged"))
    dml.insert(spark, spec).values(spark.createDataFrame([(1, ["a"])], "n int, tags array<string>")).execute()
    assert rows(spec.read(spark)) == [(1, ["a"])]
    with pytest.raises(Exception, match="a null in an array"):
        dml.insert(spark, spec).values(spark.createDataFrame([(1, ["a", None])], "n int, tags array<string>")).execute()


def test_kept_expressions_draw_defaults_anew(spark, tmp_path):
    spec = table("drawn", {"id": t.int64(), "tag": t.string().default_sql("uuid()"), "label": t.string().default([1])}, order_by="id", path=str(tmp_path / "drawn"))
    for n in range(2):
        dml.insert(spark, spec).values([{"id": n, "label": "x"}, {"id": n + 10}]).execute()
    rows = spec.read(spark).collect()
    assert len({r["tag"] for r in rows}) == 4
    assert sorted(r["label"] for r in rows) == ["[1]", "[1]", "x", "x"]
    with pytest.raises(ValueError, match="other"):
        dml.insert(spark, spec).values([{"id": 1, "other": 2}]).execute()
