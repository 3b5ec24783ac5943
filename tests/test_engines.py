import datetime

from pyspark.sql import functions as F

from tessera import engines


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_replacing_ties_go_to_the_sequence(spark):
    df = spark.createDataFrame([(1, 1, "a", 0), (1, 1, "b", 1), (2, 5, "c", 2), (2, 4, "d", 3)], "k int, v int, x string, n int")
    assert rows(engines.final(df, engines.replacing_merge_tree("v"), ["k"], sequence="n")) == [(1, 1, "b", 1), (2, 5, "c", 2)]


def test_replacing_hides_deleted(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 0)], "k int, v int, gone int")
    assert rows(engines.final(df, engines.replacing_merge_tree("v", "gone"), ["k"])) == [(2, 1, 0)]


def test_replacing_with_types_that_have_no_order(spark):
    df = spark.createDataFrame([(1, 1, {"a": 1}), (1, 2, {"b": 2})], "k int, v int, m map<string,int>")
    assert engines.final(df, engines.replacing_merge_tree("v"), ["k"]).first()["m"] == {"b": 2}


def test_summing_keeps_types_and_drops_zeros(spark):
    df = spark.createDataFrame([(1, 2, "a"), (1, 3, "a"), (2, 4, "b"), (2, -4, "b")], "k int, n int, s string")
    out = engines.final(df, engines.summing_merge_tree(), ["k"])
    assert rows(out) == [(1, 5, "a")] and out.schema["n"].dataType.simpleString() == "int"


def test_collapsing(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, -1, 1), (1, 1, 2), (2, 1, 0), (2, -1, 1)], "k int, sign int, n int")
    assert rows(engines.final(df, engines.collapsing_merge_tree("sign"), ["k"], sequence="n")) == [(1, 1, 2)]


def test_aggregating_merges_sketches(spark):
    df = spark.createDataFrame([(1, i) for i in range(50)] + [(1, i) for i in range(25, 75)], "k int, v int")
    parts = df.groupBy("k", (F.col("v") % 3).alias("p")).agg(F.hll_sketch_agg("v").alias("u"), F.sum("v").alias("s")).drop("p")
    out = engines.final(parts, engines.aggregating_merge_tree(), ["k"], merge={"u": "uniq", "s": "sum"}).select(F.hll_sketch_estimate("u").alias("n"), "s").first()
    assert abs(out["n"] - 75) <= 2 and out["s"] == sum(range(50)) + sum(range(25, 75))


def test_graphite_rolls_up_by_age(spark):
    at = lambda m, s=0: datetime.datetime(2024, 1, 1, 0, m, s)
    df = spark.createDataFrame([("a", at(0, 10), 1.0, 1), ("a", at(0, 50), 3.0, 1), ("a", at(59, 10), 5.0, 1), ("a", at(59, 50), 7.0, 1), ("a", at(59, 50), 9.0, 2)], "path string, time timestamp, value double, version int")
    engine = engines.graphite_merge_tree(rules=[(0, 1), (1800, 60)])
    out = engines.final(df, engine, ["path", "time"], now=F.lit("2024-01-01 01:00:00").cast("timestamp"))
    assert sorted((r["time"].minute, r["time"].second, r["value"]) for r in out.collect()) == [(0, 0, 2.0), (59, 10, 5.0), (59, 50, 9.0)]


def test_other_engines_show_what_is_stored(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    assert engines.final(df, engines.merge_tree(), ["k"]).count() == 2
    assert engines.final(df, engines.replicated(engines.replacing_merge_tree("k")), ["k"]).count() == 1


def test_optimize_writes_merged_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    engines.optimize(df, engines.replacing_merge_tree("v"), ["k"], str(tmp_path / "o"))
    assert rows(spark.read.parquet(str(tmp_path / "o"))) == [(1, 2)]


def test_prepared_join_side(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, x string")
    once = engines.prepared(df, engines.join_engine("ANY", "LEFT", "k"))
    assert once.count() == 2 and once.is_cached and engines.prepared(df, engines.join_engine("ALL", "LEFT", "k")).count() == 3
    once.unpersist()


def test_defaults_for_nulls(spark):
    df = spark.createDataFrame([(None, None, None, None, 5)], "n int, s string, a array<int>, b boolean, m int")
    assert tuple(engines.fill_defaults(df).first()) == (0, "", [], False, 5)
    assert tuple(engines.fill_defaults(df, "n").first()) == (0, None, None, None, 5)
