import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import frequent, joins


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def asof_brute(left, right):
    out = []
    for k, t, i in left:
        fit = [(rt, r) for rk, rt, r in right if rk == k and k is not None and t is not None and rt is not None and rt <= t]
        out.append((i, max(fit)[1] if fit else None))
    return sorted(out, key=str)


keys, times = st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(0, 200_000))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(keys, times), max_size=12), st.lists(st.tuples(keys, times), max_size=12))
def test_asof_against_brute_force(spark, left, right):
    left = [(k, t, i) for i, (k, t) in enumerate(left)]
    right = [(k, t, i) for i, (k, t) in enumerate(right)]
    a = spark.createDataFrame(left, "k int, s long, i int").withColumn("t", F.timestamp_seconds("s")).drop("s")
    b = spark.createDataFrame(right, "k int, s long, r int").withColumn("u", F.timestamp_seconds("s")).drop("s")
    for bucket in (None, "day"):
        out = joins.asof_join(a, b, ["k"], "t", "u", tie=["r"], bucket=bucket).select("i", "r")
        assert rows(out) == asof_brute(left, right)


def test_asof_rejects_clashes(spark):
    a = spark.createDataFrame([(1, 1)], "k int, t int")
    with pytest.raises(ValueError):
        joins.asof_join(a, a, ["k"], "t", "t")
    with pytest.raises(ValueError):
        joins.asof_join(a, a.withColumnRenamed("t", "u"), ["k"], "t", "u", how="full")


def test_any_joins(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, a string")
    b = spark.createDataFrame([(1, 5), (1, 4), (3, 1)], "k int, b int")
    left = joins.any_join(a, b, ["k"], "left", [F.col("b")])
    assert rows(left) == [(1, "x", 4), (1, "y", 4), (2, "z", None)]
    assert [(r["k"], r["b"]) for r in joins.any_join(a, b, ["k"], "inner", [F.col("b")]).collect()] == [(1, 4)]


def test_interval_join_against_all_pairs(spark):
    rnd = random.Random(1)
    points = [(i, rnd.uniform(-50, 50)) for i in range(60)]
    spans = [(i, lo := rnd.uniform(-60, 50), lo + rnd.choice([0, 1, 40])) for i in range(30)] + [(99, 5.0, 1.0)]
    out = joins.interval_join(spark.createDataFrame(points, "i int, x double"), spark.createDataFrame(spans, "j int, lo double, hi double"), "x", "lo", "hi", width=7.0)
    assert rows(out.select("i", "j")) == sorted([(i, j) for i, x in points for j, lo, hi in spans if lo <= x <= hi], key=str)


def test_sample_partitions_the_rows(spark):
    df = spark.range(3000)
    parts = [joins.sample(df, 0.25, "id", k / 4) for k in range(4)]
    assert sum(p.count() for p in parts) == 3000 and parts[0].intersect(parts[1]).count() == 0


def test_broadcast_only_of_small_sides(spark):
    assert "broadcast" in joins.broadcast_if_small(spark.range(10))._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in joins.broadcast_if_small(spark.range(10), most=1)._jdf.queryExecution().logical().toString().lower()


def test_frequent_values_skip_nulls_and_break_ties(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("a", 2), ("a", 3), ("b", 3)], "g string, v int")
    assert {r["g"]: r["top"] for r in frequent.top_k(df, "v", 2, ["g"]).collect()} == {"a": [1, 2], "b": [3]}
    assert frequent.top_k(df, "v", 2).first()["top"] == [1, 3] and frequent.bottom_k(df, "v", 1).first()["bottom"] == [2]
    assert frequent.top_sum(df, "v", 1).first()["top"] == [3] and frequent.bottom_sum(df, "v", 2).first()["bottom"] == [1, 2]


def test_left_interval_join_keeps_rows_without_a_match(spark):
    point = spark.createDataFrame([(5.0,), (None,)], "x double")
    assert rows(joins.interval_join(point, spark.createDataFrame([(6.0, 7.0)], "lo double, hi double"), "x", "lo", "hi", 10.0, how="left")) == [(5.0, None, None), (None, None, None)]
    rnd = random.Random(3)
    points = [(i, i % 3, rnd.uniform(-5000, 5000)) for i in range(80)] + [(80, 1, None), (81, None, 1.0), (82, 0, float("inf"))]
    spans = [(i, i % 3, lo := rnd.uniform(-5000, 5000), lo + rnd.choice([0.0, 1.0, 7.9, 900.0, 1e6])) for i in range(40)] + [(90, 0, 1.0, float("inf")), (91, 1, float("-inf"), float("inf")), (92, 1, None, 3.0)]
    spans += [(90, 0, 1.0, float("inf"))]  # a repeated row
    left, right = spark.createDataFrame(points, "i int, g int, x double"), spark.createDataFrame(spans, "j int, g int, lo double, hi double")
    for how in ("inner", "left"):
        want = []
        for i, g, x in points:
            hit = [j for j, h, lo, hi in spans if g == h and g is not None and x is not None and lo is not None and lo <= x <= hi]
            want += [(i, j) for j in hit] or ([(i, None)] if how == "left" else [])
        assert rows(joins.interval_join(left, right, "x", "lo", "hi", 7.0, ["g"], how).select("i", "j")) == sorted(want, key=str)
