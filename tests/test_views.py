import pytest
from pyspark.sql import functions as F

from tessera import engines
from tessera.plans import views
from tessera.streaming import incremental


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("a", "x", 4)], "shop string, item string, n int")


def test_views(spark, sales):
    views.view(spark, "sales_view", sales.where("n > 1"))
    assert spark.table("sales_view").count() == 3


def per_shop(df):
    return df.groupBy("shop").agg(F.sum("n").alias("n"))


def test_incremental_equals_full(spark, sales, tmp_path):
    inc = views.materialized_view("v", per_shop, target=str(tmp_path / "inc"), group_by=["shop"])
    for k in (1, 2):
        inc.apply(sales.where(f"n % 2 = {k % 2}"))
    assert rows(inc.read(spark)) == rows(per_shop(sales))
    full = views.materialized_view("v", per_shop, target=str(tmp_path / "full"), group_by=["shop"], populate_from=sales)
    assert rows(full.read(spark)) == rows(per_shop(sales)) and "TO" in full.sql()


def test_a_batch_counts_once(spark, sales, tmp_path):
    v = views.materialized_view("v", per_shop, target=str(tmp_path / "v"), group_by=["shop"])
    for batch in (0, 0, 1):
        v.apply(sales, batch)
    assert rows(v.read(spark)) == [("a", 14), ("b", 6)]


def test_back_fill_and_batches_add_up(spark, tmp_path):
    rows = lambda *v: spark.createDataFrame(list(v), "k string, n long")
    made = lambda d: d.groupBy("k").agg(F.sum("n").alias("n"))
    view = views.materialized_view("v", made, target=str(tmp_path / "mv"), group_by=["k"], populate_from=rows(("a", 1), ("b", 2)))
    for apply in (lambda r: view.apply(r, 0), lambda r: view.apply(r, 0), view.apply, view.apply):
        apply(rows(("a", 1), ("b", 2)))
    assert {r["k"]: r["n"] for r in view.read(spark).collect()} == {"a": 4, "b": 8}
    view.refresh(rows(("c", 5)))
    assert {r["k"]: r["n"] for r in view.read(spark).collect()} == {"c": 5}
    view.populate(rows())
    assert view.read(spark).count() == 0


def test_maintained_by_a_stream(spark, sales, tmp_path):
    v = views.materialized_view("v", per_shop, target=str(tmp_path / "v"), group_by=["shop"])
    for k in (0, 1):
        sales.where(f"n % 2 = {k}").write.mode("append").parquet(str(tmp_path / "in"))
        stream = incremental.file_stream(spark, str(tmp_path / "in"), {"shop": "String", "item": "String", "n": "Int32"})
        incremental.maintain(v, stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert rows(v.read(spark)) == rows(per_shop(sales))


def test_routing(spark, sales, tmp_path):
    p = views.projection("p", ["shop", "item"], {"n": ("sum", "n"), "k": ("count", "*")}).build(sales, str(tmp_path / "p"))
    out = views.route(sales, [p], ["shop"], {"total": ("sum", "n"), "rows": ("count", "*")})
    assert rows(out) == [("a", 7, 3), ("b", 3, 1)] and str(tmp_path / "p") in out.inputFiles()[0]
    miss = views.route(sales, [p], ["shop"], {"top": ("max", "n")})
    assert rows(miss) == [("a", 4), ("b", 3)]
    kept = views.route(sales, [p], ["shop"], {"total": ("sum", "n")}, F.col("item") == "x", ["item"])
    assert rows(kept) == [("a", 5), ("b", 3)]
    assert "GROUP BY shop, item" in views.to_projection_definition(p)["query"]
    with pytest.raises(ValueError):
        views.projection("q", ["shop"], {"m": ("median", "n")})


def test_drift(spark, sales):
    assert not views.detect_drift("select  a,b\nfrom t ;", "SELECT a, b FROM t") and views.detect_drift("select 'a'", "select 'A'")
    assert not views.detect_drift(per_shop(sales), per_shop(sales)) and views.detect_drift(per_shop(sales), sales)
    assert views.extract_mv_query("CREATE MATERIALIZED VIEW v TO t AS SELECT 1;") == "SELECT 1"


def test_blue_green_runs(spark, sales):
    sales.write.mode("overwrite").saveAsTable("bg")
    for s in views.blue_green("bg_view", "SELECT shop, sum(n) AS n FROM bg GROUP BY shop", "bg"):
        if not s.startswith("--"):
            spark.sql(s)
    assert rows(spark.table("bg")) == rows(per_shop(sales))
    spark.sql("DROP TABLE bg")


def test_bridge(spark, sales, tmp_path):
    views.migration_bridge(sales, str(tmp_path / "v2"), {"store": "upper(shop)", "amount": F.col("n")})
    assert spark.read.parquet(str(tmp_path / "v2")).columns == ["store", "amount"]
    sales.write.parquet(str(tmp_path / "src"))
    stream = incremental.file_stream(spark, str(tmp_path / "src"), {"shop": "String", "item": "String", "n": "Int32"})
    views.migration_bridge(stream, str(tmp_path / "v2"), {"store": "upper(shop)", "amount": "n"}, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "v2")).count() == 8


def test_event_time_windows(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 00:01:00"), ("a", "2024-01-01 00:04:00"), ("a", "2024-01-01 01:00:00")], "k string, s string").select("k", F.to_timestamp("s").alias("ts"))
    assert sorted(r["n"] for r in incremental.tumbling(df, "ts", "10 minutes", ["k"], {"n": F.count("*")}).collect()) == [1, 2]
    assert incremental.tumbling(df, "ts", "10 minutes", ["k"], {"n": F.count("*")}, slide="5 minutes").count() == 4
    assert incremental.sessions(df, "ts", "5 minutes", ["k"], {"n": F.count("*")}).count() == 2 and incremental.distinct_within(df, "ts", "1 hour", ["k"]).count() == 1
    df.write.parquet(str(tmp_path / "e"))
    late = incremental.tumbling(incremental.file_stream(spark, str(tmp_path / "e"), {"k": "String", "ts": "DateTime"}), "ts", "10 minutes", ["k"], {"n": F.count("*")}, late="5 minutes")
    q = late.writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("late").count() >= 1
    assert engines.kafka_engine("b", "t", "g").option("brokers") == "b"
