"""The reference's operators as queries over the supplied tables, each with DuckDB SQL that gives the same rows.

Sums of money are made on decimals, so that the order of addition does not matter; quotients are rounded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import engines
from tessera.functions import aggregates as A
from tessera.functions import arrays, conditional, conversion, geo, hashing, jsons, maths
from tessera.functions import predicates as P
from tessera.functions import strings as S
from tessera.functions import times as D
from tessera.functions import windows as W
from tessera.operators import frequent, joins
from tessera.plans.query import Query
from tessera.plans.relational import Fetch
from tessera.sources.dictionary import dictionary
from tessera.streaming import incremental
from tessera.table import many, one, table
from tessera.types import t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Callable], Callable]:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str) -> F.Column:
    return F.col(c).cast("decimal(18,2)")


def dsum(c) -> F.Column:
    return F.sum(c).cast("double")


def rounded(c: F.Column, digits: int) -> F.Column:
    """As DuckDB rounds a double: by its multiple as a double, where Spark goes by its decimal digits, so halves may differ."""
    return F.round(c * 10.0**digits) / 10.0**digits


# Specifications of the tables, for the builder and the nested fetch.


def specs(sf_dir: str) -> dict:
    at = lambda n: f"{sf_dir}/{n}.parquet"
    region = table("region", {"r_regionkey": t.int32().primary_key(), "r_name": t.string()}, order_by="r_regionkey", path=at("region"))
    nation = table("nation", {"n_nationkey": t.int32().primary_key(), "n_name": t.string(), "n_regionkey": t.int32()}, order_by="n_nationkey", path=at("nation"))
    customer = table("customer", {"c_custkey": t.int64().primary_key(), "c_name": t.string(), "c_nationkey": t.int32(), "c_acctbal": t.float64(), "c_mktsegment": t.string()}, order_by="c_custkey", path=at("customer"))
    orders = table("orders", {"o_orderkey": t.int64().primary_key(), "o_custkey": t.int64(), "o_orderstatus": t.string(), "o_totalprice": t.float64(), "o_orderpriority": t.string()}, order_by="o_orderkey", path=at("orders"))
    nation = nation.related(region=one(region, ["n_regionkey"], ["r_regionkey"]))
    customer = customer.related(orders=many(orders, ["c_custkey"], ["o_custkey"]), nation=one(nation, ["c_nationkey"], ["n_nationkey"]))
    return {"region": region, "nation": nation, "customer": customer, "orders": orders}


# Relational core.


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity::DECIMAL(18,2)) AS DOUBLE) AS sum_qty, CAST(sum(l_extendedprice::DECIMAL(18,2)) AS DOUBLE) AS sum_base_price,
  CAST(sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2))) AS DOUBLE) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def q1_pricing_summary(spark, sf):
    price = money("l_extendedprice") * (F.lit(1) - money("l_discount"))
    return (
        Query(spark).from_(read(spark, sf, "lineitem"))
        .where(P.lte("l_shipdate", F.lit("1998-09-02").cast("timestamp_ntz")))
        .group_by("l_returnflag", "l_linestatus")
        .select(l_returnflag=F.col("l_returnflag"), l_linestatus=F.col("l_linestatus"), sum_qty=dsum(money("l_quantity")), sum_base_price=dsum(money("l_extendedprice")), sum_disc_price=dsum(price), avg_qty=F.round(A.avg("l_quantity"), 6), count_order=A.count())
        .order_by("l_returnflag", "l_linestatus").df()
    )


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND NOT (o_totalprice BETWEEN 20000 AND 30000) AND o_orderstatus <> 'O' AND o_orderkey > 10")
def filter_between(spark, sf):
    return Query(spark).from_(specs(sf)["orders"]).where(P.between("o_totalprice", 1000.0, 50000.0) & P.not_between("o_totalprice", 20000.0, 30000.0) & P.ne("o_orderstatus", "O") & P.gt("o_orderkey", 10)).select("o_orderkey", "o_totalprice").df()


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0")
def in_list(spark, sf):
    return Query(spark).from_(specs(sf)["customer"]).where(P.in_array("c_mktsegment", ["BUILDING", "MACHINERY"]) & P.gte("c_acctbal", 0.0)).select("cCustkey", "cMktsegment").df()


@query("SELECT n_nationkey, false AS in_none, true AS not_in_none, n_nationkey NOT IN (1, 2) AS not_in_two FROM nation")
def not_in_empty(spark, sf):
    return Query(spark).from_(specs(sf)["nation"]).select(n_nationkey="n_nationkey", in_none=P.in_array("n_nationkey", []), not_in_none=P.not_in_array("n_nationkey", []), not_in_two=P.not_in_array("n_nationkey", [1, 2])).df()


@query("SELECT DISTINCT event_type FROM events")
def distinct_types(spark, sf):
    return Query(spark).from_(read(spark, sf, "events")).select("event_type").distinct().df()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5")
def order_limit_offset(spark, sf):
    return Query(spark).from_(specs(sf)["orders"]).select("o_orderkey", "o_totalprice").order_by(("o_totalprice", "desc"), "o_orderkey").limit(20).offset(5).df()


@query("SELECT CAST((row_number() OVER (ORDER BY n_nationkey) - 1) // 7 AS INTEGER) AS page, n_nationkey, n_name FROM nation")
def cursor_page(spark, sf):
    pages, cursor, number = [], None, 0
    while True:
        rows, cursor = Query(spark).from_(specs(sf)["nation"]).find_many_cursor("n_nationkey", 7, cursor)
        pages += [(number, r["n_nationkey"], r["n_name"]) for r in rows]
        number += 1
        if cursor is None:
            return spark.createDataFrame(pages, "page int, n_nationkey int, n_name string")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 9000 ORDER BY o_orderkey DESC LIMIT 50")
def cursor_page_down(spark, sf):
    return Query(spark).from_(specs(sf)["orders"]).select("o_orderkey", "o_custkey").page("o_orderkey", 50, 9000, descending=True)


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
def where_object(spark, sf):
    return Query(spark).from_(specs(sf)["customer"]).prewhere(P.eq("c_nationkey", 3)).where({"c_mktsegment": "BUILDING"}).select("c_custkey", "c_name").df()


@query("SELECT o_custkey, count(*) AS n, CAST(sum(o_totalprice::DECIMAL(18,2)) AS DOUBLE) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having(spark, sf):
    return Query(spark).from_(specs(sf)["orders"]).group_by("o_custkey").select(o_custkey="o_custkey", n=A.count(), total=dsum(money("o_totalprice"))).having("n > 12").df()


@query("SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS band, event_id + 10 AS shifted FROM events WHERE value > 90 AND event_type = 'purchase'")
def raw_sql_expressions(spark, sf):
    return Query(spark).from_(read(spark, sf, "events")).where(P.sql("value > {} AND event_type = {}", 90, "purchase")).select(event_id="event_id", band=P.raw("CASE WHEN value > 50 THEN 'high' ELSE 'low' END"), shifted=P.sql("{} + {}", F.col("event_id"), 10)).df()


# Joins.


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def join_inner(spark, sf):
    s = specs(sf)
    return Query(spark).from_(s["orders"]).inner_join(s["customer"], s["orders"].o_custkey == s["customer"].c_custkey).where(P.gt("c_acctbal", 5000.0)).select("o_orderkey", "c_name").df()


_RICH = "(SELECT * FROM customer WHERE c_acctbal > 9000)"


@query(f"SELECT o_orderkey, c_name FROM orders LEFT JOIN {_RICH} ON o_custkey = c_custkey")
def join_left(spark, sf):
    rich = read(spark, sf, "customer").where("c_acctbal > 9000")
    return Query(spark).from_(specs(sf)["orders"]).left_join(rich, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name").df()


@query("SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 400000) RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right(spark, sf):
    big = read(spark, sf, "orders").where("o_totalprice > 400000")
    return Query(spark).from_(big).right_join(specs(sf)["customer"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey").df()


@query(f"SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 300000) FULL JOIN {_RICH} ON o_custkey = c_custkey")
def join_full(spark, sf):
    big, rich = read(spark, sf, "orders").where("o_totalprice > 300000"), read(spark, sf, "customer").where("c_acctbal > 9000")
    return Query(spark).from_(big).full_join(rich, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey").df()


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark, sf):
    return Query(spark).from_(specs(sf)["nation"]).cross_join(specs(sf)["region"]).select("n_name", "r_name").df()


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(spark, sf):
    big = read(spark, sf, "orders").where("o_totalprice > 300000")
    return Query(spark).from_(specs(sf)["customer"]).semi_join(big, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey").df()


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_anti(spark, sf):
    big = read(spark, sf, "orders").where("o_totalprice > 300000")
    return Query(spark).from_(specs(sf)["customer"]).anti_join(big, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey").df()


_FIRST = "(SELECT o_custkey AS c_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_totalprice > 200000 GROUP BY 1)"


@query(f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN {_FIRST} USING (c_custkey)")
def join_any_left(spark, sf):
    big = read(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return Query(spark).from_(specs(sf)["customer"]).any_left_join(big, ["c_custkey"], order=[F.col("o_orderkey")]).select("c_custkey", "o_orderkey").df()


@query(f"SELECT c_custkey, o_orderkey FROM customer JOIN {_FIRST} USING (c_custkey)")
def join_any_inner(spark, sf):
    big = read(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return Query(spark).from_(specs(sf)["customer"]).any_inner_join(big, ["c_custkey"], order=[F.col("o_orderkey")]).select("c_custkey", "o_orderkey").df()


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_global(spark, sf):
    return Query(spark).from_(read(spark, sf, "supplier")).global_inner_join(specs(sf)["nation"], F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name").df()


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark, sf):
    n = specs(sf)["nation"]
    a, b = n.as_("a"), n.as_("b")
    return Query(spark).from_(a).inner_join(b, (a.n_regionkey == b.n_regionkey) & (a.n_nationkey < b.n_nationkey)).select(a=a.n_nationkey, b=b.n_nationkey).df()


@query("SELECT event_id, band FROM events JOIN (SELECT unnest([0, 10, 40, 90]) AS lo, unnest([9.5, 39.5, 89.5, 1000.0]) AS hi, unnest(['a', 'b', 'c', 'd']) AS band) ON value BETWEEN lo AND hi")
def join_range(spark, sf):
    bands = spark.createDataFrame([(0.0, 9.5, "a"), (10.0, 39.5, "b"), (40.0, 89.5, "c"), (90.0, 1000.0, "d")], "lo double, hi double, band string")
    return joins.interval_join(read(spark, sf, "events"), bands, "value", "lo", "hi", width=50.0).select("event_id", "band")


@query("""SELECT event_id, hi FROM events LEFT JOIN (SELECT CAST(s_suppkey AS DOUBLE) * 3 AS lo, CAST(s_suppkey AS DOUBLE) * 3 + CASE WHEN s_suppkey % 10 = 0 THEN 200 ELSE 1 END AS hi FROM supplier) ON value BETWEEN lo AND hi""")
def join_range_left(spark, sf):
    lo = F.col("s_suppkey").cast("double") * 3
    spans = read(spark, sf, "supplier").select(lo.alias("lo"), (lo + F.when(F.col("s_suppkey") % 10 == 0, 200).otherwise(1)).alias("hi"))
    return joins.interval_join(read(spark, sf, "events"), spans, "value", "lo", "hi", width=2.0, how="left").select("event_id", "hi")


_ASOF = """SELECT l.event_id, r.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF {} JOIN
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'view') WHERE k = 1) r
  ON l.user_id = r.user_id AND l.ts >= r.ts"""


def _asof(spark, sf, how, bucket=None):
    events = read(spark, sf, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("view_ts"))
    return Query(spark).from_(left).asof_join(right, ["user_id"], "ts", "view_ts", how=how, tie=["view_id"], bucket=bucket).select("event_id", "view_id").df()


@query(_ASOF.format("LEFT"))
def asof_left(spark, sf):
    return _asof(spark, sf, "left")


@query(_ASOF.format(""))
def asof_inner(spark, sf):
    return _asof(spark, sf, "inner")


@query(_ASOF.format("LEFT"))
def asof_left_bucketed(spark, sf):
    return _asof(spark, sf, "left", "day")


# Aggregates.


@query("SELECT event_type, count(*) AS n, count(value) AS n_value, min(value) AS lo, max(value) AS hi, CAST(sum(value::DECIMAL(18,4)) AS DOUBLE) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def agg_basic(spark, sf):
    return Query(spark).from_(read(spark, sf, "events")).group_by("event_type").select(event_type="event_type", n=A.count(), n_value=A.count("value"), lo=A.min_("value"), hi=A.max_("value"), total=dsum(F.col("value").cast("decimal(18,4)")), mean=F.round(A.avg("value"), 6)).df()


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, CAST(sum(value::DECIMAL(18,4)) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS spent,
  round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS mean_view, min(value) FILTER (WHERE event_type = 'click') AS lo, max(value) FILTER (WHERE event_type = 'click') AS hi,
  count(DISTINCT event_type) FILTER (WHERE value > 50) AS kinds FROM events GROUP BY 1""")
def agg_if(spark, sf):
    of = lambda k: P.eq("event_type", k)
    return read(spark, sf, "events").groupBy("user_id").agg(A.count_if(of("error")).alias("errors"), A.sum_if(F.col("value").cast("decimal(18,4)"), of("purchase")).cast("double").alias("spent"), F.round(A.avg_if("value", of("view")), 6).alias("mean_view"), A.min_if("value", of("click")).alias("lo"), A.max_if("value", of("click")).alias("hi"), A.uniq_exact_if("event_type", P.gt("value", 50)).alias("kinds"))


@query("""SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest FROM orders GROUP BY 1""")
def agg_argminmax(spark, sf):
    by = F.struct("o_totalprice", "o_orderkey")
    return read(spark, sf, "orders").groupBy("o_custkey").agg(A.arg_min("o_orderkey", by).alias("cheapest"), A.arg_max("o_orderkey", by).alias("dearest"))


@query("SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS s, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS v, round(var_pop(l_quantity), 6) AS vp FROM lineitem GROUP BY 1")
def agg_stats(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_returnflag").agg(*[F.round(f("l_quantity"), 6).alias(n) for f, n in ((A.stddev_samp, "s"), (A.stddev_pop, "sp"), (A.var_samp, "v"), (A.var_pop, "vp"))])


@query("SELECT event_type, round(median(value), 6) AS mid, round(quantile_cont(value, 0.9), 6) AS p90, list_transform(quantile_cont(value, [0.25, 0.75]), lambda x: round(x, 6)) AS quartiles FROM events GROUP BY 1")
def agg_quantiles(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.round(A.median("value"), 6).alias("mid"), F.round(A.quantile("value", 0.9), 6).alias("p90"), F.transform(A.quantiles("value", [0.25, 0.75]), lambda x: F.round(x, 6)).alias("quartiles"))


@query("SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_extendedprice), 2) AS cs, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp FROM lineitem GROUP BY 1")
def agg_corr_covar(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.round(A.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(A.covar_samp("l_quantity", "l_extendedprice"), 2).alias("cs"), F.round(A.covar_pop("l_quantity", "l_extendedprice"), 2).alias("cp"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg_distinct(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(A.count_distinct("user_id").alias("users"))


@query("SELECT r_name, list_sort(list(n_name)) AS names, list_sort(list(DISTINCT left(n_name, 1))) AS initials, min(r_name) AS one FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def agg_group_array(spark, sf):
    both = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("r_name").agg(A.group_array("n_name", ordered=True).alias("names"), A.group_uniq_array(S.left("n_name", 1), ordered=True).alias("initials"), A.any_("r_name").alias("one"))


def _top(order: str, weight: str, limit: int) -> str:
    return f"WITH c AS (SELECT event_type, user_id, {weight} AS w FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY w {order}, user_id) AS k FROM c) SELECT event_type, list(user_id ORDER BY k) AS best FROM r WHERE k <= {limit} GROUP BY 1"


@query(_top("DESC", "count(*)", 3))
def agg_topk(spark, sf):
    return frequent.top_k(read(spark, sf, "events"), "user_id", 3, ["event_type"], to="best")


@query(_top("ASC", "count(*)", 3))
def agg_bottomk(spark, sf):
    return frequent.bottom_k(read(spark, sf, "events"), "user_id", 3, ["event_type"], to="best")


@query(_top("DESC", "sum(value::DECIMAL(18,4))", 4))
def agg_topsum(spark, sf):
    return frequent.top_sum(read(spark, sf, "events").withColumn("v", F.col("value").cast("decimal(18,4)")), "user_id", 4, ["event_type"], weight="v", to="best")


@query(_top("ASC", "sum(value::DECIMAL(18,4))", 4))
def agg_bottomsum(spark, sf):
    return frequent.bottom_sum(read(spark, sf, "events").withColumn("v", F.col("value").cast("decimal(18,4)")), "user_id", 4, ["event_type"], weight="v", to="best")


@query("SELECT label, list_sort(flatten(list(embedding))) AS parts FROM embeddings GROUP BY 1")
def agg_group_array_array(spark, sf):
    return read(spark, sf, "embeddings").groupBy("label").agg(F.array_sort(A.group_array_array("embedding")).alias("parts"))


# Windows.


@query("""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)""")
def win_rank_family(spark, sf):
    status = W.spec("o_custkey", "o_orderstatus")
    cast = lambda c: c.cast("bigint")
    return read(spark, sf, "orders").select("o_orderkey", cast(W.row_number(W.spec("o_custkey", ["o_totalprice", "o_orderkey"]))).alias("rn"), cast(W.rank(status)).alias("rk"), cast(W.dense_rank(status)).alias("dr"))


@query("SELECT event_id, lag(event_id, 1, -1) OVER w AS before, lead(event_id, 2) OVER w AS after2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lag_lead(spark, sf):
    w = W.spec("user_id", ["ts", "event_id"])
    return read(spark, sf, "events").select("event_id", W.lag("event_id", 1, -1, w).alias("before"), W.lead("event_id", 2, window=w).alias("after2"))


@query("SELECT o_orderkey, CAST(sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS DOUBLE) AS running FROM orders")
def win_running_sum(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", W.over(F.sum(money("o_totalprice")), W.spec("o_custkey", "o_orderkey")).cast("double").alias("running"))


@query("SELECT o_orderkey, count(*) OVER w AS n, max(o_totalprice) OVER w AS hi FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
def win_frame_rows(spark, sf):
    q = Query(spark).from_(read(spark, sf, "orders")).window("w", "PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING")
    return q.select(o_orderkey="o_orderkey", n=q.over("w", "count(*)"), hi=q.over("w", "max(o_totalprice)")).df()


_STEP = "v - lag(v) OVER (PARTITION BY user_id ORDER BY ts)"
_SERIES = "(SELECT user_id, ts, round(max(value), 2) AS v FROM events GROUP BY 1, 2)"


@query(f"SELECT user_id, ts, round({_STEP}, 4) AS delta, round(CASE WHEN {_STEP} < 0 THEN v ELSE {_STEP} END, 4) AS increase FROM {_SERIES}")
def counter_delta(spark, sf):
    series = read(spark, sf, "events").groupBy("user_id", "ts").agg(F.round(F.max("value"), 2).alias("v"))
    return series.select("user_id", "ts", F.round(A.delta("v", "ts", ["user_id"]), 4).alias("delta"), F.round(A.increase("v", "ts", ["user_id"]), 4).alias("increase"))


@query(f"""SELECT user_id, ts, round(CASE WHEN {_STEP} < 0 THEN v ELSE {_STEP} END / nullif((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1000000.0, 0), 6) AS rate FROM {_SERIES}""")
def counter_rate(spark, sf):
    series = read(spark, sf, "events").groupBy("user_id", "ts").agg(rounded(F.max("value"), 2).alias("v"))
    return series.select("user_id", "ts", rounded(A.rate("v", "ts", ["user_id"]), 6).alias("rate"))


# Strings, conversion, hashes.


@query("""SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, reverse(p_name) AS rev, repeat(p_brand, 2) AS twice, substring(p_name, 2, 4) AS mid, left(p_name, 3) AS l3, right(p_name, 3) AS r3,
  trim(concat(' ', p_name, ' ')) AS tr, strlen(p_name) AS n_bytes, length(p_name) AS n_chars, concat(p_brand, '-', p_type) AS both FROM part""")
def str_case_trim_pad(spark, sf):
    padded = S.concat(F.lit(" "), "p_name", F.lit(" "))
    return read(spark, sf, "part").select("p_partkey", S.lower("p_name").alias("lo"), S.upper("p_name").alias("up"), S.reverse("p_name").alias("rev"), S.repeat("p_brand", 2).alias("twice"), S.substring("p_name", 2, 4).alias("mid"), S.left("p_name", 3).alias("l3"), S.right("p_name", 3).alias("r3"), S.string_trim(padded).alias("tr"), S.length("p_name").cast("bigint").alias("n_bytes"), S.length_utf8("p_name").cast("bigint").alias("n_chars"), S.concat("p_brand", F.lit("-"), "p_type").alias("both"))


@query("""SELECT p_partkey, contains(p_name, 'a') AS has_a, starts_with(p_name, 'P') AS starts_p, suffix(p_name, '1') AS ends_1, position('a' IN p_name) AS at_a, CAST(len(string_split(p_name, 'a')) - 1 AS BIGINT) AS n_a,
  p_type LIKE '%S%' AS lk, p_type NOT LIKE '%S%' AS nlk, p_type ILIKE '%s%' AS ilk, p_type NOT ILIKE '%s%' AS nilk FROM part""")
def str_search(spark, sf):
    return read(spark, sf, "part").select("p_partkey", S.contains("p_name", "a").alias("has_a"), S.starts_with("p_name", "P").alias("starts_p"), S.ends_with("p_name", "1").alias("ends_1"), S.position("p_name", "a").cast("bigint").alias("at_a"), S.count_matches("p_name", "a").cast("bigint").alias("n_a"), S.like("p_type", "%S%").alias("lk"), S.not_like("p_type", "%S%").alias("nlk"), S.ilike("p_type", "%s%").alias("ilk"), S.not_ilike("p_type", "%s%").alias("nilk"))


@query(r"""SELECT page_id, regexp_matches(url, '[0-9]+') AS has_digits, regexp_replace(url, '([a-z]+)\.', '<\1>', 'g') AS marked, replace(url, '/', '|') AS piped FROM pages""")
def str_regex(spark, sf):
    return read(spark, sf, "pages").select("page_id", S.match("url", "[0-9]+").alias("has_digits"), S.replace_regexp_all("url", r"([a-z]+)\.", r"<\1>").alias("marked"), S.replace("url", "/", "|").alias("piped"))


@query(r"SELECT page_id, string_split(url, '/') AS parts, CAST(len(list_filter(string_split_regex(html, '\s+'), lambda x: x <> '')) AS BIGINT) AS n_words FROM pages")
def str_split(spark, sf):
    return read(spark, sf, "pages").select("page_id", S.split_by_char("url", "/").alias("parts"), F.size(S.split_by_whitespace("html")).cast("bigint").alias("n_words"))


@query("SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s2 FROM customer")
def hash_hex(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", hashing.md5("c_name").alias("m"), hashing.sha1("c_name").alias("s1"), hashing.sha256("c_name").alias("s2"))


@query("""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS txt, CAST(floor(o_totalprice) AS BIGINT) AS whole, TRY_CAST(o_orderpriority AS INTEGER) AS bad, CAST(o_orderdate AS DATE) AS day, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS padded,
  rpad(o_orderstatus, 3, '*') AS rp, hex(o_orderstatus) AS hx, CAST(unhex(hex(o_orderstatus)) AS VARCHAR) AS unhx, to_base64(encode(o_orderpriority)) AS b64, replace(url_encode(o_orderpriority), '+', '%20') AS enc, printf('%.1f%%', o_totalprice * 100) AS pct FROM orders""")
def conv_casts(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", conversion.to_string("o_orderkey").alias("txt"), conversion.to_int64(F.floor("o_totalprice")).alias("whole"), conversion.to_int32("o_orderpriority").alias("bad"), conversion.to_date("o_orderdate").alias("day"), conversion.left_pad("o_orderkey", 8, "0").alias("padded"), conversion.right_pad("o_orderstatus", 3, "*").alias("rp"), conversion.to_hex("o_orderstatus").alias("hx"), conversion.from_hex(conversion.to_hex("o_orderstatus")).alias("unhx"), conversion.to_base64("o_orderpriority").alias("b64"), conversion.url_encode("o_orderpriority").alias("enc"), conversion.format_percentage("o_totalprice", 1).alias("pct"))


@query("""SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS a, round(l_extendedprice / 7, 2) AS r, CAST(floor(l_extendedprice) AS BIGINT) AS fl, CAST(ceil(l_extendedprice) AS BIGINT) AS ce, round(sqrt(l_quantity), 6) AS sq, pow(l_quantity, 2) AS p,
  l_quantity + 1 AS pl, l_quantity - 1 AS mi, l_quantity * 2 AS mu, round(l_quantity / nullif(l_linenumber - 1, 0), 6) AS dv FROM lineitem""")
def math_functions(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", maths.abs_(maths.minus("l_quantity", 25)).alias("a"), maths.round_(maths.div("l_extendedprice", 7), 2).alias("r"), maths.floor("l_extendedprice").alias("fl"), maths.ceil("l_extendedprice").alias("ce"), F.round(maths.sqrt("l_quantity"), 6).alias("sq"), maths.power("l_quantity", 2).alias("p"), maths.plus("l_quantity", 1).alias("pl"), maths.minus("l_quantity", 1).alias("mi"), maths.mult("l_quantity", 2).alias("mu"), F.round(maths.div("l_quantity", maths.minus("l_linenumber", 1)), 6).alias("dv"))


@query("""SELECT event_id, CASE WHEN value < 10 THEN 'a' WHEN value < 50 THEN 'b' ELSE 'c' END AS band, CASE WHEN value > 50 THEN 1 ELSE 0 END AS hot, CASE WHEN value > 90 THEN NULL ELSE value END AS capped, nullif(event_type, 'view') AS kind,
  coalesce(nullif(event_type, 'view'), 'v') AS kind2, greatest(user_id, event_id) AS g, least(user_id, event_id) AS l, (value > 50) <> (user_id > 75) AS x, NOT (value > 50) AS n FROM events""")
def conditionals(spark, sf):
    high = P.gt("value", 50)
    kind = conditional.null_if_equal("event_type", "view")
    return read(spark, sf, "events").select("event_id", conditional.multi_if(P.lt("value", 10), "a", P.lt("value", 50), "b", "c").alias("band"), conditional.case_when().when(high, 1).otherwise(0).alias("hot"), conditional.null_if(P.gt("value", 90), "value").alias("capped"), kind.alias("kind"), conditional.if_null(kind, "v").alias("kind2"), conditional.greatest("user_id", "event_id").alias("g"), conditional.least("user_id", "event_id").alias("l"), conditional.xor(high, P.gt("user_id", 75)).alias("x"), conditional.not_(high).alias("n"))


# Dates and times.


@query("""SELECT event_id, date_trunc('hour', ts) AS h, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, CAST(date_trunc('day', ts) AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS w, CAST(date_trunc('month', ts) AS DATE) AS m, CAST(date_trunc('quarter', ts) AS DATE) AS q,
  CAST(date_trunc('year', ts) AS DATE) AS y, time_bucket(INTERVAL 15 MINUTE, ts) AS m15 FROM events""")
def time_start_of(spark, sf):
    return read(spark, sf, "events").select("event_id", D.time_to_start_of_hour("ts").alias("h"), D.time_to_start_of_day("ts").alias("d"), D.time_to_start_of_week("ts").alias("w"), D.time_to_start_of_month("ts").alias("m"), D.to_start_of_quarter("ts").alias("q"), D.to_start_of_year("ts").alias("y"), D.to_start_of_interval("ts", 15, "minute").alias("m15"))


@query("""SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '1998-12-31') AS d, date_diff('month', o_orderdate, TIMESTAMP '1998-12-31') AS m, date_diff('year', o_orderdate, TIMESTAMP '1998-12-31') AS y,
  date_diff('day', date_trunc('week', o_orderdate), date_trunc('week', TIMESTAMP '1998-12-31')) // 7 AS w, o_orderdate + INTERVAL 1 MONTH AS next_month, o_orderdate - INTERVAL 3 DAY AS three_before FROM orders""")
def time_diff_add(spark, sf):
    end = F.lit("1998-12-31").cast("timestamp_ntz")
    return read(spark, sf, "orders").select("o_orderkey", *[D.date_diff(u, "o_orderdate", end).alias(n) for u, n in (("day", "d"), ("month", "m"), ("year", "y"), ("week", "w"))], D.date_add("month", 1, "o_orderdate").alias("next_month"), D.date_sub("day", 3, "o_orderdate").alias("three_before"))


@query("""SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(quarter(ts) AS INTEGER) AS q, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(isodow(ts) AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi,
  CAST(second(ts) AS INTEGER) AS s, CAST(week(ts) AS INTEGER) AS iso, CAST(strftime(ts, '%U') AS INTEGER) AS wk, CAST(floor(epoch(ts)) AS BIGINT) AS unix, strftime(ts, '%Y-%m-%d %H:%M') AS txt FROM events""")
def time_parts(spark, sf):
    return read(spark, sf, "events").select("event_id", D.to_year("ts").alias("y"), D.to_quarter("ts").alias("q"), D.to_month("ts").alias("m"), D.to_day_of_month("ts").alias("d"), D.to_day_of_week("ts").alias("dow"), D.to_hour("ts").alias("h"), D.to_minute("ts").alias("mi"), D.to_second("ts").alias("s"), D.to_iso_week("ts").alias("iso"), D.to_week("ts").alias("wk"), D.to_unix_timestamp("ts").alias("unix"), D.time_format_date_time("ts", "%Y-%m-%d %H:%i").alias("txt"))


# Arrays and JSON.


@query("SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(1, len(string_split(text, ' ')) + 1)) AS n FROM documents")
def array_join_unroll(spark, sf):
    words = read(spark, sf, "documents").select("doc_id", S.split_by_char("text", " ").alias("word"))
    words = words.withColumn("n", F.when(F.size("word") > 0, F.sequence(F.lit(1).cast("bigint"), F.size("word").cast("bigint"))))
    return Query(spark).from_(words).array_join("word", "n").select("doc_id", "word", "n").df()


@query("SELECT vec_id, unnest(embedding) AS x FROM embeddings")
def array_join_named(spark, sf):
    return Query(spark).from_(read(spark, sf, "embeddings")).array_join_as("embedding", "x").select("vec_id", "x").df()


@query("SELECT vec_id, unnest(embedding) AS a, unnest(list_reverse(embedding)) AS b FROM embeddings")
def array_join_several(spark, sf):
    both = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"), F.reverse("embedding").alias("b"))
    return Query(spark).from_(both).array_join_multiple("a", "b").select("vec_id", "a", "b").df()


@query("""SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2) AS doubled, list_filter(embedding, lambda x: x > 0.1) AS positive, CAST(len(embedding) AS INTEGER) AS n, embedding[1] AS first, embedding[-1] AS last, list_reverse(embedding) AS rev,
  list_sort(embedding) AS up, list_sort(embedding, 'DESC') AS down, list_min(embedding) AS lo, list_max(embedding) AS hi, embedding[1000] AS beyond FROM embeddings""")
def array_hof(spark, sf):
    e = "embedding"
    return read(spark, sf, "embeddings").select("vec_id", arrays.array_map(lambda x: x.cast("double") * 2, e).alias("doubled"), arrays.array_filter("x -> x > 0.1", e).alias("positive"), arrays.array_length(e).alias("n"), arrays.array_first(e).alias("first"), arrays.array_last(e).alias("last"), arrays.array_reverse(e).alias("rev"), arrays.array_sort(e).alias("up"), arrays.array_sort(e, False).alias("down"), arrays.array_min(e).alias("lo"), arrays.array_max(e).alias("hi"), arrays.array_element(e, 1000).alias("beyond"))


_LETTERS = "string_split(p_type, ' ')"


@query(f"""SELECT p_partkey, list_contains({_LETTERS}, 'TIN') AS has_tin, list_has_all({_LETTERS}, ['TIN', 'BRASS']) AS has_both, list_has_any({_LETTERS}, ['TIN', 'BRASS']) AS has_any, list_sort(list_distinct({_LETTERS})) AS kinds,
  list_concat({_LETTERS}, [p_brand]) AS more, array_to_string({_LETTERS}, '+') AS joined, CAST(len(list_filter({_LETTERS}, lambda x: x = 'TIN')) AS INTEGER) AS tins, len({_LETTERS}) = 0 AS none FROM part""")
def array_set_ops(spark, sf):
    a = S.split_by_char("p_type", " ")
    return read(spark, sf, "part").select("p_partkey", arrays.array_has(a, "TIN").alias("has_tin"), arrays.array_has_all(a, ["TIN", "BRASS"]).alias("has_both"), arrays.array_has_any(a, ["TIN", "BRASS"]).alias("has_any"), F.array_sort(arrays.array_distinct(a)).alias("kinds"), arrays.array_concat(a, F.array("p_brand")).alias("more"), arrays.array_join("+", a).alias("joined"), arrays.array_count_matches(a, "TIN").alias("tins"), arrays.empty(a).alias("none"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS s, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS a, CAST(len(embedding) AS INTEGER) AS n, CAST(len(list_distinct(embedding)) AS INTEGER) AS u FROM embeddings")
def array_reduce(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.round(arrays.array_reduce("sum", "embedding"), 6).alias("s"), F.round(arrays.array_reduce("avg", "embedding"), 6).alias("a"), arrays.array_reduce("count", "embedding").alias("n"), arrays.array_reduce("uniq", "embedding").alias("u"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS ks, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS kf, json_exists(props, '$.k') AS has_k, json_exists(props, '$.zz') AS has_zz FROM events")
def json_extract(spark, sf):
    return read(spark, sf, "events").select("event_id", jsons.json_extract_int("props", "k").alias("k"), jsons.json_extract_string("props", "k").alias("ks"), jsons.json_extract("props", "k", "Float64").alias("kf"), jsons.json_has("props", "k").alias("has_k"), jsons.json_has("props", "zz").alias("has_zz"))


@query("SELECT event_id, json_keys(props) AS keys, CAST(len(json_keys(props)) AS INTEGER) AS n FROM events")
def json_keys(spark, sf):
    return read(spark, sf, "events").select("event_id", jsons.json_extract_keys("props").alias("keys"), jsons.json_length("props").alias("n"))


# Merge semantics.


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'")
def final_replacing(spark, sf):
    rows = read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type").withColumn("gone", F.when(P.eq("event_type", "error"), 1).otherwise(0))
    return engines.final(rows, engines.replacing_merge_tree("ts", "gone"), ["user_id"], sequence="event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_type, CAST(sum(event_id % 3 - 1) AS BIGINT) AS n FROM events GROUP BY 1, 2 HAVING sum(event_id % 3 - 1) <> 0")
def final_summing(spark, sf):
    rows = read(spark, sf, "events").select("user_id", "event_type", (F.col("event_id") % 3 - 1).alias("n"))
    return engines.final(rows, engines.summing_merge_tree("n"), ["user_id", "event_type"])


_SIGNED = "SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS sign, event_id % 4 AS ver FROM events"


@query(f"SELECT user_id, max(event_id) FILTER (WHERE sign > 0) AS event_id FROM ({_SIGNED}) GROUP BY 1 HAVING sum(sign) > 0")
def final_collapsing(spark, sf):
    rows = read(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("sign"))
    return engines.final(rows, engines.collapsing_merge_tree("sign"), ["user_id"], sequence="event_id").select("user_id", "event_id")


@query(f"SELECT user_id, ver, max(event_id) FILTER (WHERE sign > 0) AS event_id FROM ({_SIGNED}) GROUP BY 1, 2 HAVING sum(sign) > 0")
def final_versioned(spark, sf):
    rows = read(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("sign"), (F.col("event_id") % 4).alias("ver"))
    return engines.final(rows, engines.versioned_collapsing_merge_tree("sign", "ver"), ["user_id"], sequence="event_id").select("user_id", "ver", "event_id")


@query("SELECT user_id, max(value) AS hi, CAST(sum(value::DECIMAL(18,4)) AS DOUBLE) AS total, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY 1")
def final_aggregating(spark, sf):
    # Partial states by day, merged when they are read.
    day = F.to_date("ts")
    parts = read(spark, sf, "events").groupBy("user_id", day.alias("day")).agg(F.max("value").alias("hi"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"), F.collect_set("event_type").alias("kinds"))
    out = engines.final(parts.drop("day"), engines.aggregating_merge_tree(), ["user_id"], merge={"hi": "max", "total": "sum", "kinds": "groupUniqArray"})
    return out.select("user_id", "hi", F.col("total").cast("double").alias("total"), "kinds")


# Composite.


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY 1) SELECT c_name, n FROM per JOIN customer ON o_custkey = c_custkey WHERE n > 2")
def cte_chain(spark, sf):
    s = specs(sf)
    big = Query(spark).from_(s["orders"]).where(P.gt("o_totalprice", 200000.0))
    per = Query(spark).from_("big").group_by("o_custkey").select(o_custkey="o_custkey", n=A.count())
    return Query(spark).with_("big", big).with_("per", per).from_("per").inner_join(s["customer"], F.col("o_custkey") == F.col("c_custkey")).where("n > 2").select("c_name", "n").df()


@query("SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def subquery_from(spark, sf):
    inner = Query(spark).from_(specs(sf)["orders"]).group_by("o_custkey").select(o_custkey="o_custkey", n=A.count())
    return Query(spark).from_(inner, "per").group_by("n").select(n="n", customers=A.count()).df()


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 8000")
def relation_one(spark, sf):
    out = Fetch(spark, specs(sf)["customer"]).find_many(where=lambda c, op: op["gt"](c.c_acctbal, 8000.0), columns=["c_custkey"], with_={"nation": {"columns": ["n_name"], "with_": {"region": {"columns": ["r_name"]}}}})
    return out.select("c_custkey", F.col("nation.n_name").alias("n_name"), F.col("nation.region.r_name").alias("r_name"))


@query("""SELECT c_custkey, coalesce(o.keys, []) AS keys FROM customer LEFT JOIN (SELECT o_custkey, list(o_orderkey ORDER BY k) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k
  FROM orders WHERE o_orderstatus = 'F') WHERE k <= 3 GROUP BY 1) o ON c_custkey = o_custkey""")
def relation_many_limit(spark, sf):
    out = Fetch(spark, specs(sf)["customer"]).find_many(columns=["c_custkey"], with_={"orders": {"where": {"o_orderstatus": "F"}, "order_by": [{"o_totalprice": "desc"}, "o_orderkey"], "limit": 3, "columns": ["o_orderkey"]}})
    return out.select("c_custkey", F.transform("orders", lambda o: o["o_orderkey"]).alias("keys"))


def _nations(spark, sf):
    return dictionary("nations", read(spark, sf, "nation").where("n_nationkey < 20"), "n_nationkey", parent="n_regionkey")


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def dict_get(spark, sf):
    return _nations(spark, sf).get(read(spark, sf, "customer"), "c_nationkey", "n_name").select("c_custkey", "n_name")


@query("SELECT c_custkey, coalesce(n_name, 'elsewhere') AS n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def dict_default(spark, sf):
    return _nations(spark, sf).get_or_default(read(spark, sf, "customer"), "c_nationkey", "n_name", "elsewhere").select("c_custkey", "n_name")


@query("SELECT c_custkey, c_nationkey < 20 AS known FROM customer")
def dict_has(spark, sf):
    return _nations(spark, sf).has(read(spark, sf, "customer"), "c_nationkey", "known").select("c_custkey", "known")


@query("SELECT r_regionkey, coalesce(children, []) AS children FROM region LEFT JOIN (SELECT n_regionkey, list_sort(list(n_nationkey)) AS children FROM nation WHERE n_nationkey < 20 GROUP BY 1) ON r_regionkey = n_regionkey")
def dict_children(spark, sf):
    return _nations(spark, sf).get_children(read(spark, sf, "region"), "r_regionkey").select("r_regionkey", "children")


@query("SELECT event_id, price FROM events LEFT JOIN (SELECT unnest(['view', 'click']) AS kind, unnest([0, 10]) AS lo, unnest([49, 80]) AS hi, unnest([1.5::DOUBLE, 2.5]) AS price) ON event_type = kind AND floor(value) BETWEEN lo AND hi")
def dict_range(spark, sf):
    prices = spark.createDataFrame([("view", 0, 49, 1.5), ("click", 10, 80, 2.5)], "kind string, lo bigint, hi bigint, price double")
    d = dictionary("prices", prices, "kind", layout="range_hashed", low="lo", high="hi")
    return d.get(read(spark, sf, "events").withColumn("at", F.floor("value")), "event_type", "price", at="at").select("event_id", "price")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_tumbling(spark, sf):
    out = incremental.tumbling(read(spark, sf, "events"), "ts", "1 hour", ["event_type"], {"n": F.count("*")})
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def window_sessions(spark, sf):
    out = incremental.sessions(read(spark, sf, "events"), "ts", "30 minutes", ["user_id"], {"n": F.count("*")})
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)")
def cube_counts(spark, sf):
    both = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.cube("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark, sf):
    nations = Query(spark).from_(read(spark, sf, "customer")).select(k="c_nationkey").union(Query(spark).from_(read(spark, sf, "supplier")).select(k="s_nationkey"))
    return nations.except_(Query(spark).from_(read(spark, sf, "nation").where("n_regionkey = 0")).select(k="n_nationkey")).df()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
def set_operations_all(spark, sf):
    both = Query(spark).from_(read(spark, sf, "customer")).select(k="c_nationkey").intersect(Query(spark).from_(read(spark, sf, "supplier")).select(k="s_nationkey"))
    return both.union_all(Query(spark).from_(specs(sf)["nation"]).select(k="n_nationkey")).df()


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 2")
def limit_by(spark, sf):
    return frequent.limit_by(read(spark, sf, "orders"), 2, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


# Geometry on points made from ids.

_XY = "CAST((s_suppkey * 37) % 360 - 180 AS DOUBLE) AS x, CAST((s_suppkey * 53) % 170 - 85 AS DOUBLE) AS y"


def _points(spark, sf):
    s = F.col("s_suppkey")
    return read(spark, sf, "supplier").select("s_suppkey", geo.geo_point(s * 37 % 360 - 180, s * 53 % 170 - 85).alias("p"))


@query(f"SELECT s_suppkey, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(y - 48.0) / 2), 2) + cos(radians(48.0)) * cos(radians(y)) * pow(sin(radians(x - 2.0) / 2), 2)))), 3) AS km, abs(x - 2) + abs(y - 48) AS manhattan FROM (SELECT s_suppkey, {_XY} FROM supplier)")
def geo_haversine(spark, sf):
    home = geo.geo_point(F.lit(2.0), F.lit(48.0))
    return _points(spark, sf).select("s_suppkey", F.round(geo.geo_distance(home, "p"), 3).alias("km"), geo.manhattan_distance("p", home).alias("manhattan"))


@query(f"SELECT s_suppkey, x BETWEEN -50 AND 60 AND y BETWEEN -20 AND 40 AS inside FROM (SELECT s_suppkey, {_XY} FROM supplier)")
def geo_bbox(spark, sf):
    box = geo.bounding_box(geo.geo_point(F.lit(60.0), F.lit(-20.0)), geo.geo_point(F.lit(-50.0), F.lit(40.0)))
    return _points(spark, sf).select("s_suppkey", geo.point_in_bounding_box("p", box).alias("inside"))


@query(f"SELECT s_suppkey, abs(x) + abs(y) < 60.5 AS inside FROM (SELECT s_suppkey, {_XY} FROM supplier)")
def geo_point_in_polygon(spark, sf):
    corner = lambda x, y: geo.geo_point(F.lit(x), F.lit(y))
    diamond = F.array(F.array(corner(60.5, 0.0), corner(0.0, 60.5), corner(-60.5, 0.0), corner(0.0, -60.5), corner(60.5, 0.0)))
    return _points(spark, sf).select("s_suppkey", geo.point_in_polygon("p", diamond).alias("inside"))


@query(f"SELECT s_suppkey, abs(x) * abs(y) AS area, 2 * (abs(x) + abs(y)) AS perimeter FROM (SELECT s_suppkey, {_XY} FROM supplier)")
def geo_shoelace(spark, sf):
    x, y, zero = geo.geo_x("p"), geo.geo_y("p"), F.lit(0.0)
    box = F.array(F.array(geo.geo_point(zero, zero), geo.geo_point(x, zero), geo.geo_point(x, y), geo.geo_point(zero, y)))
    return _points(spark, sf).select("s_suppkey", geo.polygon_area(box).alias("area"), geo.polygon_perimeter(box).alias("perimeter"))


# No SQL of DuckDB has the same hash: tested on its properties instead.


def sample_hash(spark: SparkSession, sf: str) -> DataFrame:
    events = table("events", {"event_id": t.int64(), "user_id": t.int64(), "event_type": t.string()}, order_by="event_id", sample_by="event_id", path=f"{sf}/events.parquet")
    return Query(spark).from_(events).sample(0.1, 0.5).select("event_id", "user_id").df()


QUERIES["sample_hash"] = sample_hash
