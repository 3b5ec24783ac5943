"""Every query with SQL against DuckDB, on the smallest tables."""

import collections
import glob
import math
import os

import duckdb
import pytest

from tessera import catalog, catalog_functions, catalog_tables  # noqa: F401  the latter two fill the first


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    rel = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    mine = collections.Counter(plain(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    order = [rel.columns.index(c) for c in columns]
    theirs = collections.Counter(plain(tuple(r[i] for i in order)) for r in rel.fetchall())
    assert mine == theirs


def test_sample_is_stable_and_about_right(spark, sf):
    one, two = (catalog.QUERIES["sample_hash"](spark, sf).collect() for _ in range(2))
    assert sorted(one) == sorted(two)
    assert 50 <= len(one) <= 150


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = catalog.QUERIES["filter_between"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull" in plan
    assert "o_orderpriority" not in plan.rpartition("ReadSchema")[2]


def test_the_as_of_join_has_one_exchange_and_no_product(spark, sf):
    plan = catalog.QUERIES["asof_left"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def same_on(spark, folder, name, **tables):
    """Whether a query gives its SQL's rows on tables made by SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{folder}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rel = con.sql(catalog.ORACLES[name])
    mine = collections.Counter(plain(tuple(r)) for r in catalog.QUERIES[name](spark, str(folder)).select(*rel.columns).collect())
    return mine == collections.Counter(plain(tuple(r)) for r in rel.fetchall())


def test_formats_of_keys_beyond_a_million(spark, sf, tmp_path):
    orders = f"SELECT * REPLACE (o_orderkey + 999000 AS o_orderkey, CASE WHEN o_orderkey <> 7 THEN o_totalprice END AS o_totalprice) FROM '{sf}/orders.parquet'"
    assert same_on(spark, tmp_path, "conv_formats", orders=orders)


def test_rates_over_microseconds(spark, tmp_path):
    events = "SELECT i AS event_id, i % 2 AS user_id, TIMESTAMP '2024-01-01' + to_microseconds(i * (i % 2 * 134 + 3)) AS ts, CAST(i * 7919 % 56021 / 100 AS DOUBLE) AS value FROM range(1000) t(i)"
    assert same_on(spark, tmp_path, "counter_rate", events=events)


def test_rates_that_end_in_halves(spark, tmp_path):
    events = "SELECT i AS event_id, i % 2 AS user_id, TIMESTAMP '2024-01-01' + to_microseconds(i * (16000000 - i % 2 * 15840000)) AS ts, CAST(i * 7919 % 560210 / 1000 AS DOUBLE) AS value FROM range(4000) t(i)"
    assert same_on(spark, tmp_path, "counter_rate", events=events)
