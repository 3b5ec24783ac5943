import pytest
from pyspark.sql import functions as F

from tessera import engines
from tessera.functions import aggregates as A
from tessera.functions import predicates as P
from tessera.functions import windows as W
from tessera.plans.query import Database, Query, fuzzy
from tessera.table import table
from tessera.types import t


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "ann", 30, ["a", "b"]), (2, "bob", None, []), (3, "cyd", 25, ["c"]), (4, "dee", 25, None)], "user_id int, first_name string, age int, tags array<string>")


def rows(q):
    return sorted(tuple(r) for r in (q.df() if isinstance(q, Query) else q).collect())


def test_builder_is_immutable(spark, people):
    base = Query(spark).from_(people)
    one = base.where(P.eq("age", 25))
    assert base.count() == 4 and one.count() == 2
    assert one.where(P.eq("age", 30)).count() == 1  # the second replaces the first


def test_fuzzy_columns(spark, people):
    assert rows(Query(spark).from_(people).select("firstName", "USER_ID").where({"userId": 1})) == [("ann", 1)]
    with pytest.raises(ValueError):
        fuzzy("nope", ["a"])
    with pytest.raises(ValueError):
        Query(spark).from_(people).where({"nope": 1}).df()


def test_where_object_with_null_and_text(spark, people):
    assert Query(spark).from_(people).where({"age": None}).count() == 1
    assert Query(spark).from_(people).where("age > 26").count() == 1


def test_order_puts_nulls_last(spark, people):
    q = Query(spark).from_(people).select("user_id", "age")
    assert [r["user_id"] for r in q.order_by("age", "user_id").collect()] == [3, 4, 1, 2]
    assert [r["user_id"] for r in q.order_by(("age", "desc"), ("user_id", "desc")).collect()] == [1, 4, 3, 2]
    assert [r["user_id"] for r in Query(spark).from_(people).select("user_id").order_by("age", "user_id").collect()] == [3, 4, 1, 2]


def test_offset_without_limit(spark, people):
    assert [r["user_id"] for r in Query(spark).from_(people).order_by("user_id").offset(3).collect()] == [4]


def test_groups_and_having(spark, people):
    q = Query(spark).from_(people).group_by("age").select(years="age", n=A.count())
    assert rows(q.where(F.col("age").isNotNull())) == [(25, 2), (30, 1)]
    assert rows(q.having("n > 1")) == [(25, 2)]
    assert Query(spark).from_(people).group_by("age").df().count() == 3
    assert Query(spark).from_(people).select(n=A.count(), top=A.max_("age")).collect()[0].asDict() == {"n": 4, "top": 30}


def test_select_forms(spark, people):
    spec = table("people", {"user_id": t.int32(), "first_name": t.string()}, order_by="user_id", path="x")
    assert Query(spark).from_(people).select({"n": F.col("first_name")}).df().columns == ["n"]
    assert Query(spark).from_(spec).select(lambda p: {"a": p.user_id}).fields.keys() == {"a"}
    assert Query(spark).from_(people).select().df().columns == people.columns
    assert Query(spark).from_(people).select("age").distinct().count() == 3


def test_ctes_may_build_on_each_other(spark, people):
    young = Query(spark).from_(people).where(P.lt("age", 28))
    q = Query(spark).with_("young", young).with_("ids", Query(spark).from_("young").select("user_id")).from_("ids")
    assert rows(q) == [(3,), (4,)]


def test_array_join_in_lock_step(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [1]), (2, [], []), (3, None, [9])], "k int, x array<string>, y array<int>")
    assert sorted(Query(spark).from_(df).array_join("x", "y").df().collect(), key=str) == sorted([(1, "a", 1), (1, "b", None), (3, None, 9)], key=str)
    assert Query(spark).from_(df).array_join_as("x", "item").df().columns == ["k", "x", "y", "item"]


def test_terminals(spark, people):
    q = Query(spark).from_(people).select("user_id", "age").order_by("user_id")
    assert q.find_first()["user_id"] == 1 and q.find_unique()["user_id"] == 1 and q.exists() and not q.where(P.eq("user_id", 99)).exists()
    assert [r["user_id"] for r in q.find_many(2, 1)] == [2, 3] and [r["user_id"] for r in q.stream()] == [1, 2, 3, 4]
    meta = q.find_many_with_meta(3, total=True)
    assert len(meta["data"]) == 3 and meta["has_more"] and meta["total"] == 4
    assert q.find_as_map("user_id")[3]["age"] == 25 and {r["age"]: len(r["rows"]) for r in q.find_grouped("age").collect()}[25] == 2
    assert q.native().num_rows == 4 and "Scan" in q.explain()


def test_cursor_pages(spark, people):
    q = Query(spark).from_(people).where(P.gt("user_id", 1)).select("user_id")
    page, cursor = q.find_many_cursor("user_id", 2)
    assert [r["user_id"] for r in page] == [2, 3] and cursor == 3
    page, cursor = q.find_many_cursor("user_id", 2, cursor)
    assert [r["user_id"] for r in page] == [4] and cursor is None
    page, _ = q.find_many_cursor("user_id", 2, descending=True)
    assert [r["user_id"] for r in page] == [4, 3]


def test_final_is_the_default_of_replacing_tables(spark, tmp_path):
    spec = table("u", {"id": t.int32(), "v": t.int32()}, order_by="id", version_column="v", path=str(tmp_path / "u"))
    spark.createDataFrame([(1, 1), (1, 2)], "id int, v int").write.parquet(spec.path)
    assert Query(spark).from_(spec).count() == 1 and Query(spark).from_(spec).final(False).count() == 2
    plain = table("u", {"id": t.int32(), "v": t.int32()}, order_by="id", path=spec.path)
    assert Query(spark).from_(plain).count() == 2
    assert spec.engine == engines.replacing_merge_tree("v")


def test_settings_hold_for_one_run(spark, people):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    q = Query(spark).from_(people).group_by("age").select(n=A.count()).settings(spark__sql__shuffle__partitions=2)
    assert len(q.collect()) == 3 and spark.conf.get("spark.sql.shuffle.partitions") == before
    # They hold for a frame and a stream of rows, too, and for them alone.
    cased = Query(spark).from_(people).select(x=F.expr("1 = 1")).settings(spark__sql__ansi__enabled="false", spark__sql__session__timeZone="Asia/Tokyo")
    zoned = cased.select(z=F.expr("current_timezone()"))
    assert zoned.df().first()["z"] == "Asia/Tokyo" == next(zoned.stream())["z"] and spark.conf.get("spark.sql.session.timeZone") == "UTC"
    with pytest.raises(ValueError):
        q.settings(spark__driver__memory="1g")


def test_windows_with_sql_frames(spark, people):
    q = Query(spark).from_(people).window("w", "ORDER BY user_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW").window("s", W.spec("age", "user_id"))
    assert rows(q.select(user_id="user_id", n=q.over("w", "count(*)"), r=q.over("s", F.row_number()))) == [(1, 1, 1), (2, 2, 1), (3, 2, 1), (4, 2, 2)]


def test_suggestions(spark, people, tmp_path):
    spec = table("p", {"user_id": t.int32(), "age": t.int32()}, order_by="user_id", path=str(tmp_path / "p"))
    people.select("user_id", "age").write.parquet(spec.path)
    assert any("sort key" in s for s in Query(spark).from_(spec).order_by("age").suggestions())
    assert any("all pairs" in s for s in Query(spark).from_(people).cross_join(people.select(F.col("age").alias("b"))).suggestions())


def test_database(spark, people):
    db = Database(spark)
    people.createOrReplaceTempView("people")
    assert db.raw("SELECT * FROM people WHERE age = :age", age=25).count() == 2
    spec = table("tessera_made", {"id": t.int32()}, order_by="id")
    db.ensure_table(spec)
    db.ensure_table(spec)
    assert db.table_exists("tessera_made")
    db.drop_table("tessera_made")
    assert not db.table_exists("tessera_made")
