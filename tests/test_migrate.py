import pytest

from tessera import engines
from tessera.plans import migrate as M
from tessera.table import table
from tessera.types import t

USERS = {"id": t.int32(), "name": t.string()}


def users(**columns):
    return table("mig_users", {**USERS, **columns}, order_by="id")


@pytest.fixture(autouse=True)
def clean(spark):
    yield
    for n in ("mig_users", "mig_users__old", "mig_users__shadow", "mig_history", "mig_new", "resumed", "resumed_history"):
        spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_create_then_nothing(spark):
    assert M.push(spark, {"u": users()}, dry_run=True)[0].startswith("CREATE TABLE") and not spark.catalog.tableExists("mig_users")
    M.push(spark, {"u": users()})
    assert M.detect_schema_drift(spark, {"u": users()})[0].kind == "none" and M.push(spark, {"u": users()}) == []


def test_add_column_in_place(spark):
    M.push(spark, {"u": users()})
    drift = M.diff_table(users(age=t.int32()), M.describe_table(spark, "mig_users"))
    assert drift.added == ("age",) and not drift.destructive and drift.plan[0].startswith("ALTER TABLE mig_users ADD COLUMNS")
    M.push(spark, {"u": users(age=t.int32())})
    assert "age" in spark.table("mig_users").columns


def test_shadow_keeps_rows(spark):
    M.push(spark, {"u": users(age=t.int32())})
    spark.sql("INSERT INTO mig_users VALUES (1, 'a', 7)")
    changed = table("mig_users", {"id": t.int64(), "name": t.string()}, order_by="id")
    with pytest.raises(ValueError, match="drops column age"):
        M.push(spark, {"u": changed})
    M.push(spark, {"u": changed}, allow_destructive=True)
    assert [tuple(r) for r in spark.table("mig_users").collect()] == [(1, "a")] and spark.table("mig_users").schema["id"].dataType.simpleString() == "bigint"


def test_widening_is_not_destructive():
    stored = M.Stored({"id": "int", "name": "string"})
    assert not M.diff_table(table("mig_users", {"id": t.int64(), "name": t.string()}, order_by="id"), stored).destructive
    assert M.diff_table(table("mig_users", {"id": t.string(), "name": t.string()}, order_by="id"), stored).destructive
    other = table("mig_users", USERS, order_by="id", engine=engines.log())
    assert M.diff_table(other, M.Stored({"id": "int", "name": "string"}, {"engine": "MergeTree"})).options


def test_skipped_and_twice(spark):
    ext = table("ext", USERS, order_by="id", externally_managed=True)
    assert M.diff_table(ext, None).kind == "skipped"
    with pytest.raises(ValueError, match="twice"):
        M.detect_schema_drift(spark, {"a": users(), "b": users()})


def test_generate_from_snapshots():
    first, snap = M.generate({"u": users()}, {})
    assert first[0].startswith("CREATE TABLE") and M.generate({"u": users()}, snap)[0] == []
    second, _ = M.generate({"u": users(age=t.int32())}, snap)
    assert second == ["ALTER TABLE mig_users ADD COLUMNS (`age` int)"] and "mig_users" in M.save_snapshot({"u": users()})


def test_validation_lists_differences(spark):
    assert M.validate_tables(spark, {"u": users()}) == ["mig_users: missing"]
    M.push(spark, {"u": users()})
    assert M.validate_tables(spark, {"u": users()}) == [] and M.validate_tables(spark, {"u": users(age=t.int32())}) == ["mig_users: lacks column age"]


def test_migrations_run_once(spark):
    files = {"1_a.sql": "CREATE TABLE mig_new (id INT) USING PARQUET; -- made\nINSERT INTO mig_new VALUES (1)", "2_b.sql": "INSERT INTO mig_new VALUES (2)"}
    assert M.migrate(spark, {"1_a.sql": files["1_a.sql"]}, "mig_history") == ["1_a.sql"]
    assert M.status(spark, files, "mig_history") == {"1_a.sql": "applied", "2_b.sql": "pending"}
    assert M.migrate(spark, files, "mig_history") == ["2_b.sql"] and spark.table("mig_new").count() == 2


def test_statements_and_check():
    assert M.statements("SELECT ';' AS a; -- x\n;SELECT 2") == ["SELECT ';' AS a", "SELECT 2"]
    found = M.check("DROP TABLE a; SELECT (1; ALTER TABLE b DROP COLUMN c")
    assert sum(f.startswith("destructive") for f in found) == 2 and any("brackets" in f for f in found)


def test_pull_and_list(spark):
    M.push(spark, {"u": users()})
    source = M.pull(spark, ["mig_users"])
    scope: dict = {}
    exec(source, scope)
    assert list(scope["mig_users"].columns) == ["id", "name"] and scope["mig_users"].order_by == ("id",)
    assert any(x["name"] == "mig_users" for x in M.list_tables(spark)) and "id: int" in M.schema_text(spark, "mig_users")
    with pytest.raises(PermissionError):
        M.drop(spark, "mig_users")
    spark.sql("INSERT INTO mig_users VALUES (1, 'a')")
    M.truncate(spark, "mig_users", confirmed=True)
    assert spark.table("mig_users").count() == 0
    M.reset(spark, {"u": users()}, confirmed=True)
    M.drop(spark, "mig_users", confirmed=True)
    assert not spark.catalog.tableExists("mig_users")


def test_config():
    good = {"schema": "a.py", "out": "out", "databases": {"main": {"database": "default"}}}
    assert M.validate_config(good) == []
    assert M.validate_config({**good, "default": "x"}) and M.validate_config({**good, "databases": {}}) and M.validate_config({"schema": "", "out": 1, "databases": {"a": {"database": "1x"}, "b": 3}})


def test_statements_with_marks_inside_quotes():
    text = """INSERT INTO t VALUES ('a--b; c', 'it''s'); -- a note; with 'a quote
    SELECT "x;--y", `q;`; /* gone;
    too */ SELECT 1 -- end"""
    assert M.statements(text) == ["INSERT INTO t VALUES ('a--b; c', 'it''s')", 'SELECT "x;--y", `q;`', "SELECT 1"]


def test_a_migration_goes_on_where_it_failed(spark):
    spark.sql("DROP TABLE IF EXISTS resumed")
    files = {"1.sql": "CREATE TABLE resumed (n INT) USING PARQUET; INSERT INTO resumed VALUES (1); SELECT * FROM no_such_table"}
    with pytest.raises(Exception, match="no_such_table"):
        M.migrate(spark, files, "resumed_history")
    assert M.status(spark, files, "resumed_history") == {"1.sql": "begun"}
    files["1.sql"] = files["1.sql"].replace("no_such_table", "resumed")
    assert M.migrate(spark, files, "resumed_history") == ["1.sql"] and M.migrate(spark, files, "resumed_history") == []
    assert spark.table("resumed").count() == 1
