import pytest

from tessera.plans.query import Database
from tessera.table import many, one, table
from tessera.types import t


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("relational")
    users = table("users", {"id": t.int32().primary_key(), "role": t.string(), "team_id": t.int32()}, order_by="id", path=str(d / "users"))
    events = table("events", {"id": t.int32().primary_key(), "user_id": t.int32(), "type": t.string()}, order_by="id", path=str(d / "events"))
    teams = table("teams", {"id": t.int32().primary_key(), "name": t.string()}, order_by="id", path=str(d / "teams"))
    spark.createDataFrame([(1, "admin", 1), (2, "user", None), (3, "user", 9)], "id int, role string, team_id int").write.parquet(users.path)
    spark.createDataFrame([(10, 1, "login"), (11, 1, "click"), (12, 1, "login"), (13, 3, "login")], "id int, user_id int, type string").write.parquet(events.path)
    spark.createDataFrame([(1, "core")], "id int, name string").write.parquet(teams.path)
    events = events.related(user=one(users, ["user_id"], ["id"]))
    users = users.related(events=many(events, ["id"], ["user_id"]), team=one(teams, ["team_id"], ["id"]))
    teams = teams.related(users=many(users, ["id"], ["team_id"]))
    return Database(spark, {"users": users, "events": events, "teams": teams})


def test_siblings_do_not_multiply(db):
    out = {r["id"]: r for r in db.query.users.find_many(with_={"events": True, "team": True}).collect()}
    assert [e["id"] for e in out[1]["events"]] == [10, 11, 12] and out[2]["events"] == [] and out[1]["team"]["name"] == "core" and out[3]["team"] is None


def test_nested_order_limit_offset_and_filter(db):
    out = db.query.users.find_by_id(1, with_={"events": {"order_by": {"id": "desc"}, "limit": 1, "offset": 1, "columns": ["id"]}})
    assert [tuple(e) for e in out["events"]] == [(11,)]
    out = db.query.users.find_many(where=lambda u, op: op["in_array"](u.id, [1, 3]), with_={"events": {"where": {"type": "login"}}}, order_by="id").collect()
    assert [[e["id"] for e in r["events"]] for r in out] == [[10, 12], [13]]


def test_three_levels(db):
    out = db.query.teams.find_first(with_={"users": {"with_": {"events": {"columns": ["type"]}}}})
    assert [e["type"] for e in out["users"][0]["events"]] == ["login", "click", "login"]


def test_columns_and_limits(db):
    out = db.query.users.find_many(columns={"role": True, "id": False}, order_by=[{"id": "desc"}], limit=2)
    assert out.columns == ["role"] and out.count() == 2
    for strategy in ("standard", "global", "any", "global_any"):
        assert db.query.events.find_many(with_={"user": True}, join_strategy=strategy).count() == 4


def test_mistakes(db):
    with pytest.raises(ValueError):
        db.query.users.find_many(with_={"nope": True})
    with pytest.raises(ValueError):
        db.query.users.find_by_id(1, 2)
    with pytest.raises(ValueError):
        db.query.users.find_many(join_strategy="fast")
    with pytest.raises(AttributeError):
        db.query.nope
