"""More of the catalog: reading and writing tables, fetch helpers, engines, views, dictionaries and schema tooling. What a
query writes goes to this application's scratch folder or to tables that it drops again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera import engines, scratch, types
from tessera.catalog import money, query, read, specs
from tessera.functions import aggregates as A
from tessera.functions import predicates as P
from tessera.plans import migrate, views
from tessera.plans.query import Database, Query
from tessera.plans.relational import Fetch, Relational
from tessera.sources import dml, external
from tessera.sources.dictionary import dictionary
from tessera.streaming import incremental
from tessera.table import define_columns, derive_table, extend_columns, generate_types, index, render_schema, table, versioned_table
from tessera.types import t


def _flags(spark, **named):
    """One row for each remark and whether it held."""
    return spark.createDataFrame(list(named.items()), "what string, held boolean")


def _held(*names: str) -> str:
    return "SELECT what, true AS held FROM (VALUES " + ", ".join(f"('{n}')" for n in names) + ") AS v(what)"


def _refused(kind, f, *args, **options) -> bool:
    try:
        f(*args, **options)
    except kind:
        return True
    return False


# Fetch helpers and clauses.


@query("SELECT * FROM (SELECT 'first' AS how, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) UNION ALL SELECT * FROM (SELECT 'unique', o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7)")
def fetch_first(spark, sf):
    q = Query(spark).from_(specs(sf)["orders"]).select("o_orderkey", "o_totalprice")
    first, unique = q.order_by(("o_totalprice", "desc"), "o_orderkey").find_first(), q.where(P.eq("o_orderkey", 7)).find_unique()
    return spark.createDataFrame([("first", *first), ("unique", *unique)], "how string, o_orderkey bigint, o_totalprice double")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 8 OFFSET 3")
def fetch_many(spark, sf):
    rows = Query(spark).from_(specs(sf)["nation"]).select("nNationkey", "N_NAME").order_by("n_nationkey").find_many(limit=8, offset=3)
    return spark.createDataFrame(rows, "n_nationkey int, n_name string")


@query("SELECT (SELECT count(*) FROM orders) AS n, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n_f, true AS some, false AS none, true AS more, (SELECT count(*) FROM nation) AS total, 5 AS shown")
def fetch_counts(spark, sf):
    s = specs(sf)
    q = Query(spark).from_(s["orders"])
    meta = Query(spark).from_(s["nation"]).order_by("n_nationkey").find_many_with_meta(5, total=True)
    row = (q.count(), q.where({"o_orderstatus": "F"}).count(), q.exists(), q.where("o_orderkey < 0").exists(), meta["has_more"], meta["total"], len(meta["data"]))
    return spark.createDataFrame([row], "n bigint, n_f bigint, some boolean, none boolean, more boolean, total bigint, shown int")


@query("SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY 1")
def fetch_grouped(spark, sf):
    out = Query(spark).from_(specs(sf)["nation"]).find_grouped("n_regionkey")
    return out.select("n_regionkey", F.array_sort(F.transform("rows", lambda r: r["n_nationkey"])).alias("keys"))


@query("SELECT n_nationkey, n_name, n_name AS arrow_name, n_name AS vector_name, n_name AS streamed FROM nation")
def fetch_forms(spark, sf):
    q = Query(spark).from_(specs(sf)["nation"]).order_by("n_nationkey")
    by_key, arrow, vector = q.find_as_map("n_nationkey"), q.native().to_pylist(), q.vector().to_pylist()
    rows = [(r["n_nationkey"], by_key[r["n_nationkey"]]["n_name"], a["n_name"], v["n_name"], r["n_name"]) for r, a, v in zip(q.stream(), arrow, vector, strict=True)]
    return spark.createDataFrame(rows, "n_nationkey int, n_name string, arrow_name string, vector_name string, streamed string")


@query("SELECT o_orderstatus, count(*) AS n, 'Asia/Tokyo' AS zone FROM orders GROUP BY 1")
def clause_settings(spark, sf):
    q = Query(spark).from_(specs(sf)["orders"]).group_by("o_orderstatus").select(o_orderstatus="o_orderstatus", n=A.count(), zone=F.current_timezone())
    return spark.createDataFrame(q.settings(spark__sql__session__timeZone="Asia/Tokyo", spark__sql__shuffle__partitions=3).collect(), "o_orderstatus string, n bigint, zone string")


@query(_held("pushed", "columns", "physical", "sorted", "pairs"))
def clause_explain(spark, sf):
    s = specs(sf)
    q = Query(spark).from_(s["orders"]).where(P.gt("o_totalprice", 1000.0)).select("o_orderkey")
    plan, remarks = q.explain(), q.order_by("o_orderkey").suggestions()
    product = Query(spark).from_(s["orders"]).inner_join(s["customer"], F.col("o_custkey") < F.col("c_custkey")).suggestions()
    return _flags(spark, pushed="PushedFilters: [IsNotNull(o_totalprice)" in plan, columns="o_orderpriority" not in plan, physical="Scan parquet" in q.explain_pipeline(), sorted=any("without limit" in r for r in remarks), pairs=any("all pairs" in r for r in product))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_all(spark, sf):
    s = specs(sf)
    return Query(spark).from_(s["orders"]).all_join("inner", s["customer"], s["orders"].o_custkey == s["customer"].c_custkey).select("o_orderkey", "c_name").df()


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) USING (c_custkey)")
def join_global_any(spark, sf):
    right = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return Query(spark).from_(specs(sf)["customer"]).global_any_join("left", right, ["c_custkey"], order=[-F.col("o_orderkey")]).select("c_custkey", "o_orderkey").df()


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1")
def join_global_left(spark, sf):
    near = read(spark, sf, "nation").where("n_regionkey = 1")
    return Query(spark).from_(specs(sf)["customer"]).global_left_join(near, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name").df()


@query("""SELECT l.event_id, r.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'error') l ASOF LEFT JOIN
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'click') WHERE k = 1) r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def join_global_asof(spark, sf):
    events = read(spark, sf, "events")
    left = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("click_ts"))
    return Query(spark).from_(left).global_asof_join(right, ["user_id"], "ts", "click_ts", tie=["click_id"]).select("event_id", "click_id").df()


_STRATEGIES = ("auto", "standard", "global", "any", "global_any")


@query("SELECT how, c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey, (VALUES " + ", ".join(f"('{s}')" for s in _STRATEGIES) + ") AS v(how)")
def relation_strategies(spark, sf):
    out = None
    for how in _STRATEGIES:
        rows = Fetch(spark, specs(sf)["customer"]).find_many(columns=["c_custkey"], with_={"nation": {"columns": ["n_name"]}}, join_strategy=how)
        rows = rows.select(F.lit(how).alias("how"), "c_custkey", F.col("nation.n_name").alias("n_name"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT * FROM (SELECT 'first' AS how, c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1) UNION ALL SELECT 'id', c_custkey, c_name FROM customer WHERE c_custkey = 11")
def relation_rows(spark, sf):
    db = Relational(spark, specs(sf))
    first = db.customer.find_first(order_by=[{"c_acctbal": "desc"}, "c_custkey"], columns=["c_custkey", "c_name"])
    one = db.customer.find_by_id(11, columns={"c_custkey": True, "c_name": True, "c_acctbal": False})
    return spark.createDataFrame([("first", *first), ("id", *one)], "how string, c_custkey bigint, c_name string")


# Sources.


@query("SELECT count(*) AS n, count(*) AS n_distinct FROM events")
def sample_parts(spark, sf):
    events = table("events", {"event_id": t.int64(), "user_id": t.int64()}, order_by="event_id", sample_by="event_id", path=f"{sf}/events.parquet")
    parts = [Query(spark).from_(events).sample(0.25, k / 4).select("event_id") for k in range(4)]
    every = parts[0].union_all(parts[1]).union_all(parts[2]).union_all(parts[3])
    return every.df().agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_distinct"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 5000.5 AND o_orderpriority <> 'x''; DROP TABLE y' GROUP BY 1")
def source_raw(spark, sf):
    db, name = Database(spark), f"orders_{uuid.uuid4().hex}"
    read(spark, sf, "orders").createOrReplaceTempView(name)
    db.command(f"CREATE OR REPLACE TEMPORARY VIEW {name}_dear AS SELECT * FROM {name} WHERE o_totalprice > 5000.5")
    return db.raw(f"SELECT o_orderstatus, count(*) AS n FROM {name}_dear WHERE o_orderpriority <> :not GROUP BY 1", **{"not": "x'; DROP TABLE y"})


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey + 10, r_name FROM region UNION ALL SELECT r_regionkey + 20, r_name FROM region")
def source_files(spark, sf):
    """A file, a download and a round trip through text, by function and by engine."""
    plain = external.file(spark, f"{sf}/region.parquet")
    loaded = external.of_engine(spark, engines.url_engine(f"file://{sf}/region.parquet", "Parquet"))
    path = scratch.scratch_path(spark, "region-csv")
    external.write(plain, path, "CSVWithNames", compression="gzip")
    back = external.of_engine(spark, engines.file_engine("CSVWithNames", path), "r_regionkey Int32, r_name String")
    return plain.unionByName(loaded.withColumn("r_regionkey", F.col("r_regionkey") + 10)).unionByName(back.withColumn("r_regionkey", F.col("r_regionkey") + 20))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT number, 'numbers' FROM (SELECT unnest(range(5, 25)) AS number)")
def source_made(spark, sf):
    rows = [tuple(r) for r in read(spark, sf, "region").collect()]
    given = external.values(spark, rows, "r_regionkey Int32, r_name String")
    numbers = external.numbers(spark, 20, 5).select(F.col("number").cast("int").alias("r_regionkey"), F.lit("numbers").alias("r_name"))
    return given.unionByName(numbers)


@query(_held("as_many", "again", "another", "short", "ranged"))
def source_random(spark, sf):
    made = lambda seed: external.generate_random(spark, "a Int32, b String, c Array(Float64)", 500, seed, 6, 3)
    one, two, three = made(1), made(1), made(2)
    return _flags(spark, as_many=one.count() == 500, again=one.exceptAll(two).isEmpty(), another=not one.exceptAll(three).isEmpty(), short=one.where("length(b) > 6 or size(c) > 3").isEmpty(), ranged=one.where("exists(c, x -> x < 0 or x >= 1)").isEmpty())


@query(_held("s3", "mysql", "postgresql", "hdfs", "kafka", "cluster"))
def source_options(spark, sf):
    """Sources whose connector or server is not here: what they would be asked for."""
    my, pg = (external.jdbc_options(k, "h", "d", "t", "u", "p") for k in ("mysql", "postgresql"))
    kafka = incremental.kafka_options(engines.kafka_engine("b:9092", "clicks", "g"), max_offsets=5)
    return _flags(
        spark, s3=_refused(ValueError, external.s3, spark, "http://x"), cluster=_refused(ValueError, external.s3_cluster, spark, "c", "http://x"), hdfs=_refused(ValueError, external.hdfs, spark, "/local"),
        mysql=my["url"] == "jdbc:mysql://h:3306/d" and my["driver"] == "com.mysql.cj.jdbc.Driver", postgresql=pg["url"] == "jdbc:postgresql://h:5432/d" and pg["dbtable"] == "t", kafka=kafka["subscribe"] == "clicks" and kafka["maxOffsetsPerTrigger"] == "5",
    )


# Inserts, updates, deletes.

_ORDER = {"o_orderkey": t.int64(), "o_custkey": t.int64(), "o_orderstatus": t.string(), "o_totalprice": t.float64()}


def _copy(spark, sf, **options):
    """An own copy of the orders, inserted through the library."""
    spec = table("orders_copy", dict(_ORDER), order_by="o_orderkey", path=scratch.scratch_path(spark, "orders-copy"), **options)
    dml.insert(spark, spec).values(read(spark, sf, "orders").select(*_ORDER)).execute()
    return spec


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def dml_insert(spark, sf):
    return _copy(spark, sf).read(spark)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def dml_update(spark, sf):
    spec = _copy(spark, sf, append_only=False)
    dml.update(spark, spec, {"o_orderstatus": "done", "o_custkey": F.col("o_custkey") + 1}, P.eq("o_orderstatus", "F"))
    return spec.read(spark)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE NOT (o_totalprice < 100000)")
def dml_delete(spark, sf):
    spec = _copy(spark, sf, append_only=False)
    dml.delete(spark, spec, "o_totalprice < 100000")
    return spec.read(spark)


@query("SELECT n_nationkey, n_name, 'new' AS state, upper(n_name) AS loud, '{\"r\":' || n_regionkey || '}' AS extra, true AS has_id, true AS has_time, 7 AS level FROM nation")
def dml_defaults(spark, sf):
    columns = {"id": t.uuid().auto_generate(7), "n_nationkey": t.int32(), "n_name": t.string(), "state": t.enum8(["new", "old"]).default("new"), "loud": t.string().default_from(lambda r: r["n_name"].upper()), "extra": t.json(), "at": types.created_at(), "level": t.int32().default(7)}
    spec = table("nations_copy", columns, order_by="n_nationkey", path=scratch.scratch_path(spark, "nations-copy"))
    rows = [{"n_nationkey": r["n_nationkey"], "n_name": r["n_name"], "extra": {"r": r["n_regionkey"]}} for r in read(spark, sf, "nation").collect()]
    dml.insert(spark, spec).values(rows).execute()
    return spec.read(spark).select("n_nationkey", "n_name", "state", "loud", F.to_json("extra").alias("extra"), F.col("id").rlike("^[0-9a-f-]{36}$").alias("has_id"), F.col("created_at").isNotNull().alias("has_time"), "level")


_NATION = {"n_nationkey": t.int32(), "n_name": t.string(), "n_regionkey": t.int32()}


def _nations(spark, name="nations", **options):
    return table(name, dict(_NATION), order_by="n_nationkey", path=scratch.scratch_path(spark, "nations"), **options)


@query("SELECT how, n_nationkey, n_name, n_regionkey FROM nation, (VALUES ('many'), ('blocks'), ('batcher'), ('json'), ('compact'), ('binary'), ('turbo'), ('async'), ('unchecked')) AS v(how)")
def dml_insert_ways(spark, sf):
    rows = [r.asDict() for r in read(spark, sf, "nation").collect()]
    out = None
    for how in ("many", "blocks", "batcher", "json", "compact", "binary", "turbo", "async", "unchecked"):
        spec = _nations(spark)
        made = dml.insert(spark, spec).values(rows)
        if how == "many":
            dml.insert_many(spark, spec, iter(rows), block=10)
        elif how == "blocks":
            made.max_block_size(4).execute()
        elif how == "batcher":
            with dml.Batcher(spark, spec, rows=10, seconds=60) as b:
                for r in rows:
                    b.append(r)
        else:
            ways = {"json": made.use_json_format, "compact": made.use_compact_format, "binary": made.use_binary_format, "turbo": made.turbo, "async": made.async_insert, "unchecked": lambda m=made: m.skip_validation().sync_insert()}
            ways[how]().execute()
        stored = spec.read(spark).withColumn("how", F.lit(how))
        out = stored if out is None else out.unionByName(stored)
    return out


@query("SELECT n_nationkey, n_name, n_regionkey, 'many' AS how FROM nation UNION ALL SELECT 99, 'NEW', 1, 'one'")
def dml_returning(spark, sf):
    spec = _nations(spark)
    back = dml.insert(spark, spec).values(read(spark, sf, "nation")).returning().execute().withColumn("how", F.lit("many"))
    one = dml.insert(spark, spec).values({"n_nationkey": 99, "n_name": "NEW", "n_regionkey": 1}).returning_one()
    none = dml.insert(spark, spec).values({"n_nationkey": 98, "n_name": "OLD", "n_regionkey": 1}).returning().no_returning().execute()
    assert none is None
    return back.unionByName(spark.createDataFrame([(*one, "one")], back.schema))


@query(_held("update_append_only", "delete_append_only", "no_condition", "nothing_set", "unknown_column", "read_only", "bad_enum", "null_refused", "out_of_range"))
def dml_guards(spark, sf):
    spec, free = _nations(spark), _nations(spark, append_only=False)
    dml.insert(spark, free).values({"n_nationkey": 1, "n_name": "x", "n_regionkey": 1}).execute()
    strict = table("strict", {"k": t.uint8(), "e": t.enum8(["a", "b"])}, order_by="k", path=scratch.scratch_path(spark, "strict"))
    put = lambda row: _refused(Exception, dml.insert(spark, strict).values(row).execute)
    return _flags(
        spark, update_append_only=_refused(PermissionError, dml.update, spark, spec, {"n_name": "x"}, "true"), delete_append_only=_refused(PermissionError, dml.delete, spark, spec, "true"), no_condition=_refused(ValueError, dml.delete, spark, free, None),
        nothing_set=_refused(ValueError, dml.update, spark, free, {}, "true"), unknown_column=_refused(ValueError, dml.update, spark, free, {"x": 1}, "true"), read_only=_refused(PermissionError, dml.insert, spark, _nations(spark, read_only=True)),
        bad_enum=put({"k": 1, "e": "c"}), null_refused=put({"k": None, "e": "a"}), out_of_range=put({"k": 300, "e": "a"}),
    )


@query(_held("absent", "created", "kept", "dropped"))
def dml_tables(spark, sf):
    db, name = Database(spark), f"tessera_{uuid.uuid4().hex}"
    spec = table(name, dict(_NATION), order_by="n_nationkey")
    absent = not db.table_exists(name)
    db.ensure_table(spec)
    created = db.table_exists(name)
    dml.insert(spark, spec).values(read(spark, sf, "nation")).execute()
    db.ensure_table(spec)
    kept = spark.table(name).count() == read(spark, sf, "nation").count()
    db.drop_table(name)
    return _flags(spark, absent=absent, created=created, kept=kept, dropped=not db.table_exists(name))


# Engines.


@query("SELECT how, n_nationkey, n_name, n_regionkey FROM nation, (VALUES ('merge_tree'), ('log'), ('tiny_log'), ('memory'), ('distributed'), ('buffer'), ('buffer_explicit'), ('replicated')) AS v(how)")
def engine_storage(spark, sf):
    """Engines that keep rows as they come."""
    made = {"merge_tree": engines.merge_tree(), "log": engines.log(), "tiny_log": engines.tiny_log(), "memory": engines.memory(), "distributed": engines.distributed("c", "t", "n_regionkey"), "replicated": engines.replicated(engines.merge_tree(), "/p", "r")}
    made |= {"buffer": engines.buffer("t", 10, 60.0), "buffer_explicit": engines.buffer_explicit("t", 2, 1.0, 60.0, 1, 10, 1, 1000)}
    out = None
    for how, engine in made.items():
        spec = _nations(spark, engine=engine)
        if engine.name == "Buffer":
            with dml.Batcher(spark, spec, engine.option("rows"), engine.option("seconds")) as b:
                for r in read(spark, sf, "nation").collect():
                    b.append(r.asDict())
        else:
            dml.insert(spark, spec).values(read(spark, sf, "nation")).execute()
        rows = Query(spark).from_(spec).df().withColumn("how", F.lit(how))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT count(*) AS returned, 0 AS stored FROM nation")
def engine_null(spark, sf):
    spec = _nations(spark, engine=engines.null())
    back = dml.insert(spark, spec).values(read(spark, sf, "nation")).returning().execute()
    return back.agg(F.count("*").alias("returned")).withColumn("stored", F.lit(int(scratch.exists(spark, spec.path))))


@query("SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def engine_replicated(spark, sf):
    """A replicated engine has its base's semantics, and a replacing table reads merged rows."""
    columns = {"user_id": t.int64(), "event_id": t.int64(), "event_type": t.string()}
    spec = table("latest", columns, order_by="user_id", engine=engines.replicated(engines.replacing_merge_tree("event_id")), path=scratch.scratch_path(spark, "latest"))
    dml.insert(spark, spec).values(read(spark, sf, "events").select(*columns)).execute()
    return Query(spark).from_(spec).final().select("user_id", "event_type").df()


@query("SELECT user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS time, round(avg(value), 6) AS value FROM (SELECT user_id, ts, max_by(value, event_id) AS value FROM events GROUP BY 1, 2) GROUP BY 1, 2")
def engine_graphite(spark, sf):
    rows = read(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("ts").alias("time"), "value", F.col("event_id").alias("version"))
    out = engines.final(rows, engines.graphite_merge_tree(rules=[(0, 3600)]), ["path"], now=F.lit("2030-01-01").cast("timestamp"))
    return out.select(F.col("path").alias("user_id"), F.col("time").cast("timestamp_ntz").alias("time"), F.round("value", 6).alias("value"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def engine_join(spark, sf):
    twice = read(spark, sf, "nation").union(read(spark, sf, "nation"))
    side = engines.prepared(twice, engines.join_engine("ANY", "LEFT", "n_nationkey"))
    return read(spark, sf, "customer").join(side, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def engine_dictionary(spark, sf):
    known = {"nations": dictionary("nations", read(spark, sf, "nation"), "n_nationkey")}
    named = engines.dictionary_engine("nations").option("dictionary")
    return known[named].get(read(spark, sf, "supplier"), "s_nationkey", "n_name").select("s_suppkey", "n_name")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def engine_kafka(spark, sf):
    """What a topic's engine makes of its messages."""
    engine = engines.kafka_engine("b:9092", "props", "g", "JSONCompactEachRow")
    sent = read(spark, sf, "events").select(F.concat(F.lit("["), "event_id", F.lit(","), F.get_json_object("props", "$.k"), F.lit("]")).cast("binary").alias("value"))
    return incremental.messages(sent, "event_id Int64, k Int32", engine.option("format"))


@query(_held("s3", "postgresql", "mysql", "family", "replica", "version"))
def engine_options(spark, sf):
    s3 = engines.s3_engine("s3://b/k", "Parquet")
    pg, my = engines.postgresql_engine("jdbc:postgresql://h/d", "t"), engines.mysql_engine("jdbc:mysql://h/d", "t")
    return _flags(
        spark, s3=(s3.option("path"), s3.option("format")) == ("s3://b/k", "Parquet"), postgresql=external.engine_options(pg)["dbtable"] == "t", mysql=external.engine_options(my)["url"] == "jdbc:mysql://h/d",
        family=engines.is_merge_tree_family(engines.merge_tree()) and not engines.is_merge_tree_family(engines.log()), replica=engines.is_replicated_engine(engines.replicated()), version=engines.version_column(engines.replacing_merge_tree("v")) == "v",
    )


# Dictionaries.


@query("SELECT c_custkey, c_nationkey AS one, n_regionkey AS two, CAST(NULL AS INTEGER) AS three FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def dict_ancestor(spark, sf):
    up = read(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), (F.col("n_regionkey") + 1000).alias("parent"))
    up = up.unionByName(read(spark, sf, "region").select((F.col("r_regionkey") + 1000).alias("key"), F.lit(None).cast("int").alias("parent")))
    d = dictionary("tree", up, "key", parent="parent")
    out = read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    for level, name in ((1, "one"), (2, "two"), (3, "three")):
        out = d.get_ancestor(out, "c_nationkey", level, name)
    return out.select("c_custkey", "one", (F.col("two") - 1000).alias("two"), "three")


@query("""SELECT event_id, CASE WHEN user_id < 50 THEN 'half' WHEN user_id < 64 THEN 'quarter' ELSE 'all' END AS net, CASE WHEN user_id % 2 = 0 THEN 'even' END AS six FROM (SELECT event_id, user_id % 128 AS user_id FROM events)""")
def dict_prefix(spark, sf):
    nets = [("10.0.0.0/8", "all"), ("10.0.0.0/26", "quarter"), *[(f"10.0.0.{i}/32", "half") for i in range(50)]]
    four = dictionary("nets", spark.createDataFrame(nets, "net string, name string"), "net", layout="ip_trie")
    six = dictionary("six", spark.createDataFrame([("2001:db8::/64", "even")], "net string, label string"), "net", layout="ip_trie")
    user = F.col("user_id") % 128
    rows = read(spark, sf, "events").select("event_id", F.concat(F.lit("10.0.0."), user).alias("ip"), F.concat(F.when(user % 2 == 0, "2001:db8::").otherwise("2001:db9::"), F.lower(F.hex(user))).alias("ip6"))
    out = six.get(four.get(rows, "ip", "name"), "ip6", "label")
    return out.select("event_id", F.col("name").alias("net"), F.col("label").alias("six"))


@query("SELECT 'CREATE DICTIONARY nations (n_nationkey int, n_name string, n_regionkey int) PRIMARY KEY n_nationkey LAYOUT(HASHED) LIFETIME(MIN 0 MAX 300)' AS ddl")
def dict_ddl(spark, sf):
    return spark.createDataFrame([(dictionary("nations", read(spark, sf, "nation"), "n_nationkey", lifetime=(0, 300)).to_sql(),)], "ddl string")


# Views.

_ROLLUP = "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_totalprice::DECIMAL(18,2)) AS DOUBLE) AS total FROM orders GROUP BY 1"


def _rollup(rows):
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).alias("total"))


@query(_ROLLUP)
def mv_rollup(spark, sf):
    """Populated with a third of the orders, which come in two batches after that, one of them twice."""
    orders = read(spark, sf, "orders")
    part = lambda k: orders.where(F.col("o_orderkey") % 3 == k)
    view = views.materialized_view("rollup", _rollup, target=scratch.scratch_path(spark, "mv"), group_by=["o_orderstatus"], engine=engines.summing_merge_tree("n", "total"), populate_from=part(0))
    view.apply(part(1), 0)
    view.apply(part(1), 0)
    view.apply(part(2))
    return view.read(spark).select("o_orderstatus", "n", F.col("total").cast("double").alias("total"))


@query(_ROLLUP)
def mv_stream(spark, sf):
    """Kept up to date by a stream of files."""
    at = scratch.scratch_path(spark, "mv-stream")
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    orders.repartition(4).write.parquet(f"{at}/in")
    view = views.materialized_view("rollup", _rollup, target=f"{at}/out", group_by=["o_orderstatus"], engine=engines.summing_merge_tree("n", "total"))
    incremental.maintain(view, incremental.file_stream(spark, f"{at}/in", orders.schema, files_per_trigger=1), f"{at}/checkpoint").awaitTermination()
    return view.read(spark).select("o_orderstatus", "n", F.col("total").cast("double").alias("total"))


@query("SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1 HAVING count(*) > 3 ORDER BY n DESC, c_nationkey LIMIT 10")
def view_builder(spark, sf):
    s = specs(sf)
    q = Query(spark).from_(s["customer"]).inner_join(s["nation"], s["customer"].c_nationkey == s["nation"].n_nationkey).where(P.gt("c_acctbal", 0.0)).group_by("c_nationkey").select(c_nationkey="c_nationkey", n=A.count(), mean=F.round(A.avg("c_acctbal"), 6)).having("n > 3").order_by(("n", "desc"), "c_nationkey").limit(10)
    return spark.table(views.view(spark, f"built_{uuid.uuid4().hex}", q))


@query("SELECT n_nationkey, upper(n_name) AS name FROM nation")
def view_sql(spark, sf):
    name = f"texts_{uuid.uuid4().hex}"
    views.view(spark, name, f"SELECT 1 AS n_nationkey, 'x' AS name FROM parquet.`{sf}/nation.parquet`", temporary=True)
    return spark.table(views.view(spark, name, f"SELECT n_nationkey, upper(n_name) AS name FROM parquet.`{sf}/nation.parquet`", or_replace=True, temporary=True))


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(o_totalprice::DECIMAL(18,2)) AS DOUBLE) AS total, 'projection' AS how FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*), max(o_totalprice), 'source' FROM orders GROUP BY 1")
def projection_route(spark, sf):
    orders = read(spark, sf, "orders").withColumn("price", money("o_totalprice"))
    wanted = {"n": ("count", "*"), "total": ("sum", "price")}
    p = views.projection("by_status", ["o_orderstatus", "o_custkey"], wanted).build(orders, scratch.scratch_path(spark, "projection"))
    routed = views.route(orders, [p], ["o_orderstatus"], wanted).withColumn("how", F.lit("projection"))
    direct = views.route(orders, [p], ["o_orderpriority"], {"n": ("count", "*"), "total": ("max", "o_totalprice")}).withColumn("how", F.lit("source"))
    shaped = lambda d, k: d.select(F.col(k).alias("o_orderstatus"), "n", F.col("total").cast("double").alias("total"), "how")
    return shaped(routed, "o_orderstatus").unionByName(shaped(direct, "o_orderpriority"))


@query("SELECT 'by_status' AS name, 'SELECT o_orderstatus, count(*) AS n GROUP BY o_orderstatus' AS query")
def projection_text(spark, sf):
    made = views.to_projection_definition(views.projection("by_status", ["o_orderstatus"], {"n": ("count", "*")}))
    return spark.createDataFrame([(made["name"], made["query"])], "name string, query string")


@query("SELECT * FROM (VALUES ('normalized', 'SELECT A,COUNT(*)FROM T WHERE B=''x y'' GROUP BY A'), ('extracted', 'SELECT a FROM t'), ('same', 'false'), ('other', 'true'), ('plans', 'false')) AS v(what, text)")
def view_drift(spark, sf):
    one, two = "select a , count( * )\nfrom t where b='x y'  group by a;", "SELECT a, COUNT(*) FROM t WHERE b='x y' GROUP BY a"
    nation = lambda: read(spark, sf, "nation").select("n_name")
    rows = [("normalized", views.normalize_sql(one)), ("extracted", views.extract_mv_query("CREATE MATERIALIZED VIEW v TO x AS SELECT a FROM t;")), ("same", str(views.detect_drift(one, two)).lower()), ("other", str(views.detect_drift(one, two.replace("x y", "x  y"))).lower()), ("plans", str(views.detect_drift(nation(), nation())).lower())]
    return spark.createDataFrame(rows, "what string, text string")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def view_blue_green(spark, sf):
    name, source = f"counts_{uuid.uuid4().hex}", f"nation_{uuid.uuid4().hex}"
    read(spark, sf, "nation").createOrReplaceTempView(source)
    spark.sql(f"CREATE TABLE {name} USING PARQUET AS SELECT n_regionkey, 0L AS n FROM {source}")
    for statement in views.blue_green("counts", f"SELECT n_regionkey, count(*) AS n FROM {source} GROUP BY n_regionkey", name):
        if not statement.startswith("--"):
            spark.sql(statement)
    rows = spark.table(name).collect()
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame(rows, "n_regionkey int, n bigint")


@query("SELECT c_custkey AS id, upper(c_name) AS name, c_acctbal * 100 AS cents FROM customer")
def view_bridge(spark, sf):
    target = scratch.scratch_path(spark, "bridge")
    views.migration_bridge(read(spark, sf, "customer"), target, {"id": "c_custkey", "name": F.upper("c_name"), "cents": "c_acctbal * 100"})
    return spark.read.parquet(target)


# Tables and types.


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity::DECIMAL(18,2)) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1")
def table_derived(spark, sf):
    out = derive_table(read(spark, sf, "lineitem"), ["l_returnflag"], {"n": F.count("*"), "quantity": F.sum(money("l_quantity"))})
    return out.withColumn("quantity", F.col("quantity").cast("double"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def table_versioned(spark, sf):
    base = f"nations_{uuid.uuid4().hex}"
    spec, sql = versioned_table(base, 2, extend_columns(define_columns({"n_nationkey": t.int32()}), {"n_name": t.string(), "n_regionkey": t.int32()}), order_by="n_nationkey")
    db = Database(spark)
    db.ensure_table(spec)
    dml.insert(spark, spec).values(read(spark, sf, "nation")).execute()
    db.command(sql)
    rows = spark.table(base).collect()
    db.command(f"DROP VIEW {base}")
    db.drop_table(spec.name)
    return spark.createDataFrame(rows, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT * FROM (VALUES ('id', 'int'), ('name', 'string'), ('price', 'decimal(18,4)'), ('tags', 'array<string>'), ('created_at', 'timestamp')) AS v(name, type)")
def table_ddl(spark, sf):
    name = f"made_{uuid.uuid4().hex}"
    spec = table(name, {"id": t.int32().primary_key(), "name": t.string().nullable(), "price": t.decimal(18, 4), "tags": t.array(t.string()), "at": types.created_at()}, order_by="id", indices=[index("by_name").on("name").type("bloom_filter")])
    spark.sql(render_schema(spec))
    rows = [(f.name, f.dataType.simpleString()) for f in spark.table(name).schema.fields]
    Database(spark).drop_table(name)
    return spark.createDataFrame(rows, "name string, type string")


@query(_held("select", "insert", "bloom"))
def table_types(spark, sf):
    spec = table("people", {"id": t.int32().primary_key(), "name": t.string().nullable()}, order_by="id", indices=[index("i").on("name").type("bloom_filter")])
    space: dict = {}
    exec("from typing import NotRequired, TypedDict\n" + generate_types(spec, "Person"), space)
    return _flags(spark, select=space["Person"].__annotations__.keys() == {"id", "name"}, insert="NotRequired" in generate_types(spec), bloom=spec.writer_options() == {"parquet.bloom.filter.enabled#name": "true"})


_STATES = ["on", "off"]
_PRESETS = {
    "low_cardinality_string": types.low_cardinality_string("c"), "low_cardinality_nullable_string": types.low_cardinality_nullable_string("c"), "nullable_json": types.nullable_json("c"), "low_cardinality_json": types.low_cardinality_json("c"),
    "low_cardinality_nullable_json": types.low_cardinality_nullable_json("c"), "enum8": types.enum8(_STATES, "c"), "nullable_enum8": types.nullable_enum8("c", _STATES), "enum16": types.enum16(_STATES, "c"), "nullable_enum16": types.nullable_enum16("c", _STATES),
    "low_cardinality_string_array": types.low_cardinality_string_array("c"), "nullable_string_array": types.nullable_string_array("c"), "string_nullable_array": types.string_nullable_array("c"), "low_cardinality_int32_array": types.low_cardinality_int32_array("c"),
    "email": types.email(), "nullable_email": types.nullable_email(), "phone": types.phone(), "nullable_phone": types.nullable_phone(), "country_code": types.country_code(), "nullable_country_code": types.nullable_country_code(), "status": types.status("c", _STATES),
    "nullable_status": types.nullable_status("c", _STATES), "common_status": types.common_status(), "nullable_common_status": types.nullable_common_status(), "created_at": types.created_at(), "updated_at": types.updated_at(), "deleted_at": types.deleted_at(),
    "uuid_primary_key": types.uuid_primary_key(), "low_cardinality_uuid_primary_key": types.low_cardinality_uuid_primary_key(), "int32_primary_key": types.int32_primary_key(), "int64_primary_key": types.int64_primary_key(),
}
_OF_PRESETS = (
    [(n, "string", "nullable" in n) for n in ("low_cardinality_string", "low_cardinality_nullable_string", "enum8", "nullable_enum8", "enum16", "nullable_enum16", "email", "nullable_email", "phone", "nullable_phone", "country_code", "nullable_country_code", "status", "nullable_status", "common_status", "nullable_common_status", "uuid_primary_key", "low_cardinality_uuid_primary_key")]
    + [("nullable_json", "variant", True), ("low_cardinality_json", "variant", False), ("low_cardinality_nullable_json", "variant", True), ("low_cardinality_string_array", "array<string>", False), ("nullable_string_array", "array<string>", True), ("string_nullable_array", "array<string>", False), ("low_cardinality_int32_array", "array<int>", False)]
    + [("created_at", "timestamp", False), ("updated_at", "timestamp", False), ("deleted_at", "timestamp", True), ("int32_primary_key", "int", False), ("int64_primary_key", "bigint", False)]
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}', {str(nullable).lower()})" for n, k, nullable in _OF_PRESETS) + ") AS v(preset, type, nullable)")
def type_presets(spark, sf):
    rows = [(n, c.field().dataType.simpleString(), c.field().nullable) for n, c in _PRESETS.items()]
    return spark.createDataFrame(rows, "preset string, type string, nullable boolean")


@query("SELECT c_custkey AS id, c_name AS email, CASE WHEN c_custkey % 2 = 0 THEN 'active' ELSE 'pending' END AS status, 'DE' AS country, [c_mktsegment] AS tags, [CAST(c_nationkey AS INTEGER)] AS codes, true AS stamped, CAST(NULL AS VARCHAR) AS phone FROM customer")
def type_presets_stored(spark, sf):
    """Rows go in and out of a table made of presets."""
    columns = {"id": types.int64_primary_key(), "email": types.email(), "phone": types.nullable_phone(), "status": types.common_status(), "country": types.country_code(), "tags": types.low_cardinality_string_array("tags"), "codes": types.low_cardinality_int32_array("codes"), "created_at": types.created_at(), "updated_at": types.updated_at(), "deleted_at": types.deleted_at(), "uid": types.low_cardinality_uuid_primary_key("uid")}
    spec = table("people", columns, order_by="id", path=scratch.scratch_path(spark, "people"))
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"), F.when(F.col("c_custkey") % 2 == 0, "active").otherwise("pending").alias("status"), F.lit("DE").alias("country"), F.array("c_mktsegment").alias("tags"), F.array("c_nationkey").alias("codes"))
    dml.insert(spark, spec).values(rows).execute()
    stamped = F.col("created_at").isNotNull() & F.col("updated_at").isNotNull() & F.col("deleted_at").isNull() & F.col("uid").isNotNull()
    return spec.read(spark).select("id", "email", "status", "country", "tags", "codes", stamped.alias("stamped"), "phone")


# Types that take arguments, by the Spark types that hold them.
_BUILT = {
    "decimal32": (t.decimal32(2), "decimal(9,2)"), "decimal64": (t.decimal64(4), "decimal(18,4)"), "decimal128": (t.decimal128(6), "decimal(38,6)"), "fixed_string": (t.fixed_string(3), "string"), "datetime64": (t.datetime64(6), "timestamp"),
    "timestamp": (t.timestamp(), "timestamp"), "tuple": (t.tuple_(t.int32(), t.string()), "struct<_1:int,_2:string>"), "map": (t.map_(t.string(), t.int64()), "map<string,bigint>"), "nested": (t.nested({"a": t.int32(), "b": t.string()}), "array<struct<a:int,b:string>>"),
    "low_cardinality": (t.low_cardinality(t.string()), "string"), "simple_aggregate_function": (t.simple_aggregate_function("sum", t.int64()), "bigint"), "aggregate_function": (t.aggregate_function("uniq", t.int64()), "binary"),
    "primary_uuid": (types.primary_uuid(), "string"), "primary_uuid_v7": (types.primary_uuid_v7(), "string"), **{n: (c, "timestamp") for n, c in types.timestamps().items()}, **{n: (c, "boolean" if n == "is_deleted" else "timestamp") for n, c in types.soft_deletes().items()},
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{kind}')" for n, (_, kind) in _BUILT.items()) + ") AS v(builder, type)")
def type_builders(spark, sf):
    return spark.createDataFrame([(n, c.field().dataType.simpleString()) for n, (c, _) in _BUILT.items()], "builder string, type string")


@query("SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, coalesce(c_mktsegment, 'none') AS segment, 'web' AS channel, CAST(length(c_name) AS INTEGER) AS size, upper(c_name) AS loud, CAST(1 + c_custkey % 2 AS INTEGER) AS bits FROM customer")
def type_computed(spark, sf):
    """Defaults, columns computed as rows are written and columns computed as they are read; nested values go in and out."""
    columns = {
        "id": t.int64().primary_key(), "name": t.string().not_null().comment("as given"), "segment": t.string().default("none"), "channel": t.string().default_sql("lower('WEB')").codec("ZSTD"),
        "size": t.int32().materialized("length(name)"), "loud": t.string().alias("upper(name)"), "marks": t.map_(t.string(), t.int64()),
    }
    spec = table("computed", columns, order_by="id", path=scratch.scratch_path(spark, "computed"))
    marks = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("a"), F.lit(1).cast("long"))).otherwise(F.create_map(F.lit("a"), F.lit(1).cast("long"), F.lit("b"), F.lit(2).cast("long")))
    dml.insert(spark, spec).values(read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), marks.alias("marks"))).execute()
    return spec.read(spark).select("id", "name", "segment", "channel", "size", "loud", F.size("marks").alias("bits"))


# Schema tooling.


@query(_held("created", "clean", "altered", "kept", "risky", "shadowed", "validated", "described", "counted", "pulled", "listed", "texted", "reset", "truncated", "guarded", "dropped"))
def schema_push(spark, sf):
    name = f"pushed_{uuid.uuid4().hex}"
    spec = lambda **more: {"t": table(name, {"id": t.int32(), **more}, order_by="id")}
    one, two, three = spec(name=t.string()), spec(name=t.string(), age=t.int32().nullable()), spec(name=t.string())
    created = len(migrate.push(spark, one)) == 1 and spark.catalog.tableExists(name)
    clean = not any(d.changed for d in migrate.detect_schema_drift(spark, one))
    spark.sql(f"INSERT INTO {name} VALUES (1, 'a')")
    altered = migrate.push(spark, two, dry_run=True) != [] and migrate.push(spark, two) != [] and "age" in spark.table(name).columns
    kept = spark.table(name).count() == 1
    validated = migrate.validate_tables(spark, two) == [] and migrate.validate_tables(spark, three) != []
    risky = _refused(ValueError, migrate.push, spark, three)
    shadowed = len(migrate.push(spark, three, allow_destructive=True)) > 1 and [tuple(r) for r in spark.table(name).collect()] == [(1, "a")]
    stored = migrate.describe_table(spark, name, count=True)
    described, counted = list(stored.columns) == ["id", "name"], stored.rows == 1
    pulled, texted = "ColumnSpec" in migrate.pull(spark, [name]), "id: int" in migrate.schema_text(spark, name)
    listed = any(x["name"] == name for x in migrate.list_tables(spark))
    guarded = _refused(PermissionError, migrate.truncate, spark, name)
    migrate.truncate(spark, name, confirmed=True)
    truncated = spark.table(name).isEmpty()
    migrate.reset(spark, one, confirmed=True)
    again = spark.catalog.tableExists(name)
    migrate.drop(spark, name, confirmed=True)
    return _flags(spark, created=created, clean=clean, altered=altered, kept=kept, risky=risky, shadowed=shadowed, validated=validated, described=described, counted=counted, pulled=pulled, listed=listed, texted=texted, reset=again, truncated=truncated, guarded=guarded, dropped=not spark.catalog.tableExists(name))


@query("SELECT n_nationkey, n_name FROM nation")
def schema_migrate(spark, sf):
    """Generated statements and one of our own, run once as files."""
    mark = uuid.uuid4().hex
    name, history, source = f"migrated_{mark}", f"history_{mark}", f"nation_{mark}"
    read(spark, sf, "nation").createOrReplaceTempView(source)
    made, snap = migrate.generate({"n": table(name, {"n_nationkey": t.int32(), "n_name": t.string()}, order_by="n_nationkey")}, {})
    files = {"1_make.sql": ";\n".join(made), "2_fill.sql": f"-- all of them\nINSERT INTO {name} SELECT n_nationkey, n_name FROM {source} WHERE n_name <> 'a--b; c';"}
    before = migrate.status(spark, files, history)
    ran, again = migrate.migrate(spark, files, history), migrate.migrate(spark, files, history)
    after = migrate.status(spark, files, history)
    assert set(before.values()) == {"pending"} and set(after.values()) == {"applied"} and ran == sorted(files) and again == [] and name in snap
    rows = spark.table(name).collect()
    for x in (name, history):
        spark.sql(f"DROP TABLE {x}")
    return spark.createDataFrame(rows, "n_nationkey int, n_name string")


@query("SELECT * FROM (VALUES ('create', 'create'), ('same', 'none'), ('added', 'age'), ('modified', 'name string int'), ('dropped', 'x'), ('checked', 'destructive: DROP TABLE t'), ('config', 'databases must name at least one database')) AS v(what, found)")
def schema_diff(spark, sf):
    spec = table("people", {"id": t.int32(), "name": t.int32(), "age": t.int32()}, order_by="id")
    d = migrate.diff_table(spec, migrate.Stored({"id": "int", "name": "string", "x": "int"}))
    same = migrate.diff_table(spec, migrate.Stored({"id": "int", "name": "int", "age": "int"}))
    rows = [("create", migrate.diff_table(spec, None).kind), ("same", same.kind), ("added", ",".join(d.added)), ("modified", " ".join(d.modified[0])), ("dropped", ",".join(d.dropped)), ("checked", migrate.check("DROP TABLE t; SELECT 1")[0]), ("config", migrate.validate_config({"schema": "s", "out": "o"})[0])]
    return spark.createDataFrame(rows, "what string, found string")


# Streams.


@query("SELECT CAST(s AS TIMESTAMP) AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1")
def window_sliding(spark, sf):
    out = incremental.tumbling(read(spark, sf, "events"), "ts", "1 hour", [], {"n": F.count("*")}, slide="30 minutes")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_distinct(spark, sf):
    return incremental.distinct_within(read(spark, sf, "events").select("user_id", "event_type", "ts"), "ts", "1 hour", ["user_id", "event_type"]).select("user_id", "event_type")


@query("SELECT event_type, count(*) AS n, CAST(sum(value::DECIMAL(18,4)) AS DOUBLE) AS total FROM events GROUP BY 1")
def stream_to_table(spark, sf):
    """Events as a stream of files with a watermark, their counts by type in a sink."""
    at = scratch.scratch_path(spark, "stream")
    events = read(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("decimal(18,4)").alias("value"))
    events.repartition(3).write.parquet(f"{at}/in")
    rows = incremental.file_stream(spark, f"{at}/in", events.schema, files_per_trigger=1)
    views.migration_bridge(rows, f"{at}/out", {"event_type": "event_type", "value": "value"}, f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"))

