import pytest
from pyspark.sql import types as T

from tessera import engines
from tessera.table import extend_columns, generate_types, index, many, table, versioned_table
from tessera.types import COMMON_STATUSES, ColumnSpec, bounds, common_status, country_code, created_at, enum_values, low_cardinality_uuid_primary_key, spark_type, t


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("UInt8", "smallint"), ("UInt64", "decimal(20,0)"), ("Int256", "string"), ("Nullable(Int32)", "int"), ("LowCardinality(Nullable(String))", "string"), ("Array(Nullable(UInt32))", "array<bigint>"),
        ("Map(String, Array(Int8))", "map<string,array<tinyint>>"), ("Tuple(Int32, String)", "struct<_1:int,_2:string>"), ("Tuple(a Int32, b Decimal(10, 2))", "struct<a:int,b:decimal(10,2)>"), ("Nested(a Int32, b String)", "array<struct<a:int,b:string>>"),
        ("Decimal(76, 3)", "decimal(38,3)"), ("Decimal64(4)", "decimal(18,4)"), ("DateTime64(3, 'UTC')", "timestamp"), ("DateTime('Europe/Paris')", "timestamp"), ("FixedString(16)", "string"), ("Enum8('a' = 0, 'b' = 1)", "string"),
        ("JSON", "variant"), ("Ring", "array<struct<x:double,y:double>>"), ("AggregateFunction(uniq, UInt64)", "binary"), ("SimpleAggregateFunction(sum, Float64)", "double"), ("array<int>", "array<int>"), ("bigint", "bigint"),
    ],
)
def test_types(text, kind):
    assert spark_type(text).simpleString() == kind


def test_unknown_types_fail():
    for bad in ("Integr", "Foo(Int32)"):
        with pytest.raises(ValueError):
            spark_type(bad)


def test_type_details():
    assert spark_type("Array(Nullable(Int8))").containsNull and not spark_type("Array(Int8)").containsNull
    assert enum_values("Nullable(Enum8('a' = 0, 'b,c' = 1))") == ["a", "b,c"] and bounds("UInt8") == (0, 255) and bounds("Nullable(Int16)") == (-32768, 32767) and bounds("String") is None


def test_columns_are_immutable():
    a = ColumnSpec("UUID", "id")
    b = a.auto_generate(7).primary_key()
    assert not a.is_primary_key and b.is_primary_key and b.auto == "uuid7" and b.has_default
    with pytest.raises(ValueError):
        ColumnSpec("Int32").auto_generate()
    with pytest.raises(ValueError):
        a.auto_generate(5)
    assert t.uuid("id").type == "UUID" and t.uint64().data_type == T.DecimalType(20, 0) and t.datetime().type == "DateTime" and t.array(t.string().nullable()).type == "Array(Nullable(String))"


def test_presets():
    assert len(country_code("c").values) == 16 and common_status().values == tuple(COMMON_STATUSES.values()) and created_at().default_expr == "current_timestamp()"
    assert low_cardinality_uuid_primary_key().auto == "uuid4" and set(t.timestamps()) == {"created_at", "updated_at"} and "deleted_at" in t.soft_deletes()
    assert t.nested({"a": t.int32()}).type == "Nested(a Int32)" and t.enum("a", "b").is_nullable


COLUMNS = {"id": t.int64().primary_key(), "version": t.uint64(), "name": t.string().nullable().default("x")}


def test_validation():
    with pytest.raises(ValueError, match="order_by"):
        table("a", COLUMNS)
    with pytest.raises(ValueError, match="no column"):
        table("a", COLUMNS, order_by="nope")
    with pytest.raises(ValueError, match="sample_by"):
        table("a", COLUMNS, order_by="id", sample_by="nope")
    with pytest.raises(ValueError, match="no column"):
        table("a", COLUMNS, order_by="id", engine=engines.replacing_merge_tree("nope"))
    assert table("empty", {}).schema == T.StructType([])
    assert table("log", COLUMNS, engine=engines.log()).engine.name == "Log"


def test_engine_choice():
    spec = table("a", COLUMNS, order_by="id", version_column="version")
    assert spec.engine.name == "ReplacingMergeTree" and spec.default_final and engines.version_column(spec.engine) == "version"
    signed = table("b", {**COLUMNS, "sign": t.int8()}, order_by="id", version_column="version", engine=engines.versioned_collapsing_merge_tree("sign", "version"))
    assert signed.engine.name == "VersionedCollapsingMergeTree"
    made = table("c", COLUMNS, order_by="id", cluster="main")
    assert engines.is_replicated_engine(made.engine) and engines.is_merge_tree_family(made.engine) and made.engine.base.name == "MergeTree"
    assert not engines.is_merge_tree_family(engines.memory())


def test_every_engine_can_be_made():
    made = [engines.merge_tree(), engines.replacing_merge_tree("v"), engines.summing_merge_tree("a"), engines.aggregating_merge_tree(), engines.collapsing_merge_tree("s"), engines.versioned_collapsing_merge_tree("s", "v"), engines.graphite_merge_tree(), engines.replicated(), engines.buffer("t"), engines.buffer_explicit("t", 1, 1, 2, 1, 2, 1, 2), engines.distributed("c", "t"), engines.null(), engines.log(), engines.tiny_log(), engines.memory(), engines.join_engine("ANY", "LEFT", "k"), engines.dictionary_engine("d"), engines.file_engine("CSV"), engines.url_engine("http://x", "CSV"), engines.s3_engine("s3://b/x", "Parquet"), engines.kafka_engine("b", "t", "g"), engines.postgresql_engine("u", "t"), engines.mysql_engine("u", "t")]
    assert len({e.name for e in made}) == 22


def test_ddl_and_alias():
    spec = table("users", COLUMNS, order_by="id", partition_by="name", indices=(index("i").on("name").type("bloom_filter"),))
    ddl = spec.to_ddl()
    assert "`id` bigint NOT NULL" in ddl and "PARTITIONED BY (name)" in ddl and "parquet.bloom.filter.enabled#name" in ddl
    assert spec.as_("u").alias == "u" and spec.alias is None
    with pytest.raises(AttributeError):
        spec.nope


def test_helpers():
    with pytest.raises(ValueError):
        extend_columns(COLUMNS, {"id": t.int32()})
    spec, view = versioned_table("users", 2, COLUMNS, order_by="id")
    assert spec.name == "users_v2" and view.endswith("FROM users_v2")
    source = generate_types(spec, "User")
    assert "class UserInsert(TypedDict)" in source and "name: NotRequired[str | None]" in source and "id: int\n" in source
    orders = table("orders", {"id": t.int64(), "user": t.int64()}, order_by="id")
    assert spec.related(orders=many(orders, ["id"], ["user"])).relations["orders"].kind == "many"
