import datetime
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import aggregates, arrays, conditional, conversion, geo, hashing, jsons, maths
from tessera.functions import predicates as P
from tessera.functions import strings as S
from tessera.functions import times as D


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(df, c):
    return df.select(c.alias("x")).first()["x"]


def row(spark, schema, *values):
    return spark.createDataFrame([values], schema)


def test_sql_takes_values_as_literals(one):
    assert value(one, P.sql("upper({})", "it's; DROP")) == "IT'S; DROP"
    assert value(one, P.sql("{} + {}", F.col("id"), 41)) == 41
    with pytest.raises(ValueError):
        P.sql("{}")


def test_join_of_expressions(one):
    assert value(one, P.join([F.lit(1), F.lit(2), F.lit(3)], "+")) == 6
    assert value(one, P.fn("concat", F.lit("a"), F.lit("b"))) == "ab"


def test_membership_with_nulls(spark):
    df = row(spark, "a array<int>", [1, None])
    assert value(df, P.has("a", 5)) is False
    assert value(df, P.has("a", 1)) is True
    assert value(df, P.has_any("a", [7])) is False
    assert value(df, P.has_all("a", [1])) is True


def test_in_subquery(spark):
    keys = spark.range(3).select("id")
    assert spark.range(5).where(P.in_array("id", keys)).count() == 3


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (1, 4.0, "b"), (2, None, "a")], "k int, v double, s string")
    out = df.agg(aggregates.uniq("s").alias("u"), aggregates.any_("v").alias("a"), aggregates.group_uniq_array_if("s", F.col("k") == 1).alias("g"), aggregates.quantile("v", 0.5).alias("q"), aggregates.quantiles("v", [0.0, 1.0], approx=True).alias("qs"), aggregates.filtered(F.sum, "v", F.col("k") == 1).alias("f")).first()
    assert out["u"] == 2 and out["a"] in (2.0, 4.0) and sorted(out["g"]) == ["a", "b"] and out["q"] == 3.0 and out["qs"] == [2.0, 4.0] and out["f"] == 6.0
    states = df.groupBy("k").agg(aggregates.uniq_state("s").alias("h"))
    assert states.agg(aggregates.uniq_merge("h").alias("n")).first()["n"] == 2
    assert df.agg(aggregates.top_k("s", 1).alias("t")).first()["t"][0]["item"] == "a"
    assert df.agg(aggregates.uniq_if("s", F.col("k") == 2).alias("n")).first()["n"] == 1


def test_strings(one):
    assert value(one, S.substring(F.lit("hello"), 2, 0)) == ""
    assert value(one, S.position(F.lit("hello"), "l")) == 3
    assert value(one, S.position(F.lit("hello"), "z")) == 0
    assert value(one, S.length(F.lit("é"))) == 2 and value(one, S.length_utf8(F.lit("é"))) == 1
    assert value(one, S.replace_regexp_all(F.lit("a1$"), r"([a-z])(\d)", r"\2\1$")) == "1a$$"
    assert value(one, S.split_by_char(F.lit("a.b."), ".")) == ["a", "b", ""]
    assert value(one, S.split_by_whitespace(F.lit(" a \t b "))) == ["a", "b"]
    assert value(one, S.count_matches(F.lit("a\\Eb\\Ec"), "\\E")) == 2


def test_hashes(one):
    # The published test vector: key 00..0f, message 00..0e.
    k0, k1 = int.from_bytes(bytes(range(8)), "little"), int.from_bytes(bytes(range(8, 16)), "little")
    assert hashing.sip_hash(bytes(range(15)), k0, k1) == 0xA129CA6149BE45E5
    assert int(value(one, hashing.sip_hash64(F.lit("abc")))) == hashing.sip_hash(b"abc")
    assert value(one, hashing.md5(F.lit("a"))) == "0cc175b9c0f1b6a831c399e269772661"
    assert bytes(value(one, hashing.sha1(F.lit("a"), binary=True))).hex() == "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"
    assert value(one, hashing.city_hash64(F.lit("a"))) is not None


def test_conversion(one):
    lit = F.lit
    assert value(one, conversion.to_int32(lit("x"))) is None
    assert value(one, conversion.to_uint32(lit("4294967296"))) is None and value(one, conversion.to_uint32(lit("4294967295"))) == 4294967295
    assert int(value(one, conversion.to_uint64(lit("18446744073709551615")))) == 2**64 - 1 and value(one, conversion.to_uint64(lit("-1"))) is None
    assert value(one, conversion.to_bool(lit("true"))) is True
    assert value(one, conversion.to_uuid(lit("123E4567-E89B-12D3-A456-426614174000"))) == "123e4567-e89b-12d3-a456-426614174000" and value(one, conversion.to_uuid(lit("x"))) is None
    assert value(one, conversion.to_date_time64(lit("2024-01-02 03:04:05.678912"), 3)).microsecond == 678000
    assert value(one, conversion.to_date_time(lit("2024-01-02 03:04:05.678"))).microsecond == 0
    assert value(one, conversion.from_base64(conversion.to_base64(lit("hé")))) == "hé"
    assert value(one, conversion.to_bin(lit(5))) == "101" and value(one, conversion.to_bin(lit("ab"))) == "0110000101100010" and value(one, conversion.from_bin(lit("101"))) == 5
    assert value(one, conversion.url_decode(conversion.url_encode(lit("a b&c/é")))) == "a b&c/é" and value(one, conversion.url_encode(lit("a b"))) == "a%20b"
    assert value(one, conversion.html_escape(lit("<a href='x'>&</a>"))) == "&lt;a href=&#39;x&#39;&gt;&amp;&lt;/a&gt;"
    assert value(one, conversion.html_unescape(lit("&lt;&amp;lt;&apos;"))) == "<&lt;'" and value(one, conversion.html_unescape(lit("&eacute;"), every_entity=True)) == "é"
    assert value(one, conversion.format_readable_decimal(lit(1234567.0), 2)) == "1.23M" and value(one, conversion.format_readable_decimal(lit(12.0), 1)) == "12.0"
    assert value(one, conversion.format_bytes(lit(1536))) == "1.50 KiB" and value(one, conversion.format_bytes(lit(12))) == "12.00 B"
    assert value(one, conversion.format_number(lit(1234567.891), 2)) == "1,234,567.89" and value(one, conversion.format_decimal(lit(2), 2)) == "2.00"
    assert value(one, conversion.to_title_case(lit("ab cd"))) == "Ab Cd"


def test_formats_of_large_and_missing_numbers(one):
    assert value(one, conversion.format_readable_decimal(F.lit(1e9), 2)) == "1.00B" and value(one, conversion.format_readable_decimal(F.lit(1e9), 2, largest="M")) == "1000.00M"
    assert value(one, conversion.format_decimal(F.lit(None).cast("double"), 2)) is None


def test_times(spark):
    df = row(spark, "t timestamp_ntz", datetime.datetime(2024, 3, 31, 13, 47, 59))
    assert value(df, D.time_to_start_of_week("t")) == datetime.date(2024, 3, 31)
    assert value(df, D.to_start_of_interval("t", 1, "week")) == datetime.datetime(2024, 3, 25)
    assert value(df, D.to_start_of_interval("t", 2, "month")) == datetime.datetime(2024, 3, 1)
    assert value(df, D.to_start_of_interval("t", 1, "day", "America/New_York")) == datetime.datetime(2024, 3, 31, 4)
    assert value(df, D.to_day_of_week("t")) == 7 and value(df, D.to_week("t")) == 13 and value(df, D.to_iso_week("t")) == 13
    assert value(df, D.date_diff("hour", "t", F.lit("2024-03-31 14:00:01").cast("timestamp_ntz"))) == 1
    assert value(df, D.date_add("month", -1, "t")) == datetime.datetime(2024, 2, 29, 13, 47, 59)
    assert value(df, D.time_format_date_time("t", "%Y/%m/%d at %H:%i:%S 100%%")) == "2024/03/31 at 13:47:59 100%"
    assert value(df, D.to_timezone("t", "Asia/Tokyo")) == datetime.datetime(2024, 3, 31, 22, 47, 59) and value(df, D.time_offset("t", "Asia/Tokyo")) == 9 * 3600
    nulls = spark.createDataFrame([(None,)], "t timestamp_ntz")
    assert nulls.select(D.to_start_of_interval("t", 5, "minute").alias("x")).collect()[0]["x"] is None
    with pytest.raises(ValueError):
        D.time_format_date_time("t", "%!")
    kept = D.apply_ttl(df, "t", "10 days", F.lit("2024-04-09").cast("timestamp"))
    assert kept.count() == 1 and D.apply_ttl(df, "t", "10 days", F.lit("2024-04-11").cast("timestamp")).count() == 0
    assert value(spark.range(1), F.datediff(D.time_today(), D.time_yesterday())) == 1 and value(spark.range(1), D.time_now()) is not None


def test_maths_and_conditions(one):
    assert value(one, maths.div(F.lit(1), F.lit(0))) is None
    assert value(one, maths.round_(F.lit(2.5))) == 3 and value(one, maths.round_(F.lit(2.5), bankers=True)) == 2
    assert value(one, conditional.case_when().when(F.lit(False), 1).otherwise(0)) == 0
    assert value(one, conditional.case_when().when(F.lit(False), "a").end()) is None
    assert conditional.and_() is None and conditional.or_(None) is None
    assert value(one, conditional.and_(F.lit(True), None, F.lit(False))) is False and value(one, conditional.or_(F.lit(True), F.lit(False))) is True
    assert value(one, conditional.sql_if(F.lit(True), 1, 2)) == 1 and value(one, conditional.coalesce(F.lit(None), F.lit(3))) == 3
    for bad in ((F.lit(True), 1), (F.lit(True), 1, F.lit(True), 2)):
        with pytest.raises(ValueError):
            conditional.multi_if(*bad)


def test_arrays(spark):
    df = row(spark, "a array<int>, e array<int>", [3, None, 1, 3], [])
    assert value(df, arrays.array_sum("a")) == 7 and value(df, arrays.array_avg("e")) is None and value(df, arrays.array_sum("e")) == 0
    assert value(df, arrays.array_sort("a")) == [1, 3, 3, None] and value(df, arrays.array_sort("a", False)) == [3, 3, 1, None]
    assert value(df, arrays.array_distinct("a")) == [3, 1] and value(df, arrays.array_element("a", -1)) == 3 and value(df, arrays.array_element("a", 9)) is None
    assert value(df, arrays.array_count_matches("a", 3)) == 2 and value(df, arrays.empty("e")) is True and value(df, arrays.not_empty("a")) is True
    assert value(df, arrays.array_map("x -> x * 2", "a")) == [6, None, 2, 6]
    assert df.select(arrays.unnest("a")).count() == 4
    with pytest.raises(ValueError):
        arrays.array_reduce("mode", "a")


def test_json(spark):
    df = row(spark, "j string", '{"a": {"b": [1, 2, {"c": "x"}]}, "n": null, "t": true, "f": 1.5}')
    assert value(df, jsons.json_extract_int("j", "a.b[1]")) == 2 and value(df, jsons.json_extract_string("j", "$.a.b[2].c")) == "x"
    assert value(df, jsons.json_extract_bool("j", "t")) is True and value(df, jsons.json_extract_float("j", "f")) == 1.5
    assert value(df, jsons.json_has("j", "n")) is True and value(df, jsons.json_has("j", "zz")) is False
    assert value(df, jsons.json_extract_raw("j", "a.b[2]")) == '{"c":"x"}'
    assert value(df, jsons.json_extract_keys("j", "a")) == ["b"] and value(df, jsons.json_length("j")) == 4 and value(df, jsons.json_array_length("j", "a.b")) == 3
    assert [value(df, jsons.json_type("j", p)) for p in ("a", "a.b", "n", "t", "f", "a.b[2].c", "zz")] == ["object", "array", "null", "bool", "number", "string", None]
    assert value(df, jsons.json_extract_values("j", "a")) == ['[1,2,{"c":"x"}]'] and len(value(df, jsons.json_extract_keys_and_values("j"))) == 4
    short = row(spark, "j string", '{"a":{"b":1}}')
    assert value(short, jsons.json_insert("j", "a.c", "x")) == '{"a":{"b":1,"c":"x"}}' and value(short, jsons.json_insert("j", "a.b", 9)) == '{"a":{"b":1}}'
    assert value(short, jsons.json_replace("j", "a.b", F.lit(7))) == '{"a":{"b":7}}' and value(short, jsons.json_replace("j", "zz", 7)) == '{"a":{"b":1}}'
    assert value(short, jsons.json_remove("j", "a.b")) == '{"a":{}}'
    assert value(row(spark, "j string", "{bad"), jsons.json_remove("j", "a")) is None and value(row(spark, "j string", "{bad"), jsons.parse_json_best_effort("j")) is None
    assert value(short, jsons.json_stringify(jsons.parse_json("j"))) == '{"a":{"b":1}}' and value(df, jsons.json_array_extract("j", "a.b", "String"))[0] == "1"


def point(x, y):
    return geo.geo_point(F.lit(float(x)), F.lit(float(y)))


def ring(*points):
    return F.array(*[point(*p) for p in points])


def polygon(*points):
    return F.array(ring(*points))


SQUARE = ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))


def test_geo_measures(one):
    assert value(one, geo.polygon_area(polygon(*SQUARE))) == 16 and value(one, geo.polygon_perimeter(polygon(*SQUARE))) == 16
    holed = F.array(ring(*SQUARE), ring((1, 1), (2, 1), (2, 2), (1, 2)))
    assert value(one, geo.polygon_area(holed)) == 15 and value(one, geo.polygon_num_interior_rings(holed)) == 1
    assert value(one, geo.point_in_polygon(point(1.5, 1.5), holed)) is False and value(one, geo.point_in_polygon(point(3, 3), holed)) is True
    assert tuple(value(one, geo.polygon_centroid(polygon(*SQUARE)))) == (2, 2)
    assert value(one, geo.euclidean_distance(point(0, 0), point(3, 4))) == 5
    assert math.isclose(value(one, geo.geo_distance(point(0, 0), point(0, 90))), math.pi / 2 * 6371, rel_tol=1e-9)
    assert math.isclose(value(one, geo.great_circle_distance(point(0, 0), point(180, 0))), math.pi * 6371000, rel_tol=1e-9)


def test_geo_relations(one):
    inner, beside = ((1, 1), (2, 1), (2, 2), (1, 2)), ((3, 3), (6, 3), (6, 6), (3, 6))
    assert value(one, geo.polygon_contains(polygon(*SQUARE), polygon(*inner))) is True and value(one, geo.polygon_contains(polygon(*SQUARE), polygon(*beside))) is False
    assert value(one, geo.polygons_intersect(polygon(*SQUARE), polygon(*beside))) is True and value(one, geo.polygons_intersect(polygon(*SQUARE), polygon((9, 9), (10, 9), (10, 10)))) is False
    box = geo.bounding_box(point(4, 0), point(0, 4))
    assert tuple(value(one, geo.bbox_min(box))) == (0, 0) and tuple(value(one, geo.bbox_max(box))) == (4, 4)
    assert value(one, geo.is_valid_geometry(polygon(*SQUARE))) is True and value(one, geo.is_valid_geometry(polygon((0, 0), (4, 4), (4, 0), (0, 4), (0, 0)))) is False


def test_geo_shapes(spark, one):
    noisy = ((0, 0), (2, 0.01), (4, 0), (4, 4), (0, 4), (0, 0))
    assert len(value(one, geo.polygon_simplify(polygon(*noisy), 0.1))[0]) == 5
    grown = value(one, geo.polygon_area(geo.polygon_buffer(polygon(*SQUARE), 1.0, 64)))
    assert abs(grown - (16 + 16 + math.pi)) < 0.05
    back = value(one, geo.web_mercator_to_wgs84(geo.wgs84_to_web_mercator(point(12.5, 41.9))))
    assert math.isclose(back["x"], 12.5, abs_tol=1e-9) and math.isclose(back["y"], 41.9, abs_tol=1e-9)
    df = one.select(polygon(*SQUARE).alias("g"), point(1, 2).alias("p"))
    assert geo.geometry_type(df, "g") == "Polygon" and geo.geometry_type(df, "p") == "Point" and value(df, geo.geometry_num_points(df, "g")) == 5
    assert value(one, geo.radians_to_degrees(geo.degrees_to_radians(F.lit(90.0)))) == 90


def test_geohash(one):
    assert geo.geohash_text(-5.6, 42.6, 5) == "ezs42"
    assert value(one, geo.geo_hash_encode(point(-5.6, 42.6), 5)) == "ezs42"
    centre = value(one, geo.geo_hash_decode(F.lit("ezs42")))
    assert abs(centre["x"] + 5.603) < 0.001 and abs(centre["y"] - 42.605) < 0.001
    assert len(value(one, geo.geo_hash_neighbors(F.lit("ezs42")))) == 8 and value(one, geo.geo_hash_are_neighbors(F.lit("ezs42"), F.lit("ezs48"))) is True
    assert value(one, geo.geo_hash_decode(F.lit("a!"))) is None


def test_geo_sets(spark, one):
    points = F.array(point(0, 0), point(0, 1), point(0, 5))
    assert len(value(one, geo.points_within_radius(point(0, 0), 200_000, points))) == 2
    assert [p["y"] for p in value(one, geo.nearest_neighbors(point(0, 4), points, 2))] == [5, 1]
    df = spark.createDataFrame([(0.0, 0.0), (0.1, 0.0), (9.0, 9.0), (9.1, 9.0), (None, 1.0)], "x double, y double").select(geo.geo_point("x", "y").alias("p"))
    out = geo.k_means_clustering(df, "p", 2).collect()
    assert len(out) == 5 and len({r["cluster"] for r in out if r["p"]["x"] is not None and r["p"]["x"] < 1}) == 1
