"""Plane and spherical geometry on structs: a point is (x, y) = (longitude, latitude), a ring an array of points, closed or
not, a polygon an array of rings of which the first is the outer one. What folds over a ring stays in the JVM; geohashes,
simplification, buffers and the intersection of polygons are Arrow batch UDFs."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions._args import ColumnLike, col
from tessera.shipping import ship

EARTH_KM = 6371.0
MILES = 0.621371
MERCATOR = 6378137.0

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def geo_point(longitude: ColumnLike, latitude: ColumnLike) -> Column:
    return F.struct(col(longitude).cast("double").alias("x"), col(latitude).cast("double").alias("y"))


def geo_x(point: ColumnLike) -> Column:
    return col(point)["x"]


def geo_y(point: ColumnLike) -> Column:
    return col(point)["y"]


geo_longitude, geo_latitude = geo_x, geo_y


def _haversine(p: Column, q: Column, radius: float) -> Column:
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    h = half(q["y"] - p["y"]) + F.cos(F.radians(p["y"])) * F.cos(F.radians(q["y"])) * half(q["x"] - p["x"])
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def geo_distance(a: ColumnLike, b: ColumnLike, unit: str = "km") -> Column:
    """Great-circle distance in km, mi or m."""
    factor = {"km": 1.0, "mi": MILES, "m": 1000.0}[unit]
    return _haversine(col(a), col(b), EARTH_KM) * factor


def great_circle_distance(a: ColumnLike, b: ColumnLike) -> Column:
    """In metres."""
    return _haversine(col(a), col(b), EARTH_KM * 1000)


def euclidean_distance(a: ColumnLike, b: ColumnLike) -> Column:
    return F.hypot(geo_x(a) - geo_x(b), geo_y(a) - geo_y(b))


def manhattan_distance(a: ColumnLike, b: ColumnLike) -> Column:
    return F.abs(geo_x(a) - geo_x(b)) + F.abs(geo_y(a) - geo_y(b))


def _edges(ring: Column) -> Column:
    """(a, b) for every edge, the closing one too."""
    rotated = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, rotated, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _fold(ring: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + f(e["a"], e["b"]))


def _outer(polygon: ColumnLike) -> Column:
    return F.try_element_at(col(polygon), F.lit(1))


def _inside(p: Column, ring: Column) -> Column:
    """Crossings of a ray to the right are odd."""
    crosses = lambda e: ((e["a"]["y"] > p["y"]) != (e["b"]["y"] > p["y"])) & (p["x"] < (e["b"]["x"] - e["a"]["x"]) * F.try_divide(p["y"] - e["a"]["y"], e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.pmod(F.size(F.filter(_edges(ring), lambda e: F.coalesce(crosses(e), F.lit(False)))), F.lit(2)) == 1


def point_in_polygon(point: ColumnLike, polygon: ColumnLike) -> Column:
    """Inside the outer ring and in no hole."""
    p, poly = col(point), col(polygon)
    holes = F.slice(poly, F.lit(2), F.greatest(F.size(poly) - 1, F.lit(0)))
    return _inside(p, _outer(poly)) & ~F.exists(holes, lambda r: _inside(p, r))


def _side(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def _cross(e: Column, f: Column) -> Column:
    return (_side(e["a"], e["b"], f["a"]) * _side(e["a"], e["b"], f["b"]) < 0) & (_side(f["a"], f["b"], e["a"]) * _side(f["a"], f["b"], e["b"]) < 0)


def polygon_contains(a: ColumnLike, b: ColumnLike) -> Column:
    """All corners of b's outer ring are inside a and no edges cross."""
    one, two = col(a), _outer(b)
    crossing = F.exists(_edges(_outer(one)), lambda e: F.exists(_edges(two), lambda f: _cross(e, f)))
    return F.forall(two, lambda p: point_in_polygon(p, one)) & ~crossing


def polygons_intersect(a: ColumnLike, b: ColumnLike) -> Column:
    """Some edges cross, or a corner of one is inside the other."""
    one, two = col(a), col(b)
    crossing = F.exists(_edges(_outer(one)), lambda e: F.exists(_edges(_outer(two)), lambda f: _cross(e, f)))
    return crossing | F.exists(_outer(two), lambda p: point_in_polygon(p, one)) | F.exists(_outer(one), lambda p: point_in_polygon(p, two))


def bounding_box(a: ColumnLike, b: ColumnLike) -> Column:
    """Struct (min, max) of two corners."""
    low = F.struct(F.least(geo_x(a), geo_x(b)).alias("x"), F.least(geo_y(a), geo_y(b)).alias("y"))
    high = F.struct(F.greatest(geo_x(a), geo_x(b)).alias("x"), F.greatest(geo_y(a), geo_y(b)).alias("y"))
    return F.struct(low.alias("min"), high.alias("max"))


def bbox_min(box: ColumnLike) -> Column:
    return col(box)["min"]


def bbox_max(box: ColumnLike) -> Column:
    return col(box)["max"]


def point_in_bounding_box(point: ColumnLike, box: ColumnLike) -> Column:
    p, b = col(point), col(box)
    return p["x"].between(b["min"]["x"], b["max"]["x"]) & p["y"].between(b["min"]["y"], b["max"]["y"])


def _signed(ring: Column) -> Column:
    return _fold(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def polygon_area(polygon: ColumnLike) -> Column:
    """The outer ring's area less that of the holes."""
    poly = col(polygon)
    return F.aggregate(poly, F.lit(0.0), lambda s, r: s - F.abs(_signed(r))) + 2 * F.abs(_signed(_outer(poly)))


def polygon_perimeter(polygon: ColumnLike) -> Column:
    """The length of all rings."""
    return F.aggregate(col(polygon), F.lit(0.0), lambda s, r: s + _fold(r, lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])))


def polygon_centroid(polygon: ColumnLike) -> Column:
    """Of the outer ring."""
    ring = _outer(polygon)
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    six = 6 * _signed(ring)
    x = F.try_divide(_fold(ring, lambda a, b: (a["x"] + b["x"]) * cross(a, b)), six)
    y = F.try_divide(_fold(ring, lambda a, b: (a["y"] + b["y"]) * cross(a, b)), six)
    return F.struct(x.alias("x"), y.alias("y"))


def _ring_udf(f: Callable[[list[tuple[float, float]]], list[tuple[float, float]]]) -> Callable[[Column], Column]:
    ship()

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def mapped(rings: pd.Series) -> pd.Series:
        return rings.map(lambda r: None if r is None else [{"x": x, "y": y} for x, y in f([(p["x"], p["y"]) for p in r])])

    return mapped


def _douglas_peucker(points: list[tuple[float, float]], epsilon: float) -> list[tuple[float, float]]:
    keep = {0, len(points) - 1}
    todo = [(0, len(points) - 1)]
    while todo:
        i, j = todo.pop()
        (ax, ay), (bx, by) = points[i], points[j]
        length = math.hypot(bx - ax, by - ay)
        far, at = 0.0, None
        for k in range(i + 1, j):
            x, y = points[k]
            d = abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / length if length else math.hypot(x - ax, y - ay)
            if d > far:
                far, at = d, k
        if at is not None and far > epsilon:
            keep.add(at)
            todo += [(i, at), (at, j)]
    return [points[k] for k in sorted(keep)]


def polygon_simplify(polygon: ColumnLike, epsilon: float) -> Column:
    """The outer ring by Douglas and Peucker, as a polygon of one ring."""
    return F.array(_ring_udf(lambda r: _douglas_peucker(r, epsilon) if len(r) > 2 else r)(_outer(polygon)))


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def half(q):
        out: list[tuple[float, float]] = []
        for x, y in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append((x, y))
        return out[:-1]

    return half(p) + half(p[::-1])


def polygon_buffer(polygon: ColumnLike, distance: float, sides: int = 32) -> Column:
    """The buffer of the outer ring's convex hull, with round corners of ``sides`` to a full turn: for convex polygons the
    buffer itself. Buffers of other shapes need a geometry library."""
    circle = [(distance * math.cos(2 * math.pi * k / sides), distance * math.sin(2 * math.pi * k / sides)) for k in range(sides)]
    return F.array(_ring_udf(lambda r: _hull([(x + dx, y + dy) for x, y in _hull(r) for dx, dy in circle]))(_outer(polygon)))


# The digits of a geohash.
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash_text(x: float, y: float, precision: int) -> str:
    bits = {0: (-180.0, 180.0, x), 1: (-90.0, 90.0, y)}
    out, code = [], 0
    for k in range(5 * precision):
        lo, hi, v = bits[k % 2]
        mid = (lo + hi) / 2
        code = code * 2 + (v >= mid)
        bits[k % 2] = (mid, hi, v) if v >= mid else (lo, mid, v)
        if k % 5 == 4:
            out.append(_BASE32[code])
            code = 0
    return "".join(out)


def geohash_cell(text: str) -> tuple[float, float, float, float] | None:
    """Centre and size (x, y, width, height)."""
    lo, hi, axis = [-180.0, -90.0], [180.0, 90.0], 0
    for c in text.lower():
        code = _BASE32.find(c)
        if code < 0:
            return None
        for k in (4, 3, 2, 1, 0):
            mid = (lo[axis] + hi[axis]) / 2
            if code >> k & 1:
                lo[axis] = mid
            else:
                hi[axis] = mid
            axis = 1 - axis
    return (lo[0] + hi[0]) / 2, (lo[1] + hi[1]) / 2, hi[0] - lo[0], hi[1] - lo[1]


def geohash_around(text: str) -> list[str] | None:
    """The neighbours of a cell; beyond a pole there are none, and the date line is crossed."""
    cell = geohash_cell(text)
    if cell is None:
        return None
    x, y, w, h = cell
    out = {geohash_text((x + dx * w + 180) % 360 - 180, y + dy * h, len(text)) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if -90 <= y + dy * h <= 90}
    return sorted(out - {text.lower()})


def geo_hash_encode(point: ColumnLike, precision: int = 10) -> Column:
    ship()

    @F.pandas_udf("string")
    def encoded(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else geohash_text(a, b, precision) for a, b in zip(x, y, strict=True)], dtype=object)

    return encoded(geo_x(point).cast("double"), geo_y(point).cast("double"))


def geo_hash_decode(geohash: ColumnLike) -> Column:
    """The centre of the cell."""
    ship()

    @F.pandas_udf("array<double>")
    def decoded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None or (c := geohash_cell(t)) is None else list(c[:2]))

    centre = decoded(col(geohash))
    return F.when(centre.isNotNull(), F.struct(centre[0].alias("x"), centre[1].alias("y")))


def geo_hash_neighbors(geohash: ColumnLike) -> Column:
    ship()

    @F.pandas_udf("array<string>")
    def around(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else geohash_around(t))

    return around(col(geohash))


def geo_hash_are_neighbors(a: ColumnLike, b: ColumnLike) -> Column:
    return F.array_contains(geo_hash_neighbors(a), F.lower(col(b)))


def points_within_radius(center: ColumnLike, radius: Any, points: ColumnLike) -> Column:
    """Those of an array of points within so many metres."""
    c = col(center)
    return F.filter(col(points), lambda p: _haversine(c, p, EARTH_KM * 1000) <= col(radius))


def nearest_neighbors(point: ColumnLike, points: ColumnLike, k: int) -> Column:
    """The k nearest of an array of points, nearest first."""
    c = col(point)
    ranked = F.array_sort(F.transform(col(points), lambda p: F.struct(_haversine(c, p, EARTH_KM * 1000).alias("d"), p.alias("p"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: r["p"])


def k_means_clustering(df: DataFrame, point: ColumnLike, k: int, seed: int = 1, to: str = "cluster") -> DataFrame:
    """``df`` with the number of each point's cluster, by Spark ML; rows with a null point have none."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    at = df.withColumn("_point", F.when(geo_x(point).isNotNull() & geo_y(point).isNotNull(), F.array(geo_x(point), geo_y(point))))
    known = at.where("_point is not null").withColumn("_features", array_to_vector("_point"))
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol=to).fit(known)
    lost = at.where("_point is null").withColumn(to, F.lit(None).cast("int")).drop("_point")
    return model.transform(known).drop("_features", "_point").unionByName(lost)


def degrees_to_radians(c: ColumnLike) -> Column:
    return F.radians(col(c))


def radians_to_degrees(c: ColumnLike) -> Column:
    return F.degrees(col(c))


def web_mercator_to_wgs84(point: ColumnLike) -> Column:
    x = F.degrees(geo_x(point) / MERCATOR)
    y = F.degrees(2 * F.atan(F.exp(geo_y(point) / MERCATOR)) - math.pi / 2)
    return F.struct(x.alias("x"), y.alias("y"))


def wgs84_to_web_mercator(point: ColumnLike) -> Column:
    x = F.radians(geo_x(point)) * MERCATOR
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(geo_y(point)) / 2)) * MERCATOR
    return F.struct(x.alias("x"), y.alias("y"))


def is_valid_geometry(polygon: ColumnLike) -> Column:
    """Every ring is closed, has four points at least, and no two of its edges cross."""

    def ok(r: Column) -> Column:
        closed = (F.try_element_at(r, F.lit(1)) == F.try_element_at(r, F.lit(-1))) & (F.size(r) >= 4)
        return F.coalesce(closed, F.lit(False)) & ~F.exists(_edges(r), lambda e: F.exists(_edges(r), lambda f: _cross(e, f)))

    return F.forall(col(polygon), ok)


def _depth(kind: T.DataType) -> int:
    d = 0
    while isinstance(kind, T.ArrayType):
        d, kind = d + 1, kind.elementType
    return d if isinstance(kind, T.StructType) else -1


def geometry_type(df: DataFrame, name: str) -> str:
    """Point, Ring, Polygon or MultiPolygon, from the column's type."""
    d = _depth(df.schema[name].dataType)
    if not 0 <= d <= 3:
        raise ValueError(f"{name} is not a geometry")
    return ("Point", "Ring", "Polygon", "MultiPolygon")[d]


def geometry_num_points(df: DataFrame, name: str) -> Column:
    kind, c = geometry_type(df, name), F.col(name)
    if kind == "Point":
        return F.when(c.isNotNull(), 1)
    for _ in range(("Ring", "Polygon", "MultiPolygon").index(kind)):
        c = F.flatten(c)
    return F.size(c)


def polygon_num_interior_rings(polygon: ColumnLike) -> Column:
    return F.greatest(F.size(col(polygon)) - 1, F.lit(0))
