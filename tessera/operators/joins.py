"""Joins that Spark lacks, as plans over ones it has.

Equality keys are column names that both sides share. Skewed keys of ordinary joins are split by adaptive execution; the
as-of join's window is by key, so ``bucket`` splits a hot key by time.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much wider the cells of an interval join's next level are; the last level, for intervals without an end.
_FACTOR, _LEVELS = 8, 341
#: Bytes that the optimiser may estimate of a side that is broadcast on request.
BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size of a plan; it is an overestimate where statistics lack."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if estimated_bytes(df) <= most else df


def _one_per_key(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row of each key: the least by ``order``, else any; pre-aggregated, so a hot key moves once a task."""
    if not order:
        return df.dropDuplicates(keys)
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return df.groupBy(*keys).agg(F.min(ranked).alias("best")).select("best.row.*")


def any_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", order: list[Column] | None = None) -> DataFrame:
    """At most one match on the right for each row on the left; an inner one keeps one row of each key on the left, too.
    ``order`` decides which row of a key is kept: without it any may be."""
    if how == "inner":
        left = _one_per_key(left, on, None)
    return left.join(_one_per_key(right, on, order), on, how)


def semi_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_anti")


def global_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """An ordinary join whose right side is sent to all executors if it is small."""
    return left.join(broadcast_if_small(right), on, how)


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, how: str = "left", tie: list[str] | None = None, bucket: str | None = None) -> DataFrame:
    """Each left row with the last right row of its key whose time is at most its own; of equal times the greatest ``tie``.

    Both sides go through one shuffle by key and one sort; a running last value carries the right row forward. Times of the
    two sides need the same type. With ``bucket`` (a unit such as ``day``) keys are split by time: the last right row of
    each bucket is carried into the later ones by a window over the buckets alone.
    """
    if how not in ("left", "inner"):
        raise ValueError("an as-of join is left or inner")
    clash = (set(left.columns) & set(right.columns)) - set(on)
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    taken = [c for c in right.columns if c not in on]
    a = left.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(on)], F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left"))
    a = a.withColumn("_right", F.lit(None).cast(right.select(*taken).schema.simpleString())).withColumn("_tie", F.lit(None).cast("string") if not tie else F.lit(None).cast(right.select(*tie).schema.simpleString()))
    b = right.where(F.col(right_time).isNotNull())
    b = b.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(on)], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in taken]).alias("_right"), (F.struct(*[F.col(f"`{c}`") for c in tie]) if tie else F.lit(None).cast("string")).alias("_tie"))
    b = b.withColumn("_left", F.lit(None).cast(left.schema.simpleString())).select(*a.columns)
    both = a.unionByName(b)
    keys = [f"_k{i}" for i in range(len(on))]
    order = ["_t", "_side", "_tie"]
    run = lambda parts: Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if bucket:
        both = both.withColumn("_b", F.date_trunc(bucket, F.col("_t").cast("timestamp")))
        ends = both.groupBy(*keys, "_b").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_tie", "_right"))).alias("_end"))
        earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*[F.col(k).alias(f"{k}c") for k in keys], F.col("_b").alias("_bc"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
        same = F.col("_b").eqNullSafe(F.col("_bc"))
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}c"))
        both = both.join(carried, same, "left")
        found = F.coalesce(F.last("_right", ignorenulls=True).over(run([*keys, "_b"])), F.col("_carried._right"))
    else:
        found = F.last("_right", ignorenulls=True).over(run(keys))
    out = both.withColumn("_found", found).where("_side = 1")
    # Null keys and times match nothing.
    known = F.col("_t").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    out = out.withColumn("_found", F.when(known, F.col("_found")))
    if how == "inner":
        out = out.where(F.col("_found").isNotNull())
    return out.select("_left.*", *[F.col("_found")[c].alias(c) for c in taken])


def interval_join(left: DataFrame, right: DataFrame, point: str, start: str, end: str, width: float, on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Left rows whose number ``point`` is between ``start`` and ``end`` of a right row, both included; with ``how="left"``
    also those without such a row, their right columns null.

    The line is cut into cells, so the join is on equal cells instead of all pairs. Cells of a level are ``_FACTOR`` times as
    wide as those of the level below, the lowest ``width`` wide; an interval lies in the lowest level whose cells are as wide
    as itself, so it touches two cells at most however wide it is. The levels that occur are found by a scan of the right
    side's bounds; each is one join."""
    if how not in ("inner", "left"):
        raise ValueError("an interval join is inner or left")
    keys = list(on or [])
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    number = lambda c: F.greatest(F.least(F.col(f"`{c}`").cast("double"), F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))
    low, high = number(start), number(end)
    level = F.least(F.ceil(F.log(F.greatest(high - low, F.lit(width)) / width) / math.log(_FACTOR)), F.lit(_LEVELS)).cast("int")
    sides = right.where(F.col(f"`{start}`") <= F.col(f"`{end}`")).withColumn("_level", level)
    levels = sorted(r["_level"] for r in sides.select("_level").distinct().collect()) or [0]
    rest, found = left, None
    for k in levels:
        size = width * float(_FACTOR) ** k
        cell = lambda c: F.floor(c / F.lit(size))  # noqa: E731, B023
        cells = sides.where(F.col("_level") == k).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
        cells = cells.drop("_level").withColumnsRenamed({c: f"_on_{c}" for c in keys})
        at = F.when(F.col(f"`{point}`").isNotNull(), cell(number(point)))
        asked = rest.withColumn("_at", at)
        same = (F.col("_at") == F.col("_cell")) & F.col(f"`{point}`").between(F.col(f"`{start}`"), F.col(f"`{end}`"))
        for c in keys:
            same = same & (F.col(f"`{c}`") == F.col(f"`_on_{c}`"))
        spare = ["_at", "_cell", *[f"_on_{c}" for c in keys]]
        if how == "left" and len(levels) == 1:
            return asked.join(cells, same, "left").drop(*spare)
        hits = left.withColumn("_at", at).join(cells, same, "inner").drop(*spare)
        found = hits if found is None else found.unionByName(hits)
        if how == "left":
            rest = asked.join(cells, same, "left_anti").drop("_at")
    return found.unionByName(rest, allowMissingColumns=True) if how == "left" else found


def unroll(df: DataFrame, *arrays: str, into: list[str] | None = None, outer: bool = False) -> DataFrame:
    """One row for each place of the arrays, which go in lock-step, short ones filled with null; rows whose arrays are all
    empty or null go unless ``outer``. The elements take the arrays' names, or those of ``into``."""
    names = into or list(arrays)
    zipped = F.arrays_zip(*[F.coalesce(F.col(f"`{a}`"), F.array().cast(df.schema[a].dataType)) for a in arrays])
    made = df.withColumn("_item", (F.explode_outer if outer else F.explode)(zipped))
    fields = made.schema["_item"].dataType.fieldNames()
    for name, f in zip(names, fields, strict=True):
        made = made.withColumn(name, F.col("_item")[f])
    return made.drop("_item")


def sample(df: DataFrame, ratio: float, key: str, offset: float = 0.0, buckets: int = 1_000_000) -> DataFrame:
    """The rows whose key's hash falls in [offset, offset + ratio) of its range: the same keys on every read."""
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets))
    return df.where((at >= int(offset * buckets)) & (at < int((offset + ratio) * buckets)))
