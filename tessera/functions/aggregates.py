"""Aggregate functions. Sums of no rows are null, as in SQL; exact variants are the default, sketches are opt-in."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions._args import ColumnLike, col


def count(c: ColumnLike | None = None) -> Column:
    return F.count("*") if c is None else F.count(col(c))


def min_(c: ColumnLike) -> Column:
    return F.min(col(c))


def max_(c: ColumnLike) -> Column:
    return F.max(col(c))


def sum_(c: ColumnLike) -> Column:
    return F.sum(col(c))


def avg(c: ColumnLike) -> Column:
    return F.avg(col(c))


def uniq(c: ColumnLike, rsd: float = 0.02) -> Column:
    """Approximate number of distinct values (HyperLogLog++)."""
    return F.approx_count_distinct(col(c), rsd)


def uniq_exact(c: ColumnLike) -> Column:
    return F.count_distinct(col(c))


count_distinct = uniq_exact


def uniq_state(c: ColumnLike) -> Column:
    """A mergeable sketch of the distinct values; merge with ``uniq_merge_state``, read with ``uniq_merge``."""
    return F.hll_sketch_agg(col(c))


def uniq_merge_state(c: ColumnLike) -> Column:
    return F.hll_union_agg(col(c))


def uniq_merge(c: ColumnLike) -> Column:
    return F.hll_sketch_estimate(F.hll_union_agg(col(c)))


def group_array(c: ColumnLike, ordered: bool = False) -> Column:
    """All non-null values; ``ordered`` sorts them, since a shuffle leaves no order."""
    out = F.collect_list(col(c))
    return F.array_sort(out) if ordered else out


def group_uniq_array(c: ColumnLike, ordered: bool = False) -> Column:
    out = F.collect_set(col(c))
    return F.array_sort(out) if ordered else out


def group_uniq_array_if(c: ColumnLike, condition: Column) -> Column:
    return F.collect_set(F.when(condition, col(c)))


def group_array_array(c: ColumnLike) -> Column:
    return F.flatten(F.collect_list(col(c)))


def any_(c: ColumnLike) -> Column:
    return F.any_value(col(c), ignoreNulls=F.lit(True))


def any_last(c: ColumnLike) -> Column:
    """The last non-null value; only meaningful over ordered input, such as a window."""
    return F.last(col(c), ignorenulls=True)


def arg_min(value: ColumnLike, weight: ColumnLike) -> Column:
    return F.min_by(col(value), col(weight))


def arg_max(value: ColumnLike, weight: ColumnLike) -> Column:
    return F.max_by(col(value), col(weight))


def stddev_samp(c: ColumnLike) -> Column:
    return F.stddev_samp(col(c))


def stddev_pop(c: ColumnLike) -> Column:
    return F.stddev_pop(col(c))


def var_samp(c: ColumnLike) -> Column:
    return F.var_samp(col(c))


def var_pop(c: ColumnLike) -> Column:
    return F.var_pop(col(c))


def median(c: ColumnLike, approx: bool = False) -> Column:
    return F.percentile_approx(col(c), 0.5) if approx else F.median(col(c))


def quantile(c: ColumnLike, level: float, approx: bool = False) -> Column:
    """Interpolated and exact, or an approximate rank with bounded memory."""
    return F.percentile_approx(col(c), level) if approx else F.percentile(col(c), F.lit(level))


def quantiles(c: ColumnLike, levels: list[float], approx: bool = False) -> Column:
    return F.percentile_approx(col(c), levels) if approx else F.percentile(col(c), F.array(*map(F.lit, levels)))


def corr(a: ColumnLike, b: ColumnLike) -> Column:
    return F.corr(col(a), col(b))


def covar_samp(a: ColumnLike, b: ColumnLike) -> Column:
    return F.covar_samp(col(a), col(b))


def covar_pop(a: ColumnLike, b: ColumnLike) -> Column:
    return F.covar_pop(col(a), col(b))


def _series(time: ColumnLike, by: list[ColumnLike] | None) -> WindowSpec:
    return Window.partitionBy(*[col(b) for b in by or []]).orderBy(col(time))


def delta(c: ColumnLike, time: ColumnLike, by: list[ColumnLike] | None = None) -> Column:
    """The change since the row before, in order of time within each series."""
    w = _series(time, by)
    return col(c) - F.lag(col(c)).over(w)


def increase(c: ColumnLike, time: ColumnLike, by: list[ColumnLike] | None = None) -> Column:
    """Growth of a counter since the row before; after a reset the counter's own value."""
    before = F.lag(col(c)).over(_series(time, by))
    return F.when(col(c) < before, col(c)).otherwise(col(c) - before)


def _elapsed(time: ColumnLike, by: list[ColumnLike] | None) -> Column:
    """Seconds since the row before. Whole microseconds are subtracted: seconds since 1970 as a double are off by some 1e-7."""
    micros = F.unix_micros(col(time).cast("timestamp"))
    return (micros - F.lag(micros).over(_series(time, by))) / 1e6


def rate(c: ColumnLike, time: ColumnLike, by: list[ColumnLike] | None = None) -> Column:
    """Growth of a counter per second since the row before; null where no time has passed."""
    return F.try_divide(increase(c, time, by), _elapsed(time, by))


def increase_by(df: DataFrame, c: str, time: str, bucket: Column, by: list[str] | None = None, to: str = "increase") -> DataFrame:
    """Growth of each series' counter summed by ``bucket``, a column made of the time such as its hour; a row's growth falls
    into the bucket of the row. A bucket with a series' first row only has none: null."""
    grown = df.withColumn("_grown", increase(c, time, by)).withColumn("bucket", bucket)
    return grown.groupBy(*(by or []), "bucket").agg(F.sum("_grown").alias(to))


def rate_by(df: DataFrame, c: str, time: str, bucket: Column, by: list[str] | None = None, to: str = "rate") -> DataFrame:
    """Growth per second of each series' counter by ``bucket``: what it grew over the time since the row before it grew in."""
    w = _series(time, by)
    seconds = F.unix_micros(col(time).cast("timestamp")) / 1e6
    grown = df.withColumn("_grown", increase(c, time, by)).withColumn("_took", seconds - F.lag(seconds).over(w)).withColumn("bucket", bucket)
    return grown.groupBy(*(by or []), "bucket").agg(F.try_divide(F.sum("_grown"), F.sum("_took")).alias(to))


def top_k(c: ColumnLike, n: int) -> Column:
    """The n most frequent values with their counts, by a sketch; ``operators.frequent.top_k`` is the exact one."""
    return F.call_function("approx_top_k", col(c), F.lit(n))


def sum_if(c: ColumnLike, condition: Column) -> Column:
    return F.sum(F.when(condition, col(c)))


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def avg_if(c: ColumnLike, condition: Column) -> Column:
    return F.avg(F.when(condition, col(c)))


def min_if(c: ColumnLike, condition: Column) -> Column:
    return F.min(F.when(condition, col(c)))


def max_if(c: ColumnLike, condition: Column) -> Column:
    return F.max(F.when(condition, col(c)))


def uniq_if(c: ColumnLike, condition: Column) -> Column:
    return uniq(F.when(condition, col(c)))


def uniq_exact_if(c: ColumnLike, condition: Column) -> Column:
    return F.count_distinct(F.when(condition, col(c)))


def filtered(aggregate: Any, c: ColumnLike, condition: Column) -> Column:
    """Any one-column aggregate of this module over the rows of the condition only."""
    return aggregate(F.when(condition, col(c)))
