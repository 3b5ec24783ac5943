"""Exact most and least frequent or heaviest values, by group. Counts are pre-aggregated; ranks prune before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, value: str, n: int, by: list[str], weight: Column, descending: bool, to: str) -> DataFrame:
    totals = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(weight.alias("_w"))
    order = [F.col("_w").desc() if descending else F.col("_w").asc(), F.col(value).asc()]
    if not by:
        best = totals.orderBy(*order).limit(n)
    else:
        best = totals.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
    weighed = F.col("_w") if not descending else -F.col("_w")
    listed = F.array_sort(F.collect_list(F.struct(weighed.alias("w"), F.col(value).alias("v"))))
    return best.groupBy(*by).agg(F.transform(listed, lambda x: x["v"]).alias(to))


def top_k(df: DataFrame, value: str, n: int, by: list[str] | None = None, to: str = "top") -> DataFrame:
    """An array of the n most frequent values, ties by value, for each group or for all."""
    return _ranked(df, value, n, by or [], F.count("*"), True, to)


def bottom_k(df: DataFrame, value: str, n: int, by: list[str] | None = None, to: str = "bottom") -> DataFrame:
    return _ranked(df, value, n, by or [], F.count("*"), False, to)


def top_sum(df: DataFrame, value: str, n: int, by: list[str] | None = None, weight: str | None = None, to: str = "top") -> DataFrame:
    """The n values of greatest sum: of ``weight``, or of the values themselves."""
    return _ranked(df, value, n, by or [], F.sum(weight or value), True, to)


def bottom_sum(df: DataFrame, value: str, n: int, by: list[str] | None = None, weight: str | None = None, to: str = "bottom") -> DataFrame:
    return _ranked(df, value, n, by or [], F.sum(weight or value), False, to)


def limit_by(df: DataFrame, n: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
