"""Nested fetches: a table's rows with their related rows inside.

Each ``many`` relation is aggregated once by its foreign key before it is joined, so sibling relations never multiply; each
``one`` relation is a left join packed into a struct. Nested filters, order, limit and offset are part of the plan.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tessera import engines
from tessera.functions import conditional, predicates
from tessera.operators import joins
from tessera.plans.query import fuzzy
from tessera.table import Relation, TableSpec

#: What a where callback gets beside the table.
OPERATORS: dict[str, Callable[..., Any]] = {
    "eq": predicates.eq, "ne": predicates.ne, "gt": predicates.gt, "gte": predicates.gte, "lt": predicates.lt, "lte": predicates.lte, "in_array": predicates.in_array, "not_in_array": predicates.not_in_array, "between": predicates.between, "not_between": predicates.not_between,
    "has": predicates.has, "has_all": predicates.has_all, "has_any": predicates.has_any, "sql": predicates.sql, "and_": conditional.and_, "or_": conditional.or_, "not_": conditional.not_, "is_null": conditional.is_null, "is_not_null": conditional.is_not_null, "asc": predicates.asc, "desc": predicates.desc,
}


class Relational:
    """``Relational(spark, tables).users.find_many(...)``."""

    def __init__(self, spark: SparkSession, tables: dict[str, TableSpec]) -> None:
        self._spark, self._tables = spark, tables

    def __getattr__(self, name: str) -> Fetch:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        return Fetch(self._spark, self._tables[name])


class Fetch:
    def __init__(self, spark: SparkSession, spec: TableSpec) -> None:
        self.spark, self.spec = spark, spec

    def find_many(self, *, where: Any = None, columns: list[str] | dict[str, bool] | None = None, order_by: Any = None, limit: int | None = None, offset: int | None = None, with_: dict[str, Any] | None = None, join_strategy: str = "auto") -> DataFrame:
        """A nested DataFrame. ``with_`` names relations, each True or a dict of these same options. A strategy of ``global``
        broadcasts small related sides, ``any`` keeps one row for each key of a ``one`` relation, ``global_any`` does both."""
        if join_strategy not in ("auto", "standard", "global", "any", "global_any"):
            raise ValueError(f"unknown join strategy {join_strategy}")
        return _fetch(self.spark, self.spec, where, columns, order_by, limit, offset, with_, join_strategy)

    def find_first(self, **options: Any) -> Row | None:
        return self.find_many(**{**options, "limit": 1}).first()

    def find_by_id(self, *key: Any, **options: Any) -> Row | None:
        names = self.spec.key()
        if len(key) != len(names):
            raise ValueError(f"the key is ({', '.join(names)})")
        return self.find_first(**{**options, "where": dict(zip(names, key, strict=True))})


def _filter(df: DataFrame, spec: TableSpec, where: Any) -> DataFrame:
    if where is None:
        return df
    if callable(where) and not isinstance(where, Column):
        where = where(spec, OPERATORS)
    if isinstance(where, dict):
        made = F.lit(True)
        for name, value in where.items():
            c = F.col(fuzzy(name, df.columns))
            made = made & (c.isNull() if value is None else c.isin(value) if isinstance(value, (list, tuple)) else c == F.lit(value))
        where = made
    return df.where(where)


def _order(order_by: Any) -> list[Column]:
    if order_by is None:
        return []
    made = []
    for k in order_by if isinstance(order_by, list) else [order_by]:
        if isinstance(k, dict):
            made += [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in k.items()]
        else:
            made.append(F.col(k).asc_nulls_last() if isinstance(k, str) else k)
    return made


def _fetch(spark: SparkSession, spec: TableSpec, where: Any, columns: Any, order_by: Any, limit: int | None, offset: int | None, with_: dict[str, Any] | None, strategy: str) -> DataFrame:
    df = spec.read(spark)
    if spec.default_final:
        df = engines.final(df, spec.engine, spec.order_by)
    df = _filter(df, spec, where)
    order = _order(order_by)
    if limit is not None or offset:
        df = df.orderBy(*order) if order else df
        df = df.offset(offset) if offset else df
        df = df if limit is None else df.limit(limit)
    wanted = _wanted(df, columns)
    nested = {k: v for k, v in (with_ or {}).items() if v}
    for name, options in nested.items():
        if name not in spec.relations:
            raise ValueError(f"{spec.name} has no relation {name!r}")
        df = _attach(spark, df, spec.relations[name], name, {} if options is True else dict(options), strategy)
    out = df.orderBy(*order) if order else df
    return out.select(*[F.col(f"`{c}`") for c in [*wanted, *[n for n in nested if n not in wanted]]])


def _wanted(df: DataFrame, columns: Any) -> list[str]:
    if columns is None:
        return df.columns
    chosen = [c for c, on in columns.items() if on] if isinstance(columns, dict) else columns
    return [fuzzy(c, df.columns) for c in chosen]


def _attach(spark: SparkSession, parent: DataFrame, relation: Relation, name: str, options: dict[str, Any], strategy: str) -> DataFrame:
    target = relation.target
    order, limit, offset = options.pop("order_by", None), options.pop("limit", None), options.pop("offset", None)
    columns, where, inner = options.pop("columns", None), options.pop("where", None), options.pop("with_", None)
    if options:
        raise ValueError(f"unknown options: {', '.join(options)}")
    rows = _fetch(spark, target, where, None, None, None, None, inner, strategy)
    shown = [*_wanted(target.read(spark), columns), *[k for k, v in (inner or {}).items() if v]]
    keys = [f"_fk{i}" for i in range(len(relation.references))]
    child = rows.select(*[F.col(f"`{r}`").alias(k) for r, k in zip(relation.references, keys, strict=True)], "*")
    item = F.struct(*[F.col(f"`{c}`") for c in shown])
    ranks = _order(order)
    if relation.kind == "many":
        if limit is not None or offset:
            w = Window.partitionBy(*keys).orderBy(*(ranks or [F.col(f"`{c}`") for c in target.key()]))
            first, last = (offset or 0) + 1, (offset or 0) + limit if limit is not None else None
            child = child.withColumn("_rank", F.row_number().over(w))
            child = child.where((F.col("_rank") >= first) & (F.col("_rank") <= last) if last is not None else F.col("_rank") >= first)
            listed = F.array_sort(F.collect_list(F.struct("_rank", item.alias("item"))))
        elif ranks:
            child = child.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*ranks)))
            listed = F.array_sort(F.collect_list(F.struct("_rank", item.alias("item"))))
        else:  # by key, so that the order does not depend on the run
            listed = F.array_sort(F.collect_list(F.struct(F.struct(*[F.col(f"`{c}`") for c in target.key()]).alias("_rank"), item.alias("item"))))
        side = child.groupBy(*keys).agg(F.transform(listed, lambda x: x["item"]).alias(name))
    else:
        side = child.select(*keys, item.alias(name))
        if strategy.endswith("any"):
            side = side.groupBy(*keys).agg(F.min(name).alias(name))
    if strategy.startswith("global"):
        side = joins.broadcast_if_small(side)
    same = F.lit(True)
    for f, k in zip(relation.fields, keys, strict=True):
        same = same & (parent[f"`{f}`"] == F.col(k))
    out = parent.join(side, same, "left").drop(*keys)
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(out.schema[name].dataType))) if relation.kind == "many" else out
