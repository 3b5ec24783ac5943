"""An immutable query builder. Every method returns a new query; nothing runs before a terminal method, and what runs is one
DataFrame plan. Clauses apply in the order of SQL, not in that of the calls."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from contextlib import redirect_stdout
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera import engines
from tessera.functions.windows import Spec
from tessera.operators import joins
from tessera.table import TableSpec

Source = "TableSpec | DataFrame | Query | str"


def fuzzy(name: str, columns: list[str]) -> str:
    """The column that the name means: as it is, without regard to case, or between camelCase and snake_case."""
    if name in columns:
        return name
    flat = lambda s: re.sub(r"_", "", s).lower()
    found = [c for c in columns if flat(c) == flat(name)]
    if len(found) != 1:
        raise ValueError(f"no column {name!r} among {', '.join(columns)}")
    return found[0]


@dataclass(frozen=True)
class _Join:
    kind: str
    right: Any
    on: Any
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Query:
    spark: SparkSession
    source: Any = None
    ctes: tuple[tuple[str, Any], ...] = ()
    fields: tuple[Any, ...] | dict[str, Any] | None = None
    is_distinct: bool = False
    wants_final: bool | None = None
    sampled: tuple[float, float] | None = None
    joined: tuple[_Join, ...] = ()
    unrolled: tuple[tuple[tuple[str, ...], tuple[str, ...] | None], ...] = ()
    before: Column | None = None
    condition: Any = None
    groups: tuple[Any, ...] = ()
    kept: Column | None = None
    order: tuple[Column, ...] = ()
    count_limit: int | None = None
    skip: int = 0
    windows: tuple[tuple[str, Any], ...] = ()
    conf: tuple[tuple[str, str], ...] = ()

    # Sources.

    def from_(self, source: Any, alias: str | None = None) -> Query:
        if alias is not None:
            source = source.as_(alias) if isinstance(source, TableSpec) else _frame(self.spark, source).alias(alias)
        return replace(self, source=source)

    def with_(self, name: str, query: Any) -> Query:
        """A common table expression: later sources and joins may use the name."""
        return replace(self, ctes=(*self.ctes, (name, query)))

    def final(self, on: bool = True) -> Query:
        return replace(self, wants_final=on)

    def sample(self, ratio: float, offset: float = 0.0) -> Query:
        return replace(self, sampled=(ratio, offset))

    # Projection.

    def select(self, *fields: Any, **named: Any) -> Query:
        """Columns or names, a dict or keywords of output name to column, or a function of the source that returns a dict."""
        if len(fields) == 1 and isinstance(fields[0], dict):
            return replace(self, fields={**fields[0], **named})
        if len(fields) == 1 and callable(fields[0]) and not isinstance(fields[0], Column):
            return replace(self, fields=fields[0](self.source))
        if named:
            return replace(self, fields={**{str(i): f for i, f in enumerate(fields)}, **named} if fields else named)
        return replace(self, fields=tuple(fields) or None)

    def distinct(self) -> Query:
        return replace(self, is_distinct=True)

    def window(self, name: str, definition: str | Spec) -> Query:
        """A named window: a specification, or SQL text with a frame; use it with ``over(name, 'sum(x)', as_)``."""
        return replace(self, windows=(*self.windows, (name, definition)))

    def over(self, name: str, expr: str | Column) -> Column:
        definition = dict(self.windows)[name]
        if isinstance(definition, str):
            if isinstance(expr, Column):
                raise ValueError("a window of SQL text takes an expression of SQL text")
            return F.expr(f"{expr} OVER ({definition})")
        return (F.expr(expr) if isinstance(expr, str) else expr).over(definition.build())

    # Filters.

    def where(self, condition: Column | dict[str, Any] | str | None) -> Query:
        """A condition, or equalities by column. A second call replaces the first."""
        return replace(self, condition=condition)

    def prewhere(self, condition: Column) -> Query:
        """A filter before the joins; the optimiser would push it down anyway."""
        return replace(self, before=condition)

    def group_by(self, *columns: Any) -> Query:
        return replace(self, groups=columns)

    def having(self, condition: Column | str) -> Query:
        return replace(self, kept=F.expr(condition) if isinstance(condition, str) else condition)

    def order_by(self, *keys: Any) -> Query:
        """Columns, names or (column, 'asc' or 'desc'); nulls last in both directions."""
        made = []
        for k in keys:
            c, direction = k if isinstance(k, tuple) else (k, None)
            c = F.col(c) if isinstance(c, str) else c
            ordered = re.search(r"NULLS (FIRST|LAST)", str(c))
            made.append(c if ordered and direction is None else (c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last()))
        return replace(self, order=tuple(made))

    def limit(self, n: int) -> Query:
        return replace(self, count_limit=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def settings(self, **conf: Any) -> Query:
        """Settings that hold for this query alone, whenever its plan runs; only ``spark.sql.*``, with dots as double
        underscores."""
        made = tuple((k.replace("__", "."), str(v)) for k, v in conf.items())
        for k, _ in made:
            if not k.startswith("spark.sql."):
                raise ValueError(f"{k} can't be set for a query")
        return replace(self, conf=(*self.conf, *made))

    # Joins.

    def join(self, kind: str, right: Any, on: Any = None, **options: Any) -> Query:
        return replace(self, joined=(*self.joined, _Join(kind, right, on, options)))

    def inner_join(self, right: Any, on: Any) -> Query:
        return self.join("inner", right, on)

    def left_join(self, right: Any, on: Any) -> Query:
        return self.join("left", right, on)

    def right_join(self, right: Any, on: Any) -> Query:
        return self.join("right", right, on)

    def full_join(self, right: Any, on: Any) -> Query:
        return self.join("full", right, on)

    def cross_join(self, right: Any) -> Query:
        return self.join("cross", right)

    def semi_join(self, right: Any, on: Any) -> Query:
        return self.join("left_semi", right, on)

    def anti_join(self, right: Any, on: Any) -> Query:
        return self.join("left_anti", right, on)

    def all_join(self, kind: str, right: Any, on: Any) -> Query:
        return self.join(kind, right, on)

    def any_join(self, kind: str, right: Any, on: list[str], order: list[Column] | None = None) -> Query:
        return self.join("any", right, on, how=kind, order=order)

    def any_inner_join(self, right: Any, on: list[str], order: list[Column] | None = None) -> Query:
        return self.any_join("inner", right, on, order)

    def any_left_join(self, right: Any, on: list[str], order: list[Column] | None = None) -> Query:
        return self.any_join("left", right, on, order)

    def global_join(self, kind: str, right: Any, on: Any) -> Query:
        return self.join("global", right, on, how=kind)

    def global_inner_join(self, right: Any, on: Any) -> Query:
        return self.global_join("inner", right, on)

    def global_left_join(self, right: Any, on: Any) -> Query:
        return self.global_join("left", right, on)

    def global_any_join(self, kind: str, right: Any, on: list[str], order: list[Column] | None = None) -> Query:
        return self.any_join(kind, right, on, order)

    def asof_join(self, right: Any, on: list[str], left_time: str, right_time: str, **options: Any) -> Query:
        return self.join("asof", right, on, left_time=left_time, right_time=right_time, **options)

    def asof_inner_join(self, right: Any, on: list[str], left_time: str, right_time: str, **options: Any) -> Query:
        return self.asof_join(right, on, left_time, right_time, how="inner", **options)

    global_asof_join = asof_join

    def array_join(self, *arrays: str) -> Query:
        """One row for each element; several arrays unroll in lock-step."""
        return replace(self, unrolled=(*self.unrolled, (arrays, None)))

    array_join_multiple = array_join

    def array_join_as(self, array: str, alias: str) -> Query:
        return replace(self, unrolled=(*self.unrolled, ((array,), (alias,))))

    # The plan.

    def _resolve(self, x: Any) -> DataFrame:
        if isinstance(x, str) and x in dict(self.ctes):
            names = [n for n, _ in self.ctes]
            inner = replace(self, ctes=self.ctes[: names.index(x)])
            made = dict(self.ctes)[x]
            if isinstance(made, Query):
                made = replace(made, ctes=(*inner.ctes, *made.ctes))
            return _frame(self.spark, made).alias(x)
        return _frame(self.spark, x)

    def df(self) -> DataFrame:
        return self._scoped(self._plan()) if self.conf else self._plan()

    def _scoped(self, plan: DataFrame) -> DataFrame:
        """The plan in a copy of the session that has the settings; catalog, cache and functions are shared or copied."""
        copy = self.spark._jsparkSession.cloneSession()
        for k, v in self.conf:
            copy.conf().set(k, v)
        jdf = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(copy, plan._jdf.queryExecution().logical())
        return DataFrame(jdf, SparkSession(self.spark.sparkContext, copy))

    def _plan(self) -> DataFrame:
        out = self._resolve(self.source)
        if isinstance(self.source, TableSpec) and (self.source.default_final if self.wants_final is None else self.wants_final):
            out = engines.final(out, self.source.engine, self.source.order_by)
            if self.source.alias:
                out = out.alias(self.source.alias)
        if self.sampled:
            key = (self.source.sample_by or self.source.order_by[0]) if isinstance(self.source, TableSpec) else out.columns[0]
            out = joins.sample(out, self.sampled[0], key, self.sampled[1])
        if self.before is not None:
            out = out.where(self.before)
        for arrays, into in self.unrolled:
            out = joins.unroll(out, *arrays, into=list(into) if into else None)
        for j in self.joined:
            out = self._join(out, j)
        if self.condition is not None:
            out = out.where(self._condition(out))
        if self.groups:
            out = self._grouped(out)
        elif self.fields is None:
            out = out if self.kept is None else out.where(self.kept)
            out = out.orderBy(*self.order) if self.order else out
        else:
            selected = out.select(*self._columns(out))
            selected = selected if self.kept is None else selected.where(self.kept)
            # Spark finds sort keys in the projection and, failing that, in its input.
            out = selected.orderBy(*self.order) if self.order else selected
        if self.is_distinct:
            out = out.distinct()
            out = out.orderBy(*self.order) if self.order else out
        if self.skip:
            out = out.offset(self.skip)
        return out if self.count_limit is None else out.limit(self.count_limit)

    def _join(self, left: DataFrame, j: _Join) -> DataFrame:
        right = self._resolve(j.right)
        o = j.options
        if isinstance(j.right, TableSpec) and j.right.default_final:
            right = engines.final(right, j.right.engine, j.right.order_by)
            right = right.alias(j.right.alias) if j.right.alias else right
        if j.kind == "cross":
            return left.crossJoin(right)
        if j.kind == "any":
            return joins.any_join(left, right, list(j.on), o["how"], o.get("order"))
        if j.kind == "asof":
            return joins.asof_join(left, right, list(j.on), **o)
        if j.kind == "global":
            return joins.global_join(left, right, j.on, o["how"])
        return left.join(right, j.on, j.kind)

    def _condition(self, out: DataFrame) -> Column:
        c = self.condition
        if isinstance(c, str):
            return F.expr(c)
        if not isinstance(c, dict):
            return c
        made = F.lit(True)
        for name, value in c.items():
            made = made & (F.col(fuzzy(name, out.columns)).isNull() if value is None else F.col(fuzzy(name, out.columns)) == F.lit(value))
        return made

    def _columns(self, out: DataFrame) -> list[Column]:
        if isinstance(self.fields, dict):
            return [_expr(v, out).alias(k) for k, v in self.fields.items()]
        return [_expr(v, out) for v in self.fields]

    def _grouped(self, out: DataFrame) -> DataFrame:
        keys = [_expr(g, out) for g in self.groups]
        if self.fields is None:
            made = out.select(*keys).distinct()
            return made.where(self.kept) if self.kept is not None else made
        # The keys come first, then what is selected, which may be keys again.
        made = out.groupBy(*keys).agg(*self._columns(out))
        names = made.columns[len(keys) :]
        hidden = [f"_key{i}" if k in names else k for i, k in enumerate(made.columns[: len(keys)])]
        made = made.toDF(*hidden, *names)
        if self.kept is not None:
            made = made.where(self.kept)
        if self.order:
            made = made.orderBy(*self.order)
        return made.select(*[F.col(f"`{n}`") for n in names])

    # Terminals.

    def collect(self) -> list[Row]:
        return self.df().collect()

    def stream(self) -> Iterator[Row]:
        """Rows one partition at a time."""
        return self.df().toLocalIterator(prefetchPartitions=True)

    def find_first(self) -> Row | None:
        return self.limit(1).df().first()

    find_unique = find_first

    def find_many(self, limit: int | None = None, offset: int | None = None) -> list[Row]:
        q = self if limit is None else self.limit(limit)
        return (q if offset is None else q.offset(offset)).collect()

    def find_many_cursor(self, column: str, limit: int, cursor: Any = None, descending: bool = False) -> tuple[list[Row], Any]:
        """A page in order of a unique column after the cursor, and the next page's cursor, None at the end. The query's own
        condition stays."""
        rows = self.page(column, limit + 1, cursor, descending).collect()
        more = len(rows) > limit
        return rows[:limit], rows[limit - 1][column] if more else None

    def page(self, column: str, limit: int, cursor: Any = None, descending: bool = False) -> DataFrame:
        """The plan of a page."""
        d = self.df()
        if cursor is not None:
            d = d.where(F.col(column) < F.lit(cursor) if descending else F.col(column) > F.lit(cursor))
        return d.orderBy(F.col(column).desc() if descending else F.col(column).asc()).limit(limit)

    def union(self, other: Any) -> Query:
        """The rows of both, by place and without duplicates; a query over the result."""
        return Query(self.spark).from_(self.df().union(_frame(self.spark, other)).distinct())

    def union_all(self, other: Any) -> Query:
        return Query(self.spark).from_(self.df().union(_frame(self.spark, other)))

    def except_(self, other: Any) -> Query:
        return Query(self.spark).from_(self.df().subtract(_frame(self.spark, other)))

    def intersect(self, other: Any) -> Query:
        return Query(self.spark).from_(self.df().intersect(_frame(self.spark, other)))

    def count(self) -> int:
        return self.df().count()

    def exists(self) -> bool:
        return not self.df().isEmpty()

    def find_many_with_meta(self, limit: int, offset: int = 0, total: bool = False) -> dict[str, Any]:
        rows = self.offset(offset).limit(limit + 1).collect()
        return {"data": rows[:limit], "has_more": len(rows) > limit, "total": self.count() if total else None}

    def find_as_map(self, key: str) -> dict[Any, Row]:
        return {r[key]: r for r in self.collect()}

    def find_grouped(self, column: str) -> DataFrame:
        """One row for each value with an array of its rows; the grouping is distributed."""
        d = self.df()
        return d.groupBy(column).agg(F.collect_list(F.struct(*d.columns)).alias("rows"))

    def native(self) -> Any:
        """An Arrow table."""
        return self.df().toArrow()

    vector = native

    def explain(self, mode: str = "formatted") -> str:
        text = io.StringIO()
        with redirect_stdout(text):
            self.df().explain(mode=mode)
        return text.getvalue()

    def explain_pipeline(self) -> str:
        """The physical operators, one by one."""
        return self.explain("formatted")

    def suggestions(self) -> list[str]:
        """Remarks on the query that need no run."""
        out = []
        if isinstance(self.source, TableSpec) and self.order and self.source.order_by:
            first = re.sub(r"^Column<'`?|[`\s'].*$", "", str(self.order[0]))
            if first != self.source.order_by[0]:
                out.append(f"order_by {first} is not the table's sort key ({', '.join(self.source.order_by)})")
        plan = self.explain()
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            out.append("a join without an equality compares all pairs")
        if self.count_limit is None and self.order:
            out.append("order_by without limit sorts the whole result")
        return out


def _expr(x: Any, out: DataFrame) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x) if "." in x else F.col(f"`{fuzzy(x, out.columns)}`")
    return x.column() if hasattr(x, "column") else F.lit(x)


def _frame(spark: SparkSession, x: Any) -> DataFrame:
    if isinstance(x, DataFrame):
        return x
    if isinstance(x, Query):
        return x.df()
    if isinstance(x, TableSpec):
        return x.read(spark)
    return spark.table(x)


class Database:
    """A client: queries, raw SQL with bound values, and the catalog."""

    def __init__(self, spark: SparkSession, tables: dict[str, TableSpec] | None = None) -> None:
        self.spark = spark
        self.tables = dict(tables or {})

    def select(self, *fields: Any, **named: Any) -> Query:
        return Query(self.spark).select(*fields, **named)

    def from_(self, source: Any, alias: str | None = None) -> Query:
        return Query(self.spark).from_(source, alias)

    def with_(self, name: str, query: Any) -> Query:
        return Query(self.spark).with_(name, query)

    def raw(self, sql: str, **params: Any) -> DataFrame:
        """SQL text; values are bound by name (``:name``), never pasted in."""
        return self.spark.sql(sql, args=params or None)

    def command(self, sql: str) -> None:
        self.spark.sql(sql)

    def table_exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def ensure_table(self, spec: TableSpec) -> None:
        self.spark.sql(spec.to_ddl())

    def drop_table(self, name: str, if_exists: bool = True) -> None:
        self.spark.sql(f"DROP TABLE {'IF EXISTS ' if if_exists else ''}{name}")

    @property
    def query(self):
        from tessera.plans.relational import Relational

        return Relational(self.spark, self.tables)
