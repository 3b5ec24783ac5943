"""Views, materialized views and projections (side tables of aggregates), with their drift and migration plans."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import engines, scratch
from tessera.engines import Engine, summing_merge_tree
from tessera.plans.query import Query


def view(spark: SparkSession, name: str, query: str | DataFrame | Query, or_replace: bool = True, temporary: bool | None = None) -> str:
    """Create a view and return its name. SQL text makes a catalog view, a plan a temporary one."""
    if isinstance(query, str) and not temporary:
        spark.sql(f"CREATE {'OR REPLACE ' if or_replace else ''}VIEW {name} AS {query}")
        return name
    df = spark.sql(query) if isinstance(query, str) else query.df() if isinstance(query, Query) else query
    (df.createOrReplaceTempView if or_replace else df.createTempView)(name)
    return name


@dataclass(frozen=True)
class MaterializedView:
    """A query whose result is kept in a table. ``refresh`` computes it anew; ``apply`` takes only new rows of the source and
    appends their partial result, which ``read`` merges by the engine, as a trigger on inserts would. Every part, the
    back-fill too, is a partition of the target's folder."""

    name: str
    query: Any
    target: str
    engine: Engine = field(default_factory=summing_merge_tree)
    order_by: tuple[str, ...] = ()
    merge: tuple[tuple[str, str], ...] = ()

    def _result(self, source: DataFrame) -> DataFrame:
        return self.query(source)

    def refresh(self, source: DataFrame) -> None:
        """Everything that was applied goes; what the source's rows give is the first part of the target."""
        spark, new = source.sparkSession, f"{self.target.rstrip('/')}__new_{uuid.uuid4().hex}"
        try:
            self._result(source).write.parquet(f"{new}/_batch=populated")
        except Exception:
            scratch.remove(spark, new)
            raise
        scratch.remove(spark, self.target)
        scratch.move(spark, new, self.target)

    populate = refresh

    def apply(self, new_rows: DataFrame, batch: int | None = None) -> None:
        """Adds to the target. ``batch`` numbers a streaming batch: applying it again changes nothing."""
        part = f"added-{uuid.uuid4().hex}" if batch is None else str(batch)
        self._result(new_rows).write.mode("overwrite").parquet(f"{self.target.rstrip('/')}/_batch={part}")

    def stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.target)

    def read(self, spark: SparkSession) -> DataFrame:
        rows = self.stored(spark)
        rows = rows.drop("_batch") if "_batch" in rows.columns else rows
        return engines.final(rows, self.engine, self.order_by, merge=dict(self.merge)) if self.order_by else rows

    def sql(self) -> str:
        return f"CREATE MATERIALIZED VIEW {self.name} TO {self.target}"


def materialized_view(name: str, query: Any, *, target: str, engine: Engine | None = None, group_by: list[str] = (), merge: dict[str, str] | None = None, populate_from: DataFrame | None = None) -> MaterializedView:
    """``query`` is a function from the source's rows to the result's."""
    made = MaterializedView(name, query, target, engine or summing_merge_tree(), tuple(group_by), tuple((merge or {}).items()))
    if populate_from is not None:
        made.refresh(populate_from)
    return made


@dataclass(frozen=True)
class Projection:
    """A side table of a table's rows grouped by ``group_by``, with additive aggregates: name -> (sum, min, max or count,
    column). ``route`` answers from it whatever it can."""

    name: str
    group_by: tuple[str, ...]
    aggregates: tuple[tuple[str, tuple[str, str]], ...]
    path: str | None = None

    def build(self, source: DataFrame, path: str) -> Projection:
        _aggregate(source, self.group_by, self.aggregates).write.mode("overwrite").parquet(path)
        return replace(self, path=path)

    def answers(self, group_by: list[str], aggregates: dict[str, tuple[str, str]]) -> bool:
        return self.path is not None and set(group_by) <= set(self.group_by) and set(aggregates.values()) <= {a for _, a in self.aggregates}


_HOW = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
_AGAIN = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}


def _aggregate(df: DataFrame, group_by: Any, aggregates: Any) -> DataFrame:
    return df.groupBy(*group_by).agg(*[_HOW[how](F.col(c) if c != "*" else "*").alias(name) for name, (how, c) in aggregates])


def projection(name: str, group_by: list[str], aggregates: dict[str, tuple[str, str]]) -> Projection:
    for how, _ in aggregates.values():
        if how not in _HOW:
            raise ValueError(f"{how} can't be merged")
    return Projection(name, tuple(group_by), tuple(aggregates.items()))


def to_projection_definition(p: Projection) -> dict[str, str]:
    chosen = [*p.group_by, *[f"{how}({c}) AS {name}" for name, (how, c) in p.aggregates]]
    return {"name": p.name, "query": f"SELECT {', '.join(chosen)} GROUP BY {', '.join(p.group_by)}"}


def route(source: DataFrame, projections: list[Projection], group_by: list[str], aggregates: dict[str, tuple[str, str]], where: Column | None = None, where_columns: list[str] = ()) -> DataFrame:
    """Grouped aggregates from the projection of fewest keys that holds them, else from the source. A filter needs the
    columns it reads named."""
    fit = [p for p in projections if p.answers([*group_by, *where_columns], aggregates) and (where is None or where_columns)]
    if not fit:
        return _aggregate(source if where is None else source.where(where), group_by, aggregates.items())
    p = min(fit, key=lambda p: len(p.group_by))
    held = {a: name for name, a in p.aggregates}
    rows = source.sparkSession.read.parquet(p.path)
    rows = rows if where is None else rows.where(where)
    return rows.groupBy(*group_by).agg(*[_AGAIN[how](held[how, c]).alias(name) for name, (how, c) in aggregates.items()])


def normalize_sql(text: str) -> str:
    """One space for white space, none at the ends or around brackets and commas, no closing semicolon, in capitals outside
    quotes."""
    parts = re.split(r"('(?:[^'\\]|\\.)*')", text.strip().rstrip(";"))
    flat = [p if i % 2 else re.sub(r"\s*([(),])\s*", r"\1", re.sub(r"\s+", " ", p)).upper() for i, p in enumerate(parts)]
    return "".join(flat).strip()


def extract_mv_query(statement: str) -> str | None:
    m = re.search(r"\bAS\s+((?:WITH|SELECT)\b.*)$", statement, re.I | re.S)
    return m[1].strip().rstrip(";") if m else None


def detect_drift(local: DataFrame | str, remote: DataFrame | str) -> bool:
    """Whether two views differ: by analysed plan, or as SQL text without regard to layout."""
    if isinstance(local, DataFrame) and isinstance(remote, DataFrame):
        return not local.sameSemantics(remote)
    return normalize_sql(str(local)) != normalize_sql(str(remote))


def blue_green(old: str, new_query: str, target: str, backfill: bool = True) -> list[str]:
    """Statements that build the next version beside the old one and swap the names. Two renames, so readers may fall between
    them: Spark's catalog can't exchange tables at once."""
    out = [f"DROP TABLE IF EXISTS {target}__next", f"CREATE TABLE {target}__next USING PARQUET AS {new_query}" if backfill else f"CREATE TABLE {target}__next USING PARQUET AS SELECT * FROM ({new_query}) WHERE false"]
    return [*out, f"ALTER TABLE {target} RENAME TO {target}__old", f"ALTER TABLE {target}__next RENAME TO {target}", f"DROP TABLE IF EXISTS {target}__old", f"-- {old} now reads {target}"]


def migration_bridge(source: DataFrame, target: str, mapping: dict[str, Column | str], checkpoint: str | None = None):
    """Copy rows of one version of a table to the next through a column mapping: at once, or for a stream as they come. A
    stream's batch that fails after its write is written again when the stream restarts."""
    made = lambda df: df.select(*[(F.expr(e) if isinstance(e, str) else e).alias(k) for k, e in mapping.items()])
    if not source.isStreaming:
        made(source).write.mode("append").parquet(target)
        return None
    if not checkpoint:
        raise ValueError("a stream needs a checkpoint folder")

    def batch(rows: DataFrame, _: int) -> None:
        made(rows).write.mode("append").parquet(target)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
