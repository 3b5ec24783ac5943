"""Table engines as merge semantics. Storage is append-only; ``final`` is the merged view that a reader asks for, a plan over
the stored rows keyed on the sort key. Nothing is merged in the background; ``optimize`` writes the merged rows back."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Engine:
    name: str
    version: str | None = None
    sign: str | None = None
    deleted: str | None = None
    columns: tuple[str, ...] = ()
    options: tuple[tuple[str, Any], ...] = field(default=())
    inner: Engine | None = None

    @property
    def base(self) -> Engine:
        """The engine whose semantics hold: a replicated engine's own base."""
        return self.inner.base if self.inner else self

    @property
    def merges(self) -> bool:
        return self.base.name.endswith("MergeTree")

    def option(self, name: str, default: Any = None) -> Any:
        return dict(self.options).get(name, default)


def merge_tree() -> Engine:
    return Engine("MergeTree")


def replacing_merge_tree(version: str, deleted: str | None = None) -> Engine:
    return Engine("ReplacingMergeTree", version=version, deleted=deleted)


def summing_merge_tree(*columns: str) -> Engine:
    return Engine("SummingMergeTree", columns=columns)


def aggregating_merge_tree() -> Engine:
    return Engine("AggregatingMergeTree")


def collapsing_merge_tree(sign: str) -> Engine:
    return Engine("CollapsingMergeTree", sign=sign)


def versioned_collapsing_merge_tree(sign: str, version: str) -> Engine:
    return Engine("VersionedCollapsingMergeTree", sign=sign, version=version)


def graphite_merge_tree(path: str = "path", time: str = "time", value: str = "value", version: str = "version", rules: list[tuple[int, int]] = ()) -> Engine:
    """Rules are (age in seconds, precision in seconds), by increasing age."""
    return Engine("GraphiteMergeTree", version=version, options=(("path", path), ("time", time), ("value", value), ("rules", tuple(rules))))


def replicated(engine: Engine | None = None, path: str | None = None, replica: str | None = None) -> Engine:
    base = engine or merge_tree()
    return Engine(f"Replicated{base.name}", version=base.version, sign=base.sign, deleted=base.deleted, columns=base.columns, options=(("path", path), ("replica", replica)), inner=base)


def buffer(target: str, rows: int = 10_000, seconds: float = 5.0) -> Engine:
    """Rows gather in the driver until there are so many or so old; see ``sources.dml.Batcher``."""
    return Engine("Buffer", options=(("target", target), ("rows", rows), ("seconds", seconds)))


def buffer_explicit(target: str, layers: int, min_seconds: float, max_seconds: float, min_rows: int, max_rows: int, min_bytes: int, max_bytes: int) -> Engine:
    return Engine("Buffer", options=(("target", target), ("layers", layers), ("rows", max_rows), ("seconds", max_seconds), ("min_rows", min_rows), ("min_seconds", min_seconds), ("min_bytes", min_bytes), ("max_bytes", max_bytes)))


def distributed(cluster: str, table: str, shard_key: str | None = None) -> Engine:
    """Rows are dealt by the shard key when they are written."""
    return Engine("Distributed", options=(("cluster", cluster), ("table", table), ("shard_key", shard_key)))


def null() -> Engine:
    return Engine("Null")


def log() -> Engine:
    return Engine("Log")


def tiny_log() -> Engine:
    return Engine("TinyLog")


def memory() -> Engine:
    return Engine("Memory")


def join_engine(strictness: str, kind: str, *keys: str) -> Engine:
    return Engine("Join", columns=keys, options=(("strictness", strictness), ("kind", kind)))


def dictionary_engine(name: str) -> Engine:
    return Engine("Dictionary", options=(("dictionary", name),))


def file_engine(format: str, path: str | None = None, compression: str | None = None) -> Engine:
    return Engine("File", options=(("format", format), ("path", path), ("compression", compression)))


def url_engine(url: str, format: str) -> Engine:
    return Engine("URL", options=(("url", url), ("format", format)))


def s3_engine(path: str, format: str, **options: Any) -> Engine:
    return Engine("S3", options=(("path", path), ("format", format), *options.items()))


def kafka_engine(brokers: str, topics: str, group: str, format: str = "JSONEachRow", **options: Any) -> Engine:
    return Engine("Kafka", options=(("brokers", brokers), ("topics", topics), ("group", group), ("format", format), *options.items()))


def postgresql_engine(url: str, table: str, **options: Any) -> Engine:
    return Engine("PostgreSQL", options=(("url", url), ("table", table), *options.items()))


def mysql_engine(url: str, table: str, **options: Any) -> Engine:
    return Engine("MySQL", options=(("url", url), ("table", table), *options.items()))


def is_merge_tree_family(engine: Engine) -> bool:
    return engine.merges


def is_replicated_engine(engine: Engine) -> bool:
    return engine.inner is not None


def version_column(engine: Engine) -> str | None:
    return engine.base.version


def _whole(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def _newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of the greatest order of each key: one pre-aggregated pass, which no hot key can overload. Types without an
    order can't go into max_by's struct and take a window instead."""
    if not order:
        return df.dropDuplicates(keys)
    w = Window.partitionBy(*keys).orderBy(*[o.desc_nulls_last() for o in order])
    if any(isinstance(f.dataType, (T.VariantType, T.MapType)) for f in df.schema.fields):
        return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    # The whole row breaks ties, so the result does not depend on the order of the input.
    best = df.groupBy(*keys).agg(F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], _whole(df).alias("row"))).alias("best"))
    return best.select("best.row.*")


def final(df: DataFrame, engine: Engine, order_by: list[str] | tuple[str, ...], sequence: str | None = None, merge: dict[str, str] | None = None, now: Column | None = None) -> DataFrame:
    """The rows that a reader of the merged table sees. ``sequence`` is a column of the order of insertion, which decides
    between equal versions; ``merge`` names the function of each state column of an aggregating table: sum, min, max, any,
    uniq (a sketch) or groupUniqArray."""
    e, keys = engine.base, list(order_by)
    after = [F.col(sequence)] if sequence else []
    if e.name == "ReplacingMergeTree":
        out = _newest(df, keys, [*([F.col(e.version)] if e.version else []), *after])
        return out.where(F.col(e.deleted) == 0) if e.deleted else out
    if e.name == "SummingMergeTree":
        numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keys]
        sums = [c for c in e.columns if c not in keys] or numeric
        rest = [c for c in df.columns if c not in keys and c not in sums]
        kinds = {f.name: f.dataType for f in df.schema.fields}
        out = df.groupBy(*keys).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in sums], *[F.any_value(c).alias(c) for c in rest])
        # Rows whose sums are all zero vanish.
        some = F.lit(False)
        for c in sums:
            some = some | (F.coalesce(F.col(c), F.lit(0)) != 0)
        return (out.where(some) if sums else out).select(*df.columns)
    if e.name == "AggregatingMergeTree":
        how = {"sum": F.sum, "min": F.min, "max": F.max, "any": F.any_value, "uniq": F.hll_union_agg, "groupUniqArray": lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))}
        merge = merge or {}
        return df.groupBy(*keys).agg(*[how[merge.get(c, "any")](c).alias(c) for c in df.columns if c not in keys]).select(*df.columns)
    if e.name in ("CollapsingMergeTree", "VersionedCollapsingMergeTree"):
        by = keys + ([e.version] if e.name.startswith("Versioned") else [])
        order = [*after, *([F.col(e.version)] if e.version and e.version not in by else [])]
        state = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], _whole(df).alias("row"))
        live = df.groupBy(*by).agg(F.sum(e.sign).alias("_n"), F.max(F.when(F.col(e.sign) > 0, state)).alias("_last"))
        return live.where("_n > 0").select("_last.row.*")
    if e.name == "GraphiteMergeTree":
        path, time, value = e.option("path"), e.option("time"), e.option("value")
        latest = _newest(df, [path, time], [F.col(e.version), *after])
        at = F.unix_timestamp(F.col(time).cast("timestamp"))
        age = F.unix_timestamp(now if now is not None else F.current_timestamp()) - at
        slot: Column = at
        for limit, step in sorted(e.option("rules") or ()):
            slot = F.when(age >= limit, at - F.pmod(at, F.lit(step))).otherwise(slot)
        kind = df.schema[time].dataType
        rolled = latest.withColumn(time, F.timestamp_seconds(slot).cast(kind))
        return rolled.groupBy(path, time).agg(F.avg(value).alias(value), F.max(e.version).alias(e.version))
    return df


def optimize(df: DataFrame, engine: Engine, order_by: list[str], path: str, **how: Any) -> None:
    """Write the merged rows, sorted by the key within files, to another path; the caller swaps it in."""
    final(df, engine, order_by, **how).sortWithinPartitions(*order_by).write.mode("overwrite").parquet(path)


def prepared(df: DataFrame, engine: Engine) -> DataFrame:
    """The right side that a Join engine keeps ready: cached, and for ANY joins one row of each key."""
    if engine.base.name != "Join":
        raise ValueError(f"{engine.name} keeps no join side")
    keys = list(engine.base.columns)
    return (df.dropDuplicates(keys) if engine.option("strictness", "ALL").upper() == "ANY" else df).persist()


def fill_defaults(df: DataFrame, *columns: str) -> DataFrame:
    """Nulls of the columns (all by default) as their types' defaults: 0, empty text or array, false, the start of 1970. For
    dialects in which a missed join or lookup is not null."""
    zero = {T.BooleanType: F.lit(False), T.DateType: F.lit("1970-01-01").cast("date"), T.TimestampType: F.timestamp_seconds(F.lit(0)), T.TimestampNTZType: F.lit("1970-01-01").cast("timestamp_ntz")}
    made = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if not columns or f.name in columns:
            if isinstance(kind, T.NumericType):
                c = F.coalesce(c, F.lit(0).cast(kind))
            elif isinstance(kind, T.StringType):
                c = F.coalesce(c, F.lit(""))
            elif isinstance(kind, T.ArrayType):
                c = F.coalesce(c, F.array().cast(kind))
            elif type(kind) in zero:
                c = F.coalesce(c, zero[type(kind)])
        made.append(c.alias(f.name))
    return df.select(*made)
