"""Table specifications: columns, an engine, keys and relations, validated when they are made."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.engines import Engine, merge_tree, replacing_merge_tree, replicated
from tessera.types import ColumnSpec


@dataclass(frozen=True)
class Relation:
    """``one`` or ``many`` rows of ``target`` whose ``references`` equal this table's ``fields``."""

    kind: str
    target: TableSpec
    fields: tuple[str, ...]
    references: tuple[str, ...]


def one(target: TableSpec, fields: list[str], references: list[str]) -> Relation:
    return Relation("one", target, tuple(fields), tuple(references))


def many(target: TableSpec, fields: list[str], references: list[str]) -> Relation:
    return Relation("many", target, tuple(fields), tuple(references))


@dataclass(frozen=True)
class Index:
    """A data-skipping hint: ``minmax`` is Parquet's own statistics, ``bloom_filter`` a writer option."""

    name: str
    columns: tuple[str, ...] = ()
    kind: str = "minmax"

    def on(self, *columns: str) -> Index:
        return replace(self, columns=columns)

    def type(self, kind: str) -> Index:
        return replace(self, kind=kind)


def index(name: str) -> Index:
    return Index(name)


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: dict[str, ColumnSpec]
    engine: Engine = field(default_factory=merge_tree)
    order_by: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    primary_key: tuple[str, ...] = ()
    sample_by: str | None = None
    ttl: tuple[str, str] | None = None
    append_only: bool = True
    read_only: bool = False
    default_final: bool = False
    indices: tuple[Index, ...] = ()
    externally_managed: bool = False
    path: str | None = None
    relations: dict[str, Relation] = field(default_factory=dict, compare=False)
    alias: str | None = None

    def __getattr__(self, name: str) -> Column:
        columns = self.__dict__.get("columns") or {}
        if name in columns:
            return F.col(f"`{self.alias}`.`{columns[name].name}`") if self.__dict__.get("alias") else columns[name].column()
        raise AttributeError(name)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns.values() if c.alias_expr is None])

    def as_(self, alias: str) -> TableSpec:
        """The table under another name; the specification itself stays as it is, so self joins work."""
        return replace(self, alias=alias)

    def related(self, **relations: Relation) -> TableSpec:
        return replace(self, relations={**self.relations, **relations})

    def key(self) -> tuple[str, ...]:
        return self.primary_key or tuple(c.name for c in self.columns.values() if c.is_primary_key) or (next(iter(self.columns.values())).name,)

    def read(self, spark: SparkSession) -> DataFrame:
        """The stored rows, with alias columns computed; a merge-on-read engine shows its merged rows only through
        ``engines.final``."""
        df = spark.read.schema(T.StructType([replace_nullable(f) for f in self.schema.fields])).parquet(self.path) if self.path else spark.table(self.name)
        for c in self.columns.values():
            if c.alias_expr is not None:
                df = df.withColumn(c.name, F.expr(c.alias_expr).cast(c.data_type))
        return df.alias(self.alias) if self.alias else df

    def to_ddl(self, if_not_exists: bool = True) -> str:
        """CREATE TABLE for a Parquet table of Spark's catalog."""
        lines = [f"  `{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" + (f" COMMENT '{f.metadata['comment']}'" if "comment" in f.metadata else "") for f in self.schema.fields]
        out = f"CREATE TABLE {'IF NOT EXISTS ' if if_not_exists else ''}{self.name} (\n" + ",\n".join(lines) + "\n) USING PARQUET"
        if self.partition_by:
            out += f"\nPARTITIONED BY ({', '.join(self.partition_by)})"
        options = self.writer_options()
        if options:
            out += "\nOPTIONS (" + ", ".join(f"'{k}' '{v}'" for k, v in options.items()) + ")"
        return out + f"\nTBLPROPERTIES ('engine' = '{self.engine.name}', 'order_by' = '{', '.join(self.order_by)}', 'append_only' = '{str(self.append_only).lower()}')"

    def writer_options(self) -> dict[str, str]:
        return {f"parquet.bloom.filter.enabled#{c}": "true" for i in self.indices if i.kind == "bloom_filter" for c in i.columns}


def replace_nullable(f: T.StructField) -> T.StructField:
    return T.StructField(f.name, f.dataType, True, f.metadata)


def table(name: str, columns: dict[str, ColumnSpec], *, engine: Engine | None = None, order_by: str | list[str] = (), partition_by: str | list[str] = (), primary_key: str | list[str] = (), sample_by: str | None = None, cluster: str | None = None, version_column: str | None = None, relations: dict[str, Relation] | None = None, default_final: bool | None = None, **options: Any) -> TableSpec:
    """A validated specification. A version column makes a plain merge tree a replacing one; a cluster without an engine
    makes it replicated. Replacing tables read merged rows by default."""
    many_of = lambda x: (x,) if isinstance(x, str) else tuple(x)
    made = {k: c.named(k) for k, c in columns.items()}
    given = engine
    engine = engine or merge_tree()
    if version_column and given is None:
        engine = replacing_merge_tree(version_column)
    if cluster and given is None:
        engine = replicated(engine)
    spec = TableSpec(name, made, engine, many_of(order_by), many_of(partition_by), many_of(primary_key), sample_by, relations=dict(relations or {}), default_final=engine.base.name == "ReplacingMergeTree" if default_final is None else default_final, **options)
    validate(spec)
    return spec


def validate(spec: TableSpec) -> None:
    names = {c.name for c in spec.columns.values()}
    for what in ("order_by", "primary_key", "partition_by"):
        for c in getattr(spec, what):
            if c not in names and "(" not in c:
                raise ValueError(f"{spec.name}: {what} names {c!r}, which is no column")
    if spec.sample_by and spec.sample_by not in names:
        raise ValueError(f"{spec.name}: sample_by names {spec.sample_by!r}, which is no column")
    base = spec.engine.base
    if base.merges and spec.columns and not spec.order_by:
        raise ValueError(f"{spec.name}: {base.name} needs order_by")
    if base.name == "ReplacingMergeTree" and not base.version:
        raise ValueError(f"{spec.name}: ReplacingMergeTree needs a version column")
    for c in (base.version, base.sign, base.deleted, *base.columns):
        if c and c not in names:
            raise ValueError(f"{spec.name}: the engine names {c!r}, which is no column")


def define_columns(columns: dict[str, ColumnSpec]) -> dict[str, ColumnSpec]:
    return columns


def extend_columns(base: dict[str, ColumnSpec], extra: dict[str, ColumnSpec]) -> dict[str, ColumnSpec]:
    twice = base.keys() & extra.keys()
    if twice:
        raise ValueError(f"columns defined twice: {', '.join(sorted(twice))}")
    return {**base, **extra}


def versioned_table(base: str, version: int | str, columns: dict[str, ColumnSpec], **options: Any) -> tuple[TableSpec, str]:
    """``<base>_v<version>`` and the SQL of the view that stands for it under the base name."""
    spec = table(f"{base}_v{version}", columns, **options)
    return spec, f"CREATE OR REPLACE VIEW {base} AS SELECT * FROM {spec.name}"


def derive_table(source: DataFrame, group_by: list[str], aggregates: dict[str, Column], target: str | None = None) -> DataFrame:
    """Grouped rows of a table, with the types that the analyser finds; written to ``target`` if one is named."""
    out = source.groupBy(*group_by).agg(*[e.alias(k) for k, e in aggregates.items()])
    if target:
        out.write.mode("overwrite").saveAsTable(target)
        return source.sparkSession.table(target)
    return out


def render_schema(spec: TableSpec) -> str:
    return spec.to_ddl()


_PYTHON = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float", "string": "str", "boolean": "bool", "date": "datetime.date", "timestamp": "datetime.datetime", "timestamp_ntz": "datetime.datetime", "binary": "bytes", "variant": "Any"}


def python_type(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"list[{python_type(kind.elementType)}]"
    if isinstance(kind, T.MapType):
        return f"dict[{python_type(kind.keyType)}, {python_type(kind.valueType)}]"
    if isinstance(kind, T.StructType):
        return "dict[str, Any]"
    return "decimal.Decimal" if isinstance(kind, T.DecimalType) else _PYTHON[kind.simpleString()]


def generate_types(spec: TableSpec, name: str | None = None) -> str:
    """Source of TypedDicts of the table's rows: one to select, one to insert, where defaulted columns are optional."""
    name = name or "".join(p.title() for p in spec.name.split("_"))
    hint = lambda f: python_type(f.dataType) + (" | None" if f.nullable else "")
    rows = [(c, f) for c, f in zip([c for c in spec.columns.values() if c.alias_expr is None], spec.schema.fields, strict=True)]
    select = "".join(f"    {f.name}: {hint(f)}\n" for _, f in rows)
    insert = "".join(f"    {f.name}: {f'NotRequired[{hint(f)}]' if c.has_default or f.nullable else hint(f)}\n" for c, f in rows)
    return f"class {name}(TypedDict):\n{select}\n\nclass {name}Insert(TypedDict):\n{insert}"


def callback(f: Callable[[TableSpec], dict[str, Relation]], spec: TableSpec) -> TableSpec:
    """Relations that refer to the table itself."""
    return spec.related(**f(spec))
