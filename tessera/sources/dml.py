"""Inserts, updates and deletes on Parquet tables. Nothing is changed in place: an update or delete writes the new rows beside
the old ones and swaps the folders, so a reader never meets half a table and a failed run leaves the old one."""

from __future__ import annotations

import datetime
import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.table import TableSpec
from tessera.types import ColumnSpec, bounds, enum_values


def _uuid7() -> str:
    ms, rest = time.time_ns() // 1_000_000, int.from_bytes(os.urandom(10), "big")
    bits = (ms & ((1 << 48) - 1)) << 80 | 7 << 76 | (rest >> 62 & 0xFFF) << 64 | 2 << 62 | rest & ((1 << 62) - 1)
    text = f"{bits:032x}"
    return f"{text[:8]}-{text[8:12]}-{text[12:16]}-{text[16:20]}-{text[20:]}"


def generated(kind: str) -> str:
    return _GENERATORS[kind]()


def _uuid6() -> str:
    u = uuid.uuid1()
    t = u.time
    bits = (t >> 28) << 96 | (t >> 12 & 0xFFFF) << 80 | 6 << 76 | (t & 0xFFF) << 64 | u.int & ((1 << 64) - 1)
    return str(uuid.UUID(int=bits))


_GENERATORS = {"uuid1": lambda: str(uuid.uuid1()), "uuid4": lambda: str(uuid.uuid4()), "uuid6": _uuid6, "uuid7": _uuid7}


def _rows(spec: TableSpec, rows: Iterable[dict]) -> list[tuple]:
    columns = [c for c in spec.columns.values() if c.alias_expr is None]
    known = {c.name for c in columns} | set(spec.columns)
    renamed = {k: c.name for k, c in spec.columns.items() if k != c.name}
    cells = [_cell(c) for c in columns]
    out = []
    for r in rows:
        if not known.issuperset(r):
            raise ValueError(f"{spec.name} has no column {', '.join(sorted(set(r) - known))}")
        made = {renamed.get(k, k): v for k, v in r.items()} if renamed else r
        out.append(tuple([cell(made) for cell in cells]))
    return out


def _cell(c: ColumnSpec) -> Callable[[dict], Any]:
    """The value of the column in a row: the one given, else its default."""
    name, kind, value, auto = c.name, c.data_type, c.default_value, c.auto
    lost = c.default_fn or (lambda row: generated(auto) if auto else value)
    variant, text = isinstance(kind, T.VariantType), isinstance(kind, T.StringType)

    def cell(row: dict) -> Any:
        v = row[name] if name in row else lost(row)
        if v is not None and not isinstance(v, str) and (variant or (text and isinstance(v, (dict, list)))):
            return json.dumps(v)
        return v

    return cell


def insert_plan(spark: SparkSession, spec: TableSpec, rows: Iterable[dict] | DataFrame, validate: bool = True) -> DataFrame:
    """The rows as they will be stored: defaults filled, types cast, allowed values and ranges checked in the plan. Row
    functions and UUIDs of given rows are evaluated here, those of a DataFrame in the plan."""
    columns = [c for c in spec.columns.values() if c.alias_expr is None]
    if isinstance(rows, DataFrame):
        lost = [c for c in rows.columns if c not in {c.name for c in columns}]
        if lost:
            raise ValueError(f"{spec.name} has no column {', '.join(lost)}")
        missing = [c for c in columns if c.name not in rows.columns]
        for c in missing:
            if c.default_fn is not None:
                raise ValueError(f"{c.name} has a default of Python rows; give the column")
            rows = rows.withColumn(c.name, F.uuid() if c.auto else F.lit(c.default_value))
        df = rows.select(*[F.col(f"`{c.name}`") for c in columns])
    else:
        held = T.StructType([T.StructField(c.name, T.StringType() if isinstance(c.data_type, T.VariantType) else c.data_type, True) for c in columns])
        df = _local(spark, _rows(spec, rows), held)
    kept = spark.__dict__.setdefault("_tessera_stored", {})
    made = []
    for c in columns:
        key = c, df.schema[c.name].dataType, validate
        try:
            x = kept.get(key)
        except TypeError:  # a default that can't be hashed
            made.append(_stored(*key))
            continue
        if x is None:
            if len(kept) >= KEPT:
                kept.clear()
            x = kept[key] = _stored(*key)
        made.append(x)
    return df.select(*made)


#: Columns' expressions that a session keeps, so that small inserts needn't make them anew.
KEPT = 1024


def _stored(c: ColumnSpec, given: T.DataType, validate: bool) -> Column:
    """What is stored of a column that comes as ``given``."""
    x: Column = F.col(f"`{c.name}`")
    if isinstance(c.data_type, T.VariantType) and not isinstance(given, T.VariantType):
        x = F.parse_json(x.cast("string"))
    elif given != c.data_type:
        x = x.cast(_relaxed(c.data_type))
    if c.materialized_expr:
        x = F.expr(c.materialized_expr).cast(c.data_type)
    elif c.default_expr:
        x = F.coalesce(x, F.expr(c.default_expr).cast(c.data_type))
    return (_checked(c, x) if validate else x).alias(c.name)


#: Rows from Python up to which an insert is one task and one file.
ONE_FILE = 100_000


def _local(spark: SparkSession, rows: list[tuple], kind: T.StructType) -> DataFrame:
    """Rows by way of Arrow columns, where their types have them."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    try:
        arrow = to_arrow_schema(kind)
        if any(pa.types.is_nested(f.type) and "timestamp" in str(f.type) for f in arrow):
            raise TypeError("times inside other types need the session's conversion")
        columns = [pa.array([_zoned(r[i]) if pa.types.is_timestamp(f.type) and f.type.tz else r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
        df = spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError, TypeError, ValueError, OverflowError):
        df = spark.createDataFrame(rows, kind)
    return df


def _zoned(v: Any) -> Any:
    """A time without a zone is the local clock's, as everywhere in Python."""
    return v.astimezone() if isinstance(v, datetime.datetime) and v.tzinfo is None else v


def _relaxed(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed inside, which a cast can't take away; ``_checked`` refuses them instead."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_relaxed(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _relaxed(kind.valueType), True)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _relaxed(f.dataType), True) for f in kind.fields])
    return kind


def _checked(c: ColumnSpec, x: Column) -> Column:
    def must(ok: Column, what: str) -> Column:
        return F.when(ok, x).otherwise(F.raise_error(F.concat(F.lit(f"{c.name}: {what}: "), F.coalesce(x.cast("string"), F.lit("null")))).cast(_relaxed(c.data_type)))

    allowed = list(c.values) or enum_values(c.type)
    if allowed:
        x = must(x.isNull() | x.isin(allowed), "not an allowed value")
    span = bounds(c.type)
    if span and span[1] < 1 << 126:
        x = must(x.isNull() | x.between(F.lit(span[0]).cast(c.data_type) if span[0] == 0 else F.lit(span[0]), F.lit(span[1]).cast("decimal(38,0)")), "out of range")
    if isinstance(c.data_type, T.ArrayType) and not c.data_type.containsNull:
        x = must(x.isNull() | ~F.exists(x, lambda e: e.isNull()), "a null in an array that allows none")
    if not c.field().nullable:
        x = must(x.isNotNull(), "null in a column that allows none")
    return x


def writer(spark: SparkSession, spec: TableSpec, df: DataFrame):
    """The rows dealt by partition and sorted by the key within files."""
    if spec.partition_by:
        df = df.repartition(*spec.partition_by)
    shard = spec.engine.option("shard_key")
    if shard:
        df = df.repartition(F.expr(shard))
    if spec.order_by:
        df = df.sortWithinPartitions(*[*spec.partition_by, *[c for c in spec.order_by if c in df.columns and c not in spec.partition_by]])
    out = df.write.options(**spec.writer_options())
    return out.partitionBy(*spec.partition_by) if spec.partition_by else out


def _in_driver(df: DataFrame) -> bool:
    """Whether the optimiser has worked the rows out already, so that reading them takes no job, and Arrow has their types."""
    from pyspark.sql.pandas.types import to_arrow_schema

    try:
        to_arrow_schema(df.schema)
    except Exception:  # a type without a counterpart, such as VARIANT
        return False
    return df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LocalRelation"


def _write_here(spark: SparkSession, spec: TableSpec, df: DataFrame) -> None:
    """A small insert as one file, without a job: under a hidden name first, so that no reader meets a part of it."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = df.toArrow()
    keys = [(c, "ascending") for c in spec.order_by if c in rows.column_names and not pa.types.is_nested(rows.schema.field(c).type)]
    out = pa.BufferOutputStream()
    pq.write_table(rows.sort_by(keys) if keys else rows, out, compression="snappy")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    name = f"part-{uuid.uuid4().hex}.parquet"
    hidden, final = hadoop(f"{spec.path}/_{name}"), hadoop(f"{spec.path}/{name}")
    fs = hidden.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(hidden, True)
    try:
        stream.write(bytearray(out.getvalue()))
    finally:
        stream.close()
    if not fs.rename(hidden, final):
        raise OSError(f"{final.toString()} could not be written")


class Insert:
    """``insert(spark, table).values(rows).execute()``; immutable."""

    def __init__(self, spark: SparkSession, spec: TableSpec, rows: Any = None, validate: bool = True, returns: bool = False, most: int | None = None) -> None:
        if spec.read_only:
            raise PermissionError(f"{spec.name} is read-only")
        self.spark, self.spec, self._rows, self._validate, self._returns, self._most = spark, spec, rows, validate, returns, most

    def _with(self, **changed: Any) -> Insert:
        now = {"rows": self._rows, "validate": self._validate, "returns": self._returns, "most": self._most, **changed}
        return Insert(self.spark, self.spec, **now)

    def values(self, rows: dict | Iterable[dict] | DataFrame) -> Insert:
        return self._with(rows=[rows] if isinstance(rows, dict) else rows if isinstance(rows, DataFrame) else list(rows))

    def skip_validation(self) -> Insert:
        return self._with(validate=False)

    def returning(self) -> Insert:
        return self._with(returns=True)

    def no_returning(self) -> Insert:
        return self._with(returns=False)

    def max_block_size(self, rows: int) -> Insert:
        return self._with(most=rows)

    def sync_insert(self) -> Insert:
        """Writes are synchronous."""
        return self

    async_insert = use_json_format = use_compact_format = use_binary_format = turbo = sync_insert

    def execute(self) -> DataFrame | None:
        if self._rows is None:
            raise ValueError("nothing to insert")
        df = insert_plan(self.spark, self.spec, self._rows, self._validate)
        if self._returns and isinstance(self._rows, DataFrame):
            df = df.persist()  # or its UUIDs would be drawn again
        if self.spec.engine.name == "Null":
            df.write.format("noop").mode("overwrite").save()
            return df if self._returns else None
        if not isinstance(self._rows, DataFrame):
            if self._plain() and len(self._rows) <= ONE_FILE and _in_driver(df):
                _write_here(self.spark, self.spec, df)
                return df if self._returns else None
            df = df.coalesce(1) if len(self._rows) <= ONE_FILE else df
        out = writer(self.spark, self.spec, df).mode("append")
        if self._most:
            out = out.option("maxRecordsPerFile", self._most)
        out.parquet(self.spec.path) if self.spec.path else out.insertInto(self.spec.name)
        return df if self._returns else None

    def _plain(self) -> bool:
        """Whether one plain Parquet file holds the rows of an insert."""
        s = self.spec
        return bool(s.path) and not (s.partition_by or s.engine.option("shard_key") or s.writer_options() or self._most)

    def returning_one(self) -> Any:
        return self.returning().execute().first()


def insert(spark: SparkSession, spec: TableSpec) -> Insert:
    return Insert(spark, spec)


def insert_many(spark: SparkSession, spec: TableSpec, rows: Iterable[dict] | Iterator[dict], block: int = 10_000) -> int:
    """Rows of any iterator, written a block at a time; their number."""
    held: list[dict] = []
    n = 0
    for r in rows:
        held.append(r)
        if len(held) >= block:
            insert(spark, spec).values(held).execute()
            n, held = n + len(held), []
    if held:
        insert(spark, spec).values(held).execute()
    return n + len(held)


class Batcher:
    """A buffer in the driver, written when it has so many rows, and by a timer when its first row is so old. An error of the
    timer's write keeps the rows and is raised by the next call."""

    def __init__(self, spark: SparkSession, spec: TableSpec, rows: int = 10_000, seconds: float = 5.0) -> None:
        self.spark, self.spec, self.rows, self.seconds = spark, spec, rows, seconds
        self._held: list[dict] = []
        self._lock, self._writing = threading.Lock(), threading.Lock()
        self._timer: threading.Timer | None = None
        self._failed: Exception | None = None

    def append(self, row: dict) -> None:
        self._raise()
        with self._lock:
            self._held.append(row)
            due = len(self._held) >= self.rows
            if not due and self._timer is None:
                self._timer = threading.Timer(self.seconds, self._late)
                self._timer.daemon = True
                self._timer.start()
        if due:
            self.flush()

    def _raise(self) -> None:
        with self._lock:
            failed, self._failed = self._failed, None
        if failed is not None:
            raise failed

    def _late(self) -> None:
        try:
            self.flush()
        except Exception as e:  # for the next call
            with self._lock:
                self._failed = e

    def flush(self) -> int:
        """Write what is held; the number of its rows."""
        with self._writing:
            with self._lock:
                held, self._held = self._held, []
                timer, self._timer = self._timer, None
            if timer is not None:
                timer.cancel()
            if held:
                try:
                    insert(self.spark, self.spec).values(held).execute()
                except Exception:
                    with self._lock:
                        self._held = held + self._held
                    raise
        return len(held)

    def close(self) -> None:
        self._raise()
        self.flush()

    def __enter__(self) -> Batcher:
        return self

    def __exit__(self, kind: Any, *_: Any) -> None:
        if kind is None:
            self.close()
        elif self._timer is not None:
            self._timer.cancel()


def _guard(spec: TableSpec, condition: Any, what: str) -> None:
    if spec.read_only:
        raise PermissionError(f"{spec.name} is read-only")
    if spec.append_only:
        raise PermissionError(f"{spec.name} is append-only; {what} needs append_only=False")
    if condition is None:
        raise ValueError(f"{what} needs a condition")
    if not spec.path:
        raise ValueError(f"{what} needs a table with a path")


def _swap(spark: SparkSession, path: str, df: DataFrame, spec: TableSpec) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    name = uuid.uuid4().hex
    new, old = f"{path.rstrip('/')}__new_{name}", f"{path.rstrip('/')}__old_{name}"
    try:
        writer(spark, spec, df).parquet(new)
    except Exception:
        fs.delete(hadoop(new), True)
        raise
    fs.rename(hadoop(path), hadoop(old))
    if not fs.rename(hadoop(new), hadoop(path)):
        fs.rename(hadoop(old), hadoop(path))
        raise OSError(f"{path} could not be replaced")
    fs.delete(hadoop(old), True)


def update(spark: SparkSession, spec: TableSpec, set_: dict[str, Any], where: Column | str | None) -> None:
    """Rows of the condition get the values, which may be columns; a condition that is null leaves the row."""
    _guard(spec, where, "an update")
    if not set_:
        raise ValueError("an update sets at least one column")
    named = {k: spec.columns[k].name if k in spec.columns else k for k in set_}
    own = {c.name: c for c in spec.columns.values()}
    lost = [k for k, n in named.items() if n not in own]
    if lost:
        raise ValueError(f"{spec.name} has no column {', '.join(lost)}")
    hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
    df = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in spec.schema.fields])).parquet(spec.path)
    new = {n: F.when(hit, _checked(own[n], (v if isinstance(v, Column) else F.lit(v)).cast(own[n].data_type))).otherwise(F.col(f"`{n}`")).alias(n) for (k, n), v in zip(named.items(), set_.values(), strict=True)}
    _swap(spark, spec.path, df.select(*[new.get(c, F.col(f"`{c}`")) for c in df.columns]), spec)


def delete(spark: SparkSession, spec: TableSpec, where: Column | str | None) -> None:
    _guard(spec, where, "a delete")
    hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
    df = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in spec.schema.fields])).parquet(spec.path)
    _swap(spark, spec.path, df.where(~hit), spec)
