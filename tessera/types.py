"""Column types: builders, a parser for type strings, and immutable column specifications.

Types wider than Spark's go to the next that holds all their values: unsigned integers widen one step, 64-bit unsigned and
128-bit integers are decimals, 256-bit integers text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type names and the Spark types that hold them.
_PLAIN: dict[str, T.DataType] = {
    "Int8": T.ByteType(), "Int16": T.ShortType(), "Int32": T.IntegerType(), "Int64": T.LongType(),
    "Int128": T.DecimalType(38, 0), "Int256": T.StringType(), "UInt8": T.ShortType(), "UInt16": T.IntegerType(), "UInt32": T.LongType(),
    "UInt64": T.DecimalType(20, 0), "UInt128": T.DecimalType(38, 0), "UInt256": T.StringType(),
    "Float32": T.FloatType(), "Float64": T.DoubleType(), "BFloat16": T.FloatType(), "String": T.StringType(), "Bool": T.BooleanType(), "UUID": T.StringType(),
    "Date": T.DateType(), "Date32": T.DateType(), "DateTime": T.TimestampType(), "IPv4": T.StringType(), "IPv6": T.StringType(), "JSON": T.VariantType(), "Dynamic": T.VariantType(),
}
_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_GEO = {"Point": _POINT, "Ring": T.ArrayType(_POINT), "Polygon": T.ArrayType(T.ArrayType(_POINT)), "MultiPolygon": T.ArrayType(T.ArrayType(T.ArrayType(_POINT)))}
_DECIMAL = {"Decimal32": 9, "Decimal64": 18, "Decimal128": 38, "Decimal256": 38}
_SPARK = re.compile(r"^(tinyint|smallint|int|integer|bigint|float|double|decimal|string|boolean|binary|date|timestamp|timestamp_ntz|variant|array|map|struct)\b")


def _split(text: str) -> list[str]:
    """At the commas outside brackets and quotes."""
    out, depth, at, quoted = [], 0, 0, False
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += c in "(<"
            depth -= c in ")>"
            if c == "," and not depth:
                out.append(text[at:i].strip())
                at = i + 1
    return [*out, text[at:].strip()] if text.strip() else []


def spark_type(text: str) -> T.DataType:
    """The Spark type of a type string, such as ``Array(Nullable(UInt32))``, or of Spark's own DDL."""
    text = text.strip()
    if _SPARK.match(text):
        return T._parse_datatype_string(text) if "<" in text or "(" in text else T._parse_datatype_string(text)
    if text in _PLAIN:
        return _PLAIN[text]
    if text in _GEO:
        return _GEO[text]
    m = re.fullmatch(r"(\w+)\((.*)\)", text, re.S)
    if not m:
        raise ValueError(f"unknown type {text!r}")
    name, args = m[1], _split(m[2])
    if name in ("Nullable", "LowCardinality"):
        return spark_type(args[0])
    if name == "Array":
        return T.ArrayType(spark_type(args[0]), args[0].startswith("Nullable(") or args[0].startswith("LowCardinality(Nullable("))
    if name == "Map":
        return T.MapType(spark_type(args[0]), spark_type(args[1]))
    if name == "Tuple":
        named = [re.fullmatch(r"(\w+)\s+(.+)", a, re.S) for a in args]
        return T.StructType([T.StructField(n[1], spark_type(n[2])) if n else T.StructField(f"_{i}", spark_type(a)) for i, (a, n) in enumerate(zip(args, named, strict=True), 1)])
    if name == "Nested":
        fields = [re.fullmatch(r"(\w+)\s+(.+)", a, re.S) for a in args]
        return T.ArrayType(T.StructType([T.StructField(f[1], spark_type(f[2])) for f in fields]))
    if name == "Decimal":
        return T.DecimalType(min(int(args[0]), 38), int(args[1]) if len(args) > 1 else 0)
    if name in _DECIMAL:
        return T.DecimalType(_DECIMAL[name], int(args[0]))
    if name in ("FixedString", "Enum8", "Enum16"):
        return T.StringType()
    if name in ("DateTime", "DateTime64"):
        return T.TimestampType()
    if name == "SimpleAggregateFunction":
        return spark_type(args[1])
    if name == "AggregateFunction":
        return T.BinaryType()
    raise ValueError(f"unknown type {text!r}")


def enum_values(text: str) -> list[str] | None:
    m = re.fullmatch(r"(?:Nullable\()?Enum(?:8|16)\((.*?)\)\)?", text, re.S)
    return re.findall(r"'((?:[^'\\]|\\.)*)'", m[1]) if m else None


def bounds(text: str) -> tuple[int, int] | None:
    """The least and greatest value of an integer type."""
    m = re.fullmatch(r"(?:Nullable\(|LowCardinality\()*(U?)Int(\d+)\)*", text)
    if not m:
        return None
    n = int(m[2])
    return (0, 2**n - 1) if m[1] else (-(2 ** (n - 1)), 2 ** (n - 1) - 1)


@dataclass(frozen=True)
class ColumnSpec:
    """A column: name, type string, and what inserts need to know. Every modifier returns a new specification."""

    type: str
    name: str = ""
    is_nullable: bool = False
    is_primary_key: bool = False
    values: tuple[str, ...] = ()
    default_value: Any = None
    default_expr: str | None = None
    default_fn: Callable[[dict], Any] | None = field(default=None, compare=False)
    auto: str | None = None
    refers_to: str | None = None
    codec_text: str | None = None
    materialized_expr: str | None = None
    alias_expr: str | None = None
    comment_text: str | None = None

    @property
    def data_type(self) -> T.DataType:
        return spark_type(self.type)

    def named(self, name: str) -> ColumnSpec:
        return self if self.name else replace(self, name=name)

    def column(self) -> Column:
        return F.col(f"`{self.name}`")

    def nullable(self) -> ColumnSpec:
        return replace(self, is_nullable=True)

    def not_null(self) -> ColumnSpec:
        return replace(self, is_nullable=False)

    def primary_key(self) -> ColumnSpec:
        return replace(self, is_primary_key=True)

    def default(self, value: Any) -> ColumnSpec:
        return replace(self, default_value=value)

    def default_sql(self, expr: str) -> ColumnSpec:
        return replace(self, default_expr=expr)

    def default_from(self, fn: Callable[[dict], Any]) -> ColumnSpec:
        """A function of the row, evaluated where rows are inserted from Python."""
        return replace(self, default_fn=fn)

    def auto_generate(self, version: int = 4) -> ColumnSpec:
        if self.type not in ("UUID", "LowCardinality(UUID)"):
            raise ValueError("only UUID columns are generated")
        if version not in (1, 4, 6, 7):
            raise ValueError("UUIDs of versions 1, 4, 6 and 7 are generated; 3 and 5 need a name")
        return replace(self, auto=f"uuid{version}")

    def references(self, target: str) -> ColumnSpec:
        return replace(self, refers_to=target)

    def codec(self, text: str) -> ColumnSpec:
        return replace(self, codec_text=text)

    def materialized(self, expr: str) -> ColumnSpec:
        return replace(self, materialized_expr=expr)

    def alias(self, expr: str) -> ColumnSpec:
        return replace(self, alias_expr=expr)

    def comment(self, text: str) -> ColumnSpec:
        return replace(self, comment_text=text)

    @property
    def has_default(self) -> bool:
        return any(x is not None for x in (self.default_value, self.default_expr, self.default_fn, self.auto))

    def field(self) -> T.StructField:
        kept = {"type": self.type, "primary_key": self.is_primary_key or None, "values": list(self.values) or None, "default": self.default_expr or (None if self.default_value is None else repr(self.default_value)), "auto": self.auto, "references": self.refers_to, "codec": self.codec_text, "materialized": self.materialized_expr, "alias": self.alias_expr, "comment": self.comment_text}
        nullable = self.is_nullable or self.type.startswith(("Nullable(", "LowCardinality(Nullable(")) or self.type in ("JSON", "Dynamic")
        return T.StructField(self.name, self.data_type, nullable, {k: v for k, v in kept.items() if v is not None})


class t:  # noqa: N801  a namespace of column builders
    """``t.int32()``, ``t.array(t.string())`` and so on; names come from the table or the argument."""


def _builder(name: str) -> Callable[..., ColumnSpec]:
    return staticmethod(lambda column="", name=name: ColumnSpec(name, column))


for _name in (*_PLAIN, *_GEO):
    _snake = re.sub(r"(?<=[a-z])(?=[A-Z])", "_", _name).lower()
    _snake = {"uint8": "uint8", "date_time": "datetime", "ipv4": "ipv4", "bfloat16": "bfloat16"}.get(_snake, _snake.replace("u_int", "uint").replace("b_float", "bfloat").replace("i_pv", "ipv"))
    setattr(t, _snake, _builder(_name))


def _type_of(x: ColumnSpec | str) -> str:
    inner = x.type if isinstance(x, ColumnSpec) else x
    return f"Nullable({inner})" if isinstance(x, ColumnSpec) and x.is_nullable and not inner.startswith("Nullable(") else inner


def _static(f: Callable[..., ColumnSpec]) -> Callable[..., ColumnSpec]:
    setattr(t, f.__name__, staticmethod(f))
    return f


@_static
def decimal(precision: int = 18, scale: int = 4, column: str = "") -> ColumnSpec:
    return ColumnSpec(f"Decimal({precision}, {scale})", column)


@_static
def decimal32(scale: int = 4, column: str = "") -> ColumnSpec:
    return ColumnSpec(f"Decimal32({scale})", column)


@_static
def decimal64(scale: int = 4, column: str = "") -> ColumnSpec:
    return ColumnSpec(f"Decimal64({scale})", column)


@_static
def decimal128(scale: int = 4, column: str = "") -> ColumnSpec:
    return ColumnSpec(f"Decimal128({scale})", column)


@_static
def fixed_string(length: int, column: str = "") -> ColumnSpec:
    return ColumnSpec(f"FixedString({length})", column)


@_static
def datetime64(precision: int = 3, timezone: str | None = None, column: str = "") -> ColumnSpec:
    return ColumnSpec(f"DateTime64({precision}, '{timezone}')" if timezone else f"DateTime64({precision})", column)


@_static
def timestamp(timezone: str | None = None, column: str = "") -> ColumnSpec:
    return ColumnSpec(f"DateTime('{timezone}')" if timezone else "DateTime", column)


@_static
def array(of: ColumnSpec | str, column: str = "") -> ColumnSpec:
    return ColumnSpec(f"Array({_type_of(of)})", column)


@_static
def tuple_(*of: ColumnSpec | str, column: str = "") -> ColumnSpec:
    return ColumnSpec(f"Tuple({', '.join(map(_type_of, of))})", column)


@_static
def map_(key: ColumnSpec | str = "String", value: ColumnSpec | str = "String", column: str = "") -> ColumnSpec:
    return ColumnSpec(f"Map({_type_of(key)}, {_type_of(value)})", column)


@_static
def nested(fields: dict[str, ColumnSpec | str], column: str = "") -> ColumnSpec:
    return ColumnSpec(f"Nested({', '.join(f'{k} {_type_of(v)}' for k, v in fields.items())})", column)


@_static
def low_cardinality(of: ColumnSpec | str, column: str = "") -> ColumnSpec:
    return ColumnSpec(f"LowCardinality({_type_of(of)})", column)


@_static
def aggregate_function(name: str, *of: ColumnSpec | str, column: str = "") -> ColumnSpec:
    return ColumnSpec(f"AggregateFunction({', '.join([name, *map(_type_of, of)])})", column)


@_static
def simple_aggregate_function(name: str, of: ColumnSpec | str, column: str = "") -> ColumnSpec:
    return ColumnSpec(f"SimpleAggregateFunction({name}, {_type_of(of)})", column)


def _enum(size: int, values: list[str] | tuple[str, ...], column: str) -> ColumnSpec:
    body = ", ".join(f"'{v}' = {i}" for i, v in enumerate(values))
    return ColumnSpec(f"Enum{size}({body})", column, values=tuple(values))


@_static
def enum8(values: list[str], column: str = "") -> ColumnSpec:
    return _enum(8, values, column)


@_static
def enum16(values: list[str], column: str = "") -> ColumnSpec:
    return _enum(16, values, column)


@_static
def enum(*values: str, column: str = "") -> ColumnSpec:
    """Text with allowed values; nullable."""
    return ColumnSpec("String", column, is_nullable=True, values=tuple(values))


@_static
def primary_uuid(column: str = "id", version: int = 4) -> ColumnSpec:
    return ColumnSpec("UUID", column).auto_generate(version).primary_key()


@_static
def primary_uuid_v7(column: str = "id") -> ColumnSpec:
    return primary_uuid(column, 7)


def timestamps() -> dict[str, ColumnSpec]:
    return {"created_at": created_at(), "updated_at": updated_at()}


def soft_deletes() -> dict[str, ColumnSpec]:
    return {"is_deleted": ColumnSpec("Bool", "is_deleted").default(False), "deleted_at": deleted_at()}


t.timestamps, t.soft_deletes, t.varchar, t.text, t.boolean, t.integer = staticmethod(timestamps), staticmethod(soft_deletes), t.string, t.string, t.bool, t.int32


# Presets.


def low_cardinality_string(name: str) -> ColumnSpec:
    return ColumnSpec("LowCardinality(String)", name)


def low_cardinality_nullable_string(name: str) -> ColumnSpec:
    return ColumnSpec("LowCardinality(Nullable(String))", name, is_nullable=True)


def nullable_json(name: str) -> ColumnSpec:
    return ColumnSpec("JSON", name, is_nullable=True)


def low_cardinality_json(name: str) -> ColumnSpec:
    return ColumnSpec("LowCardinality(JSON)", name)


def low_cardinality_nullable_json(name: str) -> ColumnSpec:
    return ColumnSpec("LowCardinality(Nullable(JSON))", name, is_nullable=True)


def nullable_enum8(name: str, values: list[str]) -> ColumnSpec:
    return enum8(values, name).nullable()


def nullable_enum16(name: str, values: list[str]) -> ColumnSpec:
    return enum16(values, name).nullable()


def low_cardinality_string_array(name: str) -> ColumnSpec:
    return ColumnSpec("Array(LowCardinality(String))", name)


def nullable_string_array(name: str) -> ColumnSpec:
    return ColumnSpec("Array(String)", name, is_nullable=True)


def string_nullable_array(name: str) -> ColumnSpec:
    return ColumnSpec("Array(Nullable(String))", name)


def low_cardinality_int32_array(name: str) -> ColumnSpec:
    return ColumnSpec("Array(LowCardinality(Int32))", name)


def email(name: str = "email") -> ColumnSpec:
    return ColumnSpec("String", name)


def nullable_email(name: str = "email") -> ColumnSpec:
    return email(name).nullable()


def phone(name: str = "phone") -> ColumnSpec:
    return ColumnSpec("String", name)


def nullable_phone(name: str = "phone") -> ColumnSpec:
    return phone(name).nullable()


# The countries of the preset.
COUNTRIES = ("US", "GB", "CA", "AU", "DE", "FR", "IT", "ES", "JP", "CN", "IN", "BR", "MX", "RU", "KR", "ZA")


def country_code(name: str = "country") -> ColumnSpec:
    return enum8(list(COUNTRIES), name)


def nullable_country_code(name: str = "country") -> ColumnSpec:
    return country_code(name).nullable()


def status(name: str, values: list[str]) -> ColumnSpec:
    return enum8(values, name)


def nullable_status(name: str, values: list[str]) -> ColumnSpec:
    return status(name, values).nullable()


# Common states.
COMMON_STATUSES = {s.upper(): s for s in ("active", "inactive", "pending", "approved", "rejected", "completed", "cancelled", "deleted", "draft", "published")}


def common_status(name: str = "status", values: list[str] | None = None) -> ColumnSpec:
    return status(name, values or list(COMMON_STATUSES.values()))


def nullable_common_status(name: str = "status", values: list[str] | None = None) -> ColumnSpec:
    return common_status(name, values).nullable()


def created_at(name: str = "created_at", timezone: str | None = None) -> ColumnSpec:
    return timestamp(timezone, name).default_sql("current_timestamp()")


def updated_at(name: str = "updated_at", timezone: str | None = None) -> ColumnSpec:
    return created_at(name, timezone)


def deleted_at(name: str = "deleted_at", timezone: str | None = None) -> ColumnSpec:
    return timestamp(timezone, name).nullable()


def uuid_primary_key(name: str = "id") -> ColumnSpec:
    return primary_uuid(name)


def low_cardinality_uuid_primary_key(name: str = "id") -> ColumnSpec:
    return ColumnSpec("LowCardinality(UUID)", name).auto_generate().primary_key()


def int32_primary_key(name: str = "id") -> ColumnSpec:
    return ColumnSpec("Int32", name).primary_key()


def int64_primary_key(name: str = "id") -> ColumnSpec:
    return ColumnSpec("Int64", name).primary_key()
