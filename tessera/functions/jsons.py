"""JSON held as text. A path is ``a.b[0]`` or ``$.a.b[0]``; a miss is null. Reading goes through VARIANT in the JVM."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._args import ColumnLike, col
from tessera.shipping import ship


def _path(path: str | None) -> str:
    if not path or path == "$":
        return "$"
    return path if path.startswith("$") else f"$.{path}" if not path.startswith("[") else f"${path}"


def _get(c: ColumnLike, path: str | None, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(col(c)), _path(path), kind)


def json_extract_string(c: ColumnLike, path: str) -> Column:
    return _get(c, path, "string")


def json_extract_int(c: ColumnLike, path: str) -> Column:
    return _get(c, path, "bigint")


def json_extract_float(c: ColumnLike, path: str) -> Column:
    return _get(c, path, "double")


def json_extract_bool(c: ColumnLike, path: str) -> Column:
    return _get(c, path, "boolean")


def json_extract(c: ColumnLike, path: str, kind: str) -> Column:
    """``kind`` is a Spark type, or one of the column types of this package."""
    from tessera.types import spark_type

    return _get(c, path, spark_type(kind).simpleString())


def json_extract_raw(c: ColumnLike, path: str) -> Column:
    """The JSON text at the path."""
    return F.to_json(_get(c, path, "variant"))


def json_has(c: ColumnLike, path: str) -> Column:
    """A JSON null counts as there."""
    return _get(c, path, "variant").isNotNull()


def json_extract_keys(c: ColumnLike, path: str | None = None) -> Column:
    return F.json_object_keys(_text(c, path))


def _text(c: ColumnLike, path: str | None) -> Column:
    return col(c) if path is None else F.get_json_object(col(c), _path(path))


def json_extract_values(c: ColumnLike, path: str | None = None) -> Column:
    """Values as text."""
    return F.map_values(F.from_json(_text(c, path), "map<string,string>"))


def json_extract_keys_and_values(c: ColumnLike, path: str | None = None) -> Column:
    return F.map_entries(F.from_json(_text(c, path), "map<string,string>"))


def json_length(c: ColumnLike, path: str | None = None) -> Column:
    """Elements of an array, keys of an object, else 0."""
    text = _text(c, path)
    return F.coalesce(F.json_array_length(text), F.size(F.json_object_keys(text)), F.lit(0))


def json_type(c: ColumnLike, path: str | None = None) -> Column:
    """null, bool, number, string, array or object; null for a miss or bad JSON."""
    v = _get(c, path, "variant")
    kind = F.schema_of_variant(v)
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|TINYINT|SMALLINT|INT)")
    named = F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "bool").when(number, "number").when(kind == "STRING", "string")
    return F.when(v.isNotNull(), named.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object"))


def _steps(path: str) -> list[str | int]:
    out: list[str | int] = []
    for part in _path(path)[1:].replace("[", ".[").split("."):
        if part:
            out.append(int(part[1:-1]) if part.startswith("[") else part)
    return out


def _edit(how: str, path: str):
    """Text to text: insert sets what is absent, replace what is there, remove takes it away. Bad JSON is null."""
    steps = _steps(path)
    given = lambda value: json.loads(value).get("v")

    def one(text: str | None, value: str | None = None) -> str | None:
        try:
            root = json.loads(text) if text is not None else None
        except ValueError:
            return None
        if text is None:
            return None
        if not steps:
            return text if how == "insert" else "null" if how == "remove" else json.dumps(given(value))
        at: Any = root
        for s in steps[:-1]:
            try:
                at = at[s]
            except (KeyError, IndexError, TypeError):
                if how == "insert" and isinstance(at, dict) and isinstance(s, str):
                    at = at.setdefault(s, {})
                else:
                    return json.dumps(root, separators=(",", ":"))
        last = steps[-1]
        there = last in at if isinstance(at, dict) else isinstance(at, list) and isinstance(last, int) and -len(at) <= last < len(at)
        if how == "remove" and there:
            del at[last]
        elif how == "replace" and there:
            at[last] = given(value)
        elif how == "insert" and not there:
            if isinstance(at, dict) and isinstance(last, str):
                at[last] = given(value)
            elif isinstance(at, list) and isinstance(last, int):
                at.append(given(value))
        return json.dumps(root, separators=(",", ":"), ensure_ascii=False)

    return one


def _edited(how: str, c: ColumnLike, path: str, value: Any = None) -> Column:
    one = _edit(how, path)
    if how == "remove":
        ship()

        @F.pandas_udf("string")
        def removed(texts: pd.Series) -> pd.Series:
            return texts.map(one, na_action=None)

        return removed(col(c))
    ship()

    @F.pandas_udf("string")
    def put(texts: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([one(t, v) for t, v in zip(texts, values, strict=True)], dtype=object)

    # Wrapped, so that text, numbers and nulls go the same way.
    text = F.to_json(F.struct(value.alias("v"))) if isinstance(value, Column) else F.lit(json.dumps({"v": value}))
    return put(col(c), text)


def json_insert(c: ColumnLike, path: str, value: Any) -> Column:
    """Sets the value where the path leads nowhere. An Arrow batch UDF, as are replace and remove."""
    return _edited("insert", c, path, value)


def json_replace(c: ColumnLike, path: str, value: Any) -> Column:
    return _edited("replace", c, path, value)


def json_remove(c: ColumnLike, path: str) -> Column:
    return _edited("remove", c, path)


def parse_json(c: ColumnLike) -> Column:
    """VARIANT; bad JSON is an error."""
    return F.parse_json(col(c))


def parse_json_best_effort(c: ColumnLike) -> Column:
    return F.try_parse_json(col(c))


def json_stringify(c: ColumnLike) -> Column:
    return F.to_json(col(c))


def json_array_extract(c: ColumnLike, path: str, kind: str) -> Column:
    from tessera.types import spark_type

    return _get(c, path, f"array<{spark_type(kind).simpleString()}>")


def json_array_length(c: ColumnLike, path: str) -> Column:
    return F.json_array_length(F.get_json_object(col(c), _path(path)))

