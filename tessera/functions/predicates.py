"""Comparison, membership, sort keys and raw SQL expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions._args import ColumnLike, col, val


def eq(c: ColumnLike, v: Any) -> Column:
    return col(c) == val(v)


def eq_null_safe(c: ColumnLike, v: Any) -> Column:
    return col(c).eqNullSafe(val(v))


def ne(c: ColumnLike, v: Any) -> Column:
    return col(c) != val(v)


def gt(c: ColumnLike, v: Any) -> Column:
    return col(c) > val(v)


def gte(c: ColumnLike, v: Any) -> Column:
    return col(c) >= val(v)


def lt(c: ColumnLike, v: Any) -> Column:
    return col(c) < val(v)


def lte(c: ColumnLike, v: Any) -> Column:
    return col(c) <= val(v)


def in_array(c: ColumnLike, values: Iterable[Any] | DataFrame) -> Column:
    """Membership; false for an empty list. A one-column DataFrame makes an IN subquery."""
    if isinstance(values, DataFrame):
        return col(c).isin(values)
    values = list(values)
    return col(c).isin(*[val(v) for v in values]) if values else F.lit(False)


def not_in_array(c: ColumnLike, values: Iterable[Any] | DataFrame) -> Column:
    """Negated membership; true for an empty list. As in SQL, a null among the values makes it null."""
    return F.lit(True) if not isinstance(values, DataFrame) and not (values := list(values)) else ~in_array(c, values)


def between(c: ColumnLike, low: Any, high: Any) -> Column:
    return col(c).between(val(low), val(high))


def not_between(c: ColumnLike, low: Any, high: Any) -> Column:
    return ~between(c, low, high)


def has(c: ColumnLike, v: Any) -> Column:
    """Whether the array holds the value; false, not null, if it is absent beside nulls."""
    return F.coalesce(F.array_contains(col(c), val(v)), F.lit(False))


def has_all(c: ColumnLike, values: Iterable[Any] | ColumnLike) -> Column:
    wanted = col(values) if isinstance(values, (Column, str)) else val(list(values))
    return F.size(F.array_except(wanted, col(c))) == 0


def has_any(c: ColumnLike, values: Iterable[Any] | ColumnLike) -> Column:
    wanted = col(values) if isinstance(values, (Column, str)) else val(list(values))
    return F.coalesce(F.arrays_overlap(col(c), wanted), F.lit(False))


def asc(c: ColumnLike) -> Column:
    """Ascending, nulls last."""
    return col(c).asc_nulls_last()


def desc(c: ColumnLike) -> Column:
    """Descending, nulls last."""
    return col(c).desc_nulls_last()


def fn(name: str, *args: Any) -> Column:
    """Any built-in or registered function by name; strings are column names, other values literals."""
    return F.call_function(name, *[col(a) for a in args])


def raw(text: str) -> Column:
    """SQL text as it stands."""
    return F.expr(text)


_MARK = re.compile(r"\{\}")


def sql(template: str, *args: Any) -> Column:
    """A SQL expression with ``{}`` for each argument: a Column goes in as its own expression, anything else as a quoted
    literal, so that no value is ever read as SQL."""
    parts = _MARK.split(template)
    if len(parts) != len(args) + 1:
        raise ValueError(f"the template has {len(parts) - 1} places for {len(args)} arguments")
    return F.expr(parts[0] + "".join(_text(a) + p for a, p in zip(args, parts[1:], strict=True)))


typed_sql = sql


def join(exprs: Iterable[Column], operator: str = "and") -> Column:
    """Columns joined by a binary operator: and, or, +, -, *, /, ||."""
    made = list(exprs)
    if not made:
        raise ValueError("nothing to join")
    both = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "||": F.concat}
    return reduce(both[operator.lower()], made)


def _text(x: Any) -> str:
    return f"({(x if isinstance(x, Column) else F.lit(x))._jc.node().sql()})"
