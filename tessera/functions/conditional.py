"""Conditions and nulls."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._args import ColumnLike, col, val


def if_null(c: ColumnLike, other: Any) -> Column:
    return F.coalesce(col(c), val(other))


def sql_if(condition: Column, yes: Any, no: Any) -> Column:
    return F.when(condition, val(yes)).otherwise(val(no))


def multi_if(*args: Any) -> Column:
    """condition, value, condition, value, ..., otherwise."""
    if len(args) < 3 or len(args) % 2 == 0:
        raise ValueError("pairs of condition and value, then the value otherwise")
    case = CaseBuilder()
    for condition, value in zip(args[:-1:2], args[1::2], strict=True):
        case = case.when(condition, value)
    return case.otherwise(args[-1])


class CaseBuilder:
    """CASE WHEN ... THEN ... ELSE ... END; immutable."""

    def __init__(self, pairs: tuple[tuple[Column, Any], ...] = ()) -> None:
        self._pairs = pairs

    def when(self, condition: Column, value: Any) -> CaseBuilder:
        return CaseBuilder((*self._pairs, (condition, value)))

    def end(self) -> Column:
        """Null where no condition holds."""
        if not self._pairs:
            raise ValueError("a case needs a condition")
        (first, value), *rest = self._pairs
        return reduce(lambda c, p: c.when(p[0], val(p[1])), rest, F.when(first, val(value)))

    def otherwise(self, value: Any) -> Column:
        return self.end().otherwise(val(value))


def case_when() -> CaseBuilder:
    return CaseBuilder()


def coalesce(*args: Any) -> Column:
    return F.coalesce(*[col(a) for a in args])


def greatest(*args: Any) -> Column:
    """Nulls are skipped."""
    return F.greatest(*[col(a) for a in args]) if len(args) > 1 else col(args[0])


def least(*args: Any) -> Column:
    return F.least(*[col(a) for a in args]) if len(args) > 1 else col(args[0])


def is_null(c: ColumnLike) -> Column:
    return col(c).isNull()


def is_not_null(c: ColumnLike) -> Column:
    return col(c).isNotNull()


def null_if(condition: Column, c: ColumnLike) -> Column:
    """Null where the condition holds, else the column."""
    return F.when(~F.coalesce(condition, F.lit(False)), col(c))


def null_if_equal(c: ColumnLike, value: Any) -> Column:
    return F.nullif(col(c), val(value))


def not_(expr: Column) -> Column:
    return ~expr


def and_(*exprs: Column | None) -> Column | None:
    """Missing operands are dropped; None if none is left."""
    left = [e for e in exprs if e is not None]
    return reduce(lambda a, b: a & b, left) if left else None


def or_(*exprs: Column | None) -> Column | None:
    left = [e for e in exprs if e is not None]
    return reduce(lambda a, b: a | b, left) if left else None


def xor(a: Column, b: Column) -> Column:
    return a != b
