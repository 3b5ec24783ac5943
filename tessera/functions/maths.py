"""Arithmetic."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._args import ColumnLike, col


def abs_(c: ColumnLike) -> Column:
    return F.abs(col(c))


def round_(c: ColumnLike, precision: int = 0, bankers: bool = False) -> Column:
    """Halves go away from zero, or to the even neighbour."""
    return F.bround(col(c), precision) if bankers else F.round(col(c), precision)


def floor(c: ColumnLike) -> Column:
    return F.floor(col(c))


def ceil(c: ColumnLike) -> Column:
    return F.ceil(col(c))


def sqrt(c: ColumnLike) -> Column:
    return F.sqrt(col(c))


def power(c: ColumnLike, exponent: Any) -> Column:
    return F.pow(col(c), col(exponent))


def plus(a: Any, b: Any) -> Column:
    return col(a) + col(b)


def minus(a: Any, b: Any) -> Column:
    return col(a) - col(b)


def mult(a: Any, b: Any) -> Column:
    return col(a) * col(b)


def div(a: Any, b: Any) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(col(a), col(b))
