"""Window functions. A specification has partition and order columns and, beyond that, an optional frame."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions._args import ColumnLike, col


@dataclass(frozen=True)
class Spec:
    """``rows`` and ``range`` are frames (start, end); without one the default frame of SQL holds."""

    partition_by: tuple[ColumnLike, ...] = field(default=())
    order_by: tuple[ColumnLike, ...] = field(default=())
    rows: tuple[int, int] | None = None
    range: tuple[int, int] | None = None

    def build(self) -> WindowSpec:
        w = Window.partitionBy(*[col(c) for c in self.partition_by]).orderBy(*[col(c) for c in self.order_by])
        if self.rows is not None:
            w = w.rowsBetween(*self.rows)
        return w.rangeBetween(*self.range) if self.range is not None else w


def spec(partition_by: Any = (), order_by: Any = (), rows: tuple[int, int] | None = None, range_: tuple[int, int] | None = None) -> Spec:
    many = lambda x: tuple(x) if isinstance(x, (list, tuple)) else (x,)
    return Spec(many(partition_by), many(order_by), rows, range_)


def over(expr: Column, window: Spec | WindowSpec | None = None) -> Column:
    return expr.over(window if isinstance(window, WindowSpec) else (window or Spec()).build())


def row_number(window: Spec | None = None) -> Column:
    return over(F.row_number(), window)


def rank(window: Spec | None = None) -> Column:
    return over(F.rank(), window)


def dense_rank(window: Spec | None = None) -> Column:
    return over(F.dense_rank(), window)


def lag(c: ColumnLike, offset: int = 1, default: Any = None, window: Spec | None = None) -> Column:
    return over(F.lag(col(c), offset, default), window)


def lead(c: ColumnLike, offset: int = 1, default: Any = None, window: Spec | None = None) -> Column:
    return over(F.lead(col(c), offset, default), window)


def ntile(n: int, window: Spec | None = None) -> Column:
    return over(F.ntile(n), window)


def first_value(c: ColumnLike, window: Spec | None = None) -> Column:
    return over(F.first(col(c)), window)


def last_value(c: ColumnLike, window: Spec | None = None) -> Column:
    return over(F.last(col(c)), window)


#: The functions by name.
WINDOW_FUNCTIONS = {f.__name__: f for f in (over, row_number, rank, dense_rank, lag, lead)}
