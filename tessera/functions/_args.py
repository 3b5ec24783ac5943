"""How the functions of this package take their arguments."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(x: Any) -> Column:
    """A column argument: a Column, a column's name, or anything with a ``name`` (a column specification)."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    if hasattr(x, "column"):
        return x.column()
    return F.lit(x)


def val(x: Any) -> Column:
    """A value argument: a Column stays, everything else is a literal."""
    if isinstance(x, Column):
        return x
    if hasattr(x, "column"):
        return x.column()
    if isinstance(x, (list, tuple)):
        return F.array(*[val(v) for v in x])
    return F.lit(x)
