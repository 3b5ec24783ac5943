"""Array functions. Places are 1-based, negative from the end."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._args import ColumnLike, col, val
from tessera.functions.predicates import has as array_has
from tessera.functions.predicates import has_all as array_has_all
from tessera.functions.predicates import has_any as array_has_any

__all__ = ["array_has", "array_has_all", "array_has_any"]


def array_join(separator: str, c: ColumnLike) -> Column:
    """The elements as text with the separator between them."""
    return F.array_join(col(c), separator)


def unnest(c: ColumnLike) -> Column:
    """One row for each element; none for an empty array."""
    return F.explode(col(c))


def _lambda(f: Callable | str, c: Column, name: str) -> Column:
    """A Python function of columns, or SQL such as ``x -> x + 1``."""
    if isinstance(f, str):
        return F.expr(f"{name}({c._jc.node().sql()}, {f})")
    return (F.transform if name == "transform" else F.filter)(c, f)


def array_map(f: Callable | str, c: ColumnLike) -> Column:
    return _lambda(f, col(c), "transform")


def array_filter(f: Callable | str, c: ColumnLike) -> Column:
    return _lambda(f, col(c), "filter")


def array_length(c: ColumnLike) -> Column:
    return F.size(col(c))


def array_sum(c: ColumnLike) -> Column:
    """Nulls are skipped; 0 for an empty array."""
    return F.aggregate(F.array_compact(col(c)), F.lit(0.0), lambda a, x: a + x.cast("double"))


def array_avg(c: ColumnLike) -> Column:
    return F.try_divide(array_sum(c), F.size(F.array_compact(col(c))))


def array_min(c: ColumnLike) -> Column:
    return F.array_min(col(c))


def array_max(c: ColumnLike) -> Column:
    return F.array_max(col(c))


def array_count(c: ColumnLike) -> Column:
    return F.size(F.array_compact(col(c)))


def array_uniq(c: ColumnLike) -> Column:
    return F.size(array_distinct(c))


_REDUCERS: dict[str, Callable[[ColumnLike], Column]] = {"sum": array_sum, "avg": array_avg, "min": array_min, "max": array_max, "count": array_count, "uniq": array_uniq, "uniqExact": array_uniq}


def array_reduce(name: str, c: ColumnLike) -> Column:
    """An aggregate over the elements: sum, avg, min, max, count or uniq."""
    if name not in _REDUCERS:
        raise ValueError(f"unknown aggregate {name}")
    return _REDUCERS[name](c)


def array_concat(*arrays: ColumnLike) -> Column:
    return F.concat(*[col(a) for a in arrays])


def array_element(c: ColumnLike, index: int | Column) -> Column:
    """Null beyond the array's ends."""
    return F.try_element_at(col(c), val(index))


def array_first(c: ColumnLike) -> Column:
    return array_element(c, 1)


def array_last(c: ColumnLike) -> Column:
    return array_element(c, -1)


def array_sort(c: ColumnLike, ascending: bool = True) -> Column:
    """Nulls last in both directions."""
    return F.array_sort(col(c)) if ascending else F.sort_array(col(c), asc=False)


def array_reverse(c: ColumnLike) -> Column:
    return F.reverse(col(c))


def array_distinct(c: ColumnLike) -> Column:
    """Without nulls."""
    return F.array_distinct(F.array_compact(col(c)))


def array_count_matches(c: ColumnLike, element: Any) -> Column:
    return F.size(F.filter(col(c), lambda x: x == val(element)))


def empty(c: ColumnLike, of: str = "array") -> Column:
    """Whether an array, or a string, is empty."""
    return (F.size(col(c)) if of == "array" else F.length(col(c))) == 0


def not_empty(c: ColumnLike, of: str = "array") -> Column:
    return ~empty(c, of)


def map_keys(c: ColumnLike) -> Column:
    return F.map_keys(col(c))


def map_values(c: ColumnLike) -> Column:
    return F.map_values(col(c))
