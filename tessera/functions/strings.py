"""String functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._args import ColumnLike, col, val


def length(c: ColumnLike) -> Column:
    """Bytes."""
    return F.octet_length(col(c))


def length_utf8(c: ColumnLike) -> Column:
    """Code points."""
    return F.char_length(col(c))


def lower(c: ColumnLike) -> Column:
    return F.lower(col(c))


def upper(c: ColumnLike) -> Column:
    return F.upper(col(c))


def reverse(c: ColumnLike) -> Column:
    return F.reverse(col(c))


def repeat(c: ColumnLike, n: int) -> Column:
    return F.repeat(col(c), n)


def substring(c: ColumnLike, offset: int, length: int | None = None) -> Column:
    """From the offset (1 is the first character, negative from the end); a length of 0 is empty."""
    return F.substr(col(c), F.lit(offset)) if length is None else F.substr(col(c), F.lit(offset), F.lit(length))


def left(c: ColumnLike, length: int) -> Column:
    return F.left(col(c), F.lit(length))


def right(c: ColumnLike, length: int) -> Column:
    return F.right(col(c), F.lit(length))


def string_trim(c: ColumnLike) -> Column:
    return F.trim(col(c))


def string_trim_left(c: ColumnLike) -> Column:
    return F.ltrim(col(c))


def string_trim_right(c: ColumnLike) -> Column:
    return F.rtrim(col(c))


def contains(c: ColumnLike, text: str) -> Column:
    return col(c).contains(val(text))


def starts_with(c: ColumnLike, text: str) -> Column:
    return col(c).startswith(val(text))


def ends_with(c: ColumnLike, text: str) -> Column:
    return col(c).endswith(val(text))


def position(c: ColumnLike, text: str) -> Column:
    """1-based place of the first occurrence, 0 if there is none."""
    return F.position(val(text), col(c))


def count_matches(c: ColumnLike, text: str) -> Column:
    """Occurrences of a literal text that don't overlap."""
    return F.regexp_count(col(c), F.lit(literal(text)))


def concat(*columns: ColumnLike) -> Column:
    """Null if any part is."""
    return F.concat(*[col(c) for c in columns])


def replace(c: ColumnLike, text: str, by: str) -> Column:
    """All occurrences of a literal text."""
    return F.replace(col(c), val(text), val(by))


def replace_regexp_all(c: ColumnLike, pattern: str, by: str) -> Column:
    r"""All matches; groups are ``\1`` in the replacement."""
    return F.regexp_replace(col(c), pattern, re.sub(r"\\(\d)", r"$\1", by.replace("$", r"\$")))


def match(c: ColumnLike, pattern: str) -> Column:
    """Whether the pattern matches somewhere."""
    return col(c).rlike(pattern)


def like(c: ColumnLike, pattern: str) -> Column:
    return col(c).like(pattern)


def not_like(c: ColumnLike, pattern: str) -> Column:
    return ~col(c).like(pattern)


def ilike(c: ColumnLike, pattern: str) -> Column:
    return col(c).ilike(pattern)


def not_ilike(c: ColumnLike, pattern: str) -> Column:
    return ~col(c).ilike(pattern)


def split_by_char(c: ColumnLike, delimiter: str) -> Column:
    return F.split(col(c), literal(delimiter), -1)


def split_by_whitespace(c: ColumnLike) -> Column:
    return F.filter(F.split(col(c), r"\s+", -1), lambda x: x != "")


def literal(text: str) -> str:
    r"""A Java pattern that matches the text itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
