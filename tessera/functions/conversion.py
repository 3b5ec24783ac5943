"""Type conversion, text encodings and number formats. A value that doesn't fit the type is null unless ``strict``."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._args import ColumnLike, col
from tessera.shipping import ship

_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _cast(c: ColumnLike, kind: str, strict: bool) -> Column:
    return col(c).cast(kind) if strict else col(c).try_cast(kind)


def to_string(c: ColumnLike) -> Column:
    return col(c).cast("string")


def to_int32(c: ColumnLike, strict: bool = False) -> Column:
    return _cast(c, "int", strict)


to_integer = to_int32


def to_int64(c: ColumnLike, strict: bool = False) -> Column:
    return _cast(c, "bigint", strict)


def to_uint32(c: ColumnLike, strict: bool = False) -> Column:
    x = _cast(c, "bigint", strict)
    return F.when((x >= 0) & (x <= 4294967295), x)


def to_uint64(c: ColumnLike, strict: bool = False) -> Column:
    x = _cast(c, "decimal(20,0)", strict)
    return F.when((x >= 0) & (x <= F.lit("18446744073709551615").cast("decimal(20,0)")), x)


def to_float32(c: ColumnLike, strict: bool = False) -> Column:
    return _cast(c, "float", strict)


def to_float64(c: ColumnLike, strict: bool = False) -> Column:
    return _cast(c, "double", strict)


def to_bool(c: ColumnLike, strict: bool = False) -> Column:
    return _cast(c, "boolean", strict)


to_boolean = to_bool


def to_uuid(c: ColumnLike) -> Column:
    """The UUID in lower case, null if it isn't one."""
    x = F.lower(col(c).cast("string"))
    return F.when(x.rlike(_UUID), x)


def to_date(c: ColumnLike, strict: bool = False) -> Column:
    return _cast(c, "date", strict)


def to_date_time(c: ColumnLike, strict: bool = False) -> Column:
    """To whole seconds."""
    return F.date_trunc("second", _cast(c, "timestamp", strict))


to_timestamp = to_date_time


def to_date_time64(c: ColumnLike, precision: int = 3, strict: bool = False) -> Column:
    """To ``precision`` digits of a second, at most 6."""
    if not 0 <= precision <= 6:
        raise ValueError("timestamps have up to 6 digits of a second")
    step = 10 ** (6 - precision)
    micros = F.unix_micros(_cast(c, "timestamp", strict))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(step)))


def to_lowercase(c: ColumnLike) -> Column:
    return F.lower(col(c))


def to_uppercase(c: ColumnLike) -> Column:
    return F.upper(col(c))


def to_title_case(c: ColumnLike) -> Column:
    return F.initcap(col(c))


def convert_trim(c: ColumnLike) -> Column:
    return F.trim(col(c))


def convert_trim_left(c: ColumnLike) -> Column:
    return F.ltrim(col(c))


def convert_trim_right(c: ColumnLike) -> Column:
    return F.rtrim(col(c))


def left_pad(c: ColumnLike, length: int, fill: str = " ") -> Column:
    return F.lpad(col(c).cast("string"), length, fill)


def right_pad(c: ColumnLike, length: int, fill: str = " ") -> Column:
    return F.rpad(col(c).cast("string"), length, fill)


def to_hex(c: ColumnLike) -> Column:
    return F.hex(col(c))


def from_hex(c: ColumnLike) -> Column:
    return F.unhex(col(c)).cast("string")


def to_base64(c: ColumnLike) -> Column:
    return F.base64(col(c).cast("binary"))


def from_base64(c: ColumnLike) -> Column:
    return F.unbase64(col(c)).cast("string")


def to_bin(c: ColumnLike) -> Column:
    """Binary digits: of whole numbers without leading zeros, of text eight a byte."""
    x = col(c)
    digits = lambda h: F.lpad(F.conv(h, 16, 2), 4, "0")
    of_text = F.array_join(F.transform(F.split(F.hex(x.cast("string")), ""), digits), "")
    return F.when(x.try_cast("bigint").isNotNull(), F.bin(x.try_cast("bigint"))).otherwise(of_text)


def from_bin(c: ColumnLike) -> Column:
    """The whole number of binary digits."""
    return F.conv(col(c), 2, 10).try_cast("bigint")


def url_encode(c: ColumnLike) -> Column:
    """Per RFC 3986: a space is %20."""
    return F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20"))


def url_decode(c: ColumnLike) -> Column:
    return F.try_url_decode(col(c))


# The five entities of XML, & first.
_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def html_escape(c: ColumnLike) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), _ENTITIES, col(c))


def html_unescape(c: ColumnLike, every_entity: bool = False) -> Column:
    """The five entities in the JVM, or all of HTML's in an Arrow batch UDF."""
    if every_entity:
        import html
        ship()

        @F.pandas_udf("string")
        def plain(values: pd.Series) -> pd.Series:
            return values.map(lambda s: None if s is None else html.unescape(s))

        return plain(col(c))
    named = [*reversed(_ENTITIES), ("'", "&apos;")]
    named.sort(key=lambda e: e[0] == "&")  # & last, lest an escaped entity be read twice
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), named, col(c))


def format_decimal(c: ColumnLike, precision: int) -> Column:
    x = col(c).cast("double")
    return F.when(x.isNotNull(), F.format_string(f"%.{precision}f", x))


def _scaled(c: ColumnLike, base: float, units: tuple[str, ...], precision: int, gap: str) -> Column:
    x = col(c).cast("double")
    shown = lambda k: F.concat(F.format_string(f"%.{precision}f", x / F.lit(float(base**k))), F.lit(gap + units[k] if units[k] else ""))
    out = None
    for k in range(len(units) - 1, 0, -1):
        test = F.abs(x) >= F.lit(float(base**k))
        out = F.when(test, shown(k)) if out is None else out.when(test, shown(k))
    return out.otherwise(shown(0))


def format_readable_decimal(c: ColumnLike, precision: int, largest: str = "T") -> Column:
    """With a suffix for thousands, millions, billions or trillions, none above ``largest``."""
    units = ("", "K", "M", "B", "T")
    return _scaled(c, 1000, units[: units.index(largest) + 1], precision, "")


def format_number(c: ColumnLike, digits: int) -> Column:
    """With separators of thousands."""
    return F.format_number(col(c), digits)


def format_bytes(c: ColumnLike, precision: int = 2) -> Column:
    return _scaled(c, 1024, ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"), precision, " ")


def format_percentage(c: ColumnLike, precision: int = 2) -> Column:
    return F.format_string(f"%.{precision}f%%", col(c).cast("double") * 100)
