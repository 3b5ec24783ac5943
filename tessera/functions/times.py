"""Dates and times. Weeks start on Sunday where SQL dialects differ, unless a function says otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._args import ColumnLike, col, val


def time_now() -> Column:
    return F.current_timestamp()


def time_today() -> Column:
    return F.current_date()


def time_yesterday() -> Column:
    return F.date_sub(F.current_date(), 1)


def time_to_date(c: ColumnLike) -> Column:
    return F.to_date(col(c))


def time_to_date_time(c: ColumnLike) -> Column:
    return F.date_trunc("second", col(c).cast("timestamp"))


def to_unix_timestamp(c: ColumnLike) -> Column:
    return F.unix_timestamp(col(c).cast("timestamp"))


# Format letters and the Java patterns with the same meaning.
_FORMATS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "h": "hh", "i": "mm", "M": "mm", "S": "ss", "s": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss", "F": "yyyy-MM-dd", "D": "MM/dd/yy", "R": "HH:mm", "Q": "q", "z": "xx", "n": "\n", "t": "\t"}


def time_format_date_time(c: ColumnLike, pattern: str) -> Column:
    """A format with %Y, %m, %d, %H, %i (or %M) for minutes, %S and so on; %% is a percent sign."""

    def one(m: re.Match) -> str:
        if m[1] is not None:
            if m[1] == "%":
                return "%"
            if m[1] not in _FORMATS:
                raise ValueError(f"unknown format %{m[1]}")
            return _FORMATS[m[1]]
        return "'" + m[0].replace("'", "''") + "'" if re.search(r"[A-Za-z']", m[0]) else m[0]

    return F.date_format(col(c), re.sub(r"%(.)|[^%]+", one, pattern))


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def _trunc(unit: str, c: ColumnLike) -> Column:
    return _ntz(F.date_trunc(unit, col(c)))


def time_to_start_of_hour(c: ColumnLike) -> Column:
    return _trunc("hour", c)


def time_to_start_of_day(c: ColumnLike) -> Column:
    return _trunc("day", c)


def time_to_start_of_week(c: ColumnLike) -> Column:
    """The Sunday on or before, a date."""
    return F.date_sub(F.to_date(col(c)), F.dayofweek(col(c)) - 1)


def time_to_start_of_month(c: ColumnLike) -> Column:
    return F.trunc(col(c), "month")


def to_start_of_quarter(c: ColumnLike) -> Column:
    return F.trunc(col(c), "quarter")


def to_start_of_year(c: ColumnLike) -> Column:
    return F.trunc(col(c), "year")


_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}
#: The first Monday of the Unix calendar, from which weeks are counted.
_MONDAY = 4 * 86400


def to_start_of_interval(c: ColumnLike, n: int, unit: str, timezone: str | None = None) -> Column:
    """The start of the interval of n units around the time; null for null. Weeks start on Monday, months are counted from
    the year 0, and with a time zone intervals follow its clock."""
    unit = unit.lower().rstrip("s")
    x = col(c).cast("timestamp")
    if timezone:
        x = F.from_utc_timestamp(x, timezone)
    if unit in _SECONDS:
        step, shift = n * _SECONDS[unit], _MONDAY if unit == "week" else 0
        at = F.unix_seconds(x) - shift
        out = F.timestamp_seconds(at - F.pmod(at, F.lit(step)) + shift)
    elif unit in _MONTHS:
        months = F.year(x) * 12 + F.month(x) - 1
        start = months - F.pmod(months, F.lit(n * _MONTHS[unit]))
        out = F.make_date(F.floor(start / 12).cast("int"), (F.pmod(start, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp")
    else:
        raise ValueError(f"unknown unit {unit}")
    return _ntz(F.to_utc_timestamp(out, timezone) if timezone else out)


def date_diff(unit: str, start: ColumnLike, end: ColumnLike) -> Column:
    """Boundaries of the unit between the two; weeks start on Monday."""
    unit = unit.lower().rstrip("s")
    a, b = F.date_trunc(unit, col(start)), F.date_trunc(unit, col(end))
    if unit == "week":
        return F.floor(F.timestamp_diff("day", a, b) / 7).cast("bigint")
    return F.timestamp_diff(unit, a, b)


def date_add(unit: str, amount: int | Column, c: ColumnLike) -> Column:
    """The last day of a month stands for days that the target month lacks."""
    return F.timestamp_add(unit.lower().rstrip("s"), val(amount), col(c))


def date_sub(unit: str, amount: int | Column, c: ColumnLike) -> Column:
    return F.timestamp_add(unit.lower().rstrip("s"), -val(amount), col(c))


def to_timezone(c: ColumnLike, timezone: str) -> Column:
    """The zone's clock at that instant."""
    return _ntz(F.from_utc_timestamp(col(c).cast("timestamp"), timezone))


def time_offset(c: ColumnLike, timezone: str = "UTC") -> Column:
    """Seconds that the zone's clock is ahead of UTC at that instant."""
    x = col(c).cast("timestamp")
    return F.unix_timestamp(F.from_utc_timestamp(x, timezone)) - F.unix_timestamp(x)


def to_year(c: ColumnLike) -> Column:
    return F.year(col(c))


def to_quarter(c: ColumnLike) -> Column:
    return F.quarter(col(c))


def to_month(c: ColumnLike) -> Column:
    return F.month(col(c))


def to_day_of_month(c: ColumnLike) -> Column:
    return F.dayofmonth(col(c))


def to_day_of_week(c: ColumnLike) -> Column:
    """1 is Monday, 7 Sunday."""
    return F.weekday(col(c)) + 1


def to_hour(c: ColumnLike) -> Column:
    return F.hour(col(c))


def to_minute(c: ColumnLike) -> Column:
    return F.minute(col(c))


def to_second(c: ColumnLike) -> Column:
    return F.second(col(c))


def to_iso_week(c: ColumnLike) -> Column:
    return F.weekofyear(col(c))


def to_week(c: ColumnLike) -> Column:
    """0 to 53; week 1 begins on the year's first Sunday."""
    return F.floor((F.dayofyear(col(c)) + 6 - (F.dayofweek(col(c)) - 1)) / 7).cast("int")


def apply_ttl(df, time: ColumnLike, keep: str, now: Column | None = None):
    """Rows whose time plus the interval (such as ``30 days``) is yet to come; rows without a time stay."""
    until = col(time).cast("timestamp") + F.expr(f"INTERVAL {keep}")
    return df.where(F.coalesce(until > (now if now is not None else F.current_timestamp()), F.lit(True)))
