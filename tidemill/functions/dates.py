"""Date and timestamp expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def day_text(col: Column | str) -> Column:
    return F.date_format(_c(col), "yyyy-MM-dd")


def second_text(col: Column | str) -> Column:
    return F.date_format(_c(col), "yyyy-MM-dd HH:mm:ss")


def parse_either(col: Column | str, *formats: str) -> Column:
    """First format that fits; null when none does."""
    return F.coalesce(*[F.try_to_timestamp(_c(col), F.lit(f)) for f in formats])


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """Whole minutes from start to end, across days and years."""
    return F.floor((F.unix_timestamp(_c(end)) - F.unix_timestamp(_c(start))) / 60)


def julian_day(col: Column | str) -> Column:
    """Year and day of year as ``yyyyDDD``."""
    return F.date_format(_c(col), "yyyyDDD")


def next_julian_day(value: Column | str) -> Column:
    """The ``yyyyDDD`` value of the following day."""
    text = _c(value)
    first = F.make_date(F.substring(text, 1, 4).cast("int"), F.lit(1), F.lit(1))
    return F.date_format(F.date_add(first, F.substring(text, 5, 3).cast("int")), "yyyyDDD")


def is_leap_year(year: Column | str) -> Column:
    y = _c(year)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def month_millis(col: Column | str) -> Column:
    """Length of the value's month in milliseconds."""
    return F.dayofmonth(F.last_day(_c(col))).cast("bigint") * 86_400_000


def year_millis(col: Column | str) -> Column:
    """Length of the value's year in milliseconds."""
    return F.when(is_leap_year(F.year(_c(col))), 366).otherwise(365).cast("bigint") * 86_400_000


def expires_at(col: Column | str, expiry: str) -> Column:
    """Time plus an interval text such as ``2 months``."""
    return _c(col) + F.expr(f"interval {expiry}")
