"""Calendar rules in whole days. Two age definitions live side by side on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def birth_date(year: Column, month: Column, day: Column) -> Column:
    """The date of the three parts; NULL where a part is missing or the date does not exist."""
    known = year.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.when(known, F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month, day).try_cast("date"))


def duration_years(start: Column, end: Column) -> Column:
    """Elapsed time in years of 365.25 days, with its fraction."""
    return F.datediff(end, start) / F.lit(365.25)


def anniversary_years(start: Column, end: Column) -> Column:
    """Number of birthdays reached."""
    def month_day(date: Column) -> Column:
        return F.month(date) * 100 + F.dayofmonth(date)
    return F.year(end) - F.year(start) - (month_day(end) < month_day(start)).cast("int")


def exposure_end(start: Column, days_supply: Column) -> Column:
    """Last day covered by a supply that begins on ``start``."""
    return F.date_add(start, days_supply - 1)


def within_days(date: Column, anchor: Column, first: int, last: int) -> Column:
    """Whether the date lies ``first``..``last`` days after the anchor, both ends included."""
    return date.between(F.date_add(anchor, first), F.date_add(anchor, last))


def in_lookback(date: Column, index: Column, days: int) -> Column:
    """Whether the date lies in the ``days`` days that end on the day before ``index``."""
    return within_days(date, index, -days, -1)
