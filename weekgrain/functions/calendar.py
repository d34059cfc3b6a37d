"""Week calendar: YYYYWW keys and Sunday-first week numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_key(year: Column, week: Column) -> Column:
    return (year * 100 + week).cast("int")


def fiscal_quarter(week: Column) -> Column:
    """13 weeks to a quarter; week 53 falls in quarter 5."""
    return F.ceil(week / F.lit(13)).cast("int")


def week_start(year: Column, week: Column) -> Column:
    """Monday of the week. Week 1 is the one holding the year's first Sunday."""
    new_year = F.make_date(year, F.lit(1), F.lit(1))
    first_sunday = F.next_day(F.date_sub(new_year, 1), "SUN")
    return F.date_add(first_sunday, ((week - 1) * 7 + 1).cast("int"))


def week_end(start: Column) -> Column:
    return F.date_add(start, 6)
