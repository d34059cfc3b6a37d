"""Trailing and week-over-week measures."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def ordered(order: str, by: list[str] | None = None):
    """Window ordered by a week key, one series per `by` group."""
    return Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)


def trailing_mean(x: Column, series, rows: int = 4) -> Column:
    """Mean over the last `rows` rows; null until all of them are there and non-null."""
    w = series.rowsBetween(1 - rows, 0)
    return F.when(F.count(x).over(w) == rows, F.avg(x).over(w))


def change(x: Column, series) -> Column:
    return x - F.lag(x).over(series)


def relative_change(x: Column, series) -> Column:
    return F.try_divide(x, F.lag(x).over(series)) - 1
