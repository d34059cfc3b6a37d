"""Ratios, weighted means and null-tolerant aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded_ratio(num: Column, den: Column) -> Column:
    """num / den as double where den > 0, else null."""
    return F.when(den > 0, num.cast("double") / den.cast("double"))


def safe_div(num: Column, den: Column) -> Column:
    """num / den as double; null where den is null or zero, negative den divides."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def total(x: Column) -> Column:
    """Sum skipping nulls; 0 when nothing is left."""
    return F.coalesce(F.sum(x), F.lit(0))


def weighted_mean(x: Column, weight: Column) -> Column:
    """Weighted mean; a row with null x leaves numerator and denominator alike."""
    return safe_div(F.sum(x * weight), F.sum(F.when(x.isNotNull(), weight)))


def correlation(x: Column, y: Column, min_rows: int) -> Column:
    """Pearson correlation over pairs; null below min_rows or for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    flat = (F.max(px) == F.min(px)) | (F.max(py) == F.min(py))
    r = F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))
    return F.when((F.count(F.lit(1)) >= min_rows) & ~flat, r)


def distinct_with_null(x: Column) -> Column:
    """Distinct values, null counted as one value of its own."""
    return F.count_distinct(x) + F.max(x.isNull().cast("int"))


def missing(x: Column) -> Column:
    return F.count_if(x.isNull())
