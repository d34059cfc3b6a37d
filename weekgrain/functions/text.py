"""Text made from numbers and labels."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def paste(*parts: Column, sep: str = " | ") -> Column:
    """Join labels; a null label shows as NA instead of vanishing."""
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def dollars(x: Column, cents: Column | None = None) -> Column:
    """Dollars with thousands separators, sign before the currency mark; whole dollars unless
    cents is true."""
    def spelled(places: int) -> Column:
        sign = F.when(F.round(x, places) < 0, "-").otherwise("")
        return F.concat(sign, F.lit("$"), F.format_number(F.abs(F.round(x, places)), places))

    return spelled(0) if cents is None else F.when(cents, spelled(2)).otherwise(spelled(0))


def needs_cents(x: Column, over: Window) -> Column:
    """Whether money is shown with cents: no value of the whole column is as large as 100,000,
    and some value is not whole."""
    largest = F.max(F.abs(x)).over(over)
    return F.coalesce((largest < 100_000) & F.max(x != F.floor(x)).over(over), F.lit(False))


def commas(x: Column) -> Column:
    return F.format_number(F.round(x, 0), 0)


def percents(x: Column, digits: int = 1) -> Column:
    return F.concat(F.round(x * 100, digits).cast(f"decimal(38,{digits})").cast("string"), F.lit("%"))


def normal_id(x: Column) -> Column:
    return F.upper(F.trim(x))


def metric_text(metric: Column, value: Column, cents: Column | None = None) -> Column:
    """Money by name first, then percent, else plain text; the first match wins,
    so a trade spend share whose name holds 'Revenue' prints as money."""
    return (
        F.when(metric.rlike("Revenue|Spend"), dollars(value, cents))
        .when(metric.rlike("%|Realization"), percents(value))
        .otherwise(value.cast("string"))
    )


def caseless(text: Column) -> Column:
    """The text under a collation that ignores case: joins, groups and orders by it treat names
    that differ by case as one, as the source server does. Compared in the JVM as it is."""
    return F.collate(text, "UTF8_LCASE")
