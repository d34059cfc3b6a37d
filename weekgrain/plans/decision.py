"""The decision pack: correlation, trade effectiveness, leakage, trends, summary.

Two reports exist in two readings. `as_run` reproduces the defined results, where prices are
summed over KPI rows because the unit total replaces the row's units before the weights are
applied. `intended` weights every row by its own units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekgrain.functions.ratios import correlation, safe_div, total
from weekgrain.functions.text import metric_text, needs_cents, paste
from weekgrain.functions.windows import ordered, trailing_mean

SEGMENT = ["operating_country", "channel_name", "product_family", "brand_tier"]
LEAKAGE_SEGMENT = [*SEGMENT, "wholesaler_tier"]


def exact(x: Column) -> Column:
    """A double at a fixed scale, so that a sum of many doesn't depend on their order."""
    return x.cast("decimal(38,12)")


def summed(name: str) -> Column:
    return F.sum(exact(F.col(name))).cast("double")


def mean_by_units(name: str) -> Column:
    units = F.col("shipments_units").cast("double")
    return safe_div(F.sum(exact(F.col(name) * units)), F.sum("shipments_units"))


def price_volume_correlation(kpi: DataFrame, min_rows: int = 10) -> DataFrame:
    price = F.col("avg_net_price")
    return (
        kpi.where((price > 0) & (F.col("shipments_units") > 0))
        .groupBy(*SEGMENT)
        .agg(
            F.count(F.lit(1)).alias("weeks"),
            correlation(price, F.col("shipments_units").cast("double"), min_rows).alias(
                "corr_price_volume"
            ),
            correlation(price, F.col("net_revenue_after_trade").cast("double"), min_rows).alias(
                "corr_price_netrev"
            ),
        )
        .orderBy(F.asc_nulls_last("corr_price_volume"), *SEGMENT)
    )


def trade_effectiveness(kpi: DataFrame) -> DataFrame:
    """weeks counts KPI rows, as defined; n_weeks is the number of different weeks."""
    keys = ["operating_country", "channel_name"]
    sums = kpi.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("weeks"),
        F.count_distinct("date_week_id").alias("n_weeks"),
        total(F.col("shipments_units")).alias("shipments_units"),
        total(F.col("gross_revenue")).alias("gross_revenue"),
        total(F.col("trade_spend")).alias("total_trade_spend"),
        total(F.col("net_revenue_after_trade")).alias("net_revenue_after_trade"),
    )
    units, spend = F.col("shipments_units"), F.col("total_trade_spend")
    return sums.withColumns(
        {
            "trade_spend_pct_calc": safe_div(spend, F.col("gross_revenue")),
            "trade_spend_per_unit": safe_div(spend, units),
            "net_rev_per_unit": safe_div(F.col("net_revenue_after_trade"), units),
        }
    ).orderBy(F.desc_nulls_last("total_trade_spend"), *keys)


def with_leakage(kpi: DataFrame) -> DataFrame:
    """Rows with realization, prices and units above zero, and the gap per unit."""
    positive = ["price_realization", "avg_list_price", "avg_net_price", "shipments_units"]
    for name in positive:
        kpi = kpi.where(F.col(name) > 0)
    return kpi.withColumn("leakage_per_unit", F.col("avg_list_price") - F.col("avg_net_price"))


LEAKAGE_MEASURES = {
    "avg_price_realization": "price_realization",
    "avg_list_price": "avg_list_price",
    "avg_net_price": "avg_net_price",
    "avg_leakage_per_unit": "leakage_per_unit",
}


def realization_leakage(kpi: DataFrame, reading: str = "as_run") -> DataFrame:
    def mean(name):
        if reading == "as_run":
            return F.when(F.sum("shipments_units") != 0, summed(name))
        return mean_by_units(name)

    extra = [] if reading == "as_run" else [F.count_distinct("date_week_id").alias("n_weeks")]
    return (
        with_leakage(kpi)
        .groupBy(*LEAKAGE_SEGMENT)
        .agg(
            F.count(F.lit(1)).alias("weeks" if reading == "as_run" else "n_rows"),
            *extra,
            F.sum("shipments_units").alias("shipments_units"),
            *[mean(source).alias(name) for name, source in LEAKAGE_MEASURES.items()],
        )
        .orderBy(F.asc_nulls_last("avg_price_realization"), *LEAKAGE_SEGMENT)
    )


def lowest(leakage: DataFrame, rows: int) -> DataFrame:
    """The first rows in report order; ties fall by segment, so the cut is repeatable."""
    return leakage.orderBy(F.asc_nulls_last("avg_price_realization"), *LEAKAGE_SEGMENT).limit(rows)


def segment_label() -> F.Column:
    return paste(
        *[F.col(c) for c in ("operating_country", "channel_name", "brand_tier", "wholesaler_tier")]
    )


def weekly_totals(kpi: DataFrame, reading: str = "as_run") -> DataFrame:
    def mean(name):
        if reading == "as_run":
            return F.when(F.sum("shipments_units") != 0, F.coalesce(summed(name), F.lit(0.0)))
        return mean_by_units(name)

    sums = kpi.groupBy("date_week_id").agg(
        total(F.col("shipments_units")).alias("shipments_units"),
        total(F.col("gross_revenue")).alias("gross_revenue"),
        total(F.col("trade_spend")).alias("trade_spend"),
        total(F.col("net_revenue_after_trade")).alias("net_revenue_after_trade"),
        mean("avg_list_price").alias("weighted_list_price"),
        mean("avg_net_price").alias("weighted_net_price"),
    )
    return sums.withColumns(
        {
            "trade_spend_pct": safe_div(F.col("trade_spend"), F.col("gross_revenue")),
            "price_realization": safe_div(
                F.col("weighted_net_price"), F.col("weighted_list_price")
            ),
        }
    )


ROLLED = ["gross_revenue", "trade_spend_pct", "price_realization"]


def weekly_trend(kpi: DataFrame, reading: str = "as_run") -> DataFrame:
    """Weekly totals with trailing four-week means. The unpartitioned window runs over one
    row per week, after the roll-up."""
    series = ordered("date_week_id")
    return (
        weekly_totals(kpi, reading)
        .withColumns(
            {f"{c}_roll4": trailing_mean(F.col(c).cast("double"), series) for c in ROLLED}
        )
        .orderBy(F.asc_nulls_last("date_week_id"))
    )


def executive_summary(kpi: DataFrame) -> DataFrame:
    """Five headline metrics in long form; prices are weighted by units. The metric names are
    fixed values."""
    gross, spend = total(F.col("gross_revenue")), total(F.col("trade_spend"))

    one = kpi.agg(
        gross.cast("double").alias("gross"),
        spend.cast("double").alias("spend"),
        safe_div(spend, gross).alias("share"),
        total(F.col("net_revenue_after_trade")).cast("double").alias("net"),
        safe_div(mean_by_units("avg_net_price"), mean_by_units("avg_list_price")).alias("realization"),
    )
    return one.selectExpr(
        "stack(5, 'Total Gross Revenue', gross, 'Total Trade Spend', spend,"
        " 'Trade Spend % of Revenue (calc)', share, 'Total Net Revenue After Trade', net,"
        " 'Avg Price Realization (weighted)', realization) AS (metric, value)"
    )


def formatted_summary(summary: DataFrame) -> DataFrame:
    cents = needs_cents(F.col("value"), Window.partitionBy())  # over the five rows
    return summary.withColumn("value_fmt", metric_text(F.col("metric"), F.col("value"), cents))
