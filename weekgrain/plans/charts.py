"""The table behind each chart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrain.functions.text import commas
from weekgrain.operators.histogram import histogram
from weekgrain.plans.decision import lowest, segment_label


def net_price_histogram(wide: DataFrame) -> DataFrame:
    return histogram(wide.where(F.col("net_unit_price") > 0), "net_unit_price", 40)


def realization_histogram(wide: DataFrame) -> DataFrame:
    return histogram(wide.where(F.col("price_realization_pct") > 0), "price_realization_pct", 40)


def net_and_list(wide: DataFrame) -> DataFrame:
    return wide.where((F.col("net_unit_price") > 0) & (F.col("list_unit_price") > 0)).select(
        "list_unit_price", "net_unit_price"
    )


def net_and_list_density(wide: DataFrame, bins: int = 100) -> DataFrame:
    """The same scatter as counts on a bins x bins grid, for data too large to plot."""
    pairs = net_and_list(wide)
    edges = pairs.agg(
        *[F.min(c).alias(f"lo_{c}") for c in pairs.columns],
        *[F.max(c).alias(f"hi_{c}") for c in pairs.columns],
    )
    edge = edges.select(F.struct("*")).scalar()

    def cell(name):
        lo, hi = edge[f"lo_{name}"], edge[f"hi_{name}"]
        place = F.coalesce(F.try_divide((F.col(name) - lo) * bins, hi - lo), F.lit(0.0))
        return F.least(F.floor(place) + 1, F.lit(bins)).cast("int")

    return pairs.groupBy(
        cell("list_unit_price").alias("list_bin"), cell("net_unit_price").alias("net_bin")
    ).agg(F.count(F.lit(1)).alias("count"))


def spend_by_type(trade_by_type: DataFrame) -> DataFrame:
    """Bars in ascending order of spend, with the axis text."""
    return (
        trade_by_type.where(F.col("incentive_type").isNotNull())
        .select(
            "incentive_type", "total_trade_spend", commas(F.col("total_trade_spend")).alias("label")
        )
        .orderBy("total_trade_spend", "incentive_type")
    )


def price_index_histogram(indexed: DataFrame) -> DataFrame:
    return histogram(indexed, "price_index_vs_comp", 40)


def correlation_histogram(correlations: DataFrame) -> DataFrame:
    return histogram(correlations, "corr_price_volume", 30)


def spend_and_net_revenue(effectiveness: DataFrame) -> DataFrame:
    spend, net = F.col("total_trade_spend"), F.col("net_revenue_after_trade")
    return effectiveness.where((spend >= 0) & (net >= 0)).select(
        "operating_country", "channel_name", "total_trade_spend", "net_revenue_after_trade"
    )


def lowest_realization(leakage: DataFrame, rows: int = 15) -> DataFrame:
    return (
        lowest(leakage, rows)
        .select(segment_label().alias("segment"), "product_family", "avg_price_realization")
        .orderBy("avg_price_realization", "segment", "product_family")
    )


def trend_line(trend: DataFrame, measure: str) -> DataFrame:
    return trend.select("date_week_id", f"{measure}_roll4").orderBy("date_week_id")
