"""Weekly KPI table and its slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrain.functions.ratios import guarded_ratio, total, weighted_mean
from weekgrain.sources.schemas import KPI_KEYS, KPI_MEASURES

GROUP = list(KPI_KEYS)
ORDER = ["date_week_id", "operating_country", "channel_name", "product_family"]
# Ties go by the remaining keys, so that the order is the same in every run.
FULL_ORDER = [*ORDER, *[k for k in GROUP if k not in ORDER]]


def weekly_kpis(wide: DataFrame) -> DataFrame:
    """Week x country x channel x family x tier x wholesaler tier. Additive measures are
    summed as decimals and stay so; prices are weighted by volume; realization is the ratio
    of the two weighted prices."""
    sums = wide.groupBy(*GROUP).agg(
        total(F.col("shipment_volume")).alias("shipments_units"),
        total(F.col("sell_in_revenue")).alias("gross_revenue"),
        total(F.col("trade_spend_amount")).alias("trade_spend"),
        total(F.col("revenue_net_of_trade")).alias("net_revenue_after_trade"),
        weighted_mean(F.col("list_price"), F.col("shipment_volume")).alias("list_mean"),
        weighted_mean(F.col("net_invoice_price"), F.col("shipment_volume")).alias("net_mean"),
        F.try_divide(
            F.sum("contribution_margin_proxy").cast("double"), F.count("contribution_margin_proxy")
        ).alias("avg_contribution_margin_proxy"),
    )
    has_units = F.col("shipments_units") > 0
    return (
        sums.withColumns(
            {
                "trade_spend_pct": guarded_ratio(F.col("trade_spend"), F.col("gross_revenue")),
                "avg_list_price": F.when(has_units, F.col("list_mean")),
                "avg_net_price": F.when(has_units, F.col("net_mean")),
            }
        )
        .withColumn(
            "price_realization", guarded_ratio(F.col("avg_net_price"), F.col("avg_list_price"))
        )
        .select(*GROUP, *KPI_MEASURES)
    )


def sorted_kpis(kpi: DataFrame) -> DataFrame:
    return kpi.orderBy(*[F.asc_nulls_last(c) for c in FULL_ORDER])


def sliced(kpi: DataFrame, weeks: tuple[int, int] | None = None, **values) -> DataFrame:
    """Report slicers: column = value or list of values, and a week range. All of them are
    plain predicates, so they reach the Parquet scan."""
    for column, wanted in values.items():
        wanted = wanted if isinstance(wanted, (list, tuple, set)) else [wanted]
        kpi = kpi.where(F.col(column).isin(*wanted))
    if weeks:
        kpi = kpi.where(F.col("date_week_id").between(*weeks))
    return kpi
