"""Dashboard tables: trends, decomposition, pricing, trade, competition, structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekgrain.functions.ratios import guarded_ratio, safe_div, total, weighted_mean
from weekgrain.functions.windows import change, ordered, relative_change
from weekgrain.plans.decision import LEAKAGE_SEGMENT, ROLLED, weekly_totals, weekly_trend


def week_over_week(kpi: DataFrame, reading: str = "as_run") -> DataFrame:
    series = ordered("date_week_id")
    columns = {}
    for name in ROLLED:
        x = F.col(name).cast("double")
        columns[f"{name}_change"] = change(x, series)
        columns[f"{name}_wow"] = relative_change(x, series)
    return weekly_totals(kpi, reading).select(
        "date_week_id", *ROLLED, *[c.alias(n) for n, c in columns.items()]
    )


def trend_page(kpi: DataFrame) -> DataFrame:
    """Rolling means and week-over-week changes of revenue, trade share and realization."""
    series = ordered("date_week_id")
    wow = {f"{c}_wow": relative_change(F.col(c).cast("double"), series) for c in ROLLED}
    return weekly_trend(kpi).select(
        "date_week_id",
        *[f"{c}_roll4" for c in ROLLED],
        *[c.alias(n) for n, c in wow.items()],
    )


def revenue_decomposition(kpi: DataFrame) -> DataFrame:
    """Change of net revenue between consecutive observed weeks of a segment, split in
    volume effect (u1-u0)*n0, price effect (l1-l0)*u1 and trade effect (the rest), where n is
    net revenue per unit and l the list price. The three add up to the change."""
    series = Window.partitionBy(*LEAKAGE_SEGMENT).orderBy("date_week_id")
    units = F.col("shipments_units").cast("double")
    net = F.col("net_revenue_after_trade").cast("double")
    now = kpi.select(
        *LEAKAGE_SEGMENT, "date_week_id", units.alias("u1"), net.alias("r1"),
        F.col("avg_list_price").alias("l1"),
    )
    before = {f"{c}0": F.lag(f"{c}1").over(series) for c in ("u", "r", "l")}
    return (
        now.withColumns(before)
        .where(F.col("r0").isNotNull())
        .select(
            *LEAKAGE_SEGMENT,
            "date_week_id",
            (F.col("r1") - F.col("r0")).alias("revenue_change"),
            ((F.col("u1") - F.col("u0")) * safe_div(F.col("r0"), F.col("u0"))).alias("volume_effect"),
            ((F.col("l1") - F.col("l0")) * F.col("u1")).alias("price_effect"),
        )
        .withColumn(
            "trade_effect",
            F.col("revenue_change") - F.col("volume_effect") - F.col("price_effect"),
        )
    )


def pricing_page(wide: DataFrame) -> DataFrame:
    """List and net price and realization per price strategy and week."""
    volume = F.col("shipment_volume")
    return (
        wide.groupBy("price_strategy", "date_week_id")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            weighted_mean(F.col("list_price"), volume).alias("list_price"),
            weighted_mean(F.col("net_invoice_price"), volume).alias("net_price"),
            F.sum("price_change_flag").alias("price_changes"),
        )
        .withColumn("price_realization", guarded_ratio(F.col("net_price"), F.col("list_price")))
    )


def trade_page(wide: DataFrame) -> DataFrame:
    """Incentive mix per week: share of spend by type, and net revenue per unit of spend."""
    by_type = wide.groupBy("date_week_id", "incentive_type").agg(
        total(F.col("trade_spend_amount")).alias("trade_spend"),
        total(F.col("revenue_net_of_trade")).alias("net_revenue"),
    )
    week = Window.partitionBy("date_week_id")
    return by_type.withColumns(
        {
            "spend_share": safe_div(F.col("trade_spend"), F.sum("trade_spend").over(week)),
            "net_revenue_per_spend": safe_div(F.col("net_revenue"), F.col("trade_spend")),
        }
    )


def channel_dependency(kpi: DataFrame) -> DataFrame:
    """Revenue share of each channel within its country."""
    sums = kpi.groupBy("operating_country", "channel_name").agg(
        total(F.col("gross_revenue")).alias("gross_revenue")
    )
    country = Window.partitionBy("operating_country")
    return sums.withColumn(
        "revenue_share", safe_div(F.col("gross_revenue"), F.sum("gross_revenue").over(country))
    )


def wholesaler_concentration(wide: DataFrame, top: int = 1) -> DataFrame:
    """Per country: wholesalers, Herfindahl index of revenue, share of the `top` largest.
    Windows run over one row per country and wholesaler."""
    sums = wide.groupBy("operating_country", "wholesaler_id").agg(
        total(F.col("sell_in_revenue")).alias("revenue")
    )
    country = Window.partitionBy("operating_country")
    ranked = sums.withColumns(
        {
            "share": safe_div(F.col("revenue"), F.sum("revenue").over(country)),
            "place": F.row_number().over(
                country.orderBy(F.desc("revenue"), F.asc("wholesaler_id"))
            ),
        }
    )
    return ranked.groupBy("operating_country").agg(
        F.count(F.lit(1)).alias("wholesalers"),
        F.sum(F.col("share") * F.col("share")).alias("herfindahl"),
        F.sum(F.when(F.col("place") <= top, F.col("share"))).alias("top_share"),
    )


def channel_comparison(wide: DataFrame) -> DataFrame:
    """Weekly revenue, units and margin per channel with the change on the week before."""
    sums = wide.groupBy("channel_name", "date_week_id").agg(
        total(F.col("sell_in_revenue")).alias("gross_revenue"),
        total(F.col("shipment_volume")).alias("shipments_units"),
        total(F.col("contribution_margin_proxy")).alias("contribution_margin"),
    )
    series = ordered("date_week_id", ["channel_name"])
    return sums.withColumns(
        {
            "revenue_wow": relative_change(F.col("gross_revenue").cast("double"), series),
            "units_wow": relative_change(F.col("shipments_units").cast("double"), series),
            "margin_change": change(F.col("contribution_margin"), series),
        }
    )
