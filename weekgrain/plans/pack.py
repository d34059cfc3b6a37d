"""All results of one run, written under one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrain.operators import quality
from weekgrain.plans import charts, dashboard, decision, eda, kpi
from weekgrain.plans.warehouse import Warehouse
from weekgrain.sources.sinks import write_csv, write_snapshot

DIMENSIONS = ["dim_product", "dim_channel", "dim_country", "dim_region", "dim_date_week", "dim_wholesaler"]
FACTS = ["fact_shipments", "fact_price", "fact_trade", "fact_competitor"]

REPORTS: dict[str, Callable[[Warehouse], DataFrame]] = {
    "eda/health": lambda t: eda.health(t("wide")),
    "eda/pricing": lambda t: eda.pricing(t("wide")),
    "eda/trade": lambda t: eda.trade(t("wide")),
    "eda/trade_by_type": lambda t: eda.trade_by_type(t("wide")),
    "eda/compliance": lambda t: eda.compliance(t("wide")),
    "eda/price_index": lambda t: eda.price_index_summary(t("price_index")),
    "decision/price_volume_correlation": lambda t: decision.price_volume_correlation(t("kpi")),
    "decision/trade_effectiveness": lambda t: decision.trade_effectiveness(t("kpi")),
    "decision/leakage": lambda t: decision.realization_leakage(t("kpi")),
    "decision/leakage_intended": lambda t: decision.realization_leakage(t("kpi"), "intended"),
    "decision/leakage_lowest_20": lambda t: decision.lowest(decision.realization_leakage(t("kpi")), 20),
    "decision/weekly_trend": lambda t: decision.weekly_trend(t("kpi")),
    "decision/weekly_trend_intended": lambda t: decision.weekly_trend(t("kpi"), "intended"),
    "decision/summary": lambda t: decision.formatted_summary(decision.executive_summary(t("kpi"))),
    "charts/net_price": lambda t: charts.net_price_histogram(t("wide")),
    "charts/realization": lambda t: charts.realization_histogram(t("wide")),
    "charts/net_and_list_density": lambda t: charts.net_and_list_density(t("wide")),
    "charts/spend_by_type": lambda t: charts.spend_by_type(eda.trade_by_type(t("wide"))),
    "charts/price_index": lambda t: charts.price_index_histogram(t("price_index")),
    "charts/correlation": lambda t: charts.correlation_histogram(
        decision.price_volume_correlation(t("kpi"))
    ),
    "charts/spend_and_net_revenue": lambda t: charts.spend_and_net_revenue(
        decision.trade_effectiveness(t("kpi"))
    ),
    "charts/lowest_realization": lambda t: charts.lowest_realization(
        decision.realization_leakage(t("kpi"))
    ),
    "dashboard/trends": lambda t: dashboard.trend_page(t("kpi")),
    "dashboard/decomposition": lambda t: dashboard.revenue_decomposition(t("kpi")),
    "dashboard/pricing": lambda t: dashboard.pricing_page(t("wide")),
    "dashboard/trade": lambda t: dashboard.trade_page(t("wide")),
    "dashboard/competition": lambda t: eda.index_by_competitor(t("price_index")),
    "dashboard/channel_dependency": lambda t: dashboard.channel_dependency(t("kpi")),
    "dashboard/wholesalers": lambda t: dashboard.wholesaler_concentration(t("wide")),
    "dashboard/channels": lambda t: dashboard.channel_comparison(t("wide")),
    "quality/foreign_keys": quality.foreign_key_report,
    "quality/unique_keys": quality.unique_key_report,
    "quality/not_null": quality.not_null_report,
}


def write_all(tables: Warehouse, out: str) -> None:
    """Facts by fiscal year and the KPI table as Parquet, dimensions as quoted CSV, reports
    as CSV."""
    for name in FACTS:
        year = F.floor(F.col("date_week_id") / 100).cast("int")
        dated = tables(name).withColumn("fiscal_year", year)
        write_snapshot(dated, f"{out}/{name}", partition_by=["fiscal_year"])
    for name in DIMENSIONS:
        write_csv(tables(name), f"{out}/{name}", quote_text=True)
    write_snapshot(tables("kpi"), f"{out}/kpi/parquet")
    write_csv(kpi.sorted_kpis(tables("kpi")), f"{out}/kpi/csv")
    for name, report in REPORTS.items():
        write_csv(report(tables), f"{out}/{name}")
