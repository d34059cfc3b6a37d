"""KPI table, decision pack and dashboard tables over hand-made rows."""

from decimal import Decimal

import pytest
from helpers import plan
from pyspark.sql import functions as F

from weekgrain.plans import charts, dashboard, decision, kpi
from weekgrain.sources.schemas import KPI_COLUMNS, ddl


def kpi_rows(spark, *rows):
    base = {
        "date_week_id": 201101, "fiscal_year": 2011, "fiscal_week": 1, "fiscal_quarter": 1, "month": 1,
        "operating_country": "France", "channel_name": "Retail", "product_family": "Cigarettes",
        "product_category": "Combustible", "brand_tier": "Core", "wholesaler_tier": "T2",
        "shipments_units": 10.0, "gross_revenue": 100.0, "trade_spend": 20.0, "trade_spend_pct": 0.2,
        "net_revenue_after_trade": 80.0, "avg_list_price": 12.5, "avg_net_price": 10.0,
        "price_realization": 0.8, "avg_contribution_margin_proxy": 1.0,
    }
    data = [tuple({**base, **row}[c] for c in KPI_COLUMNS) for row in rows]
    return spark.createDataFrame(data, ddl(KPI_COLUMNS))


def test_leakage_as_run_sums_and_intended_weights(spark):
    df = kpi_rows(
        spark,
        {"price_realization": 0.5, "shipments_units": 1.0},
        {"price_realization": 0.9, "shipments_units": 3.0, "date_week_id": 201102},
        {"price_realization": None},
    )
    as_run = decision.realization_leakage(df).first()
    assert as_run.avg_price_realization == pytest.approx(1.4) and as_run.weeks == 2
    intended = decision.realization_leakage(df, "intended").first()
    assert intended.avg_price_realization == pytest.approx(0.8)
    assert (intended.n_rows, intended.n_weeks) == (2, 2)


def test_effectiveness_counts_rows_as_weeks(spark):
    df = kpi_rows(spark, {}, {"brand_tier": "Value"}, {"trade_spend": 0.0, "shipments_units": 0.0})
    got = decision.trade_effectiveness(df).first()
    assert (got.weeks, got.total_trade_spend, got.trade_spend_pct_calc) == (3, 40.0, pytest.approx(40 / 300))
    assert got.trade_spend_per_unit == 2.0


def test_weekly_trend_needs_four_weeks(spark):
    df = kpi_rows(spark, *[{"date_week_id": 201101 + i, "gross_revenue": 100.0 * i} for i in range(5)])
    got = decision.weekly_trend(df).collect()
    assert [r.gross_revenue_roll4 for r in got] == [None, None, None, 150.0, 250.0]
    assert got[0].price_realization == pytest.approx(0.8)
    short = decision.weekly_trend(df.where("date_week_id < 201104")).collect()
    assert all(r.gross_revenue_roll4 is None for r in short)


def test_readings_of_the_weekly_price_differ(spark):
    df = kpi_rows(spark, {"avg_list_price": 10.0, "shipments_units": 1.0},
                  {"avg_list_price": 20.0, "shipments_units": 3.0, "brand_tier": "Value"})
    assert decision.weekly_totals(df).first().weighted_list_price == 30.0
    assert decision.weekly_totals(df, "intended").first().weighted_list_price == 17.5


def test_summary_is_weighted_by_units(spark):
    df = kpi_rows(spark, {"avg_list_price": 10.0, "avg_net_price": 5.0, "shipments_units": 1.0},
                  {"avg_list_price": 20.0, "avg_net_price": 18.0, "shipments_units": 3.0})
    got = {r.metric: r for r in decision.formatted_summary(decision.executive_summary(df)).collect()}
    assert got["Avg Price Realization (weighted)"].value == pytest.approx(59 / 70)
    assert got["Avg Price Realization (weighted)"].value_fmt == "84.3%"
    assert got["Total Gross Revenue"].value_fmt == "$200.00"
    assert got["Trade Spend % of Revenue (calc)"].value_fmt.startswith("$0.")


def test_decomposition_adds_up(tables):
    got = dashboard.revenue_decomposition(tables("kpi"))
    gap = F.col("revenue_change") - F.col("volume_effect") - F.col("price_effect") - F.col("trade_effect")
    assert got.count() > 0 and got.where(F.abs(gap) > 1e-6).count() == 0


def test_decomposition_by_hand(spark):
    df = kpi_rows(
        spark, {},
        {"date_week_id": 201105, "shipments_units": 12.0, "net_revenue_after_trade": 120.0, "avg_list_price": 15.0},
    )
    got = dashboard.revenue_decomposition(df).first()
    assert (got.revenue_change, got.volume_effect, got.price_effect, got.trade_effect) == (40.0, 16.0, 30.0, -6.0)


def test_shares_add_to_one(tables):
    mix = dashboard.trade_page(tables("wide")).groupBy("date_week_id").agg(F.sum("spend_share").alias("s"))
    assert mix.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    held = dashboard.wholesaler_concentration(tables("wide"), top=3)
    assert held.where("herfindahl > 1.0000001 OR top_share > 1.0000001").count() == 0


def test_top_rows_break_ties_by_segment(spark):
    df = kpi_rows(spark, {"brand_tier": "Value"}, {"brand_tier": "Core"}, {"brand_tier": "Premium"})
    low = decision.lowest(decision.realization_leakage(df), 2)
    assert [r.brand_tier for r in low.collect()] == ["Core", "Premium"]
    label = charts.lowest_realization(decision.realization_leakage(df), 1).first().segment
    assert label == "France | Retail | Core | T2"


def test_kpi_prices_skip_missing_prices(spark):
    schema = (
        ", ".join(f"{c} string" for c in kpi.GROUP)
        + ", shipment_volume decimal(18,2), sell_in_revenue decimal(18,2), trade_spend_amount decimal(18,2),"
        " revenue_net_of_trade decimal(18,2), list_price decimal(18,4), net_invoice_price decimal(18,4),"
        " contribution_margin_proxy decimal(18,2)"
    )
    keys = tuple("x" for _ in kpi.GROUP)

    def row(volume, revenue, list_price, net):
        d = [None if v is None else Decimal(str(v)) for v in (volume, revenue, 1, 9, list_price, net, 2)]
        return keys + tuple(d)

    df = spark.createDataFrame([row(2, 10, 6, 5), row(3, 10, None, 4)], schema)
    got = kpi.weekly_kpis(df).first()
    assert (got.avg_list_price, got.avg_net_price) == (6.0, pytest.approx(4.4))
    assert got.price_realization == pytest.approx(4.4 / 6)
    none = kpi.weekly_kpis(spark.createDataFrame([row(0, 0, None, None)], schema)).first()
    assert (none.avg_list_price, none.price_realization, none.trade_spend_pct) == (None, None, None)


def test_slicers_reach_the_scan(tables):
    df = kpi.sliced(tables("kpi"), weeks=(199701, 199853), channel_name="Retail")
    text = df._jdf.queryExecution().executedPlan().toString()
    pushed = text[text.index("PushedFilters"):]
    assert "channel_name,Retail" in pushed and "date_week_id" in pushed


def test_reports_use_no_python_rows_and_no_pair_joins(tables):
    for df in (
        decision.price_volume_correlation(tables("kpi")),
        decision.realization_leakage(tables("kpi")),
        dashboard.pricing_page(tables("wide")),
        charts.net_price_histogram(tables("wide")),
    ):
        ops = plan(df)
        assert not [o for o in ops if "Python" in o or "Pandas" in o or "Cartesian" in o or "NestedLoop" in o]
