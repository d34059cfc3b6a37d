"""Queries over aggregates and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekgrain.functions import ratios
from weekgrain.operators import dims, facts, quality
from weekgrain.plans import dashboard, decision, eda, kpi
from weekgrain.registry.core import in_order, query
from weekgrain.registry.oracle import KEYS, SEGMENT, ratio
from weekgrain.registry.rows import SEG, SUMMARY_FMT
from weekgrain.registry.sources import IDS, KPI, SHIPMENT


@query("agg_01_raw_profile", "row_count:i distinct_orders:i distinct_products:i min_year:i max_year:i"
       " min_weeknum:i max_weeknum:i",
       "SELECT COUNT(*) AS row_count, COUNT(DISTINCT order_id) AS distinct_orders,"
       " COUNT(DISTINCT product_id) AS distinct_products, MIN(year) AS min_year, MAX(year) AS max_year,"
       " MIN(weeknum) AS min_weeknum, MAX(weeknum) AS max_weeknum FROM raw")
def raw_profile(w):
    return eda.raw_profile(w("raw"), w("raw_products"))


@query("agg_02_channel_dim", "channel_id:i channel_name:s", "SELECT * FROM dim_channel")
def channel_dim(w):
    return dims.channels(w("raw_places"))


@query("agg_03_country_dim", "country_id:i operating_country:s macro_region:s macro_region_2:s",
       "SELECT * FROM dim_country_loaded")
def country_dim(w):
    return dims.countries_loaded(w("raw_places"))


@query("agg_04_region_dim", "region_id:i country_id:i regulatory_region:s state:s city:s", "SELECT * FROM dim_region")
def region_dim(w):
    return dims.regions(w("raw_places"), w("dim_country"))


@query("agg_05_week_dim", "date_week_id:i fiscal_year:i fiscal_week:i fiscal_quarter:i month:i"
       " week_start_date:s week_end_date:s", "SELECT * FROM dim_date_week")
def week_dim(w):
    return dims.weeks(w("raw_weeks"))


@query("agg_06_product_dim", "product_id:s product_variant_name:s source_product_family:s source_product_category:s"
       " product_family:s product_category:s brand_tier:s pack_size:s nicotine_format:s",
       "SELECT * FROM dim_product_loaded")
def product_dim(w):
    return dims.products_loaded(w("raw_products"))


@query("agg_07_wholesaler_dim", "wholesaler_id:i wholesaler_name:s wholesaler_tier:s country_id:i primary_channel_id:i",
       "SELECT * FROM dim_wholesaler")
def wholesaler_dim(w):
    return dims.wholesalers(w("raw_places"), w("dim_country"), w("dim_channel"))


@query("agg_08_shipments_fact", SHIPMENT, "SELECT * FROM fact_shipments")
def shipments_fact(w):
    return facts.shipments(
        w("raw_lines"), w("dim_country"), w("dim_region"), w("dim_channel"), w("dim_wholesaler")
    )


@query("agg_09_trade_fact", f"{IDS} incentive_type:s incentive_pct:d incentive_amount:d compliance_flag:i",
       "SELECT * FROM fact_trade")
def trade_fact(w):
    return facts.trade_incentives(w("fact_shipments"), w("dim_product"), w("dim_channel"))


@query("agg_10_price_fact", f"{IDS} list_price:d net_invoice_price:d price_change_flag:i price_strategy:s",
       "SELECT * FROM fact_price")
def price_fact(w):
    return facts.prices(w("fact_shipments"), w("dim_product"), w("dim_channel"))


@query("agg_11_competitor_fact", "date_week_id:i country_id:i region_id:i channel_id:i competitor_name:s"
       " competitor_product_family:s competitor_price:d", "SELECT * FROM fact_competitor")
def competitor_fact(w):
    return facts.competitor_prices(w("fact_price"), w("dim_product"))


TABLES = [
    "dim_channel", "dim_country", "dim_region", "dim_date_week", "dim_product", "dim_wholesaler",
    "fact_shipments", "fact_price", "fact_trade", "fact_competitor", "wide", "kpi",
]


@query("agg_12_row_counts", "table_name:s rows:i",
       " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS rows FROM {t}" for t in TABLES))
def row_counts(w):
    return quality.row_counts(w, TABLES)


@query("agg_13_week_range", "min_key:i max_key:i weeks_loaded:i",
       "SELECT MIN(date_week_id) AS min_key, MAX(date_week_id) AS max_key, COUNT(*) AS weeks_loaded FROM dim_date_week")
def week_range(w):
    return w("dim_date_week").agg(
        F.min("date_week_id").alias("min_key"),
        F.max("date_week_id").alias("max_key"),
        F.count(F.lit(1)).alias("weeks_loaded"),
    )


@query("agg_14_group_counts", "name:s rows_cnt:i",
       "SELECT incentive_type AS name, COUNT(*) AS rows_cnt FROM fact_trade GROUP BY 1 UNION ALL"
       " SELECT competitor_name, COUNT(*) FROM fact_competitor GROUP BY 1")
def group_counts(w):
    def count(table, column):
        return w(table).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("rows_cnt"))

    return count("fact_trade", "incentive_type").unionByName(count("fact_competitor", "competitor_name"))


@query("agg_15_missing_counts", "missing_net_price:i missing_list_price:i",
       "SELECT COUNT(*) FILTER (WHERE net_unit_price IS NULL) AS missing_net_price,"
       " COUNT(*) FILTER (WHERE list_unit_price IS NULL) AS missing_list_price FROM wide")
def missing_counts(w):
    return eda.missing_counts(w("wide"))


@query("agg_16_health", "rows:i weeks:i countries:i products:i channels:i wholesalers:i missing_net_price:i"
       " missing_list_price:i missing_trade:i",
       "SELECT COUNT(*) AS rows, "
       + ", ".join(
           f"COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS {n}"
           for n, c in eda.HEALTH_DISTINCT.items()
       )
       + ", COUNT(*) FILTER (WHERE net_unit_price IS NULL) AS missing_net_price,"
       " COUNT(*) FILTER (WHERE list_unit_price IS NULL) AS missing_list_price,"
       " COUNT(*) FILTER (WHERE trade_spend_amount IS NULL) AS missing_trade FROM wide")
def health(w):
    return eda.health(w("wide"))


@query("agg_17_pricing_summary", "avg_net_price:r9 median_net_price:r9 p10_net_price:r9 p90_net_price:r9 max_net_price:d",
       f"SELECT {ratio('SUM(net_invoice_price)', 'COUNT(net_invoice_price)')} AS avg_net_price,"
       " quantile_cont(net_unit_price, 0.5) AS median_net_price, quantile_cont(net_unit_price, 0.1) AS p10_net_price,"
       " quantile_cont(net_unit_price, 0.9) AS p90_net_price, MAX(net_unit_price) AS max_net_price"
       " FROM wide WHERE net_unit_price > 0")
def pricing_summary(w):
    return eda.pricing(w("wide"))


@query("agg_18_trade_summary", "total_trade_spend:d avg_trade_spend:d trade_spend_pct_of_revenue:d",
       "SELECT SUM(trade_spend_amount) AS total_trade_spend,"
       f" {ratio('SUM(trade_spend_amount)', 'COUNT(trade_spend_amount)')} AS avg_trade_spend,"
       f" {ratio('SUM(trade_spend_amount)', 'SUM(sell_in_revenue)')} AS trade_spend_pct_of_revenue FROM wide")
def trade_summary(w):
    return eda.trade(w("wide"))


@query("agg_19_trade_by_type", "incentive_type:s rows:i total_trade_spend:d place:i",
       "SELECT *, row_number() OVER (ORDER BY total_trade_spend DESC NULLS LAST, incentive_type NULLS LAST) AS place FROM"
       " (SELECT incentive_type, COUNT(*) AS rows, SUM(trade_spend_amount) AS total_trade_spend FROM wide GROUP BY 1)")
def trade_by_type(w):
    return in_order(w, eda.trade_by_type(w("wide")), "agg_19")


@query("agg_20_compliance", "compliance_rate:r9 rows_with_flag:i",
       "SELECT AVG(compliance_flag) AS compliance_rate, COUNT(*) AS rows_with_flag FROM wide"
       " WHERE compliance_flag IS NOT NULL")
def compliance(w):
    return eda.compliance(w("wide"))


@query("agg_21_competitor_benchmark", "date_week_id:i country_id:i region_id:i channel_id:i avg_comp_price:d",
       "SELECT * FROM bench")
def competitor_benchmark(w):
    return facts.competitor_means(w("fact_price"), w("dim_product"))


@query("agg_22_price_index", "avg_price_index:r9 p10_price_index:r9 p90_price_index:r9",
       "SELECT AVG(price_index_vs_comp) AS avg_price_index, quantile_cont(price_index_vs_comp, 0.1) AS p10_price_index,"
       " quantile_cont(price_index_vs_comp, 0.9) AS p90_price_index FROM price_index")
def price_index(w):
    return eda.price_index_summary(w("price_index"))


@query("agg_23_weekly_kpi", KPI, "SELECT * FROM kpi")
def weekly_kpi(w):
    return kpi.weekly_kpis(w("wide"))


@query("agg_24_weighted_mean", "price_strategy:s list_price:d prev_price:d",
       "SELECT price_strategy, CAST(SUM(list_price * shipment_volume) AS DOUBLE)"
       " / NULLIF(CAST(SUM(shipment_volume) FILTER (WHERE list_price IS NOT NULL) AS DOUBLE), 0) AS list_price,"
       " CAST(SUM(prev_net_price * shipment_volume) AS DOUBLE)"
       " / NULLIF(CAST(SUM(shipment_volume) FILTER (WHERE prev_net_price IS NOT NULL) AS DOUBLE), 0) AS prev_price"
       f" FROM (SELECT {KEYS}, shipment_volume, list_price, CAST(prev_net_price AS DECIMAL(18,4)) AS prev_net_price"
       f" FROM unit_price) JOIN (SELECT {KEYS}, price_strategy FROM fact_price) USING ({KEYS}) GROUP BY 1")
def weighted_mean(w):
    # The previous price is null in a series' first week: those rows must leave both sums.
    volume, before = F.col("shipment_volume"), F.col("prev_net_price").cast("decimal(18,4)")
    rows = facts.unit_prices(w("fact_shipments")).join(w("dim_product"), "product_id")
    return (
        rows.withColumns(facts.price_columns(w("dim_channel")))
        .groupBy("price_strategy")
        .agg(
            ratios.weighted_mean(F.col("list_price"), volume).alias("list_price"),
            ratios.weighted_mean(before, volume).alias("prev_price"),
        )
    )


@query("agg_25_price_volume_correlation", f"{SEG} weeks:i corr_price_volume:r9 corr_price_netrev:r9",
       "SELECT * FROM correlations")
def price_volume_correlation(w):
    return decision.price_volume_correlation(w("kpi"))


EFFECT = (
    "operating_country:s channel_name:s weeks:i n_weeks:i shipments_units:d gross_revenue:d total_trade_spend:d"
    " net_revenue_after_trade:d trade_spend_pct_calc:d trade_spend_per_unit:d net_rev_per_unit:d place:i"
)


@query("agg_26_trade_effectiveness", EFFECT,
       "SELECT *, row_number() OVER (ORDER BY total_trade_spend DESC NULLS LAST, operating_country, channel_name) AS place"
       " FROM effectiveness")
def trade_effectiveness(w):
    return in_order(w, decision.trade_effectiveness(w("kpi")), "agg_26")


LEAK = (
    "shipments_units:d avg_price_realization:r9 avg_list_price:r9 avg_net_price:r9 avg_leakage_per_unit:r9"
)


@query("agg_27_leakage", f"{SEG} wholesaler_tier:s weeks:i {LEAK} place:i",
       f"SELECT *, row_number() OVER (ORDER BY avg_price_realization NULLS LAST, {SEGMENT}, wholesaler_tier) AS place"
       " FROM leakage")
def leakage(w):
    return in_order(w, decision.realization_leakage(w("kpi")), "agg_27")


@query("agg_27_leakage_intended", f"{SEG} wholesaler_tier:s n_rows:i n_weeks:i {LEAK}", "SELECT * FROM leakage_intended")
def leakage_intended(w):
    return decision.realization_leakage(w("kpi"), "intended")


WEEK = (
    "date_week_id:i shipments_units:d gross_revenue:d trade_spend:d net_revenue_after_trade:d trade_spend_pct:d"
    " weighted_list_price:r9 weighted_net_price:r9 price_realization:r9"
)


@query("agg_28_weekly_totals", WEEK, "SELECT * FROM weekly")
def weekly_totals(w):
    return decision.weekly_totals(w("kpi"))


@query("agg_28_weekly_totals_intended", WEEK, "SELECT * FROM weekly_intended")
def weekly_totals_intended(w):
    return decision.weekly_totals(w("kpi"), "intended")


@query("agg_29_executive_summary", "metric:s value:r6 value_fmt:s", SUMMARY_FMT)
def executive_summary(w):
    return decision.formatted_summary(decision.executive_summary(w("kpi")))


@query("agg_30_null_tolerant", "category:s sales:d shipping:d mean_shipping:d",
       "SELECT category, COALESCE(SUM(sales), 0) AS sales, COALESCE(SUM(shipping_cost), 0) AS shipping,"
       " AVG(shipping_cost) AS mean_shipping FROM raw GROUP BY category")
def null_tolerant(w):
    return w("raw").groupBy("category").agg(
        ratios.total(F.col("sales")).alias("sales"),
        ratios.total(F.col("shipping_cost")).alias("shipping"),
        F.avg("shipping_cost").alias("mean_shipping"),
    )


@query("win_01_lag", f"{IDS} net_price:d prev_net_price:d", "SELECT * FROM unit_price")
def lag(w):
    return facts.unit_prices(w("fact_shipments"))


ROLL = "gross_revenue_roll4:r4 trade_spend_pct_roll4:r9 price_realization_roll4:r9"


@query("win_02_trailing_mean", f"date_week_id:i {ROLL} place:i",
       "SELECT *, row_number() OVER (ORDER BY date_week_id) AS place FROM trend")
def trailing_mean(w):
    return in_order(w, decision.weekly_trend(w("kpi")), "win_02")


@query("win_02_trailing_mean_intended", f"date_week_id:i {ROLL}", "SELECT * FROM trend_intended")
def trailing_mean_intended(w):
    return decision.weekly_trend(w("kpi"), "intended")


def _wow_sql(columns, change=True):
    parts = []
    for c in columns:
        before = f"lag(CAST({c} AS DOUBLE)) OVER (ORDER BY date_week_id)"
        if change:
            parts.append(f"CAST({c} AS DOUBLE) - {before} AS {c}_change")
        parts.append(f"CAST({c} AS DOUBLE) / NULLIF({before}, 0) - 1 AS {c}_wow")
    return ", ".join(parts)


ROLLED = decision.ROLLED
WOW = " ".join(f"{c}_wow:r9" for c in ROLLED)


@query("win_03_week_over_week", "date_week_id:i gross_revenue_change:r4 trade_spend_pct_change:r9"
       f" price_realization_change:r9 {WOW}",
       f"SELECT date_week_id, {_wow_sql(ROLLED)} FROM weekly")
def week_over_week(w):
    return dashboard.week_over_week(w("kpi"))


@query("win_04_surrogate_keys", "region_id:i country_id:i state:s city:s", "SELECT * FROM dim_region")
def surrogate_keys(w):
    return dims.regions(w("raw_places"), w("dim_country"))


