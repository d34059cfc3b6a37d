"""Queries over chart tables, quality reports and dashboard tables."""

from __future__ import annotations

from weekgrain.operators import dims, quality
from weekgrain.plans import charts, dashboard, decision, eda, kpi
from weekgrain.registry.aggregates import ROLL, ROLLED, WOW, _wow_sql
from weekgrain.registry.core import query
from weekgrain.registry.oracle import SEGMENT, binned, ratio, weighted
from weekgrain.registry.rows import SEG
from weekgrain.registry.sources import KPI, RAW
from weekgrain.sources.layout import write_interleaved
from weekgrain.sources.readers import read_snapshot, standardise

BINS = "bin:i bin_start:r9 bin_end:r9 count:i"


@query("cht_01_net_price_histogram", BINS,
       binned("SELECT net_unit_price FROM wide WHERE net_unit_price > 0", "net_unit_price", 40))
def net_price_histogram(w):
    return charts.net_price_histogram(w("wide"))


@query("cht_02_realization_histogram", BINS,
       binned("SELECT price_realization_pct FROM wide WHERE price_realization_pct > 0", "price_realization_pct", 40))
def realization_histogram(w):
    return charts.realization_histogram(w("wide"))


@query("cht_03_net_list_scatter", "list_unit_price:d net_unit_price:d",
       "SELECT * FROM wide WHERE net_unit_price > 0 AND list_unit_price > 0")
def net_list_scatter(w):
    return charts.net_and_list(w("wide"))


def _cell(column, bins):
    return (
        f"LEAST(CAST(floor(COALESCE(({column} - lo_{column}) * {bins} / NULLIF(hi_{column} - lo_{column}, 0), 0))"
        f" AS BIGINT) + 1, {bins})"
    )


@query("cht_03_net_list_density", "list_bin:i net_bin:i count:i",
       f"SELECT {_cell('list_unit_price', 100)} AS list_bin, {_cell('net_unit_price', 100)} AS net_bin, COUNT(*) AS count"
       " FROM (SELECT * FROM wide WHERE net_unit_price > 0 AND list_unit_price > 0),"
       " (SELECT MIN(list_unit_price) AS lo_list_unit_price, MAX(list_unit_price) AS hi_list_unit_price,"
       " MIN(net_unit_price) AS lo_net_unit_price, MAX(net_unit_price) AS hi_net_unit_price FROM wide"
       " WHERE net_unit_price > 0 AND list_unit_price > 0) GROUP BY 1, 2")
def net_list_density(w):
    return charts.net_and_list_density(w("wide"))


@query("cht_04_spend_by_type", "incentive_type:s total_trade_spend:d label:s",
       "SELECT incentive_type, SUM(trade_spend_amount) AS total_trade_spend,"
       " format('{:,}', CAST(round(SUM(trade_spend_amount)) AS BIGINT)) AS label FROM wide"
       " WHERE incentive_type IS NOT NULL GROUP BY 1")
def spend_by_type(w):
    return charts.spend_by_type(eda.trade_by_type(w("wide")))


@query("cht_05_price_index_histogram", BINS,
       binned("SELECT price_index_vs_comp FROM price_index", "price_index_vs_comp", 40))
def price_index_histogram(w):
    return charts.price_index_histogram(w("price_index"))


@query("cht_06_correlation_histogram", BINS,
       binned("SELECT corr_price_volume FROM correlations", "corr_price_volume", 30))
def correlation_histogram(w):
    return charts.correlation_histogram(decision.price_volume_correlation(w("kpi")))


@query("cht_07_spend_net_revenue", "operating_country:s channel_name:s total_trade_spend:d net_revenue_after_trade:d",
       "SELECT * FROM effectiveness WHERE total_trade_spend >= 0 AND net_revenue_after_trade >= 0")
def spend_net_revenue(w):
    return charts.spend_and_net_revenue(decision.trade_effectiveness(w("kpi")))


@query("cht_08_lowest_realization", "segment:s product_family:s avg_price_realization:r9",
       "SELECT operating_country || ' | ' || channel_name || ' | ' || brand_tier || ' | ' || wholesaler_tier AS segment,"
       " product_family, avg_price_realization FROM (SELECT * FROM leakage"
       f" ORDER BY avg_price_realization, {SEGMENT}, wholesaler_tier LIMIT 15)")
def lowest_realization(w):
    return charts.lowest_realization(decision.realization_leakage(w("kpi")))


def _line(name, measure, digits):
    @query(name, f"date_week_id:i {measure}_roll4:r{digits}", "SELECT * FROM trend")
    def line(w):
        return charts.trend_line(decision.weekly_trend(w("kpi")), measure)

    return line


_line("cht_09_revenue_line", "gross_revenue", 4)
_line("cht_10_trade_share_line", "trade_spend_pct", 9)
_line("cht_11_realization_line", "price_realization", 9)


def _union(parts):
    return " UNION ALL ".join(parts)


@query("dq_01_foreign_keys", "check_name:s violations:i",
       _union(
           f"SELECT '{c}.{k} -> {p}' AS check_name, COUNT(*) AS violations FROM {c}"
           f" WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {t} FROM {p})"
           for c, k, p, t in quality.FOREIGN_KEYS
       ))
def foreign_keys(w):
    return quality.foreign_key_report(w)


@query("dq_02_unique_keys", "check_name:s violations:i",
       _union(
           f"SELECT '{t}({', '.join(k)})' AS check_name, COUNT(*) AS violations FROM (SELECT {', '.join(k)} FROM {t}"
           f" WHERE {' AND '.join(c + ' IS NOT NULL' for c in k)} GROUP BY {', '.join(k)} HAVING COUNT(*) > 1)"
           for t, k in quality.UNIQUE_KEYS
       ))
def unique_keys(w):
    return quality.unique_key_report(w)


@query("dq_03_not_null", "check_name:s violations:i",
       _union(
           f"SELECT '{t}.{c}' AS check_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS violations FROM {t}"
           for t, columns in quality.NOT_NULL.items() for c in columns
       ))
def not_null(w):
    return quality.not_null_report(w)


@query("dq_04_standardise", RAW,
       "SELECT * REPLACE (trim(product_id) AS product_id, trim(product_name) AS product_name) FROM raw")
def standardised(w):
    from pyspark.sql import functions as F

    from weekgrain.sources.schemas import RAW_FILE_COLUMNS, snake

    untidy = w("raw").select(
        *[F.col(snake(c)).cast("string").alias(c) for c in RAW_FILE_COLUMNS]
    )
    return standardise(untidy)


@query("dim_01_product_groups", "product_group_id:i product_family:s product_category:s brand_tier:s",
       "SELECT row_number() OVER (ORDER BY product_family, product_category, brand_tier) AS product_group_id, *"
       " FROM (SELECT DISTINCT product_family, product_category, brand_tier FROM dim_product)")
def product_groups(w):
    return dims.product_groups(w("dim_product"))


@query("doc_01_trend_page", f"date_week_id:i {ROLL} {WOW}", f"SELECT *, {_wow_sql(ROLLED, False)} FROM trend")
def trend_page(w):
    return dashboard.trend_page(w("kpi"))


@query("doc_02_decomposition", f"{SEG} wholesaler_tier:s date_week_id:i revenue_change:r4 volume_effect:r4"
       " price_effect:r4 trade_effect:r4",
       f"""SELECT *, revenue_change - volume_effect - price_effect AS trade_effect FROM (
       SELECT {SEGMENT}, wholesaler_tier, date_week_id, r1 - r0 AS revenue_change,
              (u1 - u0) * (r0 / NULLIF(u0, 0)) AS volume_effect, (l1 - l0) * u1 AS price_effect
       FROM (SELECT *, lag(u1) OVER s AS u0, lag(r1) OVER s AS r0, lag(l1) OVER s AS l0
             FROM (SELECT *, CAST(shipments_units AS DOUBLE) AS u1, CAST(net_revenue_after_trade AS DOUBLE) AS r1,
                          avg_list_price AS l1 FROM kpi)
             WINDOW s AS (PARTITION BY {SEGMENT}, wholesaler_tier ORDER BY date_week_id))
       WHERE r0 IS NOT NULL)""")
def decomposition(w):
    return dashboard.revenue_decomposition(w("kpi"))


@query("doc_03_slicers", KPI,
       "SELECT * FROM kpi WHERE date_week_id BETWEEN 199701 AND 199853 AND channel_name = 'Retail'"
       " AND brand_tier IN ('Premium', 'Core')")
def slicers(w):
    return kpi.sliced(
        w("kpi"), weeks=(199701, 199853), channel_name="Retail", brand_tier=["Premium", "Core"]
    )


@query("doc_03_slicers_any_column", KPI,
       "SELECT * FROM kpi WHERE operating_country IN ('NATION_3', 'NATION_17') AND product_family = 'Oral Nicotine'"
       " UNION ALL SELECT * FROM kpi WHERE date_week_id BETWEEN 199501 AND 199513")
def slicers_any_column(w):
    """Slices of a table whose files are dealt by week, country and family at once."""
    path = w.path("out/kpi_by_slicers")
    write_interleaved(w("kpi"), path, ["date_week_id", "operating_country", "product_family"], files=32)
    laid = read_snapshot(w.spark, path, w("kpi").schema)
    places = kpi.sliced(laid, operating_country=["NATION_3", "NATION_17"], product_family="Oral Nicotine")
    return places.unionByName(kpi.sliced(laid, weeks=(199501, 199513)))


@query("doc_04_pricing_page", "price_strategy:s date_week_id:i rows:i list_price:d net_price:d price_changes:i"
       " price_realization:d",
       "SELECT *, CASE WHEN list_price > 0 THEN net_price / list_price END AS price_realization FROM ("
       f"SELECT price_strategy, date_week_id, COUNT(*) AS rows, {weighted('list_price')} AS list_price,"
       f" {weighted('net_invoice_price')} AS net_price, SUM(price_change_flag) AS price_changes FROM wide GROUP BY 1, 2)")
def pricing_page(w):
    return dashboard.pricing_page(w("wide"))


@query("doc_05_trade_page", "date_week_id:i incentive_type:s trade_spend:d net_revenue:d spend_share:d"
       " net_revenue_per_spend:d",
       f"SELECT *, {ratio('trade_spend', 'week_spend')} AS spend_share,"
       f" {ratio('net_revenue', 'trade_spend')} AS net_revenue_per_spend FROM (SELECT *, SUM(trade_spend) OVER"
       " (PARTITION BY date_week_id) AS week_spend FROM (SELECT date_week_id, incentive_type,"
       " SUM(trade_spend_amount) AS trade_spend, SUM(revenue_net_of_trade) AS net_revenue FROM wide GROUP BY 1, 2))")
def trade_page(w):
    return dashboard.trade_page(w("wide"))


@query("doc_06_competition_page", "channel_name:s competitor_name:s avg_price_index:r9 rows:i",
       "SELECT channel_name, competitor_name, AVG(list_unit_price / avg_price) AS avg_price_index, COUNT(*) AS rows"
       " FROM wide JOIN (SELECT date_week_id, country_id, region_id, channel_id, competitor_name,"
       f" {ratio('SUM(competitor_price)', 'COUNT(*)')} AS avg_price FROM fact_competitor GROUP BY ALL)"
       " USING (date_week_id, country_id, region_id, channel_id) WHERE list_unit_price > 0 AND avg_price > 0 GROUP BY 1, 2")
def competition_page(w):
    return eda.index_by_competitor(w("price_index"))


@query("doc_07_channel_dependency", "operating_country:s channel_name:s gross_revenue:d revenue_share:d",
       f"SELECT *, {ratio('gross_revenue', 'country_revenue')} AS revenue_share FROM (SELECT operating_country,"
       " channel_name, gross_revenue, SUM(gross_revenue) OVER (PARTITION BY operating_country) AS country_revenue"
       " FROM effectiveness)")
def channel_dependency(w):
    return dashboard.channel_dependency(w("kpi"))


@query("doc_07_wholesaler_concentration", "operating_country:s wholesalers:i herfindahl:r9 top_share:d",
       "SELECT operating_country, COUNT(*) AS wholesalers, SUM(share * share) AS herfindahl, MAX(share) AS top_share FROM ("
       f"SELECT operating_country, {ratio('revenue', 'SUM(revenue) OVER (PARTITION BY operating_country)')} AS share FROM ("
       "SELECT operating_country, wholesaler_id, SUM(sell_in_revenue) AS revenue FROM wide GROUP BY 1, 2)) GROUP BY 1")
def wholesaler_concentration(w):
    return dashboard.wholesaler_concentration(w("wide"))


@query("doc_08_channel_comparison", "channel_name:s date_week_id:i gross_revenue:d shipments_units:d"
       " contribution_margin:d revenue_wow:r9 units_wow:r9 margin_change:d",
       "SELECT *, CAST(gross_revenue AS DOUBLE) / NULLIF(lag(CAST(gross_revenue AS DOUBLE)) OVER s, 0) - 1 AS revenue_wow,"
       " CAST(shipments_units AS DOUBLE) / NULLIF(lag(CAST(shipments_units AS DOUBLE)) OVER s, 0) - 1 AS units_wow,"
       " contribution_margin - lag(contribution_margin) OVER s AS margin_change FROM (SELECT channel_name, date_week_id,"
       " SUM(sell_in_revenue) AS gross_revenue, SUM(shipment_volume) AS shipments_units,"
       " SUM(contribution_margin_proxy) AS contribution_margin FROM wide GROUP BY 1, 2)"
       " WINDOW s AS (PARTITION BY channel_name ORDER BY date_week_id)")
def channel_comparison(w):
    return dashboard.channel_comparison(w("wide"))


