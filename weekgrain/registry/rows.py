"""Queries over projections, filters, CASE labels and casts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekgrain.functions import calendar, hashing, labels, ratios, text
from weekgrain.operators import dataset, dims, facts
from weekgrain.plans import charts, decision
from weekgrain.registry.core import in_order, query
from weekgrain.registry.oracle import CHANNEL, KEYS, SEGMENT, line, ratio
from weekgrain.registry.sources import IDS

SEG = "operating_country:s channel_name:s product_family:s brand_tier:s"
# Money shows cents if no value of the whole column is as large as 100,000 and some is not whole.
SUMMARY_FMT = """
SELECT metric, value,
  CASE WHEN regexp_matches(metric, 'Revenue|Spend')
         THEN '$' || CASE WHEN cents THEN format('{:,.2f}', value) ELSE format('{:,}', CAST(round(value) AS BIGINT)) END
       WHEN regexp_matches(metric, '%|Realization') THEN format('{:.1f}%', value * 100)
       ELSE CAST(value AS VARCHAR) END AS value_fmt
FROM (SELECT *, max(abs(value)) OVER () < 100000 AND bool_or(value <> floor(value)) OVER () AS cents FROM summary)
"""


@query("prj_01_select_rename", "week:i product:s units:i revenue:d",
       "SELECT year * 100 + weeknum AS week, product_id AS product, quantity AS units, sales AS revenue FROM raw")
def select_rename(w):
    return w("raw").select(
        (F.col("year") * 100 + F.col("weeknum")).alias("week"),
        F.col("product_id").alias("product"),
        F.col("quantity").alias("units"),
        F.col("sales").alias("revenue"),
    )


@query("prj_02_column_drop", "country_id:i operating_country:s macro_region:s", "SELECT * FROM dim_country")
def column_drop(w):
    return dims.countries_loaded(w("raw_places")).drop("macro_region_2")


MEASURES = (
    "net_unit_price:d list_unit_price:d discount_rate:d trade_spend_amount:d"
    " price_realization_pct:d revenue_net_of_trade:d"
)


@query("prj_03_derived_columns", f"{IDS} {MEASURES}", "SELECT * FROM wide")
def derived_columns(w):
    return w("wide")


@query("prj_04_row_leakage", f"date_week_id:i {SEG} wholesaler_tier:s product_category:s leakage_per_unit:d",
       "SELECT * FROM leaking")
def row_leakage(w):
    return decision.with_leakage(w("kpi"))


@query("prj_05_placeholder_nulls", "region_id:i tax_proxy_rate:d regulation_intensity:s",
       "SELECT region_id, tax_proxy_rate, regulation_intensity FROM dim_region")
def placeholder_nulls(w):
    return w("dim_region")


@query("flt_01_not_blank", "order_id:s country:s product_id:s",
       "SELECT order_id, country, product_id FROM raw WHERE country IS NOT NULL AND country <> ''"
       " AND product_id IS NOT NULL AND trim(product_id) <> ''")
def not_blank(w):
    return w("raw").where(dims.filled("country") & dims.filled("product_id"))


@query("flt_02_not_null_pair", "year:i weeknum:i rows:i",
       "SELECT year, weeknum, COUNT(*) AS rows FROM raw WHERE year IS NOT NULL AND weeknum IS NOT NULL GROUP BY ALL")
def not_null_pair(w):
    return w("raw").dropna(subset=["year", "weeknum"]).groupBy("year", "weeknum").agg(
        F.count(F.lit(1)).alias("rows")
    )


@query("flt_03_positive_value", f"{IDS} net_unit_price:d list_unit_price:d price_realization_pct:d",
       "SELECT * FROM wide WHERE net_unit_price > 0 AND list_unit_price > 0 AND price_realization_pct > 0")
def positive_value(w):
    return w("wide").where("net_unit_price > 0 AND list_unit_price > 0 AND price_realization_pct > 0")


@query("flt_04_kpi_eligibility", f"date_week_id:i {SEG} wholesaler_tier:s shipments_units:d price_realization:d",
       "SELECT * FROM leaking WHERE trade_spend >= 0 AND net_revenue_after_trade >= 0")
def kpi_eligibility(w):
    return decision.with_leakage(w("kpi")).where("trade_spend >= 0 AND net_revenue_after_trade >= 0")


@query("flt_05_not_null_category", "incentive_type:s compliance_flag:i rows:i",
       "SELECT incentive_type, compliance_flag, COUNT(*) AS rows FROM wide"
       " WHERE incentive_type IS NOT NULL AND compliance_flag IS NOT NULL GROUP BY ALL")
def not_null_category(w):
    wide = w("wide").dropna(subset=["incentive_type", "compliance_flag"])
    return wide.groupBy("incentive_type", "compliance_flag").agg(F.count(F.lit(1)).alias("rows"))


@query("case_01_segment_channel", "segment:s channel_name:s rows:i",
       f"SELECT segment, {CHANNEL} AS channel_name, COUNT(*) AS rows FROM raw GROUP BY ALL")
def segment_channel(w):
    return w("raw").groupBy("segment", labels.channel_of(F.col("segment")).alias("channel_name")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query("case_02_product_line", "category:s family:s product_category:s format:s prefix:s rows:i",
       f"""SELECT category, {line('category', 'Cigarettes', 'Heated Tobacco', 'Oral Nicotine', 'Other')} AS family,
       {line('category', 'Combustible', 'Heat-not-burn', 'Nicotine Pouches', 'Other')} AS product_category,
       {line('category', 'Combustible', 'Heated', 'Oral', 'Other')} AS format,
       {line('category', 'CIG', 'HTP', 'ONP', 'GEN')} AS prefix, COUNT(*) AS rows FROM raw GROUP BY ALL""")
def product_line(w):
    category = F.col("category")
    counts = w("raw").groupBy("category").agg(F.count(F.lit(1)).alias("rows"))
    return counts.select(
        "category",
        labels.product_family(category).alias("family"),
        labels.product_category(category).alias("product_category"),
        labels.nicotine_format(category).alias("format"),
        labels.variant_prefix(category).alias("prefix"),
        "rows",
    )


@query("case_03_brand_tier", "product_id:s brand_tier:s", "SELECT product_id, brand_tier FROM dim_product")
def brand_tier(w):
    return w("raw_products").select("product_id").distinct().withColumn(
        "brand_tier", labels.brand_tier(F.col("product_id"))
    )


@query("case_04_pack_size", "product_id:s pack_size:s", "SELECT product_id, pack_size FROM dim_product")
def pack_size(w):
    return w("raw_products").select("product_id").distinct().withColumn(
        "pack_size", labels.pack_size(F.col("product_id"))
    )


@query("case_05_wholesaler_tier", "channel_name:s wholesaler_tier:s wholesalers:i",
       "SELECT channel_name, wholesaler_tier, COUNT(*) AS wholesalers FROM dim_wholesaler"
       " JOIN dim_channel ON primary_channel_id = channel_id GROUP BY ALL")
def wholesaler_tier(w):
    named = w("dim_wholesaler").join(
        w("dim_channel").withColumnRenamed("channel_id", "primary_channel_id"), "primary_channel_id"
    )
    return named.groupBy(
        "channel_name", labels.wholesaler_tier(F.col("channel_name")).alias("wholesaler_tier")
    ).agg(F.count(F.lit(1)).alias("wholesalers"))


@query("case_06_price_change_flag", f"{IDS} price_change_flag:i", "SELECT * FROM fact_price")
def price_change_flag(w):
    return facts.unit_prices(w("fact_shipments")).withColumn(
        "price_change_flag", labels.price_change_flag(F.col("net_price"), F.col("prev_net_price"))
    )


def _tiered(w):
    return w("fact_shipments").join(w("dim_product"), "product_id").join(w("dim_channel"), "channel_id")


@query("case_07_price_strategy", f"{IDS} price_strategy:s", "SELECT * FROM fact_price")
def price_strategy(w):
    is_key = F.col("channel_name") == labels.KEY_ACCOUNTS
    return _tiered(w).withColumn("price_strategy", labels.price_strategy(F.col("brand_tier"), is_key))


@query("case_08_incentive_type", f"{IDS} incentive_type:s", "SELECT * FROM fact_trade")
def incentive_type(w):
    is_key = F.col("channel_name") == labels.KEY_ACCOUNTS
    return _tiered(w).withColumn("incentive_type", labels.incentive_type(F.col("brand_tier"), is_key))


@query("case_09_compliance_flag", "trade_incentive_pct:d compliance_flag:i rows:i",
       "SELECT trade_incentive_pct, CASE WHEN COALESCE(trade_incentive_pct, 0) <= 0.25 THEN 1 ELSE 0 END"
       " AS compliance_flag, COUNT(*) AS rows FROM fact_shipments GROUP BY ALL")
def compliance_flag(w):
    flag = labels.compliance_flag(F.col("trade_incentive_pct"))
    return w("fact_shipments").groupBy("trade_incentive_pct", flag.alias("compliance_flag")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query("case_10_guarded_ratio", f"{IDS} realization:d",
       f"SELECT *, CASE WHEN list_price > 0 THEN {ratio('net_invoice_price', 'list_price')} END AS realization"
       " FROM fact_price")
def guarded_ratio(w):
    return w("fact_price").withColumn(
        "realization", ratios.guarded_ratio(F.col("net_invoice_price"), F.col("list_price"))
    )


@query("case_11_safe_division", f"{IDS} margin_per_revenue:d",
       f"SELECT {KEYS}, {ratio('contribution_margin_proxy', 'sell_in_revenue')} AS margin_per_revenue FROM fact_shipments")
def safe_division(w):
    return w("fact_shipments").withColumn(
        "margin_per_revenue",
        ratios.safe_div(F.col("contribution_margin_proxy"), F.col("sell_in_revenue")),
    )


@query("case_12_metric_format", "metric:s value_fmt:s", SUMMARY_FMT)
def metric_format(w):
    return decision.formatted_summary(decision.executive_summary(w("kpi")))


@query("cast_01_numeric", f"{IDS} shipment_volume:d sell_in_revenue:d trade_spend_amount:d revenue_net_of_trade:d",
       "SELECT * FROM wide")
def numeric(w):
    return dataset.as_numeric(w("wide"))


@query("cast_02_coerce", "order_id:s shipments_units:d gross_revenue:d trade_spend:d",
       "SELECT order_id, TRY_CAST(CAST(quantity AS VARCHAR) AS DOUBLE) AS shipments_units,"
       " TRY_CAST(CAST(sales AS VARCHAR) AS DOUBLE) AS gross_revenue,"
       " TRY_CAST(order_priority AS DOUBLE) AS trade_spend FROM raw")
def coerce(w):
    as_text = w("raw").select(
        "order_id",
        F.col("quantity").cast("string").alias("shipments_units"),
        F.col("sales").cast("string").alias("gross_revenue"),
        F.col("order_priority").alias("trade_spend"),
    )
    return dataset.as_numeric(
        as_text, ["shipments_units", "gross_revenue", "trade_spend", "price_realization"]
    )


@query("fn_01_upper_trim", "product_id:s normal:s rows:i",
       "SELECT product_id, upper(trim(product_id)) AS normal, COUNT(*) AS rows FROM raw GROUP BY ALL")
def upper_trim(w):
    counts = w("raw").groupBy("product_id").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("normal", text.normal_id(F.col("product_id")))


@query("fn_02_concat", f"{IDS} hash_text:s",
       f"SELECT {KEYS}, product_id || '|' || CAST(country_id AS VARCHAR) || '|' || CAST(date_week_id AS VARCHAR)"
       " || '|Competitor A' AS hash_text FROM fact_shipments")
def concat(w):
    first = F.lit(facts.COMPETITORS[0][0])
    return w("fact_shipments").withColumn("hash_text", facts.noise_text(first))


@query("fn_03_lpad", "product_id:s padded:s",
       "SELECT product_id, lpad(CAST(h % 9999 AS VARCHAR), 4, '0') AS padded FROM dim_product_loaded")
def lpad(w):
    ids = w("dim_product").select("product_id")
    return ids.withColumn("padded", hashing.padded_hash(F.col("product_id"), 9999, 4))


def _hashed(w):
    from weekgrain.functions.hashing import crc32_text

    return w("raw_products").select("product_id").distinct().withColumn(
        "hash", crc32_text(F.col("product_id"))
    )


@query("fn_04_crc32", "product_id:s hash:i", "SELECT product_id, h AS hash FROM dim_product_loaded")
def crc32(w):
    return _hashed(w)


@query("fn_05_modulo", "product_id:s m3:i m4:i m7:i m9999:i m999999:i",
       "SELECT product_id, h % 3 AS m3, h % 4 AS m4, h % 7 AS m7, h % 9999 AS m9999, h % 999999 AS m999999"
       " FROM dim_product_loaded")
def modulo(w):
    return _hashed(w).select(
        "product_id", *[(F.col("hash") % m).alias(f"m{m}") for m in (3, 4, 7, 9999, 999999)]
    )


@query("fn_06_abs", f"{IDS} moved:d",
       f"SELECT {KEYS}, abs(net_price - prev_net_price) AS moved FROM unit_price")
def absolute(w):
    return facts.unit_prices(w("fact_shipments")).withColumn(
        "moved", F.abs(F.col("net_price") - F.col("prev_net_price"))
    )


@query("fn_07_ceil", "fiscal_week:i fiscal_quarter:i weeks:i",
       "SELECT fiscal_week, CAST(ceil(fiscal_week / 13.0) AS INTEGER) AS fiscal_quarter, COUNT(*) AS weeks"
       " FROM dim_date_week GROUP BY ALL")
def ceiling(w):
    from weekgrain.functions.calendar import fiscal_quarter

    weeks = w("raw_weeks").select("fiscal_year", "fiscal_week").distinct()
    return weeks.groupBy(
        "fiscal_week", fiscal_quarter(F.col("fiscal_week")).alias("fiscal_quarter")
    ).agg(F.count(F.lit(1)).alias("weeks"))


@query("fn_08_round", f"{IDS} incentive_amount:d list_2:d",
       "SELECT *, ROUND(list_price, 2) AS list_2 FROM wide")
def rounding(w):
    amount = F.round(F.col("sell_in_revenue") * F.col("trade_incentive_pct"), 2)
    return w("wide").withColumn("incentive_amount", amount).withColumn("list_2", F.round("list_price", 2))


@query("fn_09_week_key", "year:i weeknum:i date_week_id:i",
       "SELECT DISTINCT year, weeknum, CAST(CAST(year AS VARCHAR) || lpad(CAST(weeknum AS VARCHAR), 2, '0') AS INTEGER)"
       " AS date_week_id FROM raw")
def week_key_number(w):
    from weekgrain.functions.calendar import week_key

    return w("raw").select("year", "weeknum").distinct().withColumn(
        "date_week_id", week_key(F.col("year"), F.col("weeknum"))
    )


@query("fn_10_week_start", "date_week_id:i week_start_date:s", "SELECT * FROM dim_date_week")
def week_start_date(w):
    from weekgrain.functions.calendar import week_start

    weeks = w("raw_weeks").select("date_week_id", "fiscal_year", "fiscal_week").distinct()
    return weeks.withColumn("week_start_date", week_start(F.col("fiscal_year"), F.col("fiscal_week")))


@query("fn_11_month", "date_week_id:i month:i", "SELECT * FROM dim_date_week")
def month(w):
    return dims.weeks(w("raw_weeks")).select("date_week_id", "month")


@query("fn_12_date_add", "date_week_id:i week_end_date:s", "SELECT * FROM dim_date_week")
def date_add(w):
    end = calendar.week_end(F.col("week_start_date"))
    return w("dim_date_week").select("date_week_id", end.alias("week_end_date"))


@query("fn_13_nullif", f"{IDS} net_price:d",
       f"SELECT {KEYS}, CASE WHEN channel_id > 1 THEN net_price END AS net_price FROM unit_price")
def null_if(w):
    # No unit is sold through the first channel: its prices have no divisor.
    sold = F.when(F.col("channel_id") > 1, F.col("shipment_volume")).otherwise(0).cast("decimal(18,2)")
    return facts.unit_prices(w("fact_shipments").withColumn("shipment_volume", sold))


@query("fn_14_ifnull", f"{IDS} previous:d",
       f"SELECT {KEYS}, COALESCE(prev_net_price, 0) AS previous FROM unit_price")
def if_null(w):
    zero = F.lit(0).cast("decimal(24,6)")
    return facts.unit_prices(w("fact_shipments")).withColumn("previous", F.coalesce("prev_net_price", zero))


@query("fn_15_arithmetic", f"{IDS} revenue_net_of_trade:d incentive_amount:d compliance_flag:i price_change_flag:i",
       "SELECT * FROM wide")
def arithmetic(w):
    return dataset.add_measures(dataset.enrich_facts(w("fact_shipments"), w("dim_channel")))


@query("fn_16_paste", f"{SEG} wholesaler_tier:s segment:s",
       f"SELECT {SEGMENT}, wholesaler_tier, operating_country || ' | ' || channel_name || ' | ' || brand_tier || ' | '"
       " || wholesaler_tier AS segment FROM leakage")
def paste(w):
    return decision.realization_leakage(w("kpi")).withColumn("segment", decision.segment_label())


@query("fn_17_regex", "metric:s money:i share:i",
       "SELECT metric, CAST(regexp_matches(metric, 'Revenue|Spend') AS INTEGER) AS money,"
       " CAST(regexp_matches(metric, '%|Realization') AND NOT regexp_matches(metric, 'Revenue|Spend') AS INTEGER) AS share"
       " FROM summary")
def regex(w):
    spelled = text.metric_text(F.col("metric"), F.lit(1.0))
    return decision.executive_summary(w("kpi")).select(
        "metric",
        spelled.startswith("$").cast("int").alias("money"),
        spelled.endswith("%").cast("int").alias("share"),
    )


@query("fn_18_money_percent", "operating_country:s channel_name:s spend:s share:s units:s",
       "SELECT operating_country, channel_name, '$' || format('{:,}', CAST(round(total_trade_spend) AS BIGINT)) AS spend,"
       " format('{:.1f}%', trade_spend_pct_calc * 100) AS share,"
       " format('{:,}', CAST(round(shipments_units) AS BIGINT)) AS units FROM effectiveness")
def money_percent(w):
    return decision.trade_effectiveness(w("kpi")).select(
        "operating_country",
        "channel_name",
        text.dollars(F.col("total_trade_spend")).alias("spend"),
        text.percents(F.col("trade_spend_pct_calc")).alias("share"),
        text.commas(F.col("shipments_units")).alias("units"),
    )


@query("fn_19_null_test_text", f"{IDS} first_week:i week_text:s",
       f"SELECT {KEYS}, CASE WHEN prev_net_price IS NULL THEN 1 ELSE 0 END AS first_week,"
       " CAST(date_week_id AS VARCHAR) AS week_text FROM unit_price")
def null_test_text(w):
    return facts.unit_prices(w("fact_shipments")).withColumns({
        "first_week": F.col("prev_net_price").isNull().cast("int"),
        "week_text": F.col("date_week_id").cast("string"),
    })


@query("fn_20_category_order", "incentive_type:s total_trade_spend:d place:i",
       "SELECT incentive_type, SUM(trade_spend_amount) AS total_trade_spend,"
       " row_number() OVER (ORDER BY SUM(trade_spend_amount), incentive_type) AS place FROM wide"
       " WHERE incentive_type IS NOT NULL GROUP BY incentive_type")
def category_order(w):
    from weekgrain.plans import eda

    return in_order(w, charts.spend_by_type(eda.trade_by_type(w("wide"))), "fn_20")
