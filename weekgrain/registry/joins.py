"""Queries over joins, subqueries, set operations, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekgrain.functions.labels import channel_of
from weekgrain.operators import dataset, facts
from weekgrain.plans import charts, decision, eda, kpi
from weekgrain.registry.core import in_order, query
from weekgrain.registry.oracle import CHANNEL, KEYS, SEGMENT
from weekgrain.registry.rows import SEG
from weekgrain.registry.sources import IDS, KPI, SHIPMENT

FACTS = (
    f"{SHIPMENT} list_price:d net_invoice_price:d price_change_flag:i price_strategy:s"
    " incentive_type:s incentive_pct:d incentive_amount:d compliance_flag:i"
)


@query("join_01_one_key", "order_id:s country_id:i quantity:i brand_tier:s",
       "SELECT r.order_id, c.country_id, r.quantity, p.brand_tier FROM raw r"
       " JOIN dim_country c ON c.operating_country = r.country"
       " JOIN dim_product p ON p.product_id = upper(trim(r.product_id))")
def one_key(w):
    countries = w("dim_country").select("country_id", F.col("operating_country").alias("country"))
    lines = w("raw").withColumn("product_id", F.upper(F.trim("product_id")))
    return lines.join(countries, "country").join(w("dim_product"), "product_id")


@query("join_02_four_keys", "order_id:s region_id:i quantity:i",
       "SELECT r.order_id, g.region_id, r.quantity FROM raw r JOIN dim_country c ON c.operating_country = r.country"
       " JOIN dim_region g ON g.country_id = c.country_id AND g.regulatory_region = r.region AND g.state = r.state"
       " AND g.city = r.city")
def four_keys(w):
    countries = w("dim_country").select("country_id", F.col("operating_country").alias("country"))
    places = w("dim_region").withColumnRenamed("regulatory_region", "region")
    return w("raw").join(countries, "country").join(places, ["country_id", "region", "state", "city"])


@query("join_03_computed_key", "order_id:s segment:s channel_id:i quantity:i",
       f"SELECT order_id, segment, channel_id, quantity FROM (SELECT *, {CHANNEL} AS channel_name FROM raw)"
       " JOIN dim_channel USING (channel_name)")
def computed_key(w):
    lines = w("raw").withColumn("channel_name", channel_of(F.col("segment")))
    return lines.join(w("dim_channel"), "channel_name")


@query("join_04_two_keys", f"{IDS} wholesaler_name:s",
       f"SELECT {KEYS}, wholesaler_name FROM fact_shipments JOIN (SELECT wholesaler_name, country_id,"
       " primary_channel_id AS channel_id FROM dim_wholesaler) USING (country_id, channel_id)")
def two_keys(w):
    sellers = w("dim_wholesaler").select(
        "wholesaler_name", "country_id", F.col("primary_channel_id").alias("channel_id")
    )
    return w("fact_shipments").join(sellers, ["country_id", "channel_id"])


@query("join_05_existence", f"{IDS} list_price:d",
       "SELECT * FROM fact_price WHERE list_price > 0 AND product_id IN (SELECT product_id FROM dim_product)")
def existence(w):
    return facts.priced(w("fact_price"), w("dim_product"))


@query("join_06_literal_fan_out", f"{IDS} competitor_name:s base_multiplier:d", "SELECT * FROM competitor_rows")
def literal_fan_out(w):
    rows = facts.priced(w("fact_price"), w("dim_product"))
    return rows.select("*", F.inline(facts.competitor_structs()))


@query("join_07_scalar_subquery", f"{IDS} is_key_account:i",
       f"SELECT {KEYS}, CASE WHEN channel_id = (SELECT channel_id FROM dim_channel WHERE channel_name = 'Key Accounts')"
       " THEN 1 ELSE 0 END AS is_key_account FROM fact_shipments")
def scalar_subquery(w):
    same = F.col("channel_id") == facts.key_accounts_id(w("dim_channel"))
    return w("fact_shipments").withColumn("is_key_account", same.cast("int"))


@query("join_08_fact_left_join", FACTS, "SELECT * FROM wide")
def fact_left_join(w):
    return dataset.join_facts(w("fact_shipments"), w("fact_price"), w("fact_trade"))


@query("join_09_star_left_join",
       f"{IDS} product_variant_name:s product_family:s product_category:s pack_size:s nicotine_format:s"
       " operating_country:s macro_region:s channel_name:s fiscal_year:i fiscal_week:i wholesaler_name:s"
       " wholesaler_tier:s primary_channel_id:i",
       "SELECT * FROM wide")
def star_left_join(w):
    return dataset.add_dimensions(
        w("fact_shipments"), w("dim_product"), w("dim_country"), w("dim_channel"),
        w("dim_date_week"), w("dim_wholesaler"),
    )


@query("join_10_renamed_keys", f"{IDS} avg_comp_price:d price_index_vs_comp:d", "SELECT * FROM price_index")
def renamed_keys(w):
    return eda.price_index(w("wide"), facts.competitor_benchmark(w("fact_competitor")))


@query("subq_01_derived_table", f"{IDS} net_price:d list_price:d prev_net_price:d", "SELECT * FROM unit_price")
def derived_table(w):
    return facts.unit_prices(w("fact_shipments"))


@query("set_01_union_all", "competitor_name:s competitor_product_family:s base_multiplier:d offers:i",
       "SELECT c.competitor_name, c.competitor_product_family, c.base_multiplier, COUNT(*) AS offers"
       " FROM competitors c JOIN competitor_rows r ON r.competitor_name = c.competitor_name GROUP BY ALL")
def union_all(w):
    one = facts.competitor_literals(w.spark)
    parts = [one.where(F.col("competitor_name") == name) for name, _, _ in facts.COMPETITORS]
    together = parts[0].unionByName(parts[1]).unionByName(parts[2])
    offers = w("fact_competitor").groupBy("competitor_name").agg(F.count(F.lit(1)).alias("offers"))
    return together.join(offers, "competitor_name")


@query("set_02_distinct", "country:s segment:s", "SELECT DISTINCT country, segment FROM raw")
def distinct(w):
    return w("raw").select("country", "segment").distinct()


@query("sort_01_ascending", "date_week_id:i gross_revenue:d place:i",
       "SELECT *, row_number() OVER (ORDER BY date_week_id) AS place FROM weekly")
def ascending(w):
    return in_order(w, decision.weekly_trend(w("kpi")), "sort_01")


@query("sort_02_descending_aggregate", "incentive_type:s rows_cnt:i place:i",
       "SELECT *, row_number() OVER (ORDER BY rows_cnt DESC, incentive_type) AS place FROM"
       " (SELECT incentive_type, COUNT(*) AS rows_cnt FROM fact_trade GROUP BY incentive_type)")
def descending_aggregate(w):
    return in_order(w, eda.rows_by_type(w("fact_trade")), "sort_02")


@query("sort_03_multi_key", f"{KPI} place:i",
       f"SELECT *, row_number() OVER (ORDER BY {', '.join(f'{c} NULLS LAST' for c in kpi.FULL_ORDER)}) AS place FROM kpi")
def multi_key(w):
    return in_order(w, kpi.sorted_kpis(w("kpi")), "sort_03")


@query("sort_04_nullable_measure", f"{SEG} weeks:i corr_price_volume:r9 place:i",
       f"SELECT *, row_number() OVER (ORDER BY corr_price_volume NULLS LAST, {SEGMENT}) AS place FROM correlations")
def nullable_measure(w):
    return in_order(w, decision.price_volume_correlation(w("kpi")), "sort_04")


LOW = f"""SELECT *, row_number() OVER (ORDER BY avg_price_realization, {SEGMENT}, wholesaler_tier) AS place
FROM leakage QUALIFY place <= """


@query("topk_01_lowest_20", f"{SEG} wholesaler_tier:s weeks:i shipments_units:d avg_price_realization:r9"
       " avg_list_price:r9 avg_net_price:r9 avg_leakage_per_unit:r9 place:i", LOW + "20")
def lowest_20(w):
    return in_order(w, decision.lowest(decision.realization_leakage(w("kpi")), 20), "topk_01")


@query("topk_02_lowest_15_labelled", "segment:s product_family:s avg_price_realization:r9 place:i",
       "SELECT * EXCLUDE (place), row_number() OVER (ORDER BY avg_price_realization, segment, product_family) AS place"
       " FROM (SELECT operating_country || ' | ' || channel_name || ' | ' || brand_tier || ' | ' || wholesaler_tier"
       f" AS segment, product_family, avg_price_realization, place FROM ({LOW}15))")
def lowest_15(w):
    return in_order(w, charts.lowest_realization(decision.realization_leakage(w("kpi"))), "topk_02")


@query("lim_01_preview", SHIPMENT, f"SELECT * FROM fact_shipments ORDER BY {KEYS} LIMIT 10")
def preview(w):
    return w("fact_shipments").orderBy(*facts.FACT_KEYS).limit(10)


@query("lim_02_first_match", "channel_id:i volume:d",
       "SELECT channel_id, SUM(shipment_volume) AS volume FROM fact_shipments WHERE channel_id ="
       " (SELECT channel_id FROM dim_channel WHERE channel_name = 'Key Accounts' LIMIT 1) GROUP BY channel_id")
def first_match(w):
    first = w("dim_channel").where(F.col("channel_name") == "Key Accounts").select("channel_id").limit(1)
    return (
        w("fact_shipments")
        .where(F.col("channel_id") == first.scalar())
        .groupBy("channel_id")
        .agg(F.sum("shipment_volume").alias("volume"))
    )
