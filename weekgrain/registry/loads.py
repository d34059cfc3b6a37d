"""Queries over weekly loads, groups, mergeable counts, bad rows and names in any case."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekgrain.functions.text import caseless
from weekgrain.operators import facts, quality
from weekgrain.plans import eda
from weekgrain.registry.core import query
from weekgrain.registry.sources import IDS


@query("win_01_weekly_loads", f"{IDS} net_price:d prev_net_price:d", "SELECT * FROM unit_price")
def weekly_loads(w):
    """The shipments in loads of a year each; a load reads its weeks and the state before it."""
    shipments = w("fact_shipments")
    state, out = facts.empty_state(shipments), None
    years = [r[0] for r in shipments.select(F.floor(F.col("date_week_id") / 100).alias("y")).distinct().sort("y").collect()]
    for year in years:
        week = shipments.where(F.col("date_week_id").between(year * 100, year * 100 + 99))
        facts.check_order(week, state)
        prices, after = facts.weekly_prices(week, state)
        prices.write.mode("overwrite").parquet(w.path(f"out/loads/prices/load={year}"))
        after.write.mode("overwrite").parquet(w.path(f"out/loads/state_{year}"))
        state = w.spark.read.parquet(w.path(f"out/loads/state_{year}"))
        own = w.spark.read.parquet(w.path(f"out/loads/prices/load={year}"))
        out = own if out is None else out.unionByName(own)
    return out


@query(
    "agg_17_pricing_by_group",
    "operating_country:s brand_tier:s n:i p10_net_price:r9 median_net_price:r9 p90_net_price:r9",
    "SELECT operating_country, brand_tier, COUNT(*) AS n, quantile_cont(net_unit_price, 0.1) AS p10_net_price,"
    " quantile_cont(net_unit_price, 0.5) AS median_net_price, quantile_cont(net_unit_price, 0.9) AS p90_net_price"
    " FROM wide WHERE net_unit_price > 0 GROUP BY 1, 2",
)
def pricing_by_group(w):
    return eda.price_quantiles(w("wide"), ["operating_country", "brand_tier"])


@query(
    "agg_22_like_for_like",
    "channel_name:s rows:i avg_price_index:r9",
    "SELECT channel_name, COUNT(i) AS rows, AVG(i) AS avg_price_index FROM"
    " (SELECT channel_name, CASE WHEN list_unit_price > 0 AND avg_like_price > 0 THEN list_unit_price / avg_like_price END AS i"
    " FROM wide LEFT JOIN bench_like USING (date_week_id, country_id, region_id, channel_id, product_id)) GROUP BY 1",
)
def like_for_like(w):
    """Own list price over the mean competitor price of the same product in the same cell."""
    means = facts.competitor_means(w("fact_price"), keys=facts.LIKE_KEYS).select(*facts.LIKE_KEYS, "avg_comp_price")
    wide = w("wide").select(*facts.LIKE_KEYS, "channel_name", "list_unit_price")
    index = eda.price_index(wide, means, facts.LIKE_KEYS)
    return index.groupBy("channel_name").agg(
        F.count("price_index_vs_comp").alias("rows"), F.avg("price_index_vs_comp").alias("avg_price_index")
    )


@query(
    "agg_01_distinct_by_sketch",
    "weeks:i distinct_orders:i orders_within_bound:s distinct_products:i products_within_bound:s",
    "SELECT COUNT(DISTINCT year * 100 + weeknum) AS weeks, COUNT(DISTINCT order_id) AS distinct_orders, 'true' AS orders_within_bound,"
    " COUNT(DISTINCT product_id) AS distinct_products, 'true' AS products_within_bound FROM raw",
)
def distinct_by_sketch(w):
    """Exact counts, and whether those from the written weekly sketches are within the bound."""
    path, columns = w.path("out/weekly_sketches"), ["order_id", "product_id"]
    raw = w("raw").select("year", "weeknum", *columns)
    eda.weekly_sketches(raw, F.col("year") * 100 + F.col("weeknum"), columns).write.mode("overwrite").parquet(path)
    sketches = w.spark.read.parquet(path)
    exact = raw.agg(*[F.count_distinct(c).alias(c) for c in columns])
    both = eda.sketched_counts(sketches, columns).join(exact).join(sketches.agg(F.count("week").alias("weeks")))
    near = lambda c: F.abs(F.col(f"approx_{c}") - F.col(c)) <= eda.BOUND * F.col(c)
    return both.select(
        "weeks",
        F.col("order_id").alias("distinct_orders"),
        near("order_id").alias("orders_within_bound"),
        F.col("product_id").alias("distinct_products"),
        near("product_id").alias("products_within_bound"),
    )


# Rows made bad by rule, the same in Spark and in SQL: no country, an unknown product, both.
_BAD_SQL = """SELECT * REPLACE (CASE WHEN date_week_id % 7 = 3 THEN NULL ELSE country_id END AS country_id,
 CASE WHEN date_week_id % 5 = 2 THEN 'unknown' ELSE product_id END AS product_id) FROM fact_shipments"""


def _bad(w):
    week = F.col("date_week_id")
    rows = w("fact_shipments").withColumns(
        {
            "country_id": F.when(week % 7 != 3, F.col("country_id")),
            "product_id": F.when(week % 5 == 2, F.lit("unknown")).otherwise(F.col("product_id")),
        }
    )
    return lambda name: rows if name == "fact_shipments" else w(name)


_SHIPMENT = f"{IDS} shipment_volume:d sell_in_revenue:d"


@query(
    "dq_05_offending_rows",
    f"{_SHIPMENT} broken:s",
    "SELECT *, concat_ws(', ', CASE WHEN country_id IS NULL THEN 'fact_shipments.country_id' END,"
    " CASE WHEN product_id NOT IN (SELECT product_id FROM dim_product) THEN 'fact_shipments.product_id -> dim_product' END) AS broken"
    f" FROM ({_BAD_SQL}) WHERE country_id IS NULL OR product_id NOT IN (SELECT product_id FROM dim_product)",
)
def offending_rows(w):
    _, bad = quality.quarantine(_bad(w), "fact_shipments", w.path("out/checked_shipments"))
    return bad.withColumn("broken", F.array_join("broken", ", "))


@query(
    "dq_06_accepted_rows",
    _SHIPMENT,
    f"SELECT * FROM ({_BAD_SQL}) WHERE country_id IS NOT NULL AND product_id IN (SELECT product_id FROM dim_product)",
)
def accepted_rows(w):
    sound, _ = quality.quarantine(_bad(w), "fact_shipments", w.path("out/accepted_shipments"))
    return sound


@query(
    "join_11_collated_names",
    "country_id:i names:i rows:i sales:d",
    "SELECT c.country_id, COUNT(DISTINCT name) AS names, COUNT(*) AS rows, SUM(sales) AS sales FROM"
    " (SELECT sales, CASE weeknum % 3 WHEN 0 THEN upper(country) WHEN 1 THEN lower(country) ELSE country END AS name FROM raw) r"
    " JOIN dim_country c ON lower(c.operating_country) = lower(r.name) GROUP BY 1",
)
def collated_names(w):
    """Lines whose country comes in several cases, joined to the one country that they mean."""
    week, name = F.col("weeknum") % 3, F.col("country")
    spelled = F.when(week == 0, F.upper(name)).when(week == 1, F.lower(name)).otherwise(name)
    lines = w("raw").select("sales", spelled.alias("name")).withColumn("key", caseless(F.col("name")))
    countries = w("dim_country").select("country_id", caseless(F.col("operating_country")).alias("key"))
    return lines.join(countries, "key").groupBy("country_id").agg(
        F.count_distinct("name").alias("names"), F.count(F.lit(1)).alias("rows"), F.sum("sales").alias("sales")
    )
