"""Summaries of data health, pricing, trade and competition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekgrain.functions.ratios import distinct_with_null, guarded_ratio, missing, safe_div, total
from weekgrain.operators.facts import COMPETITORS, MARKET_KEYS
from weekgrain.operators.quantiles import exact_quantiles, grouped_quantiles


def _beside(frames: list[DataFrame]) -> DataFrame:
    """One-row results side by side, each column taken from the row that has it."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def raw_profile(raw: DataFrame, products: DataFrame) -> DataFrame:
    """Rows, distinct orders and products, year and week range, in one pass over the lines.
    products: the distinct product attributes of the same lines, with ids as stored."""
    return _beside(
        [
            raw.agg(
                F.count(F.lit(1)).alias("row_count"),
                F.count_distinct("order_id").alias("distinct_orders"),
                F.min("year").alias("min_year"),
                F.max("year").alias("max_year"),
                F.min("weeknum").alias("min_weeknum"),
                F.max("weeknum").alias("max_weeknum"),
            ),
            products.agg(F.count_distinct("stored_product_id").alias("distinct_products")),
        ]
    )


HEALTH_DISTINCT = {
    "weeks": "date_week_id",
    "countries": "operating_country",
    "products": "product_id",
    "channels": "channel_id",
    "wholesalers": "wholesaler_id",
}


def health(wide: DataFrame) -> DataFrame:
    """Row, distinct and missing counts; a null counts as one distinct value. One pass groups
    by the keys of few values, combined map-side, and the counts are taken from the groups; a
    second pass reads the products."""
    few = {name: c for name, c in HEALTH_DISTINCT.items() if c != "product_id"}
    groups = wide.groupBy(*few.values()).agg(
        F.count(F.lit(1)).alias("rows"),
        missing(F.col("net_unit_price")).alias("missing_net_price"),
        missing(F.col("list_unit_price")).alias("missing_list_price"),
        missing(F.col("trade_spend_amount")).alias("missing_trade"),
    )
    added = ("rows", "missing_net_price", "missing_list_price", "missing_trade")
    counts = groups.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in added],
        *[distinct_with_null(F.col(c)).alias(name) for name, c in few.items()],
    )
    return _beside([counts, wide.agg(distinct_with_null(F.col("product_id")).alias("products"))])


def missing_counts(wide: DataFrame) -> DataFrame:
    return wide.agg(
        missing(F.col("net_unit_price")).alias("missing_net_price"),
        missing(F.col("list_unit_price")).alias("missing_list_price"),
    )


def pricing(wide: DataFrame) -> DataFrame:
    """Net unit price above zero: mean, median, p10, p90, maximum."""
    return exact_quantiles(
        wide.where(F.col("net_unit_price") > 0),
        "net_unit_price",
        {"median_net_price": 0.5, "p10_net_price": 0.1, "p90_net_price": 0.9},
        extra={
            "avg_net_price": safe_div(F.sum("net_invoice_price"), F.count("net_invoice_price")),
            "max_net_price": F.max("net_unit_price"),
        },
    )


def trade(wide: DataFrame) -> DataFrame:
    spend = F.col("trade_spend_amount")
    return wide.agg(
        total(spend).alias("total_trade_spend"),
        safe_div(F.sum(spend), F.count(spend)).alias("avg_trade_spend"),
        safe_div(total(spend), total(F.col("sell_in_revenue"))).alias("trade_spend_pct_of_revenue"),
    )


def trade_by_type(wide: DataFrame) -> DataFrame:
    return (
        wide.groupBy("incentive_type")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            total(F.col("trade_spend_amount")).alias("total_trade_spend"),
        )
        .orderBy(F.desc_nulls_last("total_trade_spend"), F.asc_nulls_last("incentive_type"))
    )


def rows_by_type(trade: DataFrame) -> DataFrame:
    """Trade rows per incentive type, most first; ties by name."""
    counts = trade.groupBy("incentive_type").agg(F.count(F.lit(1)).alias("rows_cnt"))
    return counts.orderBy(F.desc_nulls_last("rows_cnt"), F.asc_nulls_last("incentive_type"))


def compliance(wide: DataFrame) -> DataFrame:
    return wide.where(F.col("compliance_flag").isNotNull()).agg(
        F.avg("compliance_flag").alias("compliance_rate"),
        F.count(F.lit(1)).alias("rows_with_flag"),
    )


def price_index(wide: DataFrame, benchmark: DataFrame, by: list[str] = MARKET_KEYS) -> DataFrame:
    """Own list price over the mean competitor price of the same week, country, region and
    channel, over all products there; with LIKE_KEYS over the same product only. Keys match null
    to null."""
    keys = benchmark.select(
        *[F.col(c).alias(f"_bench_{c}") for c in by],
        *[c for c in benchmark.columns if c not in by],
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_bench_{c}")) for c in by])
    ours, theirs = F.col("list_unit_price"), F.col("avg_comp_price")
    return (
        wide.join(keys, same, "left")
        .drop(*[f"_bench_{c}" for c in by])
        .withColumn(
            "price_index_vs_comp", F.when((ours > 0) & (theirs > 0), guarded_ratio(ours, theirs))
        )
    )


def price_index_summary(indexed: DataFrame) -> DataFrame:
    return exact_quantiles(
        indexed,
        "price_index_vs_comp",
        {"p10_price_index": 0.1, "p90_price_index": 0.9},
        extra={"avg_price_index": F.avg("price_index_vs_comp")},
    )


def index_by_competitor(indexed: DataFrame) -> DataFrame:
    """Mean index per competitor and channel. The per-competitor means ride along as columns
    of one join and are unpivoted after the aggregation."""
    ours = F.col("list_unit_price")
    aggs, stack = [], []
    for i, (name, _, _) in enumerate(COMPETITORS):
        theirs = F.col(f"avg_price_{i}")
        index = F.when((ours > 0) & (theirs > 0), ours / theirs)
        aggs += [F.avg(index).alias(f"index_{i}"), F.count(index).alias(f"rows_{i}")]
        stack.append(f"'{name}', index_{i}, rows_{i}")
    return indexed.groupBy("channel_name").agg(*aggs).selectExpr(
        "channel_name",
        f"stack({len(stack)}, {', '.join(stack)}) AS (competitor_name, avg_price_index, rows)",
    )


def price_quantiles(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Exact p10, median and p90 of the net unit price above zero for every group."""
    return grouped_quantiles(
        wide.where(F.col("net_unit_price") > 0),
        keys,
        "net_unit_price",
        {"p10_net_price": 0.1, "median_net_price": 0.5, "p90_net_price": 0.9},
    )


# Registers of a distinct sketch, as a power of two: its error is 1.04 / sqrt(2 ** BITS) in one
# of three cases, and three times that bounds all but one in four hundred.
BITS = 14
BOUND = 3 * 1.04 / 2 ** (BITS / 2)


def weekly_sketches(raw: DataFrame, week: Column, columns: list[str]) -> DataFrame:
    """week and a mergeable distinct sketch per column: one row a week, kept from load to load."""
    return raw.groupBy(week.alias("week")).agg(*[F.hll_sketch_agg(F.col(c), BITS).alias(c) for c in columns])


def sketched_counts(sketches: DataFrame, columns: list[str]) -> DataFrame:
    """approx_ distinct counts over any set of weeks, from their sketches alone."""
    return sketches.agg(
        *[F.hll_sketch_estimate(F.hll_union_agg(F.col(c))).alias(f"approx_{c}") for c in columns]
    )
