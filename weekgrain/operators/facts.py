"""The weekly facts. Money and prices are decimals, so sums do not depend on order."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from weekgrain.functions import labels
from weekgrain.functions.hashing import hash_bucket

FACT_KEYS = [
    "date_week_id",
    "country_id",
    "region_id",
    "product_id",
    "wholesaler_id",
    "channel_id",
]
SERIES_KEYS = FACT_KEYS[1:]

# Competitor, its segment, its price level against our list price.
COMPETITORS = [
    ("Competitor A", "Value", "0.92"),
    ("Competitor B", "Mainstream", "0.97"),
    ("Competitor C", "Premium", "1.05"),
]


def narrow_sum(lines: DataFrame, name: str) -> Column:
    """F.sum of a column, of the same type. Decimals of up to ten digits are summed as whole
    numbers of their last place: eight bytes in the tables of sums that tasks hold and shuffle,
    not 32. A long has room for 900 million of the largest in one group; more fail, not wrap."""
    kind = lines.schema[name].dataType
    if not isinstance(kind, DecimalType) or kind.precision > 10:
        return F.sum(name)
    units = (F.col(name) * F.lit(10**kind.scale)).cast("long")
    whole = F.sum(units).cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-kind.scale))
    return whole.cast(DecimalType(kind.precision + 10, kind.scale))


def shipments(lines, countries, regions, channels, wholesalers) -> DataFrame:
    """Lines with natural keys swapped for ids, summed per week and series. Rows without a
    country or place drop out. Only six short ids and the sums leave a task, combined first; the
    look-back of unit_prices then lays out the facts, not the lines, by series."""
    keyed = (
        lines.join(
            countries.select("country_id", F.col("operating_country").alias("country")), "country"
        )
        .join(
            regions.select(
                "region_id", "country_id", F.col("regulatory_region").alias("region"), "state", "city"
            ),
            ["country_id", "region", "state", "city"],
        )
        .join(channels, "channel_name")
        .join(
            wholesalers.select(
                "wholesaler_id", "country_id", F.col("primary_channel_id").alias("channel_id")
            ),
            ["country_id", "channel_id"],
        )
    )
    discount = F.try_divide(narrow_sum(lines, "discount"), F.count("discount").cast("decimal(19,0)"))
    return keyed.groupBy(*FACT_KEYS).agg(
        F.sum("quantity").cast("decimal(18,2)").alias("shipment_volume"),
        narrow_sum(lines, "sales").cast("decimal(18,2)").alias("sell_in_revenue"),
        discount.cast("decimal(10,4)").alias("trade_incentive_pct"),
        narrow_sum(lines, "profit").cast("decimal(18,2)").alias("contribution_margin_proxy"),
    )


def priced_units(shipments: DataFrame) -> DataFrame:
    """Shipments plus net price at 6 decimals and list price."""
    net = F.col("sell_in_revenue") / F.nullif(F.col("shipment_volume"), F.lit(0).cast("decimal(18,2)"))
    kept = 1 - F.coalesce("trade_incentive_pct", F.lit(0).cast("decimal(10,4)"))
    return shipments.withColumn("net_price", net.cast("decimal(24,6)")).withColumn(
        "list_price", F.try_divide("net_price", kept).cast("decimal(18,4)")
    )


def unit_prices(shipments: DataFrame) -> DataFrame:
    """Shipments plus net price at 6 decimals, list price, and the net price of the last
    observed week. One series holds at most one row per week, so no window grows hot."""
    series = Window.partitionBy(*SERIES_KEYS).orderBy("date_week_id")
    return priced_units(shipments).withColumn("prev_net_price", F.lag("net_price").over(series))


def empty_state(shipments: DataFrame) -> DataFrame:
    """The state before the first load: no series."""
    return priced_units(shipments).where("false").select(*SERIES_KEYS, "date_week_id", "net_price")


def weekly_prices(week: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prices of one load of new weeks, as unit_prices gives them, and the state after it.

    state: the last observed week and net price of every series, from the load before. A load
    reads its own weeks and the state, never older weeks; loads come in order of weeks, and a
    load with weeks that the state has passed is refused by the caller (`check_order`). Series
    match by null-safe keys, as a window does."""
    new = priced_units(week)
    series = Window.partitionBy(*SERIES_KEYS).orderBy("date_week_id")
    last = state.select(*[F.col(k).alias(f"_{k}") for k in SERIES_KEYS], F.col("net_price").alias("_net"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in SERIES_KEYS])
    first = F.row_number().over(series) == 1
    prices = (
        new.withColumn("prev_net_price", F.lag("net_price").over(series))
        .withColumn("_first", first)
        .join(last, same, "left")
        .withColumn("prev_net_price", F.when(F.col("_first"), F.col("_net")).otherwise(F.col("prev_net_price")))
        .drop("_first", "_net", *[f"_{k}" for k in SERIES_KEYS])
    )
    both = state.unionByName(new.select(*SERIES_KEYS, "date_week_id", "net_price"))
    newest = F.max(F.struct("date_week_id", "net_price")).alias("top")
    after = both.groupBy(*SERIES_KEYS).agg(newest).select(*SERIES_KEYS, "top.*")
    return prices, after


def check_order(week: DataFrame, state: DataFrame) -> None:
    """Refuse a load with weeks that an earlier load has covered."""
    first, last = week.agg(F.min("date_week_id")).first()[0], state.agg(F.max("date_week_id")).first()[0]
    if first is not None and last is not None and first <= last:
        raise ValueError(f"week {first} comes after week {last} was loaded")


def key_accounts_id(channels: DataFrame) -> Column:
    """The id of the key account channel as a scalar subquery, run once per plan."""
    return channels.where(F.col("channel_name") == labels.KEY_ACCOUNTS).select("channel_id").scalar()


def price_columns(channels: DataFrame) -> dict[str, Column]:
    """Price fact columns over unit_prices joined with the product's brand tier."""
    is_key = F.col("channel_id") == key_accounts_id(channels)
    return {
        "net_invoice_price": F.col("net_price").cast("decimal(18,4)"),
        "price_change_flag": labels.price_change_flag(F.col("net_price"), F.col("prev_net_price")),
        "price_strategy": labels.price_strategy(F.col("brand_tier"), is_key),
    }


def trade_columns(channels: DataFrame) -> dict[str, Column]:
    """Trade fact columns over shipments joined with the product's brand tier."""
    is_key = F.col("channel_id") == key_accounts_id(channels)
    pct = F.coalesce("trade_incentive_pct", F.lit(0).cast("decimal(10,4)"))
    return {
        "incentive_type": labels.incentive_type(F.col("brand_tier"), is_key),
        "incentive_pct": pct,
        "incentive_amount": F.round(F.col("sell_in_revenue") * pct, 2).cast("decimal(18,2)"),
        "compliance_flag": labels.compliance_flag(pct),
    }


SHIPMENT_MEASURES = [
    "shipment_volume",
    "sell_in_revenue",
    "trade_incentive_pct",
    "contribution_margin_proxy",
]
PRICE_MEASURES = ["list_price", "net_invoice_price", "price_change_flag", "price_strategy"]
TRADE_MEASURES = ["incentive_type", "incentive_pct", "incentive_amount", "compliance_flag"]


def prices(shipments: DataFrame, products: DataFrame, channels: DataFrame) -> DataFrame:
    return (
        unit_prices(shipments)
        .join(products.select("product_id", "brand_tier"), "product_id")
        .withColumns(price_columns(channels))
        .select(*FACT_KEYS, *PRICE_MEASURES)
    )


def trade_incentives(shipments: DataFrame, products: DataFrame, channels: DataFrame) -> DataFrame:
    return (
        shipments.join(products.select("product_id", "brand_tier"), "product_id")
        .withColumns(trade_columns(channels))
        .select(*FACT_KEYS, *TRADE_MEASURES)
    )


def noise_text(competitor: Column) -> Column:
    """What the noise hashes: product, country, week and competitor."""
    return F.concat_ws("|", "product_id", "country_id", "date_week_id", competitor)


def noise(competitor: Column, level: str = "1") -> Column:
    """One of seven factors, 0.97 to 1.03 times the price level, chosen by a hash. The products
    are worked out here, so a row looks its factor up. Reads product_id, country_id and
    date_week_id."""
    text = noise_text(competitor)
    factors = [Decimal(level) * (97 + step) / 100 for step in range(7)]
    table = F.array(*[F.lit(str(f)).cast("decimal(6,4)") for f in factors])
    return F.element_at(table, (hash_bucket(text, 7) + 1).cast("int"))


def competitor_price(list_price: Column, factor: Column) -> Column:
    """To 4 decimals, half up; all factors are exact decimals."""
    return F.round(list_price * factor, 4).cast("decimal(18,4)")


def competitor_literals(spark) -> DataFrame:
    rows = [f"('{name}', '{family}', CAST({level} AS DECIMAL(4,2)))" for name, family, level in COMPETITORS]
    return spark.sql(
        "SELECT * FROM VALUES "
        + ", ".join(rows)
        + " AS t(competitor_name, competitor_product_family, base_multiplier)"
    )


def competitor_structs() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("competitor_name"),
                F.lit(family).alias("competitor_product_family"),
                F.lit(level).cast("decimal(4,2)").alias("base_multiplier"),
            )
            for name, family, level in COMPETITORS
        ]
    )


def priced(prices: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Price rows that get competitors: a known product and a positive list price. Without
    `products` the rows are taken to have known products, as the staged price fact has: that
    saves a shuffle on the product, where one product may hold much of the fact."""
    positive = prices.where(F.col("list_price") > 0)
    if products is None:
        return positive
    return positive.join(products.select("product_id"), "product_id", "left_semi")


def competitor_prices(prices: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Every price row once per competitor. The fixed list of competitors is unfolded
    from a literal array inside the row, without a join."""
    return (
        priced(prices, products)
        .select("*", F.inline(competitor_structs()))
        .select(
            "date_week_id",
            "country_id",
            "region_id",
            "channel_id",
            "competitor_name",
            "competitor_product_family",
            competitor_price(
                F.col("list_price"), F.col("base_multiplier") * noise(F.col("competitor_name"))
            ).alias("competitor_price"),
        )
    )


MARKET_KEYS = ["date_week_id", "country_id", "region_id", "channel_id"]
# The same product in the same cell.
LIKE_KEYS = [*MARKET_KEYS, "product_id"]


def competitor_means(
    prices: DataFrame, products: DataFrame | None = None, keys: list[str] = MARKET_KEYS
) -> DataFrame:
    """Mean competitor price per week, country, region and channel, or other keys: overall and per
    competitor. Taken straight from the price rows, so the threefold competitor fact is
    never laid out; sums are combined map-side before the one shuffle."""
    per = {
        f"price_{i}": competitor_price(F.col("list_price"), noise(F.lit(name), level))
        for i, (name, _, level) in enumerate(COMPETITORS)
    }
    wide = priced(prices, products).select(*keys, *[c.alias(n) for n, c in per.items()])
    n = F.count(F.lit(1))
    everything = sum((F.col(c) for c in list(per)[1:]), F.col(list(per)[0]))
    return wide.groupBy(*keys).agg(
        (F.sum(everything).cast("double") / (n * len(per))).alias("avg_comp_price"),
        *[(F.sum(c).cast("double") / n).alias(f"avg_{c}") for c in per],
    )


def competitor_benchmark(competitor_fact: DataFrame) -> DataFrame:
    """The same overall mean from a stored competitor fact."""
    n = F.count("competitor_price")
    return competitor_fact.groupBy(*MARKET_KEYS).agg(
        F.try_divide(F.sum("competitor_price").cast("double"), n).alias("avg_comp_price")
    )
