"""The wide analytics table: facts and dimensions side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrain.functions.labels import brand_tier
from weekgrain.functions.ratios import guarded_ratio
from weekgrain.operators.dims import filled
from weekgrain.operators.facts import (
    FACT_KEYS,
    PRICE_MEASURES,
    TRADE_MEASURES,
    price_columns,
    trade_columns,
    unit_prices,
)

# Measures that become doubles for consumers without decimals.
NUMERIC = [
    "shipment_volume",
    "sell_in_revenue",
    "net_unit_price",
    "list_unit_price",
    "discount_rate",
    "trade_spend_amount",
    "price_realization_pct",
    "revenue_net_of_trade",
]


def join_facts(shipments: DataFrame, prices: DataFrame, trade: DataFrame) -> DataFrame:
    """Shipments with separately stored price and trade facts, left joins on all six keys."""
    return shipments.join(prices.select(*FACT_KEYS, *PRICE_MEASURES), FACT_KEYS, "left").join(
        trade.select(*FACT_KEYS, *TRADE_MEASURES), FACT_KEYS, "left"
    )


def enrich_facts(shipments: DataFrame, channels: DataFrame) -> DataFrame:
    """What join_facts gives, straight from shipments. Price and trade rows are functions of a
    shipment row and its predecessor, so the window's one layout replaces three fact-sized
    shuffles. The brand tier is a function of the product id; rows
    without a product id have no price or trade row and get nulls."""
    known = filled("product_id")
    measures = {
        **price_columns(channels),
        **trade_columns(channels),
        "list_price": F.col("list_price"),
    }
    return (
        unit_prices(shipments)
        .withColumn("brand_tier", brand_tier(F.col("product_id")))
        .withColumns({name: F.when(known, column) for name, column in measures.items()})
        .select(*shipments.columns, *PRICE_MEASURES, *TRADE_MEASURES)
    )


def add_dimensions(facts, products, countries, channels, weeks, wholesalers) -> DataFrame:
    """Readable fields by left joins; the optimizer broadcasts what is small on disk.
    The wholesaler's own country_id is left out, so no name appears twice."""
    return (
        facts.join(products, "product_id", "left")
        .join(countries, "country_id", "left")
        .join(channels, "channel_id", "left")
        .join(weeks, "date_week_id", "left")
        .join(wholesalers.drop("country_id"), "wholesaler_id", "left")
    )


def add_measures(wide: DataFrame) -> DataFrame:
    """Unit prices and realization as double, money as exact decimal. Revenue is already
    after discount, yet trade spend is taken off it again: that is the defined measure."""
    return wide.withColumns(
        {
            "net_unit_price": F.col("net_invoice_price").cast("double"),
            "list_unit_price": F.col("list_price").cast("double"),
            "discount_rate": F.col("incentive_pct").cast("double"),
            "trade_spend_amount": F.col("incentive_amount"),
            "price_realization_pct": guarded_ratio(
                F.col("net_invoice_price"), F.col("list_price")
            ),
            "revenue_net_of_trade": F.col("sell_in_revenue") - F.col("incentive_amount"),
        }
    )


def wide_table(facts, products, countries, channels, weeks, wholesalers) -> DataFrame:
    return add_measures(add_dimensions(facts, products, countries, channels, weeks, wholesalers))


def as_numeric(df: DataFrame, names: list[str] = NUMERIC) -> DataFrame:
    """The named columns that exist, as double; text that is no number becomes null."""
    have = [c for c in names if c in df.columns]
    return df.withColumns({c: F.col(c).try_cast("double") for c in have})
