"""The raw lines as the star schema reads them, and the attributes that they hold.

Lines are projected, never laid out by a key: dimensions come from the distinct attributes, which
are combined map-side to tables of their own, and the facts join those to the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrain.functions.calendar import week_key
from weekgrain.functions.labels import channel_of
from weekgrain.functions.text import normal_id

PLACE = ["country", "region", "state", "city"]
MARKET = ["market", "market2"]
PRODUCT = ["stored_product_id", "product_id", "category", "sub_category"]
WEEK = ["date_week_id", "fiscal_year", "fiscal_week"]
MEASURES = ["quantity", "sales", "discount", "profit"]


def lines(raw: DataFrame) -> DataFrame:
    """Raw lines with normal ids, channel and week; a projection only, null keys stay."""
    return raw.select(
        F.col("year").alias("fiscal_year"),
        F.col("weeknum").alias("fiscal_week"),
        week_key(F.col("year"), F.col("weeknum")).alias("date_week_id"),
        *PLACE,
        *MARKET,
        F.col("product_id").alias("stored_product_id"),
        normal_id(F.col("product_id")).alias("product_id"),
        "category",
        "sub_category",
        channel_of(F.col("segment")).alias("channel_name"),
        *MEASURES,
    )


def places(raw: DataFrame) -> DataFrame:
    """Distinct places, markets and channels."""
    return places_of(lines(raw))


def products(raw: DataFrame) -> DataFrame:
    """Distinct products, ids as stored and as compared, with their categories."""
    return products_of(lines(raw))


def weeks(raw: DataFrame) -> DataFrame:
    return weeks_of(lines(raw))


def places_of(lines: DataFrame) -> DataFrame:
    return lines.select(*PLACE, *MARKET, "channel_name").distinct()


def products_of(lines: DataFrame) -> DataFrame:
    return lines.select(*PRODUCT).distinct()


def weeks_of(lines: DataFrame) -> DataFrame:
    return lines.select(*WEEK).distinct()
