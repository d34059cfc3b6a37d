"""The six dimensions, built from the distinct attributes of the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrain.functions import calendar, labels
from weekgrain.functions.hashing import padded_hash
from weekgrain.operators.keys import dense_ids


def filled(name: str):
    """Neither null nor empty. Product ids are trimmed before; a country of blanks stays."""
    return F.col(name).isNotNull() & (F.col(name) != "")


def channels(base: DataFrame) -> DataFrame:
    return dense_ids(base.select("channel_name").distinct(), "channel_id", ["channel_name"])


def countries_loaded(base: DataFrame) -> DataFrame:
    """One row per country, the least market name where the raw lines disagree."""
    rows = (
        base.where(filled("country"))
        .select("country", "market", "market2")
        .distinct()
        .groupBy(F.col("country").alias("operating_country"))
        .agg(F.min("market").alias("macro_region"), F.min("market2").alias("macro_region_2"))
    )
    return dense_ids(rows, "country_id", ["operating_country"])


def countries(base: DataFrame) -> DataFrame:
    return countries_loaded(base).drop("macro_region_2")


def regions(base: DataFrame, countries: DataFrame) -> DataFrame:
    """Distinct places; tax and regulation are placeholders for a later source."""
    places = base.select(
        F.col("country").alias("operating_country"),
        F.col("region").alias("regulatory_region"),
        "state",
        "city",
    ).distinct()
    rows = places.join(countries, "operating_country").select(
        "operating_country", "country_id", "regulatory_region", "state", "city"
    )
    keyed = dense_ids(
        rows, "region_id", ["operating_country"], ["regulatory_region", "state"], ["city"]
    )
    return keyed.select(
        "region_id",
        "country_id",
        "regulatory_region",
        "state",
        "city",
        F.lit(None).cast("decimal(10,4)").alias("tax_proxy_rate"),
        F.lit(None).cast("string").alias("regulation_intensity"),
    )


def weeks(base: DataFrame) -> DataFrame:
    start = calendar.week_start(F.col("fiscal_year"), F.col("fiscal_week"))
    return (
        base.select("date_week_id", "fiscal_year", "fiscal_week")
        .dropna(subset=["fiscal_year", "fiscal_week"])
        .distinct()
        .withColumn("week_start_date", start)
        .select(
            "date_week_id",
            "fiscal_year",
            "fiscal_week",
            calendar.fiscal_quarter(F.col("fiscal_week")).alias("fiscal_quarter"),
            F.month("week_start_date").alias("month"),
            "week_start_date",
            calendar.week_end(F.col("week_start_date")).alias("week_end_date"),
        )
    )


def products_loaded(base: DataFrame) -> DataFrame:
    """One row per normalised product id with its source columns and made-up labels."""
    pid, category = F.col("product_id"), F.col("source_product_family")
    name = F.concat(
        labels.variant_prefix(category), F.lit("-VAR-"), padded_hash(pid, 999999, 6)
    )
    return (
        base.where(filled("product_id"))
        .select("product_id", "category", "sub_category")
        .distinct()
        .groupBy("product_id")
        .agg(
            F.min("category").alias("source_product_family"),
            F.min("sub_category").alias("source_product_category"),
        )
        .select(
            "product_id",
            name.alias("product_variant_name"),
            "source_product_family",
            "source_product_category",
            labels.product_family(category).alias("product_family"),
            labels.product_category(category).alias("product_category"),
            labels.brand_tier(pid).alias("brand_tier"),
            labels.pack_size(pid).alias("pack_size"),
            labels.nicotine_format(category).alias("nicotine_format"),
        )
    )


def products(base: DataFrame) -> DataFrame:
    return products_loaded(base).drop("source_product_family", "source_product_category")


def wholesalers(base: DataFrame, countries: DataFrame, channels: DataFrame) -> DataFrame:
    """One wholesaler per country and channel. Segments are mapped to channels before
    the distinct, so two segments of one channel do not make two wholesalers."""
    pairs = (
        base.select(F.col("country").alias("operating_country"), "channel_name")
        .distinct()
        .join(countries, "operating_country")
        .join(channels, "channel_name")
        .select("operating_country", "channel_name", "country_id", "channel_id")
    )
    keyed = dense_ids(pairs, "wholesaler_id", ["operating_country"], ["channel_name"])
    ids = F.concat_ws("|", "country_id", "channel_id")
    name = F.concat(
        F.lit("WH-"),
        "operating_country",
        F.lit("-"),
        "channel_name",
        F.lit("-"),
        padded_hash(ids, 9999, 4),
    )
    return keyed.select(
        "wholesaler_id",
        name.alias("wholesaler_name"),
        labels.wholesaler_tier(F.col("channel_name")).alias("wholesaler_tier"),
        "country_id",
        F.col("channel_id").alias("primary_channel_id"),
    )


def product_groups(products: DataFrame) -> DataFrame:
    """De-duplicated family / category / tier groups with a key."""
    columns = ["product_family", "product_category", "brand_tier"]
    return dense_ids(products.select(*columns).distinct(), "product_group_id", columns)
