"""Data-quality reports in place of enforced constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Child table, child column, parent table, parent column.
FOREIGN_KEYS = [
    ("dim_region", "country_id", "dim_country", "country_id"),
    ("dim_wholesaler", "country_id", "dim_country", "country_id"),
    ("dim_wholesaler", "primary_channel_id", "dim_channel", "channel_id"),
    ("fact_shipments", "date_week_id", "dim_date_week", "date_week_id"),
    ("fact_shipments", "country_id", "dim_country", "country_id"),
    ("fact_shipments", "region_id", "dim_region", "region_id"),
    ("fact_shipments", "product_id", "dim_product", "product_id"),
    ("fact_shipments", "wholesaler_id", "dim_wholesaler", "wholesaler_id"),
    ("fact_shipments", "channel_id", "dim_channel", "channel_id"),
]

# Table and the columns that identify a row.
UNIQUE_KEYS = [
    ("dim_channel", ["channel_name"]),
    ("dim_country", ["operating_country"]),
    ("dim_region", ["country_id", "regulatory_region", "state", "city"]),
    ("dim_wholesaler", ["country_id", "primary_channel_id", "wholesaler_name"]),
    ("dim_date_week", ["date_week_id"]),
    ("dim_product", ["product_id"]),
]

# Columns that must be filled, by table.
_FACT = ["date_week_id", "country_id", "region_id", "product_id", "wholesaler_id", "channel_id"]
NOT_NULL = {
    "dim_channel": ["channel_name"],
    "dim_country": ["operating_country"],
    "dim_region": ["country_id"],
    "dim_date_week": ["fiscal_year", "fiscal_week"],
    "dim_product": ["product_variant_name"],
    "dim_wholesaler": ["wholesaler_name", "country_id", "primary_channel_id"],
    "fact_shipments": [*_FACT, "shipment_volume", "sell_in_revenue"],
    "fact_price": _FACT,
    "fact_trade": [*_FACT, "incentive_type"],
    "fact_competitor": [
        "date_week_id",
        "country_id",
        "region_id",
        "channel_id",
        "competitor_name",
        "competitor_product_family",
    ],
}


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def foreign_key_report(tables) -> DataFrame:
    """Orphan rows per constraint. Child keys are counted first, map-side, so the join sees
    each key once, however hot it is; a null key is no violation. It is an outer join with a
    mark: the optimizer would push an anti-join back below the counting."""

    def check(child, column, parent, target):
        keys = tables(child).groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        known = tables(parent).select(F.col(target).alias("key"), F.lit(1).alias("known"))
        matched = keys.where(F.col("key").isNotNull()).join(known, "key", "left")
        orphans = matched.where(F.col("known").isNull())
        return orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
            F.lit(f"{child}.{column} -> {parent}").alias("check_name"), "violations"
        )

    return _union([check(*rule) for rule in FOREIGN_KEYS])


def unique_key_report(tables) -> DataFrame:
    """Keys that occur more than once; a key with a null part does not count."""

    def check(table, columns):
        repeated = (
            tables(table)
            .dropna(subset=columns)
            .groupBy(*columns)
            .agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1)
        )
        return repeated.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(f"{table}({', '.join(columns)})").alias("check_name"), "violations"
        )

    return _union([check(*rule) for rule in UNIQUE_KEYS])


def not_null_report(tables) -> DataFrame:
    """Nulls per required column, one pass per table."""

    def check(table, columns):
        counts = tables(table).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        return counts.unpivot([], columns, "column", "violations").select(
            F.concat(F.lit(f"{table}."), "column").alias("check_name"), "violations"
        )

    return _union([check(table, columns) for table, columns in NOT_NULL.items()])


def tagged(tables, name: str) -> DataFrame:
    """All rows of a table with the names of the rules that each breaks: column broken, empty for a
    sound row. The table is scanned once. A null key breaks no foreign or unique key; of rows
    that share a key every one breaks it. Parents are distinct keys, which the optimizer
    broadcasts while they are small; hot child keys are split at run time."""
    rows, broken = tables(name), []
    for column in NOT_NULL.get(name, []):
        broken.append(F.when(F.col(column).isNull(), f"{name}.{column}"))
    for i, (child, column, parent, target) in enumerate(FOREIGN_KEYS):
        if child == name:
            keys = tables(parent).select(F.col(target).alias(f"_key_{i}")).distinct()
            rows = rows.join(keys, F.col(column) == F.col(f"_key_{i}"), "left")
            orphan = F.col(column).isNotNull() & F.col(f"_key_{i}").isNull()
            broken.append(F.when(orphan, f"{name}.{column} -> {parent}"))
    for table, columns in UNIQUE_KEYS:
        if table == name:
            same = F.count(F.lit(1)).over(Window.partitionBy(*columns))
            rows = rows.withColumn("_same", same)
            whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
            broken.append(F.when(whole & (F.col("_same") > 1), f"{name}({', '.join(columns)})"))
    listed = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    return rows.select(*tables(name).columns, listed.alias("broken"))


def quarantine(tables, name: str, path: str) -> tuple[DataFrame, DataFrame]:
    """The accepted and the quarantined rows of a table, the latter with the rules that they
    break. Both are written in one pass, and together they are the table."""
    sound = F.size("broken") == 0
    tagged(tables, name).withColumn("sound", sound).write.mode("overwrite").partitionBy("sound").parquet(path)
    spark = tables(name).sparkSession
    # Either kind may have no rows, and then no folder to tell the schema from.
    schema = tagged(tables, name).withColumn("sound", sound).schema
    written = spark.read.schema(schema).option("basePath", path).parquet(path)
    return written.where("sound").drop("broken", "sound"), written.where("not sound").drop("sound")


def row_counts(tables, names: list[str]) -> DataFrame:
    return _union(
        [
            tables(n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows")
            for n in names
        ]
    )
