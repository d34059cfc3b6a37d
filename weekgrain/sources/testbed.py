"""Raw order lines bound to the TPC-H-like test tables.

The engine reads one flat order-line table. The test tables hold none, so this view
supplies its 21 columns. Orders meet customers before they meet lines, so the widest
table is shuffled once on the order key. That join is a sort-merge join by hint: it spills,
skewed keys are split at run time, and a small test file does not end up with one task
doing all lines. The optimizer broadcasts the other tables only where their files are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrain.functions.labels import choose

# Fixed values of the binding: part type -> category, market segment -> segment.
CATEGORY_OF_TYPE = {
    "ECONOMY": "Office Supplies",
    "STANDARD": "Office Supplies",
    "LARGE": "Furniture",
    "MEDIUM": "Furniture",
    "PROMO": "Technology",
}
SEGMENT_OF_MARKET = {
    "AUTOMOBILE": "Consumer",
    "BUILDING": "Corporate",
    "FURNITURE": "Home Office",
}


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    def read(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    buyers = read("customer").select(
        "c_custkey",
        "c_nationkey",
        (F.col("c_custkey") % 2).cast("string").alias("half"),
        choose(F.col("c_mktsegment"), SEGMENT_OF_MARKET, F.col("c_mktsegment")).alias("segment"),
    )
    orders = (
        read("orders")
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "o_orderpriority", "c_nationkey", "half", "segment")
    )
    # Lines travel through the shuffles as they are stored; what follows from them is worked
    # out behind these, in narrower rows and more tasks. So are the names of places, two small
    # tables, and the texts of products.
    lines = read("lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"
    )
    parts = read("part").select("p_partkey", "p_name", "p_brand", "p_type")
    joined = (
        lines.hint("merge")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "*",
            F.concat("n_name", F.lit("-"), "half").alias("city"),
            F.col("p_name").alias("product_name"),
            F.col("p_brand").alias("sub_category"),
            choose(F.col("p_type"), CATEGORY_OF_TYPE, F.col("p_type")).alias("category"),
            F.concat(
                F.lit(" "), F.lower(F.concat_ws("-", "p_brand", "p_type")), F.lit(" ")
            ).alias("product_id"),
        )
    )
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    discount = (F.abs("l_discount").cast("decimal(5,4)") * 5).cast("decimal(10,4)")
    margin = F.lit("0.4").cast("decimal(2,1)") - F.col("discount")
    day = F.col("l_shipdate").cast("date")
    return joined.withColumns({"price": price, "discount": discount}).select(
        "category",
        "city",
        F.col("n_name").alias("country"),
        "discount",
        F.col("r_name").alias("market"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("o_orderpriority").alias("order_priority"),
        "product_id",
        "product_name",
        (F.col("price") * margin).cast("decimal(10,2)").alias("profit"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("r_name").alias("region"),
        (F.col("price") * (1 - F.col("discount"))).cast("decimal(10,2)").alias("sales"),
        "segment",
        F.lit(None).cast("string").alias("ship_mode"),
        F.lit(None).cast("decimal(10,2)").alias("shipping_cost"),
        F.col("n_name").alias("state"),
        "sub_category",
        F.year(day).alias("year"),
        F.col("r_name").alias("market2"),
        F.ceil(F.dayofyear(day) / 7).cast("int").alias("weeknum"),
    )
