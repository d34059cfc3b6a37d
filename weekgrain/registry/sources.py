"""Queries over scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekgrain.operators import facts
from weekgrain.registry.core import query
from weekgrain.sources.infer import profile
from weekgrain.sources.readers import csv_texts, read_csv, read_order_lines, read_preferred, read_snapshot
from weekgrain.sources.schemas import RAW_FILE_COLUMNS, snake
from weekgrain.sources.sinks import write_csv, write_snapshot
from weekgrain.sources.versions import VersionedTable

RAW = (
    "category:s city:s country:s discount:d market:s order_id:s order_priority:s product_id:s"
    " product_name:s profit:d quantity:i region:s sales:d segment:s ship_mode:s shipping_cost:d"
    " state:s sub_category:s year:i market2:s weeknum:i"
)
IDS = "date_week_id:i country_id:i region_id:i product_id:s wholesaler_id:i channel_id:i"
SHIPMENT = (
    f"{IDS} shipment_volume:d sell_in_revenue:d trade_incentive_pct:d contribution_margin_proxy:d"
)
KPI = (
    "date_week_id:i fiscal_year:i fiscal_week:i fiscal_quarter:i month:i operating_country:s"
    " channel_name:s product_family:s product_category:s brand_tier:s wholesaler_tier:s"
    " shipments_units:d gross_revenue:d trade_spend:d trade_spend_pct:d"
    " net_revenue_after_trade:d avg_list_price:d avg_net_price:d price_realization:d"
    " avg_contribution_margin_proxy:r9"
)


def _lines(w, path, header_start):
    lines = w.spark.read.text(path).withColumnRenamed("value", "line")
    return lines.where(~F.col("line").startswith(header_start))


def _by_year(w):
    return w("fact_shipments").withColumn("fiscal_year", F.floor(F.col("date_week_id") / 100).cast("int"))


# Text that needs care in a CSV: quotes, separators, outer blanks. The same in Spark and in SQL.
def _awkward(name):
    return F.concat(F.lit('  "'), F.col(name), F.lit('", 46" x 60" '))


def _awkward_sql(name):
    return f"""('  "' || {name} || '", 46" x 60" ')"""


@query("src_01_raw_scan", RAW, f"SELECT * REPLACE ({_awkward_sql('product_name')} AS product_name) FROM raw")
def raw_scan(w):
    path = w.path("out/raw_csv")
    names = {snake(n): n for n in RAW_FILE_COLUMNS}
    rows = w("raw").withColumn("product_name", _awkward("product_name")).select(*names)
    write_csv(rows.withColumnsRenamed(names), path)
    return read_order_lines(w.spark, path, "csv")


# Line breaks, alone and beside quotes, in cells that files of any size are split through.
_BROKEN_SQL = """product_name || chr(10) || '"a' || chr(10) || chr(10) || 'b" ' || product_id"""


@query("src_01_line_breaks", RAW, f"SELECT * REPLACE ({_BROKEN_SQL} AS product_name) FROM raw")
def line_breaks(w):
    path = w.path("out/raw_broken_csv")
    names = {snake(n): n for n in RAW_FILE_COLUMNS}
    text = F.concat("product_name", F.lit('\n"a\n\nb" '), "product_id")
    write_csv(w("raw").withColumn("product_name", text).select(*names).withColumnsRenamed(names), path)
    return read_order_lines(w.spark, path, "csv", line_breaks=True)


@query("src_02_table_scan", SHIPMENT, "SELECT * FROM fact_shipments")
def table_scan(w):
    return w("fact_shipments")


@query(
    "src_03_snapshot_write",
    "fiscal_year:i rows:i revenue:d",
    "SELECT date_week_id // 100 AS fiscal_year, COUNT(*) AS rows, SUM(sell_in_revenue) AS revenue"
    " FROM fact_shipments GROUP BY 1",
)
def snapshot_write(w):
    path = w.path("out/shipments_by_year")
    write_snapshot(_by_year(w), path, partition_by=["fiscal_year"])
    return (
        w.spark.read.parquet(path)
        .groupBy("fiscal_year")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("sell_in_revenue").alias("revenue"))
    )


@query(
    "src_04_snapshot_read",
    "wholesaler_id:i wholesaler_name:s wholesaler_tier:s country_id:i primary_channel_id:i",
    "SELECT * FROM dim_wholesaler",
)
def snapshot_read(w):
    w("dim_wholesaler")
    return read_snapshot(w.spark, w.path("dim_wholesaler"))


@query(
    "src_05_csv_write_quoted",
    "line:s",
    f"""SELECT CAST(wholesaler_id AS VARCHAR) || ',"' || replace({_awkward_sql('wholesaler_name')}, '"', '""') || '","'
       || wholesaler_tier || '",' || CAST(country_id AS VARCHAR) || ',' || CAST(primary_channel_id AS VARCHAR) AS line
       FROM dim_wholesaler""",
)
def csv_write_quoted(w):
    path = w.path("out/wholesalers_quoted")
    write_csv(w("dim_wholesaler").withColumn("wholesaler_name", _awkward("wholesaler_name")), path, quote_text=True)
    return _lines(w, path, '"wholesaler_id"')


@query(
    "src_06_csv_write_minimal",
    "line:s",
    f"""SELECT CAST(region_id AS VARCHAR) || ',' || CAST(country_id AS VARCHAR) || ',' || regulatory_region || ',"'
       || replace({_awkward_sql('state')}, '"', '""') || '",  ' || city || ' ,NA,NA' AS line FROM dim_region""",
)
def csv_write_minimal(w):
    path = w.path("out/regions")
    blanks = F.concat(F.lit("  "), F.col("city"), F.lit(" "))
    write_csv(w("dim_region").withColumns({"state": _awkward("state"), "city": blanks}), path)
    return _lines(w, path, "region_id")


@query("src_07_csv_read", KPI, f"SELECT * REPLACE ({_awkward_sql('channel_name')} AS channel_name) FROM kpi")
def csv_read(w):
    path = w.path("out/kpi_csv")
    write_csv(w("kpi").withColumn("channel_name", _awkward("channel_name")), path)
    return read_csv(w.spark, path)


@query(
    "src_07_inferred_types",
    "column:s type:s filled:i",
    "SELECT * FROM (VALUES ('date_week_id', 'int'), ('operating_country', 'string'), ('channel_name', 'string'),"
    " ('code', 'string'), ('mixed', 'string'), ('start', 'date'), ('revenue', 'decimal(18,2)')) t(\"column\", type)"
    " CROSS JOIN (SELECT COUNT(*) AS filled FROM kpi)",
)
def inferred_types(w):
    """Types told from files: among them codes with leading zeros and a column that holds one
    text only among its numbers."""
    path = w.path("out/typed_csv")
    last = w("kpi").agg(F.max("date_week_id")).scalar()
    rows = w("kpi").select(
        "date_week_id",
        "operating_country",
        "channel_name",
        F.lpad(F.col("fiscal_week").cast("string"), 4, "0").alias("code"),
        F.when(F.col("date_week_id") == last, F.lit("n/a")).otherwise(F.col("fiscal_week").cast("string")).alias("mixed"),
        F.make_date("fiscal_year", F.lit(1), F.lit(31)).alias("start"),
        (F.lit(1_000_000_000) + F.col("gross_revenue")).cast("decimal(18,2)").alias("revenue"),
    )
    write_csv(rows, path)
    filled = w.spark.read.parquet(w.path("kpi")).agg(F.count(F.lit(1))).scalar()
    return profile(csv_texts(w.spark, path)).where("null_share = 0").withColumn("filled", filled)


@query(
    "src_08_fallback_read",
    "wholesaler_id:i wholesaler_name:s wholesaler_tier:s country_id:i primary_channel_id:i",
    f"SELECT * REPLACE ({_awkward_sql('wholesaler_name')} AS wholesaler_name) FROM dim_wholesaler",
)
def fallback_read(w):
    sellers = w("dim_wholesaler").withColumn("wholesaler_name", _awkward("wholesaler_name"))
    path = w.path("out/wholesalers_csv")
    write_csv(sellers, path, quote_text=True)
    return read_preferred(w.spark, w.path("out/no_such_snapshot"), path, sellers.schema)


@query("src_09_table_load", SHIPMENT, "SELECT * FROM fact_shipments")
def table_load(w):
    path = w.path("out/loaded_shipments")
    loaded = facts.shipments(
        w("raw_lines"), w("dim_country"), w("dim_region"), w("dim_channel"), w("dim_wholesaler")
    )
    write_snapshot(loaded, path)
    return w.spark.read.parquet(path)


@query(
    "src_10_full_refresh",
    "fiscal_year:i rows:i revenue:d",
    "SELECT date_week_id // 100 AS fiscal_year, COUNT(*) AS rows, SUM(sell_in_revenue) AS revenue"
    " FROM fact_shipments GROUP BY 1",
)
def full_refresh(w):
    table = VersionedTable(w.spark, w.path("out/refreshed"), part="fiscal_year")
    shipments = _by_year(w)
    for _ in range(2):  # the second load replaces the first
        table.replace(shipments)
    table.replace_parts(shipments.where(F.col("fiscal_year") == 1998))
    return (
        table.read()
        .groupBy("fiscal_year")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("sell_in_revenue").alias("revenue"))
    )


@query(
    "src_11_inline_literals",
    "competitor_name:s competitor_product_family:s base_multiplier:d rows:i",
    "SELECT competitor_name, competitor_product_family, base_multiplier, COUNT(*) AS rows"
    " FROM competitor_rows GROUP BY ALL",
)
def inline_literals(w):
    literals = facts.competitor_literals(w.spark)
    counts = w("fact_competitor").groupBy("competitor_name").agg(F.count(F.lit(1)).alias("rows"))
    return literals.join(counts, "competitor_name")


