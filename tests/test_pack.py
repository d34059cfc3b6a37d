"""The whole run over a raw order file."""

import re

import pytest
from helpers import raw
from pyspark.sql import functions as F

from weekgrain.plans import charts, eda
from weekgrain.plans.pack import REPORTS, write_all
from weekgrain.plans.warehouse import Warehouse
from weekgrain.sources.readers import read_order_lines
from weekgrain.sources.schemas import RAW_FILE_COLUMNS, snake
from weekgrain.sources.sinks import write_csv


def test_run_from_a_raw_file(spark, tmp_path):
    lines = raw(
        spark,
        *[
            {"weeknum": w, "segment": s, "product_id": p, "category": c, "quantity": w + 1}
            for w in (1, 2, 3, 4, 5)
            for s in ("Consumer", "Corporate", "Home Office")
            for p, c in (("A1", "Furniture"), ("B2", "Technology"), ("C3", "Office Supplies"))
        ],
    )
    source, out = str(tmp_path / "orders"), str(tmp_path / "out")
    lines.withColumnsRenamed({snake(n): n for n in RAW_FILE_COLUMNS}).write.parquet(source)
    tables = Warehouse(spark, read_order_lines(spark, source), f"{out}/staged")
    write_all(tables, out)
    assert spark.read.parquet(f"{out}/fact_shipments").count() == 45
    assert spark.read.parquet(f"{out}/fact_competitor").count() == 135
    for name in REPORTS:
        assert spark.read.option("header", True).csv(f"{out}/{name}").columns, name


def test_run_from_a_raw_csv_file_with_awkward_names(spark, tmp_path):
    names = ['Tenex 46" x 60" Chairmat, Clear', "  blanks  ", "back\\slash", "", None, 'a,"b"', "plain"]
    lines = raw(spark, *[{"product_name": n, "product_id": f"P{i}", "quantity": 3} for i, n in enumerate(names)])
    source = str(tmp_path / "orders")
    write_csv(lines.withColumnsRenamed({snake(n): n for n in RAW_FILE_COLUMNS}), source)
    back = read_order_lines(spark, source, "csv")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, lines.collect()))
    tables = Warehouse(spark, back, str(tmp_path / "staged"))
    assert tables("fact_shipments").agg(F.sum("shipment_volume")).first()[0] == 3 * len(names)


def test_malformed_lines_are_refused(spark, tmp_path):
    header = ",".join(RAW_FILE_COLUMNS)
    (tmp_path / "o.csv").write_text(f"{header}\nFurniture,Paris,France\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ|Malformed"):
        read_order_lines(spark, str(tmp_path / "o.csv"), "csv").collect()


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_few_passes(spark, tables):
    wide = tables("wide")
    flat = str(tables.path("raw_flat"))
    tables("raw").write.mode("overwrite").parquet(flat)
    assert scans(eda.raw_profile(spark.read.parquet(flat), tables("raw_products"))) == 2  # lines, products
    assert scans(eda.health(wide)) == 2
    bars = charts.net_price_histogram(wide)
    bars.collect()
    # Equal scalars run once: what remains are the bounds and the counts.
    final = bars._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") - final.count("ReusedSubquery") <= 2
