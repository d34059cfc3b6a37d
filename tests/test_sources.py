"""Readers and writers on small files."""

import os

import pytest
from helpers import DEFAULT, plan, raw
from pyspark.sql import functions as F

from weekgrain.operators import quality
from weekgrain.operators.facts import FACT_KEYS
from weekgrain.sources import readers, sinks, staging
from weekgrain.sources.schemas import RAW_COLUMNS, RAW_FILE_COLUMNS


def text_lines(path):
    out = []
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            with open(os.path.join(path, name)) as f:
                out += f.read().splitlines()
    return out


def test_raw_csv_with_dotted_names(spark, tmp_path):
    header = ",".join(RAW_FILE_COLUMNS)
    line = "Furniture,Paris,France,0.2,EU,o1,High,P1,Chair,1.5,2,Central,10,Consumer,Air,3.2,IDF,Chairs,2011,EU,7"
    (tmp_path / "orders.csv").write_text(f"{header}\n{line}\n")
    df = readers.read_order_lines(spark, str(tmp_path / "orders.csv"), "csv")
    assert df.columns == list(RAW_COLUMNS)
    got = df.first()
    assert (got.order_id, got.sub_category, str(got.sales), got.weeknum) == ("o1", "Chairs", "10.00", 7)


def test_standardise_trims_casts_and_fills(spark):
    df = spark.createDataFrame([(" France ", "12", "x")], ["Country", "quantity", "Year"])
    got = readers.standardise(df).first()
    assert (got.country, got.quantity, got.year, got.city) == ("France", 12, None, None)
    assert got.__fields__ == list(RAW_COLUMNS)


def test_csv_minimal_quotes_and_na(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', None), (2, "c", 1.5)], "id int, name string, x double").coalesce(1)
    path = str(tmp_path / "out")
    sinks.write_csv(df, path)
    assert text_lines(path) == ["id,name,x", '1,"a,""b""",NA', "2,c,1.5"]
    back = readers.read_csv(spark, path, df.schema.simpleString()[7:-1].replace(":", " "))
    assert back.where("x IS NULL").count() == 1


def test_csv_quoted_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', None), (2, "c", "d")], "id int, name string, y string").coalesce(1)
    path = str(tmp_path / "out")
    sinks.write_csv(df, path, quote_text=True)
    assert text_lines(path) == ['"id","name","y"', '1,"a,""b""",NA', '2,"c","d"']


AWKWARD = [
    'Mat 46" x 60", clear', "back\\slash\\", '\\"', "  outer blanks  ", "", "line\nbreak", "line\r\nbreak", '"', ",", '"quoted"',
    None, "plain", "tab\there",
]


@pytest.mark.parametrize("quote_text", [False, True])
def test_both_writers_round_trip(spark, tmp_path, quote_text):
    rows = [(i, text, None if i % 2 else 1.5, "x") for i, text in enumerate(AWKWARD)]
    df = spark.createDataFrame(rows, "id int, name string, x double, last string").repartition(3)
    path = str(tmp_path / "out")
    sinks.write_csv(df, path, quote_text=quote_text)
    back = readers.read_csv(spark, path, df.schema)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)


def test_an_empty_table_round_trips(spark, tmp_path):
    df = spark.createDataFrame([], "id int, name string")
    for quote_text in (False, True):
        sinks.write_csv(df, str(tmp_path / str(quote_text)), quote_text=quote_text)
        assert readers.read_csv(spark, str(tmp_path / str(quote_text)), df.schema).count() == 0


def test_preferred_source(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "id int")
    parquet, csv = str(tmp_path / "p"), str(tmp_path / "c")
    sinks.write_csv(df, csv)
    assert readers.read_preferred(spark, parquet, csv, "id int").count() == 1
    sinks.write_snapshot(df.union(df), parquet)
    assert readers.read_preferred(spark, parquet, csv, "id int").count() == 2


def test_refresh_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(2011, 1), (2011, 2), (2012, 3)], "fiscal_year int, x int")
    for _ in range(2):
        sinks.write_snapshot(df, path, ["fiscal_year"])
    assert spark.read.parquet(path).count() == 3
    sinks.refresh_partitions(spark.createDataFrame([(2012, 9)], df.schema), path, ["fiscal_year"])
    got = sorted((r.fiscal_year, r.x) for r in spark.read.parquet(path).collect())
    assert got == [(2011, 1), (2011, 2), (2012, 9)]
    sinks.write_snapshot(df.where("fiscal_year = 2011"), path, ["fiscal_year"])
    assert spark.read.parquet(path).count() == 2


def test_bucketed_facts_join_without_a_shuffle(spark, tables, tmp_path):
    for name, table in (("b_ship", "fact_shipments"), ("b_price", "fact_price")):
        sinks.write_bucketed(tables(table), name, FACT_KEYS, 4, str(tmp_path / name))
    try:
        joined = spark.table("b_ship").hint("merge").join(spark.table("b_price"), FACT_KEYS, "left")
        assert not [o for o in plan(joined) if "Exchange" in o]
        assert joined.count() == tables("fact_shipments").count()
    finally:
        spark.sql("DROP TABLE b_ship")
        spark.sql("DROP TABLE b_price")


def test_jdbc_options_split_the_scan():
    got = readers.jdbc_options("jdbc:x", "fact", "date_week_id", 201101, 201453, 16)
    assert got["numPartitions"] == "16" and got["partitionColumn"] == "date_week_id"
    assert (got["lowerBound"], got["upperBound"]) == ("201101", "201453")


def test_staged_tables_live_in_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = staging.shared_root(spark)
    assert spark.sparkContext.applicationId in root
    if named:
        assert root.startswith(named)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        applicationId, master = "app", "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        staging.shared_root(Session())


def test_quality_reports_find_what_is_wrong(spark):
    frames = {
        "dim_country": spark.createDataFrame([(1, "A"), (2, "A")], "country_id int, operating_country string"),
        "dim_channel": spark.createDataFrame([(1, "R"), (2, None)], "channel_id int, channel_name string"),
        "dim_region": spark.createDataFrame(
            [(1, 9, "r", "s", None), (2, 9, "r", "s", None)],
            "region_id int, country_id int, regulatory_region string, state string, city string"),
        "dim_wholesaler": spark.createDataFrame(
            [(1, 1, 1, "w"), (2, None, 7, "w")],
            "wholesaler_id int, country_id int, primary_channel_id int, wholesaler_name string"),
        "dim_date_week": spark.createDataFrame([(1, 2011, None)], "date_week_id int, fiscal_year int, fiscal_week int"),
        "dim_product": spark.createDataFrame([("p", "n")], "product_id string, product_variant_name string"),
    }
    ids = "date_week_id int, country_id int, region_id int, product_id string, wholesaler_id int, channel_id int"
    fact = spark.createDataFrame([(1, 1, 1, "q", 1, 1), (1, 1, 1, "q", 1, 1), (2, 1, 1, "p", 1, 1)], ids)
    measures = {"shipment_volume": F.lit(1), "sell_in_revenue": F.lit(None), "incentive_type": F.lit("x"),
                "competitor_name": F.lit("x"), "competitor_product_family": F.lit("x")}
    for name in ("fact_shipments", "fact_price", "fact_trade", "fact_competitor"):
        frames[name] = fact.withColumns(measures)

    def found(report):
        return {r.check_name: r.violations for r in report.collect() if r.violations}

    t = frames.__getitem__
    assert found(quality.foreign_key_report(t)) == {
        "dim_region.country_id -> dim_country": 2,
        "dim_wholesaler.primary_channel_id -> dim_channel": 1,
        "fact_shipments.date_week_id -> dim_date_week": 1,
        "fact_shipments.product_id -> dim_product": 2,
    }
    assert found(quality.unique_key_report(t)) == {"dim_country(operating_country)": 1}
    assert found(quality.not_null_report(t)) == {
        "dim_channel.channel_name": 1, "dim_wholesaler.country_id": 1, "dim_date_week.fiscal_week": 1,
        "fact_shipments.sell_in_revenue": 3,
    }


def test_raw_helper_matches_the_declared_columns(spark):
    assert raw(spark, {}).columns == list(RAW_COLUMNS) and set(DEFAULT) <= set(RAW_COLUMNS)
