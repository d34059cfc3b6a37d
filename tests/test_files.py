import random
import re

import pytest
from pyspark.sql import functions as F

from weekgrain.sources import infer, readers, sinks, split_csv
from weekgrain.sources.versions import Conflict, VersionedTable

CELLS = [None, "", "a", 'x "q" y', "line\nbreak", 'two\n\nbreaks "and" quotes', "  pad ", "com,ma", '"', '\n"\n', "é\n漢", "b\r\nc"]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("quote_text", [False, True])
def test_a_file_with_line_breaks_is_read_in_splits(spark, tmp_path, small_splits, quote_text):
    rng = random.Random(5)
    data = [(i, rng.choice(CELLS), rng.choice(CELLS[:-1])) for i in range(5000)]
    df = spark.createDataFrame(data, "id int, a string, b string").coalesce(1)
    path = str(tmp_path / "x")
    sinks.write_csv(df, path, quote_text=quote_text)
    got = readers.read_csv(spark, path, df.schema)
    whole = spark.read.schema(df.schema).options(**readers.CSV, multiLine=True).csv(path)
    assert split_csv.records(spark, path).rdd.getNumPartitions() >= 8 and whole.rdd.getNumPartitions() == 1
    assert sorted_rows(got) == sorted_rows(whole)


def test_a_cell_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i} of a long cell" for i in range(3000))
    df = spark.createDataFrame([(1, "x"), (2, long), (3, "y\n"), (4, long + '"')], "id int, a string").coalesce(1)
    path = str(tmp_path / "x")
    sinks.write_csv(df, path)
    assert sorted_rows(readers.read_csv(spark, path, df.schema)) == sorted_rows(df)


def test_files_with_a_header_only_and_windows_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'id,a\r\n1,"x\r\ny"\r\n2,z\r\n')
    (tmp_path / "b.csv").write_bytes(b"id,a\r\n")
    assert sorted_rows(readers.read_csv(spark, str(tmp_path), "id int, a string")) in (
        [(1, "x\r\ny"), (2, "z")],
        [(1, "x\ny"), (2, "z")],
    )


def test_a_record_with_too_many_cells_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,a\n1,x\n2,y,z\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_csv(spark, str(tmp_path), "id int, a string").collect()


def test_types_are_the_least_that_hold_all_cells(spark):
    columns = {
        "i": ("1", "-20", None, "int"),
        "l": ("1", "99999999999", "0", "bigint"),
        "wide": ("1" * 25, "2", "3", "decimal(38,0)"),
        "d": ("1.50", "-22.25", None, "decimal(10,2)"),
        "d18": ("123456789.2500", "1.0000", "0.5000", "decimal(18,4)"),
        "f": ("1.5", "22.25", "3.0", "double"),
        "e": ("1", "2.5E7", "NaN", "double"),
        "day": ("2020-02-29", None, "1999-12-31", "date"),
        "noday": ("2020-02-30", "2020-01-01", None, "string"),
        "code": ("007", "012", "100", "string"),
        "mixed": ("1", "2", "x", "string"),
        "blank": ("1", "", "2", "string"),
        "empty": (None, None, None, "string"),
    }
    rows = [[c[k] for c in columns.values()] for k in range(3)]
    texts = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in columns)).repartition(3)
    found = {r["column"]: r for r in infer.profile(texts).collect()}
    assert {n: found[n]["type"] for n in columns} == {n: c[3] for n, c in columns.items()}
    assert found["empty"]["null_share"] == 1.0 and found["i"]["null_share"] == pytest.approx(1 / 3)
    assert [t for _, t in infer.typed(texts).dtypes] == [c[3] for c in columns.values()]
    none = infer.typed(texts.where("false"))
    assert none.count() == 0 and {t for _, t in none.dtypes} == {"string"}


def test_inferred_reading_gives_the_declared_types(spark, tables, tmp_path):
    for name in ("kpi", "dim_wholesaler", "dim_date_week"):
        path = str(tmp_path / name)
        declared = tables(name)
        sinks.write_csv(declared, path)
        got = readers.read_csv(spark, path)
        # How wide a type was declared does not show in the cells, how many places does.
        wide = lambda t: re.sub(r"bigint", "int", re.sub(r"decimal\(\d+,", "decimal(", t))
        assert [(n, wide(t)) for n, t in got.dtypes] == [(n, wide(t)) for n, t in declared.dtypes]
        assert got.count() == declared.count()


def load(spark, year, n):
    return spark.range(n).select(F.lit(year).alias("year"), F.col("id").alias("v"))


def test_a_reader_keeps_its_version_while_a_refresh_fails(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        table.read()
    table.replace(load(spark, 2011, 10))
    before = table.read()

    def fails(x):
        raise RuntimeError("half-way")

    half = load(spark, 2012, 50).withColumn("v", F.udf(fails, "long")("v"))
    with pytest.raises(Exception, match="half-way"):
        table.replace(half)
    assert before.count() == table.read().count() == 10
    table.replace(load(spark, 2013, 7))
    assert before.count() == 10 and table.read().count() == 7
    assert table.read(1).count() == 10
    assert any(g.startswith("data/") for g in table.clear()) and table.read().count() == 7


def test_parts_are_replaced_alone(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), part="year")
    table.replace(load(spark, 2011, 3).union(load(spark, 2012, 4)))
    old = table.read()
    table.replace_parts(load(spark, 2012, 1).union(load(spark, 2013, 2)))
    counts = lambda df: {r["year"]: r["count"] for r in df.groupBy("year").count().collect()}
    assert counts(table.read()) == {2011: 3, 2012: 1, 2013: 2} and counts(old) == {2011: 3, 2012: 4}
    table.clear()
    assert counts(table.read()) == {2011: 3, 2012: 1, 2013: 2}


def test_of_two_loads_at_once_one_is_refused(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.replace(load(spark, 2011, 3))
    one, two = table._write(load(spark, 2012, 5)), table._write(load(spark, 2013, 6))
    table._commit(2, {"": one})
    with pytest.raises(Conflict):
        table._commit(2, {"": two})
    assert table.read().count() == 5
