import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weekgrain.sources.layout import interleaved, write_interleaved

COUNTRIES = [f"Country {i:02d}" for i in range(40)]


def lines(spark, n=40_000):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        rows.append((i, 201101 if hot else rng.randint(201101, 201452), COUNTRIES[0 if hot else rng.randrange(40)], rng.random()))
    return spark.createDataFrame(rows, "id long, week int, country string, price double")


def shares(path, column, low, high):
    """Of the files at path: the share whose statistics let a slice in, and the largest file's
    share of rows."""
    read, sizes = 0, []
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.read_metadata(file)
        at = meta.schema.to_arrow_schema().get_field_index(column)
        found = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        read += any(s.min <= high and s.max >= low for s in found)
        sizes.append(meta.num_rows)
    return read / len(sizes), max(sizes) / sum(sizes)


def test_a_slice_on_any_column_reads_few_files(spark, tmp_path):
    df, path = lines(spark), str(tmp_path / "laid")
    write_interleaved(df, path, ["week", "country", "price"], files=64)
    assert spark.read.parquet(path).exceptAll(df).count() == 0 and spark.read.parquet(path).count() == df.count()
    plain = str(tmp_path / "plain")
    df.repartition(64).write.parquet(plain)
    for column, low, high in (("week", 201301, 201304), ("country", COUNTRIES[20], COUNTRIES[20]), ("price", 0.5, 0.51)):
        read, largest = shares(path, column, low, high)
        assert read <= 0.45, (column, read)
        assert largest <= 4 / 64  # a third of all rows have one week and one country
        assert shares(plain, column, low, high)[0] >= 0.9


def test_bits_are_interleaved_in_order(spark):
    df = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).cast("string").alias("y"))
    got = {(r["x"], r["y"]): r["z"] for r in df.select("x", "y", interleaved(df, ["x", "y"], 3).alias("z")).collect()}
    rank = lambda v: sorted({k[0] for k in got}).index(v)
    spread = lambda v: sum((v >> b & 1) << 2 * b for b in range(3))
    for (x, y), z in got.items():
        assert z == (spread(rank(x)) << 1) | spread(int(y))


def test_odd_columns(spark, tmp_path):
    df = spark.sql(
        "SELECT * FROM VALUES (1, 'a', DATE'2011-01-01', 1.5, 1), (NULL, NULL, NULL, NULL, NULL), (1, 'a', DATE'2011-01-01', 1.5, 1),"
        " (-3, 'ä€', DATE'1960-05-05', -2.5, 2), (9, '', DATE'2020-01-01', 0.0, 3) AS t(a, b, c, d, _interleaved)"
    )
    path = str(tmp_path / "odd")
    for rows in (df, df.where("false")):
        write_interleaved(rows, path, ["a", "b", "c", "d"], files=3)
        got = spark.read.schema(df.schema).parquet(path)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(ValueError):
        interleaved(df.select(F.array("a").alias("a")), ["a"])
    with pytest.raises(ValueError):
        interleaved(df, [])
