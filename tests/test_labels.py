"""Labels, hashes, calendar and text over literal values."""

import datetime
import zlib

import pytest
from pyspark.sql import functions as F

from weekgrain.functions import calendar, hashing, labels, ratios, text, windows


def column(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(
    "segment, channel",
    [("Consumer", "Retail"), ("Corporate", "Key Accounts"), ("Home Office", "E-Commerce"),
     ("Other", "Retail"), (None, "Retail")],
)
def test_channel(spark, segment, channel):
    got = column(spark, labels.channel_of(F.col("s")), s=F.lit(segment).cast("string"))
    assert got == channel


@pytest.mark.parametrize(
    "category, line",
    [("Technology", ("Heated Tobacco", "Heat-not-burn", "Heated", "HTP")),
     ("Furniture", ("Oral Nicotine", "Nicotine Pouches", "Oral", "ONP")),
     ("Toys", ("Other", "Other", "Other", "GEN"))],
)
def test_product_line(spark, category, line):
    c = F.lit(category)
    got = spark.range(1).select(
        labels.product_family(c), labels.product_category(c), labels.nicotine_format(c),
        labels.variant_prefix(c),
    ).first()
    assert tuple(got) == line


@pytest.mark.parametrize("words", ["122|2", "AB-12-345678", "Ünïcode"])
def test_crc32_is_the_standard_one(spark, words):
    want = zlib.crc32(words.encode())
    assert column(spark, hashing.crc32_text(F.col("t")), t=words) == want
    assert column(spark, labels.brand_tier(F.col("t")), t=words) == ["Premium", "Core", "Value"][want % 3]
    packs = ["10-pack", "20-pack", "30-pack", "Multi-pack"]
    assert column(spark, labels.pack_size(F.col("t")), t=words) == packs[want % 4]


@pytest.mark.parametrize("ids, tail", [("122|2", "7513"), ("122|3", "4826"), ("122|1", "5442")])
def test_wholesaler_hash(spark, ids, tail):
    assert column(spark, hashing.padded_hash(F.col("t"), 9999, 4), t=ids) == tail


@pytest.mark.parametrize(
    "year, week, start, quarter",
    [(2011, 1, "2011-01-03", 1), (2011, 53, "2012-01-02", 5), (2012, 1, "2012-01-02", 1),
     (2012, 13, "2012-03-26", 1), (2012, 14, "2012-04-02", 2), (2013, 53, "2014-01-06", 5),
     (2014, 1, "2014-01-06", 1)],
)
def test_week_calendar(spark, year, week, start, quarter):
    y, w = F.lit(year), F.lit(week)
    got = spark.range(1).select(
        calendar.week_key(y, w), calendar.week_start(y, w), calendar.fiscal_quarter(w),
        calendar.week_end(calendar.week_start(y, w)),
    ).first()
    day = datetime.date.fromisoformat(start)
    assert tuple(got) == (year * 100 + week, day, quarter, day + datetime.timedelta(6))


def test_strategy_tests_tier_first_and_incentive_channel_first(spark):
    yes, no = F.lit(True), F.lit(False)
    got = spark.range(1).select(
        labels.price_strategy(F.lit("Premium"), yes),
        labels.price_strategy(F.lit("Core"), yes),
        labels.price_strategy(F.lit("Core"), no),
        labels.incentive_type(F.lit("Premium"), yes),
        labels.incentive_type(F.lit("Premium"), no),
        labels.incentive_type(F.lit("Value"), no),
        labels.incentive_type(F.lit("Core"), no),
    ).first()
    assert tuple(got) == (
        "Premium Hold", "Contracted", "Core Maintain", "Contract Rebate", "Display Allowance",
        "Price Support", "Volume Discount",
    )


@pytest.mark.parametrize("pct, flag", [("0.2500", 1), ("0.2501", 0), (None, 1)])
def test_compliance_limit_is_inclusive(spark, pct, flag):
    got = column(spark, labels.compliance_flag(F.col("p")), p=F.lit(pct).cast("decimal(10,4)"))
    assert got == flag


@pytest.mark.parametrize(
    "before, now, flag", [(None, "5", 0), ("5", "5.0099", 0), ("5", "5.01", 1), ("5", "4.99", 1)]
)
def test_price_change_flag(spark, before, now, flag):
    kind = "decimal(24,6)"
    got = column(
        spark, labels.price_change_flag(F.col("n"), F.col("b")),
        n=F.lit(now).cast(kind), b=F.lit(before).cast(kind),
    )
    assert got == flag


def test_divisions(spark):
    got = spark.range(1).select(
        ratios.safe_div(F.lit(1), F.lit(0)), ratios.safe_div(F.lit(1), F.lit(-2)),
        ratios.guarded_ratio(F.lit(1), F.lit(-2)), ratios.guarded_ratio(F.lit(1), F.lit(0)),
        ratios.guarded_ratio(F.lit(1), F.lit(4)),
    ).first()
    assert tuple(got) == (None, -0.5, None, None, 0.25)


def test_null_tolerant_and_weighted(spark):
    df = spark.createDataFrame([(None, 5.0), (2.0, 1.0), (4.0, 3.0)], "x double, w double")
    got = df.agg(
        ratios.total(F.col("x")), ratios.weighted_mean(F.col("x"), F.col("w")),
        ratios.distinct_with_null(F.col("x")), ratios.missing(F.col("x")),
    ).first()
    assert tuple(got) == (6.0, 3.5, 3, 1)
    empty = df.where("w < 0").agg(ratios.total(F.col("x"))).first()
    assert empty[0] == 0.0


@pytest.mark.parametrize("n, constant, null", [(9, False, True), (10, False, False), (10, True, True)])
def test_correlation_guard(spark, n, constant, null):
    df = spark.range(n).select(
        F.lit(0.1).alias("x") if constant else F.col("id").cast("double").alias("x"),
        (F.col("id") * -2.0).alias("y"),
    )
    got = df.agg(ratios.correlation(F.col("x"), F.col("y"), 10)).first()[0]
    assert got is None if null else got == pytest.approx(-1.0)


def test_trailing_mean_needs_four_values(spark):
    df = spark.createDataFrame(
        [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (5, None), (6, 6.0)], "w int, x double"
    )
    series = windows.ordered("w")
    got = df.select("w", windows.trailing_mean(F.col("x"), series).alias("m")).orderBy("w")
    assert [r.m for r in got.collect()] == [None, None, None, 2.5, None, None]
    change = df.select("w", windows.relative_change(F.col("x"), series).alias("c")).orderBy("w")
    assert [r.c for r in change.collect()][:3] == [None, 1.0, 0.5]


@pytest.mark.parametrize(
    "value, money, share",
    [(12642905.4, "$12,642,905", "1264290540.0%"), (-1234.5, "-$1,235", "-123450.0%"),
     (0.1065, "$0", "10.7%"), (-0.2, "$0", "-20.0%")],
)
def test_number_text(spark, value, money, share):
    assert column(spark, text.dollars(F.col("v")), v=value) == money
    assert column(spark, text.percents(F.col("v")), v=value) == share


def test_metric_text_takes_the_first_match(spark):
    share = column(spark, text.metric_text(F.lit("Trade Spend % of Revenue (calc)"), F.lit(0.106)))
    assert share == "$0"
    real = column(spark, text.metric_text(F.lit("Avg Price Realization"), F.lit(0.8424)))
    assert real == "84.2%"
    assert column(spark, text.metric_text(F.lit("Weeks"), F.lit(3))) == "3"


def test_paste_shows_missing_labels(spark):
    assert column(spark, text.paste(F.lit("a"), F.lit(None), F.lit("b"))) == "a | NA | b"
