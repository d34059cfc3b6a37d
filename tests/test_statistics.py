"""Quantiles and histograms against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekgrain.operators.histogram import histogram
from weekgrain.operators import quantiles
from weekgrain.operators.quantiles import exact_quantiles
from weekgrain.plans import decision, eda

PROBS = {"p10": 0.1, "median": 0.5, "p90": 0.9, "top": 1.0, "low": 0.0}
rng = np.random.default_rng(3)
SAMPLES = {
    "uniform": rng.uniform(-5, 5, 1000),
    "heavy_tail": np.exp(rng.normal(0, 4, 2001)),
    "one_value_a_third": np.where(rng.random(999) < 0.34, 7.25, rng.uniform(0, 1e6, 999)),
    "dense_corner": np.concatenate([rng.uniform(0, 1e-3, 5000), [1e9]]),
    "constant": np.full(17, 2.5),
    "single": np.array([4.0]),
    "two": np.array([1.0, 2.0]),
}


@pytest.mark.parametrize("name", SAMPLES)
@pytest.mark.parametrize("accuracy, grid", [(10_000, 1_000), (100, 10)])
def test_quantiles(spark, name, accuracy, grid):
    values = SAMPLES[name]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    extra = {"rows": F.count(F.lit(1)), "most": F.max("x")}
    got = exact_quantiles(df, "x", PROBS, extra, accuracy, grid).first().asDict()
    for key, p in PROBS.items():
        assert got[key] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)
    assert (got["rows"], got["most"]) == (len(values) + 1, values.max())


@pytest.mark.parametrize("name", ["outlier", "dominant"])
def test_what_is_sorted_stays_small(spark, monkeypatch, name):
    """One extreme value, or one value that most rows have: the sorted window still sees a small
    part of the different values."""
    x = F.rand(5) * 1000
    if name == "outlier":
        df = spark.range(200_000).select(F.when(F.col("id") == 7, 1e18).otherwise(x).alias("x"))
    else:
        df = spark.range(200_000).select(F.when(F.col("id") % 3 > 0, 500.0).otherwise(x).alias("x"))
    df = df.cache()
    held = []
    real = quantiles.running_counts

    def kept(values, wanted):
        out = real(values, wanted)
        held.append(out.groupBy("which").count())
        return out

    monkeypatch.setattr(quantiles, "running_counts", kept)
    got = exact_quantiles(df, "x", PROBS).first().asDict()
    values = np.array([r[0] for r in df.collect()])
    for key, p in PROBS.items():
        assert got[key] == pytest.approx(np.quantile(values, p), rel=1e-12)
    assert max(r["count"] for r in held[0].collect()) < 2_000


def test_nothing_runs_while_planning(spark):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    exact_quantiles(spark.range(10).select(F.col("id").alias("x")), "x", PROBS)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before


def test_quantiles_of_nothing_are_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert tuple(exact_quantiles(df, "x", {"m": 0.5}).first()) == (None,)


@pytest.mark.parametrize("name", ["uniform", "one_value_a_third", "dense_corner", "constant"])
def test_histogram(spark, name):
    values = SAMPLES[name]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    got = {r["bin"]: r["count"] for r in histogram(df, "x", 40).collect()}
    assert sorted(got) == list(range(1, 41)) and sum(got.values()) == len(values)
    lo, hi = values.min(), values.max()
    place = np.zeros(len(values)) if lo == hi else (values - lo) * 40 / (hi - lo)
    want = np.bincount(np.minimum(np.floor(place).astype(int), 39), minlength=40)
    assert [got[b] for b in range(1, 41)] == want.tolist()


def test_price_index_keeps_rows_without_a_benchmark(spark):
    wide = spark.createDataFrame(
        [(1, 1, 1, 1, 8.0), (1, 1, 1, 2, 8.0), (1, 1, None, 1, 9.0)],
        "date_week_id int, country_id int, region_id int, channel_id int, list_unit_price double",
    )
    bench = spark.createDataFrame(
        [(1, 1, 1, 1, 4.0), (1, 1, None, 1, 3.0)],
        "date_week_id int, country_id int, region_id int, channel_id int, avg_comp_price double",
    )
    got = eda.price_index(wide, bench).orderBy("list_unit_price", "channel_id").collect()
    assert [r.price_index_vs_comp for r in got] == [2.0, None, 3.0]


def test_health_counts_a_null_as_one_value(tables):
    wide = tables("wide").withColumn(
        "operating_country", F.when(F.col("channel_id") == 1, F.col("operating_country"))
    )
    known = wide.select("operating_country").dropna().distinct().count()
    assert eda.health(wide).first()["countries"] == known + 1


def test_sums_do_not_depend_on_partitioning(spark, tables):
    kpi = tables("kpi").drop("no_such")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for parts in (1, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            mixed = kpi.repartition(parts, "avg_net_price")
            seen.append(
                [
                    sorted(map(tuple, report(mixed, reading).collect()), key=repr)
                    for report in (decision.realization_leakage, decision.weekly_totals)
                    for reading in ("as_run", "intended")
                ]
            )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_money_shows_cents_below_a_hundred_thousand(spark):
    rows = [("Total Gross Revenue", 12345.5), ("Total Trade Spend", -3.0), ("Avg Price Realization (weighted)", 0.84)]
    df = spark.createDataFrame(rows, "metric string, value double")
    got = [r["value_fmt"] for r in decision.formatted_summary(df).orderBy("metric").collect()]
    assert got == ["84.0%", "$12,345.50", "-$3.00"]
    large = decision.formatted_summary(df.withColumn("value", F.col("value") * 100)).orderBy("metric").collect()
    assert [r["value_fmt"] for r in large][1:] == ["$1,234,550", "-$300"]
    whole = decision.formatted_summary(df.withColumn("value", F.round("value"))).orderBy("metric").collect()
    assert [r["value_fmt"] for r in whole][1:] == ["$12,346", "-$3"]


def test_n_weeks_counts_different_weeks(tables):
    for r in decision.trade_effectiveness(tables("kpi")).collect():
        assert 0 < r["n_weeks"] <= min(r["weeks"], tables("dim_date_week").count())
