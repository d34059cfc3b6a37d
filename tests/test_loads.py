import random

import pandas as pd
import pytest
from helpers import plan, raw, rows, star
from pyspark.sql import functions as F

from weekgrain.operators import facts, quality, quantiles
from weekgrain.plans import eda


def shipments(spark, weeks=52):
    rng = random.Random(7)
    lines = []
    for week in range(1, weeks + 1):
        for city, product in (("Paris", "P1"), ("Lyon", "P1"), ("Paris", "P2")):
            if rng.random() < 0.7:  # series have gaps
                lines.append({"city": city, "product_id": product, "weeknum": week, "sales": f"{rng.randint(100, 900)}.00"})
    return star(raw(spark, *lines))["fact_shipments"]


def test_52_weekly_loads_equal_one_full_load(spark, tmp_path):
    path = str(tmp_path / "shipments")
    shipments(spark).write.parquet(path)
    full = spark.read.parquet(path)
    state, parts = facts.empty_state(full), []
    for week in range(201101, 201153):
        one = full.where(F.col("date_week_id") == week)
        facts.check_order(one, state)
        prices, after = facts.weekly_prices(one, state)
        parts += rows(prices, *facts.FACT_KEYS, "net_price", "prev_net_price")
        after.write.parquet(str(tmp_path / f"state{week}"))
        state = spark.read.parquet(str(tmp_path / f"state{week}"))
    want = rows(facts.unit_prices(full), *facts.FACT_KEYS, "net_price", "prev_net_price")
    assert sorted(parts) == want and any(r[-1] is not None for r in want)
    assert state.count() == full.select(*facts.SERIES_KEYS).distinct().count()
    with pytest.raises(ValueError):
        facts.check_order(full.where("date_week_id = 201110"), state)


def test_a_load_of_several_weeks_looks_back_within_itself(spark):
    full = shipments(spark, 9)
    state, parts = facts.empty_state(full), []
    for low, high in ((1, 4), (5, 5), (6, 9)):
        part = full.where(F.col("date_week_id").between(201100 + low, 201100 + high))
        prices, state = facts.weekly_prices(part, state)
        parts += rows(prices, *facts.FACT_KEYS, "prev_net_price")
    assert sorted(parts) == rows(facts.unit_prices(full), *facts.FACT_KEYS, "prev_net_price")


def test_grouped_quantiles_are_exact(spark):
    rng = random.Random(3)
    data = [("hot", round(rng.lognormvariate(3, 1), 2)) for _ in range(6000)]
    data += [(f"g{i % 40}", float(rng.randint(0, 9))) for i in range(900)]
    data += [("one", 5.0), ("none", None), (None, 1.0), (None, 4.0), ("tie", 2.0), ("tie", 2.0)]
    df = spark.createDataFrame(data, "g string, x double").repartition(7)
    probs = {"a": 0.1, "b": 0.5, "c": 0.9}
    for accuracy in (10_000, 50):
        found = quantiles.grouped_quantiles(df, ["g"], "x", probs, accuracy)
        got = {r["g"]: r for r in found.collect()}
        frame = pd.DataFrame(data, columns=["g", "x"])
        for name, part in frame.groupby(frame["g"].fillna("null")):
            row = got[None if name == "null" else name]
            assert row["n"] == part["x"].count()
            for column, p in probs.items():
                want = part["x"].quantile(p)
                assert row[column] == pytest.approx(want) if part["x"].count() else row[column] is None
    assert len(got) == frame["g"].nunique() + 1
    assert quantiles.grouped_quantiles(df.where("false"), ["g"], "x", probs).count() == 0


def test_sketches_of_weeks_unite_to_the_sketch_of_all(spark):
    df = spark.range(60_000).select((F.col("id") % 12).alias("w"), (F.col("id") % 25_000).cast("string").alias("c"))
    weekly = eda.weekly_sketches(df, F.col("w"), ["c"])
    estimate = eda.sketched_counts(weekly, ["c"]).first()[0]
    assert weekly.count() == 12 and abs(estimate - 25_000) <= eda.BOUND * 25_000
    some = eda.sketched_counts(weekly.where("week < 3"), ["c"]).first()[0]
    assert abs(some - df.where("w < 3").select("c").distinct().count()) <= eda.BOUND * some


def bad_tables(spark):
    t = star(raw(spark, *[{"weeknum": w, "city": c} for w in range(1, 9) for c in ("Paris", "Lyon")]))
    week = F.col("date_week_id")
    t["fact_shipments"] = t["fact_shipments"].withColumns({
        "country_id": F.when(week > 201102, F.col("country_id")),
        "product_id": F.when(week == 201104, F.lit("?")).otherwise(F.col("product_id")),
        "region_id": F.when(week == 201104, F.lit(99)).otherwise(F.col("region_id")),
    })
    t["dim_region"] = t["dim_region"].unionByName(t["dim_region"])
    return lambda name: t[name]


def test_offending_rows_agree_with_the_reports(spark, tmp_path):
    t = bad_tables(spark)
    reported = {}
    for report in (quality.foreign_key_report(t), quality.not_null_report(t)):
        reported |= {r["check_name"]: r["violations"] for r in report.collect()}
    for name in ("fact_shipments", "dim_region", "dim_channel"):
        accepted, bad = quality.quarantine(t, name, str(tmp_path / name))
        counts = {r["rule"]: r["n"] for r in bad.select(F.explode("broken").alias("rule")).groupBy("rule").agg(F.count("*").alias("n")).collect()}
        assert accepted.columns == t(name).columns
        assert sorted(map(repr, accepted.unionByName(bad.drop("broken")).collect())) == sorted(map(repr, t(name).collect()))
        for rule, n in reported.items():
            if rule.startswith(f"{name}."):
                assert counts.get(rule, 0) == n
    doubled = quality.tagged(t, "dim_region").collect()
    assert doubled and all(any("regulatory_region" in b for b in r["broken"]) for r in doubled)
    assert plan(quality.tagged(t, "dim_channel")).count("ArrowEvalPython") == 0


def test_names_in_any_case_are_one(spark):
    from weekgrain.functions.text import caseless

    left = spark.createDataFrame([("PARIS", 1), ("paris", 2), ("Rome", 3), (None, 4)], "name string, n int")
    right = spark.createDataFrame([("Paris", "FR"), ("ROME", "IT")], "name string, c string")
    both = left.withColumn("k", caseless(F.col("name"))).join(right.withColumn("k", caseless(F.col("name"))).drop("name"), "k")
    assert rows(both, "n", "c") == [(1, "FR"), (2, "FR"), (3, "IT")]
