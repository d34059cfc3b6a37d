"""Dimensions and facts over hand-made lines."""

from decimal import Decimal

import pytest
from helpers import plan, raw, rows, star
from pyspark.sql import functions as F

from weekgrain.operators import base, dataset, dims, facts
from weekgrain.operators.keys import dense_ids


def test_ids_are_trimmed_and_upper_case(spark):
    t = star(raw(spark, {"product_id": " abc "}, {"product_id": "ABC"}, {"product_id": "  "},
                 {"product_id": None}))
    assert rows(t["dim_product"], "product_id") == [("ABC",)]


def test_inconsistent_attributes_take_the_least_and_do_not_split_facts(spark):
    t = star(raw(
        spark,
        {"category": "Technology", "sub_category": "B", "market": "EU"},
        {"category": "Furniture", "sub_category": "C", "market": "APAC"},
    ))
    got = dims.products_loaded(t["raw_products"])
    assert rows(got, "source_product_family", "source_product_category") == [("Furniture", "B")]
    assert rows(t["dim_country"], "macro_region") == [("APAC",)]
    assert rows(t["fact_shipments"], "shipment_volume", "sell_in_revenue") == [
        (Decimal("4.00"), Decimal("20.00"))
    ]


def test_two_segments_of_one_channel_make_one_wholesaler(spark):
    t = star(raw(spark, {"segment": "Consumer"}, {"segment": "Unknown"}))
    assert t["dim_wholesaler"].count() == 1
    assert rows(t["fact_shipments"], "shipment_volume") == [(Decimal("4.00"),)]


def test_rows_without_country_or_place_leave_the_facts_only(spark):
    t = star(raw(spark, {}, {"country": None}, {"country": ""}, {"city": None, "weeknum": 2}))
    assert base.lines(t["raw"]).count() == 4
    assert t["dim_country"].count() == 1
    assert rows(t["dim_region"].select(F.coalesce("city", F.lit("-")).alias("c")), "c") == [("-",), ("Paris",)]
    assert t["fact_shipments"].count() == 1


def test_mean_discount_is_per_line_and_rounded(spark):
    t = star(raw(spark, {"discount": "0.1000"}, {"discount": "0.2000"}, {"discount": "0.2000"},
                 {"discount": None}))
    assert rows(t["fact_shipments"], "trade_incentive_pct") == [(Decimal("0.1667"),)]


@pytest.mark.parametrize(
    "line, net, list_price, offers",
    [
        ({"quantity": 0}, None, None, 0),
        ({"discount": "1.0000"}, Decimal("5.0000"), None, 0),
        ({"discount": None}, Decimal("5.0000"), Decimal("5.0000"), 3),
        ({"discount": "0.2000"}, Decimal("5.0000"), Decimal("6.2500"), 3),
        ({"sales": "10.00", "quantity": 3}, Decimal("3.3333"), Decimal("4.1667"), 3),
    ],
)
def test_prices(spark, line, net, list_price, offers):
    t = star(raw(spark, line))
    got = t["fact_price"].select("net_invoice_price", "list_price").first()
    assert tuple(got) == (net, list_price)
    assert t["fact_competitor"].count() == offers


def test_missing_discount_counts_as_compliant_zero(spark):
    t = star(raw(spark, {"discount": None}))
    got = t["fact_trade"].select("incentive_pct", "incentive_amount", "compliance_flag").first()
    assert tuple(got) == (Decimal("0.0000"), Decimal("0.00"), 1)


def test_price_change_looks_at_the_last_observed_week(spark):
    weeks = [(1, "10.00"), (5, "10.00"), (9, "10.02"), (10, "10.03")]
    t = star(raw(spark, *[{"weeknum": w, "sales": s} for w, s in weeks]))
    got = rows(t["fact_price"], "date_week_id", "price_change_flag")
    # 10.02 / 2 moves by exactly a cent, 10.03 / 2 by half a cent.
    assert got == [(201101, 0), (201105, 0), (201109, 1), (201110, 0)]


def test_competitor_price_by_hand(spark):
    import zlib

    t = star(raw(spark, {}))
    got = dict(rows(t["fact_competitor"], "competitor_name", "competitor_price"))
    for name, _, level in facts.COMPETITORS:
        noise = Decimal(97 + zlib.crc32(f"P1|1|201101|{name}".encode()) % 7) / 100
        assert got[name] == round(Decimal("6.2500") * Decimal(level) * noise, 4)


def test_means_equal_the_benchmark_of_the_laid_out_fact(tables):
    ours = facts.competitor_means(tables("fact_price"), tables("dim_product"))
    theirs = facts.competitor_benchmark(tables("fact_competitor"))
    keys = facts.MARKET_KEYS
    both = ours.join(theirs.withColumnRenamed("avg_comp_price", "other"), keys, "full")
    assert both.where(F.abs(F.col("avg_comp_price") - F.col("other")) > 1e-9).count() == 0
    assert both.where("avg_comp_price IS NULL OR other IS NULL").count() == 0


def test_enriched_facts_equal_the_joined_facts(tables):
    ship, products, channels = (tables(n) for n in ("fact_shipments", "dim_product", "dim_channel"))
    joined = dataset.join_facts(
        ship, facts.prices(ship, products, channels), facts.trade_incentives(ship, products, channels)
    )
    fused = tables("fact_weekly").select(*joined.columns)
    assert joined.exceptAll(fused).count() == 0
    assert fused.exceptAll(joined).count() == 0


def test_enriched_facts_leave_unknown_products_without_prices(spark):
    t = star(raw(spark, {}, {"product_id": "", "weeknum": 2}))
    fused = dataset.enrich_facts(t["fact_shipments"], t["dim_channel"])
    got = rows(fused, "product_id", F.col("price_strategy").isNull(), F.col("incentive_amount").isNull())
    assert got == [("", True, True), ("P1", False, False)]


def test_wide_has_no_doubled_names_and_keeps_rows(tables):
    wide = tables("wide")
    assert len(set(wide.columns)) == len(wide.columns)
    assert wide.count() == tables("fact_shipments").count()


def test_invariants(tables):
    prices, wide, kpi = tables("fact_price"), tables("wide"), tables("kpi")
    assert tables("fact_competitor").count() == 3 * prices.where("list_price > 0").count()
    keys = facts.FACT_KEYS
    assert tables("fact_shipments").groupBy(*keys).count().where("count > 1").count() == 0
    a = wide.agg(F.sum("sell_in_revenue"), F.sum("trade_spend_amount"), F.sum("revenue_net_of_trade")).first()
    b = kpi.agg(F.sum("gross_revenue"), F.sum("trade_spend"), F.sum("net_revenue_after_trade")).first()
    raw_sales = tables("raw").agg(F.sum("sales")).first()[0]
    assert tuple(a) == tuple(b) and a[0] - a[1] == a[2] and a[0] == raw_sales


def test_dense_ids_equal_a_global_row_number(spark):
    import random

    random.seed(7)
    places = {
        (None if random.random() < 0.1 else f"c{min(random.randrange(40), 9)}",
         random.choice([None, "s1", "s2", "s3"]), f"t{random.randrange(500)}")
        for _ in range(3000)
    }
    df = spark.createDataFrame(sorted(places, key=str), "a string, b string, c string")
    got = dense_ids(df, "id", ["a"], ["b"], ["c"]).collect()
    want = sorted(places, key=lambda r: tuple((x is not None, x or "") for x in r))
    assert [(r.a, r.b, r.c) for r in sorted(got, key=lambda r: r.id)] == want
    assert sorted(r.id for r in got) == list(range(1, len(want) + 1))


def test_lines_are_summed_before_their_only_shuffle(spark, tables):
    lines = raw(spark, {}, {"weeknum": 2})  # a plain table: the test tables' view has joins of its own
    dims_ = [tables(n) for n in ("dim_country", "dim_region", "dim_channel", "dim_wholesaler")]
    ops = plan(dataset.enrich_facts(facts.shipments(base.lines(lines), *dims_), tables("dim_channel")))
    # Outermost first: facts laid out by series, sums, the lines' shuffle, partial sums.
    kept = [o for o in ops if o in ("Window", "HashAggregate", "SortAggregate", "Exchange hashpartitioning")]
    assert kept == ["Window", "Exchange hashpartitioning", "HashAggregate", "Exchange hashpartitioning", "HashAggregate"]
    assert not [o for o in ops if "Python" in o or "NestedLoop" in o or "Cartesian" in o]


def test_attributes_are_hash_aggregated(spark):
    lines = raw(spark, {})
    for made in (base.places(lines), base.products(lines), base.weeks(lines)):
        ops = plan(made)
        assert ops.count("HashAggregate") == 2 and "SortAggregate" not in ops


def test_a_country_of_blanks_is_a_country(spark):
    t = star(raw(spark, {"country": " "}, {"country": ""}, {}))
    assert rows(t["dim_country"], "operating_country") == [(" ",), ("France",)]


def test_wide_needs_no_shuffle_when_dimensions_are_small(tables):
    from weekgrain.plans.warehouse import BUILD

    assert not [o for o in plan(BUILD["wide"](tables)) if "Exchange hash" in o]


def test_decimals_are_summed_in_longs_to_the_same_sums(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, CAST(99999999.99 AS DECIMAL(10,2)), CAST(-0.9999 AS DECIMAL(10,4)), 0.5D),"
        " (1, -0.01, 0.0001, 1D), (1, 99999999.99, null, null), (2, null, null, null), (null, -99999999.99, 0, 2D)"
        " AS t(k, money, rate, plain)"
    )
    for name in ("money", "rate", "plain"):
        got = df.groupBy("k").agg(facts.narrow_sum(df, name).alias("x"))
        want = df.groupBy("k").agg(F.sum(name).alias("x"))
        assert got.schema["x"].dataType == want.schema["x"].dataType
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    lines = base.lines(raw(spark, {}))
    text = lines.groupBy("country").agg(facts.narrow_sum(lines, "sales"))._jdf.queryExecution().executedPlan().toString()
    assert "as bigint" in text and "partial_sum(sales" not in text


def test_the_raw_view_is_run_once(spark, tables):
    from weekgrain.plans.warehouse import BUILD

    # The test tables' view joins lines and orders; what is built from it reads the staged lines.
    assert "SortMergeJoin" in plan(BUILD["raw_lines"](tables))
    for name in ("raw_places", "raw_products", "raw_weeks", "fact_weekly"):
        assert "SortMergeJoin" not in plan(BUILD[name](tables)), name
