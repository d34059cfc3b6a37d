"""The view of order lines over small tables made here."""

import datetime
from decimal import Decimal

from helpers import plan

from weekgrain.sources.testbed import order_lines


def small(spark, path):
    day = datetime.datetime(1996, 1, 10)
    made = {
        "region": ([(0, "AFRICA"), (1, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(7, "N7", 1), (8, "N8", None)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": (
            [(1, "a", 7, 0.0, "BUILDING"), (2, "b", 7, 0.0, None), (2, "c", 7, 0.0, "MACHINERY"),
             (3, "d", 8, 0.0, "BUILDING"), (4, "e", None, 0.0, "BUILDING"), (None, "f", 7, 0.0, "BUILDING")],
            "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        ),
        "part": (
            [(5, "bolt", "Brand#1", "PROMO", 1, 1.0), (6, "ring", None, "LARGE", 1, 1.0), (None, "x", "y", "z", 1, 1.0)],
            "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        ),
        "orders": (
            [(10 + c, c, "O", 1.0, day, "5-LOW") for c in (1, 2, 3, 4)] + [(15, None, "O", 1.0, day, "5-LOW")],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp,"
            " o_orderpriority string",
        ),
        "lineitem": (
            [(o, p, 2.0, 100.0, 0.05, day) for o in (11, 12, 13, 14, 15, None) for p in (5, 6, 9, None)],
            "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double,"
            " l_shipdate timestamp",
        ),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return order_lines(spark, str(path))


def test_lines_of_known_orders_parts_and_places(spark, tmp_path):
    lines = small(spark, tmp_path)
    columns = ["order_id", "city", "country", "region", "segment", "product_id", "category", "sub_category", "sales"]
    got = sorted(map(tuple, lines.select(*columns).collect()), key=repr)
    parts = [(" brand#1-promo ", "Technology", "Brand#1"), (" large ", "Furniture", None)]
    buyers = [("11", "N7-1", "Corporate"), ("12", "N7-0", None), ("12", "N7-0", "MACHINERY")]
    want = [(o, c, "N7", "ASIA", s, *p, Decimal("75.00")) for o, c, s in buyers for p in parts]
    assert got == sorted(want, key=repr)


def test_texts_are_made_behind_the_shuffles(spark, tmp_path):
    small(spark, tmp_path)
    ops = plan(order_lines(spark, str(tmp_path)))
    # Outermost first: regions, nations and parts meet the lines behind the join on the order.
    assert ops[: ops.index("SortMergeJoin")].count("BroadcastHashJoin") == 3
