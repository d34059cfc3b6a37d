"""Small raw tables by hand."""

import re
from decimal import Decimal

from weekgrain.operators import base, dims, facts
from weekgrain.sources.schemas import RAW_COLUMNS, ddl

DEFAULT = {
    "category": "Furniture",
    "city": "Paris",
    "country": "France",
    "discount": "0.2000",
    "market": "EU",
    "order_id": "o1",
    "product_id": "P1",
    "profit": "1.00",
    "quantity": 2,
    "region": "Central",
    "sales": "10.00",
    "segment": "Consumer",
    "state": "IDF",
    "sub_category": "Chairs",
    "year": 2011,
    "market2": "EU",
    "weeknum": 1,
}


def raw(spark, *rows):
    data = []
    for row in rows:
        full = {**DEFAULT, **row}
        line = []
        for name, kind in RAW_COLUMNS.items():
            value = full.get(name)
            if value is not None and kind.startswith("decimal"):
                value = Decimal(value)
            line.append(value)
        data.append(tuple(line))
    return spark.createDataFrame(data, ddl(RAW_COLUMNS))


def star(lines):
    """All tables of the star schema over raw lines, unstaged."""
    t = {"raw": lines, "raw_places": base.places(lines), "raw_products": base.products(lines)}
    t["dim_channel"] = dims.channels(t["raw_places"])
    t["dim_country"] = dims.countries(t["raw_places"])
    t["dim_region"] = dims.regions(t["raw_places"], t["dim_country"])
    t["dim_date_week"] = dims.weeks(base.weeks(lines))
    t["dim_product"] = dims.products(t["raw_products"])
    t["dim_wholesaler"] = dims.wholesalers(t["raw_places"], t["dim_country"], t["dim_channel"])
    t["fact_shipments"] = facts.shipments(
        base.lines(lines), t["dim_country"], t["dim_region"], t["dim_channel"], t["dim_wholesaler"]
    )
    t["fact_price"] = facts.prices(t["fact_shipments"], t["dim_product"], t["dim_channel"])
    t["fact_trade"] = facts.trade_incentives(t["fact_shipments"], t["dim_product"], t["dim_channel"])
    t["fact_competitor"] = facts.competitor_prices(t["fact_price"], t["dim_product"])
    return t


def plan(df):
    """Operator names of the physical plan, outermost first."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(
        r"SortAggregate|ObjectHashAggregate|HashAggregate|Exchange SinglePartition|"
        r"Exchange hashpartitioning|Exchange rangepartitioning|BroadcastExchange|"
        r"SortMergeJoin|BroadcastHashJoin|NestedLoopJoin|CartesianProduct|Window|"
        r"ArrowEvalPython|BatchEvalPython|MapInPandas",
        text,
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
