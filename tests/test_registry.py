"""Every registered query against its check SQL on the small test tables."""

import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry
from weekgrain.plans import decision, eda
from weekgrain.registry import core, joins
from weekgrain.registry.core import ORACLES

TABLES = "region nation customer supplier part orders lineitem".split()
QUERIES = {name: query for name, query in entry.queries().items() if name in core.QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    assert got and got == normal(want.columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    "name, module, report",
    [
        ("sort_01_ascending", decision, "weekly_trend"),
        ("sort_02_descending_aggregate", eda, "rows_by_type"),
        ("sort_03_multi_key", joins.kpi, "sorted_kpis"),
        ("sort_04_nullable_measure", decision, "price_volume_correlation"),
        ("agg_19_trade_by_type", eda, "trade_by_type"),
        ("agg_26_trade_effectiveness", decision, "trade_effectiveness"),
    ],
)
def test_a_missing_sort_is_noticed(spark, duck, monkeypatch, name, module, report):
    real = getattr(module, report)

    def unsorted(*args):
        df = real(*args)
        return df.sort(*[df[c].desc() for c in df.columns])

    monkeypatch.setattr(module, report, unsorted)
    with pytest.raises(AssertionError):
        test_query(spark, duck, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
