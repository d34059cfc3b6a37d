"""Registration: a query, its result columns and the SQL giving the same rows.

Result columns are one text, e.g. "country:s rows:i spend:d share:r9": s text, i integer,
d double as computed, rN double rounded to N places. Both sides are cast by it, so names and
types agree. Before rounding, a hair far below the last place is added on both sides: exact
half-way values, which sums of doubles meet from either side, then fall to the same side.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekgrain.plans.warehouse import Warehouse
from weekgrain.registry.oracle import statement
from weekgrain.sources.staging import shared_root
from weekgrain.sources.testbed import order_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_open: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """One set of staged tables per application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        folder = re.sub(r"[^A-Za-z0-9.]+", "_", sf_dir).strip("_")
        _open[key] = Warehouse(spark, order_lines(spark, sf_dir), f"{shared_root(spark)}/{folder}")
    return _open[key]


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def _hair(kind: str) -> float:
    return 1.2345 * 10.0 ** -(int(kind[1:]) + 3)


def present(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        column = F.col(name)
        if kind == "s":
            column = column.cast("string")
        elif kind == "i":
            column = column.cast("bigint")
        else:
            column = column.cast("double")
            if kind[0] == "r":
                column = F.round(column + F.lit(_hair(kind)), int(kind[1:])) + F.lit(0.0)
        out.append(column.alias(name))
    return df.select(*out)


def _sql_column(name: str, kind: str) -> str:
    name = f'"{name}"'
    if kind == "s":
        return f"CAST({name} AS VARCHAR) AS {name}"
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "d":
        return f"CAST({name} AS DOUBLE) AS {name}"
    value = f"CAST({name} AS DOUBLE) + CAST({_hair(kind)!r} AS DOUBLE)"
    return f"ROUND({value}, {kind[1:]}) + CAST(0 AS DOUBLE) AS {name}"


ROW = (1 << 33) - 1


def in_order(w: Warehouse, df: DataFrame, label: str) -> DataFrame:
    """df with the place of each row as it comes out. The rows are written with their part and
    number in it; adding up the sizes of the parts before needs one row per part only."""
    path = w.path(f"out/{label}")
    df.withColumn("_at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    rows = w.spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(ROW) + 1
    return rows.join(parts, "_part").withColumn("place", place).drop("_at", "_part", "_before")


def query(name: str, spec: str, sql: str | None = None):
    """Register fn(warehouse) under name."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(warehouse(spark, sf_dir)), spec)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = statement(", ".join(_sql_column(*c) for c in _columns(spec)), sql)
        return fn

    return register
