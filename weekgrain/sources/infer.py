"""Column types of text cells, by one pass that merges over any split of the rows.

A cell lies in a lattice: integer, fixed decimal, double, date, text. Every column keeps a few
counts and extremes of its cells, which add up over tasks, and its type is the least one that
holds all of them. Nulls fit every type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DecimalType, DoubleType, IntegerType, LongType, StringType

# A number with leading zeros is a code, so text.
WHOLE = r"^-?(0|[1-9][0-9]*)$"
FIXED = r"^-?(0|[1-9][0-9]*)\.[0-9]+$"
FLOAT = r"^-?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|Infinity)$|^NaN$"
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
# Precisions that a decimal is widened to.
PRECISIONS = (10, 18, 38)


def cell_facts(name: str) -> dict[str, Column]:
    """Aggregates over one text column, from which `column_type` tells its type."""
    cell = F.col(f"`{name}`")
    whole, fixed = cell.rlike(WHOLE), cell.rlike(FIXED)
    digits = F.length(F.regexp_replace(F.split_part(cell, F.lit("."), F.lit(1)), "-", ""))
    places = F.when(fixed, F.length(F.split_part(cell, F.lit("."), F.lit(2))))
    day = cell.rlike(DAY) & F.try_to_date(cell, "yyyy-MM-dd").isNotNull()
    return {
        "rows": F.count(F.lit(1)),
        "cells": F.count(cell),
        "whole": F.count_if(whole),
        "int": F.count_if(whole & cell.try_cast("int").isNotNull()),
        "long": F.count_if(whole & cell.try_cast("bigint").isNotNull()),
        "fixed": F.count_if(fixed),
        "number": F.count_if(cell.rlike(FLOAT) & ~cell.rlike(r"^-?0[0-9]")),
        "day": F.count_if(day),
        "digits": F.max(F.when(whole | fixed, digits)),
        "least_places": F.min(places),
        "most_places": F.max(places),
    }


def column_type(facts: dict) -> DataType:
    """The least type that holds all cells. A column is a decimal if all cells have one and the
    same number of two or more places, as written decimals do; other fractions are doubles."""
    cells = facts["cells"]
    if not cells:
        return StringType()
    if facts["int"] == cells:
        return IntegerType()
    if facts["long"] == cells:
        return LongType()
    if facts["whole"] == cells and facts["digits"] <= 38:
        return DecimalType(38, 0)
    if facts["fixed"] == cells and facts["least_places"] == facts["most_places"] >= 2:
        need = facts["digits"] + facts["most_places"]
        for p in PRECISIONS:
            if need <= p:
                return DecimalType(p, facts["most_places"])
    if facts["number"] == cells:
        return DoubleType()
    if facts["day"] == cells:
        return DateType()
    return StringType()


def profile(texts: DataFrame) -> DataFrame:
    """column, type and null_share of every column, from one aggregation over text columns."""
    return _profile(texts)[0]


def _profile(texts: DataFrame) -> tuple[DataFrame, dict[str, DataType]]:
    names = texts.columns
    each = [F.struct(*[c.alias(k) for k, c in cell_facts(n).items()]).alias(f"_{i}") for i, n in enumerate(names)]
    row = texts.agg(*each).first()  # one row, a struct a column
    types = {n: column_type(row[f"_{i}"].asDict()) for i, n in enumerate(names)}
    out = []
    for i, n in enumerate(names):
        rows, cells = row[f"_{i}"]["rows"], row[f"_{i}"]["cells"]
        out.append((n, types[n].simpleString(), (rows - cells) / rows if rows else None))
    return texts.sparkSession.createDataFrame(out, "column string, type string, null_share double"), types


def typed(texts: DataFrame) -> DataFrame:
    """The same columns in the types that their cells have."""
    types = _profile(texts)[1]
    return texts.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in types.items()])
