"""Exact interpolated quantiles without gathering the rows in one task.

A sketch of the whole column gives, for every wanted quantile, two values that enclose it: its
error in ranks is known. A second pass counts what lies below and sketches what lies between, which
gives a far narrower pair. The third pass counts equal values between those, and only these
counts, about a millionth of the rows, are sorted. All three passes are one plan, and the rows of
one value count as one entry.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
GRID = 1_000


def _enclosing(df: DataFrame, x: Column, probs: list[float], accuracy: int, extra: dict[str, Column]) -> Column:
    """First pass, as one scalar: rows, two enclosing values for each probability, extras. The
    sketch is off by n / accuracy ranks at most. Few rows are enclosed by their extremes."""
    slack = 2.0 / accuracy
    pairs = [[max(p - slack, 0.0), min(p + slack, 1.0)] for p in probs]
    first = df.agg(
        F.count(x).alias("n"),
        F.array(F.min(x), F.max(x)).alias("all"),
        *[F.percentile_approx(x, pair, accuracy).alias(f"p{i}") for i, pair in enumerate(pairs)],
        *[c.alias(name) for name, c in extra.items()],
    )
    few = F.col("n") < 2 * accuracy
    ends = F.array(*[F.when(few, F.col("all")).otherwise(F.col(f"p{i}")) for i in range(len(probs))])
    return first.select(F.struct("n", ends.alias("ends"), *extra)).scalar()


def _narrowed(values: DataFrame, facts: Column, probs: list[float], accuracy: int, grid: int) -> Column:
    """Second pass, as one scalar: two closer enclosing values for each probability, or the same
    where few rows are enclosed already."""
    steps = [k / grid for k in range(grid + 1)]
    x = F.col("x")
    parts = []
    for i in range(len(probs)):
        low, high = F.col("f.ends")[i][0], F.col("f.ends")[i][1]
        inside = x.between(low, high)
        parts += [
            F.count_if(x < low).alias(f"below_{i}"),
            F.count_if(inside).alias(f"inside_{i}"),
            F.percentile_approx(F.when(inside, x), steps, accuracy).alias(f"grid_{i}"),
        ]
    found = values.withColumn("f", facts).agg(F.max("f").alias("f"), *parts)
    pairs = []
    for i, p in enumerate(probs):
        # Cell of the grid in which the rank lies, with one more before and two after it.
        rank = (F.col("f.n") - 1) * F.lit(p)
        cell = F.floor(F.try_divide((rank - F.col(f"below_{i}")) * grid, F.col(f"inside_{i}")))
        at = lambda k, i=i: F.get(
            F.col(f"grid_{i}"), F.least(F.greatest(k, F.lit(0)), F.lit(grid)).cast("int")
        )
        few = F.col(f"inside_{i}") < 10 * grid
        pairs.append(F.when(few, F.col("f.ends")[i]).otherwise(F.array(at(cell - 1), at(cell + 3))))
    return found.select(F.array(*pairs)).scalar()


def exact_quantiles(
    df: DataFrame,
    column: str,
    probs: dict[str, float],
    extra: dict[str, Column] | None = None,
    accuracy: int = ACCURACY,
    grid: int = GRID,
) -> DataFrame:
    """One row with the named quantiles, linear between the two neighbours, and with the extra
    aggregates of df, which ride along in the first pass. Nulls don't count; without values
    every quantile is null."""
    x = F.col(column).cast("double")
    wanted = list(probs.values())
    values = df.select(x.alias("x")).where(F.col("x").isNotNull())
    facts = _enclosing(df, x, wanted, accuracy, extra or {})
    close = _narrowed(values, facts, wanted, accuracy, grid)
    held = running_counts(values.withColumn("ends", close), len(wanted))
    found = _at_ranks(held.withColumn("f", facts), wanted)
    out = [F.col(f"q{i}").alias(name) for i, name in enumerate(probs)]
    return found.select(*out, *[F.col(f"f.{name}").alias(name) for name in extra or {}])


def running_counts(values: DataFrame, wanted: int) -> DataFrame:
    """which, x, start, end: per wanted quantile, the different values between its ends and the
    ranks that each takes. All smaller values are one entry, with a null x; larger ones are left
    out. The sorted windows hold these entries only."""
    entries = []
    for i in range(wanted):
        low, high = F.col("ends")[i][0], F.col("ends")[i][1]
        key = F.struct(F.lit(i).alias("which"), F.when(F.col("x") >= low, F.col("x")).alias("x"))
        entries.append(F.when(F.col("x") <= high, key))
    spread = values.select(F.explode(F.array(*entries)).alias("e")).where("e is not null")
    counts = spread.groupBy("e.which", "e.x").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("which").orderBy(F.asc_nulls_first("x"))
    return counts.withColumn("end", F.sum("n").over(order)).withColumn("start", F.col("end") - F.col("n"))


def _at_ranks(held: DataFrame, probs: list[float]) -> DataFrame:
    parts = []
    for i, p in enumerate(probs):
        rank = (F.col("f.n") - 1) * F.lit(p)
        for name, r in ((f"low{i}", F.floor(rank)), (f"high{i}", F.ceil(rank))):
            here = (F.col("which") == i) & (r >= F.col("start")) & (r < F.col("end"))
            parts.append(F.max(F.when(here, F.col("x"))).alias(name))
    found = held.agg(F.max("f").alias("f"), *parts)
    out = []
    for i, p in enumerate(probs):
        rank = (F.col("f.n") - 1) * F.lit(p)
        low, high = F.col(f"low{i}"), F.col(f"high{i}")
        out.append((low + (rank - F.floor(rank)) * (high - low)).alias(f"q{i}"))
    return found.select("f", *out)


def grouped_quantiles(
    df: DataFrame, keys: list[str], column: str, probs: dict[str, float], accuracy: int = ACCURACY
) -> DataFrame:
    """keys, n and the named exact quantiles of every group, linear between the two neighbours.

    All groups are served at once: a sketch per group encloses each quantile, the enclosures are
    joined back, and a second pass counts, per group, what lies below and the equal values
    between. Only these counts are sorted, so no group is ever laid out whole: a hot one is combined
    map-side, and its window holds its enclosed values only, about 4 / accuracy of them. Null
    values don't count; a group of nulls has null quantiles; null keys are a group.
    """
    wanted, x = list(probs.values()), F.col(column).cast("double")
    slack = 2.0 / accuracy
    pairs = [[max(p - slack, 0.0), min(p + slack, 1.0)] for p in wanted]
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    few = F.count(x) < 2 * accuracy
    ends = [
        F.when(few, F.array(F.min(x), F.max(x))).otherwise(F.percentile_approx(x, pair, accuracy)).alias(f"p{i}")
        for i, pair in enumerate(pairs)
    ]
    marks = df.groupBy(*named).agg(F.count(x).alias("n"), *ends)
    marks = marks.select(*[f"_k{i}" for i in range(len(keys))], "n", F.array(*[f"p{i}" for i in range(len(wanted))]).alias("ends"))
    own = [f"_k{i}" for i in range(len(keys))]
    values = df.where(x.isNotNull()).select(*named, x.alias("x"))
    same = reduce(lambda a, b: a & b, [F.col(f"v.{k}").eqNullSafe(F.col(f"m.{k}")) for k in own])
    held = values.alias("v").join(marks.alias("m"), same).select(*[f"v.{k}" for k in own], "x", "ends")
    entries = []
    for i in range(len(wanted)):
        low, high = F.col("ends")[i][0], F.col("ends")[i][1]
        key = F.struct(F.lit(i).alias("which"), F.when(F.col("x") >= low, F.col("x")).alias("x"))
        entries.append(F.when(F.col("x") <= high, key))
    spread = held.select(*own, F.explode(F.array(*entries)).alias("e")).where("e is not null")
    counts = spread.groupBy(*own, "e.which", "e.x").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*own, "which").orderBy(F.asc_nulls_first("x"))
    placed = counts.withColumn("end", F.sum("c").over(order)).withColumn("start", F.col("end") - F.col("c"))
    same = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"m.{k}")) for k in own])
    both = marks.alias("m").join(placed.alias("c"), same, "left").select(
        *[F.col(f"m.{k}").alias(k) for k in own], "n", "which", "x", "start", "end"
    )
    parts, out = [], []
    for i, (name, p) in enumerate(probs.items()):
        rank = (F.col("n") - 1) * F.lit(p)
        for end, r in ((f"low{i}", F.floor(rank)), (f"high{i}", F.ceil(rank))):
            here = (F.col("which") == i) & (r >= F.col("start")) & (r < F.col("end"))
            parts.append(F.max(F.when(here, F.col("x"))).alias(end))
        low, high = F.col(f"low{i}"), F.col(f"high{i}")
        out.append((low + (rank - F.floor(rank)) * (high - low)).alias(name))
    found = both.groupBy(*own, "n").agg(*parts)
    return found.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "n", *out)
