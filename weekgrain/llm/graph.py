"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrain.llm.common import saved


def _stars(edges: DataFrame, both: DataFrame, keep) -> DataFrame:
    """Every neighbour that `keep` selects is linked to the smallest node around its centre."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # Saved, so that both sides of the join are laid out for it alone and a centre with many
    # neighbours can be split at run time.
    least = saved(least, "least")
    joined = both.join(least, "u")
    return joined.where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node reachable, one row per node.

    Alternating large and small stars: a logarithmic number of rounds in practice, each one
    aggregation and one join over at most as many edges as before. Rows with a null end or
    equal ends count for nothing; an empty table gives an empty one; repeated links count once.
    """
    pair = edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    now = saved(pair.distinct(), "links")
    before = None
    while True:
        mark = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if mark == before or not mark[0]:
            break
        before = mark
        # large stars: neighbours above the centre move to the centre's smallest neighbour
        both = now.union(now.select("v", "u"))
        large = _stars(now, both, F.col("v") > F.col("u")).distinct()
        # small stars: edges point down; a node and its lower neighbours meet at the lowest
        large = saved(large.where("u <> v"), "large")
        small = _stars(large, large, F.col("v") > F.col("m"))
        lowest = large.groupBy("u").agg(F.min("v").alias("v"))
        now = saved(small.union(lowest).distinct(), "small")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
