"""Comparing the rows of a group with each other when a group can be of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrain.llm.common import salted_join, saved

BLOCK = 1024
WORK = 4096
LEAST_WORK = 64


def _parts(key: list[str], rows: DataFrame, name: str, block: int) -> DataFrame:
    count = F.ceil(F.count(F.lit(1)) / block).cast("int")
    return rows.groupBy(*key).agg(count.alias(name))


def blocked(homes: DataFrame, probes: DataFrame, key: list[str], by: str, block: int = BLOCK) -> DataFrame:
    """Rows of both tables, laid out so that every probe meets every home of its key.

    Both tables have the same columns; key, not null, names the group and `by` spreads its rows.
    A group's homes and probes are cut into blocks of about `block` rows, and each pair of
    blocks is a unit of work of its own: column unit. Only groups beyond one block repeat rows.
    Units are gathered into pieces of about WORK rows: column work. Keys without homes or
    without probes are left out. Column probe tells the two kinds apart.
    """
    sizes = _parts(key, homes, "_hs", block).join(_parts(key, probes, "_ps", block), key)
    sizes = saved(sizes, "sizes")
    part = lambda n: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Groups can be large: their rows are spread over several keys of the joins.
    h = salted_join(homes, sizes, key, F.col(by)).where("_ps is not null").withColumn("_h", part("_hs")).withColumn("_p", each("_ps"))
    p = salted_join(probes, sizes, key, F.col(by)).where("_ps is not null").withColumn("_p", part("_ps")).withColumn("_h", each("_hs"))
    both = h.withColumn("probe", F.lit(False)).unionByName(p.withColumn("probe", F.lit(True)))
    both = saved(both.withColumn("unit", F.xxhash64(*key, "_h", "_p")).drop("_h", "_p", "_hs", "_ps"), "blocks")
    pieces = max(LEAST_WORK, both.count() // WORK)
    return both.withColumn("work", F.pmod(F.col("unit"), F.lit(pieces)))


def units(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """(homes, probes) of each unit in a piece of work."""
    for _, rows in frame.groupby("unit", sort=False):
        probe = rows["probe"].to_numpy(dtype=bool)
        yield rows[~probe], rows[probe]


def forest(match: np.ndarray, homes: np.ndarray, probes: np.ndarray) -> list[tuple[int, int]]:
    """Few links (id, smaller id) that connect what a matrix of matches connects: every row to
    the smallest id that it reaches within the matrix."""
    top = np.iinfo(np.int64).max
    at_home, at_probe = homes.copy(), probes.copy()
    while True:
        probe = np.minimum(at_probe, np.where(match, at_home[None, :], top).min(axis=1, initial=top))
        home = np.minimum(at_home, np.where(match, probe[:, None], top).min(axis=0, initial=top))
        if (probe == at_probe).all() and (home == at_home).all():
            break
        at_home, at_probe = home, probe
    out = {(int(a), int(b)) for a, b in zip(homes, at_home, strict=True) if a != b}
    return sorted(out | {(int(a), int(b)) for a, b in zip(probes, at_probe, strict=True) if a != b})
