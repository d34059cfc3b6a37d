"""Near-duplicate vectors by an inverted multi-index.

The halves of unit vectors have codebooks of their own; their product is a grid of cells.
Every vector is listed in its nearest cell. As a query it visits cells in the order of their
distance, by multi-sequence traversal of the two sorted lists of centroid distances, up to an
excess over the nearest cell that finds the wanted share of neighbours at exactly the least
cosine. What it meets is verified in double precision.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrain.llm.blocks import blocked, forest, units
from weekgrain.llm.common import salted_join, saved, table
from weekgrain.llm.graph import components


@dataclass(frozen=True)
class Index:
    """sample: bound on the vectors that the codebooks are fitted to. codes: centroids a half.
    recall: wanted share of neighbours at the least cosine, of either direction's visit."""

    least: float = 0.93
    sample: int = 8192
    codes: int = 32
    recall: float = 0.999
    steps: int = 12


@dataclass(frozen=True)
class Books:
    """Two codebooks, and the excess of squared distance up to which cells are visited."""

    halves: tuple[np.ndarray, np.ndarray]
    excess: float


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    gap = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)
    return np.maximum(gap, 0.0)


def _codebook(points: np.ndarray, codes: int, steps: int, rng: np.random.Generator) -> np.ndarray:
    different = np.unique(points, axis=0)
    centres = different[rng.permutation(len(different))[:codes]]
    for _ in range(steps):
        own = _distances(points, centres).argmin(1)
        for k in range(len(centres)):
            if (own == k).any():
                centres[k] = points[own == k].mean(0)
    return centres


def _neighbours(units_: np.ndarray, least: float, rng: np.random.Generator) -> np.ndarray:
    """For each unit vector one at exactly the least cosine, in a random direction."""
    noise = rng.normal(size=units_.shape)
    noise -= (noise * units_).sum(1)[:, None] * units_
    size = np.linalg.norm(noise, axis=1)[:, None]
    return least * units_ + np.sqrt(1 - least**2) * noise / np.where(size > 0, size, 1.0)


def fit(units_: np.ndarray, how: Index) -> Books:
    """Codebooks for unit vectors of one length, and the excess that reaches how.recall, both of
    made-up neighbours at exactly the least cosine and of the neighbours within the sample."""
    rng = np.random.default_rng(7)
    half = units_.shape[1] // 2
    halves = tuple(_codebook(x, how.codes, how.steps, rng) for x in (units_[:, :half], units_[:, half:]))
    near = _neighbours(units_, how.least, rng)
    own = [_distances(x, c) for x, c in zip((units_[:, :half], units_[:, half:]), halves, strict=True)]
    at = [_distances(x, c).argmin(1) for x, c in zip((near[:, :half], near[:, half:]), halves, strict=True)]
    row = np.arange(len(units_))
    excess = sum(d[row, a] - d.min(1) for d, a in zip(own, at, strict=True))
    reach = float(np.quantile(excess, how.recall))
    home = [d.argmin(1) for d in own]
    found = []
    for start in range(0, len(units_), 256):
        rows = slice(start, start + 256)
        a, b = np.nonzero(units_[rows] @ units_.T >= how.least)
        x = a + start
        found.append(sum(d[x, h[b]] - d[x, h[x]] for d, h in zip(own, home, strict=True))[x != b])
    real = np.concatenate(found)
    return Books(halves, max(reach, float(np.quantile(real, how.recall))) if len(real) else reach)


def traverse(first: np.ndarray, second: np.ndarray, excess: float) -> list[int]:
    """Cells in order of first[i] + second[j], nearest first, while within the excess.

    Multi-sequence: the next cell is the smallest of a heap; a cell enters it when its
    predecessors in both sorted lists have been visited.
    """
    a, b = first.argsort(kind="stable"), second.argsort(kind="stable")
    stop = first[a[0]] + second[b[0]] + excess
    heap, out, seen = [(first[a[0]] + second[b[0]], 0, 0)], [], set()
    while heap:
        distance, i, j = heapq.heappop(heap)
        if distance > stop:
            break
        out.append(int(a[i]) * len(second) + int(b[j]))
        seen.add((i, j))
        if i + 1 < len(a) and (j == 0 or (i + 1, j - 1) in seen):
            heapq.heappush(heap, (first[a[i + 1]] + second[b[j]], i + 1, j))
        if j + 1 < len(b) and (i == 0 or (i - 1, j + 1) in seen):
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
    return out


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Rows divided by their norms. Scaled by the largest component first, so that neither
    very large nor very small components are lost."""
    rows = np.array(vectors.tolist(), dtype=np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def books(distinct: DataFrame, how: Index) -> dict[int, Books]:
    """Codebooks by vector length, from how.sample vectors at most (smallest hashes)."""
    rows = distinct.select("embedding").orderBy(F.xxhash64("embedding")).limit(how.sample).collect()
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r[0]), []).append(r[0])
    return {n: fit(unit_rows(pd.Series(x)), how) for n, x in by_size.items() if n > 1}


def _pairs(frame: pd.DataFrame, least: float) -> tuple[list, list]:
    """Of one piece of work: (id, links) counts, and links that connect the same vectors."""
    counts, links = [], []
    for homes, probes in units(frame):
        a, b = unit_rows(homes["embedding"]), unit_rows(probes["embedding"])
        own, other = homes["node"].to_numpy(), probes["node"].to_numpy()
        match = (b @ a.T >= least) & (other[:, None] != own[None, :])
        if not match.any():
            continue
        # A pair that both ends find is counted at one of them.
        cells, at = np.unique(probes["cell"].to_numpy(), return_inverse=True)
        back = np.stack([np.isin(cells, c) for c in homes["visits"]])[:, at].T
        mine, here = probes["cell"].to_numpy()[:, None], homes["cell"].to_numpy()[None, :]
        match &= ~back | (mine > here) | ((mine == here) & (other[:, None] > own[None, :]))
        size_home, size_probe = homes["copies"].to_numpy(), probes["copies"].to_numpy()
        counts += [(int(i), int(n)) for i, n in zip(other, match @ size_home, strict=True) if n]
        counts += [(int(i), int(n)) for i, n in zip(own, size_probe @ match, strict=True) if n]
        links += forest(match, own, other)
    return counts, links


def near_vectors(vectors: DataFrame, how: Index = Index()) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors.

    Rows compare when their labels are equal and their cosine is at least how.least. A row whose
    id, label or vector is null, whose vector is empty, all zero or holds a null or non-finite
    component, links with nothing and is a component of its own (null for a null id). Vectors of
    different lengths don't compare. Copies of a vector are one vector with a number of copies,
    rows that share an id are one node; an empty table gives no rows; other columns are left out.
    Every vector is listed and looks for others: nothing is capped. Groups of any size are
    compared in blocks; counts and connecting links leave a block, not pairs.
    """
    e = F.col("embedding")
    sound = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & e.isNotNull()
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(e, lambda x: x != 0)
    )
    rows = vectors.select(
        "vec_id",
        "label",
        "embedding",
        F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("label", "embedding")).alias("k1"),
        F.xxhash64(F.lit(1), "embedding", "label").alias("k2"),
    )
    distinct = (
        rows.where("k1 is not null")
        .groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    )
    distinct = saved(distinct, "vectors")
    known = distinct.sparkSession.sparkContext.broadcast(books(distinct, how))

    @F.pandas_udf("cell long, visits array<long>")
    def place(vectors: pd.Series) -> pd.DataFrame:
        sizes = vectors.map(len).to_numpy()
        out: list = [None] * len(sizes)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            book = known.value.get(int(size))
            if book is None:  # a length that the sample lacks has one cell
                for i in at:
                    out[i] = (0, [0])
                continue
            x, half = unit_rows(vectors.iloc[at]), int(size) // 2
            first, second = _distances(x[:, :half], book.halves[0]), _distances(x[:, half:], book.halves[1])
            for i, a, b in zip(at, first, second, strict=True):
                visits = traverse(a, b, book.excess)
                out[i] = (visits[0], visits)
        return pd.DataFrame(out, columns=["cell", "visits"])

    listed = distinct.select("*", F.size("embedding").alias("size"), place("embedding").alias("p"))
    columns = ["label", "size", "node", "copies", "embedding", "p.cell", "p.visits"]
    listed = saved(listed.select(*columns), "listed")
    homes = listed.withColumn("at", F.col("cell"))
    probes = listed.withColumn("at", F.explode("visits")).withColumn("visits", F.lit(None).cast("array<long>"))
    least = how.least

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        counts, links = _pairs(frame, least)
        found = [(a, None, n) for a, n in counts] + [(a, b, None) for a, b in links]
        return pd.DataFrame(found, columns=["a", "b", "n"]).astype("Int64")

    work = blocked(homes, probes, ["label", "size", "at"], "node")
    found = saved(work.groupBy("work").applyInPandas(compare, "a long, b long, n long"), "found")
    linked = components(found.where("b is not null").select("a", "b"))
    degree = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    result = (
        distinct.select("k1", "k2", "node", "copies")
        .join(degree, "node", "left")
        .join(linked, "node", "left")
        .select(
            "k1",
            "k2",
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    result = saved(result, "result")
    out = salted_join(rows.select("vec_id", "k1", "k2"), result, ["k1", "k2"], F.col("vec_id"))
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
