"""Resampling a corpus towards a target by importance weights.

Runs of one to three words are hashed into buckets, counted over the corpus and over the target;
an array holds what an occurrence in each bucket is worth. A document's weight is the sum over
its own, and noise that depends on its id alone turns the highest scores into a draw without
replacement.

The exact ranks come from parallel sorting by regular sampling. Scored documents are written as
locally sorted runs. Regular samples of every run, sorted, give regular splitters. Counts per run
and segment say, by prefix sums, at which rank each segment starts; the segments that reach into
the draw are exchanged, merged locally, and a row's rank is its place in its segment after the
start. Segments beyond the draw never move.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weekgrain.llm.common import saved, table

# Digits, small letters and all bytes of characters beyond ASCII stay, capital letters become
# small, every other byte parts words.
KEPT = [c if chr(c).isdigit() or chr(c).islower() or c > 127 else c + 32 if chr(c).isupper() else 32 for c in range(128)]
TABLE = bytes(KEPT) + bytes(range(128, 256))


@dataclass(frozen=True)
class Draw:
    """buckets: of the hashed features. longest: words of the longest feature. least: words a
    document must have to be drawn. percent: of those that are drawn. seed: of the noise.
    segments: least number of regular segments of the sort; beyond, one per segment_rows rows.
    samples: about the most samples over all runs."""

    buckets: int = 10_000
    longest: int = 3
    least: int = 20
    percent: int = 5
    seed: int = 42
    segments: int = 64
    segment_rows: int = 1 << 20
    samples: int = 1 << 20


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def features(found: list[bytes], how: Draw) -> np.ndarray:
    """Buckets of all runs of 1 to how.longest words. A longer run's checksum goes on from that of
    the run without its last word."""
    sums = list(map(zlib.crc32, found))
    out, joined = [sums], [b" " + w for w in found] if how.longest > 1 else []
    for k in range(1, how.longest):
        sums = list(map(zlib.crc32, joined[k:], sums))
        out.append(sums)
    return np.concatenate([np.asarray(x, dtype=np.int64) for x in out]) % how.buckets


def counts(texts: DataFrame, how: Draw) -> np.ndarray:
    """Occurrences per bucket over all texts. A task counts in one array, so that a row per
    bucket leaves it, however common a feature is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(how.buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                held += np.bincount(features(words(text.as_py()), how), minlength=how.buckets)
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(held[there])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(how.buckets, dtype=np.int64)
    for row in found.toLocalIterator():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What an occurrence in each bucket adds to a weight: thousandths of a log ratio, down."""
    s_all, t_all = int(corpus.sum()), int(target.sum())
    n = len(corpus)
    ratio = lambda s, t: (t + 1) * (s_all + n) / ((s + 1) * (t_all + n))
    return np.asarray(
        [math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)],
        dtype=np.int64,
    )


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel draw that depends on the id alone; a null id is the empty text."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


RUN = (1 << 33) - 1


def order() -> list[Column]:
    """Highest score first, then the smaller id; a null id comes last, and equal rows follow
    their place in the runs."""
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("at")]


def _key(score: int, doc_id: int | None, at: int) -> tuple:
    return (-score, doc_id is None, doc_id or 0, at)


def scored_runs(docs: DataFrame, worth: np.ndarray, how: Draw) -> DataFrame:
    """doc_id, n_features, weight, score, open (long enough to be drawn), at: run and place in
    it. Each part of the table is one run, the open documents first, in order. Written."""
    shared = docs.sparkSession.sparkContext.broadcast(worth)

    @F.pandas_udf("n_features long, weight long, score long, open boolean")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = []
            for i, text in zip(ids, texts, strict=True):
                found = words(text)
                own = features(found, how)
                weight = int(shared.value[own].sum())
                rows.append((len(own), weight, weight + noise(None if pd.isna(i) else int(i), how.seed), len(found) >= how.least))
            yield pd.DataFrame(rows, columns=["n_features", "weight", "score", "open"])

    ids = F.col("doc_id").cast("long")
    made = docs.select(ids.alias("doc_id"), score(ids, "text").alias("s")).select("doc_id", "s.*")
    sorted_ = made.sortWithinPartitions(F.desc("open"), F.desc("score"), F.asc_nulls_last("doc_id"))
    return saved(sorted_.withColumn("at", F.monotonically_increasing_id()), "runs")


def splitters(runs: DataFrame, how: Draw) -> list[tuple]:
    """Keys that part the open rows into segments of about one size, from samples at regular
    distance in every run. With s samples per run a segment holds no more than its share and
    one distance of every run, a part of 1 / s of all rows."""
    run = F.shiftright("at", 33)
    sizes = saved(runs.where("open").groupBy(run.alias("run")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    runs_, rows_ = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    segments = max(how.segments, rows_ // how.segment_rows)
    each = max(1, min(segments, how.samples // max(1, runs_)))
    place = F.col("at").bitwiseAND(RUN)
    # Every run gives `each` samples, or all its rows if it has fewer.
    step = F.greatest(F.floor(F.col("n") / each), F.lit(1)).cast("long")
    rows = runs.where("open").withColumn("run", run).join(sizes, "run").where(place % step == 0)
    samples = saved(rows.select("score", "doc_id", "at"), "samples")
    total = samples.count()
    number = F.row_number().over(W.orderBy(*order())) - 1
    distance = max(1, -(-total // segments))
    chosen = samples.withColumn("k", number).where((F.col("k") > 0) & (F.col("k") % distance == 0))
    return sorted(_key(r["score"], r["doc_id"], r["at"]) for r in chosen.collect())


def draw(docs: DataFrame, target: DataFrame, how: Draw = Draw()) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per row of docs.

    docs: doc_id (long), text; target: text. Null and empty texts have no features, weight 0 and
    are never drawn; repeated rows count each and have ranks of their own; a null id draws its
    noise from the empty text and loses ties; an empty table of documents gives no rows, an empty
    target leaves every word of the corpus a loss; other columns play no part. Of n documents of
    at least how.least words the floor(how.percent * n / 100) highest scores are drawn and
    ranked from 1; the rank of all others is null.
    """
    worth = gains(counts(docs, how), counts(target, how))
    runs = scored_runs(docs, worth, how)
    cuts = splitters(runs, how)
    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def segment(score: pd.Series, doc_id: pd.Series, at: pd.Series) -> pd.Series:
        keys = zip(score.tolist(), [None if pd.isna(i) else int(i) for i in doc_id], at.tolist(), strict=True)
        return pd.Series([bisect_right(shared.value, _key(*k)) for k in keys], dtype="int32")

    parted = runs.where("open").withColumn("segment", segment("score", "doc_id", "at"))
    parted = saved(parted, "parted")
    # One row per run and segment, then prefix sums over the segments.
    sizes = {r["segment"]: r["n"] for r in parted.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = how.percent * sum(sizes.values()) // 100
    starts, sofar = {}, 0
    for s in sorted(sizes):
        starts[s] = sofar
        sofar += sizes[s]
    inside = [s for s in starts if starts[s] < drawn]
    columns = ["doc_id", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("long").alias("rank")
    rest = runs.where(~F.col("open")).select(*columns, undrawn)
    if not inside:
        return rest.unionByName(parted.select(*columns, undrawn))
    last = max(inside)
    begin = F.element_at(F.array(*[F.lit(starts.get(s, 0)).cast("long") for s in range(last + 1)]), F.col("segment") + 1)
    # The exchange of segments; each is merged where it arrives.
    place = F.row_number().over(W.partitionBy("segment").orderBy(*order()))
    ranked = parted.where(F.col("segment") <= last).withColumn("rank", begin + place)
    ranked = ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    beyond = parted.where(F.col("segment") > last).select(*columns, undrawn)
    return rest.unionByName(beyond).unionByName(ranked)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
