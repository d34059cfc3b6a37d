"""Best-fit packing by a configuration linear program.

Token pieces are packed into sequences of fixed capacity. A configuration says how many pieces
of each length share a sequence; the program covers the length histogram with the fewest of
them. Multiplicative weights price the lengths, a knapsack dynamic program finds the most
valuable configuration for every length at once, and the fractional solution is rounded to whole
sequences; what rounding leaves over goes in by best fit. All of this works on the histogram,
which has at most as many entries as the capacity. Pieces are then numbered within their length
and each finds its place in the plan by its number.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from weekgrain.llm.common import releasing, saved, table
from weekgrain.llm.word_ids import texts_of, word_ids

CAPACITY = 4096
END_ID = 1
# Bytes of text encoded at a time.
SLICE = 1 << 22
PIECE = [
    StructField("piece", IntegerType()),
    *[StructField(name, LongType()) for name in ("start", "length", "ids_crc32", "place")],
]


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids: whole if it fits, else full pieces and
    a last one."""
    step = 4 * capacity
    parts = (ids[i : i + step] for i in range(0, len(ids), step))
    return [(k, k * capacity, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(parts)]


def numbered_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's number (place) among those of its
    length in its part of the table (part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, seen = word_ids(path), Counter()
        for batch in releasing(batches):
            for part, texts in texts_of(batch.column("text"), SLICE):
                ids, sizes = machine.closed(texts, END_ID)
                packed, at, rows = ids.tobytes(), 0, []
                for row, size in enumerate((4 * sizes).tolist(), part.start):
                    for piece, start, length, crc in cut(packed[at : at + size], capacity):
                        rows.append((row, piece, start, length, crc, seen[length]))
                        seen[length] += 1
                    at += size
                found = np.asarray(rows, dtype=np.int64).T
                made = [batch.column("doc_id").take(pa.array(found[0])), *map(pa.array, found[1:])]
                yield pa.RecordBatch.from_arrays([m.cast(t.type) for m, t in zip(made, schema, strict=True)], schema=schema)

    columns = docs.select("doc_id", "text")
    out = StructType([columns.schema["doc_id"], *PIECE])
    schema = to_arrow_schema(out)
    # An operator of its own, so that no filter can pull a second run of it below another.
    return columns.mapInArrow(run, out).withColumn("part", F.spark_partition_id())


@dataclass(frozen=True)
class Pattern:
    """`times` sequences that each hold `items`: (length, how many), longest first."""

    items: tuple[tuple[int, int], ...]
    times: int


def knapsack(value: np.ndarray, capacity: int) -> np.ndarray:
    """pick[c]: a length to put into room c for the greatest total value, 0 to leave one unused.
    value[l] is the value of length l, -inf where there is none."""
    best = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        worth = value[1 : room + 1] + best[room - 1 :: -1] if room > 1 else value[1:2] + best[:1]
        k = int(worth.argmax())
        if worth[k] > best[room - 1]:
            best[room], pick[room] = worth[k], k + 1
        else:
            best[room] = best[room - 1]
    return pick


def _fill(first: int, pick: np.ndarray, capacity: int) -> tuple[tuple[int, int], ...]:
    """The most valuable configuration that holds the length `first`."""
    items = Counter({first: 1})
    room = capacity - first
    while room > 0:
        length = int(pick[room])
        if length:
            items[length] += 1
            room -= length
        else:
            room -= 1
    return tuple(sorted(items.items(), reverse=True))


def solve(demand: np.ndarray, capacity: int, rounds: int = 24, rate: float = 1.0) -> dict:
    """Fractional configurations that cover demand[l] pieces of each length l.

    Round t covers t / rounds of the demand: lengths that lack cover, longest first, bring the
    configuration of the round's prices that holds them. After each round the price of a length
    falls exponentially with its excess of cover.
    """
    lengths = np.flatnonzero(demand)
    share = np.arange(capacity + 1) / capacity
    weight = np.zeros(capacity + 1)
    cover = np.zeros(capacity + 1)
    amount: Counter = Counter()
    for t in range(1, rounds + 1):
        value = np.full(capacity + 1, -np.inf)
        value[lengths] = share[lengths] * np.exp(weight[lengths])
        pick = knapsack(value, capacity)
        due = demand * (t / rounds)
        for length in lengths[::-1]:
            lack = due[length] - cover[length]
            if lack <= 0:
                continue
            items = _fill(int(length), pick, capacity)
            x = lack / dict(items)[int(length)]
            amount[items] += x
            for l, n in items:
                cover[l] += n * x
        excess = cover[lengths] / due[lengths] - 1.0
        weight[lengths] = np.clip(weight[lengths] - rate * np.clip(excess, -1.0, 1.0) / np.sqrt(t), -3.0, 3.0)
    return amount


def _best_fit(left: np.ndarray, capacity: int) -> Iterator[Pattern]:
    """Sequences for what is left: the longest piece, then whatever fills the room exactly, alone
    or as a pair, else the longest that fits. Repeated as often as the pieces allow."""
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return
        items = Counter()
        room = capacity
        take = int(there[-1])
        while take:
            items[take] += 1
            room -= take
            left[take] -= 1
            take = 0
            if room and left[room]:
                take = room
            elif room > 1:
                small = left[: room + 1] > 0
                pair = np.flatnonzero(small[1:room] & small[room - 1 : 0 : -1]) + 1
                pair = pair[(pair * 2 != room) | (left[pair] > 1)]
                fits = pair if len(pair) else np.flatnonzero(small)
                take = int(fits[-1]) if len(fits) else 0
        times = 1 + min(int(left[l]) // n for l, n in items.items())
        for l, n in items.items():
            left[l] -= n * (times - 1)
        yield Pattern(tuple(sorted(items.items(), reverse=True)), times)


def plan(demand: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Whole sequences that hold every piece once.

    Whole parts of the fractional solution come first, then full configurations with a fraction,
    largest first, each as far as pieces are left; best fit takes the rest.
    """
    left = demand.astype(np.int64).copy()
    out = []

    def take(items, times: int) -> None:
        times = min([times, *(int(left[l]) // n for l, n in items)])
        if times > 0:
            for l, n in items:
                left[l] -= n * times
            out.append(Pattern(items, times))

    if left.any():
        found = sorted(solve(demand.astype(float), capacity).items(), key=lambda x: (-x[1], x[0]))
        for items, x in found:
            take(items, int(x))
        for items, x in sorted(found, key=lambda x: (int(x[1]) - x[1], x[0])):
            if sum(l * n for l, n in items) == capacity:
                take(items, 1)
        out += _best_fit(left, capacity)
    return out


@dataclass(frozen=True)
class Places:
    """Where the k-th piece of a length goes. starts: first entry of each length; the entries,
    by length: pieces up to its end, first sequence, pieces per sequence, first offset."""

    starts: np.ndarray
    ends: np.ndarray
    base: np.ndarray
    each: np.ndarray
    offset: np.ndarray


def places(patterns: list[Pattern], capacity: int) -> Places:
    entries = []
    sequence = 0
    for p in patterns:
        at = 0
        for length, n in p.items:
            entries.append((length, p.times * n, sequence, n, at))
            at += length * n
        sequence += p.times
    entries.sort(key=lambda e: (e[0], e[2]))
    table = np.asarray(entries, dtype=np.int64).reshape(-1, 5)
    starts = np.searchsorted(table[:, 0], np.arange(capacity + 2))
    ends = table[:, 1].copy()
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        ends[a:b] = np.cumsum(ends[a:b])
    return Places(starts, ends, table[:, 2], table[:, 3], table[:, 4])


def locate(p: Places, length: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces of one length with the given numbers."""
    a, b = p.starts[length], p.starts[length + 1]
    entry = a + np.searchsorted(p.ends[a:b], number, side="right")
    before = np.where(entry > a, p.ends[entry - 1], 0)
    within = number - before
    return p.base[entry] + within // p.each[entry], p.offset[entry] + within % p.each[entry] * length


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A null or empty text is the end id alone; repeated rows are packed each; an empty table
    gives no rows; other columns are left out. Only documents longer than the capacity are cut.
    The driver sees the histogram, at most `capacity` rows; tasks get the plan, whose size
    depends on the histogram, not on the number of pieces.
    """
    # Written out, as the numbers of the pieces hold for one run only.
    cut_up = saved(numbered_pieces(docs, path, capacity), "pieces")
    per_part = cut_up.groupBy("length", "part").agg((F.max("place") + 1).alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row per part in each window: the parts of the table, not its pieces.
    starts = saved(per_part.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "starts")
    demand = np.zeros(capacity + 1, dtype=np.int64)
    for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        demand[r["length"]] = r["n"]
    where = docs.sparkSession.sparkContext.broadcast(places(plan(demand, capacity), capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), dtype=np.int64)
        sizes, numbers = length.to_numpy(), number.to_numpy()
        for size in np.unique(sizes):
            at = sizes == size
            out[at, 0], out[at, 1] = locate(where.value, int(size), numbers[at])
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    numbered = cut_up.join(starts.drop("n"), ["length", "part"])
    return numbered.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        place("length", F.col("first") + F.col("place")).alias("p"),
    ).select("doc_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
