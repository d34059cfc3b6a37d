"""Runs of periodic text, by tiles of the scale of the period.

Periods fall into octaves P <= q < 2P. For each octave a document is cut into tiles of 16P words,
each half over the next, and at least BASE words, so that low octaves share their tiles and a
short document is one tile for all of its octaves. Tiles are rows of a table of their own, so a
document of any length is dealt out over tasks.

In a tile, every P-th word is a boundary. A stretch of period q and at least 3q words holds a
boundary b with the words b to b+q repeated right behind. The Z-function at the boundary, over
4P words, gives that repetition for all q of the octave at once, and the smallest period there;
a stretch is then followed to both sides within the tile. Boundaries without a word pattern
that returns one period later are passed over: they cannot hold a repetition.

A stretch that touches a tile's edge may go on in the next. Fragments are shuffled by document
and period, and those that overlap by a period or more are one run.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weekgrain.llm.common import saved, table

BASE = 1 << 14
# Least words of a run, and least periods that it holds.
LEAST, REPEATS = 6, 4


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def tiles(n: int, base: int = BASE) -> list[tuple[int, int, int, int]]:
    """(start, stop, lowest octave, octave after the highest) of a document of n words. A tile is
    half over the next one; octaves with the same tiles share them."""
    octaves = max(1, (n // REPEATS).bit_length())
    by_size: dict[int, list[int]] = {}
    for k in range(octaves):
        by_size.setdefault(min(max(base, 16 << k), max(n, 1)), []).append(k)
    out = []
    for size, own in by_size.items():
        last = max(0, n - size)
        starts = range(0, last + size // 2, size // 2) if last else [0]
        out += [(s, min(s + size, n), own[0], own[-1] + 1) for s in starts]
    return out


def z_function(u: list[int]) -> list[int]:
    """z[i]: how many values from i on equal those from the start on."""
    n = len(u)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and u[k] == u[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """How many values from the start on are equal, looked at in steps of doubling length."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        differ = np.flatnonzero(x[at : at + step] != y[at : at + step][: n - at])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def _patterns(codes: np.ndarray, length: int) -> np.ndarray:
    """A number for the `length` words from each place on; equal words have equal numbers."""
    n = len(codes) - length + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(length if n > 0 else 0):
        out = (out ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _doubtful(codes: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """(boundary, q) of one octave where the words behind the boundary may be repeated q words
    on: patterns at the start and at the end of the q words agree."""
    size = min(period, 4)
    p = _patterns(codes, size)
    there = np.flatnonzero(p[period:] == np.repeat(p[::period], period)[: max(len(p) - period, 0)])
    b = there // period * period
    q = there + period - b
    whole = b + 2 * q <= len(codes)
    b, q = b[whole], q[whole]
    same = p[b + q - size] == p[b + 2 * q - size]
    return b[same], q[same]


def fragments(codes: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """(start, stop, period) of the maximal stretches of a tile with a smallest period in the
    octaves low to high, the latter not included, and at least three periods."""
    out: list[tuple[int, int, int]] = []
    wide = codes.astype(np.uint64)
    for octave in range(low, high):
        period = 1 << octave
        b, q = _doubtful(wide, period)

        def explained(b: np.ndarray, q: np.ndarray, found: list[tuple[int, int, int]]) -> np.ndarray:
            """Which repetitions lie in a known stretch whose period divides theirs."""
            known = np.zeros(len(b), dtype=bool)
            for start, stop, own in found:
                known |= (q % own == 0) & (start <= b) & (b + 2 * q <= stop)
            return known

        open_ = ~explained(b, q, out)
        b, q = b[open_], q[open_]
        while len(b):
            at, same = int(b[0]), b == b[0]
            z = z_function(codes[at : at + 4 * period].tolist())
            # The smallest period of the next 2P words, if it shows: a repeated stretch of q
            # words is itself a repetition just if this period divides q.
            root = next((p for p in range(1, min(2 * period, len(z))) if z[p] + p >= 2 * period), 0)
            new = []
            for x in q[same].tolist():
                if z[x] < x or (root and root < x and x % root == 0 and z[root] + root >= x):
                    continue
                start = at - _agree(codes[:at][::-1], codes[: at + x][::-1])
                stop = at + x + _agree(codes[at + x :], codes[at:])
                if stop - start >= 3 * x:
                    new.append((start, stop, x))
            b, q = b[~same], q[~same]
            if new:
                out += new
                open_ = ~explained(b, q, new)
                b, q = b[open_], q[open_]
    return out


def planted(found: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail in about one of ten documents, as the id's checksum says."""
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    g, n = h // 10, len(found)
    if h % 10 or not n:
        return found
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return found[:a] + [found[a + i % p] for i in range(n - a)]


def cut(docs: DataFrame, plant: bool = False, base: int = BASE) -> DataFrame:
    """One row per tile: at (number of the document's row), doc_id, n (its words), start, stop,
    low, high, words (of the tile, parted by blanks). Written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for at, i, text in zip(*[batch.column(c).to_pylist() for c in ("at", "doc_id", "text")], strict=True):
                found = words(text)
                found = planted(found, i) if plant else found
                for start, stop, low, high in tiles(len(found), base):
                    held.append((at, i, len(found), start, stop, low, high, b" ".join(found[start:stop])))
                    size += len(held[-1][-1])
                    if size >= 1 << 23:
                        yield _batch(held, schema)
                        held, size = [], 0
            if held:
                yield _batch(held, schema)

    shape = "at long, doc_id long, n long, start long, stop long, low int, high int, words binary"
    schema = _arrow(docs.sparkSession, shape)
    numbered = docs.select(F.monotonically_increasing_id().alias("at"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return saved(numbered.mapInArrow(run, shape), "tiles")


def _arrow(spark: SparkSession, shape: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(shape))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def solve(tiled: DataFrame) -> DataFrame:
    """at, doc_id, n, start, whole (digest of the text, if the tile is the document and holds no
    run), words (else, of the tile's part up to the next one), found (array of fragments).
    Fragments that end within the tile are there if they are runs; those at its edges from
    three periods on. Written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                at, doc_id, n, start, stop, low, high, text = r
                found = text.split()
                number: dict[bytes, int] = {}
                codes = np.fromiter((number.setdefault(w, len(number)) for w in found), dtype=np.int32, count=len(found))
                kept = []
                for s, e, q in fragments(codes, low, high):
                    edge = (s == 0 and start > 0) or (e == len(found) and stop < n)
                    if edge or e - s >= max(LEAST, REPEATS * q):
                        kept.append({"start": start + s, "stop": start + e, "period": q})
                one = low == 0 and start == 0 and stop == n  # for all octaves
                whole = sha256(text).hexdigest() if one and not kept else None
                # Of the tiles of octave 0 the first halves, and the last one, make the text.
                own = None
                if low == 0 and whole is None:
                    own = text if stop == n else b" ".join(found[: len(found) // 2])
                rows.append((at, doc_id, n, start, whole, own, kept))
            yield _batch(rows, schema)

    names = ("at", "doc_id", "n", "start", "stop", "low", "high", "words")
    shape = (
        "at long, doc_id long, n long, start long, whole string, words binary,"
        " found array<struct<start:long,stop:long,period:long>>"
    )
    schema = _arrow(tiled.sparkSession, shape)
    return saved(tiled.select(*names).mapInArrow(run, shape), "solved")


def stitch(solved: DataFrame) -> DataFrame:
    """at, start, length, period of every run: fragments of one document and period that overlap
    by the period or more are one."""
    parts = solved.select("at", F.inline("found"))
    key = W.partitionBy("at", "period").orderBy("start", "stop")
    before = F.max("stop").over(key.rowsBetween(W.unboundedPreceding, -1))
    fresh = before.isNull() | (F.col("start") + F.col("period") > before)
    group = F.sum(F.when(fresh, 1).otherwise(0)).over(key.rowsBetween(W.unboundedPreceding, 0))
    whole = (
        parts.withColumn("group", group)
        .groupBy("at", "period", "group")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .withColumn("length", F.col("stop") - F.col("start"))
    )
    enough = F.col("length") >= F.greatest(F.lit(LEAST), REPEATS * F.col("period"))
    return whole.where(enough).select("at", "start", "length", "period")


def collapsed(parts: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text without words that a run holds after its first period."""
    found = b" ".join(parts).split()
    keep = np.ones(len(found), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([found[i] for i in np.flatnonzero(keep).tolist()])


def _longest(runs: Column) -> Column:
    order = lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("b"), r["period"].alias("c"))
    best = F.array_min(F.transform(runs, order))
    return F.struct(best["b"].alias("start"), (-best["a"]).alias("length"), best["c"].alias("period"))


def runs(docs: DataFrame, plant: bool = False, base: int = BASE) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period), text (the
    collapsed one of documents with runs, else null), text_sha256: one row per row of docs.

    docs: doc_id (long), text. Null and empty texts have no words and no runs; a null id is a
    document like others; repeated rows count each; an empty table gives no rows; other columns
    play no part. plant: give some documents a periodic tail first, see `planted`.
    """
    solved = solve(cut(docs, plant, base))
    done = F.col("whole").isNotNull()
    clean = solved.where(done).select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.expr("cast(array() as array<struct<start:long,length:long,period:long>>)").alias("runs"),
        F.lit(None).cast("string").alias("text"),
        F.col("whole").alias("text_sha256"),
    )
    found = stitch(solved).groupBy("at").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("r"))
    found = found.select("at", F.transform("r", lambda r: F.struct(r["start"], r["length"], r["period"])).alias("runs"))
    texts = solved.where(~done & F.col("words").isNotNull()).groupBy("at").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n").alias("n_words"),
        F.transform(F.sort_array(F.collect_list(F.struct("start", "words"))), lambda p: p["words"]).alias("parts"),
    )
    both = texts.join(found, "at", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, n, parts, own in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                own = own or []
                text = collapsed(parts, [(r["start"], r["length"], r["period"]) for r in own])
                rows.append((i, n, own, text.decode() if own else None, sha256(text).hexdigest()))
            yield _batch(rows, schema)

    names = ("doc_id", "n_words", "parts", "runs")
    shape = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string, text_sha256 string"
    schema = _arrow(docs.sparkSession, shape)
    return clean.unionByName(both.select(*names).mapInArrow(finish, shape))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(table(spark, sf_dir, "documents").select("doc_id", "text"), plant=True)
    best = _longest(F.col("runs"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.col("text_sha256").alias("collapsed_sha256"),
    )
