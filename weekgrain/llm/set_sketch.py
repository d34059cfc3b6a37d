"""Near-duplicate texts by SetSketch registers.

A text is its set of word shingles. Each register of its sketch keeps the smallest of
exponentially distributed hashes, on a logarithmic scale, truncated to 16 bits: sketches of sets
merge by taking the larger register, and equal registers are the likelier the more two sets
share. Bands of registers bring texts together; a joint likelihood over all registers discards
pairs that cannot be similar enough; the rest are verified on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from weekgrain.llm.blocks import blocked, units
from weekgrain.llm.common import forget, free_name, release, releasing, salted_join, saved, table
from weekgrain.llm.graph import components

# Shingles sketched at a time, and rows given back at a time.
BATCH = 1 << 18
ROWS = 2048


@dataclass(frozen=True)
class Sketch:
    """words: of a shingle. percent: least 100 * shared / joint. bands of rows registers each:
    at 80 percent a pair misses all bands once in a hundred thousand times. base, rate: of the
    registers' scale. block: rows of a family that are compared with as many in one unit of work.
    bits: of the filter that picks the texts to be read again, a multiple of 64. doubt: twice the
    log-likelihood that a pair's best similarity may be ahead of `percent` before it is
    discarded; at 36, once in a billion pairs."""

    words: int = 4
    percent: int = 80
    bands: int = 30
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    doubt: float = 36.0
    block: int = 256
    bits: int = 1 << 23

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """Equal registers that a pair similar enough has all but once in a billion times: six
        standard deviations below the least expected number."""
        p = self.percent / 100
        return max(0, math.floor(self.registers * p - 6 * math.sqrt(self.registers * p * (1 - p))))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z lower-cased, words split at
    blanks, tabs and line ends. Fewer words than a shingle are one shingle, none are none."""
    from xxhash import xxh3_64_intdigest

    found = (text or "").encode().lower().split()
    n = len(found)
    if not n:
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter(map(xxh3_64_intdigest, found), dtype=np.uint64, count=n)
    size = min(words, n)
    mixed = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        mixed = (mixed ^ each[k : n - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _keys(count: int) -> np.ndarray:
    """Odd multipliers, one per register."""
    return np.random.default_rng(11).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(sets: list[np.ndarray], how: Sketch) -> np.ndarray:
    """Registers of non-empty sets, one row each, as unsigned 16-bit integers."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    least = np.empty((how.registers, len(sets)), dtype=np.uint64)
    for i, key in enumerate(_keys(how.registers)):
        least[i] = np.minimum.reduceat(flat * key, starts)
    # The smallest uniform value gives the smallest exponential one.
    uniform = (least.T.astype(np.float64) + 0.5) / 2.0**64
    small = -np.log1p(-uniform) / how.rate
    level = np.floor(1.0 - np.log(small) / math.log(how.base))
    return np.clip(level, 0, 65535).astype("<u2")


def _digest(s: np.ndarray) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    return tuple(np.frombuffer(xxh3_128_digest(s.tobytes()), dtype=np.int64).tolist())


def _sketched(texts: Iterable, how: Sketch) -> Iterator[tuple]:
    """(n, a, b, sketch) of each text, in turns of about BATCH shingles."""
    sets: list[np.ndarray] = []

    def done() -> Iterator[tuple]:
        full = [s for s in sets if len(s)]
        rows = iter(sketches(full, how)) if full else iter(())
        for s in sets:
            yield (len(s), *_digest(s), next(rows).tobytes() if len(s) else None)

    size = 0
    for text in texts:
        sets.append(shingles(text, how.words))
        size += len(sets[-1])
        if size >= BATCH:
            yield from done()
            sets, size = [], 0
    yield from done()


def _gap(x: np.ndarray, base: float) -> np.ndarray:
    """Chance that a register of one set is larger, x being its share of own elements."""
    return -np.log1p(-np.clip(x, 0.0, 1.0) * (base - 1.0) / base) / math.log(base)


def likelihoods(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, how: Sketch) -> tuple[np.ndarray, np.ndarray]:
    """Per pair: the greatest log-likelihood over all similarities, and over those that are
    enough, given how many registers of a are larger, how many smaller, and both set sizes."""
    u, v = na / (na + nb), nb / (na + nb)
    most = np.minimum(u / v, v / u)
    best = np.full(more.shape, -np.inf)
    enough = np.full(more.shape, -np.inf)
    equal = how.registers - more - less
    least = how.percent / 100.0
    for j in (*np.linspace(0.0, 1.0, 51), least):
        s = np.minimum(j, most)
        up, down = _gap(u - v * s, how.base), _gap(v - u * s, how.base)
        same = np.maximum(1.0 - up - down, 1e-12)
        value = more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + equal * np.log(same)
        best = np.maximum(best, value)
        if j >= least:
            enough = np.maximum(enough, value)
    return best, enough


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, how: Sketch) -> np.ndarray:
    """Which pairs (rows of registers a and b) may be similar enough."""
    more, less = (a > b).sum(-1), (a < b).sum(-1)
    best, enough = likelihoods(more, less, na, nb, how)
    sizes = 100 * np.minimum(na, nb) >= how.percent * np.maximum(na, nb)
    return sizes & (2 * (best - enough) <= how.doubt)


def _registers(column: pd.Series, how: Sketch) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u2").reshape(len(column), how.registers)


def _told(rows: DataFrame, key: Column, ids: DataFrame, bits: int, name: str) -> DataFrame:
    """rows with one more column, by name: whether key hashes to the bit of one of `ids` (id). The
    bits are a table of bits / 64 rows at most, however many ids there are, sent to every task."""
    word, held = free_name(rows, "word"), free_name(rows, "held")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    own = ids.select(place(F.col("id")).alias("h")).selectExpr("shiftright(h, 6) AS w", "shiftleft(1L, CAST(h & 63 AS INT)) AS b")
    marks = saved(own.groupBy(F.col("w").alias(word)).agg(F.bit_or("b").alias(held)), "marks")
    found = rows.withColumn(word, F.shiftright(place(key), 6)).join(F.broadcast(marks), word, "left")
    bit = F.call_function("shiftright", F.col(held), F.pmod(place(key), F.lit(64)).cast("int")).bitwiseAND(F.lit(1))
    return found.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop(word, held)


def _full_sets(docs: DataFrame, named: DataFrame, how: Sketch) -> DataFrame:
    """id, k1, k2, set: the whole sets of the documents with the ids in `named`, and of a few
    more that share a bit with one. The texts are read again and stay where they are; only these
    reach Python."""
    words = how.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in releasing(batches):
            rows, size = [], 0
            for i, text in zip(batch.column("id"), batch.column("text"), strict=True):
                found = shingles(text.as_py(), words)
                rows.append((i.as_py(), *_digest(found), found.view(np.int64)))
                size += len(found)
                if size >= BATCH:
                    yield made(rows)
                    rows, size = [], 0
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    shape = StructType([StructField("id", docs.schema["doc_id"].dataType), *StructType.fromDDL("k1 long, k2 long, set array<bigint>")])
    schema = to_arrow_schema(shape)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    told = _told(texts, F.col("id"), named, how.bits, "told").where("told")
    return told.select("id", "text").mapInArrow(run, shape)


def _stars(members: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's most connected member."""
    reach = saved(members.groupBy("node").agg(F.sum("n").alias("reach")), "reach")
    ranked = members.join(reach.hint("merge"), "node").groupBy("bucket").agg(
        F.max(F.struct("reach", (-F.col("node")).alias("node"))).alias("top")
    )
    tops = saved(ranked.select("bucket", (-F.col("top.node")).alias("top")), "tops")
    pair = salted_join(members, tops, ["bucket"], F.col("node")).where("node <> top")
    return pair.select(F.least("node", "top").alias("a"), F.greatest("node", "top").alias("b")).distinct()


def _both(pairs: DataFrame, cards: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with the columns of either end, as name_a and name_b."""
    for end in ("a", "b"):
        own = cards.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        pairs = pairs.join(own.hint("merge"), end)
    return pairs


def _linked(pairs: DataFrame, cards: DataFrame, how: Sketch) -> DataFrame:
    """The pairs that set sizes and sketches don't rule out and whose full sets are similar."""

    @F.pandas_udf("boolean")
    def may(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        found = plausible(_registers(a, how), _registers(b, how), na.to_numpy(), nb.to_numpy(), how)
        release()
        return pd.Series(found)

    likely = _both(pairs, cards, ["n_shingles", "sketch"])
    likely = likely.where(may("sketch_a", "sketch_b", "n_shingles_a", "n_shingles_b")).select("a", "b")
    sets = _both(saved(likely, "likely"), cards, ["set"])
    shared = F.size(F.array_intersect("set_a", "set_b"))
    joint = F.size("set_a") + F.size("set_b") - shared
    return sets.where(100 * shared >= how.percent * joint).select("a", "b")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share enough."""
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    shared = int((a[at] == b).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _across_unit(homes: pd.DataFrame, probes: pd.DataFrame, how: Sketch) -> list[tuple[int, int]]:
    """Links between homes and probes that join two components. Only rows that share a bucket are
    compared. A probe tries the likeliest homes first, and none of a component that it has
    reached."""
    registers, sizes = _registers(homes["sketch"], how), homes["n_shingles"].to_numpy()
    ids, own = homes["node"].to_numpy(), homes["component"].to_numpy()
    unsigned = lambda x: np.asarray(x, dtype=np.int64).view(np.uint64)  # noqa: E731  as it was sorted
    sets = [unsigned(x) for x in homes["set"]]
    joined: dict[int, int] = {}

    def top(x: int) -> int:
        while x in joined:
            x = joined[x]
        return x

    out = []
    for row in probes.itertuples(index=False):
        sketch = np.frombuffer(row.sketch, dtype="<u2")
        same = registers == sketch
        equal = same.sum(1)
        fits = 100 * np.minimum(sizes, row.n_shingles) >= how.percent * np.maximum(sizes, row.n_shingles)
        near = np.flatnonzero((equal >= how.least_equal) & fits & (own != row.component))
        near = near[same[near].reshape(-1, how.bands, how.rows).all(2).any(1)]
        if len(near):
            n = np.full(len(near), row.n_shingles)
            near = near[plausible(registers[near], sketch[None, :], sizes[near], n, how)]
        for i in near[np.argsort(-equal[near], kind="stable")]:
            x, y = top(int(own[i])), top(int(row.component))
            if x != y and similar(sets[i], unsigned(row.set), how.percent):
                joined[max(x, y)] = min(x, y)
                out.append((min(int(ids[i]), row.node), max(int(ids[i]), row.node)))
    return out


def _across(cards: DataFrame, families: DataFrame, parts: DataFrame, how: Sketch) -> DataFrame:
    """Links between components of one family, verified on full sets. The largest component of a
    family needs no comparing within; the members of all others meet the whole family, in
    blocks, and only links that join components come out. A family can be large, so its rows
    are spread by their node wherever they are joined."""
    held = families.withColumnRenamed("component", "family").join(parts.hint("merge"), "node", "left")
    held = saved(held.withColumn("component", F.coalesce("component", "node")), "held")
    counts = held.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("family").agg(
        F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component")).alias("top")
    )
    open_ = saved(top.where("parts > 1").select("family", F.col("top.component").alias("main")), "open")
    homes = salted_join(held, open_, ["family"], F.col("node")).where("main is not null")
    homes = saved(saved(homes, "open_rows").join(cards.hint("merge"), "node"), "homes")
    probes = homes.where("component <> main").drop("main")
    work = blocked(homes.drop("main"), probes, ["family"], "node", how.block)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        out = [pair for home, probe in units(frame) for pair in _across_unit(home, probe, how)]
        release()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return work.groupBy("work").applyInPandas(compare, "a long, b long")


def _read(docs: DataFrame, how: Sketch) -> DataFrame:
    """doc_id, mark, n_shingles, k1, k2, sketch: one row per row of docs. Texts are taken from their
    batch one by one, so a task holds the batch and about BATCH shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in releasing(batches):
            found, at = _sketched((t.as_py() for t in batch.column("text")), how), 0
            while rows := list(islice(found, ROWS)):
                own = [batch.column(c).slice(at, len(rows)) for c in ("doc_id", "mark")]
                columns = [*own, *map(list, zip(*rows, strict=True))]
                made = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays(made, schema=schema)
                at += len(rows)

    shape = StructType([docs.schema["doc_id"], *StructType.fromDDL("mark long, n_shingles long, k1 long, k2 long, sketch binary")])
    schema = to_arrow_schema(shape)
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, shape)


def _classes(docs: DataFrame, how: Sketch) -> DataFrame:
    """doc_id, n_shingles, component_id, main, mark: one row per row of docs. main: whether the row
    has the set that stands for its component; mark: a hash of its text."""
    seen = saved(_read(docs, how), "sketches")
    sets = (
        seen.where("n_shingles > 0 and doc_id is not null")
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    )
    # A number per different set; ids can be shared by unlike texts.
    nodes = saved(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    size = 2 * how.rows
    band = lambda i: F.xxhash64(i, F.substring("sketch", i * size + 1, F.lit(size)))
    listed = nodes.select(
        "node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(how.bands - 1)), band)).alias("bucket")
    )
    full = saved(listed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = saved(listed.join(full.hint("merge"), "bucket"), "members")

    # Only texts that share a bucket with another are compared: their sketches and full sets.
    named = members.select("node").distinct().join(nodes.hint("merge"), "node")
    named = saved(named.select("node", "id", "k1", "k2", "n_shingles", "sketch"), "named")
    cards = _full_sets(docs, named.select("id"), how).join(named.hint("merge"), ["id", "k1", "k2"])
    cards = saved(cards.dropDuplicates(["node"]).select("node", "n_shingles", "sketch", "set"), "cards")

    stars = saved(_stars(members), "stars")
    links = saved(_linked(stars, cards, how), "star_links")
    rest = _across(cards, saved(components(stars), "families"), saved(components(links), "parts"), how)
    parts = saved(components(links.union(saved(rest, "across"))), "parts")

    # The smallest id of each component, and the set that has it.
    own = parts.join(nodes.select("node", "id").hint("merge"), "node")
    tops = own.groupBy("component").agg(F.min(F.struct("id", "node")).alias("top"))
    named_ = salted_join(own, saved(tops, "tops"), ["component"], F.col("node"))
    linked = saved(named_.select("node", F.col("top.id").alias("component_id"), F.col("top.node").alias("chosen")), "linked")
    result = nodes.join(linked.hint("merge"), "node", "left").select(
        "k1", "k2",
        F.coalesce("component_id", "id").alias("component_id"),
        (F.coalesce("chosen", "node") == F.col("node")).alias("main"),
    )
    out = salted_join(seen.drop("sketch"), saved(result, "result"), ["k1", "k2"], F.col("doc_id"))
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | F.col("main")).alias("main"),
        "mark",
    )


def groups(docs: DataFrame, how: Sketch = Sketch()) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs.

    Texts link when 100 * shared >= how.percent * joint shingles; a component is what links
    reach, and its id the smallest doc_id in it. Null and empty texts have an empty set and link
    with nothing; a null id has no component and links with nothing; unlike texts that share an
    id are in components of their own; an empty table gives no rows; columns other than doc_id
    and text play no part.

    Texts of one set are one node, and only nodes are compared. The members of a bucket are
    first compared with its best connected one. Buckets that share members are a family; rows of
    a family that then still lie in different components, and share a bucket, are compared in
    blocks, so no link between components is left out however large a bucket is.
    """
    return _classes(docs, how).select("doc_id", "n_shingles", "component_id")


def kept() -> Column:
    return F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))


def deduplicated(docs: DataFrame, how: Sketch = Sketch(words=5)) -> DataFrame:
    """docs with one row of each group, that of the smallest id, with the columns of docs. Of
    rows with the same id and text one stays; unlike texts that share an id are judged each for
    itself; rows with a null id all stay, and texts without words, one for each id; an empty
    table stays empty."""
    found = _classes(docs, how).where("doc_id is not null")
    stays = F.col("main") & (F.col("doc_id") == F.col("component_id"))
    keys = found.groupBy("doc_id", "mark").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("n"))
    touched = saved(keys.where("not stays or n > 1"), "touched")

    # Texts move only if their row may be one of these, as bits of fixed number tell.
    mark = free_name(docs, "mark")
    marked = docs.where("doc_id is not null").withColumn(mark, F.xxhash64("text"))
    told = free_name(marked, "told")
    keys = touched.select(F.xxhash64("doc_id", "mark").alias("id"))
    marked = _told(marked, F.xxhash64("doc_id", mark), keys, how.bits, told)
    doubtful = marked.where(F.col(told))
    named = touched.withColumnRenamed("mark", mark)
    once = doubtful.join(named, ["doc_id", mark], "left_anti")
    repeated = doubtful.join(named.where("stays"), ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    out = marked.where(~F.col(told)).unionByName(once).unionByName(repeated)
    return out.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("kept", kept())
