"""Benchmark decontamination by winnowing, in DataFrame operations only.

Documents and items are reduced to the smallest hash of every window of consecutive k-grams.
A run of WINDOW shared words contains a whole such window on both sides, so both keep the same
smallest hash: no shared run is missed. Documents that share a fingerprint with an item are
read again, and the hits extended to exact word positions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrain.llm.common import LOWER, UPPER, saved, table

WINDOW = 10
GRAM = 5
# fixed value: what separates words, after A-Z are lower-cased
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    # lower() would touch letters beyond A-Z; it is only used where there are none.
    folded = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(folded, GAPS), lambda w: w != "")


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _starts(size: Column, span: int) -> Column:
    """0-based places at which a run of span elements can begin."""
    last = size - F.lit(span)
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, length: int) -> Column:
    """One hash for every run of length words."""
    return F.transform(
        _starts(F.size(hashes), length),
        lambda i: F.xxhash64(*(F.get(hashes, i + F.lit(j)) for j in range(length))),
    )


def with_fingerprints(df: DataFrame, length: int, name: str) -> DataFrame:
    """df, which has hashes, plus a column: the smallest k-gram hash of every window of
    `length` words, each once. Where a run of `length` words is shared, one of them is."""
    gram = min(GRAM, length)
    span = length - gram + 1
    # The grams are a column of their own: inside the lambda they would be made per element.
    df = df.withColumn("grams", _grams(F.col("hashes"), gram))
    least = lambda i: F.least(*(F.get(F.col("grams"), i + F.lit(j)) for j in range(span)))
    marks = F.transform(_starts(F.size("grams"), span), least) if span > 1 else F.col("grams")
    return df.withColumn(name, F.array_distinct(marks)).drop("grams")


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, words, length: of its windows. Items without words have no window."""
    item = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    return item.withColumn("length", F.least(F.size("words"), F.lit(WINDOW)))


def _windows(items: DataFrame) -> DataFrame:
    """item_id, length, gram (hash), window (its words): every window of every item, once."""
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    window = items.select("item_id", "length", "words", F.explode(starts).alias("at")).select(
        "item_id", "length", F.slice("words", F.col("at"), F.col("length")).alias("window")
    )
    return window.withColumn("gram", F.xxhash64("window")).distinct()


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, text_key, n_words, n_hit, items (sorted as strings).

    docs needs doc_id and text, benchmark item_id and text; other columns play no part. A null
    or empty text has no words; items without words hit nothing; items of fewer words than
    WINDOW are one window; repeated rows give the same result each; an empty table on either
    side gives no hits. Null ids are ids like others.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    items = saved(_items(benchmark), "items")
    # At most WINDOW values: the lengths of windows.
    lengths = sorted(r[0] for r in items.select("length").distinct().collect()) or [WINDOW]
    marks = [f"marks_{n}" for n in lengths]
    read = docs.select("doc_id", "text_key", words(F.col("text")).alias("words")).select(
        "doc_id", "text_key", F.size("words").alias("n_words"), _hashes(F.col("words")).alias("hashes")
    )
    for n, m in zip(lengths, marks, strict=True):
        read = with_fingerprints(read, n, m)
    read = saved(read.drop("hashes").withColumn("n_words", F.col("n_words").cast("bigint")), "fingerprints")

    # Which documents share a fingerprint with which items. The items' side is a written table:
    # the planner broadcasts it only if its files are small, and else joins by sorting.
    test = items.withColumn("hashes", _hashes(F.col("words")))
    sides = []
    for n, m in zip(lengths, marks, strict=True):
        # Written before it is unfolded: the planner would else merge the projections and make
        # all hashes anew for every element.
        own = saved(with_fingerprints(test.where(F.col("length") == n), n, "mark").select("mark"), f"item_{m}")
        own = saved(own.select(F.explode("mark").alias("mark")).distinct(), m)
        sides.append(read.select("doc_id", "text_key", F.explode(m).alias("mark")).join(own, "mark", "left_semi"))
    suspects = reduce(DataFrame.union, sides).select("doc_id", "text_key").distinct()
    suspects = saved(suspects, "suspects")

    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    again = docs.join(suspects, same(docs, suspects), "left_semi").select(
        "doc_id", "text_key", words(F.col("text")).alias("words")
    )
    windows = saved(_windows(items), "windows")
    hits = []
    for n in lengths:
        place = again.select(
            "doc_id", "text_key", "words", F.explode(_starts(F.size("words"), n)).alias("at")
        ).select("doc_id", "text_key", "at", F.slice("words", F.col("at") + 1, n).alias("found"))
        place = place.withColumn("gram", F.xxhash64("found"))
        own = windows.where(F.col("length") == n).select("item_id", "gram", "window")
        hits.append(
            place.join(own, "gram")
            .where(F.col("found") == F.col("window"))
            .select("doc_id", "text_key", "item_id", "at", F.lit(n).alias("length"))
        )
    hit = reduce(DataFrame.union, hits)
    # A run of words counts once however many windows cover it.
    reach = hit.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("at", "length")).alias("runs"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    covered = F.size(
        F.array_distinct(
            F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["at"] + r["length"] - 1)))
        )
    )
    reach = reach.select(
        F.col("doc_id").alias("hit_doc"),
        F.col("text_key").alias("hit_key"),
        covered.cast("bigint").alias("n_hit"),
        "items",
    )
    reach = saved(reach, "hits")
    on = read["doc_id"].eqNullSafe(reach["hit_doc"]) & (read["text_key"] == reach["hit_key"])
    return read.join(reach, on, "left").select(
        read["doc_id"],
        read["text_key"],
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that share no window with any item, with the columns of docs."""
    bad = find(docs, benchmark).where("n_hit > 0").select(
        F.col("doc_id").alias("bad_doc"), F.col("text_key").alias("bad_key")
    )
    bad = saved(bad.distinct(), "contaminated")
    on = docs["doc_id"].eqNullSafe(bad["bad_doc"]) & (F.xxhash64(docs["text"]) == bad["bad_key"])
    return docs.join(bad, on, "left_anti")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '') AS w
  FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '') AS w
  FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, pos, pos + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, pos, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS pos FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, dw.n AS n, pos, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
