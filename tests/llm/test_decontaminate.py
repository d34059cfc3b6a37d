import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weekgrain.llm import decontaminate as dc
from helpers_llm import rows


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, other in items:
        w = words(other)
        n = min(10, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1 if n else 0):
            if tuple(own[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(own), len(hit), sorted(found)


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "Short item É9"), (10, "one"), (3, ""), (4, None), (5, "-- !!"), (6, "a a a a a a a a a a a a a"),
    (2, "five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (None, "null id item words"),
]
TEXTS = [
    "x ONE,two three four five six seven eight nine ten y", "short ITEM É9 short item é9", "two three", "a " * 40, None, "",
    "zero one two three four five six seven eight nine", "five six seven eight nine ten eleven twelve thirteen fourteen",
    "x null id item words y", "ONE\x00one", "b a a a a a a a a a a c one", " ".join(["filler"] * 3000 + ["short item É9"]),
]


def test_against_all_windows(shipped):
    docs = [(i, t, 1, "n") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 1, "n"), (None, TEXTS[1], 1, "n"), (0, TEXTS[7], 2, "n")]
    df = shipped.createDataFrame(docs, "doc_id long, text string, n_hit int, words string")
    bench = shipped.createDataFrame([(*x, "e") for x in ITEMS], "item_id long, text string, gram string")
    got = rows(dc.find(df, bench).select("doc_id", "n_words", "n_hit", F.array_join("items", ",")))
    kept = [(i, t) for i, t in ITEMS if i is not None]
    want = []
    for doc, text, *_ in docs:
        n, hit, found = brute(text, kept + [(None, "null id item words")])
        want.append((doc, n, hit, ",".join(x for x in found if x != "None")))
    assert got == sorted(want, key=repr)
    left = dc.decontaminated(df, bench)
    assert left.columns == df.columns
    clean = [(d, t) for d, t, *_ in docs if not brute(t, ITEMS)[1]]
    assert rows(left.select("doc_id", "text")) == sorted(clean, key=repr)
    assert dc.find(df.where("false"), bench).count() == 0
    assert dc.find(df, bench.where("false")).where("n_hit > 0").count() == 0


def test_odd_rows(odd_docs, no_docs):
    bench = odd_docs.select(F.col("doc_id").alias("item_id"), F.lit("beta gamma delta epsilon").alias("text"))
    got = {(r["doc_id"], r["n_hit"]) for r in dc.find(odd_docs, bench).collect()}
    assert got == {(1, 4), (2, 0), (3, 0), (4, 0), (5, 0), (None, 0)}
    assert dc.decontaminated(no_docs, bench).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=10, max_size=30), st.integers(0, 20))
def test_shared_runs_share_a_fingerprint(tokens, at):
    """The guarantee of winnowing, on plain lists: the least 5-gram of any ten shared tokens is
    a fingerprint of both sides."""
    def marks(x):
        grams = [hash(tuple(x[i : i + 5])) for i in range(len(x) - 4)]
        return {min(grams[i : i + 6]) for i in range(len(grams) - 5)}

    run = tokens[:10]
    assert marks(tokens) & marks([9] * at + run + [8] * 3)


def test_query_against_sql(shipped, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    want = con.sql(dc.OP8_SQL)
    got = dc.op8(shipped, sf_dir).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
