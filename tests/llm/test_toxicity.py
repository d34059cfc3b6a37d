import zlib

import numpy as np
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from weekgrain.llm import toxicity as tx


def all_maximal(x):
    """Maximal segments by definition: the best segment, then the same left and right of it."""
    best = max(((sum(x[i:j]), -j, i) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i, j = best[2], -best[1]
    return all_maximal(x[:i]) + [(best[0], i, j - 1)] + [(s, a + j, b + j) for s, a, b in all_maximal(x[j:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-3, 5), max_size=14))
def test_segment_totals(values):
    got = tx.segments([float(v) for v in values], list(range(len(values))), -0.25)
    want = all_maximal(values)
    assert sum(s for s, _, _ in got) == sum(s for s, _, _ in want)
    assert max((s for s, _, _ in got), default=0) == max((s for s, _, _ in want), default=0)
    assert all(a <= b < c for (_, a, b), (_, c, _) in zip(got, got[1:]))


def test_gaps_between_listed_positions_cost():
    assert tx.segments([3.0, 3.0], [0, 5], -0.25) == [(5.0, 0, 5)]
    assert tx.segments([1.0, 1.0], [0, 9], -0.25) == [(1.0, 0, 0), (1.0, 9, 9)]


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{''.join(rng.choice(list('abcdefgh'), 4))}" for _ in range(rng.integers(5, 120))]
        bad = i % 5 == 0
        if bad:
            at = int(rng.integers(len(words)))
            words[at:at] = list(rng.choice(["vileone", "nastyx", "rottenq"], 3))
        docs.append((i, " ".join(words), "en", i))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_documents_are_judged_right(shipped):
    docs, labels = corpus(800, 1)
    d = shipped.createDataFrame(docs, "doc_id long, text string, toxic string, fold int")
    model = tx.train(d, shipped.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.scores["vileone"] > 0
    truth = dict(labels)
    got = tx.score(d, model).select("doc_id", "toxicity.*").collect()
    out = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([(r["score"] >= 0.3) == bool(truth[r["doc_id"]]) for r in out]) >= 0.97
    assert all(r["n_segments"] == len(r["passages"]) for r in got)


def test_held_out_labels_are_not_used(shipped):
    docs, labels = corpus(200, 2)
    d = shipped.createDataFrame(docs, "doc_id long, text string, toxic string, fold int")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    flipped = [(i, 1 - t if held(i) else t) for i, t in labels]
    one = tx.train(d, shipped.createDataFrame(labels, "doc_id long, toxic int"))
    two = tx.train(d, shipped.createDataFrame(flipped, "doc_id long, toxic int"))
    assert one == two


def test_odd_rows(shipped, odd_docs, no_docs):
    labels = shipped.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (4, 0), (9, 7)], "doc_id long, toxic int")
    for model in (tx.train(odd_docs, labels), tx.train(no_docs, labels), tx.train(odd_docs, labels.where("false"))):
        got = tx.score(odd_docs, model).collect()
        assert len(got) == odd_docs.count()
        assert all(0 <= r["toxicity"]["score"] <= 1 for r in got)
    assert tx.score(no_docs, tx.EMPTY).count() == 0


def test_query_columns(shipped, sf_dir):
    rows = tx.op9(shipped, sf_dir).collect()
    assert len(rows) == shipped.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1


def test_words_of_a_rare_language_are_learned(shipped):
    docs, labels = corpus(600, 3)
    rng = np.random.default_rng(4)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    for i in range(1000, 1060):
        words = [f"z{''.join(rng.choice(list('klmnop'), 4))}" for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            words[7:7] = ["zmalvado", "zhorrible", "zmalvado"]
        docs.append((i, " ".join(words), "es", i))
        labels.append((i, int(bad)))
    d = shipped.createDataFrame(docs, "doc_id long, text string, toxic string, fold int")
    model = tx.train(d, shipped.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.scores["zmalvado"] > 0
    truth = dict(labels)
    got = {r["doc_id"]: r["score"] for r in tx.score(d, model).select("doc_id", "toxicity.*").collect()}
    out = [i for i in got if i >= 1000 and held(i)]
    assert any(truth[i] for i in out)
    assert all((got[i] >= 0.3) == bool(truth[i]) for i in out)


def test_equal_scores_in_any_order_of_rows(shipped):
    docs, labels = corpus(300, 6)
    docs += [(2000 + i, docs[i][1], "x", i) for i in range(0, 200, 3)]  # copies under other ids
    labels += [(2000 + i, 1 - dict(labels)[i]) for i in range(0, 200, 3)]
    l = shipped.createDataFrame(labels, "doc_id long, toxic int")
    d = shipped.createDataFrame(docs, "doc_id long, text string, toxic string, fold int")
    assert tx.train(d, l) == tx.train(d.repartition(7, F.rand(3)).sort(F.rand(5)), l)


def test_only_copies_are_merged(shipped):
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    base = ["w" + name(i) for i in range(200)]
    near, far = base[:150] + ["x"] + base[151:], base[:60] + ["y" + name(i) for i in range(140)]
    rows = [(3, " ".join(base), 0), (1, " ".join(near), 1), (2, " ".join(far), 0), (5, " ".join(far), 0), (4, "", 1), (6, "", 0)]
    df = shipped.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("a", F.lit(1))
    for order in (F.asc("doc_id"), F.desc("doc_id")):
        got = tx._without_copies(df.orderBy(order), "a", 80).select("doc_id", "toxic").collect()
        assert sorted(map(tuple, got)) == [(1, 1), (2, 0), (4, 1)]
