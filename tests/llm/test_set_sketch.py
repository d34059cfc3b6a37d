import random
import re

import numpy as np
from pyspark.sql import functions as F

from weekgrain.llm import set_sketch as sk


def shingles(text, words=4):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(docs, words=4):
    sets = {i: shingles(t, words) for i, t in docs if i is not None}
    group = {i: i for i in sets}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                group[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def copies(rng, groups=12, each=9):
    """Chains of edited texts, so that components reach further than single links."""
    docs = []
    for g in range(groups):
        text = [f"g{g}w{rng.randint(0, 400)}" for _ in range(rng.randint(30, 160))]
        for _ in range(each):
            docs.append((len(docs), " ".join(text)))
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = f"e{rng.randint(0, 10**6)}"
    return docs


def test_against_all_pairs(shipped):
    docs = copies(random.Random(8))
    df = shipped.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, node int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in sk.groups(df).collect()}
    assert got == brute(docs)


def test_large_buckets_are_compared_in_blocks(shipped, monkeypatch):
    monkeypatch.setattr("weekgrain.llm.blocks.blocked.__defaults__", (4,))
    docs = copies(random.Random(9), groups=2, each=40)
    df = shipped.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in sk.groups(df).collect()}
    assert got == brute(docs)


def test_families_beyond_one_block_are_compared_whole(shipped, monkeypatch):
    made, blocked = [], sk.blocked

    def counting(homes, probes, key, *rest):
        work = blocked(homes, probes, key, *rest)
        made.extend(r["n"] for r in work.groupBy(*key).agg(F.countDistinct("unit").alias("n")).collect())
        return work

    monkeypatch.setattr(sk, "blocked", counting)
    docs = copies(random.Random(9), groups=2, each=40)
    df = shipped.createDataFrame(docs, "doc_id long, text string")
    found = sk.groups(df, sk.Sketch(block=4))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}
    assert got == brute(docs)
    assert max(made) > 1


def test_odd_rows(shipped, odd_docs, no_docs):
    rows = [(20, "A b\tC", 1), (21, "a B c", 1), (22, "a b", 1), (23, " x", 1), (24, "É", 1), (25, "é", 1), (26, "\x1c", 1)]
    df = shipped.createDataFrame(rows, "doc_id long, text string, k1 int")
    both = odd_docs.select("doc_id", "text").union(df.select("doc_id", "text"))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in sk.groups(both).collect()]
    want = brute([(r["doc_id"], r["text"]) for r in both.collect()])
    assert len(got) == both.count()
    assert {g for g in got if g[0] is not None} == {(i, *x) for i, x in want.items()}
    assert [g for g in got if g[0] is None][0][2] is None
    assert sk.groups(no_docs).count() == 0


def test_one_of_each_group_stays(odd_docs, no_docs):
    kept = sk.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "2", "3", "4", "5", "None"]
    assert sk.deduplicated(no_docs).count() == 0


def test_sketches_merge_and_estimate():
    how, rng = sk.Sketch(), np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2600])
    one, two, both = sk.sketches([a, b, np.unique(np.concatenate([a, b]))], how)
    assert (np.maximum(one, two) == both).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((one == two).mean() - true) < 0.15
    na, nb = np.array([len(a)]), np.array([len(b)])
    assert not sk.plausible(one[None], sk.sketches([rng.integers(0, 1 << 62, 2000, dtype=np.uint64)], how), na, na, how)[0]
    assert sk.plausible(one[None], one[None], na, na, how)[0]
    best, enough = sk.likelihoods(np.array([0]), np.array([0]), na, na, how)
    assert best == enough and nb[0] > 0


def test_query_against_all_pairs(shipped, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in shipped.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(docs)
    got = {r["doc_id"]: r for r in sk.op10(shipped, sf_dir).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_unlike_texts_of_one_id(shipped):
    rng = random.Random(2)
    text = [" ".join(f"t{k}w{rng.randint(0, 900)}" for _ in range(60)) for k in range(4)]
    rows = [(1, text[0]), (5, text[0]), (5, text[1]), (5, text[1]), (5, text[2]), (6, text[2]), (2, text[3]), (2, text[2])]
    df = shipped.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"]) for r in sk.groups(df).collect()]
    assert sorted(got) == [(1, 1), (2, 2), (2, 2), (5, 1), (5, 2), (5, 5), (5, 5), (6, 2)]
    left = sorted(tuple(r) for r in sk.deduplicated(df, sk.Sketch(words=4)).collect())
    assert left == sorted([(1, text[0]), (5, text[1]), (2, text[3]), (2, text[2])])


def test_full_sets_read_each_text_once(shipped):
    docs = shipped.createDataFrame(copies(random.Random(3), 2, 4), "doc_id long, text string")
    named = docs.select("doc_id").where("doc_id < 3").withColumnRenamed("doc_id", "id")
    for bits in (1 << 23, 64):
        full = sk._full_sets(docs, named, sk.Sketch(bits=bits))
        plan = full.where("k1 is not null")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
        got = {r["id"]: r["set"] for r in full.collect()}
        assert set(got) >= {0, 1, 2} and (bits == 64 or len(got) == 3)
        assert len(got[0]) == len(shingles(docs.where("doc_id = 0").first()["text"]))
