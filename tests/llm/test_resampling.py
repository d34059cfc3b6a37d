import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from weekgrain.llm import resampling as rs


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


def buckets(text, n=10_000):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target, how=rs.Draw()):
    """(doc_id, n_features, weight, score, rank) of each row, in the order of docs."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text, how.buckets))
    for text in target:
        t.update(buckets(text, how.buckets))
    n, s_all, t_all = how.buckets, sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        weight = 0
        for b in buckets(text, n):
            weight += math.floor(1000 * math.log((t[b] + 1) * (s_all + n) / ((s[b] + 1) * (t_all + n))))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(buckets(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [r for r, (_, text) in zip(out, docs) if len(words(text)) >= how.least]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: how.percent * len(able) // 100], 1):
        r[4] = rank
    return sorted(map(tuple, out), key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frames(spark, docs, target):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")


def test_words_and_buckets():
    for text in (None, "", "Ab é-c2 d", "É_x9 ÀB\x00z", "one", "a b", "日本 語"):
        found = rs.words(text)
        assert [w.decode() for w in found] == words(text)
        assert sorted(rs.features(found, rs.Draw()).tolist()) == sorted(buckets(text))


def test_sort_with_many_segments_ties_and_repeated_rows(shipped):
    texts = ["alpha beta gamma " * 8, "delta " * 25, "rho sigma tau upsilon " * 6]
    docs = [(i // 3, texts[i % 5 % 3]) for i in range(1500)] + [(9, texts[0])] * 700 + [(None, texts[1])] * 3
    target = ["alpha beta gamma", "tau"]
    for how in (rs.Draw(percent=60, segments=40, samples=600), rs.Draw(percent=100, segments=3), rs.Draw(least=10**6)):
        df, want = frames(shipped, docs, target)
        got = rows(rs.draw(df.repartition(13), want, how))
        # Repeated rows of one id and text share their ranks among them in any order.
        expected = brute(docs, target, how)
        assert [r[:4] for r in got] == [r[:4] for r in expected]
        assert sorted(r[4] or 0 for r in got) == sorted(r[4] or 0 for r in expected)
        assert Counter(got) == Counter(expected)


def test_segments_are_of_about_one_size(shipped):
    docs = [(i, " ".join(f"w{(i * k) % 97}" for k in range(1, 30))) for i in range(4000)]
    df, _ = frames(shipped, docs, [])
    how = rs.Draw(segments=16)
    runs = rs.scored_runs(df.repartition(8), np.arange(10_000) % 7, how)
    cuts = rs.splitters(runs, how)
    keys = sorted(rs._key(r["score"], r["doc_id"], r["at"]) for r in runs.collect())
    places = [0, *np.searchsorted(np.arange(len(keys)), [keys.index(c) for c in cuts]), len(keys)]
    assert len(cuts) == 15 and max(np.diff(places)) <= 2 * len(keys) / 16


def test_odd_rows(odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    target = odd_docs.select("text")
    got = rows(rs.draw(odd_docs.withColumnRenamed("score", "weight"), target, rs.Draw(least=1, percent=100)))
    assert got == brute(docs, [t for _, t in docs], rs.Draw(least=1, percent=100))
    assert rs.draw(no_docs, target).count() == 0
    assert rows(rs.draw(odd_docs, no_docs)) == brute(docs, [])


def test_query_against_brute_force(shipped, sf_dir):
    docs = [tuple(r) for r in shipped.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in shipped.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert rows(rs.op11(shipped, sf_dir)) == brute(docs, target)
