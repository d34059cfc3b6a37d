import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from weekgrain.llm import periodic as pe


def brute(w):
    """(start, length, period) of all runs, by comparing the words at every distance."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)  # smaller periods come first
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def collapsed(w, runs):
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


def made(rng):
    w = []
    for _ in range(rng.randint(0, 6)):
        k = rng.choice([1, 2, 3, 9, 50])
        part = [rng.randint(0, k) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30]))]
        w += [rng.randint(0, k) for _ in range(rng.randint(0, 20))] + (part * 9)[: rng.randint(1, 200)]
    return w


@pytest.mark.parametrize("base", [16, 64, 1 << 14])
def test_tiles_stitched_are_the_runs(base):
    rng = random.Random(base)
    for _ in range(400):
        w = made(rng)
        parts = []
        for start, stop, low, high in pe.tiles(len(w), base):
            for s, e, q in pe.fragments(np.asarray(w[start:stop], dtype=np.int32), low, high):
                edge = (s == 0 and start) or (e == stop - start and stop < len(w))
                if edge or e - s >= max(6, 4 * q):
                    parts.append((q, start + s, start + e))
        out = []
        for q, s, e in sorted(parts):
            if out and out[-1][0] == q and s + q <= out[-1][2]:
                out[-1][2] = max(out[-1][2], e)
            else:
                out.append([q, s, e])
        assert sorted((s, e - s, q) for q, s, e in out if e - s >= max(6, 4 * q)) == brute(w)


def test_z_function():
    rng = random.Random(1)
    for _ in range(300):
        u = [rng.randint(0, 1) for _ in range(rng.randint(1, 30))]
        want = [next((k for k in range(len(u) - i) if u[k] != u[i + k]), len(u) - i) for i in range(len(u))]
        assert pe.z_function(u) == want


def test_tiles_hold_every_word_of_every_octave():
    for n in (0, 1, 5, 16, 17, 100, 1000, 4097):
        found = pe.tiles(n, 32)
        octaves = {k for _, _, low, high in found for k in range(low, high)}
        assert octaves == set(range(max(1, (n // 4).bit_length())))
        for k in octaves:
            own = sorted((s, e) for s, e, low, high in found if low <= k < high)
            assert own[0][0] == 0 and own[-1][1] == n
            assert all(b - c >= min(8 << k, n) for (_, b), (c, _) in zip(own, own[1:]))


def expected(docs):
    out = []
    for i, text in docs:
        w = split(text)
        runs = brute(w)
        text = collapsed(w, runs)
        out.append((i, len(w), [tuple(r) for r in runs], text if runs else None, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r[0], r[1], [tuple(x) for x in r[2]], r[3], r[4]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("base", [32, 1 << 14])
def test_documents_over_many_tiles(shipped, base):
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{x}" for x in made(rng))) for i in range(60)]
    docs += [(100, "a " * 3000), (101, "a b c " * 700 + "x " + "a b c " * 900), (101, "é  é\té é\u00a0é é é é é é"), (None, "z " * 50)]
    df = shipped.createDataFrame(docs, "doc_id long, text string")
    assert got(pe.runs(df.repartition(5), base=base)) == expected(docs)


def test_odd_rows(odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect() if r["doc_id"] != 4]
    odd = odd_docs.withColumnsRenamed({"score": "at", "found": "words"})
    assert got(pe.runs(odd.where("doc_id is null or doc_id <> 4"))) == expected(docs)
    assert pe.runs(odd.where("doc_id = 4"), base=256).select("n_words").first()[0] == 12_000
    assert pe.runs(no_docs).count() == 0


def test_query_against_brute_force(shipped, sf_dir):
    docs = shipped.read.parquet(f"{sf_dir}/documents.parquet").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for r in docs:
        w = split(r["text"])
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        runs = brute(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if runs else None
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want[r["doc_id"]] = (len(runs), *best, milli, sha(lines), sha(collapsed(w, runs)))
    found = {r["doc_id"]: tuple(r)[1:] for r in pe.op12(shipped, sf_dir).collect()}
    assert found == want and any(v[0] for v in want.values())
