import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weekgrain.llm import packing as pk

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(library, text):
    return np.asarray([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def test_each_text_is_encoded_once(odd_docs):
    made = pk.numbered_pieces(odd_docs)
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def check(rows, texts, library, capacity):
    """Pieces hold every id once; sequences are gapless and not over capacity."""
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in texts.items():
        want = ids(library, text)
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == doc)
        cuts = [want[i : i + capacity] for i in range(0, len(want), capacity)]
        assert own == [(k, k * capacity, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(cuts)]
    return len(held)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan_holds_every_piece_once(lengths):
    demand = np.bincount(lengths, minlength=41).astype(np.int64)
    patterns = pk.plan(demand, 40)
    used = np.zeros(41, dtype=np.int64)
    for p in patterns:
        assert sum(l * n for l, n in p.items) <= 40 and p.times > 0
        for l, n in p.items:
            used[l] += n * p.times
    assert (used == demand).all()
    where = pk.places(patterns, 40)
    seen = set()
    for l in np.flatnonzero(demand):
        seq, off = pk.locate(where, int(l), np.arange(demand[l]))
        for s, o in zip(seq, off, strict=True):
            cells = {(int(s), int(o) + k) for k in range(l)}
            assert not cells & seen
            seen |= cells


def test_plan_is_close_to_the_least_number():
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.lognormal(6, 1, 20_000).astype(int) + 1, 4096)
    patterns = pk.plan(np.bincount(lengths, minlength=4097).astype(np.int64))
    assert sum(p.times for p in patterns) <= 1.002 * np.ceil(lengths.sum() / 4096)


def test_odd_rows(odd_docs, no_docs, library):
    docs = odd_docs.where("doc_id <> 1")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    n = check(pk.pack(docs, capacity=64).collect(), texts, library, 64)
    total = sum(len(ids(library, t)) for t in texts.values())
    assert n <= -(-total // 64) + 1
    assert pk.pack(odd_docs.where("doc_id = 1")).count() == 2
    assert pk.pack(odd_docs.where("doc_id is null")).count() == 1
    assert pk.pack(no_docs).count() == 0


def test_query_against_library(shipped, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in shipped.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pk.op5(shipped, sf_dir).collect()
    n = check(rows, texts, library, 4096)
    assert n <= -(-sum(r["length"] for r in rows) // 4096) + 1
