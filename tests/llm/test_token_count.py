import random
from functools import reduce

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weekgrain.llm import token_count as tc

BITS = [
    "a", "the", " ", "\n", "\t", "12", "'s", "'", "é", "ß", "漢字", "😀", " ", "\x85", "²", "<|endoftext|>", "!!!", "    ",
    "-----", "\x1c", "\x00", "ation", "THE", "zq", "　", "ſ", "'LL", "'ll", "_", "\r\n", "é", "٣",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_counts_and_chunk_maps(library):
    machine, rng = tc.transducer(None), random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 30)))
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert machine.count(text) == want
        step = rng.randint(1, 6)
        maps = [tc.chunk_map(text[i : i + step], machine) for i in range(0, len(text), step)] or [("", 0, None)]
        left = reduce(lambda a, b: tc.compose(a, b, machine), maps)
        right = reduce(lambda a, b: tc.compose(b, a, machine), maps[::-1])
        assert tc.apply(left, machine) == tc.apply(right, machine) == want


def test_states_are_rebuilt_when_there_are_too_many(library, monkeypatch):
    monkeypatch.setattr(tc, "STATES", 50)
    monkeypatch.setattr(tc, "MEMO", 20)
    machine = tc.Transducer(public_tokenizers.path("byte_bpe_50k.json"))
    text = " ".join(f"w{i}ord{i * 7}ing" for i in range(300))
    assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_odd_rows_in_small_chunks(odd_docs, no_docs, library):
    got = tc.count_tokens(odd_docs, chunk=100, limit=5).collect()
    texts = [r["text"] or "" for r in odd_docs.collect()]
    want = sorted((len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 5) for r in got)
    assert tc.count_tokens(no_docs).count() == 0


def test_query_against_library(shipped, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in shipped.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in tc.op6(shipped, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len(t.encode()), n, n > 1024)
