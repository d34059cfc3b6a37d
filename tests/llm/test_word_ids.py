import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from weekgrain.llm import word_ids as wi

BITS = [
    "a", "the", " ", "\n", "\t", "12", "'s", "'", "é", "ß", "漢字", "😀", " ", "\x85", "²", "<|endoftext|>", "!!!", "    ",
    "-----", "\x1c", "ing", "THE", "zq", "　", "ſ", "'LL", "'ll", "_", "é", "İ", "Σ", "ǆ", "É", "''s", "<|", "|>", "K", "ŉ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("memo", [500_000, 20])
def test_the_librarys_ids(library, monkeypatch, memo):
    monkeypatch.setattr(wi, "MEMO", memo)
    rng, machine = random.Random(4), wi.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for part in wi.slices(texts, 500):
        ids, sizes = machine.encode(texts[part])
        for text, got in zip(texts[part], np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert got.tolist() == library.encode(text, add_special_tokens=False).ids


def test_plain_texts_of_any_shape(library):
    machine = wi.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", " ", "\n a", "a ", "x" * 100_000, "don't  stop 'll", "Ab " * 5000]
    ids, sizes = machine.closed(texts, 1)
    for text, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert got.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]
    assert [len(x) for x in machine.closed([], 1)] == [0, 0]


def test_slices_hold_every_text():
    texts = ["a" * n for n in (0, 5, 9, 30, 0, 1, 1)]
    parts = list(wi.slices(texts, 10))
    assert [t for p in parts for t in texts[p]] == texts
    assert max(len(texts[p]) for p in parts) > 1 and ["a" * 30] in [texts[p][:1] for p in parts]


def test_pretokens_of_the_pattern():
    pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{wi.LATIN}]+|[0-9]|[^a-z0-9{wi.LATIN}]+")
    rng = random.Random(8)
    bits = ["'", "'", "s", "t", "re", "ve", "m", "ll", "d", "r", "l", "é", "ſ", "ŉ", "1", "2", "!", "-", "'s"]
    strings = ["", "'", "'s", *("".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(20_000)), "'", ""]
    column = pa.array(strings, pa.large_string())
    for a, n in ((0, len(strings)), (500, 70), (0, 1), (0, 0), (3, 0)):
        found, counts = wi.pretokens(column.slice(a, n))
        each = [pattern.findall(x) for x in strings[a : a + n]]
        assert counts.tolist() == [len(x) for x in each]
        assert found.to_pylist() == [y for x in each for y in x]


def test_strings_of_known_pretokens_are_not_learned():
    machine = wi.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    machine.encode(["stop don't a ."])
    known = set(machine.newer)
    assert known == {"stop", "don", "'t", "a", "."}
    machine.encode(["stop. a.stop don't. .don't"])
    assert set(machine.newer) == known


def test_gathering_takes_little_more_than_what_is_gathered():
    flat, sizes = np.arange(300, dtype="<u4"), np.full(100, 3)
    at = np.arange(2_000_000) % 100
    tracemalloc.start()
    out, ends = wi.gather(flat, sizes, at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.tolist()[:300] == list(range(300)) and len(out) == ends[-1] == 6_000_000
    assert (out.reshape(-1, 300) == flat).all()
    assert peak - out.nbytes - ends.nbytes < 24_000_000
