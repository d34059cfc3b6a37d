import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weekgrain.llm import token_output as to


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(library, text):
    return np.asarray([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=60))
def test_round_trip_of_a_block(values):
    control, data = to.encode(np.asarray(values, dtype=np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, -(-v.bit_length() // 8)) for v in values)
    assert to.decode(control, data, len(values)).tolist() == values


def written(docs, **how):
    folder = tempfile.mkdtemp()
    to.write(docs, folder, **how)
    spark = docs.sparkSession
    return folder, to.read(spark, folder).collect(), spark.read.parquet(f"{folder}/blocks")


def check(found, docs, library):
    """Every stored row in order, its ids those of the library, no gap between."""
    at = 0
    got = sorted(found, key=lambda r: r["start"])
    want = sorted(docs, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want]
    assert sorted(bytes(r["ids"]) for r in got) == sorted(ids(library, r["text"]).tobytes() for r in want)
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]


def test_odd_rows(odd_docs, no_docs, library):
    for block in (1 << 18, 7):
        folder, found, blocks = written(odd_docs.withColumnRenamed("lang", "part"), block=block)
        check(found, odd_docs.collect(), library)
    assert blocks.count() > 4
    assert to.read(odd_docs.sparkSession, folder).columns == ["doc_id", "start", "n_tokens", "ids"]
    assert written(no_docs)[1] == []


def test_commonest_ids_take_one_byte(shipped, library):
    docs = shipped.createDataFrame([(i, "the of and " * 50 + f"word{i}") for i in range(400)], "doc_id long, text string")
    _, found, blocks = written(docs)
    check(found, docs.collect(), library)
    size = sum(len(r["control"]) + len(r["data"]) for r in blocks.collect())
    total = sum(r["n_tokens"] for r in found)
    assert size < 1.3 * total


def test_one_id_on_many_rows_is_split(shipped, library):
    shipped.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = shipped.createDataFrame([(7, f"text {i}") for i in range(3000)] + [(i, "x") for i in range(20)], "doc_id long, text string")
    try:
        _, found, blocks = written(docs, block=500)
    finally:
        shipped.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    check(found, docs.collect(), library)
    assert blocks.select("part").distinct().count() > 1


def test_query_against_library(shipped, sf_dir, library):
    docs = shipped.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in to.op13(shipped, sf_dir).collect()}
    at, want = 0, {}
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        own = ids(library, r["text"])
        want[r["doc_id"]] = (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert got == want
