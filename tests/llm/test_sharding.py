from collections import Counter

import pytest
from helpers_llm import rows
from pyspark.sql import functions as F

from weekgrain.llm import sharding as sh


def brute(members, slots):
    """Turns over whole permutations, written out."""
    orders = {}
    for m in sorted(members, key=lambda m: m.name):
        first, step = sh.preference(m.name, slots)
        orders[m.name] = iter([(first + j * step) % slots for j in range(slots)])
    owner = {}
    while len(owner) < slots:
        for m in sorted(members, key=lambda m: m.name):
            for _ in range(m.weight):
                slot = next((s for s in orders[m.name] if s not in owner), None)
                if slot is not None:
                    owner[slot] = m.name
    return [owner[i] for i in range(slots)]


@pytest.mark.parametrize("weights", [[1], [1, 1, 1], [3, 1, 2, 1]])
def test_table_against_written_out_turns(weights):
    members = [sh.Shard(f"s{i}", w) for i, w in enumerate(weights)]
    got = [members[i].name for i in sh.fill(members, 101)]
    assert got == brute(members, 101)
    assert [members[::-1][i].name for i in sh.fill(members[::-1], 101)] == got


def test_table_is_even_and_follows_weights():
    held = Counter(sh.fill(sh.shards(100)))
    assert max(held.values()) - min(held.values()) <= 1
    held = Counter(sh.fill([sh.Shard("a", 3), sh.Shard("b", 1)]))
    assert held[0] / held[1] == pytest.approx(3, rel=0.01)


def test_few_slots_move_when_a_shard_leaves():
    before, after = sh.shards(50), sh.shards(50)[:-1]
    a, b = sh.fill(before), sh.fill(after)
    moved = sum(before[x].name != after[y].name for x, y in zip(a, b, strict=True) if x != 49)
    assert moved < 0.03 * len(a)


def test_bad_tables_are_refused():
    for members, slots in ((sh.shards(2), 100), ([], 101), ([sh.Shard("a"), sh.Shard("a")], 101), (sh.shards(102), 101)):
        with pytest.raises(ValueError):
            sh.fill(members, slots)


def test_odd_rows(odd_docs, no_docs, tmp_path):
    docs = odd_docs.withColumn("shard", F.lit(1)).withColumn("shard_slot", F.lit("x"))
    placed = sh.assign(docs, sh.document_key(docs), sh.shards(5), 101)
    assert placed.count() == docs.count()
    assert {r["shard"] for r in placed.where("doc_id = 1").collect()} <= {m.name for m in sh.shards(5)}
    assert placed.where("doc_id = 1").select("shard").distinct().count() == 1
    assert sh.assign(no_docs, sh.document_key(no_docs), sh.shards(5), 101).count() == 0
    sh.write_shards(odd_docs, sh.document_key(odd_docs), sh.shards(3), str(tmp_path / "out"), 101)
    back = odd_docs.sparkSession.read.schema(odd_docs.schema).parquet(str(tmp_path / "out"))
    assert rows(back.select(*odd_docs.columns)) == rows(odd_docs)


def test_query_against_the_table(shipped, sf_dir):
    owner = sh.fill(sh.shards(sh.SHARDS))
    docs = shipped.read.parquet(f"{sf_dir}/documents.parquet")
    slots = dict(docs.select("doc_id", sh.slot_of(F.col("doc_id").cast("string"))).collect())
    got = sh.op3(shipped, sf_dir).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["shard_slot"] == slots[r["doc_id"]]
        assert r["shard"] == sh.shards(sh.SHARDS)[owner[r["shard_slot"]]].name
