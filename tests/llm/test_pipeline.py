import pyarrow as pa

import corpus_pipeline as cp
from weekgrain.llm import decontaminate, secret_scan, set_sketch, toxicity
from helpers_llm import rows


def test_each_stage_takes_effect(shipped, sf_dir):
    docs = shipped.read.parquet(f"{sf_dir}/documents.parquet")
    labels = shipped.read.parquet(f"{sf_dir}/labels.parquet")
    bench = shipped.read.parquet(f"{sf_dir}/benchmark.parquet")
    stages = dict(cp.STAGES)

    clean = stages["toxicity"](shipped, docs, sf_dir).cache()
    scored = toxicity.score(docs, toxicity.train(docs, labels)).select("doc_id", "toxicity.score").collect()
    assert rows(clean.select("doc_id")) == sorted(((r["doc_id"],) for r in scored if r["score"] < 0.3), key=repr)

    single = stages["near_duplicates"](shipped, clean, sf_dir).cache()
    kept = set_sketch.groups(clean, set_sketch.Sketch(words=5)).where(set_sketch.kept())
    assert rows(single.select("doc_id")) == rows(kept.select("doc_id"))

    fresh = stages["decontamination"](shipped, single, sf_dir).cache()
    bad = {r["doc_id"] for r in decontaminate.find(single, bench).where("n_hit > 0").collect()}
    assert {r["doc_id"] for r in fresh.collect()} == {r["doc_id"] for r in single.collect()} - bad

    safe = stages["secrets"](shipped, fresh, sf_dir).cache()
    texts = {r["doc_id"]: r["text"] for r in fresh.collect()}
    for r in safe.collect():
        text = texts[r["doc_id"]]
        assert r["text"] == secret_scan.redact(text, secret_scan.find(text))
        assert r["text"] == text or r["n_chars"] == len(r["text"])
    for df in (clean, single, fresh, safe):
        assert df.columns == docs.columns

    out = stages["packing"](shipped, safe, sf_dir)
    assert {r["doc_id"] for r in out.collect()} == set(texts)


def test_run_gives_the_stages_result(shipped, sf_dir):
    got = cp.run(shipped, sf_dir).collect()
    assert got and len({(r["doc_id"], r["piece"]) for r in got}) == len(got)


def test_stages_run_on_small_batches(shipped, sf_dir):
    docs = shipped.createDataFrame([(i, "x " * 100_000) for i in range(40)], "doc_id long, text string").coalesce(1)
    cp.packed(shipped, docs.limit(1), sf_dir)
    assert shipped.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "512"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    seen = [r["n"] for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
    assert sum(seen) >= 8_000_000 and max(seen) < 2_000_000


def test_odd_rows(shipped, odd_docs, no_docs, sf_dir):
    odd = odd_docs.withColumnRenamed("score", "toxicity").withColumnRenamed("found", "place")
    for docs in (odd, no_docs):
        for name, stage in cp.STAGES:
            out = stage(shipped, docs, sf_dir)
            assert name == "packing" or out.columns == docs.columns
            out.collect()
    left = odd
    for _, stage in cp.STAGES[:-1]:
        left = stage(shipped, left, sf_dir)
    assert rows(left.select("doc_id")) == sorted([(1,), (2,), (3,), (4,), (5,), (None,)], key=repr)
