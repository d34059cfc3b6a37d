"""Cleaning of a document table in five stages, each over all that the one before has kept.

Toxic documents go; of each group of near duplicates one stays; documents that hold benchmark
passages go; secrets are blanked; what is left is packed into sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrain.llm import decontaminate, packing, secret_scan, set_sketch, toxicity
from weekgrain.llm.common import discard, free_name, scratch, table
from weekgrain.llm.queries import BATCH, ship
from weekgrain.sources.staging import shared_root

# The stages share the executors, and what one has taken of their memory lies beside the next: bytes
# of a batch that goes to Python, and rows that a Parquet reader holds, whole texts among them.
SMALL = {BATCH: 1 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose toxicity reaches the threshold. Null and empty texts and rows with
    a null id are judged like others, null and empty texts always stay; repeated rows are judged
    alike; an empty table stays empty; a column of the score's name is left as it is."""
    ship(spark, SMALL)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "toxicity")
    scored = toxicity.score(docs, model, name)
    clean = F.col(name)["score"] < toxicity.THRESHOLD
    spoken = F.coalesce(F.col("text"), F.lit("")) != ""
    return scored.where(clean | ~spoken).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest id: shingles of five words, similarity of
    0.8 or more. Null and empty texts are in no group and stay, one row for each id; rows with a
    null id stay; of rows with the same id and text one stays; unlike texts that share an id are
    judged each for itself; an empty table stays empty."""
    ship(spark, SMALL)
    return set_sketch.deduplicated(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that share no ten words in a row, and no shorter whole item, with the benchmark. Null
    and empty texts share nothing and stay; repeated rows and rows with a null id are judged by
    their texts; an empty table stays empty, an empty benchmark leaves all."""
    ship(spark, SMALL)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All docs, secrets in their texts blanked. Null and empty texts stay as they are, repeated rows
    and null ids too; an empty table stays empty."""
    ship(spark, SMALL)
    return secret_scan.clean(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: a row per piece of a document, with its sequence and offset. A null or empty
    text is the end id alone; repeated rows and rows with a null id are packed each; an empty
    table gives no rows."""
    ship(spark, SMALL)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmarks),
    ("secrets", without_secrets),
    ("packing", packed),
]

# No stage but the third and parts of the fourth can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again. What a stage
    leaves there besides goes when it is done, and its result when the next one is."""
    folder = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
