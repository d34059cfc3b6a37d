"""Token ids on disk: frequency-ranked, byte-aligned, with control bytes apart from the data.

An id is replaced by its rank among all ids of the corpus, the commonest first, so that most
take one byte. A rank takes one to four bytes; two bits of a control byte say how many, four
ranks to a control byte. Control and data bytes are stored apart, and a block is decoded at once:
a table turns each control byte into four lengths, their running sum gives the places of the
values.

The files lie in a folder as Parquet tables, so that any store that Spark writes to can hold
them: `blocks` (part, block, before, doc_ids, lengths, control, data), `parts` (part, start) and
`ranks` (rank, id, n). Documents are in ascending order of their ids over parts and blocks; a
block holds whole documents, and `before` and `start` give the ids before it in its part, and
before the part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from weekgrain.llm.common import saved, scratch, table
from weekgrain.llm.word_ids import texts_of, word_ids
from weekgrain.sources.staging import shared_root

END_ID = 1
# Ids of a block, but for a longer document, which is a block of its own.
BLOCK = 1 << 18

# Bytes of each of the four ranks that a control byte stands for.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)
MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of ranks below 2**32. The last control byte is filled up with zero bits."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    fours = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    fours[: len(ranks)] = more
    control = (fours.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(1).astype(np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a block."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n].astype(np.int64)
    at = np.cumsum(lengths) - lengths
    padded = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    values = padded[at].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=0))):
        values |= padded[at + k].astype(np.uint32) << np.uint32(8 * k)
    return values & MASKS[lengths - 1]


def tokens(docs: DataFrame, path: str | None = None, end: int = END_ID) -> DataFrame:
    """doc_id, n, ids (16-bit where the vocabulary allows, else 32-bit) of whole texts; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = word_ids(path)
        kind = _kind(machine.size)
        for batch in batches:
            for part, texts in texts_of(batch.column("text")):
                ids, sizes = machine.closed(texts, end)
                packed = ids.astype(kind).tobytes()
                ends = np.cumsum(sizes) * np.dtype(kind).itemsize
                starts = np.concatenate([[0], ends[:-1]])
                cells = [packed[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                own = batch.column("doc_id").slice(part.start, len(cells))
                yield pa.RecordBatch.from_arrays([own, pa.array(sizes), pa.array(cells, pa.binary())], schema=schema)

    columns = docs.select("doc_id", "text")
    shape = columns.select("doc_id", F.lit(0).cast("long").alias("n"), F.col("text").cast("binary").alias("ids")).schema
    for field in shape:
        field.nullable = True
    schema = to_arrow_schema(shape)
    return saved(columns.mapInArrow(run, shape), "tokens")


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def ranking(made: DataFrame, size: int) -> DataFrame:
    """rank, id, n: the ids that occur, the most frequent first, ties by id. Each task counts in
    one array of the vocabulary's size, so that at most that many rows leave it."""
    kind = _kind(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for cell in batch.column("ids"):
                held += np.bincount(np.frombuffer(cell.as_buffer(), dtype=kind), minlength=size)
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(held[there])], names=["id", "n"])

    counts = made.select("ids").mapInArrow(run, "id long, n long")
    counts = counts.groupBy("id").agg(F.sum("n").alias("n"))
    # One row per id of the vocabulary at most.
    rank = F.row_number().over(W.orderBy(F.desc("n"), "id")) - 1
    return counts.select(rank.alias("rank"), "id", "n")


BLOCKS = "block long, before long, doc_ids array<bigint>, lengths array<bigint>, control binary, data binary"


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END_ID, block: int = BLOCK) -> None:
    """Write the ids of all texts of docs (doc_id long, text) in ascending order of doc_id.

    path: vocabulary file. A null or empty text is the end id alone; null ids come first;
    repeated rows, and unlike rows of one id, are stored each, in a fixed order; an empty table
    leaves empty tables; other columns play no part.
    """
    with scratch(docs.sparkSession):
        _write(tokens(docs, path, end), folder, word_ids(path).size, block)


def _write(made: DataFrame, folder: str, size: int, block: int) -> None:
    spark = made.sparkSession
    ranks = ranking(made, size)
    ranks.write.parquet(f"{folder}/ranks")
    kind = _kind(size)
    rank_of = np.zeros(size, dtype="<u4")
    for row in spark.read.parquet(f"{folder}/ranks").select("rank", "id").toLocalIterator():
        rank_of[row["id"]] = row["rank"]
    shared = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, before, total = [], 0, 0, 0

        def done() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(cell for _, _, cell in held), dtype=kind)
            control, data = encode(shared.value[ids])
            own, sizes = [i for i, _, _ in held], [n for _, n, _ in held]
            row = [[number], [before], [own], [sizes], [control], [data]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for i, n, cell in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n", "ids")], strict=True):
                if held and total + n > block:
                    yield done()
                    held, number, before, total = [], number + 1, before + total, 0
                held.append((i, n, cell))
                total += n
        if held:
            yield done()

    schema = to_arrow_schema(spark.createDataFrame([], BLOCKS).schema)
    # The digest settles the order of equal ids and splits an id that many rows share.
    tie = F.xxhash64("ids")
    ordered = made.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("tie", tie)
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    out = ordered.mapInArrow(run, BLOCKS).withColumn("part", F.spark_partition_id())
    out.withColumn("n_tokens", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).write.parquet(
        f"{folder}/blocks"
    )
    blocks = spark.read.parquet(f"{folder}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per part.
    sofar = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sizes.select("part", F.coalesce(sofar, F.lit(0)).cast("long").alias("start")).write.parquet(f"{folder}/parts")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every stored document; ids as little-endian unsigned 32-bit
    integers. start counts the ids of all documents before it."""
    ranks = spark.read.parquet(f"{folder}/ranks").select("rank", "id")
    pairs = np.asarray([tuple(r) for r in ranks.toLocalIterator()], dtype=np.int64).reshape(-1, 2)
    id_of = np.zeros(len(pairs), dtype="<u4")
    id_of[pairs[:, 0]] = pairs[:, 1]
    shared = spark.sparkContext.broadcast(id_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.asarray(row["lengths"], dtype=np.int64)
                ranks = decode(row["control"], row["data"], int(sizes.sum()))
                packed = shared.value[ranks].tobytes()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                cells = [packed[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                part = np.full(len(sizes), row["part"])
                own = [part, row["doc_ids"], starts + row["before"], sizes, cells]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(own, schema, strict=True)], schema=schema)

    shape = "part int, doc_id long, at long, n_tokens long, ids binary"
    schema = to_arrow_schema(spark.createDataFrame([], shape).schema)
    blocks = spark.read.parquet(f"{folder}/blocks").select("part", "before", "doc_ids", "lengths", "control", "data")
    found = blocks.mapInArrow(run, shape).join(spark.read.parquet(f"{folder}/parts"), "part")
    return found.select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_root(spark)}/llm/token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), folder)
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
