"""CSV files with line breaks in cells, read in splits.

A line break is within a cell just if an odd number of quotes stands before it in its file. The
lines of each split are counted first: the parity of its quotes, added up over the splits
before, says in which state it begins. A second pass then joins lines to records, split by split;
records that lie across splits are joined from their parts, of which each split has two at most.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Reader options that hold for a single record.
PARSED = ("quote", "escape", "nullValue", "emptyValue", "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace", "mode")
SHAPE = "file string, block long, number long, kind string, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def odd_starts(lines: DataFrame) -> set[tuple[str, int]]:
    """The splits that begin within a cell: as many rows as there are splits, at most."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    parity = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = parity.withColumn("within", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    return {(r["file"], r["block"]) for r in begins.where("within = 1").collect()}


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, block, number, record: every CSV record as text, without the line break behind it.
    number counts within the split; a record across splits has the place of its first part."""
    lines = _lines(spark, path)
    within = spark.sparkContext.broadcast(odd_starts(lines))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["file", "block", "number", "kind", "record"]
        place, number, parts, open_, started = None, 0, [], False, "whole"

        def row(ended: bool) -> tuple:
            # whole, or a part of a record: its first, one between, or its last
            kind = started if ended else {"whole": "first", "last": "between"}[started]
            text = "\n".join(parts)
            return (*place, number, kind, text[:-1] if ended and text.endswith("\r") else text)

        for batch in batches:
            out = []
            for file, block, value in zip(*[batch.column(c).to_pylist() for c in ("file", "block", "value")], strict=True):
                if place != (file, block):
                    if parts:
                        out.append(row(False))
                    place, number, parts = (file, block), 0, []
                    open_ = place in within.value
                    started = "last" if open_ else "whole"
                parts.append(value)
                if value.count('"') % 2:
                    open_ = not open_
                if not open_:
                    out.append(row(True))
                    number, parts, started = number + 1, [], "whole"
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 5, TYPES, strict=True)], names=names
            )
        if parts:
            last = [[v] for v in row(False)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(last, TYPES, strict=True)], names=names)

    import pyarrow as pa

    TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]  # noqa: N806
    found = lines.mapInArrow(run, SHAPE)
    whole = found.where("kind = 'whole'").select("file", "block", "number", "record")
    # Parts: two a split at most, so a file's window holds as many as it has splits.
    order = Window.partitionBy("file").orderBy("block", "number")
    parts = found.where("kind <> 'whole'").withColumn("which", F.sum(F.when(F.col("kind") == "first", 1).otherwise(0)).over(order))
    joined = parts.groupBy("file", "which").agg(F.sort_array(F.collect_list(F.struct("block", "number", "record"))).alias("p"))
    text = F.array_join(F.transform("p", lambda p: p["record"]), "\n")
    ended = F.when(text.endswith("\r"), F.expr("left(t, length(t) - 1)")).otherwise(F.col("t"))
    stitched = joined.withColumn("t", text).select(
        "file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["number"].alias("number"), ended.alias("record")
    )
    return whole.unionByName(stitched)


def read_split_csv(spark: SparkSession, path: str, schema: StructType, options: dict) -> DataFrame:
    """All records in the types of the schema. Every file begins with a header, and a record has
    as many cells as the schema has fields; one with more or fewer fails, as does a file that ends
    within a cell. Blank records are left out; an empty file gives no rows."""
    body = records(spark, path).where("not (block = 0 and number = 0) and record <> ''")
    fields = ", ".join(f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(schema))
    kept = {k: str(options[k]).lower() if isinstance(options[k], bool) else options[k] for k in PARSED if k in options}
    # The record is parsed as it is: no line break ends it.
    cells = body.select(F.from_csv("record", fields, {**kept, "lineSep": "\u0001"}).alias("c"))
    return cells.select(*[F.col(f"c._c{i}").alias(f.name) for i, f in enumerate(schema)])
