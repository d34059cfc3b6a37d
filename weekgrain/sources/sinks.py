"""Writers: Parquet snapshots, CSV results, full and per-year refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekgrain.sources.readers import CSV


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace the snapshot at path. With partition columns the rows are rebalanced
    first, so a task writes few partitions and a hot one is split over many tasks."""
    if not partition_by:
        df.write.mode("overwrite").parquet(path)
        return
    (
        df.hint("rebalance", *partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def refresh_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions that df holds, e.g. one fiscal year."""
    (
        df.hint("rebalance", *partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, path: str) -> None:
    """Catalog table bucketed and sorted by keys: joins on exactly these keys between
    tables of equal bucket count need no shuffle."""
    (
        df.repartition(buckets, *keys)
        .write.mode("overwrite")
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", path)
        .format("parquet")
        .saveAsTable(table)
    )


FIRST_ROW = (1 << 33) - 1


def write_csv(df: DataFrame, path: str, quote_text: bool = False) -> None:
    """CSV with header and NA for null. Default: quotes only where needed.
    quote_text: every text value in quotes, numbers bare."""
    if not quote_text:
        keep = {k: v for k, v in CSV.items() if k not in ("mode", "emptyValue")}
        df.write.mode("overwrite").options(**keep, emptyValue='""').csv(path)
        return
    text = {name for name, kind in df.dtypes if kind in ("string", "date", "timestamp")}
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    cells = []
    for name in df.columns:
        value = F.col(f"`{name}`").cast("string")
        cells.append(F.coalesce(quoted(value) if name in text else value, F.lit("NA")))
    header = ",".join('"' + name.replace('"', '""') + '"' for name in df.columns) + "\n"
    # Ready-made lines; the first row of every file brings the header along.
    first = F.monotonically_increasing_id().bitwiseAND(FIRST_ROW) == 0
    line = F.concat(F.when(first, F.lit(header)).otherwise(F.lit("")), F.concat_ws(",", *cells))
    df.select(line.alias("value")).write.mode("overwrite").text(path)
