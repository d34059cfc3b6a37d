"""Readers: raw order files, snapshots, CSV results and database tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weekgrain.sources.infer import typed
from weekgrain.sources.schemas import RAW_COLUMNS, RAW_FILE_COLUMNS, ddl, snake
from weekgrain.sources.split_csv import read_split_csv

# One dialect for all readers and writers: a header, quotes doubled inside quotes, NA for null,
# blanks kept, malformed lines refused.
CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "nullValue": "NA",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "mode": "FAILFAST",
}


def read_order_lines(
    spark: SparkSession, path: str, fmt: str = "parquet", line_breaks: bool = False, **options
) -> DataFrame:
    """Raw order lines with snake_case names; dotted source names go on read.

    CSV files are split for reading. A line break in a cell fails unless line_breaks is given:
    then the splits are counted first, to tell breaks in cells from those between records.
    """
    if fmt == "csv" and line_breaks:
        df = read_split_csv(spark, path, StructType.fromDDL(ddl(RAW_FILE_COLUMNS)), CSV | options)
        return df.withColumnsRenamed({name: snake(name) for name in RAW_FILE_COLUMNS})
    reader = spark.read.schema(ddl(RAW_FILE_COLUMNS))
    if fmt == "csv":
        reader = reader.options(**CSV)
    df = reader.options(**options).format(fmt).load(path)
    return df.withColumnsRenamed({name: snake(name) for name in RAW_FILE_COLUMNS})


def standardise(df: DataFrame, columns: dict[str, str] = RAW_COLUMNS) -> DataFrame:
    """Clean names, trimmed text and declared types; a value that does not fit its
    type becomes null, a missing column comes in as null."""
    have = {snake(c): c for c in df.columns}
    out = []
    for name, kind in columns.items():
        if name not in have:
            out.append(F.lit(None).cast(kind).alias(name))
            continue
        text = F.trim(F.col(f"`{have[name]}`").cast("string"))
        out.append((text if kind == "string" else text.try_cast(kind)).alias(name))
    return df.select(*out)


def read_snapshot(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def csv_texts(spark: SparkSession, path: str) -> DataFrame:
    """All cells of CSV files as text, under the names of their header."""
    names = spark.read.options(**CSV, multiLine=True).csv(path).columns
    return read_split_csv(spark, path, StructType([StructField(n, StringType()) for n in names]), CSV)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV as the writers here leave it, line breaks in cells included, in splits. Without a schema
    the types are those that all cells of a column have, told in one pass over them. A text NA
    reads as null."""
    if schema is None:
        return typed(csv_texts(spark, path))
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return read_split_csv(spark, path, schema, CSV)


def read_preferred(spark: SparkSession, snapshot: str, csv: str, schema=None) -> DataFrame:
    """The typed snapshot if it is there, else the CSV."""
    try:
        return spark.read.parquet(snapshot)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    return read_csv(spark, csv, schema)


def jdbc_options(url: str, table: str, split: str, lower: int, upper: int, parts: int,
                 fetch: int = 10_000) -> dict[str, str]:
    """Options of a split table scan: `parts` range queries over the `split` column.
    lower and upper only set the stride; rows outside still arrive."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": split,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(parts),
        "fetchsize": str(fetch),
    }


def read_jdbc(spark: SparkSession, user: str, password: str, **split) -> DataFrame:
    """Database table as a distributed scan; the driver jar comes with the cluster."""
    reader = spark.read.format("jdbc").options(**jdbc_options(**split))
    return reader.option("user", user).option("password", password).load()
