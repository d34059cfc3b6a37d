"""What the operators share: reading tables, saved intermediate tables, name clashes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrain.sources.staging import shared_root

# fixed values: A-Z and a-z, for lower-casing that leaves other scripts alone
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scratch: list[list[str]] = []


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, outlives lost
    executors, and gives the planner the table's true size."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _scratch:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder, whatever store it lies in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved within go when it ends: what is made of them must be written by then."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield
    finally:
        _scratch.remove(paths)
        for path in paths:
            discard(spark, path)


def release() -> None:
    """Give back to the system what this process has freed. A Python worker outlives its task, and
    what Arrow and the C library keep for later would lie beside the next stage's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def releasing(batches: Iterable[T]) -> Iterator[T]:
    """batches, with release() after each."""
    for batch in batches:
        yield batch
        del batch
        release()


_held: dict[Hashable, object] = {}


def held(name: Hashable, make: Callable[[], T]) -> T:
    """make(), kept by this process until something of another name is held: a Python worker goes
    on to other stages, and the vocabulary of one would lie beside that of the next."""
    if name not in _held:
        forget()
        _held[name] = make()
    return _held[name]


def forget() -> None:
    """Drop what is held."""
    if _held:
        _held.clear()
        release()


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: Column, salts: int = 16) -> DataFrame:
    """left join of many rows on few: each key's rows are spread over `salts` keys by the hash
    of `by`, and right, which has a row per key at most, is repeated for each of them."""
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    return spread.join(right.withColumn("_salt", F.explode(every)), [*keys, "_salt"], "left").drop("_salt")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, whichever df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
