"""Files laid out by several columns at once, so that a slice on any of them skips files.

Each column's values are numbered in order by ranges of about equal rows; the bits of the numbers
are interleaved, and rows are dealt to files by the result. Every file then holds a short range of
each column, which the file's own statistics tell a scan.
"""

from __future__ import annotations

from functools import reduce
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampType

TEXT = 6  # bytes of a text that order it, from where texts differ; a double holds them exactly


def _shared(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Letters with which all values of each text column begin: those of the least and greatest."""
    texts = [c for c in columns if isinstance(df.schema[c].dataType, StringType)]
    if not texts:
        return {}
    ends = df.agg(*[f(F.col(f"`{c}`")).alias(f"{f.__name__}{i}") for i, c in enumerate(texts) for f in (F.min, F.max)]).first()
    return {c: len(commonprefix([ends[2 * i] or "", ends[2 * i + 1] or ""])) for i, c in enumerate(texts)}


def _number(df: DataFrame, name: str, shared: dict[str, int]) -> Column:
    """A double that never falls as the column's values grow."""
    kind, column = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, NumericType):
        return column.cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, TimestampType):
        return column.cast("double")
    if isinstance(kind, StringType):
        rest = F.encode(F.substr(column, F.lit(shared[name] + 1)), "UTF-8")
        start = F.rpad(F.hex(F.substring(rest, 1, TEXT)), 2 * TEXT, "0")
        return F.conv(start, 16, 10).cast("double")
    raise ValueError(f"{name}: no order for files by {kind.simpleString()}")


def _ranges(df: DataFrame, numbers: list[Column], bits: int) -> list[list[float]]:
    """Up to 2**bits - 1 values that part the rows of each column into ranges of like size. A hot
    value is one bound only, so the others keep their share of the numbers."""
    parts = 1 << bits
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(*[F.percentile_approx(x, shares, 100 * parts).alias(f"b{i}") for i, x in enumerate(numbers)])
    return [sorted(set(bounds or [])) for bounds in found.first()]


def interleaved(df: DataFrame, columns: list[str], bits: int = 6) -> Column:
    """The bits of the columns' range numbers, highest first and in turns, as a long. Nulls are
    before all values. At most 2**bits - 1 bounds a column reach the driver."""
    if not columns or bits * len(columns) > 62:
        raise ValueError("one column at least, and 62 bits together at most")
    shared = _shared(df, columns)
    numbers = [_number(df, c, shared) for c in columns]
    key = []
    for place, (value, bounds) in enumerate(zip(numbers, _ranges(df, numbers, bits), strict=True)):
        # Binary search, one comparison a bit: the number of bounds below the value.
        at = F.lit(0)
        held = F.array(*[F.lit(b) for b in bounds]) if bounds else None
        for step in (1 << b for b in reversed(range(bits))):
            if step <= len(bounds):
                above = (at + step <= len(bounds)) & (F.get(held, at + (step - 1)) < value)
                at = at + F.when(above, step).otherwise(0)
        at = at.cast("bigint")
        for b in range(bits):
            bit = F.shiftright(at, b).bitwiseAND(F.lit(1).cast("bigint"))
            key.append(F.shiftleft(bit, b * len(columns) + len(columns) - 1 - place))
    return reduce(lambda a, b: a.bitwiseOR(b), key)


def write_interleaved(df: DataFrame, path: str, columns: list[str], files: int, bits: int = 6) -> None:
    """Replace the table at path by df in `files` files, or fewer, of like size. Rows of one
    combination of values, however many, are spread over files by a hash of the row."""
    key, spread = "_interleaved", "_spread"
    while {key, spread} & {c.lower() for c in df.columns}:
        key, spread = "_" + key, "_" + spread
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    laid = df.withColumns({key: interleaved(df, columns, bits), spread: whole})
    laid.repartitionByRange(files, key, spread).drop(key, spread).write.mode("overwrite").parquet(path)
