"""Stable text hashes used for synthetic labels and price noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crc32_text(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes, as bigint; null in, null out."""
    return F.crc32(F.encode(text, "UTF-8"))


def hash_bucket(text: Column, buckets: int) -> Column:
    return crc32_text(text) % F.lit(buckets)


def padded_hash(text: Column, modulus: int, width: int) -> Column:
    """Hash modulo `modulus`, left-padded with zeros to `width` digits."""
    return F.lpad(hash_bucket(text, modulus).cast("string"), width, "0")
