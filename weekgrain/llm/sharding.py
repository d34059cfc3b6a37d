"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: an offset
and a step drawn from its name. The shards take turns, each claiming its next free slot, until the
table is full. A row's slot is the hash of its key, so a placement is one look-up; when a shard
joins or leaves, nearly all other rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrain.llm.common import free_name, table

SLOTS = 65_537


@dataclass(frozen=True)
class Shard:
    """A shard of weight n takes n turns in every round."""

    name: str
    weight: int = 1


def shards(count: int) -> list[Shard]:
    return [Shard(f"shard-{i:05d}") for i in range(count)]


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """First slot and step; a step that is not 0 visits every slot of a prime table."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(name, seed=1) % slots, xxh3_64_intdigest(name, seed=2) % (slots - 1) + 1


def fill(members: Sequence[Shard], slots: int = SLOTS) -> list[int]:
    """For every slot the number of its shard in members. The table depends on the set of names
    and weights, not on their order. The slots bound its size."""
    if not _is_prime(slots):
        raise ValueError("the table size must be prime")
    names = [m.name for m in members]
    if not names or len(set(names)) < len(names) or any(m.weight < 1 for m in members):
        raise ValueError("shards need different names and positive weights")
    if sum(m.weight for m in members) > slots:
        raise ValueError("more turns in a round than slots")
    order = sorted(range(len(members)), key=lambda i: names[i])
    place = {i: preference(names[i], slots) for i in order}
    at = {i: place[i][0] for i in order}
    owner = [-1] * slots
    free = slots
    while free:
        for i in order:
            for _ in range(min(members[i].weight, free)):
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + place[i][1]) % slots
                owner[at[i]] = i
                free -= 1
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def assign(
    df: DataFrame, key: Column, members: Sequence[Shard], slots: int = SLOTS, name: str = "shard"
) -> DataFrame:
    """df with two more columns: the slot (name_slot) and the name of the shard (name).

    A null key is a key like others, and equal keys go to one shard, so a key should tell rows
    apart if one value may hold much of the table. Repeated rows are placed each, an empty table
    gives none; columns of the two names are replaced. The table, `slots` rows whatever df
    holds, is broadcast; df is neither shuffled nor sorted.
    """
    spark = df.sparkSession
    slot = f"{name}_slot"
    rows = [(i, members[m].name) for i, m in enumerate(fill(members, slots))]
    owners = spark.createDataFrame(rows, f"`{slot}` int, `{name}` string")
    placed = df.drop(name).withColumn(slot, slot_of(key, slots))
    return placed.join(F.broadcast(owners), slot).select(*[c for c in placed.columns if c != slot], slot, name)


def write_shards(df: DataFrame, key: Column, members: Sequence[Shard], path: str, slots: int = SLOTS) -> None:
    """One folder per shard, shard=<name>. Rows are rebalanced by shard: a task writes few
    folders, and a large shard is split over several tasks."""
    name = free_name(df, "shard")
    placed = assign(df, key, members, slots, name).drop(f"{name}_slot")
    placed.hint("rebalance", name).write.mode("overwrite").partitionBy(name).parquet(path)


def document_key(docs: DataFrame) -> Column:
    """The id, or the text where there is no id."""
    return F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("text:"), docs["text"]), F.lit("none"))


SHARDS = 128


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign(docs, document_key(docs), shards(SHARDS)).select("doc_id", "shard_slot", "shard")
