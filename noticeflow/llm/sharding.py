"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a table of prime
size; the shards take turns claiming their next free slot until the table is
full.  Shares of the table are even to within one slot, and adding or removing
a shard moves few other slots.  A row is placed by one hash and one lookup.

The table's size is a parameter, so what is broadcast has a fixed bound.

Defined cases: a null key hashes like the empty string; equal keys go to the
same shard; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TABLE_SIZE = 65_537
SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard index of every slot."""
    if not shards or not _is_prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime no smaller than the number of shards, of which there must be one")
    seeds = [hashlib.sha256(s.encode()).digest() for s in shards]
    offset = [int.from_bytes(d[:8], "big") % size for d in seeds]
    step = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 if size > 2 else 1 for d in seeds]
    owner, at, free = [-1] * size, [0] * len(shards), size
    while free:
        for i in range(len(shards)):
            slot = (offset[i] + at[i] * step[i]) % size
            while owner[slot] >= 0:
                at[i] += 1
                slot = (offset[i] + at[i] * step[i]) % size
            owner[slot], at[i], free = i, at[i] + 1, free - 1
            if not free:
                break
    return owner


def key_slot(key: Column, size: int = TABLE_SIZE) -> Column:
    digest = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    return F.pmod(digest, F.lit(size)).cast("int")


def lookup(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """slot, shard: the whole table, ``size`` rows."""
    listed = ",".join(map(str, fill_table(shards, size)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(listed), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def assign_shards(docs: DataFrame, shards: list[str] | None = None, key_col: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """All columns of ``docs`` and slot, shard (which replace columns of those names)."""
    shards = shards or [f"shard-{i:05d}" for i in range(SHARDS)]
    placed = docs.drop("slot", "shard").withColumn("slot", key_slot(F.col(key_col), size))
    return placed.join(F.broadcast(lookup(docs.sparkSession, shards, size)), "slot").select(*docs.drop("slot", "shard").columns, "slot", "shard")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return assign_shards(docs).select("doc_id", "slot", "shard")


def op7_sql() -> str:
    """The lookup table as a literal; slots from the same digest."""
    listed = ",".join(map(str, fill_table([f"shard-{i:05d}" for i in range(SHARDS)])))
    return f"""
WITH t AS (SELECT string_split('{listed}', ',') AS owners),
d AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {TABLE_SIZE})::INTEGER AS slot FROM documents)
SELECT doc_id, slot, owners[slot + 1]::INTEGER AS shard FROM d, t
"""
