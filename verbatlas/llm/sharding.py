"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own: a start and a stride, both
from the MD5 of its name, which run through all slots as the size is prime. The shards take turns, and each
claims the first slot it prefers that is free, until none is. A key's slot is its hash modulo the
size. The table is broadcast (its size is a parameter, at most MOST_SLOTS rows), so placement is one
probe of an array and no row moves. Shards get equal shares of slots, within one; when a shard goes, few keys of others move.

Defined results: a null key is placed by the hash of the text where one is given, else by that of
the empty string. Equal keys always share a shard. An empty table gives an empty result; columns
named ``slot`` or ``shard`` are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hex_of

SHARDS, SLOTS, MOST_SLOTS = 64, 8191, 1 << 20


def preference(name: str, size: int) -> tuple[int, int]:
    """A shard's first slot and its stride, from 24 hexadecimal digits of its name's MD5."""
    h = hashlib.md5(name.encode()).hexdigest()
    return int(h[:12], 16) % size, int(h[12:24], 16) % (size - 1) + 1


def filled(names: list[str], size: int = SLOTS) -> list[int]:
    """The number of the shard that has each slot. O(size log size) steps on average, once, on the driver."""
    if not names:
        raise ValueError("no shard")
    if size > MOST_SLOTS or size < len(names) or size < 3 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime of at least the number of shards")
    prefer = [preference(n, size) for n in names]
    slot = [-1] * size
    at = [start for start, _ in prefer]
    left = size
    while left:
        for i, (_, stride) in enumerate(prefer):
            while slot[at[i]] >= 0:
                at[i] = (at[i] + stride) % size
            slot[at[i]] = i
            left -= 1
            if not left:
                break
    return slot


def lookup(spark: SparkSession, names: list[str], size: int = SLOTS) -> DataFrame:
    """(slot long, shard string), one row for each slot."""
    numbers = ",".join(map(str, filled(names, size)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(numbers), ",")).alias("slot", "no")).select(
        F.col("slot").cast("long").alias("slot"), F.element_at(F.array(*map(F.lit, names)), F.col("no").cast("int") + 1).alias("shard")
    )


def placed(df: DataFrame, key: Column, names: list[str], size: int = SLOTS, instead: Column | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard``."""
    whole = F.coalesce(key.cast("string"), *([] if instead is None else [instead]), F.lit(""))
    slots = lookup(df.sparkSession, names, size)
    df = df.withColumn("__slot", hex_of(whole) % size).drop("slot", "shard")
    return df.join(F.broadcast(slots), F.col("__slot") == F.col("slot")).drop("__slot")
