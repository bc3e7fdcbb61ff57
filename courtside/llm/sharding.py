"""Sharding by a permutation-filled lookup table.

Every shard orders the slots of a prime-sized table by its own permutation ``offset + j * skip``; shards take turns
claiming the first free slot of their order until the table is full. Shares differ by one slot at most, and when a
shard joins or leaves, few other slots change hands. Placing a row is one hash, one remainder and one look-up in the
broadcast table. The table's size is the parameter ``size`` (65,537 rows of two integers, under 2 MB, however many
rows are placed), so the broadcast is bounded; rows are never shuffled, and a hot key is spread by its row ids.

Null keys hash like any other value and get a defined shard; repeated keys get the same shard; an empty table gives
an empty result; other columns are ignored, whatever their names, but to keep one named like a result is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mixed(text: str, seed: int) -> int:
    """A 64-bit hash of a shard's name: FNV-1a, then a finalizer that spreads its bits."""
    h = 0xCBF29CE484222325 ^ seed
    for byte in text.encode():
        h = (h ^ byte) * 0x100000001B3 % 2**64
    h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD % 2**64
    return h ^ h >> 33


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard index of each slot. ``size`` must be prime, and at least the number of shards."""
    if size < max(2, len(shards)) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table needs a prime size that is at least the number of shards")
    if not shards or len({*shards}) != len(shards):
        raise ValueError("shards need distinct names, and there must be one at least")
    at = [_mixed(s, SEEDS[0]) % size for s in shards]
    skip = [_mixed(s, SEEDS[1]) % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: its 64-bit hash modulo the prime."""
    return F.pmod(F.xxhash64(key), F.lit(size)).cast("int")


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The lookup table as ``(slot, shard)``: one literal of the plan, cut and numbered by Spark."""
    slots = ",".join(map(str, lookup_table(shards, size)))
    table = spark.range(1).select(F.posexplode(F.split(F.lit(slots), ",")).alias("slot", "number"))
    return table.select("slot", F.col("number").cast("int").alias("shard"))


def place(df: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE, keep: list[str] | None = None) -> DataFrame:
    """The key (and the columns ``keep``), its ``slot`` and its ``shard`` for every row."""
    if clash := {key, *(keep or [])} & {"slot", "shard"}:
        raise ValueError(f"columns named like a result: {sorted(clash)}")
    rows = df.select(key, *(keep or []), slot_of(F.col(key), size).alias("slot"))
    return rows.join(F.broadcast(table_frame(df.sparkSession, shards, size)), "slot").select(key, *(keep or []), "slot", "shard")


def moved(df: DataFrame, before: list[str], after: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """``(rows, moved_rows)``: how many rows change shards when the set of shards changes."""
    spark = df.sparkSession
    names = [F.create_map(*[x for i, s in enumerate(group) for x in (F.lit(i), F.lit(s))]) for group in (before, after)]
    pairs = table_frame(spark, before, size).join(table_frame(spark, after, size).withColumnRenamed("shard", "later"), "slot")
    changed = pairs.select("slot", (names[0][F.col("shard")] != names[1][F.col("later")]).alias("changed"))
    return df.select(slot_of(F.col(key), size).alias("slot")).join(F.broadcast(changed), "slot").agg(F.count("*").alias("rows"), F.count_if("changed").alias("moved_rows"))
