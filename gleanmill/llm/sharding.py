"""Operator 8, sharding: a lookup table that shards fill by their own permutations.

Every shard orders the slots of a prime-sized table by its own permutation
(an offset and a step from its name). Shards take turns; whoever is on turn
claims the first slot of its order that is still free, until none is. A key
goes to the shard that owns slot ``hash(key) mod size``. The table has as many
rows as slots, whatever the data's size, so it is broadcast and a row is placed
by one hash and one lookup, without a shuffle. When a shard joins or leaves,
few slots change owner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

#: Slots of the production table, a prime; the broadcast has this many rows.
TABLE_SIZE = 65_537
#: Shards of the registered query.
SHARDS = tuple(f"shard-{k:03d}" for k in range(96))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and step of a shard's permutation: slot ``(offset + i * step) mod size`` is its i-th choice."""
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> np.ndarray:
    """The owner (index into ``shards``) of each slot.

    ``weights`` are turns per round, 1 each by default. ``size`` must be a
    prime no smaller than the number of shards, so that every step reaches
    every slot and every shard owns one.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("size must be a prime of at least the number of shards")
    turns = list(weights) if weights is not None else [1] * len(shards)
    if len(turns) != len(shards) or any(w < 1 for w in turns):
        raise ValueError("weights must be positive, one for each shard")
    owner = np.full(size, -1, dtype=np.int32)
    orders = [preference(s, size) for s in shards]
    tried = [0] * len(shards)
    free = size
    while free:
        for k, (offset, step) in enumerate(orders):
            for _ in range(turns[k]):
                if not free:
                    break
                while owner[slot := (offset + tried[k] * step) % size] >= 0:
                    tried[k] += 1
                owner[slot] = k
                tried[k] += 1
                free -= 1
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: the first 60 bits of its MD5 as text, modulo ``size``; a null key is the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.lit(size)).cast("int")


def assign_shards(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> DataFrame:
    """``df`` with columns ``slot`` and ``shard`` appended.

    Every row is kept, repeated ones too, and equal keys meet in one shard; null
    keys share a slot. An empty table stays empty. Columns of ``df`` that have
    the appended names already are replaced.
    """
    spark = df.sparkSession
    owner = lookup_table(shards, size, weights)
    slots = spark.createDataFrame([(k, shards[o]) for k, o in enumerate(owner.tolist())], "slot int, shard string")
    rows = df.select(F.struct("*").alias("row"), slot_of(F.col(key), size).alias("slot")).join(F.broadcast(slots), "slot")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c.lower() not in ("slot", "shard")], "slot", "shard")


def write_shards(df: DataFrame, key: str, path: str, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE, splits: int = 8) -> None:
    """Writes ``df`` as Parquet, a folder for each shard.

    Rows are dealt by their values, over up to ``splits`` tasks for a shard, so that a shard
    holding a hot key's rows is written by several tasks.
    """
    placed = assign_shards(df, key, shards, size)
    part = free_name("part", placed.columns)
    dealt = F.pmod(F.xxhash64(*[F.col(c).cast("string") if "map<" in t else F.col(c) for c, t in placed.dtypes]), F.lit(splits))
    placed.withColumn(part, dealt).repartition("shard", part).drop(part, "slot").write.partitionBy("shard").parquet(path)


def op8_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot int, shard string of every row of ``documents``."""
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
