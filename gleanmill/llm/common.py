"""What the operators of this subpackage share: table access and shared-folder checkpoints."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import checkpointed, remove  # noqa: F401
from ..sources.shared import shared_root as shared_dir  # noqa: F401

#: The 52 letters of the only case folding that exact matching uses.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder, through Spark's reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written as a table to a folder of the shared one, and read from there."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores as it needs not to be ``taken``."""
    while name.lower() in map(str.lower, taken):
        name += "_"
    return name


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores by a hash of ``keys``, for what follows makes much of few bytes; adaptive execution leaves a stated number of partitions."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def key_ranges(df: DataFrame, key: str, parts: int) -> list[Column]:
    """Conditions that deal rows into ranges of falling keys, null ones in the last; just one for keys that aren't whole numbers."""
    column = F.col(key)
    low, high = df.agg(F.min(column), F.max(column)).first()
    if not isinstance(low, int) or parts < 2:
        return [F.lit(True)]
    edges = [low + (high - low) * k // parts for k in range(parts - 1, 0, -1)]
    above = [column > e for e in edges]
    out = above[:1] + [b & ~a for a, b in zip(above, above[1:])]
    return [*[F.coalesce(c, F.lit(False)) for c in out], F.coalesce(~above[-1], F.lit(True))]


#: A key is hot if it has more than one in so many rows: there are fewer hot keys than this, whatever the data's size.
HOT_KEYS = 1_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` left-joined with ``groups``, a checkpointed table with one row for each ``key`` and the ``count`` of its rows.

    Hot keys, fewer than ``HOT_KEYS``, are broadcast and joined where their
    rows are; those rows are then dealt evenly, so no task of the shuffled join
    gets a key with more than a thousandth of all rows. Null keys are joined
    with nothing. The other columns of both sides must not share names.
    """
    plain = [F.col(c) if "map<" not in t else F.col(c).cast("string") for c, t in rows.dtypes]
    values = [c for c in groups.columns if c != key]
    total = groups.agg(F.sum(count).alias("n")).first()["n"] or 0
    hot = groups.where(F.col(count) * HOT_KEYS > F.lit(total)).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    marked = rows.join(F.broadcast(hot), rows[key] == F.col("_hot_key"), "left")
    place = F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), 1 + F.pmod(F.xxhash64(*plain), F.lit(1 << 20))).otherwise(0)
    marked = marked.withColumn("_place", place)
    cold = groups.select(F.col(key), F.lit(0).cast("long").alias("_place"), F.struct(*values).alias("_cold"))
    joined = marked.join(cold, [key, "_place"], "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in values])


#: Cached functions whose values, of hundreds of MB, a Python worker keeps from task to task.
KEPT: list[Callable] = []


def relieve() -> None:
    """Gives back what ``KEPT`` functions hold in this worker. Spark hands its workers on from one query to the next, which has no use for that; it is only made anew if asked for again."""
    if not any(f.cache_info().currsize for f in KEPT):
        return
    for f in KEPT:
        f.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
