"""Operator 9, exact dedup: a persistent digest index, bucketed and sorted by hash.

The index is a table of one row for each distinct text: its digest, the id of
the document kept, and how many rows had it when it was added. New data is
reduced to one row for each digest before a shuffle carries it (a text that a
third of all rows have is one row of each task), and what comes of that is
written before anything else, or the anti-join would be pushed below it. It is
sort-merge anti-joined with the index and appended. The index is written
bucketed and sorted by digest, a file for each bucket, so its side of that join
needs no shuffle. Only DataFrame functions are used.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpointed, join_groups, key_ranges, table

#: Buckets of an index table. At 100 TB of documents use several thousand.
BUCKETS = 16
#: Loads in which a table is put into an index.
BATCHES = 2


def normalised(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digest_of(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text).cast("binary"), 256)


def digest_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each distinct text: text_sha256, keep_id (the largest key), group_size."""
    rows = df.select(F.col(key).alias("keep_id"), digest_of(F.col(text)).alias("text_sha256"))
    return rows.groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


class DigestIndex:
    """A digest index in the warehouse, by table name."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of ``digest_groups`` (a written table, such as a checkpoint) whose digest the index doesn't have."""
        if not self.exists():
            return groups
        return groups.join(self.read().select("text_sha256").hint("merge"), "text_sha256", "left_anti")

    def append(self, groups: DataFrame) -> DataFrame:
        """Adds the unseen rows of ``groups``, bucketed and sorted by digest, and returns them.

        A run that is repeated after a crash finds what the first one added and
        adds nothing twice. The anti-join reads the table that is appended to,
        so its result is checkpointed first.
        """
        new = checkpointed(self.unseen(groups))
        self._write(new, self.name, "append")
        return new

    def _write(self, rows: DataFrame, name: str, mode: str) -> None:
        # Dealt like the buckets, so that each task writes one of them.
        dealt = rows.repartition(self.buckets, "text_sha256")
        dealt.write.mode(mode).bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").format("parquet").saveAsTable(name)

    def compact(self) -> None:
        """One file for each bucket again, after many appends. A crash before the end leaves the whole index under this or the other name; a repeated call ends it."""
        other = f"{self.name}_compacted"
        if self.exists():
            self.spark.sql(f"DROP TABLE IF EXISTS {other}")
            # Checkpointed, or the planner drops the exchange since the table is bucketed, and then reads it without its buckets.
            self._write(checkpointed(self.read()), other, "errorifexists")
            self.drop()
        self.spark.sql(f"ALTER TABLE {other} RENAME TO {self.name}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def ingest(df: DataFrame, index: DigestIndex, key: str = "doc_id", text: str = "text", batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """Puts ``df`` into the index, in ranges of falling keys so that the largest key of a text comes first.

    Returns what was new (``digest_groups`` rows) and text_sha256, group_size
    of every text of ``df``.
    """
    new, all_ = [], []
    for part in key_ranges(df, key, batches):
        groups = checkpointed(digest_groups(df.where(part), key, text))
        new.append(index.append(groups))
        all_.append(groups.select("text_sha256", "group_size"))
    return reduce(DataFrame.union, new), reduce(DataFrame.union, all_).groupBy("text_sha256").agg(F.sum("group_size").alias("group_size"))


def deduplicate(df: DataFrame, index: DigestIndex, key: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """The rows of ``df`` whose text neither the index nor a row with a larger key has; the index then has their texts.

    All columns of ``df`` stay, whatever their names. Of rows equal in key and
    text, one stays. Rows with a null key stay only where no row of their text
    has a key.
    """
    new, _ = ingest(df, index, key, text, batches)
    name = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("key")
    rows = df.select(F.struct("*").alias("row"), digest_of(F.col(text)).alias("sha"), name(F.col(key)))
    kept = new.select(F.col("text_sha256").alias("sha"), name(F.col("keep_id")))
    # A row stays under the largest key of its text, so (text, key) is all but unique: no hot group is left to meet in one task.
    return rows.join(kept, ["sha", "key"], "left_semi").dropDuplicates(["sha", "key"]).select("row.*")


def report(df: DataFrame, groups: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: the key, keep_id, group_size, kept, text_sha256.

    ``groups``, a checkpointed table, has a row for each digest. Only keys and
    digests are shuffled; rows of a hot digest find its group where they are.
    """
    rows = df.select(F.col(key).alias("doc_id"), digest_of(F.col(text)).alias("text_sha256"))
    return join_groups(rows, groups.select("text_sha256", "keep_id", "group_size"), "text_sha256", "group_size").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256"
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``documents`` put into a new index in ``BATCHES`` loads, the later ones deduplicated against it, then read against it.

    Null text counts as empty. Of equal texts the largest doc_id stays; repeated
    rows with that same doc_id are all marked kept. An empty table gives no rows.
    The index is a table of its own for this call and goes when the result has
    been checkpointed.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}")
    try:
        _, sizes = ingest(docs, index)
        return checkpointed(report(docs, checkpointed(index.read().drop("group_size").join(sizes, "text_sha256"))))
    finally:
        index.drop()


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""
