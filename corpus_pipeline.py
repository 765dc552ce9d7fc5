"""Raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmill.llm import exact_dedup, packing, quality_rules, secrets, shingle_sets
from gleanmill.llm.common import checkpointed, free_name, remove, shared_dir, table

#: Packing has no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays; the index is this run's own."""
    index = exact_dedup.DigestIndex(spark, f"digests_{uuid.uuid4().hex}")
    try:
        return exact_dedup.deduplicate(docs, index)
    finally:
        index.drop()


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity of five-word shingles 0.8 or more) the document with the smallest doc_id stays."""
    return shingle_sets.keep_one(docs)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text. All documents stay."""
    spans = free_name("spans", docs.columns)
    found = secrets.scan_table(docs, name=spans)
    text = secrets.redacted(F.col("text"), F.col(spans))
    new = {"text": lambda t: text, "n_chars": lambda t: F.when(F.size(spans) > 0, F.length(text).cast(t)).otherwise(F.col("n_chars"))}
    return found.select(*[new[c](t).alias(c) if c in new else F.col(c) for c, t in docs.dtypes])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_dedup", near), ("secret_scan", secret), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written to the shared folder for the next, and goes when the last one's is checkpointed."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{k}-{name}")
        used = shingle_sets.work_folders(docs)
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        for work in used:
            remove(spark, work)
    packed = checkpointed(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, folder)
    return packed
