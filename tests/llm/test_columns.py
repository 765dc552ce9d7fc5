"""Rows that operators pass on keep all their values, whatever their columns are called; and hot keys are joined whole."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanmill.llm import exact_dedup, quality_rules, secrets, sharding, shingle_sets, simhash
from gleanmill.llm.common import checkpointed, free_name, join_groups, key_ranges


def test_kept_rows_are_unchanged(spark, odd, unchanged):
    for f in (simhash.keep_one, shingle_sets.keep_one, quality_rules.keep_good):
        kept = f(odd)
        assert 0 < kept.count() < odd.count()
        unchanged(kept)
    index = exact_dedup.DigestIndex(spark, "digests_of_odd_rows", buckets=2)
    index.drop()
    try:
        unchanged(exact_dedup.deduplicate(odd, index))
    finally:
        index.drop()


def test_appended_columns_replace_their_namesakes(odd, unchanged):
    found = secrets.scan_table(odd)
    assert found.count() == odd.count() and dict(found.dtypes)["findings"].startswith("array")
    unchanged(found, "findings")
    other = secrets.scan_table(odd, name="other")
    assert other.columns == [*odd.columns, "other"]
    unchanged(other.drop("other"))
    placed = sharding.assign_shards(odd, "doc_id")
    assert placed.count() == odd.count() and dict(placed.dtypes)["slot"] == "int" and placed.columns[-2:] == ["slot", "shard"]
    unchanged(placed, "slot", "shard")


def test_stages_keep_values(spark, odd, unchanged):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        unchanged(stage(spark, odd, ""), *(("text", "n_chars") if name == "secret_scan" else ()))
    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.secret(spark, odd, "").collect()}
    assert masked[8].count("[secret]") == 3 and "AKIA" not in masked[8] and masked[2] == "same TEXT here"


def test_free_names():
    assert free_name("a", ["b"]) == "a" and free_name("a", ["A", "a_"]) == "a__"


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_ranges_hold_each_row_once(spark, parts):
    df = spark.createDataFrame([(k,) for k in (None, None, -5, 0, 1, 7, 8, 100, 100, 2**62)], "k long")
    found = [df.where(c).collect() for c in key_ranges(df, "k", parts)]
    assert len(found) == parts and sum(map(len, found)) == df.count()
    tops = [max(own) for f in found if (own := [r["k"] for r in f if r["k"] is not None])]
    assert tops == sorted(tops, reverse=True)
    assert len(key_ranges(df.select(F.col("k").cast("string").alias("k")), "k", 3)) == 1 and len(key_ranges(df.limit(0), "k", 3)) == 1


def test_hot_keys_are_joined_where_they_are(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"), "id").withColumn("m", F.create_map(F.lit("a"), "id"))
    groups = checkpointed(rows.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")))
    joined = join_groups(rows, groups, "k", "n")
    expected = rows.select("k", "id").join(groups, "k", "left")
    assert joined.columns == ["k", "id", "m", "n", "first"] and joined.count() == 6000
    assert joined.select("k", "id", "n", "first").exceptAll(expected.select("k", "id", "n", "first")).count() == 0
    sizes = [r["count"] for r in joined.where("k = 'hot' OR k IS NULL").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 3000
    empty = join_groups(rows.limit(0), checkpointed(groups.limit(0)), "k", "n")
    assert empty.count() == 0
