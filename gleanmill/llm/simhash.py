r"""Operator 3, SimHash near-dedup by deletion-variant signatures.

A text's fingerprint has 64 bits, each set if over half of its shingles' hashes
have it. To find fingerprints within ``bits`` differing bits they are cut into
so few segments that one of them differs by at most one bit. Every segment is
indexed once for each of its bits with that bit left out; fingerprints that
agree on such a variant meet in an equality join and are verified.

A variant shared by more than ``BUCKET`` fingerprints is not paired. Its
fingerprints go to a second index, of the whole fingerprint with every choice
of ``bits`` bits left out; two fingerprints are within reach just if they share
one of those, and at most ``2 ** bits`` can. So no group is paired in full, and
no link is lost. Equal fingerprints are one row before any of this.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpointed, join_groups, remove, shared_dir, spread, table, written

WORDS, SEED, BITS = 3, 42, 2
#: Fingerprints that one variant may have for their pairs to be joined; more go to the second index.
BUCKET = 24


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint of a whole text; null and word-less texts have 0.

    A-Z are lower-cased and nothing else; words are runs of bytes other than
    space and ``\\t``-``\\r``, which bytes.split() takes for white space.
    """
    if not text or not (found := text.encode(errors="replace").lower().split()):
        return 0
    shingles = map(b" ".join, zip(*(found[k:] for k in range(words)))) if len(found) >= words else [b" ".join(found)]
    return majority(np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of unsigned hashes; of none it is 0."""
    totals = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        totals += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * totals > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), words, seed) for x in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return df.selectExpr(f"CAST(`{key}` AS BIGINT) AS doc_id", f"CAST(`{text}` AS STRING) AS text").mapInArrow(each, "doc_id long, fp long")


def _variants(fp: Column, bits: int) -> Column:
    """One long for each bit: its number, and its segment with that bit left out."""
    parts = max(2, bits // 2 + 1)
    edges = [64 * k // parts for k in range(parts + 1)]
    out = []
    for low, high in zip(edges, edges[1:]):
        segment = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        out += [segment.bitwiseAND(F.lit(~(1 << (b - low)))).bitwiseOR(F.lit(b << 32)) for b in range(low, high)]
    return F.array(*out)


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def indexed(found: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """a, b: the pairs of distinct fingerprints ``found.fp`` within ``bits`` bits that share a variant of at most ``bucket`` fingerprints; and fp, v: the fingerprints of each variant of more. ``bits`` from 1 to 3."""
    if not 1 <= bits <= 3:
        raise ValueError("bits must be 1, 2 or 3")
    variants = found.select("fp", F.explode(_variants(F.col("fp"), bits)).alias("v"))
    shared = checkpointed(variants.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    near = _distance(F.col("a"), F.col("b")) <= bits
    twos = shared.where("n = 2").where(near).select("a", "b")
    # Past the keys of pairs only few variants are left to be looked at again.
    some = variants.join(shared.where(f"n > 2 AND n <= {bucket}").select("v"), "v", "left_semi")
    one, two = some.select(F.col("fp").alias("a"), F.col("v").alias("_v")), some.select(F.col("fp").alias("b"), F.col("v").alias("_w"))
    pairs = one.join(two, (F.col("_v") == F.col("_w")) & (F.col("a") < F.col("b")) & near).select("a", "b")
    return twos.union(pairs), variants.join(shared.where(f"n > {bucket}").select("v"), "v", "left_semi").select("fp", "v")


def links(found: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """a, b: links between distinct fingerprints ``found.fp`` whose closure is that of all pairs within ``bits`` bits.

    Within a shared variant of the second index all are within reach of the
    least, so links to that one stand for the pairs. ``bits`` from 1 to 3.
    """
    pairs, crowded = indexed(found, bits, bucket)
    hot = crowded.select("fp").distinct()
    masks = F.array(*[F.lit(np.uint64(sum(1 << b for b in chosen)).astype(np.int64).item()) for chosen in combinations(range(64), bits)])
    left = hot.select("fp", F.explode(masks).alias("m")).select("fp", "m", F.col("fp").bitwiseAND(F.bitwise_not("m")).alias("k"))
    least = left.groupBy("m", "k").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    stars = least.select("a", F.explode("all").alias("b")).where("a < b")
    return pairs.union(stars).distinct()


def _relinked(all_: DataFrame, some: DataFrame, folder: str, own: bool = False) -> DataFrame:
    """Edges (v, m) for the edges (u, v) of ``some``, with m the least of u and its neighbours in ``all_``; with ``own`` also (u, m). A node of very many edges finds its m where they are."""
    least = checkpointed(all_.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")))
    moved = join_groups(some, least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return written((moved.union(least.select("u", F.col("m").alias("v"))) if own else moved).where("u <> v").distinct(), folder)


def components(edges: DataFrame) -> DataFrame:
    """node, root for all nodes of ``edges`` (a, b), as a checkpoint: the least node that can be reached.

    Alternates two star operations (Kiveris et al. 2014): first every node
    links its larger neighbours to its least one, then its smaller ones; this
    ends after a few rounds, about the logarithm of the longest chain. Every
    round is written as a table: a checkpoint would keep the planner's guess of
    its size, which each round's joins multiply. No edges come to the driver but
    their number and a checksum.
    """
    spark = edges.sparkSession
    folder = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{folder}/0")
    check = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before, k = check(edges), 0
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = _relinked(both, both.where("v > u"), f"{folder}/{k + 1}")
        edges = _relinked(edges, edges, f"{folder}/{k + 2}", own=True)
        k += 2
        if (now := check(edges)) == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    found = checkpointed(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots))
    remove(spark, folder)
    return found


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id of every row, repeated ones too.

    component_id is the smallest doc_id reachable over links, the row's own
    included; null doc_ids are only chosen where there is no other. Empty and
    null texts share fingerprint 0 and are linked. An empty table gives no rows.
    """
    rows = checkpointed(fingerprints(df, key, text, words, seed))
    # Spread, since each of these small rows becomes 64 variants.
    found = checkpointed(spread(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "fp"))
    nodes = components(links(found.select("fp"), bits)).withColumnRenamed("node", "fp")
    linked = checkpointed(nodes.join(found, "fp").select("fp", "root", "least"))
    least = checkpointed(linked.groupBy("root").agg(F.min("least").alias("_c"), F.count(F.lit(1)).alias("_n")))
    member = join_groups(linked.select("fp", "root"), least, "root", "_n").select("fp", "_c")
    by_fp = checkpointed(found.join(member, "fp", "left").select("fp", "n", F.coalesce("_c", "least").alias("component_id")))
    return join_groups(rows, by_fp, "fp", "n").select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """One row of each group, all columns unchanged: that of the least key; one with a null key only where the group has no other."""
    # The key is marked so that null is apart from all others; a digest of the text tells rows of one key apart.
    mark, digest = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("")), F.coalesce(F.xxhash64(F.col(text).cast("string")), F.lit(0))
    marked = df.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(text).alias("text"), mark.alias("k"), digest.alias("d"))
    groups = near_groups(marked, "d", "text", words, seed, bits).select(F.col("doc_id").alias("d"), "component_id").distinct()
    rows = marked.select("key", "k", "d").join(groups, "d")
    kept = rows.groupBy("component_id").agg(F.min(F.struct(F.col("key").isNull(), "key", "k", "d")).alias("r")).select("r.k", "r.d")
    return marked.join(kept, ["k", "d"], "left_semi").dropDuplicates(["k", "d"]).select("row.*")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``documents``."""
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
