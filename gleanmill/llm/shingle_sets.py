"""Near copies by the Jaccard similarity of their sets of five-word shingles.

Candidates come from ``simhash`` first: each set has a fingerprint, and sets
whose fingerprints its deletion variants link, by any chain, have the number of
that group as a key in common; those of a crowded variant have the variant.
Fingerprints of similarity 0.8 differ in about ten bits, beyond its reach, so a
set has ``BANDS`` more keys, of MinHash bands, each of the least members under
``ROWS`` hash functions; two sets of similarity j have one of these in common
with probability 1 - (1 - j ** ROWS) ** BANDS: 0.99993 for j = 0.8. What they
only share a passage for hardly ever meets. Candidates are verified on whole
sets, so no false pair counts.

Rows are reduced to one for each set and written once, bucketed by a number of
the set: what follows reads texts from there without shuffling them again, and
the result is read from there too. First the sets of a key are verified against
one of them only, that which meets most others under all its keys. Of the pairs
left, those within the largest group found so far under their key would add
nothing, so a key that a large group of near copies shares costs as much as it
has rows, times those outside that group; and bitmaps of the sets rule out, in
the join, all but pairs that are similar or nearly so.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpointed, join_groups, relieve, shared_dir, spread
from .simhash import components, indexed, majority

WORDS, SEED = 5, 42
#: Keys of a set, and hash functions that make one.
BANDS, ROWS = 24, 5
#: Pairs of one set beyond which its text is given to several tasks.
PAIRS_A_TASK = 1_000
#: Documents whose prefixes, or pairs whose verdicts, are handed over at once.
SLICE = 512


def shingle_set(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a shorter text is one shingle, a word-less one has none.

    Words are those of ``simhash.fingerprint``.
    """
    if not text or not (found := text.encode(errors="replace").lower().split()):
        return np.zeros(0, dtype=np.int64)
    shingles = map(b" ".join, zip(*(found[k:] for k in range(words)))) if len(found) >= words else [b" ".join(found)]
    return np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64).view(np.int64))


def _node(own: np.ndarray) -> int:
    """One number for one set."""
    return int(np.uint64(xxh64_intdigest(own.tobytes(), SEED)).astype(np.int64))


def parities(own: np.ndarray) -> np.ndarray:
    """For each of 4 numbers a member, or more up to a power of two and 64 at least, whether an odd number of members fall on it; as longs.

    Where those of two sets differ, a member is in one set only: that bounds
    what they share. Halves combined by XOR are the bits of half the width.
    """
    width = max(64, 1 << int(4 * len(own) - 1).bit_length()) if len(own) else 64
    odd = np.bincount(own & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)
        del batch
        pa.default_memory_pool().release_unused()


def write_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """node, n (the set's size), fp (its fingerprint as a signed long), bits (``parities``) and row of each distinct set of ``df``: its row of least key, one with a null key only where there is no other.

    Written once, into a folder of the shared one, bucketed by node. Copies
    collapse within each task before the shuffle.
    """
    spark = df.sparkSession

    @F.arrow_udf("struct<node:long,n:int,fp:long,bits:array<long>>")
    def numbered(texts: pa.Array) -> pa.Array:
        relieve()
        nodes, sizes, prints, bits = [], [], [], [np.zeros(0, dtype=np.int64)]
        for x in texts:
            own = shingle_set(x.as_py())
            nodes.append(_node(own))
            sizes.append(len(own))
            prints.append(majority(own.view(np.uint64)))
            bits.append(parities(own))
        ends = pa.array(np.cumsum([0, *map(len, bits[1:])]).astype(np.int32))
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(bits)))
        pa.default_memory_pool().release_unused()
        return pa.StructArray.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), lists], names=["node", "n", "fp", "bits"])

    # Only texts go to Python; rows wait for their numbers in the JVM.
    rows = df.select(F.struct("*").alias("row"), numbered(F.col(text).cast("string")).alias("x")).select("row", "x.node", "x.n", "x.fp", "x.bits")
    own = F.col("row").getField(key)
    order = F.struct(own.isNull(), own, F.xxhash64(F.col("row").getField(text)))
    distinct = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits"), F.min_by("row", order).alias("row"))
    buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"near_{uuid.uuid4().hex}"
    distinct.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark).rstrip('/')}/near-{name}").bucketBy(buckets, "node").sortBy("node").saveAsTable(name)
    sets = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only its name: the files stay
    return sets


_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(own: np.ndarray) -> np.ndarray:
    """The keys of a set that isn't empty."""
    values = own.view(np.uint64)
    least = np.fromiter(((values * f).min() for f in _FACTORS), dtype=np.uint64, count=len(_FACTORS)).reshape(BANDS, ROWS)
    return np.fromiter((xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least)), dtype=np.uint64, count=BANDS).view(np.int64)


def _keys(texts: DataFrame) -> DataFrame:
    """node, n, s for each key s of each set that isn't empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            sets = [shingle_set(x.as_py()) for x in part.column("t")]
            some = np.array([len(own) > 0 for own in sets], dtype=bool)
            nodes, sizes = part.column("node").to_numpy(zero_copy_only=False)[some], np.array([len(own) for own in sets if len(own)], dtype=np.int32)
            keys = np.concatenate([np.zeros(0, dtype=np.int64), *(band_keys(own) for own in sets if len(own))])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, BANDS)), pa.array(np.repeat(sizes, BANDS)), pa.array(keys)], names=["node", "n", "s"])

    return texts.mapInArrow(each, "node long, n int, s long")


def _print_keys(sets: DataFrame) -> DataFrame:
    """node, n, s: keys of sets that aren't empty, so that any two whose fingerprints are equal or within two bits have one in common.

    One is for each component of fingerprints that ``simhash.indexed`` links;
    a variant of many fingerprints is a key itself, so that such a crowd is not
    paired here but verified like that of any key.
    """
    some = sets.where("n > 0").select("node", "n", "fp")
    # Spread, since each of these small rows becomes 64 variants.
    prints = checkpointed(spread(some.groupBy("fp").agg(F.count(F.lit(1)).alias("c")), "fp"))
    pairs, crowds = indexed(prints.select("fp"))
    linked = components(pairs).withColumnRenamed("node", "fp")
    crowds = checkpointed(crowds.groupBy("fp").agg(F.collect_list(F.xxhash64(F.lit(1), "v")).alias("crowds")))  # 64 at most
    own = F.when(F.col("root").isNotNull() | (F.col("c") > 1), F.array(F.xxhash64(F.lit(0), F.coalesce("root", "fp")))).otherwise(F.array().cast("array<long>"))
    keys = F.concat(own, F.coalesce("crowds", F.array().cast("array<long>")))
    shared = checkpointed(prints.join(linked, "fp", "left").join(crowds, "fp", "left").select("fp", "c", keys.alias("keys")).where(F.size("keys") > 0))
    return join_groups(some, shared, "fp", "c").select("node", "n", F.explode("keys").alias("s"))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of ``s`` those that don't have theirs alone."""
    last, again = None, False  # the row kept back, and whether the one before it has the same ``s``
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([*([last] if last is not None else []), batch]).combine_chunks()
        s = whole.column("s").to_numpy()
        same = s[1:] == s[:-1]
        keep = np.append(same, False) | np.insert(same, 0, again)
        now = whole.slice(0, len(s) - 1).filter(pa.array(keep[:-1]))
        yield from now.to_batches()
        last, again = whole.slice(len(s) - 1).to_batches()[0], bool(keep[-1])
    if last is not None and again:
        yield last


def _possible(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can have similarity 4/5 or more."""
    return (n * 5 >= m * 4) & (m * 5 >= n * 4)


def _near(x: str, y: str) -> Column:
    """Whether sizes and bits (of rows ``x`` and ``y`` of a join) allow similarity 4/5 or more: bits of sets of such sizes have one width, or one twice the other's."""
    n, m, a, b = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.bits"), F.col(f"{y}.bits")
    xor = lambda p, q: p.bitwiseXOR(q)
    half = lambda c: F.zip_with(F.slice(c, 1, F.shiftright(F.size(c), 1)), F.slice(c, F.shiftright(F.size(c), 1) + 1, F.shiftright(F.size(c), 1)), xor)
    one, two = F.when(F.size(a) > F.size(b), half(a)).otherwise(a), F.when(F.size(b) > F.size(a), half(b)).otherwise(b)
    apart = F.aggregate(F.zip_with(one, two, lambda p, q: F.bit_count(xor(p, q))), F.lit(0), lambda total, k: total + k)
    return F.when(_possible(n, m), apart * 9 <= n + m).otherwise(False)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of similarity 4/5 or more, as a checkpoint.

    The text of a set with many pairs goes to several tasks, so none gets all of them.
    """

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, np.zeros(0, dtype=np.int64)
        for part in _slices(batches):
            keep = []
            for b, x, y in zip(part.column("b").to_pylist(), part.column("ta"), part.column("tb"), strict=True):
                if b != last:  # rows come in order of b
                    last, mine = b, shingle_set(y.as_py())
                other = shingle_set(x.as_py())
                keep.append(9 * len(np.intersect1d(mine, other, assume_unique=True)) >= 4 * (len(mine) + len(other)))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = checkpointed(pairs)
    counts = checkpointed(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")))
    parts = F.ceil(F.col("c") / PAIRS_A_TASK).cast("long")
    dealt = join_groups(pairs, counts, "a", "c").select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("part"))
    centres = counts.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").select("a", "ta", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    both = dealt.join(centres, ["a", "part"]).select("a", "b", "ta").join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
    return checkpointed(both.select("a", "b", "ta", "tb").mapInArrow(close, "a long, b long"))


def groups(sets: DataFrame, text: str) -> DataFrame:
    """node, root of every set of ``write_sets`` that is in a group with another, as a checkpoint.

    Sets are in one group if pairs of similarity 4/5 or more lead from one to the other.
    """
    texts = sets.select("node", F.col("row").getField(text).cast("string").alias("t"))
    held = checkpointed(_print_keys(sets).union(_keys(texts)).repartition("s").sortWithinPartitions("s").mapInArrow(_shared, "node long, n int, s long"))
    size = checkpointed(held.groupBy("s").agg(F.count(F.lit(1)).alias("c")))
    meets = join_groups(held, size, "s", "c").groupBy("node").agg(F.sum("c").alias("d"))
    ranked = held.join(meets, "node")
    centre = checkpointed(ranked.groupBy("s").agg(F.max(F.struct("d", "node", "n")).alias("m"), F.count(F.lit(1)).alias("c")).select("s", "c", F.col("m.node").alias("a"), F.col("m.n").alias("m")))
    met = join_groups(held, centre, "s", "c").where((F.col("a") != F.col("node")) & _possible(F.col("n"), F.col("m")))
    first = _verified(met.select("a", F.col("node").alias("b")).distinct(), texts)
    member = held.join(components(first), "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = member.groupBy("s", "root").agg(F.count(F.lit(1)).alias("c"))
    main = checkpointed(counts.groupBy("s").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("roots")).select("s", F.when(F.col("roots") > 1, F.col("m.root")).alias("main"), "c"))
    open_ = join_groups(member, main, "s", "c").where("main IS NOT NULL")
    open_ = checkpointed(open_.join(sets.select("node", "bits"), "node"))
    x, y = open_.where("root <> main").alias("x"), open_.alias("y")
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    others = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.root") != F.col("y.root")) & once & _near("x", "y"))
    others = others.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    return components(first.union(_verified(others, texts)))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, all columns unchanged: that of the least key; one with a null key only where the group has no other.

    Texts without words are one group. An empty table gives no rows. The
    result is read from a folder ``near-*`` in the shared one (``work_folders``).
    """
    sets = write_sets(df, key, text)
    own = F.col("row").getField(key)
    order = F.struct(own.isNull(), own, F.xxhash64(F.col("row").getField(text)))
    ranked = groups(sets, text).join(sets.select("node", order.alias("o")), "node")
    first = ranked.groupBy("root").agg(F.min_by("node", "o").alias("node"))
    gone = checkpointed(ranked.select("node").join(first.select("node"), "node", "left_anti"))
    return sets.join(gone, "node", "left_anti").select("row.*")


def work_folders(df: DataFrame) -> list[str]:
    """The folders ``near-*`` that ``df`` reads, which may go when it has been used."""
    return sorted({f.rsplit("/", 1)[0] for f in df.inputFiles() if f.rsplit("/", 2)[-2].startswith("near-")})
