"""The pipeline's near-duplicate stage against the similarity of every pair."""

import numpy as np
import pytest

import corpus_pipeline
from gleanmill.llm import shingle_sets, simhash


def slow_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def slow_groups(texts):
    """The number of the first member of each text's group."""
    own, root = [slow_set(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(own):
        for j in range(i):
            if not a and not own[j] or 5 * len(a & own[j]) >= 4 * len(a | own[j]) > 0:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(k) for k in range(len(texts))]


def near_copies(seed):
    """Chains of edits, a group under shared shingles, texts that share most of a long passage, and short ones."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 4000)}"
    texts = ["", None, "one two", "One TWO", " \t", "one two three"]
    for length in (12, 40, 60, 150):
        for _ in range(4):
            now = [word() for _ in range(length)]
            for _ in range(6):
                texts.append(" ".join(now))
                now = list(now)
                for _ in range(int(rng.integers(1, 1 + max(1, length // 40)))):
                    now[int(rng.integers(0, len(now)))] = word()
    passage = [word() for _ in range(60)]
    texts += [" ".join([*passage, *(word() for _ in range(int(rng.integers(1, 20))))]) for _ in range(30)]
    texts += [" ".join([*passage[: int(rng.integers(20, 60))], *(word() for _ in range(10))]) for _ in range(30)]
    return [texts[k] for k in rng.permutation(len(texts))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_stage_by_brute_force(spark, seed):
    texts = near_copies(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near(spark, docs, "")
    roots = slow_groups(texts)
    assert len(set(roots)) < len(texts) - 40
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots))


def test_near_stage_keeps_one_row_of_each_group(spark):
    texts = [" ".join(f"{name}{k}" for k in range(40)) for name in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[2] + " more"), (5, texts[3]), (5, texts[4]), (5, texts[4]), (None, texts[5]), (None, texts[5] + " more")]
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert len(kept) == 6
    assert {(r["doc_id"], (r["text"] or "")[0]) for r in kept} == {(None, "a"), (None, "b"), (7, "c"), (5, "d"), (5, "e"), (None, "f")}


def test_simhash_links_meet_in_the_stage(spark):
    """A pair of similarity 0.8 that no band has in common, but whose fingerprints differ in two bits."""
    texts = [" ".join([*(f"p6w{k}" for k in range(12)), last]) for last in ("e253", "e286")]
    a, b = map(shingle_sets.shingle_set, texts)
    assert (len(a), len(b), len(np.intersect1d(a, b))) == (9, 9, 8)
    assert np.intersect1d(shingle_sets.band_keys(a), shingle_sets.band_keys(b)).size == 0
    one, two = (simhash.fingerprint(t, words=5) for t in texts)
    assert (one ^ two).bit_count() == 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()] == [0]


def test_print_keys_by_brute_force(spark):
    """Sets have a key of SimHash in common if their fingerprints are within two bits, and only if they are linked over a chain or share a crowded variant."""
    rng = np.random.default_rng(4)
    prints = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 40)]
    turned = lambda base, most, low=0: base ^ sum(1 << int(k) for k in rng.choice(np.arange(low, 62), int(rng.integers(1, most + 1)), replace=False))
    for base in prints[:20]:
        for _ in range(4):  # a chain, each step of one to three bits
            prints.append(base := turned(base, 3))
    crowd = [turned(prints[39], 3, 32) for _ in range(60)]
    prints += prints[30:35] + crowd
    apart = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    rows = [(k, 3, fp) for k, fp in enumerate(prints)]
    got = shingle_sets._print_keys(spark.createDataFrame([*rows, (1000, 0, prints[0])], "node long, n int, fp long")).collect()
    assert len(got) < 64 * len(crowd) + len(rows)
    keys = {}
    for r in got:
        keys.setdefault(r["node"], set()).add(r["s"])
    assert 1000 not in keys
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        root = [min(root[j] for j, _, y in rows if apart(x, y) <= 2) for _, _, x in rows]
    for i, _, x in rows:
        for j, _, y in rows[:i]:
            met = bool(keys.get(i, set()) & keys.get(j, set()))
            assert met or apart(x, y) > 2
            assert not met or root[i] == root[j] or min(apart(x & m, y & m) for m in ((1 << 32) - 1, (1 << 64) - (1 << 32))) <= 1 and apart(x, prints[39]) < 7


def test_recall_of_candidates():
    """Of 2,000 pairs of similarity 0.8 to 0.85 hardly one has no key in common; of pairs that share a tenth hardly one has."""
    rng = np.random.default_rng(9)
    found = {True: 0, False: 0}
    for k in range(2000):
        n = int(rng.integers(20, 400))
        for near in (True, False):
            common = -(-8 * n // 9) if near else n // 6
            pool = np.unique(rng.integers(-(1 << 63), 1 << 63, 2 * n, dtype=np.int64))[: 2 * n - common]
            pool = rng.permutation(pool)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n:]]))
            found[near] += bool(np.intersect1d(shingle_sets.band_keys(a), shingle_sets.band_keys(b)).size)
    assert found[True] >= 1990 and found[False] < 20


def test_parities_bound_what_sets_share():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n, m = int(rng.integers(1, 300)), int(rng.integers(1, 300))
        pool = np.unique(rng.integers(-(1 << 63), 1 << 63, n + m, dtype=np.int64))
        a, b = rng.permutation(pool)[:n], rng.permutation(pool)[:m]
        x, y = shingle_sets.parities(a), shingle_sets.parities(b)
        while len(x) != len(y):
            x, y = (x, y) if len(x) > len(y) else (y, x)
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        apart = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b))
        assert len(shingle_sets.parities(a)) * 64 >= 4 * len(a)
    assert shingle_sets.parities(np.zeros(0, dtype=np.int64)).tolist() == [0]


def test_near_stage_on_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    kept = corpus_pipeline.near(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({rows[k][0] for k in slow_groups([t for _, t in rows])})
