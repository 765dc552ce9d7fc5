"""Operators that treat each text by itself: quality rules, BPE, language ID, quality classifier, sharding."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanmill.llm import byte_bpe, language_id, quality_classifier, quality_rules, sharding


# quality rules


def brute(text):
    """Measures by Python tuples instead of hashes."""
    words = quality_rules.WORD.findall(text or "")
    out = []
    for n in sorted(quality_rules.LIMITS):
        grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        many = Counter(grams)
        hit = {k + j for k, g in enumerate(grams) if many[g] > 1 for j in range(n)}
        out.append((len(hit), sum(len(words[k]) for k in hit)))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("a bb c\n d\te é中".split(" ")), max_size=80))
def test_repetition_by_brute_force(parts):
    text = " ".join(parts)
    got, expected = quality_rules.measure(text), brute(text)
    assert got["n_repeat_words"] == expected[0][0]
    assert got["dup_ngram_chars"] == [c for _, c in expected]


def test_quality_matches_sql(agrees):
    agrees(quality_rules.op1_quality_rules, quality_rules.ORACLE_SQL)


def test_quality_edges(spark, odd):
    got = quality_rules.measure_quality(odd).collect()
    assert len(got) == odd.count() and sum(r["n_words"] == 0 for r in got) == 4 and not any(r["kept"] for r in got if r["n_words"] < 10)
    assert quality_rules.measure_quality(odd.limit(0)).count() == 0
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {5}
    assert quality_rules.measure("one line of ten words that is not said again\n" * 9)["kept"] is False


# BPE


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(public_tokenizers.path(byte_bpe.VOCABULARY))


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("aabte nio's l\n\t0129éß中\U0001f600<|>_."), max_size=120))
def test_bpe_agrees(text, codec, reference):
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text) and codec.decode(ids) == text.encode()


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_bpe_tables(name):
    own = byte_bpe.codec(public_tokenizers.path(name))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(7)
    for _ in range(60):
        piece = "".join(rng.choice("aeinstlr") for _ in range(rng.randint(60, 260))).encode()
        held = byte_bpe.PieceTable(own, piece[:40])
        held.append(piece[40:])
        assert list(held.ids) == other._encode_single_piece(piece)
        a = rng.randint(0, len(piece) - 10)
        held.edit(a, a + 7, b"zing")
        assert held.piece == piece[:a] + b"zing" + piece[a + 7 :]
        assert list(held.ids) == other._encode_single_piece(held.piece)
    piece = b"internationalisation" * 40
    held = byte_bpe.PieceTable(own, piece)
    assert held.edit(200, 201, b"q") < len(piece) // 2  # meets the old table again


def test_bpe_appends(codec, reference):
    rng = random.Random(3)
    for _ in range(80):
        parts = ["".join(rng.choice("ab 'lre\n 12.") for _ in range(rng.randint(0, 6))) for _ in range(8)]
        grown = byte_bpe.TextTable(codec)
        for p in parts:
            grown.append(p)
        assert grown.ids == reference.encode_ordinary("".join(parts))


def test_bpe_edits_of_texts(codec, reference):
    rng = random.Random(4)
    word = lambda most: "".join(rng.choice("ab 'lrevts\n\t12.é") for _ in range(rng.randint(0, most)))
    for _ in range(300):
        text = word(40)
        held = byte_bpe.TextTable(codec, text)
        for _ in range(6):
            start = rng.randint(0, len(text))
            stop, by = rng.randint(start, min(len(text), start + 8)), word(6)
            held.edit(start, stop, by)
            text = text[:start] + by + text[stop:]
            assert "".join(p for p, _ in held.pieces) == text and held.ids == reference.encode_ordinary(text), repr(text)
    long = byte_bpe.TextTable(codec, "some words of a text " * 2000)
    assert long.edit(20_000, 20_004, "other") < 12
    with pytest.raises(ValueError):
        long.edit(5, 4, "")


def test_bpe_query(spark, odd, as_table, reference):
    import hashlib

    rows = byte_bpe.op2_byte_bpe(spark, as_table(odd)).collect()
    texts = [r["text"] or "" for r in odd.select("text").collect()]
    expected = Counter((hashlib.sha256(" ".join(map(str, reference.encode_ordinary(t))).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts)
    assert Counter((r["ids_sha256"], r["decoded_sha256"]) for r in rows) == expected
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    back = odd.select("text", byte_bpe.decoded(byte_bpe.encoded(F.col("text"), path), path).cast("string").alias("b"))
    assert back.where("coalesce(text, '') <> b").count() == 0


# language ID


def test_language_accuracy(spark):
    rows = {(r["doc_id"], r["lang_pred"]): r for r in language_id.op6_language_id(spark, "/root/testdata/sf0.01").collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [truth[d] == p for (d, p), r in rows.items() if r["held_out"]]
    assert len(held) > 200 and sum(held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def slow_grams(text):
    """Letter trigrams by a walk over characters; breaks are spaces."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = f" {' '.join(letters.split())} " if letters.strip() else ""
    return Counter(padded[k : k + 3] for k in range(len(padded) - 2))


def slow_vector(p, text):
    """The bundle of a text's bound letters, from the definition."""
    out = np.zeros(p.dimensions)
    for gram, n in slow_grams(text).items():
        bound = np.ones(p.dimensions)
        for place, c in enumerate(reversed(gram)):
            bound = bound * np.roll(p._letter(ord(c)), place)
        out += n * bound
    return out


def test_language_by_brute_force(spark):
    import zlib

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    p = language_id.Profiles()
    held = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1 for d in docs}
    vectors = {d["doc_id"]: slow_vector(p, d["text"] or "") for d in docs}
    total = {}
    for d in docs:
        v = vectors[d["doc_id"]]
        if not held[d["doc_id"]] and d["lang"] is not None and v.any():
            total[d["lang"]] = total.get(d["lang"], 0) + v / np.linalg.norm(v)
    names = sorted(total)
    got = {r["doc_id"]: r for r in language_id.op6_language_id(spark, sf).collect()}
    assert len(got) == len(docs)
    for key, v in vectors.items():
        r = got[key]
        assert r["held_out"] == held[key]
        if not v.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cosines = [float(total[n] @ v / np.linalg.norm(total[n]) / np.linalg.norm(v)) for n in names]
        best = int(np.argmax(cosines))
        assert r["score"] == pytest.approx(max(0, cosines[best]), abs=1e-4)
        assert r["lang_pred"] == names[best] or sorted(cosines)[-1] - cosines[names.index(r["lang_pred"])] < 1e-4


def test_rare_languages_are_learned(spark):
    text = "some words of a language that is spoken by {}"
    rows = [(k, text.format("many"), "en") for k in range(3000)] + [(10_000 + k, "wenige zeilen haben diese sprache", "de") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language_id.learn(df, rows=100)) == {"de", "en"}
    for gram in (0, 4):
        with pytest.raises(ValueError):
            language_id.Profiles(64, gram)


def test_language_edges(spark, odd, as_table):
    got = language_id.op6_language_id(spark, as_table(odd)).collect()
    assert len(got) == odd.count() and sum(r["lang_pred"] == "und" for r in got) == 4
    empty = odd.limit(0)
    assert language_id.op6_language_id(spark, as_table(empty)).count() == 0
    assert language_id.learn(odd.where("lang IS NULL")) == {}


def test_vectors_bind_and_bundle():
    p = language_id.Profiles(64, 3)
    grams, counts = p.grams("Ab1a")
    assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) and counts.sum() == 4  # " ab", "ab ", "b a", " a " with one break for the digit
    direct = sum(c * np.prod([np.roll(p.letter(int(g) >> 21 * k & 0x1FFFFF), k) for k in range(3)], axis=0) for g, c in zip(grams, counts, strict=True))
    assert np.allclose(direct, p.vector("Ab1a"))
    assert p.vector(None) is None and p.vector("12 3") is None


# quality classifier


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in quality_classifier.op7_quality_classifier(spark, sf).where("held_out").collect() if r["doc_id"] in labels]
    assert sum(p == y for _, p, y in got) / len(got) > 0.97
    good, bad = np.array([s for s, _, y in got if y]), np.array([s for s, _, y in got if not y])
    assert (good[:, None] > bad[None]).mean() > 0.98


def slow_features(text):
    """The features by characters and tuples."""
    import math
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars, counts = len(words), len(text), Counter(words)
    sizes = [len(w) for w in words]
    mean = sum(sizes) / n if n else 0
    lines = [x for x in text.split("\n") if x.strip()]
    windows = [tuple(words[k : k + 5]) for k in range(n - 4)]
    share = lambda hit: math.sqrt(sum(map(hit, text)) / max(1, chars))
    return [
        math.log1p(chars), math.log1p(n), math.log1p(mean), math.log1p(math.sqrt(sum((s - mean) ** 2 for s in sizes) / n)) if n else 0, math.log1p(len(counts)) - math.log1p(n),
        math.sqrt(max(counts.values()) / n) if n else 0, -sum(c / n * math.log(c / n) for c in counts.values()) / math.log1p(n) if n else 0, sum(s <= 3 for s in sizes) / n if n else 0,
        math.log1p(chars / max(1, len(lines))), math.sqrt(1 - len(set(lines)) / max(1, len(lines))), math.sqrt(1 - len(set(windows)) / max(1, len(windows))) if words else math.sqrt(1 - len(set(windows)) / max(1, len(windows))),
        share(lambda c: c.lower() != c), math.sqrt((len(text.encode()) - chars) / max(1, chars)), *(share(lambda c, k=kind: c in k) for kind in quality_classifier.KINDS.values()),
    ]


TEXTS = st.text(st.sampled_from("abAZ İΣßé中\U0001f600\n\t |#!19.,_"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_features_by_brute_force(text):
    assert np.allclose(quality_classifier.features(text), slow_features(text), atol=1e-9)


def curve(t):
    return 1 / (1 + np.exp(-np.clip(t, -50, 50)))


def test_logistic_curve_by_bisection():
    rng = np.random.default_rng(3)
    d = rng.normal(scale=4, size=500)
    y = (rng.random(500) < curve(0.7 * d - 1)).astype(float)

    def bisect(f, low, high):
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if f(middle) < 0 else (low, middle)
        return low

    shift_of = lambda a: bisect(lambda b: (curve(a * d + b) - y).sum(), -50, 50)
    slope = bisect(lambda a: ((curve(a * d + shift_of(a)) - y) * d).sum() + 1e-3 * a, 0, 20)
    assert np.allclose(quality_classifier._logistic(d, y), (slope, shift_of(slope)), atol=1e-5)


def test_scores_by_brute_force(spark):
    """Every score of a table from slow features and covariances by definition."""
    import zlib

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in docs}
    used = [(d, y) for d, y in labels if d in docs and not held[d] and y in (0, 1)]
    x, y = np.array([slow_features(docs[d]) for d, _ in used]), np.array([q for _, q in used])
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = lambda v: np.clip((v - centre) / scale, -8, 8)
    own = [z(x[y == k]) for k in (0, 1)]
    pooled = sum(np.cov(v.T, bias=True) * len(v) for v in own) / (len(x) - 2)
    q = quality_classifier
    pooled = (1 - q.TO_DIAGONAL) * pooled + q.TO_DIAGONAL * np.diag(np.diag(pooled))
    shrunk = [(1 - q.TO_POOLED) * np.cov(v.T) + q.TO_POOLED * pooled + q.RIDGE * np.eye(len(centre)) for v in own]

    def difference(v):
        d = [z(v) - o.mean(axis=0) for o in own]
        logs = [-0.5 * (np.einsum("ij,jk,ik->i", e, np.linalg.inv(c), e) + np.linalg.slogdet(c)[1]) for e, c in zip(d, shrunk, strict=True)]
        return logs[1] - logs[0]

    # The few labels of this table can be parted, so the curve's two numbers are taken from the model; the next test has the curve.
    tables = [spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels")]
    model = q.learn(*tables)
    got = {r["doc_id"]: r for r in q.op7_quality_classifier(spark, sf).collect()}
    expected = curve(model.slope * difference(np.array([slow_features(docs[k]) for k in got])) + model.shift)
    assert np.allclose([r["score"] for r in got.values()], expected, atol=1e-6)
    assert all(r["held_out"] == held[k] and r["predicted"] == (r["score"] >= 0.3) for k, r in got.items())


def test_classifier_edges(spark, odd, as_table):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (6, 0), (None, 1), (8, None)], "doc_id long, quality int")
    got = quality_classifier.op7_quality_classifier(spark, as_table(odd, labels=labels)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    none = quality_classifier.op7_quality_classifier(spark, as_table(odd, labels=labels.limit(0))).collect()
    assert {round(r["score"], 6) for r in none} == {0.5}
    assert quality_classifier.op7_quality_classifier(spark, as_table(odd.limit(0), labels=labels)).count() == 0


def test_scores_are_log_density_differences():
    rng = np.random.default_rng(1)
    width = len(quality_classifier.FEATURES)
    x, y = rng.normal(size=(400, width)), np.repeat([0, 1], 200)
    x[y == 1] += 0.5
    model = quality_classifier.fit(x, y)
    z = np.clip((x - model.centre) / model.scale, -8, 8)
    direct = []
    for k in (0, 1):
        cov = np.linalg.inv(model.factors[k].T @ model.factors[k])
        d = z - model.means[k]
        direct.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(direct[1] - direct[0], model.difference(x))


# sharding


def slow_table(shards, size):
    orders = [[(o + k * s) % size for k in range(size)] for o, s in (sharding.preference(n, size) for n in shards)]
    owner = [-1] * size
    while -1 in owner:
        for k, order in enumerate(orders):
            if free := [s for s in order if owner[s] < 0]:
                owner[free[0]] = k
    return owner


def test_table_by_brute_force():
    names = [f"n{k}" for k in range(7)]
    assert sharding.lookup_table(names, 251).tolist() == slow_table(names, 251)


def test_table_is_even_and_stable():
    names = [f"n{k}" for k in range(20)]
    full, less = sharding.lookup_table(names, 10007), sharding.lookup_table(names[:-1], 10007)
    counts = np.bincount(full)
    assert counts.max() - counts.min() <= 1
    moved = (full != less) & (full != 19)
    assert moved.mean() < 0.1
    assert abs(np.bincount(sharding.lookup_table(["a", "b"], 1009, [3, 1]))[0] / 1009 - 0.75) < 0.01
    for bad in ((["a", "a"], 11), ([], 11), (["a"], 10)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement_query(spark, odd, as_table):
    import hashlib

    owner = sharding.lookup_table(sharding.SHARDS)
    for r in sharding.op8_shard_placement(spark, as_table(odd)).collect():
        slot = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert r["slot"] == slot and r["shard"] == sharding.SHARDS[owner[slot]]
    assert sharding.op8_shard_placement(spark, as_table(odd.limit(0))).count() == 0


def test_shards_are_written(spark, odd, tmp_path):
    sharding.write_shards(odd.select("doc_id", "text"), "doc_id", str(tmp_path / "out"), ("a", "b", "c"), 101)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd.count() and back.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_capitals_count_whatever_lower_casing_does_to_the_length():
    assert quality_classifier.features("ABCD efgh")[11] == pytest.approx((4 / 9) ** 0.5)
    assert quality_classifier.features("ABCİ efgh")[11] == pytest.approx((4 / 9) ** 0.5)
    assert quality_classifier.features("abcd efgh")[11] == 0
