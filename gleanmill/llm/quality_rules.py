r"""Operator 1, quality rules: how much of a text lies in repeated n-grams and lines.

Words are runs of characters other than space and ``\t``-``\r``. A 64-bit hash
of every word is rolled into hashes of all windows of several lengths with a
multiply and an add for each length, over whole arrays. Windows whose hash
occurs twice or more cover their words; the characters of covered words, and
of repeated lines, are held against a limit for each measure. A repeated
window of n words holds repeated windows of fewer words, so a text without any
at the shortest length is done after one sort.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import relieve, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = dict.fromkeys(map(ord, "#*$%&|<>"))
#: Percent of a text's word characters that repeated windows of so many words may cover (Rae et al. 2021, table A1).
LIMITS: Mapping[int, int] = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Percent of word-bearing lines, and of their characters, that may repeat an earlier line.
LINE_LIMIT, LINE_CHAR_LIMIT = 30, 20
#: The base rule's shortest text in words, its window, and the percent of words that repeated windows may cover.
LEAST_WORDS, BASE_WINDOW, BASE_LIMIT = 10, 5, 20
_STEP = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, dup_ngram_chars array<long>"


def covered(windows: np.ndarray, length: int, words: int) -> np.ndarray | None:
    """Which words lie in a window whose hash occurs twice or more; None if no window repeats."""
    if len(windows) < 2:
        return None
    ranked = np.sort(windows)
    again = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(again):
        return None
    at = np.minimum(np.searchsorted(again, windows), len(again) - 1)
    starts = np.flatnonzero(again[at] == windows)
    edge = np.zeros(words + 1, dtype=np.int64)
    edge[starts] += 1
    np.subtract.at(edge, starts + length, 1)
    return np.cumsum(edge[:-1]) > 0


def repetition(words: list[str], lengths: tuple[int, ...]) -> tuple[int, list[int]]:
    """Words in repeated windows of the first length, and characters in repeated windows of each length."""
    n = len(words)
    chars = [0] * len(lengths)
    if n <= lengths[0]:
        return 0, chars
    one = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    sizes = None
    rolled, repeated, done = one, 0, 1
    for k, length in enumerate(lengths):
        for have in range(done, length):
            rolled = rolled[:-1] * _STEP + one[have:]
        done = length
        if len(rolled) < 2 or (mask := covered(rolled, length, n)) is None:
            break
        if sizes is None:
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
            repeated = int(mask.sum())
        chars[k] = int(sizes[mask].sum())
    return repeated, chars


def measure(text: str | None, limits: Mapping[int, int] = LIMITS) -> dict:
    """All measures of one whole text and the verdict on it.

    Null has no words, no lines and fails. Limits are compared in whole
    numbers: percent times the whole against a hundred times the part.
    """
    text = text or ""
    words = WORD.findall(text)
    n, lengths = len(words), tuple(sorted(limits))
    chars = len("".join(words))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen: set[str] = set()
    dup_lines = dup_line_chars = 0
    for x in lines:
        if x in seen:
            dup_lines += 1
            dup_line_chars += len(x)
        else:
            seen.add(x)
    if lengths[0] == BASE_WINDOW:
        repeat_words, dup_chars = repetition(words, lengths)
    else:
        repeat_words, dup_chars = repetition(words, (BASE_WINDOW,))[0], repetition(words, lengths)[1]
    failed = n < LEAST_WORDS or 100 * repeat_words > BASE_LIMIT * n
    kept = (
        not failed
        and 100 * dup_lines <= LINE_LIMIT * len(lines)
        and 100 * dup_line_chars <= LINE_CHAR_LIMIT * sum(map(len, lines))
        and all(100 * c <= limits[k] * chars for k, c in zip(lengths, dup_chars, strict=True))
    )
    return {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": len(text) - len(text.translate(SYMBOLS)),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "base_failed": failed,
        "kept": kept,
        "dup_line_chars": dup_line_chars,
        "dup_ngram_chars": dup_chars,
    }


def _measures(batches: Iterator[pa.RecordBatch], limits: Mapping[int, int]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("doc_id", pa.int64()), *[(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("dup_line_chars", pa.int64()), ("dup_ngram_chars", pa.list_(pa.int64()))])
    relieve()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = [measure(x.as_py(), limits) for x in part.column("text")]
            yield pa.RecordBatch.from_pylist([{"doc_id": k.as_py(), **r} for k, r in zip(part.column("doc_id"), rows, strict=True)], kinds)


def measure_quality(df: DataFrame, key: str = "doc_id", text: str = "text", limits: Mapping[int, int] = LIMITS) -> DataFrame:
    """One row of measures for each row of ``df``: repeated and null keys and null texts each get theirs; no rows for an empty table.

    No shuffle: every text is measured where it is read.
    """
    rows = df.selectExpr(f"CAST(`{key}` AS BIGINT) AS doc_id", f"CAST(`{text}` AS STRING) AS text")
    return rows.mapInArrow(lambda it: _measures(it, limits), SCHEMA)


def keep_good(df: DataFrame, text: str = "text", limits: Mapping[int, int] = LIMITS) -> DataFrame:
    """The rows of ``df`` whose text passes, all columns unchanged."""
    schema = df.schema

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        relieve()
        for batch in batches:
            yield batch.filter(pa.array([measure(x.as_py(), limits)["kept"] for x in batch.column(text)], pa.bool_()))

    return df.mapInArrow(passing, schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and verdict of every row of ``documents``."""
    return measure_quality(table(spark, sf_dir, "documents"))


_LENGTHS = ", ".join(map(str, LIMITS))
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
n AS (SELECT rid, unnest([{_LENGTHS}]) AS n FROM d),
g AS (SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS win FROM w JOIN n USING (rid), unnest(range(1, len(ws) - n + 2)) AS r(i)),
dup AS (SELECT rid, n, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, n, win) AS c FROM g) WHERE c > 1),
cov AS (SELECT DISTINCT rid, n, j FROM dup, unnest(range(i, i + n)) AS r(j)),
cc AS (SELECT rid, n, count(*) AS words, CAST(sum(length(ws[j])) AS BIGINT) AS chars FROM cov JOIN w USING (rid) GROUP BY rid, n),
lim AS (SELECT unnest([{_LENGTHS}]) AS n, unnest([{", ".join(map(str, LIMITS.values()))}]) AS most),
per AS (SELECT rid, n.n, coalesce(words, 0) AS words, coalesce(chars, 0) AS chars, most FROM n LEFT JOIN cc USING (rid, n) JOIN lim USING (n)),
ln AS (SELECT rid, line, row_number() OVER (PARTITION BY rid, line) AS k FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
l AS (SELECT rid, count(*) AS lines, sum(length(line)) AS line_chars, count(*) FILTER (k > 1) AS dup, coalesce(sum(length(line)) FILTER (k > 1), 0) AS dup_chars FROM ln GROUP BY rid),
a AS (
  SELECT rid, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(l.dup, 0) AS n_dup_lines, coalesce(lines, 0) AS lines, coalesce(line_chars, 0) AS line_chars,
         CAST(coalesce(dup_chars, 0) AS BIGINT) AS dup_line_chars
  FROM d JOIN w USING (rid) LEFT JOIN l USING (rid)
),
p AS (
  SELECT rid, max(words) FILTER (n = {BASE_WINDOW}) AS n_repeat_words, list(chars ORDER BY n) AS dup_ngram_chars,
         bool_and(100 * chars <= most * word_chars) AS fine
  FROM per JOIN a USING (rid) GROUP BY rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {BASE_LIMIT} * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {BASE_LIMIT} * n_words) AND fine
         AND 100 * n_dup_lines <= {LINE_LIMIT} * lines AND 100 * dup_line_chars <= {LINE_CHAR_LIMIT} * line_chars AS kept,
       dup_line_chars, dup_ngram_chars
FROM a JOIN p USING (rid)
"""
