"""Operator 7, a quality classifier: regularised quadratic discriminant.

Each class is a Gaussian over transformed statistics of whole texts. Its
covariance is shrunk towards the pooled one and that towards its diagonal, so
that every class has a well-conditioned matrix. A text's score comes from the
difference of the two log densities, by Mahalanobis distances with Cholesky
factors computed once; a logistic curve fitted on the training rows turns the
difference into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: About so many labelled rows are learned from, evenly over all by a hash of the id.
TRAINING_ROWS = 20_000
#: Weight of the pooled covariance in a class's, and of the diagonal in the pooled one.
TO_POOLED, TO_DIAGONAL, RIDGE = 0.15, 0.1, 1e-3
THRESHOLD = 0.3
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: ASCII characters whose shares are features.
KINDS = {"symbols": "#*$%&|<>~^=+_{}[]\\/@", "marks": ".,;:?'\"()-", "cries": "!", "digits": "0123456789", "bars": "|", "vowels": "aeiouAEIOU"}
#: A row for each kind, and one for the capitals: which bytes count.
_MEMBERS = np.array([[chr(b) in x for b in range(256)] for x in (*KINDS.values(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")], dtype=np.int64)
FEATURES = ("log_chars", "log_words", "word_length", "word_spread", "distinct", "top_word", "entropy", "short_words", "line_length", "repeated_lines", "repeated_windows", "capitals", "wide", *KINDS)


@lru_cache(1)
def _wide_capitals() -> np.ndarray:
    """Which code points beyond ASCII change when lower-cased."""
    return np.fromiter((k > 127 and chr(k).lower() != chr(k) for k in range(0x110000)), dtype=bool, count=0x110000)


def features(text: str | None) -> np.ndarray:
    """The transformed statistics of a whole text; a null or empty one has those of no words.

    Characters are counted by one histogram of the text's UTF-8 bytes; only
    texts with characters beyond ASCII are looked at by code points too.
    """
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    held = _MEMBERS @ np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = WORD.findall(text)
    n, chars = len(words), len(text)
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=n)
    counts = np.fromiter(Counter(words).values(), dtype=np.float64)
    share = counts / n if n else counts
    lines = [x for x in text.split("\n") if x.strip()]
    windows = max(0, n - 4)
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=n)
    rolled = hashes[:windows].copy()
    for k in range(1, 5):
        rolled = rolled * 1_000_003 + hashes[k : k + windows]
    upper = int(held[-1])
    if len(data) > chars:
        upper += int(_wide_capitals()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].sum())
    return np.array(
        [
            np.log1p(chars),
            np.log1p(n),
            np.log1p(sizes.mean()) if n else 0.0,
            np.log1p(sizes.std()) if n else 0.0,
            np.log1p(len(counts)) - np.log1p(n),
            np.sqrt(share.max()) if n else 0.0,
            -(share * np.log(share)).sum() / np.log1p(n) if n else 0.0,
            (sizes <= 3).mean() if n else 0.0,
            np.log1p(chars / max(1, len(lines))),
            np.sqrt(1 - len(set(lines)) / max(1, len(lines))),
            np.sqrt(1 - len(np.unique(rolled)) / max(1, windows)),
            np.sqrt(upper / max(1, chars)),
            np.sqrt((len(data) - chars) / max(1, chars)),
            *np.sqrt(held[:-1] / max(1, chars)),
        ]
    )


@dataclass(frozen=True)
class Model:
    """Centre and scale of the features; for classes 0 and 1 the mean, the inverse Cholesky factor and the log-determinant; the logistic curve."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    slope: float
    shift: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, for each row of raw features."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        far = [(((z - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors, strict=True)]
        return 0.5 * (far[0] - far[1] + self.log_dets[0] - self.log_dets[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -50, 50)))


def _logistic(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method with a small penalty."""
    slope, shift = 0.5, float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * d + shift, -50, 50)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - y) * d).sum() + 1e-3 * slope, (p - y).sum()])
        hess = np.array([[(w * d * d).sum() + 1e-3, (w * d).sum()], [(w * d).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        slope, shift = float(slope - np.clip(step[0], -0.5, 0.5)), float(shift - np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-9:
            break
    return max(slope, 1e-3), shift


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of raw features ``x`` and labels ``y`` (0 or 1).

    Without rows of both classes the score is the share of class 1 (a half if
    there are no rows).
    """
    width = len(FEATURES)
    if not len(x) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(x) else 0.5, 1e-3, 1 - 1e-3))
        one = np.eye(width)
        return Model(np.zeros(width), np.ones(width), np.zeros((2, width)), np.array([one, one]), np.zeros(2), 1.0, float(np.log(share / (1 - share))))
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - centre) / scale, -8, 8)
    own = [z[y == k] for k in (0, 1)]
    means = np.array([v.mean(axis=0) for v in own])
    scatter = [(v - m).T @ (v - m) for v, m in zip(own, means, strict=True)]
    pooled = (scatter[0] + scatter[1]) / max(1, len(z) - 2)
    pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled))
    factors, log_dets = [], []
    for s, v in zip(scatter, own, strict=True):
        cov = (1 - TO_POOLED) * s / max(1, len(v) - 1) + TO_POOLED * pooled + RIDGE * np.eye(width)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        log_dets.append(2 * np.log(np.diag(low)).sum())
    model = Model(centre, scale, means, np.array(factors), np.array(log_dets), 1.0, 0.0)
    return Model(centre, scale, means, model.factors, model.log_dets, *_logistic(model.difference(x), y.astype(float)))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", rows: int = TRAINING_ROWS) -> Model:
    """A model from the labelled rows that aren't held out, about ``rows`` of them at most.

    The sample of labels is bounded, so it may be broadcast; its rows of
    features come to the driver. Null labels are left out; a key's repeated
    labels each count.
    """
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out(key)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y"))
    share = min(1.0, rows / max(1, usable.count()))
    if share < 1:
        usable = usable.where(F.pmod(F.xxhash64(F.col("_key"), F.lit("quality")), F.lit(1 << 30)) < int(share * (1 << 30)))
    joined = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(usable), "_key").select("text", "_y")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array([features(x.as_py()).tolist() for x in batch.column("text")], pa.list_(pa.float64()))], names=["y", "x"])

    found = joined.mapInArrow(rows_of, "y int, x array<double>").toArrow()
    order = np.lexsort(np.array([[*x, y] for x, y in zip(found["x"].to_pylist(), found["y"].to_pylist(), strict=True)]).T) if found.num_rows else []
    x, y = np.array(found["x"].to_pylist()).reshape(-1, len(FEATURES)), np.array(found["y"].to_pylist(), dtype=int)
    return fit(x[order], y[order]) if found.num_rows else fit(x, y)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null and empty texts are scored as texts without words. No shuffle."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = model.score(np.array([features(x.as_py()) for x in batch.column("text")]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(held_out(key), F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``documents``, as ``labels.quality`` marks it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, learn(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
