"""Operator 6, language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point alone.
An n-gram's vector binds (multiplies) its letters' vectors, each permuted by
its place; a text bundles (adds) the vectors of its n-grams, a language those of
its texts, each scaled to length one. A text gets the language whose prototype
has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

DIMENSIONS, GRAM = 1024, 3
#: About so many rows are learned from: of each language as many as it has, up to an even share of what rarer ones leave; chosen by a hash of the id.
TRAINING_ROWS = 20_000
#: N-gram vectors that a worker remembers; a kilobyte each.
REMEMBERED = 40_000
UNKNOWN = "und"
_BREAK = ord(" ")


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), dtype=bool, count=0x110000)


class Profiles:
    """Vectors of n-grams and of texts."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM):
        if not 1 <= gram <= 3:
            raise ValueError("n-grams of one to three letters: three code points of 21 bits fit a number")
        self.dimensions, self.gram = dimensions, gram
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((1024, dimensions), dtype=np.int8)
        self.letter = lru_cache(4096)(self._letter)

    def _letter(self, code: int) -> np.ndarray:
        return np.random.default_rng((7919, code)).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1

    def _bind(self, gram: int) -> np.ndarray:
        out = np.ones(self.dimensions, dtype=np.int8)
        for place in range(self.gram):
            out *= np.roll(self.letter(gram >> (21 * place) & 0x1FFFFF), place)
        return out

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The distinct n-grams of a text and how often each occurs; None without letters.

        Letters are lower-cased; every run of other characters is one break,
        and so are the text's ends.
        """
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        letter = _letters()[codes]
        if not letter.any():
            return None
        codes = np.concatenate(([_BREAK], np.where(letter, codes, _BREAK), [_BREAK])).astype(np.uint64)
        codes = codes[np.concatenate(([True], (codes[1:] != _BREAK) | (codes[:-1] != _BREAK)))]
        n = len(codes) - self.gram + 1
        if n < 1:
            return None
        packed = np.zeros(n, dtype=np.uint64)
        for place in range(self.gram):
            packed |= codes[self.gram - 1 - place :][:n] << np.uint64(21 * place)
        return np.unique(packed, return_counts=True)

    def vector(self, text: str | None) -> np.ndarray | None:
        """The bundle of a whole text's n-grams; None if null or without letters."""
        if not text or (found := self.grams(text)) is None:
            return None
        out = np.zeros(self.dimensions, dtype=np.float32)
        for at in range(0, len(found[0]), 2048):
            grams, counts = found[0][at : at + 2048], found[1][at : at + 2048]
            places = self._place(grams.tolist())  # may replace self.vectors
            out += counts.astype(np.float32) @ self.vectors[places].astype(np.float32)
        return out

    def _place(self, grams: list[int]) -> np.ndarray:
        if len(self.rows) + len(grams) > REMEMBERED:
            self.rows.clear()
        rows = self.rows
        for g in grams:
            if g not in rows:
                if len(rows) == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
                self.vectors[len(rows)] = self._bind(g)
                rows[g] = len(rows)
        return np.fromiter(map(rows.__getitem__, grams), dtype=np.int64, count=len(grams))


@lru_cache(2)
def profiles(dimensions: int, gram: int) -> Profiles:
    return Profiles(dimensions, gram)


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAINING_ROWS, dimensions: int = DIMENSIONS, gram: int = GRAM) -> dict[str, np.ndarray]:
    """A prototype for each language of the rows with a language, which must not include held-out ones.

    With more than ``rows`` of them, a language with more rows than its share
    gives those whose key's hash falls into that share; rare ones give all. Sums are made by language and dimension
    before the shuffle; what comes to the driver is a vector for each language.
    """
    spark = df.sparkSession
    usable = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    # A row for each language, as the prototypes are.
    held, left, share = sorted((r["n"], r["lang"]) for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()), rows, {}
    for k, (n, name) in enumerate(held):
        share[name] = min(1.0, left / (len(held) - k) / n)
        left -= n * share[name]
    shares = spark.createDataFrame([(name, int(x * (1 << 30))) for name, x in share.items()], "lang string, share long")
    usable = usable.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("key", F.lit("language")), F.lit(1 << 30)) < F.col("share"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, total = profiles(dimensions, gram), {}
        for batch in batches:
            for name, x in zip(batch.column(0), batch.column(1), strict=True):
                if (v := p.vector(x.as_py())) is not None and (norm := float(np.linalg.norm(v))):
                    own = total.setdefault(name.as_py(), np.zeros(dimensions, dtype=np.float64))
                    own += v / norm
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = usable.select("lang", "text").mapInArrow(sums, "lang string, v array<double>")
    # Rounded to whole numbers, sums don't depend on the order in which tasks end.
    parts = parts.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum(F.round(F.col("x") * (1 << 20)).cast("long")).alias("x"))
    out: dict[str, np.ndarray] = {}
    for row in parts.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).collect():
        v = np.array([x["x"] for x in row["v"]], dtype=np.float64)
        out[row["lang"]] = (v / (np.linalg.norm(v) or 1)).astype(np.float32)
    return dict(sorted(out.items()))


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", dimensions: int = DIMENSIONS, gram: int = GRAM) -> DataFrame:
    """``df`` (doc_id, held_out and the text) with lang_pred and score, the cosine cut to 0..1.

    Null texts and texts without letters are ``und`` with score 0, and so is
    everything if no language was learned. Ties go to the first language by name.
    """
    names = [*prototypes, UNKNOWN]
    matrix = np.array(list(prototypes.values()), dtype=np.float32).reshape(len(prototypes), dimensions)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = profiles(dimensions, gram)
        for batch in batches:
            best, score = [], []
            for x in batch.column("text"):
                v = p.vector(x.as_py())
                norm = float(np.linalg.norm(v)) if v is not None else 0.0
                if not norm or not len(matrix):
                    best.append(UNKNOWN)
                    score.append(0.0)
                    continue
                cosines = matrix @ v / norm
                best.append(names[k := int(np.argmax(cosines))])
                score.append(min(1.0, max(0.0, float(cosines[k]))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return df.select("doc_id", "held_out", F.col(text).alias("text")).mapInArrow(scored, "doc_id long, held_out boolean, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``documents``, learned from rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    return predict(docs, learn(docs.where(~F.col("held_out"))))
