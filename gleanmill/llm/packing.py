"""Operator 4, best-fit packing: bin completion by branch and bound.

Every document becomes pieces of at most ``capacity`` tokens; only longer ones
are cut. Packing sees just how many pieces have each length: at most
``capacity`` numbers, however large the corpus. A bin is completed around the
largest piece left: all fillings of its free space that no other filling
dominates are enumerated, one after the other, and the chosen one is repeated as
often as the counts allow, then ever less often. The first descent at least
halves one length's count with each choice: it has at most ``capacity *
log2(largest count)`` choices. A best-fit solution is the first incumbent;
branches whose waste already rules out beating the incumbent are cut, and the
steps of the whole search are limited. Pieces then take
their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import codecs
import os
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KEPT, checkpointed, table

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Words, and parts of words, used of late whose ids a worker remembers twice over.
REMEMBERED = 150_000
#: Bytes of text that are encoded together.
CHUNK_BYTES = 8 << 20
#: Most steps that look for the filling to try first, which are no cut, and steps of the whole search, which are the only one.
FILL_STEPS, SEARCH_STEPS = 400, 500_000
#: Tasks over which the pieces of one length are ranked.
SALTS = 64

#: Bytes that no simple word has: ASCII but the printable, and what begins characters past U+024F.
_STRANGE = np.array([(b <= 0x20 and b != 0x0A) or b == 0x7F or b >= 0xCA for b in range(256)])


def _byte_letters() -> str:
    """The letter that byte-level vocabularies have for each byte: printable Latin-1 its own, the others those from U+0100 on; here a space stays one."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    letters = [chr(b if b in own else next(others)) for b in range(256)]
    letters[0x20] = " "
    return "".join(letters)


BYTE_LETTERS = _byte_letters()

#: A run: one filling, as (length, how often) with the longest first, and how many bins have it.
Run = tuple[tuple[tuple[int, int], ...], int]


class Recent(dict):
    """Values of keys used of late: at ``most`` the current ones become the old ones, which are asked before they are forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def unknown(self, keys: set) -> list:
        """The keys of ``keys`` without a value; old ones become current."""
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        new, old = keys.difference(self), self.old
        back = list(filter(old.__contains__, new)) if old else []
        self.update(zip(back, map(old.__getitem__, back)))
        return list(new.difference(back))


class WordIds:
    """Ids of whole texts, by white-space-separated words that were encoded before.

    The tokenizer drops white space and nothing in it looks across ASCII white
    space, so a text's ids are those of its words in order. Words of Latin
    letters, digits and marks are lower-cased and cut as the tokenizer cuts
    them, so that its merges are only asked for parts not seen before, all at
    once; other words the whole tokenizer gets.
    """

    #: Fixed value: how the tokenizer cuts text; and a line feed, which parts words that are cut together.
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")
    #: What a line feed becomes: no id has these bytes, nor do two ids in a row.
    BORDER = b"\xff" * 4

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        #: The same merges over parts that are normalised, cut and in the letters of the vocabulary already.
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer, self.merges.pre_tokenizer = None, WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        #: Which ids end a part.
        self.final = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.final[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.words, self.parts = Recent(REMEMBERED), Recent(REMEMBERED)

    def _one(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_parts(self, parts: set[str]) -> None:
        """Encodes the unknown parts together and takes their ids apart after each final one."""
        new = self.parts.unknown(parts)
        for at in range(0, len(new), 5_000):
            some = new[at : at + 5_000]
            letters = codecs.charmap_decode(" ".join(some).encode(), "strict", BYTE_LETTERS)[0]
            ids = np.asarray(self.merges.encode_batch_fast([letters], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = [0, *((np.flatnonzero(self.final[ids]) + 1) * 4).tolist()]
            data = ids.tobytes()
            self.parts.update(zip(some, (data[i:j] for i, j in zip(ends, ends[1:])), strict=True))

    def _learn(self, words: set[bytes]) -> list[bytes]:
        """Makes every word's ids known; returns those that are to be forgotten after use."""
        new = self.words.unknown(words)
        simple = self._simple(new)
        cut, rare = list(compress(new, simple)), list(compress(new, ~simple))
        if cut:
            parts = self.PARTS.findall(b"\n".join(cut).decode().lower())
            self._learn_parts({*parts} - {"\n"})
            self.parts["\n"] = self.BORDER
            self.words.update(zip(cut, b"".join(map(self.parts.__getitem__, parts)).split(self.BORDER), strict=True))
        self.words.update((w, self._one(w.decode())) for w in rare)
        return rare

    def texts(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; null counts as empty.

        Splitting, finding the distinct words and putting their ids in the
        texts' order are Arrow's; Python sees each distinct word once.
        """
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        rare = self._learn(set(distinct))
        own = pa.array(list(map(self.words.__getitem__, distinct)), pa.large_binary())
        for w in rare:
            del self.words[w]
        flat = own.take(coded.indices)
        ends = np.frombuffer(flat.buffers()[1], dtype=np.int64, count=len(flat) + 1, offset=8 * flat.offset) if len(flat) else np.zeros(1, dtype=np.int64)
        data = memoryview(flat.buffers()[2] or b"")
        at = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])].tolist()
        for low, high in zip(at, at[1:]):
            yield bytes(data[low:high])

    @staticmethod
    def _simple(words: list[bytes]) -> np.ndarray:
        """Which words may be cut here: under 64 bytes, nothing of a special token, only characters that normalise to themselves but for case.

        Those are U+0021 to U+007E and U+00A1 to U+024F without U+0130.
        """
        data = np.frombuffer(b"\n".join([*words, b"", b""]), dtype=np.uint8)
        here, after = data[:-1], data[1:]
        strange = _STRANGE[here] | ((here == 0xC2) & (after < 0xA1)) | ((here == 0xC4) & (after == 0xB0)) | ((here == 0xC9) & (after > 0x8F)) | ((here == ord("<")) & (after == ord("|")))
        ends = np.flatnonzero(here == ord("\n"))[: len(words)]
        return (np.diff(np.cumsum(strange)[ends], prepend=0) == 0) & (np.diff(ends, prepend=-1) <= 64)


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


KEPT.append(word_ids)


def _by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts begin within the same ``CHUNK_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // CHUNK_BYTES, prepend=-1)).tolist()
    for low, high in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(low, high - low)


def cut_documents(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of rows (doc_id, text): doc_id, piece, start, length, ids_crc32, and their ids if asked for.

    A null or empty text is one piece that holds just the end id.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_size(batch):
                out = []
                for key, ids in zip(part.column("doc_id").to_pylist(), word_ids(path).texts(part.column("text")), strict=True):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        out.append((key, k, start // 4, len(own) // 4, zlib.crc32(own)) + ((own,) if with_ids else ()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return df.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by the total, and by pieces too long to share (Martello and Toth's L2)."""
    sizes = np.arange(capacity + 1)
    many, tokens = np.cumsum(counts), np.cumsum(counts * sizes)
    best = -(-int(tokens[-1]) // capacity)
    half = capacity // 2
    for least in range(half + 1):
        alone = int(many[capacity] - many[capacity - least])
        large, large_tokens = int(many[capacity - least] - many[half]), int(tokens[capacity - least] - tokens[half])
        small = int(tokens[half] - (tokens[least - 1] if least else 0))
        best = max(best, alone + large + max(0, -(-(small - (large * capacity - large_tokens)) // capacity)))
    return best


def _fit(left: np.ndarray, first: int, capacity: int) -> tuple[tuple[int, int], ...]:
    """The best-fit filling around a piece of length ``first``: the longest that still fits, again and again."""
    filling, space = [(first, 1)], capacity - first
    own = {first: 1}
    while space > 0:
        fits = np.flatnonzero(left[1 : space + 1])
        size = next((int(k) + 1 for k in fits[::-1] if left[k + 1] > own.get(int(k) + 1, 0)), 0)
        if not size:
            break
        times = min(space // size, int(left[size]) - own.get(size, 0))
        own[size] = own.get(size, 0) + times
        space -= times * size
    filling = sorted(own.items(), reverse=True)
    return tuple(filling)


class Fillings:
    """All undominated fillings around ``first``, one at a time: first the one of least waste that ``probe`` steps find, then the others, longest pieces first.

    A filling is dominated if one of its pieces could be swapped for a longer
    one that is left and fits, or another could be added. ``left`` is not
    copied: whenever one is asked for it must hold what it held at first.
    ``without`` is a filling to leave out.
    """

    def __init__(self, left: np.ndarray, first: int, capacity: int, probe: int = FILL_STEPS, without: tuple[tuple[int, int], ...] | None = None):
        self.left, self.first, self.space, self.probe, self.without = left, first, capacity - first, probe, without
        self.spent = 0
        self._restart()

    def _restart(self) -> None:
        #: Position in the lengths, space, most waste, last length of which pieces were left out, what was chosen, how often to choose the position's (-1: not known).
        self.stack = [(0, self.space, self.space, 2 * self.space + 1, (), -1)] if self.first else []

    def _load(self) -> None:
        own = self.left[: self.space + 1].copy()
        if self.first <= self.space:
            own[self.first] -= 1
        sizes = np.flatnonzero(own)[::-1]
        counts = own[sizes]
        self.rest = [*np.cumsum((sizes * counts)[::-1])[::-1].tolist(), 0]
        self.sizes, self.counts, self.negative = sizes.tolist(), counts.tolist(), (-sizes).tolist()

    def _whole(self, chosen: tuple[tuple[int, int], ...]) -> tuple[tuple[int, int], ...]:
        if chosen and chosen[0][0] == self.first:
            return ((self.first, chosen[0][1] + 1), *chosen[1:])
        return ((self.first, 1), *chosen)

    def _search(self, allowed: int, steps: int) -> tuple[int, tuple[tuple[int, int], ...]] | None:
        """The next filling with at most ``allowed`` waste; None if there is no other or ``steps`` are spent."""
        sizes, counts, rest = self.sizes, self.counts, self.rest
        while self.stack and self.spent < steps:
            at, space, cap, skipped, chosen, times = self.stack.pop()
            self.spent += 1
            if times < 0:
                at = max(at, bisect_left(self.negative, -space))
                if space - rest[at] > min(cap, allowed):
                    continue
                if at == len(sizes) or sizes[at] == space:  # nothing else fits, or one piece fills it
                    found = self._whole((*chosen, (space, 1)) if at < len(sizes) else chosen)
                    if found != self.without:
                        return (0 if at < len(sizes) else space), found
                    continue
                times = min(space // sizes[at], counts[at])
            size, most = sizes[at], min(space // sizes[at], counts[at])
            if times:
                self.stack.append((at, space, cap, skipped, chosen, times - 1))
                cap, chosen = min(cap, skipped - size - 1), (*chosen, (size, times))
            if times < most:
                cap, skipped = min(cap, size - 1), size
            self.stack.append((at + 1, space - times * size, cap, skipped, chosen, -1))
        return None

    def next(self, allowed: int, steps: int) -> tuple[int, tuple[tuple[int, int], ...]] | None:
        """(waste, filling); ``self.spent`` is the number of steps that this took, ``steps`` at most."""
        self.spent, best = 0, None
        if allowed < 0 or not self.first:
            return None
        self._load()
        if self.probe:
            while (best is None or best[0]) and (found := self._search(allowed, min(self.probe, steps))):
                best = min(best or found, found, key=lambda x: x[0])
            self.probe = 0
            self._restart()
            self.given = best and best[1]
            if not best:  # the probe was too short
                best = self._search(allowed, steps)
        else:
            while (best := self._search(allowed, steps)) and best[1] == self.given:
                pass
        self.rest = self.sizes = self.counts = self.negative = None
        return best


def _repeats(left: np.ndarray, filling: tuple[tuple[int, int], ...]) -> int:
    return min(int(left[s]) // k for s, k in filling)


def best_fit(counts: np.ndarray, capacity: int) -> list[Run]:
    """The incumbent: best-fit fillings around the largest piece left."""
    left, runs = counts.copy(), []
    while (largest := int(np.max(np.flatnonzero(left), initial=0))) > 0:
        filling = _fit(left, largest, capacity)
        times = _repeats(left, filling)
        for s, k in filling:
            left[s] -= k * times
        runs.append((filling, times))
    return runs


def complete_bins(counts: np.ndarray, capacity: int = CAPACITY, steps: int = SEARCH_STEPS) -> list[Run]:
    """A packing of ``counts[length]`` pieces into as few bins as the search finds.

    Stops at the lower bound, or after ``steps`` enumeration steps; the best
    solution up to there stands, and it is never worse than best fit.
    """
    counts = np.asarray(counts, dtype=np.int64)
    if counts[0] or (counts < 0).any() or len(counts) != capacity + 1:
        raise ValueError("counts must have a count for each length from 1 to the capacity")
    total = int((counts * np.arange(capacity + 1)).sum())
    best = best_fit(counts, capacity)
    bins, bound = sum(t for _, t in best), lower_bound(counts, capacity)
    if bins <= bound:
        return best
    left, waste, spent = counts.copy(), 0, 0
    path: list[tuple[Fillings, tuple[tuple[int, int], ...], int, int]] = []  # a node, the filling tried, its waste, how often

    def node(without: tuple[tuple[int, int], ...] | None = None) -> Fillings:
        held = np.flatnonzero(left)
        probe = min(FILL_STEPS, max(1, (steps - spent) // (4 * len(held) + 1)))  # so that the first descent leaves steps to spend
        return Fillings(left, int(held[-1]) if len(held) else 0, capacity, probe, without)

    now = node()
    while spent < steps:
        allowed = (bins - 1) * capacity - total - waste  # more waste than this can't beat the incumbent
        found, without = now.next(allowed, steps - spent), None
        spent += 1 + now.spent
        if found:
            own, filling = found
            times = _repeats(left, filling)
        elif path:
            now, filling, own, times = path.pop()
            for s, k in filling:
                left[s] += k * times
            waste -= own * times
            allowed += own * times
            times, without = times - 1, filling
        else:
            break
        times = min(times, allowed // own) if own else times
        if times < 1 or allowed < 0:
            continue
        for s, k in filling:
            left[s] -= k * times
        waste += own * times
        path.append((now, filling, own, times))
        if not left.any() and (used := sum(t for *_, t in path)) < bins:
            runs: dict[tuple[tuple[int, int], ...], int] = {}
            for _, f, _, t in path:
                runs[f] = runs.get(f, 0) + t
            best, bins = list(runs.items()), used
            if bins <= bound:
                break
        now = node(without)
    return best


def place(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """``pieces`` (doc_id, piece, length, and more) with sequence_id and offset appended.

    Reads ``pieces`` twice, so give it a checkpointed table. Pieces of one
    length are dealt over ``salts`` tasks and ranked there, then each task's
    ranks are moved up by what the tasks before it hold. The broadcast table
    has a row for each length of each run, and a bin holds under
    ``sqrt(2 * capacity)`` different lengths: its size depends on the capacity
    and the logarithm of the corpus.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    held = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    held = checkpointed(held)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in held.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    slots, sequence, taken = [], 0, np.zeros(capacity + 1, dtype=np.int64)
    for filling, times in complete_bins(counts, capacity):
        at = 0
        for size, k in filling:
            slots.append((size, int(taken[size]), int(taken[size]) + k * times, k, sequence, at))
            taken[size] += k * times
            at += size * k
        sequence += times
    before = held.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).select("length", "_salt", "_before")
    ranked = salted.withColumn("_own", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_own") + F.col("_before"))
    places = spark.createDataFrame(slots, "length long, _from long, _to long, _k long, _first long, _at long")
    placed = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).drop(places["length"])
    nth = F.col("_rank") - F.col("_from")
    return placed.select(
        *pieces.columns,
        (F.col("_first") + F.floor(nth / F.col("_k"))).cast("long").alias("sequence_id"),
        (F.col("_at") + (nth % F.col("_k")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row.

    Null and repeated keys are packed like any other row; null texts count as
    empty. An empty table gives no rows.
    """
    rows = df.selectExpr(f"CAST(`{key}` AS BIGINT) AS doc_id", f"CAST(`{text}` AS STRING) AS text")
    pieces = checkpointed(cut_documents(rows, path or public_tokenizers.path(VOCABULARY), capacity))
    return place(pieces, capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every row of ``documents`` with its place."""
    return pack_documents(table(spark, sf_dir, "documents"))
