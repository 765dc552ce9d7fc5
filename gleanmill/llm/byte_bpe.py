"""Operator 2, byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece (one match of the split pattern) the encoding
of that prefix has one last token. Walking the prefixes in order, the last
token of the next one is the only vocabulary token that ends there and forms a
valid pair with the last token of the prefix before it. A pair is valid if
merging the bytes of both gives back the two, which shows from the order in
which their own parts were merged. The table of last tokens allows exact
appends, and after an edit it is only computed anew up to where it meets the
old one again.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate, chain

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces, and prefixes of short pieces, that a worker remembers; beyond that it forgets them all and starts again.
REMEMBERED = 250_000
#: Bytes up to which a piece's prefixes go to the table shared by all pieces.
SHORT = 48
_NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder over one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.bytes_of = {k: b for b, k in ranks.items()}
        self.ends: dict[bytes, int] = {}  # every suffix of a token, with its rank or -1
        for token in ranks:
            for at in range(len(token) - 1, -1, -1):
                self.ends.setdefault(token[at:], -1)
        self.ends.update(ranks)
        self.longest = max(map(len, ranks))
        self.known: dict[str, tuple[int, ...]] = {}
        self.prefixes: dict[bytes, int] = {}
        self.numerals = {k: str(k) for k in self.bytes_of}
        self.valid = lru_cache(1 << 17)(self._valid)
        self.spines = lru_cache(1 << 16)(self._spines)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merge into ``token`` last; None for single bytes and for tokens that merging never reaches."""
        parts = [self.ranks[bytes([b])] for b in self.bytes_of[token]]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(self.bytes_of[x] + self.bytes_of[y], _NEVER), k) for k, (x, y) in enumerate(zip(parts, parts[1:])))
            if rank == _NEVER:
                return None
            parts[at : at + 2] = [rank]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _spines(self, token: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """The tokens at the left and at the right edge of ``token`` while it is merged, from a byte to itself."""
        if len(self.bytes_of[token]) == 1:
            return (token,), (token,)
        if (pair := self.halves(token)) is None or (left := self.spines(pair[0])) is None or (right := self.spines(pair[1])) is None:
            return None
        return (*left[0], token), (*right[1], token)

    def _valid(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` encode to just these two.

        Follows the parts at both sides of the border as they grow; if two of
        them merge before either is merged into its own token, the pair can't
        stand. Merges of one rank go from left to right.
        """
        one, two = self.spines(a), self.spines(b)
        if one is None or two is None:
            return False
        left, right = one[1], two[0]
        i = j = 0
        while True:
            next_left = left[i + 1] if i + 1 < len(left) else _NEVER
            next_right = right[j + 1] if j + 1 < len(right) else _NEVER
            across = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]], _NEVER)
            if across < next_left and across <= next_right and across < _NEVER:
                return False
            if next_left == next_right == _NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def last_token(self, prefix: bytes) -> int:
        """The last token of a short prefix, from the table that all pieces share; longest candidates first, and only the prefixes they ask for."""
        found = self.prefixes.get(prefix)
        if found is not None:
            return found
        ranks = self.ranks
        for begin in range(len(prefix)):
            token = ranks.get(prefix[begin:])
            if token is not None and (self.valid(self.last_token(prefix[:begin]), token) if begin else self.spines(token)):
                break
        else:
            raise ValueError("no valid last token: the vocabulary lacks a byte")
        if len(self.prefixes) >= REMEMBERED:
            self.prefixes.clear()
        self.prefixes[prefix] = token
        return token

    def extend(self, piece: bytes, last: list[int], to: int) -> None:
        """Fills ``last`` (the last token of each prefix) up to the prefix of ``to`` bytes."""
        ends, valid = self.ends, self.valid
        for end in range(len(last) + 1, to + 1):
            for begin in range(end - 1, max(-1, end - 1 - self.longest), -1):
                token = ends.get(piece[begin:end])
                if token is None:
                    raise ValueError("no token ends here: the vocabulary lacks a byte or the pair rule failed")
                if token >= 0 and (not begin or valid(last[begin - 1], token)) and (begin or self.spines(token)):
                    last.append(token)
                    break
            else:
                raise ValueError("no valid last token")

    def tokens(self, last: list[int]) -> tuple[int, ...]:
        """The encoding that a table of last tokens stands for."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[last[at - 1]])
        return tuple(reversed(out))

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) <= SHORT:
            out = []
            while piece:
                out.append(token := self.last_token(piece))
                piece = piece[: -len(self.bytes_of[token])]
            return tuple(reversed(out))
        last: list[int] = []
        self.extend(piece, last, len(piece))
        return self.tokens(last)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text; null and empty texts have none."""
        pieces, known = self.split.findall(text or ""), self.known
        new = set(pieces).difference(known)
        for piece in new:
            known[piece] = self.encode_piece(piece.encode())
        ids = list(chain.from_iterable(map(known.__getitem__, pieces)))
        for piece in new:
            if len(piece) > SHORT:
                del known[piece]
        if len(known) >= REMEMBERED:
            known.clear()
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids; an id outside the vocabulary is a KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PieceTable:
    """The prefix table of one piece, for appends and edits; ``ids`` is its encoding by merging."""

    def __init__(self, codec: Codec, piece: bytes = b""):
        self.codec, self.piece, self.last = codec, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.codec.extend(self.piece, self.last, len(self.piece))

    def edit(self, start: int, stop: int, by: bytes) -> int:
        """Replaces bytes ``start`` to ``stop``; returns how many prefixes were computed anew.

        Past the edit a prefix depends on no more bytes and entries than the
        longest token has; once that many agree with the old ones, all do.
        """
        old, shift = self.last, len(by) - (stop - start)
        self.piece = self.piece[:start] + by + self.piece[stop:]
        self.last, same, anew = old[:start], 0, 0
        while len(self.last) < len(self.piece):
            self.codec.extend(self.piece, self.last, len(self.last) + 1)
            anew += 1
            at = len(self.last)
            same = same + 1 if at > start + len(by) and self.last[-1] == old[at - shift - 1] else 0
            if same >= self.codec.longest:
                self.last += old[at - shift :]
                break
        return anew

    @property
    def ids(self) -> tuple[int, ...]:
        return self.codec.tokens(self.last)


class TextTable:
    """A changing text's encoding. What follows a piece can change it and the one before, no others: so an append splits anew from the last two pieces, and an edit from two before it up to where pieces begin as they did."""

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.pieces = codec, []
        self.append(text)

    def append(self, more: str) -> None:
        tail = "".join(p for p, _ in self.pieces[-2:]) + more
        del self.pieces[-2:]
        self.pieces += [(p, self.codec.encode_piece(p.encode())) for p in self.codec.split.findall(tail)]

    def edit(self, start: int, stop: int, by: str) -> int:
        """Replaces characters ``start`` to ``stop``; returns how many pieces were encoded anew."""
        ends = list(accumulate((len(p) for p, _ in self.pieces), initial=0))
        if not 0 <= start <= stop <= ends[-1]:
            raise ValueError("no such characters")
        first = max(0, bisect_right(ends, start) - 3)
        at, shift = ends[first], len(by) - (stop - start)
        tail = "".join(p for p, _ in self.pieces[first:])
        tail = tail[: start - at] + by + tail[stop - at :]
        number, fresh, rest = {end: k for k, end in enumerate(ends)}, [], []
        for m in self.codec.split.finditer(tail):
            now = at + m.start()
            if now >= start + len(by) and (k := number.get(now - shift)) is not None:
                rest = self.pieces[k:]
                break
            fresh.append((m[0], self.codec.encode_piece(m[0].encode())))
        self.pieces[first:] = fresh + rest
        return len(fresh)

    @property
    def ids(self) -> list[int]:
        return [k for _, ids in self.pieces for k in ids]


@lru_cache(2)
def codec(path: str) -> Codec:
    """The codec of a rank file, built once for each worker."""
    return Codec(read_ranks(path))


def encoded(text: Column, path: str) -> Column:
    """The ids of a text column, as array<int>."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([codec(path).encode(x) for x in texts], dtype=object)

    return ids(text)


def decoded(ids: Column, path: str) -> Column:
    """The bytes of an id column; null ids give null."""

    @F.pandas_udf("binary")
    def data(rows: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else codec(path).decode(list(x)) for x in rows], dtype=object)

    return data(ids)


def _digests(path: str):
    """Ids to (n_tokens, ids_sha256, decoded_sha256)."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(rows: pd.Series) -> pd.DataFrame:
        out = []
        for ids in rows:
            out.append((len(ids), hashlib.sha256(" ".join(map(codec(path).numerals.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(codec(path).decode(ids)).hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``documents``; null texts count as empty.

    The ids go from the encoding function to the digesting one within the
    worker. No shuffle.
    """
    path = public_tokenizers.path(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", _digests(path)(encoded(F.col("text"), path)).alias("d"))
    return docs.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
