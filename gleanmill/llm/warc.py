"""Operator 5, WARC: a writer of gzip-member archives and a reader that salvages damaged ones.

The writer gives each task its own archives: a ``warcinfo`` record, then one
record for each row, every record a gzip member of its own. An archive's name
holds the attempt of its task and it is renamed when whole, so a lost or
repeated task leaves nothing half written under a final name, and no attempt
overwrites another's: only those archives count that the attempt which
succeeded returned. A payload that another record has already is written as a
``revisit``.

The reader walks an archive member by member (or, uncompressed, record by
record) and streams each record through its checks, so that a record of any
length takes bounded memory. Where a check fails (inflating, gzip checksum,
version line, headers, length, closing lines, digests) it looks for the next
place at which a valid record starts, goes on there, and logs the bytes between
as quarantined. Members may hold several records; one is returned when the next
one begins or the member's checksum agrees.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, join_groups, remove, shared_dir, table

#: Compressed bytes after which a task begins its next archive.
ARCHIVE_BYTES = 64 << 20
#: Bytes of a record's headers beyond which the reader takes it for damaged: they are held in memory.
HEAD_BYTES = 16 << 20
#: Bytes of a payload beyond which it isn't returned, only its length and digest: a Spark value ends at 2 GiB.
VALUE_BYTES = 1 << 30
#: A payload of fewer bytes is always written in full.
LEAST_REVISIT = 0
BLOCK = 1 << 18
#: Most tasks over which archives are dealt to be read.
MOST_TASKS = 50_000
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_DATE = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")  # fixed, so that a repeated task writes the same bytes


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None) -> str:
    return f"<urn:record:{'null' if key is None else key}>"


def _key(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:record:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: version line, headers, block, closing lines. Header values lose their line breaks."""
    lines = [f"{k}: {' '.join(v.split())}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def page_record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the record of ``refers_to``.

    A revisit's block ends after the HTTP headers, which tell the full payload's length.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(key)),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", url or "urn:none"),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    return record_bytes(headers, http + payload if refers_to is None else http)


def member(data: bytes) -> bytes:
    """``data`` as one gzip member without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _info(name: str) -> bytes:
    return record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields")], b"software: gleanmill\r\nformat: WARC File Format 1.1\r\n")


def first_copies(df: DataFrame, key: str, payload: str, least: int = LEAST_REVISIT) -> DataFrame:
    """_key, _digest, _refers_to: for each row of which a row with a smaller key has the payload too, the smallest such key.

    Only keys and digests are shuffled. A hot payload is one row of each task
    before its key is found, and its rows are joined with that one row where
    they are.
    """
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    slim = df.where(F.length(data) >= least).select(F.col(key).cast("long").alias("_key"), F.sha1(data).alias("_digest"))
    first = checkpointed(slim.groupBy("_digest").agg(F.min("_key").alias("_refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    return join_groups(slim, first, "_digest", "_n").where(F.col("_key") > F.col("_refers_to")).select("_key", "_digest", "_refers_to").distinct()


def write_archives(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row into archives below ``folder``; returns path, records, bytes of each archive.

    ``payload`` is text; null is an empty one. A null key is written as such
    and never is or has a revisit; of rows with equal key and payload none
    revisits another. ``folder`` is a URI that pyarrow can open on executors.
    """
    rows = df.select(F.col(key).cast("long").alias("_key"), F.col(url).cast("string").alias("_url"), F.coalesce(F.col(payload), F.lit("")).alias("_payload"))
    rows = rows.withColumn("_digest", F.sha1(F.col("_payload").cast("binary"))).join(first_copies(df, key, payload, least), ["_key", "_digest"], "left").select("_key", "_url", "_payload", "_refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, number, name, temporary, records, size = None, 0, "", "", 0, 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            out.close()
            store.move(temporary, f"{root}/{name}")
            done.append((f"{folder}/{name}", records, size))

        for batch in batches:
            for at in range(batch.num_rows):
                page, address, text, refers_to = (c[at].as_py() for c in batch.columns)
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    temporary = f"{root}/_{name}"
                    out, records, size, number = store.open_output_stream(temporary, compression=None), 0, 0, number + 1
                    size += out.write(member(_info(name)))
                size += out.write(member(page_record(page, address, text.encode(errors="replace"), refers_to)))
                records += 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return checkpointed(rows.mapInArrow(write, "path string, records long, bytes long"))


class Damaged(Exception):
    """A check that a record fails."""


@dataclass
class Record:
    """A valid record: where it (or its gzip member) lies, its headers, those of its HTTP block, and what its payload comes to."""

    start: int
    stop: int
    headers: dict[str, str]
    http: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def _fields(lines: list[bytes], strict: bool) -> dict[str, str]:
    """Header fields, folded lines joined. Other lines are damage if ``strict``, else passed over."""
    out, name = {}, ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            out[name] = f"{out[name]} {line.decode('utf-8', 'replace').strip()}".strip()
            continue
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        name = name.strip().lower()
        if colon:
            out[name] = value.strip()
        elif strict:
            raise Damaged("header without a colon")
        else:
            name = ""
    return out


def _digest(told: str | None) -> str | None:
    """A digest header as bare upper-case base32 SHA-1, from base32 or hex; None if it is none."""
    kind, _, value = (told or "").strip().rpartition(":")
    if kind.lower() not in ("", "sha1", "sha-1"):
        return None
    if re.fullmatch(r"[0-9A-Fa-f]{40}", value):
        return base64.b32encode(bytes.fromhex(value)).decode()
    return value.upper() if re.fullmatch(r"[A-Za-z2-7]{32}", value) else None


class Source:
    """Random reads of an open file, of any size, by blocks."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()

    def read(self, at: int, n: int) -> bytes:
        if at >= self.size:
            return b""
        self.file.seek(at)
        return self.file.read(min(n, self.size - at))

    def find(self, mark: bytes, at: int) -> int:
        """The first place of ``mark`` from ``at`` on, or the archive's end."""
        while at < self.size:
            data = self.read(at, BLOCK)
            if (k := data.find(mark)) >= 0:
                return at + k
            at += max(1, len(data) - len(mark) + 1)
        return self.size


class Feed:
    """The bytes of one gzip member, or of an archive from a place on, as they come."""

    def __init__(self, source: Source, at: int, packed: bool):
        self.source, self.at, self.start, self.held = source, at, at, b""
        self.unpacker = zlib.decompressobj(31) if packed else None
        self.fed, self.broken = False, ""

    @property
    def place(self) -> int:
        """Where the next byte lies; within a member, how much of it has been read."""
        return self.at if self.unpacker else self.at - len(self.held)

    def _more(self) -> bytes:
        """Further bytes; none at the end of the archive, or of a member whose checksum agrees."""
        if self.unpacker is None:
            data = self.source.read(self.at, BLOCK)
            self.at += len(data)
            return data
        while not self.unpacker.eof:
            if self.broken:
                raise Damaged(self.broken)
            raw = self.unpacker.unconsumed_tail
            if not raw:
                raw = self.source.read(self.at, BLOCK)
                self.at += len(raw)
            if not raw:
                raise Damaged("member ends early")
            before = self.unpacker.copy() if self.fed else None
            try:
                out = self.unpacker.decompress(raw, BLOCK * 4)
            except zlib.error as e:
                self.broken = f"inflating failed: {e}"
                out = self._until_broken(before or zlib.decompressobj(31), raw)
            self.fed = True
            if self.unpacker.eof:
                self.at -= len(self.unpacker.unused_data)
            if out:
                return out
        return b""

    @staticmethod
    def _until_broken(unpacker, raw: bytes) -> bytes:
        """What ``raw`` inflates to before the error in it."""
        out = []
        try:
            for k in range(len(raw)):
                out.append(unpacker.decompress(raw[k : k + 1]))
        except zlib.error:
            pass
        return b"".join(out)

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and (more := self._more()):
            self.held += more
        return self.held[:n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.held = self.held[n:]
        return out

    def head(self) -> bytes:
        """What comes before the next blank line, which is passed over."""
        seen = 0
        while (k := self.held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.held)
            if seen > HEAD_BYTES or not (more := self._more()):
                raise Damaged("headers don't end")
            self.held += more
        return self.take(k + 4)[:-4]

    def body(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, in pieces."""
        while n:
            if not (piece := self.take(min(n, len(self.held) or 1))):
                raise Damaged("record ends early")
            n -= len(piece)
            yield piece


class _Payload:
    """Length, digest and, if wanted, bytes of what is put in."""

    def __init__(self, wanted: bool):
        self.size, self.sha, self.parts = 0, hashlib.sha1(), [] if wanted else None

    def add(self, data: bytes) -> None:
        self.size += len(data)
        self.sha.update(data)
        if self.parts is not None:
            self.parts.append(data)
            if self.size > VALUE_BYTES:
                self.parts = None


def _read_record(feed: Feed, payloads: bool) -> Record:
    """The record that begins here; a request's block, and what isn't HTTP, is all payload."""
    if feed.peek(len(VERSION)) != VERSION:
        raise Damaged("no version line")
    lines = feed.head().split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[0-9]+", lines[0]):
        raise Damaged("no version line")
    headers = _fields(lines[1:], strict=True)
    if not re.fullmatch(r"[0-9]{1,18}", headers.get("content-length", "")):
        raise Damaged("no content length")
    length, kind = int(headers["content-length"]), headers.get("warc-type")
    if not kind:
        raise Damaged("no record type")
    if feed.unpacker is None and feed.place + length + 4 > feed.source.size:
        raise Damaged("record ends early")
    whole, told = _digest(headers.get("warc-block-digest")), _digest(headers.get("warc-payload-digest"))
    block, payload, http, early = hashlib.sha1(), _Payload(payloads and kind != "revisit"), {}, b""
    in_head = kind in ("response", "revisit") and headers.get("content-type", "").lower().startswith("application/http")
    for piece in feed.body(length):
        if whole:
            block.update(piece)
        if not in_head:
            payload.add(piece)
            continue
        seen, early = len(early), early + piece
        if (k := early.find(b"\r\n\r\n", max(0, seen - 3))) >= 0:
            http, in_head = _fields(early[:k].split(b"\r\n")[1:], strict=False), False
            payload.add(early[k + 4 :])
        elif len(early) > HEAD_BYTES:
            in_head = False
            payload.add(early)
    if in_head and (kind == "revisit" or early.startswith(b"HTTP/")):  # nothing but headers
        http = _fields(early.split(b"\r\n")[1:], strict=False)
    elif in_head:
        payload.add(early)
    if feed.take(4) != b"\r\n\r\n":
        raise Damaged("length differs")
    found = base64.b32encode(payload.sha.digest()).decode()
    if whole and base64.b32encode(block.digest()).decode() != whole:
        raise Damaged("block digest differs")
    # Some writers take the digest of a payload whose transfer coding they have undone.
    if kind in ("response", "resource") and told and found != told and not whole and "transfer-encoding" not in http:
        raise Damaged("payload digest differs")
    size = payload.size
    if kind == "revisit":
        size, found = int(m[0]) if (m := re.fullmatch(r"[0-9]{1,18}", http.get("content-length", ""))) else 0, told or ""
    return Record(feed.start, 0, headers, http, size, found, b"".join(payload.parts) if payload.parts is not None else None)


def _records(feed: Feed, payloads: bool) -> Iterator[Record]:
    """The records of a member, or uncompressed ones up to the next member."""
    while True:
        if feed.unpacker is None:
            feed.start = feed.place
        record = _read_record(feed, payloads)
        after = feed.peek(len(MAGIC))  # for a member's last record this checks the member
        record.stop = feed.place
        yield record
        if not after or feed.unpacker is None and after == MAGIC:
            return


def read_archive(source: Source, payloads: bool = False) -> Iterator[Record | tuple[int, int, str]]:
    """Records in order, and (start, stop, reason) of every stretch of bytes with no valid record.

    A damaged member of several records is such a stretch, from its start,
    though those before the damage are returned.
    """
    at, gap, marks = 0, None, {MAGIC: -1, VERSION: -1}
    while at < source.size:
        feed = Feed(source, at, source.read(at, len(MAGIC)) == MAGIC)
        try:
            for record in _records(feed, payloads):
                if gap:
                    yield gap[0], record.start, gap[1]
                    gap = None
                yield record
            at = feed.place
        except Damaged as e:
            gap = gap or (feed.start, str(e))
            for mark, place in marks.items():
                if place <= feed.start:
                    marks[mark] = source.find(mark, feed.start + 1)
            at = min(marks.values())
    if gap:
        yield gap[0], source.size, gap[1]


SCHEMA = "path string, start long, stop long, damage string, record_type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"


def read_archives(paths: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of the archives in ``paths.path``, and their quarantined gaps (rows with ``damage``).

    Archives are dealt over as many tasks as there are of them (``MOST_TASKS``
    at most); each is read as a stream. ``payload_bytes`` and
    ``payload_digest`` are those of the full payload, for revisits as their
    headers tell. ``warcinfo`` records are passed over. ``page_id`` and
    ``refers_to`` are null unless the record's names are this writer's.
    """
    kinds = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("damage", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = pafs.FileSystem.from_uri(path)
                with store.open_input_file(place) as file:
                    for x in read_archive(Source(file), payloads):
                        if isinstance(x, tuple):
                            rows.append((path, *x, *[None] * 7))
                        elif (kind := x.headers["warc-type"]) != "warcinfo":
                            rows.append((path, x.start, x.stop, None, kind, _key(x.headers.get("warc-record-id")), _key(x.headers.get("warc-refers-to")), x.headers.get("warc-target-uri"), x.payload_bytes, x.payload_digest, x.payload))
                            held += len(x.payload or b"") + 200
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
        if rows:
            yield batch_of(rows)

    tasks = min(MOST_TASKS, max(1, paths.count()))
    return paths.select("path").repartition(tasks, "path").mapInArrow(read, SCHEMA)


def op5_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of ``pages``, from archives written and read back.

    A quarantined stretch in an archive just written is an error. The archives
    go when the result has been checkpointed.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    found = read_archives(write_archives(pages, folder))
    whole = F.when(F.col("damage").isNull(), F.col("page_id")).otherwise(F.raise_error(F.concat_ws(" ", "path", "start", "damage")).cast("long"))
    result = checkpointed(found.select(whole.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove(spark, folder)
    return result


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h)) AS first_id FROM p
),
q AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(x, CAST(1 + 5 * i AS INTEGER), 5) AS INTEGER)) AS parts FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((v >> s) & 31) AS INTEGER), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM q
"""
