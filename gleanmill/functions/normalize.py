"""Content normalisation: compression, charsets, headers and wrapped pages."""

from __future__ import annotations

import html as html_lib
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dates import date_text
from .text import strip_tags


@F.pandas_udf(T.BinaryType())
def _inflate(rows: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> bytes | None:
        try:
            return None if b is None else zlib.decompress(b, 31)
        except zlib.error:
            return None

    return rows.map(one)


@F.pandas_udf(T.BinaryType())
def gzip_bytes(rows: pd.Series) -> pd.Series:
    """gzip of binary values; null stays null."""

    def one(b: bytes | None) -> bytes | None:
        if b is None:
            return None
        packer = zlib.compressobj(wbits=31)
        return packer.compress(b) + packer.flush()

    return rows.map(one)


def gunzip(body: Column, encoding: Column) -> Column:
    """``body`` inflated if its Content-Encoding says gzip; null if that fails. Other bodies never reach Python's inflater."""
    return F.when(F.coalesce(F.instr(encoding, "gzip"), F.lit(0)) > 0, _inflate(F.when(F.instr(encoding, "gzip") > 0, body))).otherwise(body)


def declared_charset(page: Column) -> Column:
    """gbk or gb2312 if the page says so, quoted or not and in any case; else utf-8."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(page, r"(?i)charset=[\"']?(gbk|gb2312)", 1), F.lit("")), F.lit("utf-8")))


@F.pandas_udf(T.StringType())
def _decode(body: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else bytes(b).decode(c, "ignore") for b, c in zip(body, charset, strict=True)], dtype=object)


def decode_body(body: Column) -> Column:
    """A page's bytes as text, by the charset it declares; bytes that don't fit are dropped."""
    return _decode(body, declared_charset(F.decode(body, "ISO-8859-1")))


def encode_body(page: Column, charset: str) -> Column:
    """A page's text as bytes in ``charset``; characters that it lacks are dropped."""

    @F.pandas_udf(T.BinaryType())
    def encoded(rows: pd.Series) -> pd.Series:
        return rows.map(lambda s: None if s is None else s.encode(charset, "ignore"))

    return encoded(page)


@F.pandas_udf(T.StringType())
def unescape(rows: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    return rows.map(lambda s: None if s is None else html_lib.unescape(s))


def wrap_page(body: Column) -> Column:
    """A fragment as a whole page."""
    return F.concat(F.lit('<html><head><meta http-equiv="Content-Type" content="text/html; charset=utf-8" /></head><body>'), body, F.lit("</body></html>"))


def rewrite_charset(page: Column) -> Column:
    """A short ``<meta charset>`` within the first 500 characters in its long form; only for bytes that leave the engine, as its strings are UTF-8."""
    head = F.regexp_replace(F.substring(page, 1, 500), r'(?i)<\s*meta\s+charset="?([^"\s>/]+)"?\s*/?>', r'<meta http-equiv="Content-Type" content="text/html; charset=$1"/>')
    return F.concat(head, F.substring(page, F.lit(501), F.length(page)))


def header_value(block: Column, name: str) -> Column:
    """The value of a ``name: value`` line in a CRLF block; null if there is none. Values may hold colons."""
    return F.nullif(F.btrim(F.regexp_extract(block, rf"(?im)^\Q{name}\E[ \t]*:([^\r\n]*)", 1)), F.lit(""))


def header_map(block: Column) -> Column:
    """All lines of a CRLF header block with a colon, as a map; of a repeated name the last."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(lines, lambda x: F.struct(F.btrim(F.substring_index(x, ":", 1)).alias("k"), F.btrim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def unwrap_search_json(page: Column) -> Column:
    r"""The result page within a stream of JSON chunks parted by ``/*""*/``; null if it isn't one.

    Past the first two chunks, the last that holds an escaped ``"i":"search"``
    has in its ``d`` scripts, of which the longest holds an object with the
    page in ``h``.
    """
    chunks = F.split(page, r"\Q/*" + '""' + r"*/\E", -1)
    fit = F.filter(F.slice(chunks, 3, F.greatest(F.size(chunks), F.lit(1))), lambda c: F.instr(c, r'\"i\":\"search\"') > 0)
    scripts = F.split(F.get_json_object(F.try_element_at(fit, F.lit(-1)), "$.d"), "<script>", -1)
    longest = F.array_max(F.transform(scripts, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s"))))["s"]
    return F.when((F.size(chunks) >= 2) & (F.size(scripts) >= 2), F.get_json_object(F.regexp_extract(longest, r"(?s)(\{.*\})", 1), "$.h"))


def unwrap_pagelet(page: Column) -> Column:
    """The html of a result pagelet that a script hands to the page's viewer; null if there is none."""
    call = r'(?s)<script>STK && STK\.pageletM && STK\.pageletM\.view\((\{"pid":"pl_weibo_direct".*?)\)</script>'
    return F.get_json_object(F.nullif(F.regexp_extract(page, call, 1), F.lit("")), "$.html")


def parse_feed(xml: Column) -> Column:
    """The results of an XML feed: array of (title, link, source, channel, date); empty if it has none or is no XML.

    Titles lose their tags; dates in digits and 年月日时分秒 or in ``-`` and ``:``
    become ``yyyy-MM-dd HH:mm``, empty if they are none; results with a link
    shorter than 4 are left out; a missing channel is null.
    """
    kind = "RESULT ARRAY<STRUCT<TITLE:STRING,PUBLISHTIME:STRING,SOURCE:STRING,CHANNEL:STRING,DOCURL:STRING>>"
    rows = F.coalesce(F.from_xml(xml, kind, {"mode": "PERMISSIVE"})["RESULT"], F.array().cast(kind.removeprefix("RESULT ")))
    plain = lambda s: F.btrim(F.regexp_replace(F.translate(s, "年月日时分秒", "--\u0001::\u0001"), "\u0001", " "))
    ts = lambda s: F.try_to_timestamp(F.regexp_replace(F.regexp_replace(plain(s), r"\s+", " "), r"^(\d+-\d+-\d+ \d+:\d+)$", "$1:0"), F.lit("y-M-d H:m:s"))
    fit = F.filter(rows, lambda r: F.coalesce(F.length(r["DOCURL"]), F.lit(0)) >= 4)
    return F.transform(
        fit,
        lambda r: F.struct(
            strip_tags(F.coalesce(r["TITLE"], F.lit(""))).alias("title"), F.btrim(r["DOCURL"]).alias("link"), F.coalesce(r["SOURCE"], F.lit("")).alias("source"),
            r["CHANNEL"].alias("channel"), date_text(ts(r["PUBLISHTIME"])).alias("date"),
        ),
    )
