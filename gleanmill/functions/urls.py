"""URL functions: encoding, hosts, links and query parameters, as column expressions."""

from __future__ import annotations

import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_number, strip


def form_encode(s: Column) -> Column:
    """Form encoding of a value in UTF-8; ``*`` is encoded too."""
    return F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A"))


def encode_keyword(keyword: Column, site: Column | None = None, charset: str = "utf-8") -> Column:
    """A keyword, after the site to search in if there is one, form-encoded in ``charset``.

    UTF-8 stays in the JVM; other charsets take an Arrow function. Characters
    that the charset lacks are dropped.
    """
    whole = keyword if site is None else F.concat_ws(" ", F.nullif(site, F.lit("")), keyword)
    if charset.lower().replace("-", "") == "utf8":
        return form_encode(whole)

    @F.pandas_udf("string")
    def quoted(rows: pd.Series) -> pd.Series:
        return rows.map(lambda s: None if s is None else urllib.parse.quote_plus(s.encode(charset, "ignore"), safe="").replace("~", "%7E"))

    return quoted(whole)


def charset_name(encode_type: Column) -> Column:
    """A charset setting as one name for each charset; none counts as utf-8."""
    name = F.regexp_replace(F.lower(F.coalesce(encode_type, F.lit(""))), "[-_ ]", "")
    return F.when(name.isin("", "utf8"), "utf-8").otherwise(name)


def encode_as(words: Column, charset: Column) -> Column:
    """``words`` form-encoded in the charset of a column of ``charset_name``; characters that it lacks are dropped, null for an unknown charset. UTF-8 stays in the JVM."""

    @F.pandas_udf("string")
    def quoted(rows: pd.Series, charsets: pd.Series) -> pd.Series:
        out = []
        for s, c in zip(rows, charsets, strict=True):
            try:
                out.append(None if s is None else urllib.parse.quote_plus(s.encode(c, "ignore"), safe="").replace("~", "%7E"))
            except LookupError:
                out.append(None)
        return pd.Series(out, dtype=object)

    other = charset != "utf-8"
    return F.when(other, quoted(F.when(other, words), charset)).otherwise(form_encode(words))


def decode_keyword(s: Column) -> Column:
    """The inverse of form encoding; null where the escapes are no UTF-8."""
    return F.try_url_decode(s)


def authority(url: Column) -> Column:
    """Host with port and user, as it stands between ``//`` and the next ``/`` or ``?``; null without a scheme."""
    return F.nullif(F.regexp_extract(url, r"^[^:/]+://([^/?]*)", 1), F.lit(""))


def before_query(url: Column) -> Column:
    """``url`` up to its last ``?``; the whole of it if there is none."""
    return F.regexp_replace(url, r"\?[^?]*\z", "")


def query_of(url: Column) -> Column:
    """What follows the last ``?``; null if there is none."""
    return F.when(F.instr(url, "?") > 0, F.substring_index(url, "?", -1))


def normalise_link(link: Column, page: Column) -> Column:
    """A link of ``page`` as an absolute one.

    ``/x`` takes the page's scheme and authority (``//h/x`` too), ``?q`` the
    page without its query, anything but ``http...`` is put after the page as a
    query. Dot segments stay as they are.
    """
    own = strip(link)
    root = F.concat(F.regexp_extract(page, r"^([^:/]+)://", 1), F.lit("://"), F.coalesce(authority(page), F.lit("")))
    return (
        F.when(own.startswith("/"), F.concat(root, own))
        .when(own.startswith("?"), F.concat(before_query(page), own))
        .when(~own.startswith("http"), F.concat(before_query(page), F.lit("?"), F.substring_index(own, "?", -1)))
        .otherwise(own)
    )


def rooted(link: Column) -> Column:
    """A bare relative link with ``/`` put before it."""
    return F.when(link.startswith("http") | link.startswith("?") | link.startswith("/"), link).otherwise(F.concat(F.lit("/"), link))


def query_params(url: Column) -> Column:
    """The query's parameters, sorted: array of (key, number, value).

    A part ``k=v=w`` has the value ``v``. Numbers order as numbers, before
    other values of their key.
    """
    parts = F.filter(F.split(query_of(url), "&"), lambda p: p != "")
    split = F.transform(
        parts,
        lambda p: F.struct(
            F.element_at(F.split(p, "="), 1).alias("key"),
            F.when(is_number(F.try_element_at(F.split(p, "="), F.lit(2))), F.try_element_at(F.split(p, "="), F.lit(2)).try_cast("bigint")).alias("number"),
            F.coalesce(F.try_element_at(F.split(p, "="), F.lit(2)), F.lit("")).alias("value"),
        ),
    )
    order = F.transform(split, lambda p: F.struct(p["key"].alias("key"), F.coalesce(p["number"], F.lit((1 << 63) - 1)).alias("order"), p["value"].alias("value"), p["number"].alias("number")))
    return F.transform(F.array_sort(order), lambda p: F.struct(p["key"].alias("key"), p["number"].alias("number"), p["value"].alias("value")))
