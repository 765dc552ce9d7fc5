"""Scalar string functions, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The only characters that stripping takes off; wider Unicode spaces stay.
BLANKS = " \t\r\n"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once, however often it is used there."""
    return F.element_at(F.transform(F.array(value), lambda v: then(v)), 1)


def strip(s: Column, compat: bool = False) -> Column:
    """``s`` without blanks at its ends; null stays null. With ``compat`` a result of one byte becomes empty."""
    out = F.btrim(s, F.lit(BLANKS))
    return F.when(F.octet_length(out) <= 1, F.lit("")).otherwise(out) if compat else out


def split_strip(s: Column, sep: str) -> Column:
    """The stripped, non-empty parts of ``s`` between literal separators."""
    return F.filter(F.transform(F.split(s, r"\Q" + sep + r"\E", -1), lambda x: strip(x)), lambda x: x != "")


def drop_breaks(s: Column) -> Column:
    """``s`` without tabs and line breaks; null becomes empty."""
    return F.translate(F.coalesce(s, F.lit("")), "\t\r\n", "")


def squeeze(s: Column) -> Column:
    """``s`` without spaces and line breaks, as summaries are stored."""
    return F.translate(s, " \r\n", "")


def strip_tags(s: Column) -> Column:
    """``s`` without anything between angle brackets."""
    return F.regexp_replace(s, r"<[\s\S]*?>", "")


def is_number(s: Column) -> Column:
    """Whether ``s`` is one or more ASCII digits; null gives false."""
    return F.coalesce(s.rlike(r"^[0-9]+\z"), F.lit(False))


def clean_summary(s: Column) -> Column:
    """A summary up to its last ``...`` if that lies in its second half; stripped, line feeds as spaces."""
    last = F.length(s) - F.length(F.substring_index(s, "...", -1)) - 3
    cut = F.when((F.instr(s, "...") > 0) & (last > 0.5 * F.length(s)), F.substring(s, F.lit(1), last.cast("int"))).otherwise(s)
    return F.replace(strip(cut), F.lit("\n"), F.lit(" "))


def edit_distance_semi(a: Column, b: Column) -> Column:
    """Edit distance in which a prefix of the shorter string may be skipped for free.

    The least Levenshtein distance between the longer string and any suffix of
    the shorter one; with an empty string, the other's length.
    """
    swap = F.length(a) > F.length(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    each = F.transform(F.sequence(F.lit(0), F.length(short)), lambda k: F.levenshtein(F.substring(short, k + 1, F.length(short)), long))
    return F.when(F.length(short) == 0, F.length(long)).otherwise(F.array_min(each))
