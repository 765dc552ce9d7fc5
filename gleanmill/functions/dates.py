r"""Fuzzy dates in text, as column expressions.

``first_date`` tries, in this order, an absolute date, a time ago, a Unix time
and an English month, and gives (accuracy, ts, beg, end): how many fields were
found, the time, and where. All of it is relative to an explicit ``as_of``;
nothing after that is a result. Fields a text leaves open come from ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Separators and words of the accepted formats.
_DATE = r"(?:(\d{2,4})[ \-/年]|(?! \d{2}[\-/] ?\d{1,2}[\-/] ?\d)) ?(\d{1,2})[ \-/月] ?(\d{1,2})[ \-/日号]?"
_TIME = r"([0-9]{1,2})[:时点] ?(?:([0-9]{1,2})(?: ?(?::|分钟|分) ?([0-9]{1,2})(?:秒钟|秒)?)?)?"
#: Units of a time ago, each with its seconds, what it adds to the accuracy, and its words (``minutes`` must follow a space). A year has 365 days.
UNITS = (
    (365 * 86_400, 10, ("年", "years")),
    (86_400, 0, ("天", "日", "days", "day")),
    (3_600, 10, ("小时", "时", "hours")),
    (60, 20, ("分钟", "分", "minutes")),
    (1, 30, ("秒钟", "秒", "seconds")),
)
AGO, YESTERDAY = ("之前", "前", "ago"), "昨天"
_WORDS = "|".join(rf"(?<=\s){w}" if w == "minutes" else w for _, _, words in UNITS for w in words)
_RELATIVE = rf"(?i)(\d{{1,2}}) ?({_WORDS}) *(?:{'|'.join(AGO)})|{YESTERDAY} ?(\d{{1,2}}):(\d{{1,2}})"
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_ENGLISH = "(" + "|".join(_MONTHS) + r").*?(\d{1,2})(?!\d)(?:\D+(\d{4}|\d{2})(?!\d))?"
#: Characters that may stand around a date where a separator is asked for.
_SEPARATORS = r"[ ,\t\r\n\-—;；，:：]"
#: Texts of this many bytes or more are searched in windows of as many characters at both ends.
WINDOW = 100

RESULT = "struct<accuracy:int,ts:timestamp,beg:int,end:int>"


def _result(accuracy: Column, ts: Column, beg: Column, end: Column) -> Column:
    return F.struct(accuracy.cast("int").alias("accuracy"), ts.alias("ts"), beg.cast("int").alias("beg"), end.cast("int").alias("end"))


def _number(s: Column) -> Column:
    return s.try_cast("int")


def cleaned(text: Column) -> Column:
    """Without line breaks; slashes of what looks like a URL become ``*``."""
    flat = F.translate(text, "\r\n", "")
    slashes = F.length(flat) - F.length(F.replace(flat, F.lit("/"), F.lit("")))
    address = ((F.instr(flat, ".cn/") > 1) | (F.instr(flat, ".com/") > 1)) & (slashes > 2)
    return F.when(address, F.replace(flat, F.lit("/"), F.lit("*"))).otherwise(flat)


def absolute_date(text: Column, as_of: Column) -> Column:
    """A date, a time or both; two fields at least, 10 for each. ``昨天`` without a year is a day earlier, 30 more."""
    take = lambda s, p, k: _number(F.nullif(F.regexp_extract(s, p, k), F.lit("")))

    def date(head: Column) -> Column:
        """``head``: the text up to the end of its first date, empty without one."""
        whole = F.length(head)
        return F.struct(
            take(head, _DATE, 1).alias("year"), take(head, _DATE, 2).alias("month"), take(head, _DATE, 3).alias("day"), whole.alias("end"),
            F.length(F.regexp_extract(head, "^(.*?)" + _DATE, 1)).alias("beg"), F.substring(text, whole + 1, F.length(text)).alias("rest"),
        )

    def time(d: Column) -> Column:
        return let(
            F.regexp_extract(d["rest"], "^.*?" + _TIME, 0),
            lambda head: F.struct(
                take(head, _TIME, 1).alias("hour"), take(head, _TIME, 2).alias("minute"), take(head, _TIME, 3).alias("second"),
                F.length(head).alias("end"), F.length(F.regexp_extract(head, "^(.*?)" + _TIME, 1)).alias("beg"),
            ),
        )

    def result(d: Column, t: Column) -> Column:
        year = F.when(d["year"] < 70, d["year"] + 2000).when(d["year"] < 100, d["year"] + 1900).otherwise(d["year"])
        fields = sum((x.isNotNull().cast("int") for x in (d["year"], d["month"], d["day"], t["hour"], t["minute"], t["second"])), F.lit(0))
        ts = F.try_make_timestamp(
            F.coalesce(year, F.year(as_of)), F.coalesce(d["month"], F.month(as_of)), F.coalesce(d["day"], F.day(as_of)),
            F.coalesce(t["hour"], F.greatest(F.hour(as_of) - 2, F.lit(0))), F.coalesce(t["minute"], F.minute(as_of)), F.coalesce(t["second"], F.second(as_of)).cast("decimal(8,6)"),
        )
        yesterday = (F.instr(text, YESTERDAY) > 0) & d["year"].isNull()
        moved = F.when(yesterday, ts - F.expr("INTERVAL 1 DAY")).otherwise(ts)
        beg = F.when(d["end"] > 0, d["beg"]).otherwise(t["beg"])
        end = F.when(t["end"] > 0, d["end"] + t["end"]).otherwise(d["end"])
        return let(moved, lambda at: F.when((fields >= 2) & (at <= as_of), _result(fields * 10 + F.when(yesterday, 30).otherwise(0), at, beg, end)))

    return let(let(F.regexp_extract(text, "^.*?" + _DATE, 0), date), lambda d: let(time(d), lambda t: result(d, t)))


def relative_date(text: Column, as_of: Column) -> Column:
    """Years, days, hours, minutes or seconds ago, or yesterday at a time."""

    def result(head: Column) -> Column:
        """``head``: the text up to the end of its first such phrase."""
        found = F.regexp_extract(head, "(?:" + _RELATIVE + r")\z", 0)
        count, word, at_hour, at_minute = (F.nullif(F.regexp_extract(found, _RELATIVE, k), F.lit("")) for k in range(1, 5))
        of_word = lambda k: F.try_element_at(F.create_map(*[F.lit(x) for unit in UNITS for w in unit[2] for x in (w, unit[k])]), F.lower(word))
        ago = _number(count) * of_word(0)
        day = F.date_sub(F.to_date(as_of), 1)
        at = F.try_make_timestamp(F.year(day), F.month(day), F.day(day), _number(at_hour), _number(at_minute), F.lit(0).cast("decimal(8,6)"))
        more = F.coalesce(of_word(1), F.lit(20))
        end = F.length(head)
        return let(F.coalesce(F.timestamp_seconds(F.unix_timestamp(as_of) - ago), at), lambda ts: F.when(ts <= as_of, _result(30 + more, ts, end - F.length(found), end)))

    return F.when(text.rlike(_RELATIVE), let(F.regexp_extract(text, "^.*?(?:" + _RELATIVE + ")", 0), result))


def epoch_date(text: Column, as_of: Column) -> Column:
    """Ten digits beginning with 1 or 2, at the start of the text or right after digits there."""
    pattern = r"^(\d*?)([12]\d{9})"
    digits = F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")).try_cast("bigint")
    beg = F.length(F.regexp_extract(text, pattern, 1))
    ts = F.timestamp_seconds(digits)
    return F.when(ts <= as_of, _result(F.lit(10), ts, beg, beg + 10))


def month_date(text: Column, as_of: Column) -> Column:
    """An English month's short name, a day, perhaps a year; a month later than now's without a year is last year's."""
    name = F.regexp_extract(text, _ENGLISH, 1)
    month = F.nullif(F.array_position(F.array(*map(F.lit, _MONTHS)), name).cast("int"), F.lit(0))
    day, year = (_number(F.nullif(F.regexp_extract(text, _ENGLISH, k), F.lit(""))) for k in (2, 3))
    full = F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)
    last = F.year(as_of) - F.when(month > F.month(as_of), 1).otherwise(0)
    ts = F.try_make_timestamp(F.coalesce(full, last), month, day, F.hour(as_of), F.minute(as_of), F.second(as_of).cast("decimal(8,6)"))
    beg = F.length(F.regexp_extract(text, "^(.*?)" + _ENGLISH, 1))
    return F.when(ts <= as_of, _result(F.when(year.isNull(), 20).otherwise(30), ts, beg, beg + F.length(F.regexp_extract(text, _ENGLISH, 0))))


def _nothing(text: Column) -> Column:
    return _result(F.lit(0), F.lit(None).cast("timestamp"), F.lit(0), F.length(text))


def first_date(text: Column, as_of: Column) -> Column:
    """The first kind of date that the whole text has; accuracy 0 and a null time if none. Null text counts as empty."""
    kinds = lambda t: F.coalesce(absolute_date(t, as_of), relative_date(t, as_of), epoch_date(t, as_of), month_date(t, as_of), _nothing(t))
    return let(cleaned(F.coalesce(text, F.lit(""))), kinds)


def separated(text: Column, found: Column) -> Column:
    """``found`` if a separator or the text's end is on both its sides, else no date."""
    before, after = F.substring(text, found["beg"], F.lit(1)), F.substring(text, found["end"] + 1, F.lit(1))
    fine = ((found["beg"] == 0) | before.rlike(_SEPARATORS)) & ((found["end"] >= F.length(text)) | after.rlike(_SEPARATORS) | F.substring(text, found["end"], F.lit(1)).rlike(_SEPARATORS))
    return F.when(fine, found).otherwise(_nothing(text))


def extract_date(text: Column, as_of: Column, full: bool = False, need_separator: bool = False) -> Column:
    """A date at the start or the end of a text, or anywhere in one that is short or with ``full``.

    Of a longer text the first and last ``WINDOW`` characters are searched; a
    match that touches the first one's end may be cut off and doesn't count;
    the last one wins if it is more accurate.
    """
    text = F.coalesce(text, F.lit(""))
    windows = F.when((F.octet_length(text) < WINDOW) | F.lit(full), F.array(text)).otherwise(F.array(F.substring(text, 1, WINDOW), F.substring(text, -WINDOW, WINDOW)))
    found = F.transform(windows, lambda w: let(first_date(w, as_of), lambda d: separated(w, d)) if need_separator else first_date(w, as_of))
    base = F.greatest(F.length(text) - WINDOW, F.lit(0))

    def choose(ends: Column) -> Column:
        first, last = ends[0], ends[1]
        accuracy = F.when(first["end"] >= WINDOW, 0).otherwise(first["accuracy"])
        moved = _result(last["accuracy"], last["ts"], last["beg"] + base, last["end"] + base)
        return F.when(accuracy < last["accuracy"], moved).when(accuracy == 0, _nothing(F.substring(text, 1, WINDOW))).otherwise(first)

    return let(found, lambda ends: F.when(F.size(ends) == 1, ends[0]).otherwise(choose(ends)))


def best_date(texts: Column, as_of: Column) -> Column:
    """The most accurate date of an array of texts, the first of equals: (accuracy, at, ts, beg, end), ``at`` its text's place."""
    each = F.transform(texts, lambda t, i: let(extract_date(t, as_of), lambda d: F.struct(d["accuracy"].alias("accuracy"), (-i).alias("back"), d["ts"].alias("ts"), d["beg"].alias("beg"), d["end"].alias("end"))))
    best = F.array_max(F.filter(each, lambda e: e["accuracy"] > 0))
    return let(best, lambda b: F.struct(b["accuracy"].alias("accuracy"), (-b["back"]).alias("at"), b["ts"].alias("ts"), b["beg"].alias("beg"), b["end"].alias("end")))


def split_date_source(text: Column) -> Column:
    """(date, source): a ``Y-m-d H:M:S`` in the text and what is left without it; both empty if there is none."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\r\n", "")
    date = F.regexp_extract(flat, r"(\d+-\d+-\d+ \d+:\d+:\d+)", 1)
    return F.struct(date.alias("date"), F.when(date != "", F.btrim(F.replace(flat, date, F.lit("")))).otherwise("").alias("source"))


def date_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm``; empty for null."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(""))
