"""Publisher names in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Words that mark a publisher's name, separators that end it, and words that rule a text out.
SITE_WORDS = ("网", "频道", "新闻", "博客", "论坛", "通讯社", "在线", "微博", "资讯", "报", "视窗", "站", "百科", "电视台")
BIG_NAMES = ("网易", "新浪", "搜狐", "腾讯", "凤凰", "百度", "知乎", "优酷", "土豆", "贴吧", "搜狗", "和讯", "中新", "人民网")
TOPIC_WORDS = ("科技", "教育", "军事", "育儿", "房产", "金融", "财经", "IT")
DENY_WORDS = ("快照", "站内搜索", "在线播放", "相同新闻", "最新相关资讯", "举报")
_SEPARATORS = r",\s_\-;；，:"
#: Accuracy that a word of each kind adds; the anchor is the last kind that occurs.
KINDS = ((SITE_WORDS, 10), (BIG_NAMES, 20), (TOPIC_WORDS, 10))
#: Longest name, and bytes beyond which only the text's ends are searched, in windows of as many characters.
WINDOW = 30

RESULT = "struct<accuracy:int,source:string,beg:int,end:int>"


def _earliest(text: Column, words: tuple[str, ...]) -> Column:
    """The first place (from 1) of any of the words; null if there is none."""
    return F.array_min(F.filter(F.transform(F.array(*map(F.lit, words)), lambda w: F.instr(text, w)), lambda k: k > 0))


def _result(accuracy: Column, source: Column, beg: Column, end: Column) -> Column:
    return F.struct(accuracy.cast("int").alias("accuracy"), source.alias("source"), beg.cast("int").alias("beg"), end.cast("int").alias("end"))


def _nothing() -> Column:
    return _result(F.lit(0), F.lit(None).cast("string"), F.lit(0), F.lit(0))


def _whole(text: Column) -> Column:
    flat = F.replace(text, F.lit("——"), F.lit(",,"))

    def around(places: Column) -> Column:
        accuracy = sum((F.when(places[k].isNotNull(), w).otherwise(0) for k, (_, w) in enumerate(KINDS)), F.lit(0))
        anchor = F.coalesce(*(places[k] for k in reversed(range(len(KINDS)))))
        left = F.least(F.length(F.regexp_extract(F.substring(flat, F.lit(1), anchor - 1), f"[^{_SEPARATORS}]*$", 0)), F.lit(WINDOW))
        right = F.length(F.regexp_extract(F.substring(flat, anchor, F.length(flat)), f"^[^{_SEPARATORS}]*", 0))
        span = F.struct(anchor.alias("anchor"), left.alias("left"), F.least(right, F.lit(WINDOW) - left).alias("right"))
        made = lambda s: _result(accuracy, F.substring(text, s["anchor"] - s["left"], s["left"] + s["right"]), s["anchor"] - 1 - s["left"], s["anchor"] - 1 + s["right"])
        return F.when(anchor.isNull(), _nothing()).otherwise(let(span, made))

    found = let(F.array(*[_earliest(flat, words) for words, _ in KINDS]), around)
    return F.when(_earliest(flat, DENY_WORDS).isNotNull(), _nothing()).otherwise(found)


def extract_source(text: Column) -> Column:
    """A publisher's name in a short text, or at the start or end of a longer one; accuracy 0 and null if none.

    A name that touches a window's inner end may be cut off and doesn't count.
    Of equal accuracies the longer name at the start wins, else the one at the end.
    """
    text = F.coalesce(text, F.lit(""))
    windows = F.when(F.octet_length(text) <= WINDOW, F.array(text)).otherwise(F.array(F.substring(text, 1, WINDOW), F.substring(text, -WINDOW, WINDOW)))
    base, long = F.greatest(F.length(text) - WINDOW, F.lit(0)), F.length(text) > WINDOW

    def choose(ends: Column) -> Column:
        first, last = ends[0], ends[1]
        one = F.when(long & (first["end"] >= WINDOW), 0).otherwise(first["accuracy"])
        two = F.when(long & (last["beg"] == 0), 0).otherwise(last["accuracy"])
        size = lambda x: x["end"] - x["beg"]
        ahead = (one > two) | ((one == two) & (size(first) > size(last)))
        moved = _result(last["accuracy"], last["source"], last["beg"] + base, last["end"] + base)
        return F.when((one == 0) & (two == 0), _nothing()).when(ahead, first).otherwise(moved)

    return let(F.transform(windows, lambda w: _whole(w)), lambda ends: F.when(F.size(ends) == 1, ends[0]).otherwise(choose(ends)))


def best_source(texts: Column, linked: Column | None = None) -> Column:
    """The most accurate name of an array of texts, the first of equals: (accuracy, at, source, beg, end).

    With ``linked`` (array of booleans) a text counts 1 more, and one within a
    link 2 less.
    """
    linked = linked if linked is not None else F.transform(texts, lambda _: F.lit(None).cast("boolean"))
    pairs = F.arrays_zip(texts.alias("t"), linked.alias("l"))
    each = F.transform(pairs, lambda p, i: F.struct(extract_source(p["t"]).alias("s"), i.alias("i"), F.when(p["l"].isNull(), 0).when(p["l"], -1).otherwise(1).alias("bias")))
    ranked = F.transform(
        F.filter(each, lambda e: e["s"]["accuracy"] > 0),
        lambda e: F.struct((e["s"]["accuracy"] + e["bias"]).alias("accuracy"), (-e["i"]).alias("back"), e["s"]["source"].alias("source"), e["s"]["beg"].alias("beg"), e["s"]["end"].alias("end")),
    )
    best = F.array_max(ranked)
    return let(best, lambda b: F.struct(b["accuracy"].alias("accuracy"), (-b["back"]).alias("at"), b["source"].alias("source"), b["beg"].alias("beg"), b["end"].alias("end")))
