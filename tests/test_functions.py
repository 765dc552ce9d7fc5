"""Scalar functions on single values, with their edge cases."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanmill.functions import dates, normalize, publishers, text, urls
from gleanmill.operators.page import distance_semi, normalise

AS_OF = "2024-06-15 12:00:00"
def value(spark, column, **named):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in named.items()], F.lit(None).cast("string").alias("nothing"))
    return row.select(column.alias("v")).first()["v"]


DATES = [
    ("Harbour news, Mar 09, 2021: ferry back in service", 30, "2021-03-09 12:00:00"),
    ("Mar 9 and no year", 20, "2024-03-09 12:00:00"),
    ("Dec 24", 20, "2023-12-24 12:00:00"),
    ("港口消息 2019年3月5日  07:08:09", 60, "2019-03-05 07:08:09"),
    ("港口消息 2019年3月5日", 30, "2019-03-05 10:00:00"),
    ("渡船 23:59:58 开", 0, None),
    ("渡船 09:10:11 开", 30, "2024-06-15 09:10:11"),
    ("edited 2019-3-5 7:08:09 by staff", 60, "2019-03-05 07:08:09"),
    ("edited 2019/03/05 07:08", 50, "2019-03-05 07:08:00"),
    ("于 2019年3月5号 7点8分9秒 更新", 60, "2019-03-05 07:08:09"),
    ("于 19年03月05 7点8分9 更新", 60, "2019-03-05 07:08:09"),
    ("on 98-03-02 at 10:11", 50, "1998-03-02 10:11:00"),
    ("写于 7秒前", 60, "2024-06-15 11:59:53"),
    ("写于 45 秒钟之前", 60, "2024-06-15 11:59:15"),
    ("写于 6分钟前", 50, "2024-06-15 11:54:00"),
    ("写于 6分之前", 50, "2024-06-15 11:54:00"),
    ("left 10 minutes ago", 50, "2024-06-15 11:50:00"),
    ("left 10minutes ago", 0, None),
    ("left 4 HOURS ago", 40, "2024-06-15 08:00:00"),
    ("写于 4小时前", 40, "2024-06-15 08:00:00"),
    ("写于 3日之前", 30, "2024-06-12 12:00:00"),
    ("seen 1 day ago", 30, "2024-06-14 12:00:00"),
    ("写于 1年前", 40, "2023-06-16 12:00:00"),
    ("写于 昨天 18:05", 50, "2024-06-14 18:05:00"),
    ("1年前 的船 2019年3月5日 07:08:09", 60, "2019-03-05 07:08:09"),
    ("id 1551773289", 0, None),
    ("see http://ferry.example.com/2019/3/5/x at 2018-01-02 03:04:05", 60, "2018-01-02 03:04:05"),
    ("1551773289 id", 10, "2019-03-05 08:08:09"),
    ("y" * 130 + " id 1551773289 then 2019/3/5 07:08:09", 60, "2019-03-05 07:08:09"),
    ("31/02/2020 none 2020-02-31", 0, None),
    ("", 0, None),
    (None, 0, None),
]


@pytest.mark.parametrize("shown,accuracy,found", DATES)
def test_dates(spark, shown, accuracy, found):
    got = value(spark, dates.extract_date(F.col("t") if shown is not None else F.col("nothing"), F.lit(AS_OF).cast("timestamp")), t=shown or "")
    assert got["accuracy"] == accuracy
    expected = None if found is None else dt.datetime.fromisoformat(found)
    assert got["ts"] == expected or (expected and got["ts"].replace(second=0) == expected.replace(second=0) and found.endswith(":00"))


def test_yesterday_on_the_first_of_a_month(spark):
    got = value(spark, dates.extract_date(F.lit("昨天 09:30"), F.lit("2024-03-01 12:00:00").cast("timestamp")))
    assert got["ts"] == dt.datetime(2024, 2, 29, 9, 30)


def test_separator_is_asked_for(spark):
    at = F.lit(AS_OF).cast("timestamp")
    assert value(spark, dates.extract_date(F.lit("ab2020-01-02cd"), at, need_separator=True))["accuracy"] == 0
    assert value(spark, dates.extract_date(F.lit("a 2020-01-02 b"), at, need_separator=True))["accuracy"] == 30


def test_best_date_reports_the_winners_span(spark):
    got = value(spark, dates.best_date(F.array(F.lit("x 2020-01-02 10:11:12"), F.lit("4天前")), F.lit(AS_OF).cast("timestamp")))
    assert (got["at"], got["beg"], got["end"]) == (0, 2, 21)


@pytest.mark.parametrize("shown,accuracy,source", [("海港晚报  2021-03-09", 10, "海港晚报"), ("搜狐频道  3月9日", 30, "搜狐频道"), ("搜狐频道 快照", 0, None), ("plain", 0, None), ("腾讯科技_渡船", 30, "腾讯科技"), ("", 0, None)])
def test_sources(spark, shown, accuracy, source):
    got = value(spark, publishers.extract_source(F.col("t")), t=shown)
    assert (got["accuracy"], got["source"]) == (accuracy, source)


def test_strip_and_split(spark):
    assert value(spark, text.strip(F.col("t")), t=" \t a b \r\n") == "a b"
    assert value(spark, text.strip(F.col("t")), t=" x ") == " x "
    assert value(spark, text.strip(F.col("t"), compat=True), t=" a ") == ""
    assert value(spark, text.strip(F.col("nothing"))) is None
    assert value(spark, text.split_strip(F.col("t"), "|"), t=" a | |b|") == ["a", "b"]
    assert value(spark, text.clean_summary(F.col("t")), t="a long summary\n... end") == "a long summary"
    assert value(spark, text.clean_summary(F.col("t")), t="a...long summary") == "a...long summary"
    assert [value(spark, text.is_number(F.col("t")), t=x) for x in ("12", "", "1a", "1\n")] == [True, False, False, False]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=6), st.text("abc", max_size=6)), min_size=1, max_size=20))
def test_semi_distance_is_the_least_over_suffixes(spark, pairs):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    got = {r["k"]: r["d"] for r in df.select("k", text.edit_distance_semi(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {k: distance_semi(a, b) for k, (a, b) in enumerate(pairs)}


def test_semi_distance_sample():
    assert distance_semi("abc", "bcd") == 1


PAGE = "http://u@h.example:8080/p/q?x=1?y"


@pytest.mark.parametrize("link", ["/a", "?b=2", "c/d", "http://o.example/e?f", "//h/x", " /g ", "https://z", ""])
def test_links_agree_in_both_engines(spark, link):
    assert value(spark, urls.normalise_link(F.col("l"), F.lit(PAGE)), l=link) == normalise(link, PAGE)


def test_urls(spark):
    assert value(spark, urls.authority(F.lit(PAGE))) == "u@h.example:8080"
    assert value(spark, urls.authority(F.lit("no scheme"))) is None
    assert value(spark, urls.before_query(F.lit(PAGE))) == "http://u@h.example:8080/p/q?x=1"
    assert value(spark, urls.form_encode(F.lit("a b*c&中"))) == "a+b%2Ac%26%E4%B8%AD"
    assert value(spark, urls.decode_keyword(F.lit("%zz"))) is None
    got = value(spark, urls.query_params(F.lit("http://h/?b=x&a=10&a=9&c=1=2&d")))
    assert [(p["key"], p["number"], p["value"]) for p in got] == [("a", 9, "9"), ("a", 10, "10"), ("b", None, "x"), ("c", 1, "1"), ("d", None, "")]


def test_normalise(spark):
    page = F.lit('<meta charset=gbk/><p>x</p>')
    assert value(spark, normalize.declared_charset(page)) == "gbk"
    assert 'http-equiv="Content-Type"' in value(spark, normalize.rewrite_charset(F.lit('<meta charset="utf-8"><title>t</title>')))
    assert value(spark, normalize.rewrite_charset(F.lit('<meta charset="utf-8"><title>t</title>'))).endswith("<title>t</title>")
    assert value(spark, normalize.wrap_page(F.lit("x"))).endswith("<body>x</body></html>")
    assert value(spark, normalize.unwrap_search_json(F.lit("no chunks"))) is None
    assert value(spark, normalize.unwrap_pagelet(F.lit("nothing"))) is None
    assert value(spark, normalize.parse_feed(F.lit("<R></R>"))) == []
    feed = "<R><RESULT><TITLE>a&lt;b&gt;c</TITLE><PUBLISHTIME>2015年05月17日00时11分02秒</PUBLISHTIME><SOURCE>s</SOURCE><CHANNEL>c</CHANNEL><DOCURL>http://x/1</DOCURL></RESULT><RESULT><TITLE>t</TITLE><PUBLISHTIME>soon</PUBLISHTIME><DOCURL>http://x/2</DOCURL></RESULT></R>"
    got = value(spark, normalize.parse_feed(F.lit(feed)))
    assert [(r["title"], r["date"], r["channel"]) for r in got] == [("ac", "2015-05-17 00:11", "c"), ("t", "", None)]
