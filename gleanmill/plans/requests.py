"""From sites and keywords to page requests, and which parser a site's pages need."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import authority, charset_name, encode_as
from ..operators.dedup import first_of_all
from ..sources.shared import small

#: Task types of site templates.
NEWS, BLOG, FORUM, WECHAT = "新闻", "博客", "论坛", "微信"
FEED_HOST = "search.people.com.cn"
#: Sites up to which their table is broadcast.
MOST_SITES = 100_000


def distinct_keywords(keywords: DataFrame) -> DataFrame:
    """keyword: stripped, non-empty, each once."""
    return keywords.select(F.btrim("keyword").alias("keyword")).where("keyword <> ''").distinct()


def distinct_sites(sites: DataFrame) -> DataFrame:
    """Sites with a usable address (10 characters at least), one for each host: the first by address."""
    usable = sites.where(F.length("request_url") >= 10).withColumn("host", authority(F.col("request_url")))
    return first_of_all(usable, "host", "request_url")


def plan_requests(sites: DataFrame, keywords: DataFrame) -> DataFrame:
    """site, keyword, page_idx, page_no, url, post_data, method for each page of each keyword at each site.

    A keyword is encoded once for each charset among ``sites.encode_type``
    (UTF-8 without that column), a site's own search prefix once for it. The
    product of sites and keywords is what is asked for; up to ``MOST_SITES``
    sites are broadcast, so it needs no shuffle.
    """
    kind = F.col("encode_type") if "encode_type" in sites.columns else F.lit(None).cast("string")
    own = sites.withColumn("_charset", charset_name(kind))
    prefix = F.when(F.coalesce("search_in_site", F.lit("")) == "", "").otherwise(F.concat(encode_as(F.col("search_in_site"), F.col("_charset")), F.lit("+")))
    own = small(own.withColumn("_prefix", prefix), MOST_SITES)
    charsets = F.broadcast(own.select("_charset").distinct())  # a handful
    words = keywords.crossJoin(charsets)
    words = words.withColumn("_word", encode_as(F.col("keyword"), F.col("_charset")))
    each = words.join(own, "_charset").withColumn("_key", F.concat("_prefix", "_word"))
    pages = each.withColumn("page_idx", F.explode(F.when(F.col("page_total") > 0, F.sequence(F.lit(0), F.col("page_total") - 1))))
    number = (F.col("page_start") + F.col("page_idx") * F.col("page_increase")).cast("string")
    filled = lambda c: F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("{0}"), F.col("_key")), F.lit("{1}"), number)
    out = pages.withColumns({"url": filled("request_url"), "post_data": filled("post_data"), "page_no": number.cast("int")})
    return out.select("site", "keyword", "page_idx", "page_no", "url", "post_data", F.when(F.col("post_data") != "", "POST").otherwise("GET").alias("method"))


def with_referer(requests: DataFrame) -> DataFrame:
    """``requests`` with ``referer``: the last address of the site's round before."""
    last = requests.groupBy("site", "page_idx").agg(F.max_by("url", F.struct("keyword", "url")).alias("_last"))
    before = last.select("site", (F.col("page_idx") + 1).alias("page_idx"), F.col("_last").alias("referer"))
    return requests.join(before, ["site", "page_idx"], "left").select(*requests.columns, "referer")


def live_requests(requests: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Requests of keywords not cancelled at their site (site, keyword)."""
    return requests.join(cancelled.select("site", "keyword"), ["site", "keyword"], "left_anti")


def request_chain(requests: DataFrame) -> DataFrame:
    """``requests`` with ``previous_url``: the request before it at its site, by page and keyword.

    Within a page of a site by a window; a page's first request has the last
    one of the site's page before, of which there are few.
    """
    own = Window.partitionBy("site", "page_idx").orderBy("keyword")
    last = requests.groupBy("site", "page_idx").agg(F.max_by("url", "keyword").alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.partitionBy("site").orderBy("page_idx"))).select("site", "page_idx", "_before")
    joined = requests.withColumn("_lag", F.lag("url").over(own)).join(before, ["site", "page_idx"], "left")
    return joined.select(*requests.columns, F.coalesce("_lag", "_before").alias("previous_url"))


@dataclass(frozen=True)
class Parser:
    """How pages of a kind of site become records."""

    name: str
    has_summary: bool = True
    feed: bool = False


#: By (task type, host); the host None stands for all others.
PARSERS: dict[tuple[str, str | None], Parser] = {
    (NEWS, FEED_HOST): Parser("feed", feed=True),
    (NEWS, None): Parser("news"),
    (BLOG, None): Parser("search"),
    (FORUM, None): Parser("search"),
    (WECHAT, None): Parser("search"),
}


def register(task_type: str, host: str | None, parser: Parser) -> None:
    """Adds or replaces the parser of a kind of site."""
    PARSERS[task_type, host] = parser


def dispatch(sites: DataFrame, parsers: dict[tuple[str, str | None], Parser] | None = None) -> DataFrame:
    """``sites`` with ``parser``, by task type and host, else by task type, and its has_summary and feed; null for unknown types. The registry is small and broadcast."""
    spark = sites.sparkSession
    rows = [(t, h, p.name) for (t, h), p in (parsers or PARSERS).items()]
    table = spark.createDataFrame(rows, "task_type string, _host string, _parser string")
    exact = F.broadcast(table.where("_host IS NOT NULL"))
    general = F.broadcast(table.where("_host IS NULL").select("task_type", F.col("_parser").alias("_any")))
    own = sites.withColumn("host", authority(F.col("request_url")))
    joined = own.join(exact.select("task_type", F.col("_host").alias("host"), "_parser"), ["task_type", "host"], "left").join(general, "task_type", "left")
    found = joined.withColumn("parser", F.coalesce("_parser", "_any")).drop("_parser", "_any")
    named = {p.name: p for p in (parsers or PARSERS).values()}
    flag = lambda name: F.col("parser").isin(*[n for n, p in named.items() if getattr(p, name)])
    return found.withColumns({"has_summary": flag("has_summary"), "feed": flag("feed")})
