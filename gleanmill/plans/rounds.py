"""A round: from fetched bytes, or pages, to new records, messages and stop decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import decode_body, gunzip, header_value, parse_feed, unescape, unwrap_pagelet, unwrap_search_json, wrap_page
from ..functions.urls import authority
from ..operators.dedup import dedup_key, first_of_all, new_records, page_counts, rule_filter, within_page
from ..operators.records import learn_from, record_parts, records_of
from ..operators.stops import stop_rule
from ..operators.tasks import task, task_messages
from ..sources.shared import checkpointed, small
from .requests import MOST_SITES, NEWS, Parser, dispatch, distinct_sites

#: Hosts whose pages come as chunks of JSON, and within a script.
CHUNKED_HOST, PAGELET_HOST = "www.google.com.hk", "s.weibo.com"


@dataclass(frozen=True)
class Round:
    """What a round found: every record (with page, dedup_key, dup_method and site_type), the new ones, a message for each page with any, and each page's counts."""

    records: DataFrame
    new: DataFrame
    messages: DataFrame
    counts: DataFrame

    def stops(self, by: list[str], order: str = "page_idx") -> DataFrame:
        """The stop rule over ``counts``, by each site's own setting."""
        return stop_rule(self.counts, by, order, stop_turn_page=F.col("stop_turn_page"))


def with_sites(fetched: DataFrame, sites: DataFrame, parsers: dict[tuple[str, str | None], Parser] | None = None) -> DataFrame:
    """``fetched`` pages of known sites with what their site says: parser, has_summary, feed, task_type, dup_method, stop_turn_page.

    Sites of one host count once, and those of unknown types not at all.
    """
    settings = dispatch(distinct_sites(sites), parsers).where("parser IS NOT NULL").select("host", "parser", "has_summary", "feed", "task_type", "dup_method", "stop_turn_page")
    return fetched.withColumn("host", authority(F.col("url"))).join(small(settings, MOST_SITES), "host")


def page_text(body: Column, headers: Column, url: Column, feed: Column) -> Column:
    """A fetched body as the page to parse: inflated, decoded, unwrapped by its host, entities resolved, made a whole page. A feed is only inflated and decoded."""
    text = decode_body(gunzip(body, F.coalesce(header_value(headers, "Content-Encoding"), F.lit(""))))
    host = authority(url)
    page = F.when(host == CHUNKED_HOST, unwrap_search_json(text)).when(host == PAGELET_HOST, unwrap_pagelet(text)).otherwise(text)
    return F.when(feed, text).otherwise(wrap_page(unescape(F.when(~feed, page))))


def mine(records: DataFrame, seen: DataFrame, key: str = "page_id", method: Column | str = "LINK", site_type: Column | str = NEWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records of a round (key, rank, title, link, summary, date) to (all with dedup_key, the new ones, a message for each page with any).

    Filtered, deduplicated within their page, across pages and against ``seen``
    (dedup_key), by each row's own method.
    """
    as_column = lambda c: F.lit(c) if isinstance(c, str) else c
    keyed = records.withColumns({"dedup_key": dedup_key(as_column(method), F.col("link"), F.col("title"), F.col("summary")), "site_type": as_column(site_type)})
    once = within_page(rule_filter(keyed), key, "dedup_key", "rank")
    new = new_records(first_of_all(once, "dedup_key", key, "rank"), seen, "dedup_key")
    return keyed, new, task_messages(new, key, "rank", task(F.col("link"), F.col("title"), F.col("date"), F.col("site_type")))


def pages_round(pages: DataFrame, seen: DataFrame, as_of: Column, method: str = "LINK", site_type: str = NEWS, learn: bool = True) -> tuple[DataFrame, DataFrame]:
    """A round over ready pages (page_id, url, html): (new records, messages). Each page is parsed once: its parts are written first.

    Records come from induction, failed ones by wrappers that this round's
    pages teach.
    """
    parts = checkpointed(record_parts(pages))
    found = records_of(parts, as_of, learn_from(parts, as_of) if learn else None)
    _, new, messages = mine(found, seen, method=method, site_type=site_type)
    return new, messages


def fetched_round(fetched: DataFrame, sites: DataFrame, seen: DataFrame, as_of: Column, learn: bool = True, parsers: dict[tuple[str, str | None], Parser] | None = None) -> Round:
    """A round over fetched bodies (fetch_id, url, body, headers, and columns that are passed to ``counts``) of known sites.

    Bodies that can't be inflated are left out. Each page is parsed once.
    """
    own = with_sites(fetched, sites, parsers)
    pages = own.select("fetch_id", "url", "has_summary", "feed", page_text(F.col("body"), F.col("headers"), F.col("url"), F.col("feed")).alias("html")).where("html IS NOT NULL")
    parts = checkpointed(record_parts(pages.where("NOT feed"), F.col("has_summary"), "fetch_id"))
    found = records_of(parts, as_of, learn_from(parts, as_of) if learn else None, "fetch_id").select("fetch_id", "rank", "title", "link", "summary", "source", "date")
    fed = pages.where("feed").select("fetch_id", F.posexplode(parse_feed(F.col("html"))).alias("rank", "r"))
    fed = fed.select("fetch_id", "rank", "r.title", "r.link", F.lit("").alias("summary"), "r.source", "r.date")
    settings = own.select("fetch_id", "dup_method", "task_type")
    records = checkpointed(found.unionByName(fed).join(settings, "fetch_id"))
    keyed, new, messages = mine(records, seen, "fetch_id", F.col("dup_method"), F.col("task_type"))
    passed = [c for c in own.columns if c not in ("body", "headers", "parser", "has_summary", "feed", "task_type", "dup_method")]
    counted = page_counts(keyed, seen, "fetch_id", "dedup_key", "rank", new=new)
    counts = own.select(*passed).join(counted, "fetch_id", "left").na.fill(0, ["new_cnt", "dup_cnt"])
    return Round(keyed, new, messages, counts)
