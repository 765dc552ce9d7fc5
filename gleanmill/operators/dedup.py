"""Record filtering and deduplication within pages and across all that was seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.urls import authority

# Parts of links, hosts, and parts of hosts that are no records.
LINK_PARTS, HOSTS, HOST_PARTS = ("&query=", "/ns?word=", "news.haosou.com/ns?j=0"), ("www.xici.net", "news.baidu.com"), ("dedeadmin.com",)


def rule_filter(records: DataFrame, link: str = "link", link_parts: tuple[str, ...] = LINK_PARTS, hosts: tuple[str, ...] = HOSTS, host_parts: tuple[str, ...] = HOST_PARTS) -> DataFrame:
    """Without rows whose link has a part (not at its start) or whose host is, or has a part, on the lists. Null links stay."""
    url, host = F.col(link), F.coalesce(authority(F.col(link)), F.lit(""))
    bad = F.lit(False)
    for p in link_parts:
        bad = bad | (F.coalesce(F.instr(url, p), F.lit(0)) > 1)
    for p in host_parts:
        bad = bad | host.contains(p)
    return records.where(~(bad | host.isin(*hosts)))


def rule_filter_table(records: DataFrame, rules: DataFrame, link: str = "link") -> DataFrame:
    """The same from a rules table (kind: link_part, host or host_part; value), by an anti-join; the table is one row for each rule."""
    host = F.coalesce(authority(F.col(link)), F.lit(""))
    hit = (
        ((F.col("kind") == "link_part") & (F.instr(F.col(link), F.col("value")) > 1))
        | ((F.col("kind") == "host") & (host == F.col("value")))
        | ((F.col("kind") == "host_part") & F.contains(host, F.col("value")))
    )
    return records.join(rules, hit, "left_anti")


def dedup_key(method: Column, link: Column, title: Column, summary: Column) -> Column:
    """The link, or for method TITLE the stripped title and the first 20 characters of the stripped summary."""
    by_title = F.concat(F.coalesce(strip(title), F.lit("")), F.substring(F.coalesce(strip(summary), F.lit("")), 1, 20))
    return F.when(method == "TITLE", by_title).otherwise(link)


def within_page(records: DataFrame, page: str, key: str, rank: str) -> DataFrame:
    """Of a page's rows with one key the last by ``rank``: an aggregate, which combines before the shuffle."""
    rest = [c for c in records.columns if c not in (page, key)]
    best = F.max_by(F.struct(*rest), F.col(rank)).alias("_r")
    return records.groupBy(page, key).agg(best).select(page, key, "_r.*").select(*records.columns)


def first_of_all(records: DataFrame, key: str, *order: str) -> DataFrame:
    """Of all rows with one key the first by ``order``.

    The least order and its row are found by an aggregate, which combines
    before the shuffle: a hot key is one row of each task, not a window of all.
    """
    rest = [c for c in records.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return records.groupBy(key).agg(best).select(key, "_r.*").select(*records.columns)


def new_records(records: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``seen`` (one column of that name)."""
    return records.join(seen.select(key), key, "left_anti")


def page_counts(records: DataFrame, seen: DataFrame, page: str, key: str, *order: str, new: DataFrame | None = None) -> DataFrame:
    """page, new_cnt, dup_cnt: of each page's rows those that are the first of their key anywhere and unseen, and the rest.

    A repeat within a page and a filtered row count as duplicates, if they are
    in ``records``. The new rows may be given if they are known.
    """
    new = new_records(first_of_all(records.select(page, key, *order), key, *order), seen, key) if new is None else new
    new = new.groupBy(page).agg(F.count(F.lit(1)).alias("new_cnt"))
    every = records.groupBy(page).agg(F.count(F.lit(1)).alias("_all"))
    return every.join(new, page, "left").select(page, F.coalesce("new_cnt", F.lit(0)).alias("new_cnt"), (F.col("_all") - F.coalesce("new_cnt", F.lit(0))).alias("dup_cnt"))
