"""Task messages: what leaves the engine for each page with new records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def task(link: Column, title: Column, date: Column, site_type: Column) -> Column:
    """One task; every value is a string."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.struct(
        text(link).alias("url"), text(date).alias("pubdate"), text(title).alias("title"), F.lit("").alias("siteName"), F.lit("").alias("channelName"), text(site_type).alias("siteType"), F.lit("-1").alias("maxDepth"),
    )


def task_messages(records: DataFrame, page: str, rank: str, made: Column) -> DataFrame:
    """page, tasks_json: the tasks of a page's records, in order. A page's records are few; pages without any have no message."""
    each = records.select(page, F.struct(F.col(rank).alias("rank"), made.alias("task")).alias("_t"))
    grouped = each.groupBy(page).agg(F.array_sort(F.collect_list("_t")).alias("_l"))
    return grouped.select(page, F.to_json(F.struct(F.transform("_l", lambda t: t["task"]).alias("tasks"))).alias("tasks_json"))


MESSAGE = "tasks array<struct<url:string,pubdate:string,title:string,siteName:string,channelName:string,siteType:string,maxDepth:string>>"


def read_messages(messages: DataFrame, column: str = "tasks_json") -> DataFrame:
    """The tasks of messages, a row each; what is no message gives no rows."""
    others = [c for c in messages.columns if c != column]
    return messages.select(*others, F.inline(F.from_json(column, MESSAGE)["tasks"]))
