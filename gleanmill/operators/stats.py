"""Discovery counters by host and keyword, in tumbling hours and days."""

from __future__ import annotations

import html as html_lib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ("pages", "new", "dup")


def _sums(prefix: str = "") -> list[Column]:
    return [F.count(F.lit(1)).alias(f"{prefix}pages"), F.sum("new_cnt").alias(f"{prefix}new"), F.sum("dup_cnt").alias(f"{prefix}dup")]


def windowed(stats: DataFrame, width: str, ts: str = "ts") -> DataFrame:
    """host, keyword, bucket, pages, new, dup by event time; ``width`` is an interval such as ``1 hour``."""
    w = F.window(F.col(ts).cast("timestamp"), width)
    return stats.groupBy("host", "keyword", w.alias("_w")).agg(*_sums()).select("host", "keyword", F.col("_w.start").alias("bucket"), *COUNTERS)


def current(stats: DataFrame, as_of: Column, ts: str = "ts") -> DataFrame:
    """host, keyword and six counters: of the hour and of the day that ``as_of`` lies in, up to it."""
    at = F.col(ts).cast("timestamp")
    day, hour = F.date_trunc("day", at) == F.date_trunc("day", as_of), F.date_trunc("hour", at) == F.date_trunc("hour", as_of)
    one = lambda c, cond: F.sum(F.when(cond, c).otherwise(0)).cast("long")
    kinds = (("pages", F.lit(1)), ("new", F.col("new_cnt")), ("dup", F.col("dup_cnt")))
    return stats.where(day & (at <= as_of)).groupBy("host", "keyword").agg(*[one(c, hour).alias(f"hour_{n}") for n, c in kinds], *[one(c, F.lit(True)).alias(f"day_{n}") for n, c in kinds])


def by_host(stats: DataFrame) -> DataFrame:
    """Sums of all counters by host and keyword, by host (keyword null) and overall (both null)."""
    return stats.rollup("host", "keyword").agg(*_sums())


def html_report(counters: DataFrame, by: str) -> DataFrame:
    """``by``, html: a table row for each row of ``current``, escaped."""
    escape = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    columns = [c for c in counters.columns if c != by]
    cells = F.concat(*[F.concat(F.lit("<td>"), escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns])
    return counters.select(by, F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("html"))


def html_page(title: str, rows: list[str]) -> str:
    """A report page around rows that a caller has limited."""
    return f"<html><head><title>{html_lib.escape(title)}</title></head><body><table>{''.join(rows)}</table></body></html>"
