"""When to stop turning pages of a keyword's results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Empty pages in a row that end a keyword.
EMPTY_PAGES = 5


def empty_runs(counts: DataFrame, by: list[str], order: str = "page_idx") -> DataFrame:
    """``counts`` with ``empty_run``: how many pages in a row up to this one had no records."""
    w = Window.partitionBy(*by).orderBy(order)
    filled = F.last(F.when((F.col("new_cnt") + F.col("dup_cnt")) > 0, F.col("_at")), True).over(w)
    return counts.withColumn("_at", F.row_number().over(w)).withColumn("empty_run", F.col("_at") - F.coalesce(filled, F.lit(0))).drop("_at")


def stop_rule(counts: DataFrame, by: list[str], order: str = "page_idx", most: int = EMPTY_PAGES, stop_turn_page: bool | Column = True) -> DataFrame:
    """``counts`` with ``stop`` (this page ends the keyword) and ``live`` (no earlier page did).

    A page stops its keyword if it has only duplicates (with
    ``stop_turn_page``, a column where sites differ) or is the ``most``-th empty one in a row. Runs are kept
    for each of ``by``; a keyword's pages at one site are few.
    """
    runs = empty_runs(counts, by, order)
    flag = F.lit(stop_turn_page) if isinstance(stop_turn_page, bool) else stop_turn_page
    stale = (F.col("new_cnt") == 0) & (F.col("dup_cnt") > 0) & flag
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    stopped = runs.withColumn("stop", stale | (F.col("empty_run") >= most))
    return stopped.withColumn("live", ~F.coalesce(F.max("stop").over(before), F.lit(False)))
