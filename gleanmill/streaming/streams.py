"""The same stages over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.stats import COUNTERS
from ..operators.stops import EMPTY_PAGES


def stream_stats(stats: DataFrame, width: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """host, keyword, bucket, pages, new, dup by event time; rows later than ``late`` are dropped and their state goes."""
    timed = stats.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    counted = timed.groupBy("host", "keyword", F.window("_ts", width).alias("_w")).agg(F.count(F.lit(1)).alias("pages"), F.sum("new_cnt").alias("new"), F.sum("dup_cnt").alias("dup"))
    return counted.select("host", "keyword", F.col("_w.start").alias("bucket"), *COUNTERS)


def stream_dedup(records: DataFrame, key: str, ts: str | None = None, within: str | None = None) -> DataFrame:
    """The first row of each key: forever, or with bounded state ``within`` an interval of event time ``ts``."""
    if within is None:
        return records.dropDuplicates([key])
    return records.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


STOPPED = "site string, keyword string, page_idx long, stop boolean, live boolean"


class StopProcessor(StatefulProcessor):
    """The stop rule for one (site, keyword): the state is the run of empty pages and whether it has stopped."""

    def __init__(self, most: int = EMPTY_PAGES, stop_turn_page: bool = True):
        self.most, self.stop_turn_page = most, stop_turn_page

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "empty_run long, stopped boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        run, stopped = self.state.get() if self.state.exists() else (0, False)
        out = []
        for row in pd.concat(list(rows)).sort_values("page_idx").itertuples():
            run = run + 1 if row.new_cnt + row.dup_cnt == 0 else 0
            stop = (self.stop_turn_page and row.new_cnt == 0 and row.dup_cnt > 0) or run >= self.most
            out.append((*key, int(row.page_idx), bool(stop), not stopped))
            stopped = bool(stopped or stop)
        self.state.update((int(run), stopped))
        yield pd.DataFrame(out, columns=["site", "keyword", "page_idx", "stop", "live"])

    def close(self) -> None:
        pass


def stream_stops(counts: DataFrame, most: int = EMPTY_PAGES, stop_turn_page: bool = True) -> DataFrame:
    """The stop rule over a stream of page counts, in order within each micro-batch; needs the RocksDB state store."""
    return counts.groupBy("site", "keyword").transformWithStateInPandas(StopProcessor(most, stop_turn_page), outputStructType=STOPPED, outputMode="Append", timeMode="None")


def post_messages(messages: DataFrame, checkpoint: str, send: Callable[[list[str]], None], interval: str | None = None) -> StreamingQuery:
    """Hands every micro-batch's messages to ``send`` on the executors, partition by partition, again after a failure.

    At least once: receivers tell repeats apart by content. Without
    ``interval`` what is there is handled and the query ends.
    """

    def each(batch: DataFrame, _: int) -> None:
        batch.select("tasks_json").foreachPartition(lambda rows: send([r["tasks_json"] for r in rows]))

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(**trigger).start()


def append_new(records: DataFrame, key: str, seen_path: str, out_path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Writes rows with unseen keys and remembers the keys, without state that grows in memory.

    Each micro-batch is anti-joined with the keys of batches before it; both
    folders hold a subfolder for each batch, so a repeated batch overwrites its own.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.dropDuplicates([key])
        if number:
            seen = spark.read.option("basePath", seen_path).parquet(seen_path).where(F.col("batch") < number).select(key)
            first = first.join(seen, key, "left_anti")
        first.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        spark.read.parquet(f"{out_path}/batch={number}").select(key).write.mode("overwrite").parquet(f"{seen_path}/batch={number}")

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(**trigger).start()
