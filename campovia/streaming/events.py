"""Streams: idempotent micro-batches of work items, windowed counts with late data, running progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, ts: str, kind: str, value: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, kind, n, total) by event-time window; events later than `late` behind the newest are dropped on a stream."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    g = timed.groupBy(F.window(ts, window).alias("w"), F.col(kind)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, end, n): runs of a user's events without a longer gap."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    g = timed.groupBy(F.session_window(ts, gap).alias("w"), F.col(user)).agg(F.count("*").alias("n"))
    return g.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def process_once(items: DataFrame, chunk: str, done_path: str, work: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str) -> StreamingQuery:
    """Work through a stream of chunks, each at most once by its id, appending the results.

    A batch that is run again after a failure skips the chunks that have been noted as done; results are written under the
    batch's number, so a half-written batch is replaced.
    """
    spark = items.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates([chunk])
        try:
            done = spark.read.parquet(done_path).where(F.col("batch") != number).select(chunk)
            rows = rows.join(done, chunk, "left_anti")
        except Exception as error:  # nothing is done yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
        work(rows).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        rows.select(chunk).write.mode("overwrite").parquet(f"{done_path}/batch={number}")

    return items.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(results: DataFrame, job: str, chunk: str, total: str) -> DataFrame:
    """(job, done, percent) of chunks reported by subjobs, never over 100."""
    g = results.groupBy(job).agg(F.countDistinct(chunk).alias("done"), F.max(total).alias("_total"))
    return g.select(job, "done", F.least(F.lit(100.0), F.round(100 * F.col("done") / F.col("_total"), 2)).alias("percent"))
