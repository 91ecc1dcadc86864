"""Structured Streaming: incremental passes and windows. Extensions; batch operators need none of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def incremental(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str) -> StreamingQuery:
    """Run a batch step over each micro-batch and append what ``out`` lacks by key.

    A batch that is run again after a failure finds its keys stored and appends nothing twice.
    """

    def write(batch: DataFrame, _: int) -> None:
        made = step(batch).dropDuplicates([key])
        try:
            stored = batch.sparkSession.read.parquet(out).select(key)
            made = made.join(stored, key, "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        made.write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", at: str = "ts", group: str = "event_type") -> DataFrame:
    """Counts and sums per window and group; rows later than the watermark are left out of a stream."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width).alias("w"), group).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), group, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", at: str = "ts", user: str = "user_id") -> DataFrame:
    """Sessions of each user: start, end and number of events."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
