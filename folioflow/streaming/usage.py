"""Streaming forms: live usage over event logs and windows of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COUNTERS = ("tokens", "events")


def live_usage(events: DataFrame) -> DataFrame:
    """stage, events, tokens: sums that grow as logs grow; write in update or complete mode."""
    return events.groupBy("stage").agg(F.count("*").alias("events"), F.sum("tokens").alias("tokens"))


def windowed_usage(events: DataFrame, at: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """start, stage, events, tokens of tumbling windows; rows later than ``late`` are left out.

    Timestamps without a zone are read as UTC, as watermarks need zoned ones."""
    zoned = events.withColumn(at, F.col(at).cast("timestamp"))
    sums = zoned.withWatermark(at, late).groupBy(F.window(at, size), "stage").agg(F.count("*").alias("events"), F.sum("tokens").alias("tokens"))
    return sums.select(F.col("window.start").alias("start"), "stage", "events", "tokens")


def drain(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Runs a streaming frame over what is there into the in-memory table ``name`` and ends it."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def live_status(reports: DataFrame) -> DataFrame:
    """doc, done, tokens: counters of runs as reports come in; none ever falls, whatever a late report says."""
    return reports.groupBy("doc").agg(F.max("done").alias("done"), F.max("tokens").alias("tokens"))
