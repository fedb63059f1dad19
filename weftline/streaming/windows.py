"""Operational signals over log events: windows, thresholds, absence, runs of breaches.

Every function takes a batch or a stream, unless it says otherwise; time columns
are instants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Periods and thresholds of the alarms.
FAILURE_PERIOD, STALE_PERIOD = "5 minutes", "12 hours"
SLOW_MS, FAILED_STATUS = 2000, 500


def failed_runs(events: DataFrame) -> DataFrame:
    return events.where(F.col("event") == "collection_failed")


def completed_runs(events: DataFrame) -> DataFrame:
    """Runs that ended in any way but failure."""
    return events.where((F.col("event") == "collection_completed") & (F.coalesce("status", F.lit("")) != "failed"))


def counted(events: DataFrame, period: str, late: str | None = None, time: str = "ts") -> DataFrame:
    """Events by tumbling window: window_start, events. ``late`` sets a watermark for streams."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.window(time, period)).agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("window_start"), "events")


def over_threshold(counts: DataFrame, least: int = 1) -> DataFrame:
    """Windows that alarm; a window without events does not."""
    return counts.where(F.col("events") >= least)


def statistics(events: DataFrame, value: str, period: str, late: str | None = None, time: str = "ts") -> DataFrame:
    """Average, maximum, minimum and sum by window."""
    rows = events.withWatermark(time, late) if late else events
    v = F.col(value)
    aggregates = [F.avg(v).alias("average"), F.max(v).alias("maximum"), F.min(v).alias("minimum"), F.sum(v).alias("total")]
    return rows.groupBy(F.window(time, period)).agg(*aggregates).select(F.col("window.start").alias("window_start"), "average", "maximum", "minimum", "total")


def dense(counts: DataFrame, period_seconds: int, start: Column, end: Column) -> DataFrame:
    """Batch only: every window from ``start`` to before ``end``, with 0 where nothing happened."""
    spark = counts.sparkSession
    first = F.floor(F.unix_seconds(start) / period_seconds) * period_seconds
    grid = spark.range(1).select(F.explode(F.sequence(first.cast("long"), F.unix_seconds(end) - 1, F.lit(period_seconds).cast("long"))).alias("s"))
    return grid.select(F.timestamp_seconds("s").alias("window_start")).join(counts, "window_start", "left").select("window_start", F.coalesce("events", F.lit(0)).alias("events"))


def absent(counts: DataFrame, period_seconds: int, start: Column, end: Column, least: int = 1) -> DataFrame:
    """Batch only: windows with fewer events than ``least``, those without any among them."""
    return dense(counts, period_seconds, start, end).where(F.col("events") < least)


def sustained(series: DataFrame, breach: Column, need: int, of: int, order: str = "window_start", by: list[str] | None = None) -> DataFrame:
    """Batch only: the series with ``breaching`` and ``alarm``: ``need`` of the last ``of`` rows breach.

    A series has a row a window; without ``by`` that is one metric's.
    """
    last = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(1 - of, 0)
    marked = series.withColumn("breaching", F.coalesce(breach, F.lit(False)))
    return marked.withColumn("alarm", F.sum(F.col("breaching").cast("int")).over(last) >= need)


def troubled_requests(requests: DataFrame) -> DataFrame:
    """Failed or slow requests; the caller orders them, newest first."""
    return requests.where((F.col("http_status") >= FAILED_STATUS) | (F.col("duration_ms") >= SLOW_MS))


def without_probes(requests: DataFrame) -> DataFrame:
    """Requests but for successful liveness probes."""
    return requests.where(~((F.col("path") == "/health/live") & (F.col("http_status") < 400)))
