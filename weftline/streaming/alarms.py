"""Alarms that keep state on streams: M of the last N windows, and sources that fall silent.

Both are ``transformWithState`` processors, which need Spark's RocksDB state
store (``ready`` sets it for the session). What a stream tells is what the batch
functions of ``windows`` tell of the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ready(spark: SparkSession) -> None:
    """Let the session's streams keep their state in RocksDB, as these alarms need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Sustained(StatefulProcessor):
    """For each window of a key: whether it breaches, and whether ``need`` of the last ``of`` do."""

    def __init__(self, need: int, of: int):
        self.need, self.of = need, of

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "at long, breaching boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = [tuple(r) for r in self.last.get()] if self.last.exists() else []
        for r in sorted(rows, key=lambda r: r["at"]):
            if kept and r["at"] <= kept[-1][0]:
                continue  # told already
            kept = [*kept, (r["at"], bool(r["breaching"]))][-self.of :]
            yield Row(key=key[0], at=r["at"], breaching=kept[-1][1], alarm=sum(b for _, b in kept) >= self.need)
        self.last.put(kept)

    def close(self) -> None:
        pass


def sustained(series: DataFrame, breach: Column, need: int, of: int, by: str | None = None) -> DataFrame:
    """key, window_start, breaching, alarm of a stream of windows (column window_start), a row a window.

    Windows of a key are taken in order; one that comes after a later window of
    its key was told is left out, as the watermark of ``windows.counted`` does.
    Without ``by`` all windows are one metric's, so one task keeps it: a row a
    window, as alarms have.
    """
    ready(series.sparkSession)
    rows = series.select(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("key") if by else F.lit("").alias("key"), F.unix_micros("window_start").alias("at"), F.coalesce(breach, F.lit(False)).alias("breaching"))
    out = rows.groupBy("key").transformWithState(Sustained(need, of), "key string, at long, breaching boolean, alarm boolean", "Append", "None")
    return out.select("key", F.timestamp_micros("at").alias("window_start"), "breaching", "alarm")


class Silent(StatefulProcessor):
    """Tells a key once whenever it has had no event for a while, one that never had any among them."""

    def __init__(self, seconds: int):
        self.wait = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seen_ms long")

    def _seen(self, at: int) -> None:
        before = self.last.get()[0] if self.last.exists() else None
        if before is not None and before >= at:
            return
        if before is not None:
            self.handle.deleteTimer(before + self.wait)
        self.last.update((at,))
        self.handle.registerTimer(at + self.wait)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._seen(initialState["seen_ms"])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._seen(max(r["seen_ms"] for r in rows))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self.last.get()[0]
        # stays known, so that a late event tells nothing again; the next event sets a new timer
        yield Row(key=key[0], last_seen_ms=last)

    def close(self) -> None:
        pass


def silences(events: DataFrame, seconds: int, known: DataFrame, start: Column, key: str = "source", time: str = "ts", late: str = "1 minute") -> DataFrame:
    """key, last_seen whenever a key has had no event for ``seconds`` of event time.

    ``known`` (the registry, with the column ``key``) are those from which events
    are expected since ``start``; a key without a first event is told with it.
    """
    ready(events.sparkSession)
    rows = events.withWatermark(time, late).select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col(time).cast("timestamp")).alias("seen_ms"), F.col(time))
    first = known.select(F.col(key).cast("string").alias("key"), F.unix_millis(start).alias("seen_ms")).distinct().groupBy("key")
    out = rows.groupBy("key").transformWithState(Silent(seconds), "key string, last_seen_ms long", "Append", "EventTime", first)
    return out.select("key", F.timestamp_millis("last_seen_ms").alias("last_seen"))
