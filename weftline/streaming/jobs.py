"""Streams: windows into a table, candidates into the store, silence into alarms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import collection
from ..providers import Embedder, HashedEmbedder
from ..schemas import ARTICLES
from ..sources.store import BatchTable


def started(df: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Write a stream as Parquet; with ``once`` all that is there now, then stop."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tables(spark: SparkSession, root: str) -> tuple[BatchTable, BatchTable, BatchTable]:
    """Articles, chunks and ledger under a root folder."""
    return BatchTable(spark, root, "articles"), BatchTable(spark, root, "chunks", "document_id"), BatchTable(spark, root, "runs", "run_id")


def ingest_batch(articles: BatchTable, chunks: BatchTable, runs: BatchTable, relevance: Callable[[DataFrame], DataFrame], embedder: Embedder) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` does with prepared candidates: a collection run into articles, chunks and the ledger.

    ``relevance`` adds ``tier`` to rows; better evidence that is stored stays. A
    batch sees the articles as of the batch before it, so one that is run again
    after a failure decides as it did and replaces all that it wrote.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = articles.read(upto=number - 1)
        now = F.current_timestamp()
        made = collection.collected(batch, known if known is not None else spark.createDataFrame([], ARTICLES), relevance, embedder, f"batch-{number}", now, now, keep=lambda df: df.persist())
        try:
            collection.stored(made, articles, chunks, runs, number)
        finally:
            made.chunks.unpersist()
            made.articles.unpersist()

    return run


def ingesting(candidates: DataFrame, root: str, relevance: Callable[[DataFrame], DataFrame], checkpoint: str, embedder: Embedder | None = None, every: str | None = None) -> StreamingQuery:
    """Candidates go through collection runs into the tables under ``root``: all that are there now, or ``every`` so often."""
    writer = candidates.writeStream.foreachBatch(ingest_batch(*tables(candidates.sparkSession, root), relevance, embedder or HashedEmbedder())).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def silences(events: DataFrame, seconds: int, key: str = "source", time: str = "ts", late: str = "1 minute") -> DataFrame:
    """(key, last_seen) whenever a key has had no event for ``seconds`` of event time."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "last_seen_ms": [last]})
            return
        last = state.get[0] if state.exists else 0
        for b in batches:
            last = max(last, int(b[time].max().timestamp() * 1000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    rows = events.withWatermark(time, late).groupBy(F.col(key).cast("string").alias(key))
    out = rows.applyInPandasWithState(run, "key string, last_seen_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("key", F.timestamp_millis("last_seen_ms").alias("last_seen"))
