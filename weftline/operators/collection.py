"""A collection run: candidates through the router into articles, chunks and the ledger.

Everything is set operations over one run's candidates; nothing loops over
sources or entries. A run's parts are DataFrames until ``stored`` writes them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import MAX_TOKENS, OVERLAP, TokenCounter, count_words
from ..functions.chunking import chunks as chunked
from ..providers import Embedder, embedded
from ..schemas import ARTICLES, CHUNKS, RUNS
from ..sources.store import BatchTable, Lease
from .ingest import Summarizer, collection_totals, fallback_card, last_of_batch, matched, routed, run_totals, written

# What the ledger says of a source's run, and how much of an error it keeps.
COMPLETED, FAILED, ERROR_LIMIT = "completed", "failed", 1000


@dataclass
class Run:
    """What a run writes: article rows (with route, status, drops_chunks), their new chunks, a ledger row a source."""

    articles: DataFrame
    chunks: DataFrame
    ledger: DataFrame

    def totals(self) -> DataFrame:
        """One row over all sources."""
        return collection_totals(self.ledger)


def new_chunks(articles: DataFrame, embedder: Embedder, most: int = MAX_TOKENS, overlap: int = OVERLAP, count: TokenCounter = count_words) -> DataFrame:
    """Chunks of the articles (of one route or another) that have a card of their own, with their vectors."""
    cut = chunked(articles.where(F.col("route") == "summarize"), most, overlap, count)
    vectors = embedded(cut, embedder)
    hashed = vectors.withColumn("content_hash", F.sha2(F.encode("content", "UTF-8"), 256))
    named = hashed.withColumn("id", F.sha2(F.concat_ws("\n", "document_id", F.col("chunk_index").cast("string"), "content_hash"), 256))
    return named.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in CHUNKS.fields))


def ledger(articles: DataFrame, chunks: DataFrame, failures: DataFrame | None, run_id: str, started: Column, finished: Column) -> DataFrame:
    """A row a source: counts where it went through, the error where it did not (``failures``: source_name, error)."""
    cut = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("chunks"))
    by_source = articles.select("id", "source_name").join(cut, "id").groupBy("source_name").agg(F.sum("chunks").alias("chunks_written"))
    done = run_totals(articles).join(by_source, "source_name", "left").withColumn("error", F.lit(None).cast("string"))
    if failures is not None:
        gone = failures.select("source_name", F.substring("error", 1, ERROR_LIMIT).alias("error"))
        done = done.join(gone.select("source_name"), "source_name", "left_anti").unionByName(gone, allowMissingColumns=True)
    counts = [f.name for f in RUNS.fields if f.name.startswith("updates_") or f.name in ("matched_items", "chunks_written")]
    values = {
        "run_id": F.lit(run_id), "source_slug": F.col("source_name"), "started_at": started, "finished_at": finished,
        "status": F.when(F.col("error").isNull(), F.lit(COMPLETED)).otherwise(F.lit(FAILED)), "error": F.col("error"),
    } | {c: F.coalesce(c, F.lit(0)) for c in counts}
    return done.select(*(values[f.name].cast(f.dataType).alias(f.name) for f in RUNS.fields))


def collected(
    candidates: DataFrame, stored: DataFrame, relevance: Callable[[DataFrame], DataFrame], embedder: Embedder, run_id: str, started: Column, finished: Column,
    *, failures: DataFrame | None = None, summarize: Summarizer = fallback_card, count: TokenCounter = count_words, keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> Run:
    """One run over prepared, gated candidates (with their ``position``) and the stored articles.

    ``relevance`` adds ``tier`` to matched rows. ``keep`` is applied to the
    written rows, which everything else is made from: a run that writes them to
    a table first calls models once.
    """
    rows = keep(written(routed(relevance(matched(last_of_batch(candidates), stored))), ARTICLES.names, summarize, keep))
    chunks = keep(new_chunks(rows, embedder, count=count))
    return Run(rows, chunks, ledger(rows, chunks, failures, run_id, started, finished))


def stored(run: Run, articles: BatchTable, chunks: BatchTable, runs: BatchTable, batch: int, lease: Lease | None = None) -> None:
    """Write a run as a batch: articles, the chunks of touched ones, and last the ledger, a row a source.

    The ledger's batch makes the others count (``committed``). A batch that is
    run again, wherever it stopped, replaces what it wrote. With a lease, a run
    that has lost the lock raises before it commits.
    """
    chunks.put(run.chunks, batch, run.articles.where("drops_chunks").select(F.col("id").alias("document_id")))
    articles.put(run.articles.drop("route", "status", "drops_chunks"), batch)
    if lease:
        lease.check()
    runs.put(run.ledger, batch)


def committed(runs: BatchTable) -> int:
    """The last batch whose run is whole; readers of the other tables read up to it. -1 before the first."""
    return max(runs.batches(), default=-1)
