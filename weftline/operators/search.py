"""Hybrid retrieval: a vector leg, a keyword leg, their mixture, and diversity.

The vector leg is exact. Each leg reads its own columns and keeps its best rows
per task before anything moves; what is joined after that is tens of rows a leg.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keywords import keyword_score, normalized
from ..functions.scores import combined, cosine_similarity, display_similarity, keyword_normalized, recency
from ..sources.registry import slugs_with
from .feed import overlaps, visible

# Over-fetch of a leg, its least size, and passages of one document.
OVERFETCH, LEAST, PER_DOCUMENT = 5, 30, 2


@dataclass
class SearchRequest:
    """A search request; ranges are checked when it is made."""

    query: str
    as_of: Column
    top_k: int = 8
    search_mode: str = "hybrid"
    retrieval_strategy: str = "standard"
    include_contextual: bool = False
    source_names: list[str] = field(default_factory=list)
    tools: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    event_types: list[str] = field(default_factory=list)
    source_types: list[str] = field(default_factory=list)
    start: Column | None = None
    end: Column | None = None

    def __post_init__(self) -> None:
        if not self.query.strip():
            raise ValueError("the query is empty")
        if self.search_mode not in ("vector", "keyword", "hybrid"):
            raise ValueError("search_mode must be vector, keyword or hybrid")
        if self.retrieval_strategy not in ("standard", "source_balanced"):
            raise ValueError("retrieval_strategy must be standard or source_balanced")
        if not 1 <= self.top_k <= 50:
            raise ValueError("top_k must be 1 to 50")

    @property
    def leg(self) -> int:
        return max(self.top_k * OVERFETCH, LEAST)


def filtered(articles: DataFrame, sources: DataFrame, request: SearchRequest) -> DataFrame:
    """Visible articles that pass the filters; those without a date stay unless a bound is given."""
    rows = articles
    if request.source_names:
        rows = rows.where(F.col("source_name").isin(*request.source_names))
    if request.categories:
        rows = rows.where(F.col("primary_topic").isin(*request.categories))
    if request.event_types:
        rows = rows.where(overlaps(F.col("event_types"), request.event_types))
    if request.start is not None:
        rows = rows.where(F.col("published_at") >= request.start)
    if request.end is not None:
        rows = rows.where(F.col("published_at") <= request.end)
    allowed = sources
    if request.tools:
        allowed = allowed.where(F.col("tool").isin(*request.tools))
    if request.source_types:
        allowed = allowed.join(slugs_with(sources, "source_type", request.source_types, "official-release"), "slug", "left_semi")
    return visible(rows, allowed, request.include_contextual)


def passages(chunks: DataFrame, articles: DataFrame, sources: DataFrame, request: SearchRequest) -> DataFrame:
    """Chunks of the articles that pass, with what ranking needs of the article."""
    docs = filtered(articles, sources, request).select(F.col("id").alias("document_id"), "title", "source_name", "url", "published_at")
    return chunks.join(docs, "document_id")


def vector_leg(rows: DataFrame, query: DataFrame) -> DataFrame:
    """Passages that have a vector, with their similarity to the one row of ``query`` (column q)."""
    both = rows.where("embedding IS NOT NULL").crossJoin(F.broadcast(query.select("q").limit(1)))
    return both.withColumn("vector_similarity", cosine_similarity(F.col("embedding"), F.col("q"))).drop("q")


def keyword_leg(rows: DataFrame, query: str) -> DataFrame:
    """Passages with a keyword score other than zero."""
    return rows.withColumn("keyword_score", keyword_score(query, F.col("title"), F.col("content"))).where("keyword_score > 0")


def best(rows: DataFrame, score: str, most: int, by: str | None = None) -> DataFrame:
    """The best rows, ties to the smaller chunk id; of each ``by`` if given."""
    if by is None:
        return rows.orderBy(F.desc_nulls_last(score), "chunk_id").limit(most)
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last(score), "chunk_id"))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")


def candidates(rows: DataFrame, query: DataFrame | None, request: SearchRequest, vectors: DataFrame | None = None) -> DataFrame:
    """Both legs' best, one row a passage, with the scores that it has.

    The vector leg reads ids, sources and vectors alone (``vectors``, or the
    ``embedding`` of ``rows``) and asks for the contents of its best; the keyword
    leg never reads a vector. Source-balanced requests take each leg's best of
    every source.
    """
    balanced = request.retrieval_strategy == "source_balanced"
    by = "source_name" if balanced else None
    most = max(max(2, min(6, request.top_k)) * OVERFETCH, LEAST) if balanced else request.leg
    texts = rows.drop("embedding")
    legs = []
    if request.search_mode in ("vector", "hybrid") and query is not None:
        narrow = (rows if vectors is None else vectors).select("chunk_id", "source_name", "embedding")
        hits = best(vector_leg(narrow, query), "vector_similarity", most, by).select("chunk_id", "vector_similarity")
        # as many rows as the leg has, of each source if balanced
        legs.append(texts.join(F.broadcast(hits), "chunk_id").withColumn("keyword_score", F.lit(None).cast("double")))
    if request.search_mode in ("keyword", "hybrid"):
        legs.append(best(keyword_leg(texts, request.query), "keyword_score", most, by).withColumn("vector_similarity", F.lit(None).cast("double")))
    both = legs[0] if len(legs) == 1 else legs[0].unionByName(legs[1])
    keep = [c for c in texts.columns if c != "chunk_id"]
    merged = both.groupBy("chunk_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in keep), F.max("vector_similarity").alias("vector_similarity"), F.max("keyword_score").alias("keyword_score"))
    return merged.withColumn("recency_score", recency(F.col("published_at"), request.as_of))


def ranked(found: DataFrame, mode: str) -> DataFrame:
    """Candidates with their share of the best keyword score, the mixture, and the rank from 1.

    Candidates are tens of rows a leg and source, so one window may see all.
    """
    top = F.coalesce(F.max("keyword_score").over(Window.partitionBy()), F.lit(0.0))
    share = keyword_normalized(F.col("keyword_score"), F.col("_top"))
    rows = found.withColumn("_top", top).withColumn("combined_score", combined(F.col("vector_similarity"), share, F.col("recency_score"), mode))
    rows = rows.withColumn("keyword_normalized", F.round(share, 4)).drop("_top")
    rows = rows.withColumn("similarity", display_similarity(F.col("vector_similarity"), F.col("keyword_score"), F.col("keyword_normalized"), F.col("combined_score")))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("combined_score"), "chunk_id")))


def title_only(title: Column, content: Column) -> Column:
    """Whether a passage says no more than its title."""
    t = normalized(F.coalesce(title, F.lit("")))
    return (t != "") & (normalized(F.coalesce(content, F.lit(""))) == t)


def diversified(rows: DataFrame, top_k: int, per_document: int = PER_DOCUMENT) -> DataFrame:
    """At most two passages a document, in order; bare titles only where a document has nothing else."""
    bare = rows.withColumn("_bare", title_only(F.col("title"), F.col("content")))
    rest = bare.withColumn("_more", F.max(~F.col("_bare")).over(Window.partitionBy("document_id"))).where(~(F.col("_bare") & F.col("_more")))
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("rank"))
    return rest.withColumn("_nth", nth).where(F.col("_nth") <= per_document).orderBy("rank").limit(top_k).drop("_bare", "_more", "_nth")


def search(chunks: DataFrame, articles: DataFrame, sources: DataFrame, request: SearchRequest, query: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """The passages that a request retrieves, in order.

    ``vectors`` (chunk_id, document_id, embedding) if the chunks do not hold them.
    """
    rows = passages(chunks, articles, sources, request)
    own = None if vectors is None else passages(vectors, articles, sources, request)
    return diversified(ranked(candidates(rows, query, request, own), request.search_mode), request.top_k)


def weak(results: DataFrame, least: float) -> DataFrame:
    """One row: how many passages there are, the first one's similarity, and whether that is too little."""
    one = results.agg(F.count(F.lit(1)).alias("passages"), F.min_by("similarity", "rank").alias("top_similarity"))
    return one.withColumn("weak", (F.col("passages") == 0) | (F.coalesce("top_similarity", F.lit(0.0)) < least))


