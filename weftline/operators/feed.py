"""The ranked feed: visibility, filters, importance order, pages, statistics, facets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import importance
from ..functions.text import article_excerpt, falsy
from ..schemas import DEFAULT_TOPIC, PUBLISHED
from ..sources.registry import slugs_with, source_type, with_source

# Days of the windows; "all" has none.
WINDOW_DAYS = {"day": 1, "week": 7, "month": 30, "all": None}


@dataclass
class FeedRequest:
    """A feed request; ranges are checked when it is made."""

    as_of: Column
    window: str = "week"
    limit: int = 50
    offset: int = 0
    start: Column | None = None
    end: Column | None = None
    include_contextual: bool = False
    source_names: list[str] = field(default_factory=list)
    tools: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    event_types: list[str] = field(default_factory=list)
    source_types: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.window not in WINDOW_DAYS:
            raise ValueError(f"window must be one of {', '.join(WINDOW_DAYS)}")
        if not 1 <= self.limit <= 100 or self.offset < 0:
            raise ValueError("limit must be 1 to 100 and offset at least 0")


def window_start(window: str, end: Column) -> Column | None:
    days = WINDOW_DAYS[window]
    return None if days is None else end - F.expr(f"INTERVAL {days} DAYS")


def visible(articles: DataFrame, sources: DataFrame, include_contextual: bool = False) -> DataFrame:
    """Published articles of registered sources in a tier that shows."""
    tiers = ("core", "contextual") if include_contextual else ("core",)
    rows = articles.where((F.col("ingestion_status") == PUBLISHED) & F.col("relevance_tier").isin(*tiers))
    return rows.join(sources.select(F.col("slug").alias("source_name")), "source_name", "left_semi")


def overlaps(labels: Column, wanted: list[str]) -> Column:
    """Whether an array has any of the labels; false for null."""
    return F.coalesce(F.arrays_overlap(labels, F.array(*map(F.lit, wanted))), F.lit(False))


def of_sources(articles: DataFrame, slugs: DataFrame) -> DataFrame:
    return articles.join(slugs.select(F.col("slug").alias("source_name")), "source_name", "left_semi")


def matching(articles: DataFrame, sources: DataFrame, request: FeedRequest) -> DataFrame:
    """Visible articles in the window that pass the request's filters."""
    end = request.end if request.end is not None else request.as_of
    start = request.start if request.start is not None else window_start(request.window, end)
    rows = articles.where(F.col("published_at") <= end)
    if start is not None:
        rows = rows.where(F.col("published_at") >= start)
    if request.source_names:
        rows = rows.where(F.col("source_name").isin(*request.source_names))
    if request.categories:
        rows = rows.where(F.coalesce("primary_topic", F.lit(DEFAULT_TOPIC)).isin(*request.categories))
    if request.event_types:
        rows = rows.where(overlaps(F.col("event_types"), request.event_types))
    allowed = sources
    if request.tools:
        allowed = allowed.where(F.col("tool").isin(*request.tools))
    if request.source_types:
        allowed = allowed.join(slugs_with(sources, "source_type", request.source_types, "official-release"), "slug", "left_semi")
    return visible(rows, allowed, request.include_contextual)


def scored(articles: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """Articles with their source's attributes and their importance."""
    rows = with_source(articles, sources, "organization", "tool", "source_type", "credibility_weight")
    return rows.withColumn("importance_score", importance(F.col("credibility_weight"), F.col("published_at"), F.col("raw_text"), as_of))


#: The feed's order: importance, then the newest, then the largest id.
ORDER = [F.desc, F.desc_nulls_last, F.desc]
ORDER_COLUMNS = ("importance_score", "published_at", "id")


def ranked(articles: DataFrame) -> list[Column]:
    return [f(c) for f, c in zip(ORDER, ORDER_COLUMNS, strict=True)]


def items(articles: DataFrame, as_of: Column) -> DataFrame:
    """What the feed shows of scored articles; empty fields fall back as null ones do."""
    excerpt = article_excerpt(F.col("title"), F.col("raw_text"))
    return articles.select(
        "id", "title", "url", "source_name",
        falsy(F.col("organization"), F.lit("unknown")).alias("organization"), falsy(F.col("tool"), F.lit("unknown")).alias("tool"),
        falsy(F.col("primary_topic"), F.lit(DEFAULT_TOPIC)).alias("primary_topic"), "event_types",
        source_type(F.col("source_type")).alias("source_type"), "relevance_tier",
        F.coalesce("relevance_reason", F.lit("")).alias("relevance_reason"), excerpt.alias("excerpt"),
        falsy(F.col("display_headline"), F.col("title")).alias("display_headline"), falsy(F.col("summary"), excerpt).alias("summary"),
        F.coalesce("why_it_matters", F.lit("")).alias("why_it_matters"), "key_points",
        F.coalesce("published_at", as_of).alias("published_at"), F.coalesce("fetched_at", as_of).alias("fetched_at"), "importance_score",
    )


def page(articles: DataFrame, sources: DataFrame, request: FeedRequest) -> DataFrame:
    """One page of the feed, in order.

    Ids are ranked first, by score and time alone: the sort keeps offset + limit
    narrow rows a task, and only the page's rows are read whole. An id names one
    article.
    """
    rows = scored(matching(articles, sources, request), sources, request.as_of)
    keys = rows.select("id", "importance_score", "published_at")
    top = keys.orderBy(*ranked(keys)).offset(request.offset).limit(request.limit) if request.offset else keys.orderBy(*ranked(keys)).limit(request.limit)
    # at most 100 ids, so the page's rows are found by a broadcast of them
    shown = articles.join(F.broadcast(top.select("id", "importance_score")), "id")
    with_names = with_source(shown, sources, "organization", "tool", "source_type")
    return items(with_names.orderBy(*ranked(with_names)), request.as_of)


def after(articles: DataFrame, sources: DataFrame, request: FeedRequest, last: tuple) -> DataFrame:
    """The page that follows a row (its importance, time or None, and id): no row before it is kept, however deep the page lies."""
    score, time, id_ = last
    rows = scored(matching(articles, sources, request), sources, request.as_of)
    t = F.col("published_at")
    later = F.lit(False) if time is None else (t < F.lit(time)) | t.isNull() | ((t == F.lit(time)) & (F.col("id") < id_))
    if time is None:
        later = t.isNull() & (F.col("id") < id_)
    keys = rows.select("id", "importance_score", "published_at").where((F.col("importance_score") < score) | ((F.col("importance_score") == score) & later))
    top = keys.orderBy(*ranked(keys)).limit(request.limit)
    shown = with_source(articles.join(F.broadcast(top.select("id", "importance_score")), "id"), sources, "organization", "tool", "source_type")
    return items(shown.orderBy(*ranked(shown)), request.as_of)


def compact(page: DataFrame, first: int = 6) -> DataFrame:
    """What a client shows of a page before it is opened: its first rows, in order."""
    return page.orderBy(*ranked(page)).limit(first)


def stats(articles: DataFrame, sources: DataFrame, request: FeedRequest) -> DataFrame:
    """Totals over everything that matches, whatever the page."""
    rows = with_source(matching(articles, sources, request), sources, "tool")
    return rows.agg(
        F.count(F.lit(1)).alias("total_updates"),
        F.countDistinct("source_name").alias("source_count"),
        F.countDistinct(F.coalesce("tool", F.lit("unknown"))).alias("tool_count"),
        F.countDistinct(falsy(F.col("primary_topic"), F.lit(DEFAULT_TOPIC))).alias("topic_count"),
        F.max("published_at").alias("latest_published_at"),
    )


def facets(articles: DataFrame, sources: DataFrame, include_contextual: bool = False) -> DataFrame:
    """(facet, value): the registry's sources and tools, and what visible articles hold, whatever the window."""
    rows = with_source(visible(articles, sources, include_contextual), sources, "source_type")
    held = rows.select(
        F.explode(
            F.concat(
                F.array(
                    F.struct(F.lit("categories").alias("facet"), falsy(F.col("primary_topic"), F.lit(DEFAULT_TOPIC)).alias("value")),
                    F.struct(F.lit("source_types").alias("facet"), source_type(F.col("source_type")).alias("value")),
                ),
                F.transform("event_types", lambda e: F.struct(F.lit("event_types").alias("facet"), e.alias("value"))),
            )
        ).alias("x")
    ).select("x.*")
    known = sources.select(F.explode(F.array(F.struct(F.lit("sources").alias("facet"), F.col("slug").alias("value")), F.struct(F.lit("tools").alias("facet"), F.col("tool").alias("value")))).alias("x")).select("x.*")
    return held.union(known).distinct().orderBy("facet", "value")


def census(articles: DataFrame) -> DataFrame:
    """Articles by source, status and tier."""
    return articles.groupBy("source_name", "ingestion_status", "relevance_tier").agg(F.count(F.lit(1)).alias("articles"))


def quarantine_census(articles: DataFrame) -> DataFrame:
    """Quarantined articles by source and extraction status."""
    return articles.where(F.col("ingestion_status") != PUBLISHED).groupBy("source_name", "extraction_status").agg(F.count(F.lit(1)).alias("articles"))
