"""Table schemas, controlled vocabularies and the checks that a write must pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The controlled vocabularies.
PUBLISHED = "published"
QUARANTINED = "quarantined"
RELEVANCE_TIERS = ("core", "contextual", "excluded")
PRIMARY_TOPICS = (
    "agentic-generative-ai",
    "machine-learning-classical-ai",
    "vision-speech-robotics",
    "data-search-retrieval",
    "ai-products-engineering-infrastructure",
    "safety-evaluation-governance",
)
EVENT_TYPES = ("release-update", "research", "guide", "analysis", "alert")
EXTRACTION_STATUSES = ("source_entry", "full_article", "feed_excerpt_only", "title_only")
DEFAULT_TOPIC = "developer-tools"
DEFAULT_SOURCE_TYPE = "official-release"
TITLE_LIMIT = 500


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


_s, _ts, _i, _labels = T.StringType(), T.TimestampType(), T.IntegerType(), T.ArrayType(T.StringType(), False)

ARTICLES = _schema(
    ("id", _s, False), ("source_name", _s, False), ("title", _s, False), ("url", _s, False), ("raw_text", _s, False),
    ("content_hash", _s, False), ("fetched_at", _ts, False), ("published_at", _ts, True), ("ingestion_status", _s, False),
    ("extraction_status", _s, False), ("relevance_tier", _s, True), ("relevance_reason", _s, True),
    ("relevance_policy_version", _s, True), ("primary_topic", _s, True), ("event_types", _labels, False),
    ("display_headline", _s, True), ("summary", _s, True), ("why_it_matters", _s, True), ("key_points", _labels, False),
    ("summary_generated_by", _s, True),
)
CHUNKS = _schema(
    ("id", _s, False), ("document_id", _s, False), ("chunk_index", _i, False), ("content", _s, False),
    ("embedding", T.ArrayType(T.FloatType()), False), ("token_count", _i, False), ("content_hash", _s, False),
)
RUNS = _schema(
    ("run_id", _s, False), ("source_slug", _s, False), ("started_at", _ts, False), ("finished_at", _ts, False),
    ("status", _s, False), ("matched_items", _i, False), ("updates_created", _i, False), ("updates_changed", _i, False),
    ("updates_unchanged", _i, False), ("updates_quarantined", _i, False), ("chunks_written", _i, False), ("error", _s, True),
)
REGISTRY = _schema(
    ("slug", _s, False), ("name", _s, False), ("organization", _s, False), ("tool", _s, False), ("homepage_url", _s, False),
    ("feed_url", _s, False), ("source_kind", _s, False), ("default_primary_topic", _s, False), ("source_type", _s, True),
    ("credibility_weight", T.DoubleType(), True), ("default_event_types", _labels, True), ("include_terms", _labels, True),
    ("exclude_title_prefixes", _labels, True), ("exclude_tags", _labels, True),
    ("require_published_date", T.BooleanType(), True), ("fetch_full_article", T.BooleanType(), True),
    ("link_pattern", _s, True), ("content_selector", _s, True), ("date_selector", _s, True),
    ("minimum_full_article_characters", _i, True),
)

#: What a managed column holds where a write leaves it out, or gives an empty value.
FIELD_DEFAULTS: dict[str, object] = {
    "ingestion_status": PUBLISHED,
    "extraction_status": "source_entry",
    "relevance_tier": None,
    "relevance_reason": None,
    "relevance_policy_version": None,
    "primary_topic": None,
    "event_types": [],
    "display_headline": None,
    "summary": None,
    "why_it_matters": None,
    "key_points": [],
    "summary_generated_by": None,
}


def managed(values: dict[str, Column]) -> dict[str, Column]:
    """All managed columns of a write: those given, empty ones and the rest at their defaults."""
    out = {}
    for name, default in FIELD_DEFAULTS.items():
        kind = ARTICLES[name].dataType
        if isinstance(default, list):
            empty = F.array().cast(kind)
            out[name] = F.coalesce(values[name], empty) if name in values else empty
        else:
            fallback = F.lit(default).cast("string")
            out[name] = F.coalesce(F.nullif(values[name], F.lit("")), fallback) if name in values else fallback
    return out


def subset(labels: Column, allowed: tuple[str, ...]) -> Column:
    """Whether every label is allowed."""
    return F.size(F.array_except(labels, F.array(*map(F.lit, allowed)))) == 0


def violations(articles: DataFrame) -> DataFrame:
    """Rows that break a constraint of the article table, with the names of those they break."""
    checks = {
        "title_length": F.length("title") <= TITLE_LIMIT,
        "ingestion_status": F.col("ingestion_status").isin(PUBLISHED, QUARANTINED),
        "extraction_status": F.col("extraction_status").isin(*EXTRACTION_STATUSES),
        "relevance_tier": F.col("relevance_tier").isNull() | F.col("relevance_tier").isin(*RELEVANCE_TIERS),
        "primary_topic": F.col("primary_topic").isNull() | F.col("primary_topic").isin(*PRIMARY_TOPICS),
        "event_types": subset(F.col("event_types"), EVENT_TYPES),
    }
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
    return articles.withColumn("violations", broken).where(F.size("violations") > 0)


def any_of(conditions: list[Column]) -> Column:
    """Their disjunction; false of none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
