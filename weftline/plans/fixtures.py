"""The driver's tables in the shapes that the engine works on, in Spark and in SQL.

Attributes that the tables do not have are arithmetic on ids, the same on either
side. Times are instants; sessions run in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EVENT_TYPES, EXTRACTION_STATUSES, PRIMARY_TOPICS

#: 2024-01-01 and 2024-02-01.
FIRST, AS_OF = 1704067200, 1706745600
SOURCES = 19  # src0 to src18; src19 is not registered
#: Characters of a passage, from one to the next, and the numbers that a document's passages have.
WINDOW, STEP, PER_DOCUMENT = 600, 400, 1_000_000
SOURCE_TYPES = (None, "engineering-blog", "official-release", "analysis")


def as_of() -> Column:
    return F.timestamp_seconds(F.lit(AS_OF))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(n: Column, values: tuple) -> Column:
    """values[n], null beyond them."""
    return F.get(F.array(*(F.lit(v) for v in values)), n.cast("int"))


def registry(spark: SparkSession) -> DataFrame:
    n = F.col("id")
    s = lambda x: n.cast("string") if x is None else (n % x).cast("string")
    return spark.range(SOURCES, numPartitions=1).select(
        F.concat(F.lit("src"), s(None)).alias("slug"), F.concat(F.lit("org"), s(5)).alias("organization"), F.concat(F.lit("tool"), s(7)).alias("tool"),
        pick(n % 3, (0.9, 0.95, 1.0)).alias("credibility_weight"), pick(n % 4, SOURCE_TYPES).alias("source_type"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").withColumn("line", F.substring_index(text, "\n", 1))
    docs = docs.withColumn("title", F.substring("line", 1, 500))
    # all that follows the title, whether the first line goes on or ends there
    after = F.length("title") + 1
    rest = text.substr(F.when(text.substr(after, F.lit(1)) == "\n", after + 1).otherwise(after), F.length(text))
    docs = docs.withColumn("raw_text", F.btrim(F.concat("title", F.lit("\n\n"), rest), F.lit(" \t\n\x0b\f\r")))
    published = F.when(d % 50 != 49, F.timestamp_seconds(F.lit(FIRST) + (d * 7919 % 43200) * 60))
    return docs.select(
        d.cast("string").alias("id"), d.alias("doc_id"), F.col("source").alias("source_name"), "title", F.concat(F.lit("https://src.example/"), d.cast("string")).alias("url"),
        "raw_text", published.alias("published_at"), (F.coalesce(published, F.timestamp_seconds(F.lit(FIRST))) + F.expr("INTERVAL 1 DAY")).alias("fetched_at"),
        F.when(d % 13 == 0, F.lit("quarantined")).otherwise(F.lit("published")).alias("ingestion_status"),
        pick(d % 4, EXTRACTION_STATUSES).alias("extraction_status"), pick(d % 10, ("core",) * 6 + ("contextual",) * 2 + ("excluded",)).alias("relevance_tier"),
        F.lit(None).cast("string").alias("relevance_reason"), pick(d % 7, PRIMARY_TOPICS).alias("primary_topic"),
        F.when(d % 6 < 5, F.array(pick(d % 6, EVENT_TYPES))).otherwise(F.array().cast("array<string>")).alias("event_types"),
        pick(d % 3, (None, "", "Headline")).alias("display_headline"), pick(d % 3, ("", "Summary", None)).alias("summary"),
        F.lit(None).cast("string").alias("why_it_matters"), F.array().cast("array<string>").alias("key_points"),
    )


def chunks(docs: DataFrame, *more: str) -> DataFrame:
    """The title and the whole text of every document as passages: windows of WINDOW characters, STEP apart; with ``more`` columns of the document."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("raw_text") - (WINDOW - STEP)), F.lit(STEP))
    windows = F.transform(starts, lambda s: F.col("raw_text").substr(s, F.lit(WINDOW)))
    rows = docs.select("doc_id", F.col("id").alias("document_id"), *more, F.posexplode(F.concat(F.array("title"), windows)).alias("chunk_index", "content"))
    return rows.select((F.col("doc_id") * PER_DOCUMENT + F.col("chunk_index")).alias("chunk_id"), "document_id", *more, "chunk_index", "content")


def vectors(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """The vectors of passages: the first three of a document have those of its number, where the table has them."""
    v = F.col("vec_id")
    own = table(spark, sf_dir, "embeddings").select(F.floor(v / 3).cast("long").alias("doc_id"), (v % 3).alias("nth"), "embedding")
    many = 1 + F.size(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("raw_text") - (WINDOW - STEP)), F.lit(STEP)))
    there = docs.select("doc_id", F.col("id").alias("document_id"), many.alias("many"))
    return own.join(there, "doc_id").where("nth < many").select((F.col("doc_id") * PER_DOCUMENT + F.col("nth")).alias("chunk_id"), "document_id", "embedding")


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as failed runs, purchases as completed ones, and all as requests."""
    e, kind = F.col("event_id"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "value", "props",
        F.when(kind == "error", F.lit("collection_failed")).when(kind == "purchase", F.lit("collection_completed")).otherwise(kind).alias("event"),
        F.when((kind == "purchase") & (e % 5 == 0), F.lit("failed")).otherwise(F.lit("success")).alias("status"),
        F.when(kind == "view", F.lit("/health/live")).otherwise(F.lit("/updates")).alias("path"),
        F.when(kind == "error", 503).when(kind == "signup", 201).otherwise(200).alias("http_status"),
        F.floor(F.col("value") * 20).cast("long").alias("duration_ms"),
    )


def _case(n: str, values: tuple) -> str:
    quoted = ("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" for v in values)
    return f"CASE {n} " + " ".join(f"WHEN {k} THEN {q}" for k, q in enumerate(quoted)) + " END"


REGISTRY_SQL = f"""registry AS (
  SELECT 'src' || n AS slug, 'org' || (n % 5) AS organization, 'tool' || (n % 7) AS tool,
         {_case("n % 3", (0.9, 0.95, 1.0))} AS credibility_weight, {_case("n % 4", SOURCE_TYPES)} AS source_type
  FROM range({SOURCES}) AS t(n))"""

ARTICLES_SQL = rf"""lines AS (
  SELECT *, coalesce(text, '') AS t, split_part(coalesce(text, ''), chr(10), 1) AS line FROM documents),
titled AS (
  SELECT *, substr(line, 1, 500) AS title, CASE WHEN length(line) <= 500 THEN substr(t, length(line) + 2) ELSE substr(t, 501) END AS rest FROM lines),
articles AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, source AS source_name, title, 'https://src.example/' || doc_id AS url,
         regexp_replace(title || chr(10) || chr(10) || rest, '^\s+|\s+$', '', 'g') AS raw_text,
         CASE WHEN doc_id % 50 <> 49 THEN {FIRST} + (doc_id * 7919 % 43200) * 60 END AS published,
         CASE WHEN doc_id % 13 = 0 THEN 'quarantined' ELSE 'published' END AS ingestion_status,
         {_case("doc_id % 4", EXTRACTION_STATUSES)} AS extraction_status,
         {_case("doc_id % 10", ("core",) * 6 + ("contextual",) * 2 + ("excluded",))} AS relevance_tier,
         {_case("doc_id % 7", PRIMARY_TOPICS)} AS primary_topic, {_case("doc_id % 6", EVENT_TYPES)} AS event,
         {_case("doc_id % 3", (None, "", "Headline"))} AS display_headline, {_case("doc_id % 3", ("", "Summary", None))} AS summary
  FROM titled)"""

#: The body after the title, and a text collapsed.
BODY_SQL = r"regexp_replace(CASE WHEN length(title) > 0 AND starts_with(raw_text, title) THEN substr(raw_text, length(title) + 1) ELSE raw_text END, '^\s+|\s+$', '', 'g')"


def collapse_sql(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def normalized_sql(x: str) -> str:
    return collapse_sql(f"regexp_replace(lower({x}), '[-_/]+', ' ', 'g')")


def excerpt_sql(x: str) -> str:
    c = collapse_sql(x)
    return f"CASE WHEN length({c}) <= 420 THEN {c} ELSE rtrim(substr({c}, 1, 419)) || '...' END"


def shorten_sql(x: str, limit: int) -> str:
    room = limit - 3
    head = f"rtrim(substr({x}, 1, {room}))"
    last = f"(length({head}) - strpos(reverse({head}), ' '))"
    return f"CASE WHEN length({x}) <= {limit} THEN {x} WHEN strpos({head}, ' ') > 0 AND {last} >= {max(room // 2, 1)} THEN rtrim(substr({head}, 1, {last})) || '...' ELSE {head} || '...' END"


IMPORTANCE_SQL = f"""round(coalesce(credibility_weight, CAST(1 AS DOUBLE)) * CAST(0.45 AS DOUBLE)
  + exp(-(greatest(CAST(0 AS DOUBLE), CAST({AS_OF} - coalesce(published, {AS_OF}) AS DOUBLE) / CAST(86400 AS DOUBLE))) / CAST(21 AS DOUBLE)) * CAST(0.45 AS DOUBLE)
  + least(CAST(length(raw_text) AS DOUBLE) / CAST(4000 AS DOUBLE), CAST(1 AS DOUBLE)) * CAST(0.10 AS DOUBLE), 4)"""
RECENCY_SQL = f"CASE WHEN published IS NULL THEN CAST(0 AS DOUBLE) ELSE round(exp(-(greatest(CAST(0 AS DOUBLE), CAST({AS_OF} - published AS DOUBLE) / CAST(86400 AS DOUBLE))) / CAST(21 AS DOUBLE)), 4) END"


def visible_sql(contextual: bool) -> str:
    tiers = "('core', 'contextual')" if contextual else "('core')"
    return f"ingestion_status = 'published' AND relevance_tier IN {tiers} AND source_name IN (SELECT slug FROM registry)"


SOURCED_SQL = """sourced AS (
  SELECT a.*, r.organization, r.tool, r.source_type, r.credibility_weight FROM articles a LEFT JOIN registry r ON a.source_name = r.slug)"""
