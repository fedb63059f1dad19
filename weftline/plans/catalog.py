"""The registered queries, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, display, documents, redact, scores, taxonomy, text, urls
from ..functions.chunking import chunks as chunked
from ..functions.quotes import quotes_supported
from ..operators import collection, context, feed, gate, indexes, ingest, search
from ..providers import HashedEmbedder
from ..schemas import PRIMARY_TOPICS
from ..sources import feeds, fetch, html, logs, store
from ..streaming import windows
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: What the fixtures' invented prose has, in place of the English vocabularies.
SEARCH = "that thing tion-est que"
TOPIC_WORDS = {
    "agentic-generative-ai": ("the", "ing", "of the"),
    "vision-speech-robotics": ("und", "die", "der"),
    "data-search-retrieval": ("que", "de", "les"),
    "safety-evaluation-governance": ("la", "los", "para"),
}
EVENT_WORDS = {"alert": ("thing", "ation"), "research": ("keit", "ung"), "guide": ("ment", "eau"), "analysis": ("ción",)}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return X.articles(spark, sf_dir), X.registry(spark)


def with_cte(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = (X.REGISTRY_SQL, X.ARTICLES_SQL, X.SOURCED_SQL)
_TOPIC = "coalesce(primary_topic, 'developer-tools')"


# --- feed -----------------------------------------------------------------

ITEM_COLUMNS = ("id", "title", "url", "source_name", "organization", "tool", "primary_topic", "source_type", "relevance_tier", "excerpt", "display_headline", "summary", "importance_score")


def shown(page: DataFrame) -> DataFrame:
    return page.select(*ITEM_COLUMNS, F.array_join("event_types", ",").alias("event_types"), F.unix_seconds("published_at").alias("published_unix"))


def page_sql(where: str, contextual: bool, limit: int, offset: int = 0) -> str:
    excerpt = X.excerpt_sql(f"coalesce(nullif({X.BODY_SQL}, ''), title)")
    return (
        with_cte(*BASE)
        + f"""SELECT id, title, url, source_name, coalesce(organization, 'unknown') AS organization, coalesce(tool, 'unknown') AS tool,
  {_TOPIC} AS primary_topic, coalesce(source_type, 'official-release') AS source_type, relevance_tier, {excerpt} AS excerpt,
  coalesce(nullif(display_headline, ''), title) AS display_headline, coalesce(nullif(summary, ''), {excerpt}) AS summary,
  {X.IMPORTANCE_SQL} AS importance_score, coalesce(event, '') AS event_types, published AS published_unix
FROM sourced WHERE {X.visible_sql(contextual)} AND published <= {X.AS_OF} AND {where}
ORDER BY importance_score DESC, published DESC, id DESC LIMIT {limit} OFFSET {offset}"""
    )


def since(days: int) -> str:
    return f"published >= {X.AS_OF - days * 86400}"


@query(page_sql(since(30), False, 50))
def feed_top_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(feed.page(*both(spark, sf_dir), feed.FeedRequest(X.as_of(), window="month", limit=50)))


@query(page_sql(since(7), True, 20, 5))
def feed_offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(feed.page(*both(spark, sf_dir), feed.FeedRequest(X.as_of(), window="week", limit=20, offset=5, include_contextual=True)))


@query(
    page_sql(
        f"tool IN ('tool1', 'tool2', 'tool3') AND {_TOPIC} IN ('developer-tools', 'data-search-retrieval', 'agentic-generative-ai') AND event IN ('alert', 'guide', 'research') AND coalesce(source_type, 'official-release') IN ('official-release', 'analysis')",
        True,
        100,
    )
)
def feed_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = feed.FeedRequest(
        X.as_of(), window="all", limit=100, include_contextual=True, tools=["tool1", "tool2", "tool3"],
        categories=["developer-tools", "data-search-retrieval", "agentic-generative-ai"], event_types=["alert", "guide", "research"],
        source_types=["official-release", "analysis"],
    )
    return shown(feed.page(*both(spark, sf_dir), request))


@query(
    with_cte(*BASE)
    + f"""SELECT count(*) AS total_updates, count(DISTINCT source_name) AS source_count, count(DISTINCT coalesce(tool, 'unknown')) AS tool_count,
  count(DISTINCT {_TOPIC}) AS topic_count, max(published) AS latest_published_unix
FROM sourced WHERE {X.visible_sql(False)} AND published <= {X.AS_OF} AND {since(30)}"""
)
def feed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feed.stats(*both(spark, sf_dir), feed.FeedRequest(X.as_of(), window="month"))
    return out.withColumn("latest_published_unix", F.unix_seconds("latest_published_at")).drop("latest_published_at")


@query(
    with_cte(*BASE)
    + f""", v AS (SELECT * FROM sourced WHERE {X.visible_sql(True)})
SELECT 'categories' AS facet, {_TOPIC} AS value FROM v UNION SELECT 'source_types', coalesce(source_type, 'official-release') FROM v
UNION SELECT 'event_types', event FROM v WHERE event IS NOT NULL UNION SELECT 'sources', slug FROM registry UNION SELECT 'tools', tool FROM registry"""
)
def feed_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.facets(*both(spark, sf_dir), include_contextual=True)


@query(with_cte(X.ARTICLES_SQL) + "SELECT source_name, ingestion_status, relevance_tier, count(*) AS articles FROM articles GROUP BY ALL")
def visibility_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.census(X.articles(spark, sf_dir))


@query(with_cte(X.ARTICLES_SQL) + "SELECT source_name, extraction_status, count(*) AS articles FROM articles WHERE ingestion_status <> 'published' GROUP BY ALL")
def quarantine_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.quarantine_census(X.articles(spark, sf_dir))


@query(with_cte(X.ARTICLES_SQL) + f"SELECT id, {X.excerpt_sql(f'coalesce(nullif({X.BODY_SQL}, {chr(39) * 2}), title)')} AS excerpt FROM articles")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.articles(spark, sf_dir).select("id", text.article_excerpt(F.col("title"), F.col("raw_text")).alias("excerpt"))


# --- retrieval ------------------------------------------------------------

_TERMS = ("that", "thing", "tion", "est", "que")
_SUM = lambda x: " + ".join(f"CAST(contains({x}, '{t}') AS INTEGER)" for t in _TERMS)
PASSAGES_SQL = f"""passages AS (
  SELECT a.doc_id * {X.PER_DOCUMENT} + a.chunk_index AS chunk_id, a.id AS document_id, a.chunk_index, a.title, a.source_name, a.url, a.published,
         CASE a.chunk_index WHEN 0 THEN a.title ELSE substr(a.raw_text, 1 + {X.STEP} * (a.chunk_index - 1), {X.WINDOW}) END AS content,
         round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 4) AS vs, {X.RECENCY_SQL} AS recency_score
  FROM (SELECT *, unnest(range(CAST(2 + greatest(0, length(raw_text) - {X.WINDOW - X.STEP} - 1) // {X.STEP} AS BIGINT))) AS chunk_index FROM articles WHERE {X.visible_sql(True)}) a
  LEFT JOIN embeddings e ON a.chunk_index < 3 AND e.vec_id = 3 * a.doc_id + a.chunk_index),
normal AS (SELECT *, {X.normalized_sql("title")} AS nt, {X.normalized_sql("content")} AS nc FROM passages),
worded AS (
  SELECT *, round(CAST({_SUM("nc")} AS DOUBLE) / CAST(5 AS DOUBLE) + CAST({_SUM("nt")} AS DOUBLE) / CAST(5 AS DOUBLE)
    + CASE WHEN contains(nt || chr(10) || nc, 'that thing tion est que') THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 4) AS ks FROM normal)"""


def legs_sql(by: str = "", most: int = 40) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""vleg AS (SELECT * FROM (SELECT *, row_number() OVER ({part}ORDER BY vs DESC NULLS LAST, chunk_id) AS vn FROM worded WHERE vs IS NOT NULL) WHERE vn <= {most}),
kleg AS (SELECT * FROM (SELECT *, row_number() OVER ({part}ORDER BY ks DESC, chunk_id) AS kn FROM worded WHERE ks > 0) WHERE kn <= {most}),
found AS (
  SELECT w.chunk_id, w.document_id, w.title, w.source_name, w.url, w.content, w.published, w.recency_score, w.nt, w.nc, v.vs AS vector_similarity, k.ks AS keyword_score
  FROM worded w LEFT JOIN vleg v ON w.chunk_id = v.chunk_id LEFT JOIN kleg k ON w.chunk_id = k.chunk_id WHERE v.chunk_id IS NOT NULL OR k.chunk_id IS NOT NULL),
shares AS (SELECT *, CASE WHEN max(keyword_score) OVER () > 0 AND keyword_score IS NOT NULL THEN keyword_score / max(keyword_score) OVER () ELSE CAST(0 AS DOUBLE) END AS share FROM found),
mixed AS (SELECT *, coalesce(vector_similarity, 0) * CAST(0.60 AS DOUBLE) + share * CAST(0.25 AS DOUBLE) + recency_score * CAST(0.15 AS DOUBLE) AS combined_score FROM shares),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY combined_score DESC, chunk_id) AS rank,
         round(CASE WHEN vector_similarity IS NOT NULL AND keyword_score IS NOT NULL THEN combined_score ELSE coalesce(vector_similarity, round(share, 4)) END, 4) AS similarity FROM mixed)"""


DIVERSE_SQL = """bare AS (SELECT *, (nt <> '' AND nc = nt) AS b FROM ranked),
rest AS (SELECT * FROM (SELECT *, bool_or(NOT b) OVER (PARTITION BY document_id) AS more FROM bare) WHERE NOT (b AND more)),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY rank) AS nth FROM rest) WHERE nth <= 2),
results AS (SELECT * FROM kept ORDER BY rank LIMIT 8)"""
RESULT_SQL = "SELECT chunk_id, document_id, vector_similarity, keyword_score, recency_score, round(combined_score, 6) AS combined_score, similarity, CAST(rank AS INTEGER) AS rank FROM "
RETRIEVAL = (X.REGISTRY_SQL, X.ARTICLES_SQL, PASSAGES_SQL)


def request(**more) -> search.SearchRequest:
    return search.SearchRequest(SEARCH, X.as_of(), include_contextual=True, **more)


def rows_for(spark: SparkSession, sf_dir: str, r: search.SearchRequest) -> DataFrame:
    docs, sources = both(spark, sf_dir)
    return search.passages(X.chunks(docs), docs, sources, r)


def vectors_for(spark: SparkSession, sf_dir: str, r: search.SearchRequest) -> DataFrame:
    docs, sources = both(spark, sf_dir)
    return search.passages(X.vectors(spark, sf_dir, docs), docs, sources, r)


def results(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_id", "document_id", "vector_similarity", "keyword_score", "recency_score", F.round("combined_score", 6).alias("combined_score"), "similarity", "rank")


@query(with_cte(*RETRIEVAL, legs_sql()) + "SELECT chunk_id, document_id, vs AS vector_similarity FROM vleg")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = request()
    rows = search.vector_leg(vectors_for(spark, sf_dir, r), X.query_vector(spark, sf_dir))
    return search.best(rows, "vector_similarity", r.leg).select("chunk_id", "document_id", "vector_similarity")


@query(with_cte(*RETRIEVAL, legs_sql()) + "SELECT chunk_id, document_id, ks AS keyword_score FROM kleg")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = request()
    return search.best(search.keyword_leg(rows_for(spark, sf_dir, r), r.query), "keyword_score", r.leg).select("chunk_id", "document_id", "keyword_score")


@query(with_cte(*RETRIEVAL, legs_sql()) + "SELECT chunk_id, document_id, ks AS keyword_score FROM kleg")
def keyword_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``keyword_topk`` from a stored index of all articles' passages."""
    r = request()
    docs, sources = both(spark, sf_dir)
    index = indexes.KeywordIndex.built(X.chunks(docs, "title"), store.scratch(spark, "keywords"))
    allowed = search.filtered(docs, sources, r).select(F.col("id").alias("document_id"))
    # scored as they are read, so no text moves after that
    rows = search.keyword_leg(index.candidates(r.query), r.query).select("chunk_id", "document_id", "keyword_score")
    return search.best(rows.join(allowed, "document_id", "left_semi"), "keyword_score", r.leg).select("chunk_id", "document_id", "keyword_score")


@query(with_cte(*RETRIEVAL, legs_sql()) + "SELECT chunk_id, document_id, vs AS vector_similarity FROM vleg")
def vector_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vector_topk`` from a stored index of all vectors."""
    r = request()
    docs, sources = both(spark, sf_dir)
    index = indexes.VectorIndex.built(X.vectors(spark, sf_dir, docs), store.scratch(spark, "vectors"))
    allowed = search.filtered(docs, sources, r).select(F.col("id").alias("document_id"))
    return index.best(X.query_vector(spark, sf_dir).first().q, r.leg, allowed).select("chunk_id", "document_id", "vector_similarity")


@query(with_cte(*RETRIEVAL, legs_sql()) + RESULT_SQL + "ranked")
def hybrid_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = request()
    return results(search.ranked(search.candidates(rows_for(spark, sf_dir, r), X.query_vector(spark, sf_dir), r, vectors_for(spark, sf_dir, r)), "hybrid"))


def retrieved(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    docs, sources = both(spark, sf_dir)
    return search.search(X.chunks(docs), docs, sources, request(**more), X.query_vector(spark, sf_dir), X.vectors(spark, sf_dir, docs))


@query(with_cte(*RETRIEVAL, legs_sql(), DIVERSE_SQL) + RESULT_SQL + "results")
def hybrid_diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(retrieved(spark, sf_dir))


@query(with_cte(*RETRIEVAL, legs_sql("source_name", 30), DIVERSE_SQL) + RESULT_SQL + "results")
def source_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(retrieved(spark, sf_dir, retrieval_strategy="source_balanced"))


@query(with_cte(*RETRIEVAL, legs_sql(), DIVERSE_SQL) + "SELECT count(*) AS passages, arg_min(similarity, rank) AS top_similarity, count(*) = 0 OR coalesce(arg_min(similarity, rank), 0) < 0.9 AS weak FROM results")
def weak_retrieval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.weak(retrieved(spark, sf_dir), 0.9)


@query(with_cte(*RETRIEVAL, legs_sql().replace("coalesce(vector_similarity, 0) * CAST(0.60 AS DOUBLE) + share * CAST(0.25 AS DOUBLE) + recency_score * CAST(0.15 AS DOUBLE)", "coalesce(vector_similarity, 0)").replace("WHERE ks > 0", "WHERE FALSE"), DIVERSE_SQL) + RESULT_SQL + "results")
def search_by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(retrieved(spark, sf_dir, search_mode="vector"))


@query(with_cte(*RETRIEVAL, legs_sql().replace("coalesce(vector_similarity, 0) * CAST(0.60 AS DOUBLE) + share * CAST(0.25 AS DOUBLE) + recency_score * CAST(0.15 AS DOUBLE)", "share").replace("WHERE vs IS NOT NULL", "WHERE FALSE"), DIVERSE_SQL) + RESULT_SQL + "results")
def search_by_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(retrieved(spark, sf_dir, search_mode="keyword"))


_FILTERED = f"""filtered AS (SELECT w.* FROM worded w JOIN articles a ON w.document_id = a.id JOIN registry r ON r.slug = w.source_name
  WHERE a.source_name IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6') AND a.primary_topic IN ('data-search-retrieval', 'safety-evaluation-governance', 'vision-speech-robotics')
    AND a.event IN ('alert', 'guide', 'research') AND r.tool IN ('tool1', 'tool2', 'tool4', 'tool5', 'tool6') AND coalesce(r.source_type, 'official-release') IN ('official-release', 'analysis', 'engineering-blog')
    AND a.published >= {X.FIRST + 2 * 86400} AND a.published <= {X.FIRST + 29 * 86400})"""


@query(with_cte(*RETRIEVAL, _FILTERED, legs_sql().replace("worded", "filtered"), DIVERSE_SQL) + RESULT_SQL + "results")
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filter of a search at once, and both bounds of time."""
    more = dict(
        source_names=[f"src{k}" for k in range(1, 7)], categories=["data-search-retrieval", "safety-evaluation-governance", "vision-speech-robotics"], event_types=["alert", "guide", "research"],
        tools=["tool1", "tool2", "tool4", "tool5", "tool6"], source_types=["official-release", "analysis", "engineering-blog"],
    )
    return results(retrieved(spark, sf_dir, start=F.timestamp_seconds(F.lit(X.FIRST + 2 * 86400)), end=F.timestamp_seconds(F.lit(X.FIRST + 29 * 86400)), **more))


_TOKENS = r"len(regexp_extract_all(b, '[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}\s]'))"
_BLOCK = r"""chr(10) || r.title || chr(10) || 'Source: ' || r.source_name || chr(10) || 'Published: ' || coalesce(strftime(to_timestamp(r.published) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S'), 'unknown') || chr(10) || 'Tool: ' || coalesce(g.tool, 'unknown') || chr(10) || 'URL: ' || r.url || chr(10) || r.content"""


@query(
    with_cte(
        *RETRIEVAL, legs_sql(), DIVERSE_SQL,
        "again AS (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(rtrim(lower(trim(coalesce(url, ''))), '/'), ''), document_id) ORDER BY rank) > 1 AS later FROM results)",
        "turns AS (SELECT *, row_number() OVER (ORDER BY later, rank) AS place FROM again)",
        f"""shown AS (SELECT r.place, r.chunk_id, substr({_BLOCK}, 2) AS rest FROM turns r LEFT JOIN registry g ON g.slug = r.source_name)""",
        f"""packed AS (
  SELECT 0::BIGINT AS place, CAST([] AS VARCHAR[]) AS chunk_ids, 0::BIGINT AS tokens, '' AS context
  UNION ALL
  SELECT s.place, CASE WHEN fits THEN list_append(chunk_ids, CAST(s.chunk_id AS VARCHAR)) ELSE chunk_ids END, CASE WHEN fits THEN tokens + n ELSE tokens END, CASE WHEN fits THEN context || b ELSE context END
  FROM (SELECT *, len(chunk_ids) = 0 OR tokens + n <= 600 AS fits FROM (SELECT *, {_TOKENS} AS n FROM (
    SELECT p.chunk_ids, p.tokens, p.context, s.place, s.chunk_id, CASE WHEN len(p.chunk_ids) > 0 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || '[' || (len(p.chunk_ids) + 1) || '] ' || s.rest AS b
    FROM packed p JOIN shown s ON s.place = p.place + 1))) s)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT chunk_ids, CAST(tokens AS INTEGER) AS tokens, context FROM packed ORDER BY place DESC LIMIT 1"
)
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is retrieved, diverse documents first, in 600 tokens."""
    rows = retrieved(spark, sf_dir).join(X.registry(spark).select(F.col("slug").alias("source_name"), "tool"), "source_name", "left")
    rows = rows.withColumn("published", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"))
    return context.packed(context.diverse_order(rows), 600)


@query(
    r"""WITH a AS (SELECT conv_id, turn, coalesce(text, '') || ' [' || (conv_id % 5) || '] [' || (turn % 9) || '] [2]' AS answer FROM conversations WHERE role = 'assistant'),
n AS (SELECT *, [CAST(x AS BIGINT) FOR x IN regexp_extract_all(answer, '\[(\d+)\]', 1)] AS ids FROM a)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct([x FOR x IN ids IF x BETWEEN 1 AND 4])), ',') AS valid,
  array_to_string(['Answer referenced unknown citation [' || x || '].' FOR x IN list_sort(list_distinct([x FOR x IN ids IF x < 1 OR x > 4]))], '|') AS warnings FROM n"""
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of answers, to which the fixture's turns are given some."""
    rows = X.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    given = F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), (F.col("conv_id") % 5).cast("string"), F.lit("] ["), (F.col("turn") % 9).cast("string"), F.lit("] [2]"))
    return rows.select("conv_id", "turn", F.array_join(text.valid_citations(given, F.lit(4)).cast("array<string>"), ",").alias("valid"), F.array_join(text.citation_warnings(given, F.lit(4)), "|").alias("warnings"))


# --- text and taxonomy ----------------------------------------------------

_WORDS = r"len([x FOR x IN regexp_extract_all({0}, '[\p{{L}}\p{{M}}\p{{N}}_+#.-]+') IF regexp_matches(x, '[\p{{L}}\p{{M}}\p{{N}}_]')])"
_SENTENCES = r"string_split(regexp_replace(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))"
DETAIL_SQL = f"""bodies AS (SELECT *, {X.BODY_SQL} AS body FROM articles),
detailed AS (SELECT *, CASE WHEN {_WORDS.format("body")} < 50 OR len([s FOR s IN {_SENTENCES} IF {_WORDS.format("s")} >= 6]) < 2 THEN 'sparse' ELSE 'detailed' END AS content_detail FROM bodies)"""


@query(with_cte(X.ARTICLES_SQL, DETAIL_SQL) + "SELECT id, content_detail FROM detailed")
def content_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.articles(spark, sf_dir).select("id", text.content_detail(F.col("title"), F.col("raw_text")).alias("content_detail"))


@query(
    with_cte(
        X.ARTICLES_SQL,
        DETAIL_SQL,
        """coded AS (SELECT id, array_to_string([x FOR x IN [
  CASE WHEN extraction_status IN ('feed_excerpt_only', 'title_only') THEN 'article_hydration_failed' END,
  CASE WHEN extraction_status = 'title_only' THEN 'title_only_source' END,
  CASE WHEN content_detail = 'sparse' AND coalesce(event, '') <> 'alert' THEN 'insufficient_source_detail' END] IF x IS NOT NULL], ',') AS failure_codes FROM detailed)""",
    )
    + "SELECT id, failure_codes, CASE WHEN failure_codes = '' THEN 'published' ELSE 'quarantined' END AS status FROM coded"
)
def publication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.articles(spark, sf_dir).withColumn("detail", text.content_detail(F.col("title"), F.col("raw_text")))
    codes = gate.failure_codes(F.col("detail"), F.col("extraction_status"), F.col("event_types"))
    return rows.select("id", F.array_join(codes, ",").alias("failure_codes"), gate.gate_status(codes).alias("status"))


def _topic_sql() -> str:
    def one(w: str) -> str:
        if " " in w:
            return f"(length(low) - length(replace(low, '{w}', ''))) // {len(w)}"
        return f"len([x FOR x IN words IF x = '{w}'])"

    sums = [" + ".join(map(one, ws)) for ws in TOPIC_WORDS.values()]
    cols = ", ".join(f"CAST({s} AS INTEGER) AS s{k}" for k, s in enumerate(sums))
    top = "greatest(" + ", ".join(f"s{k}" for k in range(len(sums))) + ")"
    case = " ".join(f"WHEN s{k} = {top} THEN '{t}'" for k, t in enumerate(TOPIC_WORDS))
    return (
        with_cte(X.ARTICLES_SQL, "lowered AS (SELECT *, lower(title || chr(10) || title || chr(10) || raw_text) AS low FROM articles)", f"counted AS (SELECT id, primary_topic, {cols} FROM (SELECT *, string_split_regex(low, '[^a-z0-9]+') AS words FROM lowered))")
        + f"""SELECT id, {", ".join(f"s{k}" for k in range(len(sums)))}, CASE WHEN {top} > 0 THEN CASE {case} END ELSE coalesce(primary_topic, 'ai-products-engineering-infrastructure') END AS topic,
  CASE WHEN {top} > 0 THEN 'deterministic-keyword' ELSE 'source-default' END AS method FROM counted"""
    )


@query(_topic_sql())
def topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat_ws("\n", "title", "title", "raw_text")
    counts = taxonomy.topic_scores(whole, TOPIC_WORDS)
    chosen = taxonomy.topic(whole, F.col("primary_topic"), TOPIC_WORDS)
    return X.articles(spark, sf_dir).select("id", *(c.cast("int").alias(f"s{k}") for k, c in enumerate(counts.values())), chosen["topic"].alias("topic"), chosen["method"].alias("method"))


@query(
    with_cte(X.ARTICLES_SQL)
    + "SELECT id, CASE "
    + " ".join("WHEN " + " OR ".join(f"contains(lower(raw_text), '{w}')" for w in ws) + f" THEN '{e}'" for e, ws in EVENT_WORDS.items())
    + " ELSE coalesce(event, '') END AS event FROM articles"
)
def event_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = taxonomy.events(F.col("raw_text"), F.transform("event_types", lambda e: F.concat(F.lit(" "), F.upper(F.replace(e, F.lit("-"), F.lit("_"))))), EVENT_WORDS)
    return X.articles(spark, sf_dir).select("id", F.array_join(found, ",").alias("event"))


_SPLIT = rf"string_split(regexp_replace({X.collapse_sql('body')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


@query(
    with_cte(X.ARTICLES_SQL, f"bodies AS (SELECT *, {X.BODY_SQL} AS body FROM articles)", f"parts AS (SELECT id, title, {_SPLIT} AS s FROM bodies)", "firsts AS (SELECT *, coalesce(nullif(array_to_string(s[1:2], ' '), ''), title) AS two FROM parts)")
    + f"SELECT id, {X.shorten_sql('two', 500)} AS summary, array_to_string([{X.shorten_sql('x', 160)} FOR x IN s[1:3] IF x <> ''], '|') AS points, {X.shorten_sql('title', 90)} AS headline FROM firsts"
)
def fallback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, raw = F.col("title"), F.col("raw_text")
    return X.articles(spark, sf_dir).select("id", text.fallback_summary(t, raw).alias("summary"), F.array_join(text.fallback_points(t, raw), "|").alias("points"), text.shorten(t, 90).alias("headline"))


# --- ingestion ------------------------------------------------------------

CANDIDATES_SQL = """candidates AS (SELECT *, 'https://example.com/a/' || doc_id AS new_url, sha256(raw_text) AS content_hash FROM detailed),
stored AS (
  SELECT id AS sid, doc_id AS sdoc, source_name AS s_source, title AS s_title, CASE WHEN doc_id % 3 = 0 THEN 'https://example.com/a/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '' END ELSE 'https://old.example.com/' || doc_id END AS s_url,
         CASE WHEN doc_id % 12 = 0 THEN 'stale' ELSE content_hash END AS s_hash, relevance_tier AS s_tier, content_detail AS s_detail, extraction_status AS s_extraction,
         CASE WHEN doc_id % 4 = 0 THEN 'old-policy' ELSE '2026-09-25-agent-engineering-v3' END AS s_policy
  FROM candidates WHERE doc_id % 3 < 2),
ways AS (
  SELECT c.id, 0 AS way, s.* FROM candidates c JOIN stored s ON s.s_url IN (c.new_url, c.new_url || '/')
  UNION ALL SELECT c.id, 1, s.* FROM candidates c JOIN stored s ON c.source_name = s.s_source AND c.title = s.s_title AND c.content_hash = s.s_hash),
old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY way, sid) AS n FROM ways) WHERE n = 1)"""


def stored_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two thirds of the documents as stored articles, all of them as candidates at new addresses."""
    d = F.col("doc_id")
    # never null, so no join asks for it a second time
    docs = X.articles(spark, sf_dir).withColumn("content_hash", F.coalesce(F.sha2(F.encode("raw_text", "UTF-8"), 256), F.lit("")))
    old_url = F.when(d % 3 == 0, F.concat(F.lit("https://example.com/a/"), d.cast("string"), F.when(d % 2 == 0, F.lit("/")).otherwise(F.lit("")))).otherwise(F.concat(F.lit("https://old.example.com/"), d.cast("string")))
    policy = F.when(d % 4 == 0, F.lit("old-policy")).otherwise(F.lit(ingest.POLICY_VERSION))
    stored = docs.where(d % 3 < 2).select(
        "id", "source_name", "title", old_url.alias("url"), "raw_text", F.when(d % 12 == 0, F.lit("stale")).otherwise(F.col("content_hash")).alias("content_hash"),
        "fetched_at", "published_at", "ingestion_status", "extraction_status", "relevance_tier", "relevance_reason", policy.alias("relevance_policy_version"),
        "primary_topic", "event_types", "display_headline", "summary", "why_it_matters", "key_points", F.lit("model").alias("summary_generated_by"),
    )
    new = docs.select(
        "doc_id", "source_name", "title", "raw_text", "content_hash", "published_at", "fetched_at", "extraction_status",
        F.concat(F.lit("https://example.com/a/"), d.cast("string")).alias("url"), text.content_detail(F.col("title"), F.col("raw_text")).alias("content_detail"),
        text.article_excerpt(F.col("title"), F.col("raw_text")).alias("excerpt"), F.col("primary_topic").alias("default_topic"),
        F.col("primary_topic").alias("provisional_topic"), F.col("event_types").alias("provisional_events"),
        X.pick((d * 7 + 3) % 10, ("core",) * 5 + ("contextual",) * 2 + ("excluded",) * 2).alias("answer"),
    )
    return ingest.gated(new), stored


@query(with_cte(X.ARTICLES_SQL, DETAIL_SQL, CANDIDATES_SQL) + "SELECT c.doc_id, o.sid AS stored_id, CASE o.way WHEN 0 THEN 'address' WHEN 1 THEN 'content' END AS way FROM candidates c LEFT JOIN old o ON c.id = o.id")
def exact_dup_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, stored = stored_and_new(spark, sf_dir)
    rows = ingest.matched(new, stored)
    by_url = F.array_contains(urls.url_candidates(F.col("url")), F.col("old.url"))
    return rows.select("doc_id", F.col("old.id").alias("stored_id"), F.when(F.col("old").isNotNull(), F.when(by_url, F.lit("address")).otherwise(F.lit("content"))).alias("way"))


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(
    with_cte(
        X.ARTICLES_SQL,
        f"""entries AS (SELECT id, source_name, CASE WHEN title = '' THEN 'Untitled update' ELSE {_STRIP.format("title")} END AS title,
  array_to_string([{_STRIP.format("x")} FOR x IN string_split(raw_text, chr(10)) IF regexp_matches(x, '\\S')], chr(10)) AS body_text FROM articles)""",
        f"cands AS (SELECT *, {_STRIP.format('title || chr(10) || chr(10) || body_text')} AS raw_text FROM entries)",
        DETAIL_SQL.replace("FROM articles", "FROM cands"),
    )
    + f"""SELECT id, source_name, 'https://src.example/' || id AS url, title, sha256(raw_text) AS content_hash, 'source_entry' AS extraction_status, content_detail,
  {X.excerpt_sql("CASE WHEN body_text = '' THEN title ELSE body_text END")} AS excerpt FROM detailed"""
)
def feed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as a feed's entries, in HTML and with tracked links, prepared as candidates."""
    plain = F.replace(F.replace(F.replace("raw_text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html_text = F.concat(F.lit("<div><p>"), plain, F.lit("</p></div>"))
    link = F.concat(F.lit("https://SRC.example:443/"), F.col("id"), F.lit("?utm_source=feed"))
    entries = X.articles(spark, sf_dir).select("source_name", "title", link.alias("link"), html_text.alias("html"), "published_at", F.lit(None).cast("string").alias("extraction_status"))
    rows = feeds.candidates(entries, X.as_of()).withColumn("url", urls.normalize_url("raw_url"))
    return rows.select(F.regexp_extract("url", "[0-9]+$", 0).alias("id"), "source_name", "url", "title", "content_hash", "extraction_status", "content_detail", "excerpt")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, stored = stored_and_new(spark, sf_dir)
    rows = ingest.matched(new, stored)
    return ingest.routed(rows.withColumn("tier", F.when(ingest.reuses(), F.col("old.relevance_tier")).otherwise(F.col("answer"))))


ROUTES_SQL = """decided AS (
  SELECT c.*, o.sid, o.s_hash = c.content_hash AS same, o.s_tier, (o.s_extraction = 'full_article' OR o.s_detail = 'detailed') AS evidence,
         NOT (c.extraction_status IN ('feed_excerpt_only', 'title_only') OR (c.content_detail = 'sparse' AND coalesce(c.event, '') <> 'alert')) AS publishable,
         CASE WHEN coalesce(o.s_hash = c.content_hash AND o.s_policy = '2026-09-25-agent-engineering-v3', FALSE) AND o.s_tier IS NOT NULL THEN o.s_tier
              ELSE CASE WHEN (c.doc_id * 7 + 3) % 10 < 5 THEN 'core' WHEN (c.doc_id * 7 + 3) % 10 < 7 THEN 'contextual' WHEN (c.doc_id * 7 + 3) % 10 < 9 THEN 'excluded' END END AS tier
  FROM candidates c LEFT JOIN old o ON c.id = o.id),
routed AS (
  SELECT *, CASE WHEN sid IS NOT NULL AND NOT publishable AND coalesce(evidence, FALSE) THEN 'keep_stored'
    WHEN publishable AND tier IS NULL AND s_tier IS NOT NULL THEN 'keep_relevance' WHEN publishable AND tier IS NULL THEN 'await_relevance'
    WHEN publishable AND tier = 'excluded' THEN 'excluded_card' WHEN sid IS NOT NULL AND same AND s_tier IS NOT NULL THEN 'refresh'
    WHEN NOT publishable THEN 'quarantine' ELSE 'summarize' END AS route FROM decided),
statuses AS (
  SELECT *, CASE WHEN route IN ('keep_stored', 'keep_relevance') THEN 'unchanged'
    WHEN route IN ('await_relevance', 'excluded_card') THEN CASE WHEN sid IS NULL THEN 'created' WHEN same THEN 'unchanged' ELSE 'changed' END
    WHEN route = 'refresh' THEN CASE WHEN publishable THEN 'unchanged' ELSE 'quarantined' END WHEN route = 'quarantine' THEN 'quarantined'
    WHEN sid IS NULL THEN 'created' ELSE 'changed' END AS status FROM routed)"""
INGEST = (X.ARTICLES_SQL, DETAIL_SQL, CANDIDATES_SQL, ROUTES_SQL)


@query(with_cte(*INGEST) + "SELECT doc_id, route, status FROM statuses")
def ingest_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes(spark, sf_dir).select("doc_id", "route", "status")


WRITTEN_SQL = f"""old_rows AS (
  SELECT s.*, o.sid AS o_sid, o.sdoc, o.s_url, o.s_source, o.s_title, CASE WHEN o.sdoc % 13 = 0 THEN 'quarantined' ELSE 'published' END AS s_status,
         {X._case("o.sdoc % 7", PRIMARY_TOPICS)} AS s_topic, {X._case("o.sdoc % 3", (None, "", "Headline"))} AS s_headline
  FROM statuses s LEFT JOIN old o ON s.id = o.id),
written AS (
  SELECT coalesce(sid, sha256(source_name || chr(10) || new_url)) AS id, route, status,
    CASE WHEN route IN ('keep_stored', 'keep_relevance', 'refresh') THEN s_source ELSE source_name END AS source_name,
    CASE WHEN route IN ('keep_stored', 'keep_relevance', 'refresh') THEN s_title ELSE title END AS title,
    CASE route WHEN 'quarantine' THEN new_url ELSE coalesce(s_url, new_url) END AS url,
    CASE WHEN route IN ('keep_stored', 'keep_relevance') THEN s_status WHEN publishable THEN 'published' ELSE 'quarantined' END AS ingestion_status,
    CASE WHEN route IN ('keep_stored', 'keep_relevance') THEN s_tier WHEN route = 'refresh' AND NOT publishable THEN s_tier WHEN route = 'quarantine' THEN NULL ELSE tier END AS relevance_tier,
    CASE WHEN route IN ('keep_stored', 'keep_relevance', 'refresh') THEN s_topic ELSE primary_topic END AS primary_topic,
    CASE WHEN route IN ('keep_stored', 'keep_relevance') THEN s_headline WHEN route = 'refresh' THEN nullif(s_headline, '') WHEN route = 'excluded_card' THEN nullif(substr(title, 1, 90), '')
      WHEN route = 'summarize' THEN nullif({X.shorten_sql("title", 90)}, '') END AS display_headline,
    CASE WHEN route IN ('keep_stored', 'keep_relevance', 'refresh') THEN 'model' WHEN route = 'excluded_card' THEN 'relevance-excluded' WHEN route = 'summarize' THEN 'deterministic-fallback' END AS summary_generated_by,
    CASE WHEN route IN ('keep_stored', 'keep_relevance') THEN FALSE WHEN route = 'refresh' THEN NOT publishable ELSE TRUE END AS drops_chunks
  FROM old_rows)"""


@query(with_cte(*INGEST, WRITTEN_SQL) + "SELECT * FROM written")
def ingest_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article rows that the routes write."""
    _, stored = stored_and_new(spark, sf_dir)
    out = ingest.written(routes(spark, sf_dir), stored.columns)
    return out.select("id", "source_name", "title", "url", "ingestion_status", "relevance_tier", "primary_topic", "display_headline", "summary_generated_by", "route", "status", "drops_chunks")


@query(
    with_cte(*INGEST)
    + """SELECT source_name, count(*) AS matched_items, CAST(sum(CAST(status = 'created' AS INTEGER)) AS BIGINT) AS updates_created, CAST(sum(CAST(status = 'changed' AS INTEGER)) AS BIGINT) AS updates_changed,
  CAST(sum(CAST(status = 'unchanged' AS INTEGER)) AS BIGINT) AS updates_unchanged, CAST(sum(CAST(status = 'quarantined' AS INTEGER)) AS BIGINT) AS updates_quarantined,
  CASE WHEN source_name = 'src19' THEN 'failed' ELSE 'success' END AS run_status FROM statuses GROUP BY source_name"""
)
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.when(F.col("source_name") == "src19", 1).otherwise(0)
    return ingest.run_totals(routes(spark, sf_dir)).withColumn("run_status", ingest.run_status(1 - failed, failed))


@query(
    with_cte(*INGEST)
    + """SELECT 'r1' AS run_id, source_name AS source_slug, CASE WHEN source_name = 'src3' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN source_name = 'src3' THEN 'no feed' END AS error,
  CAST(CASE WHEN source_name = 'src3' THEN 0 ELSE count(*) END AS INTEGER) AS matched_items, """
    + ", ".join(f"CAST(CASE WHEN source_name = 'src3' THEN 0 ELSE sum(CAST(status = '{s}' AS INTEGER)) END AS INTEGER) AS updates_{s}" for s in ("created", "changed", "unchanged", "quarantined"))
    + " FROM statuses GROUP BY source_name"
)
def collection_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over all candidates, one source of which failed: the ledger's rows."""
    new, stored = stored_and_new(spark, sf_dir)
    tiers = lambda df: df.withColumn("tier", F.when(ingest.reuses(), F.col("old.relevance_tier")).otherwise(F.col("answer")))
    failures = spark.createDataFrame([("src3", "no feed")], "source_name string, error string")
    now = X.as_of()
    run = collection.collected(new.withColumn("position", F.col("doc_id")), stored, tiers, HashedEmbedder(), "r1", now, now, failures=failures)
    return run.ledger.drop("started_at", "finished_at", "chunks_written")


@query(page_sql(since(30) + " AND source_name IN ('src2', 'src4', 'src8', 'src19')", True, 30))
def feed_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = feed.FeedRequest(X.as_of(), window="month", limit=30, include_contextual=True, source_names=["src2", "src4", "src8", "src19"])
    return shown(feed.page(*both(spark, sf_dir), request))


_MODEL_SQL = "CASE CAST(substr(source, 4) AS INTEGER) % 3 WHEN 0 THEN 'gpt-4.1-mini' WHEN 1 THEN 'gpt-4.1-mini-2025' ELSE 'other' END"


@query(
    f"""WITH t AS (SELECT source, {_MODEL_SQL} AS model, CAST(sum(greatest(0, n_chars)) AS BIGINT) AS tokens_in, CAST(sum(greatest(0, n_chars - 2000)) AS BIGINT) AS tokens_out FROM documents GROUP BY source)
SELECT source, model, tokens_in, tokens_out, CASE WHEN model <> 'other' THEN round(CAST(tokens_in AS DOUBLE) / CAST(1000000 AS DOUBLE) * CAST(0.4 AS DOUBLE) + CAST(tokens_out AS DOUBLE) / CAST(1000000 AS DOUBLE) * CAST(1.6 AS DOUBLE), 6) END AS chat_cost,
  round(CAST(tokens_in AS DOUBLE) / CAST(1000000 AS DOUBLE) * CAST(0.02 AS DOUBLE), 6) AS embedding_cost FROM t"""
)
def model_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, zero = F.col("n_chars"), F.lit(0).cast("long")
    used = X.table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.greatest(zero, n)).alias("tokens_in"), F.sum(F.greatest(zero, n - 2000)).alias("tokens_out"))
    model = X.pick(F.col("source").substr(4, 9).cast("int") % 3, ("gpt-4.1-mini", "gpt-4.1-mini-2025", "other"))
    used = used.withColumn("model", model)
    return used.select("source", "model", "tokens_in", "tokens_out", scores.chat_cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out")).alias("chat_cost"), scores.embedding_cost(F.lit("text-embedding-3-small"), F.col("tokens_in")).alias("embedding_cost"))


@query("SELECT event_id AS run, 'src' || (user_id % 20) AS source_slug, CAST(floor(epoch(ts)) AS BIGINT) AS finished_unix FROM events WHERE event_type IN ('error', 'purchase') ORDER BY ts DESC, event_id DESC LIMIT 20")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    top = rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(20)
    return top.select(F.col("event_id").alias("run"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_slug"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("finished_unix"))


@query(
    with_cte(
        X.ARTICLES_SQL,
        r"whole AS (SELECT *, lower(lower(regexp_replace(title, '^\s+|\s+$', '', 'g')) || ' ' || raw_text) AS w FROM articles)",
        r"""kept AS (SELECT * FROM whole WHERE NOT starts_with(lower(regexp_replace(title, '^\s+|\s+$', '', 'g')), 'the') AND coalesce(event, '') <> 'alert'
  AND (list_contains(string_split_regex(w, '[^a-z0-9]+'), 'que') OR regexp_matches(w, '(^|[^a-z0-9])of\s+the($|[^a-z0-9])') OR list_contains(string_split_regex(w, '[^a-z0-9]+'), 'und')))""",
    )
    + "SELECT doc_id, source_name FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY doc_id) AS n FROM kept) WHERE n <= 12"
)
def entry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a source's filter lets pass, twelve a source at most."""
    rows = X.articles(spark, sf_dir)
    ok = feeds.matches_source(F.col("title"), F.col("event_types"), F.col("raw_text"), prefixes=["The "], excluded=["Alert"], terms=["que", "of the", "und"])
    return feeds.capped(rows.where(ok), 12, position="doc_id").select("doc_id", "source_name")


@query(
    f"""WITH d AS (SELECT doc_id, {X.FIRST} + (doc_id % 28) * 86400 AS day FROM documents)
SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN day + 36000 WHEN 1 THEN day + 28800 WHEN 2 THEN day WHEN 3 THEN day WHEN 4 THEN day
  WHEN 6 THEN day + 36000 WHEN 7 THEN day + 32400 WHEN 8 THEN day + 36000 + 5 * 3600 WHEN 9 THEN day + 36060 + 5 * 3600 + 1800 END AS published_unix FROM d"""
)
def entry_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry times in nine spellings, and one that is none."""
    d = F.col("doc_id")
    day = F.timestamp_seconds(F.lit(X.FIRST) + (d % 28) * 86400)
    spelled = (
        F.when(d % 10 == 0, F.date_format(day, "yyyy-MM-dd'T10:00:00Z'")).when(d % 10 == 1, F.date_format(day, "yyyy-MM-dd'T10:00:00+02:00'")).when(d % 10 == 2, F.date_format(day, "yyyy-MM-dd"))
        .when(d % 10 == 3, F.date_format(day, "MMM d, yyyy")).when(d % 10 == 4, F.date_format(day, "MMMM d, yyyy"))
        .when(d % 10 == 6, F.date_format(day, "EEE, dd MMM yyyy '10:00:00 GMT'")).when(d % 10 == 7, F.date_format(day, "EEE, dd MMM yyyy '10:00:00 +0100'"))
        .when(d % 10 == 8, F.date_format(day, "dd MMM yyyy '10:00:00 EST'")).when(d % 10 == 9, F.date_format(day, "EEE, d MMM yy '10:01 -0530'")).otherwise(F.lit("some day"))
    )
    docs = X.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.unix_seconds(dates.entry_datetime(F.lit(None).cast("timestamp"), spelled, F.lit(None))).alias("published_unix"))


@query(
    r"""SELECT event_id, '{"api_key":"[REDACTED]",' || CASE event_type WHEN 'view' THEN '' ELSE '"event":"' || event_type || '",' END || CASE event_type WHEN 'error' THEN '"exception_type":"ValueError",' ELSE '' END
  || '"level":"' || CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END || '","logger":"app",' || CASE event_type WHEN 'view' THEN '"message":"seen password=[REDACTED]",' ELSE '' END
  || '"none":null,"note":"caf\u00e9 \ud83e\udd16 token=1 password=[REDACTED]","ok":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END
  || ',"prompt_tokens":42,"request":{"id":' || event_id || ',"my_secret":"[REDACTED]","path":"/a"},"tags":["x","Bearer [REDACTED]"],"timestamp":"2024-01-01T00:00:0' || (event_id % 10) || CASE event_id % 2 WHEN 0 THEN '' ELSE '.500000' END || '+00:00","user":' || user_id || '}' AS line FROM events"""
)
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines: typed, nested and secret fields, messages and errors."""
    e, kind = F.col("event_id"), F.col("event_type")
    request = F.struct(F.lit("/a").alias("path"), e.alias("id"), F.lit("s").alias("my_secret"))
    rows = X.table(spark, sf_dir, "events").select(
        e, kind, F.col("user_id").alias("user"), F.lit("k").alias("api_key"), F.lit("café 🤖 token=1 password=x").alias("note"), F.lit(None).cast("string").alias("none"),
        F.lit(42).alias("prompt_tokens"), (e % 2 == 0).alias("ok"), F.array(F.lit("x"), F.lit("Bearer abc")).alias("tags"), request.alias("request"),
    )
    time = F.timestamp_millis(F.lit(X.FIRST * 1000) + (e % 10) * 1000 + (e % 2) * 500)
    level, error = F.when(kind == "error", F.lit("ERROR")).otherwise(F.lit("INFO")), F.when(kind == "error", F.lit("ValueError"))
    line = logs.lines(rows, time, level, F.lit("app"), F.when(kind != "view", kind), ("user", "api_key", "note", "none", "prompt_tokens", "ok", "tags", "request"), F.lit("seen password=x"), error)
    return rows.select("event_id", line.alias("line"))


# --- operations -----------------------------------------------------------

def _bucket(seconds: int) -> str:
    return f"CAST(floor(epoch(ts) / {seconds}) AS BIGINT) * {seconds}"


@query(f"SELECT {_bucket(300)} AS window_unix, count(*) AS events FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 2")
def error_windows_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = windows.counted(windows.failed_runs(X.log_events(spark, sf_dir)), windows.FAILURE_PERIOD)
    return windows.over_threshold(counts, 2).select(F.unix_seconds("window_start").alias("window_unix"), "events")


@query(
    f"""WITH g AS (SELECT unnest(range({X.FIRST}, {X.FIRST} + 30 * 86400, 3600)) AS window_unix),
c AS (SELECT {_bucket(3600)} AS w, count(*) AS n FROM events WHERE event_type = 'purchase' AND event_id % 5 <> 0 GROUP BY 1)
SELECT window_unix, coalesce(n, 0) AS events FROM g LEFT JOIN c ON g.window_unix = c.w WHERE coalesce(n, 0) < 1"""
)
def stale_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours without a run that did not fail."""
    counts = windows.counted(windows.completed_runs(X.log_events(spark, sf_dir)), "1 hour")
    out = windows.absent(counts, 3600, F.timestamp_seconds(F.lit(X.FIRST)), F.timestamp_seconds(F.lit(X.FIRST + 30 * 86400)))
    return out.select(F.unix_seconds("window_start").alias("window_unix"), "events")


@query(
    f"""WITH s AS (SELECT {_bucket(3600)} AS window_unix, max(value) AS maximum FROM events GROUP BY 1),
b AS (SELECT *, maximum >= 150 AS breaching FROM s)
SELECT window_unix, maximum, breaching, sum(CAST(breaching AS INTEGER)) OVER (ORDER BY window_unix ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 AS alarm FROM b"""
)
def m_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = windows.statistics(X.log_events(spark, sf_dir), "value", "1 hour")
    out = windows.sustained(series, F.col("maximum") >= 150, 3, 3)
    return out.select(F.unix_seconds("window_start").alias("window_unix"), "maximum", "breaching", "alarm")


@query(f"SELECT {_bucket(43200)} AS window_unix, round(avg(value), 6) AS average, max(value) AS maximum, min(value) AS minimum, round(sum(value), 4) AS total FROM events GROUP BY 1")
def period_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.statistics(X.log_events(spark, sf_dir), "value", "12 hours")
    return out.select(F.unix_seconds("window_start").alias("window_unix"), F.round("average", 6).alias("average"), "maximum", "minimum", F.round("total", 4).alias("total"))


@query("SELECT event_id, CAST(floor(value * 20) AS BIGINT) AS duration_ms, CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 201 ELSE 200 END AS http_status FROM events WHERE event_type = 'error' OR (event_type <> 'view' AND floor(value * 20) >= 2000)")
def troubled_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.troubled_requests(windows.without_probes(X.log_events(spark, sf_dir))).select("event_id", "duration_ms", "http_status")


@query(
    """WITH p AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, k, k % 2 = 0 AS has_flag, CASE WHEN k % 2 = 0 THEN 'flag,k,source' ELSE 'k,source' END AS keys, CASE WHEN k < 10 THEN 'low' WHEN k >= 90 THEN 'high' ELSE '' END AS reasons FROM p"""
)
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON text read, merged, dropped, tested and named."""
    rows = X.table(spark, sf_dir, "events").withColumn("doc", documents.fields(F.col("props")))
    k = F.col("doc")["k"].try_cast("long")
    extra = F.create_map(F.lit("source"), F.lit("log"), F.lit("flag"), F.when(k % 2 == 0, F.lit("yes")), F.lit("gone"), F.lit("x"))
    out = rows.withColumn("n", k).withColumn("more", documents.stripped(documents.without(documents.merged(F.col("doc"), extra), "gone")))
    reasons = documents.conditions(low=F.col("n") < 10, high=F.col("n") >= 90)
    return out.select("event_id", F.col("n").alias("k"), documents.has_any(F.col("more"), "flag", "other").alias("has_flag"), F.array_join(F.array_sort(F.map_keys("more")), ",").alias("keys"), F.array_join(reasons, ",").alias("reasons"))


@query(
    """WITH p AS (SELECT click_id, kind, CASE WHEN json_valid(props) THEN CAST(props AS JSON) END AS j FROM clicks),
d AS (SELECT *, coalesce(json_type(j, '$.device') = 'OBJECT', FALSE) AS device, coalesce(json_type(j, '$.items') = 'ARRAY', FALSE) AS listed FROM p)
SELECT click_id, CAST(json_extract_string(j, '$.k') AS BIGINT) AS k, json_extract_string(j, '$.device.os') AS os, CASE WHEN device THEN kind END AS seen,
  CASE WHEN device THEN json_extract_string(j, '$.device.ver') END AS kept, CASE WHEN device THEN 'os,seen' END AS left_in, json_extract_string(j, '$.tags[0]') AS tag,
  CASE WHEN listed THEN CAST(json_array_length(j, '$.items') AS INTEGER) END AS n_items, CASE WHEN listed THEN CAST(coalesce(list_sum(CAST(json_extract(j, '$.items[*].qty') AS BIGINT[])), 0) AS BIGINT) END AS quantity FROM d"""
)
def props_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested fields of JSON text: typed values read by path, one set and one dropped in an inner object, arrays summed."""
    rows = X.table(spark, sf_dir, "clicks").withColumn("doc", documents.parsed(F.col("props")))
    rows = rows.withColumn("with", documents.with_path(F.col("doc"), ["device", "seen"], documents.variant(F.col("kind"))))
    rows = rows.withColumn("less", documents.without_path(F.col("with"), ["device", "ver"]))
    doc, more, less = F.col("doc"), F.col("with"), F.col("less")
    quantity = F.aggregate(documents.elements(doc, "$.items"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(documents.at(x, "$.qty", "long"), F.lit(0)))
    left = F.array_join(F.array_sort(F.map_keys(documents.opened(documents.at(less, "$.device")))), ",")
    return rows.select(
        "click_id", documents.at(doc, "$.k", "long").alias("k"), documents.at(doc, "$.device.os", "string").alias("os"), documents.at(more, "$.device.seen", "string").alias("seen"),
        documents.at(more, "$.device.ver", "string").alias("kept"), left.alias("left_in"), documents.at(doc, "$.tags[0]", "string").alias("tag"),
        F.size(documents.elements(doc, "$.items")).alias("n_items"), quantity.alias("quantity"),
    )


@query("SELECT event_id, regexp_replace(regexp_replace('Bearer abc' || event_id || ', password=' || user_id || '&x=1 /p?q=' || value, '\\bBearer\\s+[^\\s,;]+', 'Bearer [REDACTED]', 'g'), '\\b(api[_-]?key|password|secret|access_token)=([^&\\s]+)', '\\1=[REDACTED]', 'g') AS line FROM (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS value FROM events)")
def redacted_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("Bearer abc"), F.col("event_id").cast("string"), F.lit(", password="), F.col("user_id").cast("string"), F.lit("&x=1 /p?q="), F.floor("value").cast("long").cast("string"))
    return X.table(spark, sf_dir, "events").select("event_id", redact.redact(line).alias("line"))


@query(
    """WITH a AS (SELECT event_id, CAST(event_id % 3 + 1 AS INTEGER) AS attempt, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 20 AS VARCHAR) WHEN 1 THEN 'soon' END AS after, CASE event_id % 6 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 500 END AS http FROM events)
SELECT event_id, least(CAST(10 AS DOUBLE), CASE WHEN regexp_full_match(after, '[0-9]+') THEN TRY_CAST(after AS DOUBLE) ELSE CAST(2 ** (attempt - 1) AS DOUBLE) END) AS delay,
  CASE WHEN http = 403 THEN 'http_forbidden' WHEN http = 404 THEN 'http_not_found' WHEN http IS NOT NULL THEN 'http_error' WHEN event_id % 6 = 3 THEN 'network_error' WHEN event_id % 6 = 4 THEN 'content_incomplete' ELSE 'unknown_error' END AS error_code FROM a"""
)
def fetch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    after = F.when(e % 4 == 0, (e % 20).cast("string")).when(e % 4 == 1, F.lit("soon"))
    http = X.pick(e % 6, (403, 404, 500)).cast("int")
    kind = X.pick(e % 6, (None, None, None, "network", "content"))
    return X.table(spark, sf_dir, "events").select("event_id", fetch.retry_delay((e % 3 + 1).cast("int"), after).alias("delay"), fetch.error_code(http, kind).alias("error_code"))


@query(
    with_cte(X.ARTICLES_SQL)
    + f"""SELECT id, CASE primary_topic {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in display.CATEGORIES.items())} ELSE 'Developer Tools' END AS category, upper(substr(source_name, 1, 1)) || substr(source_name, 2) AS source,
  CASE WHEN published IS NULL THEN NULL WHEN {X.AS_OF} - published < 60 THEN 'just now' WHEN {X.AS_OF} - published < 3600 THEN (({X.AS_OF} - published) // 60) || 'm ago'
  WHEN {X.AS_OF} - published < 86400 THEN (({X.AS_OF} - published) // 3600) || 'h ago' WHEN {X.AS_OF} - published < 172800 THEN 'yesterday' ELSE (({X.AS_OF} - published) // 86400) || 'd ago' END AS age FROM articles"""
)
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.when(F.col("published_at").isNotNull(), dates.relative(F.col("published_at"), X.as_of()))
    return X.articles(spark, sf_dir).select("id", display.category_label(F.coalesce("primary_topic", F.lit("developer-tools"))).alias("category"), display.source_display_name(F.col("source_name")).alias("source"), age.alias("age"))


# --- pages, passages, quotes ----------------------------------------------

@query()
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.article_of(F.col("html"), selector="article", minimum=200)
    return X.table(spark, sf_dir, "pages").withColumn("a", found).select("page_id", "a.title", F.sha2(F.encode("a.body", "UTF-8"), 256).alias("body_sha256"), F.length("a.body").alias("body_length"), "a.published", "a.extraction_status", "a.error")


@query()
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.listing_entries(X.table(spark, sf_dir, "pages"), "url", "^/[a-z]").select("page_id", "position", "title", "link")


@query(
    r"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '([?&])utm_[a-z]+=[^&#]*', '\1', 'g'), '[?&]+($|#)', '\1') AS url FROM pages)
SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/]*')) || regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1), '([^/])/+($|[?#])', '\1\2') AS url FROM u"""
)
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracked = F.regexp_replace("url", r"\?", "?utm_source=a&")
    once = F.when(F.col("url").contains("?"), tracked).otherwise(F.concat(F.regexp_extract("url", "^[^#]*", 0), F.lit("?fbclid=1"), F.regexp_extract("url", "#.*$", 0)))
    return X.table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(once).alias("url"))


URL_FORMS = (
    ("HTTPS://User:pw@Example.COM:443/P/{0}//?b=2&utm_source=x&a={0}&fbclid=1#Frag", "https://example.com/P/{0}?a={0}&b=2#Frag"),
    ("http://example.com:8080/p/{0};v=1/?z=&A=%7Ex+y&z=1&UTM_x=2", "http://example.com:8080/p/{0};v=1?A=~x+y&z=&z=1"),
    ("https://example.com:0443?gclid={0}", "https://example.com"),
    (" https://example.com:x/%7E{0}/?q=a%2Bb%26c&q=%C3%A9%zz ", "https://example.com/%7E{0}?q=a%2Bb%26c&q=%C3%A9%25zz"),
    ("http://[2001:DB8::1]:80/{0}/#", "http://2001:db8::1/{0}"),
    ("/relative/{0}/?mc_eid=1", "/relative/{0}"),
)


@query("SELECT page_id, CASE page_id % 6 " + " ".join(f"WHEN {k} THEN replace('{want}', '{{0}}', CAST(page_id AS VARCHAR))" for k, (_, want) in enumerate(URL_FORMS)) + " END AS url FROM pages")
def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with users, ports, parameters, escapes and trackers, each as its one form."""
    given = F.replace(X.pick(F.col("page_id") % 6, tuple(a for a, _ in URL_FORMS)), F.lit("{0}"), F.col("page_id").cast("string"))
    return X.table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(given).alias("url"))


@query()
def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunked(X.articles(spark, sf_dir).select("id", "raw_text"))
    return out.select("document_id", "chunk_index", "token_count", F.sha2(F.encode("content", "UTF-8"), 256).alias("content_hash"))


@query()
def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an article has quotes from all over its own text, and the whole benchmark item of its number, if there is one."""
    items = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("item"))
    rows = X.articles(spark, sf_dir).join(items, "doc_id", "left")
    size = F.length("raw_text")
    starts = [F.greatest(F.lit(1), F.floor((size - 119) * k / 4).cast("int")) for k in range(5)]
    # without the words that the cuts go through
    cut = (r"(?U)\w+$", *[r"(?U)^\w+|\w+$"] * 3, r"(?U)^\w+")
    parts = [F.when(size <= 120, F.col("raw_text")).otherwise(F.regexp_replace(F.col("raw_text").substr(p, F.lit(120)), c, "")) for p, c in zip(starts, cut, strict=True)]
    found = rows.withColumn("found", quotes_supported("title", "raw_text", F.array("item", F.concat_ws(" ... ", *parts))))
    return found.select("doc_id", F.when(F.col("item").isNotNull(), F.col("found")[0]).alias("item_supported"), F.col("found")[1].alias("own_supported"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
