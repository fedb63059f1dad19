"""Ingestion as a set operation: who is known already, which route each takes, what is written.

Candidates meet stored articles by two equi-joins, by address and by content;
a chain of conditions names the route, the first that holds; every route is one
projection. Costly model calls see only the routes that need them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.taxonomy import clean_labels, events, topic
from ..functions.text import clean_list, clean_text, content_detail, fallback_points, fallback_summary, falsy, shorten
from ..functions.urls import normalize_url, url_candidates
from ..schemas import FIELD_DEFAULTS, PRIMARY_TOPICS, RELEVANCE_TIERS, TITLE_LIMIT, managed
from .gate import failure_codes, full_evidence, gate_status

# The version of the relevance policy, and a card's standing sentence.
POLICY_VERSION = "2026-09-25-agent-engineering-v3"
WHY_IT_MATTERS = "Review the source for implementation details and compatibility impact."


def prepared(candidates: DataFrame, default_topic: Column, default_events: Column) -> DataFrame:
    """Candidates with their address, provisional labels and the gate's decision."""
    text = F.concat_ws("\n", "title", "title", "raw_text")
    rows = candidates.withColumn("url", normalize_url("raw_url")).withColumn("default_topic", default_topic).withColumn("default_events", default_events)
    rows = rows.withColumn("provisional_topic", topic(text, F.col("default_topic"))["topic"]).withColumn("provisional_events", events(F.col("raw_text"), F.col("default_events")))
    return gated(rows)


def gated(rows: DataFrame) -> DataFrame:
    codes = failure_codes(F.col("content_detail"), F.col("extraction_status"), F.col("provisional_events"))
    return rows.withColumn("failure_codes", codes).withColumn("gate", gate_status(F.col("failure_codes")))


def last_of_batch(candidates: DataFrame, position: str = "position") -> DataFrame:
    """One candidate an address: the last, as when entries came one after another."""
    nth = F.row_number().over(Window.partitionBy("url").orderBy(F.desc(position)))
    return candidates.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


CONTENT = ["source_name", "title", "content_hash"]


def least_ids(stored: DataFrame, by: list[str]) -> DataFrame:
    """Each key of the stored articles with its smallest id, summed before anything moves."""
    return stored.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in by))).groupBy(*by).agg(F.min("id").alias("_id"))


def matched(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates with the stored article they are, as struct ``old``; null if they are new.

    By address first, then by source, title and content; of several the smallest
    id. Keys are made distinct on both sides before they meet, so no join puts out
    more rows than it has candidates, however often a content repeats; a key that
    very many candidates share is on the side that the planner can split. Whole
    stored rows move once, to the candidates they belong to.
    """
    title = F.substring("title", 1, TITLE_LIMIT)
    key = F.sha2(F.to_json(F.struct("source_name", "url", title.alias("title"), "content_hash"), {"ignoreNullFields": "false"}), 256)
    keyed = candidates.withColumn("_key", F.coalesce(key, F.lit("")))  # never null, so no join filters by it
    keys = keyed.select("_key", "source_name", title.alias("title"), "content_hash", "url").distinct()
    forms = keys.select("url").distinct().select("url", F.explode(url_candidates(F.col("url"))).alias("_url"))
    by_url = forms.join(least_ids(stored.select("id", F.col("url").alias("_url")), ["_url"]), "_url").groupBy("url").agg(F.min("_id").alias("_by_url"))
    by_content = keys.select(*CONTENT).distinct().join(least_ids(stored, CONTENT), CONTENT).withColumnRenamed("_id", "_by_content")
    first = keys.join(by_url, "url", "left").join(by_content, CONTENT, "left").select("_key", F.coalesce("_by_url", "_by_content").alias("_id")).where("_id IS NOT NULL")
    old = stored.select(F.col("id").alias("_id"), F.struct(*stored.columns).alias("old"))
    return keyed.join(first.join(old, "_id").select("_key", "old"), "_key", "left").drop("_key")


def _valid(tier: Column) -> Column:
    return F.coalesce(tier.isin(*RELEVANCE_TIERS), F.lit(False))


def reuses(policy: str = POLICY_VERSION) -> Column:
    """Whether the stored relevance still holds: same content, same policy, a valid tier."""
    old = F.col("old")
    return F.coalesce((old["content_hash"] == F.col("content_hash")) & (old["relevance_policy_version"] == policy), F.lit(False)) & _valid(old["relevance_tier"])


def routed(rows: DataFrame) -> DataFrame:
    """Matched candidates with ``tier`` (their relevance), ``route`` and ``status``.

    ``tier`` is null where classification failed; it is looked at only for
    candidates that the gate publishes.
    """
    old, known = F.col("old"), F.col("old").isNotNull()
    publishable = F.col("gate") == "published"
    same = F.coalesce(old["content_hash"] == F.col("content_hash"), F.lit(False))
    evidence = F.coalesce(full_evidence(old["extraction_status"], content_detail(old["title"], old["raw_text"])), F.lit(False))
    route = (
        F.when(known & ~publishable & evidence, F.lit("keep_stored"))
        .when(publishable & F.col("tier").isNull() & _valid(old["relevance_tier"]), F.lit("keep_relevance"))
        .when(publishable & F.col("tier").isNull(), F.lit("await_relevance"))
        .when(publishable & (F.col("tier") == "excluded"), F.lit("excluded_card"))
        .when(known & same & _valid(old["relevance_tier"]), F.lit("refresh"))
        .when(~publishable, F.lit("quarantine"))
        .otherwise(F.lit("summarize"))
    )
    written = F.when(~known, F.lit("created")).when(same, F.lit("unchanged")).otherwise(F.lit("changed"))
    out = rows.withColumn("route", route)
    r = F.col("route")
    status = (
        F.when(r.isin("keep_stored", "keep_relevance"), F.lit("unchanged"))
        .when(r.isin("await_relevance", "excluded_card"), written)
        .when(r == "refresh", F.when(publishable, F.lit("unchanged")).otherwise(F.lit("quarantined")))
        .when(r == "quarantine", F.lit("quarantined"))
        .otherwise(F.when(known, F.lit("changed")).otherwise(F.lit("created")))
    )
    return out.withColumn("status", status)


Summarizer = Callable[[DataFrame], DataFrame]


def fallback_fields() -> dict[str, Column]:
    """A candidate's card from its first sentences, field by field."""
    t, raw = F.col("title"), F.col("raw_text")
    return {
        "display_headline": shorten(t, 90), "summary": fallback_summary(t, raw), "why_it_matters": F.lit(WHY_IT_MATTERS),
        "key_points": fallback_points(t, raw), "primary_topic": F.col("provisional_topic"),
        "event_types": F.when(F.size("provisional_events") > 0, F.col("provisional_events")).otherwise(F.array(F.lit("analysis"))),
        "summary_generated_by": F.lit("deterministic-fallback"),
    }


def fallback_card(rows: DataFrame) -> DataFrame:
    """The card of a candidate from its first sentences, without a model."""
    return rows.withColumn("card", F.struct(*(v.alias(f) for f, v in fallback_fields().items())))


PAYLOAD = "display_headline string, summary string, why_it_matters string, key_points array<string>, primary_topic string, event_type string, event_types array<string>"


def model_card(rows: DataFrame, payload: str = "payload", model: str = "model") -> DataFrame:
    """Cards from a model's JSON in column ``payload``: valid fields count, the fallback fills the others.

    JSON that cannot be read leaves the whole fallback.
    """
    with_fallback = fallback_card(rows)
    old, got = F.col("card"), F.from_json(F.col(payload), PAYLOAD, {"mode": "PERMISSIVE"})
    read = with_fallback.withColumn("_got", got)
    g = F.col("_got")
    asked = F.lower(F.trim(falsy(g["primary_topic"], old["primary_topic"])))
    named = clean_labels(F.when(F.length(g["event_type"]) > 0, F.array(g["event_type"])).otherwise(g["event_types"]), limit=1)
    any_field = F.coalesce(*(g[c].cast("string") for c in ("display_headline", "summary", "why_it_matters", "primary_topic", "event_type")), g["key_points"].cast("string"), g["event_types"].cast("string")).isNotNull()
    card = F.struct(
        clean_text(g["display_headline"], old["display_headline"], 90).alias("display_headline"), clean_text(g["summary"], old["summary"], 600).alias("summary"),
        clean_text(g["why_it_matters"], old["why_it_matters"], 320).alias("why_it_matters"), clean_list(g["key_points"], old["key_points"], 4, 180).alias("key_points"),
        F.when(asked.isin(*PRIMARY_TOPICS), asked).otherwise(old["primary_topic"]).alias("primary_topic"),
        F.when(F.size(named) > 0, named).otherwise(old["event_types"]).alias("event_types"), F.lit(model).alias("summary_generated_by"),
    )
    return read.withColumn("card", F.when(any_field, card).otherwise(old)).drop("_got")


def written(rows: DataFrame, columns: list[str], summarize: Summarizer = fallback_card, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The article rows that the routes write, with ``route`` and whether chunks go (``drops_chunks``).

    Without a model all routes are one projection. A model looks only at the rows
    that need a card; ``keep`` (to write or persist them) is then applied to
    ``rows``, which two branches read.
    """
    old = F.col("old")
    new_id = F.coalesce(old["id"], F.sha2(F.concat_ws("\n", "source_name", "url"), 256))
    base = {"primary_topic": F.col("default_topic"), "extraction_status": F.col("extraction_status"), "ingestion_status": F.col("gate")}
    relevance = {
        "relevance_tier": F.col("tier"),
        "relevance_reason": F.col("reason") if "reason" in rows.columns else F.when(reuses(), old["relevance_reason"]),
        "relevance_policy_version": F.lit(POLICY_VERSION),
    }
    fresh = {
        "id": new_id, "source_name": F.col("source_name"), "title": F.substring("title", 1, TITLE_LIMIT), "raw_text": F.col("raw_text"),
        "content_hash": F.col("content_hash"), "fetched_at": F.col("fetched_at"), "published_at": F.col("published_at"),
    }
    kept_url = F.coalesce(old["url"], F.col("url"))

    stored_row = {c: old[c] for c in columns}
    provisional = {"primary_topic": F.col("provisional_topic"), "event_types": F.col("provisional_events")}
    shown = {k: F.when(F.col("gate") == "published", v).otherwise(old[k]) for k, v in relevance.items()}
    # the routes that need no model: their rows, and whether chunks go
    cases: list[tuple[tuple[str, ...], dict[str, Column], Column]] = [
        (("keep_stored", "keep_relevance"), stored_row | {"fetched_at": F.col("fetched_at")}, F.lit(False)),
        (("await_relevance",), fresh | {"url": kept_url} | managed(base | relevance | provisional), F.lit(True)),
        (
            ("excluded_card",),
            fresh | {"url": kept_url} | managed(base | relevance | provisional | {"display_headline": F.substring("title", 1, 90), "summary": F.col("excerpt"), "summary_generated_by": F.lit("relevance-excluded")}),
            F.lit(True),
        ),
        (
            ("refresh",),
            stored_row | {"fetched_at": F.col("fetched_at"), "published_at": F.col("published_at")}
            | managed({n: old[n] for n in FIELD_DEFAULTS} | {"extraction_status": F.col("extraction_status"), "ingestion_status": F.col("gate")} | shown),
            F.col("gate") != "published",
        ),
        (("quarantine",), fresh | {"url": F.col("url")} | managed(base | {"event_types": F.col("provisional_events")}), F.lit(True)),
    ]

    def by_route(values: list[Column]) -> Column:
        """The value of a row's route."""
        named = zip((names for names, _, _ in cases), values, strict=True)
        return F.coalesce(*(F.when(F.col("route").isin(*names), v) for names, v in named))

    card, fields = F.col("card"), ("display_headline", "summary", "why_it_matters", "key_points", "primary_topic", "event_types", "summary_generated_by")
    made_here = summarize is fallback_card
    carded = fresh | {"url": kept_url} | managed(base | relevance | (fallback_fields() if made_here else {f: card[f] for f in fields}))
    summarized = F.col("route") == "summarize"

    def projected(df: DataFrame) -> DataFrame:
        return df.select(*(by_route([values[c] for _, values, _ in cases]).alias(c) for c in columns), "route", "status", by_route([d for _, _, d in cases]).alias("drops_chunks"))

    if made_here:  # field by field, so only those that are asked for are made
        cases.append((("summarize",), carded, F.lit(True)))
        return projected(rows)
    rows = keep(rows)
    made = summarize(rows.where(summarized))
    return projected(rows.where(~summarized)).unionByName(made.select(*(carded[c].alias(c) for c in columns), "route", "status", F.lit(True).alias("drops_chunks")))


def run_totals(rows: DataFrame, by: str = "source_name") -> DataFrame:
    """Counts of statuses by source."""
    count = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(f"updates_{s}")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("matched_items"), *map(count, ("created", "changed", "unchanged", "quarantined")))


def collection_totals(runs: DataFrame) -> DataFrame:
    """One row over the sources of a run (with column ``error``, null where none): what went through, and errors."""
    fine = F.col("error").isNull()
    sums = [F.sum(F.when(fine, F.col(c)).otherwise(0)).alias(c) for c in ("updates_created", "updates_changed", "updates_unchanged", "updates_quarantined", "chunks_written")]
    totals = runs.agg(F.count(F.when(fine, 1)).alias("sources_processed"), *sums, F.count("error").alias("errors"))
    return totals.withColumn("status", run_status(F.col("sources_processed"), F.col("errors")))


def run_status(processed: Column, errors: Column) -> Column:
    """success, partial_success, or failed where no source went through."""
    return F.when(errors == 0, F.lit("success")).when(processed > 0, F.lit("partial_success")).otherwise(F.lit("failed"))
