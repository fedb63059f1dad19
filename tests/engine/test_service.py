"""Requests with plain parameters, and providers of cards."""

import json

import pytest
from pyspark.sql import functions as F

from weftline import providers, schemas, service
from weftline.operators import answer, feed, ingest
from weftline.plans import catalog
from weftline.plans import fixtures as X

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs, sources = catalog.both(spark, SF)
    chunks = X.chunks(docs).join(X.vectors(spark, SF, docs).select("chunk_id", "embedding"), "chunk_id", "left")
    return service.Tables(docs, chunks, sources, lambda _: X.query_vector(spark, SF))


def test_request_ids_and_times():
    assert service.request_id("review-request-123") == "review-request-123"
    for bad in (None, "", "a b", "x" * 65, "é", "a\n"):
        assert len(service.request_id(bad)) == 32
    with service.timed() as t:
        pass
    assert isinstance(t.milliseconds, int) and 0 <= t.milliseconds < 1000


def test_updates(spark, tables):
    page = service.updates(tables, X.as_of(), window="month", source_names=[" SRC2 ", "src4"], include_contextual=True)
    rows = page.collect()
    assert rows and len(rows) <= 30 and {r.source_name for r in rows} <= {"src2", "src4"}
    assert [r.id for r in feed.compact(page).collect()] == [r.id for r in rows[:6]]
    for bad in ({"limit": 0}, {"window": "year"}, {"offset": -1}, {"tools": "tool1"}, {"other": 1}):
        with pytest.raises(ValueError):
            service.updates(tables, X.as_of(), **bad)


def test_pages_follow_each_other(spark, tables):
    whole = [r.id for r in service.updates(tables, X.as_of(), window="all", limit=20, include_contextual=True).collect()]
    request = feed.FeedRequest(X.as_of(), window="all", limit=7, include_contextual=True)
    got, last = [], None
    for _ in range(3):
        page = feed.page(tables.articles, tables.sources, request) if last is None else feed.after(tables.articles, tables.sources, request, last)
        rows = page.collect()
        got += [r.id for r in rows]
        last = (rows[-1].importance_score, rows[-1].published_at, rows[-1].id)
    assert got[:20] == whole


def test_search_and_ask(spark, tables):
    rows = service.found(tables, X.as_of(), catalog.SEARCH, include_contextual=True).collect()
    assert rows and [r["rank"] for r in rows] == sorted(r["rank"] for r in rows)
    only = service.found(tables, X.as_of(), catalog.SEARCH, search_mode="keyword", include_contextual=True).collect()
    assert only and all(r.vector_similarity is None for r in only)
    got = service.asked(tables, X.as_of(), catalog.SEARCH, lambda q, c: answer.Generated("It says so [1].", "stop", 10, 5), min_similarity=0.0, include_contextual=True).first()
    assert got.citations and got.warnings == []
    ok, checks = service.readiness({"articles": lambda: tables.articles, "gone": lambda: spark.read.parquet("/nowhere")})
    assert not ok and checks["articles"] == "ok" and checks["gone"].startswith("failed")


class Cards:
    def summarize(self, titles, texts):
        if any("of the" in t for t in texts):
            return ["no json"] * len(titles)
        return [json.dumps({"display_headline": "H", "summary": "S", "primary_topic": "data-search-retrieval", "event_type": "guide", "key_points": ["k"]})] * len(titles)


class Broken:
    def summarize(self, titles, texts):
        raise RuntimeError("no model")


@pytest.mark.parametrize("model,names", [(Cards(), {"m", "deterministic-fallback"}), (Broken(), {"deterministic-fallback"})])
def test_cards_of_a_model(spark, model, names):
    routed = catalog.routes(spark, SF)
    _, stored = catalog.stored_and_new(spark, SF)
    plain = ingest.written(routed, stored.columns)
    out = ingest.written(routed, stored.columns, providers.summarizer(model, "m"))
    assert out.count() == plain.count() and schemas.violations(out.select(*stored.columns)).count() == 0
    assert {r.summary_generated_by for r in out.where("route = 'summarize'").collect()} <= names
    assert out.where("route <> 'summarize'").select("id", "url", F.col("title")).exceptAll(plain.select("id", "url", "title")).count() == 0


def test_request_rules(spark, tables):
    """Names, defaults, ranges and lists of requests."""
    ids = lambda **more: [r.chunk_id for r in service.found(tables, X.as_of(), catalog.SEARCH, **({"include_contextual": True, "search_mode": "keyword"} | more)).collect()]
    plain = ids()
    assert 0 < len(plain) <= 6 and ids(source_names=[], categories=None, collection="updates") == plain
    assert ids(source_names=[" SRC2 ", "src2", "Src4"]) == ids(source_names=["src2", "src4"])
    assert ids(tools=[" tool1 "]) == ids(tools=["tool1"]) != [] and ids(tools=["TOOL1"]) == []
    assert ids(event_types=["Guide"]) == ids(event_types=["guide"])
    assert ids(published_after="2024-01-05", published_before="2024-01-20") == ids(start="2024-01-05", end="2024-01-20") != []
    for bad in ({"top_k": 0}, {"top_k": 21}, {"collection": "other"}, {"other": 1}, {"tools": "tool1"}, {"search_mode": "none"}):
        with pytest.raises(ValueError):
            ids(**bad)
    say = lambda q, c: answer.Generated("It says so [1].", "stop", 10, 5)
    for bad in ({"min_similarity": 1.1}, {"max_context_tokens": 499}, {"max_context_tokens": 12001}, {"max_completion_tokens": 49}):
        with pytest.raises(ValueError):
            service.asked(tables, X.as_of(), catalog.SEARCH, say, **bad)
