"""Feed, retrieval, context, gate and router."""

import datetime as dt
import itertools

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftline import providers, schemas
from weftline.functions.chunking import BpeCounter, chunk_text, count_words
from weftline.functions.quotes import supported
from weftline.operators import context, feed, gate, ingest, search
from weftline.sources.registry import registry, selected

NOW = dt.datetime(2024, 2, 1)
SOURCE = dict(slug="a", name="A", organization="Org", tool="T", homepage_url="https://a", feed_url="https://a/f", source_kind="rss", default_primary_topic="data-search-retrieval", credibility_weight=1.0)


def article(k, **more):
    row = dict(
        id=f"id{k}", source_name="a", title=f"Title {k}", url=f"https://a/{k}", raw_text=f"Title {k}\n\nBody text.", content_hash=f"h{k}", fetched_at=NOW, published_at=NOW - dt.timedelta(days=1),
        ingestion_status="published", extraction_status="full_article", relevance_tier="core", relevance_reason=None, relevance_policy_version=None, primary_topic=None, event_types=["guide"],
        display_headline=None, summary=None, why_it_matters=None, key_points=[], summary_generated_by=None,
    )
    return row | more


def table(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in schemas.ARTICLES) for r in rows], schemas.ARTICLES)


@pytest.fixture(scope="module")
def sources(spark):
    return registry(spark, [SOURCE, SOURCE | dict(slug="b", feed_url="https://b/f", source_type="analysis", tool="U")])


def test_registry_is_checked(spark, sources):
    with pytest.raises(ValueError, match="twice"):
        registry(spark, [SOURCE, SOURCE])
    with pytest.raises(ValueError, match="lacks"):
        registry(spark, [SOURCE | dict(tool="")])
    assert [r.slug for r in selected(sources, ["b"]).collect()] == ["b"]
    with pytest.raises(ValueError, match="unknown"):
        selected(sources, ["b", "z"])


def test_visibility_truth_table(spark, sources):
    rows = [article(f"{s}-{t}-{n}", ingestion_status=s, relevance_tier=t, source_name=n) for s, t, n in itertools.product(("published", "quarantined"), ("core", "contextual", "excluded", None), ("a", "zz"))]
    df = table(spark, rows)
    assert {r.id for r in feed.visible(df, sources).collect()} == {"idpublished-core-a"}
    assert {r.id for r in feed.visible(df, sources, True).collect()} == {"idpublished-core-a", "idpublished-contextual-a"}


def test_equal_scores_rank_by_date_then_id_whatever_the_order(spark, sources):
    old = article(9, published_at=NOW - dt.timedelta(days=300), raw_text="x")
    older = article(8, published_at=NOW - dt.timedelta(days=301), raw_text="x")
    rows = [article(1), article(2), article(3), old, older]
    for order in (rows, rows[::-1]):
        out = feed.page(table(spark, order), sources, feed.FeedRequest(F.lit(NOW), window="all")).collect()
        assert [r.id for r in out] == ["id3", "id2", "id1", "id9", "id8"]
    assert [r.id for r in feed.page(table(spark, rows), sources, feed.FeedRequest(F.lit(NOW), window="all", offset=1, limit=2)).collect()] == ["id2", "id1"]


def test_window_is_inclusive_and_filters_combine(spark, sources):
    rows = [article(1, published_at=NOW - dt.timedelta(days=7)), article(2, published_at=NOW), article(3, published_at=NOW + dt.timedelta(seconds=1)), article(4, published_at=None), article(5, source_name="b", event_types=["alert"])]
    df = table(spark, rows)
    ids = lambda **more: {r.id for r in feed.matching(df, sources, feed.FeedRequest(F.lit(NOW), **more)).collect()}
    assert ids(window="week") == {"id1", "id2", "id5"}
    assert ids(window="all", tools=["U"]) == {"id5"} and ids(window="all", tools=["none"]) == set()
    assert ids(window="all", categories=["developer-tools"], event_types=["alert"], source_types=["analysis"]) == {"id5"}
    assert ids(window="all", source_types=["official-release"]) == {"id1", "id2"}
    with pytest.raises(ValueError):
        feed.FeedRequest(F.lit(NOW), limit=0)
    shown = feed.page(df, sources, feed.FeedRequest(F.lit(NOW), window="week", tools=["U"])).first()
    assert (shown.display_headline, shown.summary, shown.source_type, shown.primary_topic) == ("Title 5", "Body text.", "analysis", "developer-tools")


def test_facets_ignore_the_window(spark, sources):
    df = table(spark, [article(1, published_at=None, event_types=["alert", "guide"]), article(2, relevance_tier=None, event_types=["research"])])
    got = {(r.facet, r.value) for r in feed.facets(df, sources).collect()}
    assert got == {("categories", "developer-tools"), ("source_types", "official-release"), ("event_types", "alert"), ("event_types", "guide"), ("sources", "a"), ("sources", "b"), ("tools", "T"), ("tools", "U")}
    assert feed.stats(df, sources, feed.FeedRequest(F.lit(NOW))).first().total_updates == 0


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, document_id string, content string, embedding array<float>")


def test_legs_merge_and_diversity(spark, sources):
    docs = table(spark, [article(k, title=f"Agent {k}") for k in range(4)])
    rows = [(10 * k + c, f"id{k}", f"Agent {k}" if c == 0 else f"agent memory part {c}", [1.0, float(k + c)]) for k in range(4) for c in range(4)]
    query = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    request = search.SearchRequest("agent memory", F.lit(NOW), top_k=5)
    out = search.search(chunk_rows(spark, rows), docs, sources, request, query).collect()
    assert len(out) == 5
    assert max(sum(r.document_id == d for r in out) for d in {r.document_id for r in out}) <= 2
    assert all("part" in r.content for r in out)  # bare titles give way
    assert [r.combined_score for r in out] == sorted((r.combined_score for r in out), reverse=True)
    only = search.search(chunk_rows(spark, rows), docs, sources, search.SearchRequest("zzz", F.lit(NOW), search_mode="keyword"), query)
    assert only.collect() == [] and search.weak(only, 0.3).first().weak


def test_similarity_has_three_scales(spark):
    found = spark.createDataFrame([(1, "d", 0.8, None), (2, "d", None, 2.0), (3, "d", 0.5, 1.0)], "chunk_id long, document_id string, vector_similarity double, keyword_score double").withColumn("recency_score", F.lit(1.0))
    got = {r.chunk_id: r for r in search.ranked(found, "hybrid").collect()}
    assert got[1].similarity == 0.8 and got[2].similarity == 1.0
    assert got[3].similarity == round(0.6 * 0.5 + 0.25 * 0.5 + 0.15, 4)


def test_context_skips_what_does_not_fit(spark):
    rows = [(1, "d1", "u1", "word " * 30, 1), (2, "d1", "u1/", "word " * 30, 2), (3, "d2", "u2", "word " * 500, 3), (4, "d3", "u3", "tiny", 4)]
    df = spark.createDataFrame(rows, "chunk_id long, document_id string, url string, content string, rank int").withColumn("title", F.lit("T")).withColumn("source_name", F.lit("s")).withColumn("published", F.lit(None).cast("string")).withColumn("tool", F.lit(None).cast("string"))
    ordered = context.diverse_order(df)
    assert [r.chunk_id for r in ordered.orderBy("place").collect()] == [1, 3, 4, 2]
    one = context.packed(ordered, 160).first()
    assert one.chunk_ids == ["1", "4", "2"]
    assert one.context.startswith("[1] T\nSource: s\nPublished: unknown\nTool: unknown\nURL: u1\nword") and "\n\n---\n\n[2] T" in one.context
    assert context.packed(ordered.where("chunk_id = 3"), 5).first().chunk_ids == ["3"]


def test_context_keeps_the_budget_of_a_tokenizer(spark):
    count = BpeCounter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    words = ["größer", "x9-y", "internationalization", "😀", "a", "it's"]
    rows = [(k, str(k), f"T{k}", "s", None, "t", f"u{k}", " ".join(words[(k + j) % 6] for j in range(20 + 13 * k % 40))) for k in range(1, 25)]
    df = spark.createDataFrame(rows, "place int, chunk_id string, title string, source_name string, published string, tool string, url string, content string")
    for budget in (10, 300, 900, 100_000):
        got = context.packed(df, budget, counts=context.counted_by(count)).first()
        blocks = got.context.split(context.JOINT)
        sizes = [count((context.JOINT if k else "") + b) for k, b in enumerate(blocks)]
        assert got.tokens == sum(sizes) and (got.tokens <= budget or len(blocks) == 1) and len(blocks) == len(got.chunk_ids)
        # one by one, as a plain loop takes them
        ids, tokens = [], 0
        for r in rows:
            text = f"[{len(ids) + 1}] {r[2]}\nSource: s\nPublished: unknown\nTool: t\nURL: {r[6]}\n{r[7]}"
            n = count((context.JOINT if ids else "") + text)
            if not ids or tokens + n <= budget:
                ids.append(r[1])
                tokens += n
        assert (got.chunk_ids, got.tokens) == (ids, tokens)


@pytest.mark.parametrize(
    "detail,extraction,events,codes",
    [
        ("detailed", "full_article", [], []), ("sparse", "full_article", ["alert"], []), ("sparse", "full_article", ["guide"], ["insufficient_source_detail"]),
        ("sparse", "title_only", [], ["article_hydration_failed", "title_only_source", "insufficient_source_detail"]), ("detailed", "feed_excerpt_only", [], ["article_hydration_failed"]),
    ],
)
def test_gate(spark, detail, extraction, events, codes):
    row = spark.createDataFrame([(detail, extraction, events)], "d string, x string, e array<string>")
    found = gate.failure_codes(F.col("d"), F.col("x"), F.col("e"))
    r = row.select(found.alias("c"), gate.gate_status(found).alias("s")).first()
    assert r.c == codes and r.s == ("published" if not codes else "quarantined")


LONG = "This sentence has well over six words in it. " * 10


def candidate(spark, **more):
    row = dict(source_name="a", title="Title 1", raw_text="Title 1\n\n" + LONG, content_hash="new", published_at=NOW, fetched_at=NOW, extraction_status="full_article", url="https://a/1", content_detail="detailed", excerpt="Ex", default_topic="data-search-retrieval", provisional_topic="vision-speech-robotics", provisional_events=["guide"], tier="core") | more
    types = {"published_at": "timestamp", "fetched_at": "timestamp", "provisional_events": "array<string>"}
    return ingest.gated(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {types.get(k, 'string')}" for k in row)))


@pytest.mark.parametrize(
    "stored,new,route,status",
    [
        (article(1), dict(extraction_status="title_only", content_detail="sparse"), "keep_stored", "unchanged"),
        (article(1), dict(tier=None), "keep_relevance", "unchanged"),
        (article(1, relevance_tier=None), dict(tier=None), "await_relevance", "changed"),
        (None, dict(tier=None), "await_relevance", "created"),
        (article(1, content_hash="new"), dict(tier="excluded"), "excluded_card", "unchanged"),
        (article(1, content_hash="new"), {}, "refresh", "unchanged"),
        (article(1, content_hash="new", extraction_status="source_entry", raw_text="x"), dict(content_detail="sparse"), "refresh", "quarantined"),
        (article(1, extraction_status="source_entry", raw_text="x"), dict(content_detail="sparse"), "quarantine", "quarantined"),
        (None, dict(content_detail="sparse"), "quarantine", "quarantined"),
        (None, {}, "summarize", "created"),
        (article(1), {}, "summarize", "changed"),
        (article(1, content_hash="new", relevance_tier=None), {}, "summarize", "changed"),
    ],
)
def test_routes(spark, stored, new, route, status):
    rows = ingest.routed(ingest.matched(candidate(spark, **new), table(spark, [stored] if stored else [])))
    r = rows.first()
    assert (r.route, r.status) == (route, status)
    w = ingest.written(rows, schemas.ARTICLES.names).first()
    if route in ("keep_stored", "keep_relevance"):
        assert (w.title, w.content_hash, w.fetched_at, w.drops_chunks) == (stored["title"], stored["content_hash"], NOW, False)
    elif route == "excluded_card":
        assert (w.summary, w.display_headline, w.why_it_matters, w.primary_topic, w.event_types) == ("Ex", "Title 1", None, "vision-speech-robotics", ["guide"])
    elif route == "refresh":
        assert w.event_types == stored["event_types"] and w.drops_chunks == (status == "quarantined") and w.ingestion_status == ("published" if status == "unchanged" else "quarantined")
    elif route == "summarize":
        assert w.summary_generated_by == "deterministic-fallback" and w.relevance_tier == "core" and w.summary.startswith("This sentence")
    elif route == "quarantine":
        assert w.summary is None and w.ingestion_status == "quarantined" and w.url == "https://a/1"
    assert schemas.violations(ingest.written(rows, schemas.ARTICLES.names)).count() == 0


def test_identity_by_address_or_content(spark):
    stored = table(spark, [article(5, url="https://a/1/"), article(4, url="https://z", title="Title 1", content_hash="new"), article(6, url="https://zz", title="Title 1", content_hash="new", source_name="b")])
    assert ingest.matched(candidate(spark), stored).first().old.id == "id5"
    assert ingest.matched(candidate(spark, url="https://q"), stored).first().old.id == "id4"
    assert ingest.matched(candidate(spark, url="https://q", content_hash="x"), stored).first().old is None


def rows_out(plan):
    """(node, rows) of every join that a plan ran."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    if "QueryStage" in plan.getClass().getSimpleName():
        plan = plan.plan()
    out = []
    if "Join" in plan.nodeName() and plan.metrics().contains("numOutputRows"):
        out.append((plan.nodeName(), plan.metrics().apply("numOutputRows").value()))
    kids = plan.children()
    for k in range(kids.size()):
        out += rows_out(kids.apply(k))
    return out


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_content_that_repeats_meets_once(spark, threshold):
    """Every join puts out at most a row a candidate or stored row, with one content on all of both sides."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        n = 100_000
        one = candidate(spark)
        many = one.crossJoin(spark.range(n).select(F.concat(F.lit("https://new/"), F.col("id").cast("string")).alias("_u"))).withColumn("url", F.col("_u")).drop("_u")
        stored = table(spark, [article(5, content_hash=one.first().content_hash, title=one.first().title, source_name=one.first().source_name)])
        stored = stored.crossJoin(spark.range(n).withColumnRenamed("id", "_k")).withColumn("id", F.concat(F.lit("s"), F.lpad(F.col("_k").cast("string"), 7, "0"))).withColumn("url", F.concat(F.lit("https://old/"), F.col("_k").cast("string"))).drop("_k")
        got = ingest.matched(many, stored).select(F.col("old.id").alias("i")).groupBy("i").count()
        assert [tuple(r) for r in got.collect()] == [("s0000000", n)]
        found = [r for r in rows_out(got._jdf.queryExecution().executedPlan()) if r[0] != "BroadcastNestedLoopJoin"]
        assert len(found) >= 4 and max(r for _, r in found) <= 2 * n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_model_cards_and_fallback_cards_write_the_same_rows(spark):
    rows = ingest.routed(ingest.matched(candidate(spark), table(spark, [])))
    one = ingest.written(rows, schemas.ARTICLES.names)
    kept = []
    two = ingest.written(rows, schemas.ARTICLES.names, lambda df: ingest.fallback_card(df), keep=lambda df: kept.append(df) or df)
    assert one.collect() == two.collect() and len(kept) == 1
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0


def test_one_candidate_an_address_a_batch(spark):
    df = spark.createDataFrame([("u", 1, "x"), ("u", 2, "y"), ("v", 1, "z")], "url string, position int, t string")
    assert sorted(r.t for r in ingest.last_of_batch(df).collect()) == ["y", "z"]


def test_run_accounts(spark):
    df = spark.createDataFrame([("a", "created"), ("a", "changed"), ("b", "quarantined")], "source_name string, status string")
    assert [tuple(r) for r in ingest.run_totals(df).orderBy("source_name").collect()] == [("a", 2, 1, 1, 0, 0), ("b", 1, 0, 0, 0, 1)]
    status = lambda p, e: spark.range(1).select(ingest.run_status(F.lit(p), F.lit(e)).alias("x")).first().x
    assert (status(1, 0), status(1, 1), status(0, 1)) == ("success", "partial_success", "failed")


def test_chunks():
    text = "Title\n\n" + "word " * 2000
    out = chunk_text(text, 100, 20)
    assert [c for _, c, _ in out[:2]] == ["Title", "Title"] and out[2][0] == 2
    assert all(n <= 100 and c in text for _, c, n in out)
    assert chunk_text("a\n\nb\n\nc", 100, 20) == [(0, "a\n\nb\n\nc", 3)]
    assert chunk_text("one two three\n\nfour five\n\nsix seven", 5, 2) == [(0, "one two three\n\nfour five", 5), (1, "four five\n\nsix seven", 4)]
    assert chunk_text(None) == chunk_text(" \n\n ") == []
    odd = "é😀 " * 300
    assert "".join(c for _, c, _ in chunk_text(odd, 50, 0)).replace(" ", "") == odd.replace(" ", "")
    assert count_words("Hi, you!") == 4


@pytest.mark.parametrize(
    "quote,ok",
    [("agents that plan and act", True), ("Agents that PLAN, and act", True), ("we build agents ... memory for tools", True), ("agents that dream and fly", False), ("agents", False), ("we build ... unrelated words entirely here", False)],
)
def test_quotes(quote, ok):
    assert supported("Title", "Today we build agents that plan and act with memory for tools.", quote) is ok


def test_relevance_is_demoted_without_evidence(spark):
    class Model:
        def classify(self, titles, texts):
            return [dict(relevance_tier="core", relevance_reason="r", agent_focus=f, agent_evidence_quote=q) for f, q in (("central", "agents plan and act"), ("central", "not in the text at all"), ("supporting", "agents plan and act"), ("else", "agents plan and act"))][: len(titles)]

    df = spark.createDataFrame([(k, "T", "Here agents plan and act.") for k in range(4)], "k int, title string, raw_text string").coalesce(1)
    got = [(r.tier, r.reason) for r in providers.classified(df, Model()).orderBy("k").collect()]
    assert [t for t, _ in got] == ["core", "contextual", "contextual", None]
    assert got[1][1] == providers.UNSUPPORTED_CORE and "pending retry" in got[3][1]
    assert len(providers.HashedEmbedder(8).embed(["a b"])[0]) == 8


def test_model_cards_keep_valid_fields(spark):
    payloads = ['{"display_headline": " New  head ", "primary_topic": "Nonsense", "event_type": "Alert", "key_points": ["a", " "]}', "not json", None, '{"event_types": ["guide"], "primary_topic": "DATA-search-retrieval"}']
    rows = candidate(spark).crossJoin(spark.createDataFrame([(k, p) for k, p in enumerate(payloads)], "k int, payload string"))
    got = {r.k: r.card for r in ingest.model_card(rows).collect()}
    assert (got[0].display_headline, got[0].primary_topic, got[0].event_types, got[0].key_points, got[0].summary_generated_by) == ("New head", "vision-speech-robotics", ["alert"], ["a"], "model")
    assert got[0].summary.startswith("This sentence")
    assert got[1].summary_generated_by == got[2].summary_generated_by == "deterministic-fallback"
    assert got[3].primary_topic == "data-search-retrieval" and got[3].event_types == ["guide"]


def test_totals_leave_failed_sources_out(spark):
    runs = spark.createDataFrame([("a", 1, 2, 3, 4, 5, None), ("b", 1, 1, 1, 1, 1, "boom")], "s string, updates_created int, updates_changed int, updates_unchanged int, updates_quarantined int, chunks_written int, error string")
    assert tuple(ingest.collection_totals(runs).first()) == (1, 1, 2, 3, 4, 5, 1, "partial_success")


def test_answers(spark):
    from weftline.operators import answer

    rows = [(k, f"d{k % 2}", f"T{k}", "s", f"u{k % 2}", "tool", "2024-01-01", f"content {k}", 0.9 - k / 10, k + 1) for k in range(4)]
    results = spark.createDataFrame(rows, "chunk_id long, document_id string, title string, source_name string, url string, tool string, published string, content string, similarity double, rank int")
    seen = []

    def model(question, text):
        seen.append(text)
        return answer.Generated("It is so [2][9].", "length", 1_000_000, 0)

    out = answer.ask(results, answer.AskRequest("Compare a and b"), model).first()
    assert out.citations == ["1"] and out.estimated_cost == 0.4 and out.context_tokens > 0
    assert out.warnings == ["Answer referenced unknown citation [9].", answer.CUT]
    assert seen[0].index("T1") < seen[0].index("T2") and "[4] T3" in seen[0]
    weak = answer.ask(results, answer.AskRequest("x", min_similarity=0.95), model).first()
    assert weak.answer == "" and "0.900" in weak.warnings[0] and len(seen) == 1
    assert answer.ask(results.limit(0), answer.AskRequest("x"), model).first().warnings == [answer.NOTHING_FOUND]
