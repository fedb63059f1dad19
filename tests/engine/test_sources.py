"""Pages, feeds, fetching, stores, logs and streams."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from weftline import schemas
from weftline.functions import documents
from weftline.operators import collection, ingest
from weftline.plans import catalog, fixtures
from weftline.providers import HashedEmbedder
from weftline.sources import feeds, fetch, html, logs, store
from weftline.streaming import jobs, windows

BODY = "<p>" + "Real words of an article. " * 30 + "</p>"
PAGE = f"""<html><head><meta name="date" content=""><script type="application/ld+json">{{"@graph": [{{"x": {{"datePublished": "2024-03-05"}}}}]}}</script></head>
<body><nav>menu</nav><time datetime="1999-01-01">old</time><main class="a b"><h1>Big <b>title</b></h1>{BODY}<footer>foot</footer><script>var x = "</p>";</script></main></body></html>"""


def test_article():
    a = html.article(PAGE, title="Feed title")
    assert a["title"] == "Feed title" and a["published"] == "2024-03-05" and a["extraction_status"] == "full_article"
    assert "Real words" in a["body"] and "menu" not in a["body"] and "foot" not in a["body"] and "var x" not in a["body"]
    assert html.article(PAGE, listing=True)["title"] == "Big title"
    assert html.article("<main>short</main>")["error"] == "content_incomplete"
    assert html.article(PAGE.replace("Real", "Enable JavaScript and cookies"))["error"] == "content_incomplete"
    meta = PAGE.replace('<meta name="date" content="">', '<meta property="article:published_time" content="2020-01-02">')
    assert html.article(meta)["published"] == "2020-01-02"
    timed = PAGE.replace("datePublished", "other")
    assert html.article(timed)["published"] == "1999-01-01"
    assert html.article(timed.replace("datetime=", "x="), published="2001-01-01")["published"] == "2001-01-01"
    assert html.article(f"<div id='c'><span class='d'>May 4, 2023</span>{BODY}</div>", selector="#c", date_selector="span.d")["published"] == "May 4, 2023"
    assert html.article(None)["error"] and html.article("<p>" * 5000)["error"]


def test_selectors():
    page = html.parse("<div class='x'><p id=q>a</p><ul><li><p>b</p></li></ul></div><p>c</p>")
    texts = lambda s: [n.text() for n in page.select(s)]
    assert texts("p") == ["a", "b", "c"] and texts(".x p") == ["a", "b"] and texts("div li p, #q") == ["a", "b"] and texts("p[id=q]") == ["a"]
    page = html.parse("<div class='HeroEngineering_x Hero__date_1' data-k='a-b'><span>one</span><b><span>two</span></b></div><p>x</p><ul lang=en-GB><li>y</li></ul>")
    assert texts("[class*='HeroEngineering'][class*='__date']") == ["one two"] and texts("div > span") == ["one"] and texts("div span") == ["one", "two"]
    assert texts("[class^='Hero']") == ["one two"] and texts('[data-k$="-b"]') == ["one two"] and texts("[lang|=en] li") == ["y"] and texts("[class~=Hero__date_1]>b>span") == ["two"]
    assert texts("div + p") == ["x"] and texts("div ~ ul") == ["y"] and texts("p, span") == ["one", "two", "x"] and texts("[class*='']") == [] and texts("div [data-k]") == []
    with pytest.raises(ValueError):
        list(page.select("p:hover"))


def test_listing():
    page = """<a href="/post/one">One  thing</a><a href="/post/one">again</a><a href="/about">x</a><a href="/post/two"> </a><a href="/post/two">Two Mar 3, 2024</a><a href="">y</a>"""
    out = html.listing(page, "https://e.com/list", "^/post/")
    assert [(e["title"], e["link"], e["published"]) for e in out] == [("One thing", "https://e.com/post/one", ""), ("Two Mar 3, 2024", "https://e.com/post/two", "Mar 3, 2024")]
    assert html.text_lines("<p>a</p> <p> b<br>c</p>") == "a\nb\nc"


RSS = """<rss><channel><item><title>A &amp; b</title><link>https://e.com/1</link><description>&lt;p&gt;Hi&lt;/p&gt;</description><pubDate>2024-03-05</pubDate><category>x</category><category>y</category></item>
<item><title>Two</title><link>https://e.com/2</link></item></channel></rss>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text(RSS)
    rows = feeds.read_feed(spark, str(tmp_path / "f.xml")).orderBy("link").collect()
    assert [(r.title, r.link, r.html, r.published, r.tags) for r in rows] == [("A & b", "https://e.com/1", "<p>Hi</p>", "2024-03-05", ["x", "y"]), ("Two", "https://e.com/2", None, None, [])]
    df = spark.createDataFrame([("s", RSS), ("t", "<rss></rss>")], "source_name string, xml string")
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">T &amp;amp; U</title><link rel="self" href="https://e.com/self"/><link href="https://e.com/9"/><id>urn:9</id>
<updated>2024-03-06T00:00:00Z</updated><content type="html">&lt;p&gt;Long&lt;/p&gt;</content><summary>short</summary><category term="k"/></entry></feed>"""
    more = """<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><item><title>C</title><guid>https://e.com/g</guid><description>d</description><content:encoded>whole</content:encoded><pubDate>Tue, 05 Mar 2024 10:00:00 +0100</pubDate></item></channel></rss>"""
    rows = {r.source_name: r for r in feeds.parse_feeds(spark.createDataFrame([("a", atom), ("c", more)], "source_name string, xml string")).collect()}
    a, c = rows["a"], rows["c"]
    assert (a.link, a.html, a.updated, a.tags, a.error) == ("https://e.com/9", "<p>Long</p>", "2024-03-06T00:00:00Z", ["k"], None) and a.title.startswith("T &")
    assert (c.title, c.link, c.html, c.published) == ("C", "https://e.com/g", "whole", "Tue, 05 Mar 2024 10:00:00 +0100")
    kept = feeds.dated(spark.createDataFrame([(c.published, None)], "published string, updated string"), F.lit(True))
    assert kept.first().published_at == dt.datetime(2024, 3, 5, 9)
    got = {(r.source_name, r.position, r.title, r.error) for r in feeds.parse_feeds(df).collect()}
    assert got == {("s", 0, "A & b", None), ("s", 1, "Two", None), ("t", None, None, "could not parse feed")}
    entries = feeds.read_feed(spark, str(tmp_path / "f.xml")).withColumn("source_name", F.lit("s")).withColumn("extraction_status", F.lit(None).cast("string"))
    dated = feeds.dated(entries, F.lit(True))
    assert dated.count() == 1
    c = feeds.candidates(dated, F.lit(dt.datetime(2024, 4, 1))).first()
    assert (c.title, c.raw_text, c.extraction_status, c.content_detail, c.excerpt) == ("A & b", "A & b\n\nHi", "source_entry", "sparse", "Hi")


@pytest.mark.parametrize(
    "options,ok",
    [({}, True), (dict(prefixes=["new"]), False), (dict(excluded=["Sponsored"]), False), (dict(terms=["agent"]), True), (dict(terms=["age"]), False), (dict(terms=["tool  use"]), True), (dict(terms=["c++"]), False)],
)
def test_entry_filters(spark, options, ok):
    df = spark.createDataFrame([(" New things", ["sponsored "], "An agent with tool\nuse")], "t string, g array<string>, x string")
    assert df.select(feeds.matches_source(F.col("t"), F.col("g"), F.col("x"), **options).alias("r")).first().r is ok


def test_cap(spark):
    df = spark.createDataFrame([(s, p) for s in "ab" for p in range(5)], "source_name string, position int")
    assert sorted(map(tuple, feeds.capped(df, 2).collect())) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def test_retries():
    waits, answers = [], iter([fetch.Response(None), fetch.Response(503, retry_after="99"), fetch.Response(200, "ok")])
    assert fetch.get("u", lambda _: next(answers), waits.append).text == "ok" and waits == [1.0, 10.0]
    asked = []
    assert fetch.get("u", lambda u: asked.append(u) or fetch.Response(404), waits.append).status == 404 and len(asked) == 1
    assert fetch.get("u", lambda u: fetch.Response(500), lambda _: None).status == 500


def test_fetching_by_partition(spark):
    df = spark.createDataFrame([("u1",), ("u2",)], "url string")
    out = fetch.fetched(df, lambda u: fetch.Response(200 if u == "u1" else 404, f"<p>{u}</p>")).collect()
    assert {(r.url, r.http_status, r.html) for r in out} == {("u1", 200, "<p>u1</p>"), ("u2", 404, "<p>u2</p>")}
    failed = spark.createDataFrame([(None, " <p>x</p>", None, 404, None), (None, None, None, None, "network")], "content string, summary string, description string, http_status int, error_kind string")
    assert [(r.extraction_status, r.error_code) for r in fetch.failed_entries(failed).collect()] == [("feed_excerpt_only", "http_not_found"), ("title_only", "network_error")]


def test_store(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    new = spark.createDataFrame([("2", "c"), ("3", "d")], "id string, v string")
    merged = store.upserted(rows, new)
    assert sorted(map(tuple, merged.collect())) == [("1", "a"), ("2", "c"), ("3", "d")]
    assert store.upserted(None, new) is new
    chunks = spark.createDataFrame([("1", "x"), ("2", "y")], "document_id string, content string").withColumn("content_hash", F.lit("h"))
    out = store.replaced_chunks(chunks, new, spark.createDataFrame([("2", "new")], "document_id string, content string"))
    assert sorted((r.document_id, r.content) for r in out.collect()) == [("1", "x"), ("2", "new")]
    assert store.cascaded(out, merged.where("id <> '1'")).count() == 1


def files(path):
    return {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_a_batch_writes_its_own_rows_alone(spark, tmp_path):
    t = store.BatchTable(spark, str(tmp_path), "docs")
    rows = lambda *r: spark.createDataFrame(list(r), "id string, v string")
    assert t.read() is None and t.batches() == []
    t.put(rows(*((str(k), "a") for k in range(50))), 0)
    before = files(tmp_path)
    t.put(rows(("7", "b"), ("new", "c")), 1)
    assert before.items() <= files(tmp_path).items() and t.rows().where("_batch = 1").count() == 2
    got = {r.id: r.v for r in t.read().collect()}
    assert len(got) == 51 and got["7"] == "b" and got["8"] == "a" and got["new"] == "c"
    # a key may have many rows, or lose all
    t.put(rows(("9", "z"), ("9", "y")), 2, rows(("8", ""), ("9", "")).select("id"))
    got = sorted((r.id, r.v) for r in t.read().where("id in ('8', '9')").collect())
    assert got == [("9", "y"), ("9", "z")]
    t.put(rows().limit(0), 3)
    assert t.read().count() == 51
    # as of an earlier batch, and written again
    assert {r.id: r.v for r in t.read(upto=0).collect()} == {str(k): "a" for k in range(50)}
    t.put(rows(("7", "other")), 1)
    got = {r.id: r.v for r in t.read().where("id in ('7', 'new')").collect()}
    assert got == {"7": "other"}


def test_old_batches_go(spark, tmp_path):
    t = store.BatchTable(spark, str(tmp_path), "docs", "k")
    for k in range(4):
        t.put(spark.createDataFrame([(k, k), (9, k)], "k int, v int"), k)
    want = sorted(map(tuple, t.read().collect()))
    assert t.compact(2) == [0, 1] and t.batches() == [2, 3]
    assert sorted(map(tuple, t.read().collect())) == want == [(0, 0), (1, 1), (2, 2), (3, 3), (9, 3)]
    assert t.compact(2) == []


def test_lock(spark, tmp_path):
    with store.run_lock(spark, str(tmp_path)) as mine:
        assert mine
        with store.run_lock(spark, str(tmp_path)) as other:
            assert not other
    with store.run_lock(spark, str(tmp_path)) as mine:
        assert mine


def test_a_dead_runs_lock_is_taken_over(spark, tmp_path):
    path = tmp_path / "LOCK"
    path.write_text(json.dumps({"owner": "gone", "token": 41, "expires": time.time() - 1}))
    with store.run_lock(spark, str(tmp_path)) as mine:
        assert mine and mine.token > 41
        mine.check()
    assert not path.exists()
    path.write_text("half a li")  # a writer that may still write, and one that died while it wrote
    with store.run_lock(spark, str(tmp_path)) as mine:
        assert mine is None
    os.utime(path, (time.time() - 500,) * 2)
    with store.run_lock(spark, str(tmp_path)) as mine:
        assert mine
    path.write_text(json.dumps({"owner": "alive", "token": 41, "expires": time.time() + 60}))
    with store.run_lock(spark, str(tmp_path)) as mine:
        assert mine is None
    assert json.loads(path.read_text())["owner"] == "alive"


def test_a_lease_is_renewed_while_the_run_lives_and_told_when_it_is_lost(spark, tmp_path):
    with store.run_lock(spark, str(tmp_path), lease=4) as mine:
        time.sleep(6)
        with store.run_lock(spark, str(tmp_path)) as other:
            assert other is None
        mine.check()
    with store.run_lock(spark, str(tmp_path), lease=60) as mine:
        store._put(spark, str(tmp_path / "LOCK"), json.dumps({"owner": "another", "token": mine.token + 1, "expires": time.time() + 60}), overwrite=True)
        for act in (mine.check, mine.renew):
            with pytest.raises(RuntimeError, match="another run"):
                act()
    assert json.loads((tmp_path / "LOCK").read_text())["owner"] == "another"  # not deleted by who lost it


def test_embeddings_need_equal_lengths(spark):
    c = spark.createDataFrame([("1", ["a", "b"])], "document_id string, chunks array<string>")
    v = spark.createDataFrame([("1", [[1.0], [2.0]])], "document_id string, vectors array<array<float>>")
    assert [(r.chunk_index, r.content, r.embedding) for r in store.with_embeddings(c, v).collect()] == [(0, "a", [1.0]), (1, "b", [2.0])]
    with pytest.raises(Exception, match="as many embeddings"):
        store.with_embeddings(c, v.withColumn("vectors", F.slice("vectors", 1, 1))).collect()


def test_log_lines(spark):
    row = spark.sql(
        """select 'sk-field-secret123' as api_key, 'postgresql://app:database-password@db/app' as database_url, 42 as prompt_tokens, 1.5D as share, true as ok, cast(null as string) as none,
        'Bearer bearer-secret and sk-value-secret123 and postgresql://user:password@db/app' as detail, 'own' as logger, date'2024-01-02' as day,
        named_struct('b', array(named_struct('password', 'p', 'n', 1)), 'a', map('z', 'Bearer x', 'cookie', 'y')) as deep, 'é "q" 🤖' as text"""
    )
    fields = row.columns
    time = F.lit(dt.datetime(2024, 1, 1, 0, 0, 0, 250000))
    line = row.select(logs.lines(row, time, F.lit("INFO"), F.lit("app"), F.lit("done"), fields).alias("x")).first().x
    got = json.loads(line)
    assert line == json.dumps(got, separators=(",", ":"), sort_keys=True)
    assert got == {
        "api_key": "[REDACTED]", "database_url": "[REDACTED]", "prompt_tokens": 42, "share": 1.5, "ok": True, "none": None, "level": "info", "logger": "own", "event": "done",
        "detail": "Bearer [REDACTED] and [REDACTED] and postgresql://user:[REDACTED]@db/app", "day": "2024-01-02", "timestamp": "2024-01-01T00:00:00.250000+00:00",
        "deep": {"a": {"cookie": "[REDACTED]", "z": "Bearer [REDACTED]"}, "b": [{"n": 1, "password": "[REDACTED]"}]}, "text": 'é "q" 🤖',
    }
    said = row.select(logs.lines(row, F.lit(dt.datetime(2024, 1, 1)), F.lit("ERROR"), F.lit("app"), F.lit(""), (), F.lit("password=x"), F.lit("KeyError")).alias("x")).first().x
    assert json.loads(said) == {"exception_type": "KeyError", "level": "error", "logger": "app", "message": "password=[REDACTED]", "timestamp": "2024-01-01T00:00:00+00:00"}


def test_json_fields(spark):
    row = spark.createDataFrame([('{"a": 1, "b": null}', "[1, 2]")], "j string, l string")
    f = documents.fields(F.col("j"))
    r = row.select(documents.stripped(f).alias("s"), documents.with_field(f, "a", F.lit("9")).alias("w"), documents.without(f, "a").alias("o"), documents.has_any(f, "z", "b").alias("h"), documents.strings(F.col("l")).alias("l")).first()
    assert (r.s, r.w, r.o, r.h, r.l) == ({"a": "1"}, {"a": "9", "b": None}, {"b": None}, True, ["1", "2"])


def test_nested_documents(spark):
    rows = ['{"k": 89, "device": {"os": "a", "ver": "4.10"}, "tags": ["a", null, 3]}', '{"k": 4}', '{"k": 4, "dev', None, "[1]", '{"device": 5, "k": null}', '"x"', '{"device": {"in": {"x": 1.50, "y": [true]}}}']
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "i int, j string").withColumn("v", documents.parsed(F.col("j")))
    v = F.col("v")
    said = df.select(
        "i", documents.at(v, "$.k", "long").alias("k"), F.to_json(documents.with_path(v, ["device", "in", "x"], documents.variant(F.lit("s")))).alias("deep"),
        F.to_json(documents.with_path(v, ["n"], documents.variant(F.lit(2)))).alias("top"), F.to_json(documents.without_path(v, ["device", "os"])).alias("less"), documents.texts(v, "$.tags").alias("tags"),
    )
    got = {r.i: (r.k, *(json.loads(x) if x else None for x in (r.deep, r.top, r.less)), r.tags) for r in said.collect()}
    read = {k: json.loads(r) for k, r in enumerate(rows) if r and k != 2}
    for i, (k, deep, top, less, tags) in got.items():
        doc = read.get(i)
        assert k == (doc.get("k") if isinstance(doc, dict) else None) and tags == (["a"] if i == 0 else None)
        assert deep == ({"device": {"in": {"x": "s", "y": [True]}}} if i == 7 else doc)
        assert top == (doc | {"n": 2} if isinstance(doc, dict) else doc)
        assert less == ({**doc, "device": {"ver": "4.10"}} if i == 0 else doc)


def events(spark, rows):
    return spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), e, st, v) for s, e, st, v in rows], "ts timestamp, event string, status string, value double")


def test_signals(spark):
    df = events(spark, [(10, "collection_failed", None, 1.0), (20, "collection_completed", "failed", 2.0), (7300, "collection_completed", "success", 3.0)])
    assert [r.events for r in windows.over_threshold(windows.counted(windows.failed_runs(df), windows.FAILURE_PERIOD)).collect()] == [1]
    start, end = F.lit(dt.datetime(2024, 1, 1)), F.lit(dt.datetime(2024, 1, 1, 4))
    gone = windows.absent(windows.counted(windows.completed_runs(df), "1 hour"), 3600, start, end)
    assert sorted(r.window_start.hour for r in gone.collect()) == [0, 1, 3]
    series = windows.statistics(df, "value", "1 hour")
    assert sorted((r.minimum, r.maximum, r.total) for r in series.collect()) == [(1.0, 2.0, 3.0), (3.0, 3.0, 3.0)]
    marks = windows.sustained(spark.createDataFrame([(k, v) for k, v in enumerate([9, 9, 0, 9, 9, 9])], "window_start int, v int"), F.col("v") > 5, 2, 2)
    assert [r.alarm for r in marks.orderBy("window_start").collect()] == [False, True, False, False, True, True]


def test_stream_equals_batch(spark, tmp_path):
    batch = fixtures.log_events(spark, "/root/testdata/sf0.001")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    counts = windows.counted(windows.failed_runs(stream), "1 hour", late="10 minutes")
    q = counts.writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = sorted(map(tuple, windows.counted(windows.failed_runs(batch), "1 hour").collect()))
    assert sorted(map(tuple, spark.table("hourly").collect())) == want and want


RELEVANCE = lambda df: df.withColumn("tier", F.when(ingest.reuses(), F.col("old.relevance_tier")).otherwise(F.col("answer")))


def test_stream_of_candidates_goes_through_the_router(spark, tmp_path):
    new, _ = catalog.stored_and_new(spark, "/root/testdata/sf0.001")
    rows = new.withColumn("position", F.col("doc_id"))
    rows.write.parquet(str(tmp_path / "in"))
    articles, chunk_table, run_table = jobs.tables(spark, str(tmp_path))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    jobs.ingesting(stream, str(tmp_path), RELEVANCE, str(tmp_path / "cp")).awaitTermination(120)
    stored = articles.read().select(*schemas.ARTICLES.names)
    assert stored.count() == rows.select("url").distinct().count()
    assert schemas.violations(stored).count() == 0
    # those with a card of their own have chunks with vectors; the ledger has a row a source
    chunks = chunk_table.read()
    carded = stored.where("summary_generated_by = 'deterministic-fallback'").select("id")
    assert {r.document_id for r in chunks.select("document_id").distinct().collect()} == {r.id for r in carded.collect()}
    assert chunks.where("size(embedding) = 0 or token_count > 650").count() == 0
    runs = run_table.read()
    assert runs.agg(F.sum("matched_items")).first()[0] == stored.count() and runs.agg(F.sum("chunks_written")).first()[0] == chunks.count()
    # the same candidates again change nothing but dates
    again = ingest.routed(RELEVANCE(ingest.matched(rows, stored)))
    assert {r.status for r in again.select("status").distinct().collect()} <= {"unchanged", "quarantined"}


@pytest.mark.parametrize("stops", ["chunks", "articles", "runs", "after"])
def test_a_run_that_stops_anywhere_and_runs_again_leaves_what_one_leaves(spark, tmp_path, stops):
    new, _ = catalog.stored_and_new(spark, "/root/testdata/sf0.001")
    rows = new.withColumn("position", F.col("doc_id")).where("doc_id < 40")
    both = {}
    for name in ("once", "twice"):
        three = jobs.tables(spark, str(tmp_path / name))
        run = jobs.ingest_batch(*three, RELEVANCE, HashedEmbedder())
        run(rows.where("doc_id < 30"), 0)
        if name == "twice":
            for t, step in zip((three[1], three[0], three[2]), ("chunks", "articles", "runs"), strict=True):
                if step == stops:
                    t.put = lambda *a: (_ for _ in ()).throw(OSError("stopped"))
            try:
                run(rows.where("doc_id >= 20"), 1)
                assert stops == "after"
            except OSError:
                # what was not committed does not count
                assert collection.committed(three[2]) == 0
                assert three[0].read(upto=0).count() == 30
            three = jobs.tables(spark, str(tmp_path / name))
            run = jobs.ingest_batch(*three, RELEVANCE, HashedEmbedder())
        run(rows.where("doc_id >= 20"), 1)
        assert collection.committed(three[2]) == 1
        both[name] = [sorted(map(str, t.read().drop("started_at", "finished_at").collect())) for t in three]
    assert both["once"] == both["twice"] and all(both["once"])


def test_silence_is_told_once(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    def write(name, rows):
        spark.createDataFrame([(s, start + dt.timedelta(seconds=t)) for s, t in rows], "source string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    write("1", [("a", 0), ("b", 0), ("a", 30)])
    stream = lambda: spark.readStream.schema("source string, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run():
        jobs.started(jobs.silences(stream(), 600), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)

    run()
    write("2", [("a", 3000)])
    run()
    write("3", [("a", 3100)])
    run()
    got = sorted((r.key, r.last_seen) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert ("b", start) in got and all(k in "ab" for k, _ in got)
    assert len(got) == len(set(got))
