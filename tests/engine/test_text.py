"""Text, keyword, taxonomy, date, URL and display expressions."""

import datetime as dt
import os
import random
import urllib.parse

import pytest
from pyspark.sql import functions as F

from weftline.functions import chunking, dates, display, keywords, redact, scores, taxonomy, text, urls

#: Ranks of a public byte-pair encoding, where the machine has them, and a pattern of words.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def value(spark, column, **named):
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in named.items()))
    return row.select(column.alias("x")).first().x


def test_excerpts(spark):
    t, raw = F.col("t"), F.col("raw")
    assert value(spark, text.article_excerpt(t, raw), t="Title", raw="Title\n\nThe  body\nhere.") == "The body here."
    assert value(spark, text.article_excerpt(t, raw), t="Title", raw="Title") == "Title"
    long = "word " * 200
    out = value(spark, text.compact_excerpt(t), t=long)
    assert out == long[:419].rstrip() + "..." and len(out) <= 422
    assert value(spark, text.collapse(t), t=" a  b\n") == "a b"


@pytest.mark.parametrize("given,limit,want", [("short", 10, "short"), ("one two three four", 12, "one two..."), ("abcdefghijklmnop", 10, "abcdefg..."), ("a bcdefghijklmnop", 12, "a bcdefgh...")])
def test_shorten(spark, given, limit, want):
    assert value(spark, text.shorten(F.col("t"), limit), t=given) == want


def test_reason_is_cut_at_any_blank(spark):
    assert value(spark, text.shorten_reason(F.col("t"), 12), t="a bcdefghijklmnop") == "a..."


def test_clean_lists(spark):
    out = value(spark, text.clean_list(F.col("v"), F.array(F.lit("none")), 2, 8), v=[" a  b ", "  ", "long words here", "c"])
    assert out == ["a b", "long..."]
    assert value(spark, text.clean_list(F.col("v"), F.array(F.lit("none")), 2, 8), v=["  "]) == ["none"]
    assert value(spark, text.clean_text(F.col("t"), F.lit("none"), 20), t=" \n") == "none"


def test_detail(spark):
    long = "This sentence has well over six words in it. " * 10
    t, raw = F.col("t"), F.col("raw")
    assert value(spark, text.content_detail(t, raw), t="T", raw="T\n\n" + long) == "detailed"
    assert value(spark, text.content_detail(t, raw), t="T", raw="T\n\nShort one.") == "sparse"
    assert value(spark, text.content_detail(t, raw), t="T", raw="T\n\n" + "été " * 60) == "sparse"


def test_chunks_are_parts_of_the_text():
    text = "Updates 🇬🇧 🤖 🌷 — agent tools and evaluations. " * 300
    counters = [chunking.count_words]
    if os.path.exists(RANKS):
        counters.append(chunking.BpeCounter(RANKS, PATTERN))
    for count in counters:
        found = chunking.chunk_text(text, 80, 12, count)
        assert len(found) > 1 and all(c in text and n == count(c) <= 80 for _, c, n in found)
        found = chunking.chunk_text("agent orchestration and evaluation " * 200, 20, 20, count)
        assert len(found) > 1 and all(n <= 20 for _, _, n in found)
    assert [c for _, c, _ in chunking.chunk_text("a b\n\nc d\n\ne f", 4, 2)] == ["a b\n\nc d", "c d\n\ne f"]
    assert chunking.chunk_text(None) == [] and chunking.chunk_text(" \n\n ") == []


def plain_spans(text, most, overlap):
    """One character after the other."""
    count = chunking.count_words
    out, at = [], 0
    while at < len(text):
        end = at + 1
        while end < len(text) and count(text[at : end + 1]) <= most:
            end += 1
        out.append((at, end))
        if end >= len(text):
            return out
        nxt = at + 1
        while nxt < end and count(text[nxt:end]) > overlap:
            nxt += 1
        at = nxt if overlap else end
    return out


def test_spans_equal_the_plain_version():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab c,.é-") for _ in range(rng.randrange(1, 60)))
        most = rng.randrange(1, 9)
        overlap = max(0, min(rng.randrange(0, 9), most - 1))
        assert list(chunking.spans(text, most, overlap, chunking.count_words)) == plain_spans(text, most, overlap), (text, most, overlap)


def test_citations(spark):
    a, n = F.col("a"), F.lit(3)
    assert value(spark, text.valid_citations(a, n), a="x [2] y [2] [9] [1]") == [1, 2]
    assert value(spark, text.citation_warnings(a, n), a="x [9] [0] [2]") == ["Answer referenced unknown citation [0].", "Answer referenced unknown citation [9]."]
    assert value(spark, text.citation_warnings(a, n), a="no marks") == ["Answer did not reference any retrieved evidence."]
    assert value(spark, text.citation_warnings(a, n), a="The  Context does not\ninclude it") == []
    assert value(spark, text.compares(a), a="A vs. B?") and not value(spark, text.compares(a), a="Advs B")


def test_terms(spark):
    assert keywords.query_terms("How does the fixed RAG-pipeline/tool fixing work, C++ to go?") == ["fix", "rag", "pipeline", "tool", "c++"]
    assert value(spark, keywords.terms_of(F.col("q")), q="How does the fixed RAG-pipeline/tool fixing work, C++ to go?") == ["fix", "rag", "pipeline", "tool", "c++"]


@pytest.mark.parametrize("q,title,content,want", [("agent memory", "Agent memory", "nothing", 1.5), ("agent memory", "x", "agents keep memory", 1.0), ("the", "the", "the", 0.0), ("rag", "storage", "", 1.5), ("a_b long-term", "", "Long term", 1.0)])
def test_keyword_scores(spark, q, title, content, want):
    assert value(spark, keywords.keyword_score(q, F.col("t"), F.col("c")), t=title, c=content) == want


def test_topics_and_events(spark):
    pick = lambda t, d="x": value(spark, taxonomy.topic(F.col("t"), F.col("d")), t=t, d=d)
    assert tuple(pick("An agent and another agent with an API")) == ("agentic-generative-ai", "deterministic-keyword")
    assert tuple(pick("agents fine-tuning")) == ("ai-products-engineering-infrastructure", "source-default")
    assert tuple(pick("nothing", "data-search-retrieval")) == ("data-search-retrieval", "source-default")
    assert pick("machine learning api")["topic"] == "machine-learning-classical-ai"
    event = lambda t, d: value(spark, taxonomy.events(F.col("t"), F.col("d")), t=t, d=d)
    assert event("The newspaper wrote", []) == ["research"]
    assert event("Deprecated paper", ["guide"]) == ["alert"]
    assert event("nothing", [" Release_Update", "guide"]) == ["release-update"]
    assert event("nothing", ["unknown"]) == []


@pytest.mark.parametrize(
    "given,want",
    [("2024-03-05T10:00:00Z", "2024-03-05 10:00:00"), ("2024-03-05T10:00:00+02:00", "2024-03-05 08:00:00"), ("2024-03-05", "2024-03-05 00:00:00"), ("March 5, 2024", "2024-03-05 00:00:00"), ("Mar 5, 2024", "2024-03-05 00:00:00"), ("soon", None), ("", None), ("2024-13-45", None),
     ("Tue, 05 Mar 2024 10:00:00 GMT", "2024-03-05 10:00:00"), ("Tue, 05 Mar 2024 10:00:00 +0100", "2024-03-05 09:00:00"), ("5 Mar 2024 10:00 EST", "2024-03-05 15:00:00"),
     ("Tue, 5 March 24 23:59:59 -0930", "2024-03-06 09:29:59"), ("Tue, 05 Mar 2024 10:00:00", "2024-03-05 10:00:00"), ("Tue, 35 Mar 2024 10:00:00 GMT", None), ("05 Mar 99 01:02:03 Z", "1999-03-05 01:02:03")],
)
def test_entry_times(spark, given, want):
    out = value(spark, F.date_format(dates.entry_datetime(F.lit(None).cast("timestamp"), F.col("p"), F.lit(None)), "yyyy-MM-dd HH:mm:ss"), p=given)
    assert out == want


def test_written_dates_and_ages(spark):
    assert value(spark, dates.date_from_text(F.col("t")), t="on september 12, 2025 we") == "september 12, 2025"
    now = F.timestamp_seconds(F.lit(10**9))
    ago = lambda s: value(spark, dates.relative(F.timestamp_seconds(F.lit(10**9 - s)), now), t="")
    assert [ago(s) for s in (-5, 59, 61, 7200, 90000, 10**6)] == ["just now", "just now", "1m ago", "2h ago", "yesterday", "11d ago"]


@pytest.mark.parametrize(
    "given,want",
    [
        ("HTTPS://User:pw@Example.com:443/a/?b=2&a=1&utm_source=x#f", "https://example.com/a?a=1&b=2#f"),
        ("http://example.com:8080/", "http://example.com:8080/"),
        ("https://example.com?gclid=1", "https://example.com"),
        ("https://example.com/a//", "https://example.com/a"),
    ],
)
def test_urls(spark, given, want):
    assert plain_url(given) == want
    assert value(spark, urls.normalize_url(F.col("u")), u=given) == want


def plain_url(url):
    """The same by the standard library's parsers."""
    parts = urllib.parse.urlsplit(url.strip())
    pairs = [(k, v) for k, v in urllib.parse.parse_qsl(parts.query, keep_blank_values=True) if not (k.lower().startswith("utm_") or k.lower() in urls.TRACKERS)]
    try:
        port = parts.port
    except ValueError:
        port = None
    host = (parts.hostname or "") + (f":{port}" if port and urls.DEFAULT_PORTS.get(parts.scheme) != str(port) else "")
    path = parts.path if parts.path in ("", "/") else parts.path.rstrip("/")
    return urllib.parse.urlunsplit((parts.scheme, host.lower(), path, urllib.parse.urlencode(sorted(pairs)), parts.fragment))


def test_urls_equal_the_plain_version(spark):
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    given = []
    for _ in range(1500):
        query = "&".join(pick("a", "B", "utm_x", "UTM_y", "fbclid", "é", "%41", "c%2Bd", "~*") + pick("", "=", "=1", "=x+y", "=%zz", "=%20", "=a=b", "=~*-._") for _ in range(rng.randrange(4)))
        host = pick("example.com", "Example.COM", "u:p@e.org", "a@b@c.de", "127.0.0.1", "[::1]")
        port = pick("", "", ":80", ":443", ":8080", ":x", ":", ":0", ":00443")
        given.append(f"{pick('http', 'HTTPS', 'ftp')}://{host}{port}{pick('', '/', '//', '/a', '/a/', '/a//b/;p=1/', '/%7E/x//')}{pick('', '?')}{query}{pick('', '#', '#F/', '#a?b')}{pick('', ' ')}")
    rows = spark.createDataFrame([(u,) for u in given], "u string")
    for r in rows.select("u", urls.normalize_url(F.col("u")).alias("n")).collect():
        assert r.n == plain_url(r.u), r.u
    assert value(spark, urls.normalize_url(F.lit(None).cast("string")), t="") is None


def test_url_forms(spark):
    assert value(spark, urls.url_candidates(F.col("u")), u="https://e.com/a?x=1") == ["https://e.com/a?x=1", "https://e.com/a/?x=1"]
    assert value(spark, urls.url_candidates(F.col("u")), u="https://e.com") == ["https://e.com"]
    assert value(spark, urls.safe_url(F.col("u")), u="https://e.com/a?x=1#y") == "https://e.com/a"


def test_costs(spark):
    cost = lambda m: value(spark, scores.chat_cost(F.col("m"), F.lit(1_000_000), F.lit(500_000)), m=m)
    assert (cost("gpt-4.1-mini"), cost("gpt-4.1-mini-2025-04-14"), cost("other")) == (1.2, 1.2, None)
    assert value(spark, scores.embedding_cost(F.col("m"), F.lit(1_000_000)), m="text-embedding-3-small") == 0.02


def test_secrets(spark):
    assert value(spark, redact.redact(F.col("t")), t="Bearer abc.def, sk-12345678x password=hunter2&a=1 postgresql://u:pw@h/db") == "Bearer [REDACTED], [REDACTED] password=[REDACTED]&a=1 postgresql://u:[REDACTED]@h/db"
    row = spark.sql("select map('Password', 'x', 'my_api_key', 'y', 'note', 'Bearer z') as m")
    assert row.select(redact.redact_map(F.col("m")).alias("m")).first().m == {"Password": "[REDACTED]", "my_api_key": "[REDACTED]", "note": "Bearer [REDACTED]"}


def test_names(spark):
    assert value(spark, display.labelize(F.col("v")), v="api-change") == "API change"
    assert value(spark, display.labelize(F.col("v")), v="tool-use") == "Tool Use"
    assert value(spark, display.source_display_name(F.col("v"), {"x-y": "XY"}), v="some-lab-blog") == "Some Lab"
    assert value(spark, display.source_display_name(F.col("v")), v="mcp-blog") == "MCP"
    assert value(spark, display.labelize(F.col("v")), v="c/c++ (new.thing)") == "C/C++ (New.Thing)"
    assert value(spark, display.category_label(F.col("v")), v="data-search-retrieval") == "Data, Search & Retrieval"
    assert value(spark, display.edition("month", F.to_timestamp(F.lit("2024-02-01"))), v="") == "February 2024"


def test_vectors_and_scores(spark):
    v = lambda *x: F.array(*map(F.lit, x)).cast("array<float>")
    assert value(spark, scores.cosine_similarity(v(1.0, 0.0), v(1.0, 1.0)), t="") == 0.7071
    assert value(spark, scores.cosine_similarity(v(0.0, 0.0), v(1.0, 1.0)), t="") is None
    now = F.lit(dt.datetime(2024, 2, 1))
    assert value(spark, scores.recency(F.lit(dt.datetime(2024, 1, 11)), now), t="") == 0.3679
    assert value(spark, scores.recency(F.lit(dt.datetime(2024, 3, 1)), now), t="") == 1.0
    assert value(spark, scores.recency(F.lit(None).cast("timestamp"), now), t="") == 0.0
    assert value(spark, scores.importance(F.lit(None).cast("double"), F.lit(dt.datetime(2024, 2, 1)), F.lit("x" * 2000), now), t="") == 0.95


def test_white_space_is_cut_as_the_patterns_say(spark):
    rows = [(x,) for x in ["  a b \n", "\u00a0\u3000x y \u0085", "", " \t\n ", None, "\x1c a \u200b", "\u00e9 \r\n", "a \u2028", "\x0b\x0c\u205f\u1680b"]]
    df = spark.createDataFrame(rows, "x string")
    same = text.strip(F.col("x")).eqNullSafe(F.regexp_replace("x", r"(?U)^\s+|\s+$", "")) & text.rstrip(F.col("x")).eqNullSafe(F.regexp_replace("x", r"(?U)\s+$", ""))
    assert df.where(~same).collect() == []
