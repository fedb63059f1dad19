"""Quote grounding over whole items and all articles."""

import random
from difflib import SequenceMatcher

from weftline.functions import quotes
from weftline.functions.quotes import supported
from weftline.plans import catalog
from weftline.plans import fixtures as X

SF = "/root/testdata/sf0.001"


def test_whole_items_and_all_articles(spark):
    rows = {r.doc_id: r for r in catalog.quote_grounding(spark, SF).collect()}
    articles = {r.doc_id: r for r in X.articles(spark, SF).collect()}
    items = {r.item_id: r.text for r in X.table(spark, SF, "benchmark").collect()}
    assert set(rows) == set(articles)
    for d, a in articles.items():
        assert rows[d].item_supported == (supported(a.title, a.raw_text, items[d]) if d in items else None)
    # a text has its own quotes, unless it has too few words to be quoted
    assert all(rows[d].own_supported for d, a in articles.items() if len(a.raw_text.split()) >= 60)


def test_runs_equal_the_longest_first_matching():
    r = random.Random(8)
    for _ in range(3000):
        source = [r.choice("abcdef"[: r.randint(1, 6)]) for _ in range(r.randint(0, 40))]
        words = [r.choice("abcdefg"[: r.randint(1, 7)]) for _ in range(r.randint(1, 14))]
        plain = SequenceMatcher(None, words, source, autojunk=False)
        want = sum(n for _, _, n in plain.get_matching_blocks() if n >= quotes.RUN)
        assert quotes.covered(quotes.runs(words, quotes.places(" ".join(source)))) == want, (words, source)


def test_odd_quotes(spark):
    df = spark.createDataFrame([("T", "one two three four", ["one two three", None, "", "two ... three", "ONE TWO … three four"]), (None, None, ["a b c"]), ("T", "x", None)], "title string, raw string, q array<string>")
    got = [r.x for r in df.select(quotes.quotes_supported("title", "raw", "q").alias("x")).collect()]
    assert got == [[True, False, False, False, True], [False], None]


def test_quotes_as_they_are_need_no_places(monkeypatch):
    def never(*texts):
        raise AssertionError("looked up")

    monkeypatch.setattr(quotes, "places", never)
    assert supported("A title", "Straße one,\ntwo-three four", "title STRASSE one ... two three FOUR")


def test_either_way_finds_the_same():
    r = random.Random(9)
    seen = set()
    for _ in range(3000):
        text = " ".join(r.choice(["a", "b", "ab", "c.", "d", "-"]) for _ in range(r.randint(0, 25)))
        words = [r.choice(["a", "b", "ab", "c", "d"]) for _ in range(r.randint(2, 7))]
        found = quotes.covered(quotes.runs(words, quotes.places(text))) / len(words) >= quotes.COVERAGE
        assert quotes.Source(text).has(words) == found, (text, words)
        seen.add((found, f" {' '.join(words)} " in quotes.Source(text).words))
    assert len(seen) == 3  # found as they are, found in parts, not found
