"""Ranked search against a plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from weftline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, total, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        scores = []
        for d, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in wanted & b.keys())
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("vocabulary", [1 << 26, 700])
def test_equals_the_plain_ranking(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    monkeypatch.setattr(lexical, "ENTRIES", 50)
    r = random.Random(4)
    words = ["Alpha", "beta", "gamma", "ÉTÉ", "été", "x9", "你好", "the", "THE", "o", "zz", "averyveryverylongword"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "\n", "'", "-", "\x00", " "]) for _ in range(r.randint(0, n)))
    docs = [(k, text(30)) for k in range(150)] + [(None, "the alpha"), (5, "beta beta"), (6, None), (7, "..."), *[(1000 + k, "gamma the") for k in range(40)]]
    items = [(k, text(5)) for k in range(12)] + [(3, "gamma"), (None, "the zz"), (50, None), (51, ""), (52, "unheard")]
    d = spark.createDataFrame([(a, b, "s", 1) for a, b in docs], "doc_id long, text string, row string, n int").repartition(5)
    q = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, term int")
    assert rows(lexical.search(d, q, vocabulary=vocabulary)) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rows(lexical.search(docs.limit(0), items)) == [] and rows(lexical.search(docs, items.limit(0))) == []
    assert len(rows(lexical.search(docs, items))) == 1


def test_long_texts_piece_by_piece():
    r = random.Random(1)
    text = "".join(r.choice(["word", "É", " ", "\n", "x" * 40]) for _ in range(5000))
    found = [t.decode() for part in lexical.terms(text.encode()) for t in part]
    assert found == terms(text)
    before, lexical.PIECE = lexical.PIECE, 64
    try:
        assert [t.decode() for part in lexical.terms(text.encode()) for t in part] == found
    finally:
        lexical.PIECE = before


def test_radix_order():
    keys = np.random.default_rng(2).integers(0, 1 << 40, 5000)
    keys[::7] = keys[0]
    assert (lexical.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(lexical.radix_order(keys[:0])) == 0


def test_scores_beyond_32_bits_of_slices(spark):
    docs = [(k, "common " * (1 + k % 3) + f"w{k}") for k in range(300)]
    items = [(1, "common"), (2, "common w7 w8")]
    got = rows(lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=25))
    assert got == plain(docs, items, 25)
