import random

import numpy as np

from tests.llm import brute
from weftline.llm import near_copies


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def corpus(seed, groups=12, alone=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    text = lambda: [rng.choice(vocabulary) for _ in range(rng.randrange(60, 500))]
    rows, group = [], []
    for g in range(groups):
        base = text()
        for _ in range(rng.randrange(2, 9)):
            words = list(base)
            for _ in range(max(1, len(words) // 160)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
            group.append(g)
    for k in range(alone):
        rows.append(" ".join(text()))
        group.append(groups + k)
    return rows, group


def classes(spark, docs, block=near_copies.BLOCK):
    nodes, found = near_copies.copies(docs, block)
    root = {r.node: r.root for r in found.collect()}
    return {r.node: root.get(r.node, r.node) for r in nodes.collect()}


def test_planted_copies_meet_and_others_do_not(spark):
    texts, group = corpus(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for block in (near_copies.BLOCK, 4):
        got = classes(spark, docs, block)
        first = {}
        for d, g in enumerate(group):
            first.setdefault(g, d)
        want = {d: first[g] for d, g in enumerate(group)}
        wrong = [d for d in want if got[d] != want[d]]
        # a copy may be less like every other one of its group than 0.8
        assert all(max(alike(texts[d], texts[e]) for e in range(len(texts)) if e != d and group[e] == group[d]) < 0.85 for d in wrong if want[d] != d)
        assert len(wrong) <= 2


def test_classes_of_the_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = classes(spark, docs)
    assert set(got) == {min(d for d, t in rows if t == text) for text in {t for _, t in rows}}
    text = dict(rows)
    nodes = sorted(got)
    sets = {d: shingles(text[d]) for d in nodes}
    fps = {d: brute.fingerprint(text[d]) for d in nodes}
    found = missed = 0
    link = {d: d for d in nodes}
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            n, m = len(sets[a]), len(sets[b])
            near = min(n, m) >= 0.8 * max(n, m) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            if near:
                found += got[a] == got[b]
                missed += got[a] != got[b]
            if near or (fps[a] ^ fps[b]).bit_count() <= 3 or (min(n, m) >= 0.7 * max(n, m, 1) and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])):
                link[a] = min(link[a], b)
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                assert got[a] == got[b]
    assert missed <= max(1, 0.1 * (found + missed))
    # nothing is joined that has no near text at all
    assert all(link[d] != d for d in nodes if got[d] != d and not any(got[e] == got[d] and e != d and (e > d or link[d] != d) for e in nodes))


def test_packed_words_keep_their_set():
    for text in ("", "one", "a b c d e", "A  b\nc d E f g", "é " * 7000):
        words = near_copies.words_of(text)
        packed = near_copies.pack(words)
        assert near_copies.unpack(packed).tolist() == near_copies.shingle_set(words).tolist()
    assert len(near_copies.unpack(near_copies.pack(near_copies.words_of("a b c d e f")))) == 2


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(300))
    rows = [(1, None, 0), (2, "", 0), (3, "one", 0), (3, "one", 0), (4, "one", 0), (None, long, 0), (None, long, 0), (6, long, 0), (7, long + " more", 0), (8, long, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    kept = near_copies.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 6]
    assert sum(r.doc_id is None for r in kept.collect()) == 2
    assert near_copies.deduplicated(docs.limit(0)).count() == 0


def test_copies_that_differ_by_a_block_meet(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    line = some(30)  # which many texts have
    texts = []
    for k in range(60):
        base = some(rng.randrange(50, 400)) + (line if k % 2 else [])
        n = len(base) * 16 // 100
        at = len(base) // 2
        texts += [base, (base + some(n), base[: len(base) - n], base[:at] + some(n) + base[at:])[k % 3]]
    texts += [some(k) for k in (1, 2, 4, 5, 6, 9)]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for block in (near_copies.BLOCK, 4):
        got = classes(spark, docs, block)
        pairs = [(a, b) for a in range(len(texts)) for b in range(a) if alike(texts[a], texts[b]) >= 0.8]
        assert len(pairs) > 30
        assert [p for p in pairs if got[p[0]] != got[p[1]]] == []


def test_prefixes_of_alike_sets_meet():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 1 << 40, n))
        y = np.unique(np.r_[x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 40, int(rng.integers(0, 1 + n // 8)))])
        common = np.unique(rng.choice(x, max(1, n // 3)))
        if 9 * len(np.intersect1d(x, y)) >= 4 * (len(x) + len(y)):
            weight = common % 5 + 1
            assert len(np.intersect1d(near_copies.prefix(x, common, weight), near_copies.prefix(y, common, weight)))


def test_long_texts_are_decided_at_the_threshold(spark):
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    texts = []
    for k in range(40):
        base = [rng.choice(vocabulary) for _ in range(2000)]
        words = list(base)
        for at in range(20, 2000, 2000 // (45 if k % 2 else 50))[: 43 if k % 2 else 49]:
            words[at] = rng.choice(vocabulary)
        texts += [" ".join(base), " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = classes(spark, docs)
    above = below = 0
    for k in range(0, len(texts), 2):
        true = alike(texts[k], texts[k + 1])
        if true >= 0.8:
            above += 1
            assert got[k] == got[k + 1]
        elif (brute.fingerprint(texts[k]) ^ brute.fingerprint(texts[k + 1])).bit_count() > 3:
            below += true > 0.77
            assert got[k] != got[k + 1]
    assert above >= 10 and below >= 10


def test_unlike_texts_under_one_id_both_stay(spark):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(80))
    near = text(1) + " more"
    rows = [(5, text(1)), (5, text(2)), (7, near), (8, text(3)), (8, text(3)), (8, text(2)), (9, text(3).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((r.doc_id, r.text) for r in near_copies.deduplicated(docs).collect())
    assert kept == sorted([(5, text(1)), (5, text(2)), (8, text(3))])


def test_a_key_of_very_many_texts_costs_its_size(spark):
    """100,000 texts of one class and a few others under one key: rows dealt grow with the number of texts."""
    n, block = 100_000, 512
    rows = spark.range(n + 40).selectExpr("7L AS key", "id AS node", f"IF(id < {n}, 0L, id) AS root", "10L AS n", "0L AS place")
    assert n <= near_copies.across(rows, block).count() <= 1.2 * n
    assert near_copies.beside(rows, block).count() == n + 40
    dealt = near_copies.across(rows, block)
    largest = dealt.groupBy("key", "pair").count().agg({"count": "max"}).first()[0]
    assert largest < 2 * block + 100
    # every pair of different classes meets, and no block holds one class alone
    few = spark.range(30).selectExpr("7L AS key", "id AS node", "IF(id < 20, 0L, id) AS root", "10L AS n", "0L AS place")
    met = near_copies.across(few, 4).select("pair", "node", "root").collect()
    by = {}
    for r in met:
        by.setdefault(r.pair, []).append(r)
    pairs = {(min(a.node, b.node), max(a.node, b.node)) for g in by.values() for a in g for b in g if a.root != b.root}
    assert pairs == {(a, b) for a in range(30) for b in range(a + 1, 30) if b >= 20}


def test_many_unlike_texts_that_share_a_shingle(spark):
    texts = ["one two three four five " + " ".join(f"x{k}y{j}" for j in range(4 + k % 3)) for k in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert near_copies.deduplicated(docs, 16).count() == len(texts)
