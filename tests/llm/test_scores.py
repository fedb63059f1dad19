"""The quality and toxicity classifiers."""

import math
import pickle
import random
import zlib

import numpy as np
import pytest
import zstandard

from weftline.llm import labelled, quality, toxicity


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


@pytest.mark.parametrize("op,column,least", [(quality, "quality", 0.9), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, tables, op, column, least):
    docs, labels = tables
    model = op.train(docs, labels)
    out = {r.doc_id: r for r in op.score(docs, model).collect()}
    truth = {r.doc_id: r[column] for r in labels.collect()}
    assert len(out) == docs.count()
    for d, r in out.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % op.FOLDS == op.HELD)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= op.LIMIT)
    held = [d for d, r in out.items() if r.held_out and d in truth]
    assert np.mean([out[d].predicted == truth[d] for d in held]) >= least


def test_the_sample_leaves_the_held_out_fold_alone(spark, tables):
    docs, labels = tables
    rows, counts = labelled.sample(docs, labels, "quality", 4, 2, per_class=20)
    assert len(rows) == 40 and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 for r in rows)
    assert counts[0] + counts[1] == sum(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in labels.collect())


@pytest.mark.parametrize("op,column", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows_and_labels(spark, op, column):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (None, "x", "s"), (3, "long " * 50_000, "s"), (3, "long " * 50_000, "s")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = op.score(docs, op.train(docs, none)).collect()
    assert len(out) == 5 and {r.score for r in out} == {0.5}
    some = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 40)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    out = op.score(docs, op.train(docs, some)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert op.score(docs.limit(0), op.train(docs, some)).count() == 0
    if op is toxicity:
        assert op.kept(docs, op.train(docs, none)).count() == 5


def test_the_smaller_compressed_size_wins():
    good = [f"calm sentence number {k} with ordinary words and a full stop." for k in range(200)]
    bad = [f"BUY {k} !!! ### $$$ BUY {k} !!! ### $$$" for k in range(200)]
    rows = [{"doc_id": k, "text": t, "label": int(t in good)} for k, t in enumerate(good + bad)]
    model = quality.Model(rows, (200, 200))
    probes = ["calm sentence number 999 with ordinary words and a full stop.", "BUY 999 !!! ### $$$ BUY 999 !!! ### $$$"]
    a, b = model.score(probes)
    assert a > 0.7 > b
    gap = quality.features(probes, model.good, model.bad)[:, 0]
    assert gap[0] > 0 > gap[1]


def test_quality_equals_the_plain_version(spark, tables):
    """Scores from compressed sizes, one text and one dictionary at a time."""
    docs, labels = tables
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert 1 < len(model.good) <= quality.PARTS and 1 < len(model.bad) <= quality.PARTS
    for r in docs.where("doc_id % 9 = 0").collect():
        raw = (r.text or "").encode()
        best = []
        for dictionaries in (model.good, model.bad):
            shortest = None
            for d in dictionaries:
                made = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(raw)
                back = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d)).decompressobj().decompress(made)
                assert back == raw
                shortest = len(made) if shortest is None else min(shortest, len(made))
            best.append(shortest)
        x, y, n, v = *best, len(raw), math.log(len(raw) + 1)
        gap, share = (y - x) / (x + y), (y - x) / (n + 20)
        z = [gap, gap * v, share, share * v, math.tanh(30 * gap), math.tanh(60 * share)]
        z = [min(8, max(-8, (q - m) / s)) for q, m, s in zip(z, model.curve.mean, model.curve.scale)]
        total = model.curve.w[0] + sum(q * w for q, w in zip(z, model.curve.w[1:]))
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-total))) < 0.02


def test_dictionaries_of_parts():
    texts = [f"alpha beta gamma {k} delta epsilon zeta".encode() for k in range(80)] + [f"<td>{k}</td><td>{k * k}</td><tr/>".encode() for k in range(80)]
    found = quality.dictionaries(texts, parts=3)
    assert 1 <= len(found) <= 3 and found == quality.dictionaries(texts, parts=3)
    assert len(quality.dictionaries([])) == 1


def kinds(text):
    """What the machine makes of a clause's matches: (insult or threat, targeted, negated, reported)."""
    g = toxicity.Grammar({"idiot ": 4.0, "scum": 3.0})
    return [("threat" if c & 8 else "insult", bool(c & 1), bool(c & 2), bool(c & 4)) for _, _, found in g.clauses(text) for c, _ in sorted(found)]


def plain_kinds(text):
    """The same, by looking around each match."""
    out = []
    for clause in toxicity.BETWEEN.split(text):
        words = toxicity.WORDS.findall(clause)
        here = []
        hit = {}
        for k, w in enumerate(words):
            if w == "idiot" or w.startswith("scum"):
                hit[k] = "insult"
        for phrase in toxicity.THREATS:
            p = phrase.split()
            for k in range(len(words) - len(p) + 1):
                if words[k : k + len(p)] == p:
                    hit[k] = "threat"
        for k, kind in hit.items():
            plain = lambda j: j not in hit
            targeted = any(words[j] in toxicity.TARGETS and plain(j) for j in [*range(max(0, k - 5), k), *range(k + 1, min(len(words), k + 3))])
            negated = any(words[j] in toxicity.NEGATIONS and plain(j) for j in range(max(0, k - 3), k))
            here.append((8 * (kind == "threat") + targeted + 2 * negated + 4 * any(words[j] in toxicity.REPORTS and plain(j) for j in range(k)), kind, targeted, negated, any(words[j] in toxicity.REPORTS and plain(j) for j in range(k))))
        out += [x[1:] for x in sorted(here)]
    return out


def test_transducers_equal_the_plain_version():
    rng = random.Random(4)
    words = ["idiot", "scummy", "a", "the", "plain", "you", "her", "not", "never", "said", "wrote", "i", "will", "kill", "pay", "regret", "know", "where", "live", ".", ";"]
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(14)))
        assert kinds(text) == plain_kinds(text), text
    assert kinds("i know where you live") == [("threat", True, False, False)]
    assert kinds("she said you will pay") == [("threat", True, False, True)]


def test_grammar_composes_its_transducers():
    assert len(toxicity.GRAMMAR.arcs) == 6 * 4 * 2
    first, second = toxicity.marker(toxicity.TARGET, 5, 1), toxicity.marker(toxicity.NEGATION, 3, 2)
    rng = random.Random(1)
    for _ in range(200):
        s = bytes(rng.choice([0, 1, 2, 3, 4, 12]) for _ in range(30))
        assert (first >> second).run(s) == second.run(first.run(s))


def test_the_marks_decide():
    """Labels that depend on the marks alone: the grammar tells them apart, without its marks nothing does."""
    rng = random.Random(7)
    filler = ["the", "day", "was", "long", "and", "bright", "we", "went", "home"]
    rows = []
    for k in range(600):
        around = lambda n: " ".join(rng.choice(filler) for _ in range(n))
        insult = rng.choice(["idiot", "moron", "clown"])
        bad = k % 2
        core = f"you are an {insult}" if bad else rng.choice([f"you are not an {insult}", f"he said you are an {insult}"])
        rows.append({"doc_id": k, "text": f"{around(6)}. {core}. {around(6)}. he said so. not a day", "label": bad})
    # clean texts with the same words but the insults, so that only these have odds
    rows += [{"doc_id": 1000 + k, "text": f"{' '.join(rng.choice(filler) for _ in range(12))}. you are an x. he said so. not a day", "label": 0} for k in range(8000)]
    label = np.array([r["label"] for r in rows[:600]])

    def accuracy(model):
        return np.mean((model.score([r["text"] for r in rows[:600]]) >= 0.5) == label)

    model = toxicity.Model(rows, (8300, 300))
    grammar = toxicity.marked
    try:
        toxicity.marked = bytearray  # no marks
        plain = toxicity.Model(rows, (8300, 300))
        without = accuracy(plain)
    finally:
        toxicity.marked = grammar
    assert accuracy(model) > 0.97 and without < 0.7


def test_clauses_are_scored_not_words():
    g = toxicity.Grammar({"idiot ": 4.0, "scum": 3.0})
    low = "nice day. you idiot! not an idiot; scummy pond\nplain"
    found = list(g.clauses(low))
    assert [low[a:b].strip() for a, b, _ in found] == ["you idiot", "not an idiot", "scummy pond"]
    assert [f for _, _, f in found] == [[(1, 4.0)], [(2, 4.0)], [(0, 3.0)]]
    again = pickle.loads(pickle.dumps(g))
    assert list(again.clauses(low)) == found
    weights = np.log([2.0, 0.5, 1.0, 1.0])
    sums = np.array([g.sums(low)])
    assert toxicity.features(sums, weights)[0, 0] == pytest.approx(math.log1p(8.0 + 2.0 + 3.0))


def test_a_long_text_with_many_clauses():
    g = toxicity.Grammar({"idiot ": 4.0})
    assert g.sums("a. " * 300_000 + "you idiot. " + "b;" * 300_000)[1] == 4.0
    assert g.sums("word " * 200_000 + "idiot")[0] == 4.0


def test_lexicon_has_log_odds():
    texts = [f"you blorkish one {k}" for k in "abcdefghij"] + ["a fine blork day", "a fine blork days"] + [f"a fine day {k}" for k in range(28)]
    counts = toxicity.tally(texts, [1] * 10 + [0] * 30)
    found = toxicity.learn(counts)
    assert set(found) >= {"blorkish ", "blorki"} and "fine " not in found
    texts = [f"you blorkish one {'x' * k}" for k in range(10)] * 3 + [f"a fine day {'y' * k}" for k in range(30)]
    counts = toxicity.tally(texts, [1] * 30 + [0] * 30)  # repeated texts count once
    assert toxicity.learn(counts)["blorkish "] == pytest.approx(math.log(10.5 / 11) - math.log(0.5 / 31))


def test_a_text_longer_than_the_sample_does_not_end_it(spark):
    """Whichever rank a text of over SAMPLE_BYTES has, each class keeps its rows before it, and itself in parts."""
    rows = [(k, ("good words here " if k % 2 else "bad words there ") * (5 + k % 7)) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    first = spark.createDataFrame([(k,) for k in range(40)], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) h").where("crc32(cast(cast(doc_id as string) as binary)) % 4 != 2")
    for k in (0, 1):
        longest = first.where(f"doc_id % 2 = {k}").orderBy("h").first().doc_id
        docs = spark.createDataFrame([(d, t * 900_000 if d == longest else t) for d, t in rows], "doc_id long, text string")
        got, counts = labelled.sample(docs, labels, "quality", 4, 2)
        assert {r["label"] for r in got} == {0, 1} and len(got) == sum(counts)
        long = next(r["text"] for r in got if r["doc_id"] == longest)
        assert len(long) == labelled.PART * labelled.PARTS
        model = quality.train(docs, labels)
        assert len({round(r.score, 3) for r in quality.score(docs, model).collect()}) > 2


def test_a_sample_that_is_full_still_has_a_row_of_each_class(spark, monkeypatch):
    monkeypatch.setattr(labelled, "SAMPLE_BYTES", 10)
    docs = spark.createDataFrame([(k, "some words " * 9) for k in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    got, _ = labelled.sample(docs, labels, "quality", 4, 2)
    assert sorted(r["label"] for r in got) == [0, 1]
