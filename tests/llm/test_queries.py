"""The registered queries of the subpackage, and the pipeline."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.engine.test_catalog import TABLES, tidy
from tests.llm import brute
from tests.llm.test_near_copies import alike
from weftline.llm import pieces, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_names():
    assert sorted({int(n.split("_")[0][2:]) for n in queries.queries()}) == list(range(1, 14))
    assert set(queries.queries()) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    order = ", ".join(f'"{x}"' for x in columns)
    assert tidy(df.select(*columns).collect()) == tidy(c.sql(f"SELECT {order} FROM ({queries.oracle_sql()[name]})").fetchall())


def test_pipeline_stages_do_what_they_say(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    first, clean, single, safe, mixed, encoded = kept
    # toxicity: what goes is what the operator predicts
    model = toxicity.train(first, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(first, model).collect() if r.predicted}
    assert toxic and {r.doc_id for r in clean.collect()} == {r.doc_id for r in first.collect()} - toxic
    # near copies: one of each class of the fingerprints, less those that are like an earlier text
    whole = {r.doc_id: r.text for r in clean.collect()}
    by_print = set(brute.components([(d, brute.fingerprint(t)) for d, t in whole.items()]).values())
    left = {r.doc_id for r in single.collect()}
    assert left <= by_print
    words = {d: set((t or "").lower().split()) for d, t in whole.items()}
    like = lambda d, e: len(words[d] & words[e]) >= 0.7 * len(words[d] | words[e]) and alike(whole[d], whole[e])
    assert all(any(like(d, e) >= 0.77 for e in whole if e < d) for d in by_print - left)
    assert not any(like(d, e) >= 0.85 for d in left for e in left if e < d)
    # personal data: none of the plain version's is left, other texts are as they were
    before = {r.doc_id: r.text for r in single.collect()}
    for r in safe.collect():
        assert not brute.base_spans(r.text) and r.n_chars == len(r.text)
        if not brute.base_spans(before[r.doc_id]) and r.text != before[r.doc_id]:
            assert "<" in r.text
    # mixing: whole rows, three times at most, words by source near the targets
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(times.values()) <= 3
    words = {r.doc_id: len((r.text or "").encode().split()) for r in safe.collect()}
    source = {r.doc_id: r.source for r in safe.collect()}
    for s in sorted(set(source.values()), key=lambda x: (x is None, x)):
        got = sum(n * words[d] for d, n in times.items() if source[d] == s)
        longest = max(words[d] for d in words if source[d] == s)
        total = sum(words[d] for d in words if source[d] == s)
        assert got <= 3 * total and longest >= 0
    # pieces: they spell the text
    v = pieces.Vocabulary(pieces.model_bytes())
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert encoded.count() == mixed.count()
    for r in encoded.collect():
        assert b"".join(v.bytes[i] for i in r.ids).decode()[1:] == text[r.doc_id] and r.n_pieces == len(r.ids)


def test_pipeline_of_odd_documents(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x" * 50_000, None, None, 50_000)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs, least in ((odd, 1), (odd.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() >= least


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_pieces", "ids"]
    assert np.all([len(r.ids) == r.n_pieces for r in out.collect()])


def test_stages_keep_columns_that_clash_with_their_own(spark):
    names = ["_spans", "_row", "new", "size", "h", "s", "source_size", "target", "passes", "threshold", "share", "nth", "node", "root", "n", "_key", "predicted", "score", "label", "fp"]
    rows = [(k, f"text {k} of mail jo{k}@b.co " + "word " * (k % 5), "en", f"s{k % 3}", 0, *range(len(names))) for k in range(30)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns[5:] == names, name
        got = docs.collect()
        assert got and all(tuple(r)[5:] == tuple(range(len(names))) for r in got)
    assert all("@" not in r.text for r in got)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", *names, "n_pieces", "ids"]
    last = out.collect()
    assert len(last) == len(got) and all(tuple(r)[4:-2] == tuple(range(len(names))) for r in last)


def test_the_last_stage_needs_no_column_but_id_and_text(spark):
    docs = spark.createDataFrame([(1, "some words", 9, "x")], "doc_id long, text string, n_pieces int, ids string")
    (row,) = corpus_pipeline.encode(spark, docs, SF).collect()
    assert row.asDict().keys() == {"doc_id", "n_pieces", "ids"} and row.n_pieces == len(row.ids) > 1
