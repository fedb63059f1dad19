"""Indexed retrieval equals the full scan, and reads less."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.functions.keywords import keyword_score
from weftline.operators import indexes, search
from weftline.plans import fixtures as X

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def keywords(spark, tmp_path_factory):
    docs = X.articles(spark, SF)
    rows = X.chunks(docs).join(docs.select(F.col("id").alias("document_id"), "title"), "document_id")
    return indexes.KeywordIndex.built(rows, str(tmp_path_factory.mktemp("k") / "i"))


@pytest.mark.parametrize("query", ["that thing tion-est que", "zzzqqq", "+++ a of", "fixed 2024", "überall daß", "license copyright warranty"])
def test_the_keyword_leg_is_that_of_a_full_scan(keywords, query):
    whole, some = keywords.passages().drop("part"), keywords.candidates(query)
    top = lambda rows: [tuple(r) for r in search.best(search.keyword_leg(rows, query), "keyword_score", 40).select("chunk_id", "keyword_score").collect()]
    assert top(some) == top(whole)


def test_rare_terms_read_few_documents(spark, keywords):
    counts = keywords.passages().select("document_id", F.explode(F.array_distinct(F.split(F.lower("content"), "[^a-z]+"))).alias("w")).where("length(w) > 6").distinct().groupBy("w").count()
    rare = counts.where("count between 1 and 3").orderBy("w").first().w
    some = keywords.candidates(rare)
    assert 0 < some.select("document_id").distinct().count() <= 0.25 * keywords.passages().select("document_id").distinct().count()
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan.replace("part#", "part") or "part" in plan and "PushedFilters: [In(document_id" in plan
    want = keywords.passages().where(keyword_score(rare, F.col("title"), F.col("content")) > 0).count()
    assert some.where(keyword_score(rare, F.col("title"), F.col("content")) > 0).count() == want > 0


def test_more_documents_than_are_named(keywords, monkeypatch):
    want = keywords.candidates("that thing").count()
    monkeypatch.setattr(indexes, "NAMED", 3)
    assert keywords.candidates("that thing").count() == want


def test_postings_are_rows_of_blocks(spark, keywords):
    """What is dealt out and sorted is a row a gram and block, not a row a gram and document."""
    rows = spark.read.parquet(f"{keywords.path}/postings")
    pairs = keywords.passages().select("document_id", F.lower(F.concat_ws("\n", "title", "content")).alias("x"))
    pairs = pairs.select("document_id", F.explode(F.regexp_extract_all("x", F.lit("(?=([a-z0-9+]{3}))"), F.lit(1))).alias("gram")).distinct().count()
    assert rows.count() * 5 < pairs


def test_passages_of_a_document_that_lie_apart(spark, tmp_path):
    """Batches and tasks that cut through documents, ids that are numbers, and texts that only together have a gram."""
    texts = ["xya", "bcx", "Ünïabc", "ABC+", None, "", "a-b-c", "ab", "c", "ab\u212ael", "zz 9+9", "\u00e9abé"]
    rows = [(k, k % 5, texts[k % 3] if k % 4 else None, texts[k * 7 % len(texts)]) for k in range(120)]
    df = spark.createDataFrame(rows, "chunk_id long, document_id long, title string, content string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        index = indexes.KeywordIndex.built(df, str(tmp_path / "k"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for query in ("abc", "bke", "abkel", "9+9", "xyab", "c+abc zz", "kel bcx"):
        every = [set(indexes.grams_of(t)) for t in indexes.query_terms(query)]
        want = set()
        for _, d, t, c in rows:
            text = f"{t or ''}\n{c or ''}".lower()
            grams = {text[k : k + 3] for k in range(len(text) - 2)}
            want |= {d for gs in every if gs <= grams}
        got = {r.document_id for r in index.documents(query).collect()}
        found = {r.document_id for r in index.candidates(query).where(keyword_score(query, F.col("title"), F.col("content")) > 0).collect()}
        scored = {r.document_id for r in df.where(keyword_score(query, F.col("title"), F.col("content")) > 0).collect()}
        assert want <= got <= set(range(5)) and found == scored, query


def test_rows_that_share_a_place_have_all_their_grams():
    ids = pa.array(["a", "a", "b", "a"])
    with_grams = lambda *columns: pa.record_batch([ids, *(pa.array(c, pa.string()) for c in columns)], names=["document_id", "title", "content"])
    (out,) = _blocks(with_grams(["tit", "tit", None, "uvw"], ["xab", "cde", "ab", "c"]))
    places = dict(zip(out["gram"].to_pylist(), out["places"].to_pylist(), strict=True))
    assert places == {"tit": [0], "xab": [0], "cde": [0], "uvw": [2], None: []}
    assert out["documents"].to_pylist()[-1] == ["a", "b", "a"]
    assert [b.num_rows for b in _blocks(with_grams([None] * 4, [None] * 4))] == [1] and _blocks(with_grams([None] * 4, [None] * 4).slice(0, 0)) == []


def _blocks(batch):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(indexes.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()))
        return list(indexes.blocks_of(iter([batch])))


def vectors(spark, seed, n, d=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, d))
    x = middle[rng.integers(0, 12, n)] + 0.15 * rng.normal(size=(n, d))
    x[5:9] = x[5]  # ties
    rows = [(k, f"d{k % 50}", [float(v) for v in r]) for k, r in enumerate(x)] + [(n, "d0", None), (n + 1, "d0", [0.0] * d), (n + 2, "d1", [])]
    return spark.createDataFrame(rows, "chunk_id long, document_id string, embedding array<float>"), x


@pytest.mark.parametrize("seed", [1, 2])
def test_the_vector_leg_is_that_of_a_full_scan(spark, tmp_path, seed):
    df, x = vectors(spark, seed, 3000)
    index = indexes.VectorIndex.built(df, str(tmp_path / "v"), cells=24)
    read = []
    for q in (x[5], x[77] + 0.1, -x[3], np.ones(8)):
        query = spark.createDataFrame([([float(v) for v in q],)], "q array<double>")
        full = df.where("size(embedding) > 0 and exists(embedding, v -> v != 0)")
        for allowed in (None, spark.createDataFrame([(f"d{k}",) for k in range(0, 50, 3)], "document_id string")):
            rows = full if allowed is None else full.join(allowed, "document_id", "left_semi")
            want = [tuple(r) for r in search.best(search.vector_leg(rows, query), "vector_similarity", 15).select("chunk_id", "vector_similarity").collect()]
            got = [(r.chunk_id, r.vector_similarity) for r in index.best([float(v) for v in q], 15, allowed).collect()]
            assert got == want
            read.append(index.share_read())
    assert min(read) < 0.5  # vectors cluster, so most cells are never read
    assert len(index.best([float(v) for v in x[0]], 5000).collect()) == 3000
    assert index.best([0.0] * 8, 5).collect() == []


def test_indexes_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "chunk_id long, document_id string, embedding array<float>")
    index = indexes.VectorIndex.built(empty, str(tmp_path / "v"))
    assert index.bounds(np.ones(2)) == []
    r = random.Random(1)
    assert indexes.grams_of("abcd") == ["abc", "bcd"] and indexes.grams_of("aaa" + "a" * r.randint(1, 3)) == ["aaa"]
