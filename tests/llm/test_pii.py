import hashlib
import random
import time

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from weftline.llm import pii

WEIRD = [
    "", None, "a@b.c_d@e.f x@y.zz.", "1.2.3.4.5.6.7.8 999.1.2.3.4 0001.2.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112 5  4111111111111111",
    "4111111111111111 4111111111111111", "+1 (234) 567-8901 23 +12 3", "a" * 3000 + "@x.y", " 1 2" * 3000, "é😀 é@a.b é a@b.co 😀 1.1.1.1", "a@b.c.@x.y..z@q.r",
    "+1+1+123456789012 +" + "1" * 16, "@" * 500, "12 3" * 20 + " 1.1.1.1.1", "x@" + "a." * 4000, "1 " * 20000,
]


def fuzz(n):
    random.seed(11)
    return ["".join(random.choice("0123456789012345678+@.- ()ab_,\né") for _ in range(random.randrange(120))) for _ in range(n)]


def check(spark, texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        want = brute.base_spans(t)
        r = got[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[2] == kind for w in want) for kind in brute.BASE], t
        assert r.base_sha256 == brute.base_digest(t)
        spans = r.spans.split(",") if r.spans else []
        assert {f"{kind}:{s}:{e}" for s, _, kind, e in want} <= set(spans)
        order = [(int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])) for x in spans]
        assert order == sorted(order)


def test_base_spans_equal_the_plain_version(spark):
    check(spark, WEIRD + fuzz(1500))


def test_supervision_adds_written_numbers_and_spelled_addresses(spark):
    texts = ["call (030) 123-4567 now", "mail jo [at] site [dot] com", "card 4111 1111 1111 1112", "in 2024 or 2025, 12 of 30"] * 20 + ["+49 30 1234567 x", "jo@site.com", "4111111111111111"] * 60
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.detect(docs).collect()}
    assert got[0].startswith("phone:5:19") and got[1] == "email:5:27" and got[3] == ""


def test_supervision_adds_addresses_of_both_versions(spark):
    texts = ["server 2001:db8::ff00:42:8329 up", "host 192[.]168[.]1[.]10 seen", "at 12:30:45 or a::b", "login fe80:0:0:0:1:2:3:4, done", "10.0.0.1 here"] * 30
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_ip, r.spans) for r in pii.detect(docs).collect()}
    assert got[0] == (0, "ip:7:29") and got[1] == (0, "ip:5:23") and got[3] == (0, "ip:6:24") and got[4] == (1, "ip:0:8")
    assert "12:30" not in texts[2] or not got[2][1].startswith("ip:3:")


def test_the_classifier_sees_what_no_labeler_does():
    model = pii.Classifier([(3, "+++++5s", 500), (3, "-----2d", 500), (3, "000005s", 60), (3, "000002d", 60)])
    assert model.belief[3, "000005s"] > model.belief[3, "000002d"]


def test_reliabilities_follow_agreement():
    model = pii.Classifier([(3, "+++++", 500), (3, "+0+++", 200), (3, "-----", 500), (3, "-+---", 200)])
    assert model.belief[(3, "+++++")] > 0.9 > 0.1 > model.belief[(3, "-----")]
    table = model.reliability[3]
    assert table[0, 1, 2] > 0.9 and table[1, 1, 2] < table[0, 1, 2]
    assert pii.Classifier([]).accepted == []


def test_redaction_keeps_columns_and_the_rest_of_the_text(spark):
    rows = [(1, "a jo@b.co, 1.1.1.1!", 19, "s", 0), (2, "nothing", 7, "s", 0), (3, None, None, None, 0), (None, "+1 234 567 8901, 4111111111111111", 33, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string, base int")
    got = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert got[1].text == "a <EMAIL>, <IP>!" and got[1].n_chars == 16
    assert got[2].text == "nothing" and got[3].text is None
    assert "8901" not in got[None].text
    assert pii.redacted(docs).columns == docs.columns
    assert pii.detect(docs.limit(0)).count() == 0


def test_digest_of_no_spans(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert pii.detect(docs).first().base_sha256 == hashlib.sha256(b"").hexdigest()


def test_a_text_of_very_many_spans(spark):
    """Time follows the text's length: 200,000 spans take seconds, not hours."""
    unit, n = "a@b.co +1 234 567 8901 ", 100_000
    docs = spark.createDataFrame([(1, unit * n)], "doc_id long, text string")
    start = time.perf_counter()
    (got,) = pii.detect(docs).collect()
    assert (got.n_email, got.n_phone, got.n_ip) == (n, n, 0)
    want = ",".join(f"email:{k * 23}:{k * 23 + 6},phone:{k * 23 + 7}:{k * 23 + 22}" for k in range(n))
    assert got.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert pii.redacted(docs).first().text == "<EMAIL> <PHONE> " * n
    assert time.perf_counter() - start < 240


def test_parts_are_cut_as_from_the_text(spark):
    text = "".join(chr(0x1F600 + k % 50) if k % 7 == 0 else "abc\né "[k % 6] for k in range(2000))
    places = [(0, 0), (0, 1), (255, 2), (256, 256), (1990, 10), (1999, 5), (2000, 1), (100, 1500), (511, 1)]
    df = spark.createDataFrame([(text, a, n) for a, n in places], "text string, a long, n long")
    got = df.select(pii.part(pii.blocks(F.col("text")), F.col("a"), F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == [text[a : a + n] for a, n in places]


def test_scans(spark):
    df = spark.createDataFrame([([k * 7 % 11 for k in range(n)],) for n in (0, 1, 2, 3, 17, 100)], "v array<long>")
    for op, fold in ((lambda x, y: x + y, np.cumsum), (F.greatest, np.maximum.accumulate), (F.least, np.minimum.accumulate)):
        for r in df.select("v", pii.scanned(F.col("v"), op).alias("w")).collect():
            assert r.w == (fold(r.v).tolist() if r.v else [])
