import random

import numpy as np
import pytest

from tests.llm import brute
from weftline.llm import near_copies, simhash


def test_fingerprints_equal_the_plain_version():
    random.seed(1)
    texts = ["", " \t\n", "one", "One TWO", "a b c", "É É é x", "a\x0bb\x0cc\rd\x1ce", None]
    texts += [" ".join(random.choice("ab cd ef Gh ij kl".split()) for _ in range(random.randrange(40))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint(t) == brute.fingerprint(t), t


def test_every_pair_within_reach_shares_a_key_and_passes_the_chain():
    rng = np.random.default_rng(3)
    for _ in range(2000):
        a = int(rng.integers(0, 1 << 63)) << 1
        b = a
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b ^= 1 << int(bit)

        def keys(x):
            out = []
            for i in range(4):
                whole, after = x >> 16 * i & 0xFFFF, x >> 16 * ((i + 1) % 4) & 0xFFFF
                out += [(2 * i + h) << 24 | whole << 8 | after >> 8 * h & 0xFF for h in range(2)]
            return out

        shared = np.array(sorted(set(keys(a)) & set(keys(b))), np.int64)
        assert len(shared)
        x, y = np.full(len(shared), a, np.uint64), np.full(len(shared), b, np.uint64)
        assert simhash.chained(x, y, shared).any()


def test_chain_never_passes_a_pair_out_of_reach():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
    flips = rng.integers(0, 8, 20000)
    b = a.copy()
    for k, n in enumerate(flips):
        for bit in rng.choice(64, n, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    key = rng.integers(0, 8, 20000).astype(np.int64) << 24
    ok = simhash.chained(a, b, key)
    assert not (ok & (np.bitwise_count(a ^ b) > 3)).any()


@pytest.mark.parametrize("block", [2, 4096])
def test_components_equal_brute_force(spark, block):
    random.seed(7)
    rows, centres = [], [random.getrandbits(64) for _ in range(12)]
    for d in range(400):
        fp = random.choice(centres)
        for _ in range(random.randrange(5)):
            fp ^= 1 << random.randrange(64)
        rows.append((d, fp))
    want = brute.components(rows)
    signed = [(fp - (1 << 64) if fp >> 63 else fp,) for _, fp in rows]
    prints = spark.createDataFrame(sorted(set(signed)), "fp long").repartition(3)
    links = simhash.print_links(prints, block)
    root = {r.node: r.root for r in simhash.components(links).collect()}
    group = {}
    for (d, _), (fp,) in zip(rows, signed):
        group.setdefault(root.get(fp, fp), []).append(d)
    got = {d: min(ds) for ds in group.values() for d in ds}
    assert got == want


def test_a_long_chain_settles(spark):
    n = 300
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)], "src long, dst long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(k, 0) for k in range(1, n + 1)}


def test_documents_with_nulls_repeats_and_extra_columns(spark):
    long = " ".join(f"word{k}" for k in range(400))
    rows = [(1, long, "x", 9), (2, long, "x", 9), (3, long + " tail", "y", 9), (4, None, "z", 9), (5, "", "z", 9), (5, "", "z", 9), (None, long, "n", 9), (7, "other words here now", "q", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    want = brute.components([(k, brute.fingerprint(r[1])) for k, r in enumerate(rows)])
    ids = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            ids[want[k]] = min(ids.get(want[k], r[0]), r[0])
    expected = sorted((str(r[0]), f"{brute.fingerprint(r[1]):016x}", ids[want[k]]) for k, r in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in out) == expected
    kept = near_copies.deduplicated(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept)[:-1] == [(False, d) for d in sorted(set(ids.values()))]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_whole_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, brute.fingerprint(r.text)) for r in docs.collect()]
    want = brute.components(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{fp:016x}", want[d]) for d, fp in rows}
