import numpy as np
import pytest

from weftline.llm import knn


def brute(rows, every, k=10):
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    lengths = [len(v) for _, v in good]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
    good = [(i, v) for i, v in good if len(v) == width]
    out = []
    for q, v in good:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("block,chunk,pivots", [(8192, 4096, 64), (50, 3, 5)])
def test_equals_brute_force(spark, block, chunk, pivots):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    v = centres[rng.integers(0, 6, 500)] + rng.normal(size=(500, 8)) * 0.1
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(k, [float(x) for x in np.float32(w)]) for k, w in enumerate(v)]
    rows += [(1000 + k, rows[3][1]) for k in range(60)]  # one very common vector
    rows += [(2000, None), (2010, [None] * 8), (2020, [float("nan")] + [0.0] * 7), (2030, [float("inf")] * 8), (2040, [1.0] * 5), (None, rows[0][1]), (2050, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    got = sorted(map(tuple, knn.top_k(df, 10, pivots=pivots, block=block, chunk=chunk).collect()))
    assert got == brute(rows, 10)


def test_bounds_prune_far_cells():
    pivots = np.array([[1000, 0], [0, 1000], [-1000, 0]])
    cells = [(j, 8, 50, 2.0) for j in range(3)]
    assert knn.bounds(pivots, cells, [(0, 3, 1.5)], 10) == [(0, 0)]


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.25, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, knn.top_k(df, 100).collect()))
    assert got == [(0, 1, 1, 524288), (0, 2, 2, 262144)]
    assert knn.top_k(df.limit(0), 100).collect() == []


def test_wide_products_stay_exact():
    a = np.array([[1 << 40, 3]], np.int64)
    b = np.array([[1 << 40, 5], [1, 1]], np.int64)
    assert knn.products(a, b).tolist() == [[(1 << 63) - 1, (1 << 40) + 3]]
    low = np.array([[-(1 << 63), 5]], np.int64)
    assert knn.products(low, np.array([[-1, 7], [1, 0]], np.int64)).tolist() == [[(1 << 63) - 1, -(1 << 63)]]
    c = np.array([[(1 << 29) + 1, 3]], np.int64)
    assert knn.products(c, c).tolist() == [[((1 << 29) + 1) ** 2 + 9]]


def test_a_query_with_many_rows_of_its_own(spark):
    rng = np.random.default_rng(5)
    rows = [(0, [1.0, 0.0])] * 30 + [(k, [float(x), float(y)]) for k, (x, y) in enumerate(np.array([0.0, 0.9]) + rng.normal(size=(40, 2)) * 0.001, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.vec_id, r.score) for r in knn.top_k(df, 100).orderBy("rank").collect()]
    low = [(i, 1024 * int(np.floor(1024 * float(np.float32(v[0]))))) for i, v in rows if i]
    assert got == sorted(low, key=lambda x: (-x[1], x[0]))[:10]


def test_bounds_allow_for_own_rows():
    pivots = np.array([[1000, 0], [0, 1000]])
    cells = [(0, 0, 15, 0.0), (1, 0, 50, 0.0)]
    assert knn.bounds(pivots, cells, [(0, 1, 0.0)], 10, {0: 12}) == [(0, 0), (0, 1)]


@pytest.mark.parametrize("block,chunk,pivots", [(8192, 4096, 64), (16, 3, 4)])
def test_repeated_query_ids_equal_brute_force(spark, block, chunk, pivots):
    rng = np.random.default_rng(8)
    point = [1.0] + [0.0] * 7
    rows = [(0, point)] * 20 + [(k, [float(x) for x in np.float32(rng.normal(size=8))]) for k in range(1, 60)] + [(30, [float(x) for x in np.float32(rng.normal(size=8))]) for _ in range(25)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in knn.top_k(df, 10, pivots=pivots, block=block, chunk=chunk).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    for q in (0, 10, 20, 40, 50):  # ids with one vector each
        v = next(w for i, w in ints if i == q)
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q)[:10]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert len(got[30]) == 10
