"""Exact top-k inner products by a Voronoi kNN join.

A bounded sample of vectors serves as pivots; queries and data go to the cell of
their nearest pivot. Summaries of the cells - counts by binned distance to the
pivot, and the farthest - give for each group of queries a score that k
candidates are sure to reach, and for each cell the highest score that any of
its vectors can reach. Only pairs of a group and a cell whose bound reaches the
sure score meet: a query travels to the cells it needs, every data vector stays
in its own. Large cells are dealt into blocks and many queries into chunks, so a
task multiplies two bounded matrices, keeps k rows a query, and a last step
merges those.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part, nor do those with a null vec_id or of another length
than the most frequent one (of equally frequent ones the longest); rows that
repeat a query's vec_id count as its own, and of repeated queries one is asked;
repeated candidates are listed as often as they occur; scores beyond 64 bits are
cut to the largest or smallest long; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Pivots, rows of a data block, queries of a chunk, results a query.
PIVOTS, BLOCK, CHUNK, K = 64, 8192, 4096, 10
#: Components are scaled by this and rounded down.
SCALE = 1024
#: Bins of distance for each doubling.
BINS = 8


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the integer components, of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    return rows.join(F.broadcast(width.select("n")), F.size("v") == F.col("n")).drop("n")


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact: floats while they are, else wide integers."""
    largest = lambda x: max(float(x.max(initial=0)), -float(x.min(initial=0)))  # noqa: E731  # no long has the smallest one's size
    top = largest(a) * largest(b) * a.shape[1]
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < float(1 << 62):
        return a @ b.T
    wide = a.astype(object) @ b.astype(object).T
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller place."""
    low = ~scores  # ascends as scores descend, and cannot overflow
    if len(low) > 4 * k:
        some = np.flatnonzero(low <= np.partition(low, k - 1)[k - 1])
    else:
        some = np.arange(len(low))
    return some[np.argsort(low[some], kind="stable")[:k]]


def assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, v, cell (nearest pivot) and far (distance to it)."""
    p = pivots.astype(np.float64)
    square = (p * p).sum(1)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"), p.shape[1]).astype(np.float64)
            cell = np.argmin(square - 2 * (x @ p.T), axis=1)
            far = np.sqrt(((x - p[cell]) ** 2).sum(1))
            yield pa.record_batch([b.column("vec_id"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(far)], names=["vec_id", "v", "cell", "far"])

    return rows.mapInArrow(run, "vec_id long, v array<bigint>, cell int, far double")


def bounds(pivots: np.ndarray, cells: list, groups: list, k: int, own: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """The (group, cell) pairs that may hold a result.

    ``cells``: (cell, bin, n, farthest) rows; ``groups``: (cell, n, radius) rows
    of the queries; ``own``: the most rows that a query of the group has itself,
    one unless given. A score of group i and cell j lies within
    p_i.p_j -+ (r_i |p_j| + (|p_i| + r_i) d), d the distance from p_j.
    """
    p = pivots.astype(np.float64)
    dot, norm = p @ p.T, np.sqrt((p * p).sum(1))
    reach: dict[int, float] = {}
    for j, _, _, far in cells:
        reach[j] = max(reach.get(j, 0.0), far)
    pairs = []
    for i, _, radius in groups:
        sure = sorted(((dot[i, j] - radius * norm[j] - (norm[i] + radius) * min(2 ** (b / BINS), reach[j]), n) for j, b, n, _ in cells), reverse=True)
        left, limit = k + (own or {}).get(i, 1), -np.inf  # more, for the query's own rows
        for low, n in sure:
            left -= n
            if left <= 0:
                limit = low
                break
        for j, far in reach.items():
            high = dot[i, j] + radius * norm[j] + (norm[i] + radius) * far
            if high >= limit - 1 - 1e-9 * (abs(high) + abs(limit) if np.isfinite(limit) else 0):
                pairs.append((int(i), int(j)))
    return pairs


def solve(key, queries: pa.Table, data: pa.Table, k: int = K) -> pa.Table:
    """The k best of one block for each query of one chunk."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if queries.num_rows and data.num_rows:
        width = len(data.column("v")[0])
        ids = data.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], matrix(data.column("v"), width)[order]
        q_ids, q_rows = queries.column("query_id").to_numpy(), matrix(queries.column("q"), width)
        for at in range(0, len(q_ids), 256):
            scores = products(q_rows[at : at + 256], rows)
            for q, s in zip(q_ids[at : at + 256], scores, strict=True):
                a, b = np.searchsorted(ids, q), np.searchsorted(ids, q, side="right")
                if a < b:  # without the query's own row
                    s, own = np.r_[s[:a], s[b:]], np.r_[ids[:a], ids[b:]]
                else:
                    own = ids
                top = best(s, k)  # ids ascend
                out.append((np.full(len(top), q), own[top], s[top]))
    columns = [np.concatenate([o[c] for o in out]) if out else np.empty(0, np.int64) for c in range(3)]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})


def top_k(vectors: DataFrame, every: int = 100, k: int = K, pivots: int = PIVOTS, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows for each query row."""
    rows = stored(scaled(vectors), "vectors")
    spark = vectors.sparkSession
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()  # so many rows at most
    empty = "query_id long, rank int, vec_id long, score long"
    if not chosen:
        return spark.createDataFrame([], empty)
    p = np.unique(np.array([r["v"] for r in chosen], np.int64), axis=0)
    cells = stored(assigned(rows, p), "cells")
    asked = cells.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("cell", "far", "v")).alias("x"), F.count(F.lit(1)).alias("own")).select(F.col("vec_id").alias("query_id"), "own", "x.*")
    asked = stored(asked.withColumnRenamed("v", "q"), "queries")
    # summaries: at most pivots * 512 rows, and pivots rows
    bins = F.ceil(F.log2(F.greatest("far", F.lit(1.0))) * BINS).cast("int")
    by_bin = [tuple(r) for r in cells.groupBy("cell", bins.alias("bin")).agg(F.count(F.lit(1)), F.max("far")).collect()]
    grouped = asked.groupBy("cell").agg(F.count(F.lit(1)), F.max("far"), F.max("own")).collect()
    by_group, own = [tuple(r)[:3] for r in grouped], {r[0]: r[3] for r in grouped}
    pairs = bounds(p, by_bin, by_group, k, own)
    if not pairs:
        return spark.createDataFrame([], empty)
    size = dict.fromkeys((j for _, j in pairs), 0)
    for j, _, n, _ in by_bin:
        if j in size:
            size[j] += n
    many = {i: n for i, n, _ in by_group}
    blocks = {j: -(-n // block) for j, n in size.items()}
    chunks = {j: -(-sum(many[i] for i, c in pairs if c == j) // chunk) for j in size}

    # at most pivots rows, and pivots * pivots rows
    plan = F.broadcast(spark.createDataFrame([(j, blocks[j], chunks[j]) for j in size], "cell int, blocks int, chunks int"))
    needs = F.broadcast(spark.createDataFrame([(i, j, blocks[j], chunks[j]) for i, j in pairs], "group int, cell int, blocks int, chunks int"))

    def split(of: str, n: str):
        return F.pmod(F.xxhash64(of), F.col(n)).cast("int")

    def each(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    # by place in the stored table, so that rows that share an id are dealt out like others
    turn = F.pmod(F.monotonically_increasing_id(), F.col("blocks")).cast("int")
    data = cells.join(plan, "cell").select("cell", turn.alias("block"), "chunks", "vec_id", "v").select("cell", "block", each("chunks").alias("chunk"), "vec_id", "v")
    ask = asked.withColumnRenamed("cell", "group").join(needs, "group").select("cell", "blocks", split("query_id", "chunks").alias("chunk"), "query_id", "q").select("cell", each("blocks").alias("block"), "chunk", "query_id", "q")
    key = ["cell", "block", "chunk"]

    def run(k1, left: pa.Table, right: pa.Table) -> pa.Table:
        return solve(k1, left, right, k)

    found = ask.groupBy(*key).cogroup(data.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
