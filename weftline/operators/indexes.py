"""Stored indexes for both retrieval legs; what they let through is scored exactly.

``KeywordIndex``: which documents hold which three characters in a row, as a table
of postings by gram and block of documents, and the passages beside it by
document. A term stands in a passage only if all its grams do, so the documents
that have all grams of some term are all that can score; their passages are read
and scored as ever.

``VectorIndex``: vectors in the cell of their nearest centre, a partition a cell,
with the widest angle of each. A query reads cells by the highest similarity that
any of their vectors can have, a few at a time, until the best found beat all
that is left. The result is that of a full scan, whatever the centres.

Both are Parquet folders that Spark prunes by partition and by the ranges of
sorted row groups; the driver sees a query's grams, its ``k`` best and a row a cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keywords import normalized, query_terms
from ..functions.scores import cosine_similarity

GRAM = 3
#: Folders of postings and of passages; documents that are named in a filter rather than joined.
SLOTS, PARTS, NAMED = 64, 64, 1000
#: Documents of a block of postings, and the folder that says which they are.
BLOCK, DIRECTORY = 1024, -1
#: What terms are made of, and its number by byte.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789+"
CODES = np.full(256, len(LETTERS), np.uint8)
CODES[list(LETTERS.encode())] = np.arange(len(LETTERS))


def slot_of(gram: Column) -> Column:
    return F.when(gram.isNull(), DIRECTORY).otherwise(F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int"))


def grams_of(term: str) -> list[str]:
    return sorted({term[k : k + GRAM] for k in range(len(term) - GRAM + 1)})


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of each batch's passages (document_id, title, content; lower case), BLOCK documents at a time.

    A block is a row a gram, with the places of the documents that have it, and a
    row without gram, the documents by place. Rows of a document that follow each
    other share a place; others of it get a place of their own, with all grams of
    their own passages.
    """
    task, nth = TaskContext.get().partitionId() << 33, 0
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        ids, title = (rows[c].combine_chunks() for c in ("document_id", "title"))
        fresh, other = (np.r_[True, pc.not_equal(x[1:], x[:-1]).fill_null(True).to_numpy(zero_copy_only=False)][: len(x)] for x in (ids, title))
        starts = np.flatnonzero(fresh)
        document = np.cumsum(fresh) - 1
        for first in range(0, len(starts), BLOCK):
            many = min(BLOCK, len(starts) - first)
            a, b = starts[first], starts[first + many] if first + many < len(starts) else len(ids)
            held = np.zeros((len(LETTERS) ** GRAM, many), bool)
            for column, wanted in (("title", np.flatnonzero((fresh | other)[a:b])), ("content", np.arange(b - a))):
                held[grams_in(rows[column].slice(a, b - a).combine_chunks().take(pa.array(wanted)), document[a:b][wanted] - first)] = True
            grams = np.flatnonzero(held.any(axis=1))
            gram, place = np.nonzero(held[grams])
            ends = np.r_[0, np.cumsum(np.bincount(gram, minlength=len(grams)))].astype(np.int32)
            names = np.array([LETTERS[g // len(LETTERS) ** 2] + LETTERS[g // len(LETTERS) % len(LETTERS)] + LETTERS[g % len(LETTERS)] for g in grams], object)
            block = task + nth
            nth += 1
            yield pa.record_batch(
                [
                    pa.array([*names, None], pa.string()), pa.array(np.full(len(grams) + 1, block), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.r_[ends, ends[-1:]]), pa.array(place.astype(np.int16))),
                    pa.array([None] * len(grams) + [ids.take(pa.array(starts[first : first + many])).to_pylist()], pa.list_(pa.string())),
                ],
                names=["gram", "block", "places", "documents"],
            )


def grams_in(texts: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the gram, owner) of all grams in texts, repeats included."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(texts) else np.empty(0, np.uint8)
    code = CODES[data]
    fine = code < len(LETTERS)
    at = np.flatnonzero(fine[:-2] & fine[1:-1] & fine[2:]) if len(data) >= GRAM else np.empty(0, np.int64)
    mine = np.searchsorted(ends - ends[0], at, "right") - 1
    inside = at + GRAM <= (ends - ends[0])[mine + 1]
    at, mine = at[inside], mine[inside]
    code = code.astype(np.int64)
    return (code[at] * len(LETTERS) + code[at + 1]) * len(LETTERS) + code[at + 2], owner[mine]


class KeywordIndex:
    """Postings of grams and passages by document, under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def built(cls, passages: DataFrame, path: str) -> KeywordIndex:
        """The index of passages (chunk_id, document_id, title, content and more), written once.

        Folders that grow large are split by size, so each is many files. A
        gram's postings are a row a block of documents: what moves is a number
        a document and gram, and no task sees more of a gram than its blocks.
        """
        index = cls(passages.sparkSession, path)
        part = F.pmod(F.xxhash64(F.col("document_id").cast("string")), F.lit(PARTS)).cast("int")
        rows = passages.withColumn("part", part).hint("rebalance", "part").sortWithinPartitions("part", "document_id", "chunk_id")
        rows.write.partitionBy("part").parquet(f"{index.path}/passages")
        lower = [F.lower(F.col(c)).alias(c) for c in ("title", "content")]
        kind = index.passages().schema["document_id"].dataType.simpleString()
        blocks = index.passages().select(F.col("document_id").cast("string").alias("document_id"), *lower).mapInArrow(blocks_of, "gram string, block long, places array<smallint>, documents array<string>")
        slotted = blocks.withColumn("documents", F.col("documents").cast(f"array<{kind}>")).withColumn("slot", slot_of(F.col("gram"))).hint("rebalance", "slot")
        slotted.sortWithinPartitions("slot", "gram", "block").write.partitionBy("slot").parquet(f"{index.path}/postings")
        return index

    def passages(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/passages")

    def documents(self, query: str) -> DataFrame:
        """document_id of all that hold all grams of one of the query's terms."""
        wanted = [grams_of(t) for t in query_terms(query)]
        every = sorted({g for gs in wanted for g in gs})
        postings = self.spark.read.parquet(f"{self.path}/postings")
        places = postings.where(F.col("slot") == DIRECTORY).select("block", F.posexplode("documents").alias("place", "document_id"))
        if not every:
            return places.select("document_id").limit(0)
        (named,) = self.spark.range(1).select(F.array_distinct(F.array(*(slot_of(F.lit(g)) for g in every)))).first()  # the folders of the query's grams
        rows = postings.where(F.col("slot").isin(named) & F.col("gram").isin(every)).select("block", "gram", F.explode("places").alias("place"))
        whole = [F.sum(F.when(F.col("gram").isin(gs), 1).otherwise(0)) == len(gs) for gs in wanted]
        held = rows.groupBy("block", "place").agg(F.array(*whole).alias("whole")).where(F.exists("whole", lambda w: w))
        return places.join(held.select("block", F.col("place").cast("int").alias("place")), ["block", "place"]).select("document_id").distinct()

    def candidates(self, query: str) -> DataFrame:
        """The passages of those documents: by name where they are few, else by a join."""
        documents = self.documents(query)
        few = [r[0] for r in documents.limit(NAMED + 1).collect()]
        rows = self.passages()
        if len(few) > NAMED:
            return rows.join(documents, "document_id", "left_semi").drop("part")
        parts = self.spark.createDataFrame([(d,) for d in few], documents.schema).select(F.pmod(F.xxhash64(F.col("document_id").cast("string")), F.lit(PARTS)).cast("int")).distinct()
        return rows.where(F.col("part").isin([r[0] for r in parts.collect()]) & F.col("document_id").isin(few)).drop("part")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


class VectorIndex:
    """Vectors by cell, and a row a cell, under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.read: list[int] = []  # cells that the last query read

    @classmethod
    def built(cls, vectors: DataFrame, path: str, cells: int = 64, key: str = "chunk_id") -> VectorIndex:
        """The index of rows with an ``embedding``; those without one, or of zeros, take no part.

        Centres are the ``cells`` vectors with the smallest hashes of their key.
        """
        index = cls(vectors.sparkSession, path)
        fine = (F.size("embedding") > 0) & F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        rows = vectors.where("embedding IS NOT NULL").where(fine)
        sample = [r["embedding"] for r in rows.orderBy(F.xxhash64(key), key).select("embedding").limit(cells).collect()]
        if not sample:
            rows.withColumns({"cell": F.lit(0), "near": F.lit(1.0)}).write.partitionBy("cell").parquet(f"{index.path}/vectors")
            index.spark.createDataFrame([], "cell int, least double, rows long, centre array<double>").write.parquet(f"{index.path}/cells")
            return index
        centres = unit(np.array(sample, np.float64))

        @F.pandas_udf("struct<cell int, near double>")
        def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                near = unit(np.stack(batch.to_numpy()).astype(np.float64)) @ centres.T if len(batch) else np.empty((0, len(centres)))
                yield pd.DataFrame({"cell": near.argmax(1).astype(np.int32), "near": near.max(1, initial=-1.0)})

        dealt = rows.withColumn("_at", placed("embedding")).select(*rows.columns, "_at.cell", "_at.near")
        dealt.repartitionByRange("cell", key).write.partitionBy("cell").parquet(f"{index.path}/vectors")
        summary = index.vectors().groupBy("cell").agg(F.min("near").alias("least"), F.count(F.lit(1)).alias("rows"))
        middle = index.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
        summary.join(middle, "cell").write.parquet(f"{index.path}/cells")
        return index

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def bounds(self, q: np.ndarray) -> list[tuple[float, int]]:
        """(highest similarity that a vector of it can have, cell), the highest first."""
        out = []
        for r in self.spark.read.parquet(f"{self.path}/cells").collect():
            angle, widest = (math.acos(max(-1.0, min(1.0, x))) for x in (float(q @ np.array(r["centre"])), r["least"]))
            out.append((math.cos(max(0.0, angle - widest)) + 1e-9, r["cell"]))
        return sorted(out, reverse=True)

    def best(self, query: list[float], k: int, allowed: DataFrame | None = None, first: int = 4, key: str = "chunk_id") -> DataFrame:
        """The k rows most like the query, as a full scan finds them: similarity to four decimals, ties to the smaller key.

        ``allowed`` (document_id) are the documents that count.
        """
        rows, self.read = self.vectors(), []
        q = np.array(query, np.float64)
        found: list[tuple] = []
        left, many = self.bounds(unit(q)) if q.any() else [], first
        columns = [c for c in rows.columns if c not in ("cell", "near", "embedding")]
        while left:
            # similarities are rounded, so a cell within half a step of the last kept may hold a tie
            if len(found) == k and found[-1][-1] > left[0][0] + 5.1e-5:
                break
            now, left, many = [c for _, c in left[:many]], left[many:], 2 * many
            self.read += now
            some = rows.where(F.col("cell").isin(now))
            if allowed is not None:
                some = some.join(allowed.select("document_id"), "document_id", "left_semi")
            scored = some.select(*columns, cosine_similarity(F.col("embedding"), F.array(*map(F.lit, q.tolist()))).alias("vector_similarity")).where("vector_similarity IS NOT NULL")
            found += [tuple(r) for r in scored.orderBy(F.desc("vector_similarity"), key).limit(k).collect()]
            place = columns.index(key)
            found = sorted(found, key=lambda r: (-r[-1], r[place]))[:k]
        schema = rows.select(*columns, F.lit(0.0).alias("vector_similarity")).schema
        return self.spark.createDataFrame(found, schema)

    def share_read(self) -> float:
        """What share of the rows lies in the cells that the last query read."""
        sizes = {r["cell"]: r["rows"] for r in self.spark.read.parquet(f"{self.path}/cells").select("cell", "rows").collect()}
        return sum(sizes[c] for c in self.read) / max(1, sum(sizes.values()))
