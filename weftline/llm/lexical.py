"""Ranked lexical search: sort-based accumulation of integer impacts.

Texts are read once. A worker counts each text's terms and keeps, of the terms
that some item asks for, how often the text holds them: a narrow table of
postings by document. Its sums give the collection's numbers and the weight of
each term. The postings are dealt by ranges of doc_id; a task lays the matched
(item, document, impact) arrays end to end, in slices of bounded length, sorts
them by one packed key, 16 bits at a time, adds up equal keys with ``reduceat``
and keeps the best documents of each item in heaps. Tasks hand on ``k`` rows an
item, which one last ranking merges.

Workers hold the terms of the items. Those are gathered in blocks of about
``VOCABULARY`` bytes, dealt by hash of the item, and each block passes over the
documents by itself; nothing else is gathered but one number a term.

Defined results: null and empty texts have no terms; rows that repeat a doc_id
are documents of their own, equal scores of one id in any order; a null doc_id
comes after all others; rows that repeat an item_id are one item with the terms
of all of them; items without terms have no rows; empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, small_batches, stored

#: Documents an item, bytes of the terms of a block of items, matched entries that are sorted at a time, bytes of a text that are split at a time.
K, VOCABULARY, ENTRIES, PIECE = 10, 1 << 26, 1 << 21, 1 << 20
#: Bytes that terms consist of, A-Z as a-z; all others part them.
TERMS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    start = 0
    while start < len(text):
        end = start + PIECE
        part = text[start:end].translate(TERMS)
        if end < len(text):
            cut = part.rfind(b" ")
            while cut < 0:  # a term longer than a piece
                more = text[end : end + PIECE].translate(TERMS)
                end += PIECE
                part += more
                cut = part.rfind(b" ") if more and end < len(text) else len(part)
            end = start + cut + 1
            part = part[:cut]
        start = end
        yield part.split()


def asked(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                found = sorted({t for part in terms(text.as_py()) for t in part})
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(found), pa.int64()), pa.array(found, pa.binary())], ["item_id", "term"])

    rows = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return small_batches(rows).mapInArrow(split, "item_id long, term binary").distinct()


class Block:
    """The terms of some items: which terms there are, and which items ask for each."""

    def __init__(self, pairs: list[tuple[int | None, bytes]]):
        self.items = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
        number = {i: k for k, i in enumerate(self.items)}
        self.terms: dict[bytes, int] = {}
        by_term: list[list[int]] = []
        for item, term in pairs:
            k = self.terms.setdefault(term, len(by_term))
            if k == len(by_term):
                by_term.append([])
            by_term[k].append(number[item])
        self.sizes = np.array([len(x) for x in by_term], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)].astype(np.int64)
        self.asking = np.array([i for x in by_term for i in x], np.int64)


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, row, n (terms of the text), terms and counts (those of the vocabulary), of documents with a term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            sizes, offsets, found, times = [], [0], [], []
            for text in batch["text"]:
                n, seen = 0, Counter()
                for part in terms(text.as_py()):
                    n += len(part)
                    seen.update(map(get, part))
                seen.pop(None, None)
                sizes.append(n)
                found.extend(seen.keys())
                times.extend(seen.values())
                offsets.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, kind)) for x, kind in ((found, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], pa.array(sizes, pa.int64()), *lists], ["doc_id", "row", "n", "terms", "counts"])

    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("text"))
    return small_batches(rows).mapInArrow(counted, "doc_id long, row long, n long, terms array<int>, counts array<long>").where(F.col("n") > 0)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative integers, by counting 16 bits at a time."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    top, shift = int(keys.max(initial=0)), 16
    while top >> shift:
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


class Best:
    """The k best documents of each item so far, in heaps."""

    def __init__(self, items: int, k: int):
        self.heaps: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]
        self.floor, self.k = np.zeros(items, np.int64), k

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, named: np.ndarray) -> None:
        """Sums of a slice; doc descends in rank within equal scores as it ascends."""
        some = np.flatnonzero((score > 0) & (score >= self.floor[item]))
        some = some[np.lexsort((doc[some], ~named[some], -score[some], item[some]))]
        own = item[some]
        nth = np.arange(len(some)) - np.searchsorted(own, own)
        for i, s, d, ok in zip(*(x[some[nth < self.k]].tolist() for x in (item, score, doc, named)), strict=True):
            heap, entry = self.heaps[i], (s, ok, -d)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.floor[i] = heap[0][0]

    def rows(self) -> list[tuple[int, int, int | None]]:
        return [(i, s, -d if ok else None) for i, heap in enumerate(self.heaps) for s, ok, d in heap]


def ranked(table: DataFrame, block: Block, weights: np.ndarray, k: int) -> DataFrame:
    """item (its number), score, doc_id: each task's best documents; ``table`` has m beside the postings."""
    asking, starts, sizes, items = block.asking, block.starts, block.sizes, len(block.items)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, k)
        for batch in batches:
            column = lambda name: batch[name].fill_null(0).to_numpy(zero_copy_only=False)
            doc, named, m = column("doc_id"), batch["doc_id"].is_valid().to_numpy(zero_copy_only=False), column("m")
            upto = batch["terms"].offsets.to_numpy() - batch["terms"].offsets[0].as_py()
            term, tf = batch["terms"].flatten().to_numpy(), batch["counts"].flatten().to_numpy()
            at = np.repeat(np.arange(len(doc)), np.diff(upto))
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at]))
            entries = np.r_[0, np.cumsum(sizes[term])][upto]  # matched entries before each document
            first = 0
            while first < len(doc):
                last = max(first + 1, int(np.searchsorted(entries, entries[first] + ENTRIES, "right")) - 1)
                part = slice(upto[first], upto[last])
                n = sizes[term[part]]
                if total := int(n.sum()):
                    # the items that ask for each matched term, end to end
                    place = np.arange(total) + np.repeat(starts[term[part]] - np.r_[0, np.cumsum(n)[:-1]], n)
                    key = asking[place] * (last - first) + np.repeat(at[part] - first, n)
                    order = radix_order(key)
                    key = key[order]
                    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                    score = np.add.reduceat(np.repeat(impact[part], n)[order], heads)
                    item, where = np.divmod(key[heads], last - first)
                    best.add(item, score, doc[first + where], named[first + where])
                first = last
        rows = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["item", "score", "doc_id"])

    return small_batches(table.repartitionByRange("doc_id", "row").select("doc_id", "m", "terms", "counts")).mapInArrow(scored, "item long, score long, doc_id long")


def search_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    """item_id, rank, doc_id, score of the items of one block."""
    spark = docs.sparkSession
    table = stored(postings(docs, block.terms), "postings")
    total = table.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    holders = table.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # one row a term of the block at most
    weights = np.zeros(len(block.terms), np.int64)
    for term, df in holders:
        weights[term] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * df + 1)))
    # in wide decimals: 90 * n * N may pass 64 bits
    share = F.expr(f"CAST((CAST(90 * n AS DECIMAL(28, 0)) * CAST({total['docs']} AS DECIMAL(10, 0))) DIV {max(total['terms'], 1)} AS BIGINT)")
    found = ranked(table.withColumn("m", share + 10), block, weights, k)
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    names = spark.createDataFrame(list(enumerate(block.items)), "item long, item_id long")
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # the block's items


def search(docs: DataFrame, items: DataFrame, k: int = K, vocabulary: int = VOCABULARY) -> DataFrame:
    """Each item's k highest-scoring documents: item_id, rank, doc_id, score."""
    pairs = stored(asked(items), "asked")
    size = pairs.agg(F.sum(F.octet_length("term") + 100)).first()[0] or 0
    blocks = -(-size // vocabulary)
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        if own:
            out = out.unionByName(search_block(docs, Block([(r["item_id"], bytes(r["term"])) for r in own]), k))
    forget(pairs)
    return out
