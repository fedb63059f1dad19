"""SimHash near-duplicates by pigeonring filtering.

Fingerprints of at most ``DIFFERING`` differing bits link; a class is a
connected component. The 64 bits lie on a ring of four segments of 16. If two
fingerprints differ in at most 3 bits, then from some segment on every chain of
l consecutive segments differs in at most l * 3/4 bits: 0, 1, 2 and 3 bits in
chains of one to four. So a candidate shares one segment whole and, in the
segment that follows, at least one half; those 24 bits and their place are the
key under which fingerprints meet. Then the chain of three is checked, and only
what passes it gets the full Hamming check.

Only distinct fingerprints meet: copies join by equality. A key with more than
``BLOCK`` fingerprints is dealt into pairs of blocks, so no task holds more
than two blocks of a key. Within a task a union of the links found leaves a
forest, so a dense group of near copies never becomes all its pairs.

Defined results: null and empty texts have no words and fingerprint zero; texts
of one or two words are one shingle; rows with a null doc_id are kept, and
their component is the smallest doc_id that is not null, if any; repeated rows
come out as often as they came in; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, small_batches, stored

#: Fingerprints with this many differing bits or fewer link.
DIFFERING = 3
#: Words in a shingle, and the seed of its hash.
SHINGLE, SEED = 3, 42
#: Fingerprints of one key that one block holds.
BLOCK = 2048
#: Shingles hashed at a time.
CHUNK = 1 << 16
SEGMENT = np.uint64(0xFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(flat, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), CHUNK):
        h = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
        yield pa.record_batch([b.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""
    return small_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(_fingerprints, "doc_id long, fp long")


def keys(fp: Column, number: int | Column = 0) -> Column:
    """The eight keys of a fingerprint: the table's number, which segment is whole,
    which half of the next agrees, and those 24 bits."""
    base = F.shiftleft((F.lit(number) if isinstance(number, int) else number).cast("long"), 32)
    out = []
    for i in range(4):
        whole = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
        after = F.shiftrightunsigned(fp, 16 * ((i + 1) % 4)).bitwiseAND(F.lit(0xFFFF))
        for half in range(2):
            part = F.shiftright(after, 8 * half).bitwiseAND(F.lit(0xFF))
            out.append(base + F.lit((2 * i + half) << 24) + F.shiftleft(whole, 8) + part)
    return F.array(*out)


def met(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, pair, node, fp): the groups within which fingerprints are compared.

    ``rows``: key, node, fp. Keys of one row go. A key of more than ``block`` is
    split by hash into blocks, and each of them goes to every pair of blocks
    that it is in.
    """
    # a table of its own: a hot key's rows can then be split, or the counts broadcast if they are few
    counts = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("key", "k"), "key-counts")
    both = rows.join(counts, F.col("key") == F.col("k")).select("key", "node", "fp", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))
    return dealt(both, ["key"], "node").select("key", "pair", "node", "fp")


def dealt(rows: DataFrame, group: list[str], by: str) -> DataFrame:
    """``rows`` (with ``blocks``, how many blocks their group has) at each pair of blocks that they are in."""
    mine = F.pmod(F.xxhash64(by, *group), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    out = rows.withColumn("mine", mine).withColumn("other", other)
    return out.withColumn("pair", F.least("mine", "other").cast("long") * 0x7FFFFFFF + F.greatest("mine", "other"))


def chained(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The pairs whose chains from the key's segment stay within 0, 1, 2 and 3 bits;
    the chain of all four segments is the full Hamming check."""
    x, at = a ^ b, (key >> 25 & 3).astype(np.uint64)
    left, spent = np.arange(len(x)), np.zeros(len(x), np.uint8)
    for step in range(4):
        spent = spent + np.bitwise_count(x >> (np.uint64(16) * ((at + np.uint64(step)) % np.uint64(4))) & SEGMENT)
        ok = spent <= (step + 1) * DIFFERING // 4
        left, spent, x, at = left[ok], spent[ok], x[ok], at[ok]
    found = np.zeros(len(a), bool)
    found[left] = True
    return found


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node that is not its component's root."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            keep = root != np.arange(len(nodes))
            return nodes[keep], nodes[root[keep]]
        root = new


def links_of(key: np.ndarray, pair: np.ndarray, node: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between nodes in rows sorted by key and pair."""
    u, left, right = fp.view(np.uint64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
    size = np.diff(np.r_[starts, len(key)])
    last = np.repeat(starts + size, size)
    at = np.arange(len(key))
    held = 0
    for gap in range(1, int(size.max(initial=1))):
        at = at[at + gap < last[at]]
        if not len(at):
            break
        ok = chained(u[at], u[at + gap], key[at])
        if ok.any():
            left.append(node[at[ok]])
            right.append(node[at[ok] + gap])
            held += int(ok.sum())
            if held > 1 << 20:  # keep only a forest of what is known so far
                a, b = roots(np.concatenate(left), np.concatenate(right))
                left, right, held = [a], [b], 0
    return roots(np.concatenate(left), np.concatenate(right))


def whole_groups(batches: Iterator[pa.RecordBatch], group: tuple[str, ...], least: int) -> Iterator[pa.Table]:
    """Tables of at least ``least`` rows (but the last) that cut no group; batches come sorted by group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < least:
            continue
        rows = pa.Table.from_batches(held)
        same = np.ones(rows.num_rows, bool)
        for g in group:
            c = rows.column(g).to_numpy()
            same &= c == c[-1]
        cut = int(np.flatnonzero(same)[0])
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut).combine_chunks().to_batches()
        size = rows.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_groups(batches, ("key", "pair"), 1 << 16):
        a, b = links_of(*(rows.column(n).to_numpy() for n in ("key", "pair", "node", "fp")))
        if len(a):
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["src", "dst"])


def links(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(src, dst): links between the nodes of (key, node, fp) rows, a forest from each task."""
    placed = met(rows, block).repartition("key", "pair").sortWithinPartitions("key", "pair", "node")
    return placed.mapInArrow(_links, "src long, dst long")


def print_links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(src, dst) over distinct fingerprints ``fp``, which are their own nodes."""
    return links(prints.select(F.explode(keys(F.col("fp"))).alias("key"), F.col("fp").alias("node"), "fp"), block)


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) with root the smallest node of its component.

    Large-star and small-star steps in turn until nothing changes; the count of
    steps grows with the logarithm of the largest component. Each step's table
    is written to the shared folder. Raises if ``limit`` steps do not do.
    """

    def star(e: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
        """Link each node's neighbours (larger ones, or smaller ones and itself) to its least neighbour; and the table of those."""
        both = e.union(e.select(F.col("dst"), F.col("src"))) if large else e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least")).withColumnRenamed("src", "node")
        least = stored(least, "least")  # so that the rows of a hub can be split in the join
        joined = both.join(least, F.col("src") == F.col("node"))
        if large:
            out = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        else:
            out = joined.select(F.col("dst").alias("src"), F.col("least").alias("dst")).union(least.select(F.col("node").alias("src"), F.col("least").alias("dst")))
        return out.where("src != dst").distinct(), least

    now = stored(edges.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "links")
    seen = None
    for _ in range(limit):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            out = now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
            out._weftline_path = now._weftline_path
            return out
        seen = tuple(state)
        before = now
        large, used = star(now, True)
        small, more = star(large, False)
        now = stored(small, "links")
        forget(before, used, more)
    raise RuntimeError("components did not settle")


def print_roots(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(fp, root): every distinct fingerprint and its component's smallest."""
    found = components(print_links(prints, block))
    return prints.join(found, F.col("fp") == F.col("node"), "left").select(*prints.columns, F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    prints = stored(fingerprints(docs), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    rooted = print_roots(distinct, block)
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    named = rooted.join(least, "root").select(F.col("fp").alias("f"), "component_id")
    return prints.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    return classes(docs, block).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
