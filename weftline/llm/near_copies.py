"""Near copies of texts: SimHash candidates by pigeonring filtering, then similarity.

Texts are near copies if their sets of five-word shingles are alike to 0.8 or
more. Such texts differ in a few words, so fingerprints of their sets of words
are close. ``PRINTS`` independent fingerprints meet under the keys of
``simhash.keys``; two texts are candidates if any of the prints differ in 3 bits
at most. This joins most copies cheaply; what it misses (copies with a block of
text more or less) is found by exact prefix filtering of the shingle sets: sets
alike to 0.8 share one of their first n - ceil(0.8 n) + 1 shingles in any common
order, and each pair of texts that do, and are not yet in one class, is decided
by its whole sets. So no pair alike to 0.8 is missed, whatever the prints say.

The prints' candidates' components are looked into, also by whole sets (64-bit
hashes of all shingles); the threshold is 0.8 exactly. What moves to where two
texts are compared is their words, compressed; their sets are made there.

Texts of equal words join by their digest first, so every group of copies is one
node from then on. Large components are dealt into pairs of blocks, and a task
that knows two texts to be connected does not compare them; under a prefix key
the largest class is never compared with itself. So a dense group costs little
more than its size. Texts go through Python once; later passes read their words.

Defined results: null and empty texts are equal texts; texts of fewer than five
words have one shingle; a group keeps the row with its smallest doc_id, unlike
texts under one doc_id are texts of their own, of rows that repeat both one
stays, and rows with a null doc_id all stay; an empty table gives an empty
result; extra columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import forget, row_of, rows_again, small_batches, stored

#: Similarity of five-word shingles from which texts are near copies.
SIMILARITY, SHINGLE = 0.8, 5
#: Fingerprints of the words, and texts of a component in one block. More prints save no link, only later work.
PRINTS, BLOCK = 4, 512
#: Shingles a text of a block may have on average; components of longer texts get more blocks.
SET_SIZE = 1 << 10
#: Words hashed at a time.
CHUNK = 1 << 13
#: Most frequent shingles that the order of prefixes puts last; which ones changes the work, not the result.
COMMON = 1 << 16
_STEPS = (np.arange(PRINTS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_prints(words: list[bytes]) -> np.ndarray:
    """SimHashes of the set of words, one for each of the independent hashes."""
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in set(words)], np.uint64)
    ones = np.zeros(PRINTS * 64, np.int64)
    for k in range(0, len(h), CHUNK):
        bits = mixed(h[k : k + CHUNK, None] + _STEPS).view(np.uint8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)


def shingle_set(words: list[bytes]) -> np.ndarray:
    """The hashes of all distinct shingles, ascending."""
    if not words:
        return np.empty(0, np.int64)
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    n = min(SHINGLE, len(words))
    starts, ends = (ends - size)[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(flat[a:b]) for a, b in zip(starts, ends, strict=True)], np.uint64).view(np.int64))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def pack(words: list[bytes]) -> bytes:
    """A text's words as they travel: a third of its shingles' hashes, or less."""
    return zstandard.compress(b" ".join(words), 1)


def unpack(packed: bytes) -> np.ndarray:
    """The shingle set of packed words."""
    return shingle_set(zstandard.decompress(packed).split())


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that several different texts of a batch have, and how many."""
    for b in batches:
        sets = [unpack(w) for w in {w.as_py() for w in b.column("words")}]
        key, n = np.unique(np.concatenate([np.empty(0, np.int64), *sets]), return_counts=True)
        yield pa.record_batch([pa.array(key[n > 1]), pa.array(n[n > 1].astype(np.int64))], names=["key", "n"])


def prefix(hashes: np.ndarray, last: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The first shingles of a set, in an order that is the same for all texts.

    Two sets alike to SIMILARITY share at least one of them: what is left of a
    set of n is too small to hold the 4n/5 shingles that they must share.
    ``last`` (ascending) come after all others, by ``weight``; this only saves work.
    """
    n = len(hashes)
    if len(last):
        at = np.minimum(np.searchsorted(last, hashes), len(last) - 1)
        hashes = hashes[np.lexsort((hashes, np.where(last[at] == hashes, weight[at], 0)))]
    return hashes[: n - (4 * n + 4) // 5 + 1]


def pairs_of(key: np.ndarray, pair: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, place: np.ndarray, reach: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes with different roots that share a key and may be alike; rows come
    sorted by key, pair and n. ``reach``: how far apart in this order at most."""
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
    size = np.diff(np.r_[starts, len(key)])
    last = np.repeat(starts + size, size)
    at = np.flatnonzero(np.repeat(np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts), size))
    left, right, held = [], [], 0
    for gap in range(1, min(reach or len(key), int(size.max(initial=1)) - 1) + 1):
        at = at[at + gap < last[at]]
        at = at[5 * n[at] >= 4 * n[at + gap]]
        if not len(at):
            break
        # at the first shingle that two sets share, both must have enough left
        ok = at[(root[at] != root[at + gap]) & (9 * np.minimum(n[at] - place[at], n[at + gap] - place[at + gap]) >= 4 * (n[at] + n[at + gap]))]
        left.append(np.minimum(node[ok], node[ok + gap]))
        right.append(np.maximum(node[ok], node[ok + gap]))
        held += len(ok)
        if held > 1 << 20:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _pairs(reach: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in simhash.whole_groups(batches, ("key", "pair"), 1 << 16):
            for a, b in pairs_of(*(rows.column(c).to_numpy() for c in ("key", "pair", "node", "root", "n", "place")), reach):
                yield pa.Table.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"]).group_by(["src", "dst"]).aggregate([]).combine_chunks().to_batches()[0]

    return run


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose whole sets are alike."""
    last, x = b"", np.empty(0, np.int64)
    for b in batches:
        ok = []
        for p, q in zip(b.column("a"), b.column("b"), strict=True):
            q = q.as_py()
            if q != last:  # pairs of one node come together
                last, x = q, unpack(q)
            y = unpack(p.as_py())
            ok.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
        yield b.select(["src", "dst"]).filter(pa.array(ok, pa.bool_()))


def prefixes(profile: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    """key, node, n, place: the prefix shingles that texts of several classes have."""
    counts = small_batches(profile.select("words")).mapInArrow(_common, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    common = counts.orderBy(F.desc("n"), "key").limit(COMMON).collect()  # so many rows at most; they set the order only
    common = np.array(sorted((r["key"], r["n"]) for r in common), np.int64).reshape(-1, 2)
    last, weight = common[:, 0].copy(), common[:, 1].copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [unpack(w.as_py()) for w in b.column("words")]
            first = [prefix(s, last, weight) if len(s) else s for s in sets]
            yield pa.record_batch([b.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.list_(pa.int64()))], names=["node", "n", "keys"])

    own = small_batches(profile.select("row", "words")).mapInArrow(run, "node long, n long, keys array<bigint>")
    # both joins by node, so rows move once
    own = own.join(texts.select("node").hint("merge"), "node", "left_semi").join(found.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = stored(own, "prefixes")
    several = own.select("root", F.explode("keys").alias("key")).groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key")
    rows = own.select(F.posexplode("keys").alias("place", "key"), "node", "n").select("key", "node", "n", F.col("place").cast("long").alias("place"))
    # rows of a key that very many texts have are split by the planner
    shared = stored(rows.join(several.hint("merge"), "key"), "shared-prefixes")
    forget(own)
    return shared


def beside(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (key, node, root, n, place) in blocks of their key: neighbours in one may be alike."""
    count = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("all")), "key-counts")
    blocks = F.ceil(F.col("all") / F.lit(block))
    return rows.join(count, "key").withColumn("pair", F.pmod(F.xxhash64("node", "key"), blocks).cast("long"))


def across(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` at all pairs of blocks of their key that hold texts of different classes.

    A key's largest class is never compared with itself: its blocks meet those of
    the other classes, which meet each other too. So a key of one very large class
    and a few other texts costs about its size times the number of their blocks.
    """
    sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    keys = sizes.groupBy("key").agg(F.max(F.struct("size", "root")).alias("most"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    many = F.ceil(F.col("most.size") / F.lit(block)).cast("int")
    rest = F.ceil((F.col("all") - F.col("most.size")) / F.lit(block)).cast("int")
    keys = stored(keys.select("key", F.col("most.root").alias("main"), many.alias("many"), rest.alias("rest")), "key-classes")
    both = rows.join(keys, "key").withColumn("is_main", F.col("root") == F.col("main"))
    mine = F.pmod(F.xxhash64("node", "key"), F.when(F.col("is_main"), F.col("many")).otherwise(F.col("rest"))).cast("long")
    to = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    with_rest = F.transform(to(F.col("rest")), lambda j: F.col("mine") * 0x7FFFFFFF + j)
    with_main = F.transform(to(F.col("many")), lambda i: i * 0x7FFFFFFF + F.col("mine"))
    among = F.transform(to(F.col("rest")), lambda j: -1 - F.least("mine", j) * 0x7FFFFFFF - F.greatest("mine", j))
    out = both.withColumn("mine", mine)
    return out.withColumn("pair", F.explode(F.when(F.col("is_main"), with_rest).otherwise(F.concat(with_main, among))))


PROFILE = "doc_id long, row long, md5 binary, hi long, lo long, fp long, prints array<bigint>, size long, words binary"


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is kept of each text: its words, packed, their digest, and fingerprints."""
    for b in batches:
        n = b.num_rows
        fp, digest, prints, size, packed = np.empty(n, np.uint64), np.empty((n, 2), np.uint64), np.empty((n, PRINTS), np.int64), np.empty(n, np.int64), []
        for k, t in enumerate(b.column("text")):
            words = words_of(t.as_py())
            d = xxhash.xxh3_128_intdigest(b" ".join(words))
            fp[k], digest[k], prints[k] = simhash.fingerprint(t.as_py() or ""), (d >> 64, d & 0xFFFFFFFFFFFFFFFF), word_prints(words)
            size[k] = max(min(1, len(words)), len(words) - SHINGLE + 1)
            packed.append(pack(words))
        lists = pa.ListArray.from_arrays(np.arange(0, (n + 1) * PRINTS, PRINTS, dtype=np.int32), pa.array(prints.ravel()))
        numbers = [pa.array(x.view(np.int64)) for x in (digest[:, 0].copy(), digest[:, 1].copy(), fp)]
        columns = [b.column("doc_id"), b.column("row"), b.column("md5"), *numbers, lists, pa.array(size), pa.array(packed, pa.binary())]
        yield pa.record_batch(columns, names=["doc_id", "row", "md5", "hi", "lo", "fp", "prints", "size", "words"])


def alike(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the near copies within each (root, pair) group of the rows, by their whole sets."""
    root, pair, node = (rows.column(c).to_numpy() for c in ("root", "pair", "node"))
    packed = rows.column("words")
    starts = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (pair[1:] != pair[:-1])])
    src, dst = [], []
    for a, b in zip(starts, np.r_[starts[1:], len(root)], strict=True):
        if b - a < 2:
            continue
        own = [unpack(packed[k].as_py()) for k in range(a, b)]
        _, code = np.unique(np.concatenate(own), return_inverse=True)
        size = np.array([len(s) for s in own])
        which = np.repeat(np.arange(len(own)), size)
        first = np.cumsum(size) - size
        part = np.arange(len(own))  # which texts are known to be connected
        for i in range(len(own) - 1):
            # not yet connected, and of like size
            open_ = (part != part[i]) & (5 * np.minimum(size, size[i]) >= 4 * np.maximum(size, size[i]))
            open_[: i + 1] = False
            if not open_.any():
                continue
            flag = np.zeros(int(code.max(initial=-1)) + 1, bool)
            flag[code[first[i] : first[i] + size[i]]] = True
            shared = np.bincount(which[flag[code]], minlength=len(own))
            for j in np.flatnonzero(open_ & (9 * shared >= 4 * (size + size[i]))).tolist():
                if part[j] != part[i]:
                    src.append(node[a + j])
                    dst.append(node[a + i])
                    part[part == part[j]] = part[i]
    return np.array(src, np.int64), np.array(dst, np.int64)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in simhash.whole_groups(batches, ("root", "pair"), 1 << 10):
        a, b = alike(rows)
        if len(a):
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["src", "dst"])


def digest() -> Column:
    """A text's own digest, null texts like empty ones."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def text_classes(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(node, doc_id, md5) of each distinct sequence of words, by its row with the
    smallest doc_id and then digest; and (node, root) of those that are not the
    root of their class.

    A class joins near copies, and texts whose shingle fingerprints
    (``simhash.fingerprint``) link. Rows with a null doc_id take no part.
    """
    src = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), digest().alias("md5"), F.col("text").cast("string"))
    profile = stored(small_batches(src).mapInArrow(_profiles, PROFILE), "profiles")
    texts = profile.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "md5", "row")).alias("m"), F.first("fp").alias("fp"), F.first("prints").alias("prints"))
    texts = stored(texts.select(F.col("m.row").alias("node"), "m.doc_id", "m.md5", "fp", "prints"), "texts")
    words = profile.select(F.col("row").alias("node"), "size", "words")
    # candidates among distinct texts, and their components
    keyed = texts.select("node", F.posexplode("prints").alias("number", "fp")).select(F.explode(simhash.keys(F.col("fp"), F.col("number"))).alias("key"), "node", "fp")
    near = simhash.components(simhash.links(keyed))
    members = stored(near.union(near.select(F.col("root").alias("node"), "root").distinct()), "members")
    # merge joins at every size: what moves is in proportion to the input
    rooted = stored(words.join(members.hint("merge"), "node"), "candidates")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("size") / F.lit(block * SET_SIZE)))
    size = stored(rooted.groupBy("root").agg(blocks.cast("int").alias("blocks")).where("blocks > 0"), "component-sizes")
    placed = simhash.dealt(rooted.join(size, "root"), ["root"], "node").select("root", "pair", "node", "words")
    verified = placed.repartition("root", "pair").sortWithinPartitions("root", "pair", "node").mapInArrow(_alike, "src long, dst long")
    # texts that the shingle fingerprints link
    prints = simhash.print_roots(stored(texts.groupBy("fp").agg(F.min("node").alias("first")), "distinct-fingerprints"))
    least = stored(prints.groupBy("root").agg(F.min("first").alias("dst")), "first-of-prints")
    by_print = texts.select("fp", "node").join(prints.select("fp", "root"), "fp").join(least, "root").select(F.col("node").alias("src"), "dst")
    found = simhash.components(verified.union(by_print))
    forget(near, members, rooted, size, least)
    # every other pair that is alike shares a shingle of its prefixes: neighbours under a key first, so that
    # dense groups are one class when all pairs of different classes are looked at
    shared = prefixes(profile, texts, found)
    sets = stored(words.join(shared.select("node").distinct().hint("merge"), "node").select("node", "words"), "sets")
    forget(profile)
    for reach, deal in ((1, beside), (None, across)):
        rooted = shared.join(found.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = deal(rooted, block).select("key", "pair", "node", "root", "n", "place")
        pairs = placed.repartition("key", "pair").sortWithinPartitions("key", "pair", "n", "node").mapInArrow(_pairs(reach), "src long, dst long")
        pairs = stored(pairs.distinct(), "pairs")
        both = pairs.join(sets.select(F.col("node").alias("src"), F.col("words").alias("a")), "src").join(sets.select(F.col("node").alias("dst"), F.col("words").alias("b")), "dst")
        before, found = found, simhash.components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")).union(both.mapInArrow(_judged, "src long, dst long")))
        forget(before, pairs)
    forget(shared, sets)
    nodes = texts.select("node", "doc_id", "md5")
    nodes._weftline_path = texts._weftline_path
    return nodes, found


def kept_of(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """root, doc_id, md5: of each class the text with the smallest doc_id, then digest."""
    rooted = nodes.join(found.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rooted.groupBy("root").agg(F.min(F.struct("doc_id", "md5")).alias("kept")).select("root", "kept.doc_id", "kept.md5")


def copies(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(nodes, (node, root)) by doc_id: the smallest doc_id of each distinct text, and
    for those that another doc_id stands for, the smallest of their class."""
    nodes, found = text_classes(docs, block)
    kept = kept_of(nodes, found).select("root", F.col("doc_id").alias("kept"))
    rooted = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")).join(kept, "root")
    return nodes.select(F.col("doc_id").alias("node")), rooted.where("doc_id != kept").select(F.col("doc_id").alias("node"), F.col("kept").alias("root"))


def deduplicated(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of each class of near copies: that with the smallest doc_id.

    Texts that share a doc_id are told apart by their digests. Of rows that
    repeat the kept doc_id and text, any one stays. Rows with a null doc_id
    cannot be told apart; all of them stay.
    """
    nodes, found = text_classes(docs, block)
    keep = stored(kept_of(nodes, found).select(F.col("doc_id").alias("_id"), "md5"), "kept")
    forget(nodes, found)
    # texts move once, at every size
    rows = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("_id"), digest().alias("md5")).where(F.col("_id").isNotNull())
    rows = rows.join(keep.hint("merge"), ["_id", "md5"], "left_semi")
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if ids.limit(1).count():
        rows = rows.dropDuplicates(["_id", "md5"])
    return rows_again(rows, docs).union(docs.where(F.col("doc_id").isNull()))
