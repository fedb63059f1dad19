"""SentencePiece encoding by sampling, and lossless decoding.

A text's segmentations into vocabulary pieces form a lattice. Forward filtering
sums the weights of all paths to each place; backward sampling draws a path from
the end, each piece with its exact probability given what follows. The draws are
a hash of the row's key, the place in the text and a seed, so a row is segmented
alike on every run, whatever the partitions.

A piece weighs (rank + 2) ** -alpha by its rank among the vocabulary's learned
pieces. No learned piece has a space after another character, so the lattice
falls apart before each run of spaces, and filters are kept by word. Long words,
as of scripts without spaces, are cut where no piece goes over a place, which
changes no path's probability. Characters
without a piece of their own, line ends and literal U+2581 are spelled in byte
pieces. A space is put before every text that is not empty and taken off again,
as the vocabulary expects words to start with one.

Defined results: null and empty texts have no pieces and decode to the empty
text; a null doc_id counts as key 0; repeated rows get equal pieces; a text of
any length is taken whole; an empty table gives an empty result; extra columns
are carried along by ``encode``, but for one named like its result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_or_empty

#: Where the public vocabularies lie; every function takes another path.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED = 1.0, 42
SPACE = "▁"
#: Stands for a literal U+2581; no text has this code point.
LITERAL = 0x110000
#: Filtered places that a worker keeps at most.
KEPT = 500_000
#: Words that are sampled at a time, and new ones that are filtered at a time.
BATCH, FRESH = 1 << 17, 1 << 13
#: Longer chunks are cut where no piece goes over a place; characters that a part of one has at least.
LONG, PART = 64, 16  # LONG fits 16 bits
#: So few words are drawn one by one.
ALONE, ALL = 3, (1 << 64) - 1
#: Probabilities as whole numbers.
ONE = 1 << 53
GOLDEN, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def drawn_at(state: np.ndarray, step: int) -> np.ndarray:
    """A whole number below ONE for each state at a step."""
    return (mixed(state + np.uint64((step + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.int64)


class Vocabulary:
    """Pieces, their weights and their bytes, from a SentencePiece model's bytes."""

    def __init__(self, model: bytes, alpha: float = ALPHA):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.learned: dict[str, tuple[int, float]] = {}
        for i in range(m.vocab_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            elif m.is_unknown(i) or m.is_control(i) or m.is_unused(i):
                self.bytes.append(b"")
            else:
                self.learned[piece] = i, -alpha * math.log(len(self.learned) + 2)
                self.bytes.append(piece.replace(SPACE, " ").encode())
        if any(SPACE in p.lstrip(SPACE) for p in self.learned):
            raise ValueError("a piece goes over a word's start")
        self.longest = max(map(len, self.learned))
        #: Weight of a character spelled in bytes.
        self.spelled = -alpha * math.log(len(self.learned) + 2)

    def spell(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")]


#: A literal U+2581, a line end, or a run of spaces with the word after it.
CHUNK = re.compile(f"[{SPACE}\n]| *[^ {SPACE}\n]+| +")


def codes(text: str) -> np.ndarray:
    """A text's characters as the trie counts them: blanks as in pieces, a literal U+2581 as no piece's."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    code[code == ord(SPACE)] = LITERAL
    code[code == ord(" ")] = ord(SPACE)
    return code


class Trie:
    """The learned pieces as a trie whose edges lie in a hash table, for many walks at once."""

    BITS = 20

    def __init__(self, v: Vocabulary):
        chars = sorted({c for p in v.learned for c in p})
        self.of = np.zeros(LITERAL + 1, np.int64)  # a character's number; 0: in no piece
        self.of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        number = {c: k + 1 for k, c in enumerate(chars)}
        child: dict[int, int] = {}
        piece, weight = [-1], [0.0]
        for p, (i, w) in v.learned.items():
            node = 0
            for c in p:
                key = node * self.width + number[c]
                if key not in child:
                    child[key] = len(piece)
                    piece.append(-1)
                    weight.append(0.0)
                node = child[key]
            piece[node], weight[node] = i, math.exp(w)
        self.piece, self.weight = np.array(piece, np.int32), np.array(weight)
        # linear probing; a walk probes at most as far as the longest run
        keys, to = np.fromiter(child, np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child))
        size = 1 << self.BITS
        self.keys, self.to = np.full(size + 64, -1, np.int64), np.full(size + 64, -1, np.int64)
        slot, left, self.probes = self.slot(keys), np.arange(len(keys)), 0
        while len(left):
            free = self.keys[slot[left]] < 0
            _, first = np.unique(slot[left], return_index=True)
            won = np.zeros(len(left), bool)
            won[first] = True
            won &= free
            self.keys[slot[left[won]]], self.to[slot[left[won]]] = keys[left[won]], to[left[won]]
            left = left[~won]
            slot[left] += 1
            self.probes += 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * GOLDEN >> np.uint64(64 - self.BITS)).astype(np.int64)

    def step(self, node: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The child of each node, -1 where there is none."""
        key = node * self.width + number
        slot = self.slot(key)
        out = np.where(self.keys[slot] == key, self.to[slot], -1)
        miss = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] >= 0))
        for k in range(1, self.probes):
            if not len(miss):
                break
            there = self.keys[slot[miss] + k]
            hit = there == key[miss]
            out[miss[hit]] = self.to[slot[miss[hit]] + k]
            miss = miss[~hit & (there >= 0)]
        return out


def shares_of(many: list[int], before: list[int], weight: list[float]) -> list[float]:
    """The probability of each way into the places of one word, by sums of all paths.

    ``many`` ways lead into each place; they start after place ``before``, -1
    for the word's start. Sums are kept with a power of two, so long words do
    not vanish.
    """
    total, power, out, at = [], [], [], 0
    for n in many:
        ways = range(at, at + n)
        top = max([power[before[j]] if before[j] >= 0 else 0 for j in ways])
        values = [math.ldexp(total[b] * weight[j], max(power[b] - top, -1000)) if (b := before[j]) >= 0 else math.ldexp(weight[j], max(-top, -1000)) for j in ways]
        whole = sum(values)
        out += [x / whole for x in values]
        mantissa, shift = math.frexp(whole)
        total.append(mantissa)
        power.append(top + shift)
        at += n
    return out


class Sampler:
    """Keeps the filtered lattices of words and draws paths for many at once.

    A place is the end of a character of a kept word. The ways into it lie
    together, those of the longest pieces first; ``upto`` is the summed
    probability of the place's ways up to each, in parts of ONE. It follows from
    the word alone, whatever else a worker has met.
    """

    def __init__(self, v: Vocabulary):
        self.v, self.trie = v, Trie(v)
        self.clear()

    def clear(self) -> None:
        self.last: dict[str, int] = {}  # a chunk's last place
        self.upto, self.piece, self.back = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)
        self.first = np.empty(0, np.int64)  # a place's first way
        self.places = self.ways = 0  # how much of the arrays is filled
        self.spelled: list[list[int]] = []
        self.spelled_at: dict[int, int] = {}

    def put(self, name: str, at: int, more: np.ndarray) -> None:
        """Fill an array on from a place; it doubles when it is full."""
        have = getattr(self, name)
        if len(have) < at + len(more):
            wide = np.empty(max(at + len(more), 2 * len(have)), have.dtype)
            wide[:at] = have[:at]
            setattr(self, name, wide)
            have = wide
        have[at : at + len(more)] = more

    def split(self, chunk: str) -> list[str]:
        """A long chunk in parts, cut wherever no piece goes over the place: its lattice falls apart there."""
        out = []
        code = codes(chunk)
        number, size = self.trie.of[code], len(code)
        far = np.arange(1, size + 1)  # the farthest end of a piece from each place
        at, node = np.arange(size), np.zeros(size, np.int64)
        for k in range(self.v.longest):
            node = self.trie.step(node, number[at + k])
            ok = np.flatnonzero(node >= 0)
            at, node = at[ok], node[ok]
            hit = at[self.trie.piece[node] >= 0]
            far[hit] = np.maximum(far[hit], hit + k + 1)
            ok = np.flatnonzero(at + k + 1 < size)
            at, node = at[ok], node[ok]
            if not len(at):
                break
        ends = np.flatnonzero(np.maximum.accumulate(far) == np.arange(1, size + 1)) + 1
        begin = 0
        for end in ends.tolist():
            if end - begin >= PART or end == size:
                out.append(chunk[begin:end])
                begin = end
        return out

    def keep(self, chunks: list[str]) -> None:
        """Filter the lattices of new chunks forward, all at once."""
        code = codes("".join(chunks))
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(size)
        starts = ends - size
        number, limit, origin = self.trie.of[code], np.repeat(ends, size), np.repeat(starts, size)
        # walks from every character; no two hits of one step end at the same place
        hits = []
        at, node = np.arange(len(code)), np.zeros(len(code), np.int64)
        bare = np.ones(len(code), bool)
        for k in range(self.v.longest):
            node = self.trie.step(node, number[at + k] if k else number)
            ok = np.flatnonzero(node >= 0)
            at, node = at[ok], node[ok]
            ok = np.flatnonzero(self.trie.piece[node] >= 0)
            hits.append((at[ok], k, self.trie.piece[node[ok]], self.trie.weight[node[ok]]))
            if not k:
                bare[at[ok]] = False
            ok = np.flatnonzero(at + (k + 1) < limit[at])
            at, node = at[ok], node[ok]
            if not len(at):
                break
        bare = np.flatnonzero(bare)
        for c in np.unique(code[bare]).tolist():
            if c not in self.spelled_at:
                self.spelled_at[c] = len(self.spelled)
                self.spelled.append(self.v.spell(SPACE if c == LITERAL else chr(c)))
        hits.insert(0, (bare, 0, np.array([-1 - self.spelled_at[c] for c in code[bare].tolist()], np.int32), math.exp(self.v.spelled)))
        many = np.zeros(len(code), np.int64)
        for src, k, _, _ in hits:
            many[src + k] += 1
        first = np.cumsum(many) - many
        free, total_ways = first.copy(), int(many.sum())
        src, what, weight = np.empty(total_ways, np.int64), np.empty(total_ways, np.int32), np.empty(total_ways)
        for s, k, piece, w in reversed(hits):  # the longest first
            slot = free[s + k]
            free[s + k] += 1
            src[slot], what[slot], weight[slot] = s, piece, w
        # sums of all paths, by place in the word; each is kept with a power of two, so long words do not vanish
        total, power = np.ones(len(code) + 1), np.zeros(len(code) + 1, np.int64)
        whole = src == origin[src]
        before = np.where(whole, len(code), src - 1)
        share = np.empty(len(src))
        # words side by side, place by place; long ones by themselves
        rank, long = np.arange(len(code)) - origin, size > LONG
        short = np.flatnonzero(~np.repeat(long, size)) if long.any() else np.arange(len(code))
        by_rank = rank[short].astype(np.uint16)  # few bits sort fast
        cut = np.r_[0, np.cumsum(np.bincount(by_rank))] if len(short) else np.zeros(1, np.int64)
        by_rank = short[np.argsort(by_rank, kind="stable")]
        for k in range(len(cut) - 1):
            place = by_rank[cut[k] : cut[k + 1]]
            n = many[place]
            head = np.cumsum(n) - n
            way = np.repeat(first[place] - head, n) + np.arange(int(n.sum()))
            p = power[before[way]]
            top = np.maximum.reduceat(p, head)
            value = np.ldexp(total[before[way]] * weight[way], np.maximum(p - np.repeat(top, n), -1000))
            sums = np.add.reduceat(value, head)
            share[way] = value / np.repeat(sums, n)
            total[place], shift = np.frexp(sums)
            power[place] = top + shift
        for c in np.flatnonzero(long).tolist():
            ways = slice(int(first[starts[c]]), int(first[ends[c] - 1] + many[ends[c] - 1]))
            local = np.where(whole[ways], -1, before[ways] - starts[c])
            share[ways] = shares_of(many[starts[c] : ends[c]].tolist(), local.tolist(), weight[ways].tolist())
        # summed from each place's first way on, whatever lies around it
        upto, reached, on = np.empty(len(share), np.int64), np.zeros(len(code)), np.arange(len(code))
        for k in range(int(many.max())):
            on = on[many[on] > k]
            reached[on] += share[first[on] + k]
            upto[first[on] + k] = np.minimum(np.rint(reached[on] * ONE).astype(np.int64), ONE)
        upto[first + many - 1] = ONE
        place0, way0 = self.places, self.ways
        for name, more in (("upto", upto), ("piece", what), ("back", np.where(whole, -1, src - 1 + place0))):
            self.put(name, way0, more)
        self.put("first", place0, first + way0)
        self.places, self.ways = place0 + len(first), way0 + len(upto)
        self.last.update(zip(chunks, (ends - 1 + place0).tolist(), strict=True))

    def walk(self, at: int, state: int, step: int) -> list[int]:
        """The pieces that ``sample`` draws from a place on, last first."""
        out, first, upto, piece, back = [], self.first.item, self.upto.item, self.piece.item, self.back.item
        while at >= 0:
            x = (state + (step + 1) * int(GOLDEN)) & ALL
            x = (x ^ x >> 30) * int(MIX_A) & ALL
            x = (x ^ x >> 27) * int(MIX_B) & ALL
            x = (x ^ x >> 31) >> 11
            way = first(at)
            while upto(way) <= x:
                way += 1
            out.append(piece(way))
            at, step = back(way), step + 1
        return out

    def sample(self, chunks: list[str], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids drawn for chunks with their random states, and each chunk's count."""
        if not chunks:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        at = np.fromiter(map(self.last.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = list({chunks[k] for k in missing})
            for k in range(0, len(new), FRESH):
                self.keep(new[k : k + FRESH])
            at[missing] = [self.last[chunks[k]] for k in missing]
        drawn, alive, step = [], np.arange(len(chunks)), 0
        count = np.zeros(len(chunks), np.int64)
        while len(alive) > ALONE:
            x = drawn_at(state, step)
            way = self.first[at]
            todo = np.flatnonzero(self.upto[way] <= x)
            while len(todo):
                way[todo] += 1
                todo = todo[self.upto[way[todo]] <= x[todo]]
            drawn.append((alive, self.piece[way]))
            count[alive] = step + 1
            at = self.back[way]
            more = at >= 0
            alive, at, state, step = alive[more], at[more], state[more], step + 1
        if len(alive):  # the longest few, one by one: the same draws
            rest = [self.walk(int(a), int(r), step) for a, r in zip(at, state, strict=True)]
            count[alive] = step + np.fromiter(map(len, rest), np.int64, len(rest))
            for k in range(max(map(len, rest))):
                on = [j for j, r in enumerate(rest) if k < len(r)]
                drawn.append((alive[on], np.array([rest[j][k] for j in on], np.int32)))
        # the last piece of a chunk was drawn first
        ends = np.cumsum(count)
        ids = np.empty(int(ends[-1]), np.int32)
        for step, (which, what) in enumerate(drawn):
            ids[ends[which] - 1 - step] = what
        odd = ids < 0
        if odd.any():
            long = np.array([len(x) for x in self.spelled], np.int64)
            flat = np.array([i for x in self.spelled for i in x], np.int32)
            begin = np.cumsum(long) - long
            wide = np.ones(len(ids), np.int64)
            wide[odd] = long[-1 - ids[odd]]
            out = np.repeat(ids, wide)
            inside = np.arange(len(out)) - np.repeat(np.cumsum(wide) - wide, wide)
            hit = out < 0
            out[hit] = flat[begin[-1 - out[hit]] + inside[hit]]
            count = np.add.reduceat(wide, ends - count)
            ids = out
        return ids, count


def states(key: int, chunks: int, seed: int = SEED) -> np.ndarray:
    """Random states of a row's chunks."""
    base = mixed(np.array([(key + seed * int(GOLDEN)) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]
    return mixed(base + np.arange(chunks, dtype=np.uint64) * GOLDEN)


def chunked(sampler: Sampler, text: str) -> list[str]:
    """The parts of a text, with the blank before it, over whose places no piece goes."""
    own = CHUNK.findall(" " + text)
    if max(map(len, own)) <= LONG:
        return own
    return [part for c in own for part in (sampler.split(c) if len(c) > LONG else (c,))]


def segment(sampler: Sampler, keys: Iterable[int | None], texts: Iterable[str | None], seed: int = SEED) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of each text in order."""
    rows: list[int] = []
    chunks: list[str] = []
    sizes: list[int] = []
    rand: list[np.ndarray] = []

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        # a text longer than a batch goes through in parts; its lists of ids are joined at the end
        parts, state = [], np.concatenate(rand)
        for k in range(0, len(chunks), BATCH):
            parts.append(sampler.sample(chunks[k : k + BATCH], state[k : k + BATCH]))
            if sampler.places > KEPT:
                sampler.clear()
        ids = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int32)
        count = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
        upto = np.r_[0, np.cumsum(count)]
        at = 0
        for row, n in zip(rows, sizes, strict=True):
            yield row, ids[upto[at] : upto[at + n]]
            at += n

    for row, (key, text) in enumerate(zip(keys, texts, strict=True)):
        own = chunked(sampler, text) if text else []
        rows.append(row)
        sizes.append(len(own))
        chunks += own
        rand.append(states(key or 0, len(own), seed))
        if len(chunks) >= BATCH:
            yield from flush()
            rows, chunks, sizes, rand = [], [], [], []
    if rows:
        yield from flush()


_vocabularies: dict[tuple[int, float], Vocabulary] = {}


def vocabulary_of(model: bytes, alpha: float) -> Vocabulary:
    """A worker keeps its last vocabulary."""
    key = hash(model), alpha
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(model, alpha)
    return _vocabularies[key]


_samplers: dict[tuple[int, float], Sampler] = {}


def sampler_of(model: bytes, alpha: float) -> Sampler:
    """A worker keeps its last sampler."""
    key = hash(model), alpha
    if key not in _samplers:
        _samplers.clear()
        _samplers[key] = Sampler(vocabulary_of(model, alpha))
    return _samplers[key]


def model_bytes(path: str = MODEL) -> bytes:
    """The vocabulary file, read on the driver; its half megabyte travels with the task."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str = MODEL, alpha: float = ALPHA, seed: int = SEED, text: bool = True, out: str = "ids") -> DataFrame:
    """``docs`` with ``out``, the sampled pieces of each row's text; without the text if ``text`` is false.

    A column of ``docs`` that is named like ``out`` gives way to it.
    """
    model = model_bytes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler_of(model, alpha)
        for b in batches:
            done, size = 0, 0
            held: list[np.ndarray] = []

            def part(held: list[np.ndarray], done: int) -> pa.RecordBatch:
                offsets = np.r_[0, np.cumsum([len(x) for x in held])].astype(np.int32)
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(held)))
                return pa.record_batch([b.column("_row").slice(done, len(held)), ids], names=["_row", "_ids"])

            for _, ids in segment(s, b.column("_key").to_pylist(), (t.as_py() for t in b.column("_text")), seed):
                held.append(ids)
                size += len(ids)
                if size >= 1 << 20:
                    yield part(held, done)
                    done, held, size = done + len(held), [], 0
            if held:
                yield part(held, done)

    names = [c for c in docs.columns if c != out and (text or c != "text")]
    row = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))  # never empty
    src = docs.select(row.alias("_row"), F.col("text").cast("string").alias("_text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_key"))
    schema = T.StructType([src.schema["_row"], T.StructField("_ids", T.ArrayType(T.IntegerType()))])
    coded = small_batches(src).mapInArrow(run, schema)
    return coded.select(*(F.col(f"_row.c{k}").alias(c) for k, c in enumerate(names)), F.col("_ids").alias(out))


def decode(encoded: DataFrame, path: str = MODEL, out: str = "decoded") -> DataFrame:
    """``encoded`` with column ``out``: the text that its ``ids`` spell."""
    model = model_bytes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary_of(model, ALPHA).bytes.__getitem__
        for b in batches:
            texts = []
            for ids in b.column("ids"):
                raw = b"".join(map(table, ids.values.to_numpy(zero_copy_only=False).tolist())) if ids.is_valid else b""
                texts.append(raw[1:].decode("utf-8", "surrogatepass"))
            yield pa.record_batch([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])
    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, ids, text_sha256 of the decoded text, and whether it equals the text."""
    src = docs.select("doc_id", text_or_empty().alias("text")).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    # the text goes no further than the encoder; only its digest does
    both = decode(encode(src, path, alpha, seed, text=False), path).withColumn("text_sha256", F.sha2(F.col("decoded").cast("binary"), 256))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "text_sha256", (F.col("text_sha256") == F.col("sha")).alias("lossless"))
