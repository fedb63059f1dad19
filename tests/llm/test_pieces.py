import math
from collections import Counter

import numpy as np
import pytest

from weftline.llm import pieces


@pytest.fixture(scope="module")
def sampler():
    return pieces.Sampler(pieces.Vocabulary(pieces.model_bytes()))


def spelled(sampler, ids):
    return b"".join(sampler.v.bytes[i] for i in ids).decode("utf-8", "surrogatepass")


def edges(v, chunk):
    """For each place of a chunk's lattice, the (start, piece or spelled character, weight) that end there."""
    if chunk == pieces.SPACE or chunk == "\n":
        return [[], [(0, chunk, v.spelled)]]
    word = chunk.replace(" ", pieces.SPACE)
    out = [[] for _ in range(len(word) + 1)]
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - v.longest), end):
            if hit := v.learned.get(word[start:end]):
                out[end].append((start, *hit))
        if word[end - 1] not in v.learned:
            out[end].append((end - 1, chunk[end - 1], v.spelled))
    return out


def forward(lattice):
    """Log of the summed weight of all paths to each place."""
    sums = [0.0]
    for end in lattice[1:]:
        ways = [sums[start] + w for start, _, w in end]
        top = max(ways)
        sums.append(top + math.log(sum(math.exp(x - top) for x in ways)))
    return sums


TEXTS = ["", " ", "  a\n\n▁b ▁▁ x", "\x00é😀 𝔘", " lead", "x" * 5000, "The quick brown fox.", "▁", "\n", "a  b   c ", "日本語 テスト", "\t\r\n mixed\tblank"]


@pytest.mark.parametrize("text", TEXTS)
def test_decoding_is_lossless(sampler, text):
    for _, ids in pieces.segment(sampler, [5], [text]):
        assert spelled(sampler, ids)[1:] == text


def test_filters_equal_the_plain_version(sampler):
    for chunk in [" inging", " the", "   word", "é!?x9", " internationalization"]:
        lattice = edges(sampler.v, chunk)
        sums = forward(lattice)
        sampler.clear()
        sampler.keep([chunk])
        last = sampler.last[chunk]
        for end in range(1, len(lattice)):
            place = last - (len(lattice) - 1 - end)
            first = sampler.first[place]
            ways = sorted(lattice[end], key=lambda e: e[0])
            upto = np.cumsum([math.exp(sums[s] + w - sums[end]) for s, _, w in ways])
            assert np.allclose(sampler.upto[first : first + len(ways)] / pieces.ONE, upto, atol=1e-9)


def test_draws_follow_the_lattice(sampler):
    chunk, n = " inging", 40000
    ids, count = sampler.sample([chunk] * n, pieces.mixed(np.arange(n, dtype=np.uint64)))
    ends = np.cumsum(count)
    seen = Counter(tuple(ids[e - c : e].tolist()) for e, c in zip(ends, count))
    lattice = edges(sampler.v, chunk)
    total = forward(lattice)[-1]

    def paths(end):
        if not end:
            yield (), 0.0
        for start, piece, w in lattice[end] if end else ():
            for head, weight in paths(start):
                yield (*head, piece), weight + w

    for path, weight in paths(len(chunk)):
        assert abs(math.exp(weight - total) - seen[path] / n) < 0.012


def test_rows_do_not_depend_on_their_neighbours(sampler):
    texts = ["one two three " * 50, "four five " * 80, "six"]
    whole = [ids.tolist() for _, ids in pieces.segment(sampler, [1, 2, 3], texts)]
    sampler.clear()
    alone = [next(pieces.segment(sampler, [k], [t]))[1].tolist() for k, t in reversed(list(zip([1, 2, 3], texts)))][::-1]
    assert whole == alone
    other = [ids.tolist() for _, ids in pieces.segment(sampler, [9, 2, 3], texts)]
    assert other[0] != whole[0] and other[1:] == whole[1:]


def test_query_over_odd_rows(spark):
    rows = [(1, t, "x") for t in TEXTS] + [(None, None, "x"), (2, "same", "x"), (2, "same", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.round_trip(docs.select("doc_id", "text")).collect()
    assert len(out) == len(rows) and all(r.lossless for r in out)
    assert len({tuple(r.ids) for r in out if r.doc_id == 2}) == 1
    kept = pieces.encode(docs)
    assert kept.columns == ["doc_id", "text", "ids"]
    other = pieces.encode(docs, out="_key")
    assert other.columns == ["doc_id", "text", "ids", "_key"] and {r.ids for r in other.collect()} == {"x"}
    back = pieces.decode(kept).collect()
    assert sorted(r.decoded for r in back) == sorted(t or "" for _, t, _ in rows)
    assert pieces.round_trip(docs.select("doc_id", "text").limit(0)).count() == 0


def test_long_words_fall_apart_only_where_no_piece_goes_over(sampler):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("ABCDEFabcdef0123456789+/"), 3000))
    for word in (base, "日本語のテキスト" * 300, "internationalization" * 90):
        parts = sampler.split(word)
        assert "".join(parts) == word and (len(parts) > 3 or word.startswith("inter"))  # pieces go over all of that one
        lattice = edges(sampler.v, word)
        cuts = set(np.cumsum([len(p) for p in parts])[:-1].tolist())
        assert not any(start < cut < end for end, ways in enumerate(lattice) for start, _, _ in ways for cut in cuts if start < cut < end)
        # so the sums over all paths are those of the parts
        whole = forward(lattice)[-1]
        assert abs(sum(forward(edges(sampler.v, p))[-1] for p in parts) - whole) < 1e-6 * abs(whole)
        for _, ids in pieces.segment(sampler, [1], [word]):
            assert spelled(sampler, ids)[1:] == word


def test_few_words_are_drawn_as_many_are(sampler, monkeypatch):
    words = [" internationalization" * k for k in (1, 2, 5, 9)] + ["=" * 500, "ab" * 200]
    state = pieces.states(7, len(words))
    got = [x.tolist() for x in sampler.sample(words, state)]
    monkeypatch.setattr(pieces, "ALONE", 0)
    assert [x.tolist() for x in sampler.sample(words, state)] == got


def test_long_words_are_filtered_as_short_ones_are(sampler, monkeypatch):
    word = " internationalization" + "=-" * 40
    sampler.clear()
    sampler.keep([word])
    alone = sampler.upto
    monkeypatch.setattr(pieces, "LONG", 10_000)
    sampler.clear()
    sampler.keep([word])
    assert np.allclose(sampler.upto / pieces.ONE, alone / pieces.ONE, atol=1e-9)
    sampler.clear()


def unmixed(x):
    """The state from which SplitMix64's finaliser makes ``x``."""
    mask, undo = pieces.ALL, lambda y, k: y ^ (y >> k) ^ (y >> 2 * k)
    x = undo(x, 31) if 3 * 31 > 64 else x
    x = x * pow(int(pieces.MIX_B), -1, 1 << 64) & mask
    x = undo(x, 27)
    x = x * pow(int(pieces.MIX_A), -1, 1 << 64) & mask
    return undo(x, 30)


def test_thresholds_do_not_depend_on_the_words_before(sampler):
    """A word has the same thresholds, to the last bit, in a fresh worker and in one that holds hundreds of thousands of places."""
    words = [" internationalization", " the", " inging", "é!?x9", " unbelievably"]

    def thresholds():
        out = []
        for w in words:
            last = sampler.last[w]
            ways = slice(int(sampler.first[last - len(w) + 1]), int(sampler.first[last + 1]) if last + 1 < sampler.places else sampler.ways)
            out.append((sampler.upto[ways].tolist(), sampler.piece[ways].tolist()))
        return out

    sampler.clear()
    sampler.keep(words)
    alone = thresholds()
    # draws that fall on a threshold, and one below it
    last = sampler.last[" inging"]
    edge = int(sampler.upto[sampler.first[last]])
    states = np.array([(unmixed((t << 11) & pieces.ALL) - int(pieces.GOLDEN)) & pieces.ALL for t in (edge - 1, edge)], np.uint64)
    assert pieces.drawn_at(states, 0).tolist() == [edge - 1, edge]
    drawn = [x.tolist() for x in sampler.sample([" inging"] * 2, states)]
    rng = np.random.default_rng(5)
    sampler.clear()
    while sampler.places < 390_000:
        sampler.keep([" " + "".join(rng.choice(list("aeioustrnl"), rng.integers(3, 12))) + str(k) for k in range(pieces.FRESH)])
    sampler.keep(words)
    assert thresholds() == alone
    assert [x.tolist() for x in sampler.sample([" inging"] * 2, states)] == drawn
    assert sampler.piece[sampler.first[sampler.last[" inging"]]] in drawn[0]
    sampler.clear()
