"""Sharding and mixing."""

import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from weftline.llm import mixing, sharding


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_shards_are_even_in_bytes_and_positions_gapless(spark, docs):
    rows = sharding.shard(docs, 40).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    load, places = defaultdict(int), defaultdict(list)
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert set(load) == set(range(40)) and len(rows) == len(text)
    mean = sum(load.values()) / 40
    assert max(load.values()) <= max(1.02 * mean, mean + 200) and min(load.values()) >= 0.98 * mean - 200
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_rebalancing_edits_the_map_and_moves_little(spark):
    first = sharding.first_map(spark, 4, 400)
    grown = spark.createDataFrame([(s, 200 if s % 4 == 0 else 100, 1) for s in range(400)], "virtual_slot int, bytes long, n long")
    second = sharding.rebalance(first, grown, 4)
    rows = second.collect()
    assert len(rows) == 400
    load = defaultdict(int)
    for r in rows:
        load[r.shard] += 200 if r.virtual_slot % 4 == 0 else 100
    assert max(load.values()) - min(load.values()) <= 200
    moved = [r for r in rows if r.moved_from is not None]
    assert moved and all(r.moved_from == 0 for r in moved) and len(moved) < 50
    # another shard is filled from the others only; a shard that is gone is emptied
    third = sharding.rebalance(second, grown, 5).collect()
    assert all(r.shard == 4 for r in third if r.moved_from is not None)
    assert {r.shard for r in sharding.rebalance(second, grown, 3).collect()} == {0, 1, 2}


def test_the_map_is_whole_and_later_runs_go_on_from_it(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    one = {(r.doc_id, r.shard) for r in sharding.shard(docs, 40, path=path).collect()}
    assert sharding.versions(spark, path) == [0, 1]
    for v in (0, 1):
        assert sorted(r.virtual_slot for r in sharding.load_map(spark, path, v).collect()) == list(range(sharding.SLOTS))
    assert {r.shard for r in sharding.load_map(spark, path, 0).collect()} == set(range(40))
    two = sharding.shard(docs, 41, path=path).collect()
    assert sharding.versions(spark, path) == [0, 1, 2] and {r.map_version for r in two} == {2}
    gone = {(r.doc_id, r.shard) for r in two}
    assert len(gone - one) < 0.25 * len(gone) and 40 in {r.shard for r in two}


def test_the_law_holds_with_repeated_rows(spark):
    rows = [(1, "x" * 1000)] * 3000 + [(k, f"text {k}") for k in range(2, 40)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    load, places = defaultdict(int), defaultdict(list)
    for r in out:
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    mean = sum(load.values()) / 40
    assert len(out) == len(rows) and len(load) == 40 and max(load.values()) <= mean + 16 * 1016 and min(load.values()) >= mean - 16 * 1016
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def plain_slot(doc_id, crc, run):
    """The virtual slot, by the hash of one number after the other."""
    h = 42
    for x in (doc_id, crc, run):
        if x is not None:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), h)
    return (h - (1 << 64) if h >> 63 else h) % sharding.SLOTS


def test_placement_equals_the_plain_version(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, None), (None, None), (5, None)] + [(7, "same")] * 40
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    count, size = Counter(rows), {}
    load, n = Counter(), Counter()
    for (d, t), many in count.items():
        raw = (t or "").encode()
        for k in range(many):
            s = plain_slot(d, zlib.crc32(raw), k // sharding.RUN)
            load[s] += len(raw) + 16
            n[s] += 1
            size[d, zlib.crc32(raw), k] = s
    # the slots' shards: round robin, then only what does not fit moves, largest first, to the least shard
    shard = {s: s % 40 for s in range(sharding.SLOTS)}
    mean, full, spare = sum(load.values()) / 40, [0] * 40, []
    for k in range(40):
        upto = 0
        for s in sorted((s for s in shard if shard[s] == k), key=lambda s: (-load[s], s)):
            upto += load[s]
            if upto <= mean:
                full[k] += load[s]
            else:
                spare.append((-load[s], s))
    for b, s in sorted(spare):
        to = min(range(40), key=lambda k: (full[k], k))
        shard[s], full[to] = to, full[to] - b
    want = Counter((d, c, s, shard[s]) for (d, c, _), s in size.items())
    assert Counter((r.doc_id, r.text_crc32, r.virtual_slot, r.shard) for r in got) == want
    order = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        order[r.shard].append((r.virtual_slot, r.doc_id is not None, r.doc_id or 0, r.text_crc32))
    assert all(x == sorted(x) for x in order.values())


def test_shards_of_odd_tables(spark):
    rows = [(None, "a", 1), (None, None, 1), (1, "", 1), (1, "", 1), (2, "x" * 100_000, 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = sharding.shard(odd, 3).collect()
    assert len(out) == 5 and sorted(r["size"] for r in out)[:2] == [16, 16]
    assert sharding.shard(odd.limit(0), 3).count() == 0


def plain_targets(size, weight):
    left, out, total = set(size), {}, float(sum(size.values()))
    while True:
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * size[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * size[s]
            total -= out[s]
            left.remove(s)


def test_mix_meets_targets(spark, docs):
    rows = mixing.mix(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        s = source[r.doc_id]
        size[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    names = sorted(size)
    want = plain_targets(size, {s: k % 3 + 1 for k, s in enumerate(names)})
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(mixing.mix(docs.repartition(7)).collect())]


def test_mix_caps_small_sources_and_takes_odd_rows(spark):
    rows = [(k, "a b c " * 50, "big") for k in range(300)] + [(1000 + k, "w", s) for k, s in enumerate(["tiny", None, "tiny"])] + [(7, None, "void"), (None, "x y", "big"), (None, "x y", "big")]
    odd = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, source string, h string")
    out = mixing.mix(odd).collect()
    assert len(out) == len(rows)
    size, weight = {"big": 300 * 150 + 4, "tiny": 2, "void": 0, None: 1}, {"big": 1, "tiny": 2, "void": 3, None: 1}
    want = plain_targets({k: v for k, v in size.items()}, weight)
    assert {r.target for r in out if r.source_size == 2} == {want["tiny"]} == {6.0}
    assert sum(r.taken for r in out if r.source_size == 2) == 6
    assert mixing.mix(odd.limit(0)).count() == 0
    mixed = mixing.mixed_rows(odd)
    assert mixed.columns == odd.columns and mixed.where("source = 'tiny'").count() == 6
    assert mixed.where("source = 'void'").count() == 1
