import glob
import hashlib
import random
import struct

import pytest
import zstandard

from weftline.llm import common, warc


def rows_of(texts):
    return [(k, f"http://x/{k}", t, 0) for k, t in enumerate(texts)]


BIG = "<p>same</p>" * 200


@pytest.fixture(scope="module")
def pages(spark):
    texts = [BIG, "small", BIG, None, "small", "é" * 500, "é" * 500, "<b>" + "z" * 300_000] + [f"<html>page {k} " + "word " * 300 for k in range(300)] + [BIG]
    rows = rows_of(texts) + [(None, None, BIG, 0), (None, None, "", 0)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3), rows


def test_records_come_back(spark, pages):
    df, rows = pages
    path = common.shared_path(spark, "test-warc")
    warc.write(df, path)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows)
    holder = {}
    for i, _, t, _ in rows:
        raw = (t or "").encode()
        if len(raw) >= 1000 and i is not None:
            holder[raw] = max(holder.get(raw, i), i)
    want = []
    for i, _, t, _ in rows:
        raw = (t or "").encode()
        other = raw in holder and i != holder[raw] and sum((r[2] or "").encode() == raw for r in rows) > 1
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if other else "response", holder[raw] if other else None))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    # the files are plain Zstandard: a skippable dictionary frame, then a frame a record
    for name in glob.glob(f"{path.removeprefix('file://')}/part-*"):
        raw = open(name, "rb").read()
        magic, size = struct.unpack_from("<II", raw)
        assert magic == warc.DICTIONARY_MAGIC
        d = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
        reader = zstandard.ZstdDecompressor(dict_data=d)
        text = reader.stream_reader(raw, read_across_frames=True).read()
        assert text.count(b"WARC/1.1\r\n") == text.count(b"\r\nWARC-Record-ID: ")


def test_damaged_payload_raises():
    frames = list(warc.frames(iter([warc.record(1, "u", b"abc", 3, hashlib.sha1(b"abd").hexdigest(), None)]), b"abcdefgh"))
    with pytest.raises(ValueError):
        [warc.digest_row(*r) for r in warc.records_of(b"".join(frames))]


def test_a_cut_archive_raises():
    raw = b"".join(warc.frames(iter([warc.record(1, "u", b"abc" * 100, 300, hashlib.sha1(b"abc" * 100).hexdigest(), None)]), b"abcdefgh"))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.records_of(raw[:-3]))


def test_empty_table(spark, pages):
    assert warc.archive(pages[0].limit(0)).count() == 0


def test_rows_that_repeat_the_response_revisit_it(spark):
    rows = [(5, "http://b", BIG)] * 3 + [(5, "http://a", BIG)] * 2 + [(4, "http://a", BIG), (6, "http://z", "tiny")] + [(6, "http://z", "tiny")]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to or 0) for r in got if r.page_id < 6) == [(4, "revisit", 5), (5, "response", 0)] + [(5, "revisit", 5)] * 4
    assert [r.record_type for r in got if r.page_id == 6] == ["response"] * 2


def test_the_dictionary_looks_at_records_wherever_they_stand(spark):
    rows = [(k, f"u{k}", f"<p>{'first' if k < 500 else 'second'} kind of page {k}</p>" * 9) for k in range(1000)]
    d = warc.dictionary_of(warc.routed(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)))
    assert b"first kind" in d and b"second kind" in d


def test_archives_roll_over(spark, tmp_path):
    """By frames and by bytes: every archive starts with the dictionary and can be read alone."""
    rng = random.Random(3)
    rows = [(k, f"u{k}", "".join(rng.choice("abcdefghij<> ") for _ in range(rng.choice([0, 40, 3000])))) for k in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for k, (most, size) in enumerate([(50, 1 << 26), (4096, 20_000), (7, 5_000), (2, 1)]):
        path = str(tmp_path / str(k))
        warc.write(df, path, most, size)
        files = [f.read_bytes() for f in (tmp_path / str(k)).glob("part-*")]
        assert len(files) > 5 and all(f[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little") for f in files if f)
        # the dictionary, the records up to the one that passes the size, and the empty frames
        assert max(map(len, files)) < warc.DICTIONARY_BYTES + size + 5_000 + 16 * most
        got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.read(spark, path).collect()}
        assert got == {p: (len(t), hashlib.sha1(t.encode()).hexdigest()) for p, _, t in rows}
