"""Byte-level BPE: cut texts give the library's own ids, ids give the bytes back."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftline.llm import bytepairs

PATH = public_tokenizers.path(bytepairs.RANKS)
SCRAPS = ["a", "B", "z", "é", "你", "1", "9", "²", " ", "  ", "\n", "\t", "\xa0", " ", "'", "'s", "'re", "'LL", "!", "..", "_", "-", "é", "😀", "don't", " 's", "​", "\x00", "<|endoftext|>", "ß", "٣", "Ⅷ"]


@pytest.fixture(scope="module")
def own():
    return bytepairs.Encoder(PATH)


def test_blocks_give_the_ids_of_the_whole(own):
    r = random.Random(3)
    for _ in range(6000):
        text = "".join(r.choice(SCRAPS) for _ in range(r.randint(0, 50)))
        own.block = r.choice([1, 2, 3, 5, 9])
        assert [i for b in own.blocks(text) for i in b] == own.library.encode_ordinary(text), (text, own.block)
    own.block = bytepairs.BLOCK


@pytest.mark.parametrize("unit", ["a", " ", "\n", "!?", "7", "你好", "ab1 ", "'", "x' "])
def test_very_long_runs(own, unit):
    text = "it's " + unit * (300_000 // len(unit)) + "end"
    ids = own.ids(text)
    assert own.bytes(ids) == text.encode()
    own.block = 1000
    assert own.ids(text) == ids
    own.block = bytepairs.BLOCK


def test_equals_another_library(spark, own):
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    for row in rows:
        if row.text:
            assert own.ids(row.text) == other.encode(row.text, add_special_tokens=False).ids
    got = {r.doc_id: r for r in bytepairs.round_trip(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert len(got) == len(rows)
    for row in rows:
        ids = other.encode(row.text or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest())
        assert tuple(got[row.doc_id])[1:] == want


def test_odd_rows(spark, own):
    long = "word, " * 60_000
    rows = [(None, None, 1, "x"), (1, "", 2, "y"), (2, "same", 3, None), (2, "same", 3, None), (3, long, 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, bytes string")
    got = sorted((tuple(r) for r in bytepairs.round_trip(docs).collect()), key=str)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(d, len(ids := own.ids(t or "")), digest(" ".join(map(str, ids))), digest(t or "")) for d, t, _, _ in rows]
    assert got == sorted(want, key=str)
    coded = bytepairs.encode(docs)
    assert coded.columns == ["doc_id", "text", "bytes", "ids"]
    plain = bytepairs.decode(coded)
    assert plain.columns == ["doc_id", "text", "ids", "bytes"]
    assert all(bytes(r["bytes"]).decode() == (r["text"] or "") for r in plain.collect())
    assert bytepairs.round_trip(docs.limit(0)).collect() == []


def test_ids_that_split_a_character(own):
    ids = own.ids("😀")
    assert len(ids) > 1 and b"".join(own.bytes([i]) for i in ids) == "😀".encode()
    with pytest.raises(UnicodeDecodeError):
        own.bytes(ids[:1]).decode()


def test_the_path_is_a_parameter(spark):
    docs = spark.createDataFrame([(1, "größer 你好")], "doc_id long, text string")
    one, other = (bytepairs.round_trip(docs, public_tokenizers.path(n)).first() for n in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"))
    assert one.ids_sha256 != other.ids_sha256 and one.decoded_sha256 == other.decoded_sha256
