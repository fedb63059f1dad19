"""Byte-level BPE with the tiktoken library: encoding, and decoding from raw bytes.

The ranks come from a local file that every worker opens by its path. A long
text is cut where no match of the library's pattern can cross, so that neither
its pattern matcher nor its merges see more than a block at a time:

- where white space follows something else: every match that holds white space
  begins with it;
- before the last of several white-space characters that something else follows:
  the run's match ends there;
- between the other characters where their kind changes (letters, numbers, the
  rest), unless an apostrophe or a space stands before.

A block is encoded as a text of its own; where no safe place comes for another
``BLOCK`` characters, the matches there are found one at a time and go to the
merges as pieces of bytes. Ids stream into the caller, so a text's memory is that of its bytes and
its ids.

Defined results: null and empty texts have no ids and decode to no bytes; a null
doc_id is kept; repeated rows get equal results; an empty table gives an empty
result; extra columns are ignored, and kept as they are by ``encode`` and
``decode``, save those named ``ids`` or ``bytes``, which give way.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

#: Characters of a block, about: a block ends at the first safe place behind so many.
BLOCK = 1 << 16
RANKS, PATTERN = "byte_bpe_50k.tiktoken", public_tokenizers.PATTERN
#: Places that no match crosses.
SAFE = regex.compile(
    r"(?<=\S)(?=\s)|(?<=\s)(?=\s\S)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])"
)


class Encoder:
    """A tiktoken encoding of one rank file, safe for texts of any length."""

    def __init__(self, path: str, pattern: str = PATTERN, block: int = BLOCK):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.block = regex.compile(pattern), block

    def cut(self, text: str) -> Iterator[tuple[int, int]]:
        """Blocks of a text, each from one safe place to another."""
        start = 0
        while len(text) - start > self.block:
            found = SAFE.search(text, start + self.block)
            # the search looks back over its start, so a place at the start itself is found
            end = found.start() if found else len(text)
            yield start, end
            start = end
        if start < len(text):
            yield start, len(text)

    def blocks(self, text: str) -> Iterator[list[int]]:
        """Ids, block by block."""
        for start, end in self.cut(text):
            part = text[start:end]
            if end - start <= 2 * self.block:
                yield self.library.encode_ordinary(part)
                continue
            # from the last safe place on, a match or two longer than a block
            last = max((m.start() for m in SAFE.finditer(part, 0, self.block + 1)), default=0)
            if last:
                yield self.library.encode_ordinary(part[:last])
            for m in self.pattern.finditer(part, last):
                yield self.library._encode_single_piece(m.group())

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        return self.library.encode_ordinary(text) if len(text) <= self.block else [i for b in self.blocks(text) for i in b]

    def bytes(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for, whether they are whole characters or not."""
        return self.library.decode_bytes(ids)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """A worker's encoder of a file."""
    return Encoder(path)


def path_or_default(path: str | None) -> str:
    return path or public_tokenizers.path(RANKS)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All rows and columns, with ``ids``, the ids of ``text``."""
    ranks, others = path_or_default(path), [F.col(f"`{c}`") for c in docs.columns if c != "ids"]
    coded = F.arrow_udf(lambda texts: pa.array([encoder(ranks).ids(t.as_py()) for t in texts], pa.list_(pa.int32())), "array<int>")
    return small_batches(docs).select(*others, coded(text_or_empty()).alias("ids"))


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """All rows and columns, with ``bytes``, what ``ids`` stand for; null ids stand for none."""
    ranks, others = path_or_default(path), [F.col(f"`{c}`") for c in coded.columns if c != "bytes"]
    plain = F.arrow_udf(lambda ids: pa.array([encoder(ranks).bytes(i.as_py() or []) for i in ids], pa.binary()), "binary")
    return small_batches(coded).select(*others, plain("ids").alias("bytes"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: texts encoded, and their ids decoded again.

    Ids of a long text are hashed, decoded and dropped block by block.
    """
    ranks = path_or_default(path)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks)
        for batch in batches:
            counts, names, plains = [], [], []
            for text in batch["text"]:
                n, ids, plain = 0, hashlib.sha256(), hashlib.sha256()
                for block in own.blocks(text.as_py()):
                    ids.update((" " if n else "").encode() + " ".join(map(str, block)).encode())
                    plain.update(own.bytes(block))
                    n += len(block)
                counts.append(n)
                names.append(ids.hexdigest())
                plains.append(plain.hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(names), pa.array(plains)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return small_batches(rows).mapInArrow(coded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
