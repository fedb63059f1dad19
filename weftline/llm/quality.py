"""Quality by compression: which class's dictionaries shorten a text more.

Zstandard dictionaries are built from good and from bad labelled texts, several
of each: a class's texts are dealt out by their hash, a dictionary is built of
each part, every text moves to the dictionary that makes it smallest, and so on
for a few rounds, so that languages and kinds of text get dictionaries of their
own. A text is compressed whole with each; its size by a class is that of the
class's best dictionary. The difference of the two sizes, over their sum and
over the text's bytes, is all that a score looks at: a logistic curve, fitted on
labelled texts that no dictionary has seen, calibrates it by the text's length.

Training looks at a bounded sample of labelled rows (``labelled.PER_CLASS`` of
each class, ``labelled.SAMPLE_BYTES`` of each); scoring at every text.

Defined results: null and empty texts are scored as the empty text; without
labels of both classes every score is 0.5 or the one class's; a null doc_id is
never held out; repeated rows get equal scores; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .labelled import Curve, remainder, sample

#: Dictionaries of each class (chosen by cross-validation among the folds that are learned from, README) and the
#: rounds in which texts move between them; a dictionary's bytes; compression level.
PARTS, ROUNDS, SIZE, LEVEL = 3, 4, 1 << 14, 3
#: Rows whose crc32 of the id has this remainder are never learned from.
FOLDS, HELD = 4, 2
#: Score from which a text is predicted good.
LIMIT = 0.7


def dictionary(texts: list[bytes], size: int = SIZE) -> bytes:
    """A trained dictionary's bytes; of few or tiny texts, the texts themselves."""
    try:
        return zstandard.train_dictionary(size, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:].rjust(8, b" ")


def coder(raw: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(raw)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)


def sizes(coders: list, texts: list[bytes]) -> np.ndarray:
    """Compressed bytes, a row a text, a column a dictionary."""
    return np.array([[len(c.compress(t)) for c in coders] for t in texts], float).reshape(len(texts), len(coders))


def dictionaries(texts: list[bytes], parts: int = PARTS, size: int = SIZE) -> list[bytes]:
    """Dictionaries of the parts that a class's texts fall into; as many as have texts, one at least."""
    at = np.array([zlib.crc32(t) % parts for t in texts], int)
    for turn in range(ROUNDS):
        found = [dictionary([t for t, a in zip(texts, at, strict=True) if a == p], size) for p in sorted(set(at.tolist()))]
        if turn < ROUNDS - 1 and texts:
            at = sizes([coder(d) for d in found], texts).argmin(axis=1)
    return found or [dictionary([], size)]


_coders: dict[tuple, tuple[list, list]] = {}


def coders(good: list[bytes], bad: list[bytes]) -> tuple[list, list]:
    """Compressors of both classes; a worker keeps the last."""
    key = *good, b"", *bad
    if key not in _coders:
        _coders.clear()
        _coders[key] = [coder(d) for d in good], [coder(d) for d in bad]
    return _coders[key]


def features(texts: Iterable[str], good: list[bytes], bad: list[bytes]) -> np.ndarray:
    """A row a text, taken one by one: the normalised size differences, and what calibrates them by length."""
    with_good, with_bad = coders(good, bad)
    rows = [(min(len(c.compress(raw)) for c in with_good), min(len(c.compress(raw)) for c in with_bad), len(raw)) for t in texts for raw in (t.encode("utf-8", "surrogatepass"),)]
    a, b, n = np.array(rows, float).reshape(-1, 3).T
    gap, share, long = (b - a) / (a + b), (b - a) / (n + 20), np.log1p(n)
    return np.stack([gap, gap * long, share, share * long, np.tanh(30 * gap), np.tanh(60 * share)], axis=1)


class Model:
    """The dictionaries and the curve."""

    def __init__(self, rows: list, counts: tuple[int, int], parts: int = PARTS, size: int = SIZE):
        texts = {k: [r["text"] for r in rows if r["label"] == k] for k in (0, 1)}
        # every other text builds a dictionary, the rest fit the curve
        self.good, self.bad = (dictionaries([t.encode("utf-8", "surrogatepass") for t in texts[k][::2]], parts, size) for k in (1, 0))
        rest = [(t, k) for k in (0, 1) for t in texts[k][1::2]]
        self.curve = Curve(features([t for t, _ in rest], self.good, self.bad), np.array([k for _, k in rest], float), counts)

    def score(self, texts: Iterable[str]) -> np.ndarray:
        return self.curve(features(texts, self.good, self.bad))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return Model(*sample(docs, labels, "quality", FOLDS, HELD))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.score(t.as_py() or "" for t in b.column("text"))
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(found), pa.array((found >= LIMIT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    src = docs.select(F.col("doc_id").cast("long"), (remainder(FOLDS) == HELD).alias("held_out"), F.col("text").cast("string"))
    return small_batches(src).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
