"""Bounded samples of labelled rows, and the logistic curve fitted to them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import forget, stored, text_or_empty

#: Labelled rows sampled of each class, and the bytes of text after which a class's sample takes no further row.
PER_CLASS, SAMPLE_BYTES = 2000, 1 << 24
#: Texts of more characters than PARTS of PART give so many parts of that length to the sample.
PART, PARTS = 1 << 16, 16


def remainder(folds: int, doc_id: str = "doc_id"):
    """crc32 of the id's decimal digits, modulo ``folds``; null ids have remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def in_parts(text: Column) -> Column:
    """A text as the sample takes it: whole, or of a very long one the parts with the smallest hashes, in order."""
    last = F.floor((F.length(text) - 1) / PART).cast("int")
    every = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.xxhash64("doc_id", k).alias("h"), k.alias("k")))
    chosen = F.sort_array(F.transform(F.slice(F.sort_array(every), 1, PARTS), lambda x: x["k"]))
    cut = F.array_join(F.transform(chosen, lambda k: text.substr(k * PART + 1, F.lit(PART))), "")
    return F.when(F.length(text) <= PART * PARTS, text).otherwise(cut)


def sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, held: int, per_class: int = PER_CLASS) -> tuple[list[Row], tuple[int, int]]:
    """(rows with text and label, counts of labelled rows by class), the held-out fold left out.

    The rows of each class with the smallest hash of their id, until there are
    ``per_class`` of them or their texts come to SAMPLE_BYTES: the first row is
    always there, however long, and no row ends the sample before its own turn.
    Very long texts are learned ``in_parts``. Of labels that repeat an id, the
    larger counts, of documents that do, the smallest text. Only ids are ranked.
    """
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(folds) != held))
    known = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    classes = [known.where(F.col("label") == k) for k in (0, 1)]
    counts = dict(known.groupBy("label").count().collect())
    ids = stored(classes[0].orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).union(classes[1].orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)), "labelled")
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")  # 2 * per_class rows of two numbers
    rows = stored(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).withColumn("text", in_parts(F.col("text"))), "labelled-texts")
    # at most 2 * per_class rows from here on
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    chosen = rows.select("doc_id", F.coalesce(before, F.lit(0)).alias("before")).where(F.col("before") < SAMPLE_BYTES).select("doc_id")
    found = sorted(rows.join(F.broadcast(chosen), "doc_id").collect(), key=lambda r: r["doc_id"])
    forget(ids, rows)
    return found, (counts.get(0, 0), counts.get(1, 0))


class Curve:
    """Logistic regression on standardised features; a score in [0, 1]."""

    def __init__(self, x: np.ndarray, y: np.ndarray, counts: tuple[int, int], ridge: float = 1.0):
        self.mean, self.scale = (x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.w, self.loss = np.zeros(x.shape[1] + 1), 0.0
        if len(set(y.tolist())) < 2:
            self.w[0] = 0.0 if not len(y) else 4.0 if y[0] else -4.0
            return
        z, seen = self.design(x), np.bincount(y.astype(int), minlength=2)
        # each class weighs as it does among all labelled rows
        weight = np.where(y == 1, counts[1] / seen[1], counts[0] / seen[0]) * len(y) / sum(counts)
        pull = np.r_[1e-6, np.full(x.shape[1], ridge)]

        def loss(w: np.ndarray) -> float:
            return float((weight * (np.logaddexp(0, z @ w) - y * (z @ w))).sum() + 0.5 * (pull * w * w).sum())

        now = loss(self.w)
        for _ in range(100):
            p = self.squash(z @ self.w)
            hess = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(pull)
            step, size = np.linalg.solve(hess, z.T @ (weight * (y - p)) - pull * self.w), 1.0
            while size > 1e-6 and loss(self.w + size * step) > now:
                size /= 2
            self.w = self.w + size * step
            last, now = now, loss(self.w)
            if last - now < 1e-9 * (1 + abs(now)):
                break
        self.loss = now

    @staticmethod
    def squash(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -40, 40)))

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.squash(self.design(x) @ self.w)
