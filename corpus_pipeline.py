"""A training corpus from raw documents, in five stages.

Each stage works on all that the one before it kept; what it decides takes
effect. Its result is written as Parquet to the shared folder and reread as the
next one's documents, so a lost executor repeats a part of one stage at most; a
stage's table goes once the next one's is written.

Every stage takes nulls in any column, empty and very long texts, repeated rows
and empty tables, and keeps extra columns, whatever their names; what it makes
of them stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import mixing, near_copies, pieces, pii, toxicity
from weftline.llm.common import forget, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar does not predict toxic.

    Null and empty texts have no clause: they stay unless texts without a
    match are predicted toxic, which needs labels that say so. Without labels
    of both classes all stay.
    """
    return toxicity.kept(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest doc_id.

    Null and empty texts are copies of each other; rows that repeat the kept
    doc_id go, rows with a null doc_id all stay.
    """
    return near_copies.deduplicated(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by its kind; n_chars counts the text as it is then.

    Null texts stay null; equal texts come out equal.
    """
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its target weight asks, three times at most.

    Null is a source of its own; a document without words stays once.
    """
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, with ``ids``, the pieces of the text, and their number ``n_pieces``.

    Null and empty texts have no pieces; columns of these two names give way.
    """
    coded = pieces.encode(docs, text=False)
    others = [F.col(f"`{c}`") for c in coded.columns if c not in ("n_pieces", "ids")]
    return coded.select(*others, F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("pii", redact),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: SQL can express neither the classifier nor the fingerprints and draws; tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
            forget(before)
    return docs
