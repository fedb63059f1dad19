"""Context for an answer: passages packed into a token budget, in order."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunking import TokenCounter

# What joins blocks, and the shape of a token without a tokenizer.
JOINT = "\n\n---\n\n"
TOKEN = r"(?U)\w+|[^\w\s]"


def count_tokens(text: Column) -> Column:
    """Words and marks; a stand-in for a model's tokenizer."""
    return F.regexp_count(text, F.lit(TOKEN))


#: From a column of texts (an array) to how many tokens each has.
Counts = Callable[[Column], Column]


def words_counted(texts: Column) -> Column:
    return F.transform(texts, count_tokens)


def counted_by(count: TokenCounter) -> Counts:
    """Counts of a tokenizer, such as ``chunking.BpeCounter``: one call a passage, for all its texts."""

    @F.pandas_udf("array<int>")
    def counts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda ts: [count(t) for t in ts])

    return counts


def document_identity(url: Column, document_id: Column) -> Column:
    """The same for all passages of one address."""
    address = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), "/+$", "")
    return F.coalesce(F.nullif(address, F.lit("")), document_id)


def diverse_order(passages: DataFrame) -> DataFrame:
    """The first passage of every document, then the others; column ``place`` counts from 1."""
    nth = F.row_number().over(Window.partitionBy(document_identity(F.col("url"), F.col("document_id"))).orderBy("rank"))
    return passages.withColumn("_again", nth > 1).withColumn("place", F.row_number().over(Window.orderBy("_again", "rank"))).drop("_again")


def block(number: Column, p: dict[str, Column]) -> Column:
    """A passage's six lines."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), number.cast("string"), F.lit("] "), p["title"]),
        F.concat(F.lit("Source: "), p["source_name"]),
        F.concat(F.lit("Published: "), F.coalesce(p["published"], F.lit("unknown"))),
        F.concat(F.lit("Tool: "), F.coalesce(p["tool"], F.lit("unknown"))),
        F.concat(F.lit("URL: "), p["url"]),
        p["content"],
    )


FIELDS = ("chunk_id", "title", "source_name", "published", "tool", "url", "content")


def packed(passages: DataFrame, budget: int, order: str = "place", counts: Counts = words_counted) -> DataFrame:
    """One row: the chunk ids taken, their tokens, and the context.

    A passage that does not fit is passed over and later ones are tried; the
    first always fits. Takes what retrieval returns, at most tens of passages: each
    is counted as it would stand under every number, before any is taken.
    """

    def text(number: Column, p: dict[str, Column]) -> Column:
        return F.when(number > 1, F.concat(F.lit(JOINT), block(number, p))).otherwise(block(number, p))

    own = {f: F.col(f).cast("string") for f in FIELDS}
    numbered = passages.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()).cast("int"))
    numbered = numbered.withColumn("_texts", F.transform(F.sequence(F.lit(1), F.col("_n")), lambda k: text(k, own)))
    numbered = numbered.withColumn("_tokens", counts(F.col("_texts")))
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), own["chunk_id"].alias("chunk_id"), F.col("_texts").alias("texts"), F.col("_tokens").alias("tokens"))))
    start = F.expr("struct(cast(array() as array<string>) as ids, '' as text, 0 as tokens)")

    def take(a: Column, p: Column) -> Column:
        k = F.size(a["ids"])
        n = F.get(p["tokens"], k)
        fits = (k == 0) | (a["tokens"] + n <= budget)
        return F.when(fits, F.struct(F.concat(a["ids"], F.array(p["chunk_id"])).alias("ids"), F.concat(a["text"], F.get(p["texts"], k)).alias("text"), (a["tokens"] + n).alias("tokens"))).otherwise(a)

    done = numbered.agg(rows.alias("rows")).select(F.aggregate("rows", start, take).alias("c"))
    return done.select(F.col("c.ids").alias("chunk_ids"), F.col("c.tokens").alias("tokens"), F.col("c.text").alias("context"))


def cited(passages: DataFrame, numbers: Column) -> DataFrame:
    """Context passages (with ``place``) that an answer's numbers name."""
    return passages.where(F.array_contains(numbers, F.col("place").cast("long")))
