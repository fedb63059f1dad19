"""Cited answers: gate the evidence, pack the context, ask a model, check what it cites."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import chat_cost
from ..functions.text import citation_warnings, compares, valid_citations
from . import context, search

# What is said without evidence, and of an answer that was cut.
NOTHING_FOUND = "I could not retrieve any matching article passages. Try broadening the source filters or lowering the similarity threshold."
CUT = "Answer reached the completion-token limit and may be truncated."


@dataclass
class Generated:
    """A model's answer."""

    text: str
    finish_reason: str | None = None
    prompt_tokens: int = 0
    completion_tokens: int = 0


Generator = Callable[[str, str], Generated]


@dataclass
class AskRequest:
    """A question with its limits."""

    question: str
    min_similarity: float = 0.3
    max_context_tokens: int = 3000
    retrieval_strategy: str = "standard"
    source_names: tuple[str, ...] = ()

    @property
    def diverse(self) -> bool:
        """Whether passages of different documents come first, other than by the question's words."""
        return self.retrieval_strategy == "source_balanced" or len(self.source_names) > 1


def weak_warning(top: float | None, least: float) -> str | None:
    """Why the passages do not do, if they do not."""
    if top is None:
        return NOTHING_FOUND
    if top < least:
        # fixed value: what is said of weak evidence
        return (
            f"The retrieved articles look weak for this question. The top similarity score was {top:.3f}, below the configured threshold of {least:.3f}. "
            "Try lowering the threshold, increasing top-k, changing filters, or collecting more relevant articles."
        )
    return None


def placed(results: DataFrame, request: AskRequest) -> DataFrame:
    """Results (with rank, url, document_id) in the order in which they are packed, from ``place`` 1."""
    if request.diverse or results.sparkSession.range(1).select(compares(F.lit(request.question)).alias("c")).first().c:
        return context.diverse_order(results)
    return results.withColumn("place", F.col("rank"))


def checked(answer: Column, passages: Column) -> tuple[Column, Column]:
    """(valid citations, warnings) of an answer over so many context passages."""
    return valid_citations(answer, passages), citation_warnings(answer, passages)


def ask(results: DataFrame, request: AskRequest, generate: Generator, model: str = "gpt-4.1-mini", counts: context.Counts = context.words_counted) -> DataFrame:
    """One row: answer, citations (chunk ids), warnings, context tokens and cost.

    ``results`` are a request's retrieved passages, at most tens, in columns
    chunk_id, document_id, title, source_name, url, tool, published, content,
    similarity, rank. Weak evidence ends it before the model is asked.
    """
    spark = results.sparkSession
    schema = "answer string, citations array<string>, warnings array<string>, context_tokens int, estimated_cost double"
    gate = search.weak(results, request.min_similarity).first()
    if warning := weak_warning(gate.top_similarity if gate.passages else None, request.min_similarity):
        return spark.createDataFrame([("", [], [warning], 0, None)], schema)
    pack = context.packed(placed(results, request), request.max_context_tokens, counts=counts).first()
    got = generate(request.question, pack.context)
    row = spark.createDataFrame([(got.text, pack.chunk_ids, got.prompt_tokens, got.completion_tokens, model)], "answer string, ids array<string>, tokens_in long, tokens_out long, model string")
    valid, warnings = checked(F.col("answer"), F.size("ids"))
    cut = F.array(F.lit(CUT)) if got.finish_reason == "length" else F.array().cast("array<string>")
    return row.select("answer", F.transform(valid, lambda n: F.element_at("ids", n.cast("int"))).alias("citations"), F.concat(warnings, cut).alias("warnings"), F.lit(pack.tokens).alias("context_tokens"), chat_cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out")).alias("estimated_cost"))
