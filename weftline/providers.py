"""Models behind narrow interfaces, with deterministic versions that need no network.

Providers run inside ``mapInPandas``, one call a batch, on the rows that a route
sends them and on no others.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.quotes import demoted, quote_supported
from .functions.text import collapse, shorten_reason
from .operators.ingest import model_card
from .schemas import RELEVANCE_TIERS

# Characters of a text that a model reads, the answers that count, limits of answers.
READ_CHARACTERS = 12000
FOCUSES = ("central", "supporting", "absent")
REASON_LIMIT, QUOTE_LIMIT = 480, 240
UNSUPPORTED_CORE = (
    "The model proposed core relevance without source-grounded evidence that "
    "agent engineering is the central subject; demoted to contextual."
)


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector a text."""


class RelevanceModel(Protocol):
    def classify(self, titles: list[str], texts: list[str]) -> list[dict]:
        """relevance_tier, relevance_reason, agent_focus and agent_evidence_quote of each article."""


class SummaryModel(Protocol):
    def summarize(self, titles: list[str], texts: list[str]) -> list[str]:
        """JSON with a card's fields of each article; anything else leaves the fallback."""


class HashedEmbedder:
    """Word counts hashed into a unit vector."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


class KeywordRelevance:
    """Core where a title has one of the words, contextual where only the text has; the quote is the title."""

    def __init__(self, words: tuple[str, ...] = ("agent", "agents", "agentic")):
        self.words = re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b", re.IGNORECASE)

    def classify(self, titles: list[str], texts: list[str]) -> list[dict]:
        out = []
        for title, text in zip(titles, texts, strict=True):
            head, any_ = bool(self.words.search(title)), bool(self.words.search(text))
            tier = "core" if head else "contextual" if any_ else "excluded"
            out.append({"relevance_tier": tier, "relevance_reason": f"Keywords in {'title' if head else 'text' if any_ else 'neither title nor text'}.", "agent_focus": "central" if head else "supporting" if any_ else "absent", "agent_evidence_quote": title})
        return out


def embedded(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """``chunks`` with an embedding of each content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(embedding=embedder.embed(b["content"].tolist()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema) + ", embedding array<float>"
    return chunks.mapInPandas(run, schema)


def decided(tier: Column, reason: Column, focus: Column, grounded: Column) -> tuple[Column, Column]:
    """(tier, reason): null tier for an answer out of the vocabulary; core only where it is grounded."""
    t, f, r = F.lower(F.trim(F.coalesce(tier, F.lit("")))), F.lower(F.trim(F.coalesce(focus, F.lit("")))), shorten_reason(collapse(F.coalesce(reason, F.lit(""))), REASON_LIMIT)
    valid = t.isin(*RELEVANCE_TIERS) & (r != "") & f.isin(*FOCUSES)
    final = F.when(valid, demoted(t, f, grounded))
    why = F.when(~valid, F.lit("Model returned an invalid relevance decision. Classification pending retry.")).when(final != t, F.lit(UNSUPPORTED_CORE)).otherwise(r)
    return final, why


def classified(rows: DataFrame, model: RelevanceModel) -> DataFrame:
    """``rows`` (title, raw_text) with the final tier and reason of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = model.classify(b["title"].tolist(), [t[:READ_CHARACTERS] for t in b["raw_text"]])
            yield b.assign(_tier=[g.get("relevance_tier") for g in got], _reason=[g.get("relevance_reason") for g in got], _focus=[g.get("agent_focus") for g in got], _quote=[" ".join(str(g.get("agent_evidence_quote") or "").split())[:QUOTE_LIMIT] for g in got])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _tier string, _reason string, _focus string, _quote string"
    answers = rows.mapInPandas(run, schema)
    tier, why = decided(F.col("_tier"), F.col("_reason"), F.col("_focus"), quote_supported("title", "raw_text", "_quote"))
    return answers.withColumn("tier", tier).withColumn("reason", why).drop("_tier", "_reason", "_focus", "_quote")


def summarizer(model: SummaryModel, name: str) -> Callable[[DataFrame], DataFrame]:
    """A summarizer for ``ingest.written``: the model's cards, the fallback's where a call fails or its JSON cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                got = model.summarize(b["title"].tolist(), [t[:READ_CHARACTERS] for t in b["raw_text"]])
            except Exception:  # the fallback stands in for whatever went wrong
                got = [None] * len(b)
            yield b.assign(_payload=got)

    def summarize(rows: DataFrame) -> DataFrame:
        flat = rows.drop("old")  # pandas takes no nested rows; they come back by key
        keyed = rows.select("url", "source_name", "content_hash", "old")
        schema = T.StructType([*flat.schema.fields, T.StructField("_payload", T.StringType())])
        answered = flat.mapInPandas(run, schema).join(keyed, ["url", "source_name", "content_hash"])
        return model_card(answered, "_payload", name).drop("_payload")

    return summarize
