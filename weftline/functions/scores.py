"""Scores: vector similarity, recency, importance, their mixture, and model cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, decay and published prices a million tokens.
DECAY_DAYS = 21.0
IMPORTANCE = (0.45, 0.45, 0.10)
HYBRID = (0.60, 0.25, 0.15)
DETAIL_LENGTH = 4000.0
CHAT_RATES = {"gpt-4.1-mini": (0.40, 1.60)}
EMBEDDING_RATES = {"text-embedding-3-small": 0.02}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Of two vectors in doubles, to four decimals; null for a vector of zeros."""
    return F.round(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), 4)


def age_days(published: Column, as_of: Column) -> Column:
    """Days and their fraction, never negative."""
    return F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(published)) / F.lit(86_400_000_000.0))


def decay(published: Column, as_of: Column) -> Column:
    return F.exp(-age_days(published, as_of) / DECAY_DAYS)


def recency(published: Column, as_of: Column) -> Column:
    return F.when(published.isNull(), F.lit(0.0)).otherwise(F.round(decay(published, as_of), 4))


def importance(credibility: Column, published: Column, raw: Column, as_of: Column) -> Column:
    """Source credibility, freshness and length, to four decimals."""
    fresh = decay(F.coalesce(published, as_of), as_of)
    detail = F.least(F.length(raw) / DETAIL_LENGTH, F.lit(1.0))
    a, b, c = IMPORTANCE
    return F.round(F.coalesce(credibility, F.lit(1.0)) * a + fresh * b + detail * c, 4)


def keyword_normalized(score: Column, top: Column) -> Column:
    return F.when((top > 0) & score.isNotNull(), score / top).otherwise(F.lit(0.0))


def combined(vector: Column, keyword: Column, fresh: Column, mode: str) -> Column:
    """The ranking score of a search mode; a missing leg counts zero."""
    v = F.coalesce(vector, F.lit(0.0))
    if mode == "vector":
        return v
    if mode == "keyword":
        return keyword
    a, b, c = HYBRID
    return v * a + keyword * b + fresh * c


def display_similarity(vector: Column, keyword: Column, normalized: Column, total: Column) -> Column:
    """The vector's similarity, the keyword share without one, the mixture with both."""
    shown = F.when(vector.isNotNull() & keyword.isNotNull(), total).otherwise(F.coalesce(vector, normalized))
    return F.round(shown, 4)


def _rate(model: Column, rates: dict[str, float]) -> Column:
    """The rate of a model, by its name or by the name that it starts with and a hyphen."""
    named = reduce(lambda rest, r: F.when(model == r[0], F.lit(r[1])).otherwise(rest), rates.items(), F.lit(None).cast("double"))
    started = reduce(lambda rest, r: F.when(model.startswith(r[0] + "-"), F.lit(r[1])).otherwise(rest), reversed(rates.items()), F.lit(None).cast("double"))
    return F.coalesce(named, started)


def chat_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """US dollars to six decimals; null for an unknown model."""
    a = _rate(model, {k: v[0] for k, v in CHAT_RATES.items()})
    b = _rate(model, {k: v[1] for k, v in CHAT_RATES.items()})
    return F.round(tokens_in / F.lit(1_000_000.0) * a + tokens_out / F.lit(1_000_000.0) * b, 6)


def embedding_cost(model: Column, tokens: Column) -> Column:
    return F.round(tokens / F.lit(1_000_000.0) * _rate(model, EMBEDDING_RATES), 6)


def max_optional(a: Column, b: Column) -> Column:
    """The larger of two scores, either of which may be missing."""
    return F.greatest(a, b)
