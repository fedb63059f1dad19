"""Topics, events and labels from words in a text. Vocabularies are arguments."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EVENT_TYPES, PRIMARY_TOPICS
from .text import strip

# The words that decide a topic, in the order that wins ties.
TOPIC_WORDS: dict[str, tuple[str, ...]] = {
    "agentic-generative-ai": ("agent", "agentic", "foundation model", "generative ai", "language model", "llm", "mcp", "prompt", "tool calling", "orchestration"),
    "machine-learning-classical-ai": ("machine learning", "deep learning", "training", "fine-tun", "distillation", "reinforcement learning", "neural network", "optimization", "recommendation system", "forecasting", "symbolic ai"),
    "vision-speech-robotics": ("computer vision", "image generation", "video generation", "speech recognition", "text-to-speech", "audio model", "multimodal", "robot", "embodied ai"),
    "data-search-retrieval": ("retrieval", "rag", "rerank", "embedding", "vector database", "knowledge graph", "dataset", "indexing", "information retrieval", "web retrieval", "vector search", "search index", "search engine", "retrieval system"),
    "ai-products-engineering-infrastructure": ("api", "sdk", "copilot", "developer tool", "inference", "serving", "deployment", "observability", "gpu", "cuda", "distributed", "cluster", "hardware", "latency", "throughput"),
    "safety-evaluation-governance": ("evaluation", "eval", "benchmark", "security", "safety", "vulnerability", "alignment", "interpretability", "governance", "policy", "privacy", "incident"),
}
FALLBACK_TOPIC = "ai-products-engineering-infrastructure"
# The parts of words that decide an event; the first event with any wins.
EVENT_WORDS: dict[str, tuple[str, ...]] = {
    "alert": ("vulnerability", "security fix", "cve-", "incident", "outage", "breaking change", "deprecat", "sunset"),
    "research": ("research", "paper", "we propose", "study", "benchmark result"),
    "guide": ("tutorial", "how to", "step-by-step", "walkthrough", "guide"),
    "release-update": ("introducing", "launch", "released", "release", "now available", "api change", "integration"),
    "analysis": ("analysis", "technical deep dive", "explainer"),
}


def bounded(word: str) -> bool:
    """Whether a word counts only where it stands alone; phrases count anywhere."""
    return bool(re.fullmatch(r"[^\W_]+", word.replace("-", "")))


def occurrences(low: Column, word: str) -> Column:
    """How often a word stands in lower-cased text: between other characters than letters and digits, phrases anywhere."""
    if bounded(word):
        return F.regexp_count(low, F.lit(rf"(?<![a-z0-9])\Q{word}\E(?![a-z0-9])"))
    return ((F.length(low) - F.length(F.replace(low, F.lit(word), F.lit("")))) / len(word)).cast("int")


def topic_scores(text: Column, words: dict[str, tuple[str, ...]] = TOPIC_WORDS) -> dict[str, Column]:
    """Occurrences of each topic's words.

    Words of letters and digits alone cannot overlap, so one pass finds all of
    them; the few others are counted one by one.
    """
    low = F.lower(text)
    plain = sorted({w for ws in words.values() for w in ws if re.fullmatch("[a-z0-9]+", w)})
    hits = F.regexp_extract_all(low, F.lit(rf"(?<![a-z0-9])(?:{'|'.join(plain)})(?![a-z0-9])"), F.lit(0)) if plain else F.array().cast("array<string>")

    def among(found: Column, ws: tuple[str, ...]) -> Column:
        own = [w for w in ws if w in plain]
        return F.size(F.filter(found, lambda h: h.isin(*own))) if own else F.lit(0)

    # one expression for all topics, so that the text is searched once
    counts = F.transform(F.array(hits), lambda found: F.struct(*(among(found, ws).alias(f"n{k}") for k, ws in enumerate(words.values()))))
    rest = [[occurrences(low, w) for w in ws if w not in plain] for ws in words.values()]
    return {topic: reduce(lambda a, b: a + b, rest[k], F.get(counts, F.lit(0))[f"n{k}"]) for k, topic in enumerate(words)}


def topic(text: Column, default: Column, words: dict[str, tuple[str, ...]] = TOPIC_WORDS) -> Column:
    """struct(topic, method): the highest score, the first of equal ones; without any the default, if it is known."""
    scores = topic_scores(text, words)
    best = F.array_max(F.array(*(F.struct(s.cast("int").alias("score"), F.lit(-k).alias("place"), F.lit(t).alias("topic")) for k, (t, s) in enumerate(scores.items()))))
    safe = F.when(default.isin(*(set(PRIMARY_TOPICS) | set(words))), default).otherwise(F.lit(FALLBACK_TOPIC))
    found = best["score"] > 0
    return F.struct(
        F.when(found, best["topic"]).otherwise(safe).alias("topic"),
        F.when(found, F.lit("deterministic-keyword")).otherwise(F.lit("source-default")).alias("method"),
    )


def clean_labels(labels: Column, allowed: tuple[str, ...] = EVENT_TYPES, limit: int = 8) -> Column:
    """Stripped, lower-cased, with hyphens, each once, allowed ones only."""
    tidy = F.transform(labels, lambda x: F.replace(F.lower(strip(x)), F.lit("_"), F.lit("-")))
    kept = F.filter(F.array_distinct(tidy), lambda x: x.isin(*allowed))
    return F.coalesce(F.slice(kept, 1, limit), F.array().cast("array<string>"))


def events(text: Column, default: Column, words: dict[str, tuple[str, ...]] = EVENT_WORDS, allowed: tuple[str, ...] = EVENT_TYPES) -> Column:
    """At most one event: the first with any of its words, else the cleaned default."""
    low = F.lower(text)
    out = clean_labels(default, allowed, 1)
    for event, ws in reversed(words.items()):
        out = F.when(reduce(lambda a, b: a | b, (low.contains(w) for w in ws)), F.array(F.lit(event))).otherwise(out)
    return out
