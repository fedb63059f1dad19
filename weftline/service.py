"""The request surface: parameters as they come, checked, to the engine's answers.

Each function takes tables and plain parameters and gives a DataFrame, so that
any server can stand before it. Health looks at the tables alone.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import answer, feed, search
from .sources.registry import normalized_list

# Fixed value: request ids that are taken over.
REQUEST_ID = re.compile(r"[A-Za-z0-9._-]{1,64}")
# Defaults, and the least and most that are taken.
TOP_K, MIN_SIMILARITY, CONTEXT_TOKENS, COMPLETION_TOKENS = (6, 1, 20), (0.35, 0, 1), (3500, 500, 12000), (300, 50, 1200)
_LISTS = ("source_names", "tools", "categories", "event_types", "source_types")


def request_id(given: str | None) -> str:
    """The caller's id if it is well formed, else a new one."""
    return given if given and REQUEST_ID.fullmatch(given) else uuid.uuid4().hex


@dataclass
class Elapsed:
    """Whole milliseconds that a request took, once it is over."""

    milliseconds: int = field(default=0)


@contextmanager
def timed() -> Iterator[Elapsed]:
    out, start = Elapsed(), time.perf_counter()
    try:
        yield out
    finally:
        out.milliseconds = int((time.perf_counter() - start) * 1000)


@dataclass
class Tables:
    """What requests are answered from; ``query_vector`` gives one row with column q for a text."""

    articles: DataFrame
    chunks: DataFrame
    sources: DataFrame
    query_vector: Callable[[str], DataFrame] | None = None


def _instant(value: object) -> Column | None:
    return None if value is None else F.lit(value).cast("timestamp")


def _given(kind: type, params: Mapping[str, object]) -> dict[str, object]:
    """The parameters that a request knows; others are an error, as are single values for lists.

    Lists are trimmed and each value taken once, all but tools in lower case; an
    empty list is no filter.
    """
    known = {f.name for f in fields(kind)}
    unknown = set(params) - known
    if unknown:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    out = dict(params)
    for name in _LISTS:
        if name in out:
            if isinstance(out[name], str):
                raise ValueError(f"{name} must be a list")
            out[name] = normalized_list(out[name], lower=name != "tools") or []
    for name in ("start", "end"):
        if name in out:
            out[name] = _instant(out[name])
    return out


def _within(name: str, value: float, least: float, most: float) -> None:
    if not least <= value <= most:
        raise ValueError(f"{name} must be {least} to {most}")


def _searched(params: Mapping[str, object]) -> dict[str, object]:
    """Parameters of a search as callers name them, checked, as the engine names them."""
    out = {"top_k": TOP_K[0]} | dict(params)
    _within("top_k", out["top_k"], *TOP_K[1:])
    if out.pop("collection", "updates") != "updates":
        raise ValueError("collection must be updates")
    for name, own in (("published_after", "start"), ("published_before", "end")):
        if name in out:
            out[own] = out.pop(name)
    return out


def updates(tables: Tables, as_of: Column, **params: object) -> DataFrame:
    """A page of the feed."""
    return feed.page(tables.articles, tables.sources, feed.FeedRequest(as_of, **_given(feed.FeedRequest, {"limit": 30} | params)))


def found(tables: Tables, as_of: Column, query: str, **params: object) -> DataFrame:
    """The passages that a search retrieves."""
    request = search.SearchRequest(query, as_of, **_given(search.SearchRequest, _searched(params)))
    vector = tables.query_vector(query) if tables.query_vector and request.search_mode != "keyword" else None
    return search.search(tables.chunks, tables.articles, tables.sources, request, vector)


def asked(
    tables: Tables, as_of: Column, question: str, generate: answer.Generator, *,
    min_similarity: float = MIN_SIMILARITY[0], max_context_tokens: int = CONTEXT_TOKENS[0], max_completion_tokens: int = COMPLETION_TOKENS[0], **params: object,
) -> DataFrame:
    """A cited answer from what a search for the question retrieves; how long it may be is the generator's to keep."""
    for name, value, (_, least, most) in (("min_similarity", min_similarity, MIN_SIMILARITY), ("max_context_tokens", max_context_tokens, CONTEXT_TOKENS), ("max_completion_tokens", max_completion_tokens, COMPLETION_TOKENS)):
        _within(name, value, least, most)
    rows = found(tables, as_of, question, **params)
    rows = rows.join(F.broadcast(tables.sources.select(F.col("slug").alias("source_name"), "tool")), "source_name", "left")
    rows = rows.withColumn("published", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"))
    more = {"retrieval_strategy": params.get("retrieval_strategy", "standard"), "source_names": tuple(params.get("source_names") or ())}
    return answer.ask(rows, answer.AskRequest(question, min_similarity, max_context_tokens, **more), generate)


def readiness(tables: Mapping[str, Callable[[], DataFrame]]) -> tuple[bool, dict[str, str]]:
    """Whether every named table can be read, and what each check said."""
    checks = {}
    for name, read in tables.items():
        try:
            read().limit(1).count()
            checks[name] = "ok"
        except Exception as e:  # a check tells, whatever went wrong
            checks[name] = f"failed: {type(e).__name__}"
    return all(v == "ok" for v in checks.values()), checks
