"""Fetching pages: what to retry, how long to wait, what a failure means.

The requests go through an injected function, so tests and offline runs read
from a table of pages; each partition fetches its own rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .feeds import entry_html
from .html import clean_html

# Attempts, seconds, and the responses that are worth another attempt.
ATTEMPTS, BASE_DELAY, MAX_DELAY = 3, 1.0, 10.0
RETRIED = (408, 429, 500, 502, 503, 504)


@dataclass
class Response:
    """What a request gave: a status, or None for a transport error."""

    status: int | None
    text: str = ""
    url: str = ""
    retry_after: str | None = None


def retry_delay(attempt: Column, retry_after: Column) -> Column:
    """Seconds before the next attempt: doubling, or as the server says, ten at most."""
    said = F.trim(retry_after)
    delay = F.when(said.rlike("^[0-9]+$"), said.try_cast("double")).otherwise(F.pow(F.lit(2.0), attempt - 1) * BASE_DELAY)
    return F.least(F.lit(MAX_DELAY), delay)


def delay_of(attempt: int, retry_after: str | None) -> float:
    said = (retry_after or "").strip()
    return min(MAX_DELAY, float(said) if said.isdigit() else BASE_DELAY * 2 ** (attempt - 1))


def get(url: str, request: Callable[[str], Response], sleep: Callable[[float], None] = time.sleep) -> Response:
    """The last of up to three attempts."""
    for attempt in range(1, ATTEMPTS + 1):
        response = request(url)
        if attempt == ATTEMPTS or not (response.status is None or response.status in RETRIED):
            return response
        sleep(delay_of(attempt, response.retry_after))
    raise AssertionError("no attempt was made")


def fetched(urls: DataFrame, request: Callable[[str], Response], column: str = "url") -> DataFrame:
    """``urls`` with http_status, html and final_url."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [get(u, request) for u in b[column]]
            yield b.assign(http_status=pd.array([r.status for r in got], "Int32"), html=[r.text for r in got], final_url=[r.url or u for r, u in zip(got, b[column], strict=True)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema) + ", http_status int, html string, final_url string"
    return urls.mapInPandas(run, schema)


def error_code(http_status: Column, kind: Column) -> Column:
    """What went wrong, by response status or by the kind of error."""
    return (
        F.when(http_status == 403, F.lit("http_forbidden"))
        .when(http_status == 404, F.lit("http_not_found"))
        .when(http_status.isNotNull(), F.lit("http_error"))
        .when(kind == "network", F.lit("network_error"))
        .when(kind == "content", F.lit("content_incomplete"))
        .otherwise(F.lit("unknown_error"))
    )


def fallback_status(feed_text: Column) -> Column:
    """How far an entry goes whose page could not be had."""
    return F.when(F.trim(F.coalesce(feed_text, F.lit(""))) != "", F.lit("feed_excerpt_only")).otherwise(F.lit("title_only"))


def failed_entries(entries: DataFrame) -> DataFrame:
    """Entries with http_status and error_kind, kept with the feed's own text."""
    text = clean_html(entry_html(F.col("content"), F.col("summary"), F.col("description")))
    return entries.withColumn("extraction_status", fallback_status(text)).withColumn("error_code", error_code(F.col("http_status"), F.col("error_kind")))


def wants_page(fetch_full: Column, source_kind: Column) -> Column:
    """Whether an entry's page is fetched after the filter (listings fetch it before)."""
    return F.coalesce(fetch_full, F.lit(False)) & (source_kind != "html_listing")
