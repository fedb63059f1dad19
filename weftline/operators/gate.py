"""The gate between stored candidates and published articles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import IMPORTANT_SPARSE_EVENTS
from ..schemas import PUBLISHED, QUARANTINED

# Extraction statuses of pages that could not be had.
FETCH_FAILED = ("feed_excerpt_only", "title_only")


def failure_codes(detail: Column, extraction: Column, events: Column) -> Column:
    """Why an article is not published, in order; empty if it is."""
    important = F.coalesce(F.arrays_overlap(events, F.array(*map(F.lit, IMPORTANT_SPARSE_EVENTS))), F.lit(False))
    return F.array_compact(
        F.array(
            F.when(extraction.isin(*FETCH_FAILED), F.lit("article_hydration_failed")),
            F.when(extraction == "title_only", F.lit("title_only_source")),
            F.when((detail == "sparse") & ~important, F.lit("insufficient_source_detail")),
        )
    )


def gate_status(codes: Column) -> Column:
    return F.when(F.size(codes) == 0, F.lit(PUBLISHED)).otherwise(F.lit(QUARANTINED))


def full_evidence(extraction: Column, detail: Column) -> Column:
    """Whether a stored article is too good for a refresh that is not published."""
    return (extraction == "full_article") | (detail == "detailed")
