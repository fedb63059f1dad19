"""Dates in entries and texts, ISO weeks and relative times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Fixed value: a date as English text writes it.
TEXT_DATE = r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2}, \d{4}\b"
ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def date_from_text(text: Column) -> Column:
    """The first written date, or the empty text."""
    return F.regexp_extract(text, TEXT_DATE, 0)


def _written(text: Column) -> Column:
    """'March 5, 2024' as 2024-03-05 for the cast."""
    tidy = F.initcap(F.regexp_replace(text, r"\s+", " "))
    return F.coalesce(F.try_to_timestamp(tidy, F.lit("MMM d, yyyy")), F.try_to_timestamp(tidy, F.lit("MMMM d, yyyy")))


# Hours that named zones of mail headers lie east of Greenwich.
ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
MAIL = r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*[\s-]+(\d{4}|\d{2})\s+(\d{1,2}:\d{2})(:\d{2})?\s*([A-Za-z]{1,3}|[+-]\d{2}:?\d{2})?$"


def mail_datetime(text: Column) -> Column:
    """A time as mail headers and RSS write it ('Tue, 05 Mar 2024 10:00:00 +0100'), in UTC; null if it is none.

    Without a zone, or with one that is not known, it counts as UTC.
    """
    part = lambda k: F.regexp_extract(text, MAIL, k)
    year = F.when(F.length(part(3)) == 4, part(3)).when(part(3).try_cast("int") < 69, F.concat(F.lit("20"), part(3))).otherwise(F.concat(F.lit("19"), part(3)))
    clock = F.concat(part(4), F.when(part(5) == "", F.lit(":00")).otherwise(part(5)))
    local = F.try_to_timestamp(F.concat_ws(" ", part(1), F.initcap(part(2)), year, clock), F.lit("d MMM yyyy H:mm:ss"))
    zone, digits = F.upper(part(6)), F.regexp_replace(part(6), "[^0-9]", "")
    shift = (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")) * F.when(part(6).startswith("-"), -60).otherwise(60)
    for name, hours in ZONES.items():
        shift = F.when(zone == name, F.lit(3600 * hours)).otherwise(shift)
    return F.when(text.rlike(MAIL), F.timestamp_seconds(F.unix_seconds(local) - F.coalesce(shift, F.lit(0))))


def entry_datetime(parsed: Column, published: Column, updated: Column) -> Column:
    """The parsed time, else the published or updated text as ISO, as in mail headers or as a written date, else null.

    Times with an offset are brought to UTC; times without count as UTC.
    """
    text = strip(F.coalesce(F.nullif(published, F.lit("")), updated, F.lit("")))
    zoned = F.when(text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & text.contains(":"), text).otherwise(F.concat(text, F.when(text.contains(":"), F.lit("Z")).otherwise(F.lit(" 00:00:00Z"))))
    iso = F.when(text.rlike(ISO), F.replace(zoned, F.lit(","), F.lit(".")).try_cast("timestamp"))
    written = F.when(text.rlike(r"^[A-Za-z]{3,9} +\d{1,2}, \d{4}$"), _written(text))
    return F.coalesce(parsed, iso, mail_datetime(text), written)


def iso_week(ts: Column) -> Column:
    return F.weekofyear(ts)


def relative(ts: Column, as_of: Column) -> Column:
    """'just now', '5m ago', '3h ago', 'yesterday' or '2d ago'."""
    seconds = F.greatest(F.lit(0), F.unix_seconds(as_of) - F.unix_seconds(ts))
    ago = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(seconds < 3600, ago(60, "m"))
        .when(seconds < 86400, ago(3600, "h"))
        .when(seconds < 2 * 86400, F.lit("yesterday"))
        .otherwise(ago(86400, "d"))
    )
