"""RSS and Atom, and what is done to entries before they become candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import entry_datetime
from ..functions.text import compact_excerpt, content_detail, falsy, strip
from .html import clean_html

ITEM = "title string, link string, guid string, id string, description string, summary string, content string, pubDate string, published string, updated string, category array<string>"


def read_feed(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """Entries of RSS files (``item``), or of Atom files (``entry``)."""
    rows = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").option("ignoreNamespace", "true").schema(ITEM).load(path)
    return rows.select(
        "title", F.coalesce("link", "guid", "id").alias("link"), F.coalesce("content", "summary", "description").alias("html"),
        F.coalesce("published", "pubDate").alias("published"), "updated", F.coalesce("category", F.array().cast("array<string>")).alias("tags"),
    )


_RSS = "struct<title:string,link:string,guid:string,description:string,encoded:string,pubDate:string,date:string,category:array<string>>"
_ATOM = "struct<title:struct<_VALUE:string>,link:array<struct<_href:string,_rel:string>>,id:string,summary:struct<_VALUE:string>,content:struct<_VALUE:string>,published:string,updated:string,category:array<struct<_term:string>>>"


def parse_feeds(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Entries of RSS and Atom documents held in a column, one row each; a document without any is an error."""
    rss = F.from_xml(F.col(xml), f"channel struct<item: array<{_RSS}>>, item array<{_RSS}>", {"ignoreNamespace": "true"})
    atom = F.from_xml(F.col(xml), f"entry array<{_ATOM}>", {"ignoreNamespace": "true"})
    none = F.array().cast("array<string>")

    def item(x: Column) -> Column:
        text = F.coalesce(F.nullif(x["encoded"], F.lit("")), x["description"])
        return F.struct(
            x["title"].alias("title"), F.coalesce(x["link"], x["guid"]).alias("link"), x["description"].alias("description"), text.alias("html"),
            F.coalesce(x["pubDate"], x["date"]).alias("published"), F.lit(None).cast("string").alias("updated"), F.coalesce(x["category"], none).alias("tags"),
        )

    def entry(x: Column) -> Column:
        first = F.filter(x["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
        summary, content = x["summary"]["_VALUE"], x["content"]["_VALUE"]
        return F.struct(
            x["title"]["_VALUE"].alias("title"), F.coalesce(F.try_element_at(first, F.lit(1))["_href"], x["id"]).alias("link"), summary.alias("description"),
            F.coalesce(F.nullif(content, F.lit("")), summary).alias("html"), x["published"].alias("published"), x["updated"].alias("updated"),
            F.coalesce(F.transform(x["category"], lambda c: c["_term"]), none).alias("tags"),
        )

    found = feeds.withColumn("_rss", rss).withColumn("_atom", atom)
    kinds = [F.transform(F.col("_rss")["channel"]["item"], item), F.transform(F.col("_rss")["item"], item), F.transform(F.col("_atom")["entry"], entry)]
    found = found.withColumn("_items", F.coalesce(*(F.when(F.size(k) > 0, k) for k in kinds)))
    others = [c for c in feeds.columns if c != xml]
    error = F.when(F.col("_items").isNull(), F.lit("could not parse feed")).alias("error")
    return found.select(*others, error, F.posexplode_outer("_items").alias("position", "entry")).select(*others, "error", "position", "entry.*")


def entry_html(content: Column, summary: Column, description: Column) -> Column:
    """An entry's content, else its summary, else its description, else nothing."""
    return F.coalesce(content, F.nullif(summary, F.lit("")), F.nullif(description, F.lit("")), F.lit(""))


def term_pattern(term: str) -> str:
    """A term that stands alone; its blanks match any white space."""
    words = [rf"\Q{w}\E" for w in term.strip().lower().split()]
    return rf"(?U)(?<![a-z0-9]){r'\s+'.join(words)}(?![a-z0-9])" if words else r"(?!)"


def contains_term(text: Column, term: str) -> Column:
    return text.rlike(term_pattern(term))


def matches_source(title: Column, tags: Column, text: Column, *, prefixes: list[str] = (), excluded: list[str] = (), terms: list[str] = ()) -> Column:
    """A source's filter: no excluded title start, no excluded tag, any of the terms if there are some."""
    low = F.lower(strip(F.coalesce(title, F.lit(""))))
    bad = [low.startswith(p.strip().lower()) for p in prefixes]
    gone = {t.strip().lower() for t in excluded}
    if gone:
        bad.append(F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(strip(t)).isin(*gone)))
    whole = F.lower(F.concat(low, F.lit(" "), F.coalesce(text, F.lit(""))))
    good = reduce(lambda a, b: a | b, (contains_term(whole, t) for t in terms)) if terms else F.lit(True)
    return good & ~F.coalesce(reduce(lambda a, b: a | b, bad, F.lit(False)), F.lit(False))


def capped(entries: DataFrame, most: int, source: str = "source_name", position: str = "position") -> DataFrame:
    """The first ``most`` entries of each source."""
    nth = F.row_number().over(Window.partitionBy(source).orderBy(position))
    return entries.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")


def dated(entries: DataFrame, required: Column) -> DataFrame:
    """Entries with their time; those of a source that requires one go without it."""
    with_time = entries.withColumn("published_at", entry_datetime(F.lit(None).cast("timestamp"), F.col("published"), F.col("updated")))
    return with_time.where(F.col("published_at").isNotNull() | ~F.coalesce(required, F.lit(False)))


def candidates(entries: DataFrame, fetched_at: Column) -> DataFrame:
    """Entries as candidates: title, text, digest, detail and excerpt.

    ``entries``: source_name, title, link, html, published_at, extraction_status.
    """
    titled = entries.withColumn("title", strip(falsy(F.col("title"), F.lit("Untitled update")))).withColumn("body_text", clean_html("html"))
    raw = strip(F.concat(F.col("title"), F.lit("\n\n"), F.col("body_text")))
    out = titled.withColumn("raw_text", raw).withColumn("content_hash", F.sha2(F.encode("raw_text", "UTF-8"), 256))
    return out.select(
        "source_name", F.col("link").alias("raw_url"), "title", "raw_text", "content_hash", "published_at", fetched_at.alias("fetched_at"),
        F.coalesce("extraction_status", F.lit("source_entry")).alias("extraction_status"),
        content_detail(F.col("title"), F.col("raw_text")).alias("content_detail"),
        compact_excerpt(falsy(F.col("body_text"), F.col("title"))).alias("excerpt"),
    )


