"""Text expressions: white space, excerpts, shortening, sentences, detail, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the excerpt and of what counts as sparse.
EXCERPT_LIMIT = 420
SPARSE_WORDS, SPARSE_SENTENCES, SENTENCE_WORDS = 50, 2, 6
IMPORTANT_SPARSE_EVENTS = ("alert", "security-issue", "breaking-change", "deprecation", "incident")
INSUFFICIENT = (
    "context does not include",
    "context does not provide",
    "evidence is missing",
    "insufficient evidence",
    "not provided in the context",
    "no information about",
    "cannot be determined from the context",
)
#: White space, as (?U)\\s has it.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: From a run's first word character to its last; the run may hold + # . and - besides.
WORD = r"(?U)\w(?:[\w+#.-]*\w)?"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(WHITE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def collapse(text: Column) -> Column:
    """White space runs as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def falsy(value: Column, fallback: Column) -> Column:
    """``fallback`` where ``value`` is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), fallback)


def compact_excerpt(text: Column, limit: int = EXCERPT_LIMIT) -> Column:
    """Collapsed text; beyond the limit its first limit - 1 characters and three dots."""
    flat = collapse(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("...")))


def body(title: Column, raw: Column) -> Column:
    """The text after the title it starts with, stripped."""
    cut = F.when((F.length(title) > 0) & raw.startswith(title), raw.substr(F.length(title) + 1, F.length(raw))).otherwise(raw)
    return strip(cut)


def article_excerpt(title: Column, raw: Column) -> Column:
    return compact_excerpt(F.when(F.length(title) > 0, falsy(body(title, raw), title)).otherwise(falsy(raw, title)))


def shorten(text: Column, limit: int) -> Column:
    """At most ``limit`` characters; cut at a blank unless that loses over half, then three dots."""
    room = limit - 3
    head = rstrip(F.substring(text, 1, room))
    last = F.length(head) - F.instr(F.reverse(head), " ")  # characters before the last blank
    has = F.instr(head, " ") > 0
    cut = F.when(has & (last >= max(room // 2, 1)), rstrip(head.substr(F.lit(1), last))).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("...")))


def shorten_reason(text: Column, limit: int = 480) -> Column:
    """Cut at the last blank, wherever it is, then three dots."""
    head = F.substring(text, 1, limit - 3)
    blank = F.instr(F.reverse(head), " ")
    cut = rstrip(F.when(blank > 0, head.substr(F.lit(1), F.length(head) - blank)).otherwise(head))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("...")))


def clean_text(value: Column, fallback: Column, limit: int) -> Column:
    flat = collapse(F.coalesce(value, F.lit("")))
    return F.when(flat != "", shorten(flat, limit)).otherwise(fallback)


def clean_list(values: Column, fallback: Column, count: int, limit: int) -> Column:
    """The first ``count`` items that are not blank, each shortened; else the fallback."""
    flat = F.transform(F.filter(values, lambda x: collapse(x) != ""), lambda x: shorten(collapse(x), limit))
    return F.when(F.size(F.coalesce(flat, F.array().cast("array<string>"))) > 0, F.slice(flat, 1, count)).otherwise(fallback)


def content_detail(title: Column, raw: Column) -> Column:
    """``sparse`` below 50 words or two sentences of six words, else ``detailed``.

    A sentence's end is white space or comes before it, so no word is cut and
    the body's words are the sum of its sentences'.
    """
    parts = F.split(body(title, raw), r"(?U)(?<=[.!?])\s+|\n+")

    def add(a: Column, s: Column) -> Column:
        n = F.regexp_count(s, F.lit(WORD))
        return F.struct((a["words"] + n).alias("words"), (a["long"] + F.when(n >= SENTENCE_WORDS, 1).otherwise(0)).alias("long"))

    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("long"))
    sparse = F.aggregate(parts, start, add, lambda a: (a["words"] < SPARSE_WORDS) | (a["long"] < SPARSE_SENTENCES))
    return F.when(sparse, F.lit("sparse")).otherwise(F.lit("detailed"))


def sentences(title: Column, raw: Column) -> Column:
    """The body's sentences, white space collapsed."""
    return F.split(collapse(body(title, raw)), r"(?<=[.!?])\s+")


def fallback_summary(title: Column, raw: Column) -> Column:
    """The body's first two sentences, or the title."""
    return shorten(falsy(F.array_join(F.slice(sentences(title, raw), 1, 2), " "), title), 500)


def fallback_points(title: Column, raw: Column) -> Column:
    """The body's first three sentences."""
    first = F.filter(F.slice(sentences(title, raw), 1, 3), lambda s: s != "")
    return F.transform(first, lambda s: shorten(s, 160))


def citation_numbers(answer: Column) -> Column:
    """The numbers in square brackets, in order, repeats included."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("long"))


def valid_citations(answer: Column, context: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(citation_numbers(answer), lambda x: x.between(F.lit(1), context))))


def insufficient(answer: Column) -> Column:
    """Whether an answer says that the evidence does not suffice."""
    return collapse(F.lower(answer)).rlike("|".join(INSUFFICIENT))


def citation_warnings(answer: Column, context: Column) -> Column:
    """A warning for each unknown number, in order, and one for an answer without evidence."""
    unknown = F.array_sort(F.array_distinct(F.filter(citation_numbers(answer), lambda x: ~x.between(F.lit(1), context))))
    some = F.transform(unknown, lambda x: F.concat(F.lit("Answer referenced unknown citation ["), x.cast("string"), F.lit("].")))
    none = (strip(answer) != "") & (F.size(valid_citations(answer, context)) == 0) & ~insufficient(answer)
    return F.concat(some, F.when(none, F.array(F.lit("Answer did not reference any retrieved evidence."))).otherwise(F.array().cast("array<string>")))


def compares(question: Column) -> Column:
    """Whether a question asks to compare."""
    return question.rlike(r"(?i)\b(?:compare|comparison|versus|vs\.?|across)\b")
