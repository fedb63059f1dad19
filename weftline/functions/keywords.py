"""Keyword scoring of titles and passages against a literal query."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse

# Words that are no search terms, and forms that are searched as another.
STOP_WORDS = frozenset(
    "about across all and are best compare changed change candidate docs documents did does for from how mentioning "
    "principal published release releases show the update updates what when where which with work would".split()
)
FORMS = {"fixed": "fix", "fixes": "fix", "fixing": "fix"}


def normalized(text: Column) -> Column:
    """Lower case, with hyphens, underscores and slashes as blanks, collapsed."""
    return spaced(F.lower(text))


def spaced(lower: Column) -> Column:
    return collapse(F.regexp_replace(lower, "[-_/]+", " "))


def normalize_query(query: str) -> str:
    return " ".join(re.sub(r"[-_/]+", " ", query.lower()).split())


def query_terms(query: str) -> list[str]:
    """A query's search terms, each once, in order."""
    words = re.findall(r"[a-z0-9+]+", normalize_query(query))
    return list(dict.fromkeys(FORMS.get(w, w) for w in words if len(w) > 2 and w not in STOP_WORDS))


def terms_of(text: Column) -> Column:
    """The same for a column of queries."""
    words = F.filter(F.regexp_extract_all(normalized(text), F.lit("[a-z0-9+]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.array_distinct(F.transform(words, lambda w: reduce(lambda rest, f: F.when(w == f[0], F.lit(f[1])).otherwise(rest), FORMS.items(), w)))


def keyword_score(query: str, title: Column, content: Column) -> Column:
    """Shares of terms in passage and title, and half a point for the whole phrase.

    Terms match anywhere, also within words. Zero for a query without terms.
    """
    terms = query_terms(query)
    if not terms:
        return F.lit(0.0)

    def share(text: Column) -> Column:
        return reduce(lambda a, b: a + b, (F.when(text.contains(t), 1).otherwise(0) for t in terms)).cast("double") / F.lit(float(len(terms)))

    def whole(text: Column) -> Column:
        return reduce(lambda a, b: a & b, (text.contains(t) for t in terms))

    # a term has nothing that blanks replace, so it stands in the lower case as in the normal form
    both = F.struct(F.lower(F.coalesce(title, F.lit(""))).alias("t"), F.lower(F.coalesce(content, F.lit(""))).alias("c"))

    def score(x: Column) -> Column:
        # where the phrase is, all terms are; the normal form is made only there
        found = F.concat(spaced(x["t"]), F.lit("\n"), spaced(x["c"])).contains(normalize_query(query))
        phrase = F.when(whole(x["c"]) | whole(x["t"]), F.when(found, F.lit(0.5)).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))
        return F.round(share(x["c"]) + share(x["t"]) + phrase, 4)

    # a lambda's argument is made once, however many terms look at it
    return F.transform(F.array(both), score)[0]
