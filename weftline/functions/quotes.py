"""Whether quotes stand in their source: runs of shared words, as arrays.

Places where a quote and its source have the same word lie on diagonals (source
place minus quote place); neighbours on a diagonal are runs. Of all runs the
longest counts first, then those before it on both sides and those after it on
both sides, each cut to what is left there. A quote that stands in its source as
it is, is one run: only for others are words looked up, once a source, however
many quotes ask for it.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words a fragment and a quote need, the share that must be found, the shortest run that counts.
FRAGMENT_WORDS, QUOTE_WORDS, COVERAGE, RUN = 2, 3, 0.8, 2
# Fixed patterns: words, and what parts the fragments of a quote.
WORD, ELLIPSIS = re.compile(r"\w+"), re.compile(r"\.\.\.|…")


def folded(texts: tuple[str | None, ...]) -> str:
    return "\n".join(t or "" for t in texts).casefold()


def places(*texts: str | None) -> dict[str, np.ndarray]:
    """Where each word of a source stands."""
    at: dict[str, list[int]] = defaultdict(list)
    for k, word in enumerate(WORD.findall(folded(texts))):
        at[word].append(k)
    return {word: np.array(ks) for word, ks in at.items()}


def runs(words: list[str], at: dict[str, np.ndarray]) -> np.ndarray:
    """(place in the quote, place in the source, length) of every longest run of RUN words or more."""
    none = np.empty(0, np.int64)
    hits = [at.get(w, none) for w in words]
    mine, theirs = np.repeat(np.arange(len(words)), [len(h) for h in hits]), np.concatenate([none, *hits])
    order = np.lexsort((mine, theirs - mine))
    mine, theirs = mine[order], theirs[order]
    heads = np.flatnonzero(np.r_[True, (np.diff(theirs) != 1) | (np.diff(mine) != 1)][: len(mine)])
    size = np.diff(np.r_[heads, len(mine)])
    return np.stack([mine[heads], theirs[heads], size], axis=1)[size >= RUN]


def covered(found: np.ndarray) -> int:
    """Words in runs that follow each other on both sides, the longest taken first, of equal ones the first."""
    total, left = 0, [found]
    while left:
        some = left.pop()
        if not len(some):
            continue
        mine, theirs, size = some.T
        first = np.lexsort((theirs, mine, -size))[0]
        i, j, n = some[first]
        total += int(n)
        ahead = np.minimum(size, np.minimum(i - mine, j - theirs))
        skip = np.maximum(0, np.maximum(i + n - mine, j + n - theirs))
        for part in (np.stack([mine, theirs, ahead], axis=1), np.stack([mine + skip, theirs + skip, size - skip], axis=1)):
            left.append(part[part[:, 2] >= RUN])
    return total


class Source:
    """A text that quotes are looked for in; where its words stand is only made for quotes that are not there as they are."""

    def __init__(self, *texts: str | None):
        self.texts = texts
        # a blank before and after each word, none of which has one
        self.words = f" {' '.join(WORD.findall(folded(texts)))} "
        self.at: dict[str, np.ndarray] | None = None

    def has(self, words: list[str]) -> bool:
        """Whether some words are found to four fifths: all of them in a row are the longest run there can be."""
        if f" {' '.join(words)} " in self.words:
            return True
        if self.at is None:
            self.at = places(*self.texts)
        return covered(runs(words, self.at)) / len(words) >= COVERAGE


def stands_in(source: Source, quote: str | None) -> bool:
    """Whether a quote has enough words, and each of its fragments is found to four fifths."""
    parts = [WORD.findall(p) for p in ELLIPSIS.split((quote or "").casefold())]
    parts = [p for p in parts if len(p) >= FRAGMENT_WORDS]
    return sum(map(len, parts)) >= QUOTE_WORDS and all(map(source.has, parts))


def supported(title: str | None, raw: str | None, quote: str | None) -> bool:
    return stands_in(Source(title, raw), quote)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def quotes_supported(title: pd.Series, raw: pd.Series, quotes: pd.Series) -> pd.Series:
    """For each of a row's quotes, whether it stands in the row's text; null quotes do not."""
    out = []
    for t, r, qs in zip(title, raw, quotes, strict=True):
        source = None if qs is None else Source(t, r)
        out.append(None if qs is None else [stands_in(source, q) for q in qs])
    return pd.Series(out, index=title.index, dtype=object)


def quote_supported(title: Column | str, raw: Column | str, quote: Column | str) -> Column:
    """Column form of ``supported``."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return quotes_supported(col(title), col(raw), F.array(col(quote)))[0]


def demoted(tier: Column, focus: Column, grounded: Column) -> Column:
    """A core article counts as contextual unless its subject is central and its quote is in its text."""
    firm = (focus == "central") & F.coalesce(grounded, F.lit(False))
    return F.when((tier == "core") & ~F.coalesce(firm, F.lit(False)), F.lit("contextual")).otherwise(tier)
