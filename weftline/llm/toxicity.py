"""Toxicity by a weighted finite-state pattern grammar.

Five transducers, each reading what the one before wrote:

- the lexical one reads words and writes symbols: insults (a lexicon of words
  and word beginnings learned from labelled rows, each with its log-odds),
  threats (fixed phrases of several words), targets, negations, reporting verbs;
- the two target transducers, one from right to left and one from left to right,
  write an insult or threat near a target as a targeted one;
- the negation transducer writes one soon after a negation as a negated one;
- the reported-speech transducer writes one after a reporting verb as reported.

Those from left to right are composed into one machine. A clause scores the sum
of its matches, each the weight of its entry times those of its marks; clauses
without a match score nothing. The marks' weights are fitted, with a prior, on
labelled texts that the lexicon has not seen; a logistic curve over the
document's clause scores, fitted with them, gives the score. Nothing else about
a text enters it: a text without a match has the score of the empty one.

Training looks at a bounded sample of labelled rows (``labelled.PER_CLASS`` of
each class, ``labelled.SAMPLE_BYTES`` of each); scoring at every clause of every
text.

Defined results: null and empty texts have no clause and get the score of such
a text; without labels of both classes every score is 0.5 or the one class's;
a null doc_id has remainder 0, so it is held out; repeated rows get equal
scores; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .labelled import Curve, remainder, sample

FOLDS, HELD, LIMIT = 5, 0, 0.5
#: Symbols: four plain ones, then matches by kind (insult, threat) and marks.
OTHER, TARGET, NEGATION, REPORT, INSULT, THREAT = 0, 1, 2, 3, 4, 12
TARGETED, NEGATED, REPORTED = 1, 2, 4
MATCHES = 16
SYMBOLS = INSULT + MATCHES
#: Fixed phrase and word lists, in four languages.
THREATS = [
    "kill you", "kill your", "kill him", "kill her", "kill them", "hurt you", "hurt him", "hurt her", "hurt them", "beat you", "burn you", "shoot you", "stab you", "destroy you",
    "find you and", "know where you live", "watch your back", "make you pay", "make you suffer", "you will pay", "you will regret", "deserve to die", "hope you die", "go and die",
    "te tuer", "vous tuer", "vais te frapper", "tu vas payer", "tu vas mourir", "je sais où tu habites",
    "dich töten", "dich umbringen", "bringe dich um", "dich schlagen", "weiß wo du wohnst", "wirst du bezahlen",
    "voy a matar", "te mato", "matarte", "voy a golpear", "vas a pagar", "sé dónde vives",
]
TARGETS = "you your yours they them he him she her toi vous tu du ihr dich euch te ustedes ellos".split()
NEGATIONS = "not never no nobody isn't aren't don't doesn't wasn't pas jamais nicht kein keine nunca tampoco".split()
REPORTS = "said says called calls wrote writes claimed reported quoted dit écrit sagte schrieb dijo escribió".split()
WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
BETWEEN = re.compile(r"[.!?;:\n]")
#: A lexicon entry needs so many different toxic texts and so high log-odds.
LEAST, ODDS = 4, 2.5
#: Letters of a word beginning in the lexicon; whole words have any length.
SHORTEST, LONGEST_STEM = 4, 8
#: Weight of a threat among the lexicon's log-odds, and what each mark, and a threat, multiplies a weight with before labels are seen.
THREAT_WEIGHT, PRIOR = 4.0, np.log([1.25, 0.4, 0.5, 1.0])
#: Steps in which the marks' weights are searched (logarithms), and the spread of their prior.
STEPS, SPREAD = (-1.6, -0.8, -0.4, 0.0, 0.4, 0.8), 1.0
#: Words whose symbols a worker remembers.
SEEN = 50_000


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer over symbols: arcs[state][symbol] = (next state, symbol written)."""

    arcs: tuple[tuple[tuple[int, int], ...], ...]

    def __rshift__(self, other: Transducer) -> Transducer:
        """Composition: ``other`` reads what this one writes; states pair up."""
        n = len(other.arcs)

        def arc(a: tuple[int, int], row: tuple[tuple[int, int], ...]) -> tuple[int, int]:
            to, written = row[a[1]]
            return a[0] * n + to, written

        return Transducer(tuple(tuple(arc(a, second) for a in first) for first, second in product(self.arcs, other.arcs)))

    def run(self, symbols: bytes | bytearray) -> bytearray:
        state, arcs, out = 0, self.arcs, bytearray(len(symbols))
        for k, s in enumerate(symbols):
            state, out[k] = arcs[state][s]
        return out


def marker(trigger: int, reach: int | None, mark: int) -> Transducer:
    """Matches up to ``reach`` symbols after a trigger are written with a mark; without ``reach``, to the end."""

    def arc(left: int, s: int) -> tuple[int, int]:
        after = (reach or 1) if s == trigger else left if reach is None else max(left - 1, 0)
        return after, INSULT + (s - INSULT | mark) if left and s >= INSULT else s

    return Transducer(tuple(tuple(arc(left, s) for s in range(SYMBOLS)) for left in range((reach or 1) + 1)))


#: Read from right to left: a target may follow what is said of it.
TARGET_AFTER = marker(TARGET, 2, TARGETED)
GRAMMAR = marker(TARGET, 5, TARGETED) >> marker(NEGATION, 3, NEGATED) >> marker(REPORT, None, REPORTED)
MARKS = dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT)
PHRASES: dict[str, list[tuple[str, ...]]] = {}
for _p in THREATS:
    PHRASES.setdefault(_p.split()[0], []).append(tuple(_p.split()))


def marked(symbols: bytes | bytearray) -> bytearray:
    """A clause's symbols after all transducers."""
    back = TARGET_AFTER.run(symbols[::-1])
    return GRAMMAR.run(back[::-1])


def stems(word: str) -> Iterator[str]:
    """What a word may be listed under: itself (ended by a blank), then its beginnings, longest first."""
    yield word + " "
    for k in range(min(LONGEST_STEM, len(word)), SHORTEST - 1, -1):
        yield word[:k]


def tally(texts: list[str], toxic: list[int]) -> tuple[Counter, Counter]:
    """In how many different texts that are not toxic, and that are, words and word beginnings occur."""
    counts = Counter(), Counter()
    for t, y in set(zip(texts, toxic, strict=True)):
        counts[y].update({s for w in set(WORDS.findall(t.lower())) for s in stems(w)})
        counts[y][""] += 1
    return counts


def learn(counts: tuple[Counter, Counter], but: tuple[Counter, Counter] = (Counter(), Counter()), least: int = LEAST) -> dict[str, float]:
    """Log-odds of words and word beginnings that toxic texts have and others have not.

    Counts in ``but`` are left out. Frequent words that a listed beginning would
    catch by mistake are listed with weight 0.
    """

    def seen(s: str, y: int) -> int:
        return counts[y][s] - but[y][s]

    def odds(s: str) -> float:
        return math.log((seen(s, 1) + 0.5) / (seen("", 1) + 1)) - math.log((seen(s, 0) + 0.5) / (seen("", 0) + 1))

    found = {s: o for s, n in counts[1].items() if s and n >= least and seen(s, 1) >= least and (o := odds(s)) >= ODDS}
    for s, n in counts[0].items():
        if s and s[-1] == " " and n >= least and s not in found and any(p in found for p in stems(s[:-1])) and seen(s, 0) >= least and odds(s) < ODDS:
            found[s] = 0.0
    return found


class Grammar:
    """The transducers with a lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.finder = self.seen = None

    def __getstate__(self) -> dict:
        return {"lexicon": self.lexicon}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["lexicon"])

    def ready(self) -> None:
        import ahocorasick

        self.finder, self.seen = ahocorasick.Automaton(), {}
        for s in {*(s.strip() for s, w in self.lexicon.items() if w > 0), *PHRASES}:
            self.finder.add_word(s, len(s))
        self.finder.make_automaton()

    def symbol(self, word: str) -> tuple[int, float]:
        """A word's symbol and weight, by its longest entry."""
        if (hit := self.seen.get(word)) is None:
            w = next((self.lexicon[s] for s in stems(word) if s in self.lexicon), 0.0)
            hit = (INSULT, w) if w > 0 else (MARKS.get(word, OTHER), 0.0)
            if len(self.seen) > SEEN:
                self.seen.clear()
            self.seen[word] = hit
        return hit

    def symbols(self, text: str, begin: int, end: int) -> tuple[bytearray, dict[int, float]]:
        """The lexical transducer: a clause's symbols, and the weights of its matches by place.

        The first word of a threat's phrase is written as the threat, the others as what they are.
        """
        out, weight = bytearray(), {}
        open_: list[tuple[int, tuple[str, ...], int]] = []  # phrases begun: place, words, how many were read
        for m in WORDS.finditer(text, begin, end):
            word, place = m.group(), len(out)
            s, w = self.symbol(word)
            out.append(s)
            if w:
                weight[place] = w
            if open_:
                open_ = [(at, p, n + 1) for at, p, n in open_ if p[n] == word]
            if word in PHRASES:
                open_ += [(place, p, 1) for p in PHRASES[word]]
            for at, p, n in open_:
                if n == len(p):
                    out[at], weight[at] = THREAT, THREAT_WEIGHT
            if open_:
                open_ = [x for x in open_ if x[2] < len(x[1])]
        return out, weight

    def clauses(self, text: str) -> Iterator[tuple[int, int, list[tuple[int, float]]]]:
        """(start, end, [(match's symbol less INSULT, weight)]) of the lower-cased text's clauses that match.

        Places between clauses are found as the search goes on, so a text needs no more memory than its longest clause's symbols.
        """
        if self.finder is None:
            self.ready()
        if not text or not len(self.finder):
            return
        between = BETWEEN.finditer(text)
        begin, end = 0, -1
        done = -1
        for at, size in self.finder.iter(text):
            start = at - size + 1
            if start < done or start and text[start - 1].isalpha():
                continue
            while end < start:  # the clause that holds the match
                begin, end = end + 1, next((m.start() for m in between), len(text))
            done = end
            symbols, weight = self.symbols(text, begin, end)
            if weight:
                read = marked(symbols)
                yield begin, end, [(read[k] - INSULT, w) for k, w in weight.items()]

    def sums(self, text: str) -> np.ndarray:
        """For each kind of match: sum and largest clause sum of its weights, count; and how many words the text has."""
        low = text.lower()
        out = np.zeros(3 * MATCHES + 1)
        for _, _, found in self.clauses(low):
            here: dict[int, float] = {}
            for c, w in found:
                here[c] = here.get(c, 0.0) + w
                out[2 * MATCHES + c] += 1
            for c, w in here.items():
                out[c] += w
                out[MATCHES + c] = max(out[MATCHES + c], w)
        out[-1] = low.count(" ") + low.count("\n") + 1
        return out


def factors(weights: np.ndarray) -> np.ndarray:
    """What each kind of match multiplies its weight with: targeted, negated, reported, threat."""
    kind = np.arange(MATCHES)
    return np.exp(sum(w * (kind >> k & 1) for k, w in enumerate(weights)))


def features(sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum, largest, count and densities of the weighted matches."""
    f = factors(weights)
    total, most, count, n = sums[:, :MATCHES] @ f, (sums[:, MATCHES : 2 * MATCHES] * f).max(axis=1, initial=0.0), sums[:, 2 * MATCHES : 3 * MATCHES] @ np.minimum(f, 1), sums[:, -1]
    return np.stack([np.log1p(total), most, np.log1p(count), np.log1p(100 * total / n), np.sqrt(total / np.sqrt(n)), np.minimum(total, 1.0)], axis=1)


class Model:
    """The grammar with its learned lexicon, its marks' weights, and the curve."""

    def __init__(self, rows: list, counts: tuple[int, int]):
        texts, y = [r["text"] for r in rows], [r["label"] for r in rows]
        # weights and curve are fitted on matches of lexicons that have not seen the text
        folds = [tally(texts[f::4], y[f::4]) for f in range(4)]
        whole = tuple(sum((f[k] for f in folds), Counter()) for k in (0, 1))
        part = [Grammar(learn(whole, f, LEAST - 1)) for f in folds]
        sums = np.array([part[k % 4].sums(t) for k, t in enumerate(texts)], float).reshape(-1, 3 * MATCHES + 1)
        label = np.array(y, float)
        self.trained = len(set(y)) == 2
        self.weights = PRIOR.copy()
        self.curve = Curve(features(sums, self.weights), label, counts)

        def cost(curve: Curve, weights: np.ndarray) -> float:
            return curve.loss + float(((weights - PRIOR) ** 2).sum()) / (2 * SPREAD**2)

        for _ in range(3):  # one weight at a time
            before = self.weights.copy()
            for k in range(len(self.weights)):
                for step in STEPS:
                    tried = self.weights.copy()
                    tried[k] = before[k] + step
                    curve = Curve(features(sums, tried), label, counts)
                    if cost(curve, tried) < cost(self.curve, self.weights) - 1e-6:
                        self.curve, self.weights = curve, tried
            if np.array_equal(before, self.weights):
                break
        self.grammar = Grammar(learn(whole))

    def score(self, texts: Iterable[str]) -> np.ndarray:
        """Scores of texts, which are gone through one by one."""
        sums = np.array([self.grammar.sums(t) for t in texts], float).reshape(-1, 3 * MATCHES + 1)
        return self.curve(features(sums, self.weights))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return Model(*sample(docs, labels, "toxic", FOLDS, HELD))


def scores_of(model: Model, b: pa.RecordBatch) -> np.ndarray:
    return model.score(t.as_py() or "" for t in b.column("text"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scores_of(model, b)
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(found), pa.array((found >= LIMIT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    src = docs.select(F.col("doc_id").cast("long"), (remainder(FOLDS) == HELD).alias("held_out"), F.col("text").cast("string"))
    return small_batches(src).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; all where labels lack a class, as nothing was learned then."""
    if not model.trained:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores_of(model, b) < LIMIT))

    return small_batches(docs).mapInArrow(run, docs.schema)
