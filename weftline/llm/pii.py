"""Personal data: base patterns, and spans added by weak supervision.

Base spans are what four patterns match, leftmost first. Looser patterns propose
further spans: e-mail addresses that are spelled out, addresses of IP version 6
or with bracketed dots, numbers that may be phones or cards. Labelers vote on
every span, base or proposed, for, against or not at all: the span's shape, a
gazetteer (top-level domains, networks, card issuers, country codes), words
before it, its check digits, and what touches it. Counts of the vote patterns,
with how many digits and which separators the spans have, are a few hundred rows
whatever the input. Expectation-maximisation over the votes estimates how
reliable each labeler is; the span classifier is a logistic curve fitted to the
resulting beliefs, which looks at the digits and separators too, as no labeler
does. Proposed spans that it accepts are added; base spans stay.

Everything that touches a text is a SQL expression. Positions come from the
lengths of matches and of what lies between them, summed in a logarithm of their
number many steps; what stands around a span is cut from a block of the text.
The patterns never back off over what they have read. So a text costs its length
and its spans times the logarithm of their number, whatever it is made of.

Defined results: null and empty texts have no spans; a null doc_id is kept;
repeated rows get equal spans; an empty table gives an empty result; extra
columns are ignored, and kept as they are by ``redacted``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_of, rows_again, stored, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: A match starts where the one before ended, or where a run of its characters does.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of digits with single separators, 12 to 19 digits long.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
#: Proposals: an address spelled out; a number written like a phone's.
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?)[A-Za-z0-9-]++)++"
LOOSE = r"(?<![0-9A-Za-z+.,(-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20.-][0-9]{2,5}){2,4}+(?![0-9A-Za-z]|[.,-][0-9])"
#: Version 6, whole or with one gap; version 4 with its dots in brackets.
HEXES = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:]|\.[0-9])"
FANGLESS = r"(?<![0-9.\]])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9]|\[\.\])"
# Top-level domains, country codes of telephone numbers, first digits of card issuers, networks of special use.
DOMAINS = (
    "com|org|net|edu|gov|mil|int|info|biz|name|io|ai|app|dev|me|tv|co|cc|xyz|online|site|shop|blog|cloud|tech|eu|de|at|ch|fr|be|lu|nl|es|pt|it|uk|ie|us|ca|mx|br|ar|cl|pe|ve|uy|py|bo|ec|cr|"
    "pl|cz|sk|hu|ro|bg|gr|tr|ru|ua|by|lt|lv|ee|fi|se|no|dk|is|si|hr|rs|ba|mk|al|md|ge|am|az|kz|il|ae|sa|qa|kw|eg|ma|tn|dz|ng|ke|gh|za|et|in|pk|bd|lk|np|cn|hk|tw|jp|kr|th|vn|my|sg|id|ph|au|nz"
)
COUNTRIES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-368]|22[0-9]|23[0-9]|24[0-9]|25[0-8]|26[0-9]|29[017-9]|35[0-9]|37[0-8]|38[0-9]|42[013]|50[0-9]|59[0-9]|67[02-9]|68[0-9]|69[0-2]|85[02356]|88[06]|96[0-8]|97[0-9]|99[2-68]"
ISSUERS = "4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|30[0-5]|3[68]|35(?:2[89]|[3-8])|6011|64[4-9]|65|62|50|5[6-9]|6[37]"
NETWORKS = r"10\.|127\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\."
# Fixed word lists: what stands before such spans, and before others, in four languages.
BEFORE = {
    "email": ("e?mail|contact|write|reach|send|address|schreib\\w*|kontakt|adresse|courriel|écri\\w*|contacter|correo|escrib\\w*|contacto|dirección", "twitter|user|handle|nutzer|utilisateur|usuario"),
    "ip": ("ip|host|server|address|login|gateway|network|rechner|netz\\w*|adresse|serveur|hôte|réseau|servidor|red|dirección", "version|section|chapter|release|kapitel|abschnitt|chapitre|capítulo|versión"),
    "card": ("card|visa|mastercard|amex|maestro|credit|debit|karte|kreditkarte|carte|bancaire|tarjeta|crédito|débito", "order|invoice|isbn|serial|tracking|id|rechnung|bestellung|auftrag|facture|commande|factura|pedido"),
    "phone": ("tel|phone|call|fax|mobile|cell|whatsapp|telefon|handy|ruf\\w*|anruf\\w*|téléphone|portable|appel\\w*|teléfono|móvil|llam\\w*", "order|invoice|isbn|serial|version|id|rechnung|bestellung|facture|commande|factura|pedido"),
}
#: Labelers, and which of them tests check digits: it starts out as the one to trust.
LABELERS, CHECK = 5, 3
#: Beliefs from which a proposed span is added, and the letters before a span that count.
LIMIT, WINDOW = 0.5, 32
#: Code points of the blocks that parts of a text are cut from.
BLOCK = 256
ROUNDS = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scanned(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The array of each element combined with all before it, in a logarithm of its length many steps."""
    steps = F.array(*(F.lit(1 << k) for k in range(31)))

    def run(v: Column) -> Column:
        step = lambda a, far: F.transform(a, lambda x, i: F.when(i >= far, combine(F.get(a, i - far), x)).otherwise(x))
        return F.aggregate(F.filter(steps, lambda far: far < F.size(v)), v, step)

    return let(values, run)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: code-point positions and text of all matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr("cast(array() as array<struct<s:bigint,e:bigint,m:string>>)")

    def placed(m: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), 1, F.size(m))
        ends = scanned(F.zip_with(between, m, lambda b, x: (F.length(b) + F.length(x)).cast("long")), lambda x, y: x + y)
        return F.zip_with(ends, m, lambda e, x: F.struct((e - F.length(x)).alias("s"), e.alias("e"), x.alias("m")))

    return let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))


def blocks(text: Column) -> Column:
    """A text in runs of BLOCK code points, from which parts are cut without walking the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part(cut: Column, start: Column, size: Column) -> Column:
    """So many code points from a place on, of a text in blocks; places from 0."""
    first = F.floor(start / BLOCK).cast("int")
    many = F.floor((start + size - 1) / BLOCK).cast("int") - first + 1
    within = (start - first.cast("long") * BLOCK).cast("int")
    return F.when(size > 0, F.array_join(F.slice(cut, first + 1, many), "").substr(within + 1, size.cast("int"))).otherwise(F.lit(""))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    d = F.reverse(digits(m))

    def add(total: Column, k: Column) -> Column:
        x = F.ascii(d.substr(k, F.lit(1))) - 48
        doubled = F.when(k % 2 == 0, x * 2).otherwise(x)
        return total + doubled - F.when(doubled > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add) % 10 == 0


def only_if(sign: Column, spans: Column) -> Column:
    """Spans where a cheap sign is in the text at all."""
    return F.when(sign, spans).otherwise(F.expr("cast(array() as array<struct<s:bigint,e:bigint,m:string>>)"))


def base_spans(text: Column) -> dict[str, Column]:
    """Each kind's base spans."""
    count = lambda x: F.length(digits(x["m"]))
    return {
        "email": only_if(text.contains("@"), matches(text, EMAIL)),
        "ip": only_if(text.rlike(r"[0-9]\.[0-9]"), F.filter(matches(text, IP), lambda x: x["m"].rlike(OCTETS))),
        "card": only_if(text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), F.filter(matches(text, CARD), lambda x: luhn(x["m"]))),
        "phone": only_if(text.contains("+"), F.filter(matches(text, PHONE), lambda x: count(x).between(9, 15))),
    }


def proposals(text: Column) -> dict[str, Column]:
    """Each kind's proposed spans; base spans may be among them."""
    return {
        "email": only_if(text.contains("at]") | text.contains("at)"), matches(text, SPELLED)),
        "ip": only_if(text.contains("::") | text.contains("[.]") | text.rlike("(?:[0-9A-Fa-f]{1,4}:){7}"), matches(text, f"(?:{HEXES}|{FANGLESS})")),
        "card": only_if(text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), matches(text, CARD)),
        "phone": only_if(text.rlike(r"[0-9]\)?[\x20.-][0-9]{2,5}[\x20.-][0-9]"), F.filter(matches(text, LOOSE), lambda x: F.length(digits(x["m"])).between(7, 15))),
    }


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def votes(kind: str, cut: Column, x: Column) -> Column:
    """The labelers' votes on a span, as a string of +, - and 0; then its form:
    half its digits (9 at most) and the first of its separators."""
    m = x["m"]
    d = digits(m)
    before = F.lower(part(cut, F.greatest(x["s"] - WINDOW, F.lit(0)), F.least(x["s"], F.lit(WINDOW))))
    after = part(cut, x["e"], F.lit(1))
    never = F.lit(False)
    if kind == "email":
        shape = vote(m.rlike(r"^[^@]{1,64}@[^@]+\.[A-Za-z]{2,}$"), m.rlike(r"@.*\.[0-9]+$"))
        names = vote(m.rlike(rf"(?i)(?:\.|dot\W{{1,2}})(?:{DOMAINS})$"), never)
        check = vote(never, m.rlike(r"^[._%+-]|\.\.|[.-]@"))
    elif kind == "ip":
        six, four = m.contains(":"), F.regexp_replace(m, r"[\[\]]", "")
        groups = F.size(F.filter(F.split(m, ":"), lambda g: g != ""))
        shape = vote(four.rlike(r"^[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}$") | (six & (groups >= 4)), four.rlike(r"^0+[0-9]|\.0[0-9]") | (six & (groups < 3) & ~m.startswith("::") & ~m.contains("::1")))
        names = vote(four.rlike(f"^(?:{NETWORKS})") | m.rlike(r"(?i)^(?:fe[89ab]|f[cd]|2[0-9a-f]{3}:|::1$)"), four.rlike(r"^[0-9]\.[0-9]\.[0-9]\.[0-9]$"))
        valid = four.rlike(OCTETS) | (six & (groups <= 8) & (F.size(F.split(m, "::")) <= 2))
        check = vote(valid, ~valid)
    elif kind == "card":
        shape = vote(m.rlike(r"^[0-9]{15,16}$|^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), m.rlike(r"[\x20-][0-9]{1,2}[\x20-]"))
        names = vote(d.rlike(f"^(?:{ISSUERS})"), d.rlike("^[01]"))
        check = vote(luhn(m), ~luhn(m))
    else:
        shape = vote(m.rlike(r"^\+|^\([0-9]{2,5}\)"), m.rlike(r"^[0-9]{4}([\x20.-])[0-9]{2}\1[0-9]{2}$"))
        names = vote(d.rlike("^(?:0[1-9]|[2-9][0-9]{9}$)") | (m.startswith("+") & d.rlike(f"^(?:{COUNTRIES})")), d.rlike("^(?:19|20)[0-9]{6}$"))
        check = vote(F.length(d).between(10, 13), F.length(d) < 8)
    good, bad = BEFORE[kind]
    near = vote(before.rlike(rf"(?:^|\W)(?:{good})\b"), before.rlike(rf"(?:^|\W)(?:{bad})\b"))
    edge = vote(after.rlike(r"^(?:[\s.,;:!?)]|$)"), after.rlike(r"^[A-Za-z0-9_]"))
    mark = lambda v: F.element_at(F.array(F.lit("-"), F.lit("0"), F.lit("+")), v + 2)
    separator = F.when(m.rlike(r"[\[\](]"), F.lit("b")).when(m.contains(" "), F.lit("s")).when(m.contains("-"), F.lit("d")).when(m.contains("."), F.lit("p")).otherwise(F.lit("n"))
    return F.concat(*(mark(v) for v in (shape, names, near, check, edge)), F.least(F.lit(9), F.floor(F.length(d) / 2)).cast("string"), separator)


SPAN = "struct<s:bigint,k:int,e:bigint,base:boolean,votes:string>"


def spans(text: Column) -> Column:
    """array<struct<s, k, e, base, votes>> of a text's base and proposed spans, by start.

    Proposed spans that touch a base span of any kind are left out.
    """

    def marked(found: dict[str, Column], is_base: bool) -> list[Column]:
        mark = lambda k: lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(is_base).alias("base"), x["m"].alias("m"))
        return [F.transform(v, mark(KINDS.index(kind))) for kind, v in found.items()]

    def free(every: Column) -> Column:
        """Base spans, and those proposals that end before the next base span starts and start after those before have ended."""
        far = F.lit((1 << 62))
        ended = scanned(F.transform(every, lambda x: F.when(x["base"], x["e"]).otherwise(F.lit(0).cast("long"))), F.greatest)
        starts = F.reverse(scanned(F.reverse(F.transform(every, lambda x: F.when(x["base"], x["s"]).otherwise(far))), F.least))
        beside = F.zip_with(every, F.arrays_zip(ended.alias("ended"), starts.alias("starts")), lambda x, y: F.struct(x.alias("x"), (x["base"] | ((y["ended"] <= x["s"]) & (y["starts"] >= x["e"]))).alias("ok")))
        return F.transform(F.filter(beside, lambda y: y["ok"]), lambda y: y["x"])

    def judged(every: Column) -> Column:
        ballot = lambda cut, x: reduce(lambda rest, k: F.when(x["k"] == k, votes(KINDS[k], cut, x)).otherwise(rest), range(len(KINDS)), F.lit(None).cast("string"))
        return let(blocks(text), lambda cut: F.transform(free(every), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["base"].alias("base"), ballot(cut, x).alias("votes"))))

    found = F.concat(*marked(base_spans(text), True), *marked(proposals(text), False))
    return let(F.sort_array(found), lambda every: F.when(F.size(every) > 0, judged(every)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)")))


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with column ``_spans``; texts without a digit, @ or (at) are not searched."""
    text = text_or_empty()
    worth = text.rlike(r"[0-9@]|[\[(]at[\])]|::")
    return docs.withColumn("_spans", F.when(worth, spans(text)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)")))


class Classifier:
    """Labeler reliabilities from expectation-maximisation, and the curve fitted to its beliefs.

    Made from counts of (kind, votes and form), at most 4 * 3**LABELERS * 50 rows.
    """

    def __init__(self, counts: list[tuple[int, str, int]], rounds: int = ROUNDS):
        self.accepted: list[tuple[int, str]] = []
        self.belief: dict[tuple[int, str], float] = {}
        self.reliability: dict[int, np.ndarray] = {}
        counts = sorted(counts)
        if not counts:
            return
        kind = np.array([k for k, _, _ in counts])
        ballot = np.array([["-0+".index(c) for c in v[:LABELERS]] for _, v, _ in counts])
        form = np.array([[int(v[LABELERS : LABELERS + 1] or 0), "nbsdp".index(v[LABELERS + 1 :] or "n")] for _, v, _ in counts])
        n = np.array([c for _, _, c in counts], float)
        # a labeler's distribution over against, silent and for, given that a span is or is not personal data
        prior = np.full(len(KINDS), 0.5)
        start = np.tile(np.array([[6.0, 4.0, 2.0], [2.0, 4.0, 6.0]]), (LABELERS, 1, 1))
        start[CHECK] = [[40.0, 4.0, 1.0], [1.0, 4.0, 40.0]]
        table = np.tile(start / start.sum(-1, keepdims=True), (len(KINDS), 1, 1, 1))
        for _ in range(rounds):
            like = np.log(table[kind[:, None], np.arange(LABELERS), :, ballot]).sum(1)  # rows x (not, is)
            odds = like[:, 1] - like[:, 0] + np.log(prior[kind] / (1 - prior[kind]))
            belief = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            for k in set(kind.tolist()):
                own = kind == k
                share = np.stack([n[own] * (1 - belief[own]), n[own] * belief[own]])
                prior[k] = (share[1].sum() + 2) / (share.sum() + 4)
                for j in range(LABELERS):
                    for c in (0, 1):
                        seen = np.bincount(ballot[own, j], share[c], 3)
                        # the start counts like spans already seen, so classes keep their meaning
                        table[k, j, c] = (seen + start[j, c]) / (seen + start[j, c]).sum()
        self.reliability = {int(k): table[k] for k in set(kind.tolist())}
        x = self.design(kind, ballot, form)
        self.weights = self.fit(x, n, belief)
        score = x @ self.weights
        final = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
        self.belief = {(int(k), v): float(p) for (k, v, _), p in zip(counts, final, strict=True)}
        self.accepted = sorted(x for x, p in self.belief.items() if p >= LIMIT)

    @staticmethod
    def design(kind: np.ndarray, ballot: np.ndarray, form: np.ndarray) -> np.ndarray:
        """For each kind one column, two for each labeler, ten for the digits, five for the separators."""
        one = np.eye(len(KINDS))[kind]
        signs = np.concatenate([ballot == 2, ballot == 0, np.eye(10)[form[:, 0]], np.eye(5)[form[:, 1]]], axis=1).astype(float)
        return np.concatenate([one, (one[:, :, None] * signs[:, None, :]).reshape(len(kind), -1)], axis=1)

    def fit(self, x: np.ndarray, n: np.ndarray, belief: np.ndarray, ridge: float = 0.05) -> np.ndarray:
        w = np.zeros(x.shape[1])
        n = n / n.sum() * len(n) + 0.1
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            hess = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, x.T @ (n * (belief - p)) - ridge * w)
            w = w + step / max(1.0, float(np.abs(step).max()) / 2)
        return w

    def accepts(self, x: Column) -> Column:
        """Whether a proposed span's pattern of votes is accepted."""
        by_kind = [(k, [v for kk, v in self.accepted if kk == k]) for k in range(len(KINDS))]
        return reduce(lambda a, b: a | b, [(x["k"] == k) & x["votes"].isin(v) for k, v in by_kind if v], F.lit(False))


def classifier(found: DataFrame) -> Classifier:
    """Learn from the spans of all rows; only counts of vote patterns reach the driver."""
    patterns = found.select(F.explode("_spans").alias("x")).groupBy(F.col("x.k").alias("k"), F.col("x.votes").alias("votes")).count()
    return Classifier([tuple(r) for r in patterns.collect()])


def final_spans(model: Classifier) -> Column:
    """Base spans and accepted proposals, by start, then kind."""
    return F.sort_array(F.filter("_spans", lambda x: x["base"] | model.accepts(x)))


def listed(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """Counts and digest of each row's base spans, and all spans."""
    found = stored(with_spans(docs.select("doc_id", "text")).select("doc_id", "_spans"), "spans")
    every = found.select("doc_id", final_spans(classifier(found)).alias("x")).withColumn("base", F.filter("x", lambda s: s["base"]))
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return every.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("x")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by its kind, as <EMAIL>.

    Where spans overlap, the first to start is named and all of them go.
    """
    model = classifier(with_spans(docs.select("text")))
    text = text_or_empty()
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def joined(cut: Column, found: Column, ended: Column) -> Column:
        """What lies between the spans, and the name of each that starts where those before it have ended."""
        before = lambda i: F.when(i > 0, F.get(ended, i - 1)).otherwise(F.lit(0).cast("long"))
        pieces = F.transform(found, lambda x, i: F.when(x["s"] >= before(i), F.concat(part(cut, before(i), x["s"] - before(i)), F.element_at(names, x["k"] + 1))).otherwise(F.lit("")))
        last = F.element_at(ended, -1)
        return F.concat(F.array_join(pieces, ""), part(cut, last, F.length(text) - last))

    def cut_out(found: Column) -> Column:
        ends = scanned(F.transform(found, lambda x: x["e"]), F.greatest)
        return let(F.struct(blocks(text).alias("cut"), ends.alias("ended")), lambda w: joined(w["cut"], found, w["ended"]))

    done = let(final_spans(model), lambda found: F.when(F.size(found) > 0, cut_out(found)).otherwise(text))
    found = F.size("_spans") > 0
    changed = {"text": F.when(found, F.col("new")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(found, F.length("new").cast("long")).otherwise(F.col("_row.n_chars"))
    rows = with_spans(docs.select(row_of(docs), "text")).select("_row", "text", "_spans", F.when(found, done).alias("new"))
    return rows_again(rows, docs, **changed)
