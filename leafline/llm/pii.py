"""Personal data: patterns, and labelers whose votes are weighed by expectation-maximisation.

Everything on the executors is built-in Spark SQL. Only the counts of vote
patterns come to the driver: at most one row per kind and combination of votes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.llm import spans as S
from leafline.llm.common import let, materialize

IN_NUMBER, IN_DOMAIN = "\x03", "\x04"

EMAIL = (
    rf"(?:(?<![A-Za-z0-9._%+{IN_DOMAIN}-])|\G)[A-Za-z0-9._%+{IN_DOMAIN}-]++@"
    rf"[A-Za-z0-9-]++{IN_DOMAIN}[A-Za-z0-9{IN_DOMAIN}-]++"
)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{IN_NUMBER}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Kinds of base spans, in their order, then those that only the labelers can find.
BASE_KINDS = ["email", "ip", "card", "phone"]
LOOSE = {
    "card_group": r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])",
    "phone_group": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])",
    "phone_local": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "national_id": r"(?<![0-9A-Za-z+.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]{1,63}\x20?(?:[(\[](?:dot|DOT)[)\]]|\.)\x20?[A-Za-z]{2,24}(?![A-Za-z])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{2,24}(?:\x20[A-Z][a-z]{2,24})?(?![A-Za-z])",
}
KINDS = [*BASE_KINDS, *LOOSE]

#: Gazetteers and context words.
TOP_DOMAINS = "com org net edu gov io info de fr es it uk eu ch at nl us ca".split()
MAIL_WORDS = "mail email e-mail contact courriel correo".split()
PHONE_WORDS = "phone call tel telephone mobile cell fax dial contact".split()
CARD_WORDS = "card visa mastercard amex credit debit payment".split()
IP_WORDS = "ip host server address client ping".split()
ID_WORDS = "ssn social security id number insurance".split()
GIVEN_NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Thomas "
    "Sarah Maria Anna Peter Paul Hans Claudia Pierre Marie Jean Sophie Carlos Carmen Jose Ana"
).split()
NEGATIVE_WORDS = "version release isbn issn section chapter order invoice page line figure v".split()
CONTEXT = {
    "email": MAIL_WORDS, "email_spelled": MAIL_WORDS, "ip": IP_WORDS, "card": CARD_WORDS, "phone": PHONE_WORDS, "card_group": CARD_WORDS, "phone_group": PHONE_WORDS,
    "phone_local": PHONE_WORDS, "national_id": ID_WORDS, "name": "dear signed from by contact author".split(),
}

LABELERS = ["format", "gazetteer", "context", "negative", "boundary"]
#: What the span classifier sees beside kind and votes: 1 if it holds, else 0.
SHAPES = ["labelled", "first in line", "last in line", "long", "grouped", "after a number"]


@dataclass(frozen=True)
class PiiParams:
    """``threshold``: probability from which a candidate outside the base patterns is a span.

    ``prior``: share of true spans among candidates before any votes are seen.
    ``trust``: weight of the starting values against the counts, as a share of the
    counts; without it nothing keeps the two classes from changing places.
    """

    threshold: float = 0.5
    prior: float = 0.5
    trust: float = 0.2
    em_rounds: int = 50
    fit_rounds: int = 200


def _luhn(digits: Column) -> Column:
    doubled = lambda c: F.when(c > 4, 2 * c - 9).otherwise(2 * c)
    values = F.transform(
        F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: F.length(F.ltrim(x, F.lit("0"))) <= 3) & F.forall(
        F.split(value, r"\."), lambda x: F.coalesce(F.try_to_number(F.right(F.concat(F.lit("000"), x), F.lit(4)), F.lit("9999")), F.lit(0)) <= 255
    )


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind.

    ``(X[sep]?)+`` makes Java's matcher recurse once per repetition. So inner dots
    and separators are first replaced by control characters of the same length;
    what is left to match are plain runs of a character class.
    """
    clean = F.translate(text, IN_NUMBER + IN_DOMAIN, "\x02\x02")
    dotted = F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", IN_DOMAIN)
    numbered = F.regexp_replace(clean, r"(?<=[0-9])[\x20-](?=[0-9])", IN_NUMBER)
    many_digits = F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}"))

    def card(s: Column) -> Column:
        return let(F.translate(s["value"], IN_NUMBER, ""), lambda d: F.length(d).between(12, 19) & _luhn(d))

    return {
        "email": F.when(F.contains(text, F.lit("@")), S.marked_spans(dotted, EMAIL)).otherwise(S.empty()),
        "ip": F.filter(S.marked_spans(text, IP), lambda s: _octets(s["value"])),
        "card": F.when(many_digits, F.filter(S.marked_spans(numbered, CARD), card)).otherwise(S.empty()),
        "phone": F.when(
            F.contains(text, F.lit("+")),
            F.filter(S.marked_spans(text, PHONE), lambda s: F.length(_digits(s["value"])).between(9, 15)),
        ).otherwise(S.empty()),
    }


def _votes(s: Column, kind: str) -> Column:
    """One vote per labeler: 1 for personal data, -1 against, 0 abstains."""
    value = F.translate(s["value"], IN_NUMBER + IN_DOMAIN, " .")
    before, after = F.lower(s["before"]), s["after"]
    digits = _digits(value)
    vote = lambda yes, no: F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))
    last = F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1))
    word = lambda words: before.rlike(r"(?:^|[^a-z])(?:" + "|".join(words) + r")[^a-z]")
    form = {
        "email": vote(F.length(value) <= 254, F.length(value) > 254),
        "email_spelled": vote(value.rlike(r"(?i)[(\[]dot[)\]]"), F.lit(False)),
        "ip": vote(~value.rlike(r"(?:^|\.)0[0-9]"), value.rlike(r"(?:^|\.)0[0-9]")),
        "card": vote(F.length(digits).between(15, 16), F.length(digits) < 15),
        "card_group": vote(F.length(digits).between(15, 16), F.length(digits) < 15),
        "phone": vote(F.length(digits).between(10, 13), F.length(digits) < 10),
        "phone_group": vote(F.length(digits).between(10, 13), F.length(digits) < 10),
        "phone_local": vote(value.rlike(r"^\(?[2-9]"), value.rlike(r"^\(?[01]")),
        "national_id": vote(~value.rlike(r"^(?:000|666|9)|-00-|-0000$"), value.rlike(r"^(?:000|666|9)|-00-|-0000$")),
        "name": vote(value.rlike(r"\x20[A-Z][a-z]+\x20[A-Z]"), F.lit(False)),
    }[kind]
    gazetteer = {
        "email": vote(last.isin(TOP_DOMAINS), ~last.isin(TOP_DOMAINS)),
        "email_spelled": vote(last.isin(TOP_DOMAINS), ~last.isin(TOP_DOMAINS)),
        "ip": vote(F.lit(False), value.rlike(r"^(?:0|127|255)\.")),
        "card": vote(digits.rlike(r"^(?:4|5[1-5]|3[47]|6(?:011|5)|2[2-7])"), digits.rlike(r"^[01]")),
        "card_group": vote(digits.rlike(r"^(?:4|5[1-5]|3[47]|6(?:011|5)|2[2-7])"), digits.rlike(r"^[01]")),
        "phone": vote(digits.rlike(r"^(?:1[2-9]|[2-9])"), digits.rlike(r"^0")),
        "phone_group": vote(digits.rlike(r"^(?:1[2-9]|[2-9])"), digits.rlike(r"^0")),
        "phone_local": vote(F.lit(False), value.rlike(r"^\(?(?:555|800|888|900)")),
        "national_id": F.lit(0),
        "name": vote(value.rlike(r"\x20(?:" + "|".join(GIVEN_NAMES) + r")(?:\x20|$)"), F.lit(False)),
    }[kind]
    odd = r"^[A-Za-z0-9_]|^[.,][0-9]"
    return F.array(
        form,
        gazetteer,
        vote(word(CONTEXT[kind]), F.lit(False)),
        vote(F.lit(False), word(NEGATIVE_WORDS)),
        vote(after.rlike(r"^(?:$|[\s.,;:!?)])") & ~after.rlike(odd), after.rlike(odd) | s["before"].rlike(r"[A-Za-z0-9_]$")),
    )


def _shape(s: Column) -> Column:
    """:data:`SHAPES` of a candidate."""
    one = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0))
    return F.array(
        one(s["before"].rlike(r"[:=]\s*$")), one(s["before"].rlike(r"(?:^|\n)\s*$")), one(s["after"].rlike(r"^\s*(?:$|\n)")),
        one(F.length(s["value"]) > 16), one(s["value"].rlike(r"[0-9A-Za-z][\x20()-]+[0-9A-Za-z]")), one(s["before"].rlike(r"[0-9]\s*$")),
    )


def pii_candidates(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id and all candidates with the labelers' votes: the base spans, and looser ones that don't overlap them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = dict(base_spans(text))
    prefilter = {
        "card_group": r"[0-9]{13}", "phone_group": r"\+[0-9]",
        "phone_local": r"[0-9]{3}[\x20.-][0-9]{4}", "national_id": r"-[0-9]{2}-[0-9]{4}",
        "email_spelled": r"(?i)[(\[]at[)\]]", "name": r"(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z]",
    }
    for kind, pattern in LOOSE.items():
        found[kind] = F.when(F.rlike(text, F.lit(prefilter[kind])), S.marked_spans(text, pattern)).otherwise(S.empty())
    found["card_group"] = F.filter(found["card_group"], lambda s: _luhn(s["value"]))

    def candidates(kind: str) -> Column:
        return F.transform(
            found[kind],
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), _votes(s, kind).alias("votes"), _shape(s).alias("shape")
            ),
        )

    def with_clear(b: Column, kinds: list[str]) -> Column:
        clear = lambda c: ~F.exists(b, lambda x: (x["start"] < c["end"]) & (x["end"] > c["start"]))
        return F.concat(b, F.filter(F.concat(*[candidates(k) for k in kinds]), clear))

    def with_loose(b: Column) -> Column:
        groups = [k for k in LOOSE if k.endswith("_group")]
        return let(with_clear(b, groups), lambda g: with_clear(g, [k for k in LOOSE if k not in groups]))

    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    return docs.select("doc_id", *carried, let(F.concat(*[candidates(k) for k in BASE_KINDS]), with_loose).alias("candidates"))


def vote_counts(candidates: DataFrame) -> list[tuple[str, tuple[int, ...], tuple[int, ...], int]]:
    """How often each combination of votes and shapes occurs. Bounded: kinds, times 3 to the number of labelers, times 2 to that of shapes."""
    rows = (
        candidates.select(F.explode("candidates").alias("c"))
        .groupBy(F.col("c.kind").alias("kind"), F.col("c.votes").alias("votes"), F.col("c.shape").alias("shape"))
        .count()
        .collect()
    )
    return sorted((r["kind"], tuple(r["votes"]), tuple(r["shape"]), r["count"]) for r in rows)


def estimate_reliabilities(counts: list[tuple[str, tuple[int, ...], int]], params: PiiParams) -> dict[tuple[str, tuple[int, ...]], float]:
    """Expectation-maximisation over the labelers' votes: the probability of each combination being personal data.

    Each kind has a prior of its own, and each labeler a table of vote probabilities
    given truth for each kind; starting values trust the labelers.
    """
    kinds = {kind for kind, _, _ in counts}
    size = {k: sum(n for kind, _, n in counts if kind == k) for k in kinds}
    prior = dict.fromkeys(kinds, params.prior)
    start = {True: {1: 0.6, 0: 0.3, -1: 0.1}, False: {1: 0.2, 0: 0.4, -1: 0.4}}
    table = {k: [{t: dict(start[t]) for t in (True, False)} for _ in LABELERS] for k in kinds}
    post: dict[tuple[str, tuple[int, ...]], float] = {}
    for _ in range(params.em_rounds):
        for kind, votes, _n in counts:
            yes, no = math.log(prior[kind]), math.log(1 - prior[kind])
            for labeler, v in zip(table[kind], votes, strict=True):
                yes, no = yes + math.log(labeler[True][v]), no + math.log(labeler[False][v])
            post[kind, votes] = 1 / (1 + math.exp(min(50.0, max(-50.0, no - yes))))
        for k in kinds:
            own = [(post[k, v], v, n) for kind, v, n in counts if kind == k]
            held = 2 + params.trust * size[k]
            prior[k] = (sum(p * n for p, _, n in own) + held * params.prior) / (size[k] + held)
            held = 10 + params.trust * size[k]
            for i, labeler in enumerate(table[k]):
                for truth in (True, False):
                    mass = {v: held * start[truth][v] for v in (1, 0, -1)}
                    for p, votes, n in own:
                        mass[votes[i]] += n * (p if truth else 1 - p)
                    total = sum(mass.values())
                    labeler[truth] = {v: m / total for v, m in mass.items()}
    return post


def _features(kind: str, votes: tuple[int, ...], shape: tuple[int, ...]) -> list[float]:
    return [1.0, *[float(kind == k) for k in KINDS], *map(float, votes), *map(float, shape)]


def train_span_classifier(
    counts: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], post: dict[tuple[str, tuple[int, ...]], float], params: PiiParams
) -> list[float]:
    """Logistic regression on kind, votes and shape, fitted by gradient steps to the probabilities of the label model."""
    weights = _features("", (1, 1, 1, 1, 1), (0,) * len(SHAPES))
    weights[0] = -0.5
    total = sum(n for *_, n in counts) or 1
    for _ in range(params.fit_rounds):
        gradient = [0.0] * len(weights)
        for kind, votes, shape, n in counts:
            x = _features(kind, votes, shape)
            z = sum(w * f for w, f in zip(weights, x, strict=True))
            error = (1 / (1 + math.exp(min(50.0, max(-50.0, -z)))) - post[kind, votes]) * n / total
            gradient = [g + error * f for g, f in zip(gradient, x, strict=True)]
        weights = [w - 2.0 * (g + 1e-4 * w) for w, g in zip(weights, gradient, strict=True)]
    return weights


def _logit(c: Column, weights: list[float]) -> Column:
    z = F.lit(weights[0])
    for kind, w in zip(KINDS, weights[1:], strict=False):
        z = z + F.when(c["kind"] == kind, F.lit(w)).otherwise(F.lit(0.0))
    rest = weights[1 + len(KINDS) :]
    for i, w in enumerate(rest[: len(LABELERS)]):
        z = z + F.get(c["votes"], F.lit(i)) * F.lit(w)
    for i, w in enumerate(rest[len(LABELERS) :]):
        z = z + F.get(c["shape"], F.lit(i)) * F.lit(w)
    return z


def pii_spans(docs: DataFrame, params: PiiParams = PiiParams(), carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with ``base`` and ``spans``: arrays of (start, rank, kind, end).

    Base spans always stay; other candidates are added where the classifier gives
    them the threshold and they don't overlap a base span: spelled addresses, local
    numbers and names, and the numbers that a base pattern loses as it runs on into
    what follows, as in two card numbers side by side. Null and empty texts
    have no spans. Rows are judged one by one; other columns play no role, but those
    named in ``carry`` come out as one struct, ``carried``.
    """
    cands = materialize(pii_candidates(docs, carry), "pii")
    counts = vote_counts(cands)
    by_votes: dict[tuple[str, tuple[int, ...]], int] = {}
    for kind, votes, _, n in counts:
        by_votes[kind, votes] = by_votes.get((kind, votes), 0) + n
    post = estimate_reliabilities([(k, v, n) for (k, v), n in sorted(by_votes.items())], params)
    weights = train_span_classifier(counts, post, params)
    limit = math.log(params.threshold / (1 - params.threshold))
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    tag = lambda c: F.struct(c["start"].alias("start"), rank[c["kind"]].alias("rank"), c["kind"].alias("kind"), c["end"].alias("end"))
    is_base = lambda c: c["kind"].isin(BASE_KINDS)
    base = F.filter("candidates", is_base)

    def split(b: Column) -> Column:
        added = F.filter("candidates", lambda c: ~is_base(c) & (_logit(c, weights) > limit))
        tagged = F.transform(b, tag)
        return F.struct(F.sort_array(tagged).alias("base"), F.sort_array(F.concat(tagged, F.transform(added, tag))).alias("spans"))

    carried = ["carried"] if carry else []
    return cands.select("doc_id", *carried, let(base, split).alias("s")).select("doc_id", *carried, "s.base", "s.spans")


def redacted(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets; overlapping spans go as one.

    ``n_chars``, if there, is the new length in code points. Null texts stay null.
    """
    found = pii_spans(docs, params, carry=docs.columns)
    text = F.col("carried.text")

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        piece = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out")
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    clean = F.when(F.size("spans") == 0, text).otherwise(F.aggregate("spans", start, step, rest))
    out = found.withColumn("clean", clean)
    value = {"text": F.col("clean"), "n_chars": F.length("clean").cast("bigint")}
    return out.select(*[value[c].alias(c) if c in value else F.col(f"carried.`{c}`").alias(c) for c in docs.columns])


def pii_digest(found: DataFrame) -> DataFrame:
    """The result of :func:`pii_spans` as counts and digests."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(S.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        S.joined(F.col("spans")).alias("spans"),
    )
