"""Quality rules: word and line statistics, and divergence from language references.

Everything here is built-in Spark SQL; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.llm.common import SPACES, let, materialize

#: Frequent function words of the supported languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "on", "for", "with"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "qui", "dans"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
#: About how frequent those words are in each language, in their order.
COMMON_SHARES = {
    "en": [0.060, 0.030, 0.028, 0.026, 0.021, 0.022, 0.010, 0.011, 0.010, 0.007, 0.009, 0.007],
    "fr": [0.050, 0.029, 0.025, 0.024, 0.020, 0.018, 0.014, 0.011, 0.009, 0.011, 0.009, 0.008],
    "de": [0.033, 0.033, 0.028, 0.019, 0.014, 0.010, 0.011, 0.012, 0.009, 0.008, 0.010, 0.008],
    "es": [0.058, 0.037, 0.032, 0.030, 0.027, 0.027, 0.021, 0.017, 0.013, 0.012, 0.011, 0.010],
}
#: About how frequent the classes of characters are, and bytes beyond one per character in each language.
CLASS_SHARES = [0.77, 0.03, 0.005, 0.16, 0.025, 0.0005]
WIDE_SHARES = {"en": 0.0, "fr": 0.03, "de": 0.02, "es": 0.02}
#: The pooled reference of documents in any other language, or in none.
OTHER = "other"
CHAR_CLASSES = ["lower", "upper", "digit", "space", "punct", "symbol", "wide"]


@dataclass(frozen=True)
class QualityParams:
    """``max_*_distance``: Jensen-Shannon distances (base 2, 0 to 1) above which a document is rejected.

    ``min_*``: shorter documents are not compared; their histograms say too little.
    ``max_word_distance`` has to be below the distance of a text without any common
    word, which is 0.305 where these are 17% of all words, and reaches it at about 14%.
    ``prior_words``: words of the fixed reference that are added to those of the corpus in each language,
    with ``prior_chars`` characters; so a language has a reference however little there is of it.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    min_chars_compared: int = 400
    min_words_compared: int = 60
    max_char_distance: float = 0.30
    max_word_distance: float = 0.27
    prior_words: float = 1_000.0
    prior_chars: float = 6_000.0


def _repeat_words(hashes: Column) -> Column:
    """Words inside 5-word windows that occur twice or more; ``hashes``: one 64-bit hash per window, in order."""
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        twin = F.transform(
            s,
            lambda e, k: F.when(
                (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]), e["i"]
            ).otherwise(F.lit(-1)),
        )
        return F.sort_array(F.filter(twin, lambda i: i >= 0))

    zero = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("bigint").alias("total"))
    covered = F.aggregate(
        let(ranked, starts),
        zero,
        lambda acc, i: F.struct(
            i.alias("last"), (acc["total"] + F.least(F.lit(5), i - acc["last"])).cast("bigint").alias("total")
        ),
        lambda acc: acc["total"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(covered)


def _pooled_words() -> list[str]:
    return sorted({x for common in COMMON_WORDS.values() for x in common})


def prior(ref: str, params: QualityParams) -> dict[str, list[float]]:
    """The fixed reference of a language; the pooled one is the mean of all."""
    langs = [ref] if ref in COMMON_WORDS else sorted(COMMON_WORDS)
    words = COMMON_WORDS.get(ref, _pooled_words())
    shares = [sum(s for x in langs for w, s in zip(COMMON_WORDS[x], COMMON_SHARES[x], strict=True) if w == word) / len(langs) for word in words]
    chars = [*CLASS_SHARES, sum(WIDE_SHARES[x] for x in langs) / len(langs)]
    return {"chars": [params.prior_chars * x for x in chars], "words": [params.prior_words * x for x in (*shares, 1 - sum(shares))]}


def among(common: list[str]) -> Callable[[Column], Column]:
    return lambda x: F.lower(x).isin(common)


def hit_counts(common: list[str]) -> Callable[[Column], Column]:
    def equal(word: str) -> Callable[[Column], Column]:
        return lambda x: F.lower(x) == word

    return lambda hits: F.array(*[F.size(F.filter(hits, equal(y))).cast("bigint") for y in common])


def quality_features(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row of integers per document: the base counts and both histograms.

    A null text counts as empty. Windows are compared by 64-bit hash. Columns named
    in ``carry`` come along as one struct, ``carried``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lang = F.when(F.col("lang").isin(list(COMMON_WORDS)), F.col("lang")).otherwise(F.lit(OTHER))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+")
    )

    def word_stats(w: Column) -> Column:
        n = F.size(w)
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        windows = let(
            hashed,
            lambda h: F.transform(
                F.sequence(F.lit(0), n - 5),
                lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]),
            ),
        )
        repeats = F.when(n < 6, F.lit(0).cast("bigint")).otherwise(let(windows, _repeat_words))
        counts = [
            (name, let(F.filter(w, among(common)), hit_counts(common)))
            for name, common in [*COMMON_WORDS.items(), (OTHER, _pooled_words())]
        ]
        hist = F.when(lang == counts[0][0], counts[0][1])
        for name, value in counts[1:-1]:
            hist = hist.when(lang == name, value)
        hist = hist.otherwise(counts[-1][1])
        return F.struct(
            n.cast("bigint").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeats.alias("n_repeat_words"),
            hist.alias("word_hits"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    counted = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("bigint")
    return docs.select(
        F.col("doc_id"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []),
        lang.alias("ref"),
        F.length(text).cast("bigint").alias("n_code_points"),
        (F.octet_length(text) - F.length(text)).cast("bigint").alias("wide"),
        counted(r"[#*$%&|<>]").alias("n_symbols"),
        counted(r"[0-9]").alias("digit"),
        counted(r"[A-Z]").alias("upper"),
        counted(r"[.,;:!?'\"()-]").alias("punct"),
        dup_lines.alias("n_dup_lines"),
        let(words, word_stats).alias("w"),
    ).select("*", "w.*").drop("w")


def _histograms(f: DataFrame) -> DataFrame:
    space = F.col("n_code_points") - F.col("word_chars")
    seen = F.col("upper") + F.col("digit") + space + F.col("punct") + F.col("n_symbols") + F.col("wide")
    lower = F.greatest(F.col("n_code_points") - seen, F.lit(0).cast("bigint"))
    hits = F.aggregate("word_hits", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return f.select(
        "*",
        F.array(lower, F.col("upper"), F.col("digit"), space, F.col("punct"), F.col("n_symbols"), F.col("wide")).alias("chars"),
        F.concat(F.col("word_hits"), F.array(F.col("n_words") - hits)).alias("words"),
    )


def language_references(hist: DataFrame, params: QualityParams) -> dict[str, dict[str, list[float]]]:
    """Histograms of each language, summed over the whole corpus and the fixed reference.

    At most five rows (the languages of COMMON_WORDS and the pooled rest) reach the driver.
    """
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CHAR_CLASSES))]
    width = max(len(_pooled_words()), *map(len, COMMON_WORDS.values())) + 1
    sums += [F.sum(F.get("words", F.lit(i))).alias(f"w{i}") for i in range(width)]
    rows = hist.groupBy("ref").agg(*sums).collect()
    return {
        r["ref"]: {kind: [x + r[f"{kind[0]}{i}"] for i, x in enumerate(own)] for kind, own in prior(r["ref"], params).items()}
        for r in rows
    }


def js_distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance, base 2, between the shares of ``counts`` and of ``reference``; null if either is empty."""
    total = float(sum(reference))
    if not total:
        return F.lit(None).cast("double")
    n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    ref = F.array(*[F.lit(x / total) for x in reference])

    def half(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def divergence(total_count: Column) -> Column:
        terms = F.zip_with(
            counts,
            ref,
            lambda x, q: let(
                x / total_count, lambda p: half(p, (p + q) / 2) + half(q, (p + q) / 2)
            ),
        )
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    return let(n, lambda t: F.when(t > 0, F.sqrt(F.greatest(F.lit(0.0), divergence(t) / 2))))


def quality_rules(docs: DataFrame, params: QualityParams = QualityParams(), carry: list[str] | None = None) -> DataFrame:
    """Counts, distances and verdict for every row of ``docs`` (doc_id, text, lang; further columns are ignored).

    Null texts are empty; empty texts have no words and fail the base rule. A null
    or unknown language is compared with the pooled reference. Repeated rows are
    judged one by one. An empty table gives an empty result.

    The features of all documents are written once to the shared folder; the
    references are sums over them and a small fixed reference of each language. Columns of ``docs`` named in ``carry`` are written
    with them and come out as one struct, ``carried``; so each row keeps its own
    verdict, whatever its doc_id.
    """
    hist = _histograms(materialize(quality_features(docs, carry), "quality"))
    refs = language_references(hist, params)

    def against(kind: str) -> Column:
        out = F.lit(None).cast("double")
        for name, ref in sorted(refs.items()):
            out = F.when(F.col("ref") == name, js_distance(F.col(kind), ref[kind])).otherwise(out)
        return out

    long_enough = (F.col("n_code_points") >= params.min_chars_compared) & (F.col("n_words") >= params.min_words_compared)
    judged = hist.select(
        *(["carried"] if carry else []), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (
            (F.col("n_words") < params.min_words)
            | (100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words"))
        ).alias("base_failed"),
        F.when(long_enough, against("chars")).alias("char_distance"),
        F.when(long_enough, against("words")).alias("word_distance"),
    )
    far = (F.coalesce("char_distance", F.lit(0.0)) > params.max_char_distance) | (
        F.coalesce("word_distance", F.lit(0.0)) > params.max_word_distance
    )
    return judged.withColumn("kept", ~F.col("base_failed") & ~far)
