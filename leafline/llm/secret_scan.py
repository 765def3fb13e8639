"""Secret scan: assignments, access keys and hex strings, and strings of high entropy.

Everything here is built-in Spark SQL; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.llm import spans as S
from leafline.llm.common import let

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_JAVA = r"(?=[PpSsTtAa])" + ASSIGN
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ["assign", "access", "hex", "entropy"]

#: Strings that look random and are not secret.
ALLOWED = {
    "digits only": r"^[0-9+/_=-]*$",
    "UUID": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "placeholder": r"(?i)example|placeholder|changeme|xxxxx|dummy|redacted",
    "alphabet run": r"(?i)abcdefgh|0123456789|qwertyuiop",
    "MD5 of nothing": r"^d41d8cd98f00b204e9800998ecf8427e$",
    "SHA-1 of nothing": r"^da39a3ee5e6b4b0d3255bfef95601890afd80709$",
    "SHA-256 of nothing": r"^e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855$",
}


@dataclass(frozen=True)
class EntropyParams:
    """``classes``: name, pattern of the whole string, least entropy in bits of its best window."""

    window: int = 20
    classes: tuple[tuple[str, str, float], ...] = field(
        default=(
            ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])(?:[0-9a-f]*|[0-9A-F]*)$", 2.81),
            ("alnum", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).*$", 3.61),
            ("one case", r"^(?=.*[0-9].*[0-9])(?=.*[A-Za-z]).*$", 3.41),
            ("letters", r"^(?=.*[a-z].*[a-z])(?=.*[A-Z].*[A-Z].*[A-Z]).*$", 4.05),
        )
    )


def _n_log_n(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def best_window_entropy(value: Column, window: int) -> Column:
    """The highest Shannon entropy, in bits, of any ``window`` consecutive characters.

    One step per character: its count goes up by one, that of the character which
    leaves goes down by one, and only those two terms of the sum of n log n change.
    """
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def scan(c: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            came, gone = F.get(c, i), F.when(i >= window, F.get(c, i - window)).otherwise(F.lit(-1))
            up = F.get(acc["counts"], came)
            down = F.when(gone >= 0, F.get(acc["counts"], gone))
            change = _n_log_n(up + 1) - _n_log_n(up)
            change = change + F.when(gone >= 0, _n_log_n(down - 1) - _n_log_n(down)).otherwise(F.lit(0.0))
            total = acc["total"] + F.when(came == gone, F.lit(0.0)).otherwise(change)
            counts = F.transform(
                acc["counts"],
                lambda n, j: n + F.when(j == came, F.lit(1)).otherwise(F.lit(0)) - F.when(j == gone, F.lit(1)).otherwise(F.lit(0)),
            )
            entropy = F.log2(F.lit(float(window))) - total / window
            best = F.when(i >= window - 1, F.greatest(acc["best"], entropy)).otherwise(acc["best"])
            return F.struct(counts.alias("counts"), total.alias("total"), best.alias("best"))

        start = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best")
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(c) - 1), start, step, lambda acc: acc["best"])

    return let(codes, scan)


def _entropy_spans(text: Column, base: Column, params: EntropyParams) -> Column:
    """Candidates that no allow-list entry suppresses, outside the base spans, whose best window is over the class's limit."""
    has_class = lambda v: v.rlike(f"[0-9]|[A-Z].*[A-Z].*[A-Z]")
    suppressed = lambda v: v.rlike("|".join(f"(?:{p})" for p in ALLOWED.values()))

    def least(v: Column) -> Column:
        out = F.lit(99.0)
        for _, pattern, limit in reversed(params.classes):
            out = F.when(v.rlike(pattern), F.lit(limit)).otherwise(out)
        return out

    def secret(s: Column) -> Column:
        v = s["value"]
        outside = ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
        return F.when(
            has_class(v) & ~suppressed(v) & outside & (least(v) < 99.0),
            best_window_entropy(v, params.window) > least(v),
        ).otherwise(F.lit(False))

    found = F.filter(S.marked_spans(text, CANDIDATE), secret)
    return F.when(F.rlike(text, F.lit(r"[A-Za-z0-9+/_=-]{20}")), found).otherwise(S.empty())


def secret_scan(docs: DataFrame, params: EntropyParams = EntropyParams()) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its secret spans: array of (start, rank, kind, end).

    Null texts are empty and have no spans, as have empty ones. Rows are judged one
    by one, so repeated rows give repeated results and other columns play no role.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(
        S.marked_spans(text, ASSIGN_JAVA), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 12
    )
    base = [assign, S.marked_spans(text, ACCESS), S.marked_spans(text, HEX)]
    tags = F.concat(*[S.tagged(x, kind, i) for i, (x, kind) in enumerate(zip(base, KINDS, strict=False))])
    found = docs.select("doc_id", let(tags, lambda b: F.struct(
        b.alias("base"), S.tagged(_entropy_spans(text, b, params), "entropy", 3).alias("added")
    )).alias("s"))
    return found.select("doc_id", F.col("s.base").alias("base"), F.concat("s.base", "s.added").alias("spans"))


def secret_digest(found: DataFrame) -> DataFrame:
    """The result of :func:`secret_scan` as counts and digests."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(S.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        S.joined(F.col("spans")).alias("spans"),
    )
