"""Scalar functions of texts, hashes and proportions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Lower case, with runs of anything but letters and digits, of any script, as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def char_similarity(a: Column, b: Column) -> Column:
    """1 minus edit distance over the longer length; two empty texts are equal.

    A text that holds the other is as far from it as it is longer; only other pairs need the table of both lengths.
    """
    most, apart = F.greatest(F.length(a), F.length(b)), F.abs(F.length(a) - F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.when(F.contains(a, b) | F.contains(b, a), apart).otherwise(F.levenshtein(a, b)) / most)


def caption_kind(text: Column) -> Column:
    return (
        F.when(text.rlike(r"(?i)^\s*(?:figure|fig\.?)\s*[0-9]+"), "figure")
        .when(text.rlike(r"(?i)^\s*(?:table|tab\.?)\s*[0-9]+"), "table")
        .when(text.rlike(r"(?i)^\s*algorithm\s*[0-9]+"), "algorithm")
    )


def hash_bucket(key: Column, buckets: int) -> Column:
    """A bucket from the first 8 hex digits of SHA-256, the same in any engine."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("bigint") % buckets


def wilson_lower(hits: Column, total: Column, z: float = 1.959963984540054) -> Column:
    p = hits / total
    spread = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total))
    return F.when(total > 0, F.greatest(F.lit(0.0), (p + z * z / (2 * total) - spread) / (1 + z * z / total))).otherwise(F.lit(0.0))


def glyph_width(text: Column, size: Column) -> Column:
    """Approximate width: narrow, wide and other characters at fixed shares of the font size."""
    narrow = F.length(F.regexp_replace(text, r"[^ilj.,:;'!|\[\]() ]", ""))
    wide = F.length(F.regexp_replace(text, r"[^mwMW@%]", ""))
    return size * (narrow * 0.28 + wide * 0.85 + (F.length(text) - narrow - wide) * 0.52)


def page_ranges(spec: str, most: int | None = None) -> list[int]:
    """``"1-3,7"`` as ordered distinct zero-based page numbers."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        first, _, last = part.partition("-")
        a, b = int(first), int(last or first)
        if a < 1 or b < a:
            raise ValueError(f"not a range of pages: {part}")
        out += [p for p in range(a - 1, b) if p not in out and (most is None or p < most)]
    return out
