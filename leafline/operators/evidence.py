"""Evidence of external providers: parsers of their JSON, streams, review proposals and their scores."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = "array<struct<type:string,bbox:array<double>,content:string>>"
#: Type names of providers.
TYPE_ALIASES = {"paragraph": "text", "para": "text", "heading": "title", "header": "title", "picture": "figure", "image": "figure", "equation": "formula", "tbl": "table"}


def normal_type(value: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for kv in TYPE_ALIASES.items() for x in kv])
    name = F.lower(F.trim(value))
    return F.coalesce(F.try_element_at(aliases, name), name, F.lit("unknown"))


def polygon_box(points: Column) -> Column:
    """The envelope of an array of [x, y] points, or null of an empty one."""
    xs, ys = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    return F.when(F.size(points) > 0, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def page_index(path: Column) -> Column:
    """Zero-based page from a file stem such as ``page_0003``."""
    return F.regexp_extract(path, r"page_0*([0-9]+)", 1).try_cast("int") - 1


def parallel_arrays(rows: DataFrame, texts: str, scores: str, polygons: str) -> DataFrame:
    """Rows of parallel arrays as one row per entry, with its place."""
    zipped = F.arrays_zip(F.col(texts).alias("text"), F.col(scores).alias("score"), F.col(polygons).alias("polygon"))
    flat = rows.select("page", F.posexplode(zipped).alias("pos", "e"))
    return flat.select("page", F.col("pos").cast("bigint").alias("pos"), F.col("e.text").alias("text"), F.col("e.score").alias("score"), polygon_box(F.col("e.polygon")).alias("box")).select("page", "pos", "text", "score", "box.*")


def bottom_left_blocks(payloads: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Blocks of (page, payload as JSON) with origin at the bottom left, turned and clamped; invalid ones keep their slot and a reason; without four numbers the box is all zero."""
    blocks = payloads.select("page", F.posexplode(F.from_json("payload", BLOCKS)).alias("slot", "b"))
    at = lambda i: F.get("b.bbox", F.lit(i))
    clamp = lambda v, most: F.least(F.greatest(F.lit(0.0), v), F.lit(most))
    moved = blocks.select(
        "page", F.col("slot").cast("bigint").alias("slot"), normal_type(F.col("b.type")).alias("type"), F.coalesce("b.content", F.lit("")).alias("text"),
        clamp(at(0), page_width).alias("x0"), clamp(page_height - at(3), page_height).alias("y0"), clamp(at(2), page_width).alias("x1"), clamp(page_height - at(1), page_height).alias("y1"),
        F.size("b.bbox").alias("n"),
    )
    boxed = F.coalesce("n", F.lit(0)) == 4
    moved = moved.withColumns({c: F.when(boxed, F.col(c)).otherwise(0.0) for c in ("x0", "y0", "x1", "y1")})
    reason = F.when(~boxed, "no box").when((F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")), "no area").when(F.trim("text") == "", "no text")
    return moved.withColumn("reason", F.coalesce(reason, F.lit("valid"))).drop("n")


def slot_successors(blocks: DataFrame) -> DataFrame:
    """Edges between neighbouring slots that are both valid; an invalid slot is never bridged."""
    w = Window.partitionBy("page").orderBy("slot")
    after = blocks.select("page", "slot", "reason", F.lead("slot").over(w).alias("target"), F.lead("reason").over(w).alias("r2"))
    return after.where("reason = 'valid' AND r2 = 'valid'").select("page", F.col("slot").alias("source"), "target")


def sibling_runs(nodes: DataFrame, least: int = 2) -> DataFrame:
    """Runs of ``least`` or more neighbouring text siblings (page, parent, pos, type) that nothing else breaks."""
    w = Window.partitionBy("page", "parent").orderBy("pos")
    is_text = F.col("type") == "text"
    started = nodes.withColumn("is_new", F.when(is_text & F.coalesce(F.lag(is_text).over(w), F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("is_new").over(w))
    grouped = started.where(is_text).groupBy("page", "parent", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("members"))
    return grouped.where(F.col("members") >= least).drop("run")


def stream_edges(ordered: DataFrame, stream: str, rank: str) -> DataFrame:
    """Neighbours inside streams as edges, and hand-overs between streams of a page as review transitions."""
    inside = Window.partitionBy("page", stream).orderBy(rank)
    page = Window.partitionBy("page").orderBy(rank)
    own = ordered.select("page", F.col("idx").alias("source"), F.lead("idx").over(inside).alias("target"), F.lit("successor").alias("kind"))
    across = ordered.select(
        "page", F.col("idx").alias("source"), F.lead("idx").over(page).alias("target"), F.lit("review").alias("kind"),
        (F.lead(stream).over(page) != F.col(stream)).alias("changes"),
    ).where("changes").drop("changes")
    return own.where("target IS NOT NULL").unionByName(across.where("target IS NOT NULL"))


def relation_quality(actual: DataFrame, truth: DataFrame) -> DataFrame:
    """Labelled edges (page, source, target) against places (page, idx, place): precedence holds if the target is later;
    succession also if no other labelled element lies between.
    """
    at = lambda end: actual.select("page", F.col("idx").alias(end), F.col("place").alias(f"{end}_at"))
    labelled = truth.select("page", F.explode(F.array("source", "target")).alias("idx")).distinct().join(actual.select("page", "idx", "place"), ["page", "idx"])
    ranked = labelled.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy("place")))
    number = lambda end: ranked.select("page", F.col("idx").alias(end), F.col("n").alias(f"{end}_n"))
    both = truth.select("page", "source", "target").join(at("source"), ["page", "source"], "left").join(at("target"), ["page", "target"], "left")
    both = both.join(number("source"), ["page", "source"], "left").join(number("target"), ["page", "target"], "left")
    return both.groupBy("page").agg(
        F.count("*").alias("edges"), F.count_if(F.expr("source_at < target_at")).alias("precedence"), F.count_if(F.expr("target_n = source_n + 1")).alias("successor")
    )


def line_edit_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edit distance between the lines of a page (page, place, text) as units: each distinct line becomes one character."""
    both = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    code = F.dense_rank().over(Window.partitionBy("page").orderBy("text")) + 0x4E00
    coded = both.withColumn("c", F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE"))
    side = lambda s: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("place", "c")))), lambda x: x["c"]), "")
    return coded.groupBy("page").agg(side("a").alias("a"), side("b").alias("b")).select("page", F.levenshtein("a", "b").cast("bigint").alias("distance"))


def zone(y0: Column, y1: Column, page_height: float) -> Column:
    center = (y0 + y1) / 2 / page_height
    return F.when(center < 0.1, "top").when(center > 0.9, "bottom").otherwise("body")


def matched_characters(a: str, b: str) -> int:
    """Characters in the matching blocks of ``difflib.SequenceMatcher(None, a, b)``, found by searches for substrings.

    The longest block without popular characters of ``b``, the first of equal ones, grows by equal characters
    at both ends; the same is done before and after it. In texts of 200 characters and more those are popular
    that make up over a hundredth.
    """
    n, popular = len(b), set()
    if n >= 200:
        popular = {c for c, k in Counter(b).items() if k > n // 100 + 1}
    usable = set(b) - popular
    runs, start = [], None
    for i, c in enumerate(a):
        if c not in usable:
            if start is not None:
                runs.append((start, i))
                start = None
        elif start is None:
            start = i
    if start is not None:
        runs.append((start, len(a)))
    ends = [e for _, e in runs]
    found, total, todo = b.find, 0, [(0, len(a), 0, n)]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        size, at, to, r = 0, alo, blo, bisect_right(ends, alo)
        while r < len(runs) and runs[r][0] < ahi and size < bhi - blo:
            i, end = max(runs[r][0], alo), min(runs[r][1], ahi)
            while i + size < end:
                j = found(a[i : i + size + 1], blo, bhi)
                if j >= 0:
                    while j >= 0:
                        size, at, to = size + 1, i, j
                        while i + size < end and j + size < bhi and a[i + size] == b[j + size]:
                            size += 1
                        j = found(a[i : i + size + 1], j, bhi) if i + size < end else -1
                i += 1
            r += 1
        while at > alo and to > blo and a[at - 1] == b[to - 1]:
            at, to, size = at - 1, to - 1, size + 1
        while at + size < ahi and to + size < bhi and a[at + size] == b[to + size]:
            size += 1
        if size:
            total += size
            if alo < at and blo < to:
                todo.append((alo, at, blo, to))
            if at + size < ahi and to + size < bhi:
                todo.append((at + size, ahi, to + size, bhi))
    return total


def _matched_ratio(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Share of characters in matching blocks, for which SQL has no function; null where either text is, 0 if common characters can't reach ``least``."""

    def ratio(x: str, y: str, at_least: float) -> float:
        if at_least > 0 and 2 * (Counter(x) & Counter(y)).total() < at_least * (len(x) + len(y)):
            return 0.0
        return 2.0 * matched_characters(x, y) / (len(x) + len(y))

    return pd.Series([None if x is None or y is None else ratio(x, y, m) for x, y, m in zip(a, b, least, strict=True)], dtype="float64")


def plain_text(c: Column) -> Column:
    """Lower case with single spaces."""
    return F.btrim(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def is_meaningful(plain: Column) -> Column:
    """Whether a text has two letters or digits."""
    return plain.rlike(r"(?s)[\p{L}\p{N}].*?[\p{L}\p{N}]")


def decided_similarity(x: Column, y: Column, meaningful: Column) -> Column:
    """The similarity of plain texts where no characters have to be matched, else null."""
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(~meaningful, 0.0).when(F.contains(x, y) | F.contains(y, x), 1.0)


def similarity_bound(x: Column, y: Column) -> Column:
    """What the share of characters in matching blocks can be at most, by the lengths of both texts."""
    return 2 * F.least(F.length(x), F.length(y)) / F.greatest(F.length(x) + F.length(y), F.lit(1))


def matched_similarity(decided: Column, x: Column, y: Column, least: Column | None = None) -> Column:
    """``decided``, or where it is null the share of characters in matching blocks; 0 may stand for a share below ``least``."""
    ratio = F.pandas_udf(_matched_ratio, "double")
    return F.coalesce(decided, ratio(F.when(decided.isNull(), x), F.when(decided.isNull(), y), F.lit(0.0) if least is None else least))


def text_similarity(a: Column, b: Column) -> Column:
    """Of texts in lower case with single spaces: 1 if equal, or if one holds the other; else the share of characters in matching blocks.

    0 if one is empty, or if they differ and one has fewer than two letters and digits. Only
    texts that are not decided by that are compared in Python.
    """
    x, y = plain_text(a), plain_text(b)
    return matched_similarity(decided_similarity(x, y, is_meaningful(x) & is_meaningful(y)), x, y)


def style_ids(elements: DataFrame, signature: Column) -> DataFrame:
    """Styles numbered by their first appearance in a document (page, idx): equal signatures share a number."""
    signed = elements.withColumn("sig", signature)
    first = signed.groupBy("page", "sig").agg(F.min("idx").alias("first"))
    numbered = first.withColumn("style", F.row_number().over(Window.partitionBy("page").orderBy("first")).cast("bigint"))
    return signed.join(numbered, ["page", "sig"]).select("page", "idx", "style")


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of the JSON of columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
