"""Roles, geometry classes, degradation, replacement text, edits and trees of elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.geometry import Box, gap_1d, overlap_1d
from leafline.functions.text import caption_kind, glyph_width, hash_bucket
from leafline.operators.pages import by_page


def element_roles(elements: DataFrame, page_height: float) -> DataFrame:
    """One role by priority: artifact, caption, heading, footnote, emphasis, empty, paragraph."""
    median = F.median(F.col("y1") - F.col("y0")).over(Window.partitionBy("page"))
    h, text = F.col("y1") - F.col("y0"), F.col("text")
    role = (
        F.when((F.col("y1") <= 0.08 * page_height) & (F.length(text) <= 40), "artifact").when(caption_kind(text).isNotNull(), "caption")
        .when(h >= 1.4 * F.col("m"), "heading").when(h <= 0.85 * F.col("m"), "footnote").when(F.length(F.trim(text)) == 0, "empty")
        .when(text == F.upper(text), "emphasis").otherwise("paragraph")
    )
    return elements.withColumn("m", median).select("page", "idx", role.alias("role"))


def page_strata(elements: DataFrame, page_width: float) -> DataFrame:
    """Layout class of a page by its narrow lines on either side of the middle and by wide lines."""
    middle = page_width / 2
    narrow = (F.col("x1") - F.col("x0")) < 0.55 * page_width
    counts = elements.groupBy("page").agg(
        F.count_if(narrow & (F.col("x1") <= middle)).alias("left_lines"), F.count_if(narrow & (F.col("x0") >= middle)).alias("right_lines"), F.count_if(~narrow).alias("wide_lines")
    )
    both = (F.col("left_lines") >= 3) & (F.col("right_lines") >= 3)
    name = F.when(both & (F.col("wide_lines") > 0), "mixed").when(both, "columns").when(F.col("wide_lines") > 0, "single").otherwise("sparse")
    return counts.withColumn("stratum", name)


def degraded(elements: DataFrame, seed: str, drop: float = 0.1, jitter: float = 2.0, mask: float = 0.05) -> DataFrame:
    """Elements with noise that depends on seed, page and index alone: some missing, boxes moved, some texts masked."""
    part = lambda tag: hash_bucket(F.concat_ws(":", F.lit(seed), F.lit(tag), F.col("page"), F.col("idx")), 10_000) / 10_000
    move = lambda tag: jitter * (2 * part(tag) - 1)
    noisy = elements.withColumn("dx", F.round(move("x"), 6)).withColumn("dy", F.round(move("y"), 6)).where(part("drop") >= drop)
    boxes: list[Column] = [(F.col(c) + F.col("dx" if c[0] == "x" else "dy")).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return noisy.select("page", "idx", F.when(part("mask") < mask, F.lit("")).otherwise(F.col("text")).alias("text"), *boxes)


def nearest_profile(rates: DataFrame, profiles: dict[str, list[float]], columns: list[str]) -> DataFrame:
    """The profile with the least root mean square distance to the rates of each row; the first by name of equal ones."""
    scored = F.array(*[
        F.struct(F.round(F.sqrt(sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip(columns, values, strict=True)), F.lit(0.0)) / len(values)), 8).alias("distance"), F.lit(name).alias("profile"))
        for name, values in sorted(profiles.items())
    ])
    return rates.withColumn("best", F.array_min(scored)).select("*", "best.profile", "best.distance").drop("best")


def replacement_fit(elements: DataFrame, text: Column, size: float = 8.0, line: float = 1.2, least: float = 0.6) -> DataFrame:
    """How a new text fits a box: natural width, wrapped lines, scale that makes it fit, and overflow below ``least``."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    natural = F.round(glyph_width(text, F.lit(size)), 6)
    lines = F.greatest(F.lit(1), F.ceil(F.col("natural") / F.greatest(F.col("w"), F.lit(1.0))))
    scale = F.round(F.least(F.lit(1.0), F.sqrt(F.col("w") * F.col("h") / F.greatest(F.col("natural") * size * line, F.lit(1e-9)))), 8)
    return elements.withColumn("natural", natural).withColumn("w", width).withColumn("h", height).select(
        "page", "idx", "natural", lines.cast("bigint").alias("lines"), scale.alias("scale"), (scale < least).alias("overflows")
    )


def padding_conflicts(elements: DataFrame, padding: float = 4.0) -> DataFrame:
    """Neighbours closer than ``padding`` on one axis that overlap on the other, and by how much it is undercut."""
    a, b = Box.of("a_"), Box.of("b_")
    cols = ["idx", "x0", "y0", "x1", "y1"]
    left = elements.select("page", *[F.col(c).alias(f"a_{c}") for c in cols])
    right = elements.select("page", *[F.col(c).alias(f"b_{c}") for c in cols])
    gx, gy = gap_1d(a.x0, a.x1, b.x0, b.x1), gap_1d(a.y0, a.y1, b.y0, b.y1)
    ox, oy = overlap_1d(a.x0, a.x1, b.x0, b.x1), overlap_1d(a.y0, a.y1, b.y0, b.y1)
    near = ((ox > 0) & (gy < padding)) | ((oy > 0) & (gx < padding))
    return left.join(right, "page").where("a_idx < b_idx").where(near).groupBy("page", F.col("a_idx").alias("idx")).agg(
        F.count("*").alias("conflicts"), F.max(padding - F.greatest(gx, gy)).alias("undercut")
    )


def pseudo_translation(elements: DataFrame, ratio: float = 1.3) -> DataFrame:
    """Texts lengthened to ``ratio`` by repeating their own start, for layout stress tests; only texts with letters."""
    text, n = F.col("text"), F.length("text")
    target = F.ceil(n * ratio).cast("int")
    longer = F.substring(F.repeat(F.concat(text, F.lit(" ")), 2), F.lit(1), target)
    eligible = (n >= 2) & text.rlike("[A-Za-z]")
    out = F.when(eligible, longer).otherwise(text)
    return elements.select("page", "idx", out.alias("text"), (F.length(out) - n).cast("bigint").alias("added"))


def apply_edits(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """Elements with edited texts; an edit (page, idx, source_text, text) counts only if its source text is still there.

    An element stays one row whatever edits it has; of several that count the least text is taken. Null texts are empty.
    """
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = edits.groupBy("page", "idx", plain("source_text").alias("source_text")).agg(F.min("text").alias("text"))
    known = one.groupBy("page", "idx").agg(F.map_from_entries(F.collect_list(F.struct("source_text", "text"))).alias("edits"))
    joined = elements.join(known, ["page", "idx"], "left").withColumn("edited", F.try_element_at("edits", plain("text")))
    status = F.when(F.col("edited").isNotNull(), "applied").when(F.col("edits").isNotNull(), "stale").otherwise("unchanged")
    return joined.select("page", "idx", F.coalesce("edited", "text").alias("text"), status.alias("status"))


def tree_preorder(nodes: DataFrame) -> DataFrame:
    """Pre-order of the trees of each page (page, node, parent, pos): children by pos, then number; nodes that no root leads to are left out."""

    def run(page: dict[str, list]) -> list[list]:
        children: dict[int | None, list[int]] = {}
        for node, parent in zip(page["node"], page["parent"], strict=True):
            children.setdefault(parent, []).append(node)
        out, stack, seen = [], [(n, 0) for n in reversed(children.get(None, []))], set()
        while stack:
            node, depth = stack.pop()
            if node not in seen:
                seen.add(node)
                out.append((node, depth, len(out) + 1))
                stack += [(n, depth + 1) for n in reversed(children.get(node, []))]
        return [list(c) for c in zip(*out, strict=True)]

    return by_page(nodes.select("page", "node", "parent", "pos"), ["pos", "node"], run, "page bigint, node bigint, depth bigint, place bigint")


def anchor_paths(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Pairs of anchors (page, idx) between which a path of edges leads that passes no other anchor, with its least number of steps."""
    marked = edges.select("page", "source", "target").join(anchors.select("page", F.col("idx").alias("source"), F.lit(True).alias("from_anchor")), ["page", "source"], "left")
    marked = marked.join(anchors.select("page", F.col("idx").alias("target"), F.lit(True).alias("to_anchor")), ["page", "target"], "left")

    def run(page: dict[str, list]) -> list[list]:
        after: dict[int, list[tuple[int, bool]]] = {}
        for s, t, stop in zip(page["source"], page["target"], page["to_anchor"], strict=True):
            after.setdefault(s, []).append((t, bool(stop)))
        out = []
        for origin in sorted({s for s, a in zip(page["source"], page["from_anchor"], strict=True) if a}):
            steps, front, seen, reached = 0, [origin], set(), {}
            while front:
                steps, ahead = steps + 1, []
                for node in front:
                    for target, stop in after.get(node, ()):
                        if stop:
                            reached.setdefault(target, steps)
                        elif target not in seen:
                            seen.add(target)
                            ahead.append(target)
                front = ahead
            out += [(origin, target, n) for target, n in sorted(reached.items())]
        return [list(c) for c in zip(*out, strict=True)]

    return by_page(marked, ["source", "target"], run, "page bigint, origin bigint, reached bigint, steps bigint")
