"""Features of pairs and pages as named columns, for the learned operators."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.geometry import Box, overlap_1d
from leafline.operators.matching import BOX, side
from leafline.operators.pages import by_pairs, pair_places


def _at_least_one(c: Column) -> Column:
    return F.greatest(c, F.lit(1.0))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def relative_boxes(a: Box, b: Box, width: float, height: float) -> dict[str, Column]:
    """Both boxes, their sizes and the step between their centres, as shares of the page."""
    scale = {"x0": width, "y0": height, "x1": width, "y1": height}
    out = {f"{p}_{c}": getattr(box, c) / scale[c] for p, box in (("source", a), ("target", b)) for c in BOX}
    for p, box in (("source", a), ("target", b)):
        out |= {f"{p}_width": _at_least_one(box.width) / width, f"{p}_height": _at_least_one(box.height) / height}
    dx, dy = (b.center_x - a.center_x) / width, (b.center_y - a.center_y) / height
    return out | {"dx": dx, "dy": dy, "abs_dx": F.abs(dx), "abs_dy": F.abs(dy)}


def shared(a: Box, b: Box) -> dict[str, Column]:
    """Overlap on each axis as a share of the smaller side."""
    return {
        "x_shared": overlap_1d(a.x0, a.x1, b.x0, b.x1) / F.least(_at_least_one(a.width), _at_least_one(b.width)),
        "y_shared": overlap_1d(a.y0, a.y1, b.y0, b.y1) / F.least(_at_least_one(a.height), _at_least_one(b.height)),
    }


def order_features(ranks: list[str], n: Column) -> dict[str, Column]:
    """For each order with ranks ``a_<order>`` and ``b_<order>`` in 0 to 1: their difference, its sign, and whether they are neighbours."""
    near = 1 / F.greatest(n - 1, F.lit(1)) + 1e-9
    out = {}
    for name in ranks:
        step = F.col(f"b_{name}") - F.col(f"a_{name}")
        out |= {f"{name}_step": step, f"{name}_forward": _flag(step > 0), f"{name}_adjacent": _flag(F.abs(step) <= near)}
    return out


def normalized_ranks(ordered: DataFrame, *ranks: str) -> DataFrame:
    """One-based ranks of a page as 0 to 1; the only element of a page has 0."""
    n = F.greatest(F.count("*").over(Window.partitionBy("page")) - 1, F.lit(1))
    return ordered.select("page", "idx", *[F.round((F.col(r) - 1) / n, 8).alias(r) for r in ranks])


def pair_order_features(pairs: DataFrame, elements: DataFrame, ranked: DataFrame, roles: list[str], width: float, height: float) -> DataFrame:
    """Geometry, steps in every candidate order and one-hot roles of pairs (page, source, target).

    ``ranked``: (page, idx, one column of 0 to 1 for each order); ``elements`` have a role; one not in ``roles`` counts as the last of them.
    """
    names = [c for c in ranked.columns if c not in ("page", "idx")]
    known = elements.join(ranked, ["page", "idx"])
    both = pairs.select("page", F.col("source").alias("a_idx"), F.col("target").alias("b_idx"))
    for p in ("a_", "b_"):
        both = both.join(side(known, p, "idx", "role", *names), ["page", f"{p}idx"])
    n = elements.groupBy("page").agg(F.count("*").alias("n"))
    a, b = Box.of("a_"), Box.of("b_")
    own = relative_boxes(a, b, width, height) | shared(a, b)
    own |= {"below": _flag(b.y0 >= a.y0), "right": _flag(b.x0 >= a.x0), "log_size": F.log1p("n") / 5}
    own |= order_features(names, F.col("n"))
    for p, end in (("a_", "source"), ("b_", "target")):
        role = F.when(F.col(f"{p}role").isin(roles), F.col(f"{p}role")).otherwise(roles[-1])
        own |= {f"{end}_is_{r}": _flag(role == r) for r in roles}
    return both.join(n, "page").select("page", F.col("a_idx").alias("source"), F.col("b_idx").alias("target"), *[F.round(c, 8).alias(k) for k, c in own.items()])


def paragraph_features(pairs: DataFrame, elements: DataFrame, width: float) -> DataFrame:
    """Features that tell whether two text lines (page, source, target, adjacent, selected, forward, reverse) are of one paragraph.

    Steps count in mean line heights; the texts add their lengths, the mark at the end of one and the first character of the other.
    """
    both = pairs.withColumnsRenamed({"source": "a_idx", "target": "b_idx"})
    for p in ("a_", "b_"):
        both = both.join(side(elements, p, "idx", "text"), ["page", f"{p}idx"])
    a, b = Box.of("a_"), Box.of("b_")
    line = _at_least_one((a.height + b.height) / 2)
    ratio = lambda x, y: F.least(x, y) / F.greatest(x, y, F.lit(1e-9))
    first, second = F.trim(F.coalesce("a_text", F.lit(""))), F.trim(F.coalesce("b_text", F.lit("")))
    end, begin = F.right(first, F.lit(1)), F.left(second, F.lit(1))
    out = {
        "left_step": (b.x0 - a.x0) / line, "right_step": (b.x1 - a.x1) / line, "gap": (b.y0 - a.y1) / line, "top_step": (b.y0 - a.y0) / line,
        "x_shared": shared(a, b)["x_shared"], "width_ratio": ratio(a.width, b.width), "height_ratio": ratio(a.height, b.height),
        "source_left": a.x0 / width, "target_left": b.x0 / width, "source_width": a.width / width, "target_width": b.width / width,
        "source_length": F.log1p(F.length(first)), "target_length": F.log1p(F.length(second)),
        "ends_sentence": _flag(end.isin(".", "!", "?")), "ends_clause": _flag(end.isin(";", ":")), "ends_open": _flag(end.isin(",", "-", "­")),
        "starts_lower": _flag(begin.rlike("[a-zà-öø-ÿ]")), "starts_upper": _flag(begin.rlike("[A-ZÀ-ÖØ-Þ]")), "starts_digit": _flag(begin.rlike("[0-9]")),
        "adjacent": _flag(F.col("adjacent")), "selected": _flag(F.col("selected")), "forward": F.col("forward").cast("double"), "reverse": F.col("reverse").cast("double"),
    }
    return both.select("page", F.col("a_idx").alias("source"), F.col("b_idx").alias("target"), *[F.round(c, 8).alias(k) for k, c in out.items()])


def floating_features(pairs: DataFrame, elements: DataFrame, width: float, height: float) -> DataFrame:
    """Features of a figure or table (source, with ``kind``) and a text that may caption it (target, with ``lines``)."""
    both = pairs.withColumnsRenamed({"source": "a_idx", "target": "b_idx"})
    both = both.join(side(elements, "a_", "idx", "kind"), ["page", "a_idx"]).join(side(elements, "b_", "idx", "text", "lines"), ["page", "b_idx"])
    a, b = Box.of("a_"), Box.of("b_")
    text = F.lower(F.trim(F.coalesce("b_text", F.lit(""))))
    begins = lambda *words: _flag(_any([F.startswith(text, F.lit(w)) for w in words]))
    out = {"is_figure": _flag(F.col("a_kind") == "figure"), "is_table": _flag(F.col("a_kind") == "table")} | relative_boxes(a, b, width, height)
    out |= {
        "x_shared": shared(a, b)["x_shared"], "below": _flag(b.y0 >= a.y1), "above": _flag(a.y0 >= b.y1), "lines": F.least(F.coalesce("b_lines", F.lit(1)), F.lit(16)) / 16,
        "length": F.log1p(F.length(text)) / 8, "figure_word": begins("figure ", "fig. ", "fig "), "table_word": begins("table "),
        "figure_sign": begins("图 ", "图表 "), "table_sign": begins("表 "),
    }
    return both.select("page", F.col("a_idx").alias("source"), F.col("b_idx").alias("target"), *[F.round(c, 8).alias(k) for k, c in out.items()])


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def borda_order(pairwise: DataFrame, ranked: DataFrame) -> DataFrame:
    """Order from probabilities that one comes before another (page, source, target, p): both directions are averaged and summed by element.

    Ties go by the visual rank of ``ranked`` (page, idx, visual_rank).
    """
    back = pairwise.select("page", F.col("source").alias("target"), F.col("target").alias("source"), F.col("p").alias("q"))
    both = pairwise.join(back, ["page", "source", "target"], "left").withColumn("p", (F.col("p") + 1 - F.coalesce("q", 1 - F.col("p"))) / 2)
    score = both.groupBy("page", F.col("source").alias("idx")).agg(F.round(F.sum("p"), 8).alias("score"))
    out = ranked.select("page", "idx", "visual_rank").join(score, ["page", "idx"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    w = Window.partitionBy("page").orderBy(F.desc("score"), "visual_rank")
    return out.select("page", "idx", "score", F.row_number().over(w).cast("bigint").alias("place"))


def _below(table: pa.Table, cuts: np.ndarray, k: int, height: float) -> list[np.ndarray]:
    """The ``k`` nearest lines below each line, of its band and the next, that share width with it; ties go to the left one."""
    page, idx = table["page"].to_numpy(), table["idx"].to_numpy()
    x0, y0, x1, y1 = (table[c].to_numpy().astype(float) for c in BOX)
    a, b = pair_places(cuts)
    band = np.floor(y0 / height)
    step = band[b] - band[a]
    near = (idx[a] != idx[b]) & (y0[b] >= y1[a]) & ((step == 0) | (step == 1)) & (np.fmin(x1[a], x1[b]) - np.fmax(x0[a], x0[b]) > 0)
    a, b = a[near], b[near]
    order = np.lexsort((y0[b] - y1[a], a))  # stable: rows come by left edge
    a, b = a[order], b[order]
    first = np.arange(len(a)) - np.searchsorted(a, a) < k
    return [page[a[first]], idx[a[first]], idx[b[first]]]


def local_candidates(elements: DataFrame, base: DataFrame, relations: DataFrame, k: int = 3, height: float = 120.0) -> DataFrame:
    """Pairs of text lines that may be of one paragraph: neighbours in the base order, related ones, and the ``k`` nearest below.

    Lines meet in bands of ``height``, so a page of many lines is not paired as a whole.
    """
    boxed = elements.select("page", "idx", *[F.col(c).cast("double").alias(c) for c in BOX])
    local = by_pairs(boxed, ["x0", "idx"], partial(_below, k=k, height=height), "page bigint, source bigint, target bigint")
    return local.unionByName(base.select("page", "source", "target")).unionByName(relations.select("page", "source", "target")).distinct()


def page_profile(elements: DataFrame, disagreement: DataFrame) -> DataFrame:
    """Numbers that describe a page as a whole: how many elements, how large and wide they are, how mixed their roles, how far orders differ."""
    b = Box.of()
    quantiles = [(f"{n}_q{int(100 * q)}", F.percentile(c, F.lit(q))) for n, c in (("width", b.width), ("height", b.height), ("area", b.area)) for q in (0.1, 0.5, 0.9)]
    share = elements.groupBy("page", "role").agg(F.count("*").alias("n"))
    total = Window.partitionBy("page")
    entropy = share.withColumn("p", F.col("n") / F.sum("n").over(total)).groupBy("page").agg(F.sum(-F.col("p") * F.log2("p")).alias("role_entropy"), F.max("p").alias("main_role_share"))
    sizes = elements.groupBy("page").agg(
        F.log1p(F.count("*")).alias("log_count"), *[c.alias(n) for n, c in quantiles], F.avg(b.width / F.greatest(b.height, F.lit(1.0))).alias("aspect")
    )
    out = sizes.join(entropy, "page").join(disagreement, "page", "left")
    return out.select("page", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in out.columns if c != "page"])


def envelope_status(profiles: DataFrame, envelope: DataFrame) -> DataFrame:
    """Pages whose numbers all lie in an envelope (name, low, high), and the names of those that do not."""
    names = [c for c in profiles.columns if c != "page"]
    long = profiles.select("page", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("v")).select("page", "v.*")
    odd = long.join(envelope, "name").withColumn("out", (F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))
    return odd.groupBy("page").agg(
        F.count_if("out").alias("outliers"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("out"), F.col("name")))), ",").alias("names")
    ).withColumn("inside", F.col("outliers") == 0)


def profile_envelope(profiles: DataFrame, low: float = 0.01, high: float = 0.99, accuracy: int = 10_000) -> DataFrame:
    """(name, low, high) of each number of profiles; approximate percentiles, so that no task holds all values."""
    names = [c for c in profiles.columns if c != "page"]
    row = profiles.agg(*[F.percentile_approx(n, F.array(F.lit(low), F.lit(high)), accuracy).alias(n) for n in names])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.get(n, F.lit(0)).alias("low"), F.get(n, F.lit(1)).alias("high")) for n in names])).alias("e")).select("e.*")
