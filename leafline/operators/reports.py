"""Reports: edges against labels, their roll-ups by page, kind and slice, and the thresholds and gates that follow from them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.text import wilson_lower
from leafline.operators.pages import by_lists

EDGE = ["page", "source", "target"]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 8)).otherwise(0.0)


def prf(correct: Column, predicted: Column, labels: Column) -> list[Column]:
    p, r = ratio(correct, predicted), ratio(correct, labels)
    f1 = F.when(predicted + labels > 0, F.round(2 * correct / (predicted + labels), 8)).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), f1.alias("f1")]


def edge_counts(predicted: DataFrame, truth: DataFrame, *by: str) -> DataFrame:
    """Correct, predicted and labelled edges for each value of ``by``, which both have; an edge counts only if both of its ends are labelled.

    The edges of a page are two sets in one row, so that no two tables of edges are sorted and joined.
    """
    keys, edge = [*by, "page"], F.struct("source", "target")
    known = predicted.where(" AND ".join(f"{c} IS NOT NULL" for c in [*by, *EDGE])).select(*keys, edge.alias("p"), F.lit(None).cast("struct<source:bigint,target:bigint>").alias("t"))
    labels = truth.select(*keys, F.lit(None).cast("struct<source:bigint,target:bigint>").alias("p"), edge.alias("t"))
    sets = known.unionByName(labels).groupBy(*keys).agg(F.collect_set("p").alias("p"), F.collect_set("t").alias("t"))
    ends = sets.withColumn("ends", F.array_distinct(F.flatten(F.transform("t", lambda x: F.array(x["source"], x["target"])))))
    scorable = ends.withColumn("p", F.filter("p", lambda x: F.array_contains("ends", x["source"]) & F.array_contains("ends", x["target"]))).where("size(p) > 0 OR size(t) > 0")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return scorable.groupBy(*by).agg(total(F.size(F.array_intersect("p", "t"))).alias("correct"), total(F.size("p")).alias("predicted"), total(F.size("t")).alias("labels"))


def edge_report(predicted: DataFrame, truth: DataFrame, *by: str) -> DataFrame:
    """:func:`edge_counts` with precision, recall and F1."""
    return edge_counts(predicted, truth, *by).select("*", *prf(F.col("correct"), F.col("predicted"), F.col("labels")))


def corpus_report(pages: DataFrame) -> DataFrame:
    """Roll-up of page counts (page, correct, predicted, labels): micro averages from the sums, macro averages over pages, and the worst page."""
    p = pages.select("*", *prf(F.col("correct"), F.col("predicted"), F.col("labels")))
    return p.agg(
        F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("correct", "predicted", "labels")],
        F.round(F.avg("f1"), 8).alias("macro_f1"), F.min_by("page", F.struct("f1", "page")).alias("worst_page"), F.count_if(F.col("f1") == 1).alias("exact_pages"),
    ).select("*", *prf(F.col("correct"), F.col("predicted"), F.col("labels")))


def membership_report(predicted: DataFrame, truth: DataFrame, edges: DataFrame) -> DataFrame:
    """Per page: labelled elements that got a region, pairs of neighbours in the same region right or wrong, and edges within and across regions.

    ``predicted`` and ``truth``: (page, idx, region); ``edges``: (page, source, target).
    """
    both = truth.select("page", "idx", F.col("region").alias("t")).join(predicted.select("page", "idx", F.col("region").alias("p")), ["page", "idx"], "left")
    recall = both.groupBy("page").agg(F.count("*").alias("labelled"), F.count("p").alias("assigned"))
    at = lambda end: both.select("page", F.col("idx").alias(end), F.col("t").alias(f"{end}_t"), F.col("p").alias(f"{end}_p"))
    e = edges.join(at("source"), ["page", "source"]).join(at("target"), ["page", "target"])
    same_t, same_p = F.col("source_t") == F.col("target_t"), F.coalesce(F.col("source_p") == F.col("target_p"), F.lit(False))
    links = e.groupBy("page").agg(F.count_if(same_t).alias("within"), F.count_if(same_t & same_p).alias("within_kept"), F.count_if(~same_t).alias("across"), F.count_if(~same_t & ~same_p).alias("across_kept"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return recall.join(links, "page", "left").select("page", "labelled", "assigned", *[zero(c) for c in ("within", "within_kept", "across", "across_kept")])


def pair_report(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs of elements (page, idx, region) of one region, by the sizes of groups and of their common parts: no pair is put out."""
    pairs = lambda n: F.sum(n * (n - 1) / 2).cast("bigint")
    known = predicted.join(truth.select("page", "idx", F.col("region").alias("t")), ["page", "idx"])
    size = lambda df, *by: df.groupBy("page", *by).agg(F.count("*").alias("n")).groupBy("page").agg(pairs(F.col("n")).alias("pairs"))
    c, p, t = size(known, "region", "t"), size(known, "region"), size(truth, "region")
    joined = t.withColumnRenamed("pairs", "labels").join(p.withColumnRenamed("pairs", "predicted"), "page", "left").join(c.withColumnRenamed("pairs", "correct"), "page", "left").fillna(0)
    return joined.select("page", "correct", "predicted", "labels", *prf(F.col("correct"), F.col("predicted"), F.col("labels")))


def native_support(edges: DataFrame, channels: DataFrame, labelled: DataFrame, truth: DataFrame) -> DataFrame:
    """For each provider edge: how many native channels (page, source, target, channel) have it, whether both ends are labelled, and if it is right."""
    votes = channels.groupBy(*EDGE).agg(F.count_distinct("channel").alias("support"))
    out = edges.select(*EDGE).distinct().join(votes, EDGE, "left").join(truth.select(*EDGE).distinct().withColumn("correct", F.lit(True)), EDGE, "left")
    for end in ("source", "target"):
        out = out.join(labelled.select("page", F.col("idx").alias(end)).distinct().withColumn(f"{end}_known", F.lit(True)), ["page", end], "left")
    scorable = F.col("source_known").isNotNull() & F.col("target_known").isNotNull()
    return out.select(*EDGE, F.coalesce("support", F.lit(0)).alias("support"), scorable.alias("scorable"), F.when(scorable, F.col("correct").isNotNull()).alias("correct"))


def support_gate(transitions: DataFrame, least_precision: float = 0.95, least_wilson: float = 0.9, least: int = 20) -> DataFrame:
    """The support from which transitions (support, scorable, correct) meet all limits: of the points that do, the one with most of them."""
    levels = transitions.where("scorable").groupBy("support").agg(F.count("*").alias("n"), F.count_if("correct").alias("c"))
    down = Window.partitionBy(F.lit(1)).orderBy(F.desc("support"))  # one row for each number of channels
    curve = levels.select("support", F.sum("n").over(down).alias("predicted"), F.sum("c").over(down).alias("correct"))
    curve = curve.withColumn("precision", ratio(F.col("correct"), F.col("predicted"))).withColumn("wilson", F.round(wilson_lower(F.col("correct"), F.col("predicted")), 8))
    passes = (F.col("precision") >= least_precision) & (F.col("wilson") >= least_wilson) & (F.col("predicted") >= least)
    return curve.withColumn("passes", passes)


def kind_report(matches: DataFrame) -> DataFrame:
    """Matched share of anchors (kind, partition, matched) by kind, by partition, by both and in all."""
    cube = matches.cube("kind", "partition").agg(F.count("*").alias("anchors"), F.count_if("matched").alias("matched"))
    return cube.select(F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce("partition", F.lit("all")).alias("partition"), "anchors", "matched", ratio(F.col("matched"), F.col("anchors")).alias("rate"))


def relation_audit(labelled: DataFrame, proposed: DataFrame) -> DataFrame:
    """Labelled and proposed targets (page, source, target) of each source side by side, with a status."""
    a = labelled.groupBy("page", "source").agg(F.min("target").alias("label"))
    b = proposed.groupBy("page", "source").agg(F.min("target").alias("proposal"))
    status = F.when(F.col("label").isNull(), "extra").when(F.col("proposal").isNull(), "missing").when(F.col("label") == F.col("proposal"), "agrees").otherwise("differs")
    return a.join(b, ["page", "source"], "full").withColumn("status", status)


def difference_summary(pages: DataFrame, limit: float = 0.02) -> DataFrame:
    """Pages (page, diff; null: without a partner): most, mean and 95th percentile, the worst page, and those over the limit or without a partner."""
    d = F.coalesce("diff", F.lit(1.0))
    return pages.agg(
        F.count("*").alias("pages"), F.max(d).alias("most"), F.round(F.avg(d), 8).alias("mean"), F.percentile_approx(d, F.lit(0.95), 10_000).alias("p95"),
        F.max_by("page", F.struct(d.alias("d"), -F.col("page"))).alias("worst_page"), F.count_if(d > limit).alias("mismatched"), F.count_if(F.col("diff").isNull()).alias("unmatched"),
    )


def totals_by_stream(replaced: DataFrame) -> DataFrame:
    """Overflows, conflicts and masks of replaced texts (stream, overflow, conflict, masked, scale) by stream."""
    return replaced.groupBy("stream").agg(
        F.count("*").alias("elements"), F.count_if("overflow").alias("overflows"), F.count_if("conflict").alias("conflicts"), F.count_if("masked").alias("masked"), F.min("scale").alias("least_scale")
    )


def score_histogram(scored: DataFrame, cells: int = 500, *by: str) -> DataFrame:
    """Scored edges (score in 0 to 1, scorable, correct) in ``cells`` equal cells: a table of fixed size, whatever the number of edges."""
    cell = F.least(F.floor(F.col("score") * cells), F.lit(cells - 1)).cast("int")
    return scored.groupBy(*by, cell.alias("cell")).agg(F.count("*").alias("selected"), F.count_if("scorable").alias("predicted"), F.count_if(F.col("scorable") & F.col("correct")).alias("correct"))


def threshold_curve(histogram: DataFrame, labels: DataFrame, cells: int = 500) -> DataFrame:
    """Precision over labelled ends, recall and F1 of all edges at or above each cell; ``labels``: one row with the number of labelled edges."""
    down = Window.partitionBy("all").orderBy(F.desc("cell"))
    h = histogram.withColumn("all", F.lit(1))
    at = h.select((F.col("cell") / cells).alias("threshold"), "all", *[F.sum(c).over(down).alias(c) for c in ("selected", "predicted", "correct")])
    joined = at.join(labels.select(F.col("labels"), F.lit(1).alias("all")), "all").drop("all")
    return joined.select("threshold", "selected", "predicted", "correct", "labels", *prf(F.col("correct"), F.col("predicted"), F.col("labels")))


def best_threshold(curve: DataFrame, least_precision: float, least: int) -> DataFrame:
    """Of the thresholds that meet both limits the one with the best F1, then precision, then the lower one; no row if none does."""
    passing = curve.where((F.col("precision") >= least_precision) & (F.col("predicted") >= least))
    best = passing.agg(F.max_by(F.struct(*curve.columns), F.struct("f1", "precision", -F.col("threshold"))).alias("x"))
    return best.where("x IS NOT NULL").select("x.*")


def noise_gate(profiles: DataFrame, least_precision: float, share: float = 0.01, least: int = 25) -> DataFrame:
    """The threshold at which every noise profile (profile, threshold, predicted, correct, labels) has its precision and enough edges.

    Of several: most correct edges in the worst profile, then in all, then the best worst precision, then the lowest threshold.
    """
    p = profiles.withColumn("precision", ratio(F.col("correct"), F.col("predicted")))
    ok = (F.col("precision") >= least_precision) & (F.col("predicted") >= F.greatest(F.lit(least), F.ceil(share * F.col("labels"))))
    by = p.groupBy("threshold").agg(
        F.min("correct").alias("least_correct"), F.sum("correct").alias("correct"), F.min("precision").alias("least_precision"), F.bool_and(ok).alias("passes")
    )
    best = by.where("passes").agg(F.max_by(F.struct("threshold", "least_correct", "correct", "least_precision"), F.struct("least_correct", "correct", "least_precision", -F.col("threshold"))).alias("x"))
    return best.where("x IS NOT NULL").select("x.*")


def best_candidate(cases: DataFrame, similarity: str, cost: str, seconds: str, *by: str) -> DataFrame:
    """Of the settings tried on a case the one most similar, then of the least cost, then the fastest."""
    return cases.groupBy(*by).agg(F.max_by("setting", F.struct(similarity, -F.col(cost), -F.col(seconds), -F.col("setting"))).alias("setting"), F.max(similarity).alias("similarity"))


def model_comparison(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Edge reports of two or more models (model, page, source, target) on the same labels, with the gain over the first by name."""
    models = predictions.select("model").distinct()
    report = edge_report(predictions, _for_each(truth, models), "model")
    w = Window.partitionBy("all").orderBy("model")
    return report.withColumn("all", F.lit(1)).withColumn("gain", F.round(F.col("f1") - F.first("f1").over(w), 8)).drop("all")


def _for_each(truth: DataFrame, models: DataFrame) -> DataFrame:
    """Labels once for each model; the names of models are few, and are kept in one array."""
    names = models.agg(F.collect_set("model").alias("names")).withColumn("all", F.lit(1))
    return truth.withColumn("all", F.lit(1)).join(names, "all").select(F.explode("names").alias("model"), *EDGE)


def _common(own: dict[int, Counter], target: dict[int, Counter]) -> list[list]:
    """For all pairs of pages with common tokens: how many, and how many both pages have."""
    code = {t: k for k, t in enumerate(dict.fromkeys(t for bag in own.values() for t in bag))}
    sizes = [[bag.total() for bag in side.values()] for side in (own, target)]
    pages, others = list(own), list(target)
    rows = []
    if (len(pages) + len(others)) * len(code) <= 4_000_000:
        grids = [np.zeros((len(side), len(code)), np.int64) for side in (own, target)]
        for grid, side in zip(grids, (own, target), strict=True):
            for row, bag in zip(grid, side.values(), strict=True):
                known = [(code[t], n) for t, n in bag.items() if t in code]
                if known:
                    at, n = zip(*known, strict=True)
                    row[list(at)] = n
        for i, row in enumerate(grids[0]):
            for j, c in enumerate(np.minimum(row, grids[1]).sum(axis=1).tolist()):
                if c:
                    rows.append((pages[i], others[j], c, sizes[0][i], sizes[1][j]))
    else:  # a long text, whose tokens lie in few of its pages
        places: dict[str, list[tuple[int, int]]] = {}
        for j, bag in enumerate(target.values()):
            for t, m in bag.items():
                places.setdefault(t, []).append((j, m))
        for i, bag in enumerate(own.values()):
            found: Counter = Counter()
            for t, n in bag.items():
                for j, m in places.get(t, ()):
                    found[j] += min(n, m)
            rows += [(pages[i], others[j], c, sizes[0][i], sizes[1][j]) for j, c in found.items()]
    return [list(c) for c in zip(*rows, strict=True)]


def _common_tokens(own: list[list], target: list[list]) -> list[list]:
    bags: list[dict[int, Counter]] = [{}, {}]
    for bag, (pages, tokens, counts) in zip(bags, (own, target), strict=True):
        for page, token, n in zip(pages, tokens, counts, strict=True):
            if token is not None:
                bag.setdefault(page, Counter())[token] += n
    return _common(*bags)


def _common_words(own: list[list], target: list[list]) -> list[list]:
    bags: list[dict[int, Counter]] = [{}, {}]
    for bag, (pages, texts) in zip(bags, (own, target), strict=True):
        for page, text in zip(pages, texts, strict=True):
            bag.setdefault(page, Counter()).update(filter(None, text.split(" ")))
    return _common(*bags)


def page_alignment(tokens: DataFrame, target: DataFrame, least_overlap: int = 3, least_f1: float = 0.5, margin: float = 0.05) -> DataFrame:
    """For each page of a document (doc, page, token, n) the page of another text of it with the best token F1, if it is clearly the best; else why not.

    Only pages of one document meet: a document is one row, and its pairs of pages are summed before they are ranked.
    """
    return _aligned(_by_document(tokens, target, "token", "n"), _common_tokens, least_overlap, least_f1, margin)


def text_alignment(texts: DataFrame, target: DataFrame, least_overlap: int = 3, least_f1: float = 0.5, margin: float = 0.05) -> DataFrame:
    """:func:`page_alignment` of the words of texts (doc, page, text), of which a page may have several; words are parted by single spaces."""
    return _aligned(_by_document(texts.where("text IS NOT NULL"), target.where("text IS NOT NULL"), "text"), _common_words, least_overlap, least_f1, margin)


def _by_document(own: DataFrame, target: DataFrame, *columns: str) -> DataFrame:
    listed = lambda df, name: df.where("doc IS NOT NULL").groupBy("doc").agg(F.collect_list(F.struct(F.col("page").cast("bigint").alias("page"), *columns)).alias(name))
    return listed(own, "a").join(listed(target, "b"), "doc").select(F.col("doc").cast("bigint").alias("page"), "a", "b")


def _aligned(both: DataFrame, common: Callable[[list[list], list[list]], list[list]], least_overlap: int, least_f1: float, margin: float) -> DataFrame:
    scored = by_lists(both, common, "page bigint, own bigint, other bigint, common bigint, a bigint, b bigint").select(F.col("page").alias("doc"), F.col("own").alias("page"), "other", "common", "a", "b")
    scored = scored.withColumn("f1", F.round(2 * F.col("common") / (F.col("a") + F.col("b")), 8))
    w = Window.partitionBy("doc", "page").orderBy(F.desc("f1"), F.desc("common"), "other")
    top = scored.withColumn("second", F.coalesce(F.lead("f1").over(w), F.lit(0.0))).withColumn("r", F.row_number().over(w)).where("r = 1")
    reason = F.when(F.col("common") < least_overlap, "few tokens").when(F.col("f1") < least_f1, "low f1").when(F.col("f1") - F.col("second") < margin, "ambiguous").otherwise("aligned")
    return top.select("doc", "page", F.when(reason == "aligned", F.col("other")).otherwise(F.col("page")).alias("aligned"), "f1", "second", reason.alias("reason"))
