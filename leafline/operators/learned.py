"""Learned successor edges: features, a gradient-boosted classifier, and thresholds frozen on held-out documents."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.geometry import Box, gap_1d, horizontal_overlap_ratio, vertical_overlap_ratio
from leafline.functions.text import hash_bucket
from leafline.operators.metrics import ratio
from leafline.operators.order import nearest_pairs

FEATURES = ["dx", "dy", "gap_x", "gap_y", "overlap_x", "overlap_y", "height_ratio", "width_ratio", "left_delta", "below", "rank_gap"]


def pair_features(elements: DataFrame, nearest: int = 20) -> DataFrame:
    """The ``nearest`` targets of each source by axis gaps, with features; ``visual_rank`` is needed."""
    near = nearest_pairs(elements, nearest, "visual_rank")
    a, b = Box.of("a_"), Box.of("b_")
    gx, gy = gap_1d(a.x0, a.x1, b.x0, b.x1), gap_1d(a.y0, a.y1, b.y0, b.y1)
    values: dict[str, Column] = {
        "dx": b.center_x - a.center_x, "dy": b.center_y - a.center_y, "gap_x": gx, "gap_y": gy, "overlap_x": horizontal_overlap_ratio(a, b),
        "overlap_y": vertical_overlap_ratio(a, b), "height_ratio": a.height / F.greatest(b.height, F.lit(1.0)), "width_ratio": a.width / F.greatest(b.width, F.lit(1.0)),
        "left_delta": F.abs(a.x0 - b.x0), "below": (b.y0 > a.y0).cast("double"), "rank_gap": (F.col("b_visual_rank") - F.col("a_visual_rank")).cast("double"),
    }
    return near.select("page", F.col("a_idx").alias("source"), F.col("b_idx").alias("target"), *[values[f].alias(f) for f in FEATURES])


def labelled(features: DataFrame, truth: DataFrame) -> DataFrame:
    marked = truth.select("page", "source", "target", F.lit(1.0).alias("label"))
    return features.join(marked, ["page", "source", "target"], "left").na.fill(0.0, ["label"])


def fit_successors(examples: DataFrame, rounds: int = 10, depth: int = 4, seed: int = 7) -> GBTClassificationModel:
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(examples).select("features", "label")
    return GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, subsamplingRate=0.8).fit(data)


def scored(model: GBTClassificationModel, features: DataFrame) -> DataFrame:
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features)
    return model.transform(data).withColumn("score", F.round(vector_to_array("probability")[1], 8)).drop("features", "rawPrediction", "probability", "prediction")


def document_split(df: DataFrame, calibration_percent: int = 20) -> DataFrame:
    """Fit or calibration by a hash of the page."""
    return df.withColumn("part", F.when(hash_bucket(F.col("page"), 100) < calibration_percent, "calibration").otherwise("fit"))


def frozen_threshold(examples: DataFrame, least_precision: float = 0.5, least_selected: int = 20, steps: int = 100) -> DataFrame:
    """Of thresholds at score quantiles, the one with the highest F1 that meets the floors: one row, or none."""
    grid = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    cuts = examples.agg(F.percentile("score", grid).alias("q")).select(F.explode(F.array_distinct("q")).alias("threshold"))
    cells = examples.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    total = cells.agg(F.sum("p").alias("positives"))
    counts = cells.join(F.broadcast(cuts), F.col("score") >= F.col("threshold")).groupBy("threshold").agg(F.sum("n").alias("selected"), F.sum("p").alias("hits"))
    full = counts.join(F.broadcast(total))
    metrics = full.withColumn("precision", ratio("hits", "selected")).withColumn("f1", ratio(2 * F.col("hits"), F.col("selected") + F.col("positives")))
    met = metrics.where((F.col("precision") >= least_precision) & (F.col("selected") >= least_selected))
    return met.orderBy(F.desc("f1"), F.desc("threshold")).limit(1).select("threshold", "selected", "hits", "precision", "f1")


def feature_envelope(features: DataFrame, columns: list[str]) -> DataFrame:
    """1st and 99th percentile of each feature: (feature, low, high)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    long = features.select(F.explode(pairs).alias("p")).select("p.*")
    q = F.percentile("v", F.array(F.lit(0.01), F.lit(0.99)))
    return long.groupBy("feature").agg(q.alias("q")).select("feature", F.round(F.get("q", F.lit(0)), 8).alias("low"), F.round(F.get("q", F.lit(1)), 8).alias("high"))


def top_edges(edges: DataFrame, threshold: float) -> DataFrame:
    """The best target of each source with a score of ``threshold`` or more."""
    w = Window.partitionBy("page", "source").orderBy(F.desc("score"), "target")
    return edges.where(F.col("score") >= threshold).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def fold_of(df: DataFrame, key: str, stratum: str, folds: int) -> DataFrame:
    """Folds by round-robin in the order of a hash inside each stratum.

    Places are counted in 256 ranges of the hash, to which the sizes of all earlier ranges are added; so no task holds a whole stratum.
    """
    hashed = df.withColumn("_hash", F.sha2(F.col(key).cast("string"), 256)).withColumn("_range", F.substring("_hash", 1, 2))
    sizes = hashed.groupBy(stratum, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(stratum).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy(stratum, "_range").orderBy("_hash", key))
    placed = hashed.withColumn("_at", at).join(sizes.withColumn("_before", before).withColumnRenamed(stratum, "_stratum").withColumnRenamed("_range", "_own"), F.expr(f"{stratum} <=> _stratum AND _range = _own"))
    return placed.withColumn("fold", ((F.col("_at") + F.col("_before") - 1) % folds).cast("bigint")).select(*df.columns, "fold")
