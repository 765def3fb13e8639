"""Commands over tables: ``python -m leafline COMMAND --name value ...``.

Tables are folders or files of Parquet, JSON lines or CSV, by their ending; results
are written the same way. Elements have page, idx, text and a box; edges page,
source and target. Each command is one plan of the operators of this library, so
it can be called as a function of a session and named values too.
"""

from __future__ import annotations

import argparse
import inspect
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.operators import content, covers, features, learned, matching, metrics, order, reports, review, strategies, structure
from leafline.sources import payloads, sinks

COMMANDS: dict[str, Callable[..., DataFrame]] = {}
EDGE = ["page", "source", "target"]
#: Commands that start a browser, a renderer or a model outside of Spark; their output is read, not made, here.
EXTERNAL = [
    "capture-pdf", "run-paddleocr-vl", "run-paddle-layout", "run-paddle-layout-corpus", "run-pp-structure", "run-opendataloader", "run-docling",
    "run-surya-layout", "quality-check", "print-pdf", "compare-pdf",
]


def command(*names: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        COMMANDS.update(dict.fromkeys(names, f))
        return f

    return add


def read(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def write(df: DataFrame, path: str) -> None:
    writer = df.write.mode("overwrite")
    if path.endswith((".json", ".jsonl")):
        writer.json(path)
    elif path.endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def _order(elements: DataFrame, strategy: str, width: float) -> DataFrame:
    """(page, idx, place) by the strategy named."""
    if strategy == "visual-yx":
        return order.visual_order(elements).select("page", "idx", F.col("visual_rank").alias("place"))
    if strategy == "box-flow":
        return order.box_flow_order(elements).select("page", "idx", F.col("flow_rank").alias("place"))
    if strategy == "recursive-xy-cut":
        out = covers.recursive_xy_cut(elements)
    elif strategy == "relation-graph":
        columns = order.column_gap_split(elements)
        chosen = covers.max_regret_cover(order.topk_candidates(order.relation_scores(elements, columns, width, 792.0)))
        ranked = order.visual_order(elements).select("page", "idx", F.col("visual_rank").alias("rank"))
        out = covers.serialized_chains(ranked, chosen.select(*EDGE))
    elif strategy == "spatial-graph":
        out = covers.spatial_graph_order(elements, width)
    else:
        out = strategies.semantic_order(elements, width, strategy)
    place = next(c for c in ("place", "xy_rank") if c in out.columns)
    return out.select("page", "idx", F.col(place).cast("bigint").alias("place"))


@command("make-fixture")
def make_fixture(spark: SparkSession, out: str, answers: str, pages: int = 100) -> DataFrame:
    """Synthetic pages, and the order in which they are read beside them."""
    inputs, truth = payloads.split_answers(payloads.fixture_pages(spark, pages), ["page", "idx"], ["place"])
    write(truth, answers)
    return inputs.drop("shuffled")


@command("make-web-fixture")
def make_web_fixture(spark: SparkSession, out: str, pages: int = 100) -> DataFrame:
    """Synthetic pages as HTML."""
    return sinks.positioned_html(payloads.fixture_pages(spark, pages))


@command("fetch-roor", "fetch-chunkr-reading-order", "fetch-comphrdoc", "fetch-comphrdoc-provider-calibration", "fetch-comphrdoc-provider-test", "fetch-comphrdoc-relations")
def landed(spark: SparkSession, landing: str, out: str, answers: str, labels: str, key: str = "uid") -> DataFrame:
    """Landed samples as inputs without answers, in an order that tells nothing; ``labels``: names of the answer fields, with commas."""
    rows = spark.read.option("multiLine", True).json(landing)
    inputs, truth = payloads.split_answers(rows, [key], labels.split(","))
    if found := payloads.leaked(inputs, labels.split(",")):
        raise ValueError(f"inputs hold answers: {found}")
    write(truth, answers)
    return inputs


@command("materialize-comphrdoc-hierarchy", "materialize-provider-hierarchy", "materialize-graph-hierarchy")
def materialize_hierarchy(spark: SparkSession, elements: str, out: str, answers: str, labels: str = "region,place", train: int = 80) -> DataFrame:
    """Inputs in partitions by a hash of the page, and answers in a table of their own."""
    rows = read(spark, elements)
    inputs, truth = payloads.split_answers(rows, ["page", "idx"], labels.split(","))
    write(truth, answers)
    parts = metrics.hash_partition(rows.select("page").distinct(), "page", {"train": train, "calibration": (100 - train) // 2, "test": 100 - train - (100 - train) // 2})
    return inputs.join(parts, "page")


@command("export-hierarchy-input")
def export_hierarchy_input(spark: SparkSession, elements: str, out: str, labels: str = "place,region,reading_order") -> DataFrame:
    """Elements without any answer column, ready for an order proposal."""
    rows = read(spark, elements)
    return rows.drop(*payloads.leaked(rows, labels.split(",")))


@command("build-hierarchical-order")
def build_hierarchical_order(spark: SparkSession, elements: str, regions: str, out: str) -> DataFrame:
    """Edges inside regions and between them: elements get their region by coverage, regions their order by their first member."""
    e = read(spark, elements)
    member = matching.memberships(e, read(spark, regions)).select("page", "idx", "region")
    ranked = order.visual_order(e).join(member, ["page", "idx"], "left")
    return review.hierarchy(ranked.withColumn("region", F.coalesce("region", F.lit(-1).cast("bigint"))), "region", "visual_rank")


@command("propose-reading-sidecar")
def propose_reading_sidecar(spark: SparkSession, elements: str, out: str, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """The first three relation candidates of each element, with margins, and whether the visual order has them."""
    e = read(spark, elements)
    scored = order.topk_candidates(order.relation_scores(e, order.column_gap_split(e), width, height))
    return sinks.review_records(scored, order.successor_edges(order.visual_order(e)))


@command("propose-joint-graph")
def propose_joint_graph(spark: SparkSession, elements: str, out: str, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """Chains of relation edges, cut at column wraps and wide gaps: the parts are the paragraphs."""
    e = read(spark, elements)
    chosen = covers.max_regret_cover(order.topk_candidates(order.relation_scores(e, order.column_gap_split(e), width, height)))
    chains = covers.serialized_chains(order.visual_order(e).select("page", "idx", F.col("visual_rank").alias("rank")), chosen.select(*EDGE))
    return structure.split_chains(chains.select("page", "idx", "chain", F.col("pos").alias("place")).join(e, ["page", "idx"]))


@command("predict-paragraph-graph")
def predict_paragraph_graph(spark: SparkSession, edges: str, out: str, threshold: float = 0.5) -> DataFrame:
    """Components of scored same-paragraph edges at or above a threshold."""
    return covers.components(read(spark, edges).where(F.col("score") >= threshold).select(*EDGE))


@command("consensus-reading-sidecars")
def consensus_reading_sidecars(spark: SparkSession, edges: str, out: str, least: int = 2) -> DataFrame:
    """Edges (with provider and confidence) that at least so many providers have."""
    return matching.provider_consensus(read(spark, edges), least)


@command("benchmark-relation-rankers-roor", "benchmark-successor-decoder-ab", "benchmark-successor-transition-ab", "benchmark-structure-ab")
def compare_models(spark: SparkSession, predicted: str, truth: str, out: str) -> DataFrame:
    """Edge metrics of each model (column model) and the gain over the first."""
    return reports.model_comparison(read(spark, predicted), read(spark, truth))


@command("benchmark-comphrdoc-relations", "benchmark-successor-graph", "benchmark-provider-anchors", "benchmark-chunkr-order-ranker-roor")
def benchmark_edges(spark: SparkSession, predicted: str, truth: str, out: str) -> DataFrame:
    """Edges against labels by page, over edges whose ends are labelled, and the roll-up as page -1."""
    p, t = read(spark, predicted), read(spark, truth)
    pages = reports.edge_report(p.withColumn("group", F.col("page")), t.withColumn("group", F.col("page")), "group").withColumnRenamed("group", "page")
    whole = reports.corpus_report(pages.select("page", "correct", "predicted", "labels")).select(F.lit(-1).cast("bigint").alias("page"), "correct", "predicted", "labels", "precision", "recall", "f1")
    return pages.unionByName(whole)


@command("benchmark-provider-anchor-suite", "benchmark")
def benchmark_suite(spark: SparkSession, predicted: str, truth: str, out: str, by: str = "case") -> DataFrame:
    """Edge metrics for each value of a column that both tables have."""
    return reports.edge_report(read(spark, predicted), read(spark, truth), by)


@command("benchmark-provider-hierarchy", "benchmark-paragraph-graph", "benchmark-joint-graph")
def benchmark_pairs(spark: SparkSession, predicted: str, truth: str, out: str) -> DataFrame:
    """Pairs of elements of one region against labels, by page."""
    return reports.pair_report(read(spark, predicted), read(spark, truth))


@command("benchmark-hierarchical-order-corpus")
def benchmark_hierarchy(spark: SparkSession, predicted: str, truth: str, edges: str, out: str) -> DataFrame:
    """Memberships and edges within and across regions against labels, by page."""
    return reports.membership_report(read(spark, predicted), read(spark, truth), read(spark, edges))


@command("benchmark-chunkr-reading-order")
def benchmark_orders(spark: SparkSession, elements: str, truth: str, out: str, orders: str = "visual-yx,box-flow", width: float = 612.0) -> DataFrame:
    """Pairs and neighbours of candidate orders against labelled places (page, idx, place), by page."""
    e, labelled = read(spark, elements), read(spark, truth).select("page", "idx", F.col("place").alias("label"))
    found = [order.order_disagreement(labelled, _order(e, name, width), "label", "place").withColumn("candidate", F.lit(name)) for name in orders.split(",")]
    out_rows = found[0]
    for more in found[1:]:
        out_rows = out_rows.unionByName(more)
    return out_rows


@command("freeze-provider-transition-gate")
def freeze_gate(spark: SparkSession, transitions: str, out: str, precision: float = 0.95, wilson: float = 0.9, least: int = 20) -> DataFrame:
    """Transitions (support, scorable, correct) from each support on, and whether they pass."""
    return reports.support_gate(read(spark, transitions), precision, wilson, least)


@command("freeze-stratified-provider-transition-gate")
def freeze_stratified_gate(spark: SparkSession, records: str, out: str, precision: float = 0.9, lower: float = 0.8, least: int = 20) -> DataFrame:
    """For each stratum the support and confidence from which its records pass."""
    return review.fitted_rules(read(spark, records), [1, 2, 3], [0.5, 0.7, 0.9], precision, lower, least)


def _pairs(elements: DataFrame) -> DataFrame:
    return learned.pair_features(order.visual_order(elements))


@command("train-relation-ranker", "train-floating-ranker", "train-chunkr-order-ranker")
def train_ranker(spark: SparkSession, elements: str, truth: str, model: str, out: str, precision: float = 0.5) -> DataFrame:
    """Fits a pair model on most pages, saves it, and freezes its threshold on the others: one row, or none."""
    split = learned.document_split(learned.labelled(_pairs(read(spark, elements)), read(spark, truth)))
    fitted = learned.fit_successors(split.where("part = 'fit'"))
    fitted.write().overwrite().save(model)
    return learned.frozen_threshold(learned.scored(fitted, split.where("part = 'calibration'")), precision)


@command("run-relation-ranker", "run-floating-ranker", "predict-successor-graph")
def run_ranker(spark: SparkSession, elements: str, model: str, out: str, threshold: float = 0.5) -> DataFrame:
    """A path cover of the pairs that a saved model scores at or above a threshold."""
    from pyspark.ml.classification import GBTClassificationModel

    scored = learned.scored(GBTClassificationModel.load(model), _pairs(read(spark, elements)))
    best = learned.top_edges(scored.select(*EDGE, "score"), threshold)
    return covers.path_cover(best.withColumn("protected", F.lit(False))).where("status = 'selected'")


@command("predict-chunkr-order")
def predict_order(spark: SparkSession, elements: str, model: str, out: str) -> DataFrame:
    """Order of each page by the sums of a saved model's probabilities that one element comes before another."""
    from pyspark.ml.classification import GBTClassificationModel

    e = read(spark, elements)
    scored = learned.scored(GBTClassificationModel.load(model), _pairs(e))
    return features.borda_order(scored.select(*EDGE, F.col("score").alias("p")), order.visual_order(e))


@command("convert")
def convert(spark: SparkSession, ocr: str, out: str, strategy: str = "auto", width: float = 612.0) -> DataFrame:
    """OCR JSON as documents, one JSON document per page, whose elements are numbered in reading order."""
    from leafline.sources.layout import read_ocr_json

    e = read_ocr_json(spark, ocr).select(F.col("page").cast("bigint").alias("page"), F.col("idx").cast("bigint").alias("idx"), "text", "x0", "y0", "x1", "y1")
    placed = e.join(_order(e, strategy, width), ["page", "idx"])
    return payloads.to_documents(placed.withColumn("idx", F.col("place")))


@command("export-html")
def export_html(spark: SparkSession, elements: str, out: str) -> DataFrame:
    """HTML of each page."""
    return sinks.positioned_html(read(spark, elements))


@command("export-xml")
def export_xml(spark: SparkSession, elements: str, out: str, mode: str = "source") -> DataFrame:
    """XML of each page, with the texts of a display mode."""
    e = read(spark, elements)
    column = lambda c: F.col(c) if c in e.columns else F.lit(None).cast("string")
    return sinks.page_xml(e.withColumn("role", column("role")), sinks.text_for_mode(mode, F.col("text"), column("edited"), column("translated")))


@command("set-text", "set-translation", "set-xml-node")
def set_text(spark: SparkSession, elements: str, page: int, idx: int, text: str, out: str, column: str = "text") -> DataFrame:
    """Elements with one text replaced, in the column named; an error if there is no such element."""
    e = read(spark, elements)
    structure.point_lookup(e, page, idx).collect()
    old = F.col(column) if column in e.columns else F.lit(None).cast("string")
    return e.withColumn(column, F.when((F.col("page") == page) & (F.col("idx") == idx), F.lit(text)).otherwise(old))


@command("apply-xml-edits", "apply-html-edits")
def apply_edits(spark: SparkSession, elements: str, edits: str, out: str) -> DataFrame:
    """Elements after a patch (page, idx, source_text, text), with what became of each edit."""
    return content.apply_edits(read(spark, elements), read(spark, edits))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="leafline", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, f in sorted(COMMANDS.items()):
        sub = commands.add_parser(name, help=(f.__doc__ or "").splitlines()[0])
        for p in list(inspect.signature(f, eval_str=True).parameters.values())[1:]:
            required = p.default is inspect.Parameter.empty
            sub.add_argument(f"--{p.name.replace('_', '-')}", dest=p.name, type=p.annotation, required=required, default=None if required else p.default)
    for name in EXTERNAL:
        commands.add_parser(name, help="runs outside of Spark")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = vars(parser().parse_args(arguments))
    name = given.pop("command")
    if name in EXTERNAL:
        print(f"{name} needs a browser, a renderer or a model; this library reads what it leaves", file=sys.stderr)
        return 2
    write(COMMANDS[name](spark or SparkSession.builder.appName(name).getOrCreate(), **given), given["out"])
    return 0
