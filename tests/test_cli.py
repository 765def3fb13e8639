"""Commands from end to end over small tables, and operators that SQL can't express against small cases."""

import difflib
import json

import pytest
from pyspark.sql import functions as F

from leafline import cli
from leafline.functions.text import char_similarity, normalized
from leafline.operators import content, covers, evidence, features, learned, matching, order, reports, shapes, structure
from leafline.sources import payloads

BOXES = "page bigint, idx bigint, text string, x0 double, y0 double, x1 double, y1 double"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A fixture of 12 pages with its answers, written by the first command."""
    base = tmp_path_factory.mktemp("tables")
    at = lambda name: str(base / name)
    assert cli.main(["make-fixture", "--out", at("elements"), "--answers", at("order"), "--pages", "12"], spark) == 0
    truth = spark.read.parquet(at("order"))
    order.successor_edges(truth, "place").write.parquet(at("truth"))
    return at


def run(spark, tables, name, **given):
    out = tables(f"out-{name}")
    args = [name, "--out", out]
    for k, v in given.items():
        args += [f"--{k.replace('_', '-')}", str(v)]
    assert cli.main(args, spark) == 0
    return spark.read.parquet(out)


def test_every_command_is_there():
    assert len(cli.COMMANDS) + len(cli.EXTERNAL) == 60


def test_fixture_keeps_its_answers_apart(spark, tables):
    assert "place" not in spark.read.parquet(tables("elements")).columns
    assert run(spark, tables, "make-web-fixture", pages=2).count() == 2


def test_orders_and_edges(spark, tables):
    found = run(spark, tables, "benchmark-chunkr-reading-order", elements=tables("elements"), truth=tables("order"), orders="visual-yx,recursive-xy-cut,spatial-graph,relation-graph")
    worst = {r.candidate: r.m for r in found.groupBy("candidate").agg(F.max("pair_disagreement").alias("m")).collect()}
    assert worst["spatial-graph"] == 0 and worst["visual-yx"] > 0
    assert run(spark, tables, "propose-reading-sidecar", elements=tables("elements")).where("selected").count() > 0
    paragraphs = run(spark, tables, "propose-joint-graph", elements=tables("elements"))
    assert paragraphs.count() == 12 * 40 and paragraphs.select("page", "chain", "part").distinct().count() == 24
    perfect = run(spark, tables, "benchmark-successor-graph", predicted=tables("truth"), truth=tables("truth"))
    assert perfect.where("page = -1").first().f1 == 1 and perfect.count() == 13
    models = spark.read.parquet(tables("truth")).withColumn("model", F.lit("a")).unionByName(spark.read.parquet(tables("truth")).where("source % 2 = 0").withColumn("model", F.lit("b")))
    models.write.parquet(tables("models"))
    got = {r.model: r for r in run(spark, tables, "benchmark-structure-ab", predicted=tables("models"), truth=tables("truth")).collect()}
    assert got["a"].gain == 0 and got["b"].gain < 0 and got["b"].precision == 1


def test_models_are_trained_saved_and_run(spark, tables):
    frozen = run(spark, tables, "train-relation-ranker", elements=tables("elements"), truth=tables("truth"), model=tables("model"))
    assert frozen.count() <= 1
    edges = run(spark, tables, "run-relation-ranker", elements=tables("elements"), model=tables("model"))
    truth = spark.read.parquet(tables("truth"))
    assert edges.join(truth, ["page", "source", "target"]).count() > 0.8 * truth.count()
    placed = run(spark, tables, "predict-chunkr-order", elements=tables("elements"), model=tables("model"))
    assert placed.count() == 12 * 40


def test_texts_and_exports(spark, tables):
    changed = run(spark, tables, "set-text", elements=tables("elements"), page=1, idx=2, text="new & old")
    assert changed.where("text = 'new & old'").count() == 1
    with pytest.raises(Exception, match="no element"):
        cli.main(["set-text", "--elements", tables("elements"), "--page", "99", "--idx", "0", "--text", "x", "--out", tables("none")], spark)
    spark.createDataFrame([(1, 2, "new & old", "a"), (1, 2, "new & old", "b"), (1, 3, "wrong", "c")], "page bigint, idx bigint, source_text string, text string").write.parquet(tables("edits"))
    edited = run(spark, tables, "apply-xml-edits", elements=tables("out-set-text"), edits=tables("edits"))
    assert edited.count() == 12 * 40 and {r.status: r.n for r in edited.groupBy("status").agg(F.count("*").alias("n")).collect()} == {"applied": 1, "stale": 1, "unchanged": 478}
    assert "new &amp; old" in "".join(r.xml for r in run(spark, tables, "export-xml", elements=tables("out-set-text")).collect())
    assert run(spark, tables, "export-html", elements=tables("elements")).count() == 12
    ocr = {"source": "x", "pages": [{"page_index": 0, "elements": [{"type": "text", "bbox_px": [0, 100, 50, 110], "text": "below", "confidence": 1.0}, {"type": "text", "bbox_px": [0, 0, 50, 10], "text": "above", "confidence": 1.0}]}]}
    with open(tables("ocr.json"), "w") as f:
        json.dump(ocr, f)
    document = json.loads(run(spark, tables, "convert", ocr=tables("ocr.json"), strategy="visual-yx").first().document)
    assert [e["text"] for e in document["elements"]] == ["above", "below"]


def test_corpora_without_answers(spark, tables):
    e = spark.read.parquet(tables("elements")).join(spark.read.parquet(tables("order")), ["page", "idx"]).withColumn("region", F.floor(F.col("place") / 20))
    e.write.parquet(tables("labelled"))
    inputs = run(spark, tables, "materialize-graph-hierarchy", elements=tables("labelled"), answers=tables("answers"))
    assert not {"place", "region"} & set(inputs.columns) and inputs.count() == spark.read.parquet(tables("answers")).count() == 480
    assert "place" not in run(spark, tables, "export-hierarchy-input", elements=tables("labelled")).columns
    e.select("page", "idx", "region").write.parquet(tables("regions"))
    pairs = run(spark, tables, "benchmark-joint-graph", predicted=tables("regions"), truth=tables("regions"))
    assert pairs.where("f1 < 1").count() == 0
    whole = run(spark, tables, "benchmark-hierarchical-order-corpus", predicted=tables("regions"), truth=tables("regions"), edges=tables("truth"))
    assert whole.where("within_kept < within OR across_kept < across OR assigned < labelled").count() == 0


def test_external_commands_say_so(spark):
    assert cli.main(["print-pdf"], spark) == 2


def test_text_similarity(spark):
    texts = ["Ab  cd", "ab cd", "abc", "x", "!", "a longer text with ab cd in it", "", None, "Ünïcode text", "ünïcode  TEXTS", "completely other"]
    rows = [(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, j int, a string, b string")
    for r in df.select("a", "b", evidence.text_similarity(F.col("a"), F.col("b")).alias("s"), char_similarity(normalized(F.col("a")), normalized(F.col("b"))).alias("c")).collect():
        x, y = (" ".join((t or "").split()).lower() for t in (r.a, r.b))
        want = difflib.SequenceMatcher(None, x, y).ratio()
        if not x or not y:
            want = 0.0
        elif x == y:
            want = 1.0
        elif min(sum(c.isalnum() for c in t) for t in (x, y)) < 2:
            want = 0.0
        elif x in y or y in x:
            want = 1.0
        assert r.s == pytest.approx(want), (r.a, r.b)
        assert 0 <= r.c <= 1


def test_region_match_prefers_equal_text(spark):
    e = spark.createDataFrame([(1, 0, "alpha beta", 0.0, 0.0, 10.0, 10.0), (1, 1, "gamma", 100.0, 100.0, 110.0, 110.0), (1, 2, "lost", 500.0, 500.0, 510.0, 510.0)], BOXES)
    r = spark.createDataFrame([(1, 0, "other words", 0, 0.0, 0.0, 20.0, 20.0), (1, 1, "Alpha  Beta", 0, 0.0, 0.0, 20.0, 20.0), (1, 2, "the gamma ray", 0, 0.0, 300.0, 20.0, 320.0)], "page bigint, region bigint, text string, fine int, x0 double, y0 double, x1 double, y1 double")
    got = {x.idx: (x.region, x.coverage, x.similarity) for x in matching.best_regions_by_text(e, r).collect()}
    assert got == {0: (1, 1.0, 1.0), 1: (2, 0.0, 1.0)}


def test_trees_and_paths_with_cycles(spark):
    nodes = spark.createDataFrame([(1, 1, None, 0), (1, 2, 1, 1), (1, 3, 1, 0), (1, 4, 3, 0), (1, 5, 6, 0), (1, 6, 5, 0)], "page bigint, node bigint, parent bigint, pos bigint")
    got = sorted((r.place, r.node, r.depth) for r in content.tree_preorder(nodes).collect())
    assert got == [(1, 1, 0), (2, 3, 1), (3, 4, 2), (4, 2, 1)]
    edges = spark.createDataFrame([(1, a, b) for a, b in [(0, 1), (1, 2), (2, 1), (2, 9), (9, 0), (0, 9)]], "page bigint, source bigint, target bigint")
    anchors = spark.createDataFrame([(1, 0), (1, 9)], "page bigint, idx bigint")
    assert sorted(tuple(r)[1:] for r in content.anchor_paths(edges, anchors).collect()) == [(0, 9, 1), (9, 0, 1)]


def test_chains_and_spatial_order(spark):
    ranked = spark.createDataFrame([(1, i, r) for r, i in enumerate([3, 1, 2, 0])], "page bigint, idx bigint, rank bigint")
    edges = spark.createDataFrame([(1, 3, 2), (1, 1, 0)], "page bigint, source bigint, target bigint")
    assert [r.idx for r in covers.serialized_chains(ranked, edges).orderBy("place").collect()] == [3, 2, 1, 0]
    pages = payloads.fixture_pages(spark, 3)
    got = covers.spatial_graph_order(pages, 612.0).join(pages.select("page", "idx", F.col("place").alias("want")), ["page", "idx"])
    assert got.count() == 120 and got.where("place <> want + 1").count() == 0
    assert covers.spatial_graph_order(pages.where("place < 20"), 612.0).count() == 0


def test_footnotes_and_captions(spark):
    body = [(1, i, "body", 40.0, 40.0 + 15 * i, 560.0, 52.0 + 15 * i) for i in range(38)]
    notes = [(1, 100 + i, "note", 40.0, 700.0 + 9 * i, 250.0, 707.0 + 9 * i) for i in range(3)]
    e = spark.createDataFrame(body + notes, BOXES)
    assert [r.idx for r in covers.footnotes(e, 792.0).collect()] == [100, 101, 102]
    assert covers.footnotes(spark.createDataFrame(body, BOXES), 792.0).count() == 0
    lines = [(1, 0, "Figure 1: a plot", 40.0, 300.0, 300.0, 310.0), (1, 1, "that goes on", 40.0, 312.0, 300.0, 322.0), (1, 2, "and on", 40.0, 324.0, 300.0, 334.0), (1, 3, "far below", 40.0, 400.0, 300.0, 410.0), (1, 4, "fourth", 40.0, 336.0, 300.0, 346.0)]
    got = sorted((r.idx, r.kind, r.anchor) for r in covers.caption_lines(spark.createDataFrame(lines, BOXES)).collect())
    assert got == [(0, "figure", 0), (1, "figure", 0), (2, "figure", 0)]


def test_shapes_and_envelopes(spark):
    grid = [(1, 0, "", 10.0 + 40 * c, 10.0 + 20 * r, 30.0 + 40 * c, 20.0 + 20 * r) for c in range(5) for r in range(6)]
    table = shapes.raster_tables(spark.createDataFrame(grid, BOXES).withColumn("cluster", F.lit(7)), 612.0, 792.0).first()
    assert (table.cluster, table.members, table.x0, table.y1) == (7, 30, 8.5, 121.5)
    assert shapes.raster_pages(spark.createDataFrame(grid, BOXES), 612.0, 792.0).count() == 0
    pages = spark.createDataFrame([(i, float(i), 1.0) for i in range(101)], "page bigint, a double, b double")
    limits = spark.createDataFrame([("a", 5.0, 95.0), ("b", 0.0, 2.0)], "name string, low double, high double")
    out = features.envelope_status(pages, limits).where("NOT inside")
    assert out.count() == 10 and {r.names for r in out.collect()} == {"a"}
    low = {r.name: (r.low, r.high) for r in features.profile_envelope(pages).collect()}
    assert low["b"] == (1.0, 1.0) and 0 <= low["a"][0] <= 2 and 98 <= low["a"][1] <= 100


def test_folds_are_even_and_split_into_ranges(spark):
    df = spark.range(1003).select(F.col("id").alias("key"), F.when(F.col("id") % 10 == 0, None).otherwise("x").alias("stratum"))
    got = learned.fold_of(df, "key", "stratum", 5).groupBy("stratum", "fold").count().collect()
    sizes = [r["count"] for r in got if r.stratum]
    assert sum(r["count"] for r in got) == 1003 and max(sizes) - min(sizes) <= 1


def test_gates_without_a_passing_point(spark):
    curve = spark.createDataFrame([(0.5, 10, 10, 5, 20, 0.5, 0.25, 0.33)], "threshold double, selected bigint, predicted bigint, correct bigint, labels bigint, precision double, recall double, f1 double")
    assert reports.best_threshold(curve, 0.9, 1).count() == 0 and reports.best_threshold(curve, 0.5, 1).count() == 1
    with pytest.raises(Exception, match="no element 5/5"):
        structure.point_lookup(spark.createDataFrame([(1, 0)], "page bigint, idx bigint"), 5, 5).collect()
