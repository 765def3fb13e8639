"""Strategies, provider evidence and learned edges on small cases."""

import pytest
from pyspark.sql import functions as F

from leafline.operators import evidence, learned, order, strategies
from leafline.operators.pages import by_page

BOX = "page bigint, idx bigint, text string, x0 double, y0 double, x1 double, y1 double"


def test_columns_before_rows():
    boxes = [(0, 36.0, 10.0, 576.0, 30.0)]
    for k in range(4):
        boxes += [(1 + 2 * k, 36.0, 40.0 + 14 * k, 280.0, 50.0 + 14 * k), (2 + 2 * k, 316.0, 40.0 + 14 * k, 560.0, 50.0 + 14 * k)]
    name, found, col, _, _ = strategies.strategy_of(boxes, 612.0)
    assert name == "column-flow-v1" and found == [0, 1, 3, 5, 7, 2, 4, 6, 8]
    assert col[0] == -1 and {col[i] for i in (1, 3, 5, 7)} == {0} and {col[i] for i in (2, 4, 6, 8)} == {1}


def test_grid_is_an_island():
    boxes = [(10 * r + c, 50.0 + 90 * c, 50.0 + 20 * r + c, 120.0 + 90 * c, 60.0 + 20 * r + c) for r in range(4) for c in range(4)]
    assert strategies.table_island(boxes) == [10 * r + c for r in range(4) for c in range(4)]
    assert strategies.table_island(boxes[:8]) is None


def test_one_box():
    assert strategies.strategy_of([(5, 0.0, 0.0, 1.0, 1.0)], 612.0)[1] == [5]


def test_running_mean_clusters_depend_on_the_mean():
    assert strategies.clusters([0.0, 4.0, 8.0, 30.0], 5.0) == [0, 0, 1, 2]


def test_pages_are_whole_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(100).select((F.col("id") % 7).alias("page"), "id")
        got = by_page(df, ["id"], lambda p: [[len(p["id"])], [p["id"][0]]], "page bigint, n bigint, first bigint").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [(k, len(range(k, 100, 7)), k) for k in range(7)]


def test_polygons_and_file_names(spark):
    r = spark.range(1).select(
        evidence.polygon_box(F.expr("array(array(3D, 1D), array(0D, 5D))")).alias("b"), evidence.polygon_box(F.expr("cast(array() AS array<array<double>>)")).alias("n"),
        evidence.page_index(F.lit("a/page_0003.json")).alias("p"), evidence.page_index(F.lit("x")).alias("q"), evidence.normal_type(F.lit(" Picture ")).alias("t"),
    ).first()
    assert tuple(r.b) == (0.0, 1.0, 3.0, 5.0) and r.n is None and r.p == 2 and r.q is None and r.t == "figure"


def test_invalid_slots_are_not_bridged(spark):
    payload = '[{"type":"p","bbox":[0,0,9,9],"content":"a"},{"type":"p","bbox":[1],"content":"b"},{"type":"p","bbox":[0,0,9,9],"content":"c"},{"type":"p","bbox":[0,0,9,9],"content":"d"}]'
    blocks = evidence.bottom_left_blocks(spark.createDataFrame([(1, payload), (2, None)], "page bigint, payload string"), 100, 100)
    assert [(r.source, r.target) for r in evidence.slot_successors(blocks).collect()] == [(2, 3)]
    assert blocks.where("slot = 0").first().y0 == 91.0


def test_text_similarity(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("abcd", "xabcdx"), ("ab", ""), ("abcd", "abxd")], "a string, b string")
    assert [r[0] for r in df.select(evidence.text_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 0.0, 0.75]


def test_line_distance(spark):
    lines = lambda *t: spark.createDataFrame([(1, i, x) for i, x in enumerate(t)], "page bigint, place bigint, text string")
    assert evidence.line_edit_distance(lines("a", "b", "c"), lines("a", "c", "d")).first().distance == 2


def test_learned_edges_beat_chance(spark):
    rows = [(p, i, "t", 36.0, 40.0 + 14 * i, 200.0, 50.0 + 14 * i) for p in range(12) for i in range(8)]
    v = order.visual_order(spark.createDataFrame(rows, BOX))
    examples = learned.document_split(learned.labelled(learned.pair_features(v, 6), order.successor_edges(v)), 40)
    graded = learned.scored(learned.fit_successors(examples.where("part = 'fit'"), 3), examples.where("part = 'calibration'"))
    frozen = learned.frozen_threshold(graded, least_selected=5).first()
    assert frozen.precision > 0.9 and frozen.f1 > 0.9
    assert learned.frozen_threshold(graded, least_precision=1.1).count() == 0
    assert learned.top_edges(graded, frozen.threshold).where("label = 0").count() <= 2


@pytest.mark.parametrize("folds", [2, 3])
def test_folds_are_even(spark, folds):
    df = spark.range(30).select("id", (F.col("id") % 2).alias("s"))
    counts = learned.fold_of(df, "id", "s", folds).groupBy("s", "fold").count().collect()
    assert max(r["count"] for r in counts) - min(r["count"] for r in counts) <= 1
