"""Layout queries against DuckDB on the smallest tables, and sequential operators against small cases."""

import itertools
import math
import os

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafline.functions.geometry import Box, coverage, iou, row_key
from leafline.functions.text import page_ranges, wilson_lower
from leafline.operators import content, covers, matching, metrics, order
from leafline.plans import registry
from leafline.sources import layout, sinks

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float, np.number)) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    rows = got.collect()
    if name not in registry.oracle_sql():
        assert rows
        return
    cols = sorted(got.columns)
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == cols
    want = sorted(str([plain(r[names.index(c)]) for c in cols]) for r in cursor.fetchall())
    assert sorted(str([plain(r[c]) for c in cols]) for r in rows) == want


def test_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0)], "ax0 double, ay0 double, ax1 double, ay1 double, bx0 double, by0 double, bx1 double, by1 double")
    a, b = Box.of("a"), Box.of("b")
    r = df.select(coverage(a, b), iou(a, b), a.clamped(8, 8).x1, row_key(F.lit(15.0))).first()
    assert r[0] == 0.25 and r[1] == pytest.approx(25 / 175) and r[2] == 8 and r[3] == 12.0


def test_page_ranges():
    assert page_ranges("1-3,7,2") == [0, 1, 2, 6]
    with pytest.raises(ValueError):
        page_ranges("3-1")


def test_wilson(spark):
    assert spark.range(1).select(wilson_lower(F.lit(256), F.lit(268))).first()[0] == pytest.approx(0.92337855, abs=1e-6)


def test_greedy_cover():
    assert covers.greedy_cover([(1, 2), (2, 3), (3, 1), (1, 3), (4, 3), (5, 5)]) == ["selected", "selected", "cycle", "outgoing", "incoming", "self"]


def test_max_regret_prefers_what_has_no_alternative():
    found = covers.max_regret_edges([(1, 3, 0.9), (1, 4, 0.85), (2, 3, 0.8)], 0.3)
    assert {e[:2] for e in found} == {(1, 4), (2, 3)}


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.data())
def test_assignment_is_best(rows, cols, data):
    cell = st.one_of(st.just(float("nan")), st.floats(0, 1))
    grid = np.array([[data.draw(cell) for _ in range(cols)] for _ in range(rows)])
    best = (0, 0.0)
    for k in range(1, min(rows, cols) + 1):
        for left in itertools.combinations(range(rows), k):
            for right in itertools.permutations(range(cols), k):
                scores = [grid[i, j] for i, j in zip(left, right, strict=True)]
                if not any(map(math.isnan, scores)):
                    best = max(best, (k, sum(scores)))
    got = covers.assign(grid)
    assert len(got) == best[0] and sum(grid[i, j] for i, j in got) == pytest.approx(best[1], abs=1e-6)


def test_xy_cut_reads_columns_after_the_title():
    boxes = [(0, 0, 0, 100, 10), (1, 0, 20, 45, 30), (2, 55, 20, 100, 30), (3, 0, 31, 45, 41), (4, 55, 31, 100, 41)]
    assert covers.xy_cut(boxes) == [0, 1, 3, 2, 4]


def test_stale_edit_is_refused(spark):
    e = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "page long, idx long, text string")
    edits = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "old", "y")], "page long, idx long, source_text string, text string")
    assert {(r.idx, r.text, r.status) for r in content.apply_edits(e, edits).collect()} == {(0, "x", "applied"), (1, "b", "stale")}


def test_empty_page_set(spark):
    none = spark.createDataFrame([], layout.ELEMENTS)
    assert order.visual_order(none).count() == 0
    assert order.flow_segments(order.visual_order(none)).count() == 0
    assert matching.near_duplicate_pairs(none).count() == 0
    assert covers.recursive_xy_cut(none).count() == 0
    assert metrics.comembership_pairs(none.withColumn("group", F.lit(1))).count() == 0


def test_round_trip_of_sinks(spark, tmp_path):
    e = spark.createDataFrame([(1, 0, "a<b", 0.0, 0.0, 5.0, 5.0)], layout.ELEMENTS)
    assert "a&lt;b" in sinks.positioned_html(e).first().html
    e.write.json(str(tmp_path / "e"))
    assert layout.read_elements(spark, str(tmp_path / "e")).collect() == e.collect()
    sinks.write_xml(e, str(tmp_path / "x"))
    assert spark.read.format("xml").option("rowTag", "element").load(str(tmp_path / "x")).count() == 1


def test_text_modes(spark):
    r = spark.range(1).select(sinks.text_for_mode("translated", F.lit("s"), F.lit("e"), F.lit("")), sinks.text_for_mode("bilingual", F.lit("s"), F.lit(""), F.lit("t"))).first()
    assert tuple(r) == ("e", "s\nt")


def test_ocr_json(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"source": "x", "pages": [{"page_index": 0, "elements": [{"type": "text", "bbox_px": [1, 2, 3, 4], "text": "t", "confidence": 0.5}]}]}')
    r = layout.read_ocr_json(spark, str(tmp_path / "o.json")).first()
    assert (r.page, r.idx, r.x0, r.y1, r.text) == (0, 0, 1.0, 4.0, "t")


def test_event_stream(spark, tmp_path):
    from leafline.streaming.windows import event_stream, windowed_counts

    spark.read.parquet(f"{SF}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = windowed_counts(event_stream(spark, str(tmp_path / "in"), "*.parquet")).writeStream.outputMode("update").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
