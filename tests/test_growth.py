"""Steps that must not grow faster than their input, and that give the same results as the plain way."""

import difflib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafline.functions.rounding import half_up
from leafline.functions.text import char_similarity
from leafline.operators import covers, decode, evidence, features, learned, matching, order, reports, structure
from leafline.operators.pages import by_page, dealt
from leafline.plans import registry

BOX = "x0 double, y0 double, x1 double, y1 double"


def test_a_long_text_that_holds_another_needs_no_table(spark):
    long = "".join(random.Random(1).choices("abcdefgh ", k=150_000))
    df = spark.createDataFrame([(long, long + long[:30_000]), ("kitten", "sitting"), ("", ""), ("", "ab"), ("ab", "xaby")], "a string, b string")
    began = time.monotonic()
    got = [r[0] for r in df.select(F.round(char_similarity(F.col("a"), F.col("b")), 8)).collect()]
    assert got == [round(150_000 / 180_000, 8), round(1 - 3 / 7, 8), 1.0, 0.0, 0.5] and time.monotonic() - began < 20


def test_matching_blocks_are_those_of_difflib():
    r = random.Random(2)
    for k in range(400):
        letters = ("ab", "abcdefgh ", "etaoin shrdlucmfwyp.ABCDEFGHIJ0123456789")[k % 3]
        a, b = ("".join(r.choices(letters, k=r.randrange(400))) for _ in range(2))
        if k % 5 == 0:
            b = a[: len(a) // 2] + b + a[len(a) // 3 :]
        assert 2 * evidence.matched_characters(a, b) == round(difflib.SequenceMatcher(None, a, b).ratio() * (len(a) + len(b)))


def test_matching_blocks_of_prose_are_found_faster_than_by_difflib():
    r = random.Random(3)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randrange(2, 9))) for _ in range(300)]
    pairs = [tuple(" ".join(r.choices(words, k=30))[:190] for _ in range(2)) for _ in range(150)]
    took = []
    for f in (lambda a, b: difflib.SequenceMatcher(None, a, b).ratio(), evidence.matched_characters):
        began = time.process_time()
        for a, b in pairs:
            f(a, b)
        took.append(time.process_time() - began)
    assert took[1] < 0.7 * took[0]


@pytest.fixture
def no_comparison(monkeypatch):
    """Any pair that would be compared by characters is an error."""
    for module in (decode, matching):
        monkeypatch.setattr(module, "matched_similarity", lambda decided, *_: F.coalesce(decided, F.raise_error(F.lit("compared")).cast("double")))


def _lines(spark, texts, key):
    return spark.createDataFrame([(1, k, t, 10.0, 10.0 + k, 300.0, 20.0 + k) for k, t in enumerate(texts)], f"page bigint, {key} bigint, text string, {BOX}")


def test_parents_of_unlike_lengths_are_not_compared(spark, no_comparison):
    texts = [f"{'abc'[k % 3]} line {k} of the page" for k in range(20)]
    long = [t + " and what follows it for a while " * 4 for t in texts]
    got = decode.text_parents(_lines(spark, texts, "idx"), _lines(spark, long, "region"), 792.0).collect()
    assert {(r.idx, r.region) for r in got} == {(k, k) for k in range(20)}


def test_regions_that_cannot_be_best_are_not_compared(spark, no_comparison):
    e = _lines(spark, ["ab" * (20 + k) + "!" for k in range(20)], "idx")
    r = _lines(spark, ["ab" * (20 + k) + "!" for k in range(20)], "region").withColumn("fine", F.lit(0))
    got = matching.best_regions_by_text(e, r).collect()
    assert {(r.idx, r.region, r.similarity) for r in got} == {(k, k, 1.0) for k in range(20)}


def test_relation_scores_join_no_pairs_and_round_as_sql_does(spark):
    e = spark.createDataFrame([(p, k, "x", 36.0 + k % 2 * 280, 40.0 + 14 * (k // 2), 276.0 + k % 2 * 280, 50.0 + 14 * (k // 2)) for p in range(40) for k in range(p)], f"page bigint, idx bigint, text string, {BOX}")
    found = order.relation_scores(e, e.select("page", "idx", (F.col("idx") % 2).alias("col")), 612.0, 792.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # of elements and columns; pairs of a page are no rows of a join
    rows = {(r.page, r.source, r.target): r.score for r in found.collect()}
    assert rows[39, 0, 6] == round(0.42 + 0.24 * (1 - 32 / 70) + 0.18 + 0.1 + 0.08, 8) and rows[2, 0, 1] == 0.28 and (39, 2, 0) not in rows
    assert {p for p, _, _ in rows} == set(range(2, 40))


def test_halves_are_rounded_away_from_zero(spark):
    values = [0.123456785, 0.123456775, 0.5, 0.28, 1.000000005, 0.999999995, -0.123456785, *np.random.default_rng(4).random(500).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 8))
    assert half_up(np.array(values)).tolist() == [r[0] for r in df.collect()]


def _plain_regret(edges, least):
    """One pass over all edges for each that is chosen."""
    chains, left, out = covers._Chains(), [e for e in edges if e[2] >= least], []
    while left := [e for e in left if not chains.obstacle(e[0], e[1])]:
        tops = {}
        for s, t, score in left:
            for key in (("s", s), ("t", t)):
                tops[key] = sorted([*tops.get(key, []), score], reverse=True)[:2]

        def other(key, score, tops=tops):
            best = tops[key]
            return score - (best[1] if best[0] == score and len(best) > 1 else 0.0 if best[0] == score else best[0])

        regret, score, s, t = max((other(("s", s), sc) + other(("t", t), sc), sc, -s, -t) for s, t, sc in left)
        chains.add(-s, -t)
        out.append((-s, -t, score, round(regret, 8)))
    return out


def test_regrets_are_valued_again_only_where_they_change():
    r = random.Random(6)
    for k in range(300):
        n = r.randrange(2, 14)
        edges = [(r.randrange(n), r.randrange(n), round(r.random(), 1 + k % 2 * 7)) for _ in range(r.randrange(6 * n))]
        assert covers.max_regret_edges(edges, 0.3) == _plain_regret(edges, 0.3)
    edges = [(s, (s + d) % 600, round(r.random(), 8)) for s in range(600) for d in range(1, 7)]
    took = []
    for f in (_plain_regret, covers.max_regret_edges):
        began = time.process_time()
        f(edges, 0.3)
        took.append(time.process_time() - began)
    assert took[1] < 0.2 * took[0]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_alignment_moves_texts_and_no_tokens(spark):
    assert "Generate explode(split" not in _plan(registry.queries()["page_alignment"](spark, "/root/testdata/sf0.001"))
    r = random.Random(7)
    rows = [(d, p, " ".join(r.choices("abcdefghij", k=r.randrange(1, 9)))) for d in range(6) for p in range(4) for _ in range(3)]
    moved = [(d, p, t) for d, p, t in rows if r.random() < 0.8]
    texts = [spark.createDataFrame(x, "doc bigint, page bigint, text string") for x in (rows, moved)]
    tokens = [x.select("doc", "page", F.explode(F.split("text", " ")).alias("token")).groupBy("doc", "page", "token").agg(F.count("*").alias("n")) for x in texts]
    got = sorted(reports.text_alignment(*texts).collect())
    assert got == sorted(reports.page_alignment(*tokens).collect())
    bags = [{}, {}]
    for bag, x in zip(bags, (rows, moved), strict=True):
        for d, p, t in x:
            bag.setdefault((d, p), Counter()).update(t.split())
    for row in got:
        mine = bags[0][row.doc, row.page]
        f1 = [round(2 * (mine & b).total() / (mine.total() + b.total()), 8) for (d, _), b in bags[1].items() if d == row.doc]
        assert row.f1 == max(f1)
    many = {k: Counter({f"{k}-{j}": 1 for j in range(60)} | {"all": k + 1}) for k in range(200)}  # beyond one grid
    assert sorted(zip(*reports._common(many, many), strict=True))[:2] == [(0, 0, 61, 61, 61), (0, 1, 1, 61, 62)]


def test_relations_are_resolved_without_joins_by_text(spark):
    assert _plan(registry.queries()["resolved_relations"](spark, "/root/testdata/sf0.001")).count("Join ") == 1
    keys = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 3), (1, "c", 3), (1, "text", 4)], "page bigint, ref string, idx bigint")
    relations = spark.createDataFrame(
        [(1, "successor", "a", "b", None, None), (1, "successor", "b", "c", None, None), (1, "precedence", "a", "x", "z", " Text"), (1, "successor", "a", "y", None, "none"), (2, "successor", "a", "b", None, None)],
        "page bigint, kind string, source string, target string, source_alias string, target_alias string",
    )
    got = {(r.page, r.source_ref, r.target_ref): (r.status, r.source, r.target, r.by_alias) for r in structure.resolved_relations(relations, keys).collect()}
    assert got == {
        (1, "a", "b"): ("resolved", 1, 2, False), (1, "b", "c"): ("overlap", None, None, False), (1, "a", "x"): ("resolved", 1, 4, True),
        (1, "a", "y"): ("unresolved", None, None, False), (2, "a", "b"): ("unresolved", None, None, False),
    }


def test_edges_are_counted_without_joins(spark):
    schema = "kind string, page bigint, source bigint, target bigint"
    truth = spark.createDataFrame([("a", 1, 1, 2), ("a", 1, 2, 3), ("a", 1, 2, 3), ("b", 1, 5, 6), (None, 1, 1, 2)], schema)
    found = spark.createDataFrame([("a", 1, 1, 2), ("a", 1, 1, 3), ("a", 1, 1, 3), ("a", 1, 1, 9), ("a", 2, 1, 2), ("c", 1, 1, 2), (None, 1, 1, 2)], schema)
    counts = reports.edge_counts(found, truth, "kind")
    assert "Join" not in _plan(counts)
    assert {tuple(r) for r in counts.collect()} == {("a", 1, 2, 2), ("b", 0, 0, 1), (None, 0, 0, 1)}
    assert [tuple(r) for r in reports.edge_counts(found.drop("kind"), truth.drop("kind")).collect()] == [(1, 2, 3)]


def test_spans_are_not_dealt_again(spark):
    df = registry.queries()["lines_of_spans"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_selected_edges_are_made_once(spark):
    e = spark.createDataFrame([(1, k, k + 1, 0.9) for k in range(6)], "page bigint, source bigint, target bigint, score double")
    selected = by_page(e.where("source % 2 = 0"), ["source"], lambda p: [p["source"], p["target"]], "page bigint, source bigint, target bigint")
    got = decode.rescued_edges(selected, e.drop("score"), e, 0.5)
    assert _plan(got).count("MapInArrow") == 2
    assert {(r.source, r.origin) for r in got.collect()} == {(k, "rescued" if k % 2 else "selected") for k in range(6)}


def _page_of(spark, n):
    r = random.Random(8)
    rows = [(p, k, *[float(r.randrange(60)) for _ in range(2)]) for p in range(3) for k in range(n)]
    return spark.createDataFrame([(p, k, x, y, x + 20, y + 4, k) for p, k, x, y in rows], f"page bigint, idx bigint, {BOX}, visual_rank bigint")


def test_nearest_pairs_are_found_without_joins(spark):
    e = _page_of(spark, 30)
    found = order.topology_budget(e)
    assert "Join" not in _plan(found) and "Join" not in _plan(learned.pair_features(e, 5))
    rows = {(r.page, r.idx): r for r in e.collect()}
    gap = lambda a, b: max(0.0, max(a.x0, b.x0) - min(a.x1, b.x1)) + max(0.0, max(a.y0, b.y0) - min(a.y1, b.y1))
    near = {}
    for (page, i), a in rows.items():
        near[page, i] = sorted((gap(a, b), b.y0, b.x0, j) for (p, j), b in rows.items() if p == page and j != i)
    assert {tuple(r) for r in found.collect()} == {(p, i, b[3], k + 1, b[0]) for (p, i), all_ in near.items() for k, b in enumerate(all_[:6])}
    assert {(r.page, r.source, r.target) for r in learned.pair_features(e, 5).collect()} == {(p, i, b[3]) for (p, i), all_ in near.items() for b in all_[:5]}


def test_candidates_below_are_found_without_joins(spark):
    e, none = _page_of(spark, 30), spark.createDataFrame([], "page bigint, source bigint, target bigint")
    found = features.local_candidates(e, none, none, 3, 15.0)
    assert "Join" not in _plan(found)
    rows, want = e.collect(), set()
    for a in rows:
        below = [b for b in rows if b.page == a.page and b.idx != a.idx and b.y0 >= a.y1 and b.y0 // 15 - a.y0 // 15 in (0, 1) and min(a.x1, b.x1) > max(a.x0, b.x0)]
        want |= {(a.page, a.idx, b.idx) for b in sorted(below, key=lambda b: (b.y0 - a.y1, b.x0, b.idx))[:3]}
    assert {tuple(r) for r in found.collect()} == want


def test_tasks_grow_with_the_files(spark, tmp_path):
    spark.range(200_000).withColumn("page", F.col("id")).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    assert dealt(read, 100_000, 2).rdd.getNumPartitions() > 8 and dealt(read, 10**9, 2).rdd.getNumPartitions() == 2
    assert dealt(read, 100_000).count() == 200_000
