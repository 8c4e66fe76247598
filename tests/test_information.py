import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from verbatica.functions.text import pieces_of, slices_of
from verbatica.operators import dedup, evaluation, information as info, retrieval as r


@settings(deadline=None, max_examples=100)
@given(st.text(alphabet="ab\né🎉", max_size=400), st.integers(5, 60))
def test_slices_and_pieces_are_lossless(text, size):
    assert "".join(slices_of(text, size)) == text and all(0 < len(s) <= size for s in slices_of(text, size))
    assert "".join(pieces_of(text, size)) == text and all(0 < len(p.encode()) <= size for p in pieces_of(text, size))


def unit(rng, n, dim=8):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("block", [4, 1000])
def test_novelty_and_neighbours_equal_the_plain_loop(spark, block):
    rng = np.random.default_rng(1)
    x = unit(rng, 40)
    rows = [(i, "ab"[i % 2], i // 3, x[i].tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, grp string, filed long, vector array<double>")
    got = {(n.id, n["rank"]): (n.prior, round(n.score, 9)) for n in info.earlier_neighbours(df, 3, block).collect()}
    want = {}
    for i, g, f, _ in rows:
        prior = sorted(((-float(x[i] @ x[j]), -j) for j, h, e, _ in rows if h == g and e < f))[:3]
        want |= {(i, k + 1): (-p[1], round(-p[0], 9)) for k, p in enumerate(prior)}
    assert got == want
    first = {n.id for n in info.novelty(df).collect() if n.is_first}
    assert first == {0, 1, 2} | ({3} & set())  # equal times don't count as earlier


def test_residual_of_a_combination_is_small(spark):
    rng = np.random.default_rng(2)
    p = unit(rng, 6)
    w = info.reconstruction_weights(p[:5].mean(axis=0), p[:5])
    assert abs(w.sum() - 1) < 1e-9 and np.linalg.norm(p[:5].mean(axis=0) - w @ p[:5]) < 0.05


def test_distributions(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.04, 0.05, 0.99, 1.0, 1.7, 2.0)], "v double")
    edges = [round(0.05 * i, 2) for i in range(21)] + [2.0]
    bins = {x.bin: x.n for x in info.histogram(df, "v", edges).collect()}
    assert bins == {0: 2, 1: 1, 19: 1, 20: 3}
    q = info.quantiles(spark.createDataFrame([("g", float(v)) for v in (3, 1, 2, 4)], "g string, v double"), "v", "g").first()
    assert (q.p25, q.median, q.p75) == (1.75, 2.5, 3.25) and abs(q.p90 - 3.7) < 1e-9
    same = spark.createDataFrame([("a", 0, 5), ("b", 0, 5)], "grp string, bin int, n long")
    assert info.jensen_shannon(same).first().distance == 0.0
    apart = spark.createDataFrame([("a", 0, 5), ("b", 1, 5)], "grp string, bin int, n long")
    assert abs(info.jensen_shannon(apart).first().distance - 1) < 1e-9


def test_ranks_and_tests(spark):
    values = [3.0, 1.0, 3.0, 2.0, 5.0]
    ranks = {x.v: x["rank"] for x in info.average_ranks(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()}
    assert ranks == {1.0: 1.0, 2.0: 2.0, 3.0: 3.5, 5.0: 5.0}
    line = spark.createDataFrame([(float(i), float(i * i)) for i in range(10)], "x double, y double")
    assert abs(info.spearman(line, "x", "y").first().rho - 1) < 1e-12
    shifted = spark.createDataFrame([("a", float(i)) for i in range(25)] + [("b", float(i + 100)) for i in range(25)] + [("c", 1.0)], "g string, v double")
    k = info.kruskal(shifted, "v", "g").first()
    assert abs(k.p - info.chi_square_tail(k.h, k.k - 1)) < 1e-12
    assert k.k == 2 and abs(k.h - 36.7647) < 1e-3 and info.chi_square_tail(k.h, 1) < 1e-6
    assert abs(info.chi_square_tail(3.841458820694124, 1) - 0.05) < 1e-6 and abs(info.chi_square_tail(18.307038053275146, 10) - 0.05) < 1e-6
    p = spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.03), ("d", 0.9)], "test string, p double")
    assert {x.test: x.rejected for x in info.benjamini_hochberg(p, 0.05).collect()} == {"a": True, "b": True, "c": True, "d": False}
    ci = info.bootstrap(line.selectExpr("x", "y", "cast(x as long) as b"), "x", "y", "b", 200)
    assert ci["low"] <= ci["r"] <= ci["high"] + 1e-9


def test_decay_model_is_recognised(spark):
    rows = [("e", 0.2 + 0.7 * float(np.exp(-i / 40)), i) for i in range(300)]
    points = info.decay_points(spark.createDataFrame(rows, "g string, v double, i int"), "v", "i", "g")
    best = info.decay_fits(points, "g").orderBy("aic").first()
    assert best.model == "exponential" and best.weight > 0.99


def test_allocation():
    assert info.allocation({"a": 900, "b": 90, "c": 10}, 100, 5) == {"a": 86, "b": 9, "c": 5}
    assert info.allocation({"a": 3, "b": 4}, 100, 5) == {"a": 3, "b": 4}


def test_fusion(spark):
    ranked = spark.createDataFrame([(1, "s", "a", 1), (1, "s", "b", 2), (1, "t", "b", 1), (1, "u", "c", 1)], "query_id int, signal string, id string, rank int")
    out = r.best(r.fused(ranked, {"s": 1.0, "t": 1.0, "u": 0.0}), 10).collect()
    assert [x.id for x in out] == ["b", "a"] and abs(out[0].score - (1 / 62 + 1 / 61)) < 1e-9
    flipped = r.best(r.fused(ranked, {"s": 1.0, "u": 3.0}), 1).first()
    assert flipped.id == "c"


def test_boosts(spark):
    from pyspark.sql import functions as F

    one = spark.range(1).select(
        r.recency(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("new"), r.recency(F.lit(1.0), F.lit(0.0), F.lit(86400.0 * 10_000)).alias("old"), r.recency(F.lit(1.0), F.lit(10.0), F.lit(0.0)).alias("future"),
        r.info_weight(F.lit(0.05)).alias("half"), r.info_weight(F.lit(None).cast("double")).alias("unknown"), r.info_weight(F.lit(0.0), 0.0).alias("off"),
        r.symbolic(F.lit(True), F.lit(True), F.lit(False), F.lit(None).cast("boolean"), F.lit(1)).alias("two"), r.symbolic(F.lit(True), F.lit(True), F.lit(True), F.lit(True), F.lit(51)).alias("late"),
        r.temporal_factor(F.lit(2.0), 1.0).alias("time"), r.quality_tier(F.lit(0.6), F.lit(True)).alias("tier")).first()
    assert one.new == 1.5 and abs(one.old - 1) < 1e-9 and one.future == 1.5 and one.half == 0.75 and one.unknown == one.off == one.late == 1.0
    assert abs(one.two - 1.25 * 1.15) < 1e-12 and abs(one.time - 0.2) < 1e-12 and one.tier == 1.25


def test_recall_and_search(spark):
    drawers = spark.createDataFrame([("a", "w", "r", "2024-01-01T00:00:00", "spark joins tables"), ("b", "w", "r", "2024-01-02T00:00:00", "tables and chairs"), ("c", "w", "r", "2024-01-03T00:00:00", None)], "id string, wing string, room string, filed_at string, text string").fillna("", ["text"])
    asked = spark.createDataFrame([(1, "Spark tables"), (2, "nothing here")], "query_id long, text string")
    assert [x.id for x in r.bm25(asked, drawers).orderBy("rank").collect()] == ["a", "b"]
    assert [(x.query_id, x.id) for x in r.boolean_match(asked, drawers).collect()] == [(1, "a")]
    assert [x.id for x in r.search(asked, drawers).orderBy("rank").collect()] == ["a", "b"]
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 1)], "query_id long, id string, rank int")
    good = spark.createDataFrame([(1, "b"), (2, "z")], "query_id long, id string")
    e = {x.query_id: x for x in evaluation.at_k(ranked, good, 2).collect()}
    assert (e[1].recall_any, e[1].recall) == (1.0, 1.0) and abs(e[1].ndcg - 1 / np.log2(3)) < 1e-9 and e[2].recall_any == e[2].ndcg == 0.0


def test_dense_blocks_and_greedy(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = unit(rng, 30)
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(30)], "id long, vector array<double>")
    asked = rows.selectExpr("id as query_id", "vector").where("id < 12")
    want = {(q, k + 1): j for q in range(12) for k, j in enumerate(sorted((j for j in range(30) if j != q), key=lambda j: -float(x[q] @ x[j]))[:4])}
    for block in (5, 100):
        monkeypatch.setattr(r, "QUERY_BLOCK", block)
        assert {(t.query_id, t["rank"]): t.id for t in r.dense(asked, rows, 4).collect()} == want
    near = [(i, "f", 100 - i, x[0].tolist() if i < 3 else x[i].tolist()) for i in range(6)] + [(9, "f", 5, x[9].tolist())]
    kept = {t.id: t.kept for t in dedup.greedy(spark.createDataFrame(near, "id long, source_file string, size int, vector array<double>"), 0.01).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: True, 4: True, 5: True, 9: False}


def test_large_groups_are_decided_in_parts(spark):
    rng = np.random.default_rng(8)
    x = unit(rng, 120, 3)
    rows = spark.createDataFrame([(i, "ab"[i % 3 == 0], int(15 + rng.integers(9)), x[i].tolist()) for i in range(120)], "id long, source_file string, size int, vector array<double>")
    whole = {t.id: t.kept for t in dedup.greedy(rows, 0.1).collect()}
    assert {t.id: t.kept for t in dedup.greedy(rows, 0.1, block=50).collect()} == whole and 5 < sum(whole.values()) < 110
    noisy = [(g, 0.2 + 0.7 * float(np.exp(-i / s)) + 0.01 * float(rng.normal()), float(i)) for g, s in (("e", 40), ("f", 15)) for i in range(1, 90 if g == "e" else 40)]
    points = spark.createDataFrame(noisy, "g string, mean double, at double")
    one, parts = ({(t.g, t.model): t for t in info.decay_fits(points, "g", block=b).collect()} for b in (1000, 50))
    assert one.keys() == parts.keys() and len(one) == 4
    for k, t in one.items():
        assert parts[k].aic == pytest.approx(t.aic, abs=1e-4) and parts[k].weight == pytest.approx(t.weight, abs=1e-4)
