import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatica.operators import distributions as dist, evaluation, information as info


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.integers(0, 40, 3000)] + [("one", 7.5), ("none", None), ("none", None)]
    return rows + [(None, float(v)) for v in rng.normal(size=101)] + [("two", 1.0), ("two", 4.0), ("two", None)]


def _by_group(rows):
    out = {}
    for g, v in rows:
        out.setdefault(g, []).extend([v] if v is not None else [])
    return out


def test_exact_quantiles_equal_numpy(spark, values):
    rows = {r.g: r for r in dist.exact_quantiles(spark.createDataFrame(values, "g string, v double").repartition(7), "v", ["g"]).collect()}
    for g, held in _by_group(values).items():
        r = rows[g]
        assert r.n == len(held)
        if held:
            assert [r.p25, r.median, r.p75, r.p90, r["mean"]] == pytest.approx([*np.quantile(held, [0.25, 0.5, 0.75, 0.9]), np.mean(held)])
        else:
            assert r.median is None and r["mean"] is None
    assert dist.exact_quantiles(spark.createDataFrame([], "g string, v double"), "v", ["g"]).collect() == []
    assert dist.exact_quantiles(spark.createDataFrame([(3,), (1,), (2,), (4,)], "v int"), "v", []).first().asDict() == {"p25": 1.75, "median": 2.5, "p75": 3.25, "p90": 3.7, "mean": 2.5, "n": 4}


def test_places_are_those_of_one_sort(spark, values):
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(values)], "i int, g string, v double").repartition(5)
    rows = dist.numbered(df, ["v", "i"], ["g"]).collect()
    assert len(rows) == len(values)
    for g in {g for g, _ in values}:
        mine = sorted((r for r in rows if r.g == g), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(1, len(mine) + 1))
        assert [r.i for r in mine] == [r.i for r in sorted(mine, key=lambda r: (r.v is not None, r.v or 0, r.i))]


def test_sketches_merge_and_keep_their_error(spark):
    rng = np.random.default_rng(1)
    rows = [(g, int(k), float(v)) for g in ("a", "b") for k in range(4) for v in rng.gamma(2, 100, 4000)] + [("c", 0, None)]
    parts = dist.sketched(spark.createDataFrame(rows, "g string, k int, v double"), "v", ["g", "k"], [0, 100, 200, 400])
    for r in dist.estimated(dist.merged(parts, ["g"])).collect():
        held = np.sort([v for g, _, v in rows if g == r.g and v is not None])
        assert r.n == len(held) == sum(r.bins)
        if not len(held):
            assert r.median is None
            continue
        assert r.bins == [int((held < 100).sum()), int(((held >= 100) & (held < 200)).sum()), int((held >= 200).sum())]
        for name, q in dist.QUARTERS.items():
            assert abs(np.searchsorted(held, r[name]) / len(held) - q) < 0.01
        assert (r.low, r.high, r["mean"]) == pytest.approx((held[0], held[-1], held.mean()))


@pytest.mark.parametrize("blocks", [1, 5, 256, 257, 1000])
def test_draws_of_all_chunks_are_one_draw(blocks):
    parts = [dist.draws(7, blocks, 50, c) for c in range(-(-blocks // dist.CHUNK))]
    whole = np.concatenate(parts, axis=1)
    assert whole.shape == (50, blocks) and (whole.sum(axis=1) == blocks).all()
    if blocks > 1:
        assert abs(whole.var() - (1 - 1 / blocks)) < 0.15


@pytest.mark.parametrize("n", [37, 900, 60_000])
def test_bootstrap_equals_numpy_on_the_same_draws(spark, n):
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.normal(size=n))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double").repartition(6)
    told = dist.bootstrap_ci(df, ["i"], {"x": F.col("v")}, lambda s: s["x"] / s["n"], resamples=200)
    size = max(10, min(100, n // 5))
    sums = np.array([[len(b), b.sum()] for b in (x[i : i + size] for i in range(0, n, size))])
    times = np.concatenate([dist.draws(42, len(sums), 200, c) for c in range(-(-len(sums) // dist.CHUNK))], axis=1)
    drawn = times @ sums
    assert [told["value"], told["low"], told["high"]] == pytest.approx([x.mean(), *np.quantile(drawn[:, 1] / drawn[:, 0], [0.025, 0.975])])


def test_bootstrap_of_nothing(spark):
    assert np.isnan(dist.bootstrap_ci(spark.createDataFrame([], "i int, v double"), ["i"], {"x": F.col("v")}, lambda s: s["x"])["value"])


def test_the_lowest_sessions_go_by_count(spark):
    scores = spark.createDataFrame([(f"s{i}", 1.0) for i in range(9)], "session_id string, score double")  # all alike: a quantile would drop none
    assert sorted(r.session_id for r in evaluation.dropped_sessions(scores, 25).collect()) == ["s0", "s1"]
    assert evaluation.dropped_sessions(scores, 10).count() == 0 and evaluation.dropped_sessions(scores, 100).count() == 9


def test_recall_falls_as_answers_are_dropped(spark):
    ranked = spark.createDataFrame([("q", f"s{i}", i + 1) for i in range(6)] + [("p", "s0", 1)], "query_id string, session_id string, rank int")
    answers = spark.createDataFrame([("q", "s4"), ("p", "s0")], "query_id string, session_id string")
    scores = spark.createDataFrame([("s0", 0.1), ("s1", 0.2), ("s2", 0.9), ("s3", 0.8), ("s4", None)], "session_id string, score double")
    out = {r.percent: (r.recall, r.n) for r in dist.recall_by_threshold(ranked, answers, scores, k=3).collect()}
    assert out == {0: (0.5, 2), 10: (0.5, 2), 25: (0.0, 1), 50: (1.0, 1)}


def test_large_groups_take_their_steps_together(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(x), float(0.2 + 0.7 * np.exp(-x / t) + rng.normal() * 0.01)) for g, t in (("a", 40), ("b", 90), (None, 20)) for x in range(1, 260)]
    points = spark.createDataFrame(rows, "g string, at double, mean double")
    one = {(r.g, r.model): r for r in info.decay_fits(points, "g").collect()}
    many = {(r.g, r.model): r for r in info.decay_fits(points.repartition(3), "g", block=50).collect()}
    assert set(one) == set(many) and len(one) == 6
    for key in one:
        assert many[key].aic == pytest.approx(one[key].aic, rel=1e-4)
    assert one["a", "exponential"].b == pytest.approx(40, rel=0.1) and one["a", "exponential"].weight > 0.99
