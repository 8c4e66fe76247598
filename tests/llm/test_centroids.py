import hashlib
import math
import random

import numpy as np
import pytest

from verbatica.llm import centroids as cc


def plainly(rows, k, rounds, dim):
    """(key, cluster, distance, final centroid) of the kept rows by comparing all distances, in Python's integers."""
    kept = [(i, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest()), r[1]))[:k]
    centres = [x for _, x in start]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        centres = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    return sorted((repr(i), nearest(x)[1], min(nearest(x)[0], 2**63 - 1), tuple(map(str, centres[nearest(x)[1]]))) for i, x in kept)


def found(spark, rows, dim, parts=3, **more):
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(parts)
    return sorted((repr(r.vec_id), r.cluster, r.distance, tuple(r.centroid)) for r in cc.clustered(df, dim=dim, **more).collect())


def _rows(seed, n, dim, spread):
    rng = random.Random(seed)
    return [(i, [rng.choice(spread) + rng.gauss(0, 0.02) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("k, rounds", [(7, 4), (1, 2), (5, 0)])
def test_equal_to_all_distances(spark, k, rounds):
    rows = _rows(1, 200, 6, [-1.0, 0.0, 0.5])
    rows += [(None, [0.1] * 6), (3, rows[9][1]), (3, rows[9][1]), (900, rows[0][1])]
    rows += [(901, None), (902, [0.0] * 5), (903, [None] + [0.0] * 5), (904, [float("nan")] * 6), (905, [float("inf")] + [0.0] * 5), (906, [])]
    assert found(spark, rows, 6, k=k, rounds=rounds) == plainly(rows, k, rounds, 6)


def test_ties_and_empty_clusters(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)]  # centroids that are equal, and vectors midway
    rows += [(100 + i, [0.5, 0.0]) for i in range(9)]
    assert found(spark, rows, 2, k=8, rounds=3) == plainly(rows, 8, 3, 2)


def test_integers_past_64_bits(spark):
    rows = [(1, [3e38, -3e38]), (2, [1e305, 0.0]), (3, [0.25, 7.0]), (4, [-2.0e30, 1.5]), (5, [1e12, -1e12]), (6, [0.1, 0.2])]
    assert found(spark, rows, 2, k=3, rounds=2) == plainly(rows, 3, 2, 2)


def test_no_vectors(spark):
    assert found(spark, [(1, None)], 4) == []


def test_limbs_add_up():
    for v in (0, 5, -5, 2**31, -(2**31) - 1, 2**200 + 12345, -(2**200) - 999):
        assert sum(limb << (cc.LIMB * place) for place, limb in cc.limbs(v)) == v
        assert all(-(2**32) < limb < 2**32 for _, limb in cc.limbs(v))


def test_zero_favours_the_smaller_number():
    two = cc.Bisectors([[0, 0], [2, 0], [0, 0]])
    winner, distance = two.nearest(np.array([[1, 0], [2, 0], [0, 5]]))
    assert winner.tolist() == [0, 1, 0] and distance.tolist() == [1, 0, 25]
