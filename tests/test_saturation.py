import numpy as np

from verbatica.operators import information as info


def plain(n, y, null, factor=1.0):
    """The same by numpy: moving means with the first one ahead, then the first run that lasts."""
    win = max(3, int(len(y) * 0.1))
    means = [np.mean(y[i - win + 1:i + 1]) for i in range(win - 1, len(y))]
    smooth = [means[0] if means else 0.0] * (len(y) - len(means)) + means
    limit = factor * (np.percentile(null, 75) - np.percentile(null, 25))
    need = max(10, int(len(n) * 0.1))
    at = next((n[i] for i in range(len(y) - need + 1) if all(s < limit for s in smooth[i:i + need])), None)
    return smooth, at


def test_smoothed_and_saturation(spark):
    rng = np.random.default_rng(5)
    series = {"falls": 5 / np.arange(1, 61), "flat": np.full(40, 9.0), "dips": np.where(np.arange(50) % 12 < 6, 0.0, 4.0), "short": np.array([0.1, 0.2]), "noise": rng.random(150) * np.linspace(2, 0, 150)}
    null = {k: rng.random(30) for k in series if k != "flat"}
    rows = [(k, 10 * (i + 1), float(v)) for k, y in series.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "grp string, n int, info double").repartition(3)
    held = spark.createDataFrame([(k, float(v)) for k, y in null.items() for v in y], "grp string, value double")
    smooth = {(r.grp, r.n): r.smooth for r in info.smoothed(df, "grp", "n", "info").collect()}
    got = {r.grp: r.n_star for r in info.saturation(df, held, "grp", "n", "info").collect()}
    for k, y in series.items():
        n = [10 * (i + 1) for i in range(len(y))]
        want, at = plain(n, y, null.get(k, np.zeros(2)))
        assert np.allclose([smooth[k, i] for i in n], want) and got[k] == (None if k == "flat" else at)
    assert got["falls"] is not None and got["short"] is None
    assert info.saturation(df.limit(0), held, "grp", "n", "info").count() == 0
