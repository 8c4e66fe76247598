"""Information statistics: novelty against earlier rows, residuals, distributions and tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.lineage import cut
from .distributions import exact_quantiles, numbered

#: Rows of a group that meet in one block, on either side.
BLOCK = 2048


def earlier_neighbours(rows: DataFrame, k: int = 1, block: int = BLOCK) -> DataFrame:
    """(id, prior, score, rank): the k most similar strictly earlier rows of the same group, exactly.

    rows has id, grp, filed and a unit vector.  A group is dealt into blocks by a hash of the id; every pair of blocks is one
    cell, multiplied in one task, so a group that holds most rows is spread over many tasks, and only k candidates a row
    leave a cell.  Ties go to the larger id.
    """
    sizes = rows.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = rows.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    target = placed.withColumn("other", every).select("grp", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("asks"), "id", "filed", "vector")
    prior = placed.withColumn("other", every).select("grp", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"), "id", "filed", "vector")

    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        ask, old = frame[frame.asks], frame[~frame.asks]
        empty = pd.DataFrame({"id": np.zeros(0, np.int64), "prior": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(ask) or not len(old):
            return empty
        old = old.sort_values("id", ascending=False)
        score = np.stack(ask.vector.to_list()) @ np.stack(old.vector.to_list()).T
        score[old.filed.to_numpy()[None, :] >= ask.filed.to_numpy()[:, None]] = -np.inf
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(score, top, 1)
        keep = np.isfinite(value)
        return pd.DataFrame({"id": np.repeat(ask.id.to_numpy(), keep.sum(axis=1)), "prior": old.id.to_numpy()[top][keep], "score": value[keep]})

    met = target.unionByName(prior).groupBy("grp", "i", "j").applyInPandas(cell, "id long, prior long, score double")
    order = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("prior"))
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def novelty(rows: DataFrame) -> DataFrame:
    """(id, grp, novelty, is_first): 1 less the largest similarity to an earlier row of the group; 1.0 for the first."""
    near = earlier_neighbours(rows, 1).select("id", "score")
    return rows.select("id", "grp").join(near, "id", "left").select(
        "id", "grp", F.coalesce(1 - F.col("score"), F.lit(1.0)).alias("novelty"), F.col("score").isNull().alias("is_first"))


def band(value: Column) -> Column:
    return F.when(value < 0.10, "low").when(value < 0.50, "medium").otherwise("high")


def backfilled(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """(id, novelty, tagged): the novelty a row is tagged with in tags (id, novelty), computed for rows without; tagged tells which are new."""
    held = tags.where("novelty is not null").select("id", F.col("novelty").alias("old"))
    return novelty(rows).join(held, "id", "left").select("id", F.coalesce("old", "novelty").alias("novelty"), F.col("old").isNull().alias("tagged"))


def scored_novelty(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, novelty, band) of queries from their nearest rows (query_id, score): 1 less the best, 1.0 without any."""
    near = hits.groupBy("query_id").agg(F.max("score").alias("score"))
    found = queries.select("query_id").join(near, "query_id", "left").select("query_id", F.coalesce(1 - F.col("score"), F.lit(1.0)).alias("novelty"))
    return found.withColumn("band", band(F.col("novelty")))


def residuals(rows: DataFrame, k: int = 20, least: int = 5, ridge: float = 0.001) -> DataFrame:
    """(id, residual): how far a vector lies from its reconstruction by up to k earlier neighbours; null below `least`."""
    near = earlier_neighbours(rows, k).select("id", "prior")
    held = near.join(rows.select(F.col("id").alias("prior"), F.col("vector").alias("pv")), "prior").groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("prior", "pv"))), lambda x: x["pv"]).alias("priors"))
    both = rows.select("id", "vector").join(held, "id", "left")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vector, priors in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if priors is None or len(priors) < least:
                    out.append(None)
                    continue
                x, p = np.array(vector), np.array(priors)
                w = reconstruction_weights(x, p, ridge)
                out.append(float(np.linalg.norm(x - w @ p)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["id", "residual"])

    return both.mapInArrow(solve, "id long, residual double")


def reconstruction_weights(target: np.ndarray, priors: np.ndarray, ridge: float = 0.001) -> np.ndarray:
    """Locally linear weights that sum to one, from the regularised Gram matrix of the differences."""
    z = priors - target
    gram = z @ z.T
    gram = gram + np.eye(len(priors)) * ridge * (np.trace(gram) or 1.0)
    w = np.linalg.solve(gram, np.ones(len(priors)))
    return w / w.sum()


def histogram(df: DataFrame, value: str, edges: list[float], by: str | None = None) -> DataFrame:
    """(by, bin, n): bins are closed on the left; what lies beyond the last edge counts in the last bin, below the first in the first."""
    last = len(edges) - 2
    bin_ = F.lit(0)
    for i, edge in enumerate(edges[1:-1], 1):
        bin_ = F.when(F.col(value) >= edge, F.lit(i)).otherwise(bin_)
    keys = ([by] if by else []) + ["bin"]
    return df.where(F.col(value).isNotNull()).withColumn("bin", F.least(bin_, F.lit(last))).groupBy(*keys).agg(F.count("*").alias("n"))


def pooled(histograms: DataFrame) -> DataFrame:
    """(bin, n): the sum of the groups' histograms over the same edges."""
    return histograms.groupBy("bin").agg(F.sum("n").alias("n"))


def variance_per_bin(df: DataFrame, at: str, value: str, width: int = 10) -> DataFrame:
    """(start, variance): the sample variance of value in bins of `at` from its smallest on; 1.0 where fewer than two rows are."""
    kept = df.where(F.col(at).isNotNull() & F.col(value).isNotNull()).select(F.col(at).alias("at"), F.col(value).alias("v"))
    ends = kept.agg(F.min("at").cast("long").alias("low"), F.max("at").cast("long").alias("high"))
    starts = ends.where("low is not null").select(F.explode(F.sequence("low", "high", F.lit(width))).alias("start"))
    low = ends.first()["low"] or 0
    spread = kept.groupBy((low + F.floor((F.col("at") - low) / width) * width).cast("long").alias("start")).agg(F.var_samp("v").alias("variance"), F.count("*").alias("n"))
    return starts.join(spread, "start", "left").select("start", F.when(F.col("n") > 1, F.col("variance")).otherwise(F.lit(1.0)).alias("variance"))


def quantiles(df: DataFrame, value: str, by: str) -> DataFrame:
    """p25, median, p75, p90, mean and n of each group, exactly; no task holds a group."""
    return exact_quantiles(df, value, [by])


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, rank, n): the mean rank of each distinct value among all rows, from counts alone.

    Distinct values are cut into ranges; ranks run inside a range and start from the counts of the ranges before, of which
    there is one number each.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    ranged = cut(counts.repartitionByRange(value).withColumn("part", F.spark_partition_id()), "ranks")
    # one row for each range
    before = ranged.groupBy("part").agg(F.sum("n").alias("m")).select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("offset"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(before, "part").select(value, (F.col("offset") + inside - F.col("n") + (F.col("n") + 1) / 2).alias("rank"), "n")


def kruskal(df: DataFrame, value: str, by: str, least: int = 20) -> DataFrame:
    """One row: the Kruskal-Wallis H of groups of at least `least` rows, corrected for ties, with epsilon squared and p."""
    kept = df.where(F.col(value).isNotNull())
    large = kept.groupBy(by).agg(F.count("*").alias("m")).where(F.col("m") >= least).select(by)
    kept = kept.join(large, by, "left_semi")
    ranks = average_ranks(kept, value)
    per = kept.join(ranks.select(value, "rank"), value).groupBy(by).agg(F.count("*").alias("m"), F.sum("rank").alias("r"))
    total = per.agg(F.lit(1).alias("one"), F.sum("m").alias("n"), F.count("*").alias("k"), F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"))
    ties = ranks.agg(F.lit(1).alias("one"), F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("t"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    h = F.try_divide(F.try_divide(F.lit(12.0), n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.try_divide(F.col("t"), n * n * n - n))
    @F.pandas_udf("double")
    def tail(h: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or g < 2 else chi_square_tail(x, int(g) - 1) for x, g in zip(h, k, strict=True)], dtype="float64")

    return (total.join(ties, "one").select(h.alias("h"), F.col("n").alias("n"), F.col("k").alias("k"))
            .withColumn("epsilon_squared", F.greatest(F.try_divide(F.col("h") - F.col("k") + 1, F.col("n") - F.col("k")), F.lit(0.0)))
            .withColumn("p", tail("h", "k")))


def chi_square_tail(x: float, df: int) -> float:
    """P(X >= x) of the chi-square distribution, by the series or the continued fraction of the incomplete gamma function."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - front * total)
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the rank correlation of two columns over rows where both are there."""
    kept = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    rx = average_ranks(kept, x).select(x, F.col("rank").alias("rx"))
    ry = average_ranks(kept, y).select(y, F.col("rank").alias("ry"))
    return kept.join(rx, x).join(ry, y).agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def bootstrap(df: DataFrame, x: str, y: str, block: str, resamples: int = 1000, confidence: float = 0.95, seed: int = 42, blocks: int = 100) -> dict[str, float]:
    """Pearson correlation with a block bootstrap interval; Spark sums each of at most `blocks` blocks, and those are resampled."""
    b = F.pmod(F.xxhash64(block), F.lit(blocks))
    v, w = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.where(v.isNotNull() & w.isNotNull()).groupBy(b.alias("b")).agg(*[F.sum(e).alias(n) for n, e in (("n", F.lit(1.0)), ("x", v), ("y", w), ("xx", v * v), ("yy", w * w), ("xy", v * w))]).orderBy("b").collect()
    sums = np.array([[r[k] for k in ("n", "x", "y", "xx", "yy", "xy")] for r in rows])

    def r(s: np.ndarray) -> np.ndarray:
        n, sx, sy, sxx, syy, sxy = s.T
        return (n * sxy - sx * sy) / np.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))

    rng = np.random.default_rng(seed)
    drawn = np.stack([sums[rng.integers(len(sums), size=len(sums))].sum(axis=0) for _ in range(resamples)])
    tail = (1 - confidence) / 2
    return {"r": float(r(sums.sum(axis=0)[None])[0]), "low": float(np.quantile(r(drawn), tail)), "high": float(np.quantile(r(drawn), 1 - tail))}


def spearman_bootstrap(df: DataFrame, x: str, y: str, block: str, **more: float) -> dict[str, float]:
    """Rank correlation with a block bootstrap interval, as ``bootstrap``; blocks are resampled with the ranks they have among all rows."""
    kept = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y, block)
    rx = average_ranks(kept, x).select(x, F.col("rank").alias("rx"))
    ry = average_ranks(kept, y).select(y, F.col("rank").alias("ry"))
    return bootstrap(kept.join(rx, x).join(ry, y), "rx", "ry", block, **more)


def benjamini_hochberg(p_values: DataFrame, q: float = 0.05) -> DataFrame:
    """(test, p, rejected): all up to the largest rank whose p lies below rank / m * q; one row a test, so few."""
    m = F.count("*").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy("p", "test"))
    ranked = p_values.withColumn("m", m).withColumn("rank", rank)
    edge = F.max(F.when(F.col("p") <= F.col("rank") / F.col("m") * q, F.col("rank"))).over(Window.partitionBy())
    return ranked.withColumn("edge", edge).select("test", "p", F.coalesce(F.col("rank") <= F.col("edge"), F.lit(False)).alias("rejected"))


def jensen_shannon(counts: DataFrame) -> DataFrame:
    """(a, b, distance) of every two groups of (grp, bin, n), base 2; groups are few (wings), bins fewer."""
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("grp")))
    groups = share.select("grp").distinct()
    pairs = groups.select(F.col("grp").alias("a")).join(groups.select(F.col("grp").alias("b")), F.col("a") < F.col("b"))  # what the result has, one row each
    mid = (F.col("pa") + F.col("pb")) / 2
    shared = share.select(F.col("grp").alias("a"), "bin", F.col("p").alias("pa")).join(share.select(F.col("grp").alias("b"), "bin", F.col("p").alias("pb")), "bin").where("a < b")
    # a bin that only one of two groups has adds its whole share
    met = shared.groupBy("a", "b").agg(F.sum(F.col("pa") * F.log2(F.col("pa") / mid) + F.col("pb") * F.log2(F.col("pb") / mid) - F.col("pa") - F.col("pb")).alias("s"))
    return pairs.join(met, ["a", "b"], "left").select("a", "b", F.sqrt(F.greatest((2 + F.coalesce("s", F.lit(0.0))) / 2, F.lit(0.0))).alias("distance"))


def decay_points(df: DataFrame, value: str, order: str, by: str, width: int = 10) -> DataFrame:
    """(by, bin, at, mean, n): the mean of each `width` rows of a group in their order (which no two share), the input of the decay fits."""
    return numbered(df.select(by, order, value), [order], [by]).groupBy(by, F.floor((F.col("place") - 1) / width).alias("bin")).agg(
        F.avg("place").alias("at"), F.avg(value).alias("mean"), F.count("*").alias("n"))


def _decay_sums(name: str, p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """J'J, J'r and the squared loss of a decay model over points; sums of parts add up."""
    def model(p: np.ndarray) -> np.ndarray:
        return p[0] * x ** -p[1] if name == "powerlaw" else p[2] + (p[0] - p[2]) * np.exp(-x / max(p[1], 1e-6))

    with np.errstate(all="ignore"):
        base = model(p)
        jac = np.stack([(model(p + d) - base) / 1e-6 for d in np.eye(len(p)) * 1e-6], axis=1)
        return np.concatenate(((jac.T @ jac).ravel(), jac.T @ (y - base), [((y - base) ** 2).sum()]))


class _Fit:
    """One model on one group: parameters, and the damped Gauss-Newton step that is tried next."""

    def __init__(self, name: str, first: tuple, last: tuple):
        start = {"powerlaw": [max(first[1], 1e-6), 0.1], "exponential": [first[1], max(last[0] - first[0], 1.0) / 2, last[1]]}[name]
        self.name, self.best, self.now, self.damping, self.steps, self.done = name, np.array(start, float), None, 1e-2, 0, False
        self.tried = self.best

    def take(self, sums: np.ndarray) -> None:
        """Sums over the group's points at what was tried; the next try follows."""
        k = len(self.best)
        if self.now is None:
            self.now = sums
        elif np.isfinite(sums).all() and sums[-1] < self.now[-1]:
            self.done = self.now[-1] - sums[-1] < 1e-14
            self.best, self.now, self.damping = self.tried, sums, self.damping / 3
        else:
            self.damping *= 4
            self.done = self.damping > 1e12
        self.steps += 1
        self.done |= self.steps > 200
        self.tried = self.best + np.linalg.lstsq(self.now[: k * k].reshape(k, k) + self.damping * np.eye(k), self.now[k * k : -1], rcond=None)[0]


MODELS = ("powerlaw", "exponential")


def _told(fits: list[_Fit], n: int) -> list[tuple]:
    """(model, a, b, c, aic, weight) of the finished fits of one group."""
    out = [(f.name, *[float(v) for v in f.best], *[None] * (3 - len(f.best)), float(n * math.log(max(f.now[-1], 1e-300) / n) + 2 * (len(f.best) + 1))) for f in fits]
    rel = [math.exp(-(row[-1] - min(r[-1] for r in out)) / 2) for row in out]
    return [(*row, r / sum(rel)) for row, r in zip(out, rel, strict=True)]


def decay_fits(points: DataFrame, by: str, least: int = 3, block: int = BLOCK) -> DataFrame:
    """(by, model, a, b, c, aic, weight) of a power law and an exponential, fitted to each group's points by Gauss-Newton steps.

    A group of at most `block` points is fitted in one task.  Larger ones take their steps together: each step is one job that adds up J'J, J'r and the
    loss of every such group and model, and only these sums and the parameters (a few numbers for each large group) reach the driver.
    """
    points = cut(points.select(by, "at", "mean"), "decay")
    schema = f"{by} string, model string, a double, b double, c double, aic double, weight double"
    sizes = points.groupBy(by).agg(F.count("*").alias("n"), F.min(F.struct("at", "mean")).alias("first"), F.max(F.struct("at", "mean")).alias("last"))
    large = sizes.where(F.col("n") > max(block, least - 1)).collect()  # one row for each large group

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("at")
        x, y = f["at"].to_numpy(float), f["mean"].to_numpy(float)
        rows = []
        if len(x) >= least:
            fits = [_Fit(name, (x[0], y[0]), (x[-1], y[-1])) for name in MODELS]
            for one in fits:
                while not one.done:
                    one.take(_decay_sums(one.name, one.tried, x, y))
            rows = _told(fits, len(x))
        return pd.DataFrame([(frame[by].iloc[0], *r) for r in rows], columns=[by, "model", "a", "b", "c", "aic", "weight"])

    small = points.join(sizes.where(F.col("n") <= block).select(F.col(by).alias("__by")), F.col(by).eqNullSafe(F.col("__by")), "left_semi").groupBy(by).applyInPandas(fit, schema)
    if not large:
        return small
    fits = {g[by]: [_Fit(name, g["first"], g["last"]) for name in MODELS] for g in large}
    width = 3 * 3 + 3 + 1
    names = [f"s{i}" for i in range(width)]
    while active := {(group, f.name): f.tried for group, of in fits.items() for f in of if not f.done}:
        def part(frames: Iterator[pd.DataFrame], active: dict = active) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for group, f in frame.groupby(by, dropna=False):
                    group = None if pd.isna(group) else group
                    x, y = f["at"].to_numpy(float), f["mean"].to_numpy(float)
                    rows = [(group, name, *np.pad(s, (0, width - len(s)))) for name in MODELS if (group, name) in active for s in [_decay_sums(name, active[group, name], x, y)]]
                    if rows:
                        yield pd.DataFrame(rows, columns=[by, "model", *names])

        summed = points.mapInPandas(part, f"{by} string, model string, " + ", ".join(f"{c} double" for c in names)).groupBy(by, "model").agg(*[F.sum(c).alias(c) for c in names]).collect()
        for r in summed:
            one = fits[r[by]][MODELS.index(r["model"])]
            k = len(one.best)
            one.take(np.array([r[c] for c in names[: k * k + k + 1]], float))
    rows = [(g[by], *r) for g in large for r in _told(fits[g[by]], g["n"])]
    return small.union(points.sparkSession.createDataFrame(rows, schema))


def reservoir(df: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group, chosen by a hash of the key: the same rows on every run and any partitioning."""
    order = Window.partitionBy(by).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return df.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= n).drop("draw")


def allocation(sizes: dict[str, int], total: int, floor: int) -> dict[str, int]:
    """Rows to take of each stratum: in proportion, at least the floor (or all of a smaller one), adding up to the total where that can be."""
    whole = sum(sizes.values())
    total = min(total, whole)
    out = {k: min(n, max(floor, int(total * n / whole))) for k, n in sizes.items()} if whole else {}
    while (gap := total - sum(out.values())) != 0:
        # what is missing goes where most was cut off; what is too much leaves the stratum furthest above its floor
        room = {k: sizes[k] - out[k] if gap > 0 else out[k] - min(floor, sizes[k]) for k in out}
        free = [k for k in out if room[k] > 0]
        if not free:
            break
        k = max(free, key=lambda k: (total * sizes[k] / whole - out[k] if gap > 0 else room[k], k))
        out[k] += 1 if gap > 0 else -1
    return out


def smoothed(series: DataFrame, by: str, at: str, value: str, share: float = 0.1) -> DataFrame:
    """series with smooth: the mean of the last rows, a tenth of the series but three at least; rows before the first full mean take it.

    A series is an aggregate, one row for each point, so its group is small; points are ordered by `at`, which no two share.
    """
    ordered = Window.partitionBy(by).orderBy(at)
    whole = Window.partitionBy(by)
    run = F.greatest(F.lit(3), F.floor(F.count("*").over(whole) * share)).cast("int")
    place = F.row_number().over(ordered)
    placed = series.withColumns({"__run": run, "__at": place, "__sum": F.sum(value).over(ordered.rowsBetween(Window.unboundedPreceding, 0))})
    before = placed.select(F.col(by).alias("__by"), (F.col("__at") + F.col("__run")).alias("__to"), F.col("__sum").alias("__past"))
    joined = placed.join(before, (F.col(by) == F.col("__by")) & (F.col("__at") == F.col("__to")), "left")
    mean = F.when(F.col("__at") >= F.col("__run"), (F.col("__sum") - F.coalesce("__past", F.lit(0.0))) / F.col("__run"))
    first = F.max(F.when(F.col("__at") == F.col("__run"), mean)).over(whole)
    return joined.select(*series.columns, F.coalesce(mean, first, F.lit(0.0)).alias("smooth"))


def saturation(series: DataFrame, null: DataFrame, by: str, at: str, value: str, factor: float = 1.0, lasting: float = 0.1) -> DataFrame:
    """(by, n_star): the first point from which the smoothed values stay below the interquartile range of the null (by, value) for a tenth of the series, ten points at least; null if none.

    Points below the threshold in a row are one island; the first island that lasts begins at the answer.
    """
    range_ = null.groupBy(F.col(by).alias("__null")).agg((F.percentile("value", 0.75) - F.percentile("value", 0.25)).alias("__iqr"))
    ordered = Window.partitionBy(by).orderBy(at)
    marked = smoothed(series, by, at, value).join(range_, F.col(by) == F.col("__null"), "left").withColumns(
        {"__place": F.row_number().over(ordered), "__n": F.count("*").over(Window.partitionBy(by)), "__below": F.coalesce(F.col("smooth") < factor * F.col("__iqr"), F.lit(False))})
    island = F.col("__place") - F.row_number().over(Window.partitionBy(by, "__below").orderBy(at))
    runs = marked.withColumn("__island", island).where("__below").groupBy(by, "__island").agg(F.count("*").alias("n"), F.max("__n").alias("whole"), F.min(at).alias("start"))
    found = runs.where(F.col("n") >= F.greatest(F.lit(10), F.floor(F.col("whole") * lasting))).groupBy(by).agg(F.min("start").alias("n_star"))
    return series.select(by).distinct().join(found, by, "left")
