"""Numbers, quantiles and resampling over data that no task holds whole.

A group of any size is cut into ranges of its order; places and running counts run inside a range and start from the counts of the ranges before it, of
which there is one number each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.lineage import cut

#: Blocks that one task draws for at once.
CHUNK = 256
#: Size of a quantile sketch: ranks are off by less than a hundredth, with more than 99 % confidence.
SKETCH = 400
QUARTERS = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}


def _running(df: DataFrame, by: list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """df with `name`: the sum of weight over the rows of the same group up to this one, in an order that no two rows share."""
    ranged = cut(df.withColumn("__w", weight.cast("long")).repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "running")
    parts = ranged.groupBy(*by, "__part").agg(F.sum("__w").alias("__m"))
    before = parts.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__at"), (F.sum("__m").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__m")).alias("__offset"))
    inside = F.sum("__w").over(Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("__part") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return ranged.withColumn("__in", inside).join(before, same).select(*df.columns, (F.col("__offset") + F.col("__in")).alias(name))


def numbered(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "place") -> DataFrame:
    """df with the place of each row in its group, from 1, in an order that no two rows of a group share."""
    return _running(df, by or [], order, F.lit(1), name)


def exact_quantiles(df: DataFrame, value: str, by: list[str], shares: dict[str, float] | None = None) -> DataFrame:
    """by, a column for each share (linear between neighbours), mean and n of each group's values; nulls don't count, a group of nulls only has nulls and 0.

    Equal values are one row with a count, so a hot group costs its distinct values, spread over ranges.
    """
    shares = QUARTERS if shares is None else shares
    counts = df.select(*by, F.col(value).cast("double").alias("__v")).groupBy(*by, "__v").agg(F.count("__v").alias("__n"))
    upto = _running(counts.where("__v is not null"), by, ["__v"], F.col("__n"), "__upto")
    totals = counts.groupBy(*by).agg(F.sum("__n").alias("n"), F.try_divide(F.sum(F.col("__v") * F.col("__n")), F.sum("__n")).alias("mean"))
    keys = totals.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("n").alias("__all"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    at = lambda q, end: end((F.col("__all") - 1) * F.lit(q))
    holds = lambda i: (F.col("__upto") > i) & (F.col("__upto") - F.col("__n") <= i)
    ends = [F.max(F.when(holds(at(q, end)), F.col("__v"))).alias(f"__{name}_{side}") for name, q in shares.items() for side, end in (("low", F.floor), ("high", F.ceil))]
    found = upto.join(keys, same).groupBy(*by).agg(*ends).withColumnsRenamed({c: f"__{c}" for c in by})
    part = lambda q: (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
    return totals.join(found, same, "left").select(
        *by, *[(F.col(f"__{name}_low") + (F.col(f"__{name}_high") - F.col(f"__{name}_low")) * part(q)).alias(name) for name, q in shares.items()], "mean", "n")


def sketched(df: DataFrame, value: str, by: list[str], edges: list[float], size: int = SKETCH) -> DataFrame:
    """One pass for by, n, sum, low, high, bins (counts between edges, what lies beyond in the last) and a mergeable quantile sketch; see ``merged``."""
    v = F.col(value).cast("double")
    last = len(edges) - 2
    in_bin = lambda i: (v >= edges[i] if i else F.lit(True)) & (v < edges[i + 1] if i < last else F.lit(True))
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("sum"), F.min(v).alias("low"), F.max(v).alias("high"),
                               F.array(*[F.count_if(v.isNotNull() & in_bin(i)) for i in range(last + 1)]).alias("bins"), F.kll_sketch_agg_double(v, size).alias("sketch"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """The same of unions of groups, or of exports of several stores: counts add up and sketches merge, no value is read again."""
    width = F.max(F.size("bins"))
    bins = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate(F.collect_list("bins"), F.lit(0).cast("long"), lambda s, b: s + F.get(b, i)))  # a row for each part
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("low").alias("low"), F.max("high").alias("high"), bins.alias("bins"), F.kll_merge_agg_double("sketch").alias("sketch"))


def estimated(sketches: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """sketches with mean and a column for each share, by their sketch."""
    shares = QUARTERS if shares is None else shares
    return sketches.select("*", F.try_divide("sum", "n").alias("mean"), *[F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q).cast("double"))).alias(name) for name, q in shares.items()]).drop("sketch", "sum")


def report(drawers: DataFrame, novelty: DataFrame, text_edges: list[float], novelty_edges: list[float], exact: bool = True) -> DataFrame:
    """A row for each wing: drawers, rooms, with_filed_at, and bins and quantiles of the length of texts and of the novelty; first_in_wing rows have none before them.

    drawers has id, wing, room, filed_at and size (characters of the text); novelty has id, novelty and is_first.  With exact the quantiles are exact, otherwise one pass of sketches.
    """
    size = drawers.select("wing", "size")
    new = drawers.select("id", "wing").join(novelty, "id").select("wing", F.when(~F.col("is_first"), F.col("novelty")).alias("novelty"), "is_first")
    counts = drawers.groupBy("wing").agg(F.count("*").alias("drawers"), F.countDistinct("room").alias("rooms"), F.count_if(F.coalesce(F.col("filed_at"), F.lit("")) != "").alias("with_filed_at"))
    first = new.groupBy("wing").agg(F.count_if("is_first").alias("first_in_wing"))

    def part(df: DataFrame, value: str, edges: list[float], prefix: str) -> DataFrame:
        told = sketched(df, value, ["wing"], edges)
        bins = told.select("wing", F.col("bins").alias(f"{prefix}_bins"))
        found = exact_quantiles(df, value, ["wing"]) if exact else estimated(told).select("wing", *QUARTERS, "mean", "n")
        return found.withColumnsRenamed({c: f"{prefix}_{c}" for c in (*QUARTERS, "mean", "n")}).join(bins, "wing")

    return counts.join(part(size, "size", text_edges, "text"), "wing").join(first, "wing", "left").join(part(new, "novelty", novelty_edges, "novelty"), "wing", "left")


def summary(reports: DataFrame, by: list[str]) -> DataFrame:
    """A row for each store of reports (several wings each): drawers, wings, wings_scored, and of the wings' novelty medians the median, the least and the most."""
    sizes = reports.groupBy(*by).agg(F.sum("drawers").alias("drawers"), F.count("*").alias("wings"), F.count("novelty_median").alias("wings_scored"),
                                     F.min("novelty_median").alias("novelty_least"), F.max("novelty_median").alias("novelty_most"))
    middle = exact_quantiles(reports, "novelty_median", by, {"novelty_middle": 0.5}).select(*by, "novelty_middle")
    return sizes.join(middle, by, "left") if by else sizes.join(F.broadcast(middle))  # one row each without a key


def block_size(n: int) -> int:
    """Rows of a contiguous block: a fifth of all, 10 at least and 100 at most."""
    return max(10, min(100, n // 5))


def draws(seed: int, blocks: int, resamples: int, chunk: int) -> np.ndarray:
    """How often each resample draws each block of one chunk, if as many blocks as there are are drawn with replacement.

    The number of draws is dealt down a binary tree over the chunks and then inside the chunk; every node has its own generator, so each task
    finds the draws of its chunk by itself, and all chunks together are one multinomial draw.
    """
    low, high = 0, -(-blocks // CHUNK)
    total = np.full(resamples, blocks)
    while high - low > 1:
        middle = (low + high) // 2
        left, whole = (middle - low) * CHUNK, min(high * CHUNK, blocks) - low * CHUNK
        taken = np.random.Generator(np.random.Philox(key=[seed, (low << 32) | high])).binomial(total, left / whole)
        low, high, total = (low, middle, taken) if chunk < middle else (middle, high, total - taken)
    inside = min(CHUNK, blocks - low * CHUNK)
    return np.random.Generator(np.random.Philox(key=[seed + 1, low])).multinomial(total, np.full(inside, 1 / inside))


def blocks_of(df: DataFrame, order: list[str], sums: dict[str, Column], size: int | None = None) -> tuple[DataFrame, int]:
    """(block, n and each sum) of contiguous blocks of the rows in their order, numbered from 0, and how many blocks there are."""
    held = df.select(*order, *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"__{name}") for name, c in sums.items()])
    n = held.count()
    size = size or block_size(n)
    out = numbered(held, order).groupBy(F.floor((F.col("place") - 1) / size).alias("block")).agg(F.count("*").alias("n"), *[F.sum(f"__{name}").alias(name) for name in sums])
    return out, -(-n // size)


def bootstrap_ci(df: DataFrame, order: list[str], sums: dict[str, Column], statistic: Callable[[dict[str, np.ndarray]], np.ndarray], resamples: int = 1000, confidence: float = 0.95,
                 seed: int = 42, size: int | None = None) -> dict[str, float]:
    """A statistic of sums over all rows, and its block bootstrap interval; statistic takes the sums (and n) of many resamples at once.

    Blocks are contiguous in the order, so that rows near each other stay together.  Spark draws and adds up; a row of sums for each resample reaches the driver.
    No rows give NaN.
    """
    blocks, count = blocks_of(df, order, sums, size)
    names = ["n", *sums]

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        chunk = int(frame["block"].iloc[0]) // CHUNK
        times = draws(seed, count, resamples, chunk)[:, frame["block"].to_numpy() - chunk * CHUNK]
        return pd.DataFrame(times @ frame[names].to_numpy(float), columns=names).assign(resample=np.arange(resamples))

    if not count:
        return {"value": float("nan"), "low": float("nan"), "high": float("nan")}
    schema = ", ".join(f"{c} double" for c in names) + ", resample int"
    drawn = blocks.groupBy(F.floor(F.col("block") / CHUNK).alias("chunk")).applyInPandas(add, schema).groupBy("resample").agg(*[F.sum(c).alias(c) for c in names]).orderBy("resample").toPandas()
    whole = blocks.agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    told = statistic({c: drawn[c].to_numpy(float) for c in names})
    tail = (1 - confidence) / 2
    return {"value": float(statistic({c: whole[c].to_numpy(float) for c in names})[0]), "low": float(np.quantile(told, tail)), "high": float(np.quantile(told, 1 - tail))}


def recall_by_threshold(ranked: DataFrame, answers: DataFrame, scores: DataFrame, percents: tuple[int, ...] = (10, 25, 50), k: int = 5) -> DataFrame:
    """(percent, recall, n): the share of queries with an answer among their first k sessions, after the least telling percent of the sessions is dropped; 0 drops none.

    ranked (query_id, session_id, rank) holds all sessions of each query's history, answers (query_id, session_id) those that answer it, scores (session_id, score) how
    telling a session is; sessions without a score stay.  A query of which no session is left does not count.
    """
    placed = numbered(scores.where("score is not null"), ["score", "session_id"])
    n = scores.where("score is not null").count()
    level = F.array(F.lit(0), *[F.when(F.col("place") > int(n * p / 100), F.lit(p)).otherwise(F.lit(None).cast("int")) for p in percents])
    kept = placed.select("session_id", F.explode(F.array_compact(level)).alias("percent"))
    every = F.explode(F.array(F.lit(0), *map(F.lit, percents)))
    loose = ranked.join(scores.where("score is not null").select("session_id"), "session_id", "left_anti").select("query_id", "session_id", "rank", every.alias("percent"))
    left = ranked.join(kept, "session_id").select("query_id", "session_id", "rank", "percent").unionByName(loose)
    order = Window.partitionBy("percent", "query_id").orderBy("rank", "session_id")
    top = left.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
    hit = top.join(answers.select("query_id", "session_id", F.lit(1).alias("good")).distinct(), ["query_id", "session_id"], "left")
    return hit.groupBy("percent", "query_id").agg(F.max(F.coalesce("good", F.lit(0))).alias("hit")).groupBy("percent").agg(F.avg("hit").alias("recall"), F.count("*").alias("n"))
