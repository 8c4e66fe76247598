"""De-duplication by vectors: probes, suggestions, and the greedy pass over each source."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.lineage import cut
from .information import BLOCK
from .retrieval import dense

THRESHOLD, SHORT, GROUP = 0.15, 20, 5


def duplicates_of(probes: DataFrame, rows: DataFrame, threshold: float = 0.9, k: int = 5) -> DataFrame:
    """(query_id, id, similarity): of the k nearest rows of each probe those with a rounded similarity of the threshold or more."""
    near = dense(probes, rows, k).withColumn("similarity", F.round("score", 3))
    return near.where(F.col("similarity") >= threshold).select("query_id", "id", "similarity")


def prune_suggestions(novelty: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Rows that say little new, least first."""
    return novelty.where(F.col("novelty") < threshold).orderBy("novelty", "id")


def _near_earlier(ask: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """(source_file, id) of the rows of ask that lie nearer than the threshold to a row of held before them; every pair of blocks is one cell."""
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asks = ask.withColumn("other", every).select("source_file", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("asks"), "id", "size", "vector")
    olds = held.withColumn("other", every).select("source_file", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"), "id", "size", "vector")

    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        new, old = frame[frame.asks], frame[~frame.asks]
        if not len(new) or not len(old):
            return new[["source_file", "id"]].head(0)
        near = 1 - np.stack(new.vector.to_list()) @ np.stack(old.vector.to_list()).T < threshold
        size, ident = (new[c].to_numpy()[:, None] for c in ("size", "id"))
        near &= (old["size"].to_numpy() > size) | ((old["size"].to_numpy() == size) & (old["id"].to_numpy() < ident))
        return new[["source_file", "id"]][near.any(axis=1)]

    return asks.unionByName(olds).groupBy("source_file", "i", "j").applyInPandas(cell, "source_file string, id long").distinct()


def greedy(rows: DataFrame, threshold: float = THRESHOLD, least: int = GROUP, block: int = BLOCK) -> DataFrame:
    """(id, source_file, kept) of sources with at least `least` rows (id, source_file, size, vector).

    Longest first; short texts go, and so does a row one of whose nearest 5 kept rows lies nearer than the threshold.  A
    source of at most `block` rows is passed over in one task.  A larger one is dealt into blocks, and decided in rounds with
    the same result: a row without an undecided near row before it stays, and what lies near to it goes.
    """
    sizes = rows.groupBy("source_file").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    placed = rows.select("id", "source_file", "size", "vector").join(sizes, "source_file").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(["size", "id"], ascending=[False, True])
        kept, n = np.zeros((len(f), len(f.vector.iloc[0]))), 0
        out = []
        for size, vector in zip(f["size"], f.vector, strict=True):
            v = np.asarray(vector, float)
            keep = size >= SHORT and not (n and (1 - kept[:n] @ v).min() < threshold)
            out.append(keep)
            if keep:
                kept[n], n = v, n + 1
        return f[["id", "source_file"]].assign(kept=out)

    small = placed.where("blocks = 1").select("id", "source_file", "size", "vector").groupBy("source_file").applyInPandas(one, "id long, source_file string, kept boolean")
    large = cut(placed.where("blocks > 1").drop("n"), "greedy")
    left, kept, key = large.where(F.col("size") >= SHORT), None, ["source_file", "id"]
    while not left.isEmpty():
        stays = cut(left.join(_near_earlier(left, left, threshold), key, "left_anti"), "stays")
        kept = stays.select(key) if kept is None else kept.union(stays.select(key))
        left = cut(left.join(stays, key, "left_anti").join(_near_earlier(left, stays, threshold), key, "left_anti"), "undecided")
    if kept is None:
        return small.union(large.select("id", "source_file", F.lit(False)))
    return small.union(large.join(kept.withColumn("kept", F.lit(True)), key, "left").select("id", "source_file", F.coalesce("kept", F.lit(False))))
