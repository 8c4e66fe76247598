"""Retrieval quality: recall, NDCG and hits of rankings against evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .distributions import numbered


def at_k(ranked: DataFrame, evidence: DataFrame, k: int) -> DataFrame:
    """(query_id, recall_any, recall_all, recall, ndcg) of every query with evidence; the ideal order is that of the retrieved k."""
    good = evidence.select("query_id", "id", F.lit(1).alias("good")).distinct()
    need = good.groupBy("query_id").agg(F.count("*").alias("need"))
    top = ranked.where(F.col("rank") <= k).join(good, ["query_id", "id"], "left").select("query_id", "rank", F.coalesce("good", F.lit(0)).alias("good"))
    order = Window.partitionBy("query_id").orderBy(F.desc("good"), "rank")
    gains = top.withColumn("ideal", F.row_number().over(order)).groupBy("query_id").agg(
        F.sum("good").alias("found"), F.sum(F.col("good") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("good") / F.log2(F.col("ideal") + 1)).alias("best"))
    found = F.coalesce("found", F.lit(0))
    return need.join(gains, "query_id", "left").select(
        "query_id", (found > 0).cast("double").alias("recall_any"), (found >= F.col("need")).cast("double").alias("recall_all"), (found / F.col("need")).alias("recall"),
        F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias("ndcg"))


def hit_rate(per_query: DataFrame, by: str) -> DataFrame:
    return per_query.groupBy(by).agg(F.avg("recall_any").alias("hit_rate"), F.count("*").alias("n"))


def split(rows: DataFrame, key: str, held_out: float = 0.9, seed: int = 42) -> DataFrame:
    """rows with held_out, decided by a hash of the key: stable whatever the partitioning, and as rows are added."""
    return rows.withColumn("held_out", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(held_out * 10_000))


def session_scores(rows: DataFrame, value: str, by: str = "session_id") -> DataFrame:
    """The mean of each session; sessions of nulls only are left out."""
    return rows.groupBy(by).agg(F.avg(value).alias("score")).where("score is not null")


def dropped_sessions(scores: DataFrame, percent: float, by: str = "session_id") -> DataFrame:
    """So many percent of the sessions (rounded down), those of the lowest score; of equal scores the smaller session goes first."""
    n = scores.count()
    return numbered(scores.select(by, "score"), ["score", by]).where(F.col("place") <= int(n * percent / 100)).select(by)
