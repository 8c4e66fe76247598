"""Tables, folds, lineage cuts and connected components for the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.lineage import cut


def discard(df: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def row_sig(text: str) -> Column:
    """What tells rows of one doc_id apart: a hash of the text."""
    return F.xxhash64(text)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(key: Column) -> Column:
    """crc32 of the key as text, modulo 4; remainder 2 is held out."""
    return F.crc32(key.cast("string").cast("binary")) % 4


#: Places of a bitmap of keys: 8 MB, whatever the data.
BITS = 1 << 26


def place(*key: Column | str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BITS))


def bitmap(places: DataFrame) -> np.ndarray:
    """Which places the one column of places names; BITS / 8 rows at most reach the driver."""
    at = places.toDF("at").select((F.col("at") / 8).cast("int").alias("byte"), F.pow(F.lit(2), F.col("at") % 8).cast("int").alias("bit"))
    bits = np.zeros(BITS // 8, np.uint8)
    for part in at.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow().to_batches():
        bits[np.asarray(part.column(0))] = np.asarray(part.column(1))
    return bits


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def among(places: DataFrame) -> Callable[[Column], Column]:
    """A test whether a place is among places; only the place of a row goes to Python, its texts stay."""
    held = places.sparkSession.sparkContext.broadcast(bitmap(places))

    @F.pandas_udf("boolean")
    def has(at: pd.Series) -> pd.Series:
        return pd.Series(is_set(held.value, at.to_numpy()))

    return has


#: Most rows of a table that is broadcast.
SMALL = 500_000


def partners(docs: DataFrame, few: DataFrame, on: Column, at: Column, places: Column) -> tuple[DataFrame, DataFrame]:
    """(docs joined with few, docs without a partner in few); few is written out, so it can be counted.

    Up to SMALL rows of few are broadcast.  Beyond, a bitmap of their places tells the documents that may have a partner, and the
    texts of these alone move.
    """
    if few.count() <= SMALL:
        return docs.join(F.broadcast(few), on), docs.join(F.broadcast(few), on, "left_anti")
    has = among(few.select(places))
    named = docs.where(has(at))
    return named.join(few, on), docs.where(~has(at)).unionByName(named.join(few, on, "left_anti"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for every node that has a link; nodes are of any ordered type.

    Alternating large-star and small-star steps, each written out once.  Every step groups by node with a partial
    minimum and joins one row per node back, so a node with very many links is a plain skewed join that can be split.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)"))).first())

    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = cut(small, "links")
        before, seen = seen, mark(after)
        discard(edges)
        edges = after
        if seen == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
