"""Counts over the wing and room taxonomy, listings and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .distributions import QUARTERS, exact_quantiles
from .filters import scope


def _named(column: str) -> Column:
    return F.when(F.coalesce(F.col(column), F.lit("")) == "", "unknown").otherwise(F.col(column))


def counts(drawers: DataFrame) -> DataFrame:
    """(level, wing, room, n): total, by wing, by room, and by both, in one pass over the data."""
    named = drawers.select(_named("wing").alias("wing"), _named("room").alias("room"))
    level = F.grouping_id("wing", "room")
    return (named.cube("wing", "room").agg(F.count("*").alias("n"), level.alias("g"))
            .select(F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "wing").when(F.col("g") == 2, "room").otherwise("wing_room").alias("level"), "wing", "room", "n"))


def wings(drawers: DataFrame) -> DataFrame:
    return drawers.groupBy(_named("wing").alias("wing")).agg(F.count("*").alias("n"))


def rooms(drawers: DataFrame, wing: str | None = None) -> DataFrame:
    return drawers.where(scope(wing)).groupBy(_named("room").alias("room")).agg(F.count("*").alias("n"))


def taxonomy(drawers: DataFrame) -> DataFrame:
    """(wing, rooms): for each wing the map from room to number of drawers, in the rooms' order."""
    by_room = drawers.groupBy(_named("wing").alias("wing"), _named("room").alias("room")).agg(F.count("*").alias("n"))
    return by_room.groupBy("wing").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("room", "n")))).alias("rooms"))


def listing(drawers: DataFrame, wing: str | None = None, room: str | None = None, after: str = "", size: int = 20, preview: int = 200) -> DataFrame:
    """A page of previews by id, after the given one: a keyset page, whose cost does not grow with its place."""
    if not 1 <= size <= 100:
        raise ValueError("a page holds 1 to 100 rows")
    kept = drawers.where(scope(wing, room) & (F.col("id") > after))
    return kept.select("id", "wing", "room", F.substring("text", 1, preview).alias("preview")).orderBy("id").limit(size)


def text_sizes(drawers: DataFrame) -> DataFrame:
    """Per wing: drawers, rooms, and the distribution of text lengths."""
    n = F.char_length("text")
    counts = drawers.groupBy("wing").agg(F.count("*").alias("n"), F.countDistinct("room").alias("n_rooms"), F.sum(n).alias("chars"))
    shares = exact_quantiles(drawers.select("wing", n.alias("size")), "size", ["wing"])
    return counts.join(shares.select("wing", *[F.round(c, 6).alias(c) for c in QUARTERS]), "wing")


def source_groups(drawers: DataFrame, least: int = 5, pattern: str | None = None) -> DataFrame:
    """Source files with at least so many drawers, and the longest text of each."""
    kept = drawers.where(F.col("source_file").contains(pattern)) if pattern else drawers
    return (kept.groupBy("source_file").agg(F.count("*").alias("n"), F.max(F.char_length("text")).cast("long").alias("longest")).where(F.col("n") >= least))


def wake_up(drawers: DataFrame, most: int = 15, budget: int = 3200, snippet: int = 200) -> DataFrame:
    """The most important drawers (then the latest, then by id), grouped by room, as far as their snippets fit the budget."""
    top = drawers.select("id", "room", F.coalesce("importance", F.lit(3)).alias("importance"), "filed_at", F.substring("text", 1, snippet).alias("snippet")).orderBy(
        F.desc("importance"), F.desc("filed_at"), "id").limit(most)
    order = Window.orderBy(F.desc("importance"), F.desc("filed_at"), "id")  # at most `most` rows
    used = F.sum(F.char_length("snippet")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("used", used).where(F.col("used") <= budget)


def neighbours(drawers: DataFrame, matches: DataFrame, radius: int = 1) -> DataFrame:
    """For each match (id, source_file, chunk_index): the texts of its file from `radius` before to `radius` after, joined in order."""
    around = matches.select("id", "source_file", F.explode(F.sequence(F.col("chunk_index") - radius, F.col("chunk_index") + radius)).alias("chunk_index"))
    found = around.join(drawers.select("source_file", "chunk_index", "text"), ["source_file", "chunk_index"])
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return found.groupBy("id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("context"), F.count("*").alias("n_chunks"))


def latest(drawers: DataFrame, per: str, n: int = 10) -> DataFrame:
    """The n latest drawers of each group, newest first."""
    order = Window.partitionBy(per).orderBy(F.desc("filed_at"), "id")
    return drawers.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select(per, "place", "id", "filed_at")
