"""Joins over captured history: scopes with their chunks, members of occurrences, attempts against occurrences and gaps.

All are equality joins on keys that are unique on one side at least, so Spark's runtime plan broadcasts a small side by its
measured size and splits a skewed key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def scoped_chunks(scopes: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks of each scope (chunk_id, source_key, workspace) with the current generation of their source; scopes whose chunk or source is gone drop out."""
    return scopes.join(chunks, "chunk_id").join(sources.select("source_key", "generation"), "source_key")


def members(occurrences: DataFrame) -> DataFrame:
    """(identity, chunk_id) of occurrences whose ids are a JSON array of texts; null, empty and broken arrays have none."""
    ids = F.from_json("ids", "array<string>")
    return occurrences.select("identity", F.explode(ids).alias("chunk_id")).where("chunk_id is not null")


def bridged(occurrences: DataFrame, links: DataFrame) -> DataFrame:
    """(identity, chunk_id) of occurrences by the bridge table of links (identity, chunk_id)."""
    return links.select("identity", "chunk_id").join(occurrences.select("identity"), "identity", "left_semi")


def candidates(chunks: DataFrame, *branches: DataFrame) -> DataFrame:
    """Chunks named by any branch, once each; branches have a chunk_id."""
    ids = branches[0].select("chunk_id")
    for branch in branches[1:]:
        ids = ids.union(branch.select("chunk_id"))
    return chunks.join(ids, "chunk_id", "left_semi")


def reconciled(left: DataFrame, *others: DataFrame, after: str | None = None, most: int | None = None) -> DataFrame:
    """left with what the others have for its cursor_key, null where they have nothing; a keyset page if `most` is given.

    With attempts on the left it shows attempts without an occurrence or a gap, with gaps on the left gaps without an attempt.
    """
    page = left if after is None else left.where(F.col("cursor_key") > after)
    for other in others:
        page = page.join(other, "cursor_key", "left")
    return page if most is None else page.orderBy("cursor_key").limit(most)
