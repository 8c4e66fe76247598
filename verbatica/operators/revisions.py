"""Revisions of a source: which rows a newer complete revision has replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def plan(rows: DataFrame) -> DataFrame:
    """(source_file, revision, n, complete, filed_at, fate) with fate kept, superseded or untouched.

    rows has source_file, revision (null for rows from before revisions), complete and filed_at.  A revision is complete if any of
    its rows is marked so.  Of the complete ones the latest stays; incomplete ones filed after it are left alone, all others
    go.  A source without a complete revision keeps everything.
    """
    per = rows.where("source_file <> ''").groupBy("source_file", "revision").agg(
        F.count("*").alias("n"), F.max(F.coalesce("complete", F.lit(False)).cast("int")).cast("boolean").alias("complete"), F.max(F.coalesce("filed_at", F.lit(""))).alias("filed_at"))
    done = F.col("complete") & F.col("revision").isNotNull()
    best = F.max(F.when(done, F.struct("filed_at", "revision"))).over(Window.partitionBy("source_file"))
    fate = (F.when(F.col("best").isNull(), "untouched").when(F.col("revision") == F.col("best.revision"), "kept")
            .when(F.col("revision").isNotNull() & ~F.col("complete") & (F.col("filed_at") > F.col("best.filed_at")), "untouched").otherwise("superseded"))
    return per.withColumn("best", best).select("source_file", "revision", "n", "complete", "filed_at", fate.alias("fate"))


def pruned(rows: DataFrame) -> DataFrame:
    """rows without what the plan calls superseded."""
    gone = plan(rows).where("fate = 'superseded'").select(F.col("source_file").alias("s"), F.col("revision").alias("r"))
    return rows.join(gone, (rows.source_file == gone.s) & rows.revision.eqNullSafe(gone.r), "left_anti")


def is_current(rows: DataFrame, signatures: DataFrame) -> DataFrame:
    """Sources (source_file, mtime_ns, size) of which a complete revision with the same signature is filed."""
    done = rows.where("complete").select("source_file", "mtime_ns", "size").distinct()
    return signatures.join(done, ["source_file", "mtime_ns", "size"], "left_semi")
