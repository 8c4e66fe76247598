"""Incremental capture with Structured Streaming: messages, coverage, sessions, and triggers by count.

Offsets, restarts and exactly-once state are the stream's checkpoint; files that arrive are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import session_messages

SAVE_EVERY = 15


def json_lines(spark: SparkSession, folder: str, files_a_batch: int = 64) -> DataFrame:
    """(value, path): lines of the files in a folder, as they come; a bounded number of files a micro-batch."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_a_batch).load(folder).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("line"))


def captured(lines: DataFrame, late: str = "1 day") -> DataFrame:
    """Messages of the lines, each once: copies of a (session, uuid) within the watermark are dropped by the state store."""
    messages = session_messages(lines).withColumn("event_time", F.to_timestamp("ts"))
    return messages.where("event_time is not null").withWatermark("event_time", late).dropDuplicatesWithinWatermark(["session_id", "uuid"])


def sweep(held: DataFrame, new: DataFrame) -> DataFrame:
    """held and what new brings: messages before a session's high-water mark are skipped, equal times are put again by their id."""
    mark = held.groupBy("session_id").agg(F.max("ts").alias("mark"))
    fresh = new.join(mark, "session_id", "left").where("mark is null or ts >= mark").drop("mark")
    return held.join(fresh.select("session_id", "uuid"), ["session_id", "uuid"], "left_anti").unionByName(fresh.dropDuplicates(["session_id", "uuid"]))


def coverage(lines: DataFrame) -> DataFrame:
    """One row: lines, captured messages, other records, broken lines and the status that follows."""
    ok = F.try_parse_json("value").isNotNull()
    get = lambda path: F.get_json_object("value", path)
    message = ok & get("$.type").isin("user", "assistant") & get("$.uuid").isNotNull()
    out = lines.agg(F.count("*").alias("n_lines"), F.sum(message.cast("long")).alias("n_messages"), F.sum((ok & ~F.coalesce(message, F.lit(False))).cast("long")).alias("n_other"), F.sum((~ok).cast("long")).alias("n_broken"))
    return out.withColumn("status", F.when(F.col("n_broken") > 0, "gaps").when(F.col("n_lines") == 0, "pending").otherwise("complete"))


def saves(messages: DataFrame, every: int = SAVE_EVERY) -> DataFrame:
    """(session_id, n_user, saves): a running count of user messages by session in the stream's state; a save is due at each multiple."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        now = before + sum(int((f.role == "user").sum()) for f in frames)
        state.update((now,))
        yield pd.DataFrame({"session_id": [key[0]], "n_user": [now], "saves": [now // every - before // every]})

    return messages.groupBy("session_id").applyInPandasWithState(step, "session_id string, n_user long, saves long", "n_user long", "update", GroupStateTimeout.NoTimeout)


def activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by type in tumbling windows of event time (ts, event_type, value)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events not further apart than the gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def revised(states: DataFrame, requests: DataFrame) -> DataFrame:
    """Optimistic updates (workspace, request_id, expected_revision, status): each applies if it expects the revision that is held.

    Of the requests of one workspace that expect it, the smallest request_id wins; the others are conflicts.
    """
    held = requests.join(states.select("workspace", F.col("revision").alias("held")), "workspace", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    first = held.where("expected_revision = held").groupBy("workspace").agg(F.min("request_id").alias("first"))
    won = F.coalesce((F.col("expected_revision") == F.col("held")) & (F.col("request_id") == F.col("first")), F.lit(False))
    return held.join(first, "workspace", "left").select("workspace", "request_id", F.when(won, F.col("held") + 1).otherwise(F.col("held")).alias("revision"), F.when(won, "applied").otherwise("conflict").alias("outcome"))
