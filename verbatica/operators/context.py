"""What a returning session is given: evidence from several ranked streams in one budget of bytes, pinned evidence first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Pieces of evidence, and bytes of all of them together.
LIMIT, BUDGET = 8, 8192
#: Bytes that each piece takes besides its text.
FRAME = 96


def live(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(workspace, id, text, place) of recent messages (workspace, id, role, at, text): the newest of users first, in half of the places, then all by time.

    Users keep their half so that a burst of answers can't push out every wish; of answers half as many are looked at.  Each workspace keeps 2.5 x limit rows at most.
    """
    newest = Window.partitionBy("workspace", "speaker").orderBy(F.desc("at"), F.desc("id"))
    spoken = rows.where(F.col("role").isin("user", "human", "assistant")).withColumn("speaker", F.col("role") == "assistant").withColumn("nth", F.row_number().over(newest))
    recent = spoken.where(F.col("nth") <= F.when(F.col("speaker"), max(1, limit // 2)).otherwise(limit))
    users = recent.where(~F.col("speaker") & (F.col("nth") <= max(1, limit // 2))).select("workspace", "id", "text", "at", F.lit(0).alias("turn"))
    order = Window.partitionBy("workspace").orderBy("turn", F.desc("at"), F.desc("id"))
    return users.unionByName(recent.select("workspace", "id", "text", "at", F.lit(1).alias("turn"))).select("workspace", "id", "text", F.row_number().over(order).alias("place"))


def restored(pins: DataFrame, *streams: DataFrame, limit: int = LIMIT, budget: int = BUDGET, frame: int = FRAME) -> DataFrame:
    """(workspace, rank, id, used, text) of what fits: pins (workspace, id, text, place) in their order, then the streams in turn (the first of each, the second of each, ...), each id once.

    The first piece that does not fit ends the packet of its workspace, so `used` never passes the budget.  A stream brings `limit` new ids at most, whatever its length: of longer ones the
    places beyond limit + pins are not looked at, since only ids that came before can be skipped.
    """
    n = len(streams)
    every = pins.select("workspace", "id", "text", F.lit(0).alias("turn"), F.col("place").cast("long").alias("at"))
    for i, stream in enumerate(streams):
        within = Window.partitionBy("workspace").orderBy("place", "id")
        placed = stream.select("workspace", "id", "text", (F.row_number().over(within) - 1).alias("nth"))
        every = every.unionByName(placed.select("workspace", "id", "text", F.lit(1).alias("turn"), (F.col("nth").cast("long") * n + i).alias("at")))
    first = Window.partitionBy("workspace", "id").orderBy("turn", "at")
    once = every.withColumn("again", F.row_number().over(first)).where("again = 1")
    order = Window.partitionBy("workspace").orderBy("turn", "at", "id")
    top = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)  # limit rows a workspace from here on
    used = F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + frame).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("used", used).where(F.col("used") <= budget).select("workspace", "rank", "id", "used", "text")
