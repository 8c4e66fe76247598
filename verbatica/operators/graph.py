"""The graph of rooms: rooms are nodes, wings and halls make the edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lineage import cut

#: Fixed value: a room of this name is no node.
GENERAL = "general"


def nodes(drawers: DataFrame, dates: int = 5) -> DataFrame:
    """(room, wings, halls, n, dates): sets in order, and the last few dates. Rooms without a name or a wing are left out."""
    kept = drawers.where((F.col("room") != "") & (F.col("room") != GENERAL) & (F.col("wing") != ""))
    day = F.substring("filed_at", 1, 10)
    every = F.sort_array(F.collect_set(day))
    return kept.groupBy("room").agg(
        F.sort_array(F.collect_set("wing")).alias("wings"), F.sort_array(F.collect_set(F.when(F.col("hall") != "", F.col("hall")))).alias("halls"),
        F.count("*").alias("n"), F.slice(every, F.greatest(F.size(every) - dates + 1, F.lit(1)), dates).alias("dates"))


def edges(graph: DataFrame) -> DataFrame:
    """(room, wing_a, wing_b, hall, n): every pair of a room's wings, for every hall; without a hall there is no edge."""
    first = graph.select("room", "n", "wings", "halls", F.posexplode("wings").alias("at", "wing_a"))
    pair = first.select("room", "n", "halls", "wing_a", F.explode(F.slice("wings", F.col("at") + 2, F.size("wings"))).alias("wing_b"))
    return pair.select("room", "wing_a", "wing_b", F.explode("halls").alias("hall"), "n")


def tunnels(graph: DataFrame, wing_a: str | None = None, wing_b: str | None = None, most: int = 50) -> DataFrame:
    """Rooms in at least two wings (and in the given ones), largest first."""
    kept = graph.where(F.size("wings") >= 2)
    for wing in (wing_a, wing_b):
        if wing:
            kept = kept.where(F.array_contains("wings", wing))
    return kept.select("room", "wings", "n", F.get("dates", F.size("dates") - 1).alias("last_date")).orderBy(F.desc("n"), "room").limit(most)


def statistics(graph: DataFrame) -> DataFrame:
    """Rooms, tunnel rooms and edges of each wing."""
    return (graph.select("room", "n", F.size("wings").alias("width"), F.size("halls").alias("n_halls"), F.explode("wings").alias("wing"))
            .groupBy("wing").agg(F.count("*").alias("n_rooms"), F.sum((F.col("width") >= 2).cast("long")).alias("n_tunnel_rooms"),
                                 F.sum((F.col("width") - 1) * F.col("n_halls")).cast("long").alias("n_edges")))


def traverse(graph: DataFrame, start: str, hops: int = 2, most: int = 50) -> DataFrame:
    """Rooms within so many steps of the start over shared wings, each at its first step; nearest and largest first."""
    place = graph.select("room", "n", F.explode("wings").alias("wing"))
    seen = graph.where(F.col("room") == start).select("room", F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        at = place.join(seen.where(F.col("hop") == hop - 1).select("room"), "room", "left_semi").select("wing").distinct()
        fresh = place.join(at, "wing", "left_semi").select("room").distinct().join(seen.select("room"), "room", "left_anti")
        seen = seen.union(fresh.select("room", F.lit(hop).alias("hop")))
    return seen.join(graph.select("room", "n"), "room").select("room", "hop", "n").orderBy("hop", F.desc("n"), "room").limit(most)


def tunnel_id(wing_a: Column, room_a: Column, wing_b: Column, room_b: Column) -> Column:
    """The same for both directions."""
    a, b = F.concat_ws("/", wing_a, room_a), F.concat_ws("/", wing_b, room_b)
    return F.substring(F.sha2(F.concat_ws("<->", F.least(a, b), F.greatest(a, b)), 256), 1, 16)


def topic_tunnels(topics: DataFrame, least: int = 1) -> DataFrame:
    """(wing_a, wing_b, topic, id) of wings that share at least so many topics (wing, topic), compared in lower case."""
    mine = topics.select("wing", F.lower(F.trim("topic")).alias("topic")).where("topic <> ''").distinct()
    other = mine.select(F.col("wing").alias("wing_b"), "topic")
    shared = mine.withColumnRenamed("wing", "wing_a").join(other, "topic").where("wing_a < wing_b")
    enough = shared.groupBy("wing_a", "wing_b").agg(F.count("*").alias("n")).where(F.col("n") >= max(1, least))
    return shared.join(enough.drop("n"), ["wing_a", "wing_b"]).select(
        "wing_a", "wing_b", "topic", tunnel_id(F.col("wing_a"), F.col("topic"), F.col("wing_b"), F.col("topic")).alias("id"))


def fuzzy_rooms(graph: DataFrame, query: str, most: int = 5) -> DataFrame:
    """Rooms that hold the query (1.0) or one of its words (0.5)."""
    q = query.lower()
    room = F.lower("room")
    words = [w for w in q.replace("-", " ").replace("_", " ").split() if w]
    part = F.lit(False)
    for w in words:
        part = part | room.contains(w)
    return graph.select("room", F.when(room.contains(q), 1.0).when(part, 0.5).alias("score")).where("score is not null").orderBy(F.desc("score"), "room").limit(most)


def with_tunnel(known: DataFrame, wing_a: str, room_a: str, wing_b: str, room_b: str, label: str = "", kind: str = "explicit") -> DataFrame:
    """known (id, wing_a, room_a, wing_b, room_b, label, kind) with the tunnel put in, or its label and kind set anew."""
    spark = known.sparkSession
    new = spark.range(1).select(
        tunnel_id(*[F.lit(x) for x in (wing_a, room_a, wing_b, room_b)]).alias("id"),
        *[F.lit(v).alias(k) for k, v in (("wing_a", wing_a), ("room_a", room_a), ("wing_b", wing_b), ("room_b", room_b), ("label", label), ("kind", kind))])
    return known.join(new.select("id"), "id", "left_anti").unionByName(new)


def tunnels_of(known: DataFrame, wing: str | None = None) -> DataFrame:
    return known.where((F.col("wing_a") == wing) | (F.col("wing_b") == wing)) if wing else known


def without_tunnel(known: DataFrame, ident: str) -> DataFrame:
    return known.where(F.col("id") != ident)


def followed(known: DataFrame, drawers: DataFrame, wing: str, room: str, preview: int = 300) -> DataFrame:
    """Where the tunnels of a wing's room lead, in both directions, with previews of the drawers there."""
    out = known.where((F.col("wing_a") == wing) & (F.col("room_a") == room)).select("id", F.col("wing_b").alias("wing"), F.col("room_b").alias("room"), "label")
    back = known.where((F.col("wing_b") == wing) & (F.col("room_b") == room)).select("id", F.col("wing_a").alias("wing"), F.col("room_a").alias("room"), "label")
    ends = out.union(back).withColumnRenamed("id", "tunnel_id")
    return ends.join(drawers.select("wing", "room", F.col("id").alias("drawer_id"), F.substring("text", 1, preview).alias("preview")), ["wing", "room"], "left")


def connected(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the links (a, b) reaches.

    Each round takes the least label among neighbours and then the label of that label, so long chains shrink by halves; a
    round is a partial minimum and two equality joins, written to the shared folder, and the last one changes nothing.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "both")
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        after = cut(lower.join(jump, "low").select("node", F.least("low", "far").alias("label"), (F.least("low", "far") != F.col("label")).alias("moved")), "labels")
        labels = after.select("node", "label")
        if not after.where("moved").take(1):
            return labels.withColumnRenamed("label", "component")
