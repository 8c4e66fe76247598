"""Placement by a permutation-filled lookup table, with DataFrame functions only.

Every shard has its own order of the slots of a table of prime size: it starts at an offset and steps by a skip, both
hashed from its name.  The shards take turns; each claims the next free slot in its order until no slot is free.  So all
shards hold the same number of slots, give or take one, and adding or removing a shard moves few slots.

The table has ``TABLE`` rows whatever the data, so broadcasting it is bounded.  A row's slot is a hash of its key modulo
the table size; one hash lookup gives its shard.  Nothing is shuffled.

A null key hashes as the empty text, so it has a place; equal keys and repeated rows share a place.  An empty table stays empty;
no shards at all is an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import table, unused

#: Slots; a prime well over 100 times the number of shards.
TABLE = 65_537
SHARDS = 64


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = TABLE) -> list[int]:
    """The number of the shard that holds each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, each by its own name")
    if size < len(shards) or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime, and no smaller than the number of shards")
    # in the order of the names, so that the table doesn't depend on the order of the list
    turns = sorted(range(len(shards)), key=lambda s: shards[s])
    at = {s: _hash(shards[s], "offset") % size for s in turns}
    skip = {s: _hash(shards[s], "skip") % (size - 1) + 1 if size > 2 else 1 for s in turns}
    held = [-1] * size
    free = size
    while free:
        for s in turns:
            slot = at[s]
            while held[slot] >= 0:
                slot = (slot + skip[s]) % size
            held[slot] = s
            at[s] = (slot + skip[s]) % size
            free -= 1
            if not free:
                break
    return held


def slot_of(key: Column, size: int = TABLE) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE) -> DataFrame:
    """df with slot and shard (its name); columns of df that have these names are replaced, the key's too once it is used."""
    held = lookup_table(shards, size)
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    own, shard = unused(df, "slot_"), unused(df, "shard_")
    slots = (df.sparkSession.range(1)
             .select(F.posexplode(F.split(F.lit(",".join(map(str, held))), ",")).alias(own, "at"))
             .select(own, F.element_at(names, F.col("at").cast("int") + 1).alias(shard)))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    placed = df.withColumn(own, slot_of(F.col(f"`{key}`"), size)).join(F.broadcast(slots), own, "left")
    return placed.select(*kept, F.col(own).alias("slot"), F.col(shard).alias("shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = [f"shard-{i:04d}" for i in range(SHARDS)]
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", shards).select("doc_id", "slot", "shard")


QUERIES = {"op7_shard_lookup": (query, None)}
