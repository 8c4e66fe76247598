"""Do two stores hold the same rows?  A tree of digests over ranges of hashed keys is compared from the top; only ranges that differ are read.

An inventory holds a row (key, digest) for each row of a store, in ``FOLDERS`` folders by the first bits of the key's hash, sorted by hash, and the tree above
them: counts and digests of every node, ``STEP`` bits a level.  Digests of a node add up (modulo nothing: sums of 64-bit hashes), so they depend neither on order nor on partitions,
and repeated rows count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.lineage import cut

#: Bits of the hash that name a leaf, bits that each level adds, and those that name a folder.
BITS, STEP, FOLDER_BITS = 20, 4, 6
NODE = "level int, node int, n long, digest decimal(38,0)"
ROW = "leaf int, key string, digest long, folder int"


def row_digest(columns: list[str]) -> Column:
    """A hash of a row's columns; null and empty differ."""
    return F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


class Inventory:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, df: DataFrame, key: str, columns: list[str]) -> None:
        """Takes the inventory of a store; columns are those that count."""
        leaf = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string")), 64 - BITS).cast("int")
        rows = df.select(leaf.alias("leaf"), F.col(key).cast("string").alias("key"), row_digest(columns).alias("digest")).withColumn("folder", F.shiftright("leaf", BITS - FOLDER_BITS))
        rows.repartition("folder").sortWithinPartitions("folder", "leaf").write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/rows")
        leaves = self.rows().groupBy(F.lit(BITS).alias("level"), F.col("leaf").alias("node")).agg(F.count("*").alias("n"), F.sum(F.col("digest").cast("decimal(38,0)")).alias("digest"))
        leaves.write.mode("overwrite").parquet(f"{self.path}/level={BITS}")
        for level in range(BITS - STEP, -1, -STEP):  # each level from the one below, a sixteenth of its rows
            below = self.level(level + STEP)
            below.groupBy(F.lit(level).alias("level"), F.shiftright("node", STEP).alias("node")).agg(F.sum("n").alias("n"), F.sum("digest").cast("decimal(38,0)").alias("digest")).coalesce(1 if level <= 8 else 8).write.mode("overwrite").parquet(f"{self.path}/level={level}")

    def rows(self, folders: list[int] | None = None) -> DataFrame:
        held = self.spark.read.schema(ROW).parquet(f"{self.path}/rows")
        return held if folders is None else held.where(F.col("folder").isin(folders))

    def level(self, level: int) -> DataFrame:
        return self.spark.read.schema(NODE).parquet(f"{self.path}/level={level}")


def _unlike(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Nodes that are not the same on both sides."""
    other = theirs.select("node", F.col("n").alias("m"), F.col("digest").alias("other"))
    return ours.select("node", "n", "digest").join(other, "node", "full").where(~(F.col("n").eqNullSafe(F.col("m")) & F.col("digest").eqNullSafe(F.col("other")))).select("node")


def unlike_leaves(ours: Inventory, theirs: Inventory) -> DataFrame:
    """(node): leaves that differ, from the top down; each level looks at the children of differing nodes only, and stops where none differ."""
    found = cut(_unlike(ours.level(0), theirs.level(0)), "unlike")  # each level is written, since the next one asks for it twice
    for level in range(STEP, BITS + 1, STEP):
        if found.isEmpty():
            break
        # children of what differs: a node names its parent by its own first bits
        under = lambda inv: inv.level(level).join(found.withColumnRenamed("node", "parent"), F.shiftright("node", STEP) == F.col("parent"), "left_semi")  # noqa: B023, E731
        found = cut(_unlike(under(ours), under(theirs)), "unlike")
    return found


def differences(ours: Inventory, theirs: Inventory) -> DataFrame:
    """(key, status, n_ours, n_theirs): keys whose rows are missing on one side (missing_ours, missing_theirs) or are not the same ones (changed).

    Folders of differing leaves are read, 64 at most are named by the driver; rows of other leaves in them are skipped by their range in the sorted files.
    """
    leaves = unlike_leaves(ours, theirs)
    folders = [r[0] for r in leaves.select(F.shiftright("node", BITS - FOLDER_BITS).alias("folder")).distinct().collect()]  # 64 at most
    side = lambda inv, name: (inv.rows(folders).join(leaves.withColumnRenamed("node", "leaf"), "leaf", "left_semi").groupBy("key")
                              .agg(F.count("*").alias(f"n_{name}"), F.sum(F.col("digest").cast("decimal(38,0)")).alias(name)))
    other = side(theirs, "theirs").withColumnRenamed("key", "__key")
    met = side(ours, "ours").join(other, F.col("key").eqNullSafe(F.col("__key")), "full" if folders else "inner").withColumn("key", F.coalesce("key", "__key"))
    status = F.when(F.col("n_ours").isNull(), "missing_ours").when(F.col("n_theirs").isNull(), "missing_theirs").when((F.col("ours") != F.col("theirs")) | (F.col("n_ours") != F.col("n_theirs")), "changed")
    return met.withColumn("status", status).where("status is not null").select("key", "status", F.coalesce("n_ours", F.lit(0)).alias("n_ours"), F.coalesce("n_theirs", F.lit(0)).alias("n_theirs"))


def audit(attempts: DataFrame, occurrences: DataFrame, gaps: DataFrame) -> DataFrame:
    """(key, outcome, fault) of receipts that do not fit together: each attempt (key, outcome) must have left exactly what it says, and nothing else may be there.

    An attempt that `indexed` left one occurrence and no gap, one that ended in a `gap` the reverse.  Faults: missing, doubled, contradicted, unexpected.
    """
    count = lambda df, name: df.groupBy("key").agg(F.count("*").alias(name))
    tried = attempts.groupBy("key").agg(F.count("*").alias("n"), F.min("outcome").alias("outcome"))
    met = tried.join(count(occurrences, "held"), "key", "full").join(count(gaps, "lost"), "key", "full").fillna(0, ["n", "held", "lost"])
    wanted, other = F.when(F.col("outcome") == "indexed", F.col("held")).otherwise(F.col("lost")), F.when(F.col("outcome") == "indexed", F.col("lost")).otherwise(F.col("held"))
    fault = (F.when(F.col("n") == 0, "unexpected").when((F.col("n") > 1) | (wanted > 1) | (other > 1), "doubled").when(other > 0, "contradicted").when(wanted == 0, "missing"))
    return met.withColumn("fault", fault).where("fault is not null").select("key", "outcome", "fault")
