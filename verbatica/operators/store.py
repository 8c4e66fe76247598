"""Writes as new tables: add, upsert, update, delete, and idempotent receipts.

A table is a folder of snapshots; a write makes the next one and then points to it, so readers see whole snapshots only
and a failed write leaves nothing behind that is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


class Table:
    """Snapshots of a DataFrame under one path, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def snapshots(self) -> list[str]:
        """Names of the committed snapshots, oldest first."""
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(folder):
            return []
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.startswith("v"))

    def read(self, snapshot: str | None = None) -> DataFrame:
        names = self.snapshots()
        if not names:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/{snapshot or names[-1]}")

    def write(self, df: DataFrame) -> str:
        """df as the next snapshot: written aside first, then renamed, which fails if another writer was faster."""
        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        names = self.snapshots()
        name = f"v{int(names[-1][1:]) + 1 if names else 0:012d}"
        aside = path(f"{self.path}/_{uuid.uuid4().hex}")
        df.write.parquet(aside.toString())
        if fs.exists(path(f"{self.path}/{name}")) or not fs.rename(aside, path(f"{self.path}/{name}")):
            fs.delete(aside, True)
            raise RuntimeError(f"another writer made {name}")
        return name

    def compact(self, files: int) -> str:
        """The rows of the newest snapshot in so many files."""
        return self.write(self.read().repartition(files))

    def forget(self, keep: int = 1) -> None:
        """Only the newest snapshots stay."""
        jvm, fs = self._fs()
        for name in self.snapshots()[:-keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)


def upsert(held: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """held with rows put in: by key a new row replaces the old one whole; the last of equal new keys wins by its other columns' order."""
    order = Window.partitionBy(key).orderBy(*[F.desc(c) for c in rows.columns if c != key])
    new = rows.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place") if len(rows.columns) > 1 else rows.distinct()
    return held.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def update(held: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """held with the columns that changes has set anew where they aren't null; rows without a change, and columns without one, stay."""
    fields = [c for c in changes.columns if c != key]
    joined = held.join(changes.select(key, *[F.col(c).alias(f"__{c}") for c in fields]), key, "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in held.columns])


def delete(held: DataFrame, ids: DataFrame | None = None, where: Column | None = None, key: str = "id") -> DataFrame:
    """held without those ids and without rows that the condition holds for; one of the two must be given."""
    if ids is None and where is None:
        raise ValueError("nothing says what to delete")
    if where is not None:
        held = held.where(~F.coalesce(where, F.lit(False)))
    return held if ids is None else held.join(ids.select(key).distinct(), key, "left_anti")


def receipts(held: DataFrame, requests: DataFrame) -> DataFrame:
    """(namespace, request_id, digest, status): stored for a new request, replayed for one with the same digest, else conflict.

    Of new requests with one id the smallest digest counts first.
    """
    first = requests.groupBy("namespace", "request_id").agg(F.min("digest").alias("first"))
    known = held.select("namespace", "request_id", F.col("digest").alias("old"))
    return (requests.join(first, ["namespace", "request_id"]).join(known, ["namespace", "request_id"], "left")
            .select("namespace", "request_id", "digest", F.when(F.coalesce("old", "first") != F.col("digest"), "conflict").when(F.col("old").isNull(), "stored").otherwise("replayed").alias("status")))


def encoded(rows: DataFrame, dim: int) -> DataFrame:
    """Nulls as the store keeps them: empty text, chunk index -1, decay 1.0, a vector of zeros."""
    blank = {"text": F.lit(""), "wing": F.lit(""), "room": F.lit(""), "source_file": F.lit(""), "chunk_index": F.lit(-1).cast("long"), "decay_score": F.lit(1.0),
             "vector": F.array_repeat(F.lit(0.0), dim)}
    return rows.select(*[F.coalesce(F.col(c), blank[c]).alias(c) if c in blank else F.col(c) for c in rows.columns])


def packed_lines(lines: DataFrame, most: int = 1500) -> DataFrame:
    """(source_file, part, document): index lines (source_file, ordinal, line) packed into documents of at most `most` characters, no line split.

    Each line's running length decides its part without a loop: a line begins a new document if it would not fit, which is
    a fold over the lines of one file, in their order.
    """
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "line")))
    zero = F.array().cast("array<string>")
    start = F.struct(zero.alias("done"), F.lit(None).cast("string").alias("open"))

    def put(s: Column, x: Column) -> Column:
        fits = F.char_length(s["open"]) + 1 + F.char_length(x["line"]) <= most
        return (F.when(s["open"].isNull(), F.struct(s["done"].alias("done"), x["line"].alias("open")))
                .when(fits, F.struct(s["done"].alias("done"), F.concat(s["open"], F.lit("\n"), x["line"]).alias("open")))
                .otherwise(F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), x["line"].alias("open"))))

    packed = F.aggregate("rows", start, put, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return lines.groupBy("source_file").agg(rows.alias("rows")).select("source_file", F.posexplode(packed).alias("part", "document"))
