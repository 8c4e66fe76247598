"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset, a new temporary one in a local session, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read from there: a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parted(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key no other row has, and the others, if there are any; only keys move, and where some repeat, the rows that are joined with these."""
    twice = cut(df.groupBy(key).count().where("count > 1").select(F.col(key).alias("twice")), "repeated")
    if twice.isEmpty():
        return df, None
    same = F.equal_null(df[key], twice["twice"])
    return df.join(twice, same, "left_anti"), df.join(twice, same, "left_semi")
