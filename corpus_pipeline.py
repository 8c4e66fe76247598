"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark passages, token ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verbatica.llm import bpe, decontamination, minhash_dedup, quality, suffix_dedup
from verbatica.llm.shared import cut
from verbatica.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality.stage),
    ("MinHash near-dedup", minhash_dedup.stage),
    ("suffix-array dedup", suffix_dedup.stage),
    ("benchmark decontamination", decontamination.stage),
    ("BPE encoding and decoding", bpe.stage),
]

#: SQL can express neither the classifier nor the suffix arrays; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn on what its predecessor kept, each written and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
