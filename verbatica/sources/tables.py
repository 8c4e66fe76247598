"""Drawers, messages, triples and vectors as views of the given tables.

A drawer is a verbatim text under a wing (its language) and a room (its source), filed at a time, and cut from a source
file at a chunk index.  Nothing here reads data; each function returns a lazy projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drawers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, wing, room, hall, source_file, chunk_index, filed_at (ISO text), importance, text."""
    docs = table(spark, sf_dir, "documents")
    filed = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 3600)
    return docs.select(
        F.concat(F.lit("drawer_"), F.coalesce("lang", F.lit("")), F.lit("_"), F.coalesce("source", F.lit("")), F.lit("_"),
                 F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 24)).alias("id"),
        F.coalesce("lang", F.lit("")).alias("wing"), F.coalesce("source", F.lit("")).alias("room"),
        F.concat(F.lit("hall_"), (F.col("n_chars") % 4).cast("string")).alias("hall"),
        F.concat(F.lit("file_"), F.floor(F.col("doc_id") / 5).cast("string")).alias("source_file"),
        (F.col("doc_id") % 5).cast("long").alias("chunk_index"),
        F.date_format(filed, "yyyy-MM-dd'T'HH:mm:ss").alias("filed_at"),
        (F.col("n_chars") % 6).cast("int").alias("importance"),
        F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


#: The same view for the oracle.
DRAWERS_SQL = """
drawers as (select 'drawer_' || coalesce(lang, '') || '_' || coalesce(source, '') || '_' || substr(sha256(doc_id::varchar), 1, 24) as id,
  coalesce(lang, '') as wing, coalesce(source, '') as room, 'hall_' || (n_chars % 4)::varchar as hall,
  'file_' || (doc_id // 5)::varchar as source_file, (doc_id % 5)::bigint as chunk_index,
  strftime(timestamp '2024-01-01' + to_hours(doc_id), '%Y-%m-%dT%H:%M:%S') as filed_at, (n_chars % 6)::int as importance, doc_id, coalesce(text, '') as text
  from documents)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, ordinal, role, content of every conversation turn."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("ordinal"), "role", F.coalesce("text", F.lit("")).alias("content"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, predicate, object, valid_from, valid_to (ISO dates; null is open), confidence, drawer_id, extracted_at.

    A customer has ordered a part from the order date until its shipping date; what was returned stays open.
    """
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        F.concat(F.lit("customer_"), "o_custkey").alias("subject"),
        F.when(F.col("o_orderpriority").startswith("1"), "urgently_ordered").otherwise("ordered").alias("predicate"),
        F.concat(F.lit("part_"), "l_partkey").alias("object"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("valid_from"),
        F.when(F.col("l_returnflag") != "R", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("valid_to"),
        (1 - F.col("l_discount")).alias("confidence"),
        F.concat(F.lit("order_"), "o_orderkey").alias("drawer_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("extracted_at"))


TRIPLES_SQL = """
triples as (select 'customer_' || o_custkey as subject,
  case when o_orderpriority like '1%' then 'urgently_ordered' else 'ordered' end as predicate, 'part_' || l_partkey as object,
  strftime(o_orderdate, '%Y-%m-%d') as valid_from, case when l_returnflag <> 'R' then strftime(l_shipdate, '%Y-%m-%d') end as valid_to,
  1 - l_discount as confidence, 'order_' || o_orderkey as drawer_id, strftime(o_orderdate, '%Y-%m-%d') as extracted_at
  from lineitem join orders on l_orderkey = o_orderkey)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, wing (the label), filed (the order of filing) and vector as doubles."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("wing"), F.col("vec_id").alias("filed"), F.col("embedding").cast("array<double>").alias("vector"))
