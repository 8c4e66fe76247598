"""Benchmark decontamination with DataFrame functions only.

Words are the runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z.  Each benchmark item gives windows of 10
consecutive words; an item of fewer words (but not none) is one window.  The 64-bit hashes of the normalised windows form a broadcast
hash set (a plain shuffled join beyond ``BROADCAST_BYTES`` of them).  Documents are read once: each word is hashed, and every
window of a document is looked up by a hash of its words' hashes.  Only what the set holds leaves the scan, with the
window's own words, and is verified by these; one more row for each document carries its word count.  No text is shuffled.

A null text has no words.  Rows equal in doc_id and text give one result; other rows of one doc_id are kept apart.  Items
without an id or without words are ignored.  An empty benchmark leaves every document clean.  The stage judges each row by its
own text, whatever its doc_id, so a row with a null doc_id or one that repeats an id goes if it holds a window, and only then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import cut, row_sig, table, unused

WINDOW = 10
WORD, MARKS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most bytes of benchmark windows that are broadcast.
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """What the marks between words part; the same as all matches of WORD, at a third of the time."""
    spaced = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), MARKS, " ")
    return F.array_remove(F.split(spaced, " "), "")


def _hashes(w: Column, k: int) -> Column:
    """(h, pos, len) of every k consecutive words, from the hashes of the words."""
    cut_ = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(F.xxhash64(F.slice(w, i + 1, k)).alias("h"), i.alias("pos"), F.lit(k).alias("len")))
    return F.when(F.size(w) >= k, cut_).otherwise(F.array().cast("array<struct<h:bigint,pos:int,len:int>>"))


def _of_words(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(window, h, len, items): every distinct window, its hash, its words and the sorted ids of the items that hold it."""
    items = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(WINDOW))
    return (items.select("item_id", k.alias("len"), F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.slice("w", i + 1, k))).alias("part"))
            .groupBy(F.array_join("part", " ").alias("window"))
            .agg(F.first(F.xxhash64(_of_words(F.col("part")))).alias("h"), F.first("len").alias("len"), F.sort_array(F.collect_set("item_id")).alias("items")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, sig, n_words, n_hit, n_items, items, spans, contaminated) of every document; spans are (pos, len) of hits, in order, and sig is ``row_sig`` of its text."""
    held = cut(benchmark_windows(benchmark), "windows")
    measure = held.agg(F.collect_set("len").alias("lengths"), (8 * F.count("*")).alias("bytes")).first()
    read = docs.select("doc_id", row_sig("text").alias("sig"), words(F.col("text")).alias("w")).withColumn("hashes", _of_words(F.col("w")))
    # the row that carries the word count; its hash is one of a document, so that no join gathers these rows
    marker = F.array(F.struct(F.xxhash64("sig").alias("h"), F.size("w").alias("pos"), F.lit(0).alias("len")))
    looked = read.select("doc_id", "sig", "w", F.explode(F.concat(marker, *[_hashes(F.col("hashes"), k) for k in sorted(measure["lengths"])])).alias("x"))
    keys = held.select("h", F.lit(True).alias("known")).distinct()
    near = looked.select("doc_id", "sig", "w", "x.h", "x.pos", "x.len").join(F.broadcast(keys) if measure["bytes"] <= BROADCAST_BYTES else keys, "h", "left").where("known or len = 0")
    near = near.select("doc_id", "sig", "pos", "len", F.when(F.col("len") > 0, F.array_join(F.slice("w", F.col("pos") + 1, F.col("len")), " ")).alias("window"))
    found = near.join(held.select("window", "items"), "window", "left").where("items is not null or len = 0")
    hit = F.col("len") > 0
    found = found.groupBy("doc_id", "sig").agg(
        F.max(F.when(~hit, F.col("pos"))).cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(hit, F.struct("pos", "len")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items"))))).alias("items"))

    def grown(s: Column, x: Column) -> Column:
        end = x["pos"] + x["len"]
        return F.struct(F.greatest(s["end"], end).alias("end"), (s["n"] + F.greatest(F.lit(0), end - F.greatest(s["end"], x["pos"]))).alias("n"))

    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), grown, lambda s: s["n"])
    return found.select("doc_id", "sig", "n_words", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.array_sort(F.transform("items", lambda i: i.cast("string"))).alias("items"), "spans", (F.size("spans") > 0).alias("contaminated"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those that hold a benchmark window."""
    key, sig = unused(docs, "id_"), unused(docs, "sig_")
    leaked = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias(key), F.col("sig").alias(sig)).distinct()
    leaked = cut(leaked, "leaked")  # its size is known, so that texts move only if it is large
    return docs.join(leaked, F.col("doc_id").eqNullSafe(F.col(key)) & (row_sig("text") == F.col(sig)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
ORACLE = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
bp as (select item_id, w, least(len(w), {WINDOW}) as k, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) as p from b where len(w) > 0),
bw as (select distinct item_id, k, array_to_string(w[p:p + k - 1], ' ') as win from bp),
ks as (select distinct k from bw),
dp as (select doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) as p from d, ks where len(w) >= k),
dw as (select doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') as win from dp),
h as (select dw.doc_id, dw.p, dw.k, bw.item_id from dw join bw on dw.win = bw.win and dw.k = bw.k),
hq as (select doc_id, unnest(generate_series(p, p + k - 1)) as q from h),
hn as (select doc_id, count(distinct q) as n_hit from hq group by doc_id),
hi as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as items from h group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hn using (doc_id) left join hi using (doc_id)
"""

QUERIES = {"op9_benchmark_decontamination": (query, ORACLE)}
