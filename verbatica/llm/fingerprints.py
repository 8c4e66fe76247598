"""Document fingerprints by locally consistent parsing.

A text is parsed bottom up.  At each level runs of one symbol are folded, then deterministic coin tossing gives each symbol
a label from the lowest bit in which it differs from its left neighbour; four tosses leave fewer than six labels.  Local
maxima of the labels begin the phrases, and a hash of its members names a phrase for the next level.  A cut depends on a
few neighbours only, so equal substrings have equal phrases inside, wherever they stand.

The fingerprint holds, for each of the levels 2 to 5 (phrases of about 9, 27, 80 and 240 characters), 32 bins of the smallest
phrase name that falls there, 16 bits each, as hexadecimal digits; `ffff` marks an empty bin.  Likeness estimates for
each level the share of names in common from the bins, weighs the levels by the bins in use, and gives the share of the
text that this stands for: 2 J / (1 + J).

``with_neighbours`` also compares each document with the next by descending doc_id, and with its own text whose second half
the next document's beginning replaces.  Rows go to ranges of doc_id cut at quantiles, each range closed by a copy of the first
row of the range after it; texts are shuffled once, and no range needs another.

A null text is empty: no phrases, all bins empty; two empty texts have likeness 1, an empty and another 0.  Null ids come
after all others; rows of one doc_id follow each other by text.  One document alone is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import parts, table
from .textops import _Q, _Q_INV, _sums, code_points, mix, portions

LEVELS, BINS = (2, 3, 4, 5), 32
#: Ranges of doc_id for each shuffle partition, and in all at most.
RANGES, MOST_RANGES = 4, 100_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LEAST_ID = -(1 << 63)
_COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _toss(s: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest bit that differs from the left neighbour, plus that bit."""
    x = np.empty_like(s)
    x[1:] = s[1:] ^ s[:-1]
    x[head] = 1
    low = x & (~x + s.dtype.type(1))
    place = np.bitwise_count(low - s.dtype.type(1)).astype(s.dtype)
    place[x == 0] = 0
    return (place * s.dtype.type(2) + ((s >> place) & s.dtype.type(1))).astype(np.uint8)


def parsed(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, phrase names, number of the first phrase of each text) level by level; a level holds only texts that go on."""
    cps, first = code_points(texts)
    keep = np.ones(len(cps), bool)
    keep[first[1:] - 1] = False  # the separators
    first = first - np.arange(len(first))
    names = mix(cps[keep].astype(np.uint64) + np.uint64(1))
    for level in range(1, LEVELS[-1] + 1):
        if not len(names):
            return
        n = np.diff(first)
        head = np.zeros(len(names), bool)
        head[first[:-1][n > 0]] = True
        edge = head.copy()
        edge[1:] |= names[1:] != names[:-1]
        at = np.flatnonzero(edge)
        times = np.diff(np.append(at, len(names)))
        names, head = names[at], head[at]
        many = times > 1
        names[many] = mix(names[many] + times[many].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        first = np.searchsorted(at, first)
        lab = _toss((names >> np.uint64(32)).astype(np.uint32), head)
        for _ in range(3):
            lab = _toss(lab, head)
        begin = head.copy()
        begin[1:-1] |= (lab[1:-1] > lab[:-2]) & (lab[1:-1] >= lab[2:]) & ~head[2:] & ~head[:-2]
        start = np.flatnonzero(begin)
        names = mix(_sums(names, start, np.append(start[1:], len(names)), _Q, _Q_INV) + np.uint64(level * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))
        first = np.searchsorted(start, first)
        yield level, names, first
        if level >= LEVELS[0]:  # texts that are one phrase are done
            n = np.diff(first)
            stay = np.repeat(n > 1, n)
            names = names[stay]
            first = np.concatenate(([0], np.cumsum(np.where(n > 1, n, 0))))


def fingerprints(texts: list[str]) -> np.ndarray:
    """Bins of each text (rows): 16 bits of the smallest name of each bin of each level."""
    least = np.full((len(texts), len(LEVELS), BINS), _EMPTY)
    for level, names, first in parsed(texts):
        if level in LEVELS:
            doc = np.repeat(np.arange(len(texts)), np.diff(first))
            flat = least.reshape(-1)
            np.minimum.at(flat, (doc * len(LEVELS) + LEVELS.index(level)) * BINS + (names & np.uint64(BINS - 1)).astype(np.int64), names >> np.uint64(6))
    out = (mix(least) % np.uint64(0xFFFF)).astype(np.uint16)
    out[least == _EMPTY] = 0xFFFF
    return out.reshape(len(texts), -1)


def digits(rows: np.ndarray) -> list[str]:
    text = rows.astype(">u2").tobytes().hex()
    width = 4 * rows.shape[1]
    return [text[i * width : (i + 1) * width] for i in range(len(rows))]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a to the row of b: 0 to 1."""
    a, b = a.reshape(len(a), len(LEVELS), BINS), b.reshape(len(b), len(LEVELS), BINS)
    used = (a != 0xFFFF) | (b != 0xFFFF)
    same = ((a == b) & used).sum(axis=(1, 2))
    all_used = used.sum(axis=(1, 2))
    j = np.where(all_used > 0, same / np.maximum(1, all_used), 1.0)
    return 2 * j / (1 + j)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row; nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, most=500_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digits(fingerprints(texts)), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _edited(texts: list[str], after: list[str]) -> list[str]:
    return [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, after, strict=True)]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list = []
    texts: list[str] = []
    copies: list[bool] = []

    def told() -> pa.RecordBatch:
        own = fingerprints(texts)
        changed = _edited(texts[:-1], texts[1:])
        new = fingerprints(changed)
        keep = [i for i in range(len(texts) - 1) if not copies[i]]
        return pa.RecordBatch.from_arrays([
            pa.array([ids[i] for i in keep], pa.int64()), pa.array([len(texts[i]) for i in keep], pa.int64()),
            pa.array([hashlib.sha256(changed[i].encode()).hexdigest() for i in keep]), pa.array(digits(own[keep]), pa.string()), pa.array(digits(new[keep]), pa.string()),
            pa.array(likeness(own[keep], new[keep])), pa.array(likeness(own[keep], own[[i + 1 for i in keep]] if keep else own[:0]))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    chars = 0
    for batch in batches:
        for doc, text, copy in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            ids.append(doc.as_py())
            texts.append(text.as_py() or "")
            copies.append(copy.as_py())
            chars += len(texts[-1])
            if chars > 400_000 and len(texts) > 1:
                yield told()
                ids, texts, copies, chars = ids[-1:], texts[-1:], copies[-1:], len(texts[-1])
    if len(texts) > 1:
        yield told()


def with_neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    spark, n = docs.sparkSession, parts(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_ID)).alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = min(RANGES * n, MOST_RANGES)
    cuts = rows.agg(F.percentile_approx("ord", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    if not cuts:
        return spark.createDataFrame([], _COMPARED)
    splits = [-float("inf"), *sorted({float(c) for c in cuts}), float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="at", outputCol="range")

    def ranged(df: DataFrame) -> DataFrame:
        return bucketed.transform(df.withColumn("at", F.col("ord").cast("double"))).withColumn("range", -F.col("range").cast("int")).drop("at")

    heads = sorted((r["range"], r["ord"]) for r in ranged(rows.select("ord")).groupBy("range").agg(F.max("ord").alias("ord")).collect())
    # the first row of each range also closes the range before it (of the first range: the last)
    closes = [(heads[i][1], heads[i - 1][0]) for i in range(len(heads))]
    closing = F.broadcast(spark.createDataFrame(closes, "ord long, range int"))
    copies = rows.join(closing, "ord").groupBy("range", "ord").agg(F.min("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "ord", "text", "range", F.lit(True).alias("copy"))
    every = ranged(rows).withColumn("copy", F.lit(False)).unionByName(copies)
    dealt = every.repartition(n, "range").sortWithinPartitions("range", "copy", F.desc("ord"), "text")
    return dealt.select("doc_id", "text", "copy").mapInArrow(_compared, _COMPARED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbours(table(spark, sf_dir, "documents"))


QUERIES = {"op4_document_fingerprints": (query, None)}
