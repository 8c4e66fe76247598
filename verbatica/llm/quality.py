"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Tokens are runs of letters and digits, and runs of other marks; blanks part them.  Two streams of n-grams are hashed into
2**18 buckets: the lower-cased tokens (n = 1, 2), and their shapes (n = 1, 2, 3) - upper case, capitalised, lower case, number,
the marks themselves, or a repeat of the token before.  A text's value in a bucket is the bucket's share of its
n-grams, so its score is one sparse dot product whatever its length.

Training takes a bounded sample: at most about ``SAMPLE`` labelled rows, chosen by a hash of the id.  The sampled ids are
broadcast (bounded by the same number) to find their texts, which go to groups of about ``SHARD`` rows; each group runs
the updates in an order hashed from the ids, and the groups' weights are averaged.  Scoring reads all texts and shuffles
nothing; the weights are 1 MB.

Null and empty texts are scored by the bias alone.  Rows are scored each on its own.  Without labels, or with labels of one
kind only, every text scores the smoothed share of label 1.  Repeated labels of one document count once, by their mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import cut, fold_of, table
from .textops import code_points, code_table, lower_table, mix, portions, runs, token_hashes

BUCKETS = 1 << 18
#: Most labelled rows to learn from, about; and rows that one task learns from, about.
SAMPLE, SHARD, EPOCHS = 24_000, 1_500, 3
#: Characters whose n-grams are in memory at once.
PORTION = 200_000
ALPHA, BETA, L1, L2, SCALE = 1.0, 1.0, 0.02, 0.05, 20.0
THRESHOLD = 0.7


def _alnum() -> np.ndarray:
    return code_table(str.isalnum)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, text after text, and the number of each text's tokens (five n-grams a token)."""
    cps, text_start = code_points(texts)
    blank = code_table(str.isspace)[cps]
    word = _alnum()[cps]
    s1, e1 = runs(word)
    s2, e2 = runs(~word & ~blank)
    start, end = np.concatenate((s1, s2)), np.concatenate((e1, e2))
    order = np.argsort(start, kind="stable")
    is_word = np.concatenate((np.ones(len(s1), bool), np.zeros(len(s2), bool)))[order]
    start, end = start[order], end[order]
    first = np.searchsorted(start, text_start)
    n = np.diff(first)
    if not len(start):
        return np.zeros(0, np.int64), n
    low = lower_table()[cps]
    h = token_hashes(low, start, end)
    begins = np.zeros(len(start), bool)
    begins[first[:-1][n > 0]] = True
    upper = (low != cps)
    ups = np.concatenate(([0], np.cumsum(upper)))
    many = ups[end] - ups[start]
    shape = np.where(many == 0, 1, np.where((many == 1) & upper[start] & (end - start > 1), 2, 3)).astype(np.uint64)
    shape[code_table(str.isdigit)[cps[start]] & is_word] = 4
    shape = np.where(is_word, shape, h)
    before = np.concatenate((np.zeros(1, np.uint64), h[:-1]))
    shape = np.where(~begins & (h == before), np.uint64(5), shape)

    def back(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[by:] = x[:-by]
        out[np.arange(len(x)) - np.repeat(first[:-1], n) < by] = 7
        return out

    k = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    grams = [h ^ k[0], h * k[0] + back(h, 1) * k[1] + np.uint64(1), shape * k[1] + np.uint64(2),
             shape * k[0] + back(shape, 1) * k[2] + np.uint64(3), shape * k[0] + back(shape, 1) * k[1] + back(shape, 2) * k[2] + np.uint64(4)]
    return (mix(np.stack(grams, axis=1)) & np.uint64(BUCKETS - 1)).astype(np.int64).ravel(), n


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the bias) after the updates over the texts in the order given."""
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    while len(rows) < len(texts):  # a few texts at a time, as their n-grams take far more room than what is kept
        some, chars = [], 0
        while len(rows) + len(some) < len(texts) and (chars < PORTION or not some):
            some.append(texts[len(rows) + len(some)])
            chars += len(some[-1])
        buckets, n = features(some)
        first = np.concatenate(([0], np.cumsum(n * 5)))
        for d in range(len(some)):
            at, count = np.unique(buckets[first[d] : first[d + 1]], return_counts=True)
            rows.append((at.astype(np.int32), count.astype(np.int32)))
    z, g2, w = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for _ in range(epochs):
        for (at, count), y in zip(rows, labels, strict=True):
            i = np.append(at, BUCKETS)
            x = np.append(SCALE * count / max(1, count.sum()), 1.0)
            zi, ni = z[i], g2[i]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(wi @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            g2[i] += g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(g2)) / ALPHA + L2))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Averaged weights learned from rows that aren't held out."""
    usable = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold_of(F.col("doc_id")) != 2))
              .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")))
    have = usable.agg(F.count("*").alias("n"), F.sum("y").alias("ones")).first()
    weights = np.zeros(BUCKETS + 1)
    ones, n = have["ones"] or 0, have["n"]
    weights[-1] = np.log((ones + 1) / (n - ones + 1))
    if ones in (0, n):
        return weights
    share = int(min(1.0, sample / n) * 1_000_000)
    groups = max(1, round(min(n, sample) / SHARD))
    shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(groups))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share)
    taken = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("shard", shard)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(turn=pd.util.hash_array(frame.doc_id.to_numpy())).sort_values(["turn", "text"])
        w = train(frame.text.fillna("").tolist(), frame.y.to_numpy(float))
        at = np.union1d(np.flatnonzero(w), [BUCKETS])
        return pd.DataFrame({"bucket": at, "w": w[at]})

    trained = taken.select("shard", "doc_id", "text", "y").groupBy("shard").applyInPandas(one, "bucket long, w double")
    trained = cut(trained, "weights")
    learners = trained.where(F.col("bucket") == BUCKETS).count()  # each has a bias
    for row in trained.groupBy("bucket").agg(F.sum("w").alias("w")).toLocalIterator():
        weights[row["bucket"]] = row["w"] / max(1, learners)
    return weights


def _scores(weights: np.ndarray, texts: list[str]) -> np.ndarray:
    buckets, n = features(texts)
    running = np.concatenate(([0.0], np.cumsum(weights[buckets], dtype=np.float64)))
    first = np.concatenate(([0], np.cumsum(n * 5)))
    dot = (running[first[1:]] - running[first[:-1]]) * SCALE / np.maximum(1, n * 5) + float(weights[-1])
    return 1 / (1 + np.exp(-np.clip(dot, -35, 35)))


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, most=PORTION):
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(_scores(held.value, texts))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, each judged by its own text, whatever its doc_id."""
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, most=PORTION):
            yield batch.filter(pa.array(_scores(held.value, texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject; nothing is shuffled."""
    return accepted(docs, fit(docs, table(spark, sf_dir, "labels")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_quality_classifier": (query, None)}
