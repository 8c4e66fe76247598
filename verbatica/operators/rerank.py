"""Reranking by a scorer of the caller's: a model that reads a query together with each candidate.

A scorer is a class or function that takes no argument and gives a function from (queries, candidates), two lists of equal length, to scores.  It is called once
in each Python worker, so a model is loaded once and kept; its function is called with ``PAIRS`` pairs at most, of several queries together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

Score = Callable[[list[str], list[str]], list[float]]
PAIRS = 256
#: Scorers that this worker has loaded, by what they were sent as.
_loaded: dict[bytes, Score] = {}

_WORD = re.compile(r"\w{2,}")


class WordOverlap:
    """The share of a query's distinct words that a candidate holds, of which pairs of neighbours count again: needs no model."""

    def __call__(self, queries: list[str], candidates: list[str]) -> list[float]:
        return [self.score(q, c) for q, c in zip(queries, candidates, strict=True)]

    @staticmethod
    def score(query: str, candidate: str) -> float:
        asked, held = _WORD.findall(query.lower()), _WORD.findall(candidate.lower())
        words, pairs = set(asked), set(zip(asked, asked[1:]))
        if not words:
            return 0.0
        return (len(words & set(held)) + len(pairs & set(zip(held, held[1:])))) / (len(words) + len(pairs))


def _scorer(sent: bytes) -> Score:
    if sent not in _loaded:
        _loaded[sent] = cloudpickle.loads(sent)()
    return _loaded[sent]


def reranked(hits: DataFrame, queries: DataFrame, drawers: DataFrame, scorer: Callable[[], Score], k: int | None = None, pairs: int = PAIRS) -> DataFrame:
    """(query_id, id, score, rank, was): the hits (query_id, id, rank) of each query in the order of the scorer; the k best, if k is given.

    Of equal scores the better earlier rank comes first, then the smaller id; a score that is not a number comes last.  A hit without a text (id, text) or a query without
    one is scored as an empty text.  Hits of a query are what a recall leaves, so few; their texts meet in batches of Arrow rows, not in groups.
    """
    sent = cloudpickle.dumps(scorer)
    told = hits.select("query_id", "id", F.col("rank").alias("was")).join(queries.select("query_id", F.col("text").alias("query")), "query_id", "left").join(drawers.select("id", "text"), "id", "left")
    kinds = {f.name: f.dataType.simpleString() for f in told.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = None
        for batch in batches:
            if not batch.num_rows:
                continue
            score = score or _scorer(sent)
            asked, texts = ([x or "" for x in batch.column(batch.schema.get_field_index(c)).to_pylist()] for c in ("query", "text"))
            out: list[float] = []
            for at in range(0, len(asked), pairs):
                got = [float(v) for v in score(asked[at : at + pairs], texts[at : at + pairs])]
                if len(got) != len(asked[at : at + pairs]):
                    raise ValueError("a scorer must give one score for each pair")
                out += got
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("query_id", "id", "was")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([None if v != v else v for v in out], pa.float64())], names=["query_id", "id", "was", "score"])

    scored = told.select("query_id", "id", "was", "query", "text").mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, was {kinds['was']}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "was", "id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)
