"""Reports, exact and sketched quantiles, contiguous blocks and thresholds over the given tables, each with its SQL where that can say it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import distributions as dist, information as info, retrieval
from ..sources.tables import DRAWERS_SQL, drawers, table, vectors
from .information_queries import EDGES, _NOVELTY

TEXT_EDGES = [0, 100, 200, 400, 800, 1600, 3200, 6400, 12800]
BY_WING = ["p25", "median", "p75", "p90"]


def _reported(spark, sf_dir):
    """A row for each label: drawers are documents by the label of the vector with their number."""
    v = vectors(spark, sf_dir)
    d = drawers(spark, sf_dir).select("doc_id", "room", "filed_at", F.char_length("text").alias("size")).join(v.select(F.col("vec_id").alias("doc_id"), F.col("wing").alias("label")), "doc_id")
    d = d.select(F.col("doc_id").alias("id"), F.col("label").alias("wing"), "room", "filed_at", "size")
    rows = v.select(F.col("vec_id").alias("id"), F.col("wing").alias("grp"), "filed", "vector")
    return dist.report(d, info.novelty(rows).select("id", "novelty", "is_first"), TEXT_EDGES, EDGES)


def _report(spark, sf_dir):
    rounded = [F.round(f"{p}_{c}", 5).alias(f"{p}_{c}") for p in ("text", "novelty") for c in (*BY_WING, "mean")]
    return _reported(spark, sf_dir).select("wing", "drawers", "rooms", "with_filed_at", "first_in_wing", "text_n", "novelty_n", *rounded,
                                           *[F.array_join(F.transform(f"{p}_bins", lambda n: n.cast("string")), ",").alias(f"{p}_bins") for p in ("text", "novelty")])


def _summary(spark, sf_dir):
    found = dist.summary(_reported(spark, sf_dir).withColumn("store", F.lit("all")), ["store"])
    return found.select("store", "drawers", "wings", "wings_scored", *[F.round(c, 5).alias(c) for c in ("novelty_middle", "novelty_least", "novelty_most")])


def _sketches(spark, sf_dir):
    """Length of texts by language, from sketches of each language and source that are merged."""
    parts = dist.sketched(drawers(spark, sf_dir).withColumn("size", F.char_length("text")), "size", ["wing", "room"], TEXT_EDGES)
    return dist.estimated(dist.merged(parts, ["wing"]))


def _blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("size"))
    return dist.blocks_of(d, ["doc_id", "size"], {"total": F.col("size"), "squares": F.col("size") * F.col("size")})[0].select("block", "n", "total", "squares")


def _interval(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("size"))
    told = dist.bootstrap_ci(d, ["doc_id", "size"], {"total": F.col("size")}, lambda s: s["total"] / np.maximum(s["n"], 1))
    return spark.createDataFrame([(told["value"], told["low"], told["high"])], "value double, low double, high double")


def _dropped(spark, sf_dir):
    """Recall of the label among the nearest vectors, as sessions of little information go; a session is a vector, its score its number's remainder."""
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "wing", "vector")
    asked = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("wing").alias("asked"), "vector")
    near = retrieval.dense(asked.select("query_id", "vector"), v.select("id", "vector"), 100)
    ranked = near.where("query_id <> id").select("query_id", F.col("id").alias("session_id"), "rank")
    answers = ranked.join(v.select(F.col("id").alias("session_id"), "wing"), "session_id").join(asked.select("query_id", "asked"), "query_id").where("asked = wing").select("query_id", "session_id")
    scores = v.where("id % 3 > 0").select(F.col("id").alias("session_id"), (F.col("id") % 7).cast("double").alias("score"))
    return dist.recall_by_threshold(ranked, answers, scores, k=3).select("percent", F.round("recall", 6).alias("recall"), "n")


def _case(value, edges, i):
    low = f"{value} >= {edges[i]}" if i else "true"
    return f"sum(({value} is not null and {low}{f' and {value} < {edges[i + 1]}' if i < len(edges) - 2 else ''})::int)::bigint"


def _bins(value, edges):
    return " || ',' || ".join(f"({_case(value, [f'{e}::double' for e in edges], i)})::varchar" for i in range(len(edges) - 1))


def _shares(value, prefix):
    return ", ".join(f"round(quantile_cont({value}, {q}), 5) as {prefix}_{name}" for name, q in dist.QUARTERS.items()) + f", round(avg({value}), 5) as {prefix}_mean, count({value}) as {prefix}_n"


_RP = "with" + DRAWERS_SQL + "," + _NOVELTY.removeprefix("\n") + f""",
dd as (select doc_id as id, label::varchar as wing, room, filed_at, length(text)::double as size from drawers join embeddings on vec_id = doc_id),
jn as (select dd.*, case when not is_first then novelty end as novelty, is_first from dd left join nv on nv.id = dd.id),
rp as (select wing, count(*) as drawers, count(distinct room) as rooms, sum((coalesce(filed_at, '') <> '')::int)::bigint as with_filed_at, sum(is_first::int)::bigint as first_in_wing,
  {_shares('size', 'text')}, {_shares('novelty', 'novelty')}, quantile_cont(novelty, 0.5) as middle, {_bins('size', TEXT_EDGES)} as text_bins, {_bins('novelty', EDGES)} as novelty_bins from jn group by wing)"""

QUERIES = {
    "info_report": (_report, _RP + " select * exclude (middle) from rp"),
    "info_summary": (_summary, _RP + """ select 'all' as store, sum(drawers)::bigint as drawers, count(*) as wings, count(middle) as wings_scored, round(quantile_cont(middle, 0.5), 5) as novelty_middle,
        round(min(middle), 5) as novelty_least, round(max(middle), 5) as novelty_most from rp"""),
    "sketched_sizes": (_sketches, None),
    "contiguous_blocks": (_blocks, """
        with d as (select doc_id, coalesce(length(text), 0) as size, row_number() over (order by doc_id, coalesce(length(text), 0)) as place, count(*) over () as m from documents where doc_id is not null)
        select (place - 1) // greatest(10, least(100, m // 5)) as block, count(*) as n, sum(size)::double as total, sum(size * size)::double as squares from d group by 1"""),
    "bootstrap_interval": (_interval, None),
    "recall_by_threshold": (_dropped, """
        with e as (select vec_id as id, label, embedding::double[] as v from embeddings),
        n as (select a.id as q, b.id as s, a.label = b.label as good, row_number() over (partition by a.id order by list_dot_product(a.v, b.v) desc, b.id) as rank from e a join e b on a.id % 50 = 0),
        r as (select * from n where rank <= 100 and q <> s),
        sc as (select id, row_number() over (order by id % 7, id) as place, count(*) over () as m from e where id % 3 > 0),
        t as (select unnest([0, 10, 25, 50]) as percent),
        k as (select r.*, percent, row_number() over (partition by percent, q order by rank) as nth from r join t on true left join sc on sc.id = r.s where sc.id is null or percent = 0 or place > m * percent // 100),
        h as (select percent, q, max(good::int) as hit from k where nth <= 3 group by all)
        select percent, round(avg(hit), 6) as recall, count(*) as n from h group by percent"""),
}
