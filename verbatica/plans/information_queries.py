"""Information statistics, de-duplication, revisions and writes, each with its SQL where that can say it."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import dedup, evaluation, information as info, revisions, store
from ..sources.tables import DRAWERS_SQL, drawers, table, vectors

EDGES = [round(0.05 * i, 2) for i in range(21)] + [2.0]


def _rows(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("wing").alias("grp"), "filed", "vector")


def _novelty(spark, sf_dir):
    return info.novelty(_rows(spark, sf_dir))


_NOVELTY = """
e as (select vec_id as id, label::varchar as grp, embedding::double[] as v from embeddings),
s as (select a.id, a.grp, b.id as prior, list_dot_product(a.v, b.v) as score from e a join e b on a.grp = b.grp and b.id < a.id),
nv as (select e.id, e.grp, coalesce(1 - max(score), 1.0) as novelty, max(score) is null as is_first from e left join s on s.id = e.id group by e.id, e.grp)"""


def _sizes(spark, sf_dir):
    return drawers(spark, sf_dir).select("wing", F.char_length("text").cast("double").alias("size"))


def _bh(spark, sf_dir):
    # a p-value for each source: how far its share of good labels lies from the mean, as a normal tail
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("source").alias("test")).agg(F.count("*").alias("n"), F.avg("quality").alias("m"))
    return info.benjamini_hochberg(both.select("test", F.round(F.exp(-F.lit(2.0) * F.col("n") * (F.col("m") - 0.85) * (F.col("m") - 0.85)), 9).alias("p")), 0.5)


def _bins(spark, sf_dir):
    return drawers(spark, sf_dir).groupBy(F.col("wing").alias("grp"), F.least(F.floor(F.char_length("text") / 500), F.lit(20)).alias("bin")).agg(F.count("*").alias("n"))


def _revised(spark, sf_dir):
    """Every fifth drawer's file is filed again: revisions from the lengths, completion from the index."""
    d = drawers(spark, sf_dir)
    return d.select("id", "source_file", F.when(F.col("importance") > 0, F.concat(F.lit("r"), F.col("importance").cast("string"))).alias("revision"), (F.col("chunk_index") % 2 == 0).alias("complete"), "filed_at")


_REVISED = "with" + DRAWERS_SQL + """,
r as (select id, source_file, case when importance > 0 then 'r' || importance::varchar end as revision, chunk_index % 2 = 0 as complete, filed_at from drawers),
p as (select source_file, revision, count(*) as n, bool_or(complete) as complete, max(filed_at) as filed_at from r group by all),
b as (select source_file, arg_max(revision, filed_at || revision) as kept, max(filed_at || revision) as k, arg_max(filed_at, filed_at || revision) as kept_at from p where complete and revision is not null group by 1),
pl as (select p.*, case when b.kept is null then 'untouched' when p.revision = b.kept then 'kept' when p.revision is not null and not complete and filed_at > kept_at then 'untouched' else 'superseded' end as fate
       from p left join b on b.source_file = p.source_file)"""


def _upserted(spark, sf_dir):
    d = drawers(spark, sf_dir).select("id", "wing", "room", F.char_length("text").alias("size"), "doc_id")
    new = d.where("doc_id % 7 = 0").select(F.when(F.col("doc_id") % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("new_"), "id")).alias("id"), F.lit("moved").alias("wing"), "room", (F.col("size") + 1).alias("size"), "doc_id")
    changed = store.update(store.upsert(d, new), new.select("id", F.lit("updated").alias("room")).where("id like 'new_%'"))
    return store.delete(changed, where=F.col("size") < 100).select("id", "wing", "room", "size")


def _receipts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.lit("operator").alias("namespace"), F.concat(F.lit("r"), (F.col("conv_id") % 40).cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("request_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "conv_id")
    held = c.where("conv_id < 40").drop("conv_id").distinct()
    return store.receipts(held, c.drop("conv_id"))


def _greedy(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return dedup.greedy(v.select(F.col("vec_id").alias("id"), F.concat(F.lit("file_"), "wing").alias("source_file"), (20 + F.col("vec_id") % 50).alias("size"), "vector"), 0.6)


def _decay(spark, sf_dir):
    n = _novelty(spark, sf_dir)
    return info.decay_points(n, "novelty", "id", "grp", 5)


def _lines(spark, sf_dir):
    d = drawers(spark, sf_dir)
    return store.packed_lines(d.select("source_file", F.col("chunk_index").alias("ordinal"), F.concat_ws("|", "room", "wing", F.concat(F.lit("->"), "id")).alias("line")), 150)


QUERIES = {
    "novelty_exact": (lambda s, d: _novelty(s, d).select("id", "grp", F.round("novelty", 5).alias("novelty"), "is_first"), "with" + _NOVELTY + " select id, grp, round(novelty, 5) as novelty, is_first from nv"),
    "novelty_band": (lambda s, d: _novelty(s, d).groupBy("grp", info.band(F.col("novelty")).alias("band")).agg(F.count("*").alias("n")), "with" + _NOVELTY + """
        select grp, case when novelty < 0.1 then 'low' when novelty < 0.5 then 'medium' else 'high' end as band, count(*) as n from nv group by all"""),
    "novelty_histogram": (lambda s, d: info.histogram(_novelty(s, d), "novelty", EDGES, "grp"), "with" + _NOVELTY + """
        select grp, case when novelty >= 1 then 20 else greatest(0, (select count(*) from (values """ + ", ".join(f"({e}::double)" for e in EDGES[1:-1]) + """) t(e) where novelty >= e)) end::int as bin, count(*) as n from nv group by all"""),
    "novelty_quantiles": (lambda s, d: info.quantiles(_novelty(s, d), "novelty", "grp").select("grp", "n", *[F.round(c, 5).alias(c) for c in ("p25", "median", "p75", "p90", "mean")]), "with" + _NOVELTY + """
        select grp, count(*) as n, round(quantile_cont(novelty, 0.25), 5) as p25, round(quantile_cont(novelty, 0.5), 5) as median, round(quantile_cont(novelty, 0.75), 5) as p75, round(quantile_cont(novelty, 0.9), 5) as p90, round(avg(novelty), 5) as mean from nv group by grp"""),
    "prior_neighbors": (lambda s, d: info.earlier_neighbours(_rows(s, d), 5).select("id", "prior", "rank", F.round("score", 5).alias("score")), "with" + _NOVELTY + """
        select id, prior, rank, round(score, 5) as score from (select *, row_number() over (partition by id order by score desc, prior desc)::int as rank from s) where rank <= 5"""),
    "prune_suggest": (lambda s, d: dedup.prune_suggestions(_novelty(s, d).select("id", "novelty"), 0.5).select("id", F.round("novelty", 5).alias("novelty")), "with" + _NOVELTY + " select id, round(novelty, 5) as novelty from nv where novelty < 0.5"),
    "check_duplicate": (lambda s, d: dedup.duplicates_of(vectors(s, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector"), vectors(s, d).select(F.col("vec_id").alias("id"), "vector"), 0.4), """
        with d as (select a.vec_id as query_id, b.vec_id as id, list_dot_product(a.embedding::double[], b.embedding::double[]) as score from embeddings a join embeddings b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
        r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from d) select query_id, id, round(score, 3) as similarity from r where rank <= 5 and round(score, 3) >= 0.4"""),
    "lle_residual": (lambda s, d: info.residuals(_rows(s, d)).select("id", F.round("residual", 6).alias("residual")), None),
    "kruskal_h": (lambda s, d: info.kruskal(_sizes(s, d), "size", "wing").select(F.round("h", 4).alias("h"), F.round("epsilon_squared", 6).alias("epsilon_squared"), "n", "k"), "with" + DRAWERS_SQL + """,
        v as (select wing, length(text)::double as size from drawers), g as (select wing from v group by 1 having count(*) >= 20), k as (select * from v where wing in (select wing from g)),
        c as (select size, count(*) as t from k group by 1), r as (select size, sum(t) over (order by size) - t + (t + 1) / 2 as rk from c),
        p as (select wing, count(*) as m, sum(rk) as r from k join r on r.size = k.size group by 1),
        a as (select sum(m)::double as n, count(*)::double as k, sum(r * r / m) as s from p), ti as (select sum(t::double * t * t - t) as t from c),
        h as (select (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)) as h, n, k from a, ti)
        select round(h, 4) as h, round(greatest((h - k + 1) / (n - k), 0), 6) as epsilon_squared, n::bigint as n, k::bigint as k from h"""),
    "spearman_ab": (lambda s, d: info.spearman(table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("x"), F.col("quality").cast("double").alias("y")), "x", "y").select(F.round("rho", 6).alias("rho"), "n"), """
        with b as (select n_chars::double as x, quality::double as y from documents join labels using (doc_id)),
        r as (select (rank() over (order by x) + (count(*) over (partition by x) - 1) / 2) as rx, (rank() over (order by y) + (count(*) over (partition by y) - 1) / 2) as ry from b)
        select round(corr(rx, ry), 6) as rho, count(*) as n from r"""),
    "bh_fdr": (_bh, """
        with t as (select source as test, round(exp(-2.0::double * count(*) * (avg(quality) - 0.85::double) * (avg(quality) - 0.85::double)), 9) as p from documents join labels using (doc_id) group by source),
        r as (select *, count(*) over () as m, row_number() over (order by p, test) as k from t), e as (select max(case when p <= k / m * 0.5::double then k end) as edge from r)
        select test, p, coalesce(k <= edge, false) as rejected from r, e"""),
    "js_distance": (lambda s, d: info.jensen_shannon(_bins(s, d)).select("a", "b", F.round("distance", 6).alias("distance")), "with" + DRAWERS_SQL + """,
        c as (select wing as grp, least(length(text) // 500, 20) as bin, count(*) as n from drawers group by all), p as (select grp, bin, n / sum(n) over (partition by grp) as p from c),
        pr as (select a.grp as a, b.grp as b from (select distinct grp from c) a join (select distinct grp from c) b on a.grp < b.grp),
        f as (select pr.a, pr.b, coalesce(x.p, 0) as pa, coalesce(y.p, 0) as pb from pr cross join (select distinct bin from c) i left join p x on x.grp = pr.a and x.bin = i.bin left join p y on y.grp = pr.b and y.bin = i.bin)
        select a, b, round(sqrt(greatest(sum(case when pa > 0 then pa * log2(pa / ((pa + pb) / 2)) else 0 end + case when pb > 0 then pb * log2(pb / ((pa + pb) / 2)) else 0 end) / 2, 0)), 6) as distance from f group by a, b"""),
    "decay_points": (lambda s, d: _decay(s, d).select("grp", F.col("bin").cast("long").alias("bin"), F.round("at", 6).alias("at"), F.round("mean", 5).alias("mean"), "n"), "with" + _NOVELTY + """,
        o as (select *, row_number() over (partition by grp order by id) as place from nv)
        select grp, ((place - 1) // 5)::bigint as bin, round(avg(place), 6) as at, round(avg(novelty), 5) as mean, count(*) as n from o group by grp, ((place - 1) // 5)"""),
    "decay_fit": (lambda s, d: info.decay_fits(_decay(s, d), "grp").select("grp", "model", F.round("aic", 3).alias("aic"), F.round("weight", 4).alias("weight")), None),
    "reservoir_sample": (lambda s, d: info.reservoir(drawers(s, d), "wing", "id", 20).select("wing", "id"), None),
    "dedup_greedy": (_greedy, None),
    "prune_revisions_plan": (lambda s, d: revisions.plan(_revised(s, d)), _REVISED + " select source_file, revision, n, complete, filed_at, fate from pl"),
    "prune_revisions": (lambda s, d: revisions.pruned(_revised(s, d)).select("id", "source_file", "revision"), _REVISED + """
        select r.id, r.source_file, r.revision from r join pl on pl.source_file = r.source_file and pl.revision is not distinct from r.revision where fate <> 'superseded'"""),
    "upsert_update_delete": (_upserted, "with" + DRAWERS_SQL + """,
        d as (select id, wing, room, length(text) as size, doc_id from drawers), n as (select case when doc_id % 2 = 0 then id else 'new_' || id end as id, 'moved' as wing, room, size + 1 as size from d where doc_id % 7 = 0),
        u as (select id, wing, room, size from d where id not in (select id from n) union all select * from n)
        select id, wing, case when id like 'new%' then 'updated' else room end as room, size::int as size from u where size >= 100"""),
    "receipts": (_receipts, """
        with c as (select 'operator' as namespace, 'r' || (conv_id % 40)::varchar || '-' || turn::varchar as request_id, sha256(coalesce(text, '')) as digest, conv_id from conversations),
        h as (select distinct namespace, request_id, digest as old from c where conv_id < 40), f as (select namespace, request_id, min(digest) as first from c group by all)
        select c.namespace, c.request_id, c.digest, case when coalesce(old, first) <> digest then 'conflict' when old is null then 'stored' else 'replayed' end as status
        from c join f on f.request_id = c.request_id left join h on h.request_id = c.request_id"""),
    "closet_lines": (_lines, None),
    "session_scores": (lambda s, d: evaluation.session_scores(table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.char_length("text").alias("value")), "value").select("session_id", F.round("score", 6).alias("score")), """
        select conv_id as session_id, round(avg(length(text)), 6) as score from conversations group by 1 having avg(length(text)) is not null"""),
    "drop_sessions": (lambda s, d: evaluation.dropped_sessions(evaluation.session_scores(table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.char_length("text").alias("value")), "value"), 25), """
        with s as (select conv_id as session_id, avg(length(text)) as score from conversations group by 1 having avg(length(text)) is not null)
        select session_id from (select *, row_number() over (order by score, session_id) as k, count(*) over () as n from s) where k <= n * 25 // 100"""),
    "session_cursor": (lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("mark"), F.count("*").alias("n")), "select user_id, max(ts) as mark, count(*) as n from events group by 1"),
    "stratum_sizes": (lambda s, d: drawers(s, d).groupBy("wing").agg(F.count("*").alias("n")).where("n >= 200"), "with" + DRAWERS_SQL + " select wing, count(*) as n from drawers group by 1 having count(*) >= 200"),
    "novelty_ranks": (lambda s, d: info.average_ranks(_sizes(s, d), "size"), "with" + DRAWERS_SQL + """,
        c as (select length(text)::double as size, count(*) as n from drawers group by 1) select size, sum(n) over (order by size) - n + (n + 1) / 2 as rank, n from c"""),
    "latest_by_role": (lambda s, d: _latest(s, d), """
        select conv_id as session_id, role, turn as ordinal from (select conv_id, role, turn, row_number() over (partition by conv_id, role order by turn desc) as k from conversations) where k <= 2"""),
}


def _latest(spark, sf_dir):
    order = Window.partitionBy("session_id", "role").orderBy(F.desc("ordinal"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "role", F.col("turn").alias("ordinal"))
    return rows.withColumn("k", F.row_number().over(order)).where("k <= 2").drop("k")
