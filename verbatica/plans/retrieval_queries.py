"""Retrieval, fusion and evaluation queries; the questions are the benchmark items, or every vector whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.classify import intent
from ..operators import evaluation, retrieval as r
from ..sources.tables import DRAWERS_SQL, drawers, table, vectors
from .lineage import cut

WITH = "with" + DRAWERS_SQL
_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def _ask(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


_BM25 = f"""
q as (select item_id as query_id, unnest(list_distinct({_TOKENS.format("coalesce(text, '')")})) as term from benchmark),
dt as (select id, {_TOKENS.format('text')} as w from drawers),
st as (select count(*) as n, avg(len(w)) as mean from dt),
px as (select id, len(w) as size, unnest(w) as term from dt),
ix as (select id, term, count(*) as tf, any_value(size) as size from px where term in (select term from q) group by id, term),
df as (select term, count(*) as df from ix group by term),
sc as (select q.query_id, ix.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean))), 10) as score
       from ix join q on q.term = ix.term join df on df.term = ix.term, st group by all),
bm as (select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from sc))"""
_ANY = f"""
q1 as (select item_id as query_id, {_TOKENS.format("coalesce(text, '')")} as w from benchmark), q2 as (select query_id, w, unnest(generate_series(1, len(w))) as p from q1),
q4 as (select query_id, w[p] as term, min(p) as p from q2 group by query_id, w[p]), q3 as (select query_id, term, row_number() over (partition by query_id order by p) as place from q4),
qa as (select query_id, term, count(*) over (partition by query_id) as asked from q3 where place <= 16),
da as (select id, unnest(list_distinct({_TOKENS.format('text')})) as term from drawers),
ma as (select query_id, id, count(*) as n_terms, any_value(asked) as asked from qa join da on qa.term = da.term group by all)"""
_DENSE = """
d as (select a.vec_id as query_id, b.vec_id as id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 10) as score from embeddings a join embeddings b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
dr as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id)::int as rank from d)"""


def _bm25(spark, sf_dir, k=10):
    """The hits are written, so that their size is known and the drawers they are joined with need not move."""
    return cut(r.bm25(_ask(spark, sf_dir), drawers(spark, sf_dir), k), "hits")


def _dense(spark, sf_dir, k=10):
    v = vectors(spark, sf_dir)
    return r.dense(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector"), v.select(F.col("vec_id").alias("id"), "vector"), k)


def _fused(spark, sf_dir):
    return r.best(r.fused(r.lexical(_ask(spark, sf_dir), drawers(spark, sf_dir)), {"sparse": 1.0, "any": 0.5}), 20)


_FUSED = WITH + "," + _BM25 + "," + _ANY + """,
rk as (select query_id, id, rank, 1.0 as w from bm where rank <= 100 union all
       select query_id, id, rank, 0.5 as w from (select *, row_number() over (partition by query_id order by n_terms desc, id) as rank from ma) where rank <= 100),
fu as (select query_id, id, round(sum(w::double / (60 + rank)), 10) as score from rk group by all)"""


def _boosted(spark, sf_dir):
    at = drawers(spark, sf_dir).select("id", "room", "wing", F.unix_timestamp(F.to_timestamp("filed_at")).cast("double").alias("filed"))
    now = F.lit(1_704_067_200 + 365 * 86_400.0)
    hits = _bm25(spark, sf_dir).join(at, "id")
    factor = r.symbolic((now - F.col("filed")) < F.lit(360 * 86400.0), F.col("wing") == "en", F.col("room") == "src0", F.lit(False), F.col("rank"))
    return hits.select("query_id", "id", F.round(r.recency(F.col("score"), F.col("filed"), now), 6).alias("recent"), F.round(factor, 6).alias("factor"), F.round(F.col("score") * factor, 6).alias("boosted"))


def _overlap(spark, sf_dir):
    asked = _ask(spark, sf_dir).withColumnRenamed("text", "question")
    both = _bm25(spark, sf_dir).join(asked, "query_id").join(drawers(spark, sf_dir).select("id", "text"), "id")
    share = r.keyword_overlap(F.col("question"), F.col("text"))
    return both.select("query_id", "id", F.round(share, 6).alias("overlap"), F.round(r.hybrid_distance(1 / (1 + F.col("score")), share), 6).alias("distance"))


def _evidence(spark, sf_dir):
    asked = _ask(spark, sf_dir)
    # a drawer is evidence if it holds all the first words of the item
    return r.boolean_match(asked, drawers(spark, sf_dir), "all").select("query_id", "id")


def _recall(spark, sf_dir):
    return evaluation.at_k(_bm25(spark, sf_dir), _evidence(spark, sf_dir), 10).select("query_id", "recall_any", "recall_all", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"))


def _merge(spark, sf_dir):
    hits = _bm25(spark, sf_dir, 20).join(drawers(spark, sf_dir).select("id", F.col("wing").alias("store")), "id").select("query_id", "store", "id", "score")
    return r.round_robin(hits, 10).select("query_id", "rank", "store", "ordinal", "id")


def _bytes(spark, sf_dir):
    hits = _bm25(spark, sf_dir).join(drawers(spark, sf_dir).select("id", "text"), "id")
    return r.within_bytes(hits, 8192).select("query_id", "rank", "id", "used")


def _weights(spark, sf_dir):
    hits = _dense(spark, sf_dir, 20).withColumn("novelty", 1 - F.col("score"))
    return hits.select("query_id", "id", "rank", F.round(r.info_weight(F.col("novelty"), 0.5, 0.5), 6).alias("factor"))


QUESTIONS, ROOMS = ["what did we decide", "which bug is it", "nothing of these"], ["decisions", "problem", "notes", "milestones", "problems"]


def _whole(mode, weigh=False):
    """Benchmark items ask; item n has the vector of row 50 n, and its project is the n-th language in turn. The first two words of a document are a fact of it."""
    def make(spark, sf_dir):
        d, v = drawers(spark, sf_dir), vectors(spark, sf_dir)
        filed = F.unix_timestamp(F.to_timestamp("filed_at")).cast("double")
        marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.col("quality").cast("double")).alias("quality"))
        rated = d.select("id", "doc_id", "wing", "text", filed.alias("filed"), ((F.col("doc_id") % 10) / 40).alias("novelty")).join(marks, "doc_id", "left")
        held = v.where("vec_id % 50 = 0").select((F.col("vec_id") / 50).cast("long").alias("query_id"), "vector")
        asked = _ask(spark, sf_dir).join(held, "query_id", "left").withColumn("wing", F.when(F.col("query_id") % 2 == 0, "en").otherwise("de"))
        # a question of each kind in turn, and rooms that hold such memories
        asked = asked.withColumn("intent", intent(F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("query_id") % len(QUESTIONS)).cast("int") + 1)))
        rated = rated.withColumn("room", F.element_at(F.array(*map(F.lit, ROOMS)), (F.col("doc_id") % len(ROOMS)).cast("int") + 1))
        first, second = r.first_two(F.col("text"))
        facts = d.select(first.alias("subject"), second.alias("object"), F.col("id").alias("drawer_id")).where("object <> ''")
        names = facts.select(F.col("subject").alias("entity")).distinct()
        found = r.search_all(asked, rated, v.select(F.col("vec_id").alias("id"), "vector"), facts, names, mode, weigh=weigh)
        return found.select("query_id", "rank", "id", "kg", F.round("score", 6).alias("score"))

    return make


def _whole_sql(symbolic, quality, weigh=False):
    """The same search: three ranked lists, fused, raised."""
    factor = """(case when now - filed <= 7 * 86400.0 then 1.25::double else 1 end) * (case when wing = project then 1.15::double else 1 end) * (case when kg then 1.30::double else 1 end)
        * (case when (query_id % 3 = 0 and doc_id % 5 = 0) or (query_id % 3 = 1 and doc_id % 5 in (1, 4)) then 1.25::double else 1 end)"""
    return WITH + "," + _BM25 + r""",
    vq as (select vec_id // 50 as query_id, embedding::double[] as a from embeddings where vec_id % 50 = 0 and vec_id // 50 in (select item_id from benchmark)),
    vs as (select query_id, vec_id as doc_id, round(list_dot_product(a, embedding::double[]), 10) as score from vq, embeddings),
    vr as (select query_id, doc_id, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from vs) where rank <= 100),
    fw as (select id, regexp_extract_all(text, '[\p{L}\p{N}_]{2,}') as w from drawers), fa as (select lower(w[1]) as subject, lower(w[2]) as object, id from fw where len(w) >= 2),
    fn as (select distinct subject as entity from fa), qe as (select distinct query_id, entity from q join fn on entity = term),
    fh as (select query_id, id, count(distinct subject)::double as score from (select subject as entity, subject, id from fa union all select object, subject, id from fa) x join qe using (entity) group by all),
    fr as (select query_id, id, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from fh) where rank <= 50),
    al as (select query_id, id, rank, 1.0::double as w, false as kg from bm where rank <= 100 union all select query_id, id, rank, 1.0, false from vr join drawers using (doc_id) union all select query_id, id, rank, 0.5, true from fr),
    fu as (select query_id, id, sum(w / (60 + rank)) as score, bool_or(kg) as kg from al group by all),
    mk as (select doc_id, max(quality)::double as quality from labels group by 1),
    pl as (select fu.*, d.wing, d.doc_id, epoch(d.filed_at::timestamp)::double as filed, mk.quality, (d.doc_id % 10) / 40.0::double as novelty, case when fu.query_id % 2 = 0 then 'en' else 'de' end as project
        from fu join drawers d on d.id = fu.id left join mk on mk.doc_id = d.doc_id),
    nw as (select *, max(filed) over (partition by query_id) as now from pl),
    rc as (select *, score * (1 + 0.5 * exp(-(now - filed) / 86400 / 90))""" + (" * (case when novelty >= 0.1 then 1 else 0.5 + 0.5 * novelty / 0.1 end)" if weigh else "") + """ as s from nw),
    so as (select *, round(s, 10) as s0, row_number() over (partition by query_id order by round(s, 10) desc, id) as r0 from rc),
    sy as (select *, """ + (f"s0 * (case when r0 > 50 then 1 else {factor} end)" if symbolic else "s") + """ as s1 from so),
    qu as (select *, round(s1""" + (" * (case when quality >= 0.60 then 1.25 when quality >= 0.53 then 1.15 else 1 end)" if quality else "") + """, 10) as s2 from sy),
    ra as (select *, row_number() over (partition by query_id order by s2 desc, id)::int as rank from qu)
    select query_id, rank, id, kg, round(s2, 6) as score from ra where rank <= 10"""


QUERIES = {
    "search_fast": (_whole("fast"), _whole_sql(False, False)),
    "search_standard": (_whole("standard", True), _whole_sql(False, True, True)),
    "search_boosted": (_whole("boosted"), _whole_sql(True, True)),
    "bm25_topk": (lambda s, d: _bm25(s, d).select("query_id", "id", "rank", F.round("score", 6).alias("score")), WITH + "," + _BM25 + " select query_id, id, rank, round(score, 6) as score from bm where rank <= 10"),
    "fts_all": (lambda s, d: r.boolean_match(_ask(s, d), drawers(s, d), "all"), WITH + "," + _ANY + " select query_id, id, n_terms from ma where n_terms = asked"),
    "fts_any": (lambda s, d: r.boolean_match(_ask(s, d), drawers(s, d), "any"), WITH + "," + _ANY + " select query_id, id, n_terms from ma"),
    "dense_topk": (lambda s, d: _dense(s, d).select("query_id", "id", "rank", F.round("score", 5).alias("score")), "with" + _DENSE + " select query_id, id, rank, round(score, 5) as score from dr where rank <= 10"),
    "rrf_fusion": (lambda s, d: _fused(s, d).select("query_id", "id", "rank", F.round("score", 8).alias("score")), _FUSED + """
        select query_id, id, rank, round(score, 8) as score from (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from fu) where rank <= 20"""),
    "boosts": (_boosted, WITH + "," + _BM25 + """,
        h as (select bm.*, d.wing, d.room, epoch(d.filed_at::timestamp)::double as filed from bm join drawers d on d.id = bm.id where rank <= 10),
        f as (select *, (case when (1704067200 + 365 * 86400.0) - filed < 360 * 86400.0 then 1.25 else 1.0 end) * (case when wing = 'en' then 1.15 else 1.0 end) * (case when room = 'src0' then 1.30 else 1.0 end) as factor from h)
        select query_id, id, round(score * (1 + 0.5 * exp(-greatest(0, ((1704067200 + 365 * 86400.0) - filed)::double / 86400) / 90)), 6) as recent, round(factor::double, 6) as factor, round(score * factor::double, 6) as boosted from f"""),
    "hybrid_overlap": (_overlap, WITH + "," + _BM25 + f""",
        h as (select bm.query_id, bm.id, score, list_distinct({_TOKENS.format("b.text")}) as a, {_TOKENS.format("d.text")} as t from bm join drawers d on d.id = bm.id join benchmark b on b.item_id = bm.query_id where rank <= 10),
        o as (select *, case when len(a) = 0 then 0 else len(list_intersect(a, t)) / len(a) end as share from h)
        select query_id, id, round(share, 6) as overlap, round(1 / (1 + score) * (1 - 0.3::double * share), 6) as distance from o"""),
    "recall_at_k": (_recall, WITH + "," + _BM25 + "," + _ANY + """,
        e as (select query_id, id from ma where n_terms = asked), need as (select query_id, count(*) as need from e group by 1),
        t as (select bm.query_id, bm.rank, (e.id is not null)::int as good from bm left join e on e.query_id = bm.query_id and e.id = bm.id where rank <= 10),
        i as (select *, row_number() over (partition by query_id order by good desc, rank) as ideal from t),
        g as (select query_id, sum(good) as found, sum(good / log2(rank + 1)) as dcg, sum(good / log2(ideal + 1)) as best from i group by 1)
        select need.query_id, (coalesce(found, 0) > 0)::int::double as recall_any, (coalesce(found, 0) >= need)::int::double as recall_all, round((coalesce(found, 0) / need)::double, 6) as recall,
               round(case when best > 0 then dcg / best else 0 end::double, 6) as ndcg from need left join g on g.query_id = need.query_id"""),
    "round_robin_merge": (_merge, WITH + "," + _BM25 + """,
        s as (select query_id, wing as store, bm.id, row_number() over (partition by query_id, wing order by score desc, bm.id)::int as ordinal from bm join drawers d on d.id = bm.id where rank <= 20),
        m as (select *, row_number() over (partition by query_id order by ordinal, store, id)::int as rank from s where ordinal <= 10)
        select query_id, rank, store, ordinal, id from m where rank <= 10"""),
    "byte_budget": (_bytes, WITH + "," + _BM25 + """,
        u as (select query_id, rank, bm.id, sum(strlen(text)) over (partition by query_id order by rank rows unbounded preceding)::bigint as used from bm join drawers d on d.id = bm.id where rank <= 10)
        select * from u where used <= 8192"""),
    "info_weight": (_weights, "with" + _DENSE + """
        select query_id, id, rank, round(case when 1 - score >= 0.5 then 1.0 else 0.5 + 0.5 * (1 - score) / 0.5 end::double, 6) as factor from dr where rank <= 20"""),
    "hybrid_search": (lambda s, d: r.search(_ask(s, d), drawers(s, d)).select("query_id", "rank", "id", "wing", "room", F.round("score", 6).alias("score")), _FUSED + """,
        p as (select fu.query_id, fu.id, fu.score, wing, room, epoch(filed_at::timestamp)::double as filed from fu join drawers d on d.id = fu.id),
        n as (select *, round(score * (1 + 0.5 * exp(-((max(filed) over (partition by query_id)) - filed) / 86400 / 90)), 10) as s from p)
        select query_id, rank, id, wing, room, round(s, 6) as score from (select *, row_number() over (partition by query_id order by s desc, id)::int as rank from n) where rank <= 10"""),
}
