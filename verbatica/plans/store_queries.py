"""The stored index, reranking and reconciliation over the given tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import retrieval as r
from ..operators.index import Index
from ..operators.reconcile import Inventory, audit, differences
from ..operators.rerank import WordOverlap, reranked
from ..sources.tables import drawers, table
from .lineage import cut, shared_dir
from .retrieval_queries import WITH, _ask, _BM25


def _place(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _indexed(spark, sf_dir):
    """An index of half of the drawers, to which the others are added; some are then deleted, some get other texts."""
    d = drawers(spark, sf_dir)
    index = Index(spark, _place(spark, "index"))
    index.add(d.where("doc_id % 2 = 0").select("id", "text"))
    index.add(d.where("doc_id % 2 = 1").select("id", "text"))
    index.delete(d.where("doc_id % 11 = 0").select("id"))
    index.add(d.where("doc_id % 13 = 0").select("id", F.concat("text", F.lit(" "), "room").alias("text")))
    return index


def _search(spark, sf_dir):
    return _indexed(spark, sf_dir).search(_ask(spark, sf_dir)).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def _reranked(spark, sf_dir):
    d, asked = drawers(spark, sf_dir).select("id", "text"), _ask(spark, sf_dir)
    return reranked(cut(r.bm25(asked, d, 20), "hits"), asked, d, WordOverlap, 5).select("query_id", "id", "rank", "was", F.round("score", 6).alias("score"))


def _inventories(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    ours, theirs = Inventory(spark, _place(spark, "ours")), Inventory(spark, _place(spark, "theirs"))
    ours.write(docs.where("doc_id % 97 > 0"), "doc_id", ["doc_id", "text", "lang"])
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 89 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    theirs.write(changed.where("doc_id % 101 > 0").unionByName(docs.where("doc_id % 103 = 0")), "doc_id", ["doc_id", "text", "lang"])
    return differences(ours, theirs)


def _audited(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat("conv_id", F.lit("/"), "turn").alias("key"), "role", F.col("conv_id").alias("c"))
    attempts = c.where("c % 17 > 0").select("key", F.when(F.col("role") == "system", "gap").otherwise("indexed").alias("outcome"))
    return audit(attempts, c.where("role <> 'system' and c % 19 > 0 or c % 23 = 0").select("key"), c.where("role = 'system' or c % 29 = 0").select("key"))


_CHANGED = WITH.replace("documents)", "documents where doc_id % 11 > 0 or doc_id % 13 = 0)").replace("coalesce(text, '') as text", "coalesce(text, '') || case when doc_id % 13 = 0 then ' ' || coalesce(source, '') else '' end as text")
_OVERLAP = r"""
h as (select bm.query_id, bm.id, bm.rank as was, regexp_extract_all(lower(coalesce(b.text, '')), '[\p{L}\p{N}_]{2,}') as a, regexp_extract_all(lower(d.text), '[\p{L}\p{N}_]{2,}') as t
      from bm join benchmark b on b.item_id = bm.query_id join drawers d on d.id = bm.id where rank <= 20),
p as (select *, list_transform(a[:-2], lambda x, i: x || ' ' || a[i + 1]) as ap, list_transform(t[:-2], lambda x, i: x || ' ' || t[i + 1]) as tp from h),
o as (select *, case when len(a) = 0 then 0 else (len(list_intersect(list_distinct(a), t)) + len(list_intersect(list_distinct(ap), tp))) / (len(list_distinct(a)) + len(list_distinct(ap))) end as score from p)"""

QUERIES = {
    "indexed_search": (_search, _CHANGED + "," + _BM25 + " select query_id, id, rank, round(score, 6) as score from bm where rank <= 10"),
    "reranked_search": (_reranked, WITH + "," + _BM25 + "," + _OVERLAP + """
        select query_id, id, rank, was, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, was, id)::int as rank from o) where rank <= 5"""),
    "inventory_differences": (_inventories, """
        with d as (select doc_id, coalesce(text, '') as text, lang from documents where doc_id is not null), a as (select * from d where doc_id % 97 > 0),
        b as (select doc_id, case when doc_id % 89 = 0 then text || '!' else text end as text, lang from d where doc_id % 101 > 0 union all select * from d where doc_id % 103 = 0),
        x as (select doc_id, count(*) as n, list_sort(list(sha256(text || chr(1) || coalesce(lang, chr(2))))) as s from a group by 1), y as (select doc_id, count(*) as n, list_sort(list(sha256(text || chr(1) || coalesce(lang, chr(2))))) as s from b group by 1)
        select coalesce(x.doc_id, y.doc_id)::varchar as key, case when x.n is null then 'missing_ours' when y.n is null then 'missing_theirs' else 'changed' end as status, coalesce(x.n, 0) as n_ours, coalesce(y.n, 0) as n_theirs
        from x full join y on x.doc_id = y.doc_id where x.s is distinct from y.s"""),
    "receipt_audit": (_audited, """
        with c as (select conv_id || '/' || turn as key, role, conv_id as c from conversations), t as (select key, count(*) as n, min(case when role = 'system' then 'gap' else 'indexed' end) as outcome from c where c % 17 > 0 group by 1),
        o as (select key, count(*) as n from c where role <> 'system' and c % 19 > 0 or c % 23 = 0 group by 1), g as (select key, count(*) as n from c where role = 'system' or c % 29 = 0 group by 1),
        k as (select key from t union select key from o union select key from g),
        m as (select k.key, outcome, coalesce(t.n, 0) as n, coalesce(case when outcome = 'indexed' then o.n else g.n end, 0) as wanted, coalesce(case when outcome = 'indexed' then g.n else o.n end, 0) as other from k left join t using (key) left join o using (key) left join g using (key))
        select key, outcome, fault from (select *, case when n = 0 then 'unexpected' when n > 1 or wanted > 1 or other > 1 then 'doubled' when other > 0 then 'contradicted' when wanted = 0 then 'missing' end as fault from m) where fault is not null"""),
}
