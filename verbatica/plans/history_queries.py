"""Queries over captured history, named entities and the novelty tools, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, information as info, knowledge as kg, retrieval
from ..sources.tables import DRAWERS_SQL, TRIPLES_SQL, drawers, table, triples, vectors
from .information_queries import _NOVELTY, EDGES


def _turns(spark, sf_dir):
    """Turns of conversations as chunks: cursor_key, identity (the conversation), role, text."""
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("cursor_key"), F.col("conv_id").cast("string").alias("identity"), "role", "text")


_TURNS = "turns as (select conv_id::varchar || '-' || turn::varchar as cursor_key, conv_id::varchar as identity, role, text from conversations)"


def _sides(spark, sf_dir):
    """Attempts are the user's turns, occurrences the texts of at least 200 characters, gaps the shorter and missing ones."""
    t = _turns(spark, sf_dir)
    attempts = t.where("role = 'user'").select("cursor_key", F.lit("stored").alias("outcome"))
    occurrences = t.where("char_length(text) >= 200").select("cursor_key", F.sha2("text", 256).alias("occurrence"))
    gaps = t.where("text is null or char_length(text) < 200").select("cursor_key", F.col("role").alias("gap"))
    return attempts, occurrences, gaps


_SIDES = "with " + _TURNS + """,
    a as (select cursor_key, 'stored' as outcome from turns where role = 'user'), o as (select cursor_key, sha256(text) as occurrence from turns where length(text) >= 200),
    g as (select cursor_key, role as gap from turns where text is null or length(text) < 200)"""


def _scoped(spark, sf_dir):
    d = drawers(spark, sf_dir)
    sources = d.groupBy(F.col("source_file").alias("source_key")).agg(F.max("filed_at").alias("generation"))
    return history.scoped_chunks(d.select(F.col("id").alias("chunk_id"), F.col("source_file").alias("source_key"), F.col("wing").alias("workspace")),
                                 d.select(F.col("id").alias("chunk_id"), F.sha2("text", 256).alias("text_hash")), sources)


def _occurrences(spark, sf_dir):
    """One row a conversation, with its turns as a JSON array; a conversation is a bounded group."""
    return _turns(spark, sf_dir).groupBy("identity").agg(F.to_json(F.sort_array(F.collect_list("cursor_key"))).alias("ids"), F.count("*").alias("n"))


def _candidates(spark, sf_dir):
    """Turns of conversations of four turns or more (by JSON array) or with a text of 600 characters (by bridge)."""
    t = _turns(spark, sf_dir).withColumnRenamed("cursor_key", "chunk_id")
    by_array = history.members(_occurrences(spark, sf_dir).where("n >= 4"))
    by_bridge = history.bridged(t.where("char_length(text) >= 600").select("identity").distinct(), t)
    return history.candidates(t, by_array, by_bridge).select("chunk_id", "identity", "role")


def _entities(spark, sf_dir):
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    named = lambda df, kind, key, more: df.select(F.concat(F.lit(kind + " "), key).alias("name"), F.lit(kind.lower()).alias("type"), F.col(more).alias("properties"))
    both = named(c, "Customer", "c_custkey", "c_mktsegment").unionByName(named(p, "Part", "p_partkey", "p_brand"))
    return both.select(kg.entity_id(F.col("name")).alias("id"), "name", "type", "properties")


_ENTITIES = """ent as (select 'customer_' || c_custkey as id, 'Customer ' || c_custkey as name, 'customer' as type, c_mktsegment as properties from customer
    union all select 'part_' || p_partkey, 'Part ' || p_partkey, 'part', p_brand from part)"""


def _added(spark, sf_dir):
    """Customers of one segment are filed again under another type, and nations come in new."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    new = c.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("Customer "), "c_custkey").alias("name"), F.lit("builder").alias("type"), F.lit("{}").alias("properties")).unionByName(
        n.select(F.col("n_name").alias("name"), F.lit("nation").alias("type"), F.lit("{}").alias("properties")))
    return kg.with_entities(_entities(spark, sf_dir), new)


def _seeded(spark, sf_dir):
    """Suppliers as fact rows: the nation is the parent, the region an interest."""
    s, n, r = (table(spark, sf_dir, name) for name in ("supplier", "nation", "region"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return kg.seeded(rows.select(F.concat(F.lit("supplier "), "s_suppkey").alias("key"), F.lit(None).cast("string").alias("full_name"), F.lit(None).cast("string").alias("birthday"),
                                 F.col("n_name").alias("parent"), F.lit(None).cast("string").alias("partner"), F.array("r_name").alias("interests")))


def _ends(spark, sf_dir, direction):
    return kg.with_names(triples(spark, sf_dir), _entities(spark, sf_dir), direction).groupBy("other_name", "other_type").agg(F.count("*").alias("n"), F.countDistinct("predicate").alias("n_predicates"))


def _rows(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("wing").alias("grp"), "filed", "vector")


def _backfilled(spark, sf_dir):
    """Rows of one wing are tagged already."""
    rows = _rows(spark, sf_dir)
    return info.backfilled(rows, rows.where("grp = '1'").select("id", F.lit(0.5).alias("novelty"))).select("id", F.round("novelty", 5).alias("novelty"), "tagged")


def _score(spark, sf_dir):
    v = vectors(spark, sf_dir)
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return info.scored_novelty(asked, retrieval.dense(asked, v.select(F.col("vec_id").alias("id"), "vector"), 5)).select("query_id", F.round("novelty", 5).alias("novelty"), "band")


def _variance(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return info.variance_per_bin(both, "n_chars", "quality", 100).select("start", F.round("variance", 6).alias("variance"))


def _reconciled(spark, sf_dir):
    attempts, occurrences, gaps = _sides(spark, sf_dir)
    return history.reconciled(attempts, occurrences, gaps)


def _gaps(spark, sf_dir):
    attempts, occurrences, gaps = _sides(spark, sf_dir)
    return history.reconciled(gaps, attempts, occurrences)


QUERIES = {
    "capture_join": (_scoped, "with" + DRAWERS_SQL + """
        select d.id as chunk_id, d.source_file as source_key, d.wing as workspace, sha256(d.text) as text_hash, g.generation
        from drawers d join (select source_file, max(filed_at) as generation from drawers group by 1) g on g.source_file = d.source_file"""),
    "history_members": (lambda s, d: history.members(_occurrences(s, d)), "with " + _TURNS + " select identity, cursor_key as chunk_id from turns"),
    "history_candidates": (_candidates, "with " + _TURNS + """
        select cursor_key as chunk_id, identity, role from turns where identity in (select identity from turns group by 1 having count(*) >= 4) or identity in (select identity from turns where length(text) >= 600)"""),
    "reconcile_attempts": (_reconciled, _SIDES + " select a.cursor_key, outcome, occurrence, gap from a left join o on o.cursor_key = a.cursor_key left join g on g.cursor_key = a.cursor_key"),
    "reconcile_gaps": (_gaps, _SIDES + " select g.cursor_key, gap, outcome, occurrence from g left join a on a.cursor_key = g.cursor_key left join o on o.cursor_key = g.cursor_key"),
    "kg_entities_added": (_added, "with " + _ENTITIES + """,
        new as (select 'customer_' || c_custkey as id, 'Customer ' || c_custkey as name, 'builder' as type, '{}' as properties from customer where c_mktsegment = 'BUILDING'
                union all select replace(replace(lower(n_name), ' ', '_'), '''', ''), n_name, 'nation', '{}' from nation)
        select * from ent where id not in (select id from new) union all select * from new"""),
    "kg_named_outgoing": (lambda s, d: _ends(s, d, "outgoing"), "with" + TRIPLES_SQL + "," + _ENTITIES + " select name as other_name, type as other_type, count(*) as n, count(distinct predicate) as n_predicates from triples join ent on ent.id = object group by all"),
    "kg_named_incoming": (lambda s, d: _ends(s, d, "incoming"), "with" + TRIPLES_SQL + "," + _ENTITIES + " select name as other_name, type as other_type, count(*) as n, count(distinct predicate) as n_predicates from triples join ent on ent.id = subject group by all"),
    "kg_seeded": (_seeded, """
        with b as (select 'supplier_' || s_suppkey as subject, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
        select subject, 'child_of' as predicate, replace(lower(n_name), ' ', '_') as object, null::varchar as valid_from from b union all select subject, 'loves', replace(lower(r_name), ' ', '_'), '2025-01-01' from b"""),
    "novelty_backfill": (_backfilled, "with" + _NOVELTY + " select id, case when grp = '1' then 0.5::double else round(novelty, 5) end as novelty, grp <> '1' as tagged from nv"),
    "novelty_of_queries": (_score, """
        with d as (select a.vec_id as query_id, round(1 - max(list_dot_product(a.embedding::double[], b.embedding::double[])), 5) as novelty from embeddings a join embeddings b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id group by 1)
        select query_id, novelty, case when novelty < 0.1 then 'low' when novelty < 0.5 then 'medium' else 'high' end as band from d"""),
    "novelty_pooled": (lambda s, d: info.pooled(info.histogram(info.novelty(_rows(s, d)), "novelty", EDGES, "grp")), "with" + _NOVELTY + """
        select case when novelty >= 1 then 20 else greatest(0, (select count(*) from (values """ + ", ".join(f"({e}::double)" for e in EDGES[1:-1]) + """) t(e) where novelty >= e)) end::int as bin, count(*) as n from nv group by all"""),
    "variance_per_bin": (_variance, """
        with b as (select n_chars as x, quality as v from documents join labels using (doc_id) where n_chars is not null and quality is not null), m as (select min(x) as low, max(x) as high from b),
        s as (select unnest(generate_series(low::bigint, high::bigint, 100)) as start from m), v as (select low + (x - low) // 100 * 100 as start, var_samp(v) as variance, count(*) as n from b, m group by 1)
        select s.start, round(case when n > 1 then variance else 1.0 end::double, 6) as variance from s left join v on v.start = s.start"""),
}
