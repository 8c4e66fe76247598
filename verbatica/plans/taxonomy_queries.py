"""Queries over the taxonomy and the graph of rooms, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, graph, taxonomy
from ..sources.tables import DRAWERS_SQL, drawers, table

WITH = "with" + DRAWERS_SQL


def _q(make):
    return lambda spark, sf_dir: make(drawers(spark, sf_dir))


_FILTER = {"$or": [{"wing": "en", "chunk_index": {"$lte": 2}}, {"$and": [{"wing": {"$in": ["de", "fr"]}}, {"room": {"$ne": "src0"}}, {"filed_at": {"$gt": "2024-01-03T00:00:00"}}]}]}
_NODES = """
g as (select room, array_to_string(list_sort(list(distinct wing)), ',') as wings, list_sort(list(distinct wing)) as wl, list_sort(list(distinct hall)) as hl, count(*) as n,
      list_sort(list(distinct substr(filed_at, 1, 10))) as ds from drawers where room not in ('', 'general') and wing <> '' group by room)"""

QUERIES = {
    "status_counts": (_q(taxonomy.counts), WITH + """
        select case when grouping(wing, room) = 3 then 'total' when grouping(wing, room) = 1 then 'wing' when grouping(wing, room) = 2 then 'room' else 'wing_room' end as level,
               wing, room, count(*) as n from (select case when wing = '' then 'unknown' else wing end as wing, case when room = '' then 'unknown' else room end as room from drawers)
        group by cube(wing, room)"""),
    "list_wings": (_q(taxonomy.wings), WITH + " select case when wing = '' then 'unknown' else wing end as wing, count(*) as n from drawers group by all"),
    "list_rooms": (_q(lambda d: taxonomy.rooms(d, "en")), WITH + " select case when room = '' then 'unknown' else room end as room, count(*) as n from drawers where wing = 'en' group by all"),
    "taxonomy": (_q(lambda d: taxonomy.taxonomy(d).select("wing", F.array_join(F.transform(F.map_entries("rooms"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("rooms"))), WITH + """
        select wing, string_agg(room || '=' || n::varchar, ',' order by room) as rooms from (select case when wing = '' then 'unknown' else wing end as wing,
          case when room = '' then 'unknown' else room end as room, count(*) as n from drawers group by all) group by wing"""),
    "text_sizes": (_q(taxonomy.text_sizes), WITH + """
        select wing, count(*) as n, count(distinct room) as n_rooms, sum(length(text))::bigint as chars, round(quantile_cont(length(text), 0.25), 6) as p25, round(quantile_cont(length(text), 0.5), 6) as median,
               round(quantile_cont(length(text), 0.75), 6) as p75, round(quantile_cont(length(text), 0.9), 6) as p90 from drawers group by wing"""),
    "source_groups": (_q(lambda d: taxonomy.source_groups(d, 5, "1")), WITH + """
        select source_file, count(*) as n, max(length(text))::bigint as longest from drawers where contains(source_file, '1') group by source_file having count(*) >= 5"""),
    "list_drawers_page": (_q(lambda d: taxonomy.listing(d, "en", None, "drawer_en_src1", 50)), WITH + """
        select id, wing, room, substring(text, 1, 200) as preview from drawers where wing = 'en' and id > 'drawer_en_src1' order by id limit 50"""),
    "filter_algebra": (_q(lambda d: d.where(filters.where(_FILTER)).select("id", "wing", "room", "chunk_index")), WITH + """
        select id, wing, room, chunk_index from drawers where (wing = 'en' and chunk_index <= 2) or (wing in ('de', 'fr') and room <> 'src0' and filed_at > '2024-01-03T00:00:00')"""),
    "text_filter": (_q(lambda d: d.where(filters.where_text({"$contains": "_%", "$not_contains": "zzz"}) | filters.where_text({"$contains": "MIT"})).select("id")), WITH + """
        select id from drawers where (contains(text, '_%') and not contains(text, 'zzz')) or contains(text, 'MIT')"""),
    "wake_up": (_q(taxonomy.wake_up), WITH + """,
        t as (select id, room, importance, filed_at, substring(text, 1, 200) as snippet from drawers order by importance desc, filed_at desc, id limit 15)
        select * from (select *, sum(length(snippet)) over (order by importance desc, filed_at desc, id rows unbounded preceding)::bigint as used from t) where used <= 3200"""),
    "neighbor_expand": (_q(lambda d: taxonomy.neighbours(d, d.where("doc_id % 50 = 0")).select("id", "n_chunks", F.sha2("context", 256).alias("context_sha256"))), WITH + """,
        m as (select * from drawers where doc_id % 50 = 0)
        select m.id, count(*) as n_chunks, sha256(string_agg(d.text, chr(10) || chr(10) order by d.chunk_index)) as context_sha256
        from m join drawers d on d.source_file = m.source_file and d.chunk_index between m.chunk_index - 1 and m.chunk_index + 1 group by m.id"""),
    "diary_last_n": (_q(lambda d: taxonomy.latest(d, "room", 10)), WITH + """
        select room, place, id, filed_at from (select room, row_number() over (partition by room order by filed_at desc, id) as place, id, filed_at from drawers) where place <= 10"""),
    "graph_nodes": (_q(lambda d: graph.nodes(d).select("room", F.array_join("wings", ",").alias("wings"), F.array_join("halls", ",").alias("halls"), "n", F.array_join("dates", ",").alias("dates"))), WITH + "," + _NODES + """
        select room, wings, array_to_string(hl, ',') as halls, n, array_to_string(ds[-5:], ',') as dates from g"""),
    "graph_edges": (_q(lambda d: graph.edges(graph.nodes(d))), WITH + "," + _NODES + """,
        w as (select room, n, unnest(wl) as wing, hl from g), h as (select room, n, wing, unnest(hl) as hall from w)
        select a.room, a.wing as wing_a, b.wing as wing_b, a.hall, a.n from h a join w b on a.room = b.room and a.wing < b.wing"""),
    "tunnels": (_q(lambda d: graph.tunnels(graph.nodes(d), "en", "de").select("room", F.array_join("wings", ",").alias("wings"), "n", "last_date")), WITH + "," + _NODES + """
        select room, wings, n, ds[-1] as last_date from g where len(wl) >= 2 and list_contains(wl, 'en') and list_contains(wl, 'de') order by n desc, room limit 50"""),
    "graph_stats": (_q(lambda d: graph.statistics(graph.nodes(d))), WITH + "," + _NODES + """
        select wing, count(*) as n_rooms, sum((len(wl) >= 2)::int)::bigint as n_tunnel_rooms, sum((len(wl) - 1) * len(hl))::bigint as n_edges from (select unnest(wl) as wing, wl, hl from g) group by wing"""),
    "traverse_2hop": (_q(lambda d: graph.traverse(graph.nodes(d), "src3")), WITH + "," + _NODES + """,
        p as (select room, n, unnest(wl) as wing from g),
        h1 as (select distinct b.room from p a join p b on a.wing = b.wing where a.room = 'src3' and b.room <> 'src3'),
        h2 as (select distinct b.room from p a join p b on a.wing = b.wing where a.room in (select room from h1) and b.room not in (select room from h1) and b.room <> 'src3'),
        s as (select 'src3' as room, 0 as hop union all select room, 1 from h1 union all select room, 2 from h2)
        select s.room, hop, n from s join g on g.room = s.room order by hop, n desc, s.room limit 50"""),
    "topic_tunnels": (_q(lambda d: graph.topic_tunnels(d.select("wing", F.col("room").alias("topic")), 2)), WITH + """,
        t as (select distinct wing, lower(trim(room)) as topic from drawers where trim(room) <> ''),
        s as (select a.wing as wing_a, b.wing as wing_b, a.topic from t a join t b on a.topic = b.topic and a.wing < b.wing)
        select wing_a, wing_b, topic, substr(sha256(least(wing_a || '/' || topic, wing_b || '/' || topic) || '<->' || greatest(wing_a || '/' || topic, wing_b || '/' || topic)), 1, 16) as id
        from (select *, count(*) over (partition by wing_a, wing_b) as c from s) where c >= 2"""),
    "explicit_tunnels": (lambda spark, sf_dir: _tunnels(spark, sf_dir), """
        select wing_a, room_a, wing_b, room_b, count(*) as n from (select c.role as wing_a, 'talk' as room_a, coalesce(d.lang, '') as wing_b, coalesce(d.source, '') as room_b
        from conversations c join documents d on c.conv_id = d.doc_id) group by all"""),
}


def _tunnels(spark, sf_dir):
    talks, docs = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "documents")
    both = talks.join(docs, talks.conv_id == docs.doc_id)
    return both.groupBy(F.col("role").alias("wing_a"), F.lit("talk").alias("room_a"), F.coalesce("lang", F.lit("")).alias("wing_b"), F.coalesce("source", F.lit("")).alias("room_b")).agg(F.count("*").alias("n"))
