"""Queries over the temporal triples, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knowledge as kg
from ..sources.tables import TRIPLES_SQL, table, triples

WITH = "with" + TRIPLES_SQL
_VALID = "(valid_from is null or valid_from <= '{0}') and (valid_to is null or valid_to >= '{0}')"
_DAY = "1996-06-01"
_FACT = "subject, predicate, object, valid_from, valid_to, round(confidence, 6) as confidence"


def _q(make):
    return lambda spark, sf_dir: make(triples(spark, sf_dir))


def _fact(df, *more):
    return df.select(*more, "subject", "predicate", "object", "valid_from", "valid_to", F.round("confidence", 6).alias("confidence"))


def _few(spark, sf_dir):
    """Entities of interest: the customers and parts whose key is divisible by 50."""
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    return c.where("c_custkey % 50 = 0").select(F.concat(F.lit("customer_"), "c_custkey").alias("entity")).union(p.where("p_partkey % 50 = 0").select(F.concat(F.lit("part_"), "p_partkey").alias("entity")))


_FEW = "few as (select 'customer_' || c_custkey as entity from customer where c_custkey % 50 = 0 union all select 'part_' || p_partkey from part where p_partkey % 50 = 0)"


def _conflicts(spark, sf_dir):
    facts = triples(spark, sf_dir)
    claims = facts.where("predicate = 'ordered'").select("subject", F.lit("urgently_ordered").alias("predicate"), "object").distinct()
    return kg.conflicts(claims, facts, "1998-01-01")


def _pending(spark, sf_dir):
    facts = triples(spark, sf_dir).select(F.col("drawer_id").alias("id"), "predicate", "valid_to").distinct()
    return kg.pending(facts.select("id").distinct(), facts.where("predicate = 'urgently_ordered'"), facts.where("valid_to is null"))


def _closed(facts):
    open_ = facts.where("valid_to is null").agg(F.min(F.struct("subject", "predicate", "object")).alias("f")).first()["f"]
    return facts if open_ is None else kg.invalidated(facts, open_["subject"], open_["predicate"], open_["object"], "1999-01-01")


QUERIES = {
    "kg_outgoing": (_q(lambda t: _fact(kg.of_entity(t, "customer_7"))), WITH + f" select {_FACT} from triples where subject = 'customer_7'"),
    "kg_incoming": (_q(lambda t: _fact(kg.of_entity(t, "part_7", direction="incoming"))), WITH + f" select {_FACT} from triples where object = 'part_7'"),
    "kg_as_of": (_q(lambda t: _fact(kg.of_relationship(t, "urgently_ordered", _DAY))), WITH + f" select {_FACT} from triples where predicate = 'urgently_ordered' and " + _VALID.format(_DAY)),
    "kg_entities_both": (lambda spark, sf_dir: _fact(kg.of_entities(triples(spark, sf_dir), _few(spark, sf_dir), _DAY), "entity", "direction"), WITH + "," + _FEW + f"""
        select entity, 'outgoing' as direction, {_FACT} from triples join few on subject = entity where {_VALID.format(_DAY)}
        union all select entity, 'incoming' as direction, {_FACT} from triples join few on object = entity where {_VALID.format(_DAY)}"""),
    "kg_relationship": (_q(lambda t: kg.of_relationship(t, "ordered").groupBy("subject").agg(F.count("*").alias("n"), F.countDistinct("object").alias("n_objects"))), WITH + """
        select subject, count(*) as n, count(distinct object) as n_objects from triples where predicate = 'ordered' group by subject"""),
    "kg_timeline": (_q(lambda t: kg.timeline(t).select("subject", "predicate", "object", "valid_from", "valid_to", "drawer_id")), WITH + """
        select subject, predicate, object, valid_from, valid_to, drawer_id from triples order by valid_from nulls last, subject, predicate, object, valid_to nulls last, drawer_id limit 100"""),
    "kg_stats": (_q(kg.statistics), WITH + """
        select count(*) as n_triples, sum((valid_to is null)::int)::bigint as n_open, (select string_agg(distinct predicate, ',' order by predicate) from triples) as predicates,
               (select count(distinct e) from (select subject as e from triples union all select object from triples)) as n_entities from triples"""),
    "kg_drawers_by_entities": (lambda spark, sf_dir: kg.drawers_by_entities(triples(spark, sf_dir), _few(spark, sf_dir), None), WITH + "," + _FEW + """
        select drawer_id, count(distinct subject) as n_subjects, max(extracted_at) as latest from triples where subject in (select entity from few) or object in (select entity from few) group by drawer_id"""),
    "kg_stale_facts": (_conflicts, WITH + """,
        c as (select distinct subject, 'urgently_ordered' as predicate, object from triples where predicate = 'ordered'),
        k as (select subject, object, bool_or(predicate = 'urgently_ordered') as same, bool_or(valid_to is null or valid_to >= '1998-01-01') as fresh from triples group by all)
        select c.subject, c.predicate, c.object, case when not same then 'relationship_mismatch' else 'stale_fact' end as conflict from c join k on c.subject = k.subject and c.object = k.object where not same or not fresh"""),
    "kg_invalidate": (_q(lambda t: _closed(t).groupBy("predicate").agg(F.count("*").alias("n"), F.sum(F.col("valid_to").isNull().cast("long")).alias("n_open"), F.max("valid_to").alias("last"))), WITH + """,
        f as (select min((subject, predicate, object)) as f from triples where valid_to is null),
        u as (select predicate, case when valid_to is null and (subject, predicate, object) = (select f from f) then '1999-01-01' else valid_to end as valid_to from triples)
        select predicate, count(*) as n, sum((valid_to is null)::int)::bigint as n_open, max(valid_to) as last from u group by predicate"""),
    "pending_antijoin": (_pending, WITH + """
        select distinct drawer_id as id from triples where drawer_id not in (select drawer_id from triples where predicate = 'urgently_ordered' or valid_to is null)"""),
    "kg_two_way_join": (lambda spark, sf_dir: _roles(spark, sf_dir), """
        select cn.n_name as customer_nation, sn.n_name as supplier_nation, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
        join nation cn on c_nationkey = cn.n_nationkey join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey group by all"""),
}


def _roles(spark, sf_dir):
    """The same dimension twice, in two roles; nations are 25 rows, and AQE broadcasts by measured size."""
    t = lambda name: table(spark, sf_dir, name)
    nation = t("nation")
    to = t("customer").join(nation, F.col("c_nationkey") == nation.n_nationkey).select("c_custkey", F.col("n_name").alias("customer_nation"))
    by = t("supplier").join(nation, F.col("s_nationkey") == nation.n_nationkey).select("s_suppkey", F.col("n_name").alias("supplier_nation"))
    return (t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(to, F.col("o_custkey") == F.col("c_custkey")).join(by, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("customer_nation", "supplier_nation").agg(F.count("*").alias("n")))
