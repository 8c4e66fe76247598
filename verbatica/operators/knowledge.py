"""Temporal triples: facts with closed validity intervals as ISO dates; a null end is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lineage import cut


#: Fixed value: the day since which seeded interests hold.
INTERESTS_SINCE = "2025-01-01"


def entity_id(name: Column) -> Column:
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def with_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """entities (id, name, type, properties) with the new ones (name, type, properties); an id that is there is replaced.

    Of several new rows with one id the greatest by name, type and properties stays.
    """
    kept = new.select(entity_id(F.col("name")).alias("id"), F.struct("name", "type", "properties").alias("row")).groupBy("id").agg(F.max("row").alias("row")).select("id", "row.*")
    return entities.select("id", "name", "type", "properties").join(kept.select("id"), "id", "left_anti").unionByName(kept)


def with_names(triples: DataFrame, entities: DataFrame, direction: str = "outgoing") -> DataFrame:
    """Facts with the name and type of the entity at the other end: the object of outgoing, the subject of incoming facts."""
    end = {"outgoing": "object", "incoming": "subject"}[direction]
    return triples.join(entities.select(F.col("id").alias(end), F.col("name").alias("other_name"), F.col("type").alias("other_type")), end)


def seeded(facts: DataFrame) -> DataFrame:
    """(subject, predicate, object, valid_from) of fact rows: key, full_name, birthday, parent, partner and interests, any of them null.

    The subject is the full name, or else the key; keys and the other ends are written with one capital in front.
    """
    def capital(name):
        return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 2**31 - 1)))

    def fact(predicate: str, obj, start):
        return F.struct(F.lit(predicate).alias("predicate"), capital(obj).alias("object"), start.cast("string").alias("valid_from"))

    loves = F.transform(F.coalesce("interests", F.array().cast("array<string>")), lambda x: fact("loves", x, F.lit(INTERESTS_SINCE)))
    kin = F.array(fact("child_of", F.col("parent"), F.col("birthday")), fact("married_to", F.col("partner"), F.lit(None)))
    every = facts.select(entity_id(F.coalesce("full_name", capital(F.col("key")))).alias("subject"), F.explode(F.concat(kin, loves)).alias("f"))
    return every.select("subject", "f.predicate", entity_id(F.col("f.object")).alias("object"), "f.valid_from").where("object is not null and object <> ''").distinct()


def valid_at(day: str | None) -> Column:
    """Both ends of the interval are included."""
    if day is None:
        return F.lit(True)
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))


def of_entity(triples: DataFrame, name: str, as_of: str | None = None, direction: str = "outgoing") -> DataFrame:
    """Facts of an entity, outgoing, incoming or both, valid on a day or ever."""
    held = triples.where(valid_at(as_of))
    out = held.where(F.col("subject") == name).withColumn("direction", F.lit("outgoing"))
    back = held.where(F.col("object") == name).withColumn("direction", F.lit("incoming"))
    return {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]


def of_entities(triples: DataFrame, names: DataFrame, as_of: str | None = None) -> DataFrame:
    """Facts of every entity in names (entity), in both directions; one scan of the triples."""
    held = triples.where(valid_at(as_of)).withColumn("end", F.explode(F.array(F.struct(F.col("subject").alias("entity"), F.lit("outgoing").alias("direction")),
                                                                         F.struct(F.col("object").alias("entity"), F.lit("incoming").alias("direction")))))
    return held.select("end.*", "subject", "predicate", "object", "valid_from", "valid_to", "confidence").join(names, "entity", "left_semi")


def of_relationship(triples: DataFrame, predicate: str, as_of: str | None = None) -> DataFrame:
    return triples.where((F.col("predicate") == predicate) & valid_at(as_of))


def timeline(triples: DataFrame, entity: str | None = None, most: int = 100) -> DataFrame:
    kept = triples.where((F.col("subject") == entity) | (F.col("object") == entity)) if entity else triples
    return kept.orderBy(F.asc_nulls_last("valid_from"), "subject", "predicate", "object", F.asc_nulls_last("valid_to"), "drawer_id").limit(most)


def statistics(triples: DataFrame) -> DataFrame:
    """One row: entities, facts, facts still open, and the sorted predicates."""
    ends = triples.select(F.explode(F.array("subject", "object")).alias("e")).agg(F.lit(1).alias("one"), F.countDistinct("e").alias("n_entities"))
    facts = triples.agg(F.lit(1).alias("one"), F.count("*").alias("n_triples"), F.sum(F.col("valid_to").isNull().cast("long")).alias("n_open"),
                        F.array_join(F.sort_array(F.collect_set("predicate")), ",").alias("predicates"))
    return facts.join(ends, "one").drop("one")  # one row each


def drawers_by_entities(triples: DataFrame, names: list[str] | DataFrame, most: int | None = 50) -> DataFrame:
    """Drawers of facts that name an entity: how many different subjects they have, and the latest extraction; best first."""
    if isinstance(names, DataFrame):
        # a subject and an object of the list may both name one fact; it counts once, as its subject does
        hit = triples.join(names.select(F.col("entity").alias("subject")), "subject", "left_semi").unionByName(
            triples.join(names.select(F.col("entity").alias("object")), "object", "left_semi"))
    else:
        hit = triples.where(F.col("subject").isin(names) | F.col("object").isin(names))
    out = hit.where("drawer_id is not null").groupBy("drawer_id").agg(F.countDistinct("subject").alias("n_subjects"), F.max("extracted_at").alias("latest"))
    return out if most is None else out.orderBy(F.desc("n_subjects"), F.desc("latest"), "drawer_id").limit(most)


def with_triple(triples: DataFrame, subject: str, predicate: str, obj: str, valid_from: str | None = None, **rest: object) -> DataFrame:
    """triples with the fact, unless it is there and still open."""
    spark = triples.sparkSession
    values = {"subject": subject, "predicate": predicate, "object": obj, "valid_from": valid_from, "valid_to": None, "confidence": 1.0, **rest}
    new = spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in triples.schema.fields])
    there = triples.where((F.col("subject") == subject) & (F.col("predicate") == predicate) & (F.col("object") == obj) & F.col("valid_to").isNull())
    return triples.unionByName(new.join(there.select("subject", "predicate", "object").distinct(), ["subject", "predicate", "object"], "left_anti").select(*triples.columns))


def invalidated(triples: DataFrame, subject: str, predicate: str, obj: str, ended: str) -> DataFrame:
    """triples, the open fact closed on a day."""
    hit = (F.col("subject") == subject) & (F.col("predicate") == predicate) & (F.col("object") == obj) & F.col("valid_to").isNull()
    return triples.withColumn("valid_to", F.when(hit, F.lit(ended)).otherwise(F.col("valid_to")))


def conflicts(claims: DataFrame, triples: DataFrame, today: str) -> DataFrame:
    """Claims (subject, predicate, object) about a known pair under another predicate, or only under closed facts."""
    known = triples.groupBy("subject", "object").agg(
        F.sort_array(F.collect_set("predicate")).alias("known"),
        F.max((F.col("valid_to").isNull() | (F.col("valid_to") >= today)).cast("int")).alias("current"))
    return (claims.join(known, ["subject", "object"]).select(
        "subject", "predicate", "object",
        F.when(~F.array_contains("known", F.col("predicate")), "relationship_mismatch").when(F.col("current") == 0, "stale_fact").alias("conflict"))
        .where("conflict is not null"))


#: Names that are broadcast at a time.
NAMES = 500_000


def mentions(drawers: DataFrame, names: DataFrame) -> DataFrame:
    """(name, drawer_id, n): how often each name (one word) stands in each drawer.

    Names are written once and broadcast in blocks of bounded size; only words that are names are counted and shuffled.
    """
    known = cut(names.select("name").where("name is not null").distinct(), "names")
    blocks = max(1, -(-known.count() // NAMES))
    words = drawers.select(F.col("id").alias("drawer_id"), F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))).alias("name"))
    out = None
    for b in range(blocks):
        few = known if blocks == 1 else known.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b)
        met = words.join(F.broadcast(few), "name", "left_semi").groupBy("name", "drawer_id").agg(F.count("*").alias("n"))
        out = met if out is None else out.unionByName(met)
    return out


def pending(ids: DataFrame, done: DataFrame, scanned: DataFrame) -> DataFrame:
    """Ids (id) not yet done or scanned."""
    return ids.join(done.select("id").union(scanned.select("id")), "id", "left_anti")
