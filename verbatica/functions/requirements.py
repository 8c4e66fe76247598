"""Requirement tools: extraction from Markdown, nouns, diagnosis, references between requirements, actors and what they do, overall score.

A text's requirements are an array in its row; only the rows of references and entities leave it, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .quality import COORDINATING, HARD, NEGATIONS, REQUIREMENT_ID, SOFT, SUBORDINATING, WORD, _count, _of, readability, words
from .text import once

#: Actors, verbs and objects of requirements, first words of a scenario's steps, endings of nouns, the shortest requirement.
ACTORS = ["user", "admin", "system", "customer", "client", "operator", "manager", "developer", "tester", "application", "service", "module", "component", "interface", "database", "server"]
VERBS = ["validate", "verify", "check", "confirm", "ensure", "create", "generate", "produce", "build", "make", "update", "modify", "change", "edit", "revise", "delete", "remove", "destroy", "clear", "purge",
         "display", "show", "present", "render", "visualize", "send", "transmit", "emit", "notify", "alert", "store", "save", "persist", "record", "log", "retrieve", "fetch", "get", "load", "read",
         "process", "handle", "manage", "execute", "perform", "allow", "enable", "permit", "authorize", "grant", "prevent", "block", "deny", "reject", "refuse"]
OBJECTS = ["data", "information", "record", "entry", "item", "element", "file", "document", "report", "form", "template", "message", "notification", "alert", "email", "request", "response",
           "user", "account", "profile", "session", "credential", "password", "input", "output", "result", "value", "status", "state", "button", "page", "screen", "view", "dialog", "menu",
           "error", "warning", "confirmation", "feedback"]
STEPS = ["Given", "When", "Then", "And", "But"]
NOUN_ENDINGS = ["tion", "ment", "ness", "ity", "er", "or", "ist"]
SHORTEST = 11
#: Where each part of the cognitive load is full, and the weights of the overall score.
LOADS = {"sentence": 30, "word": 2.5, "concepts": 0.3, "coordination": 10, "subordination": 10, "negation": 5}
OVERALL = {"readability": 0.3, "structure": 0.4, "cognitive": 0.3}

IDENTIFIED = r"(?:FR|REQ|NFR)-\d"
BULLET = r"(?s)^\s*[-*+]\s+(.+)$"
STEP = r"(?s)^\s*(?:" + "|".join(STEPS) + r")\s+(.+)$"
SENTENCE_END = r"(?<!\d)[.!?]+(?=\s|$)"


def extracted(text: Column) -> Column:
    """The different requirements of a Markdown text: lines with an id, then bullets, then steps of scenarios; sentences if there are none of these.

    Code blocks and comments don't count; what has ten characters or fewer is left out; a null text has none.
    """
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?```", ""), r"(?s)<!--.*?-->", "")
    held = lambda lines, pattern: F.filter(F.transform(lines, lambda s: F.regexp_extract(s, pattern, 1)), lambda s: s != "")
    marked = lambda lines: F.concat(F.filter(lines, lambda s: s.rlike(IDENTIFIED)), held(lines, BULLET), held(lines, STEP))
    items = lambda b: once(once(F.split(b, "\n"), marked), lambda m: F.when(F.size(m) > 0, m).otherwise(F.split(b, SENTENCE_END)))  # noqa: E731  # a line feed ends a line, and nothing else does
    return _told(once(bare, items))


def _told(items: Column) -> Column:
    """Each item once, trimmed, without the short ones."""
    return F.array_distinct(F.filter(F.transform(items, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.char_length(s) >= SHORTEST))


def nouns(text: Column) -> Column:
    """Likely nouns: capitalised words as they stand, then words of any case by their ending; a word may come twice."""
    told = F.regexp_extract_all(text, F.lit(WORD), F.lit(1))
    ended = F.filter(F.transform(told, F.lower), lambda w: w.rlike("^.+(" + "|".join(NOUN_ENDINGS) + ")$"))
    return F.concat(F.filter(told, lambda w: w.rlike("^[A-Z][a-z]+$")), ended)


def diagnosis(requirement: Column) -> Column:
    """(hard, soft, soft_words, diagnosis) of one requirement; the diagnosis is null where a number is required."""
    low = F.lower(requirement)
    held = F.filter(F.array(*[F.lit(w) for w in SOFT]), lambda w: low.contains(w))
    hard = _count(low, HARD)
    return F.struct(hard.alias("hard"), F.size(held).alias("soft"), held.alias("soft_words"), F.when(hard == 0, "no numeric thresholds").alias("diagnosis"))


def references(df: DataFrame, key: str, items: str | Column = "requirements") -> DataFrame:
    """(key, id, refs): each requirement with an id of its own (the first in it) and the other ids that it names, in order; the last of equal ids wins."""
    told = df.select(key, F.posexplode(items).alias("pos", "r")).select(key, "pos", F.regexp_extract_all("r", F.lit(f"({REQUIREMENT_ID})"), F.lit(1)).alias("ids")).where(F.size("ids") > 0)
    own = told.select(key, "pos", F.get("ids", F.lit(0)).alias("id"), "ids")
    last = own.groupBy(key, "id").agg(F.max_by("ids", "pos").alias("ids"))
    return last.select(key, "id", F.filter("ids", lambda x: x != F.col("id")).alias("refs"))


def named(requirement: Column) -> Column:
    """(actors, actions, objects) of a requirement: different words of the three lists in order, verbs in any form; an actor is no object."""
    of = lambda told, held: F.sort_array(F.array_intersect(told, F.array(*[F.lit(w) for w in held])))
    verb = "^(" + "|".join(VERBS) + ")[seding]*$"
    acted = lambda told: F.filter(F.transform(told, lambda w: F.regexp_extract(w, verb, 1)), lambda w: w != "")
    return once(F.array_distinct(words(requirement)), lambda told: F.struct(of(told, ACTORS).alias("actors"), F.sort_array(F.array_distinct(acted(told))).alias("actions"), of(told, [w for w in OBJECTS if w not in ACTORS]).alias("objects")))


def relations(df: DataFrame, key: str, column: str = "named") -> DataFrame:
    """(key, source, relation, target), each once: actors perform actions, and actions of requirements with an actor are on objects.

    The three lists are words of fixed vocabularies, so a row gives at most a fixed number of relations.
    """
    row = lambda source, relation, target: F.struct(source.alias("source"), F.lit(relation).alias("relation"), target.alias("target"))
    each = lambda e: F.flatten(F.transform(e["actions"], lambda a: F.concat(F.transform(e["actors"], lambda s: row(s, "performs", a)), F.transform(e["objects"], lambda o: row(a, "on", o)))))
    found = df.select(key, F.explode(once(F.col(column), lambda e: F.when(F.size(e["actors"]) > 0, each(e)))).alias("r"))
    return found.select(key, "r.source", "r.relation", "r.target")


def cognitive_load(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its readability and cognitive_load: the mean of six parts, each 1 at most; 0 without words."""
    c = readability(df, text).withColumn("__w", words(F.col(text)))
    n, s = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_sentences"), F.lit(1))
    exempt = F.regexp_count(F.lower(text), F.lit(r"\b(shall|must|should|will)\s+not\b"))
    parts = {"sentence": n / s, "word": F.col("n_syllables") / n, "concepts": F.size(F.array_distinct(nouns(F.col(text)))) / n, "coordination": _of(F.col("__w"), COORDINATING),
             "subordination": _of(F.col("__w"), SUBORDINATING), "negation": F.greatest(F.lit(0), _of(F.col("__w"), NEGATIONS) - exempt)}
    total = sum((F.least(part / LOADS[name], F.lit(1.0)) for name, part in parts.items()), F.lit(0.0))
    return c.withColumn("cognitive_load", F.when((F.col("n_words") > 0) & (F.col("n_sentences") > 0), total / len(parts)).otherwise(0.0)).drop("__w")


def overall(flesch: Column, atomicity: Column, completeness: Column, active: Column, clear: Column, load: Column) -> Column:
    """0 to 100 from readability around 65, structure (shares of atomic, whole, active and clear requirements) and cognitive load."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    parts = {"readability": 100 - F.abs(clip(flesch) - 65), "structure": clip(atomicity * 40 + completeness * 40 + active * 10 + clear * 10), "cognitive": (1 - load) * 100}
    return clip(sum((parts[name] * weight for name, weight in OVERALL.items()), F.lit(0.0)))
