"""Names in texts: candidates, their kind by the words around them, fuzzy lookup, confusions, claims, pointer lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.lineage import cut, parted
from .text import once

#: Capitalised words, also joined by inner capitals or hyphens.
NAME = r"(?<![\p{L}\p{N}_])(\p{Lu}[\p{L}]+(?:-\p{L}+)*)"
#: Words after and before a person's or a project's name, and words that are no names.
AFTER_PERSON = ["said", "says", "asked", "asks", "told", "replied", "thinks", "thought", "wants", "wanted", "loves", "hates", "knows", "decided", "wrote", "laughed", "smiled", "cried", "felt", "feels"]
BEFORE_PERSON = ["hey", "hi", "hello", "dear", "thanks", "thank"]
AFTER_PROJECT = ["repo", "project", "library", "framework", "release", "version", "api", "pipeline", "v1", "v2", "v3"]
BEFORE_PROJECT = ["building", "built", "ship", "shipping", "shipped", "launch", "launched", "deploy", "deployed", "install", "installed", "import", "using"]
STOP = ["The", "This", "That", "These", "Those", "When", "Where", "What", "Why", "Who", "How", "And", "But", "For", "Not", "You", "She", "They", "Their", "There", "Then", "With", "From", "Into", "Also", "Here", "Yes"]
PRONOUNS = ["he", "she", "him", "her", "his", "hers", "they", "them", "their"]


def candidates(df: DataFrame, key: str, text: str = "text", least: int = 3, chars: int | None = None) -> DataFrame:
    """(key, name, n): capitalised words that a text has at least so often; `chars` bounds the part that the definition looks at."""
    body = F.substring(text, 1, chars) if chars else F.col(text)
    return (df.select(key, F.explode(F.regexp_extract_all(body, F.lit(NAME), F.lit(1))).alias("name")).where(~F.col("name").isin(STOP))
            .groupBy(key, "name").agg(F.count("*").alias("n")).where(F.col("n") >= least))


def listed(text: Column, most: int = 25) -> Column:
    """The names that a text has twice, in order, joined by `;`, in its row."""
    names = F.sort_array(F.filter(F.regexp_extract_all(text, F.lit(NAME), F.lit(1)), lambda n: ~n.isin(STOP)))
    return once(names, lambda s: F.array_join(F.slice(F.array_distinct(F.filter(s, lambda n, i: n == F.get(s, i - 1))), 1, most), ";"))


def entity_list(df: DataFrame, key: str, text: str = "text", most: int = 25, chars: int | None = None) -> DataFrame:
    """(key, entities): names seen twice in the text, or in so many characters of it, in order, joined by `;`; only the names of texts whose key repeats move."""
    single, several = parted(df, key)
    rows = single.select(key, listed(F.substring(text, 1, chars) if chars else F.col(text), most).alias("entities")).where("entities <> ''")
    if several is None:
        return rows
    found = candidates(several, key, text, 2, chars)
    return rows.unionByName(found.groupBy(key).agg(F.array_join(F.slice(F.sort_array(F.collect_set("name")), 1, most), ";").alias("entities")))


def kinds(df: DataFrame, key: str, text: str = "text", least: int = 3) -> DataFrame:
    """(name, n, person, project, kind, confidence): a name is a person if two kinds of signs say so, a project if most signs do.

    Signs are the words next to a name and pronouns on its line; texts become rows of neighbouring words once, and only counts
    of names are shuffled.
    """
    line = df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "body"))
    words = line.select(F.regexp_extract_all("body", F.lit(r"([\p{L}\p{N}_'-]+:?)"), F.lit(1)).alias("w"))
    near = F.exists("w", lambda x: F.lower(x).isin(PRONOUNS))
    at = words.select(near.alias("near"), F.posexplode(F.arrays_zip(
        "w", F.concat(F.array(F.lit("")), F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))).alias("before"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("after"))).alias("pos", "x"))
    name = F.regexp_replace("x.w", ":$", "")
    after, before = F.lower(F.coalesce("x.after", F.lit(""))), F.lower(F.coalesce("x.before", F.lit("")))
    one = lambda test: F.sum(test.cast("long"))
    per = (at.where(name.rlike(r"^\p{Lu}\p{L}+$") & ~name.isin(STOP)).groupBy(name.alias("name")).agg(
        F.count("*").alias("n"), one((F.col("pos") == 0) & F.col("x.w").endswith(":")).alias("dialogue"), one(after.isin(AFTER_PERSON)).alias("action"), one(F.col("near")).alias("pronoun"),
        one(before.isin(BEFORE_PERSON)).alias("addressed"), one(after.isin(AFTER_PROJECT) | before.isin(BEFORE_PROJECT)).alias("built")).where(F.col("n") >= least))
    dialogue = F.when(F.col("dialogue") >= 2, F.col("dialogue") * 3).otherwise(0)
    scored = per.select("name", "n", "pronoun", (dialogue + F.col("action") * 2 + F.col("pronoun") * 2 + F.col("addressed") * 4).alias("person"), (F.col("built") * 2).alias("project"),
                        ((F.col("dialogue") >= 2).cast("int") + (F.col("action") > 0).cast("int") + (F.col("pronoun") > 0).cast("int") + (F.col("addressed") > 0).cast("int")).alias("signs"))
    share = F.try_divide(F.col("person"), F.col("person") + F.col("project"))
    sure = ((F.col("signs") >= 2) & (F.col("person") >= 5)) | ((F.col("pronoun") >= 5) & (F.col("pronoun") / F.col("n") >= 0.2))
    return scored.select(
        "name", "n", "person", "project",
        F.when(share >= 0.7, F.when(sure, "person").otherwise("uncertain")).when(share <= 0.3, "project").otherwise("uncertain").alias("kind"),
        F.round(F.when(share.isNull(), F.least(F.lit(0.4), F.col("n") / 50)).when(share >= 0.7, F.when(sure, F.least(F.lit(0.99), 0.5 + share * 0.5)).otherwise(0.4))
                .when(share <= 0.3, F.least(F.lit(0.99), 0.5 + (1 - share) * 0.5)).otherwise(0.5), 2).alias("confidence"))


def _deletions(word: Column) -> Column:
    """The word, and the word less each one of its letters: two words at distance 1 or less share one of these."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(word), F.lit(1))), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, F.char_length(word))))))


#: Spellings of names that are broadcast at a time.
SPELLINGS = 1_000_000
#: What parts the words of a text, and the most words of it that may be one name.
BORDER, GRAM = r"[\s,.;:!?()\[\]{}\"']+", 3


def fuzzy_mentions(df: DataFrame, key: str, names: DataFrame, text: str = "text", distance: int = 1) -> DataFrame:
    """(key, name, matched, distance): names that one to three words of a text come within the distance (0 or 1) of; the nearest, then the first by spelling.

    The names are spelt as the texts' words may spell them, so a text is held against them by plain equality and none of its words loses
    a letter. Spellings are written once and broadcast in blocks of bounded size, and the nearest of a name is taken in the task that reads
    the text: neither texts nor what they mention are shuffled, only their different words are (and what is found in texts whose key repeats).
    """
    rows = _worded(df, key, text)
    low = cut(names.select("name", F.lower("name").alias("low")).distinct().withColumn("who", F.monotonically_increasing_id()), "names")
    spelt = low.select(F.col("low").alias("matched"), "who", "name", F.lit(0).alias("distance")) if distance == 0 else _spelt(low, rows)
    spelt = spelt.withColumn("n", F.regexp_count("matched", F.lit(" ")) + 1).where(F.col("n") <= GRAM)
    spelt = cut(spelt.orderBy("who", "distance", "matched").withColumn("place", F.monotonically_increasing_id()), "spellings")  # a name's best spelling has its smallest place
    told = spelt.agg(F.count("*").alias("n"), F.collect_set("n").alias("grams"), F.min(F.char_length("matched")).alias("low"), F.max(F.char_length("matched")).alias("high")).first()
    blocks = max(1, -(-told["n"] // SPELLINGS))
    near = lambda w: F.char_length(w).between(told["low"] or 0, told["high"] or 0)
    grams = F.array_distinct(F.concat(*[F.filter(_grams(k), near) for k in sorted(told["grams"]) or [1]]))
    single, several = parted(df, key)
    row = F.monotonically_increasing_id().alias("row")
    windows = _worded(single, key, text).select(key, row, "w").select(key, "row", F.explode_outer(grams).alias("matched"))
    kind = df.schema[key].dataType.simpleString()
    out = None
    for b in range(blocks):
        block = spelt if blocks == 1 else spelt.where(F.pmod(F.xxhash64("who"), F.lit(blocks)) == b)
        met = F.broadcast(block.groupBy("matched").agg(F.collect_list(F.struct("who", "place")).alias("hits")))
        best = windows.join(met, "matched").select(key, "row", "hits").mapInArrow(_nearest, f"`{key}` {kind}, place long")
        if several is not None:
            again = _worded(several, key, text).select(key, F.explode_outer(grams).alias("matched")).join(met, "matched").select(key, F.explode("hits").alias("hit"))
            best = best.unionByName(again.groupBy(key, "hit.who").agg(F.min("hit.place").alias("place")).select(key, "place"))
        hits = best.join(F.broadcast(block.select("place", "name", "matched", "distance")), "place").select(key, "name", "matched", "distance")
        out = hits if out is None else out.unionByName(hits)
    return out


def _worded(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.filter(F.split(F.lower(text), BORDER), lambda w: w != "").alias("w"))


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, row, hits), where those of one row follow one another, the smallest place of each name in each row."""
    held = None
    for batch in batches:
        hits = batch.column(2)
        of, flat = pc.list_parent_indices(hits), hits.flatten()
        found = pa.table([batch.column(0).take(of), batch.column(1).take(of), flat.field("who"), flat.field("place")], names=[batch.schema.names[0], "row", "who", "place"])
        found = found if held is None else pa.concat_tables([held, found])
        row, who, place = (found.column(i).to_numpy() for i in (1, 2, 3))
        order = np.lexsort((place, row))
        row, who = row[order], who[order]
        first = np.ones(len(order), bool)
        first[1:] = (row[1:] != row[:-1]) | (who[1:] != who[:-1])  # places are in the order of names
        found = found.take(order[first])
        done = int(np.searchsorted(row[first], row[-1])) if len(row) else 0
        yield from found.slice(0, done).select([0, 3]).to_batches()
        held = found.slice(done)
    if held is not None:
        yield from held.select([0, 3]).to_batches()


def _spelt(low: DataFrame, rows: DataFrame) -> DataFrame:
    """(matched, who, name, distance): what the rows' words w may write that is at distance 1 or less of low.

    One edit changes one word, makes two words one, or parts a word by a blank. In the first two cases the word, and the name's word or
    its two words as one, share a spelling less a letter; the rest of the name stays. In the third the name tells both words.
    """
    told = low.agg(F.max(F.char_length("low")).alias("n")).first()["n"] or 0
    held = cut(rows.select(F.explode_outer("w").alias("u")).where(F.char_length("u") <= told + 1).distinct(), "words")
    parts, size = F.split("low", " "), F.size(F.split("low", " "))
    join = lambda a, at, n: F.array_join(F.slice(a, at, n), " ")
    piece = lambda n: lambda x, i: F.struct(
        F.when(i > 0, F.concat(join(parts, F.lit(1), i), F.lit(" "))).otherwise("").alias("before"), (x if n == 1 else F.concat(x, F.get(parts, i + 1))).alias("k"),
        F.when(i + n < size, F.concat(F.lit(" "), join(parts, i + n + 1, size))).otherwise("").alias("after"), F.lit(n).alias("n"))
    pieces = low.select("who", "name", "low", F.explode_outer(F.concat(F.transform(parts, piece(1)), F.transform(parts, piece(2)))).alias("p")).select("who", "name", "low", "p.*").where("k is not null")
    keys = cut(pieces.select("who", "name", "low", "before", "after", F.explode_outer(F.when(F.col("n") == 1, _deletions(F.col("k"))).otherwise(F.array("k"))).alias("k")), "keys")
    left = held.select("u", F.explode_outer(_deletions(F.col("u"))).alias("k"))
    blocks = max(1, -(-keys.count() // SPELLINGS))
    found = None
    for b in range(blocks):
        near = left.join(F.broadcast(keys if blocks == 1 else keys.where(F.pmod(F.xxhash64("who"), F.lit(blocks)) == b)), "k")
        near = near.select(F.concat("before", "u", "after").alias("matched"), "who", "name", "low")
        found = near if found is None else found.unionByName(near)
    found = found.select("matched", "who", "name", F.levenshtein("matched", "low").alias("distance")).where("distance <= 1")
    at = lambda x, i, j: F.struct(F.substr(x, F.lit(1), i).alias("a"), F.substr(x, j, F.char_length(x)).alias("b"))
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("k"), F.lit(1))), lambda i: F.array(at(F.col("k"), i, i + 1), at(F.col("k"), i, i + 2)))
    halves = pieces.where("n = 1").select("who", "name", "before", "after", F.explode_outer(F.flatten(cuts)).alias("h")).select("who", "name", "before", "after", "h.*").where("a <> '' and b <> ''")
    for half in ("a", "b"):
        halves = halves.join(held, F.col(half) == F.col("u"), "left_semi")
    parted_ = halves.select(F.concat("before", "a", F.lit(" "), "b", "after").alias("matched"), "who", "name", F.lit(1).alias("distance"))
    return found.unionByName(parted_).distinct()


def _grams(k: int) -> Column:
    """Each k words in a row as one, joined by blanks; null past the end."""
    return F.col("w") if k == 1 else F.transform("w", lambda x, i: F.concat(x, *[c for j in range(1, k) for c in (F.lit(" "), F.get("w", i + j))]))


def confusions(mentioned: DataFrame, names: DataFrame) -> DataFrame:
    """(key, name, other, distance): a mentioned name (key, name) one or two edits from another registered name that isn't mentioned there."""
    key = next(c for c in mentioned.columns if c != "name")
    cut = lambda df, column: df.withColumn("k", F.explode(F.flatten(F.transform(_deletions(F.lower(column)), _deletions))))
    pairs = cut(names.select("name").distinct(), "name").join(cut(names.select(F.col("name").alias("other")).distinct(), "other"), "k").select("name", "other").distinct()
    near = pairs.withColumn("distance", F.levenshtein(F.lower("name"), F.lower("other"))).where("distance between 1 and 2")
    return mentioned.join(near, "name").join(mentioned.select(key, F.col("name").alias("other")), [key, "other"], "left_anti").select(key, "name", "other", "distance")


def claims(text: Column) -> Column:
    """(subject, predicate, object) of `X is Y's Z` and of `Y's Z is X`."""
    person = r"([A-Z][\w-]+)"
    first = F.regexp_extract_all(text, F.lit(rf"\b({person[1:-1]} is {person[1:-1]}'s [a-z]+)\b"), F.lit(1))
    second = F.regexp_extract_all(text, F.lit(rf"\b({person[1:-1]}'s [a-z]+ is {person[1:-1]})\b"), F.lit(1))
    take = lambda s, p, i: F.regexp_extract(s, p, i)
    a, b = rf"^{person} is {person}'s ([a-z]+)$", rf"^{person}'s ([a-z]+) is {person}$"
    return F.concat(F.transform(first, lambda s: F.struct(take(s, a, 1).alias("subject"), take(s, a, 3).alias("predicate"), take(s, a, 2).alias("object"))),
                    F.transform(second, lambda s: F.struct(take(s, b, 3).alias("subject"), take(s, b, 2).alias("predicate"), take(s, b, 1).alias("object"))))


def pointer_lines(df: DataFrame, key: str, text: str = "text", window: int | None = None) -> DataFrame:
    """(key, ordinal, line) of index lines `topic|entities|->ids`: deeds and headers (12 at most), then quotes (3), else the file's name.

    df has drawer_ids, wing, room and source_file besides; with a window only so many characters of the text count.
    """
    head = F.substring(text, 1, window) if window else F.col(text)
    deeds = F.regexp_extract_all(head, F.lit(r"(?i)((?:built|fixed|wrote|added|pushed|tested|created|decided|migrated|reviewed|deployed|configured|removed|updated)\s+[\w\s]{3,40})"), F.lit(1))
    headers = F.regexp_extract_all(head, F.lit(r"(?m)^#{1,3}\s+(.{5,60})$"), F.lit(1))
    topics = F.slice(F.array_distinct(F.transform(F.concat(deeds, headers), lambda x: F.lower(F.trim(x)))), 1, 12)
    quotes = F.transform(F.slice(F.regexp_extract_all(head, F.lit(r'"([^"]{15,150})"'), F.lit(1)), 1, 3), lambda q: F.concat(F.lit('"'), q, F.lit('"')))
    told = F.concat(topics, quotes)
    name = F.substring(F.regexp_replace(F.regexp_replace("source_file", r"^.*/", ""), r"\.[^.]*$", ""), 1, 40)
    names = candidates(df, key, text, 2, window)
    top = Window.partitionBy(key).orderBy(F.desc("n"), "name")
    five = names.withColumn("k", F.row_number().over(top)).where("k <= 5").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ";").alias("entities"))
    lines = df.join(five, key, "left").select(key, F.coalesce("entities", F.lit("")).alias("entities"), F.array_join(F.slice("drawer_ids", 1, 3), ",").alias("ref"),
                                              F.when(F.size(told) > 0, told).otherwise(F.array(F.concat_ws("/", "wing", "room", name))).alias("told"))
    return lines.select(key, F.posexplode("told").alias("ordinal", "topic"), "entities", "ref").select(key, "ordinal", F.concat(F.col("topic"), F.lit("|"), "entities", F.lit("|->"), "ref").alias("line"))


def pointed(line: Column) -> Column:
    """The drawer ids that an index document points to, each once, in order."""
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(line, F.lit(r"->([^\n|]+)"), F.lit(1)), lambda s: F.split(s, ","))))


def registered(known: DataFrame, found: DataFrame, least: float = 0.75) -> DataFrame:
    """known (name, kind) with what found (name, kind, confidence) adds surely; names are compared in lower case, known ones win."""
    fresh = found.where((F.col("confidence") >= least) & (F.col("kind") != "uncertain")).select("name", "kind").withColumn("l", F.lower("name"))
    return known.unionByName(fresh.join(known.select(F.lower("name").alias("l")), "l", "left_anti").drop("l"))
