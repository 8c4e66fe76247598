"""One-line summaries of texts: topics, a key sentence, feelings and flags, and their way back into fields."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.lineage import parted
from .entities import entity_list, listed
from .text import once

#: Cues of feelings and of flags, words that mark an important sentence, and words that are no topics.
EMOTIONS = {"decided": "determ", "prefer": "convict", "worried": "anx", "excited": "excite", "frustrated": "frust", "confused": "confuse", "love": "love", "hate": "rage", "hope": "hope", "fear": "fear",
            "trust": "trust", "happy": "joy", "sad": "grief", "surprised": "surprise", "grateful": "grat", "curious": "curious", "wonder": "wonder", "anxious": "anx", "relieved": "relief",
            "satisf": "satis", "disappoint": "grief", "concern": "anx"}
FLAGS = {"decided": "DECISION", "chose": "DECISION", "switched": "DECISION", "migrated": "DECISION", "replaced": "DECISION", "instead of": "DECISION", "because": "DECISION", "founded": "ORIGIN",
         "created": "ORIGIN", "started": "ORIGIN", "born": "ORIGIN", "launched": "ORIGIN", "first time": "ORIGIN", "core": "CORE", "fundamental": "CORE", "essential": "CORE", "principle": "CORE",
         "belief": "CORE", "always": "CORE", "never forget": "CORE", "turning point": "PIVOT", "changed everything": "PIVOT", "realized": "PIVOT", "breakthrough": "PIVOT", "epiphany": "PIVOT",
         "api": "TECHNICAL", "database": "TECHNICAL", "architecture": "TECHNICAL", "deploy": "TECHNICAL", "infrastructure": "TECHNICAL", "algorithm": "TECHNICAL", "framework": "TECHNICAL",
         "server": "TECHNICAL", "config": "TECHNICAL"}
CUES = ["decided", "because", "instead", "prefer", "switched", "chose", "realized", "important", "key", "critical", "discovered", "learned", "conclusion", "solution", "reason", "why", "breakthrough", "insight"]
STOP = ["the", "and", "for", "that", "this", "with", "from", "have", "has", "had", "was", "were", "are", "not", "but", "you", "your", "they", "their", "there", "then", "than", "when", "what", "which",
        "who", "how", "all", "can", "will", "would", "should", "could", "our", "its", "into", "about", "just", "also", "more", "some", "been", "being"]


def codes(text: Column, cues: dict[str, str], most: int = 3) -> Column:
    """The first few different codes whose cue stands in the text, in the cues' order."""
    none = F.array(F.lit(None).cast("string"))
    return once(F.lower(text), lambda low: F.array_join(F.slice(F.array_except(F.array(*[F.when(low.contains(cue), F.lit(code)) for cue, code in cues.items()]), none), 1, most), "+"))


def key_sentence(text: Column) -> Column:
    """The best sentence by cue words and shortness, the first of equals, cut at 55 characters."""
    sentences = F.filter(F.transform(F.split(text, r"[.!?\n]+"), F.trim), lambda s: F.char_length(s) > 10)

    def score(low: Column, n: Column) -> Column:
        return reduce(lambda a, b: a + b, [low.contains(c).cast("int") * 2 for c in CUES]) + (n < 80).cast("int") + (n < 40).cast("int") - (n > 150).cast("int") * 2

    seen = F.transform(sentences, lambda s: F.struct(s.alias("s"), F.lower(s).alias("low"), F.char_length(s).alias("n")))
    best = F.array_max(F.transform(seen, lambda x, i: F.struct(score(x["low"], x["n"]).alias("score"), (-i).alias("at"), x["s"].alias("s"))))["s"]
    return once(best, lambda s: F.coalesce(F.when(F.char_length(s) > 55, F.concat(F.substring(s, 1, 52), F.lit("..."))).otherwise(s), F.lit("")))


TOPIC, COMPOUND = "[a-zA-Z][a-zA-Z_-]{2,}", "[_-]|.[A-Z]"


def topics(df: DataFrame, key: str, text: str = "text", most: int = 3) -> DataFrame:
    """(key, topics): words by frequency, raised by 2 for each capitalised and for each compound use; ties by spelling."""
    words = df.select(key, F.explode(F.regexp_extract_all(text, F.lit(f"({TOPIC})"), F.lit(1))).alias("w"))
    weight = 1 + F.when(F.col("w").rlike("^[A-Z]"), 2).otherwise(0) + F.when(F.col("w").rlike(COMPOUND), 2).otherwise(0)
    per = words.groupBy(key, F.lower("w").alias("word")).agg(F.sum(weight).alias("weight")).where(~F.col("word").isin(STOP))
    order = Window.partitionBy(key).orderBy(F.desc("weight"), "word")
    return per.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), "_").alias("topics"))


def topics_of(text: Column, most: int = 3) -> Column:
    """The same of one text, in its row; null if it has none."""
    word, compound = re.compile(TOPIC), re.compile(COMPOUND)

    def one(text: str | None) -> str | None:
        weight: Counter[str] = Counter()
        for w, n in Counter(word.findall(text or "")).items():
            weight[w.lower()] += n * (1 + 2 * w[0].isupper() + 2 * bool(compound.search(w)))
        first = heapq.nsmallest(most, ((-n, w) for w, n in weight.items() if w not in STOP))
        return "_".join(w for _, w in first) or None

    @F.arrow_udf("string")
    def told(texts: pa.Array) -> pa.Array:
        return pa.array([one(t.as_py()) for t in texts], pa.string())

    return told(text)


def compressed(df: DataFrame, key: str, text: str = "text", entities: DataFrame | None = None, own: bool = False) -> DataFrame:
    """(key, summary): `0:entities|topics|"sentence"|feelings|flags`; entities are (key, entities), three at most, or the texts' own names.

    A text is summed up in its row; only the words of texts whose key repeats move, as these count together.
    """
    single, several = parted(df, key)
    known, none = F.col(key).isNotNull(), F.lit(None).cast("string").alias("entities")
    rows = single.select(key, text, F.when(known, topics_of(F.col(text))).alias("topics"), F.when(known, listed(F.col(text))).alias("entities") if own else none)
    if several is not None:
        met = several.select(key, text).join(topics(several, key, text), key, "left")
        rows = rows.unionByName(met.join(entity_list(several, key, text), key, "left") if own else met.select("*", none))
    named = rows if entities is None else rows.drop("entities").join(entities, key, "left")
    first = F.array_join(F.slice(F.split(F.replace("entities", F.lit(";"), F.lit("+")), r"\+"), 1, 3), "+")
    told = named.select(key, "topics", first.alias("first"), key_sentence(F.col(text)).alias("sentence"), codes(F.col(text), EMOTIONS).alias("feelings"), codes(F.col(text), FLAGS).alias("flags"))
    quoted = F.when(F.col("sentence") != "", F.concat(F.lit('"'), "sentence", F.lit('"')))
    return told.select(key, F.concat_ws("|", F.concat(F.lit("0:"), F.coalesce(F.nullif("first", F.lit("")), F.lit("???"))), F.coalesce("topics", F.lit("misc")), quoted,
                                        F.nullif("feelings", F.lit("")), F.nullif("flags", F.lit(""))).alias("summary"))


def fields(summary: Column) -> Column:
    """(entities, topics, sentence, rest) of a summary line."""
    part = F.split(summary, r"\|")
    return F.struct(F.split(F.regexp_replace(F.get(part, F.lit(0)), "^0:", ""), r"\+").alias("entities"), F.split(F.get(part, F.lit(1)), "_").alias("topics"),
                    F.regexp_extract(summary, r'\|"([^"]*)"', 1).alias("sentence"), F.filter(part, lambda p, i: (i >= 2) & ~p.startswith('"')).alias("rest"))


def token_count(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.floor(words * 1.3)).cast("int")


def ratio(original: Column, summary: Column) -> Column:
    return token_count(original) / token_count(summary)
