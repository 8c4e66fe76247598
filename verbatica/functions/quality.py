"""Deterministic text quality: readability, structure, cognition, constraints, behaviour, meaning and depth.

Everything is arithmetic on counts of patterns, in column expressions; a text's sentences or requirements are an array in
its row, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructType

from .text import once

#: Word lists and patterns of the metrics.
COORDINATING = ["and", "or", "but", "nor", "yet", "so"]
SUBORDINATING = ["because", "if", "when", "while", "unless", "although", "since", "until", "whereas", "whenever"]
NEGATIONS = ["not", "no", "never", "none", "neither", "nor", "cannot"]
CONDITIONALS = ["if", "when", "unless", "whenever", "provided", "assuming"]
PRONOUNS = ["it", "this", "that", "these", "those", "they", "them"]
MODALS = {"must": 1.0, "shall": 1.0, "should": 0.6, "may": 0.3, "might": 0.3, "could": 0.3, "would": 0.3}
ACTIONS = ["validate", "verify", "check", "confirm", "create", "generate", "produce", "build", "update", "modify", "change", "edit", "delete", "remove", "destroy", "clear",
           "display", "show", "present", "render", "send", "transmit", "emit", "notify", "store", "save", "persist", "record", "retrieve", "fetch", "get", "load", "process",
           "handle", "execute", "perform"]
SOFT = ["fast", "slow", "quick", "responsive", "user-friendly", "intuitive", "easy", "simple", "secure", "robust", "reliable", "stable", "scalable", "flexible", "maintainable",
        "efficient", "optimal", "high-quality", "appropriate", "reasonable", "adequate"]
HARD = [r"\d+(\.\d+)?\s*(ms|milliseconds?|sec|seconds?|min|minutes?|hours?|days?)", r"\d+(\.\d+)?\s*(b|kb|mb|gb|tb|bytes?|kilobytes?|megabytes?|gigabytes?)", r"\d+(\.\d+)?\s*%",
        r"\d+(\.\d+)?\s*(requests?|queries?|transactions?|operations?)\s*per\s*(sec|second|min|minute|hour|day)", r"<\s*\d+", r">\s*\d+", r"=\s*\d+", r"<=\s*\d+", r">=\s*\d+",
        r"less\s+than\s+\d+", r"greater\s+than\s+\d+", r"equal\s+to\s+\d+", r"at\s+least\s+\d+", r"at\s+most\s+\d+", r"no\s+more\s+than\s+\d+", r"between\s+\d+\s+and\s+\d+",
        r"from\s+\d+\s+to\s+\d+", r"\d+\s*-\s*\d+", r"maximum\s+of\s+\d+", r"minimum\s+of\s+\d+", r"up\s+to\s+\d+", r"within\s+\d+", r"exactly\s+\d+", r"precisely\s+\d+"]
NEGATIVE = [r"\bmust\s+not\b", r"\bshall\s+not\b", r"\bshould\s+not\b", r"\bcannot\b", r"\bcan\s+not\b", r"\bdo\s+not\b", r"\bdoes\s+not\b", r"\bwill\s+not\b", r"\bnever\b",
            r"\bprohibited\b", r"\bforbidden\b", r"\bnot\s+allowed\b", r"\bnot\s+permitted\b", r"\bout\s+of\s+scope\b", r"\bexcludes?\b", r"\bomits?\b"]
CONDITION = [r"\bif\b", r"\bwhen\b", r"\bunless\b", r"\bgiven\b", r"\bafter\b", r"\bbefore\b", r"\bon\b(?!\s+the)", r"\bin\s+case\b", r"\bprovided\b", r"\bassuming\b", r"\bwhenever\b", r"\bupon\b"]
ERRORS = [r"\berror\b", r"\bfail\b", r"\bfailure\b", r"\bexception\b", r"\binvalid\b", r"\brejected?\b", r"\bdenied\b", r"\btimeout\b", r"\bexpired?\b", r"\bif\s+not\b", r"\bunless\b"]
OBSERVABLE = ["display", "show", "render", "present", "visualize", "hide", "highlight", "enable", "disable", "return", "output", "respond", "reply", "emit", "send", "transmit", "notify",
              "alert", "store", "save", "persist", "record", "log", "write", "update", "modify", "change", "set", "status", "code", "message", "error", "warning", "response", "becomes",
              "transitions", "moves to", "active"]
ACTORS = r"\b(user|admin|system|customer|client|operator|manager|developer|tester|application|service|module|component|interface|database|server|administrator|api|browser|device|agent)\b|\b(the|a|an)\s+\w{3,}\s+(shall|must|should|will|can|may)\b"
OBJECTS = r"\b(data|information|record|entry|item|element|file|document|report|form|template|message|notification|alert|email|request|user|account|profile|session|credential|input|output|response|result|value)\b"
OUTCOMES = r"(returns?|displays?|shows?|generates?|sends?|stores?|becomes?|transitions?\s+to|changes?\s+to|results?\s+in)\s+\w+"
TRIGGERS = r"\b(if|when|unless|given|after|before|upon|in case|provided|assuming|whenever)\b"
BE = r"\b(is|are|was|were|be|been|being)\b"
REQUIREMENT_ID = r"(?:[A-Z]+-)?(?:FR|REQ|NFR|AC|SC)-\d+"
#: Ideals and weights of the metrics, and weights of the categories.
IDEALS = {"flesch_kincaid_grade": 10.0, "gunning_fog_index": 12.0, "smog_index": 12.0, "coleman_liau_index": 10.0, "automated_readability_index": 10.0}
WEIGHTS = {
    "readability": {"flesch_reading_ease": 0.25, "flesch_kincaid_grade": 0.15, "gunning_fog_index": 0.15, "smog_index": 0.15, "coleman_liau_index": 0.15, "automated_readability_index": 0.15},
    "structure": {"atomicity_score": 0.30, "completeness_score": 0.30, "passive_voice_ratio": 0.15, "ambiguous_pronoun_ratio": 0.10, "modal_strength": 0.15},
    "cognitive": {"sentence_length": 0.20, "syllable_complexity": 0.15, "concept_density": 0.15, "coordination_complexity": 0.15, "subordination_complexity": 0.15, "negation_load": 0.10, "conditional_load": 0.10},
    "semantic": {"actor_presence": 0.20, "action_presence": 0.20, "object_presence": 0.20, "outcome_presence": 0.20, "trigger_presence": 0.10, "scc_score": 0.10},
    "testability": {"hard_constraint_ratio": 0.45, "constraint_density": 0.35, "negative_space_coverage": 0.20},
    "behavioral": {"scenario_decomposition_score": 0.25, "transition_completeness_score": 0.35, "branch_coverage_score": 0.20, "observability_score": 0.20},
    "depth": {"requirement_volume_score": 0.40, "coverage_density": 0.35, "cross_reference_index": 0.25},
}
CATEGORIES = {"structure": 0.15, "readability": 0.10, "cognitive": 0.10, "testability": 0.20, "semantic": 0.15, "behavioral": 0.15, "depth": 0.15}
WORD = r"([\p{L}\p{N}_]+)"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^a-z\p{L}\p{N}_]+"), "")  # runs of WORD; most letters are of the first range, which is the fastest to tell


@F.arrow_udf(IntegerType())
def sentence_count(text: pa.Array) -> pa.Array:
    """Pieces between marks that hold more than white space."""
    return pc.count_substring_regex(text, r"[^.!?\s\x0B][^.!?]*")


@F.arrow_udf(IntegerType())
def solid(text: pa.Array) -> pa.Array:
    """Characters but white space."""
    return reduce(pc.subtract, [pc.count_substring(text, c) for c in " \t\n\v\f\r"], pc.utf8_length(text))


def syllables(word: Column) -> Column:
    """Groups of vowels, one less for a final e, at least one."""
    return F.greatest(F.lit(1), F.regexp_count(word, F.lit("[aeiouy]+")) - word.endswith("e").cast("int"))


#: What is counted of a text's words: those of four lists, and different ones of over four characters besides.
LISTS = {"coordinations": COORDINATING, "subordinations": SUBORDINATING, "negations": NEGATIONS, "conditionals": CONDITIONALS}
COUNTS = ["n_words", "n_syllables", "n_complex", *LISTS, "concepts"]
#: Texts whose words are counted at a time.
TEXTS = 256


@F.arrow_udf(reduce(lambda schema, name: schema.add(name, IntegerType()), COUNTS, StructType()))
def word_counts(words_: pa.Array) -> pa.Array:
    """COUNTS of lists of words in lower case: each different word is looked at once for a run of texts."""
    parts = []
    for low in range(0, len(words_), TEXTS):
        lists = words_.slice(low, TEXTS)
        size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        end, coded = np.cumsum(size), lists.flatten().dictionary_encode()
        unique, code = coded.dictionary, np.asarray(coded.indices)
        syllables_ = np.maximum(1, np.asarray(pc.count_substring_regex(unique, "[aeiouy]+")) - np.asarray(pc.ends_with(unique, "e")).astype(int))
        of = [np.ones(len(unique), int), syllables_, syllables_ >= 3, *[np.asarray(pc.is_in(unique, value_set=pa.array(held, unique.type))) for held in LISTS.values()]]
        total = [np.concatenate([[0], np.cumsum(f[code], dtype=np.int64)]) for f in of]
        long_ = (np.asarray(pc.utf8_length(unique)) > 4)[code]
        pairs = np.unique(np.repeat(np.arange(len(lists)), size)[long_] * len(unique) + code[long_])
        concepts = np.bincount(pairs // max(1, len(unique)), minlength=len(lists))
        numbers = [*[t[end] - t[end - size] for t in total], concepts]
        parts.append(pa.StructArray.from_arrays([pa.array(n.astype(np.int32), mask=np.asarray(pc.is_null(lists))) for n in numbers], names=COUNTS))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(name, pa.int32()) for name in COUNTS]))


def counted(df: DataFrame, text: str = "text", *, held: bool = False) -> DataFrame:
    """df with the counts that readability needs: n_words, n_sentences, n_syllables, n_complex, n_solid (characters but white space); and with all COUNTS as `__m`, if they are held."""
    c = df.withColumn("__w", words(F.col(text))).withColumn("__m", word_counts("__w")).withColumns({"n_sentences": sentence_count(text), "n_solid": solid(text)})
    return c.withColumns({name: F.col("__m")[name] for name in ("n_words", "n_syllables", "n_complex")}).drop("__w", *[] if held else ["__m"])


def readability(df: DataFrame, text: str = "text", *, held: bool = False) -> DataFrame:
    """df with six readability scores and their mean grade; 0 for a text without words or sentences."""
    c = counted(df, text, held=held)
    w, s, y, x, n = (F.col(k).cast("double") for k in ("n_words", "n_sentences", "n_syllables", "n_complex", "n_solid"))
    some = (F.col("n_words") > 0) & (F.col("n_sentences") > 0)
    scores = {
        "flesch_reading_ease": F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * w / s - 84.6 * y / w)),
        "flesch_kincaid_grade": F.greatest(F.lit(0.0), 0.39 * w / s + 11.8 * y / w - 15.59),
        "gunning_fog_index": 0.4 * (w / s + 100 * x / w),
        "smog_index": F.greatest(F.lit(0.0), 1.0430 * F.sqrt(x * 30 / s) + 3.1291),
        "coleman_liau_index": F.greatest(F.lit(0.0), 5.88 * n / w - 29.6 * s / w - 15.8),
        "automated_readability_index": F.greatest(F.lit(0.0), 4.71 * n / w + 0.5 * w / s - 21.43),
    }
    for name, score in scores.items():
        c = c.withColumn(name, F.when(some, score).otherwise(F.lit(0.0)))
    return c.withColumn("average_grade_level", reduce(lambda a, b: a + b, [F.col(k) for k in IDEALS]) / len(IDEALS))


def requirements(text: Column) -> Column:
    """Bodies after requirement ids, else sentences with shall or must, else sentences of over 20 characters; each way is tried only where the text holds its words."""
    ident = r"(?:[A-Z]+-)?(?:FR|REQ|NFR)-\d+"
    none = F.array().cast("array<string>")
    some = lambda a: F.filter(F.transform(a, F.trim), lambda s: s != "")
    marked = some(F.regexp_extract_all(text, F.lit(rf"(?s)(?:^|\n)\s*{ident}\s*[:\-]?\s*(.+?)(?=\n\s*{ident}|\z)"), F.lit(1)))
    # a sentence begins after a mark or a line's end: a run without a mark is read once
    binding = F.filter(some(F.regexp_extract_all(text, F.lit(r"((?<![^.!?\n])[^.!?\n]++[.!?])"), F.lit(1))), lambda s: (F.char_length(s) > 10) & s.rlike(r"(?i)\b(shall|must)\b"))
    plain = F.filter(some(F.split(text, r"[.!?]+\s+")), lambda s: F.char_length(s) > 20)
    first = lambda found, otherwise: once(found, lambda a: F.when(F.size(a) > 0, a).otherwise(otherwise))
    return first(F.when(_any(text, ["FR-", "REQ-"]), marked).otherwise(none), first(F.when(_any(F.lower(text), ["shall", "must"]), binding).otherwise(none), plain))


def _any(text: Column, words_: list[str]) -> Column:
    """Whether the text holds one of the words, also within others; as fast as a text is read, which a pattern of many words is not."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words_ if not any(v in w for v in words_ if v != w)])


def _literals(pattern: str) -> list[str]:
    """What every match of the pattern holds; nothing is told of a pattern with alternatives."""
    bare = re.sub(r"\(\?!.*?\)", "", pattern)
    return [] if re.search(r"[(|]", bare) else re.sub(r"\\[bsdw][+*]?|\w\?", " ", bare).split()


def _lacks(text: Column, pattern: str) -> Column:
    """Whether the text lacks what every match of the pattern holds, so the pattern needn't be tried."""
    return reduce(lambda a, b: a | b, [~text.contains(w) for w in _literals(pattern)], F.lit(False))


def _count(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(_lacks(text, p), 0).otherwise(F.regexp_count(text, F.lit(p))) for p in patterns])


def _held(text: Column, words_: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words_])


def _of(array: Column, held: list[str]) -> Column:
    return F.size(F.filter(array, lambda w: w.isin(held)))


#: An action in any of its forms.
ACTION = r"\b(" + "|".join(ACTIONS) + r")(s|es|d|ed|ing)?\b"
#: Patterns that say whether a requirement (in lower case) has something, and, from `hard` on, whether there is anything to count.
HAS = {
    "joined": r"(?:^|\s)(?:" + "|".join(COORDINATING) + r")(?:\s|\z)", "vague": "(?:^| )(?:" + "|".join(PRONOUNS) + r")(?: |\z)", "action": "|".join(ACTIONS), "shown": "|".join(OBSERVABLE),
    "actor": ACTORS, "object": OBJECTS, "outcome": OUTCOMES, "trigger": TRIGGERS, "acts": ACTION, "reaches": ACTION + r"[^\n]*?\w{3,}", "be": BE, "been": BE + r"\s+\w+(ed|en)\b",
} | {f"condition{i}": p for i, p in enumerate(CONDITION)} | {
    "errors": "|".join(ERRORS), "hard": "|".join(HARD), "negative": "|".join(NEGATIVE), "soft": "|".join(SOFT), "modals": " (?:" + "|".join(MODALS) + ") ",
}


def _automaton(pattern: str) -> str:
    """The pattern for an automaton, which tries all alternatives at once: it finds all that Java's finds, and in ASCII, where no look-ahead is left out, no more.

    Java's white space has a vertical tab, and its borders of words know letters beyond ASCII.
    """
    return re.sub(r"\(\?!.*?\)", "", pattern).replace(r"\s", r"[\s\x0B]")


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, requirement), with a bit of __has for each pattern that the automaton finds."""
    for batch in batches:
        text, has = batch.column(1), np.zeros(batch.num_rows, np.int64)
        for i, pattern in enumerate(HAS.values()):
            has |= np.asarray(pc.match_substring_regex(text, _automaton(pattern))).astype(np.int64) << i
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(has)], names=[*batch.schema.names, "__has"])


def requirement_flags(rows: DataFrame) -> DataFrame:
    """rows (key, __r), with what each requirement __r (in lower case) has as numbers to sum instead of the requirement itself.

    One look at a batch of requirements tells which patterns may hold; Java's, whose borders count, is tried only then and beyond ASCII.
    """
    key, kind = rows.columns[0], rows.schema[0].dataType.simpleString()
    told = rows.mapInArrow(_seen, f"`{key}` {kind}, __r string, __has long")
    c, bits = F.col("__r"), {name: i for i, name in enumerate(HAS)}
    may = lambda name: F.col("__has").bitwiseAND(F.lit(1 << bits[name])) != 0
    ascii_ = F.octet_length(c) == F.char_length(c)
    has = lambda name: may(name) & ((ascii_ if "(?!" not in HAS[name] else F.lit(False)) | c.rlike(HAS[name]))
    tests = {x: may(x) for x in ("vague", "action", "shown")} | {x: has(x) for x in ("actor", "object", "outcome", "trigger", "acts")}
    tests |= {"atomic": ~may("joined"), "reaches": has("reaches"), "passive": (has("be") & c.contains(" by ")) | has("been")}
    told = told.select(key, "__r", "__has", *[t.alias(name) for name, t in tests.items()], reduce(lambda a, b: a + b, [has(f"condition{i}").cast("int") for i in range(len(CONDITION))]).alias("branches"))
    guard, acts = F.col("branches") > 0, F.col("acts")
    given = {x: F.col(x) for x in ("atomic", "passive", "vague", "actor", "action", "object", "outcome", "trigger", "shown")}
    given |= {"whole": F.col("actor") & F.col("reaches"), "guarded": guard, "moves": guard & acts, "complete": guard & acts & F.col("shown")}
    some = lambda name, number: F.when(may(name), number).otherwise(0)
    numbers = {name: test.cast("int") for name, test in given.items()} | {m: some("modals", _count(c, [f" {m} "])) for m in MODALS} | {"branches": F.col("branches")}
    numbers |= {"errors": some("errors", reduce(lambda a, b: a + b, [c.rlike(p).cast("int") for p in ERRORS])), "hard": some("hard", _count(c, HARD)), "soft": some("soft", _held(c, SOFT)), "negative": some("negative", _count(c, NEGATIVE))}
    return told.select(key, *[n.alias(name) for name, n in numbers.items()])


def metrics(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """df with 34 scores of 0 to 1, a mean for each of the seven categories, and overall_weighted_average.

    Requirements become rows, are measured by compiled expressions, and are summed by the key (which must be unique); only
    numbers are shuffled.
    """
    rows = df.select(F.col(key).alias("__key"), F.explode_outer(requirements(F.col(text))).alias("__r")).where("__r is not null").withColumn("__r", F.lower("__r"))
    flags = requirement_flags(rows)
    names = [n for n in flags.columns if n != "__key"]
    sums = flags.groupBy(F.col("__key").alias(key)).agg(F.count("*").alias("__n"), *[F.sum(n).alias(f"__{n}") for n in names])
    c = readability(df, text, held=True)
    c = c.withColumns({f"__{n}": F.col("__m")[n] for n in LISTS} | {
        "__concepts": F.col("__m.concepts").cast("double"),
        "__exempt": F.when(F.lower(text).contains("not"), F.regexp_count(F.lower(text), F.lit(r"\b(shall|must|should|will)\s+not\b"))).otherwise(0),
        "__ids": F.when(_any(F.col(text), ["FR-", "REQ-", "AC-", "SC-"]), F.regexp_extract_all(text, F.lit(f"({REQUIREMENT_ID})"), F.lit(1))).otherwise(F.array().cast("array<string>"))}).drop("__m")
    c = c.join(sums, key, "left").fillna(0, subset=["__n", *[f"__{n}" for n in names]])
    n = F.col("__n").cast("double")
    safe = F.greatest(n, F.lit(1.0))
    total = {name: F.col(f"__{name}").cast("double") for name in names}
    share = {name: total[name] / safe for name in names}
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    score: dict[str, Column] = {"flesch_reading_ease_score": clip(1 - F.abs(F.col("flesch_reading_ease") - 65) / 100)}
    for name, ideal in IDEALS.items():
        score[name + "_score"] = clip(1 - F.abs(F.col(name) - ideal) / (2 * ideal))
    strength, modals = reduce(lambda a, b: a + b, [total[m] * v for m, v in MODALS.items()]), reduce(lambda a, b: a + b, [total[m] for m in MODALS])
    score |= {"atomicity_score": share["atomic"], "completeness_score": share["whole"], "passive_voice_ratio": F.when(n > 0, 1 - share["passive"]).otherwise(1.0), "ambiguous_pronoun_ratio": F.when(n > 0, 1 - share["vague"]).otherwise(1.0),
              "modal_strength": F.when(n == 0, 0.0).when(modals == 0, 0.5).otherwise(strength / modals)}
    w, s = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("n_sentences"), F.lit(1)).cast("double")
    base = F.greatest(F.floor(w / s * (F.col("__coordinations") + F.col("__subordinations") + 1)), F.lit(1)).cast("double")
    score |= {"sentence_length": clip(1 - F.abs(w / s - 20) / 20), "syllable_complexity": clip(1 - F.abs(F.col("n_syllables") / w - 1.5) / 1.5), "concept_density": clip(1 - F.abs(F.col("__concepts") / w - 0.2) / 0.2),
              "coordination_complexity": clip(1 - F.col("__coordinations") / base / 0.1), "subordination_complexity": clip(1 - F.col("__subordinations") / base / 0.1),
              "negation_load": clip(1 - F.greatest(F.lit(0), F.col("__negations") - F.col("__exempt")) / base / 0.05), "conditional_load": clip(1 - F.col("__conditionals") / base / 0.1)}
    score |= {f"{role}_presence": share[role] for role in ("actor", "action", "object", "outcome", "trigger")}
    score["scc_score"] = (share["actor"] + share["action"] + share["object"] + share["outcome"] + 0.7 * share["trigger"]) / 4.7
    found = total["hard"] + total["soft"]
    score |= {"hard_constraint_ratio": F.when(found > 0, total["hard"] / found).otherwise(0.0), "constraint_density": 1 - F.exp(-2 * found / safe), "negative_space_coverage": 1 - F.exp(-5 * share["negative"])}
    target = F.log(F.lit(7.0)) + 0.5 * F.log(F.lit(4.0))
    score |= {"scenario_decomposition_score": 1 - F.exp(-3 * share["guarded"]), "transition_completeness_score": F.when(total["moves"] > 0, total["complete"] / total["moves"]).otherwise(0.0),
              "branch_coverage_score": F.when(total["branches"] > 0, F.least((F.log1p(total["branches"]) + 0.5 * F.log1p(total["errors"])) / target, F.lit(1.0))).otherwise(0.0), "observability_score": share["shown"]}
    references = (F.size("__ids") - F.size(F.array_distinct("__ids"))).cast("double")
    score |= {"requirement_volume_score": F.least(F.lit(1.0), F.log1p(n) / F.log(F.lit(201.0))), "coverage_density": F.when(n > 0, 1 - F.exp(-n / F.greatest(F.col("__concepts"), F.lit(1.0)) / 3)).otherwise(0.0),
              "cross_reference_index": 1 - F.exp(-references / safe)}
    c = c.withColumns(score)
    named = {cat: {k if k in score else k + "_score": v for k, v in per.items()} for cat, per in WEIGHTS.items()}
    c = c.withColumns({cat + "_average": reduce(lambda a, b: a + b, [F.col(k) * v for k, v in per.items()]) / sum(per.values()) for cat, per in named.items()})
    c = c.withColumn("overall_weighted_average", reduce(lambda a, b: a + b, [F.col(cat + "_average") * v for cat, v in CATEGORIES.items()]))
    return c.drop(*[x for x in c.columns if x.startswith("__")])


def level(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "fair").otherwise("poor")
