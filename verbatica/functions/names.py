"""Names in texts by the patterns of many languages: one pass finds every name of a register, and the signs around it.

Sections of languages are given by the caller (a dict for each, as ``load`` reads them from JSON files); the library holds no word lists for them.  A section may have
candidate_pattern, multi_word_pattern, boundary_chars, person_verb_patterns, pronoun_patterns, dialogue_patterns, direct_address_pattern, project_verb_patterns and
stopwords; ``{name}`` stands for the name.

Searching for thousands of names with every pattern by itself would read a text names x patterns times.  Here one automaton of all names (in lower case) runs over a text once,
and where a name stands each pattern is tried in place: what comes before ``{name}`` must end there, what follows must begin there.  Counts are those of
searching each pattern by itself, as long as what comes before reaches back ``REACH`` characters at most, runs of white space aside.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

REACH = 120
#: Names of one automaton; more are taken in several passes.
NAMES = 50_000
#: A name with a version, and a name with the ending of a code file.
VERSIONED, CODE = r"\b{name}[-_]v?\d+(?:\.\d+)*\b", r"\b{name}\.(py|js|ts|yaml|yml|json|sh)\b"
#: Weights of the signs.
WEIGHTS = {"dialogue": 3, "action": 2, "pronoun": 2, "addressed": 4, "built": 2, "versioned": 3, "code": 3}


def load(spark: SparkSession, folder: str) -> dict[str, dict]:
    """The `entity` sections of the JSON files of a folder, by file name; files of other content are empty sections."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", "content").collect()  # a file for each language
    return {r["path"].rsplit("/", 1)[1].removesuffix(".json").lower(): json.loads(bytes(r["content"])).get("entity", {}) for r in files}


def merged(sections: Iterable[dict]) -> dict[str, list[str]]:
    """One set of patterns of several sections: lists in order, each pattern once; candidate patterns wrapped in word borders; stop words as a set.

    A section with boundary_chars has borders of its own: they stand where neither side, or both sides, are of these characters.
    """
    out: dict[str, list[str]] = {k: [] for k in ("candidates", "phrases", "action", "pronoun", "dialogue", "addressed", "built", "stop")}
    fields = {"action": "person_verb_patterns", "pronoun": "pronoun_patterns", "dialogue": "dialogue_patterns", "built": "project_verb_patterns"}
    for section in sections:
        chars = section.get("boundary_chars")
        border = rf"(?:(?<=[{chars}])(?![{chars}])|(?<![{chars}])(?=[{chars}]))" if chars else r"\b"
        for name, field in (("candidates", "candidate_pattern"), ("phrases", "multi_word_pattern")):
            if section.get(field):
                out[name].append(f"{border}({section[field]}){border}")
        if section.get("direct_address_pattern"):
            out["addressed"].append(section["direct_address_pattern"].replace(r"\b", border))
        for name, field in fields.items():
            out[name] += [p.replace(r"\b", border) for p in section.get(field, [])]
        out["stop"] += [w.lower() for w in section.get("stopwords", [])]
    return {k: sorted(set(v)) if k == "stop" else list(dict.fromkeys(v)) if k in fields else v for k, v in out.items()}


def found_names(text: str, patterns: dict[str, list[str]]) -> Counter:
    """How often the candidate patterns find each name; names with a stop word, and single letters, are left out."""
    stop, out = set(patterns["stop"]), Counter()
    for p in patterns["candidates"]:
        out.update(w for w in re.findall(p, text) if len(w) >= 2 and w.lower() not in stop)
    for p in patterns["phrases"]:
        out.update(w for w in re.findall(p, text) if not any(x.lower() in stop for x in w.split()))
    return out


def mentions(df: DataFrame, key: str, patterns: dict[str, list[str]], text: str = "text", least: int = 1) -> DataFrame:
    """(key, name, n) of the names of each text, seen at least so often in it; a null text has none."""
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, name, n) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for name, n in found_names(t, patterns).items() if n >= least]
            if rows:
                ids, names, counts = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=[key, "name", "n"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, name string, n long")


def _fold(text: str) -> str:
    """Lower case, letter by letter, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between the bars that stand in no group, class or escape."""
    out, depth, inside, at, begin = [], 0, False, 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[begin:at])
            begin = at + 1
        at += 1
    return [*out, pattern[begin:]]


class Template:
    """One pattern around a name: tried where the name stands."""

    def __init__(self, pattern: str):
        self.parts, self.before = [], []
        for one in _alternatives(pattern):
            before, name, after = one.partition("{name}")
            if not name or "{name}" in after:
                raise ValueError(f"a pattern must hold {{name}} once in each alternative: {pattern}")
            border = before.endswith(r"\b")  # a border before the name can't be seen from before it alone
            before = before.removesuffix(r"\b")
            self.before += [before] if before else []
            self.parts.append((re.compile(f"(?:{before})\\Z", re.I | re.M) if before else None, border, re.compile(after, re.I | re.M)))

    def match(self, text: str, start: int, end: int, low: int) -> tuple[int, int] | None:
        """Begin and end of the first alternative that fits a name at start to end."""
        for before, border, after in self.parts:
            if border and not ((start == 0 or not _is_word(text[start - 1])) if _is_word(text[start]) else (start > 0 and _is_word(text[start - 1]))):
                continue
            begin = start
            if before:
                found = before.search(text, low, start)
                if not found:
                    continue
                begin = found.start()
            rest = after.match(text, end)
            if rest:
                return begin, rest.end()
        return None


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _automaton(names: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for low, same in _spelled(names).items():
        out.add_word(low, (len(low), same))
    out.make_automaton()
    return out


def _spelled(names: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name in names:
        out.setdefault(_fold(name), []).append(name)
    return out


class Signs:
    """Counts of signs around the names of one register."""

    def __init__(self, names: list[str], patterns: dict[str, list[str]]):
        self.automaton = _automaton(names) if names else None
        listed = [(kind, p) for kind in ("dialogue", "action", "addressed", "built") for p in patterns[kind]] + [("versioned", VERSIONED), ("code", CODE)]
        self.kinds = [(f"{kind}:{i}", Template(p)) for i, (kind, p) in enumerate(listed)]
        # one look tells whether any pattern can fit: what may follow a name at the begin of a word, and what may stand before it
        parts = [part for _, template in self.kinds for part in template.parts]
        together = lambda ps: re.compile("|".join(f"(?:{p})" for p in dict.fromkeys(ps)) or "(?!)", re.I | re.M)
        self.follows = together(after.pattern for before, border, after in parts if not before and border)
        self.other = any(not before and not border for before, border, _ in parts)
        before = [p for _, template in self.kinds for p in template.before]
        words = [p.removesuffix(r"\s+") for p in before if p.endswith(r"\s+")]
        last = [w.rsplit(r"\s+", 1)[-1] for w in words]
        self.simple = all(p == "^" or p.endswith(r"\s+") for p in before) and all(w.count("(") == w.count(")") for w in last)
        self.last = re.compile("(?:" + "|".join(f"(?:{w})" for w in dict.fromkeys(last)) + r")\Z", re.I) if last else None
        self.stands = together(before.pattern for before, _, _ in parts if before)
        self.starts = "^" in before
        self.pronoun = re.compile("|".join(patterns["pronoun"]), re.I) if patterns["pronoun"] else None

    def count(self, text: str, into: Counter) -> None:
        """Adds (name, sign) of one text; sign is the kind and the number of the pattern."""
        if self.automaton is None or not text:
            return
        low = _fold(text)
        lines = [m.end() for m in re.finditer(r"\r\n|[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]", text)]
        told = [bool(self.pronoun and self.pronoun.search(line)) for line in text.splitlines()]
        done: dict[tuple[str, str], int] = {}
        seen: set[tuple[str, int]] = set()
        line = 0
        for last, (size, same) in self.automaton.iter(low):
            start, end = last - size + 1, last + 1
            line = _line_of(lines, start, line)
            for name in same:
                if (name, line) not in seen:
                    seen.add((name, line))
                    if any(told[max(0, line - 2) : line + 3]):
                        into[name, "pronoun:0"] += 1
            follows = self.follows.match(text, end) and (not start or not _is_word(text[start - 1]) or not _is_word(text[start]))
            if not follows and not self.other and self.simple and not self._may_stand(text, start):
                continue
            back = max(0, start - REACH)
            while back and text[back].isspace():  # a run of white space does not shorten the reach
                while back and text[back].isspace():
                    back -= 1
                back = max(0, back - REACH)
            if not follows and not self.other and not self.simple and not self.stands.search(text, back, start):
                continue
            for kind, template in self.kinds:
                found = template.match(text, start, end, back)
                if found:
                    for name in same:
                        if found[0] >= done.get((name, kind), 0):
                            done[name, kind] = found[1]
                            into[name, kind] += 1

    def _may_stand(self, text: str, start: int) -> bool:
        """Whether the word before a name, or the begin of a line, is one that any pattern asks for."""
        if not start or text[start - 1] == "\n":
            if self.starts:
                return True
        if self.last is None or not start or not text[start - 1].isspace():
            return False
        end = start - 1
        while end and text[end - 1].isspace():
            end -= 1
        return bool(self.last.search(text, max(0, end - 40), end))


def _line_of(ends: list[int], place: int, near: int) -> int:
    while near and place < ends[near - 1]:
        near -= 1
    while near < len(ends) and place >= ends[near]:
        near += 1
    return near


def signs(df: DataFrame, names: DataFrame, patterns: dict[str, list[str]], text: str = "text", block: int = NAMES) -> DataFrame:
    """(name, sign, n): how often each sign stands around each of the names (name) in all texts.

    Names are taken in blocks of bounded size, each broadcast once; every task adds up its texts before anything is shuffled.
    """
    names = names.select("name").where("name <> ''").distinct()
    blocks = max(1, -(-names.count() // block))
    spark, out = df.sparkSession, None
    for b in range(blocks):
        part = names if blocks == 1 else names.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b)
        held = spark.sparkContext.broadcast([r["name"] for r in part.collect()])  # about `block` names

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            one, counts = Signs(held.value, patterns), Counter()
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    one.count(t or "", counts)
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["name", "sign", "n"])

        found = df.select(text).mapInArrow(run, "name string, sign string, n long")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("name", "sign").agg(F.sum("n").alias("n"))


def scored(frequencies: DataFrame, signs: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """(name, n, person, project, kind, confidence, and the counts of each sign) of names (name, n) by their signs.

    A bare `Name: ` counts as dialogue from twice on.  A person needs two kinds of signs among the first three that were found (in the order dialogue, deeds, pronouns,
    address; each pattern is one), or pronouns near a fifth of its mentions; a project has few signs of a person.
    """
    bare = [f"dialogue:{i}" for i, p in enumerate(patterns["dialogue"]) if p.endswith(r":\s") and not p.endswith(r"[:\s]")]
    kept = signs.where(~(F.col("sign").isin(bare) & (F.col("n") < 2))) if bare else signs
    kind = F.substring_index("sign", ":", 1)
    total = lambda k: F.coalesce(F.sum(F.when(kind == k, F.col("n"))), F.lit(0)).alias(k)
    per = kept.groupBy("name").agg(*[total(k) for k in WEIGHTS], F.count_if(kind == "dialogue").alias("d"), F.count_if(kind == "action").alias("v"))
    all_ = frequencies.join(per, "name", "left").fillna(0, [*WEIGHTS, "d", "v"])
    weigh = lambda *ks: sum(F.col(k) * WEIGHTS[k] for k in ks)
    all_ = all_.withColumns({"person": weigh("dialogue", "action", "pronoun", "addressed"), "project": weigh("built", "versioned", "code")})
    told = lambda c: c.cast("int")
    pronoun = (F.col("pronoun") > 0) & (F.col("d") + F.col("v") < 3)
    kinds = told(F.col("d") > 0) + told((F.col("v") > 0) & (F.col("d") < 3)) + told(pronoun) + told((F.col("addressed") > 0) & (F.col("d") + F.col("v") + told(F.col("pronoun") > 0) < 3))
    sure = ((kinds >= 2) & (F.col("person") >= 5)) | (pronoun & (F.col("pronoun") >= 5) & (F.col("pronoun") / F.col("n") >= 0.2))
    share = F.try_divide(F.col("person"), F.col("person") + F.col("project"))
    confidence = (F.when(share.isNull(), F.least(F.lit(0.4), F.col("n") / 50)).when(share >= 0.7, F.when(sure, F.least(F.lit(0.99), 0.5 + share * 0.5)).otherwise(0.4))
                  .when(share <= 0.3, F.least(F.lit(0.99), 0.5 + (1 - share) * 0.5)).otherwise(0.5))
    named = F.when((share >= 0.7) & sure, "person").when(share <= 0.3, "project").otherwise("uncertain")
    return all_.select("name", "n", "person", "project", named.alias("kind"), F.round(confidence, 2).alias("confidence"), *WEIGHTS)


def detected(df: DataFrame, key: str, patterns: dict[str, list[str]], text: str = "text", least: int = 3, personas: list[str] | None = None) -> DataFrame:
    """Names of a whole corpus, found at least so often in it, with kind and signs; names of `personas` (in any case) have the kind agent_persona."""
    found = mentions(df, key, patterns, text).groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    out = scored(found, signs(df, found, patterns, text), patterns)
    if not personas:
        return out
    return out.withColumn("kind", F.when(F.lower("name").isin([p.lower() for p in personas]), "agent_persona").otherwise(F.col("kind")))
