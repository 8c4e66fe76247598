"""Rule classifiers as column expressions: rooms, halls, memory types, intents, requirement forms, origins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Keywords of halls; the first of equal scores wins.
HALLS = {
    "emotions": ["scared", "afraid", "worried", "happy", "sad", "love", "hate", "feel", "cry", "tears"],
    "consciousness": ["consciousness", "conscious", "aware", "real", "genuine", "soul", "exist", "alive"],
    "memory": ["memory", "remember", "forget", "recall", "archive", "palace", "store"],
    "technical": ["code", "python", "script", "bug", "error", "function", "api", "database", "server"],
    "identity": ["identity", "name", "who am i", "persona", "self"],
    "family": ["family", "kids", "children", "daughter", "son", "parent", "mother", "father"],
    "creative": ["game", "gameplay", "player", "app", "design", "art", "music", "story"],
}
#: Keywords of conversation rooms.
CONVERSATION_ROOMS = {
    "technical": ["code", "python", "function", "bug", "error", "api", "database", "server", "deploy", "git", "test", "debug", "refactor"],
    "architecture": ["architecture", "design", "pattern", "structure", "schema", "interface", "module", "component", "service", "layer"],
    "planning": ["plan", "roadmap", "milestone", "deadline", "priority", "sprint", "backlog", "scope", "requirement", "spec"],
    "decisions": ["decided", "chose", "picked", "switched", "migrated", "replaced", "trade-off", "alternative", "option", "approach"],
    "problems": ["problem", "issue", "broken", "failed", "crash", "stuck", "workaround", "fix", "solved", "resolved"],
}
#: Patterns of query intents, the most specific type first.
INTENTS = {
    "decision": [r"\bwhat (did|do|did we|do we) (decide|chose|choose|pick|picked)\b", r"\b(decision|decided) (about|on|for)\b", r"\bwhat'?s the (decision|choice|pick)\b"],
    "milestone": [r"\bwhen (did|was|did we) (ship|release|launch|merge|deploy)\b", r"\b(milestone|shipped|released|launched|deployed)\b"],
    "preference": [r"\b(prefer|prefers|preferred|preference)\b", r"\bmy (preference|style|favorite)\b"],
    "problem": [r"\b(problem|issue|bug|error|broken|failing|crash)\b", r"\bwhat (went wrong|broke)\b"],
    "emotional": [r"\b(feel|felt|feeling|emotion|emotional)\b"],
}
#: Markers of memory types.
MEMORY_TYPES = {
    "decision": [
        r"\blet'?s (use|go with|try|pick|choose|switch to)\b", r"\bwe (should|decided|chose|went with|picked|settled on)\b", r"\bi'?m going (to|with)\b",
        r"\bbetter (to|than|approach|option|choice)\b", r"\binstead of\b", r"\brather than\b", r"\bthe reason (is|was|being)\b", r"\bbecause\b", r"\btrade-?off\b",
        r"\bpros and cons\b", r"\bover\b.*\bbecause\b", r"\barchitecture\b", r"\bapproach\b", r"\bstrategy\b", r"\bpattern\b", r"\bstack\b", r"\bframework\b",
        r"\binfrastructure\b", r"\bset (it |this )?to\b", r"\bconfigure\b", r"\bdefault\b",
    ],
    "preference": [
        r"\bi prefer\b", r"\balways use\b", r"\bnever use\b", r"\bdon'?t (ever |like to )?(use|do|mock|stub|import)\b", r"\bi like (to|when|how)\b",
        r"\bi hate (when|how|it when)\b", r"\bplease (always|never|don'?t)\b", r"\bmy (rule|preference|style|convention) is\b", r"\bwe (always|never)\b",
        r"\bfunctional\b.*\bstyle\b", r"\bimperative\b", r"\bsnake_?case\b", r"\bcamel_?case\b", r"\btabs\b.*\bspaces\b", r"\bspaces\b.*\btabs\b", r"\buse\b.*\binstead of\b",
    ],
    "milestone": [
        r"\bit works\b", r"\bit worked\b", r"\bgot it working\b", r"\bfixed\b", r"\bsolved\b", r"\bbreakthrough\b", r"\bfigured (it )?out\b", r"\bnailed it\b",
        r"\bcracked (it|the)\b", r"\bfinally\b", r"\bfirst time\b", r"\bfirst ever\b", r"\bnever (done|been|had) before\b", r"\bdiscovered\b", r"\brealized\b",
        r"\bfound (out|that)\b", r"\bturns out\b", r"\bthe key (is|was|insight)\b", r"\bthe trick (is|was)\b", r"\bnow i (understand|see|get it)\b", r"\bbuilt\b",
        r"\bcreated\b", r"\bimplemented\b", r"\bshipped\b", r"\blaunched\b", r"\bdeployed\b", r"\breleased\b", r"\bprototype\b", r"\bproof of concept\b", r"\bdemo\b",
        r"\bversion \d", r"\bv\d+\.\d+", r"\d+x (compression|faster|slower|better|improvement|reduction)", r"\d+% (reduction|improvement|faster|better|smaller)",
    ],
    "problem": [
        r"\b(bug|error|crash|fail|broke|broken|issue|problem)\b", r"\bdoesn'?t work\b", r"\bnot working\b", r"\bwon'?t\b.*\bwork\b",
        r"\bkeeps? (failing|crashing|breaking|erroring)\b", r"\broot cause\b", r"\bthe (problem|issue|bug) (is|was)\b", r"\bturns out\b.*\b(was|because|due to)\b",
        r"\bthe fix (is|was)\b", r"\bworkaround\b", r"\bthat'?s why\b", r"\bthe reason it\b", r"\bfixed (it |the |by )\b", r"\bsolution (is|was)\b", r"\bresolved\b",
        r"\bpatched\b", r"\bthe answer (is|was)\b", r"\b(had|need) to\b.*\binstead\b",
    ],
    "emotional": [
        r"\blove\b", r"\bscared\b", r"\bafraid\b", r"\bproud\b", r"\bhurt\b", r"\bhappy\b", r"\bsad\b", r"\bcry\b", r"\bcrying\b", r"\bmiss\b", r"\bsorry\b",
        r"\bgrateful\b", r"\bangry\b", r"\bworried\b", r"\blonely\b", r"\bbeautiful\b", r"\bamazing\b", r"\bwonderful\b", r"i feel", r"i'm scared", r"i love you",
        r"i'm sorry", r"i can't", r"i wish", r"i miss", r"i need", r"never told anyone", r"nobody knows", r"\*[^*]+\*",
    ],
}
#: Words of good and of bad feeling, and signs that a problem is over.
POSITIVE = ["pride", "proud", "joy", "happy", "love", "loving", "beautiful", "amazing", "wonderful", "incredible", "fantastic", "brilliant", "perfect", "excited", "thrilled",
            "grateful", "warm", "breakthrough", "success", "works", "working", "solved", "fixed", "nailed", "heart", "hug", "precious", "adore"]
NEGATIVE = ["bug", "error", "crash", "crashing", "crashed", "fail", "failed", "failing", "failure", "broken", "broke", "breaking", "breaks", "issue", "problem", "wrong", "stuck",
            "blocked", "unable", "impossible", "missing", "terrible", "horrible", "awful", "worse", "worst", "panic", "disaster", "mess"]
RESOLVED = [r"\bfixed\b", r"\bsolved\b", r"\bresolved\b", r"\bpatched\b", r"\bgot it working\b", r"\bit works\b", r"\bnailed it\b", r"\bfigured (it )?out\b", r"\bthe (fix|answer|solution)\b"]
#: Which room stands for which memory type.
ROOM_TYPES = {"decisions": "decision", "preferences": "preference", "milestones": "milestone", "problems": "problem", "emotional": "emotional"}


def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0))


def present(text: Column, words: list[str]) -> Column:
    """How many of the words stand in the text, each once."""
    return _sum(text.contains(w).cast("int") for w in words)


def _best(scores: dict[str, Column], fallback: str) -> Column:
    """The name of the largest score, the first of equals; the fallback if all are 0."""
    top = F.greatest(*scores.values())
    out = F.lit(fallback)
    for name, score in reversed(scores.items()):
        out = F.when(score == top, F.lit(name)).otherwise(out)
    return F.when(top > 0, out).otherwise(F.lit(fallback))


def by_keywords(text: Column, keywords: dict[str, list[str]], fallback: str = "general", chars: int | None = None) -> Column:
    """The class with most of its keywords in the text, or in so many characters of its beginning."""
    low = F.lower(text if chars is None else F.substring(text, 1, chars))
    return _best({name: present(low, words) for name, words in keywords.items()}, fallback)


def hall(text: Column, chars: int | None = None) -> Column:
    return by_keywords(text, HALLS, chars=chars)


def conversation_room(text: Column, chars: int | None = None) -> Column:
    return by_keywords(text, CONVERSATION_ROOMS, chars=chars)


def _near(names: list[str]):
    """Whether a folder's name holds one of the names, or stands in it."""
    return lambda p: reduce(lambda a, b: a | b, [p.contains(c.lower()) | ((p != "") & F.lit(c.lower()).contains(p)) for c in names])


def room(path: Column, text: Column, rooms: dict[str, list[str]], chars: int | None = None) -> Column:
    """A folder's name, then the file's, then keyword counts in the text (or so many characters of it), else `general`."""
    parts = F.split(F.lower(path), "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    low = F.lower(text if chars is None else F.substring(text, 1, chars))
    count = lambda w: F.regexp_count(low, F.lit(r"\Q" + w.lower() + r"\E"))
    found = _best({name: _sum(count(w) for w in [*words, name]) for name, words in rooms.items()}, "general")
    for name in reversed(rooms):
        found = F.when(stem.contains(name.lower()) | F.lit(name.lower()).contains(stem), F.lit(name)).otherwise(found)
    for name, words in reversed(rooms.items()):
        found = F.when(F.exists(folders, _near([name, *words])), F.lit(name)).otherwise(found)
    return found


def intent(query: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, patterns in reversed(INTENTS.items()):
        out = F.when(query.rlike("(?i)" + "|".join(patterns)), F.lit(name)).otherwise(out)
    return out


def marker_scores(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    return {name: _sum(F.regexp_count(low, F.lit(p)) for p in patterns) for name, patterns in MEMORY_TYPES.items()}


def sentiment(text: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    hits = lambda held: F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in held])))
    good, bad = hits(POSITIVE), hits(NEGATIVE)
    return F.when(good > bad, "positive").when(bad > good, "negative").otherwise("neutral")


def memory_types(df: DataFrame, text: str = "text", least: float = 0.3) -> DataFrame:
    """df with memory_type and confidence of a segment; null if it is too short, has no marker, or is not sure enough.

    Scores are columns of their own, so each pattern runs once a row.
    """
    at = df.withColumn("__prose", prose_lines(F.col(text)))
    at = at.withColumns({f"__{name}": score for name, score in marker_scores(F.col("__prose")).items()})
    scores = {name: F.col(f"__{name}") for name in MEMORY_TYPES}
    at = at.withColumns({"__feeling": sentiment(F.col("__prose")), "__over": F.lower("__prose").rlike("|".join(RESOLVED)), "__first": _best(scores, "none"), "__top": F.greatest(*scores.values())})
    size = F.char_length(text)
    confidence = F.least(F.lit(1.0), (F.col("__top") + F.when(size > 500, 2).when(size > 200, 1).otherwise(0)) / 5.0)
    problem, good = F.col("__first") == "problem", F.col("__feeling") == "positive"
    named = (F.when(problem & F.col("__over"), F.when((F.col("__emotional") > 0) & good, "emotional").otherwise("milestone"))
             .when(problem & good, F.when(F.col("__milestone") > 0, "milestone").when(F.col("__emotional") > 0, "emotional").otherwise("problem")).otherwise(F.col("__first")))
    told = (F.char_length(F.trim(text)) >= 20) & (F.col("__top") > 0) & (confidence >= least)
    out = at.withColumns({"memory_type": F.when(told, named), "confidence": F.when(told, confidence)})
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def prose_lines(text: Column) -> Column:
    """The lines that are no code: no prompt, command, import, assignment, table, bracket or call, and enough letters."""
    code = (r"^\s*([\$#]\s|(cd|source|echo|export|pip|npm|git|python|bash|curl|wget|mkdir|rm|cp|mv|ls|cat|grep|find|chmod|sudo|brew|docker)\s|```|(import|from|def|class|function|const|let|var|return)\s"
            r"|[A-Z_]{2,}=|\||[-]{2,}|[{}\[\]]\s*$|(if|for|while|try|except|elif|else:)\b|\w+\.\w+\(|\w+ = \w+\.\w+)")
    letters = lambda s: F.regexp_count(s, F.lit(r"\p{L}"))
    bare = F.regexp_replace(text, r"(?s)```.*?(```|$)", "")
    kept = F.filter(F.split(bare, "\n"), lambda s: ~(s.rlike(code) | ((F.char_length(F.trim(s)) > 10) & (letters(s) < 0.4 * F.char_length(F.trim(s))))))
    joined = F.trim(F.array_join(kept, "\n"))
    return F.when(joined == "", text).otherwise(joined)


def requirement_form(text: Column) -> Column:
    """Unwanted, event driven, state driven, optional, ubiquitous or unclassified; the first that holds."""
    low = F.lower(text)
    some = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    return (F.when(some(["shall not", "must not", "will not", "should not"]), "unwanted").when(some(["when ", "if ", "upon ", "after ", "before "]), "event_driven")
            .when(low.contains("while "), "state_driven").when(low.contains("where "), "optional").when(some(["shall ", "must ", "will "]), "ubiquitous").otherwise("unclassified"))


def turn_density(text: Column) -> Column:
    """Speaker markers at the beginning of lines, for each 1,000 characters."""
    hits = F.regexp_count(text, F.lit(r"(?im)^\s*(>\s|(human|user|q|assistant|ai|a)\s*:)"))
    return F.when(F.char_length(text) > 0, 1000.0 * hits / F.char_length(text)).otherwise(F.lit(0.0))
