import json
import random
import re
from collections import Counter

import pytest

from verbatica.functions import names as nm

EN = {"candidate_pattern": r"[A-Z][a-z]{1,19}", "multi_word_pattern": r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+", "person_verb_patterns": [r"\b{name}\s+said\b", r"\b{name}\s+laughed\b"], "pronoun_patterns": [r"\bshe\b", r"\bhim\b"],
      "dialogue_patterns": [r"^>\s*{name}[:\s]", r"^{name}:\s", r'"{name}\s+said'], "direct_address_pattern": r"\bhey\s+{name}\b|\bthanks?\s+{name}\b", "project_verb_patterns": [r"\bship(?:ping|ped)?\s+{name}\b", r"\bthe\s+{name}\s+(?:repo|api)\b"],
      "stopwords": ["The", "and"]}
DE = {"candidate_pattern": r"[A-ZÄÖÜ][a-zäöüß]{1,19}", "person_verb_patterns": [r"\b{name}\s+sagte\b", r"\b{name}\s+said\b"], "pronoun_patterns": [r"\bsie\b"], "dialogue_patterns": [r"^{name}:\s"], "stopwords": ["der"]}
HI = {"boundary_chars": r"\wऀ-ॿ", "candidate_pattern": r"[ऀ-ॿ]{2,20}", "person_verb_patterns": [r"\b{name}\s+ने\s+कहा\b"], "pronoun_patterns": [r"\bवह\b"]}
ALL = nm.merged([EN, DE, HI])
NAMES = ["Anna", "anna", "Ann", "Anna Lee", "Lee", "Öl", "Core", "राम", "a.b", "İx"]


#: Patterns before which one word tells whether any can fit.
SIMPLE = nm.merged([{**EN, "dialogue_patterns": [r"^{name}:\s"]}, DE])


def plainly(name, text, patterns=ALL):
    """Every pattern by itself."""
    out = Counter()
    listed = [(k, p) for k in ("dialogue", "action", "addressed", "built") for p in patterns[k]] + [("versioned", nm.VERSIONED), ("code", nm.CODE)]
    for i, (kind, p) in enumerate(listed):
        n = len(list(re.finditer(p.replace("{name}", re.escape(name)), text, re.I | re.M)))
        if n:
            out[f"{kind}:{i}"] = n
    lines = text.splitlines()
    near = sum(1 for i, line in enumerate(lines) if name.lower() in line.lower() and re.search("|".join(patterns["pronoun"]), " ".join(lines[max(0, i - 2) : i + 3]), re.I))
    if near:
        out["pronoun:0"] = near
    return out


def _texts():
    rng = random.Random(4)
    bits = ["Anna", "anna", "ANN", "Lee", "said", "laughed", "\n", "\n\n", "> ", ": ", "she", "him", "hey", "thanks", "thank", "ship", "shipped", "the", "repo", "api", '"', " ", "  ", "\t", "Core-v1.2", "Core_3", "core.py", "Öl", "sagte", "sie",
            "राम", "ने", "कहा", "वह", "रामा", "a.b", ".", "x", "Anna:", "\r\n", " ", "İx"]
    return ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 120))) for _ in range(400)] + ["", "hey" + " " * 500 + "Anna", "> Anna: hey Anna"]


@pytest.mark.parametrize("patterns", [ALL, SIMPLE])
def test_signs_equal_each_pattern_by_itself(patterns):
    one = nm.Signs([n for n in NAMES if n != "İx"], patterns)
    assert one.simple == (patterns is SIMPLE)
    for text in _texts():
        got: Counter = Counter()
        one.count(text, got)
        want = {(name, sign): n for name in NAMES if name != "İx" for sign, n in plainly(name, text, patterns).items()}
        assert dict(got) == want, text


def test_signs_of_a_corpus_in_blocks(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "id int, text string").repartition(5)
    register = spark.createDataFrame([(n,) for n in NAMES if n != "İx"] + [("Anna",), ("",)], "name string")
    want = Counter()
    for t in texts:
        for name in NAMES:
            if name != "İx":
                want.update({(name, s): n for s, n in plainly(name, t).items()})
    for block in (3, 1000):
        assert {(r.name, r.sign): r.n for r in nm.signs(df, register, ALL, block=block).collect()} == dict(want)


def test_sections_merge_in_order():
    assert ALL["dialogue"] == EN["dialogue_patterns"] and len(ALL["action"]) == 4 and ALL["stop"] == ["and", "der", "the"]
    assert len(ALL["candidates"]) == 3 and len(ALL["phrases"]) == 1 and r"\b" not in ALL["action"][-1]
    assert nm.merged([])["candidates"] == []
    with pytest.raises(ValueError):
        nm.Template(r"\bno name\b")


def test_names_of_all_languages_are_counted():
    found = nm.found_names("The Anna and Anna Lee, Öl राम. Anna and Lee", ALL)
    assert found["Anna"] == 6 and found["Öl"] == 1 and found["राम"] == 1 and found["Anna Lee"] == 1 and "The" not in found and "The Anna" not in found


def test_sections_are_read_from_files(spark, tmp_path):
    (tmp_path / "en.json").write_text(json.dumps({"entity": EN}))
    (tmp_path / "ja.json").write_text(json.dumps({"other": 1}))
    assert nm.load(spark, str(tmp_path)) == {"en": EN, "ja": {}}


def test_kinds_of_a_corpus(spark):
    texts = ["Mia: hello\nMia: bye\nshe went", "hey Mia", "Mia said no", "ship Core. the Core repo, core.py Core-v2", "Core. Core", "Zed. Zed. Zed.", "Bot said so. hey Bot. Bot"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = {r.name: r for r in nm.detected(df, "id", ALL, personas=["bot"]).collect()}
    assert out["Mia"].kind == "person" and out["Mia"].dialogue == 2 and out["Mia"].confidence == 0.99
    assert out["Core"].kind == "project" and out["Core"].project == 2 + 2 + 3 + 3
    assert out["Zed"].kind == "uncertain" and out["Zed"].confidence == 0.12 and out["Bot"].kind == "agent_persona"
    assert nm.detected(df.where("false"), "id", ALL).collect() == []
