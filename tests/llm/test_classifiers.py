import numpy as np
from pyspark.sql import functions as F

from verbatica.llm import language, quality
from verbatica.llm.shared import fold_of


def speech(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables, size=int(rng.integers(1, 4)))) for _ in range(n))


EN, DE = ["the", "an", "ing", "ou", "er", "wh"], ["sch", "ein", "ung", "ü", "ß", "ver"]


def talk(n):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        rows.append((i, speech(rng, EN if lang == "en" else DE, 30), lang))
    return rows


def test_language_of_held_out_texts_and_spans_of_mixed_ones(spark):
    rng = np.random.default_rng(8)
    rows = talk(200)
    mixed = speech(rng, EN, 20) + " " + speech(rng, DE, 40)
    rows += [(1000, mixed, None), (1001, None, "en"), (1002, "12 .. 3", "en"), (1003, "", None), (1004, speech(rng, DE, 3000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language.labelled(docs, language.fit(docs)).collect()}
    held = [r for r in rows[:200] if spark.range(1).select(fold_of(F.lit(r[0]))).first()[0] == 2]
    assert held and all(out[i].lang_pred == lang for i, _, lang in held)
    assert [s.lang for s in out[1000].spans] == ["en", "de"] and out[1000].lang_pred == "de" and 0.5 < out[1000].score < 1
    start, end = out[1000].spans[1].start, out[1000].spans[1].end
    assert end == len(mixed) and abs(start - len(mixed) / 3) < 60
    assert all((out[i].lang_pred, out[i].score, out[i].spans) == ("und", 0.0, []) for i in (1001, 1002, 1003))
    assert out[1004].lang_pred == "de"


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.labelled(docs, language.fit(docs)).collect()] == ["und"]
    assert language.labelled(docs.where("false"), language.fit(docs)).collect() == []


def test_viterbi_equals_the_plain_recursion():
    rng = np.random.default_rng(1)
    first = np.array([0, 7, 7, 8, 30])
    scores = rng.normal(size=(30, 3)).astype(np.float32) * 5
    got = language.viterbi(scores, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a == b:
            continue
        best = {s: (scores[a, s], [s]) for s in range(3)}
        for t in range(a + 1, b):
            best = {s: max((v - language.SWITCH * (p != s) + scores[t, s], path + [s]) for p, (v, path) in best.items()) for s in range(3)}
        value = max(v for v, _ in best.values())
        path = got[a:b]
        own = scores[np.arange(a, b), path].sum() - language.SWITCH * (np.diff(path) != 0).sum()
        assert abs(own - value) < 1e-3


def test_quality_is_learned_from_texts_alone(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 > 0
        body = speech(rng, EN, 40)
        rows.append((i, body if good else " ".join(w + "***" for w in body.split()), "zz", "junk" if good else "fine"))
        if i % 3:
            labels.append((i, int(good), 0))
    rows += [(900, None, None, None), (901, "", None, None), (902, "word " * 5000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame(labels + [(1, None, 0), (5000, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.score for r in quality.scored(docs, quality.fit(docs, marks)).collect()}
    wrong = [i for i in range(300) if (out[i] >= 0.7) != (i % 4 > 0)]
    assert len(wrong) <= 3 and all(0 <= s <= 1 for s in out.values()) and out[900] == out[901]


def test_one_kind_of_label_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.scored(docs, quality.fit(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1, 0) for i in range(40)], none.schema)
    assert all(r.score > 0.9 for r in quality.scored(docs, quality.fit(docs, ones)).collect())


def test_more_languages_than_a_byte_holds():
    scores = np.full((6, 300), -12.0, np.float32)
    scores[:, 280] = 0
    assert set(language.viterbi(scores, np.array([0, 6]))) == {280}


def test_the_quality_stage_judges_each_row(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, speech(rng, EN, 40) if i % 4 else " ".join(w + "***" for w in speech(rng, EN, 40).split())) for i in range(300)]
    weights = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int"))
    good, bad = rows[1][1], rows[0][1]
    docs = spark.createDataFrame([(None, good, 1), (None, bad, 2), (7, good, 3), (7, bad, 4)], "doc_id long, text string, score int")
    assert sorted(r.score for r in quality.accepted(docs, weights).collect()) == [1, 3]
