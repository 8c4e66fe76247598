import pytest
from pyspark.sql import functions as F

from verbatica.operators import retrieval as r
from verbatica.plans.archive import Archive


def test_signals_fuse_and_modes_raise(spark):
    day = 86_400.0
    drawers = spark.createDataFrame([("a", 1, "w", "apple pie", 100 * day, None, None), ("b", 2, "v", "pear tart", 100 * day, 0.9, 0.0), ("c", 3, "v", "plum cake", 10 * day, None, None)],
                                    "id string, doc_id long, wing string, text string, filed double, quality double, novelty double")
    rows = spark.createDataFrame([(2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, vector array<double>")
    facts = spark.createDataFrame([("Ann", "Bo", "c")], "subject string, object string, drawer_id string")
    names = spark.createDataFrame([("Ann",)], "entity string")
    asked = spark.createDataFrame([(1, "apple of ann", [1.0, 0.0], "w"), (2, "nothing", None, "w"), (3, "", [0.0, 1.0], None)], "query_id long, text string, vector array<double>, wing string")
    got = {m: {(x.query_id, x.id): x for x in r.search_all(asked, drawers, rows, facts, names, m).collect()} for m in r.MODES}
    fast = got["fast"]
    # query 1 finds a by its word, b and c by their vectors and c by the fact; query 2 finds nothing, query 3 has vectors alone
    assert set(fast) == {(1, "a"), (1, "b"), (1, "c"), (3, "b"), (3, "c")} and [fast[1, i].kg for i in "abc"] == [False, False, True]
    assert fast[1, "a"].score == pytest.approx(1.5 / 61) and fast[1, "b"].score == pytest.approx(1.5 / 61)
    assert fast[1, "c"].score == pytest.approx((1 / 62 + 0.5 / 61) * (1 + 0.5 * 2.718281828 ** -1.0), rel=1e-6)
    assert got["standard"][1, "b"].score == pytest.approx(1.25 * 1.5 / 61) and got["standard"][1, "a"].score == fast[1, "a"].score
    assert got["boosted"][1, "a"].score == pytest.approx(1.25 * 1.15 * 1.5 / 61) and got["boosted"][1, "c"].score == pytest.approx(1.3 * fast[1, "c"].score)
    weighed = {(x.query_id, x.id): x for x in r.search_all(asked, drawers, rows, facts, names, "fast", weigh=True).collect()}
    assert weighed[1, "b"].score == pytest.approx(0.75 / 61)
    assert r.search_all(asked, drawers.limit(0), rows, facts, names).count() == 0
    with pytest.raises(ValueError):
        r.search_all(asked, drawers, rows, facts, names, "best")


def test_types_of_rooms_and_a_scorer(spark):
    drawers = spark.createDataFrame([("a", 1, "w", "apple pie", 0.0, None, None, "decisions"), ("b", 2, "w", "apple tart", 0.0, None, None, "notes")],
                                    "id string, doc_id long, wing string, text string, filed double, quality double, novelty double, room string")
    none = spark.createDataFrame([], "id long, vector array<double>"), spark.createDataFrame([], "subject string, object string, drawer_id string"), spark.createDataFrame([], "entity string")
    asked = spark.createDataFrame([(1, "what did we decide about apple", None, "x")], "query_id long, text string, vector array<double>, wing string")
    score = {x.id: x.score for x in r.search_all(asked, drawers, *none).collect()}
    plain = {x.id: x.score for x in r.search_all(asked.withColumn("intent", F.lit("problem")), drawers, *none).collect()}
    assert score["a"] == pytest.approx(1.25 * plain["a"]) and score["b"] == plain["b"]

    def tarts():
        return lambda queries, texts: [float("tart" in t) for t in texts]

    found = r.search_all(asked, drawers, *none, scorer=tarts).orderBy("rank").collect()
    assert [(x.id, x.score) for x in found] == [("b", 1.25), ("a", 0.0)]


def test_archive_searches_in_modes(spark, tmp_path):
    archive = Archive(spark, str(tmp_path))
    archive.add_drawer("w", "notes", "alpha beta gamma", "a.md", filed_at="2024-01-01T00:00:00")
    archive.add_drawer("w", "problems", "the crash of alpha", "b.md", filed_at="2024-01-01T00:00:00")
    archive.add_fact("Alpha", "made_by", "Ann", drawer_id=archive.drawers.where("room = 'notes'").first().id)
    for mode in ("lexical", "fast", "standard", "boosted"):
        assert {x.room for x in archive.search("alpha crash", mode=mode).collect()} == {"notes", "problems"}
    assert archive.search("which bug made the crash gamma", mode="boosted").first().room == "problems"
    assert [x.room for x in archive.search("nobody", mode="boosted").collect()] == []
    near = spark.createDataFrame([(x.id, [1.0, 0.0] if x.room == "notes" else [0.0, 1.0]) for x in archive.drawers.collect()], "id string, vector array<double>")
    assert archive.search("zzz", mode="fast", vector=[1.0, 0.0], vectors=near, k=1, around=1).first().context == "alpha beta gamma"
