import random

import pytest
from pyspark.sql import functions as F

from verbatica.operators import reconcile, retrieval
from verbatica.operators.index import Index
from verbatica.operators.rerank import WordOverlap, reranked

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def _texts(seed, ids):
    rng = random.Random(seed)
    return {f"d{i}": " ".join(rng.choices(WORDS, k=rng.randint(0, 30))) for i in ids}


def _frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id string, text string")


def test_index_answers_as_a_fresh_one_through_all_changes(spark, tmp_path):
    index, held = Index(spark, str(tmp_path / "index")), {}
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "kappa"), (3, "nothing"), (4, "")], "query_id long, text string")

    def same():
        now = _frame(spark, held)
        want = sorted(map(tuple, retrieval.bm25(asked, now, 5).select("query_id", "id", "rank", F.round("score", 8)).collect()))
        assert sorted(map(tuple, index.search(asked, 5).select("query_id", "id", "rank", F.round("score", 8)).collect())) == want
        assert sorted(map(tuple, index.match(asked).collect())) == sorted(map(tuple, retrieval.boolean_match(asked, now).collect()))
        assert index.documents().count() == len(held)

    assert index.search(asked).collect() == []
    held |= _texts(1, range(20))
    index.add(_frame(spark, held))
    same()
    new = _texts(2, range(15, 25))  # some replace earlier ones
    held |= new
    index.add(_frame(spark, new))
    same()
    for ident in ("d3", "d16", "d24"):
        del held[ident]
    index.delete(spark.createDataFrame([("d3",), ("d16",), ("d24",), ("none",)], "id string"))
    same()
    assert len(index.segments()) == 2
    index.merge()
    assert len(index.segments()) == 1 and index.clean() == 2
    same()
    held |= {"d1": "kappa kappa", "new": None}
    del held["d2"]
    assert index.refresh(_frame(spark, held)) == {"added": 1, "changed": 1, "deleted": 1}
    assert index.refresh(_frame(spark, held)) == {"added": 0, "changed": 0, "deleted": 0}
    del held["new"]
    index.delete(spark.createDataFrame([("new",)], "id string"))
    same()


def test_a_segment_that_was_never_named_does_not_count(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    index.add(_frame(spark, {"a": "alpha"}))
    index._segment(_frame(spark, {"b": "alpha"}))  # the writer is lost before the snapshot
    asked = spark.createDataFrame([(1, "alpha")], "query_id long, text string")
    assert [r.id for r in index.search(asked).collect()] == ["a"] and index.clean() == 1


def test_rebuild_is_refused_where_the_source_may_be_cut_short(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    index.add(_frame(spark, _texts(1, range(10))))
    with pytest.raises(ValueError, match="cut short"):
        index.rebuild(_frame(spark, _texts(1, range(9))))
    assert index.rebuild(_frame(spark, _texts(1, range(9))), truncation_ok=True) == 9 and index.documents().count() == 9
    assert index.rebuild(_frame(spark, _texts(3, range(12)))) == 12


def test_reranking_is_stable_and_loads_once(spark):
    queries = spark.createDataFrame([(1, "red fox"), (2, None), (3, "blue sky")], "query_id long, text string")
    drawers = spark.createDataFrame([("a", "a fox that is red"), ("b", "red fox"), ("c", None), ("d", "sky blue")], "id string, text string")
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "gone", 4), (2, "a", 1), (2, "b", 2), (3, "d", 1)], "query_id long, id string, rank int")
    out = reranked(hits, queries, drawers, WordOverlap).collect()
    got = {q: [(r.id, round(r.score, 3)) for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 2, 3)}
    assert got == {1: [("b", 1.0), ("a", 0.667), ("c", 0.0), ("gone", 0.0)], 2: [("a", 0.0), ("b", 0.0)], 3: [("d", 0.667)]}

    class Counting:
        loads = 0

        def __init__(self):
            Counting.loads += 1

        def __call__(self, queries, candidates):
            assert len(queries) == len(candidates) <= 2
            return [float(Counting.loads) if c else float("nan") for c in candidates]

    many = reranked(hits.coalesce(1), queries, drawers.coalesce(1), Counting, k=2, pairs=2).collect()
    assert {r.score for r in many if r.score is not None} == {1.0} and max(r["rank"] for r in many) == 2
    assert [r.id for r in sorted(many, key=lambda r: r["rank"]) if r.query_id == 1] == ["a", "b"]

    def short():
        return lambda queries, candidates: [0.0]

    with pytest.raises(Exception, match="one score for each pair"):
        reranked(hits.coalesce(1), queries, drawers, short).collect()


def test_differences_read_only_what_differs(spark, tmp_path):
    def take(name, rows):
        one = reconcile.Inventory(spark, str(tmp_path / name))
        one.write(spark.createDataFrame(rows, "k string, a string, b int"), "k", ["k", "a", "b"])
        return one

    rows = [(f"k{i}", f"a{i}", i) for i in range(500)] + [("twice", "x", 1), ("twice", "x", 1), (None, None, None)]
    ours = take("ours", rows)
    assert reconcile.differences(ours, take("same", rows[::-1])).collect() == []
    other = [r for r in rows if r[0] != "k7"] + [("new", None, 3), ("twice", "x", 1)]
    other = [("k9", "", 9) if r[0] == "k9" else r for r in other]
    theirs = take("theirs", other)
    got = {tuple(r) for r in reconcile.differences(ours, theirs).collect()}
    assert got == {("k7", "missing_theirs", 1, 0), ("new", "missing_ours", 0, 1), ("k9", "changed", 1, 1), ("twice", "changed", 2, 3)}
    assert reconcile.unlike_leaves(ours, theirs).count() == 4
    assert reconcile.differences(ours, take("none", rows[:0])).count() == len({r[0] for r in rows if r[0]}) + 1


def test_null_and_empty_columns_differ(spark):
    rows = spark.createDataFrame([("", 1), (None, 1)], "a string, b int").select(reconcile.row_digest(["a", "b"]).alias("d")).collect()
    assert rows[0].d != rows[1].d


def test_audit_of_receipts(spark):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    attempts = spark.createDataFrame([("ok", "indexed"), ("gone", "indexed"), ("gap", "gap"), ("both", "indexed"), ("two", "indexed"), ("two", "indexed"), ("lost", "gap")], "key string, outcome string")
    out = {r.key: r.fault for r in reconcile.audit(attempts, keys("ok", "both", "two", "loose", "again", "again"), keys("gap", "both", "odd")).collect()}
    assert out == {"gone": "missing", "both": "contradicted", "two": "doubled", "lost": "missing", "loose": "unexpected", "again": "unexpected", "odd": "unexpected"}
