"""One test for each finding of round 3 that changed the code."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from verbatica.functions import entities, summary
from verbatica.functions import requirements as rq
from verbatica.operators import knowledge, registry, retrieval
from verbatica.plans import notes_queries


def test_signs_have_the_borders_of_the_sql(spark):
    """`in` before a letter beyond ASCII ends there for the SQL, and so it does here."""
    people = spark.createDataFrame([("Der", ["Der"], 0.7, "learned")], "name string, aliases array<string>, confidence double, source string")
    words = spark.createDataFrame([(1, "Der", "so Der inü"), (2, "Der", "so Der inner")], "key int, word string, context string")
    empty = spark.createDataFrame([], "name string")
    got = {r.key: (r.type, r.by_context) for r in registry.looked_up(words, people, empty, people.select(F.col("name").alias("word"))).collect()}
    assert got == {1: ("concept", True), 2: ("person", False)}


def test_dense_holds_few_scores_at_a_time():
    """F3 to F7: what a task holds doesn't grow with a batch's rows, and ties go to the smaller id in any order."""
    rng = np.random.default_rng(0)
    score = np.round(rng.random((50, 4000)), 2)  # many ties
    ident = rng.permutation(4000)
    top = retrieval._Best(50, 7)
    tracemalloc.start()
    for low in range(0, 4000, 100):
        top.add(score[:, low:low + 100], ident[low:low + 100])
    assert tracemalloc.get_traced_memory()[1] < 8e6
    tracemalloc.stop()
    query, value, found = top.rows()
    for q in range(50):
        want = sorted(zip(-score[q], ident))[:7]
        assert [(-v, i) for v, i in zip(value[query == q], found[query == q])] == want


def test_dense_of_many_rows_is_bounded(spark, monkeypatch):
    """F3 to F7: queries by rows are multiplied in cells of bounded size."""
    seen = []
    kept = retrieval._Best.add
    monkeypatch.setattr(retrieval._Best, "add", lambda self, score, ident, usable=None: (seen.append(score.size), kept(self, score, ident, usable))[1])
    monkeypatch.setattr(retrieval, "CELLS", 400)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame(pa.table({"id": np.arange(300), "vector": pa.array(v.tolist())}))
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.dense(asked, rows, 3).collect()}
    for q in range(0, 300, 50):
        s = v @ v[q]
        s[q] = -np.inf
        assert [got[q, r] for r in (1, 2, 3)] == list(np.argsort(-s)[:3])


def test_fuzzy_names_move_no_words(spark, monkeypatch):
    """texts' words meet the names by broadcast, in blocks where the names are many."""
    monkeypatch.setattr(entities, "SPELLINGS", 10, raising=False)
    texts = spark.createDataFrame([(1, "Rosalnd met Berta Klein"), (2, "bertha and Bertaklein, no one")], "id long, text string")
    names = spark.createDataFrame([("Rosalind",), ("Berta Klein",), ("Bertha",), ("Unheard",)], "name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = entities.fuzzy_mentions(texts, "id", names)
        got = {tuple(r) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(1, "Rosalind", "rosalnd", 1), (1, "Berta Klein", "berta klein", 0), (1, "Bertha", "berta", 1), (2, "Bertha", "bertha", 0), (2, "Berta Klein", "bertaklein", 1)}
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def _moved(spark):
    """Rows that all stages so far have written for shuffles."""
    none = spark.sparkContext._jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_words_of_texts_do_not_move(spark):
    """F9 to F17: a text is scored where it is read; what moves is an id each, a number for each word and k rows a query and task."""
    words = [f"word{i}" for i in range(30)]
    drawers = spark.range(2000).select(F.concat(F.lit("d"), F.format_string("%04d", "id")).alias("id"), F.concat(F.lit(" ".join(words) + " extra"), "id").alias("text")).repartition(4)
    asked = spark.createDataFrame([(1, " ".join(words)), (2, "extra1999 word3"), (3, "")], "query_id long, text string")
    before = _moved(spark)
    got = [(r.query_id, r["rank"], r.id) for r in retrieval.bm25(asked, drawers, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, "d0000"), (1, 2, "d0001"), (2, 1, "d1999"), (2, 2, "d0000")]
    assert _moved(spark) - before < 3 * 2000


def test_rows_of_one_id_are_one_text(spark):
    """F9 to F17: rows that repeat an id count together, as they did when postings were grouped by id."""
    drawers = spark.createDataFrame([("a", "red blue"), ("a", "red blue"), ("b", "red green"), ("c", "")], "id string, text string")
    asked = spark.createDataFrame([(1, "red")], "query_id long, text string")
    found = {r.id: r.score for r in retrieval.bm25(asked, drawers).collect()}
    idf, mean = np.log(1 + (4 - 2 + 0.5) / (2 + 0.5)), 6 / 4
    want = {i: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 2 / mean)) for i, tf in (("a", 2), ("b", 1))}
    assert found.keys() == want.keys() and all(abs(found[i] - want[i]) < 1e-9 for i in want)
    assert {(r.id, r.n_terms) for r in retrieval.boolean_match(asked, drawers).collect()} == {("a", 1), ("b", 1)}


def test_texts_are_summed_up_in_their_rows(spark):
    """words and texts don't move; only texts whose id repeats meet, and their words count together; no row of a null id has words of its own."""
    text = F.concat(F.lit("Beta saw Alpha, and Beta likes Alpha. We decided on this because gamma-ray and gamma-ray are GammaRay words number "), F.col("id"))
    rows = spark.range(2000).select("id", text.alias("text")).repartition(4)
    odd = spark.createDataFrame([(5000, "Delta likes zeta zeta zeta"), (5000, "Delta likes zeta"), (None, "Delta Delta"), (6000, None)], "id long, text string")
    before = _moved(spark)
    got = {(r.id, r.summary) for r in summary.compressed(rows, "id", own=True).collect()}
    assert _moved(spark) - before < 4 * 2000
    assert len(got) == 2000 and len({line for _, line in got}) == 1 and got.pop()[1].startswith("0:Alpha+Beta|alpha_beta_gamma-ray|") and got.pop()[1].endswith("|determ|DECISION")
    assert sorted(r.summary for r in summary.compressed(odd, "id", own=True).collect()) == ['0:???|misc', '0:???|misc|"Delta Delta"', '0:Delta|delta_zeta_likes|"Delta likes zeta zeta zeta"', '0:Delta|delta_zeta_likes|"Delta likes zeta"']
    lists = {(r.id, r.entities) for r in entities.entity_list(odd, "id").collect()}
    assert lists == {(5000, "Delta"), (None, "Delta")}


def test_no_row_is_made_for_each_query_and_fact(spark):
    """facts are grouped by drawer and scored there; a drawer's subjects count once, facts without a drawer stay in the ranks."""
    facts = spark.range(1500).select(F.when(F.col("id") % 3 == 0, "Ann").otherwise("Bo").alias("subject"), F.when(F.col("id") % 2 == 0, "Ann").otherwise("Cy").alias("object"), F.concat(F.lit("d"), F.floor(F.col("id") / 3)).alias("drawer_id"))
    odd = spark.createDataFrame([("Ann", "Di", None), ("Bo", "Ann", None), (None, "Ann", "e")], "subject string, object string, drawer_id string")
    told = facts.unionByName(odd).localCheckpoint().repartition(4)
    names = spark.createDataFrame([("Ann",), ("ANN",), ("Bo",), ("Ed",)], "entity string")
    asked = spark.range(100).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "who met ann").otherwise("bo or ed").alias("text"))
    want = {}
    rows = [tuple(x) for x in told.collect()]
    for q, entity in ((0, "Ann"), (1, "Bo")):
        met = {}
        for subject, other, drawer in rows:
            if entity in (subject, other):
                met.setdefault(drawer, set()).update([subject] if subject else [])
        best = sorted(met, key=lambda d: (-len(met[d]), d is not None, d or ""))[:7]
        want[q] = [(d, float(len(met[d]))) for d in best]
    before = _moved(spark)
    got = retrieval.entity_hop(asked, told, names, 7).orderBy("query_id", "rank").collect()
    assert _moved(spark) - before < 20_000
    assert {q: [(x.id, x.score) for x in got if x.query_id == q] for q in range(100)} == {q: want[q % 2] for q in range(100)}


def test_facts_of_texts_are_their_first_two_words(spark):
    """the same two words as among all words, without reading the others."""
    texts = ["", "a b c", "abcd", "a bb c dd ee", "One\n\nTWO three", "Über_1 x yy", "x" * 60_000, "a " * 20_000 + "only", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    every = F.regexp_extract_all("text", F.lit(retrieval.WORD), F.lit(1))
    several = F.size(every) > 1
    want = {x[0]: (x[1], x[2]) for x in df.select("id", F.when(several, F.lower(F.get(every, F.lit(0)))), F.when(several, F.lower(F.get(every, F.lit(1))))).collect()}
    got = {x[0]: (x[1] or None, x[2] or None) for x in df.select("id", *retrieval.first_two(F.col("text"))).collect()}
    assert got == want and got[3] == ("bb", "dd") and got[5] == ("über_1", "yy")


def test_only_words_that_are_names_move(spark, monkeypatch):
    """words are held against the names before they are counted, in blocks where the names are many."""
    monkeypatch.setattr(knowledge, "NAMES", 2, raising=False)
    drawers = spark.range(500).select(F.concat(F.lit("d"), "id").alias("id"), F.concat(F.lit(" ".join(f"word{i}" for i in range(20)) + " Anna Anna word"), "id").alias("text"))
    names = spark.createDataFrame([("Anna",), ("Anna",), ("word499",), ("Nobody",), ("word7",), (None,)], "name string")
    before = _moved(spark)
    got = {tuple(x) for x in knowledge.mentions(drawers, names).collect()}
    assert got == {("Anna", f"d{i}", 2) for i in range(500)} | {("word7", f"d{i}", 1 + (i == 7)) for i in range(500)} | {("word499", "d499", 1)}
    assert _moved(spark) - before < 3 * 500


def test_requirements_are_found_once(spark, tmp_path):
    """the plan of the relations has the extraction once, and its words once for each requirement."""
    texts = ["one\nthe admin shall delete the file\nGiven a user sends data\n", "The user shall get and gets a report. The system must log it. Nobody acts on data here.", "```\nuser sends data\n```", None]
    spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = notes_queries.QUERIES["requirement_relations"][0](spark, str(tmp_path))
    assert {(x.source, x.relation, x.target): x.n for x in found.collect()} == {("user", "performs", "send"): 1, ("send", "on", "data"): 1, ("user", "performs", "get"): 1, ("get", "on", "report"): 1, ("system", "performs", "log"): 1}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("```.*?```") == 1 and plan.count("(validate|verify") == 1
    lines = spark.createDataFrame([("- first item here\n* \n+   \tsecond item\r\nAnd then it ends\nX-NFR-7\nwith ABC-FR-12 in it\n-none of these",)], "text string")
    assert lines.select(rq.extracted(F.col("text")).alias("r")).first().r == ["with ABC-FR-12 in it", "first item here", "second item", "then it ends"]
