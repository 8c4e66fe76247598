import re

from pyspark.sql import functions as F

from verbatica.functions import requirements as rq, segments as sg
from verbatica.operators import graph, registry


def rows(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_requirements_of_markdown(spark):
    marked = "FR-001: it shall start\n- a bullet that counts\n* short\n```\n- code is no bullet\n```\nGiven a user with a name\n<!-- REQ-9: hidden for now -->FR-001: it shall start"
    prose = "It takes 2.5 seconds at most. Then it stops! No."
    got = {r.id: r.r for r in rows(spark, marked, prose, "", None).select("id", rq.extracted(F.col("text")).alias("r")).collect()}
    assert got == {0: ["FR-001: it shall start", "a bullet that counts", "a user with a name"], 1: ["It takes 2.5 seconds at most", "Then it stops"], 2: [], 3: []}


def test_references_entities_and_relations(spark):
    d = spark.createDataFrame([(1, ["FR-1: a user validates data as NFR-2 and FR-1 say", "nothing here", "AC-3 alone"]), (2, [])], "id int, requirements array<string>")
    assert {(r.id, tuple(r.refs)) for r in rq.references(d.withColumnRenamed("id", "doc"), "doc").select("id", "refs").collect()} == {("FR-1", ("NFR-2",)), ("AC-3", ())}
    named = d.select("id", F.explode("requirements").alias("r")).select("id", rq.named(F.col("r")).alias("named"))
    assert {tuple(r) for r in rq.relations(named, "id").collect()} == {(1, "user", "performs", "validate"), (1, "validate", "on", "data")}
    told = rows(spark, "It is fast and secure", "within 5 seconds").select("id", rq.diagnosis(F.col("text")).alias("d")).collect()
    assert [(r.d.hard > 0, r.d.soft_words, r.d.diagnosis) for r in told] == [(False, ["fast", "secure"], "no numeric thresholds"), (True, [], None)]


def test_nouns_load_and_overall_score(spark):
    text = "The System shall not stop because Users need information and safety. It is never idle."
    d = rows(spark, text, "")
    assert d.select(rq.nouns(F.col("text")).alias("n")).first().n == ["The", "System", "Users", "It", "information", "never"]
    got = {r.id: r for r in rq.cognitive_load(d).collect()}
    n, s, y = got[0].n_words, got[0].n_sentences, got[0].n_syllables
    want = [min(n / s / 30, 1), min(y / n / 2.5, 1), min(6 / n / 0.3, 1), 1 / 10, 1 / 10, 1 / 5]
    assert abs(got[0].cognitive_load - sum(want) / 6) < 1e-9 and got[1].cognitive_load == 0
    score = d.limit(1).select(rq.overall(*[F.lit(x) for x in (80.0, 1.0, 0.5, 1.0, 0.0, 0.25)]).alias("s")).first().s
    assert abs(score - ((100 - 15) * 0.3 + (40 + 20 + 10) * 0.4 + 75 * 0.3)) < 1e-9


def test_segments(spark):
    talk = "before\n> first\nmore\nAssistant: yes\n \nuser : no"
    block = "\n".join(f"line {i}" for i in range(30))
    got = {r.id: r.s for r in rows(spark, talk, "one\n\n two \n\n\n", block, "", None, "> a\n> \nx").select("id", sg.segments(F.col("text")).alias("s")).collect()}
    assert got[0] == ["before", "> first\nmore", "Assistant: yes\n ", "user : no"]
    assert got[1] == ["one", "two"] and [len(s.split("\n")) for s in got[2]] == [25, 5]
    assert got[3] == [] and got[4] == [] and got[5] == ["> a\n> \nx"]
    assert "".join(re.findall(r"\w+", "".join(got[0]))) == "".join(re.findall(r"\w+", talk))


def test_heads_of_sessions(spark):
    log = "Tool v1\nhi\nTool v2\nCtrl+E to show\n" + "x\n" * 6 + "Tool v3\n> git log\n> no\n> What's the plan, Ann Lee?\n⏺ 9:05 AM Friday, March 3, 2026\n/Users/bo/work"
    d = rows(spark, log, None, "nothing")
    # the first header is within six lines of the sign that belongs to the second
    assert {(r.id, r.line) for r in sg.session_starts(d, "id", "Tool v").collect()} == {(0, 10)}
    got = {r.id: r for r in d.select("id", sg.subject(F.col("text")).alias("subject"), sg.stamp(F.col("text")).alias("t")).collect()}
    assert got[0].subject == "Whats-the-plan-Ann-Lee" and (got[0].t.stamp, got[0].t.day) == ("2026-03-03_905AM", "2026-03-03")
    assert got[1].subject == got[2].subject == "session" and got[1].t is None and got[2].t is None
    known = spark.createDataFrame([("Ann Lee", None), ("Bo", "bo"), ("Cy", "cy"), ("Plan", None)], "name string, username string")
    assert {(r.id, r.name) for r in sg.people(d, "id", known).collect()} == {(0, "Ann Lee"), (0, "Bo"), (0, "Plan")}
    assert [r.themes for r in sg.themes(rows(spark, "Alpha beta alpha with gamma beta x", ""), "id", ["with"], most=2).collect()] == ["alpha, beta"]
    assert [r.w for r in rows(spark, " a  b\nc ", "").select(sg.first_words(F.col("text"), 2).alias("w")).collect()] == ["a b", ""]


def test_lookup_in_the_register(spark):
    people = spark.createDataFrame([("Grace", ["Gigi"], 1.0, "onboarding"), ("Max", None, 0.8, "learned")], "name string, aliases array<string>, confidence double, source string")
    projects = spark.createDataFrame([("Max",), ("Atlas",)], "name string")
    doubtful = spark.createDataFrame([("grace",)], "word string")
    words = spark.createDataFrame([(1, "grace", "Grace said hello"), (2, "Grace", "the grace of things"), (3, "Grace", ""), (4, "GIGI", "x"), (5, "max", "not max again"), (6, "atlas", None), (7, "Zed", ""), (8, "Grace", None)],
                                  "key int, word string, context string")
    got = {r.key: (r.type, r.name, round(r.confidence, 2), r.by_context) for r in registry.looked_up(words, people, projects, doubtful).collect()}
    assert got == {1: ("person", "grace", 0.9, True), 2: ("concept", "Grace", 0.8, True), 3: ("person", "Grace", 1.0, False), 4: ("person", "Grace", 1.0, False), 5: ("person", "Max", 0.8, False),
                   6: ("project", "Atlas", 1.0, False), 7: ("unknown", "Zed", 0.0, False), 8: ("person", "Grace", 1.0, False)}
    asked = spark.createDataFrame([(1, "Did Gigi meet Max?"), (2, "By the grace of luck"), (3, "Hey Grace, is Borin there? And Atlas?"), (4, "")], "query_id int, text string")
    assert {(r.query_id, r.name) for r in registry.people_of(asked, people, doubtful).collect()} == {(1, "Grace"), (1, "Max"), (3, "Grace")}
    assert {(r.query_id, r.name) for r in registry.unknown(asked, people, projects, ["did", "by", "hey"]).collect()} == {(3, "Borin")}


def test_same_people_and_chains(spark):
    commits = [("Ann Lee", "a@x"), ("ann", "a@x"), ("ann", "b@x"), ("Ann Lee", "c@x"), ("Ann Lee", None), ("dependabot[bot]", "a@x"), ("bo", "bo@x"), ("Cy Dee", ""), (None, "z@x"), ("Al Lee", "b@x")]
    got = registry.same_people(spark.createDataFrame(commits, "name string, address string")).collect()
    assert {(r.name, tuple(r.addresses), r.n) for r in got} == {("Ann Lee", ("a@x", "b@x", "c@x"), 6), ("Cy Dee", (), 1)}
    chain = spark.range(60).select(F.format_string("n%03d", "id").alias("a"), F.format_string("n%03d", F.col("id") + 1).alias("b")).union(spark.createDataFrame([("z1", "z0"), ("z1", "z1")], "a string, b string"))
    placed = {r.node: r.component for r in graph.connected(chain).collect()}
    assert len(placed) == 63 and {placed[f"n{i:03d}"] for i in range(61)} == {"n000"} and placed["z1"] == "z0"
    assert graph.connected(chain.limit(0)).count() == 0
    top = registry.reported(spark.createDataFrame([("p", 0.5), ("q", 0.9)], "name string, confidence double"), spark.createDataFrame([("r", 0.1)], "name string, confidence double"), 1)
    assert {tuple(r) for r in top.collect()} == {("project", "q", 0.9), ("person", "r", 0.1)}
