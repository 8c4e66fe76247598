import json

import pytest
from pyspark.sql import functions as F

from verbatica.functions import classify, quality, text as t
from verbatica.sources import files
from verbatica.streaming import capture


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


def test_transformations(spark):
    assert one(spark, t.newline_normalize, "a\r\nb\rc") == "a\nb\nc" and one(spark, t.collapse_blank_lines, "a\n\n\n\nb") == "a\n\nb"
    assert one(spark, t.line_trim, " a \n b") == "a\nb" and one(spark, t.line_join, "a\nb\n\nc") == "a b\n\nc" and one(spark, t.blank_line_drop, "a\n \nb") == "a\nb"
    assert one(spark, t.strip_noise, "> hi\n<system-reminder>x\ny</system-reminder>\nCURRENT TIME: 1\nsay CURRENT TIME: 2\n\n\n\n\nend") == "> hi\nsay CURRENT TIME: 2\n\n\nend"
    assert one(spark, t.strip_code_blocks, "a ```x\ny``` b") == "a  b" and one(spark, t.wing_name, "My-Wing One") == "my_wing_one"
    assert one(spark, t.safe_name, "../x") is None and one(spark, t.safe_name, " ok name ") == "ok name" and one(spark, t.safe_name, "x" * 129) is None
    with pytest.raises(ValueError):
        t.transformation("nothing")


def test_queries_are_cleaned(spark):
    long = "You are a helpful system. " * 20
    ask = lambda q: one(spark, t.sanitized_query, q)
    assert tuple(ask("short one")) == ("short one", "passthrough")
    assert tuple(ask(long + "\nWhat did we decide about storage?")) == ("What did we decide about storage?", "question_extraction")
    assert ask(long).method == "tail_sentence" and ask("x" * 400).method == "tail_truncation" and len(ask("x" * 400).clean) == 250


def test_classifiers(spark):
    assert one(spark, classify.hall, "a bug in the python code") == "technical" and one(spark, classify.hall, "zzz") == "general"
    assert one(spark, classify.conversation_room, "the roadmap and its deadline") == "planning"
    assert one(spark, classify.intent, "what did we decide about the bug?") == "decision" and one(spark, classify.intent, "a bug") == "problem" and one(spark, classify.intent, "hello") is None
    forms = ["it shall not fail", "when x, it must y", "while idle it shall", "where fitted it shall", "it shall run", "hello"]
    assert [one(spark, classify.requirement_form, f) for f in forms] == ["unwanted", "event_driven", "state_driven", "optional", "ubiquitous", "unclassified"]
    rows = spark.createDataFrame([("We decided to go with Spark because of the architecture, instead of the old stack.",), ("There was a bug and an error, but we fixed it and it works now.",), ("short",), ("nothing of note in this sentence at all",)], "text string")
    assert [r.memory_type for r in classify.memory_types(rows).collect()] == ["decision", "milestone", None, None]
    rooms = {"billing": ["invoice"], "auth": ["login"]}
    df = spark.createDataFrame([("src/billing/a.py", ""), ("src/auth_util.py", ""), ("src/x.py", "login login invoice"), ("src/y.py", "")], "p string, t string")
    assert [r.y for r in df.select(classify.room(F.col("p"), F.col("t"), rooms).alias("y")).collect()] == ["billing", "auth", "auth", "general"]


def test_quality(spark):
    good = "FR-001: The system shall validate each request within 200 ms when a user sends data.\nFR-002: The server must not store invalid records; if it fails, it shall return an error as FR-001 says."
    rows = spark.createDataFrame([(1, good), (2, "nice and fast"), (3, ""), (4, "word " * 3000)], "doc_id long, text string")
    out = {r.doc_id: r for r in quality.metrics(rows, "doc_id").collect()}
    assert out[1].hard_constraint_ratio == 1.0 and out[1].negative_space_coverage > 0.9 and out[1].actor_presence == 1.0 and out[1].modal_strength == 1.0
    assert out[1].overall_weighted_average > out[2].overall_weighted_average and all(0 <= r.overall_weighted_average <= 1 for r in out.values())
    names = [k for per in quality.WEIGHTS.values() for k in per]
    assert len(names) == 34 and all(0 <= (out[1][k] if k in out[1] and not k.endswith(("grade", "index", "ease")) else out[1].get(k + "_score", 0) if hasattr(out[1], "get") else 0) <= 1 for k in names)
    assert [one(spark, quality.syllables, w) for w in ("the", "make", "banana", "rhythm", "e")] == [1, 1, 3, 1, 1]


def test_transcripts_and_exchanges(spark):
    rows = [("s", 0, "user", "q1"), ("s", 1, "assistant", "a1"), ("s", 2, "user", "q2"), ("s", 3, "user", "q3"), ("s", 4, "assistant", "a3")]
    text = t.transcript(spark.createDataFrame(rows, "session_id string, ordinal int, role string, content string"))
    assert text.first().text == "> q1\na1\n\n> q2\n\n> q3\na3\n\n"
    assert [r.exchange.strip() for r in t.exchanges(text, "session_id").orderBy("ordinal").collect()] == ["> q1\na1", "> q2", "> q3\na3"]
    parts = t.split_at_headers(spark.createDataFrame([(1, "H one\nx\nH two\ny")], "id int, text string"), "id", "^H ")
    assert [r.body for r in parts.orderBy("part").collect()] == ["H one\nx", "H two\ny"]
    f1 = t.token_f1(spark.createDataFrame([(1, "The cat sat", "a cat ran"), (2, "", ""), (3, "x", "")], "id int, p string, q string"), ["id"], "p", "q")
    assert {r.id: round(r.f1, 6) for r in f1.collect()} == {1: 0.5, 2: 1.0, 3: 0.0}


def test_exports(spark):
    flat = json.dumps([{"role": "user", "content": "hi"}, {"sender": "assistant", "text": "yo"}, {"role": "system", "content": "no"}])
    nested = json.dumps([{"chat_messages": [{"sender": "human", "content": [{"type": "text", "text": "q"}]}, {"sender": "ai", "content": "a"}]}])
    rows = files.export_messages(spark.createDataFrame([("f", flat), ("n", nested)], "path string, text string")).orderBy("path", "ordinal").collect()
    assert [(r.path, r.role, r.content) for r in rows] == [("f", "user", "hi"), ("f", "assistant", "yo"), ("n", "user", "q"), ("n", "assistant", "a")]
    msg = lambda role, text: {"author": {"role": role}, "content": {"parts": [text]}}
    tree = {"mapping": {"r": {"id": "r", "parent": None, "children": ["a", "z"], "message": None}, "a": {"id": "a", "parent": "r", "children": ["b"], "message": msg("user", "q")}, "b": {"id": "b", "parent": "a", "children": [], "message": msg("assistant", "a")}, "z": {"id": "z", "parent": "r", "children": [], "message": msg("user", "other")}}}
    rows = files.mapping_messages(spark.createDataFrame([("t", json.dumps(tree))], "path string, text string")).orderBy("depth").collect()
    assert [(r.role, r.content) for r in rows] == [("user", "q"), ("assistant", "a")]
    chat = json.dumps([{"type": "message", "user": u, "text": x} for u, x in (("A", "1"), ("B", "2"), ("C", "3"), ("A", "4"))] + [{"type": "join", "user": "D", "text": "x"}])
    rows = files.channel_messages(spark.createDataFrame([("c", chat)], "path string, text string")).orderBy("ordinal").collect()
    assert [(r.role, r.content) for r in rows] == [("user", "[A] 1"), ("assistant", "[B] 2"), ("user", "[C] 3"), ("user", "[A] 4")]


def test_files_and_exports(spark, tmp_path):
    (tmp_path / "p/build").mkdir(parents=True)
    (tmp_path / "p/a.py").write_text("x")
    (tmp_path / "p/build/b.py").write_text("y")
    (tmp_path / "p/keep.log.md").write_text("z")
    (tmp_path / "p/c.bin").write_text("w")
    assert sorted(r.path for r in files.project(spark, str(tmp_path / "p"), "build/\n*.md\n!keep*").collect()) == ["a.py", "keep.log.md"]
    drawers = spark.createDataFrame([("i1", "w", "r", "2024", "text one"), ("i2", "w", "s", "2024", "two")], "id string, wing string, room string, filed_at string, text string")
    index = files.export(drawers, str(tmp_path / "out")).collect()
    assert len(index) == 2 and spark.read.text(str(tmp_path / "out")).where("value like '## i1%'").count() == 1
    made = []
    make = lambda: (made.append(1), drawers)[1]
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "c"), {"a": 1}, make).count() == 2
    assert len(made) == 1
    assert files.table_fingerprint(drawers).first() == files.table_fingerprint(drawers.orderBy(F.desc("id"))).first()


def line(kind, uuid, ts, text="hello", session="s"):
    return json.dumps({"type": kind, "uuid": uuid, "timestamp": ts, "sessionId": session, "message": {"role": kind, "content": [{"type": "text", "text": text}]}})


def test_stream_captures_each_message_once_and_counts_saves(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.jsonl").write_text("\n".join([line("user", "u1", "2024-01-01T00:00:00Z"), line("assistant", "a1", "2024-01-01T00:01:00Z"), line("progress", "p", "2024-01-01T00:01:00Z"), '{"type": "us']))
    schema_out = str(tmp_path / "out")

    def run():
        stream = capture.captured(capture.json_lines(spark, str(folder)).select("value", "line"))
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(schema_out)
        q.awaitTermination(120)

    run()
    (folder / "2.jsonl").write_text("\n".join([line("user", "u1", "2024-01-01T00:00:00Z"), line("user", "u2", "2024-01-01T00:02:00Z")]))
    run()  # a restart goes on from the checkpoint
    assert sorted(r.uuid for r in spark.read.parquet(schema_out).collect()) == ["a1", "u1", "u2"]
    counted = capture.saves(capture.captured(capture.json_lines(spark, str(folder)).select("value", "line")), 2)
    q = counted.writeStream.outputMode("update").format("memory").queryName("saves").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    assert spark.sql("select max(n_user) as n, sum(saves) as s from saves").first().asDict() == {"n": 2, "s": 1}


def test_sweep_coverage_and_updates(spark):
    rows = spark.createDataFrame([("s", "u1", "1"), ("s", "u2", "2")], "session_id string, uuid string, ts string")
    new = spark.createDataFrame([("s", "u0", "0"), ("s", "u2", "2"), ("s", "u3", "2"), ("t", "v", "0")], rows.schema)
    assert sorted(r.uuid for r in capture.sweep(rows, new).collect()) == ["u1", "u2", "u3", "v"]
    lines = spark.createDataFrame([(line("user", "u", "1"),), ("{",), (line("progress", "p", "1"),)], "value string")
    assert capture.coverage(lines).first().asDict() == {"n_lines": 3, "n_messages": 1, "n_other": 1, "n_broken": 1, "status": "gaps"}
    states = spark.createDataFrame([("w", 3)], "workspace string, revision int")
    asks = spark.createDataFrame([("w", "r2", 3), ("w", "r1", 3), ("w", "r3", 2), ("new", "r4", 0)], "workspace string, request_id string, expected_revision int")
    assert {(r.request_id, r.revision, r.outcome) for r in capture.revised(states, asks).collect()} == {("r1", 4, "applied"), ("r2", 3, "conflict"), ("r3", 3, "conflict"), ("r4", 1, "applied")}


def test_windows(spark):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,x) as ts, 1L as user_id, 'a' as event_type, 1.0D as value from values (0), (10), (50), (70) t(x)")
    assert sorted((r.n, r.total) for r in capture.activity(rows).collect()) == [(1, 1.0), (3, 3.0)]
    assert sorted(r.n for r in capture.sessions(rows).collect()) == [2, 2]


def test_a_chat_tree_of_many_nodes(spark):
    tree = {"mapping": {f"n{k}": {"id": f"n{k}", "parent": f"n{k - 1}" if k else None, "children": [f"n{k + 1}", "gone"] if k < 399 else [],
                                  "message": {"author": {"role": "user" if k % 2 else "assistant"}, "content": {"parts": [f"text {k}"]}} if k else None} for k in range(400)}}
    rows = files.mapping_messages(spark.createDataFrame([("t", json.dumps(tree))], "path string, text string")).orderBy("depth").collect()
    assert [r.content for r in rows] == [f"text {k}" for k in range(1, 400)] and files.mapping_messages(spark.createDataFrame([("t", "{}")], "path string, text string")).collect() == []
