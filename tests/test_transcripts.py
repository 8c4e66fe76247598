import json

from pyspark.sql import functions as F

from verbatica.sources import transcripts as t
from verbatica.sources.transcripts import normalized


def test_form(spark):
    files = [("a.md", "> x\ny\n>z\n> q"), ("b.json", '{"a": 1}'), ("c.txt", '{"a": 1}\n{"b": 2}'), ("d.jsonl", '{"a": 1}'), ("e.txt", "hello"), ("f.json", ""), ("g.txt", None), ("h.txt", '[\n {"a": 1}\n]')]
    got = [r.f for r in spark.createDataFrame(files, "path string, text string").coalesce(1).select(t.form(F.col("path"), F.col("text")).alias("f")).collect()]
    assert got == ["transcript", "json", "lines", "lines", "plain", "plain", "plain", "json"]


def test_started_messages(spark):
    said = lambda kind, *texts: json.dumps({"type": kind, "content": [{"text": x} for x in texts]})
    one = [said("user", "noise"), '{"type": "session_metadata"}', said("user", "a", " ", "b"), "broken", said("message_update", "n"), said("gemini", "c"), said("user", "")]
    two = ['{"type": "session_metadata"}', said("user", "alone")]
    three = [said("user", "x"), said("gemini", "y")]
    rows = [(p, i, v) for p, f in (("1", one), ("2", two), ("3", three)) for i, v in enumerate(f)]
    got = t.started_messages(spark.createDataFrame(rows, "path string, line int, value string")).collect()
    assert sorted(tuple(r) for r in got) == [("1", 2, "user", "a\nb"), ("1", 5, "assistant", "c")]


def test_tool_lines(spark):
    calls = [("Bash", {"command": "x" * 201}), ("Read", {"file_path": "f", "offset": 3, "limit": 4}), ("Read", {"file_path": "f", "offset": "a", "limit": 4}), ("Read", {"offset": 1}), ("Grep", {"pattern": "p", "glob": "*.py"}),
             ("Glob", {"pattern": "*"}), ("Edit", {"file_path": "g"}), ("Other", {"k": 1}), (None, None)]
    df = spark.createDataFrame([(i, n, json.dumps(v, separators=(",", ":")) if v is not None else None) for i, (n, v) in enumerate(calls)], "i int, name string, given string")
    got = [r.c for r in df.orderBy("i").select(t.tool_call(F.col("name"), F.col("given")).alias("c")).collect()]
    assert got == ["[Bash] " + "x" * 200 + "...", "[Read f:3-7]", "[Read f:a+4]", "[Read ?]", "[Grep] p in *.py", "[Glob] *", "[Edit g]", '[Other] {"k":1}', "[Unknown] {}"]
    many = "\n".join(f"l{i}" for i in range(45))
    results = [(" a\nb ", "Bash"), (many, "Bash"), (many, "Grep"), ("x", "Read"), ("y" * 3000, "Other"), ("z", None), ("", "Bash"), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(results)], "i int, text string, name string")
    got = [r.c for r in df.orderBy("i").select(t.tool_result(F.col("text"), F.col("name")).alias("c")).collect()]
    lines = ["→ " + s for s in many.split("\n")]
    assert got == ["→ a\n→ b", "\n".join([*lines[:20], "→ ... [5 lines omitted] ...", *lines[25:]]), "\n".join([*lines[:20], "→ ... [25 more matches]"]), "", "→ " + "y" * 2048 + "... [truncated, 3000 chars]", "→ z", "", ""]


def test_block_messages(spark):
    lines = [{"type": "user", "message": {"role": "user", "content": "go"}},
             {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "1", "name": "Bash", "input": {"command": "ls"}}, {"type": "tool_use", "id": "2", "name": "Read", "input": {"file_path": "f"}}]}},
             {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "1", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}, {"type": "tool_result", "tool_use_id": "2", "content": "secret"}]}},
             {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "9", "content": "lost"}]}}, {"type": "summary", "message": {"content": "x"}}]
    df = spark.createDataFrame([("p", i, json.dumps(x)) for i, x in enumerate(lines)] + [("p", 9, "broken"), ("p", 10, None)], "path string, line int, value string")
    assert sorted(tuple(r)[1:] for r in t.block_messages(df).collect()) == [(0, "user", "go"), (1, "assistant", "ok\n[Bash] ls\n[Read f]"), (2, "user", "→ a\n→ b"), (3, "user", "→ lost")]


def test_files_of_any_form_become_messages(spark):
    turn = lambda role, text: json.dumps({"type": role, "message": {"role": role, "content": text}})
    item = lambda role, text: json.dumps({"type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "text", "text": text}]}})
    node = lambda i, parent, child, role, text: {"id": i, "parent": parent, "children": child, "message": {"author": {"role": role}, "content": {"parts": [text]}}}
    files = {
        "turns.jsonl": turn("user", "a") + "\n" + turn("assistant", "b"), "items.jsonl": item("user", "c") + "\n\n" + item("assistant", "d"),
        "started.jsonl": "\n".join(json.dumps(r) for r in ({"type": "session_metadata"}, {"type": "user", "content": [{"text": "e"}]}, {"type": "gemini", "content": [{"text": "f"}]})),
        "export.json": json.dumps([{"role": "user", "content": "g"}, {"role": "assistant", "content": "h"}]),
        "mapping.json": json.dumps({"mapping": {"1": node("1", None, ["2"], "user", "i"), "2": node("2", "1", [], "assistant", "j")}}),
        "channel.json": json.dumps([{"type": "message", "user": "U1", "text": "k"}, {"type": "message", "user": "U2", "text": "l"}]),
        "quoted.txt": "> x\n> y\n> z", "plain.txt": "words", "one.jsonl": turn("user", "alone"), "broken.json": "{", "empty.txt": None,
    }
    out = normalized(spark.createDataFrame(list(files.items()), "path string, text string")).orderBy("path", "ordinal").collect()
    got = {p: [(r.reader, r.role, r.content) for r in out if r.path == p] for p in files}
    two = lambda reader, a, b: [(reader, "user", a), (reader, "assistant", b)]
    assert got == {
        "turns.jsonl": two("turns", "a", "b"), "items.jsonl": two("items", "c", "d"), "started.jsonl": two("started", "e", "f"), "export.json": two("export", "g", "h"), "mapping.json": two("mapping", "i", "j"),
        "channel.json": two("channel", "[U1] k", "[U2] l"), **{p: [("plain", None, files[p] or "")] for p in ("quoted.txt", "plain.txt", "one.jsonl", "broken.json", "empty.txt")}}
