"""Capture of files that grow and change, against a plain loop; a new query, as after a restart, reads each step."""

import hashlib
import json
import os

import pytest

from verbatica.sources import tailing
from verbatica.streaming import ingest

MARK = 4096


class Loop:
    """Reads one file step by step, whole lines only."""

    def __init__(self, path):
        self.path, self.generation, self.place, self.mark, self.identity = path, 0, 0, hashlib.sha256(b"").hexdigest(), None
        self.rows = []

    def look(self):
        if not os.path.exists(self.path):
            return
        data, identity = open(self.path, "rb").read(), os.stat(self.path).st_ino

        def mark(n):
            return hashlib.sha256(data[: min(n, MARK)] + data[max(0, n - MARK) : n]).hexdigest()

        if self.identity is not None and (identity != self.identity or len(data) < self.place or mark(self.place) != self.mark):
            self.generation, self.place = self.generation + 1, 0
            self.rows.append((self.generation, "changed", 0, 0, None))
        at = self.place
        for line in data[at : data.rfind(b"\n") + 1].splitlines(keepends=True) if data.rfind(b"\n") >= at else []:
            self.rows.append((self.generation, "record", at, at + len(line), line.decode()))
            at += len(line)
        self.place, self.mark, self.identity = at, mark(at), identity



def step(spark, folder, state, seen, **options):
    def keep(batch, number):
        seen[number] = [(os.path.basename(r.path), r.generation, r.reason, r.start, r.stop, r.value) for r in batch.collect()]

    query = tailing.appended(spark, str(folder), str(state), **options).writeStream.foreachBatch(keep).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def test_appends_tails_rewrites_and_shrinking(spark, tmp_path):
    folder, state = tmp_path / "in" / "deep", tmp_path / "state"
    folder.mkdir(parents=True)
    a, b = folder / "a.jsonl", folder / "b.jsonl"
    loops, seen = [Loop(str(a)), Loop(str(b))], {}

    def now():
        step(spark, tmp_path / "in", state, seen)
        for loop in loops:
            loop.look()
        got = sorted(r for rows in seen.values() for r in rows if r[2] in ("record", "changed"))
        want = sorted((os.path.basename(loop.path), *row) for loop in loops for row in loop.rows)
        assert got == want and len({repr(r) for r in got}) == len(got)

    step(spark, tmp_path / "in", state, seen)  # nothing there yet
    (folder / "empty.jsonl").write_text("")
    (folder / "other.txt").write_text("no\n")
    a.write_text("one\ntwo\nthr")
    now()
    assert [r[2:5] for r in seen[max(seen)] if r[2] == "pending_tail"] == [("pending_tail", 8, 11)]
    a.open("a").write("ee\nfour é\n")
    b.write_text("x" * 9000 + "\n")
    now()
    now()  # nothing new
    b.open("a").write("y\n" * 3)
    a.open("a").write("\n\n")
    now()
    a.write_text("short\n")  # the same file, shorter
    now()
    with b.open("r+b") as f:  # in place, of equal length: the bytes before the place differ
        f.seek(10)
        f.write(b"Z")
    now()
    (folder / "new").write_text("short\nagain\n")
    os.replace(folder / "new", a)  # another file with the same beginning
    now()
    a.unlink()
    now()
    a.write_text("back\n")
    now()
    table = {os.path.basename(r.path): r for r in tailing.sources(spark, str(state)).collect()}
    assert table["b.jsonl"].state == "caught_up" and table["b.jsonl"].generation == loops[1].generation == 1 and table["a.jsonl"].generation == loops[0].generation


def test_bounded_slices_and_many_plans(spark, tmp_path):
    folder, state, seen = tmp_path / "in", tmp_path / "state", {}
    folder.mkdir()
    loops = []
    for k in range(5):
        (folder / f"{k}.jsonl").write_text("".join(f"line {i} of {k}\n" for i in range(40)))
        loops.append(Loop(str(folder / f"{k}.jsonl")))
    for _ in range(10):
        step(spark, folder, state, seen, maxfiles=2, slicebytes=200)
    for loop in loops:
        loop.look()
    assert sorted(r for rows in seen.values() for r in rows) == sorted((os.path.basename(p.path), *row) for p in loops for row in p.rows)
    assert all(len({r[0] for r in rows}) <= 2 for rows in seen.values())


def test_plans_are_told_from_the_last_whole_one(tmp_path):
    plans = tailing.Plans(str(tmp_path))
    for n in range(1, 40):
        plans.write([{"n": n}], {f"f{n % 7}": {"place": n}})
    plans.forget(20)
    assert plans.numbers() == list(range(16, 40)) and plans.read(17)["slices"] == [{"n": 17}]
    again = tailing.Plans(str(tmp_path))
    assert again.number == 39 and again.files == plans.files and len(again.files) == 7


def test_a_plan_that_never_ran_and_a_file_that_changed_since(spark, tmp_path):
    folder, state, seen = tmp_path / "in", tmp_path / "state", {}
    folder.mkdir()
    (folder / "a.jsonl").write_text("one\n")
    options = {"path": str(folder), "state": str(state)}
    assert tailing.AppendedReader(options).latestOffset() == {"plan": 1}  # written, and then the driver was lost
    (folder / "a.jsonl").open("a").write("two\n")
    step(spark, folder, state, seen)
    assert sorted(r[3:] for rows in seen.values() for r in rows) == [(0, 4, "one\n"), (4, 8, "two\n")]
    (folder / "a.jsonl").open("a").write("three\n")
    reader = tailing.AppendedReader(options)
    assert reader.latestOffset() == {"plan": 3}
    (folder / "a.jsonl").write_text("other\nlines\nhere\n")
    seen.clear()
    step(spark, folder, state, seen)
    rows = [r for rows in seen.values() for r in rows]
    assert [r[2:5] for r in rows if r[2] == "lost"] == [("lost", 8, 14)]
    assert sorted(r[1:5] for r in rows if r[2] == "record") == [(1, "record", 0, 6), (1, "record", 6, 12), (1, "record", 12, 17)]


def test_long_lines_are_skipped_in_segments(spark, tmp_path):
    folder, state, seen = tmp_path / "in", tmp_path / "state", {}
    folder.mkdir()
    a = folder / "a.jsonl"
    a.write_bytes(b"ok\n" + b"x" * 700 + b"\nfine\n" + b"\xff\xfe\n" + b"y" * 150)
    options = {"slicebytes": 300, "recordbytes": 100}
    for _ in range(5):
        step(spark, folder, state, seen, **options)
    a.open("ab").write(b"y" * 500 + b"\nend\n")
    for _ in range(5):
        step(spark, folder, state, seen, **options)
    rows = sorted((r for rows in seen.values() for r in rows), key=lambda r: r[3])
    assert [(r[2], r[5]) for r in rows if r[2] in ("record", "malformed")] == [("record", "ok\n"), ("record", "fine\n"), ("malformed", None), ("record", "end\n")]
    stretches = [(r[3], r[4]) for r in rows if r[2] == "oversized"]
    assert sum(stop - start for start, stop in stretches) == 701 + 651
    kept = sorted([*stretches, *((r[3], r[4]) for r in rows if r[2] in ("record", "malformed"))])
    assert all(x[1] == y[0] for x, y in zip(kept, kept[1:])) and kept[0][0] == 0 and kept[-1][1] == a.stat().st_size


ITEMS = [
    {"type": "session_meta", "payload": {"cwd": "/work/one"}},
    {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hello"}, {"type": "input_image"}, {"type": "input_text", "text": ""}]}},
    {"type": "response_item", "payload": {"type": "message", "role": "assistant", "channel": "analysis", "content": [{"type": "output_text", "text": "inner"}]}},
    {"type": "response_item", "payload": {"type": "message", "role": "assistant", "channel": "final", "content": [{"type": "output_text", "text": "said"}, {"type": "odd"}, "loose"]}},
    {"type": "response_item", "payload": {"type": "function_call", "name": "f"}},
    {"type": "response_item", "payload": {"type": "reasoning"}},
    {"type": "response_item", "payload": {"type": "message", "role": "system", "content": [{"type": "text", "text": "s"}]}},
    {"type": "response_item", "payload": "loose"},
    {"type": "event_msg", "payload": {"type": "token_count"}}, {"type": "event_msg", "payload": {"type": "user_message"}}, {"type": "event_msg", "payload": {"type": "agent_reasoning"}}, {"type": "event_msg"},
    {"type": "turn_context", "payload": {"cwd": "/work/two"}}, {"type": "turn_context", "cwd": "/work/../up", "payload": {}}, {"type": "new"}, [1], 5, "text",
    {"type": "response_item", "payload": {"type": "message", "role": "user", "content": []}},
    {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "é" * 70_000}]}},
]
TURNS = [
    {"type": "user", "message": {"content": "plain words"}, "cwd": "/w"}, {"type": "user", "message": {"content": ""}}, {"type": "human", "message": {"content": [{"type": "text", "text": "hi"}, {"type": "tool_result"}]}},
    {"type": "assistant", "message": {"content": [{"type": "thinking"}, {"type": "text", "text": "answer"}, {"type": "tool_use"}, {"type": "text", "text": 5}]}},
    {"type": "assistant", "channel": "analysis", "message": {"content": [{"type": "text", "text": "inner"}]}}, {"type": "assistant", "message": {"channel": "final", "content": [{"type": "input_text", "text": "odd"}]}},
    {"type": "summary", "message": {"content": "s"}}, {"type": "user"}, {"type": "other", "message": {"content": [{"type": "image"}]}}, {"type": "user", "message": {"content": {"text": "x"}}},
]



def _counts(spark, records, layout):
    lines = [(0, json.dumps(r, ensure_ascii=False)) for r in records] + [(0, "{broken")]
    rows, at = [], 0
    for _, line in lines:
        n = len(line.encode()) + 1
        rows.append(("src", "p", 0, at, at + n, at, "record", "record", "h", line))
        at += n
    df = spark.createDataFrame(rows, tailing.SCHEMA)
    held = ingest.counted(ingest.read(df, layout))
    return held, [{c: r[c] for c in ingest.COUNTERS if r[c] and c != "processed_records"} for r in held.orderBy("start").collect()]


def test_accounts_of_items(spark):
    held, got = _counts(spark, ITEMS, ingest.ITEMS)
    said = lambda n, size, **more: {"indexed_records": 1, "text_blocks": n, "text_bytes": size, **more}
    assert got == [
        {"metadata_records": 1}, said(1, 5, attachment_blocks=1), {"internal_records": 1}, said(1, 4, unsupported_blocks=2), {"tool_records": 1}, {"internal_records": 1}, {"unsupported_blocks": 1},
        {"unsupported_records": 1}, {"metadata_records": 1}, {"unsupported_records": 1}, {"internal_records": 1}, {"unsupported_records": 1}, {"metadata_records": 1}, {"metadata_records": 1},
        {"unsupported_records": 1}, {"unsupported_records": 1}, {"unsupported_records": 1}, {"unsupported_records": 1}, {"metadata_records": 1}, said(1, 140_000), {"malformed_records": 1}]
    seen = ingest.observations(held)
    scope = ingest.scopes(seen).first()
    assert scope.workspace == "/work/one" and scope.first_offset == 0 and scope.conflict_at == held.where("cwd = '/work/two'").first().start
    out = ingest.scoped(ingest.texts(held), ingest.scopes(seen)).orderBy("start", "block_start").collect()
    assert [(r.text[:5], r.workspace) for r in out[:2]] == [("hello", "/work/one"), ("said", "/work/one")] and out[-1].workspace is None
    assert "".join(r.text for r in out[2:]) == "é" * 70_000 and all(len(r.text.encode()) <= ingest.PIECE_BYTES for r in out)
    total = ingest.coverage(seen).first()
    assert total.text_coverage == "gaps" and total.processed_records == len(ITEMS) + 1 and total.pending_bytes == 0


def test_accounts_of_turns_and_hints(spark):
    held, got = _counts(spark, TURNS, ingest.TURNS)
    said = lambda n, size, **more: {"indexed_records": 1, "text_blocks": n, "text_bytes": size, **more}
    assert got == [
        said(1, 11), {"unsupported_records": 1}, said(1, 2, tool_blocks=1), said(1, 6, internal_blocks=1, tool_blocks=1, unsupported_blocks=1), {"internal_records": 1}, {"unsupported_blocks": 1},
        {"metadata_records": 1}, {"unsupported_records": 1}, {"attachment_blocks": 1}, {"unsupported_records": 1}, {"malformed_records": 1}]
    said_ = ingest.texts(held)
    none = ingest.scopes(ingest.observations(held.where("start > 0")))
    hints = spark.createDataFrame([("src", "/hinted")], "source string, workspace string")
    assert {(r.workspace, r.attribution) for r in ingest.scoped(said_, none, hints).collect()} == {("/hinted", "host_event")}
    assert {r.attribution for r in ingest.scoped(said_, none).collect()} == {"unattributed"}


def test_capture_writes_texts_and_observations_once(spark, tmp_path):
    folder, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    os.mkdir(folder)
    lines = [json.dumps(r) + "\n" for r in TURNS]
    open(f"{folder}/s.jsonl", "w").write("".join(lines[:4]) + lines[4][:9])
    ingest.caught_up(spark, folder, state, out, ingest.TURNS, slicebytes=400)
    first = ingest.coverage(spark.read.parquet(f"{out}/observations")).first()
    assert first.text_coverage == "pending" and first.pending_bytes == 9 and first.processed_records == 4
    open(f"{folder}/s.jsonl", "a").write(lines[4][9:] + "".join(lines[5:]))
    ingest.caught_up(spark, folder, state, out, ingest.TURNS, slicebytes=400)
    seen = spark.read.parquet(f"{out}/observations")
    last = ingest.coverage(seen).first()
    assert last.pending_bytes == 0 and last.processed_records == len(TURNS) and last.text_coverage == "gaps"
    assert [r.text for r in spark.read.parquet(f"{out}/texts").orderBy("start", "block").collect()] == ["plain words", "hi", "answer"]
