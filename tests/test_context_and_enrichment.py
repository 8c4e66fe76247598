import random

import pytest

from verbatica.functions import names as nm
from verbatica.operators import context
from verbatica.operators.enrich import Enrichment

PATTERNS = nm.merged([{"candidate_pattern": r"[A-Z][a-z]{2,19}", "person_verb_patterns": [r"\b{name}\s+said\b"], "pronoun_patterns": [r"\bshe\b"], "project_verb_patterns": [r"\bship\s+{name}\b"], "stopwords": ["The"]}])


def plain_packet(pins, streams, limit, budget, frame):
    order = [*pins]
    for i in range(max(map(len, streams), default=0)):
        order += [s[i] for s in streams if i < len(s)]
    out, seen, used = [], set(), 0
    for ident, text in order:
        if ident in seen:
            continue
        used += len((text or "").encode()) + frame
        if len(out) >= limit or used > budget:
            break
        seen.add(ident)
        out.append((len(out) + 1, ident, used))
    return out


def test_packets_equal_the_plain_loop(spark):
    rng = random.Random(1)
    want, rows = {}, {"pins": [], "one": [], "two": []}
    for w in range(25):
        texts = {f"d{i}": "é" * rng.randint(0, 60) for i in range(12)}
        lists = {name: rng.sample(sorted(texts), rng.randint(0, n)) for name, n in (("pins", 3), ("one", 9), ("two", 9))}
        for name, held in lists.items():
            rows[name] += [(f"w{w}", i, texts[i], p) for p, i in enumerate(held)]
        want[f"w{w}"] = plain_packet(*[[(i, texts[i]) for i in lists["pins"]]], [[(i, texts[i]) for i in lists[n]] for n in ("one", "two")], 6, 300, 10)
    frames = {n: spark.createDataFrame(r, "workspace string, id string, text string, place int").repartition(3) for n, r in rows.items()}
    got: dict = {}
    for r in context.restored(frames["pins"], frames["one"], frames["two"], limit=6, budget=300, frame=10).orderBy("workspace", "rank").collect():
        assert r.used <= 300
        got.setdefault(r.workspace, []).append((r["rank"], r.id, r.used))
    assert got == {w: p for w, p in want.items() if p}


def test_users_keep_half_of_the_places(spark):
    rows = [("w", f"a{i}", "assistant", 100 + i, "x") for i in range(20)] + [("w", f"u{i}", "user", i, "y") for i in range(3)] + [("w", "s", "system", 999, "z")]
    out = context.live(spark.createDataFrame(rows, "workspace string, id string, role string, at int, text string"), 4).orderBy("place").collect()
    assert [r.id for r in out] == ["u2", "u1", "a19", "a18", "u2", "u1", "u0"]
    packet = context.restored(spark.createDataFrame([], "workspace string, id string, text string, place int"), spark.createDataFrame(out), limit=4).orderBy("rank").collect()
    assert [r.id for r in packet] == ["u2", "u1", "a19", "a18"]


def _drawers(spark):
    texts = ["Mia said hi. Mia said so. Mia said. she Mia"] * 2 + ["ship Core. ship Core. ship Core"] * 2 + ["Zed. Zed. Zed."] + ["The The The"] + [None] + ["Mia Mia Mia and Ann Ann Ann"] * 3
    return spark.createDataFrame([(f"d{i:02}", t) for i, t in enumerate(texts)], "id string, text string")


def _all(one, drawers, known):
    told = []
    while (r := one.run(drawers, known, most=4)) is not None:
        told.append(r)
    return told


def test_every_text_is_enriched_once(spark, tmp_path):
    drawers, known = _drawers(spark), spark.createDataFrame([("Ann", "person")], "name string, kind string")
    one = Enrichment(spark, str(tmp_path / "plain"), PATTERNS)
    told = _all(one, drawers, known)
    assert [t["ids"] for t in told] == [4, 4, 2] and sorted(r.id for r in one.scanned().collect()) == [f"d{i:02}" for i in range(10)]
    assert {(r.name, r.kind) for r in one.learned().collect()} == {("Mia", "person"), ("Core", "project")}
    facts = {(r.subject, r.object) for r in one.facts().collect()}
    assert facts == {("Mia", f"d{i:02}") for i in (0, 1, 7, 8, 9)} | {("Core", "d02"), ("Core", "d03")} | {("Ann", f"d{i:02}") for i in (7, 8, 9)}
    more = drawers.unionByName(spark.createDataFrame([("d99", "Core Core Core")], "id string, text string"))
    assert one.run(more, known) == {"run": 4, "ids": 1, "entries": 0, "facts": 1}


@pytest.mark.parametrize("at", [0, 1, 2, 3, 6])
def test_a_run_that_is_killed_between_two_writes_is_taken_up(spark, tmp_path, at):
    drawers, known = _drawers(spark).where("id < 'd06'"), spark.createDataFrame([], "name string, kind string")
    one, writes = Enrichment(spark, str(tmp_path), PATTERNS), 0
    write = one._write

    def dies(df, kind, run):
        nonlocal writes
        if writes == at:
            writes += 1
            raise KeyboardInterrupt
        writes += 1
        write(df, kind, run)

    one._write = dies
    with pytest.raises(KeyboardInterrupt):
        _all(one, drawers, known)
    again = Enrichment(spark, str(tmp_path), PATTERNS)
    assert {(r.subject, r.object) for r in again.facts().collect()} <= {("Mia", "d00"), ("Mia", "d01"), ("Core", "d02"), ("Core", "d03")}
    _all(again, drawers, known)
    assert sorted(r.id for r in again.scanned().collect()) == [f"d{i:02}" for i in range(6)]
    assert sorted((r.subject, r.object) for r in again.facts().collect()) == [("Core", "d02"), ("Core", "d03"), ("Mia", "d00"), ("Mia", "d01")]
    assert again.learned().groupBy("name").count().where("count > 1").isEmpty()
