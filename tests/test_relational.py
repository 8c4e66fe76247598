import pytest
from pyspark.sql import functions as F

from verbatica.operators import filters, graph, knowledge as kg, revisions, store, taxonomy
from verbatica.operators.filters import UnsupportedFilterError, where

DRAWERS = [
    ("drawer_proj_backend_aaa", "The authentication module uses JWT tokens", "project", "backend", "auth.py", 0, "2026-01-01T00:00:00", "h"),
    ("drawer_proj_backend_bbb", "Database migrations are handled by Alembic", "project", "backend", "db.py", 0, "2026-01-02T00:00:00", "h"),
    ("drawer_proj_frontend_ccc", "The React frontend uses TanStack Query", "project", "frontend", "App.tsx", 0, "2026-01-03T00:00:00", "g"),
    ("drawer_notes_planning_ddd", "Sprint planning: migrate auth to passkeys", "notes", "planning", "sprint.md", 0, "2026-01-04T00:00:00", ""),
    ("drawer_notes_backend_eee", "Notes about the backend", "notes", "backend", "sprint.md", 1, "2026-01-05T00:00:00", "g"),
    ("drawer_x", "general things", "notes", "general", "", 0, "2026-01-06T00:00:00", "g"),
]
FACTS = [("Alice", "parent_of", "Max", "2015-04-01", None), ("Max", "does", "swimming", "2025-01-01", None), ("Max", "does", "chess", "2024-06-01", None),
         ("Alice", "works_at", "Acme Corp", "2020-01-01", "2024-12-31"), ("Alice", "works_at", "NewCo", "2025-01-01", None)]


@pytest.fixture(scope="module")
def drawers(spark):
    return spark.createDataFrame(DRAWERS, "id string, text string, wing string, room string, source_file string, chunk_index long, filed_at string, hall string")


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([(*f, 1.0, f"d{i % 2}", "2025") for i, f in enumerate(FACTS)],
                                 "subject string, predicate string, object string, valid_from string, valid_to string, confidence double, drawer_id string, extracted_at string")


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_filters(drawers):
    assert ids(drawers.where(where({"wing": "project", "room": {"$ne": "backend"}}))) == ["drawer_proj_frontend_ccc"]
    assert len(ids(drawers.where(where({"$or": [{"wing": "notes"}, {"source_file": {"$in": ["db.py"]}}]})))) == 4
    assert len(ids(drawers.where(where({"$and": [{"chunk_index": {"$gte": 0}}, {"chunk_index": {"$lt": 1}}]})))) == 5
    assert ids(drawers.where(where({"room": {"$nin": ["backend", "general", "planning"]}}))) == ["drawer_proj_frontend_ccc"] and len(ids(drawers.where(where(None)))) == 6
    assert ids(drawers.where(filters.where_text({"$contains": "JWT"}))) == ["drawer_proj_backend_aaa"]
    for bad in ({"a": {"$like": 1}}, {"a": {"$gt": 1, "$lt": 2}}, {"$not": []}, {"$or": []}):
        with pytest.raises(UnsupportedFilterError):
            where(bad)


def test_counts_and_pages(drawers):
    rows = {(r.level, r.wing, r.room): r.n for r in taxonomy.counts(drawers).collect()}
    assert rows["total", None, None] == 6 and rows["wing", "project", None] == 3 and rows["wing_room", "notes", "backend"] == 1
    first = taxonomy.listing(drawers, size=2).collect()
    second = taxonomy.listing(drawers, size=2, after=first[-1].id).collect()
    assert len({r.id for r in first + second}) == 4
    with pytest.raises(ValueError):
        taxonomy.listing(drawers, size=101)
    around = taxonomy.neighbours(drawers, drawers.where("id = 'drawer_notes_backend_eee'")).first()
    assert around.n_chunks == 2 and around.context.startswith("Sprint planning")


def test_graph(drawers):
    g = graph.nodes(drawers)
    nodes = {r.room: (r.wings, r.halls, r.n) for r in g.collect()}
    assert nodes == {"backend": (["notes", "project"], ["g", "h"], 3), "frontend": (["project"], ["g"], 1), "planning": (["notes"], [], 1)}
    assert sorted((r.wing_a, r.wing_b, r.hall) for r in graph.edges(g).collect()) == [("notes", "project", "g"), ("notes", "project", "h")]
    assert [r.room for r in graph.tunnels(g).collect()] == ["backend"]
    hops = [(r.room, r.hop) for r in graph.traverse(g, "frontend").collect()]
    assert hops == [("frontend", 0), ("backend", 1), ("planning", 2)] and [(r.room, r.hop) for r in graph.traverse(g, "frontend", 1).collect()] == hops[:2]
    assert graph.traverse(g, "nowhere").collect() == [] and [r.room for r in graph.fuzzy_rooms(g, "back end").collect()] == ["backend", "frontend"]


def test_explicit_tunnels(spark, drawers):
    none = spark.createDataFrame([], "id string, wing_a string, room_a string, wing_b string, room_b string, label string, kind string")
    one = graph.with_tunnel(none, "project", "backend", "notes", "planning", "first")
    both = graph.with_tunnel(one, "notes", "planning", "project", "backend", "again")  # the same, from the other end
    row, = both.collect()
    assert row.label == "again" and graph.tunnels_of(both, "notes").count() == 1 and graph.without_tunnel(both, row.id).count() == 0
    assert [r.drawer_id for r in graph.followed(both, drawers, "project", "backend").collect()] == ["drawer_notes_planning_ddd"]
    topics = spark.createDataFrame([("a", "Spark"), ("b", " spark "), ("b", "sql"), ("a", "SQL"), ("c", "sql")], "wing string, topic string")
    assert sorted((r.wing_a, r.wing_b, r.topic) for r in graph.topic_tunnels(topics, 2).collect()) == [("a", "b", "spark"), ("a", "b", "sql")]


def test_triples(spark, facts):
    assert ids(kg.of_entity(facts, "Alice", "2023-06-01"), "object") == ["Acme Corp", "Max"] and ids(kg.of_entity(facts, "Alice", "2025-06-01"), "object") == ["Max", "NewCo"]
    assert ids(kg.of_entity(facts, "Max", direction="both"), "object") == ["Max", "chess", "swimming"]
    assert kg.of_relationship(facts, "works_at", "2024-12-31").count() == 1 and kg.of_relationship(facts, "works_at").count() == 2
    assert [r.valid_from for r in kg.timeline(facts).collect()] == sorted(f[3] for f in FACTS)
    assert kg.statistics(facts).first().asDict() == {"n_triples": 5, "n_open": 4, "predicates": "does,parent_of,works_at", "n_entities": 6}
    again = kg.with_triple(facts, "Max", "does", "chess", "2026-01-01")
    assert again.count() == 5
    closed = kg.invalidated(facts, "Max", "does", "chess", "2026-02-01")
    assert kg.with_triple(closed, "Max", "does", "chess", "2026-03-01").count() == 6 and ids(kg.of_entity(closed, "Max", "2026-02-02"), "object") == ["swimming"]
    assert {r.drawer_id: r.n_subjects for r in kg.drawers_by_entities(facts, ["Max"]).collect()} == {"d0": 2, "d1": 1}
    claims = spark.createDataFrame([("Alice", "owns", "NewCo"), ("Alice", "works_at", "Acme Corp"), ("Alice", "works_at", "NewCo")], "subject string, predicate string, object string")
    assert {(r.object, r.conflict) for r in kg.conflicts(claims, facts, "2026-01-01").collect()} == {("NewCo", "relationship_mismatch"), ("Acme Corp", "stale_fact")}
    assert spark.range(1).select(kg.entity_id(F.lit("O'Neil Smith"))).first()[0] == "oneil_smith"


def test_revisions(spark):
    rows = [("a", "r1", False, "1"), ("a", "r1", True, "2"), ("a", "r2", True, "3"), ("a", "r3", False, "4"), ("a", "r0", False, "1"), ("a", None, False, "0"), ("b", "r1", False, "1"), ("b", None, False, "0")]
    df = spark.createDataFrame(rows, "source_file string, revision string, complete boolean, filed_at string")
    fate = {(r.source_file, r.revision): r.fate for r in revisions.plan(df).collect()}
    assert fate == {("a", "r1"): "superseded", ("a", "r2"): "kept", ("a", "r3"): "untouched", ("a", "r0"): "superseded", ("a", None): "superseded", ("b", "r1"): "untouched", ("b", None): "untouched"}
    assert sorted((r.source_file, r.revision or "") for r in revisions.pruned(df).collect()) == [("a", "r2"), ("a", "r3"), ("b", ""), ("b", "r1")]


def test_table_snapshots(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        t.read()
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    t.write(rows)
    t.write(store.upsert(t.read(), spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "d")] and t.read(t.snapshots()[0]).count() == 2
    t.write(store.delete(store.update(t.read(), spark.createDataFrame([(1, "z"), (9, "q")], "id long, v string")), where=F.col("id") == 3))
    assert sorted(map(tuple, t.read().collect())) == [(1, "z"), (2, "c")]
    t.compact(1)
    t.forget()
    assert len(t.snapshots()) == 1 and t.read().count() == 2
    with pytest.raises(ValueError):
        store.delete(rows)


def test_receipts_and_packing(spark):
    held = spark.createDataFrame([("n", "r1", "x")], "namespace string, request_id string, digest string")
    asked = spark.createDataFrame([("n", "r1", "x"), ("n", "r1", "y"), ("n", "r2", "z"), ("n", "r2", "w")], held.schema)
    assert sorted(r.status for r in store.receipts(held, asked).collect()) == ["conflict", "conflict", "replayed", "stored"]
    lines = spark.createDataFrame([("f", i, "x" * n) for i, n in enumerate((4, 5, 9, 20, 1))], "source_file string, ordinal int, line string")
    assert [r.document for r in store.packed_lines(lines, 10).orderBy("part").collect()] == ["xxxx\nxxxxx", "x" * 9, "x" * 20, "x"]
