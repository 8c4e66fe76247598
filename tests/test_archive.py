import pytest
from pyspark.sql import functions as F

from verbatica.functions import article, entities, summary
from verbatica.plans.archive import Archive
from verbatica.sources.adapters import Adapters, FieldSpec, SourceAdapter


def test_archive_from_empty_to_full(spark, tmp_path):
    a = Archive(spark, str(tmp_path / "archive"))
    assert a.drawers.count() == 0 and a.search("anything").count() == 0
    one = a.add_drawer("project", "backend", "JWT tokens guard the api", "auth.py", filed_at="2026-01-01T00:00:00")
    assert a.add_drawer("project", "backend", "JWT tokens guard the api", "auth.py") == one and a.drawers.count() == 1
    a.file(spark.createDataFrame([("notes", "planning", "plan.md", "2026-01-02T00:00:00", "tokens everywhere\n" * 100)], "wing string, room string, source_file string, filed_at string, text string"))
    assert a.rooms("notes").first().n == 3 and "".join(r.text for r in a.select_drawers({"wing": "notes"}).orderBy("chunk_index").collect()) == "tokens everywhere\n" * 100
    assert a.search("JWT tokens", 3).first().id == one and [r.id for r in a.recall("jwt guard").collect()] == [one]
    a.update_drawer(one, room="security")
    assert a.get_drawer(one).first().room == "security" and a.page(one, 0, 3).first().asDict()["next"] == 3 and a.page(one, 0, 3, "wrong").count() == 0
    a.add_fact("Alice", "works_at", "Acme", "2020-01-01")
    a.invalidate("Alice", "works_at", "Acme", "2021-01-01")
    assert a.query_facts("Acme", "2022-01-01").count() == 0 and a.timeline().count() == a.fact_stats().first().n_triples == 1
    a.create_tunnel("project", "security", "notes", "planning", "x")
    tunnel, = a.list_tunnels("notes").collect()
    assert a.follow_tunnels("notes", "planning").first().drawer_id == one
    a.delete_tunnel(tunnel.id)
    a.write_diary("bot", "first", filed_at="2026-01-01")
    a.write_diary("bot", "second", filed_at="2026-01-02")
    assert [r.text for r in a.read_diary("bot", 1).collect()] == ["second"] and a.list_tunnels().count() == 0
    a.delete_drawers(condition={"wing": "notes"})
    a.optimize(1, 1)
    assert {r.table: (r.snapshots, r.n) for r in a.sizes().collect()} == {"drawers": (1, 3), "facts": (1, 1), "tunnels": (1, 0)}
    with pytest.raises(ValueError):
        a.add_drawer("../etc", "x", "y")


def test_adapters(spark):
    rows = spark.createDataFrame([("f1", 0, "t", "3", "a;b", '{"k": 1}'), ("f2", 0, "u", "x", "", None)], "source_file string, chunk_index int, text string, size string, tags string, extra string")
    adapter = SourceAdapter("rows", "1", lambda s, p: rows, [FieldSpec("size", "int", True), FieldSpec("tags", "delimiter_joined_string"), FieldSpec("extra", "json_string")])
    got, = adapter.read(spark, "").collect()
    assert (got["size"], got.tags, got.extra, got.adapter_name) == (3, ["a", "b"], {"k": "1"}, "rows") and got.drawer_id.endswith("_0")
    all_ = Adapters("rows")
    all_.register(adapter)
    assert all_.resolve() is adapter and adapter.summary(spark, "").first().n == 1
    with pytest.raises(KeyError):
        all_.resolve("none")
    with pytest.raises(ValueError):
        FieldSpec("x", "decimal")


def test_entities(spark):
    text = "Maria said yes. Maria asked why, and she left.\nMaria: hello\nMaria: bye\nhey Maria\nwe deployed Atlas and installed Atlas, then built Atlas v2"
    df = spark.createDataFrame([(1, text), (2, "Mario went to Atla")], "id int, text string")
    assert {(r.name, r.n) for r in entities.candidates(df, "id").collect()} == {("Maria", 5), ("Atlas", 3)}
    kinds = {r.name: r.kind for r in entities.kinds(df, "id").collect()}
    assert kinds == {"Maria": "person", "Atlas": "project"}
    names = spark.createDataFrame([("Maria",), ("Atlas",), ("Marco",)], "name string")
    got = {(r.id, r.name, r.distance) for r in entities.fuzzy_mentions(df, "id", names).collect()}
    assert got == {(1, "Maria", 0), (1, "Atlas", 0), (2, "Maria", 1), (2, "Atlas", 1), (2, "Marco", 1)}
    mixed = entities.confusions(spark.createDataFrame([(1, "Maria")], "id int, name string"), names).collect()
    assert [(r.name, r.other, r.distance) for r in mixed] == [("Maria", "Marco", 2)]
    claims = df.select(entities.claims(F.lit("Ann is Bob's sister and Bob's boss is Eve.")).alias("c")).first().c
    assert [tuple(c) for c in claims] == [("Ann", "sister", "Bob"), ("Eve", "boss", "Bob")]
    known = entities.registered(names.withColumn("kind", F.lit("person")), spark.createDataFrame([("MARIA", "person", 0.9), ("New", "project", 0.8), ("Weak", "person", 0.5)], "name string, kind string, confidence double"))
    assert sorted(r.name for r in known.collect()) == ["Atlas", "Marco", "Maria", "New"]
    closets = spark.createDataFrame([("d", "Atlas built well. Atlas fixed the login page.\n## Next steps\n", "w", "r", "a/b.md", ["x", "y"])], "id string, text string, wing string, room string, source_file string, drawer_ids array<string>")
    lines = [r.line for r in entities.pointer_lines(closets, "id").orderBy("ordinal").collect()]
    assert lines[-1] == "next steps|Atlas|->x,y" and any(x.startswith("fixed the login page") for x in lines)
    assert spark.range(1).select(entities.pointed(F.lit("\n".join(lines))).alias("p")).first().p == ["x", "y"]


def test_summaries_and_articles(spark):
    df = spark.createDataFrame([(1, "We decided to use Spark because of scale. Spark Spark. The rest is a long story about nothing much at all."), (2, "")], "id int, text string")
    out = {r.id: r.summary for r in summary.compressed(df, "id").collect()}
    assert out[1].startswith('0:???|spark_') and '"We decided to use Spark because of scale"' in out[1] and "determ" in out[1] and out[1].endswith("DECISION") and out[2] == "0:???|misc"
    back = spark.range(1).select(summary.fields(F.lit(out[1])).alias("f")).first().f
    assert back.sentence == "We decided to use Spark because of scale" and back.topics[0] == "spark"
    text = "# Title\nDr. Smith paid 3.5 dollars. See https://a.b/c.d now! Fine?\n```\ncode. code.\n```\n"
    p = article.profile(spark.createDataFrame([(text, "en"), (text, "fr"), ("", "en")], "text string, lang string"), language=F.col("lang")).collect()
    assert p[0].n_sentences == 3 and p[0].smog is None and p[0].flesch_reading_ease is not None and p[1].flesch_reading_ease is None and p[2].n_words == 0
