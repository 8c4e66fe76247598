from verbatica.functions import article
from verbatica.operators import history, information as info, knowledge as kg


def test_members_bridge_and_candidates(spark):
    held = spark.createDataFrame([("x", '["a","b",null]'), ("y", None), ("z", "[]"), ("w", "broken")], "identity string, ids string")
    by_array = history.members(held)
    assert sorted(r.chunk_id for r in by_array.collect()) == ["a", "b"]
    links = spark.createDataFrame([("y", "c"), ("q", "d"), (None, "e")], "identity string, chunk_id string")
    by_bridge = history.bridged(held, links)
    assert [(r.identity, r.chunk_id) for r in by_bridge.collect()] == [("y", "c")]
    chunks = spark.createDataFrame([(c, i) for i, c in enumerate("abcde")], "chunk_id string, n int")
    assert sorted(r.chunk_id for r in history.candidates(chunks, by_array, by_array, by_bridge).collect()) == ["a", "b", "c"]
    assert history.candidates(chunks, links.limit(0)).count() == 0


def test_scoped_chunks_and_reconciliation(spark):
    scopes = spark.createDataFrame([("a", "s", "w"), ("b", "s", "w"), ("c", "gone", "w"), ("lost", "s", "w")], "chunk_id string, source_key string, workspace string")
    chunks = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "chunk_id string, n int")
    sources = spark.createDataFrame([("s", 7)], "source_key string, generation int")
    assert sorted((r.chunk_id, r.generation) for r in history.scoped_chunks(scopes, chunks, sources).collect()) == [("a", 7), ("b", 7)]
    tried = spark.createDataFrame([("1", "stored"), ("2", "gap"), ("3", "stored")], "cursor_key string, outcome string")
    kept = spark.createDataFrame([("1", "i")], "cursor_key string, identity string")
    gaps = spark.createDataFrame([("2", "g"), ("9", "h")], "cursor_key string, gap string")
    assert sorted((r.cursor_key, r.identity, r.gap) for r in history.reconciled(tried, kept, gaps).collect()) == [("1", "i", None), ("2", None, "g"), ("3", None, None)]
    assert [r.cursor_key for r in history.reconciled(tried, kept, gaps, after="1", most=1).collect()] == ["2"]
    assert sorted((r.cursor_key, r.outcome) for r in history.reconciled(gaps, tried).collect()) == [("2", "gap"), ("9", None)]


def test_entities_and_seeds(spark):
    schema = "name string, type string, properties string"
    none = spark.createDataFrame([], "id string, " + schema)
    first = kg.with_entities(none, spark.createDataFrame([("Ann O'Hara", "person", "{}"), ("Rex", "person", "{}")], schema))
    then = kg.with_entities(first, spark.createDataFrame([("rex", "animal", "{}"), ("Rex", "animal", "{}")], schema))
    assert sorted((r.id, r.name, r.type) for r in then.collect()) == [("ann_ohara", "Ann O'Hara", "person"), ("rex", "rex", "animal")]
    facts = spark.createDataFrame([("ann", None, "1990-01-01", "eve", "bob", ["chess", "chess"]), ("kim", "Kim Lee", None, None, "", None)],
                                  "key string, full_name string, birthday string, parent string, partner string, interests array<string>")
    got = sorted((r.subject, r.predicate, r.object, r.valid_from) for r in kg.seeded(facts).collect())
    assert got == [("ann", "child_of", "eve", "1990-01-01"), ("ann", "loves", "chess", "2025-01-01"), ("ann", "married_to", "bob", None)]
    triples = spark.createDataFrame([("ann", "owns", "rex"), ("ann", "owns", "unknown")], "subject string, predicate string, object string")
    assert [(r.other_name, r.other_type) for r in kg.with_names(triples, then, "outgoing").collect()] == [("rex", "animal")]
    assert kg.with_names(triples, then, "incoming").count() == 0  # ann is filed as ann_ohara only


def test_novelty_tools_and_bins(spark):
    rows = spark.createDataFrame([(1, "g", 1, [1.0, 0.0]), (2, "g", 2, [1.0, 0.0]), (3, "g", 3, [0.0, 1.0])], "id long, grp string, filed long, vector array<double>")
    tags = spark.createDataFrame([(2, 0.7), (3, None)], "id long, novelty double")
    assert sorted(tuple(r) for r in info.backfilled(rows, tags).collect()) == [(1, 1.0, True), (2, 0.7, False), (3, 1.0, True)]
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    hits = spark.createDataFrame([(1, 0.95), (1, 0.2)], "query_id long, score double")
    assert sorted((r.query_id, round(r.novelty, 9), r.band) for r in info.scored_novelty(asked, hits).collect()) == [(1, 0.05, "low"), (2, 1.0, "high")]
    points = spark.createDataFrame([(5, 1.0), (6, 3.0), (25, 9.0), (None, 1.0)], "x long, y double")
    assert sorted(tuple(r) for r in info.variance_per_bin(points, "x", "y").collect()) == [(5, 2.0), (15, 1.0), (25, 1.0)]
    assert info.variance_per_bin(points.limit(0), "x", "y").count() == 0
    bins = spark.createDataFrame([("a", 0, 2), ("b", 0, 3), ("b", 4, 1)], "grp string, bin int, n long")
    assert sorted(tuple(r) for r in info.pooled(bins).collect()) == [(0, 5), (4, 1)]


def test_average_ranks_over_ranges(spark):
    df = spark.createDataFrame([(float(v),) for v in [3, 1, 1, 2, 2, 2, 9]] + [(None,)], "v double")
    assert sorted(tuple(r) for r in info.average_ranks(df, "v").collect()) == [(1.0, 1.5, 2), (2.0, 4.0, 3), (3.0, 6.0, 1), (9.0, 7.0, 1)]


def test_article_profile_reads_whole_texts(spark):
    words = 20_000
    texts = spark.createDataFrame([(1, "word " * words + "end."), (2, "One word here."), (3, None)], "n int, text string")
    got = {r.n: r for r in article.profile(texts).collect()}
    assert (got[1].n_words, got[1].oversized) == (words + 1, True) and (got[2].n_words, got[2].oversized) == (3, False)
    assert got[3].words_per_sentence is None


def test_spearman_interval_holds_the_correlation(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i + (i % 7) * 40)) for i in range(200)] + [(900, None, 1.0)], "b long, x double, y double")
    rho = info.spearman(df, "x", "y").first()["rho"]
    got = info.spearman_bootstrap(df, "x", "y", "b", resamples=200)
    assert abs(got["r"] - rho) < 1e-9 and got["low"] <= rho <= got["high"]
