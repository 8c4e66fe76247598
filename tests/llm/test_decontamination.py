import hashlib
import re

from verbatica.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    held = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            held.setdefault(tuple(w[k : k + min(10, len(w))]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in range(1, 11):
            for k in range(len(w) - n + 1):
                if (ids := held.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= ids
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (10, "short item"), (3, None), (4, " .. "), (5, "één")]
DOCS = [
    (1, "x one, two; THREE four five six seven eight nine ten eleven y"), (2, None), (3, ""), (4, "a short  item. Short-item! shortitem"), (5, "one two three four five six seven eight nine"),
    (6, "één " * 30), (7, "clean words only"), (8, "one two three four five six seven eight nine ten eleven twelve one two three four five six seven eight nine ten"),
]


def result(docs, benchmark, spark):
    docs.createOrReplaceTempView("d")
    out = dc.contamination(docs, benchmark)
    from pyspark.sql import functions as F

    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.h, r.contaminated) for r in out.select("*", F.sha2(F.array_join("items", ","), 256).alias("h")).collect()}


def test_equals_brute_force(docs_of, spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert result(docs_of(DOCS), bench, spark) == brute(DOCS, ITEMS)


def test_without_broadcast_and_without_items(docs_of, spark, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 0)
    assert result(docs_of(DOCS), bench, spark) == brute(DOCS, ITEMS)
    assert result(docs_of(DOCS), bench.where("false"), spark) == brute(DOCS, [])


def test_repeated_rows_and_empty_table(docs_of, spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dc.contamination(docs_of(DOCS).where("false"), bench).collect() == []
    assert dc.contamination(docs_of(DOCS[:1] * 3), bench).count() == 1


def test_the_stage_judges_each_row(spark, tmp_path, docs_of):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of([(None, "a short item"), (None, "clean"), (3, "short item"), (3, "clean"), (4, None), (5, "word " * 200_000 + "short item")]).withColumnRenamed("score", "sig_")
    kept = dc.stage(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in kept.select("doc_id", "text").collect() if r.text) == [(0, "clean"), (3, "clean")] and kept.count() == 3 and kept.columns == docs.columns
