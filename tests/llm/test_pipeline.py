import hashlib
import re
import struct

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from verbatica.llm import bpe, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def say(rng, n):
    return " ".join("".join(rng.choice(["the", "an", "ing", "ou", "er", "wh", "sta"], size=int(rng.integers(2, 5)))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    at = tmp_path_factory.mktemp("sf")
    leak, passage = say(rng, 14), say(rng, 70)
    rows, labels = [], []
    for i in range(240):
        good = i % 4 > 0
        body = say(rng, 60)
        rows.append((i, body if good else " ".join(w + "%%%" for w in body.split())))
        if i % 5:
            labels.append((i, int(good), 0))
    near = rows[1][1].split()
    near[-1] = "changed"
    rows += [(500, rows[1][1]), (501, " ".join(near)), (502, say(rng, 20) + " " + passage), (503, say(rng, 20) + " " + passage + " " + say(rng, 20)), (504, say(rng, 30) + " " + leak + " " + say(rng, 30)), (505, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_every_stage_against_a_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "suffix-array dedup", "benchmark decontamination", "BPE encoding and decoding"]

    one = stages["quality classifier"](spark, docs, folder).cache()
    score = {r.doc_id: r.score for r in quality.scored(docs, quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
    kept = {r.doc_id: r.text for r in one.collect()}
    assert one.columns == COLUMNS and set(kept) == {i for i, s in score.items() if s >= quality.THRESHOLD}
    assert {i for i in kept if i < 240} == {i for i in range(240) if i % 4}

    two = stages["MinHash near-dedup"](spark, one, folder).cache()
    ids, gone = sorted(i for i in kept if kept[i]), set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = shingles(kept[a]), shingles(kept[b])
            if 100 * len(x & y) >= 85 * len(x | y):
                gone.add(b)
    assert gone == {500, 501} and {r.doc_id for r in two.collect()} == set(kept) - gone and two.columns == COLUMNS

    three = stages["suffix-array dedup"](spark, two, folder).cache()
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (two, three))
    changed = {i for i in before if before[i] != after.get(i)}
    assert changed == {503} and len(before[503].split()) - len(after[503].split()) == 70 and set(before) == set(after) and three.columns == COLUMNS

    four = stages["benchmark decontamination"](spark, three, folder).cache()
    assert {r.doc_id for r in three.collect()} - {r.doc_id for r in four.collect()} == {504} and four.columns == COLUMNS

    library = Tokenizer.from_file(bpe.default_path())
    five = {r.doc_id: r for r in stages["BPE encoding and decoding"](spark, four, folder).collect()}
    for r in four.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert five[r.doc_id].n_tokens == len(ids) and five[r.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert len(five) == four.count()


def test_run_is_the_stages_in_turn(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.collect()} == ({i for i in range(240) if i % 4} | {502, 503} | ({505} & {r.doc_id for r in out.collect()}))
