import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatica.llm import minhash_dedup
from verbatica.llm.shared import components


def brute(rows):
    """Components by comparing all pairs of full sets."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: [vocab[k] for k in rng.integers(400, size=n)]
    base, rows = say(160), []
    for i in range(60):  # a group of near copies around one text, some at the edge of the threshold
        w = list(base)
        for k in rng.choice(150, size=i % 6, replace=False):
            w[k] = "x"
        rows.append((100 + i, " ".join(w)))
    rows += [(i, " ".join(say(80))) for i in range(20)]
    rows += [(30, rows[60][1]), (31, rows[60][1].upper()), (32, None), (33, ""), (34, " \n"), (35, "short text"), (36, "Short  text"), (37, "tiny")]
    return rows


def test_components_equal_brute_force(docs_of):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_a_large_bucket_is_compared_in_cells(docs_of, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "CELL", 8)
    rows = corpus()
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs_of(rows)).collect()}
    assert got == {i: v[1] for i, v in brute(rows).items()}


def test_empty_and_repeated_rows(docs_of, spark):
    empty = docs_of([(1, "a")]).where("false")
    assert minhash_dedup.near_duplicates(empty).collect() == []
    got = minhash_dedup.near_duplicates(docs_of([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, None), (1, 1), (1, 1), (2, 1)]


def test_stage_keeps_one_of_each_group_and_all_columns(docs_of, spark):
    docs = docs_of(corpus())
    out = minhash_dedup.stage(spark, docs, "")
    expected = {i for i, v in brute(corpus()).items() if v[2]}
    assert {r.doc_id for r in out.collect()} == expected and out.columns == docs.columns


@pytest.mark.parametrize("share", [0.8, 0.9, 0.97])
def test_odd_sketches_estimate_similarity(share):
    rng = np.random.default_rng(5)
    n = 2000
    both = rng.integers(1 << 62, size=n, dtype=np.int64).astype(np.uint64)
    only = rng.integers(1 << 62, size=2 * n, dtype=np.int64).astype(np.uint64)
    own = round(n * (1 - share) / (2 * share))  # |A & B| / |A | B| = share
    sets = [np.unique(np.concatenate((both, only[:own]))), np.unique(np.concatenate((both, only[n : n + own])))]
    mins = minhash_dedup.minhashes(np.concatenate(sets), np.array([len(s) for s in sets]))
    a, b = minhash_dedup.odd_sketches(mins).view(np.uint64)
    apart = int(np.bitwise_count(a ^ b).sum())
    s, k = minhash_dedup.SKETCH_BITS, minhash_dedup.HASHES
    assert abs(1 + s / (4 * k) * np.log(1 - 2 * apart / s) - share) < 0.04


def test_components_of_chains_and_stars(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 130)] + [(5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, **{i: 100 for i in range(100, 130)}}
    assert components(links.where(F.lit(False))).collect() == []


def test_rows_that_repeat_an_id_have_their_own_links(spark, docs_of):
    rng = np.random.default_rng(6)
    a, b = ([f"{c}{k}" for k in rng.integers(400, size=120)] for c in "ab")
    near = lambda w: " ".join(w[:-1] + ["x"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (5, near(a)), (5, "something else"), (None, near(a))]
    for order in (rows, rows[::-1]):
        got = sorted((r.doc_id or -1, r.component_id) for r in minhash_dedup.near_duplicates(docs_of(order)).collect())
        assert got == [(-1, None), (1, 1), (1, 1), (2, 1), (3, 1), (5, 1), (5, 5)]
    kept = minhash_dedup.stage(spark, docs_of(rows), "").collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted([(-1, near(a)), (1, rows[0][1]), (1, rows[1][1]), (5, "something else")])


def test_recall_near_the_threshold(docs_of):
    """Pairs of documents whose similarity is from 0.80 to 0.92: every link is found, and no other."""
    rng = np.random.default_rng(21)
    rows = []
    for k in range(300):
        w = [f"v{k}_{i}" for i in range(int(rng.integers(60, 300)))]
        x = list(w)
        for i in rng.choice(len(w), size=max(1, int(len(w) * rng.uniform(0.008, 0.022))), replace=False):
            x[i] = "other"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(x))]
    want = {}
    for (i, a), (j, b) in zip(rows[::2], rows[1::2]):
        s, t = ({tuple(x.split()[n : n + 5]) for n in range(len(x.split()) - 4)} for x in (a, b))
        want |= {i: i, j: i if 100 * len(s & t) >= 85 * len(s | t) else j}
    assert 60 < sum(v != k for k, v in want.items()) < 290
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs_of(rows)).collect()} == want


def test_bucket_pieces_lose_nothing(docs_of, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "PIECE", 50)
    rows = corpus()
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs_of(rows)).collect()} == {i: v[1] for i, v in brute(rows).items()}


def test_a_very_long_text_and_its_copy(docs_of):
    rng = np.random.default_rng(8)
    w = [f"v{k}" for k in rng.integers(5000, size=200_000)]
    rows = [(1, " ".join(w)), (2, " ".join([*w, "more"])), (3, " ".join(w[:100_000]))]
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs_of(rows)).collect()} == {1: 1, 2: 1, 3: 3}
