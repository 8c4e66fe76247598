import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from verbatica.llm import suffix_dedup as sd
from verbatica.llm.textops import Words, not_blank


def brute(rows):
    """For each document the words in a 50-word window that a document of a smaller id holds."""
    seen, out = {}, {}
    for d, t in sorted((r for r in rows if r[0] is not None)):
        w = (t or "").split()
        hit = set()
        for k in range(len(w) - 49):
            if tuple(w[k : k + 50]) in seen:
                hit |= set(range(k, k + 50))
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), d)
        out[d] = hit
    return out


def corpus():
    rng = np.random.default_rng(11)
    say = lambda n: [f"v{k}" for k in rng.integers(3000, size=n)]
    passages = [say(n) for n in (50, 55, 80, 300)]
    rows = []
    for i in range(40):
        w = say(int(rng.integers(0, 60)))
        for p in passages:
            if rng.random() < 0.4:
                w += p + say(int(rng.integers(0, 40)))
        rows.append((i, " ".join(w)))
    near = say(49)
    rows += [(50, " ".join(say(20) + near)), (51, " ".join(say(20) + near + say(5))), (52, None), (53, ""), (54, rows[3][1]), (55, "la " * 400), (56, "la " * 300), (57, "a  b\nc")]
    return rows


def spans(df):
    out = {}
    for r in df.collect():
        assert r.n_words == r.end_word - r.start_word >= sd.LEAST and r.other_doc_id < r.doc_id
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def test_marks_what_brute_force_marks(docs_of):
    rows = corpus()
    got, want = spans(sd.repeated_spans(docs_of(rows))), brute(rows)
    for d, hit in want.items():
        if d in (55, 56):  # one word over and over is no passage
            continue
        near = got.get(d, set())
        assert hit <= near and len(near - hit) <= 2 * (len(hit) > 0), d  # an end may lie a word too far


def test_partition_ends_lose_nothing(docs_of, spark, monkeypatch):
    rows = corpus()
    one = spans(sd.repeated_spans(docs_of(rows)))
    monkeypatch.setattr(sd, "parts", lambda s: 37)
    assert spans(sd.repeated_spans(docs_of(rows))) == one


def test_removal_keeps_the_rest(docs_of, spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = docs_of([(1, "a  b " + passage + " c"), (2, "x\ny " + passage + "  z"), (3, passage), (4, None)])
    out = {r.doc_id: r for r in sd.stage(spark, docs, "").collect()}
    assert out[1].text == "a  b " + passage + " c" and out[2].text == "x\ny z" and out[2].n_chars == 5 and 3 not in out and out[4].text is None
    assert sd.repeated_spans(docs.where("false")).collect() == []


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 6), min_size=60, max_size=160), st.integers(0, 30), st.integers(0, 30))
def test_shared_stretches_share_a_selected_word(stretch, before, after):
    body = [f"s{k}" for k in stretch]
    # periodic texts choose few places, so the stretch is made of different words where it matters
    body = [f"{w}_{i}" for i, w in enumerate(body)]
    texts = [" ".join([f"l{i}" for i in range(before)] + body), " ".join(body + [f"r{i}" for i in range(after)])]
    words = Words(texts, not_blank, fold=None)
    at = sd.selected(words)
    first = {int(p) - before for p in at if p < words.first[1]}
    second = {int(p - words.first[1]) for p in at if p >= words.first[1]}
    inside = range(0, len(body) - sd.PREFIX + 1)
    assert {p for p in first if p in inside} & {p for p in second if p in inside} & set(range(sd.SPREAD))


@pytest.mark.parametrize("ranges, piece", [(1, 1 << 17), (37, 1 << 17), (1, 40)])
def test_documents_between_that_share_less_hide_nothing(docs_of, monkeypatch, ranges, piece):
    rng = np.random.default_rng(13)
    say = lambda n: [f"v{k}" for k in rng.integers(100_000, size=n)]
    rows = []
    for k in range(0, 600, 60):
        head, passage, tail = say(4), say(46), say(4)
        rows += [(k, say(9) + head + passage + say(9)), (k + 1, say(9) + passage + tail + say(9))]  # each holds other windows of the last but one
        rows += [(i, say(20) + passage[:41] + say(20)) for i in range(k + 2, k + 16)]
        rows += [(i, say(20) + passage[5:] + say(20)) for i in range(k + 16, k + 30)]
        rows += [(k + 30, say(9) + head + passage + tail + say(9)), (k + 31, say(60))]
    rows = [(i, " ".join(w)) for i, w in rows]
    monkeypatch.setattr(sd, "parts", lambda s: ranges)
    monkeypatch.setattr(sd, "PIECE", piece, raising=False)
    assert spans(sd.repeated_spans(docs_of(rows))) == {d: hit for d, hit in brute(rows).items() if hit}


@pytest.mark.parametrize("ranges, piece", [(3, 1 << 17), (37, 7)])
def test_a_word_over_and_over_is_a_passage(docs_of, monkeypatch, ranges, piece):
    rng = np.random.default_rng(17)
    say = lambda n: [f"v{k}" for k in rng.integers(3000, size=n)]
    head, tail = say(30), say(30)
    rows = [(1, ["la"] * 50), (2, say(5) + ["la"] * 300 + say(5)), (3, ["la"] * 49), (4, head + ["la"] * 400 + tail), (5, say(3) + ["la"] * 90 + tail), (6, head + ["la"] * 91 + say(4)),
            (7, say(9) + ["lo"] * 77 + say(9)), (8, ["lo"] * 60), (9, ["da", "di"] * 100), (10, ["di", "da"] * 60 + say(8))]
    for k, n in enumerate(range(20, 60)):  # runs that a copy continues on one side
        word, ends = [f"w{k}"] * n, (say(25), say(25))
        rows += [(100 + 2 * k, say(4) + word[:7] + word + ends[1]), (101 + 2 * k, say(4) + word + ends[1])]
        rows += [(300 + 2 * k, ends[0] + [f"z{k}"] * (n + 21)), (301 + 2 * k, ends[0] + [f"z{k}"] * n + say(3))]
    rows = [(i, " ".join(w)) for i, w in rows]
    monkeypatch.setattr(sd, "parts", lambda s: ranges)
    monkeypatch.setattr(sd, "PIECE", piece)
    assert spans(sd.repeated_spans(docs_of([*rows, *corpus()[-3:-1]]))) == {d: hit for d, hit in brute([*rows, *corpus()[-3:-1]]).items() if hit}


def test_rows_of_one_id_and_long_texts(spark, docs_of):
    rng = np.random.default_rng(19)
    say = lambda n: [f"v{k}" for k in rng.integers(100_000, size=n)]
    passage, long = say(60), say(200_000)
    docs = docs_of([(1, " ".join(passage)), (2, " ".join(say(9) + passage)), (2, "own " + " ".join(say(80))), (3, " ".join(long)), (4, " ".join(say(5) + long + say(5))), (None, " ".join(passage))])
    out = sorted(((r.doc_id or 0, len(r.text.split())) for r in sd.stage(spark, docs.withColumnRenamed("score", "spans_"), "").collect()))
    assert out == [(0, 60), (1, 60), (2, 9), (2, 81), (3, 200_000), (4, 10)]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force_where_passages_share_prefixes(docs_of, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    say = lambda n: [f"v{k}" for k in rng.integers(40, size=n)]
    base = [say(120) for _ in range(3)]
    rows = []
    for i in range(80):
        b = base[int(rng.integers(3))]
        lo = int(rng.integers(0, 70))
        rows.append((i, " ".join(say(int(rng.integers(0, 20))) + b[lo : lo + int(rng.integers(30, 90))] + say(int(rng.integers(0, 20))))))
    monkeypatch.setattr(sd, "parts", lambda s: 11)
    monkeypatch.setattr(sd, "PIECE", 60)
    assert spans(sd.repeated_spans(docs_of(rows))) == {d: hit for d, hit in brute(rows).items() if hit}
