import hashlib

import pytest

from verbatica.llm import fill_in_middle as fim

SENTINELS = ("<P>", "<S>", "<M>")


def plainly(key, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= 90:
        return "plain", None, None, text
    pre, mid, suf = text[:low], text[low:high], text[high:]
    if h[3] % 100 < 20:
        return "spm", low, high - low, f"<S>{suf}<P>{pre}<M>{mid}"
    return "psm", low, high - low, f"<P>{pre}<S>{suf}<M>{mid}"


ROWS = [(i, t) for i, t in enumerate(
    ["", None, "a", "ab", "<", "<<S", "S>P>", "x <P> y", "<M>", "é👍́ñ" * 50, "line\nline\r\n\ttab", "<S", "P>", "a<" * 30, ">" * 40, "\x00\x01", "🏳️‍🌈" * 9, "word " * 40_000, "é" * 300_000]
    + ["text number %d with words < S > and <p>" % k for k in range(150)])]
ROWS += [(None, "no key"), (None, "no key"), (5, "again five"), (5, "again five"), (-7, "negative")]


def test_outputs_equal_the_plain_form_and_restore(docs_of, monkeypatch):
    monkeypatch.setattr(fim, "PORTION", 500)
    out = fim.transformed(docs_of(ROWS).withColumnsRenamed({"score": "output"}))
    rows = out.select("*", fim.restored(out.output, out.form).alias("back")).collect()
    assert len(rows) == len(ROWS)
    want = sorted((repr(k), len(t or ""), *plainly(k, t), t or "") for k, t in ROWS)
    assert sorted((repr(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in rows) == want
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_empty_table_and_other_rates(spark, docs_of):
    assert fim.transformed(docs_of([(1, "x")]).where("false")).collect() == []
    held = [t for _, t in ROWS if not t or any(s in t for s in SENTINELS)]
    assert [r.form for r in fim.transformed(docs_of(ROWS), rate=100, suffix_first=100).collect()].count("plain") == len(held)
    assert {r.form for r in fim.transformed(docs_of(ROWS), rate=0).collect()} == {"plain"}
    texts = spark.createDataFrame([("k", "some text")], "name string, text string")
    assert fim.transformed(texts, key="name").columns[0] == "name"


@pytest.mark.parametrize("texts", [["abc", "", "dé"], ["👍"], [""], ["a" * 10]])
def test_pieces(texts):
    import pyarrow as pa

    low, high = [len(t) // 3 for t in texts], [len(t) // 2 for t in texts]
    got = [x.to_pylist() for x in fim.pieces(pa.array(texts), pa.array(low), pa.array(high))]
    assert got == [[t[:a] for t, a in zip(texts, low)], [t[a:b] for t, a, b in zip(texts, low, high)], [t[b:] for t, b in zip(texts, high)]]
