import numpy as np
from hypothesis import given, settings, strategies as st

from verbatica.llm import textops
from verbatica.llm.textops import Words, not_blank, portions, window_hashes
import pyarrow as pa
import re


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet=" ab\nAÉ🎉\t", max_size=30), min_size=1, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    words = Words(texts, not_blank)
    expected = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    assert words.n.tolist() == [len(w) for w in expected]
    by_hash = {}
    for h, w in zip(words.hash.tolist(), [w for e in expected for w in e], strict=True):
        assert by_hash.setdefault(h, w) == w
    assert len(set(by_hash.values())) == len(by_hash)


def test_hashes_do_not_depend_on_place_or_segment(monkeypatch):
    text = "one two three four five six " * 40 + "x" * 300
    whole = Words([text], not_blank)
    moved = Words(["zero", text, ""], not_blank)
    assert (whole.hash == moved.hash[1:]).all()
    monkeypatch.setattr(textops, "_SEGMENT", 64)
    textops._powers.cache_clear()
    cut = Words([text], not_blank)
    assert (cut.hash == whole.hash).all()
    starts = np.arange(len(cut.hash) - 4)
    small = window_hashes(cut.hash, starts, 5)
    monkeypatch.undo()
    textops._powers.cache_clear()
    assert (small == window_hashes(whole.hash, starts, 5)).all()


def test_portions_keep_every_row_and_null():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": ["a" * 50, None, "", "b" * 50]})
    got = [t for _, texts in portions([batch], most=40, rows=2) for t in texts]
    assert got == ["a" * 50, "", "", "b" * 50]
