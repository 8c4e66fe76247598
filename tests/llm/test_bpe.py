import hashlib
import struct

import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from verbatica.llm import bpe

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as file:
        return Tokenizer.from_file(PATH), bpe.Encoder(file.read())


def same(both, text):
    want = both[0].encode(text, add_special_tokens=False)
    ids, decoded = both[1].encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want.ids
    assert decoded == both[0].decode(want.ids, skip_special_tokens=False)


CASES = ["", " ", "Hello, World!", "don't WE'LL i've", "<|startoftext|>a<|endoftext|><|END", "123 4½²", "ΑΣ ΣΑΣ İstanbul ǅ", "日本語 🎉🎉 é ﬁ", "a" * 255, "ab" * 400, "thhaen" * 300, "\x1cx\x85y　z", "\x00\x7f"]


@pytest.mark.parametrize("text", CASES)
def test_equals_the_library(both, text):
    same(both, text)


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]), max_size=60))
def test_equals_the_library_on_any_text(both, text):
    same(both, text)


def test_table(both, docs_of, spark):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(100, None), (100, None)]
    docs = docs_of(rows)
    out = bpe.encoded(docs, PATH).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    assert bytes(by_id[100].ids) == b"" and by_id[100].decoded == ""
    got = {r.doc_id: r for r in bpe.stage(spark, docs, "").collect()}
    want = both[0].encode(CASES[2], add_special_tokens=False).ids
    assert got[2].n_tokens == len(want) and got[2].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
    assert bpe.encoded(docs.where("false"), PATH).collect() == []
    again = bpe.decoded(bpe.encoded(docs, PATH), PATH).collect()
    assert all(r.decoded == r.decoded_text for r in again)


def test_every_kind_of_code_point(both):
    """Each code point by itself and doubled; of long runs of one kind (unassigned, ideographs, private) every 97th."""
    import unicodedata

    wide = {"Cn", "Co", "Lo"}
    for c in range(0x30000):
        if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c)) not in wide or c < 0x3000 or c % 97 == 0 or any(a <= c <= b for a, b in [*bpe.NEW_LETTERS[:-8], *bpe.NEW_DIGITS])):
            same(both, f"a{chr(c)}b {chr(c)}{chr(c)}")
