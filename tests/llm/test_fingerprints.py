import hashlib

import numpy as np
from hypothesis import given, settings, strategies as st

from verbatica.llm import fingerprints as fp


def prose(rng, n):
    return " ".join("".join(rng.choice(list("etaoinshrdlu"), size=int(rng.integers(2, 8)))) for _ in range(n))


def test_equal_substrings_share_names_whatever_their_offset():
    rng = np.random.default_rng(1)
    shared = prose(rng, 200)
    names = [set(), set()]
    for k, text in enumerate((prose(rng, 13) + shared + prose(rng, 5), "Q" + shared)):
        for level, n, _ in fp.parsed([text]):
            names[k] |= {(level, int(x)) for x in n}
    for level in (1, 2, 3):
        a, b = ({x for x in s if x[0] == level} for s in names)
        assert len(a & b) > 0.75 * len(b)


def test_likeness_orders_texts():
    rng = np.random.default_rng(2)
    base, other = prose(rng, 300), prose(rng, 300)
    half = base[: len(base) // 2] + other[: len(base) // 2]
    edited = base.replace("e", "e", 1)[:-3] + "xyz"
    rows = fp.fingerprints([base, base, edited, half, other, "", ""])
    like = lambda i, j: float(fp.likeness(rows[i : i + 1], rows[j : j + 1])[0])
    assert like(0, 1) == 1.0 and like(5, 6) == 1.0 and like(0, 5) == 0.0
    assert 1 > like(0, 2) > 0.85 > 0.65 > like(0, 3) > 0.3 > 0.1 > like(0, 4)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="ab é🎉", max_size=60), min_size=1, max_size=5))
def test_a_text_is_fingerprinted_alike_in_any_company(texts):
    together = fp.fingerprints(texts)
    assert all((together[i] == fp.fingerprints([t])[0]).all() for i, t in enumerate(texts))


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        f = fp.fingerprints([t, e, u])
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), *fp.digits(f[:2]), round(float(fp.likeness(f[:1], f[1:2])[0]), 9), round(float(fp.likeness(f[:1], f[2:3])[0]), 9)))
    return sorted(out, key=str)


def test_neighbours_equal_the_plain_loop(docs_of):
    rng = np.random.default_rng(3)
    rows = [(int(i), prose(rng, int(rng.integers(0, 60)))) for i in rng.permutation(60) * 7 - 100]
    rows += [(5000, None), (6000, "é🎉" * 9), (6000, "same id"), (None, "no id"), (7000, "x" * 5000), (8000, "")]
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fp.with_neighbours(docs_of(rows)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_one_document_and_none(docs_of):
    one, = fp.with_neighbours(docs_of([(1, "abcdef")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0
    assert fp.with_neighbours(docs_of([(1, "a")]).where("false")).collect() == []
    assert fp.fingerprinted(docs_of([(1, None)])).first().fingerprint == "ffff" * 128
