import pytest

from verbatica.llm import licenses, sharding, url_filter

URLS = [
    (1, "http://A.Example.org/es/5?x=1"), (2, "https://example.org/en/17#top"), (3, "https://example.org/en/27"), (4, "http://b.example.com/fr/1"), (5, "http://b.example.com/de"),
    (6, "http://b.example.com/de/9"), (7, None), (8, "no scheme"), (9, "http://org"), (10, "http://x.org/"), (11, "ftp://notexample.org/es/1"), (12, "http://q.example.net/en/1?u=http://x.org/"), (13, "http://h"),
]


def test_rules_hosts_and_paths(spark):
    pages = spark.createDataFrame([(i, u, "<html>", u) for i, u in URLS], "page_id long, url string, html string, host string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages).collect()}
    assert len(out) == len(URLS)
    assert out[1] == ("a.example.org", "/es/5", "example.org/es/", "block")
    assert out[2] == ("example.org", "/en/17", "example.org/en/1", "block")
    assert out[3] == ("example.org", "/en/27", "org/", "allow")
    assert out[4][2:] == ("com/fr/", "allow") and out[5][2] is None and out[6][2:] == ("com/de/", "block")
    assert out[7][:3] == ("", "", None) and out[8][:3] == ("", "", None) and out[9][:3] == ("org", "", None)
    assert out[10][2] == "org/" and out[11][2] == "org/" and out[12] == ("q.example.net", "/en/1", None, out[12][3]) and out[13][:2] == ("h", "")
    assert url_filter.judged(pages.where("false")).collect() == []


def test_a_template_of_blocked_pages_is_rejected(spark):
    rules = [("block", "bad.com/x/1"), ("allow", "good.com/")]
    rows = [(i, f"http://bad.com/x/1{i}") for i in range(30)] + [(100, "http://bad.com/x/7"), (101, "http://good.com/x/7"), (102, "http://new.com/x/7")]
    out = {r.page_id: r for r in url_filter.judged(spark.createDataFrame([(i, u, "") for i, u in rows], "page_id long, url string, html string"), rules).collect()}
    assert out[100].rule is None and out[100].verdict == "block" and out[100].template == "/x/#"
    assert out[101].verdict == "allow" and out[102].template == "/x/#"


def test_many_children_become_a_wildcard(spark):
    rows = [(i, f"http://h.com/user/name{chr(97 + i % 26)}{chr(97 + i // 26)}/home") for i in range(60)] + [(99, "http://h.com/about")] * 2
    out = {r.page_id: r.template for r in url_filter.judged(spark.createDataFrame([(i, u, "") for i, u in rows], "page_id long, url string, html string")).collect()}
    assert {out[i] for i in range(60)} == {"/user/*/home"} and out[99] == "/about"


def test_lookup_table_is_even_and_stable():
    names = [f"s{i}" for i in range(13)]
    held = sharding.lookup_table(names, 1009)
    sizes = [held.count(i) for i in range(13)]
    assert max(sizes) - min(sizes) <= 1 and -1 not in held
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(names[a] != names[b] for a, b in zip(held, fewer, strict=True) if a != 12)
    assert moved < 1009 * 0.25
    assert [names[::-1][i] for i in sharding.lookup_table(names[::-1], 1009)] == [names[i] for i in held]
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 1009)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_placement_equals_the_plain_hash(docs_of):
    import hashlib

    names = ["a", "b", "c"]
    rows = [(1, "x"), (2, None), (2, "y"), (None, "z")]
    out = sharding.place(docs_of(rows), "doc_id", names, 101).collect()
    held = sharding.lookup_table(names, 101)
    assert len(out) == 4
    for r in out:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, names[held[slot]])


def test_licenses_are_found_where_they_stand(docs_of):
    mit = licenses.TEMPLATES["MIT terms"]
    changed = mit.replace("free of charge", "gratis").replace("sublicense, ", "")
    long = "word " * 3000 + "Licensed under CC BY-NC 4.0." + " more" * 3000
    rows = [(1, "intro. Released under the MIT License. tail"), (2, "x\n" + changed + "\ny"), (3, None), (4, ""), (5, "the license of under"), (6, long), (7, "Released under the MIT License. " * 2)]
    out = licenses.scanned(docs_of(rows)).collect()
    found = {}
    for r in out:
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == {1, 2, 6, 7}
    assert [(r.license, r.coverage) for r in found[1]] == [("MIT", 1.0)] and rows[0][1][found[1][0].start : found[1][0].end] == "Released under the MIT License"
    best = max(found[2], key=lambda r: r.matched_words)
    assert best.license == "MIT terms" and 0.9 < best.coverage < 1 and rows[1][1][best.start : best.end].startswith("Permission is hereby")
    assert long[found[6][0].start : found[6][0].end] == "Licensed under CC BY-NC 4.0" and len(found[7]) == 2
    assert licenses.scanned(docs_of(rows).where("false")).collect() == []
    with pytest.raises(ValueError):
        licenses.Index({"x": " .. "})


def test_alignment_equals_the_plain_subsequence():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = rng.integers(4, size=12), rng.integers(4, size=15)
        table = np.zeros((13, 16), int)
        for i in range(12):
            for j in range(15):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + (a[i] == b[j]))
        assert licenses.aligned(a, b, 0, 40)[0] == table[12, 15]


def test_short_templates_need_each_word(docs_of):
    rows = [(1, "This is in the Public Domain. public-domain"), (2, "public. the domain"), (3, "wtfpl and WTFPL"), (4, "public"), (5, "domain")]
    found = sorted((r.doc_id, r.license, rows[r.doc_id - 1][1][r.start : r.end]) for r in licenses.scanned(docs_of(rows), {"PD": "public domain", "W": "WTFPL"}).collect())
    assert found == [(1, "PD", "Public Domain"), (1, "PD", "public-domain"), (3, "W", "WTFPL"), (3, "W", "wtfpl")]


def test_matches_equal_a_search_of_every_place(docs_of):
    """Planted templates with a few words changed, against alignment tried at every place."""
    import numpy as np

    rng = np.random.default_rng(12)
    template = [f"t{i}" for i in range(30)]
    rows = []
    for d in range(40):
        words = [f"w{k}" for k in rng.integers(500, size=int(rng.integers(0, 80)))]
        copy = list(template)
        for k in rng.choice(30, size=int(rng.integers(0, 10)), replace=False):
            copy[k] = "other"
        at = int(rng.integers(0, len(words) + 1))
        rows.append((d, " ".join(words[:at] + (copy if d % 4 else []) + words[at:])))
    index = licenses.Index({"T": " ".join(template)})
    want = {}
    for d, text in rows:
        words = licenses._words([text])[0]
        best = max((licenses.aligned(index.words[0], words[max(0, p - 8) : p + 38], p - max(0, p - 8))[0] for p in range(len(words))), default=0)
        if best >= 0.8 * 30:
            want[d] = best
    assert {r.doc_id: r.matched_words for r in licenses.scanned(docs_of(rows), {"T": " ".join(template)}).collect()} == want


def test_placement_replaces_columns_of_its_names(spark):
    df = spark.createDataFrame([(1, "x", 7), (2, "y", 8)], "doc_id long, shard string, slot int")
    out = sharding.place(df, "doc_id", ["a", "b"], 101)
    assert out.columns == ["doc_id", "slot", "shard"] and {r.shard for r in out.collect()} <= {"a", "b"}
    assert sharding.place(df.where("false"), "slot", ["a"], 101).collect() == []


def test_pages_that_repeat_and_long_urls(spark):
    rows = [(1, "http://h.com/a"), (1, "http://h.com/a"), (2, "http://h.com/" + "x/" * 20_000), (None, "http://h.com/a")]
    out = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(out) == 4 and len({(r.template, r.purity, r.verdict) for r in out if r.path == "/a"}) == 1
