import random

import pytest

from verbatica.llm import html_extraction as hx
from verbatica.llm.html_blocks import ARTICLE, CHROME, MAIN, OPEN, blocks


def text_of(html):
    return hx.main_text(blocks(html), [])[0]


PAGES = {
    "parts": ("""<!DOCTYPE html><html><head><title>T &lt;p&gt;</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head><body class="has-sidebar nav-open">
        <header><a href="/">Home</a></header><nav><ul><li>A<li>B</ul></nav><aside>side</aside><div class="cookie-notice">We use cookies</div>
        <article class="post"><header><h1>The &amp; Title</h1><p>by me</p></header><p>One  two<br>three&nbsp;four.<p>Five <b>six</b><i>seven</i></p><div class="ad">Buy!</div>
        <form><label>Mail</label><input></form><blockquote>Quote</blockquote><!-- <p>no</p> --><p>Last<span class="ad-slot">Now!</span> one.</p><footer>Tags</footer>
        <section id="comments"><p>Great post</p><article class="comment"><p>Me too</p></article></section></article><div role="contentinfo">(c)</div><footer>&copy; 2024</footer></body></html>""",
              "The & Title\n\nOne two three four.\n\nFive sixseven\n\nQuote\n\nLast one."),
    "broken": ("<article><p><b>One<br><p>Two &am &amp</b> < 3 and <em>four</article><p>out", "One\n\nTwo &am & < 3 and four"),
    "main": ("<body><div>top</div><main><h2>H</h2><div>text</div><ul><li>a<li>b</ul></main><div>low</div>", "H\n\ntext\n\na\n\nb"),
    "open": ("<div>Only</div>text<p>here &#233;&#x1F600;</p>", "Only\n\ntext\n\nhere é😀"),
    "role": ('<div role="navigation">n</div><div role=main><p>x</p></div>', "x"),
    "body class": ('<div class="entry-content clearfix"><p>x</p><div class="share-buttons">s</div></div><p>y', "x"),
    "one form": ('<form id="aspnet"><div>menu</div><article><p>x</p></article></form>', "x"),
    "misnested": ("<article><b><nav></b>menu</nav>text</article>", "text"),
    "script only": ("<script>x</script>", ""),
    "open comment": ("a<!-- b", "a"),
    "open script": ("<p>a</p><script>b", "a"),
    "quotes": ("<article><p title='a>b' data-x=\"<p>\" it's>text</p><a href=\"x>y</p>z</article>", "text\n\ny\n\nz"),
    "table": ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\n\nb\n\nc"),
    "empty": ("", ""),
    "hidden articles": ('<div class="sidebar"><article><p>teaser</p></article></div><article><p>story</p></article>', "story"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, want = PAGES[name]
    assert text_of(html) == want


def test_parts_of_a_page():
    assert [b.part for b in blocks("<nav>a</nav><p>b</p><main>c<article>d</article></main>")] == [CHROME, OPEN, MAIN, ARTICLE]
    assert [b.linked for b in blocks("<p><a>link link</a> x</p><p>text <a>l</a></p>")] == [True, False]


def test_deep_and_endless_markup_takes_no_time():
    assert text_of("<div>" * 30_000 + "x" + "</b></div>" * 30_000) == "x"
    assert text_of("<p>x" * 20_000).count("x") == 20_000
    assert text_of("<a b='" * 20_000) == "" and text_of("<" * 20_000) == "<" * 20_000


def plainly_covered(pages):
    """(host, html) to covered blocks, by comparing every suffix at a block with every other."""
    streams = {}
    for host, html in {(h, t or "") for _, h, t in pages}:
        words, first = hx.tokens(blocks(html))
        streams[host, html] = [words[f:][: hx.LEAST + hx.AFTER] for f in first]
    out = {}
    for one, suffixes in streams.items():
        hit = set()
        for k, s in enumerate(suffixes):
            for other, theirs in streams.items():
                if other == one or other[0] != one[0]:
                    continue
                for t in theirs:
                    n = 0
                    while n < min(len(s), len(t)) and s[n] == t[n]:
                        n += 1
                    if n >= hx.LEAST:
                        hit |= set(range(k, k + s[:n].count(1)))
        out[one] = hit
    return out


def _random_pages(seed, n):
    rng = random.Random(seed)
    words = [chr(97 + i) * 2 for i in range(12)]
    frames = [[" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(rng.randint(1, 6))] for _ in range(6)]
    out = []
    for i in range(n):
        body = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(rng.randint(0, 5))]
        if rng.random() < 0.2:
            body = [rng.choice(words)] * rng.randint(1, 40)
        f, g = rng.choice(frames), rng.choice(frames)
        host = rng.choice(["a.com", "b.com", ""])
        out.append((i, host, "".join(f"<div>{t}</div>" for t in [*f, *body, *g])))
    return out + [(n, "a.com", None), (n + 1, "a.com", ""), (n + 2, *out[0][1:]), (n + 3, *out[0][1:]), (None, *out[1][1:])]


@pytest.mark.parametrize("ranges, piece, size", [(1, 7, 40), (37, 1 << 17, 40), (5, 16, 120), (1, 1 << 17, 120)])
def test_covered_blocks_equal_all_comparisons(spark, ranges, piece, size):
    pages = _random_pages(size + ranges, size)
    df = spark.createDataFrame([(i, f"http://{h}/x" if h else None, t, "p") for i, h, t in pages], "page_id long, url string, html string, page string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        rows = hx.extracted(df, piece=piece).collect()
        shuffled = hx.extracted(df, broadcast_bytes=-1).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plainly_covered(pages)

    def expected(i, host, html):
        hit = sorted(want[host, html or ""])
        page = blocks(html or "")
        kept = [b.text for k, b in enumerate(page) if k not in hit] or [b.text for b in page]
        text = "\n\n".join(kept)
        return repr(i), text, len(text), len(page), len(hit)

    assert sorted((repr(r.page_id), r.text, r.n_chars, r.n_blocks, r.n_covered) for r in rows) == sorted(expected(*p) for p in pages)
    assert sorted(map(repr, shuffled)) == sorted(map(repr, rows))


def test_unmarked_boilerplate_goes_and_shared_passages_of_articles_stay(spark):
    top, low = "<div>Our site has many stories to read</div><ul><li>News<li>World<li>Sport</ul>", "<div>All rights are ours since ever</div>"
    rows = [(i, f"https://h.org/{i}", f"{top}<p>Story number {i} is about the {w} that came by</p>{low}") for i, w in enumerate(["fox", "cow", "owl", "hen"])]
    quoted = "<p>A passage which two articles share word by word</p>"
    rows += [(10 + i, "https://h.org/q", f"{top}<article>{quoted}<p>own {i}</p></article>{low}") for i in range(2)]
    rows += [(20, "https://alone.org/", f"{top}<p>Alone</p>{low}")]
    out = {r.page_id: r for r in hx.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[i].text for i in range(4)] == [f"Story number {i} is about the {w} that came by" for i, w in enumerate(["fox", "cow", "owl", "hen"])]
    assert out[10].text == "A passage which two articles share word by word\n\nown 0" and out[10].n_covered >= 6
    assert out[20].text.startswith("Our site") and out[20].n_covered == 0
    assert hx.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").where("false")).collect() == []
