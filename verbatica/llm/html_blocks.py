"""Blocks of text of one page: what an HTML tree holds, in page order, and which part of the page each belongs to.

A block is the text between two borders of block elements, character references decoded and white space as single spaces.  Broken markup is
read as browsers do in the main cases: tags that nobody closed, closing tags that nobody opened, quotes and comments without an end.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from typing import NamedTuple

#: Parts of a page: what its markup says is no article, what it leaves open, its main element, its article.
CHROME, OPEN, MAIN, ARTICLE = range(4)

BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, and of no interest.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in "iframe noembed noframes noscript script style textarea title xmp".split()}
#: Elements that are never part of an article, whatever their attributes say; fences hold what is not text at all.
NEVER = frozenset("aside dialog footer menu nav search button datalist fieldset label legend optgroup option output select".split())
FENCES = frozenset("audio canvas map object picture svg template video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag that ends an open element of these names, if that is the nearest block.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
        "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
#: Words of classes and ids, and roles, of parts that are no article.
WORDS = frozenset("""ad ads adbox adsense adslot adunit advert advertisement advertising adverts banner breadcrumb breadcrumbs comment commentlist comments consent cookie
    cookiebar cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation navigationbar newsletter notice notices notification overlay pager
    pagination popup promo promoted promotion recommended related reply replies respond search share sharebar sharing sidebar signin signup skiplink social sponsor sponsored
    subscribe subscription toolbar widget""".split())
#: The same for an element that is itself an article.
ASIDE_WORDS = frozenset("ad ads advert advertisement comment promo reply related sponsored teaser".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Two of these words, one of each kind, in a class or id name the body of an article.
BODY_KINDS, BODY_PARTS = frozenset("article entry post story".split()), frozenset("body content text".split())

_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</(?![a-zA-Z])[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>=]*(?:=\s*(?:"[^"]*"|'[^']*'|)[^>=]*)*)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Bits of what an open element says about the text in it.
_OUT, _FORM, _HEAD, _MAIN, _ARTICLE, _LINK = 1, 2, 4, 8, 16, 32


class Block(NamedTuple):
    part: int
    text: str
    #: Most of the text is links.
    linked: bool


@lru_cache(maxsize=4096)
def _said(name: str, attributes: str) -> int:
    """What class, id, role and itemprop of an element say."""
    given = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    role, prop = given.get("role", "").strip().lower(), given.get("itemprop", "").lower().split()
    out = 0
    if role == "main":
        out |= _MAIN
    if role == "article" or "articlebody" in prop:
        out |= _ARTICLE
    if name in ("html", "body", "main"):
        return out
    for names in (given.get("class", "").split(), [given.get("id", "")]):
        for one in names:
            words = {w.lower() for w in _WORD.findall(one)}
            if words & {"with", "has", "no", "without"}:
                continue
            if BODY_KINDS & words and BODY_PARTS & words:
                out |= _ARTICLE
            elif words & (ASIDE_WORDS if name == "article" else WORDS):
                out |= _OUT
            elif "header" in words and name != "article":
                out |= _HEAD
    return out | _OUT if role in ROLES else out


def _within(state: int, name: str, attributes: str) -> int:
    """The state inside an element that is opened in this one."""
    said = _said(name, attributes) if ("class" in attributes or "id" in attributes or "role" in attributes or "itemprop" in attributes.lower()) else 0
    if name in NEVER or name in FENCES:
        said |= _OUT
    elif name == "article" and not said & _OUT:
        said |= _ARTICLE
    elif name == "main":
        said |= _MAIN
    elif name == "header":
        said |= _HEAD
    elif name == "form":
        said |= _FORM
    elif name == "a":
        said |= _LINK
    if said & _ARTICLE | said & _MAIN:
        state &= ~_FORM  # a page may be one form as a whole
        said &= ~(_OUT | _HEAD | _FORM) if said & _ARTICLE and name != "article" else -1
    if name in HEADINGS and state & (_MAIN | _ARTICLE):
        return (state & ~_HEAD) | (said & ~_HEAD)  # the title in an article's head
    return state | said


def _part(state: int) -> int:
    if state & (_OUT | _FORM | _HEAD):
        return CHROME
    return ARTICLE if state & _ARTICLE else MAIN if state & _MAIN else OPEN


def blocks(html: str) -> list[Block]:
    """The blocks of a page, in page order."""
    out: list[Block] = []
    inside: list[str] = []  # pieces of the block that is being read
    beside: list[str] = []  # pieces of inline elements in it that are no part of an article
    linked = [0, 0]
    part = OPEN
    stack: list[tuple[str, bool, int]] = [("", True, 0)]
    names: dict[str, int] = {}
    state = at = 0

    def flush() -> None:
        nonlocal inside, beside, linked
        for pieces, where, links in ((inside, part, linked[0]), (beside, CHROME, linked[1])):
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(where, text, 2 * links >= len(text)))
        inside, beside, linked = [], [], [0, 0]

    def pop(count: int) -> None:
        nonlocal state
        for _ in range(count):
            names[stack.pop()[0]] -= 1
        state = stack[-1][2]

    def depth(until) -> int:
        """How many open elements lie down to the nearest one for which until holds, that one included."""
        n = 1
        while not until(stack[-n]):
            n += 1
        return n

    def nearest_block() -> tuple[int, str]:
        n = depth(lambda e: e[1])
        return n, stack[-n][0]

    while at < len(html):
        tag = _TAG.search(html, at)
        end = tag.start() if tag else len(html)
        if end > at:
            text = html[at:end]
            if "&" in text:
                text = unescape(text)
            where = _part(state)
            if where == CHROME:
                beside.append(text)
                linked[1] += len(text) if state & _LINK else 0
            else:
                if not text.isspace():
                    part = where
                inside.append(text)
                linked[0] += len(text) if state & _LINK else 0
        if not tag:
            break
        at = tag.end()
        name = tag.group(2)
        if name is None:
            continue
        name = name.lower()
        block = name in BLOCKS
        if tag.group(1):
            if block:
                flush()
            if not names.get(name):
                continue
            if block or name in FENCES:
                pop(depth(lambda e: e[0] == name))
            else:  # an inline element doesn't close a block in which it does not stand
                n, _ = nearest_block()
                inner = [e[0] for e in stack[len(stack) - n + 1 :]]
                if name in inner:
                    pop(len(inner) - max(i for i, e in enumerate(inner) if e == name))
            continue
        if name in VOID:
            if name == "br":
                inside.append(" ")
                beside.append(" ")
            elif block:
                flush()
            continue
        if name in RAW:
            closing = RAW[name].search(html, at)
            at = closing.start() if closing else len(html)
            continue
        if block:
            flush()
            n, open_block = nearest_block()
            if open_block == "p":
                pop(n)
                n, open_block = nearest_block()
            while open_block in ENDS.get(name, ()):
                pop(n)
                n, open_block = nearest_block()
        elif name == "a" and state & _LINK:
            n, _ = nearest_block()
            inner = [e[0] for e in stack[len(stack) - n + 1 :]]
            if "a" in inner:
                pop(len(inner) - inner.index("a"))
        state = _within(state, name, tag.group(3))
        stack.append((name, block or name in FENCES, state))
        names[name] = names.get(name, 0) + 1
    flush()
    return out
