"""HTML pages as events, and which elements are page furniture.

A small tolerant tokenizer: comments, raw-text elements, unclosed and implied end
tags.  An element is known by its path of tags with class and id names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

OPEN, CLOSE, TEXT, SPACE = range(4)

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'](?=[^\"']*>))*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select article section div body html td th nav aside main".split())

# Names by which pages mark what is not their article.
FURNITURE_TAGS = frozenset(
    "head nav header footer aside form script style noscript template button select textarea iframe svg canvas dialog menu object "
    "audio video noembed noframes title".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices notification popup modal overlay sidebar rail menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "comment comments disqus replies share sharing social related recommended newsletter subscribe subscription signup login search "
    "pagination pager skip widget widgets toolbar topbar sidenav topnav subnav commentlist commentform respond responses discussion "
    "adbox adunit adsense cookiebar cookiebanner".split()
)
_HEADINGS = FURNITURE_NAMES & {"header", "banner", "masthead", "notice"}
_REMARKS = frozenset("comment comments reply replies disqus ad ads advert sponsored".split())


@dataclass(frozen=True)
class Element:
    path: str
    tag: str
    furniture: bool
    main: bool


#: With one of these a "header" is the head of the text.
_OWN = frozenset("article entry post story".split())


def _name_words(names: str) -> set[str]:
    """The words of class and id names, and neighbours written as one ("side-bar")."""
    words: set[str] = set()
    for name in names.split():
        own = [w.lower() for w in _WORD.findall(name)]
        words.update(own)
        words.update(a + b for a, b in zip(own, own[1:], strict=False))
    return words


@lru_cache(maxsize=50_000)
def _element(path: str, tag: str, names: str, role: str, hidden: bool, in_article: bool) -> Element:
    words = _name_words(names)
    if tag in ("html", "body", "main"):
        marked = False
    elif tag == "article":
        marked = bool(words & _REMARKS)
    else:
        by_tag = tag in FURNITURE_TAGS and not (tag == "header" and in_article)
        by_name = words & (FURNITURE_NAMES - _HEADINGS if in_article else FURNITURE_NAMES - {"header"} if words & _OWN else FURNITURE_NAMES)
        marked = by_tag or role in FURNITURE_ROLES or hidden or bool(by_name)
    main = not marked and (tag in ("article", "main") or role in ("article", "main") or "articleBody" in names)
    return Element(f"{path}/{tag}" + (f".{'.'.join(names.split())}" if names else ""), tag, marked, main)


def _attributes(text: str) -> tuple[str, str, bool]:
    names, role, hidden = [], "", False
    if text and not text.isspace():
        for m in _ATTR.finditer(text):
            key = (m[1] or m[5]).lower()
            value = m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "itemprop"):
                names.append(value)
            elif key == "role":
                role = value.strip().lower()
            elif key == "hidden":
                hidden = True
    return " ".join(names), role, hidden


def events(page: str) -> Iterator[tuple[int, object]]:
    """(OPEN, Element), (CLOSE, Element), (TEXT, decoded string) and (SPACE, None)
    for a line break, in page order; every opened element is closed."""
    stack: list[Element] = []
    articles = 0
    at, n = 0, len(page)

    def leave(keep: int):
        nonlocal articles
        while len(stack) > keep:
            gone = stack.pop()
            articles -= gone.main
            yield CLOSE, gone

    while at < n:
        m = _TOKEN.search(page, at)
        start = m.start() if m else n
        if start > at:
            yield TEXT, html.unescape(page[at:start])
        if not m:
            break
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                yield TEXT, m[0][9:].removesuffix("]]>")
            continue
        tag = tag.lower()
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    yield from leave(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            if tag == "br":
                yield SPACE, None
            continue
        if tag == "br":
            yield SPACE, None
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p":
                    yield from leave(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in SIBLINGS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in SIBLINGS[tag]:
                    yield from leave(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        names, role, hidden = _attributes(m["attrs"])
        # Inline elements stay out of paths: text looks alike in bold or not.
        base = next((e.path for e in reversed(stack) if e.tag not in INLINE), "")
        own = _element(base, tag, names, role, hidden, articles > 0)
        if tag in VOID:
            if tag not in INLINE:
                yield OPEN, own
                yield CLOSE, own
            continue
        if m[0].endswith("/>") and (tag in ("svg", "path", "circle") or "svg" in base):
            continue
        yield OPEN, own
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag == "title":
                yield TEXT, html.unescape(page[at : stop.start() if stop else n])
            at = stop.end() if stop else n
            yield CLOSE, own
            continue
        stack.append(own)
        articles += own.main
    yield from leave(0)
