"""Main text of pages by equivalence-class template deduction.

Pages of a host are dealt into blocks of about ``block_pages``; a host with most
pages is many blocks.  In a block every element path's opening and closing tag is
a token with an occurrence vector (its count in each page).  Tokens that share a
vector are an equivalence class; a class is valid if its tokens come in one order
in all pages, and valid classes nest where each occurrence of one lies in a single
slot of another.  Classes that do not nest are no part of
the template.  The slots between template tokens hold the pages' data.  Slots
under elements whose names mark page furniture are dropped, and of a page that
marks its article, slots outside it.

A slot's text is a token too, known by path and text.  It is of the template, and
dropped inside a marked article as well, where at least four pages and half of all
have it and it is in one class with an element around it.  Only distinct pages
count: a page that has over half of its text from a longer one is a copy, however
often it is repeated.  In pages without a marked article the main element is the
innermost one of the template around nearly all text, by one vote a page; outside
it such repeated text is template without an element of its class, elements of the
template whose text is links on most pages are menus, and all other text stays.  Text of a slot is never cut: only whole slots are kept or dropped.  A
page of which nothing else is left keeps the template's text.

Defined results: null or empty pages have empty text; a null url is a host of its
own; repeated rows are extracted alike; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onomast.llm.htmltext import CLOSE, INLINE, OPEN, SPACE, TEXT, Element, events
from onomast.sources.scratch import written

Event = tuple[int, object]
#: Path and text of what stands between two tags that are not inline.
Slot = tuple[str, str]


def occurrences(pages: list[list[Event]]) -> dict[tuple[int, str], list[int]]:
    """Occurrence vector of each tag token: its count in every page."""
    vectors: dict[tuple[int, str], list[int]] = {}
    for k, page in enumerate(pages):
        for kind, what in page:
            if kind in (OPEN, CLOSE) and what.tag not in INLINE:
                vectors.setdefault((kind, what.path), [0] * len(pages))[k] += 1
    return vectors


def occurrence_classes(pages: list[list[Event]]) -> list[list[tuple[int, str]]]:
    """Equivalence classes: tag tokens with the same count in every page."""
    classes: dict[tuple[int, ...], list[tuple[int, str]]] = defaultdict(list)
    for token, vector in occurrences(pages).items():
        classes[tuple(vector)].append(token)
    return list(classes.values())


def ordered(tokens: set[tuple[int, str]], sequences: list[list[tuple[int, str]]]) -> bool:
    """Whether the tokens come in the same order in each of their occurrences."""
    order: list[tuple[int, str]] | None = None
    width = len(tokens)
    for sequence in sequences:
        own = [t for t in sequence if t in tokens]
        if own and order is None:
            order = own[:width]
        if order is not None and own != order * (len(own) // width):
            return False
    return True


class Template:
    """The valid classes of a block of pages and how they nest.  Pages that are for the
    greater part copies of a longer one have no say."""

    def __init__(self, pages: list[list[Event]]):
        slots = [open_slots(p) for p in pages]
        distinct = _distinct(slots)
        pages, slots = [pages[k] for k in distinct], [slots[k] for k in distinct]
        sequences = [[(kind, what.path) for kind, what in p if kind in (OPEN, CLOSE) and what.tag not in INLINE] for p in pages]
        self.classes: list[list[tuple[int, str]]] = []
        for tokens in occurrence_classes(pages):
            if ordered(set(tokens), sequences):
                self.classes.append(tokens)
            else:  # not one class: elements by themselves still are
                by_path = defaultdict(list)
                for t in tokens:
                    by_path[t[1]].append(t)
                self.classes += by_path.values()
        self.of = {t: k for k, tokens in enumerate(self.classes) for t in tokens}
        self.parents = self._nest(sequences)
        self.known = {""} | {path for (_, path), k in self.of.items() if k in self.parents}
        self.often, self.fixed = self._texts(pages, slots)
        self.menus = self._menus(pages)
        self.main = self._main(slots)

    def _nest(self, sequences) -> dict[int, tuple[int, str] | None]:
        """For each class that nests, the opening token whose slot holds all of its
        occurrences; None for what is outermost.  Classes found in several slots are absent."""
        slots: dict[int, set[tuple[int, str] | None]] = defaultdict(set)
        firsts = {k: tokens[0] for k, tokens in enumerate(self.classes)}
        for sequence in sequences:
            inside: list[tuple[int, str] | None] = []
            for token in sequence:
                k = self.of[token]
                if token == firsts[k]:
                    slots[k].add(inside[-1] if inside else None)
                if token[0] == OPEN:
                    inside.append(token)
                elif inside:
                    inside.pop()
        return {k: next(iter(s)) for k, s in slots.items() if len(s) == 1}

    def _texts(self, pages, slots) -> tuple[set[Slot], set[Slot]]:
        """Texts that at least four pages and half of all repeat under one path, and
        those of them in the class of an element around them."""
        support = Counter(s for page in slots for s in set(page))
        often = {s for s, c in support.items() if c >= 4 and 2 * c >= len(pages)}
        vectors: dict[Slot, list[int]] = {s: [0] * len(pages) for s in often}
        for k, page in enumerate(slots):
            for s in page:
                if s in often:
                    vectors[s][k] += 1
        tags = occurrences(pages)
        tags[OPEN, ""] = [1] * len(pages)
        fixed = {s for s, v in vectors.items() if any(p in self.known and tags[OPEN, p] == v for p in _around(s[0]))}
        return often, fixed

    def _menus(self, pages) -> set[str]:
        """The paths of template elements whose text is almost all links, of several at
        least, on most of the pages that have them."""
        lists: Counter = Counter()
        others: Counter = Counter()
        for page in pages:
            if not _has_article(page):
                for path, (texts, linked, n_links) in link_shares(page).items():
                    (lists if n_links > 1 and linked >= 0.8 * texts else others)[path] += 1
        return {path for path, n in lists.items() if n > others[path] and path in self.known and path.count("/") > 2}

    def _main(self, slots) -> str:
        """The path of the innermost template element around nearly all text of the
        slots; each page has one vote, dealt out by the shares of its own text."""
        around: Counter = Counter()
        votes = 0
        for page in slots:
            own = [(path, len(text)) for path, text in page if (path, text) not in self.fixed and self.menus.isdisjoint(_around(path))]
            total = sum(n for _, n in own)
            votes += total > 0
            for path, n in own:
                for p in _around(path):
                    around[p] += n / total
        fit = [p for p, share in around.items() if share >= 0.9 * votes and p in self.known and p.rsplit("/", 1)[-1].split(".")[0] in ("body", "div", "section", "main", "article", "td")]
        return max(fit, key=lambda p: p.count("/"), default="")


def link_shares(page: list[Event]) -> dict[str, tuple[int, int, int]]:
    """For each element path: characters of text in it, those of them in links, and links."""
    shares: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    paths: list[str] = []
    links = 0
    for kind, what in page:
        if kind == TEXT:
            n = len("".join(what.split()))
            for path in paths:
                shares[path][0] += n
                shares[path][1] += n if links else 0
        elif kind == OPEN:
            if what.tag == "a":
                links += 1
                for path in paths:
                    shares[path][2] += 1
            elif what.tag not in INLINE:
                paths.append(what.path)
        elif kind == CLOSE:
            if what.tag == "a":
                links -= 1
            elif what.tag not in INLINE:
                paths.pop()
    return {path: tuple(share) for path, share in shares.items()}


def _around(path: str) -> list[str]:
    """The paths of the page and of all elements down to ``path``."""
    parts = path.split("/")
    return ["/".join(parts[:k]) for k in range(1, len(parts) + 1)]


def _distinct(slots: list[list[Slot]]) -> list[int]:
    """The pages with text less than half of which a longer page (or an earlier one) has too."""
    sizes = [{s: len(s[1]) for s in page} for page in slots]
    totals = [sum(size.values()) for size in sizes]
    kept: list[int] = []
    for k in sorted(range(len(slots)), key=lambda k: (-totals[k], k)):
        own = sizes[k]
        if own and not any(2 * sum(own[s] for s in own.keys() & sizes[j].keys()) > totals[k] for j in kept):
            kept.append(k)
    return sorted(kept)


def open_slots(page: list[Event]) -> list[Slot]:
    """(path, text) of each slot outside furniture; of a page that marks its article,
    those inside it only."""
    marked = _has_article(page)
    slots: list[Slot] = []
    now: list[str] = []
    paths: list[str] = [""]
    dropped = inside = 0
    for kind, what in page:
        if kind == TEXT:
            if not dropped and (inside or not marked):
                now.append(what)
        elif kind == SPACE:
            now.append("\n")
        else:
            block = what.tag not in INLINE
            if block:
                text = " ".join("".join(now).split())
                if text:
                    slots.append((paths[-1], text))
                now.clear()
            step = 1 if kind == OPEN else -1
            dropped += step * what.furniture
            inside += step * what.main
            if block and kind == OPEN:
                paths.append(what.path)
            elif block:
                paths.pop()
    text = " ".join("".join(now).split())
    if text:
        slots.append((paths[-1], text))
    return slots


def main_text(page: list[Event], template: Template, constant: bool = False) -> str:
    """The kept slots of a page as blocks; ``constant`` keeps text of the template too."""
    main, marked = template.main, _has_article(page)
    within = not marked and main and any(k == OPEN and w.path == main for k, w in page)

    def stays(slot: Slot) -> bool:
        outside = within and slot[0] != main and not slot[0].startswith(main + "/")
        if not marked and not template.menus.isdisjoint(_around(slot[0])):
            return False
        return slot not in (template.often if outside else template.fixed)

    return "\n\n".join(slot[1] for slot in open_slots(page) if constant or stays(slot))


def _has_article(page: list[Event]) -> bool:
    dropped = 0
    for kind, what in page:
        if kind == OPEN:
            dropped += what.furniture
            if what.main and not dropped:
                return True
        elif kind == CLOSE:
            dropped -= what.furniture
    return False


def extract(pages: list[str | None]) -> list[str]:
    """The main texts of one block of same-host pages."""
    parsed = [list(events(p or "")) for p in pages]
    template = Template(parsed)
    # Pages that are nothing but template are copies of each other: their text stays.
    return [main_text(p, template) or main_text(p, template, True) for p in parsed]


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block_pages: int = 64) -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    sizes = rows.groupBy(F.col("host").alias("h")).agg(F.ceil(F.count("*") / block_pages).cast("int").alias("blocks"))
    sizes = written(sizes, "hosts")
    block = F.pmod(F.xxhash64("id", "url", "html"), F.col("blocks"))
    rows = rows.join(sizes, F.col("host") == F.col("h")).select("host", block.alias("block"), "id", "url", "html")
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(block: pa.Table) -> pa.Table:
        texts = extract(block.column("html").to_pylist())
        return pa.table(
            {id_col: block.column("id"), url_col: block.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
        )

    return rows.groupBy("host", "block").applyInArrow(run, f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars long")
