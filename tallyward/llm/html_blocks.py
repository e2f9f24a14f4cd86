"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks with word count, link density, the same of both neighbours, and the
kind of region the block stands in. A small decision tree, trained on the labelled blocks below, tells article
text from the rest.

Defined results: null or empty html gives an empty text; text outside any element is a block; unclosed
elements end with their parent; an unknown character reference stays as written; a repeated row gives a
repeated result. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyward.llm.text import strings
from tallyward.session import ship

ship(__name__)

# Elements of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
UNREAD = set("script style template noscript iframe svg math object canvas head title select textarea".split())
CHROME = set("nav footer aside form dialog button menu".split())
ARTICLE = set("article main".split())
CHROME_NAMES = re.compile(
    r"(^|[\s_-])(ads?|adverts?|advertisement|sponsor(ed)?|banner|promo|cookies?|consent|notice|popup|modal|"
    r"nav(bar|igation)?|menu|breadcrumbs?|side-?bar|footer|masthead|comments?|discussion|replies|respond|"
    r"related|recommended|share|sharing|social|newsletter|subscribe|login|signup|toolbar|widget)($|[\s_-])",
    re.I,
)
CHROME_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu".split())

BODY, IN_ARTICLE, IN_CHROME = 0, 1, 2

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)",
    re.S,
)
RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in UNREAD}
NAMING = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ROLE = re.compile(r"\brole\s*=\s*[\"']?([\w-]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=/])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
SPACES = re.compile(r"\s+")

FEATURES = ("region", "words", "words_before", "words_after", "links", "links_before", "links_after")

#: Labelled blocks to learn from, in the order of FEATURES, then 1 for article text. Links are link densities.
LABELLED = """
1 40 8 60 0.0 0.0 0.0 1
1 60 40 35 0.0 0.0 0.0 1
1 1 40 30 0.0 0.0 0.0 1
1 2 1 1 0.0 0.0 0.0 1
1 8 6 40 0.0 1.0 0.0 1
1 12 3 50 0.0 0.0 0.0 1
1 25 30 5 0.2 0.0 0.0 1
1 3 60 8 0.0 0.0 0.0 1
1 90 80 12 0.1 0.0 0.0 1
1 15 0 0 0.0 0.0 0.0 1
1 6 20 22 1.0 0.0 0.0 1
1 5 0 9 0.0 0.0 0.0 1
1 33 2 1 0.0 1.0 1.0 1
0 45 50 60 0.0 0.0 0.0 1
0 70 30 4 0.05 0.0 0.0 1
0 30 12 33 0.1 0.0 0.1 1
0 22 8 40 0.0 0.0 0.0 1
0 14 40 35 0.0 0.0 0.1 1
0 55 0 0 0.0 0.0 0.0 1
0 28 3 2 0.0 1.0 1.0 1
0 18 45 3 0.0 0.0 1.0 1
0 120 9 80 0.2 0.0 0.1 1
0 9 44 50 0.0 0.0 0.0 1
0 6 38 41 0.0 0.1 0.0 1
0 1 1 1 1.0 1.0 1.0 0
0 2 2 1 1.0 1.0 1.0 0
0 5 4 6 1.0 1.0 1.0 0
0 12 3 4 0.9 1.0 1.0 0
0 30 2 3 0.8 1.0 0.9 0
0 24 26 28 0.7 0.8 0.7 0
0 3 2 3 0.0 1.0 1.0 0
0 6 1 2 0.0 1.0 1.0 0
0 8 2 4 0.5 1.0 1.0 0
0 4 0 3 0.0 0.0 1.0 0
0 5 2 0 0.0 1.0 0.0 0
0 7 4 5 0.0 0.0 0.0 0
0 3 5 2 0.0 0.0 0.0 0
0 1 45 2 1.0 0.0 1.0 0
0 2 60 1 1.0 0.0 1.0 0
0 4 30 3 1.0 0.0 1.0 0
0 12 80 6 0.9 0.0 0.8 0
0 2 1 0 1.0 1.0 0.0 0
2 1 1 1 1.0 1.0 1.0 0
2 6 1 8 1.0 1.0 0.0 0
2 9 6 8 0.0 1.0 0.0 0
2 40 1 60 0.0 1.0 0.0 0
2 80 60 40 0.0 0.0 0.0 0
2 12 50 0 0.0 0.0 0.0 0
2 25 30 5 0.3 0.0 0.2 0
2 3 40 2 0.0 0.0 1.0 0
2 15 0 0 0.0 0.0 0.0 0
"""


class Block(NamedTuple):
    text: str
    region: int
    words: int
    links: float


class Node(NamedTuple):
    feature: int  # -1 in a leaf
    cut: float
    low: object
    high: object
    main: bool


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> Node:
    """A decision tree by Gini impurity; the first of equally good cuts is taken."""
    main = bool(y.mean() >= 0.5) if len(y) else False
    best = None
    if depth and 0 < y.sum() < len(y):
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] < cut
                impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(cut), low)
    if best is None:
        return Node(-1, 0.0, None, None, main)
    _, f, cut, low = best
    return Node(f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1), main)


@lru_cache(maxsize=1)
def trained_tree() -> Node:
    rows = np.array([[float(v) for v in line.split()] for line in LABELLED.split("\n") if line])
    return grow(rows[:, :-1], rows[:, -1])


def is_main(tree: Node, row: tuple) -> bool:
    while tree.feature >= 0:
        tree = tree.low if row[tree.feature] < tree.cut else tree.high
    return tree.main


def _region(name: str, attributes: str, outer: int) -> int:
    if outer == IN_CHROME or name in CHROME or (name == "header" and outer != IN_ARTICLE):
        return IN_CHROME
    if attributes:
        role = ROLE.search(attributes)
        if (role and role[1].lower() in CHROME_ROLES) or HIDDEN.search(attributes):
            return IN_CHROME
        if name not in ("html", "body"):
            for m in NAMING.finditer(attributes):
                if CHROME_NAMES.search(m[1] or m[2] or m[3] or ""):
                    return IN_CHROME
        if role and role[1].lower() in ARTICLE:
            return IN_ARTICLE
    return IN_ARTICLE if name in ARTICLE else outer


def blocks(html: str) -> list[Block]:
    """Flat text blocks in page order."""
    out: list[Block] = []
    open_elements: list[tuple[str, int]] = []  # name and region inside
    pieces: list[tuple[str, bool]] = []  # text, inside a link
    links = region = at = 0

    def flush() -> None:
        if not pieces:
            return
        text = SPACES.sub(" ", unescape("".join(p for p, _ in pieces))).strip()
        if text:
            linked = unescape(" ".join(p for p, link in pieces if link)).split()
            n = len(text.split())
            out.append(Block(text, region, n, min(1.0, len(linked) / n)))
        pieces.clear()

    size = len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            pieces.append((html[at:], links > 0))
            break
        if m.start() > at:
            pieces.append((html[at : m.start()], links > 0))
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if not m[1] and name in RAW_END and name != "head":
            end = RAW_END[name].search(html, at)
            at = end.end() if end else size
            continue
        if name == "a":
            links = max(0, links + (-1 if m[1] else 1))
        elif name == "br":
            pieces.append((" ", links > 0))
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if m[1]:
            held = next((k for k in range(len(open_elements) - 1, -1, -1) if open_elements[k][0] == name), None)
            if name not in INLINE:
                flush()
            if held is not None:
                inner = region
                outer = open_elements[held - 1][1] if held else BODY
                if outer != inner:
                    flush()
                region = outer
                del open_elements[held:]
            continue
        inside = IN_CHROME if name == "head" else _region(name, m[3], region)
        if name not in INLINE or inside != region:
            flush()
        if name in ("body", "p"):  # both close what cannot hold them
            if name == "body":
                open_elements.clear()
                inside = _region(name, m[3], BODY)
        region = inside
        if not m[3].endswith("/"):
            open_elements.append((name, region))
    flush()
    return out


def main_text(html: str | None) -> str:
    found = blocks(html) if html else []
    tree, kept, last = trained_tree(), [], len(found) - 1
    for i, b in enumerate(found):
        before = found[i - 1] if i else Block("", 0, 0, 0.0)
        after = found[i + 1] if i < last else Block("", 0, 0, 0.0)
        row = (b.region, b.words, before.words, after.words, b.links, before.links, after.links)
        if is_main(tree, row):
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: ``page_id``, ``url``, ``text``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = strings([main_text(h) for h in batch["html"]])
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text})

    return pages.select("page_id", "url", "html").mapInPandas(work, "page_id long, url string, text string")
