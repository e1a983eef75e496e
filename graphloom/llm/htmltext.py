"""Main text of web pages.

A page is cut into flat blocks of text at its block-level tags.  A block is
described by its number of words and link density, those of the blocks before
and after it, and by where it stands (in an article, in a menu or the like, a
heading, a list item).  A decision tree, trained on the small table of
labelled blocks in ``LABELLED``, tells the article's blocks from the rest.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_CUE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")

#: Elements whose content is read as one raw text up to their end tag.
RAW = frozenset("script style noscript title textarea iframe".split())
#: Elements whose content is no text of the page; they end with their end tag or their parent.
UNSEEN = frozenset("template button object svg math canvas audio video".split())
#: The same for elements whose end tag may be left out; a block ends them too, so that one left open hides nothing after it.
CHOICES = frozenset("select datalist optgroup option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset head".split())
MAIN_TAGS = frozenset("article main".split())
#: Tokens of class, id and role that speak against and for the article.
BOILER_CUES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner nav navigation navbar menu breadcrumb breadcrumbs sidebar side aside footer foot masthead comment comments commentlist disqus reply replies respond discussion related recommended recommendations share sharing social cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay widget pagination pager tags toolbar search form copyright legal disclaimer complementary contentinfo dialog skip byline".split())
MAIN_CUES = frozenset("article articlebody content main post entry story body text maincontent postcontent entrycontent".split())
#: An open element of the first kind ends when one of the second kind opens.
ENDS = {"p": BLOCK - {"body", "html"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"})}
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "in_boiler", "heading", "item")
MARKS = (6, 7)  #: features from the page's marks: the tree may ask for them only below splits on words and links


@dataclass
class Block:
    text: str
    words: int
    links: float
    main: bool
    boiler: bool
    heading: bool
    item: bool


def _stand(name: str, attributes: str, within: int) -> int:
    """1 within an article, -1 within menus and the like, 0 unknown: the nearest element that tells."""
    cues: set[str] = set()
    if attributes:
        for m in _CUE.finditer(attributes):
            cues.update(_SPLIT.split(m[1].lower()))
        if _HIDDEN.search(attributes):
            return -1
    if name in BOILER_TAGS or (name not in ("body", "html") and cues & BOILER_CUES) or (name == "header" and within != 1):
        return -1
    if name in MAIN_TAGS or (name not in ("body", "html") and within != -1 and cues & MAIN_CUES):
        return 1
    return within


class _Open:
    """The open elements, and how many of each name there are, so that nothing is searched in vain."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool, bool]] = []  # name, stand, whether within UNSEEN, whether within CHOICES
        self.count: Counter[str] = Counter()

    def push(self, name: str, attributes: str) -> None:
        _, within, unseen, choice = self.stack[-1] if self.stack else ("", 0, False, False)
        self.stack.append((name, _stand(name, attributes, within), unseen or name in UNSEEN, choice or name in CHOICES))
        self.count[name] += 1

    def pop(self) -> None:
        self.count[self.stack.pop()[0]] -= 1

    def close(self, name: str) -> None:
        """End the innermost element of the name."""
        if self.count[name]:
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()

    def close_all(self, names: frozenset[str]) -> None:
        """End the outermost element of the names and all in it."""
        while any(self.count[n] for n in names):
            self.pop()


def blocks_of(page: str | None) -> list[Block]:
    """The page's blocks of text in order; linear in the length of the page."""
    if not page:
        return []
    out: list[Block] = []
    opened = _Open()
    stack = opened.stack
    pieces: list[str] = []
    linked: list[str] = []
    missing: set[str] = set()  # raw elements that have no end tag any more
    anchors = at = 0

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            chars = len(text.replace(" ", ""))
            stand = stack[-1][1] if stack else 0
            heading = any(opened.count[n] for n in HEADING)
            out.append(Block(text, text.count(" ") + 1, min(1.0, len("".join("".join(linked).split())) / chars), stand == 1, stand == -1, heading, opened.count["li"] > 0))
        pieces.clear()
        linked.clear()

    def put(text: str) -> None:
        if text and not (stack and (stack[-1][2] or stack[-1][3])):
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if anchors:
                linked.append(text)

    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if not closing and name in RAW:
            if not attributes.endswith("/"):
                end = None if name in missing else _ENDS_OF[name].search(page, at)
                if end is None:
                    missing.add(name)
                at = end.end() if end else len(page)
            put(" ")
            continue
        if name in BLOCK:
            if stack and stack[-1][3]:
                opened.close_all(CHOICES)
            flush()
        elif name == "br" or name in CHOICES or name in UNSEEN:
            put(" ")
        if name == "a":
            anchors = 0 if closing else 1
        if closing:
            opened.close(name)
        elif name not in VOID:
            while stack and name in ENDS.get(stack[-1][0], ()):
                opened.pop()
            if name in BLOCK:  # inline elements left open within a paragraph end with it
                opened.close_all(_PARAGRAPH)
            elif name in CHOICES and stack and stack[-1][3]:
                opened.close_all(CHOICES if name in ("datalist", "select") else CHOICES - {"datalist", "select"} if name == "optgroup" else frozenset({"option"}))
            if not attributes.endswith("/"):
                opened.push(name, attributes)
    flush()
    return out


_ENDS_OF = {n: re.compile(rf"</{n}[^>]*+(?:>|\Z)", re.I) for n in RAW}
_PARAGRAPH = frozenset({"p"})


def table_of(blocks: list[Block]) -> np.ndarray:
    """A row of ``FEATURES`` for each block."""
    own = np.array([[b.words, b.links] for b in blocks], float).reshape(-1, 2)
    none = np.zeros((1, 2))
    flags = np.array([[b.main, b.boiler, b.heading, b.item] for b in blocks], float).reshape(-1, 4)
    return np.hstack([own, np.vstack([none, own[:-1]])[: len(own)], np.vstack([own[1:], none])[: len(own)], flags])


class DecisionTree:
    """A small classification tree grown by Gini impurity; the first ``first`` levels may use the features before ``late`` only."""

    def __init__(self, depth: int = 9, first: int = 2, late: tuple[int, ...] = ()):
        self.depth, self.first, self.late = depth, first, late

    def fit(self, x: np.ndarray, y: np.ndarray) -> DecisionTree:
        self.root = self._grow(x, y, 0)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, level: int):
        share = float(y.mean())
        if level == self.depth or share in (0.0, 1.0):
            return share >= 0.5
        best = None
        for f in range(x.shape[1]):
            if level < self.first and f in self.late:
                continue
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], y[order]
            ones = np.cumsum(t)
            for i in np.flatnonzero(v[1:] > v[:-1]):
                n = i + 1
                p, q = ones[i] / n, (ones[-1] - ones[i]) / (len(t) - n)
                impurity = n * p * (1 - p) + (len(t) - n) * q * (1 - q)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, (v[i] + v[i + 1]) / 2)
        if best is None:
            return self._grow(x, y, self.first) if level < self.first else share >= 0.5
        _, f, cut = best
        left = x[:, f] <= cut
        return f, cut, self._grow(x[left], y[left], level + 1), self._grow(x[~left], y[~left], level + 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, tuple):
                f, cut, low, high = node
                left = x[rows, f] <= cut
                todo += [(low, rows[left]), (high, rows[~left])]
            else:
                out[rows] = node
        return out


def _labelled() -> np.ndarray:
    """The training table: ``FEATURES`` and the label (1: the article's)."""
    return np.array(LABELLED, float)


#: words, link density, those before, those after, in main, in boiler, heading, item, label
LABELLED = [
    # blocks of real pages; the label tells whether they stand in the page's article element
    (1, 1, 0, 0, 1, 1, 0, 1, 0, 1, 0), (1, 1, 1, 1, 1, 1, 0, 1, 0, 1, 0), (1, 1, 1, 1, 8, 0, 0, 1, 0, 1, 0), (8, 0, 1, 1, 10, 0, 0, 1, 0, 0, 0), (10, 0, 8, 0, 51, 0, 1, 0, 1, 0, 1), (51, 0, 10, 0, 8, 0, 1, 0, 0, 0, 1), (8, 0, 51, 0, 11, 0, 1, 0, 0, 0, 1), (11, 0, 8, 0, 36, 0, 1, 0, 0, 0, 1),
    (36, 0, 11, 0, 32, 0, 1, 0, 0, 0, 1), (32, 0, 36, 0, 52, 0, 1, 0, 0, 0, 1), (52, 0, 32, 0, 25, 0, 1, 0, 0, 0, 1), (25, 0, 52, 0, 11, 0, 1, 0, 0, 0, 1), (11, 0, 25, 0, 0, 0, 0, 1, 0, 0, 0), (9, 0, 8, 0, 12, 0, 1, 0, 1, 0, 1), (12, 0, 9, 0, 9, 0, 1, 0, 0, 0, 1), (39, 0, 9, 0, 8, 0, 1, 0, 0, 0, 1),
    (8, 0, 39, 0, 20, 0, 1, 0, 0, 0, 1), (20, 0, 8, 0, 8, 0, 1, 0, 0, 0, 1), (8, 0, 20, 0, 8, 0, 1, 0, 0, 0, 1), (8, 0, 8, 0, 0, 0, 0, 1, 0, 0, 0), (1, 1, 1, 1, 5, 0, 0, 1, 0, 1, 0), (5, 0, 1, 1, 2, 0, 0, 1, 0, 0, 0), (2, 0, 5, 0, 2, 0, 1, 0, 1, 0, 1), (2, 0, 2, 0, 11, 0, 1, 0, 0, 0, 1),
    (11, 0, 2, 0, 0, 0, 0, 1, 0, 0, 0), (11, 0, 8, 0, 17, 0, 1, 0, 1, 0, 1), (17, 0, 11, 0, 143, 0, 1, 0, 0, 0, 1), (143, 0, 17, 0, 31, 0, 1, 0, 0, 0, 1), (31, 0, 143, 0, 189, 0, 1, 0, 0, 0, 1), (189, 0, 31, 0, 43, 0, 1, 0, 0, 0, 1), (43, 0, 189, 0, 51, 0, 1, 0, 0, 0, 1), (51, 0, 43, 0, 22, 0, 1, 0, 0, 0, 1),
    (22, 0, 51, 0, 11, 0, 1, 0, 0, 0, 1), (11, 0, 22, 0, 0, 0, 0, 1, 0, 0, 0), (45, 0, 8, 0, 1, 0, 1, 0, 0, 0, 1), (1, 0, 45, 0, 30, 0, 1, 0, 0, 0, 1), (30, 0, 1, 0, 37, 0, 1, 0, 0, 0, 1), (37, 0, 30, 0, 47, 0, 1, 0, 0, 0, 1), (47, 0, 37, 0, 2, 0, 1, 0, 0, 0, 1), (2, 0, 47, 0, 1, 0, 1, 0, 0, 0, 1),
    (15, 0, 1, 0, 3, 0, 1, 0, 0, 0, 1), (3, 0, 15, 0, 8, 0, 1, 0, 0, 0, 1), (8, 0, 3, 0, 14, 0, 1, 0, 0, 0, 1), (14, 0, 8, 0, 0, 0, 0, 1, 0, 0, 0), (9, 0, 1, 1, 7, 0, 0, 1, 0, 0, 0), (7, 0, 9, 0, 968, 0, 1, 0, 1, 0, 1), (968, 0, 7, 0, 9, 0, 1, 0, 0, 0, 1), (9, 0, 968, 0, 7, 0, 1, 0, 0, 0, 1),
    (7, 0, 9, 0, 0, 0, 0, 1, 0, 0, 0), (6, 0, 4, 0, 6, 0, 1, 0, 1, 0, 1), (6, 0, 6, 0, 10, 0, 1, 0, 0, 0, 1), (12, 0, 1, 1, 11, 0, 0, 1, 0, 0, 0), (149, 0, 11, 0, 46, 0, 1, 0, 0, 0, 1), (46, 0, 149, 0, 1, 0, 1, 0, 0, 0, 1), (1, 0, 46, 0, 76, 0, 1, 0, 0, 0, 1), (9, 0, 76, 0, 0, 0, 0, 1, 0, 0, 0),
    (6, 0, 1, 1, 8, 0, 0, 1, 0, 0, 0), (8, 0, 12, 0, 3, 0, 1, 0, 0, 0, 1), (3, 0, 8, 0, 38, 0, 1, 0, 0, 0, 1), (38, 0, 3, 0, 36, 0, 1, 0, 0, 0, 1), (36, 0, 38, 0, 28, 0, 1, 0, 0, 0, 1), (28, 0, 36, 0, 6, 0, 1, 0, 0, 0, 1), (6, 0, 28, 0, 25, 0, 1, 0, 0, 0, 1), (25, 0, 6, 0, 32, 0, 1, 0, 0, 0, 1),
    (32, 0, 25, 0, 13, 0, 1, 0, 0, 0, 1), (13, 0, 32, 0, 0, 0, 0, 1, 0, 0, 0), (4, 0, 10, 0, 4, 0, 1, 0, 1, 0, 1), (4, 0, 4, 0, 47, 0, 1, 0, 0, 0, 1), (47, 0, 4, 0, 75, 0, 1, 0, 0, 0, 1), (95, 0, 43, 0, 11, 0, 1, 0, 0, 0, 1), (11, 0, 95, 0, 49, 0, 1, 0, 0, 0, 1), (15, 0, 5, 0, 0, 0, 0, 1, 0, 0, 0),
    (12, 0, 12, 0, 184, 0, 1, 0, 1, 0, 1), (11, 0, 7, 0, 37, 0, 1, 0, 1, 0, 1), (37, 0, 11, 0, 17, 0, 1, 0, 0, 0, 1), (17, 0, 37, 0, 13, 0, 1, 0, 0, 0, 1), (13, 0, 17, 0, 24, 0, 1, 0, 0, 0, 1), (24, 0, 13, 0, 61, 0, 1, 0, 0, 0, 1), (61, 0, 24, 0, 22, 0, 1, 0, 0, 0, 1), (22, 0, 61, 0, 74, 0, 1, 0, 0, 0, 1),
    (74, 0, 22, 0, 61, 0, 1, 0, 0, 0, 1), (19, 0, 88, 0, 9, 0, 1, 0, 0, 0, 1), (9, 0, 19, 0, 20, 0, 1, 0, 0, 0, 1), (13, 0, 20, 0, 0, 0, 0, 1, 0, 0, 0), (4, 0, 133, 0, 11, 0, 1, 0, 0, 0, 1), (11, 0, 4, 0, 29, 0, 1, 0, 0, 0, 1), (29, 0, 11, 0, 10, 0, 1, 0, 0, 0, 1), (10, 0, 29, 0, 14, 0, 1, 0, 0, 0, 1),
    (5, 0, 5, 0, 30, 0, 1, 0, 0, 0, 1), (30, 0, 5, 0, 31, 0, 1, 0, 0, 0, 1), (31, 0, 30, 0, 31, 0, 1, 0, 0, 0, 1), (31, 0, 31, 0, 1, 0, 1, 0, 0, 0, 1), (1, 0, 31, 0, 9, 0, 1, 0, 0, 0, 1), (113, 0, 117, 0, 30, 0, 1, 0, 0, 0, 1), (58, 0, 30, 0, 27, 0, 1, 0, 0, 0, 1), (15, 0, 27, 0, 46, 0, 1, 0, 0, 0, 1),
    (46, 0, 15, 0, 25, 0, 1, 0, 0, 0, 1), (12, 0, 25, 0, 0, 0, 0, 1, 0, 0, 0), (29, 0, 1, 0, 19, 0, 1, 0, 0, 0, 1), (19, 0, 29, 0, 8, 0, 1, 0, 0, 0, 1),
    # articles that are marked as such
    (9, 0, 4, 1, 60, 0, 1, 0, 1, 0, 1), (60, 0, 9, 0, 45, 0.05, 1, 0, 0, 0, 1), (45, 0.05, 60, 0, 3, 0, 1, 0, 0, 0, 1), (3, 0, 45, 0.05, 80, 0, 1, 0, 0, 0, 1),
    (80, 0.1, 3, 0, 1, 0, 1, 0, 0, 0, 1), (1, 0, 80, 0.1, 12, 0, 1, 0, 0, 0, 1), (12, 0, 1, 0, 6, 0, 1, 0, 0, 1, 1), (6, 0, 12, 0, 7, 0, 1, 0, 0, 1, 1),
    (1, 0, 6, 1, 8, 0, 1, 0, 0, 0, 1), (8, 0, 1, 0, 10, 0, 1, 0, 0, 0, 1), (2, 0, 2, 0, 2, 0, 1, 0, 0, 0, 1), (150, 0, 0, 0, 0, 0, 1, 0, 0, 0, 1),
    (5, 1, 80, 0, 70, 0, 1, 0, 0, 0, 1), (30, 0.4, 60, 0, 50, 0, 1, 0, 0, 0, 1), (4, 0, 90, 0, 120, 0, 1, 0, 1, 0, 1), (6, 1, 40, 0, 40, 0, 1, 0, 0, 1, 1),
    # menus, headers, footers, sidebars, notices, adverts, forms and comments that are marked as such, within the article too
    (1, 1, 0, 0, 1, 1, 0, 1, 0, 1, 0), (1, 1, 1, 1, 1, 1, 0, 1, 0, 1, 0), (2, 1, 1, 1, 9, 0, 0, 1, 0, 1, 0), (9, 0, 2, 1, 8, 0, 0, 1, 0, 0, 0),
    (8, 0, 60, 0, 0, 0, 0, 1, 0, 0, 0), (25, 0, 60, 0, 0, 0, 0, 1, 0, 0, 0), (40, 0, 80, 0, 30, 0, 0, 1, 0, 0, 0), (70, 0, 40, 0, 5, 1, 0, 1, 0, 0, 0),
    (3, 0, 80, 0, 12, 1, 0, 1, 1, 0, 0), (12, 1, 3, 0, 11, 1, 0, 1, 0, 1, 0), (20, 0.2, 90, 0, 60, 0, 0, 1, 0, 0, 0), (14, 0, 2, 0, 4, 0, 0, 1, 0, 0, 0),
    (110, 0, 90, 0, 10, 0, 0, 1, 0, 0, 0), (5, 0, 0, 0, 60, 0, 0, 1, 0, 0, 0), (2, 0, 5, 0, 3, 0, 0, 1, 0, 0, 0), (16, 0, 70, 0, 18, 0, 0, 1, 0, 1, 0),
    # marked blocks whose words and links say otherwise
    (60, 0, 4, 0, 0, 0, 0, 1, 0, 0, 0), (1, 0, 0, 0, 60, 0, 1, 0, 0, 0, 1), (90, 0, 30, 0, 0, 0, 1, 0, 0, 0, 1), (3, 0, 80, 0, 0, 0, 1, 0, 0, 0, 1), (5, 0, 1, 1, 90, 0, 0, 1, 0, 0, 0), (45, 0, 2, 1, 9, 0, 0, 1, 0, 0, 0), (12, 0, 1, 1, 60, 0, 0, 1, 0, 0, 0), (130, 0, 0, 0, 8, 0, 1, 0, 1, 0, 1),
    (2, 0, 3, 1, 40, 0, 1, 0, 0, 0, 1), (25, 0, 2, 1, 3, 0, 1, 0, 0, 0, 1), (4, 1, 20, 0, 30, 0, 1, 0, 0, 0, 1), (3, 0.7, 5, 0, 6, 0, 1, 0, 0, 1, 1), (30, 0.5, 60, 0, 10, 0, 1, 0, 0, 0, 1), (40, 0.6, 30, 0, 3, 1, 0, 1, 0, 0, 0), (8, 0, 60, 0, 6, 0, 1, 0, 1, 0, 1), (7, 0, 70, 0, 50, 0, 0, 1, 0, 0, 0),
    (33, 0, 20, 0, 70, 0, 0, 1, 0, 0, 0), (20, 0, 9, 0, 70, 0, 0, 1, 0, 0, 0), (10, 0, 90, 0, 0, 0, 1, 0, 0, 1, 1), (5, 0, 40, 0, 2, 1, 1, 0, 0, 0, 1), (14, 0, 30, 0, 4, 1, 1, 0, 0, 0, 1), (2, 0, 10, 0, 3, 1, 1, 0, 1, 0, 1), (70, 0, 10, 0, 3, 1, 0, 1, 0, 0, 0), (65, 0, 0, 0, 2, 1, 0, 1, 0, 0, 0),
    (80, 0.4, 30, 0, 2, 1, 1, 0, 0, 0, 1),
    # pages whose elements tell nothing
    (55, 0, 8, 0, 70, 0, 0, 0, 0, 0, 1), (70, 0.02, 55, 0, 48, 0, 0, 0, 0, 0, 1), (48, 0.1, 70, 0, 4, 0, 0, 0, 0, 0, 1), (4, 0, 48, 0.1, 66, 0, 0, 0, 0, 0, 1),
    (66, 0, 4, 0, 35, 0, 0, 0, 0, 0, 1), (8, 0, 2, 1, 55, 0, 0, 0, 1, 0, 1), (5, 0, 40, 0, 62, 0, 0, 0, 1, 0, 1), (14, 0, 62, 0, 22, 0, 0, 0, 0, 0, 1),
    (22, 0, 14, 0, 30, 0, 0, 0, 0, 0, 1), (18, 0, 50, 0, 16, 0, 0, 0, 0, 1, 1), (30, 0.3, 50, 0, 45, 0, 0, 0, 0, 0, 1), (90, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1),
    (26, 0, 33, 0, 3, 1, 0, 0, 0, 0, 1), (33, 0.2, 6, 0, 26, 0, 0, 0, 0, 0, 1), (11, 0, 30, 0, 41, 0, 0, 0, 0, 0, 1), (7, 0, 36, 0, 29, 0, 0, 0, 0, 0, 1),
    (24, 0, 24, 0, 1, 1, 0, 0, 0, 0, 1), (40, 0, 35, 0, 2, 1, 0, 0, 0, 0, 1), (24, 0, 3, 0, 24, 0, 0, 0, 0, 0, 1), (3, 0, 1, 1, 24, 0, 0, 0, 1, 0, 1),
    (1, 1, 0, 0, 1, 1, 0, 0, 0, 0, 0), (1, 1, 1, 1, 2, 1, 0, 0, 0, 1, 0), (2, 1, 1, 1, 1, 1, 0, 0, 0, 1, 0), (3, 1, 2, 1, 8, 0, 0, 0, 0, 0, 0),
    (2, 1, 2, 1, 9, 0, 0, 0, 0, 0, 0), (4, 0, 3, 1, 5, 1, 0, 0, 0, 0, 0), (12, 0.9, 60, 0, 10, 0.9, 0, 0, 0, 1, 0), (10, 0.9, 12, 0.9, 6, 0.8, 0, 0, 0, 1, 0),
    (6, 0.5, 3, 1, 2, 1, 0, 0, 0, 0, 0), (5, 0.2, 2, 1, 0, 0, 0, 0, 0, 0, 0), (7, 0, 4, 1, 3, 1, 0, 0, 0, 0, 0), (3, 0, 5, 0.6, 4, 0.7, 0, 0, 1, 0, 0),
    (9, 0.7, 50, 0, 8, 0.8, 0, 0, 0, 0, 0), (6, 0, 2, 1, 0, 0, 0, 0, 0, 0, 0), (25, 0.8, 40, 0, 30, 0.8, 0, 0, 0, 0, 0), (15, 1, 3, 0, 14, 1, 0, 0, 0, 1, 0),
    (2, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0), (8, 0.4, 0, 0, 0, 0, 0, 0, 0, 0, 0), (5, 1, 60, 0, 0, 0, 0, 0, 0, 0, 0), (4, 1, 30, 0, 2, 1, 0, 0, 0, 0, 0),
]


def trained_tree() -> DecisionTree:
    rows = _labelled()
    return DecisionTree(late=MARKS).fit(rows[:, :-1], rows[:, -1])


def main_text(page: str | None, tree: DecisionTree) -> str:
    """The article's blocks, joined by a line feed."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    return "\n".join(b.text for b, good in zip(blocks, tree.predict(table_of(blocks)), strict=True) if good)


def _extract(batches: Iterator[pa.RecordBatch], tree: DecisionTree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py(), tree).encode("utf-8", "replace").decode() for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of ``pages(page_id, url, html)``, one row per input row.

    Null and empty pages, and pages without an article, give an empty text.
    Rows are read one by one: repeated rows and null ids and urls pass.
    Broken markup (elements left open, a cut end) is read to its end.  Other
    columns are ignored; an empty table gives no rows.
    """
    return pages.select("page_id", "url", "html").mapInArrow(partial(_extract, tree=trained_tree()), "page_id long, url string, text string, n_chars long")
