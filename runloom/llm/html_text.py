"""Main text of web pages by minimum cut.

A page is a row of blocks of text.  A classifier of tags, class names, link density and length gives every block a
cost of being called boilerplate and one of being called content: the capacities of its edges to the two terminals.
Blocks that follow one another, and blocks of the same parent, are joined by edges that are stronger the nearer they are in the
document tree.  The minimum cut labels the blocks; the content side is the text.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Tags whose content is never text of the page.
HIDDEN = frozenset(
    "head script style noscript template iframe object svg math canvas audio video select button textarea option datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Inline tags; every other tag begins and ends a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr img br".split())
#: A start tag that ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p "
    "pre section table ul".split())
#: Tags that end an open element of their own kind, and where the search for it stops.
SIBLING = {
    "li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}),
    "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}),
}

#: Weights of the classifier, in log-odds of being content.
TAG_WEIGHT = {
    "article": 4.0, "main": 4.0, "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "dialog": -9.0, "menu": -6.0, "header": -3.0,
    "blockquote": 0.5, "pre": 0.5, "address": -1.0,
}
LEAF_WEIGHT = {"p": 1.0, "h1": 1.5, "h2": 0.8, "h3": 0.8, "h4": 0.5, "h5": 0.5, "h6": 0.5, "li": -0.3, "td": 0.0, "figcaption": 0.3, "pre": 0.8}
BAD_NAME, GOOD_NAME = -9.0, 3.0
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense adbox banner sponsor sponsored promo promotion promoted sidebar side menu nav navbar navigation "
    "navigator topbar toolbar breadcrumb breadcrumbs footer foot header masthead notice notices cookie cookies consent gdpr alert popup modal overlay "
    "newsletter subscribe signup login search share sharing social related recommended recommendations comment comments respond reply replies disqus "
    "discussion widget pager pagination copyright legal disclaimer skip form".split())
GOOD_NAMES = frozenset("article content main post entry body story text".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
GOOD_ROLES = frozenset("main article".split())
LINK_WEIGHT, LENGTH_WEIGHT, BIAS = -5.0, 0.35, -0.8
#: Strength of an edge between neighbours with the same parent; it falls with the steps between them in the tree.
SMOOTH = 0.8
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class _Blocks(HTMLParser):
    """Blocks in page order: text, characters in links, the tag that holds it, the path and the weight of its ancestors."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, float, bool]] = [("", 0, 0.0, False)]  # tag, number, weight, hidden
        self.numbers = 0
        self.links = 0
        self.text: list[str] = []
        self.linked = 0
        self.found: list[tuple[str, int, str, tuple[int, ...], float]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            block = [o for o in self.open if o[0] not in INLINE]
            self.found.append((text, self.linked, block[-1][0], tuple(o[1] for o in block), self.open[-1][2]))
        self.text, self.linked = [], 0

    def pop(self, at: int) -> None:
        if any(o[0] not in INLINE for o in self.open[at:]):
            self.flush()
        self.links -= sum(o[0] == "a" for o in self.open[at:])
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body":  # ends a head that was left open
            self.close_tag("head", set())
        if tag in ENDS_P:
            self.close_tag("p", {"button", "td", "th", "li", "div", "article", "section"})
        if tag in SIBLING:
            kinds, stop = SIBLING[tag]
            for kind in kinds.split():
                self.close_tag(kind, stop)
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            if tag not in INLINE:
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
        _, _, weight, hidden = self.open[-1]
        self.numbers += 1
        named = self.weight_of(tag, attrs)
        if tag == "body":
            named = 0.0
        off = any(k == "hidden" or (k == "aria-hidden" and v == "true") or (
            k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v or "", re.I)) for k, v in attrs)
        self.open.append((tag, self.numbers, weight + named, hidden or off or tag in HIDDEN))
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an HTML element

    @staticmethod
    def weight_of(tag: str, attrs: list[tuple[str, str | None]]) -> float:
        weight = TAG_WEIGHT.get(tag, 0.0)
        names: set[str] = set()
        for key, value in attrs:
            if key in ("class", "id") and value:
                names.update(n.lower() for n in _NAME.findall(value))
            elif key == "role" and value:
                weight += BAD_NAME * (value.lower() in BAD_ROLES) + GOOD_NAME * (value.lower() in GOOD_ROLES)
        if names & BAD_NAMES:
            return weight + BAD_NAME
        return weight + GOOD_NAME * bool(names & GOOD_NAMES)

    def close_tag(self, tag: str, stop: set[str]) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                return self.pop(at)
            if self.open[at][0] in stop:
                return None
        return None

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.text.append(" ")
        elif tag in INLINE:  # does not reach over the block that it is in
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at][0] == tag:
                    return self.pop(at) if at == len(self.open) - 1 else self.unwrap(at)
                if self.open[at][0] not in INLINE:
                    return None
        elif tag == "p" and not any(o[0] == "p" for o in self.open):
            self.flush()
        else:
            self.close_tag(tag, set())
        return None

    def unwrap(self, at: int) -> None:
        """End a misnested inline element; those opened inside it stay open."""
        self.links -= self.open[at][0] == "a"
        del self.open[at]

    def handle_data(self, data: str) -> None:
        if not self.open[-1][3]:
            self.text.append(data)
            if self.links > 0:
                self.linked += len("".join(data.split()))


def blocks(html: str) -> list[tuple[str, int, str, tuple[int, ...], float]]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.found


def odds(block: tuple[str, int, str, tuple[int, ...], float]) -> float:
    """Log-odds that the block is content."""
    text, linked, tag, _, weight = block
    letters = max(1, len(text) - text.count(" "))
    length = min(10, letters.bit_length())
    return weight + LEAF_WEIGHT.get(tag, 0.0) + LINK_WEIGHT * min(1.0, linked / letters) + LENGTH_WEIGHT * length + BIAS


def _apart(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    """Steps between the parents of two blocks in the document tree."""
    a, b = a[:-1], b[:-1]
    same = 0
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    return len(a) + len(b) - 2 * same


def edges(found: list[tuple[str, int, str, tuple[int, ...], float]]) -> list[tuple[int, int, float]]:
    """Neighbours in page order, and each block with the next one of the same parent."""
    out = [(i, i + 1, SMOOTH / (1 + _apart(found[i][3], found[i + 1][3])) ** 2) for i in range(len(found) - 1)]
    last: dict[tuple[int, ...], int] = {}
    for i, block in enumerate(found):
        parent = block[3][:-1]
        if parent in last and last[parent] != i - 1:
            out.append((last[parent], i, SMOOTH / 2))
        last[parent] = i
    return out


def min_cut(unary: list[float], pairs: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side.  A node with positive ``unary`` is tied to the source by it, else to the sink.

    Dinic's algorithm.  Nodes that the source cannot reach after the last flow are on the sink's side.
    """
    n = len(unary)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, u in enumerate(unary):
        if u > 0:
            link(source, i, u, 0.0)
        elif u < 0:
            link(i, sink, -u, 0.0)
    for a, b, w in pairs:
        link(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        way: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in way)
                for e in way:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(way) if room[e] <= tiny)
                a = to[way[cut] ^ 1]
                del way[cut:]
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                way.append(out[a][at[a]])
                a = to[way[-1]]
            elif way:
                a = to[way.pop() ^ 1]
                at[a] += 1
            else:
                break


def main_text(html: str | None) -> tuple[str, int, int]:
    """The text, and how many blocks it has of how many."""
    found = blocks(html) if html else []
    if not found:
        return "", 0, 0
    keep = min_cut([odds(b) for b in found], edges(found))
    kept = [b[0] for b, k in zip(found, keep) if k]
    return " ".join(kept), len(kept), len(found)


def extract(pages: DataFrame) -> DataFrame:
    """One row for each page: ``page_id, url, text, n_chars, n_kept, n_blocks``.

    A null or empty page, and one without content, has an empty text.  Pages are worked on one by one, so that repeated rows give
    equal rows; extra columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [main_text(h if isinstance(h, str) else None) for h in batch["html"]]
            yield pd.DataFrame({
                "page_id": batch["page_id"], "url": batch["url"], "text": [d[0] for d in done], "n_chars": [len(d[0]) for d in done],
                "n_kept": [d[1] for d in done], "n_blocks": [d[2] for d in done]})

    return pages.select("page_id", "url", "html").mapInPandas(
        run, "page_id long, url string, text string, n_chars long, n_kept long, n_blocks long")
