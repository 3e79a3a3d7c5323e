"""Layout-aware HTML to text.

A small tree builder closes implied tags and drops what isn't shown (head,
scripts, comments, hidden elements, suggestions of a datalist, annotations of
formulas, definitions and descriptions of drawings, and what noscript, frames,
audio, video and canvas have only for browsers without them). Formulas, text of
drawings and forms and the fallback of objects are shown; of a select all
options are. A renderer emits all visible text with
blank lines between blocks, list markers, kept line breaks in ``pre`` and table
cells aligned in columns, also those of several lines or rows. ``aria-hidden``
speaks to screen readers only, so such text is shown.

Null html gives null text; empty html gives an empty text; an empty table gives
no rows; repeated rows are rendered each. Columns besides page_id and html are
ignored. What is nested deeper than ``DEPTH`` is drawn by its ancestor at that
depth (browsers do the same), but still hidden and closed by its own elements.
Scanning takes time in proportion to a page's length.
"""

from __future__ import annotations

import html as entities
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of browsers and of the HTML standard: depth of a tree, widest cell, tallest cell.
DEPTH, COLUMNS, ROWS = 512, 1000, 65534
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes datalist audio video canvas annotation annotation-xml".split())
#: Not drawn where they stand in an svg.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption tr td th tbody thead tfoot".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table article section figure".split())
#: A start tag closes an open element of the second column, looked for up to one of the third.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "body": (("head",), ()),
}
#: A quote opens a value only after "="; what is left open runs to the end. Possessive, so nothing is read twice.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*"[^"]*+(?:"|\Z)|=\s*'[^']*+(?:'|\Z)|[^>])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
HIDING = re.compile(r"(?i)\b(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))")
SPACES = re.compile(r"[ \t\n\r\f\v]+")


class Node:
    __slots__ = ("tag", "attributes", "inner", "unseen")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.inner, self.unseen = tag, attributes, [], False


class Open:
    """Open elements, with how many there are of each tag."""

    def __init__(self, root: Node):
        self.nodes, self.count = [root], Counter()

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.count[node.tag] += 1

    def cut(self, at: int) -> None:
        for gone in self.nodes[at:]:
            self.count[gone.tag] -= 1
        del self.nodes[at:]

    def add(self, what: Node | str) -> None:
        if not self.nodes[-1].unseen:
            self.nodes[min(len(self.nodes), DEPTH) - 1].inner.append(what)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t") else {}


def parse(page: str) -> Node:
    root = Node("html", {})
    opened, at, end = Open(root), 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            opened.add(entities.unescape(text))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            _close(opened, tag)
            continue
        _imply(opened, tag)
        node = Node(tag, _attributes(m[3]))
        if tag in UNDRAWN and opened.count["svg"]:
            node.attributes["hidden"] = ""
        node.unseen = opened.nodes[-1].unseen or not visible(node)
        if not node.unseen:
            opened.add(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            body = page[at : close.start() if close else end]
            node.inner.append(entities.unescape(body) if tag in ("title", "textarea") else body)
            at = close.end() if close else end
        elif tag not in VOID:
            opened.push(node)
    return root


def _close(opened: Open, tag: str) -> None:
    if not opened.count[tag]:
        return
    for i in range(len(opened.nodes) - 1, 0, -1):
        its = opened.nodes[i].tag
        if its == tag:
            opened.cut(i)
            return
        if its in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
            return


def _imply(opened: Open, tag: str) -> None:
    if tag in BLOCK and opened.count["p"]:
        for i in range(len(opened.nodes) - 1, 0, -1):
            its = opened.nodes[i].tag
            if its == "p":
                opened.cut(i)
                break
            if its in ("td", "th", "table", "li", "button", "object", "div", "article", "section", "body"):
                break
    if tag in CLOSES:
        shut, until = CLOSES[tag]
        if not any(opened.count[s] for s in shut):
            return
        lowest = None
        for i in range(len(opened.nodes) - 1, 0, -1):
            if opened.nodes[i].tag in until:
                break
            if opened.nodes[i].tag in shut:
                lowest = i
        if lowest is not None:
            opened.cut(lowest)


def visible(node: Node) -> bool:
    a = node.attributes
    if node.tag in UNSEEN:
        return False
    return not a or not ("hidden" in a and a["hidden"].lower() != "until-found" or node.tag == "input" or HIDING.search(a.get("style", "")))


class Page:
    """Lines of text with pending spaces and blank lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.now, self.gap, self.space, self.indent = "", 0, False, ""
        self.marked = False  # the line has only a list marker, which the item's first block joins

    def words(self, text: str) -> None:
        pieces = SPACES.split(text)
        if len(pieces) == 1:
            self._put(text)
            return
        self._put(pieces[0])
        for p in pieces[1:]:
            self.space = True
            self._put(p)

    def _put(self, word: str) -> None:
        if word:
            self._open()
            if self.space and self.now and not self.now.endswith((" ", "\t")):
                self.now += " "
            self.now += word
            self.space = self.marked = False

    def _open(self) -> None:
        if not self.now:
            if self.lines and self.gap > 1:
                self.lines.append("")
            self.gap, self.now = 0, self.indent
            self.space = False

    def mark(self, marker: str) -> None:
        self.line(1)
        self._open()
        self.now += marker
        self.marked = True

    def unmark(self) -> None:
        self.marked = False
        self.line(1)

    def line(self, gap: int) -> None:
        if self.marked:
            return
        if self.now:
            self.lines.append(self.now.rstrip())
            self.now = ""
        self.space = False
        self.gap = max(self.gap, gap)

    def verbatim(self, text: str) -> None:
        first, *rest = text.expandtabs(8).split("\n")
        self._open()
        self.now += first
        self.marked = False
        for r in rest:
            self.lines.append(self.now.rstrip())
            self.now = self.indent + r

    def text(self) -> str:
        self.marked = False
        self.line(0)
        return "\n".join(self.lines).strip("\n")


def _render(node: Node, page: Page, pre: bool) -> None:
    tag = node.tag
    if tag == "br":
        page._open()
        page.lines.append(page.now.rstrip())
        page.now, page.marked = "", False
        return
    if tag == "hr":
        page.line(2)
        return
    if tag == "img":
        page.words(" " + node.attributes.get("alt", "") + " ")
        return
    if tag == "table":
        _table(node, page, pre)
        return
    if tag in ("textarea", "option", "optgroup"):
        page.line(1)
        if tag == "optgroup":
            page.words(node.attributes.get("label", ""))
            page.line(1)
    elif tag == "text":
        page.space = True
    block, was = tag in BLOCK, page.indent
    if block:
        page.line(2 if tag in SPACED else 1)
    if tag in ("ul", "ol", "menu", "dir", "dl") and was is not None:
        _list(node, page, pre)
    else:
        if tag in ("blockquote", "dd"):
            page.indent += "  "
        inner_pre = pre or tag in ("pre", "textarea")
        for x in node.inner:
            if isinstance(x, str):
                page.verbatim(x.lstrip("\n") if tag in ("pre", "textarea") and x is node.inner[0] else x) if inner_pre else page.words(x)
            elif visible(x):
                _render(x, page, inner_pre)
    page.indent = was
    if tag in ("textarea", "option", "optgroup"):
        page.line(1)
    elif tag == "text":
        page.space = True
    if block:
        page.line(2 if tag in SPACED else 1)


def _list(node: Node, page: Page, pre: bool) -> None:
    was, number = page.indent, 0
    start = node.attributes.get("start", "1")
    number = int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start) else 0
    for x in node.inner:
        if isinstance(x, str):
            if x.strip():
                page.words(x)
        elif visible(x):
            if x.tag == "li":
                number += 1
                page.marked = False
                marker = f"{number}. " if node.tag == "ol" else "- "
                page.mark(marker)
                page.indent = was + " " * len(marker)
                for y in x.inner:
                    if isinstance(y, str):
                        page.verbatim(y) if pre else page.words(y)
                    elif visible(y):
                        _render(y, page, pre)
                page.unmark()
                page.indent = was
            else:
                _render(x, page, pre)
    page.indent = was


def _width(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text) if not text.isascii() else len(text)


def _padded(text: str, wide: int) -> str:
    return text + " " * (wide - _width(text))


def _cell(node: Node, pre: bool) -> list[str]:
    inner = Page()
    for x in node.inner:
        if isinstance(x, str):
            inner.verbatim(x) if pre else inner.words(x)
        elif visible(x):
            _render(x, inner, pre)
    return inner.text().split("\n")


def _span(node: Node, name: str, most: int) -> int:
    raw = node.attributes.get(name, "1").strip()
    return min(most, int(raw[:9])) if raw.isascii() and raw.isdigit() else 1


class Grid:
    """Rows of cells, each a list of lines. A cell of several rows keeps its columns free below; rowspan 0 reaches to the end of the row group."""

    def __init__(self):
        self.rows: list[list[list[str]]] = []
        self.below: dict[int, int] = {}

    def group(self) -> None:
        self.below.clear()

    def row(self, cells: list[tuple[list[str], int, int]]) -> None:
        row: list[list[str]] = []
        taken, self.below = self.below, {c: n - 1 for c, n in self.below.items() if n > 1}
        for lines, wide, tall in cells:
            while len(row) in taken:
                row.append([""])
            for c in range(len(row), len(row) + wide) if tall > 1 else ():
                self.below[c] = tall - 1
            row += [lines, *([""] for _ in range(wide - 1))]
        self.rows.append(row)

    def draw(self, page: Page) -> None:
        wide = [0] * max(map(len, self.rows), default=0)
        for r in self.rows:
            for j, lines in enumerate(r):
                wide[j] = max(wide[j], *map(_width, lines))
        for r in self.rows:
            for k in range(max(map(len, r), default=0)):
                line = "  ".join(_padded(c[k] if k < len(c) else "", wide[j]) for j, c in enumerate(r)).rstrip()
                if line:
                    page._open()
                    page.now += line
                    page.marked = False
                    page.line(1)


def _table(node: Node, page: Page, pre: bool) -> None:
    grid = Grid()
    page.line(2)
    todo = list(reversed(node.inner))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                page.words(x)
        elif not visible(x):
            continue
        elif x.tag in ("tbody", "thead", "tfoot", "colgroup", "form"):
            grid.group()
            todo.extend(reversed(x.inner))
        elif x.tag == "tr":
            cells = []
            for y in x.inner:
                if isinstance(y, str):
                    if y.strip():
                        cells.append(([" ".join(y.split())], 1, 1))
                elif visible(y):
                    cells.append((_cell(y, pre), max(1, _span(y, "colspan", COLUMNS)), _span(y, "rowspan", ROWS) or ROWS))
            grid.row(cells)
        elif x.tag in ("td", "th"):
            grid.row([(_cell(x, pre), 1, 1)])
        else:
            _render(x, page, pre)
            page.line(1)
    page.line(1)
    grid.draw(page)
    page.line(2)


def render(page: str) -> str:
    out = Page()
    if sys.getrecursionlimit() < 16 * DEPTH:
        sys.setrecursionlimit(16 * DEPTH)
    _render(parse(page), out, False)
    return out.text()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_words of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [render(p) if isinstance(p, str) else None for p in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "text": pd.Series(texts, index=frame.index, dtype=object), "n_words": [len(t.split()) if t else 0 for t in texts]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string, n_words long")
