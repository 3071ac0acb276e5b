"""HTML extraction by layout: a tree with implied tags, visibility rules, and a renderer for all visible text.

The standard library's tokenizer feeds a tree builder that opens and closes what HTML leaves out (paragraphs before
blocks, list items, table rows and cells, table sections). Invisible are head, script, style, template, noscript and the
like, the ``hidden`` attribute, hidden inputs, closed dialogs, and ``display:none`` or ``visibility:hidden`` in a style
attribute; drawings and formulas show their text, but not their definitions and annotations. The renderer collapses white space as a browser does, separates blocks by line
feeds (paragraphs, headings, lists and tables by an empty line), marks list items with "- " or their number and
indents nested lists, keeps preformatted text, and pads table cells so that columns line up.

Every page is rendered alone, in Arrow batches; nothing is shuffled. Building and rendering use no recursion, so depth is no limit.

Defined results: a null page gives null, an empty one an empty text; broken markup is read as far as it goes and text is never
dropped for it; repeated rows give repeated rows; other columns are not carried over; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import pieces

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript iframe object audio video canvas datalist noframes".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split())  # an empty line around
BLOCK = APART | frozenset("address article aside body details dialog dd div dt fieldset figcaption footer form header html legend li main menu nav section summary tr caption optgroup option center".split())
CLOSES_P = (BLOCK - {"li", "dt", "dd", "tr", "caption", "option", "optgroup", "body", "html", "legend"}) | {"li", "dt", "dd"}
# A start tag closes these open elements, unless one of the walls is met first.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"table"}), "th": ({"td", "th", "caption"}, {"table"}), "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    **{t: ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
}
# All else, and text, ends an open head.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
# Parts of drawings and formulas that aren't shown.
UNSEEN = {"svg": frozenset("defs desc metadata symbol clippath mask marker pattern".split()), "math": frozenset("annotation annotation-xml".split())}
SPACES = re.compile(r"[ \t\n\r\f]+")
INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!\s*important\s*)?(?:;|$)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Feeds a page into a tree. The stack holds the open elements, ``count`` how many of each tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.stack = [self.root]
        self.count: dict[str, int] = {}

    def _pop(self) -> None:
        self.count[self.stack.pop().tag] -= 1

    def _close(self, tags: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> None:
        """Close open elements down to the outermost of ``tags`` that lies above any wall."""
        if not any(self.count.get(t) for t in tags):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[at].tag
            if tag in walls:
                break
            if tag in tags:
                while len(self.stack) > at:
                    self._pop()

    def _open(self, tag: str, attrs: dict[str, str | None]) -> None:
        node = Node(tag, attrs)
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, {"table", "td", "th", "button", "caption"})
        if tag in IMPLIED_END:
            self._close(*IMPLIED_END[tag])
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._open("tr", {})
        if tag not in IN_HEAD:
            self._end_head()
        unseen = any(self.count.get(t) and tag in UNSEEN[t] for t in UNSEEN)
        self._open(tag, dict(attrs) | {"hidden": None} if unseen else dict(attrs))

    def _end_head(self) -> None:
        while self.stack[-1].tag == "head":
            self._pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        # "/>" closes nothing in HTML but void elements; in drawings and formulas it closes all.
        if (tag in UNSEEN or any(self.count.get(t) for t in UNSEEN)) and self.stack[-1].tag == tag:
            self._pop()

    def handle_endtag(self, tag):
        if self.count.get(tag):
            walls = set() if tag in ("table", "html", "body") else {"table"} if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else {"td", "th", "caption"}
            for at in range(len(self.stack) - 1, 0, -1):
                if self.stack[at].tag == tag:
                    while len(self.stack) > at:
                        self._pop()
                    return
                if self.stack[at].tag in walls:
                    return

    def handle_data(self, data):
        if self.stack[-1].tag == "head" and data.strip(" \t\n\r\f"):
            self._end_head()
        self.stack[-1].children.append(data)


def visible(node: Node) -> bool:
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and (a.get("type") or "").lower() == "hidden"):
        return False
    return not ("style" in a and INVISIBLE.search(a["style"] or ""))


class Page:
    """Text under construction: owed line feeds and spaces are written when text follows."""

    def __init__(self):
        self.parts: list[str] = []
        self.feeds, self.space, self.indent, self.marker = 0, False, "", ""

    def apart(self, feeds: int) -> None:
        self.space = False
        if self.parts:
            self.feeds = max(self.feeds, feeds)

    def feed(self) -> None:
        self.space = False
        if self.parts:
            self.feeds = min(self.feeds + 1, 2)

    def _begin(self) -> None:
        fresh = not self.parts or self.feeds
        if self.feeds:
            self.parts.append("\n" * self.feeds)
            self.feeds = 0
        if fresh or self.marker:
            self.parts.append(self.indent[:-2] + self.marker if self.marker else self.indent)
            self.marker, self.space = "", False

    def say(self, text: str) -> None:
        words = SPACES.sub(" ", text)
        if not words:
            return
        if words[0] == " ":
            self.space, words = True, words[1:]
        if not words:
            return
        ends = words[-1] == " "
        fresh = not self.parts or bool(self.feeds) or bool(self.marker)
        self._begin()
        if self.space and not fresh:
            self.parts.append(" ")
        self.parts.append(words[:-1] if ends else words)
        self.space = ends

    def raw(self, text: str) -> None:
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.parts.append("\n" + self.indent)
            if line:
                self._begin()
                self.parts.append(line)

    def text(self) -> str:
        return "".join(self.parts)


def aligned(rows: list[list[str]]) -> list[str]:
    """Lines of a table: cells padded to the width of their column, two spaces between."""
    widths: list[int] = []
    for row in rows:
        for i, cell in enumerate(row):
            if i == len(widths):
                widths.append(0)
            widths[i] = max(widths[i], len(cell))
    return ["  ".join(cell.ljust(w) for cell, w in zip(row, widths)).rstrip() for row in rows]


def render(root: Node) -> str:
    page, outer = Page(), Page()  # ``outer`` waits while a table cell is rendered
    rows: list[list[str]] = []
    tables = pre = 0
    lists: list[list] = []  # [ordered, next number]
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            if pre:
                page.raw(node)
            else:
                page.say(node)
            continue
        tag = node.tag
        cell = tag in ("td", "th") and tables == 1  # tables inside a cell read on in that cell
        if not leaving:
            if not visible(node):
                continue
            todo.append((node, True))
            todo += [(c, False) for c in reversed(node.children)]
            if tag == "br":
                page.feed()
            elif tag == "table":
                tables += 1
                if tables == 1:
                    page.apart(2)
                    rows = []
            elif tag == "tr" and tables:
                if tables == 1:
                    rows.append([])
            elif cell:
                outer, page = page, Page()
            elif tag in ("td", "th", "text"):  # text: a label of a drawing
                page.say(" ")
            elif tag in ("ul", "ol", "menu"):
                page.apart(1 if lists else 2)
                start = node.attrs.get("start") or "1"
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start, re.A) else 1])
                page.indent += "  "
            elif tag == "li":
                page.apart(1)
                page.marker = f"{lists[-1][1]}. " if lists and lists[-1][0] else "- "
                if lists:
                    lists[-1][1] += 1
            elif tag in BLOCK:
                page.apart(2 if tag in APART else 1)
            pre += tag == "pre"
            continue
        if tag == "table":
            tables -= 1
            if not tables:
                for line in aligned([r for r in rows if any(r)]):
                    page.apart(1)
                    page.raw(line)
                page.apart(2)
        elif cell:
            text, page = SPACES.sub(" ", page.text()).strip(), outer
            if not rows:
                rows.append([])
            rows[-1].append(text)
        elif tag in ("td", "th", "text"):
            page.say(" ")
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
            page.indent = page.indent[:-2]
            page.apart(1 if lists else 2)
        elif tag == "li":
            page.marker = ""
            page.apart(1)
        elif tag in BLOCK and not (tag == "tr" and tables):
            page.apart(2 if tag in APART else 1)
        pre -= tag == "pre"
    return page.text()


def extract(html: str) -> str:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return render(builder.root)


def visible_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key`` and ``text``, the visible text of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            texts = [None if h is None else extract(h) for h in piece.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array(texts, pa.string())], names=[key, "text"])

    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(run, f"`{key}` {kind}, text string")
