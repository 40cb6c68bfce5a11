"""HTML extraction by layout-aware rendering.

A tree is built with the tags that HTML implies; what a browser would not show is left out; the rest is laid
out as text: blocks on lines of their own, paragraphs and headings set apart, lists with markers and indents,
preformatted text as it stands, and the cells of a table in aligned columns. Visibility is read from elements,
their attributes and inline styles; rules of style sheets are not evaluated.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript noembed noframes datalist svg math iframe object canvas audio video map link meta base param rp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table pre blockquote figure hr fieldset".split())
BLOCKS = SPACED | frozenset("address article aside body center details dd div dt figcaption footer form header hgroup html legend li listing main nav optgroup option search section summary caption tr td th thead tbody tfoot dialog".split())
CLOSES_P = (BLOCKS | frozenset(["plaintext", "xmp"])) - frozenset("html body td th tr thead tbody tfoot caption option optgroup legend".split())
#: A start tag ends open elements of these names, up to an element of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"})),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
SCOPE = frozenset(["table", "td", "th", "caption", "button", "object"])
GONE = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible|initial)", re.I)
#: A column takes no more than this width from its cells; what is wider ends its line, and later cells go on below,
#: at their columns. Calls that the layout makes for a level of nesting, at most.
COLUMN, CALLS = 40, 6
BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element. seen: whether its own text shows, by the visibility that it sets or takes from its parent."""

    __slots__ = ("tag", "attrs", "children", "seen")

    def __init__(self, tag: str, attrs: dict, seen: bool = True):
        self.tag, self.attrs, self.children = tag, attrs, []
        own = VISIBILITY.findall(attrs.get("style", ""))
        self.seen = own[-1].lower() in ("visible", "initial") if own else seen


class Tree(HTMLParser):
    """The document's elements under one root, with implied end tags."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.count: Counter[str] = Counter()
        self.depth = 1
        self.feed(text)
        self.close()

    def push(self, node: Node) -> None:
        self.open.append(node)
        self.count[node.tag] += 1
        self.depth = max(self.depth, len(self.open))

    def cut(self, k: int) -> None:
        """Close the open elements from the k-th on."""
        for n in self.open[k:]:
            self.count[n.tag] -= 1
        del self.open[k:]

    def end(self, names: set, until: set | frozenset) -> None:
        k = len(self.open) - 1
        while k > 0 and any(self.count[x] for x in names):
            if self.open[k].tag in names:
                self.cut(k)
            elif self.open[k].tag in until:
                return
            k -= 1

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag == "html":
            return
        if tag == "body" or self.open[-1].tag == "head" and tag not in HIDDEN:
            self.end({"head"}, set())
        if tag in ENDS:
            self.end(*ENDS[tag])
        if tag in CLOSES_P:
            self.end({"p"}, SCOPE)
        if tag == "a":
            self.end({"a"}, SCOPE | BLOCKS)
        node = Node(tag, attrs, self.open[-1].seen)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.push(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "path") and self.open[-1].tag == tag:
            self.cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
        elif tag == "p" and not self.count["p"]:
            self.open[-1].children.append(Node("p", {}))
        elif tag not in ("html", "body") and self.count[tag]:
            stop = {"table"} if tag in ("li", "p", "div", "span", "b", "i", "a", "ul", "ol", "dl") else set()
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    self.cut(k)
                    return
                if self.open[k].tag in stop:
                    return

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self.end({"head"}, set())
        self.open[-1].children.append(data)


def visible(node: Node) -> bool:
    a = node.attrs
    return not (node.tag in HIDDEN or "hidden" in a and a["hidden"] != "until-found" or GONE.search(a.get("style", "")) or node.tag == "dialog" and "open" not in a)


class Flow:
    """Lines of text, with blanks collapsed and margins between blocks merged."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = False
        self.gap = 0

    def text(self, data: str) -> None:
        words = BLANK.split(data)
        if len(words) > 1 and not words[0]:
            self.blank = bool(self.parts)
        for k, w in enumerate(x for x in words if x):
            if k or self.blank:
                self.parts.append(" " if self.parts else "")
            self.parts.append(w)
            self.blank = False
        if len(words) > 1 and not words[-1]:
            self.blank = bool(self.parts)

    def line(self) -> None:
        if self.parts:
            self.add(["".join(self.parts)])
        self.parts, self.blank = [], False

    def add(self, lines: list[str]) -> None:
        if self.lines and lines:
            self.lines += [""] * self.gap
        if lines:
            self.lines += lines
            self.gap = 0

    def margin(self, size: int) -> None:
        self.line()
        self.gap = max(self.gap, size)


def lay(node: Node, flow: Flow, pre: bool = False) -> None:
    for child in node.children:
        if isinstance(child, str):
            if not node.seen:
                continue
            if pre:
                first, *rest = child.replace("\r\n", "\n").split("\n")
                flow.parts.append(first)
                for line in rest:
                    flow.add(["".join(flow.parts)])
                    flow.parts = [line]
            else:
                flow.text(child)
        elif visible(child):
            element(child, flow, pre)


def element(node: Node, flow: Flow, pre: bool) -> None:
    tag = node.tag
    if tag == "br":
        if not flow.parts and flow.lines:
            flow.gap = max(flow.gap, 1)
        flow.line()
    elif tag == "input":
        if node.seen and node.attrs.get("type", "").lower() in ("submit", "reset", "button"):
            flow.text(node.attrs.get("value", ""))
    elif tag == "select":
        options = [n for n in below(node) if n.tag == "option"]
        shown = [n for n in options if "selected" in n.attrs] or ([] if "multiple" in node.attrs else options[:1])
        for n in options if "multiple" in node.attrs else shown:
            flow.text(" ")
            lay(n, flow)
            flow.text(" ")
    elif tag == "details" and "open" not in node.attrs:
        flow.margin(0)
        for n in node.children:
            if isinstance(n, Node) and n.tag == "summary" and visible(n):
                element(n, flow, pre)
        flow.margin(0)
    elif tag == "q":
        flow.text("“" if node.seen else "")
        lay(node, flow, pre)
        flow.parts.append("”" if node.seen else "")
    elif tag not in BLOCKS:
        lay(node, flow, pre)
    else:
        space = 1 if tag in SPACED else 0
        flow.margin(space)
        if tag == "hr":
            flow.add(["---"] if node.seen else [])
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.add(items(node))
        elif tag == "table":
            flow.add(rows(node))
        elif tag in ("pre", "listing", "xmp"):
            inner = Flow()
            lay(node, inner, True)
            inner.line()
            lines = inner.lines
            flow.add(lines[1:] if lines and not lines[0] else lines)
        elif tag in ("blockquote", "dd"):
            flow.add(["  " + x if x else x for x in inside(node)])
        else:
            lay(node, flow, pre)
        flow.margin(space)


def below(node: Node):
    """Elements under the node, in order."""
    stack = [c for c in reversed(node.children) if isinstance(c, Node)]
    while stack:
        n = stack.pop()
        yield n
        stack += [c for c in reversed(n.children) if isinstance(c, Node)]


def inside(node: Node) -> list[str]:
    flow = Flow()
    lay(node, flow)
    flow.line()
    return flow.lines


def _int(text: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return int(m[1]) if m else default


def items(node: Node) -> list[str]:
    out, ordered = [], node.tag == "ol"
    shown = [c for c in node.children if isinstance(c, str) and node.seen and c.strip() or isinstance(c, Node) and visible(c)]
    step = -1 if ordered and "reversed" in node.attrs else 1
    at = _int(node.attrs.get("start"), sum(isinstance(c, Node) and c.tag == "li" for c in shown) if step < 0 else 1)
    for c in shown:
        if isinstance(c, Node) and c.tag == "li":
            at = _int(c.attrs.get("value"), at)
            mark = f"{at}. " if ordered else "- "
            at += step
            lines = inside(c) or [""] * c.seen
            mark = mark if c.seen else " " * len(mark)
            out += [(mark if k == 0 else " " * len(mark) if x else "") + x for k, x in enumerate(lines)]
        elif isinstance(c, str):
            out.append(BLANK.sub(" ", c.strip()))
        else:
            wrapped = Node("div", {}, node.seen)
            wrapped.children = [c]
            out += [("  " + x if x else x) if c.tag in ("ul", "ol", "menu", "dir") else x for x in inside(wrapped)]
    return out


def rows(node: Node) -> list[str]:
    """A table's caption and rows, the cells of a column at one place; what stands outside of cells comes first."""
    before, grid, stack = [], [], [node]
    found: list[Node] = []
    loose = Node("div", {}, node.seen)

    def walk(n: Node) -> None:
        row = None
        for c in n.children:
            if isinstance(c, str):
                if n.seen and c.strip():
                    loose.children.append(c)
            elif not visible(c):
                continue
            elif c.tag == "tr":
                found.append(c)
            elif c.tag in ("thead", "tbody", "tfoot"):
                walk(c)
            elif c.tag in ("td", "th"):
                if row is None:
                    row = Node("tr", {}, n.seen)
                    found.append(row)
                row.children.append(c)
            elif c.tag == "caption":
                before.extend(inside(c))
            elif c.tag not in ("colgroup", "col"):
                loose.children.append(c)

    walk(stack.pop())
    held: dict[int, int] = {}
    for row in found:
        line: dict[int, list[str]] = {}
        at = 0
        spans = {k: v - 1 for k, v in held.items() if v > 1}
        taken = set(held)
        for c in row.children:
            if isinstance(c, str):
                if row.seen and c.strip():
                    loose.children.append(c)
                continue
            if not visible(c):
                continue
            while at in taken:
                at += 1
            line[at] = inside(c)
            across = max(1, min(_int(c.attrs.get("colspan"), 1), 1000))
            down = _int(c.attrs.get("rowspan"), 1) or len(found)  # 0: to the last row
            for k in range(at, at + across):
                if down > 1:
                    spans[k] = min(down, 65534) - 1
            at += across
        held = spans
        grid.append(line)
    width: dict[int, int] = {}
    for line in grid:
        for k, text in line.items():
            width[k] = min(COLUMN, max([width.get(k, 0), *map(columns, text)]))
    place, used = {}, 0
    for k in sorted(width):
        place[k] = used
        used += width[k] + 2
    out = before + inside(loose)
    for line in grid:
        for h in range(max((len(t) for t in line.values()), default=0)):
            text, at = "", 0
            for k in sorted(line):
                cell = line[k][h] if h < len(line[k]) else ""
                if not cell:
                    continue
                if at > place[k] or at and at == place[k]:  # a wider cell stands there
                    out.append(text.rstrip())
                    text, at = "", 0
                text += " " * (place[k] - at) + cell
                at = place[k] + columns(cell) + (1 if columns(cell) > width[k] else 0)
            if text := text.rstrip():
                out.append(text)
    return out


def columns(text: str) -> int:
    """The columns that a text takes: two for wide characters, none for combining ones."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def rendered(html: str | None) -> str:
    """All visible text of a page as lines; empty for null or for a page that shows nothing."""
    if not html:
        return ""
    tree = Tree(html.replace("\0", ""))
    usual = sys.getrecursionlimit()
    sys.setrecursionlimit(usual + CALLS * tree.depth)  # calls between Python functions take heap, not the C stack
    try:
        return "\n".join(inside(tree.root)).strip("\n")
    finally:
        sys.setrecursionlimit(usual)


def extracted(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """The input's rows with the rendered text instead of the page; null and empty pages give empty text.

    All other columns stay, nulls and repeats included; a column named as the new one is replaced.
    An empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html_col, out_col)]
    narrow = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{html_col}`").cast("string").alias(out_col))

    def run(batches):
        for batch in batches:
            texts = [rendered(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string())], names=batch.schema.names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields)
    return narrow.mapInArrow(run, schema)
