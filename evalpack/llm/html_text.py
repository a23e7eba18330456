"""Visible text of HTML pages, laid out.

A page is read tag by tag into a tree: end tags that HTML lets one leave out
are implied, void and raw-text elements are known, and stray end tags are
passed over. Elements that are never shown, or are hidden by an attribute, an
inline style or a simple rule of a style element, are left out. The rest is
written as a browser would lay it out: white space collapses outside
preformatted text, blocks stand on lines of their own, paragraphs and headings
have a blank line around them, list items have bullets or numbers and are
indented, and the cells of a table are padded to aligned columns.

The work is a map over pages; nothing is shuffled.

Defined results: a null or empty page has an empty text; broken markup is read
to the end, an unclosed tag or comment as text or to the end of the page;
repeated rows are each extracted; elements nested deeper than ``DEPTH`` are read
as children of the last one within it (their text stays); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_batch, columns, read

DEPTH = 200

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style template noscript title iframe object audio video canvas svg datalist "
                  "noembed noframes select textarea dialog".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
                  "search section summary table tbody tfoot thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
#: A start tag ends these open elements, up to the nearest of the fences.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
_HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile("[\"'>]")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))(?![\w-])", re.I)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SIMPLE = re.compile(r"[.#]?[A-Za-z_][\w-]*")
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []


def _tag_end(page: str, at: int) -> int:
    """Place of the ``>`` that ends the tag opened before ``at``, or -1; quoted ones don't count."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end())
        at = close + 1 if close >= 0 else m.end()
    return -1


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), html.unescape((m[2] or "").strip("\"'")))
    return out


def parse(page: str) -> tuple[Node, list[str]]:
    """The page's tree and the texts of its style elements."""
    root = Node("#root", {})
    stack, styles, at, size = [root], [], 0, len(page)

    def close(names: set[str], fences: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                return close(names, fences)
            if stack[i].name in fences:
                return None

    def text(raw: str) -> None:
        if raw:
            if stack[-1].name == "head" and raw.strip():
                stack.pop()
            stack[-1].children.append(html.unescape(raw))

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = _NAME.match(page, lt + 1)
        if not m:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                text(page[at:lt])
                at = end + 3 if end >= 0 else size
            elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                text(page[at:lt])
                at = end + 1 if end >= 0 else size
            else:
                text(page[at : lt + 1])
                at = lt + 1
            continue
        end = _tag_end(page, m.end())
        if end < 0:
            text(page[at:])
            break
        text(page[at:lt])
        at, name = end + 1, m[0].lower()
        if name[0] == "/":
            name = name[1:]
            fence = {"table"} if name in ("tr", "td", "th", "li", "p") else set()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if stack[i].name in fence:
                    break
            continue
        if stack[-1].name == "head" and name not in _HEAD_ONLY:
            stack.pop()
        if name in _CLOSES:
            close(*_CLOSES[name])
        if name in BLOCK:
            close({"p"}, {"table", "td", "th", "button", "caption"})
        node = Node(name, _attributes(page[m.end() : end]) if end > m.end() else {})
        stack[-1].children.append(node)
        if name in RAW:
            over = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            inside = page[at : over.start() if over else size]
            if name == "style":
                styles.append(inside)
            node.children.append(inside if name in ("script", "style") else html.unescape(inside))
            at = size if not over else (_tag_end(page, over.end()) + 1 or size)
        elif name not in VOID and len(stack) < DEPTH:
            stack.append(node)
    return root, styles


def hidden_by_rules(styles: list[str]) -> frozenset[str]:
    """Simple selectors (tag, .class, #id) that style elements hide."""
    return frozenset(s.strip() for css in styles for sel, body in _RULE.findall(re.sub(r"/\*.*?\*/", "", css, flags=re.S))
                     if _HIDE.search(body) for s in sel.split(",") if _SIMPLE.fullmatch(s.strip()))


def visible(node: Node, rules: frozenset[str]) -> bool:
    a = node.attrs
    if node.name in NEVER and not (node.name == "dialog" and "open" in a):
        return False
    if "hidden" in a or _HIDE.search(a.get("style", "")):
        return False
    return not rules or not (node.name in rules or f"#{a.get('id')}" in rules
                             or any(f".{c}" in rules for c in a.get("class", "").split()))


def width(text: str) -> int:
    """Columns that a text takes in a fixed-width font."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Layout:
    """Lines of laid-out text."""

    def __init__(self, rules: frozenset[str]):
        self.rules, self.lines, self.line, self.gap = rules, [], "", False

    def newline(self) -> None:
        """Ends the line; an empty one is not begun anew."""
        if self.line.strip():
            if self.gap and self.lines:
                self.lines.append("")
            self.lines.append(self.line.rstrip())
            self.gap = False
        self.line = ""

    def space(self) -> None:
        self.newline()
        self.gap = True

    def text(self, raw: str, pre: bool) -> None:
        if pre:
            first, *rest = raw.replace("\r\n", "\n").split("\n")
            self.line += first
            for part in rest:
                if self.gap and self.lines:
                    self.lines.append("")
                self.gap = False
                self.lines.append(self.line.rstrip())
                self.line = part
            return
        part = _BLANKS.sub(" ", raw)
        if part.startswith(" ") and (not self.line or self.line.endswith(" ")):
            part = part[1:]
        self.line += part

    def child(self, node: Node, pre: bool) -> list[str]:
        """The lines of a node laid out by itself."""
        own = Layout(self.rules)
        own.nodes(node.children, pre)
        own.newline()
        return own.lines

    def nodes(self, children: list, pre: bool) -> None:
        for x in children:
            if isinstance(x, str):
                self.text(x, pre)
            elif visible(x, self.rules):
                self.node(x, pre)

    def node(self, x: Node, pre: bool) -> None:
        if x.name == "br":
            if pre or self.line.strip():
                self.lines += [""] if self.gap and self.lines else []
                self.gap = False
                self.lines.append(self.line.rstrip())
                self.line = ""
        elif x.name == "wbr":
            pass
        elif x.name == "img":
            self.text(x.attrs.get("alt", ""), False)
        elif x.name == "input":
            if x.attrs.get("type", "text").lower() in ("submit", "button", "reset"):
                self.text(x.attrs.get("value", ""), False)
        elif x.name in ("ul", "ol", "menu", "dir"):
            self.list(x, pre)
        elif x.name == "table":
            self.table(x)
        elif x.name == "q":
            self.line += '"'
            self.nodes(x.children, pre)
            self.line += '"'
        elif x.name in BLOCK:
            edge = self.space if x.name in SPACED else self.newline
            edge()
            if x.name in ("blockquote", "dd"):
                for line in self.child(x, pre):
                    self.put("    " + line if line else "")
            else:
                self.nodes(x.children, pre or x.name == "pre")
            edge()
        else:
            self.nodes(x.children, pre)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)

    def list(self, x: Node, pre: bool) -> None:
        self.space()
        start = x.attrs.get("start", "")
        n = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        for item in x.children:
            if isinstance(item, str):
                self.text(item, pre)
            elif visible(item, self.rules):
                if item.name != "li":
                    self.node(item, pre)
                    continue
                self.newline()
                mark = f"{n}. " if x.name == "ol" else "* "
                n += 1
                for i, line in enumerate(self.child(item, pre) or [""]):
                    self.put(((mark if not i else " " * len(mark)) + line).rstrip())
        self.space()

    def table(self, x: Node) -> None:
        """Rows of cells; a cell spans columns but no rows. Columns are as wide as their widest line."""
        self.space()
        rows: list[list[tuple[int, list[str]]]] = []

        def collect(node: Node) -> None:
            loose = False
            for c in node.children:
                if isinstance(c, str):
                    if c.strip():
                        self.text(c, False)
                elif not visible(c, self.rules):
                    continue
                elif c.name == "tr":
                    rows.append([])
                    for cell in c.children:
                        if isinstance(cell, str) or cell.name not in ("td", "th"):
                            if isinstance(cell, str):
                                self.text(cell, False)
                            elif visible(cell, self.rules):
                                self.node(cell, False)
                        elif visible(cell, self.rules):
                            rows[-1].append((self._span(cell), self.child(cell, False)))
                    loose = False
                elif c.name in ("td", "th"):
                    if not loose:
                        rows.append([])
                    loose = True
                    rows[-1].append((self._span(c), self.child(c, False)))
                elif c.name in ("thead", "tbody", "tfoot"):
                    collect(c)
                elif c.name not in ("col", "colgroup"):
                    self.node(c, False)  # a caption, or what does not belong into a table

        collect(x)
        self.newline()
        wide: list[int] = []
        for row in rows:
            at = 0
            for span, lines in row:
                wide += [0] * (at + 1 - len(wide))
                if span == 1:
                    wide[at] = max([wide[at], *map(width, lines)])
                at += span
        for row in rows:
            for i in range(max((len(lines) for _, lines in row), default=0)):
                out, at = "", 0
                for span, lines in row:
                    cell = lines[i] if i < len(lines) else ""
                    own = wide[at : at + span]
                    room = sum(own) + 2 * (max(1, len(own)) - 1)
                    out += cell + " " * max(0, room - width(cell)) + "  "
                    at += span
                self.put(out.rstrip())
        self.space()

    @staticmethod
    def _span(cell: Node) -> int:
        span = cell.attrs.get("colspan", "")
        return max(1, min(1000, int(span))) if re.fullmatch(r"\d{1,4}", span) else 1


def render(page: str | None) -> str:
    """The visible text of a page."""
    root, styles = parse(page or "")
    out = Layout(hidden_by_rules(styles))
    out.nodes(root.children, False)
    out.newline()
    return "\n".join(out.lines).replace(" ", " ")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text of each row of ``pages`` (page_id, html)."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([render(x.as_py()) for x in batch.column(1)], pa.string())], ["page_id", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return by_batch(columns(pages, "page_id", "html"), work, f"page_id {kind}, text string")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return extract(read(spark, sf_dir, "pages"))
