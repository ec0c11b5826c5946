"""Visible text of web pages, laid out as a reader would see it.

A page is parsed into a tree with the tags that HTML implies, hidden subtrees are
left out, and the rest is written block by block: blank lines around paragraphs
and headings, markers and indents for lists, columns for tables, white space as
it stands in preformatted blocks. Both passes keep their own stacks, so depth is
not limited by recursion.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: kinds of elements and implied end tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes xmp".split())
HIDDEN = frozenset("head script style noscript template iframe noembed noframes audio video canvas object datalist param".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACED = HEADINGS | frozenset("p ul ol dl pre blockquote table figure fieldset menu".split())
BLOCKS = SPACED | frozenset("html body address article aside center details dialog dd dir div dt fieldset figcaption footer form header hgroup hr legend li main nav section summary option optgroup select textarea caption tr td th thead tbody tfoot".split())
STOPS_P = BLOCKS - {"p"}
CLOSES_P = (BLOCKS - frozenset("html body option optgroup select textarea caption tr td th thead tbody tfoot legend".split()))
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DECLARED = {name: re.compile(rf"(?:^|;)\s*{name}\s*:\s*([a-z-]+)[^;!]*(!\s*important)?") for name in ("display", "visibility")}
#: Values that a declaration may have; one with another value does not count.
_VALUES = {
    "display": frozenset("none block inline inline-block flex inline-flex grid inline-grid flow-root contents list-item run-in ruby math table inline-table table-row table-cell table-caption table-column table-column-group table-row-group table-header-group table-footer-group inherit initial unset revert revert-layer".split()),
    "visibility": frozenset("visible hidden collapse".split()),
}
_INSIDE_TABLE = frozenset("table thead tbody tfoot tr colgroup".split())
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW | {"title", "textarea"}}
_SPACE = re.compile(r"[ \t\n\r\f\xa0]+")
#: Column width up to which cells are padded; wider cells run over.
MAX_PAD = 60


def declared(style: str, name: str) -> str | None:
    """The value that a style attribute gives a property: the last one, but an important one before all others."""
    last = strong = None
    for m in _DECLARED[name].finditer(style.lower()):
        if m[1] in _VALUES[name]:
            last, strong = (last, m[1]) if m[2] else (m[1], strong)
    return strong or last


class Node:
    __slots__ = ("tag", "attrs", "children", "lines", "shown")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, above: Node | None = None) -> None:
        self.tag, self.attrs, self.children, self.lines = tag, attrs or {}, [], None
        self.shown = above is None or above.shown
        self.see()

    def see(self) -> None:
        """Take the visibility from the style, which a descendant may turn back."""
        value = declared(self.attrs["style"], "visibility") if "style" in self.attrs else None
        self.shown = self.shown if value is None else value == "visible"


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip("/> \t\n\r") else {}


def parse(html: str) -> tuple[Node, list[Node]]:
    """The tree of a page, and its tables in the order in which they begin."""
    root, tables = Node("html"), []
    stack, at = [root], 0
    final = html.rfind(">") + 1  # what stands after the last tag is text

    def close(tags: set[str], stop: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in stop:
                break
            if stack[k].tag in tags:
                del stack[k:]
                return close(tags, stop)
        return None

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        stack.append(node)

    def text(part: str) -> None:
        if not part:
            return
        part = unescape(part) if "&" in part else part
        if stack[-1].tag == "head" and part.strip(" \t\n\r\f"):
            stack.pop()  # words open the body
        into = stack[-1].children
        if stack[-1].tag in _INSIDE_TABLE and part.strip(" \t\n\r\f"):
            # Words that are in no cell stand before the table, which is the last child of what it is in.
            table = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "table"), None)
            if table is not None:
                stack[table - 1].children.insert(-1, part)
                return
        into.append(part)

    for m in iter(lambda: _TOKEN.search(html, at, max(at, final)), None):
        text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            stop = {"table"} if tag not in BLOCKS and tag != "table" else {"table"} - {tag}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in stop or (tag not in BLOCKS and stack[k].tag in BLOCKS):
                    break
            continue
        if tag in ("html", "body"):
            root.attrs |= _attributes(m[3][:-1])
            root.see()
            if stack[-1].tag == "head":
                stack.pop()
            continue
        if stack[-1].tag == "head" and tag not in ("title", "meta", "link", "base", "script", "style", "noscript", "template"):
            stack.pop()
        if tag in CLOSES_P:
            close({"p"}, STOPS_P)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.pop()
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            push(Node("tr", above=stack[-1]))
        node = Node(tag, _attributes(m[3][:-1]), stack[-1])
        if tag in VOID:
            stack[-1].children.append(node)
            continue
        if tag == "table":
            tables.append(node)
        if tag in RAW or tag in ("title", "textarea"):
            ending = _RAW_ENDS[tag].search(html, at)
            end = ending.start() if ending else len(html)
            stack[-1].children.append(node)
            if tag not in RAW:
                node.children.append(unescape(html[at:end]))
            close_at = html.find(">", end)
            at = len(html) if close_at < 0 else close_at + 1
            continue
        push(node)
        if tag == "pre" and html.startswith("\n", at):
            at += 1
    text(html[at:])
    return root, tables


def hidden(node: Node) -> bool:
    """Whether an element and all in it take no part in the layout."""
    attrs = node.attrs
    return node.tag in HIDDEN or "hidden" in attrs or ("style" in attrs and declared(attrs["style"], "display") == "none") or (node.tag == "dialog" and "open" not in attrs) or (node.tag == "input" and attrs.get("type", "").lower() not in ("submit", "button", "reset"))


class Page:
    """Lines of text with pending breaks and the indents of open lists and quotes."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.indents: list[str] = []
        self.marker = ""

    def words(self, text: str) -> None:
        flat = _SPACE.sub(" ", text)
        body = flat.strip(" ")
        if not body:
            self.space |= bool(flat)
            return
        if self.line and (self.space or flat[0] == " "):
            self.line.append(" ")
        self.line.append(body)
        self.space = flat[-1] == " "

    def end_line(self) -> None:
        if self.line:
            self._emit("".join(self.line))
            self.line = []
        self.space = False

    def _emit(self, text: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        if self.marker:
            lead, self.marker = "".join(self.indents[:-1]) + self.marker, ""
        else:
            lead = "".join(self.indents)
        self.lines.append((lead + text).rstrip())

    def raw(self, lines: list[str]) -> None:
        """Lines as they stand; empty ones are kept."""
        self.end_line()
        for text in lines:
            self._emit(text)

    def gap(self) -> None:
        self.end_line()
        self.blank = True


def _span(cell: Node, name: str, most: int) -> int:
    """A cell's number of columns or rows, at most what the standard allows."""
    value = cell.attrs.get(name, "1").strip()
    return min(int(value), most) if value.isascii() and value.isdigit() and len(value) < 9 else 1


def _table_lines(table: Node) -> list[str]:
    """Rows of cells as lines with aligned columns; a cell of several lines takes as many.

    A cell keeps its columns free for as many rows as it spans.
    """
    rows: list[dict[int, list[str]]] = []
    before: list[list[str]] = []
    pending = [table]
    order: list[Node] = []
    while pending:
        node = pending.pop()
        if node is not table and (node.tag in ("tr", "caption") or node.tag not in ("thead", "tbody", "tfoot")):
            order.append(node)
            continue
        pending.extend(c for c in reversed(node.children) if not isinstance(c, str) and not hidden(c))
    taken: dict[int, int] = {}  # column: rows below this one in which it is taken
    for node in order:
        if node.tag != "tr":
            before.append(render(node, inner=True))
            continue
        cells: dict[int, list[str]] = {}
        column, mine = 0, {}
        for cell in node.children:
            if isinstance(cell, str) or hidden(cell):
                continue
            while taken.get(column):
                column += 1
            cells[column] = render(cell, inner=True)
            down = _span(cell, "rowspan", 65_534) or len(order)  # zero: to the end of the table
            for _ in range(max(1, _span(cell, "colspan", 1000))):
                if down > 1:
                    mine[column] = down
                column += 1
        taken = {k: n - 1 for k, n in (taken | mine).items() if n > 1}
        rows.append(cells)
    # Columns that no cell begins in are left out.
    used = sorted({k for cells in rows for k in cells})
    widths = {k: max(min(MAX_PAD, max(map(len, cells.get(k, ())), default=0)) for cells in rows) for k in used}
    out = [line for lines in before for line in lines]
    for cells in rows:
        for k in range(max(map(len, cells.values()), default=0)):
            out.append("  ".join((cells[c][k] if c in cells and k < len(cells[c]) else "").ljust(widths[c]) for c in used).rstrip())
    return out


def render(top: Node, inner: bool = False) -> list[str]:
    """Lines of what is visible in a tree; tables inside it must have theirs already."""
    page, lists, pre = Page(), [], 0
    work: list[tuple[object, bool]] = [(c, False) for c in reversed(top.children) if top.shown or not isinstance(c, str)] if inner else [(top, False)]
    while work:
        node, done = work.pop()
        if isinstance(node, str):
            if pre:
                parts = node.split("\n")
                for k, part in enumerate(parts):
                    if k:
                        page._emit("".join(page.line))
                        page.line = []
                    if part:
                        page.line.append(part)
            else:
                page.words(node)
            continue
        tag = node.tag
        if done:
            if tag == "pre":
                pre -= 1
            if tag in ("ul", "ol", "menu", "dir") and lists:
                lists.pop()
            if tag in ("li", "dd", "blockquote"):
                page.end_line()
                page.marker = ""
                page.indents.pop()
            if tag in ("ul", "ol", "menu", "dir") and lists:
                page.end_line()
            elif tag in SPACED:
                page.gap()
            elif tag in BLOCKS:
                page.end_line()
            elif tag == "q" and node.shown:
                page.words('"')
            continue
        if hidden(node):
            continue
        if tag == "br":
            if page.line or page.marker:
                page.end_line()
            else:
                page.blank = True
            continue
        if tag == "hr":
            page.end_line()
            page.raw(["----"] * node.shown)
            continue
        if tag == "input":
            page.words(f" {node.attrs.get('value', '') if node.shown else ''} ")
            continue
        if tag in ("title", "desc", "defs") and node is not top:
            continue
        if node.lines is not None:
            page.gap()
            page.raw(node.lines)
            page.gap()
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            page.end_line() if lists else page.gap()
            start = node.attrs.get("start", "1")
            lists.append([int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1] if tag == "ol" else None)
        elif tag == "li":
            page.end_line()
            own = lists[-1] if lists else None
            mark = "- "
            if own:
                value = node.attrs.get("value", "")
                own[0] = int(value) if re.fullmatch(r"-?\d{1,9}", value) else own[0]
                mark = f"{own[0]}. "
                own[0] += 1
            page.indents.append(" " * len(mark))
            page.marker = mark if node.shown else ""
        elif tag in ("dd", "blockquote"):
            page.gap() if tag == "blockquote" else page.end_line()
            page.indents.append("    ")
        elif tag == "q" and node.shown:
            page.words('"')
        elif tag in SPACED:
            page.gap()
        elif tag in BLOCKS:
            page.end_line()
        if tag == "pre":
            pre += 1
        work.append((node, True))
        inside = node.children
        if tag == "details" and "open" not in node.attrs:
            inside = [c for c in inside if not isinstance(c, str) and c.tag == "summary"][:1]
        work.extend((c, False) for c in reversed(inside) if node.shown or not isinstance(c, str))
    page.end_line()
    return page.lines


def visible_text(html: str | None) -> str:
    """The text of a page as it is laid out; empty for null and for pages that show nothing."""
    if not html:
        return ""
    root, tables = parse(html)
    for table in reversed(tables):  # inner tables begin after the ones around them
        table.lines = _table_lines(table)
    return "\n".join(render(root))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_lines, n_chars) of every row.

    A null or empty page gives an empty text; repeated rows give a row each; an
    empty table gives none; other columns are ignored. Visibility is that of elements
    and of their own style attributes; the rules of style sheets are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [visible_text(x.as_py()) for x in part.column(1)]
                lines = [len(t.split("\n")) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "text", "n_lines", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, text string, n_lines long, n_chars long")
