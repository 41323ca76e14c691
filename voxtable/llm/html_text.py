"""HTML extraction by layout-aware rendering.

A tree builder reads tags with HTML's implied ends (paragraphs, list items, table parts, options) and void elements, and
gives every end tag to the nearest open element of its name. Visibility rules leave out what a browser would not show: the head,
scripts, styles, templates, ``hidden`` and ``display:none`` elements, ``visibility:hidden`` text, closed details and dialogs, fallback
content of embedded media, and all but the chosen option of a drop-down. All other text is emitted in layout: blocks on lines
of their own, blank lines around paragraphs, headings, lists, tables and quotes, list marks and numbers with indentation, preformatted
text as it stands, and table cells in columns padded to equal width (a column wider than ``WIDE`` is not padded).

Null and empty pages give an empty text. Elements nested deeper than ``DEEP`` are read as part of their ancestor; no visible text is lost, hidden text stays hidden, and
``visibility`` is then not switched on again inside of a hidden one. Columns wider than ``WIDE`` are not filled up to their width.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from voxtable.llm import rows
from voxtable.llm.registry import query

DEEP, WIDE = 150, 120
#: Element names of the HTML standard by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe object video audio canvas svg math datalist noembed noframes".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure hr".split())
BLOCKS = SPACED | frozenset("html body address article aside dd details dialog div dt fieldset figcaption footer form header hgroup legend li main nav optgroup option search section select summary tbody td tfoot th thead tr caption textarea".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
#: A start tag ends an open element of the first set, unless one of the second lies between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)), "thead": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)), "a": (("a",), ("table", "td", "th")),
    "rt": (("rt", "rp"), ("ruby",)), "rp": (("rt", "rp"), ("ruby",)), "body": (("head",), ()),
}
WALLS = frozenset("table td th caption template html".split())

# A quote opens a value only right after the equals sign; elsewhere it is a character like any other. What is read is not read again.
_VALUE = r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*+)"
_TAG = re.compile(rf"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|![^>]*>?|\?[^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?>{_VALUE}|[^>])*+)>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(\w+)", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(double or single or bare))
    return found


def parse(html: str) -> Node:
    """The element tree of a page."""
    root = Node("#root", {})
    stack = [root]
    extra: list[tuple[str, bool]] = []  # open elements that are too deep for the tree, and whether they hide what they hold
    at, size = 0, len(html)

    def text(piece: str) -> None:
        if piece and not any(hides for _, hides in extra):
            stack[-1].children.append(unescape(piece))

    def close(names: tuple[str, ...] | frozenset, walls: tuple[str, ...] | frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in walls:
                return

    while at < size:
        tag = _TAG.search(html, at)
        if tag is None:
            text(html[at:])
            break
        text(html[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            deep = [i for i, (n, _) in enumerate(extra) if n == name]
            if deep:
                del extra[deep[-1] :]
            else:
                close((name,), WALLS - {name} if name not in ("table", "body", "html") else ())
            continue
        if name in ENDS_P:
            close(("p",), ("button", *WALLS))
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name in ("td", "th", "tr", "tbody", "thead", "tfoot") and stack[-1].tag in BLOCKS and stack[-1].tag not in ("tr", "table", "tbody", "thead", "tfoot", "template"):
            close(("caption",), ("table",))
        node = Node(name, _attributes(tag[3]) if tag[3].strip() else {})
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            inner = html[at : end.start() if end else size]
            at = end.end() if end else size
            stack[-1].children.append(node)
            if name in ("textarea", "xmp"):
                node.children.append(unescape(inner) if name == "textarea" else inner)
            continue
        if len(stack) < DEEP:
            stack[-1].children.append(node)
            if name not in VOID:
                stack.append(node)
        elif name in VOID:
            if not any(hides for _, hides in extra):
                stack[-1].children.append(node)
        else:
            extra.append((name, _hidden(node) or not _seen(node, True)))
    return root


def _hidden(node: Node) -> bool:
    a = node.attributes
    if node.tag in UNSEEN or "hidden" in a or node.tag == "dialog" and "open" not in a:
        return True
    return "style" in a and bool(_NONE.search(a["style"]))


class _Lines:
    """Lines under construction: collapsed spaces inside a line, blank lines only between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.gap = False
        self.pending = ""  # a list mark that waits for its first text

    def text(self, piece: str) -> None:
        piece = _SPACE.sub(" ", piece)
        if not self.line or self.line.endswith(" "):
            piece = piece.lstrip(" ")
        if not piece:
            return
        if not self.line:
            self._open()
        self.line += piece

    def _open(self) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False

    def end(self) -> None:
        if self.line.strip(" "):
            self.lines.append(self.line.rstrip(" "))
        self.line = ""

    def blank(self) -> None:
        self.end()
        self.gap = True

    def put(self, block: list[str]) -> None:
        """Finished lines as they are."""
        self.end()
        if block:
            self._open()
            self.lines.extend(block)


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _number(text: str | None, other: int) -> int:
    found = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return int(found[1]) if found else other


def _rows_of(table: Node) -> tuple[list[Node], list[tuple[Node, int]], list[Node]]:
    """Captions, rows with the number of their section, and what lies in the table outside of rows."""
    captions, found, loose = [], [], []
    for i, child in enumerate(table.children):
        if isinstance(child, str):
            if child.strip():
                loose.append(Node("div", {}))
                loose[-1].children.append(child)
        elif _hidden(child):
            continue
        elif child.tag == "caption":
            captions.append(child)
        elif child.tag in ("tbody", "thead", "tfoot"):
            for row in child.children:
                if isinstance(row, Node) and row.tag == "tr" and not _hidden(row):
                    found.append((row, i))
                elif isinstance(row, Node) and not _hidden(row) or isinstance(row, str) and row.strip():
                    loose.append(row if isinstance(row, Node) else _wrapped(row))
        elif child.tag == "tr":
            found.append((child, -1))
        elif child.tag in ("td", "th"):
            if not found or found[-1][1] != -2:
                found.append((Node("tr", {}), -2))
            found[-1][0].children.append(child)
        else:
            loose.append(child)
    return captions, found, loose


def _wrapped(text: str) -> Node:
    node = Node("div", {})
    node.children.append(text)
    return node


def _table(table: Node, shown: bool) -> list[str]:
    """Rows of aligned cells; text outside of cells stands before the table, as browsers place it."""
    captions, found, loose = _rows_of(table)
    out = _Lines()
    for node in (*loose, *captions):
        out.put(_block(node, shown))
    grid: list[dict[int, list[str]]] = []
    taken: dict[int, int] = {}  # column -> rows that a cell above still reaches into
    section = None
    for row, part in found:
        if part != section:
            taken, section = {}, part
        cells: dict[int, list[str]] = {}
        column, fresh = 0, {}
        for cell in row.children:
            if isinstance(cell, str):
                if not cell.strip():
                    continue
                cell = _wrapped(cell)
            elif _hidden(cell):
                continue
            while taken.get(column, 0) > 0:
                column += 1
            cells[column] = _block(cell, shown)
            span, down = min(max(_number(cell.attributes.get("colspan"), 1), 1), 1000), _number(cell.attributes.get("rowspan"), 1)
            for k in range(column, column + span):
                if down != 1:
                    fresh[k] = 65534 if down == 0 else max(down, 1) - 1
            column += span
        taken = {k: v - 1 for k, v in taken.items() if v > 1} | fresh
        grid.append(cells)
    columns = sorted({c for cells in grid for c in cells})
    widths = {c: max((_width(line) for cells in grid for line in cells.get(c, ())), default=0) for c in columns}
    widths = {c: w if w <= WIDE else 0 for c, w in widths.items()}
    for cells in grid:
        height = max((len(x) for x in cells.values()), default=0)
        last = max((c for c, x in cells.items() if x), default=-1)
        for i in range(height):
            parts = []
            for c in columns:
                if c > last:
                    break
                line = cells[c][i] if c in cells and i < len(cells[c]) else ""
                parts.append(line + " " * (widths[c] - _width(line)) if c != last else line)
            line = "  ".join(parts).rstrip(" ")
            if line:
                out.put([line])
    return out.lines


def _list(node: Node, out: _Lines, shown: bool) -> None:
    ordered = node.tag == "ol"
    items = [c for c in node.children if isinstance(c, Node) and c.tag == "li" and not _hidden(c)]
    step = -1 if ordered and "reversed" in node.attributes else 1
    number = _number(node.attributes.get("start"), len(items) if step < 0 else 1)
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
            continue
        if child.tag != "li" or _hidden(child):
            _walk(child, out, shown)
            continue
        number = _number(child.attributes.get("value"), number)
        block = _block(child, shown)
        mark = f"{number}. " if ordered else "- "
        if block:
            out.put([(mark if i == 0 else " " * len(mark)) + line if line else "" for i, line in enumerate(block)])
        number += step


def _preformatted(node: Node, shown: bool) -> list[str]:
    pieces: list[str] = []

    def gather(n: Node, seen: bool) -> None:
        for c in n.children:
            if isinstance(c, str):
                if seen:
                    pieces.append(c)
            elif c.tag == "br":
                pieces.append("\n")
            elif not _hidden(c):
                gather(c, _seen(c, seen))

    gather(node, shown)
    lines = "".join(pieces).replace("\r\n", "\n").replace("\r", "\n").split("\n")
    while lines and not lines[0].strip():
        lines.pop(0)
    while lines and not lines[-1].strip():
        lines.pop()
    return [line.rstrip() for line in lines]


def _seen(node: Node, shown: bool) -> bool:
    found = _VISIBILITY.search(node.attributes["style"]) if "style" in node.attributes else None
    return shown if found is None else found[1].lower() not in ("hidden", "collapse")


def _options(node: Node) -> list[Node]:
    found = [c for c in node.children if isinstance(c, Node) and c.tag == "option"]
    return found + [o for c in node.children if isinstance(c, Node) and c.tag == "optgroup" for o in _options(c)]


def _walk(node: Node, out: _Lines, shown: bool) -> None:
    tag = node.tag
    if _hidden(node):
        return
    shown = _seen(node, shown)
    if tag == "br":
        if out.line:
            out.end()
        elif out.lines and out.lines[-1]:
            out.gap = True
        return
    edge = out.blank if tag in SPACED else out.end if tag in BLOCKS else None
    if edge:
        edge()
    if tag in ("ul", "ol", "menu"):
        _list(node, out, shown)
    elif tag == "table":
        out.put(_table(node, shown))
    elif tag in ("pre", "textarea", "xmp"):
        out.put(_preformatted(node, shown))
    elif tag in ("blockquote", "dd"):
        out.put([f"  {line}" if line else "" for line in _block_children(node, shown)])
    elif tag == "select" and "multiple" not in node.attributes and _number(node.attributes.get("size"), 1) < 2:
        options = _options(node)
        chosen = [o for o in options if "selected" in o.attributes][-1:] or options[:1]
        for o in chosen:
            _walk(o, out, shown)
    elif tag == "details" and "open" not in node.attributes:
        for c in [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]:
            _walk(c, out, shown)
    else:
        _children(node, out, shown)
    if edge:
        edge()
    elif tag in ("td", "th"):
        out.text(" ")


def _children(node: Node, out: _Lines, shown: bool) -> None:
    for c in node.children:
        if isinstance(c, str):
            if shown:
                out.text(c)
        else:
            _walk(c, out, shown)


def _block_children(node: Node, shown: bool) -> list[str]:
    inner = _Lines()
    _children(node, inner, shown)
    inner.end()
    return inner.lines


def _block(node: Node, shown: bool) -> list[str]:
    return [] if _hidden(node) else _block_children(node, _seen(node, shown))


def render(html: str) -> str:
    """The visible text of a page in its layout."""
    out = _Lines()
    _children(parse(html), out, True)
    out.end()
    return "\n".join(out.lines)


def extract_text(pages: DataFrame, name: str = "text") -> DataFrame:
    """All columns of ``pages`` but ``html``, and the rendered text; a column of that name is replaced."""
    pages = pages.drop(name)
    columns = [c for c in pages.columns if c != "html"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows.slices(batches, "html", 1 << 22):
            yield rows.with_columns(part, columns, **{name: pa.array([render(h or "") for h in part.column("html").to_pylist()], pa.string())})

    return pages.mapInArrow(work, rows.widened(pages.select(*columns), **{name: "string"}))


@query("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(rows.table(spark, sf_dir, "pages").select("page_id", "html"))
