"""Layout-aware text of HTML pages.

A page is tokenised, built into a tree with the end tags and parents that HTML implies, and
rendered: all visible text, blocks on lines of their own with blank lines between
paragraphs, list items with bullets or numbers and indented by depth, table cells in
aligned columns, preformatted text as it is, the shown option of a list, the text elements of
a drawing on lines of their own.  Hidden are ``script``, ``style``, ``head``
and the like, the ``hidden`` attribute, ``aria-hidden="true"``, and inline ``display:none`` or
``visibility:hidden``.

Cases: a null page gives a null text, an empty one an empty text; broken markup is text or
closed where HTML would; nesting beyond any depth is handled without recursion; repeated
rows are rendered alike; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RESULT = "page_id bigint, title string, text string, n_blocks int"

# HTML's element kinds; names are fixed values
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style head template noscript title iframe object datalist audio video canvas annotation annotation-xml mphantom".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Parts of a drawing that are not drawn where they stand.
UNDRAWN = frozenset("defs symbol desc metadata clippath mask pattern marker".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr".split())
BLOCK = PARAGRAPH | frozenset(
    "html body address article aside div footer header main nav section form fieldset li dt dd tr caption thead tbody tfoot details summary figcaption center dialog".split()
)
TABLE_PARTS = frozenset("caption colgroup thead tbody tfoot tr td th".split())
CLOSES_P = BLOCK - {"html", "body", "li", "dt", "dd", "tr", "caption", "thead", "tbody", "tfoot", "figcaption", "summary"}
#: An opening tag ends these open elements, unless one of the second set stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: An end tag does not look for its element beyond these.
FENCES = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "p": {"table", "td", "th"}}

# a quote opens a value right after "=" only; elsewhere it belongs to a name or to a value without quotes
ATTRIBUTES = r"(?>[ \t\n\r\f/]+|[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\r\f>\"'][^ \t\n\r\f>]*+)?+)?+)*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|</([A-Za-z][^ \t\n\r\f/>]*+){ATTRIBUTES}(?:>|\Z)|<([A-Za-z][^ \t\n\r\f/>]*+)({ATTRIBUTES})(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(
    r"([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\r\f>\"'][^ \t\n\r\f>]*+))?+)?+"
)
INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)

    @property
    def hidden(self) -> bool:
        a = self.attributes
        return (
            self.name in HIDDEN
            or "hidden" in a
            or a.get("aria-hidden", "").strip().lower() == "true"
            or bool(INVISIBLE.search(a.get("style", "")))
            or (self.name == "input" and a.get("type", "").lower() == "hidden")
        )


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(double or single or bare))
    return out


class Builder:
    """Open elements and the tree below ``root``."""

    def __init__(self) -> None:
        self.root = Node("#root")
        self.open = [self.root]
        #: how many of each name are open, so that end tags without a start cost nothing
        self.count: dict[str, int] = {}

    def text(self, text: str) -> None:
        if text:
            self.open[-1].children.append(text)

    def _close_to(self, size: int) -> None:
        while len(self.open) > size:
            self.count[self.open.pop().name] -= 1

    def _end(self, names, fences) -> None:
        if not any(self.count.get(n) for n in names):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in fences:
                return
            if self.open[i].name in names:
                # all of the kind up to the fence are ended, as a row ends with its cell
                j = i
                while j > 1 and self.open[j - 1].name in names:
                    j -= 1
                self._close_to(j)
                return

    def start(self, name: str, attributes: dict[str, str], closed: bool) -> None:
        if name in ("html", "body") and self.count.get(name):
            return
        if name not in ("html", "head", "meta", "link", "title", "script", "style", "base", "template", "noscript") and self.count.get("head"):
            self._end({"head"}, set())
        if name in CLOSES_P:
            self._end({"p"}, {"table", "td", "th", "button", "caption"})
        if name in ENDS:
            self._end(*ENDS[name])
        if re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", self.open[-1].name):
            self._close_to(len(self.open) - 1)
        if name in ("td", "th") and self.count.get("table") and not self.open[-1].name == "tr":
            self.start("tr", {}, False)
        node = Node(name, attributes)
        self.open[-1].children.append(node)
        if name not in VOID and not closed:
            self.open.append(node)
            self.count[name] = self.count.get(name, 0) + 1

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", {}, True)
        elif name == "p" and not self.count.get("p"):
            self.start("p", {}, True)
        elif self.count.get(name):
            fences = FENCES.get(name, set())
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].name == name:
                    self._close_to(i)
                    return
                if self.open[i].name in fences:
                    return


def parse(source: str) -> Node:
    builder, at = Builder(), 0
    while at < len(source):
        found = TOKEN.search(source, at)
        if found is None:
            builder.text(html.unescape(source[at:]))
            break
        builder.text(html.unescape(source[at : found.start()]))
        at = found.end()
        if found[1]:
            builder.end(found[1].lower())
        elif found[2]:
            name = found[2].lower()
            closed = (found[3] or "").rstrip().endswith("/") and name not in BLOCK and name not in RAW
            builder.start(name, _attributes(found[3] or ""), closed)
            if name in RAW and not closed:
                stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
                body = source[at : stop.start() if stop else len(source)]
                builder.text(html.unescape(body) if name in ("title", "textarea") else body)
                at = stop.start() if stop else len(source)
        elif found[0].startswith("<![CDATA["):
            builder.text(found[0][9:-3] if found[0].endswith("]]>") else found[0][9:])
    return builder.root


def width(text: str) -> int:
    """Columns of a monospaced font."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Renderer:
    """Lines of text; ``gap`` is what must stand between the last and the next: 0 nothing, 1 a line end, 2 a blank line."""

    def __init__(self, indent: int = 0):
        self.lines: list[str] = []
        self.line = ""
        self.space = False
        self.gap = 0
        self.indent = indent
        self.marker = ""
        self.blocks = 0

    def flush(self) -> None:
        if self.line or self.marker:
            lead = " " * max(self.indent - width(self.marker), 0) + self.marker
            self.lines.append((lead + self.line).rstrip())
            self.line, self.marker = "", ""
        self.space = False

    def need(self, gap: int) -> None:
        # a marker waits for the first text of its item
        if self.line:
            self.flush()
        self.space = False
        self.gap = max(self.gap, gap)

    def _ready(self) -> None:
        if self.gap and not self.line:
            self.blocks += 1
            if self.gap == 2 and self.lines and not self.marker:
                self.lines.append("")
            self.gap = 0

    def words(self, text: str) -> None:
        plain = BLANKS.sub(" ", text)
        body = plain.strip(" ")
        if not body:
            self.space |= bool(plain)
            return
        self._ready()
        if self.line and (self.space or plain[0] == " "):
            self.line += " "
        self.line += body
        self.space = plain[-1] == " "

    def verbatim(self, text: str) -> None:
        self._ready()
        parts = text.split("\n")
        self.line += parts[0]
        for part in parts[1:]:
            self.lines.append((" " * self.indent + self.line).rstrip())
            self.line = part

    def line_break(self) -> None:
        if self.line or self.marker:
            self.flush()
        elif self.lines and self.gap == 0:
            self.lines.append("")

    def result(self) -> str:
        self.flush()
        return re.sub(r"\n{3,}", "\n\n", "\n".join(self.lines)).strip("\n")


def _rows(table: Node) -> tuple[list[Node], list[list[Node]]]:
    """Captions and rows of a table; what is in no cell makes a row of its own."""
    captions: list[Node] = []
    rows: list[list[Node]] = []
    stack = [iter(table.children)]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif isinstance(child, str):
            if child.strip():
                rows.append([Node("td", {}, [child])])
        elif child.hidden:
            continue
        elif child.name == "caption":
            captions.append(child)
        elif child.name in ("thead", "tbody", "tfoot", "colgroup"):
            stack.append(iter(child.children))
        elif child.name == "tr":
            cells = [c for c in child.children if not isinstance(c, str) or c.strip()]
            cells = [c if isinstance(c, Node) and c.name in ("td", "th") else Node("td", {}, [c]) for c in cells]
            rows.append([c for c in cells if not c.hidden])
        else:
            rows.append([Node("td", {}, [child])])
    return captions, rows


def _span(cell: Node) -> int:
    found = re.match(r"\s*(\d{1,4})", cell.attributes.get("colspan", ""))
    return min(max(int(found[1]), 1), 1000) if found else 1


def _aligned(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Cells of a column start at the same place; a spanning cell does not widen its columns."""
    widths: dict[int, int] = {}
    for row in rows:
        at = 0
        for text, span in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), max((width(x) for x in text.split("\n")), default=0))
            at += span
    out = []
    for row in rows:
        cells = [text.split("\n") for text, _ in row]
        for i in range(max((len(c) for c in cells), default=0)):
            line, at = "", 0
            for (_, span), cell in zip(row, cells):
                part = cell[i] if i < len(cell) else ""
                room = sum(widths.get(at + s, 0) for s in range(span)) + 2 * (span - 1)
                line += part + " " * (max(room - width(part), 0) + 2)
                at += span
            out.append(line.rstrip())
    return out


def render(root: Node) -> tuple[str, int]:
    """Text and number of blocks.  A stack of frames instead of recursion: a table is rendered after its cells."""
    page = Renderer()
    stack: list[tuple] = [("visit", root, page, False, 0)]
    while stack:
        kind, *rest = stack.pop()
        if kind == "call":
            rest[0]()
            continue
        node, out, pre, depth = rest
        if isinstance(node, str):
            out.verbatim(node) if pre else out.words(node)
            continue
        if node.hidden:
            continue
        name = node.name
        if name == "br":
            out.line_break()
        elif name == "hr":
            out.need(2)
        elif name == "img":
            out.words(node.attributes.get("alt", ""))
        elif name == "table":
            _table(node, out, depth, stack)
        elif name == "select":
            stack.extend(("visit", shown, out, False, depth) for shown in reversed(_options(node)))
        elif name == "svg":
            stack.extend(("visit", shown, out, False, depth) for shown in reversed(_drawn(node)))
        elif name in BLOCK:
            gap = 2 if name in PARAGRAPH and not (name in ("ul", "ol") and depth) else 1
            stack.append(("call", _closer(out, gap, name)))
            out.need(gap)
            inner_depth = depth + (name in ("ul", "ol"))
            if name in ("ul", "ol", "blockquote", "dd"):
                out.indent += 2 if name != "ol" else 4
            _push(node, out, pre or name == "pre", inner_depth, stack)
        else:
            _push(node, out, pre or name == "textarea", depth, stack)
    return page.result(), page.blocks


def _options(node: Node) -> list[Node]:
    """What a list shows: the last selected option or else the first that is not disabled; all on lines of their own if it is open."""
    size = re.match(r"\s*(\d{1,9})", node.attributes.get("size", ""))
    opened = "multiple" in node.attributes or (size is not None and int(size[1]) > 1)
    shown, first, selected = [], None, None
    stack = [(child, False) for child in reversed(node.children)]
    while stack:
        child, disabled = stack.pop()
        if isinstance(child, str) or (opened and child.hidden):
            continue
        disabled = disabled or "disabled" in child.attributes
        label = child.attributes.get("label", "")
        if child.name == "option":
            content = [label] if label else child.children
            shown.append(Node("div", {}, content))
            first = Node("span", {}, content) if first is None and not disabled else first
            selected = Node("span", {}, content) if "selected" in child.attributes else selected
        else:
            if child.name == "optgroup" and label:
                shown.append(Node("div", {}, [label]))
            stack.extend((c, disabled) for c in reversed(child.children))
    return shown if opened else [n for n in (selected or first,) if n is not None]


def _drawn(node: Node) -> list[Node]:
    """The text elements of a drawing, each a block; other text in it is not drawn."""
    shown, stack = [], list(reversed(node.children))
    while stack:
        child = stack.pop()
        if isinstance(child, str) or child.hidden or child.name in UNDRAWN:
            continue
        a = child.attributes
        if a.get("display", "").strip() == "none" or a.get("visibility", "").strip() in ("hidden", "collapse"):
            continue
        if child.name in ("text", "foreignobject"):
            shown.append(Node("div", {}, child.children))
        else:
            stack.extend(reversed(child.children))
    return shown


def _closer(out: Renderer, gap: int, name: str):
    def close() -> None:
        out.need(gap)
        out.marker = ""
        if name in ("ul", "ol", "blockquote", "dd"):
            out.indent -= 2 if name != "ol" else 4

    return close


def _push(node: Node, out: Renderer, pre: bool, depth: int, stack: list) -> None:
    number = 1
    if node.name == "ol":
        found = re.match(r"\s*(-?\d{1,9})", node.attributes.get("start", ""))
        number = int(found[1]) if found else 1
    frames = []
    for child in node.children:
        if isinstance(child, Node) and child.name == "li" and not child.hidden:
            marker = f"{number}. " if node.name == "ol" else "- "
            number += 1
            frames.append(("call", _marker(out, marker)))
        frames.append(("visit", child, out, pre, depth))
    stack.extend(reversed(frames))


def _marker(out: Renderer, marker: str):
    def mark() -> None:
        out.need(1)
        out._ready()
        out.marker = marker

    return mark


def _table(node: Node, out: Renderer, depth: int, stack: list) -> None:
    captions, rows = _rows(node)
    out.need(2)
    parts = [[(Renderer(), cell) for cell in row] for row in rows]

    def finish() -> None:
        filled = [[(r.result(), _span(cell)) for r, cell in row] for row in parts]
        for line in _aligned([row for row in filled if any(text for text, _ in row)]):
            out._ready()
            out.lines.append((" " * out.indent + line).rstrip())
        out.gap = 2

    stack.append(("call", finish))
    for row in reversed(parts):
        for renderer, cell in reversed(row):
            stack.append(("visit", Node("cell", {}, cell.children), renderer, False, 0))
    for caption in reversed(captions):
        stack.append(("visit", caption, out, False, depth))


def title_of(root: Node) -> str:
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            continue
        if node.name == "title":
            return BLANKS.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        if node.name != "svg":  # its titles are those of its parts
            stack.extend(reversed(node.children))
    return ""


def extract(source: str | None) -> tuple[str | None, str | None, int]:
    if source is None:
        return None, None, 0
    root = parse(source)
    text, blocks = render(root)
    return title_of(root), text, blocks


def texts(pages: DataFrame) -> DataFrame:
    """Title, visible text and number of blocks of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                found = [extract(source.as_py()) for source in rows.column("html")]
                titles, bodies, blocks = zip(*found)
                columns = [pa.array(titles, pa.string()), pa.array(bodies, pa.string()), pa.array(np.array(blocks, np.int32))]
                yield pa.RecordBatch.from_arrays([rows.column("page_id").cast(pa.int64()), *columns], names=["page_id", "title", "text", "n_blocks"])

    return pages.select("page_id", "html").mapInArrow(run, RESULT)
