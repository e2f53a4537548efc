"""All visible text of HTML pages, laid out as lines.

A tree builder closes elements that HTML closes by implication; a renderer walks the
tree, leaves out what is never shown, sets blocks apart, numbers and indents lists and
aligns the cells of tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlabel.llm.common import text_or_empty

# Kinds of elements, as the HTML standard groups them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head script style template noscript title iframe object canvas audio video "
    "datalist noembed noframes rp".split()
)
#: Kinds of input whose value is shown.
SHOWN_INPUTS = frozenset("button email number reset search submit tel text url".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre section summary table ul".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
CLOSES_P = BLOCKS - frozenset("body dd dt html legend li".split())
TABLE_PARTS = frozenset("caption colgroup tbody td tfoot th thead tr".split())
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
}
# Drawings show the text of their text elements, and HTML in a foreignObject.
SVG_UNSEEN = frozenset("defs symbol clippath mask pattern marker metadata desc lineargradient radialgradient filter".split())
MATH_UNSEEN = frozenset("annotation annotation-xml mphantom".split())
#: Formulas place the parts of these apart.
MATH_APART = frozenset(
    "mfrac msub msup msubsup munder mover munderover mroot mmultiscripts mtable mtr mlabeledtr".split()
)
MATH_TOKENS = frozenset("mi mo mn ms mtext annotation-xml".split())
#: HTML that ends a drawing or formula it stands in.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li "
    "listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
MOVED = re.compile(r"(?:^|\s)(?:x|y|dy)\s*=", re.I)
BARE_SLASH = re.compile(r"=\s*[^\s\"'>]*/\Z")
BARRIERS = frozenset("table td th caption html template".split())

TAG = re.compile(
    r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)"
    r"|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDING = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
HINTS = re.compile(r"hidden|open|type|style|colspan|rowspan|start|value|alt|display|visibility|select|multiple|size|label|disabled|systemlanguage", re.I)


class Node:
    """``space`` is what the element belongs to and ``inside`` what its children do: "svg",
    "text" (of a drawing), "math", or "" for HTML. ``moved``: placed apart from what precedes."""

    __slots__ = ("tag", "attributes", "children", "space", "inside", "moved")

    def __init__(self, tag: str, attributes: dict[str, str], space: str = ""):
        self.tag, self.attributes, self.space = tag, attributes, space
        self.inside, self.moved = _inside(tag, space), False
        self.children: list[Node | str] = []


def _inside(tag: str, space: str) -> str:
    if tag in ("svg", "math"):
        return tag
    if space == "svg" and tag == "text":
        return "text"
    if tag == "foreignobject" or (space == "math" and tag in MATH_TOKENS):
        return ""
    return space


def attributes_of(raw: str) -> dict[str, str]:
    if not raw or not HINTS.search(raw):
        return {}  # none that the renderer asks for
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape(double or single or bare))
    return out


def build(html: str) -> Node:
    """The tree of a page. Every text gets a place; nothing is dropped here."""
    root = Node("html", {})
    stack = [root]
    at, end = 0, len(html)
    while at < end:
        found = TAG.search(html, at)
        if found is None:
            stack[-1].children.append(html[at:])
            break
        if found.start() > at:
            stack[-1].children.append(html[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue  # a comment or declaration
        tag = name.lower()
        if found[1]:
            close(stack, tag)
            continue
        node = open_element(stack, tag, found[3])
        if node is not None and tag in RAW:
            stop = _raw_end(html, tag, at)
            node.children.append(html[at:stop])
            stack.pop()
            at = stop
    return root


def _raw_end(html: str, tag: str, at: int) -> int:
    found = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
    return found.start() if found else len(html)


def open_element(stack: list[Node], tag: str, raw: str) -> Node | None:
    """Appends an element, after closing what it closes; returns it if it can hold content."""
    if stack[-1].inside and tag in BREAKS_OUT:
        while stack[-1].inside:
            stack.pop()
    if tag in ("select", "input", "textarea") and _close_up_to(stack, ("select",), BARRIERS) and tag == "select":
        return None  # a second start tag ends the first
    if tag in CLOSES_P:
        _close_up_to(stack, ("p",), BARRIERS)
    implied = IMPLIED.get(tag)
    if implied:
        inside, barrier = implied
        if tag in TABLE_PARTS:
            barrier = ("table",) if tag != "td" and tag != "th" else barrier
        while _close_up_to(stack, inside, barrier):
            pass
    node = Node(tag, attributes_of(raw), stack[-1].inside)
    stack[-1].children.append(node)
    if node.space:
        node.moved = bool(MOVED.search(raw))
    if tag in VOID or ((node.space or node.inside) and raw.endswith("/") and not BARE_SLASH.search(raw)):
        return None
    stack.append(node)
    return node


def _close_up_to(stack: list[Node], tags, barriers) -> bool:
    """Pops the innermost of ``tags`` and all in it, unless a barrier stands before it."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return True
        if stack[i].tag in barriers:
            return False
    return False


def close(stack: list[Node], tag: str) -> None:
    """An end tag: closes its element and all in it; one without element is passed over,
    but </p> and </br> make an empty one."""
    if tag == "br":
        stack[-1].children.append(Node("br", {}))
        return
    barriers = ("table",) if tag == "table" or tag in TABLE_PARTS else BARRIERS
    closed = _close_up_to(stack, (tag,), barriers)
    if not closed and tag == "p":
        stack[-1].children.append(Node("p", {}))


def hidden(node: Node) -> bool:
    if node.tag in UNSEEN or node.tag in (MATH_UNSEEN if node.space == "math" else SVG_UNSEEN if node.space else ()):
        return True
    a = node.attributes
    if node.space and a.get("display") == "none" or node.tag == "dialog" and "open" not in a:
        return True
    return bool(a) and ("hidden" in a or bool(HIDING.search(a.get("style", ""))))


def veiled(node: Node, above: bool) -> bool:
    """Whether an element keeps its place but is not seen; its children inherit that, unless
    they say otherwise."""
    a = node.attributes
    said = VISIBILITY.findall(a.get("style", "")) if a else ()
    own = said[-1] if said else a.get("visibility") if node.space else None
    return own.lower() in ("hidden", "collapse") if own and own.lower() != "inherit" else above


def parts_of(node: Node) -> list[Node | str]:
    """The children that can be shown."""
    if node.space == "svg" and node.tag == "switch":  # shows the first that applies
        cases = [c for c in node.children if isinstance(c, Node)]
        return ([c for c in cases if "systemlanguage" not in c.attributes] or cases)[:1]
    if node.inside == "svg":
        return [c for c in node.children if isinstance(c, Node)]
    if node.space == "math" and node.tag in MATH_APART:
        return [x for c in node.children for x in (c, " ")]
    return node.children


def choices(select: Node) -> list[str]:
    """The options that a select shows: all of a list box, else the last selected one or the first."""
    options: list[tuple[Node, bool]] = []
    todo: list[tuple[Node, bool]] = [(select, False)]
    while todo:
        node, off = todo.pop()
        off = off or (node is not select and "disabled" in node.attributes)
        if node.tag == "option":
            options.append((node, off))
        else:
            todo.extend((c, off) for c in reversed(node.children) if isinstance(c, Node))
    a = select.attributes
    if "multiple" in a or _number(a.get("size"), 1) > 1:
        shown = [node for node, _ in options if not hidden(node)]
    else:
        chosen = [node for node, _ in options if "selected" in node.attributes]
        shown = chosen[-1:] or [node for node, off in options if not off][:1]
    return [node.attributes.get("label") or _inner(node) for node in shown]


def _inner(node: Node) -> str:
    texts, todo = [], [node]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            texts.append(unescape(part))
        elif part is node or not hidden(part):
            todo.extend(reversed(part.children))
    return "".join(texts)


def apart(node: Node) -> bool:
    """Whether a drawing or formula starts a line with this element."""
    if node.space in ("svg", "text"):
        return node.tag in ("text", "foreignobject")
    return node.tag == "math" and node.attributes.get("display") == "block"


WHITE = " \t\n\r\f\v"
WORDS = re.compile(f"[^{WHITE}]+")


class Lines:
    """Lines of a block being written: collapsed inline text, breaks and indents."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.indents: list[str] = []
        self.marker: str | None = None
        self.space = self.blank = False

    def text(self, raw: str) -> None:
        words = raw.split() if raw.isascii() else WORDS.findall(raw)  # a non-breaking space is no space
        if not words:
            self.space = self.space or bool(raw)
            return
        if self.parts and (self.space or raw[0] in WHITE):
            self.parts.append(" ")
        self.parts.append(" ".join(words))
        self.space = raw[-1] in WHITE

    def verbatim(self, raw: str) -> None:
        for i, line in enumerate(raw.split("\n")):
            if i:
                self.newline()
            if line:
                self.parts.append(line)

    def newline(self) -> None:
        """Ends the line, even an empty one."""
        self._put("".join(self.parts))
        self.parts, self.space = [], False

    def block(self) -> None:
        """Ends the line, if anything is on it."""
        if self.parts:
            self.newline()
        self.space = False

    def gap(self) -> None:
        """Ends the line and asks for an empty one before the next."""
        self.block()
        self.blank = bool(self.lines)

    def _put(self, line: str) -> None:
        if self.blank and self.marker is None and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank = False
        indent = "".join(self.indents)
        if self.marker is not None:
            indent = "".join(self.indents[:-1]) + self.marker
            self.marker = None
        self.lines.append((indent + line).rstrip())

    def done(self) -> list[str]:
        self.block()
        if self.marker is not None:
            self._put("")
        return self.lines


def render(root: Node) -> str:
    """Visible text: a line for each line of a block, an empty one between paragraphs."""
    out = [Lines()]  # cells of tables are written aside
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    counters: list[int | None] = []
    pre = 0
    todo: list[tuple[Node | str, bool, bool]] = [(root, False, False)]
    while todo:
        node, leaving, unseen = todo.pop()
        lines = out[-1]
        if isinstance(node, str):
            if unseen:
                continue
            text = unescape(node) if "&" in node else node
            lines.verbatim(text) if pre else lines.text(text)
            continue
        tag = node.tag
        if not leaving:
            if hidden(node):
                continue
            if unseen := veiled(node, unseen):
                todo.extend((child, False, True) for child in reversed(parts_of(node)))
                continue
            if tag == "input":
                if node.attributes.get("type", "text").strip().lower() in SHOWN_INPUTS:
                    lines.text(f" {node.attributes.get('value', '')} ")
                continue
            if tag == "br":
                lines.newline()
                continue
            if tag == "img":
                lines.text(node.attributes.get("alt", ""))
                continue
            if tag == "select":
                for choice in choices(node):
                    lines.text(f" {choice} ")
                continue
            if apart(node):
                lines.block()
            elif node.moved and node.space == "text":
                lines.text(" ")
            if tag in BLOCKS:
                nested = tag in ("ul", "ol") and counters
                lines.gap() if tag in SPACED and not nested else lines.block()
            if tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                out.append(Lines())
            elif tag == "caption" and tables:
                out.append(Lines())
            elif tag in ("ul", "ol", "menu", "dir"):
                counters.append(_number(node.attributes.get("start"), 1) if tag == "ol" else None)
            elif tag == "li":
                _open_item(lines, node, counters)
            elif tag in ("blockquote", "dd"):
                lines.indents.append("  ")
            elif tag == "pre":
                pre += 1
            todo.append((node, True, False))
            todo.extend((child, False, False) for child in reversed(parts_of(node)))
            continue
        if apart(node):
            lines.block()
        if tag in ("td", "th") and tables:
            cell = out.pop().done()
            a = node.attributes
            span = min(max(_number(a.get("colspan"), 1), 1), 1000)
            down = min(max(_number(a.get("rowspan"), 1), 1), 65534)
            tables[-1][-1].append((cell, span, down))
            continue
        if tag == "caption" and tables:
            caption = out.pop().done()
            for line in caption:
                out[-1].parts.append(line)
                out[-1].newline()
            continue
        if tag == "table":
            for line in aligned(tables.pop()):
                lines.parts.append(line)
                lines.newline()
        elif tag in ("ul", "ol", "menu", "dir"):
            counters.pop()
        elif tag == "li":
            lines.block()
            if lines.marker is not None:
                lines._put("")
            lines.indents.pop()
        elif tag in ("blockquote", "dd"):
            lines.block()
            lines.indents.pop()
        elif tag == "pre":
            pre -= 1
        if tag in BLOCKS:
            nested = tag in ("ul", "ol") and counters
            lines.gap() if tag in SPACED and not nested else lines.block()
    lines = out[0].done()
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines)


def _open_item(lines: Lines, node: Node, counters: list[int | None]) -> None:
    if lines.marker is not None:
        lines._put("")
    if counters and counters[-1] is not None:
        number = _number(node.attributes.get("value"), counters[-1])
        counters[-1] = number + 1
        lines.marker = f"{number}. "
    else:
        lines.marker = "- "
    lines.indents.append(" " * len(lines.marker))


def _number(raw: str | None, default: int) -> int:
    return int(raw) if raw and re.fullmatch(r"\s*-?[0-9]{1,9}\s*", raw) else default


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> Iterator[str]:
    """Rows of cells as lines, columns as wide as their widest cell, two spaces apart."""
    placed: list[list[tuple[int, int, list[str]]]] = []
    held: dict[int, int] = {}  # column: rows that a cell from above still takes
    for row in rows:
        column, line, below = 0, [], {}
        for cell, span, down in row:
            while held.get(column, 0):
                column += 1
            line.append((column, span, cell))
            if down > 1:
                below.update({c: down for c in range(column, column + span)})
            column += span
        held = {c: n - 1 for c, n in {**held, **below}.items() if n > 1}
        placed.append(line)
    widths: dict[int, int] = {}
    for line in placed:
        for column, span, cell in line:
            if span == 1:
                widths[column] = max(widths.get(column, 0), max(map(len, cell), default=0))
    edges = sorted(widths)
    starts, at = {}, 0
    for column in range(max(edges, default=-1) + 1):
        starts[column] = at
        at += widths.get(column, 0) + (2 if widths.get(column, 0) else 0)
    for line in placed:
        for i in range(max((len(cell) for _, _, cell in line if any(cell)), default=0)):
            text = ""
            for column, _, cell in line:
                if i < len(cell) and cell[i]:
                    text = text.ljust(starts.get(column, at))
                    if text and not text.endswith("  "):
                        text += "  "
                    text += cell[i]
            yield text.rstrip()


def extract(html: str | None) -> str:
    return render(build(html)) if html else ""


@dataclass(frozen=True)
class HtmlExtractor:
    """Text of a column of pages."""

    out: str = "text"

    def extract(self, pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
        """(id, text, n_chars) per row of ``pages``.

        NULL and empty pages give an empty text, and so does a page without visible text.
        Unfinished or wrongly nested tags are taken as browsers take them; text outside any
        element is text. Repeated rows and NULL ids stay; an empty table gives an empty one.
        """
        narrowed = pages.select(F.col(id_col).alias("id"), text_or_empty(html_col).alias("html"))
        kind = dict(narrowed.dtypes)["id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [extract(html.as_py()) for html in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

        found = narrowed.mapInArrow(run, f"id {kind}, text string")
        return found.select(
            F.col("id").alias(id_col), F.col("text").alias(self.out), F.length("text").cast("long").alias("n_chars")
        )
