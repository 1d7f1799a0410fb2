"""Layout-aware text of HTML pages.

A tokenizer feeds a tree builder that knows implied tags (an open paragraph ends at a block, a list
item at the next item, a cell at the next cell or row, and so on). The tree is then rendered: elements
that a browser does not display (by tag, ``hidden`` or inline style) give nothing; all other text is
emitted in order, with white space collapsed as in layout, a line per block, a blank line around
paragraphs, headings, lists and tables, list markers with indentation (of ``MAX_INDENT`` levels at most),
preformatted text as it is, options of a choice a line each.

Tables are laid out on a grid: cells keep the lines of what is in them, stand side by side, take as many
columns and rows as they span, and are padded to the width of their column. A column is as wide as its
widest cell, but no wider than ``WIDE`` times its cells' average plus ``ROOM``, so that the padding stays
in proportion to the text; wider cells are emitted whole and push the rest of their line.

Both passes keep their own stacks, so deep nesting does not exhaust the interpreter's. Time and memory
are linear in the page, but for tables with many cells of different ``rowspan`` beside each other.

Defined results: null or empty html gives the empty text; unclosed and stray tags are repaired, never
an error; bytes that are no UTF-8 are replacement characters. Repeated rows get the same text. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vecgrove.llm.common import batched, table

#: Most width of a column, against the average of its cells.
WIDE, ROOM = 16, 64
MAX_INDENT = 20
#: What cells may span at most, as in browsers.
MAX_COLUMNS, MAX_ROWS = 1000, 65534

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_UNSEEN = frozenset(
    "head script style template title noscript iframe noembed noframes object audio video canvas datalist input meta link base area param source track annotation annotation-xml desc metadata defs".split()
)
_WIDE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr menu dir".split())  # a blank line around
_BLOCK = _WIDE | frozenset(
    "html body address article aside center details dialog dd div dt fieldset figcaption footer form header hgroup legend li main nav optgroup option search section summary tr tbody thead tfoot caption td th".split()
)
_CLOSES_P = _WIDE | frozenset("address article aside center details dialog dd div dl dt figcaption footer form header hgroup li main nav search section summary".split())
#: Opening a tag ends open ones of the set, up to a barrier.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"})),
    **dict.fromkeys(("option", "optgroup"), ({"option"}, {"select", "datalist"})),
    "body": ({"head"}, set()),
}
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: End tags of raw text.
_RAW_END = {t: re.compile(f"</{t}", re.I | re.A) for t in _RAW}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_HIDING = re.compile(r"display\s*:\s*none|content-visibility\s*:\s*hidden", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)
_SPACES = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


#: The rest of a tag; only a value's quotes, after an equals sign, shield what is in them.
_TAG_REST = re.compile(r"""(?:[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+>""")


def _tag_end(html: str, at: int) -> int:
    """Index of the ``>`` that ends a tag, outside quotes; without one, of the first plain ``>`` or -1."""
    m = _TAG_REST.match(html, at)
    return m.end() - 1 if m else html.find(">", at)


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", s, {}), ("open", tag, attributes), ("close", tag, {})."""
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", unescape(html[at:]), {}
            return
        if lt > at:
            yield "text", unescape(html[at:lt]), {}
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith("<![CDATA[", lt):
            end = html.find("]]>", lt)
            at = n if end < 0 else end + 3
            yield "text", html[lt + 9 : n if end < 0 else end], {}
            continue
        if html[lt + 1 : lt + 2] in ("!", "?"):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        close = html.startswith("/", lt + 1)
        m = _NAME.match(html, lt + 1 + close)
        if not m:
            yield "text", "<", {}
            at = lt + 1
            continue
        end = _tag_end(html, m.end())
        if end < 0:  # an unfinished tag at the end of the page is dropped
            return
        tag = m.group().lower()
        at = end + 1
        if close:
            yield "close", tag, {}
            continue
        found = _ATTRIBUTE.findall(html[m.end() : end])
        yield "open", tag, {k.lower(): unescape(a or b or c) for k, a, b, c in reversed(found)}
        if tag in _RAW:
            found = _RAW_END[tag].search(html, at)
            stop = found.start() if found else n
            if stop > at:
                yield "text", unescape(html[at:stop]) if tag in ("textarea", "title") else html[at:stop], {}
            at = stop


def parse(html: str) -> Node:
    root = Node("#root")
    stack = [root]
    open_count: dict[str, int] = {}

    def pop() -> None:
        node = stack.pop()
        open_count[node.tag] -= 1

    def end(tags: set[str] | frozenset[str], barrier: set[str]) -> None:
        """Close the outermost open element of ``tags`` above the nearest barrier."""
        if not any(open_count.get(t) for t in tags):
            return
        cut = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in barrier:
                break
            if stack[i].tag in tags:
                cut = i
        if cut is not None:
            while len(stack) > cut:
                pop()

    for kind, value, attrs in tokens(html):
        if kind == "text":
            if value:
                stack[-1].kids.append(value)
        elif kind == "open":
            if value in _CLOSES_P and open_count.get("p"):
                end({"p"}, {"table", "td", "th", "button", "object"})
            if value in _ENDS:
                end(*_ENDS[value])
            if value in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):  # implied row
                row = Node("tr")
                stack[-1].kids.append(row)
                stack.append(row)
                open_count["tr"] = open_count.get("tr", 0) + 1
            if value in ("html", "body") and open_count.get(value):
                continue
            node = Node(value, attrs)
            stack[-1].kids.append(node)
            if value not in _VOID:
                stack.append(node)
                open_count[value] = open_count.get(value, 0) + 1
        elif value == "p" and not open_count.get("p"):
            stack[-1].kids.append(Node("p"))
        elif value == "br":
            stack[-1].kids.append(Node("br"))
        elif open_count.get(value):
            barrier = {"table"} if value not in ("table", "html", "body") else set()
            if value not in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
                barrier |= {"td", "th"} if value not in ("table", "html", "body", "form") else set()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == value:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i].tag in barrier:
                    break
    return root


class Out:
    """Text of one flow: a page or a cell."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.gap, self.space, self.indent, self.marker = 0, False, 0, ""

    def block(self, lines: int) -> None:
        self.gap, self.space = max(self.gap, lines), False

    def _lead(self) -> None:
        if self.gap or not self.parts:
            if self.parts:
                self.parts.append("\n" * self.gap)
            lead = " " * (2 * min(self.indent, MAX_INDENT))
            if self.marker:
                lead = lead[: max(0, len(lead) - 2)] + self.marker
            self.parts.append(lead)
            self.gap, self.space, self.marker = 0, False, ""

    def text(self, s: str) -> None:
        body = _SPACES.sub(" ", s)
        if body in ("", " "):
            self.space = self.space or body == " "
            return
        fresh = bool(self.gap) or not self.parts
        self._lead()
        if (self.space or body[0] == " ") and not fresh:
            self.parts.append(" ")
        self.parts.append(body.strip(" "))
        self.space = body[-1] == " "

    def raw(self, s: str) -> None:
        if s:
            self._lead()
            self.parts.append(s)
            self.space = False

    def done(self) -> str:
        return "\n".join(x.rstrip(" ") for x in "".join(self.parts).split("\n")).strip("\n")


def _seen(node: Node) -> bool:
    if node.tag in _UNSEEN or "hidden" in node.attrs and node.attrs["hidden"].lower() != "until-found":
        return False
    if node.tag == "dialog" and "open" not in node.attrs:
        return False
    return not _HIDING.search(node.attrs.get("style", ""))


def _span(attrs: dict[str, str], name: str, most: int) -> int:
    v = attrs.get(name, "1").strip()
    return max(1, min(int(v), most)) if v.isascii() and v.isdigit() and len(v) < 7 else 1


#: A cell: its lines, columns and rows spanned.
Cell = tuple[list[str], int, int]


def _grid(rows: list[list[Cell]]) -> list[list[tuple[int, Cell]]]:
    """The column in which each cell starts, past the columns that cells of earlier rows still take."""
    held: list[tuple[int, int, int]] = []  # columns from, to, taken before this row
    out = []
    for y, row in enumerate(rows):
        held = [h for h in held if h[2] > y]
        at, i, placed, new = 0, 0, [], []
        for cell in row:
            while i < len(held) and held[i][0] < at + 1:
                at = max(at, held[i][1])
                i += 1
            placed.append((at, cell))
            if cell[2] > 1:
                if new and new[-1][1:] == (at, y + cell[2]):
                    new[-1] = (new[-1][0], at + cell[1], y + cell[2])
                else:
                    new.append((at, at + cell[1], y + cell[2]))
            at += cell[1]
        held = sorted(held + new) if new else held
        out.append(placed)
    return out


def _table_lines(rows: list[list[Cell]]) -> list[str]:
    """Rows of cells side by side, each column padded to its width."""
    grid = _grid(rows)
    widths: dict[int, list[int]] = {}
    for row in grid:
        for at, (lines, columns, _) in row:
            own = widths.setdefault(at, [])
            if columns == 1:
                own.append(max(map(len, lines), default=0))
    start, offset = {}, 0
    for at in sorted(widths):
        own, start[at] = widths[at], offset
        offset += 2 + (min(max(own), WIDE * sum(own) // len(own) + ROOM) if own else 0)
    out = []
    for row in grid:
        for y in range(max((len(cell[0]) for _, cell in row), default=0)):
            parts, length = [], 0
            for at, (lines, _, _) in row:
                if y < len(lines) and lines[y]:
                    pad = max(start[at] - length, 2 if length else 0)
                    parts += [" " * pad, lines[y]]
                    length += pad + len(lines[y])
            out.append("".join(parts))
    return out


def render(root: Node) -> str:
    page = Out()
    out, pre, visible = page, 0, [True]
    lists: list[list] = []  # [ordered, next number]
    flows: list[Out] = []  # what a cell's flow interrupts
    tables: list[list[list[Cell]]] = []
    todo: list[tuple[str, Node | str]] = [("open", root)]
    while todo:
        step, x = todo.pop()
        if isinstance(x, str):
            if visible[-1]:
                out.raw(x) if pre else out.text(x)
            continue
        tag = x.tag
        if step == "open":
            if not _seen(x):
                continue
            if tag == "br":
                if visible[-1]:
                    if pre:
                        out.raw("\n")
                    else:
                        out.gap, out.space = min(out.gap + 1, 2) if out.parts else 0, False
                continue
            if tag in ("img", "wbr"):
                continue
            m = _VISIBILITY.search(x.attrs.get("style", ""))
            visible.append(m[1].lower() == "visible" if m else visible[-1])
            if tag in ("td", "th") and tables:
                flows.append(out)
                out = Out()
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in _BLOCK:
                out.block(1 if tag in ("ul", "ol") and lists or tag not in _WIDE else 2)
            if tag == "table":
                tables.append([])
            elif tag in ("ul", "ol", "menu", "dir"):
                start = x.attrs.get("start", "1").strip()
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
                out.indent += 1
            elif tag == "li":
                if lists and lists[-1][0]:
                    out.marker = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    out.marker = "- "
            elif tag == "dd":
                out.indent += 1
            elif tag == "pre":
                pre += 1
                if x.kids and isinstance(x.kids[0], str):
                    x.kids[0] = x.kids[0].removeprefix("\n")
            todo.append(("close", x))
            todo.extend(("open", k) for k in reversed(x.kids))
            continue
        visible.pop()
        if tag in ("td", "th") and tables and flows:
            text = out.done()
            out = flows.pop()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((text.split("\n") if text else [], _span(x.attrs, "colspan", MAX_COLUMNS), _span(x.attrs, "rowspan", MAX_ROWS)))
        elif tag == "table":
            for line in _table_lines(tables.pop()):
                if line:
                    out.block(1)
                    out.raw(line)
                else:  # between blocks of a cell
                    out.gap = 2 if out.parts else 0
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
            out.indent = max(0, out.indent - 1)
        elif tag == "li":
            out.marker = ""
        elif tag == "dd":
            out.indent = max(0, out.indent - 1)
        elif tag == "pre":
            pre -= 1
        if tag in _BLOCK and not (tag in ("td", "th", "tr") and tables):
            out.block(1 if tag in ("ul", "ol") and lists or tag not in _WIDE else 2)
    return page.done()


def html_to_text(html: str | None) -> str:
    return render(parse(html)) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, text, n_chars, n_lines of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [html_to_text((t.as_py() or b"").decode("utf-8", "replace")) for t in b.column(1)]
            lines = [t.count("\n") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(lines, pa.int64())],
                ["id", "text", "n_chars", "n_lines"],
            )

    picked = pages.select(pages[id_col].cast("bigint").alias("id"), pages[html_col].cast("binary").alias("html"))
    return batched(picked).mapInArrow(run, "id bigint, text string, n_chars bigint, n_lines bigint")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its visible text."""
    return extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
