"""Operator 7: the visible text of HTML pages, laid out in lines.

A tokenizer after the HTML rules feeds a tree builder that closes elements whose end tags
may be left out, skips what isn't shown, and a renderer that sets blocks on lines of their
own, marks list items, and aligns the cells of tables in columns.

Time and memory grow with a page's length, whatever is in it: elements that are open are
found by their name, nothing recurses, indents end at ``MOST_INDENTS`` levels, and cells are aligned as
far as column ``MOST_COLUMNS``.  A table's layout depends on its cells alone, not on how long it or its page is.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element classes of HTML.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("title textarea".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title meta link base object embed applet audio video canvas svg datalist select textarea area param source track annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table ul xmp".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An opening tag closes an open element of the set, up to the nearest of the barriers.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
SECTIONS = frozenset({"thead", "tbody", "tfoot"})
#: Start tags that end whatever is open inside the table up to where they belong.
TABLE_PARTS = SECTIONS | {"tr", "td", "th", "caption", "colgroup", "col"}
#: An element of another kind inside these can't be closed from inside them.
SCOPES = frozenset({"table", "td", "th", "caption", "html", "template", "button", "object"})
#: End tags that no scope stops.
UNSCOPED = SECTIONS | {"table", "tr", "html", "body"}

MOST_INDENTS = 32
MOST_GRIDS = 16
MOST_COLUMNS = 250

#: Where markup begins; any other "<" is text.
_MARK = re.compile(r"<(?:/?[a-zA-Z]|[!?]|/(?!\Z))")
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
#: A name, then a value if "=" follows; quotes delimit a value only right after "=", and one that
#: isn't closed goes on to the page's end.  {0} opens a group.
_ATTRIBUTE = r"({0}[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:\"({0}[^\"]*+)(?:\"|\Z)|'({0}[^']*+)(?:'|\Z)|({0}[^ \t\n\r\f>]*+)))?+"
#: A tag without its ">": what stops it is that or the page's end.
_TAG = re.compile(r"</?([a-zA-Z][^ \t\n\r\f/>]*+)((?:[ \t\n\r\f/]++|" + _ATTRIBUTE.format("?:") + r")*+)")
_ATTR = re.compile(_ATTRIBUTE.format(""))
_INVISIBLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|content-visibility\s*:\s*hidden)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


@dataclass(slots=True)
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


class Open:
    """The open elements, the root first, and where those of each name stand."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost element with one of the names; 0 if none is open."""
        return max((p[-1] for p in map(self.places.get, names) if p), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, i: int) -> None:
        """Close the element at place ``i`` and all inside it."""
        while len(self.nodes) > i:
            self.places[self.nodes.pop().name].pop()

    def add(self, child: Node | str) -> None:
        self.nodes[-1].children.append(child)

    def close(self, names: set[str], barriers: set[str] | frozenset[str]) -> None:
        """Close the outermost of the adjoining elements with these names that no barrier shields."""
        i = self.last(names)
        if i and i >= self.last(barriers):
            while i > 1 and self.nodes[i - 1].name in names:
                i -= 1
            self.cut(i)

    def to_table_part(self, name: str) -> None:
        """Close what is open between the nearest table and the place of its part ``name``; open a row left out."""
        i, nodes = self.last(("table", "template")), self.nodes
        if nodes[i].name != "table":
            return
        inside = lambda: nodes[i + 1].name if i + 1 < len(nodes) else ""
        if name in ("tr", "td", "th") and inside() in SECTIONS:
            i += 1
        if inside() == ("colgroup" if name == "col" else "tr" if name in ("td", "th") else None):
            i += 1
        self.cut(i + 1)
        if name in ("td", "th") and nodes[i].name != "tr":
            row = Node("tr")
            self.add(row)
            self.push(row)


def parse(page: str) -> Node:
    """The page's tree.  Unknown end tags are dropped; open elements end with the page, and so
    does a tag or comment that isn't closed, which shows nothing."""
    root = Node("#root")
    tree = Open(root)
    at, n = 0, len(page)
    while at < n:
        m = _MARK.search(page, at)
        end = m.start() if m else n
        if end > at:
            tree.add(html.unescape(page[at:end]))
        if m is None:
            break
        if m[0][-1] in "!?/":  # a comment, or what counts as one
            comment = _COMMENT.match(page, end)
            at = comment.end() if comment else page.find(">", end) + 1 or n
            continue
        tag = _TAG.match(page, end)
        at = tag.end() + 1
        if at > n:
            break
        name = tag[1].lower()
        if m[0][1] == "/":
            _end_tag(tree, name)
            continue
        if name in CLOSES_P:
            tree.close({"p"}, SCOPES)
        if name in IMPLIED:
            tree.close(*IMPLIED[name])
        if name in TABLE_PARTS:
            tree.to_table_part(name)
        node = Node(name, _attributes(tag[2]) if tag[2].strip(" /\n\t") else {})
        tree.add(node)
        if name in RAW or name in ESCAPABLE:
            close = re.compile(rf"</{name}(?=[ \t\n\r\f/>])", re.I).search(page, at)
            text = page[at : close.start() if close else n]
            node.children.append(html.unescape(text) if name in ESCAPABLE else text)
            at = _TAG.match(page, close.start()).end() + 1 if close else n
        elif name == "plaintext":
            node.children.append(page[at:])
            break
        elif name not in VOID and not (name == "form" and (tree.nodes[-1].name in ("table", "tr") or tree.nodes[-1].name in SECTIONS)):
            tree.push(node)  # a form between a table's parts holds none of them
    return root


def _end_tag(tree: Open, name: str) -> None:
    i = tree.last((name,))
    if i and (name in UNSCOPED or i >= tree.last(SCOPES)):
        tree.cut(i)
    elif name == "br" or name == "p" and not i:
        tree.add(Node(name))


def shown(node: Node) -> bool:
    if node.name in HIDDEN or "hidden" in node.attrs and node.attrs["hidden"].lower() != "until-found":
        return False
    if node.name == "dialog" and "open" not in node.attrs:
        return False
    if node.name == "input":
        return False
    return not ("style" in node.attrs and _INVISIBLE.search(node.attrs["style"]))


def width(text: str) -> int:
    """Columns of a fixed-width display that ``text`` takes."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Renderer:
    """Lines of text; ``space`` is a blank due before more text, ``empty_due`` an empty line due before more lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.empty_due = False
        self.pads = [""]  # what stands before a line, by depth
        self.marker = ""

    def text(self, raw: str, pre: bool) -> None:
        if pre:
            first, *rest = raw.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self._put(first)
            for line in rest:
                self.line(True)
                self._put(line)
            return
        parts = _SPACE.sub(" ", raw)
        if parts.startswith(" "):
            self.space = True
        body = parts.strip(" ")
        if body:
            if self.space and self.now:
                self.now.append(" ")
            self.space = False
            self._put(body)
        if parts.endswith(" ") and body:
            self.space = True

    def _put(self, text: str) -> None:
        if text:
            self.now.append(text)

    def apart(self) -> None:
        """Two blanks between a row's cells."""
        if self.now:
            self.now.append("  ")
        self.space = False

    def indent(self, by: str) -> None:
        self.pads.append(self.pads[-1] + (by if len(self.pads) <= MOST_INDENTS else ""))

    def outdent(self) -> None:
        self.line()
        self.pads.pop()

    def line(self, force: bool = False) -> None:
        """End the line; ``force`` keeps an empty one."""
        if self.now or force:
            if self.empty_due and self.lines:
                self.lines.append("")
            self.empty_due = False
            pad, mark = self.pads[-1], self.marker
            self.marker = ""
            self.lines.append(f"{pad[: max(0, len(pad) - len(mark))]}{mark}{''.join(self.now)}".rstrip())
        self.now, self.space = [], False

    def gap(self) -> None:
        self.line()
        if self.lines:
            self.empty_due = True

    def end_row(self) -> None:
        self.line()
        self.empty_due = False

    def result(self) -> str:
        self.line()
        return "\n".join(self.lines).strip("\n")


@dataclass(slots=True)
class Cell:
    lines: list[str]
    columns: int
    rows: int
    start: int = 0


class Grid:
    """A table's cells, once they are lines."""

    def __init__(self, rows: int):
        self.rows: list[list[Cell]] = [[] for _ in range(rows)]

    def _place(self) -> None:
        """Give each cell its first column: the next one that no cell of a row above reaches down to."""
        held = np.empty((3, 0), np.int64)  # first column, column after the last, row before which they are taken
        for r, row in enumerate(self.rows):
            held = held[:, held[2] > r]
            taken = _runs(held)
            at = k = 0
            for c in row:
                while k < len(taken) and taken[k][1] <= at:
                    k += 1
                if k < len(taken) and taken[k][0] <= at:
                    at = taken[k][1]
                c.start = at
                at += c.columns
            new = [(c.start, c.start + c.columns, r + c.rows) for c in row if c.rows > 1]
            if new:
                held = np.concatenate([held, np.array(new, np.int64).T], axis=1)
                held = held[:, held[0].argsort(kind="stable")]

    def _offsets(self) -> dict[int, int]:
        """Where each column begins: two blanks after the widest of what ends before it."""
        cells = sorted((c for row in self.rows for c in row), key=lambda c: c.start)
        offset: dict[int, int] = {}
        least = dict.fromkeys(sorted({c.start for c in cells} | {c.start + c.columns for c in cells}), 0)
        i, low = 0, 0
        for column in least:
            low = offset[column] = max(low, least[column])
            while i < len(cells) and cells[i].start == column:
                c = cells[i]
                least[column + c.columns] = max(least[column + c.columns], low + 2 + max(map(width, c.lines)))
                i += 1
        return offset

    def render(self, out: Renderer) -> None:
        """A line of a cell whose text would begin beyond ``MOST_COLUMNS`` stands two blanks after what is before it."""
        self._place()
        self.rows = [row for row in self.rows if any(any(c.lines) for c in row)]
        offset = self._offsets()
        for row in self.rows:
            k = 0
            while row:
                parts, have = [], 0
                for c in row:
                    text = c.lines[k]
                    blanks = 2 if have else 0
                    if offset[c.start] + len(text) - len(text.lstrip(" ")) <= MOST_COLUMNS:
                        blanks = max(offset[c.start] - have, blanks)
                    elif not text:
                        continue
                    parts.append(" " * blanks + text)
                    have += blanks + width(text)
                line = "".join(parts).rstrip()
                if line:
                    out.now = [line]
                    out.line()
                k += 1
                row = [c for c in row if len(c.lines) > k]


def _runs(held: np.ndarray) -> list[tuple[int, int]]:
    """The columns that intervals, in the order of their beginnings, cover: runs with others between them."""
    if not held.shape[1]:
        return []
    ends = np.maximum.accumulate(held[1])
    first = np.append(True, held[0, 1:] > ends[:-1])
    return list(zip(held[0, first].tolist(), ends[np.append(first[1:], True)].tolist()))


def _span(node: Node, name: str) -> int:
    raw = node.attrs.get(name, "")
    return min(max(int(raw), 1), 1000) if re.fullmatch(r"\d{1,4}", raw) else 1


def _parts(table: Node) -> tuple[list[Node], list[Node]]:
    """The table's shown rows, and blocks of what stands outside them: captions and stray contents."""
    rows: list[Node] = []
    outside: list[Node] = []
    for group in (table, *(c for c in table.children if isinstance(c, Node) and (c.name in SECTIONS or c.name == "colgroup") and shown(c))):
        stray = Node("div")
        for c in group.children:
            if isinstance(c, str):
                stray.children.append(c)
            elif c.name == "caption":
                outside += [stray, Node("div", {}, [c])]
                stray = Node("div")
            elif c.name not in ("tr", "col") and not (group is table and (c.name in SECTIONS or c.name == "colgroup")):
                stray.children.append(c)
        outside.append(stray)
    for c in table.children:
        if isinstance(c, Node) and shown(c):
            rows += [c] if c.name == "tr" else [r for r in c.children if isinstance(r, Node) and r.name == "tr" and shown(r)] if c.name in SECTIONS else []
    return rows, [x for x in outside if x.children]


def _cells(row: Node) -> list[Node]:
    """The row's shown cells; what stands outside cells is a cell of its own."""
    there = [c for c in row.children if (c.strip() if isinstance(c, str) else shown(c))]
    return [c if isinstance(c, Node) and c.name in ("td", "th") else Node("", {}, [c]) for c in there]


class Walk:
    """Renders a tree; ``todo`` holds the steps still to be done, so depth costs no recursion."""

    def __init__(self) -> None:
        self.outs = [Renderer()]  # the page's, and one for each cell of a grid around this place
        self.todo: list[tuple[object, bool]] = []

    def run(self, root: Node) -> str:
        self._then(root.children, False)
        while self.todo:
            what, pre = self.todo.pop()
            if isinstance(what, str):
                self.outs[-1].text(what, pre)
            elif isinstance(what, Node):
                if shown(what):
                    self._node(what, pre)
            else:
                what()
        return self.outs[0].result()

    def _then(self, steps: list, pre: bool) -> None:
        self.todo.extend((x, pre) for x in reversed(steps))

    def _node(self, node: Node, pre: bool) -> None:
        out, name = self.outs[-1], node.name
        if name == "br":
            out.line(True)
        elif name == "hr":
            out.gap()
        elif name == "img":
            if node.attrs.get("alt"):
                out.text(node.attrs["alt"], False)
        elif name == "table":
            self._table(out, node)
        elif name in ("ul", "ol", "menu", "dir"):
            self._list(out, node, pre)
        elif name in BLOCK:
            edge = out.gap if name in SPACED else out.line
            edge()
            steps = [*node.children, edge]
            if name in ("dd", "blockquote"):
                out.indent("  ")
                steps[-1:] = [out.outdent, edge]
            self._then(steps, pre or name in ("pre", "listing", "plaintext", "xmp"))
        elif name == "q":
            self.todo.append(('"', False))
            self._then(node.children, pre)
            self.todo.append(('"', False))
        else:
            self._then(node.children, pre)

    def _list(self, out: Renderer, node: Node, pre: bool) -> None:
        edge = out.line if len(out.pads) > 1 else out.gap
        edge()
        number = int(node.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1
        steps: list[tuple[object, bool]] = []
        for c in node.children:
            if isinstance(c, Node) and c.name == "li" and shown(c):
                mark = "- "
                if node.name == "ol":
                    number = int(c.attrs["value"]) if re.fullmatch(r"-?\d{1,9}", c.attrs.get("value", "")) else number
                    mark = f"{number}. "
                    number += 1
                begin, end = self._item(out, mark)
                steps += [(begin, False), *((x, False) for x in c.children), (end, False)]
            else:
                steps.append((c, pre))
        self.todo.append((edge, False))
        self.todo.extend(reversed(steps))

    @staticmethod
    def _item(out: Renderer, mark: str) -> tuple[object, object]:
        def begin() -> None:
            out.line()
            out.indent(" " * len(mark))
            out.marker = mark

        def end() -> None:
            out.line()
            if out.marker == mark:  # an empty item
                out.marker = ""
            out.outdent()

        return begin, end

    def _table(self, out: Renderer, node: Node) -> None:
        """Captions and stray contents as blocks, then rows with cells padded to their columns.

        Rows of one cell are blocks too; so are those of tables in more than ``MOST_GRIDS`` others,
        with two blanks between cells.
        """
        out.gap()
        rows, outside = _parts(node)
        cells = [_cells(r) for r in rows]
        steps: list = [*outside, out.line]
        if len(self.outs) > MOST_GRIDS or max(map(len, cells), default=0) < 2:
            for row in cells:
                for c in row:
                    steps += [out.apart, *c.children]
                steps.append(out.end_row)
        else:
            grid = Grid(len(cells))
            for into, row in zip(grid.rows, cells):
                for c in row:
                    steps += [self._enter, *c.children, self._leave(into, c)]
            steps.append(lambda: grid.render(out))
        self._then([*steps, out.gap], False)

    def _enter(self) -> None:
        self.outs.append(Renderer())

    def _leave(self, row: list[Cell], node: Node) -> object:
        def leave() -> None:
            lines = self.outs.pop().result().split("\n")
            if node.name or any(lines):
                row.append(Cell(lines, _span(node, "colspan"), _span(node, "rowspan")))

        return leave


def visible_text(page: str | None) -> str:
    """The text a reader sees; empty for a page that is null or shows none."""
    if not page:
        return ""
    return Walk().run(parse(page.replace("\x00", "�")))


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Every row of ``pages`` with ``out``, its visible text, in place of ``html_col``.

    A null or empty page has an empty text, an empty table gives no rows.  Values of form
    fields (input, textarea, select) are left out, as are pictures but for their texts.  All
    other columns stay (one named ``out`` is replaced); repeated rows are rendered alike.
    """
    keep = [c for c in pages.columns if c not in (html_col, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [visible_text(x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*keep, out])

    schema = T.StructType([*pages.select(*[f"`{c}`" for c in keep]).schema.fields, T.StructField(out, T.StringType())])
    return pages.select(*[F.col(f"`{c}`") for c in [*keep, html_col]]).mapInArrow(run, schema)
