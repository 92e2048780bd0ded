"""HTML to text as it would be laid out: a tree with implied tags, visibility rules, and blocks.

Tags are read by one pattern, a tree builder adds what authors leave out (paragraphs end at the
next block, list items and table cells at the next one, unclosed elements at their parent's end),
elements that are not shown are skipped, and the rest is written with a blank line between
paragraphs, marks or numbers before list items, preformatted text as it is, and table cells padded
to the width of their column. Cells that span columns or rows keep later cells in their own columns,
and wide characters count as two places.

Nesting may be of any depth: the builder looks open elements up by name and the walk keeps its own
work list. Time is linear in the page, except that text inside tables inside tables is joined once
per level. List marks move in no further than ``INDENTS`` levels.

Defined cases: a null html gives a null text, an empty one an empty text; rows are rendered one
by one; markup that never closes ends with the page; extra input columns are ignored; an empty table
gives an empty result. Only inline styles and attributes hide; ``<style>`` rules are not applied.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Collection, Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.llm.common import pieces

#: list marks of deeper levels stand below those of this one
INDENTS = 40
#: fixed values: the spans that the HTML standard allows
MOST_COLUMNS, MOST_ROWS = 1000, 65534
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: whether text is left out, by visibility; other values follow the parent
GHOST = {"visible": False, "hidden": True, "collapse": True}
STYLED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template noscript iframe object audio video canvas datalist title noembed noframes".split())
#: one line end around these, a blank line around those in SPACED too
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption xmp listing".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
#: a start tag ends an open element of these kinds, looked for no further out than the second set
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: these end an open paragraph
ENDS_P = BLOCKS - {"html", "body", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "legend", "option", "optgroup"}
#: drawings and formulas have parts that are not shown
UNDRAWN = {"svg": frozenset("defs desc metadata symbol".split()), "math": frozenset(["annotation", "annotation-xml"])}
#: parts of a table, and the open elements that each goes into; forms and inline elements between are left
GROUPS = frozenset(["thead", "tbody", "tfoot"])
PART_OF = {"td": GROUPS | {"tr", "table"}, "th": GROUPS | {"tr", "table"}, "tr": GROUPS | {"table"}, "caption": frozenset(["table"]),
           "colgroup": frozenset(["table"]), "col": frozenset(["table", "colgroup"])} | dict.fromkeys(GROUPS, frozenset(["table"]))
#: content in these, outside of a cell, stands in front of the table
OUTSIDE = GROUPS | {"table", "tr"}
CELLS = frozenset("table td th caption".split())
SCOPE = frozenset("table td th caption button object html".split())


class Node:
    """An element; ``shown`` is false where it and all in it are left out, ``ghost`` where its own text is (None: as its parent)."""

    __slots__ = ("children", "columns", "down", "ghost", "name", "shown", "start")

    def __init__(self, name: str, shown: bool = True, ghost: bool | None = None):
        self.name, self.shown, self.ghost = name, shown, ghost
        self.start = self.columns = self.down = 1
        self.children: list[Node | str] = []


class Open:
    """The open elements from the outermost in, and where each name stands among them."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = defaultdict(list)

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.places[node.name].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            self.places[self.nodes.pop().name].pop()

    def last(self, names: Collection[str]) -> int:
        """Place of the innermost element of these names, 0 for none."""
        return max((self.places[n][-1] for n in names if self.places[n]), default=0)

    def close(self, kinds: Collection[str], until: Collection[str]) -> None:
        """End the outermost element of these kinds that stands inside the innermost of the others."""
        found = [k for k in kinds if self.places[k]]
        if found:
            barrier = self.last(until)
            inside = [self.places[k][bisect_right(self.places[k], barrier)] for k in found if self.places[k][-1] > barrier]
            if inside:
                self.cut(min(inside))


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _number(text: str, least: int, most: int) -> int:
    """A whole number within bounds, 1 for anything else."""
    digits = text.strip()
    known = digits.lstrip("-").isdecimal() and len(digits) < 10 and "-" not in digits[1:]
    return min(max(int(digits), least), most) if known else 1


def _node(name: str, attributes: dict[str, str], drawn: bool) -> Node:
    style = {m[1].lower(): m[2].lower() for m in STYLED.finditer(attributes.get("style", ""))}
    off = "hidden" in attributes or style.get("display") == "none" or (name == "dialog" and "open" not in attributes)
    node = Node(name, drawn and name not in UNSEEN and not off, GHOST.get(style.get("visibility", "")))
    if attributes:
        node.start = _number(attributes.get("start", ""), -(10**9), 10**9)
        node.columns = _number(attributes.get("colspan", ""), 1, MOST_COLUMNS)
        node.down = _number(attributes.get("rowspan", ""), 0, MOST_ROWS) or MOST_ROWS
    return node


def build(page: str) -> Node:
    """The tree of a page, with implied elements."""
    root = Node("html", ghost=False)
    opened = Open(root)
    at, size = 0, len(page)

    def put(child: Node | str) -> None:
        inner = opened.last(("table",)) if opened.top.name in OUTSIDE else 0
        stays = child.isspace() if isinstance(child, str) else child.name in PART_OF or child.name == "form" or not child.shown
        home = opened.top if not inner or stays else opened.nodes[inner - 1]
        # an open table is the last child of its parent
        home.children.insert(len(home.children) - (home is not opened.top), child)
        if isinstance(child, Node) and child.ghost is None:
            child.ghost = home.ghost

    while at < size:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text:
            put(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "p" and not opened.places["p"]:
                put(Node("p"))
            elif name == "br":
                put(Node("br"))
            elif name == "table":
                opened.cut(opened.last(("table",)) or len(opened.nodes))
            elif name not in ("html", "body"):
                opened.close((name,), ("table",) if name in PART_OF or name in ("li", "p", "dd", "dt") else CELLS)
            continue
        attributes = _attributes(m[3]) if m[3].strip(" /") else {}
        if name == "html" or name == "body" and opened.places["body"]:
            continue
        if name in ENDS_P:
            opened.close(("p",), SCOPE)
        if name in IMPLIED:
            opened.close(*IMPLIED[name])
        if name in PART_OF and opened.places["table"]:
            while opened.top.name not in PART_OF[name] and opened.top.name not in CELLS:
                opened.cut(len(opened.nodes) - 1)
        elif name == "table" and opened.top.name in OUTSIDE and opened.places["table"]:
            opened.cut(opened.last(("table",)))
        if name in ("td", "th") and opened.top.name in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", ghost=opened.top.ghost)
            opened.top.children.append(row)
            opened.push(row)
        if opened.top.name == "head" and name not in UNSEEN | {"meta", "link", "base"}:
            opened.cut(len(opened.nodes) - 1)
        drawn = not any(name in parts and opened.places[whole] for whole, parts in UNDRAWN.items())
        node = _node(name, attributes, drawn)
        outside = name == "form" and opened.top.name in OUTSIDE and opened.places["table"]
        put(node)
        if name == "img" and node.shown and attributes.get("alt"):
            node.children.append(attributes["alt"])
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>|\Z", re.I).search(page, at)
            if node.shown and end.start() > at:
                node.children.append(entities.unescape(page[at : end.start()]))
            at = end.end()
        elif (name not in VOID and not m[3].rstrip().endswith("/") or name in BLOCKS - VOID) and not outside:
            opened.push(node)
    return root


class Lines:
    """Text under way: words of a line, and how many line ends come before the next word."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.ends = 0
        self.mark = ""

    def words(self, text: str) -> None:
        parts = text.split()
        if not parts:
            self.space = self.space or bool(text)
            return
        if text[0].isspace():
            self.space = True
        self.flush()
        if self.space and self.line:
            self.line.append(" ")
        self.line.append(" ".join(parts))
        self.space = text[-1].isspace()

    def flush(self) -> None:
        if self.ends and self.out:
            self.out.append("\n" * self.ends)
        self.ends = 0
        if self.mark:
            self.line.append(self.mark)
            self.mark, self.space = "", False

    def whole(self, text: str) -> None:
        """Text that keeps its own spaces and lines."""
        self.flush()
        self.line.append(text)

    def end(self, lines: int) -> None:
        if self.line:
            self.out.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False
        self.ends = max(self.ends, lines)

    def text(self) -> str:
        self.end(0)
        return "".join(self.out)


#: a walk hands over further walks and gets what they return, so depth takes no stack
Walk = Generator["Walk", object, object]


def _run(walk: Walk) -> object:
    """Run a walk and those that it hands over."""
    under, value = [walk], None
    while under:
        try:
            under.append(under[-1].send(value))
            value = None
        except StopIteration as end:
            under.pop()
            value = end.value
    return value


def places(text: str) -> int:
    """Places that a text takes up: two for wide characters, none for marks on others."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


#: column, columns spanned, text
Cell = tuple[int, int, str]


def _row(row: Node, above: list[tuple[int, int, int]]) -> Walk:
    """Cells of a row; ``above`` holds (column, end, rows left) of cells that reach down into it and is brought up to date."""
    cells: list[Cell] = []
    reach = [(c, e, n - 1) for c, e, n in above if n > 1]
    column, passed = 0, 0
    for c in row.children:
        if isinstance(c, str):
            text, own = "" if row.ghost else " ".join(c.split()), False
        else:
            text = " ".join((yield rendered(c)).split()) if c.shown else ""
            own = c.shown and c.name in ("td", "th")
        if not (text or own):
            continue
        while passed < len(above) and above[passed][0] <= column:
            column = max(column, above[passed][1])
            passed += 1
        columns, down = (c.columns, c.down) if own else (1, 1)
        cells.append((column, columns, text))
        if down > 1:
            reach.append((column, column + columns, down - 1))
        column += columns
    above[:] = sorted(reach)
    return cells


def _cells(table: Node) -> Walk:
    """Cells of a table's shown rows, row by row."""
    rows: list[list[Cell]] = []
    above: list[tuple[int, int, int]] = []
    for part in table.children:
        if isinstance(part, Node) and part.shown:
            if part.name == "tr":
                rows.append((yield _row(part, above)))
            elif part.name in GROUPS:
                rows += yield _cells(part)
            elif table.name in GROUPS:
                rows.append([(0, 1, " ".join((yield rendered(part)).split()))])
        elif table.name in GROUPS and isinstance(part, str) and not table.ghost:
            rows.append([(0, 1, " ".join(part.split()))])
    return rows


def _aligned(rows: list[list[Cell]]) -> Iterator[str]:
    """Rows with cells padded to their columns; columns in which no cell begins take no place."""
    rows = [row for row in rows if any(text for _, _, text in row)]
    begins = sorted({c for row in rows for c, _, _ in row})
    number = {c: i for i, c in enumerate(begins)}
    # cells of one column first, then wider ones by their last column
    wide = [0] * len(begins)
    spanning = []
    for row in rows:
        for c, columns, text in row:
            last = bisect_right(begins, c + columns - 1) - 1
            if last == number[c]:
                wide[last] = max(wide[last], places(text))
            elif text:
                spanning.append((last, number[c], places(text)))
    for last, first, need in sorted(spanning):
        wide[last] += max(0, need - sum(wide[first : last + 1]) - 2 * (last - first))
    edges = [0]
    for w in wide:
        edges.append(edges[-1] + w + 2)
    for row in rows:
        line, at = [], 0
        for c, _, text in row:
            if text:
                gap = edges[number[c]] - at
                line.append(" " * (gap if gap > 0 or not line else 2) + text)
                at += max(gap, 2 if line[1:] else 0) + places(text)
        yield "".join(line)


def _table(node: Node, lines: Lines) -> Walk:
    for part in node.children:
        if isinstance(part, str):
            if not node.ghost:
                lines.words(part)
        elif part.shown and part.name not in ("tr", "thead", "tbody", "tfoot", "colgroup"):
            yield _walk([part], lines, 0, False, node.ghost)
    for row in _aligned((yield _cells(node))):
        lines.end(1)
        lines.whole(row)
        lines.end(1)


def _walk(children: list[Node | str], lines: Lines, indent: int, exact: bool, ghost: bool) -> Walk:
    for child in children:
        if isinstance(child, str):
            if ghost:
                continue
            if exact:
                lines.whole(child)
            else:
                lines.words(child)
        elif not child.shown:
            continue
        elif child.name == "br":
            lines.flush()
            lines.end(1)
            lines.ends = 1
        elif child.name == "hr":
            lines.end(1)
            if not child.ghost:
                lines.whole("---")
            lines.end(1)
        else:
            block = child.name in BLOCKS
            # a list inside a list is not set apart
            ends = (2 if child.name in SPACED and not (indent and child.name in ("ul", "ol")) else 1) if block else 0
            if block and not lines.mark:
                lines.end(ends)
            if child.name == "table":
                yield _table(child, lines)
            elif child.name in ("ul", "ol", "menu", "dir"):
                number = child.start
                for item in child.children:
                    if isinstance(item, Node) and item.name == "li":
                        if item.shown:
                            lines.end(1)
                            lines.mark = "" if item.ghost else "  " * min(indent, INDENTS) + (f"{number}. " if child.name == "ol" else "- ")
                            yield _walk(item.children, lines, indent + 1, exact, item.ghost)
                            lines.mark = ""
                            lines.end(1)
                            number += 1
                    else:
                        yield _walk([item], lines, indent + 1, exact, child.ghost)
            else:
                if child.name == "dd" and not child.ghost:
                    lines.mark = "  " * min(indent + 1, INDENTS)
                yield _walk(child.children, lines, indent, exact or child.name in ("pre", "xmp", "listing"), child.ghost)
            if block:
                lines.end(ends)


def rendered(node: Node) -> Walk:
    """Text of what stands in an element."""
    lines = Lines()
    yield _walk(node.children, lines, 0, False, node.ghost)
    return lines.text()


def render(page: str | None) -> str | None:
    """All visible text of a page."""
    return None if page is None else str(_run(rendered(build(page))))


def extract(pages: DataFrame) -> DataFrame:
    """page_id and text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(render, batch.column(1).to_pylist()), pa.string())], ["page_id", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, text string")
