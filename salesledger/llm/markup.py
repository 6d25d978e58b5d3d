"""HTML extraction by layout-aware rendering.

A tree builder that knows void elements, raw text and implied end tags turns a page into a tree; a renderer walks it and
emits all visible text: collapsed inline space, line breaks and blank lines between blocks, bullets and numbers of
lists with indentation, preformatted text as it is, and table cells padded to aligned columns, over several columns or rows where
a cell spans them. Text and elements that stand in a table but in no cell (stray text, or what follows a table that is never closed) are
lines of their own at their place. Text of drawings (svg) is emitted. Elements are not displayed by their kind, by the hidden attribute, by
inline style, or by a rule of the page's own style sheets, whatever its length, whose selector names a tag, classes and ids of
one element (div.a#b); the most specific and then the last rule holds, inline style before all. Visibility is inherited, so a visible element
inside a hidden one is emitted. Selectors that name several elements (.a .b) hide nothing.

Work and output are linear in the page: a line longer than WIDE widens no column, a row whose padding would exceed WIDE characters for
each line of its cells (and SPARE more) is written cell under cell, and of the cells that reach down into a row the SPANS leftmost keep their columns. Neither
building nor walking recurses on nesting depth (tables nested deeper than MAX_TABLES are laid out as plain blocks).

Defined cases: a null page gives a null text, an empty one an empty text; broken markup is text or closed where it must be; repeated
rows are rendered each. Input columns that share a name with a result column are replaced by the result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from salesledger.llm import textops as ops

MAX_TABLES = 8
WIDE = 48
SPARE = 4
SPANS = 64

#: Fixed values of the HTML standard: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
HIDDEN = frozenset("head script style template noscript iframe object audio video canvas datalist title".split())
#: Parts of a drawing that may hold text; nothing else in a drawing is text.
DRAWN = frozenset("svg g a switch text foreignobject".split())
#: Most columns and rows of a cell.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside header footer nav main address form details summary dialog figcaption li dt dd tr caption thead tbody tfoot legend option optgroup center".split()
)
#: What a table is made of; anything else directly inside one of these (but a caption or cell) is stray.
PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th form".split())
#: An opening tag closes these open elements, up to the nearest boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
CLOSES_P = (SPACED | frozenset("address article aside details div dl footer form header main nav section li dd dt".split())) - {"table"}

NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
ATTR = re.compile(r"[\s/]*([^\s=>/\"'][^\s=>/]*)?(?:\s*=\s*)?")
BARE = re.compile(r"[^\s>]*")
BRACE = re.compile(r"[{}]")
COMPOUND = re.compile(r"(?:[A-Za-z][\w-]*)?(?:[.#][\w-]+)*$")
PART = re.compile(r"[.#]?[\w-]+")
DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*([a-z-]+)", re.I)
VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


def _attributes(page: str, at: int, dead: set[str]) -> tuple[dict[str, str], int]:
    """Attributes from `at`, and the place after the tag. dead: quotes that do not occur any more."""
    out: dict[str, str] = {}
    while at < len(page) and page[at] != ">":
        m = ATTR.match(page, at)
        name, stop = m[1], m.end()
        value = ""
        if stop < len(page) and "=" in m[0]:
            quote = page[stop] if page[stop] in "\"'" else ""
            end = page.find(quote, stop + 1) if quote and quote not in dead else -1
            if quote and end < 0:
                dead.add(quote)
            if end >= 0:
                value, stop = page[stop + 1 : end], end + 1
            else:
                m = BARE.match(page, stop)
                value, stop = m[0], m.end()
        if name:
            out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
        at = stop if stop > at else at + 1
    return out, at + 1


def build(page: str) -> Node:
    """The tree of a page."""
    root = Node("#root")
    stack, at, n, dead = [root], 0, len(page), set()
    places: dict[str, list[int]] = {}  # of open tags in the stack

    def add_text(text: str) -> None:
        if text:
            stack[-1].kids.append(html.unescape(text) if "&" in text else text)

    def cut(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()

    def close(tags: set[str] | frozenset[str], bounds: set[str]) -> None:
        """Close the outermost of these tags inside the innermost bound, and all in it."""
        bound = max((places[b][-1] for b in bounds if places.get(b)), default=0)
        inside = [places[t] for t in tags if places.get(t) and places[t][-1] > bound]
        if inside:
            cut(min(p[bisect_right(p, bound)] for p in inside))

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add_text(page[at:])
            break
        add_text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = NAME.match(page, lt + 1)
        if not m:
            add_text("<")
            at = lt + 1
            continue
        if m[0][0] == "/":
            tag = m[0][1:].lower()
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            if tag == "br":
                stack[-1].kids.append(Node("br"))
            elif places.get(tag):
                cut(places[tag][-1])
            continue
        tag = m[0].lower()
        attrs, at = _attributes(page, m.end(), dead)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in CLOSES_P:
            close({"p"}, {"td", "th", "table", "button"})
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            inner = page[at : end.start() if end else n]
            node.kids.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            close_at = page.find(">", end.end()) if end else -1
            at = n if close_at < 0 else close_at + 1
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
    return root


def _walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [k for k in reversed(node.kids) if isinstance(k, Node)]


def _rules(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and body of each innermost rule, of any length."""
    since, opened = 0, -1
    for m in BRACE.finditer(sheet):
        if m[0] == "{":
            since, opened = opened + 1 if opened >= 0 else since, m.start()
        else:
            if opened >= 0:
                yield sheet[since:opened], sheet[opened + 1 : m.start()]
            since, opened = m.end(), -1


def _declared(body: str) -> tuple[bool | None, bool | None]:
    """Whether declarations display an element, and whether they make it visible; None if they don't say."""
    shown, seen = DISPLAY.findall(body), VISIBILITY.findall(body)
    return (shown[-1].lower() != "none" if shown else None), (seen[-1].lower() == "visible" if seen else None)


class _Styles:
    """What the style sheets of a page say about display and visibility. Each rule is kept under its rarest part."""

    def __init__(self, root: Node):
        rules: dict[frozenset[str], list] = {}  # parts: [rank, displayed, rank, visible]
        for node in _walk(root):
            if node.tag == "style":
                for names, body in _rules("".join(k for k in node.kids if isinstance(k, str))):
                    said = _declared(body)
                    if said == (None, None):
                        continue
                    for name in map(str.strip, names.split(",")):
                        if name and COMPOUND.match(name):
                            parts = frozenset(x if x[0] in ".#" else x.lower() for x in PART.findall(name))
                            ids, classes = (sum(x[0] == c for x in parts) for c in "#.")
                            old = rules.setdefault(parts, [(), None, (), None])
                            for k, value in enumerate(said):
                                if value is not None:
                                    old[2 * k : 2 * k + 2] = (ids, classes, len(parts), len(rules)), value
        uses = Counter(x for parts in rules for x in parts)
        self.by: dict[str, list] = {}
        for parts, said in rules.items():
            self.by.setdefault(min(parts, key=lambda x: (uses[x], x)), []).append((parts, said))

    def of(self, node: Node) -> tuple[bool | None, bool | None]:
        if not self.by:
            return None, None
        a = node.attrs
        have = {node.tag, "#" + a.get("id", ""), *("." + c for c in a.get("class", "").split())}
        best: list = [(), None, (), None]
        for name in have:
            for parts, said in self.by.get(name, ()):
                if parts <= have:
                    for k in (0, 2):
                        if said[k] > best[k]:
                            best[k : k + 2] = said[k : k + 2]
        return best[1], best[3]


def _shown(node: Node, styles: _Styles, seen: bool) -> tuple[bool, bool]:
    """Whether a node is displayed, and whether its own text is visible, in a parent whose text is visible if `seen`."""
    a = node.attrs
    if node.tag in HIDDEN or (node.tag == "dialog" and "open" not in a):
        return False, seen
    display, visible = styles.of(node)
    if display is None and "hidden" in a:
        display = False
    if "style" in a:
        own = _declared(a["style"])
        display, visible = (y if x is None else x for x, y in zip(own, (display, visible)))
    return display is not False, seen if visible is None else visible


class _Lines:
    """Text with pending breaks: collapsed space inside lines, at most one blank line between blocks."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks, self.space, self.indent, self.mark = 0, False, 0, ""

    def brk(self, n: int) -> None:
        if self.parts:
            self.breaks = max(self.breaks, n)
        self.space = False

    def start(self) -> None:
        if self.breaks or not self.parts:
            self.parts.append("\n" * self.breaks + " " * max(0, self.indent - len(self.mark)) + self.mark)
            self.breaks, self.mark = 0, ""
        elif self.space:
            self.parts.append(" ")
        self.space = False

    def text(self, s: str) -> None:
        words = SPACE.sub(" ", s)
        core = words.strip(" ")
        if words[:1] == " " and not self.breaks and self.parts:
            self.space = True
        if core:
            self.start()
            self.parts.append(core)
            self.space = words[-1] == " "

    def raw(self, s: str) -> None:
        for k, line in enumerate(s.split("\n")):
            if k:
                self.breaks = max(1, self.breaks + 1) if self.parts else 0
            if line:
                self.start()
                self.parts.append(line)


def _parts(node: Node, row: list | None) -> list[tuple[Node, list | None]]:
    """Kids of a part of a table, each with the row it is in; runs of whatever belongs in no table become one #stray node."""
    out: list[tuple[Node, list | None]] = []
    for kid in node.kids:
        if isinstance(kid, Node) and kid.tag in PARTS:
            out.append((kid, row))
        else:
            if not out or out[-1][0].tag != "#stray":
                out.append((Node("#stray"), row))
            out[-1][0].kids.append(kid)
    return out


def _span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "").strip()
    n = int(value.lstrip("0")[:6] or 0) if value.isascii() and value.isdecimal() else 1
    return min(n, most) if n else (most if name == "rowspan" else 1)


def _columns(grid: list[list[tuple[list[str], int, int]]]) -> list[list[int]]:
    """The first column of each cell: the next one that no cell from above reaches into."""
    out, down = [], []  # down: first and last column of cells from above, and rows they still have
    for row in grid:
        firsts, at, k, fresh = [], 0, 0, []
        for _, columns, rows in row:
            while k < len(down) and down[k][0] <= at:
                at = max(at, down[k][1] + 1)
                k += 1
            firsts.append(at)
            if rows > 1:
                fresh.append((at, at + columns - 1, rows - 1))
            at += columns
        out.append(firsts)
        if down or fresh:
            down = sorted([(a, b, n - 1) for a, b, n in down if n > 1] + fresh[:SPANS])[:SPANS]
    return out


def _row(row: list[tuple[list[str], int, int]], starts: list[int]) -> list[str]:
    """The lines of a row whose cells start at these characters, or further right where the line is full."""
    lines: list[list[tuple[int, str]]] = [[] for _ in range(max((len(c[0]) for c in row), default=0))]
    for (cell, _, _), start in zip(row, starts):
        for k, line in enumerate(cell):
            if line:
                lines[k].append((start, line))
    out, padding = [], 0
    room = WIDE * (sum(len(c[0]) for c in row) + SPARE)
    for pieces in lines:
        line, length = [], 0
        for start, piece in pieces:
            pad = max(start - length, 2 if length else 0)
            padding += pad
            if padding > room:
                return [x for c, _, _ in row for x in c if x]
            line += (" " * pad, piece)
            length += pad + len(piece)
        out.append("".join(line).rstrip())
    return out


def _table(node: Node, styles: _Styles, depth: int, seen: bool) -> list[str]:
    """Rows of a table with cells padded to the width of their column; stray content gives lines of its own, which widen no column."""
    rows: list[list[tuple[list[str], int, int]] | tuple[list[str]]] = []
    caption: list[str] = []
    todo = [(*x, seen) for x in _parts(node, None)[::-1]]
    while todo:
        kid, row, above = todo.pop()
        if kid.tag == "#stray":
            ahead = row is not None and not row and rows[-1] is row  # of the first cell
            rows.insert(len(rows) - ahead, (render(kid, styles, depth + 1, above).split("\n"),))
            continue
        shown, visible = _shown(kid, styles, above)
        if not shown:
            continue
        if kid.tag == "caption":
            caption += render(kid, styles, depth + 1, visible).split("\n")
        elif kid.tag in ("td", "th"):
            if row is None:
                rows.append(row := [])
            lines = render(kid, styles, depth + 1, visible).split("\n")
            row.append((lines, _span(kid, "colspan", MOST_COLUMNS), _span(kid, "rowspan", MOST_ROWS)))
        else:
            if kid.tag == "tr":
                rows.append(row := [])
            todo += [(*x, visible) for x in _parts(kid, row)[::-1]]
    grid = [r for r in rows if isinstance(r, list)]
    firsts = _columns(grid)
    width: dict[int, int] = {}
    for row, first in zip(grid, firsts):
        for (lines, columns, _), k in zip(row, first):
            if columns == 1:
                width[k] = max(width.get(k, 0), max((len(x) for x in lines if len(x) <= WIDE), default=0))
    columns = sorted(width)
    starts = [0, *accumulate(width[k] + 2 for k in columns)]
    out, placed = [c for c in caption if c], iter(firsts)
    for r in rows:
        if isinstance(r, tuple):
            out += r[0] if any(r[0]) else []
            continue
        first = next(placed)
        if any(any(c[0]) for c in r):
            out += _row(r, [starts[bisect_left(columns, k)] for k in first])
    return out


def render(root: Node, styles: _Styles, depth: int = 0, seen: bool = True) -> str:
    """Visible text below a node."""
    out = _Lines()
    lists: list[list] = []
    pre = 0
    todo: list = [(k, False, seen, False) for k in reversed(root.kids)]  # drawn: directly in a drawing, where only some elements are text
    while todo:
        node, leaving, visible, drawn = todo.pop()
        if isinstance(node, str):
            if not visible:
                out.text(" ")  # it still keeps words apart
            elif pre:
                out.raw(node)
            else:
                out.text(node)
            continue
        tag = node.tag
        if leaving:
            if tag in ("ul", "ol"):
                out.indent -= lists.pop()[1]
            elif tag == "pre":
                pre -= 1
            elif tag == "blockquote":
                out.indent -= 2
            elif tag == "li":
                out.mark = ""
            out.brk(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
            continue
        shown, visible = _shown(node, styles, visible)
        if not shown:
            continue
        if tag == "svg" or drawn:
            out.text(" ")
            todo.append((" ", False, visible, False))
            drawn = tag not in ("text", "foreignobject")
            kids = [k for k in node.kids if isinstance(k, Node) and k.tag in DRAWN] if drawn else node.kids
            todo += [(k, False, visible, drawn) for k in reversed(kids)]
            continue
        if tag == "br":
            out.breaks, out.space = (out.breaks + 1 if out.parts else 0), False
            continue
        if tag in BLOCK:
            out.brk(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
            if tag == "table" and depth < MAX_TABLES:
                for line in _table(node, styles, depth, visible):
                    out.brk(1)
                    out.start()
                    out.parts.append(line)
                out.brk(2)
                continue
            if tag in ("ul", "ol"):
                lists.append([int(node.attrs["start"]) if node.attrs.get("start", "").isdecimal() else 1, 2 if tag == "ul" else 3, tag])
                out.indent += lists[-1][1]
            elif tag == "li":
                out.mark = "" if not visible else "- " if not lists or lists[-1][2] == "ul" else f"{lists[-1][0]}. "
                if lists:
                    lists[-1][0] += 1
            elif tag == "pre":
                pre += 1
            elif tag == "blockquote":
                out.indent += 2
            todo.append((node, True, visible, False))
        elif tag in ("td", "th"):
            out.space = True
        todo += [(k, False, visible, False) for k in reversed(node.kids)]
    return "".join(out.parts)


def extract(page: str | None) -> tuple[str | None, str | None]:
    """Title and visible text of a page."""
    if page is None:
        return None, None
    root = build(page)
    title = next(("".join(k for k in x.kids if isinstance(k, str)) for x in _walk(root) if x.tag == "title"), None)
    return title and SPACE.sub(" ", title).strip(" "), render(root, _Styles(root))


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """`pages` without the markup column, with title and text."""
    made = ["title", "text"]
    keep = [c for c in pages.columns if c not in {*made, column}]
    plain = pages.select(*keep, column)
    schema = T.StructType([*(plain.schema[c] for c in keep), *(T.StructField(c, T.StringType()) for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            offs = ops.flat(whole.column(len(keep)))[1]
            for a, b in ops.pieces(offs):
                batch = whole.slice(a, b - a)
                rows = [extract(p) for p in batch.column(len(keep)).to_pylist()]
                cols = [pa.array([r[k] for r in rows], pa.string()) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], schema.names)

    return plain.mapInArrow(run, schema)
