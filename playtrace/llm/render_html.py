"""Visible text of HTML pages, laid out in lines.

A tree is built with the implied tags of HTML: an open ``p`` ends before a block, an
``li`` before the next ``li``, cells and rows before their like, and so on; end tags without
a start are passed over, and those in a cell do not reach beyond it. A row is implied around
bare cells; text and other elements found in a table but in none of its cells stand before
it. Hidden parts are left out by tag, by attribute and by inline style.
The tree is then rendered: inline text with single spaces, blocks on lines of their own,
paragraphs, lists and tables with an empty line around them, list items with their
mark and indent, table cells in columns of equal width. Text areas show their text, option lists what is
chosen. Only inline styles count, and everything in a hidden element is hidden, whatever its own style; the
text of a cell that spans columns widens its first one.

Open elements and open steps of the rendering are on stacks of their own, so nesting of any
depth is kept. Steps are generators that yield the steps inside them, see ``_run``.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from playtrace.llm.tables import keyed

# The element names of HTML by their part in layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset(
    "script style head title meta link template noscript iframe object embed audio video canvas svg "
    "datalist input map area base param source track noembed noframes".split()
)
PARAGRAPH = frozenset("p blockquote ul ol dl table pre h1 h2 h3 h4 h5 h6 figure hr".split())
BLOCK = PARAGRAPH | frozenset(
    "address article aside body center details dialog dd div dt fieldset figcaption footer form "
    "header hgroup html legend li main menu nav option search section summary "
    "caption thead tbody tfoot tr td th colgroup".split()
)
#: An open element of the set ends where the tag starts, if none of the walls is between.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "td", "th", "caption", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "td", "th", "caption", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "td", "th", "caption", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table", "template"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table", "template"}),
    "caption": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table", "template"}),
    "colgroup": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table", "template"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table", "template"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table", "template"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table", "template"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table", "template"}),
}
#: A block of this set ends an open paragraph.
ENDS_P = BLOCK - frozenset("li dt dd option caption thead tbody tfoot tr td th colgroup html body".split())
_WALLS_P = frozenset("td th caption table button object html".split())
_GROUPS = frozenset("thead tbody tfoot".split())
#: Where the parts of a table stand; what is open inside of that ends before them.
_PLACE = {
    **dict.fromkeys(("td", "th"), _GROUPS | {"tr", "table"}),
    "tr": _GROUPS | {"table"},
    **dict.fromkeys((*_GROUPS, "caption", "colgroup"), frozenset({"table"})),
}
#: Elements that hold parts of a table and no text.
_FRAMES = _GROUPS | {"table", "tr", "colgroup"}
#: Elements that may stand there; they show nothing of their own.
_IN_FRAMES = _PLACE.keys() | {"col", "form", "script", "style", "template"}
_CELLS = frozenset("td th caption table template".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
#: The end of a tag, or a name and its value: quoted, behind a quote that is never closed, or unquoted.
_ATTRIBUTE = re.compile(
    r"[ \t\n\r\f/]*+(?:(>)|(=?[^ \t\n\r\f/>=]*+)"
    r"(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:\"([^\"]*+)\"|'([^']*+)'|([\"'])|([^ \t\n\r\f>]*+)))?+)"
)
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_BLANK = re.compile(r"[ \t\n\r\f\v]{2,}|[\t\n\r\f\v]")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(page: str, at: int) -> tuple[dict[str, str], int] | None:
    """The attributes from ``at`` on and the place behind the tag; None if the page ends before.

    A quote opens a value only right behind the equals sign; elsewhere it is a character
    like others.
    """
    out: dict[str, str] = {}
    while True:
        found = _ATTRIBUTE.match(page, at)
        at = found.end()
        end, name, double, single, unclosed, bare = found.groups()
        if end:
            return out, at
        if unclosed or not name:
            return None
        value = double or single or bare or ""
        out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)


def _is_hidden(node: Node) -> bool:
    a = node.attrs
    return (
        node.tag in HIDDEN
        or "hidden" in a
        or a.get("aria-hidden", "").lower() == "true"
        or (node.tag == "dialog" and "open" not in a)
        or ("style" in a and bool(_HIDDEN_STYLE.search(a["style"])))
    )


class _Open:
    """The open elements, outermost first, and the places of each tag among them."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and what is open inside it."""
        for node in self.stack[place:]:
            self.places[node.tag].pop()
        del self.stack[place:]

    def last(self, tags) -> int:
        """Place of the innermost open element of ``tags``; 0, the root's, without one."""
        return max((at[-1] for tag in tags if (at := self.places.get(tag))), default=0)

    def end_first(self, tags, walls) -> None:
        """Close the outermost open element of ``tags`` above the last wall."""
        wall = self.last(walls)
        found = [at[i] for tag in tags if (at := self.places.get(tag)) and (i := bisect_right(at, wall)) < len(at)]
        if found:
            self.cut(min(found))

    def end_last(self, tag: str) -> None:
        """What the end tag of ``tag`` closes; it does not reach beyond its cell or table."""
        if not self.places.get(tag):
            return
        walls = {"table", "template"} if tag in _FRAMES or tag in _CELLS else _CELLS
        place = self.last((tag,))
        if place > self.last(walls - {tag}):
            self.cut(place)

    def table(self) -> int:
        """Place of the table whose frame is innermost; 0 outside of tables and in their cells."""
        if not self.places.get("table"):
            return 0
        place = self.last(("table",))
        return place if place > self.last(("td", "th", "caption", "template")) else 0

    def add(self, child) -> None:
        """Append to the innermost element, or before its table if that takes no text."""
        if self.stack[-1].tag == "colgroup" and self.table():
            self.cut(len(self.stack) - 1)
        inner = self.stack[-1]
        if inner.tag in _FRAMES and (place := self.table()):
            # A table stays its parent's last child while it is open.
            siblings = self.stack[place - 1].children
            siblings.insert(len(siblings) - 1, child)
        else:
            inner.children.append(child)

    def add_text(self, text: str) -> None:
        if self.stack[-1].tag in _FRAMES and not text.strip():
            return
        self.add(text)


def build(page: str) -> Node:
    """The tree of a page below a node of its own."""
    root = Node("#root", {})
    open_ = _Open(root)
    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            open_.add_text(html.unescape(page[at:]))
            break
        if begin > at:
            open_.add_text(html.unescape(page[at:begin]))
        found = _TOKEN.match(page, begin)
        if found is None:
            open_.add_text("<")
            at = begin + 1
            continue
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        scanned = _attributes(page, at)
        if scanned is None:
            break  # the page ends inside a tag
        attributes, at = scanned
        if found[1]:
            if tag == "br":
                open_.add(Node("br", {}))
            else:
                open_.end_last(tag)
            continue
        if tag in IMPLIED_END:
            open_.end_first(*IMPLIED_END[tag])
        if tag in ENDS_P:
            open_.end_first({"p"}, _WALLS_P)
        node = Node(tag, attributes)
        place = open_.table()
        if place and tag == "table":
            open_.cut(place)  # no table stands in the frame of another
            place = 0
        if place and tag in _PLACE:
            open_.cut(open_.last(_PLACE[tag]) + 1)
            if tag in ("td", "th") and open_.stack[-1].tag != "tr":
                row = Node("tr", {})
                open_.stack[-1].children.append(row)
                open_.push(row)
        if place and tag in _IN_FRAMES and open_.stack[-1].tag in _FRAMES:
            open_.stack[-1].children.append(node)
            if tag == "form":
                continue  # it ends at once, and the table goes on
        else:
            open_.add(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            node.children.append(page[at : close.start() if close else n])
            at = close.end() if close else n
        elif tag not in VOID:
            open_.push(node)
    return root


class _Lines:
    """Lines of text with the blank lines between them still to be decided."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False

    def text(self, piece: str) -> None:
        self.inline.append(piece)

    def flush(self) -> None:
        if self.inline:
            line = _BLANK.sub(" ", "".join(self.inline)).strip(" ")
            self.inline = []
            if line:
                self.line(line)

    def break_line(self) -> None:
        """The end of a line; without text since the last one, an empty line."""
        if "".join(self.inline).strip():
            self.flush()
        else:
            self.inline = []
            self.gap = bool(self.lines)

    def line(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)

    def space(self) -> None:
        self.flush()
        self.gap = True

    def block(self, lines: list[str]) -> None:
        for line in lines:
            if line:
                self.line(line)
            elif self.lines:
                self.gap = True


def _width(text: str) -> int:
    return sum(
        0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text
    ) if not text.isascii() else len(text)


def _items(node: Node):
    return (c for c in node.children if isinstance(c, Node))


def _number(text: str | None, default: int) -> int:
    """A list number; one beyond 32 bits is the last that fits, as in browsers."""
    found = re.match(r"[ \t\n\r\f]*([+-]?)0*([0-9]+)", text or "")
    if not found:
        return default
    value = int(found[2]) if len(found[2]) < 12 else 1 << 31
    return max(-(1 << 31), -value) if found[1] == "-" else min((1 << 31) - 1, value)


def _span(text: str | None) -> int:
    """Rows or columns of a cell; only the first nine digits of a number are looked at."""
    found = re.match(r"[ \t\n\r\f]*\+?0*([0-9]{1,9})", text or "")
    return max(1, int(found[1])) if found else 1


def _run(step):
    """The result of a generator; what it yields are generators whose results it gets back."""
    stack, result = [step], None
    while stack:
        try:
            inner = stack[-1].send(result)
        except StopIteration as done:
            stack.pop()
            result = done.value
        else:
            stack.append(inner)
            result = None
    return result


def _list(node: Node, out: _Lines):
    number = _number(node.attrs.get("start"), 1)
    loose = Node("#loose", {})
    for child in [*node.children, Node("#end", {})]:
        if not isinstance(child, Node) or child.tag not in BLOCK and child.tag != "#end":
            loose.children.append(child)
            continue
        if loose.children:
            # Text and inline elements between the items are lines of their own.
            lines = yield _render(loose)
            out.block(["  " + x if x else "" for x in lines])
            loose = Node("#loose", {})
        if child.tag == "#end" or _is_hidden(child):
            continue
        lines = yield _render(child)
        if child.tag == "li":
            if node.tag == "ol":
                number = _number(child.attrs.get("value"), number)
                mark = f"{number}. "
                number += 1
            else:
                mark = "- "
            body = [x for x in lines] or [""]
            out.line((mark + body[0]).rstrip())
            out.block([" " * len(mark) + x if x else "" for x in body[1:]])
        else:
            out.block(["  " + x if x else "" for x in lines])


def _chosen(select: Node) -> list[str]:
    """What a list of options shows: all of a multiple one, else the last selected option or the first."""
    options, stack = [], [iter(select.children)]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif isinstance(child, Node) and not _is_hidden(child):
            if child.tag == "option":
                options.append(child)
            else:
                stack.append(iter(child.children))
    if "multiple" not in select.attrs:
        options = ([o for o in options if "selected" in o.attrs] or options[:1])[-1:]
    return [_BLANK.sub(" ", _plain(o)).strip(" ") for o in options]


def _rows(node: Node):
    for child in _items(node):
        if _is_hidden(child):
            continue
        if child.tag == "tr":
            yield [c for c in _items(child) if c.tag in ("td", "th") and not _is_hidden(c)]
        elif child.tag in _GROUPS:
            yield from _rows(child)


def _table(node: Node, out: _Lines):
    for child in _items(node):
        if child.tag == "caption" and not _is_hidden(child):
            out.block((yield _render(child)))
    grid: dict[tuple[int, int], list[str]] = {}
    widths: dict[int, int] = {}
    # Columns held by cells of earlier rows: first, end, and the row where they are free again.
    held: list[tuple[int, int, int]] = []
    height = 0
    for r, cells in enumerate(_rows(node)):
        held = [x for x in held if x[2] > r]
        longer = []
        c = at = 0
        for cell in cells:
            while at < len(held) and held[at][0] <= c:
                c = max(c, held[at][1])
                at += 1
            down, right = _span(cell.attrs.get("rowspan")), _span(cell.attrs.get("colspan"))
            lines = yield _render(cell)
            grid[r, c] = [x for x in lines if x]
            widths[c] = max([widths.get(c, 0), *map(_width, grid[r, c])])
            if down > 1:
                longer.append((c, c + right, r + down))
            c += right
        if longer:
            held = sorted(held + longer)
        height = r + 1
    # Columns without text take no room, so spans are as long as they say.
    used = sorted(c for c, width in widths.items() if width)
    for r in range(height):
        depth = max((len(grid.get((r, c), ())) for c in used), default=0)
        for i in range(depth):
            parts = []
            for c in used:
                lines = grid.get((r, c), ())
                piece = lines[i] if i < len(lines) else ""
                parts.append(piece + " " * (widths[c] - _width(piece)))
            out.line(" | ".join(parts).rstrip(" "))


def _walk(node: Node, out: _Lines):
    for child in node.children:
        if not isinstance(child, Node):
            out.text(child)
            continue
        tag = child.tag
        if _is_hidden(child):
            continue
        if tag == "br":
            out.break_line()
        elif tag == "textarea":
            out.flush()
            out.block([x.rstrip() for x in html.unescape(_plain(child)).removeprefix("\n").split("\n")])
        elif tag == "select":
            out.text(f" {' '.join(_chosen(child))} ")
        elif tag == "hr":
            out.space()
        elif tag == "img":
            if child.attrs.get("alt"):
                out.text(f" {child.attrs['alt']} ")
        elif tag not in BLOCK:
            yield _walk(child, out)
        else:
            out.space() if tag in PARAGRAPH else out.flush()
            if tag in ("ul", "ol", "menu"):
                yield _list(child, out)
            elif tag == "table":
                yield _table(child, out)
            elif tag == "pre":
                for line in _plain(child).strip("\n").split("\n"):
                    out.line(line.rstrip()) if line.strip() else out.space()
            elif tag in ("blockquote", "dd"):
                lines = yield _render(child)
                out.block(["  " + x if x else "" for x in lines])
            else:
                yield _walk(child, out)
            out.space() if tag in PARAGRAPH else out.flush()


def _plain(node: Node) -> str:
    out: list[str] = []
    stack = [iter(node.children)]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif not isinstance(child, Node):
            out.append(child)
        elif child.tag == "br":
            out.append("\n")
        elif not _is_hidden(child):
            stack.append(iter(child.children))
    return "".join(out)


def _render(node: Node):
    out = _Lines()
    yield _walk(node, out)
    out.flush()
    return out.lines


def visible_text(page: str | None) -> str:
    """The text of one page; empty for null and for pages without visible text."""
    return "\n".join(_run(_render(build(page or ""))))


def _texts(batches):
    for batch in batches:
        texts = [visible_text(x) for x in batch.column("t").to_pylist()]
        lines = [x.count("\n") + 1 if x else 0 for x in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("k"),
                batch.column("row"),
                pa.array(texts, pa.string()),
                pa.array(lines, pa.int64()),
            ],
            names=["k", "row", "text", "n_lines"],
        )


def render_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``k`` (id), ``row`` (struct of the other columns), ``text``, ``n_lines`` of each page.

    Null and empty pages, and pages whose content is all hidden, have an empty text and no
    lines. Text that is no HTML is one paragraph. A page that ends inside a tag ends before
    it. Spans and depth have no limit; a line is indented, and copied, once per quote and list
    around it, so what those cost grows with their depth. Repeated rows are rendered alike.
    """
    work = keyed(pages, id_col, html_col)
    schema = work.select("k", "row").schema.add("text", "string").add("n_lines", "long")
    return work.mapInArrow(_texts, schema)
