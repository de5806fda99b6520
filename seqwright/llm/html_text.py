"""HTML extraction: a tree builder with implied tags, then a layout pass that emits all visible text.

The parser reads tags, text, comments and raw-text elements in one scan, linear in the page, and builds a tree with
the end tags that HTML implies (``p`` before a block, ``li`` before ``li``, cells and rows of
tables, options, definition lists; a stray end tag is dropped, an unclosed element ends with its
parent). A cell without a row gets one; text and other elements straight inside a table or row
go before the table, as in a browser, and end where the table goes on. The layout pass leaves out
what a browser does not show (scripts, styles, templates, the head, comments, ``hidden``,
``display:none``, ``visibility:hidden`` but for what is visible again inside it, closed ``details``, the fallback in frames, ``object``,
media and ``canvas``, suggestions in ``datalist``, options that are not chosen, annotations of
formulas, and what is not text in ``svg``) and writes the rest: white space collapses except in ``pre``, blocks stand on lines of their own, and
paragraphs, headings, lists and tables have a blank line between them; list items have their
bullet or number and are indented by depth; table cells are padded to aligned columns.

Pages are independent: the operator is map-only. Nesting is walked without recursion, however deep
it is; only lists, tables and quotes are laid out apart, and beyond ``MAX_LEVELS`` of them one in another
they stand as plain blocks: all text and every rule of visibility hold there too. A page of several MB
is one string and one tree in its task.

Defined cases: null and empty html give an empty text. Repeated rows are rendered each. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = set("head script style template title noscript iframe noembed noframes datalist object audio video canvas "
             "annotation annotation-xml".split())
UNDRAWN = set("defs symbol desc metadata clippath mask pattern marker".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table pre xmp blockquote figure hr".split())
BLOCKS = SPACED | set("html body div section article nav aside header footer main address form fieldset legend li dt dd "
                      "figcaption details summary caption tr td th thead tbody tfoot hgroup search center menu dir dialog".split())
CLOSES_P = SPACED | set("div section article nav aside header footer main address form fieldset figcaption details summary "
                        "center menu dir dialog hgroup search".split())
# an element of the key ends an open one of the values, up to the barrier elements
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "input": ({"select"}, {"table"}),
    "textarea": ({"select"}, {"table"}),
    "body": ({"head"}, set()),
}
SECTIONS = {"thead", "tbody", "tfoot"}
# a part of a table ends everything up to one of the values
TABLE_PARTS = {
    **dict.fromkeys(("td", "th"), {"tr", *SECTIONS, "table"}),
    "tr": {*SECTIONS, "table"},
    **dict.fromkeys((*SECTIONS, "caption", "colgroup"), {"table"}),
    "col": {"colgroup", "table"},
}
# elements that hold only parts of a table, and those that may stand there beside them
TABLE_LEVELS = {"table", "tr", "colgroup", *SECTIONS}
IN_TABLE = {*TABLE_PARTS, "script", "style", "template"}
MAX_LEVELS = 100   # nested lists, tables and quotes that are laid out as such; deeper ones as plain blocks

OPEN = re.compile(r"<(?:!--|[!?]|(/?)(?=[A-Za-z]))")
NAME = re.compile(r"[^\s/>]*")
GAP = re.compile(r"[\s/]*")
BLANK = re.compile(r"\s*")
ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
BARE = re.compile(r"[^\s>]*")
SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


class Scanner:
    """The tags of a page in order, in time linear in its length. A quote opens a value only right after ``=`` and if
    it is closed somewhere. A tag that no ``>`` ends outside a value ends at the first one; without any
    ``>`` it is text. Places from which a scan ran into the end of the page are not scanned again."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        self.dead: set[int] = set()

    def next(self, at: int):
        """(start, end, name, attributes or None for an end tag, whether it closes itself) of the next tag; the name is
        empty for comments and the like. None if there is none."""
        page = self.page
        while True:
            m = OPEN.search(page, at)
            if m is None:
                return None
            if m[0] == "<!--":
                end = page.find("-->", m.end())
                return m.start(), len(page) if end < 0 else end + 3, "", None, False
            if m.start() > self.last:   # nothing ends it
                at = m.end()
                continue
            if m[1] is None:
                return m.start(), page.index(">", m.end()) + 1, "", None, False
            name = NAME.match(page, m.end())
            if m[1]:
                return m.start(), page.index(">", name.end()) + 1, name[0].lower(), None, False
            return m.start(), *self._start(name[0].lower(), name.end())

    def _start(self, name: str, i: int):
        page, n, first = self.page, len(self.page), i
        found: dict[str, str] = {}
        passed = []
        while True:
            gap = GAP.match(page, i)
            i = gap.end()
            if i >= n or i in self.dead:
                self.dead.update(passed)
                return page.index(">", first) + 1, name, {}, False
            if page[i] == ">":
                return i + 1, name, found, "/" in gap[0]
            passed.append(i)
            m = ATTRIBUTE.match(page, i)
            key, value = m[0].lower(), ""
            j = BLANK.match(page, m.end()).end()
            i = m.end()
            if j < n and page[j] == "=":
                j = BLANK.match(page, j + 1).end()
                if j < n and page[j] in "\"'" and self.quotes[page[j]] > j:
                    i = page.index(page[j], j + 1)
                    value, i = page[j + 1:i], i + 1
                else:
                    m = BARE.match(page, j)
                    value, i = m[0], m.end()
            found.setdefault(key, entities.unescape(value) if "&" in value else value)


def parse(page: str) -> Node:
    """The tree of a page; text nodes are strings."""
    root = Node("#root")
    stack = [root]
    opened: Counter[str] = Counter()   # open elements by tag: most searches end before they begin

    def push(node: Node) -> None:
        stack.append(node)
        opened[node.tag] += 1

    def cut(i: int) -> None:
        for x in stack[i:]:
            opened[x.tag] -= 1
        del stack[i:]

    def close(tags: set[str], barriers: set[str]) -> None:
        """Ends the open elements of ``tags`` above the innermost barrier; one may be open in another (a cell in a row)."""
        while any(opened[t] for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    cut(i)
                    break
                if stack[i].tag in barriers:
                    return

    def nearest(tags: set[str]) -> int:
        """Position of the innermost open element of ``tags``, 0 if there is none in this template."""
        if any(opened[t] for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    return i
                if stack[i].tag == "template":
                    break
        return 0

    def insert(node: Node | str) -> None:
        """Into the open element; what may not stand straight in a table goes before the table."""
        top = stack[-1]
        if top.tag in TABLE_LEVELS and not (not node.strip() if isinstance(node, str) else node.tag in IN_TABLE or hidden(node)):
            i = nearest({"table"})
            if i:
                if top.tag == "colgroup":
                    cut(len(stack) - 1)
                before = stack[i - 1].kids  # its last element is the open table
                before.insert(len(before) - 1, node)
                return
        top.kids.append(node)

    at, n, tags = 0, len(page), Scanner(page)
    while at < n:
        got = tags.next(at)
        if got is None:
            insert(entities.unescape(page[at:]))
            break
        start, end, tag, attrs, closed = got
        if start > at:
            insert(entities.unescape(page[at:start]))
        at = end
        if attrs is not None:
            if tag in CLOSES_P:
                close({"p"}, {"td", "th", "li", "table", "button", "object", "caption"})
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            if tag in TABLE_PARTS and nearest({"table"}):
                cut(nearest(TABLE_PARTS[tag]) + 1)
                if tag in ("td", "th") and stack[-1].tag != "tr":
                    row = Node("tr")
                    stack[-1].kids.append(row)
                    push(row)
            elif stack[-1].tag in TABLE_LEVELS and nearest({"table"}):
                if tag == "form":
                    continue  # holds nothing there
                if tag == "table":
                    cut(nearest({"table"}))
            node = Node(tag, attrs)
            insert(node)
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at, tags.last + 1) if at <= tags.last else None
                body = page[at:stop.start()] if stop else page[at:]
                node.kids.append(entities.unescape(body) if tag in ("textarea", "title") else body)
                at = stop.end() if stop else n
            elif tag not in VOID and not closed:
                push(node)
        elif tag == "br":
            insert(Node("br"))
        elif tag and opened[tag]:
            barrier = "table" if tag not in ("table", "html", "body") else None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    cut(i)
                    break
                if stack[i].tag == barrier and tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
                    break
    return root


def hidden(node: Node) -> bool:
    if node.tag in UNSEEN:
        return True
    a = node.attrs
    if not a:
        return False
    if "hidden" in a or node.tag == "input" and a.get("type", "").lower() == "hidden":
        return True
    return "style" in a and "display:none" in re.sub(r"\s+", "", a["style"].lower())


def visible(node: Node, inherited: bool) -> bool:
    """Whether the node's own text shows; unlike ``hidden`` elements, those below may show themselves again."""
    if "style" in node.attrs:
        said = re.findall(r"visibility:(visible|hidden|collapse)", re.sub(r"\s+", "", node.attrs["style"].lower()))
        if said:
            return said[-1] == "visible"
    return inherited


class Writer:
    """Lines of text with pending white space: a gap of 0 (same line), 1 (new line) or 2 (blank line)."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0

    def break_(self, gap: int) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False
        self.gap = max(self.gap, gap)

    def _begin(self) -> None:
        if not self.line and self.gap:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.gap = 0

    def text(self, s: str) -> None:
        parts = SPACE.split(s)
        for i, p in enumerate(parts):
            if i and self.line:
                self.space = True
            if p:
                self._begin()
                if self.space and self.line:
                    self.line.append(" ")
                self.space = False
                self.line.append(p)

    def newline(self) -> None:
        self._begin()
        self.lines.append("".join(self.line).rstrip(" "))
        self.line, self.space = [], False

    def raw(self, s: str) -> None:
        """Preformatted text; a space that is pending before it is written."""
        first, *rest = s.replace("\r\n", "\n").split("\n")
        if first:
            self._begin()
            self.line.append(first)
        for x in rest:
            self.newline()
            if x:
                self.line.append(x)

    def block(self, lines: list[str], gap: int) -> None:
        if lines:
            self.break_(gap)
            self._begin()
            self.lines.extend(lines)
            self.gap = max(1, gap)

    def result(self) -> list[str]:
        self.break_(0)
        return self.lines


def width(s: str) -> int:
    """Columns of a string: wide characters take two, combining ones none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def span(value: str | None, most: int = 1000) -> int:
    return max(1, min(most, int(value))) if value and value.isdecimal() and len(value) < 6 else 1


def rows_of(table: Node):
    for kid in table.kids:
        if isinstance(kid, Node) and not hidden(kid):
            if kid.tag == "tr":
                yield kid
            elif kid.tag in ("thead", "tbody", "tfoot"):
                yield from (r for r in kid.kids if isinstance(r, Node) and r.tag == "tr" and not hidden(r))


class Counts:
    def __init__(self):
        self.blocks = self.items = self.tables = 0


_END = object()


def render(nodes, w: Writer, counts: Counts, depth: int = 0, pre: bool = False, shown: bool = True, level: int = 0) -> None:
    """Writes nodes. Plain elements are walked with a stack of our own, so nesting may be as deep as it likes; ``level``
    counts lists, tables and other elements that are laid out apart."""
    open_ = [(iter(nodes), None, depth, pre, shown)]
    while open_:
        kids, after, depth, pre, shown = open_[-1]
        node = next(kids, _END)
        if node is _END:
            open_.pop()
            if after is not None:
                after()
            continue
        if isinstance(node, str):
            if shown:
                w.raw(node) if pre else w.text(node)
            continue
        if hidden(node):
            continue
        tag, see = node.tag, visible(node, shown)
        apart = level < MAX_LEVELS
        if tag in ("br", "wbr", "hr", "img", "input", "select", "textarea", "svg"):
            if see:
                atom(node, w, counts, depth, level)
        elif tag == "table" and apart:
            counts.tables += 1
            table(node, w, counts, depth, see, level + 1)
        elif tag in ("ul", "ol", "menu", "dir") and apart:
            listing(node, w, counts, depth, see, level + 1)
        elif tag == "details" and "open" not in node.attrs:
            w.break_(1)
            first = [k for k in node.kids if isinstance(k, Node) and k.tag == "summary"][:1]
            open_.append((iter(first), lambda: w.break_(1), depth + 1, pre, see))
        elif tag in BLOCKS:
            gap = 2 if tag in SPACED else 1
            counts.blocks += 1
            w.break_(gap)
            if tag in ("dd", "blockquote") and apart:
                sub = Writer()
                render(node.kids, sub, counts, depth + 1, pre, see, level + 1)
                w.block(["  " + x if x else x for x in sub.result()], gap)
                w.break_(gap)
            else:
                open_.append((iter(node.kids), lambda gap=gap: w.break_(gap), depth + 1, pre or tag in ("pre", "xmp"), see))
        else:
            quoted = tag == "q" and see
            if quoted:
                w.text('"')
            open_.append((iter(node.kids), (lambda: w.text('"')) if quoted else None, depth + 1, pre, see))


def atom(node: Node, w: Writer, counts: Counts, depth: int, level: int) -> None:
    """Elements that show something of their own."""
    tag = node.tag
    if tag == "br":
        w.newline()
    elif tag == "hr":
        w.break_(2)
    elif tag == "img":
        w.text(node.attrs.get("alt", ""))
    elif tag == "input":
        if node.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text"):
            w.text(" " + node.attrs.get("value", "") + " ")
    elif tag == "select":
        w.text(" ")
        for option in chosen(node):
            if option.attrs.get("label"):
                w.text(option.attrs["label"])
            else:
                nested(option.kids, w, counts, depth + 1, level)
            w.text(" ")
    elif tag == "textarea":
        w.break_(1)
        render([re.sub(r"\A\r?\n", "", k) for k in node.kids], w, counts, depth + 1, True)
        w.break_(1)
    elif tag == "svg":
        w.text(" ")
        for drawn in drawn_text(node):
            nested(drawn.kids, w, counts, depth + 1, level)
            w.text(" ")


def nested(nodes, w: Writer, counts: Counts, depth: int, level: int) -> None:
    """Content of a control or a drawing; beyond ``MAX_LEVELS`` of them its plain text."""
    if level < MAX_LEVELS:
        render(nodes, w, counts, depth, level=level + 1)
    else:
        todo = list(reversed(nodes))
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                w.text(node)
            elif not hidden(node):
                todo.extend(reversed(node.kids))


def within(node: Node, tags: set[str], skip: set[str]):
    """The outermost elements of ``tags`` below a node, in order, not inside ``skip`` or hidden ones."""
    open_ = [iter(node.kids)]
    while open_:
        kid = next(open_[-1], _END)
        if kid is _END:
            open_.pop()
        elif isinstance(kid, Node) and kid.tag not in skip and not hidden(kid):
            if kid.tag in tags:
                yield kid
            else:
                open_.append(iter(kid.kids))


def drawn_text(svg: Node):
    return within(svg, {"text", "foreignobject"}, UNDRAWN)


def chosen(select: Node) -> list[Node]:
    """The options that a select shows: all in a list box, else the last selected or the first enabled."""
    options = list(within(select, {"option"}, set()))
    if "multiple" in select.attrs or span(select.attrs.get("size")) > 1:
        return options
    picked = [o for o in options if "selected" in o.attrs]
    return picked[-1:] or [o for o in options if "disabled" not in o.attrs][:1]


def listing(node: Node, w: Writer, counts: Counts, depth: int, shown: bool, level: int) -> None:
    lines: list[str] = []
    number = int(node.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1
    for kid in node.kids:
        if isinstance(kid, Node) and hidden(kid):
            continue
        sub = Writer()
        if isinstance(kid, Node) and kid.tag == "li":
            counts.items += 1
            if re.fullmatch(r"-?\d{1,9}", kid.attrs.get("value", "")):
                number = int(kid.attrs["value"])
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            see = visible(kid, shown)
            render(kid.kids, sub, counts, depth + 1, False, see, level)
            got = sub.result()
            if not see:   # no mark; what shows inside it does
                lines.extend(" " * len(mark) + x if x else x for x in got)
                continue
            got = got or [""]
            lines.append((mark + got[0]).rstrip())
            lines.extend(" " * len(mark) + x if x else x for x in got[1:])
        else:
            render([kid], sub, counts, depth + 1, False, shown, level)
            lines.extend("  " + x if x else x for x in sub.result())
    # lists inside a list need no blank lines around them
    w.block(lines, 2 if depth == 0 or not w.line else 1)


def table(node: Node, w: Writer, counts: Counts, depth: int, shown: bool, level: int) -> None:
    for kid in node.kids:
        if isinstance(kid, Node) and kid.tag == "caption" and not hidden(kid):
            w.break_(2)
            render(kid.kids, w, counts, depth + 1, False, visible(kid, shown), level)
            w.break_(1)
    grid: list[list[tuple[int, list[str]]]] = []
    taken: dict[tuple[int, int], bool] = {}
    for r, row in enumerate(rows_of(node)):
        cells, c = [], 0
        for kid in row.kids:
            if isinstance(kid, str) or hidden(kid):
                continue
            while taken.pop((r, c), False):
                c += 1
            sub = Writer()
            of_row = visible(row, shown)
            if kid.tag in ("td", "th"):
                render(kid.kids, sub, counts, depth + 1, False, visible(kid, of_row), level)
            else:
                render([kid], sub, counts, depth + 1, False, of_row, level)
            lines = sub.result()
            cells.append((c, lines))
            wide = span(kid.attrs.get("colspan"), 100)
            for down in range(1, span(kid.attrs.get("rowspan"), 100)):
                for x in range(c, c + wide):
                    taken[r + down, x] = True
            c += wide
        grid.append(cells)
    columns = sorted({c for cells in grid for c, _ in cells})
    wide = {c: max((width(x) for cells in grid for k, lines in cells if k == c for x in lines), default=0) for c in columns}
    out: list[str] = []
    for cells in grid:
        got = dict(cells)
        for i in range(max((len(x) for x in got.values()), default=0)):
            parts = []
            for c in columns:
                x = got.get(c, [])
                s = x[i] if i < len(x) else ""
                parts.append(s + " " * (wide[c] - width(s)))
            out.append(" | ".join(parts).rstrip(" |") if any(p.strip() for p in parts) else "")
    w.block(out, 2)


def to_text(page: str | None) -> tuple[str, Counts]:
    counts, w = Counts(), Writer()
    if page:
        render(parse(page).kids, w, counts)
    lines = w.result()
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines), counts


RESULT = "page_id bigint, text string, n_chars bigint, n_lines bigint, n_blocks bigint, n_items bigint, n_tables bigint"


def extract(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """Per page: page_id, text, and counts of characters, lines, blocks, list items and tables."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                rows = []
                for i, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    text, n = to_text(page)
                    rows.append((i, text, len(text), text.count("\n") + 1 if text else 0, n.blocks, n.items, n.tables))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                    names=["page_id", "text", "n_chars", "n_lines", "n_blocks", "n_items", "n_tables"])

    return pages.select(F.col(id_col).cast("bigint"), F.col(html)).mapInArrow(run, RESULT)
