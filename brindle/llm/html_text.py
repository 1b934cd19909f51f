"""Text of HTML pages as a browser lays it out."""

from __future__ import annotations

import html
import re
from bisect import bisect, bisect_left
from collections.abc import Generator, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import bound_batches

#: Blanks that a table may be padded with, for each character of its text, besides ``SPARE``. Beyond that its
#: widest columns are narrowed, and what follows a cell that is wider goes to a line below.
BLANKS, SPARE = 4, 2000
#: Fixed values of the standard: the most columns and rows that a cell spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
#: Elements that are never shown.
UNSEEN = frozenset("head script style template noscript noembed noframes iframe title datalist audio video canvas".split())
#: Elements that start and end a line, and those of them that also have a blank line around them.
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure fieldset hr".split())
BLOCK = APART | frozenset("address article aside body center details dialog dd div dt figcaption footer form header hgroup html legend li main nav option optgroup search section summary caption".split())
#: What a start tag closes, and what it doesn't look beyond.
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
_SCOPE = frozenset("table td th caption template html".split())
_SECTION = frozenset("thead tbody tfoot caption tr td th".split())
_IMPLIED = {
    "li": (frozenset(["li"]), _SCOPE | frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), _SCOPE | frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), _SCOPE | frozenset(["dl"])),
    "option": (frozenset(["option"]), _SCOPE | frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), _SCOPE | frozenset(["select"])),
    "rt": (frozenset(["rt", "rp"]), _SCOPE | frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), _SCOPE | frozenset(["ruby"])),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table", "html"])),
    "th": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table", "html"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table", "thead", "tbody", "tfoot", "html"])),
    "thead": (_SECTION, frozenset(["table", "html"])),
    "tbody": (_SECTION, frozenset(["table", "html"])),
    "tfoot": (_SECTION, frozenset(["table", "html"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
#: What may stand in a head; anything else, and text, ends it.
_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
#: Fixed values of the standard: HTML elements that end the pictures and formulas around them.
_BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Elements with rules of their own, and those within them that hold HTML again.
_FOREIGN, _HOSTS = frozenset(["svg", "math"]), frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=>/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TELLING = re.compile(r"hidden|style|span|type|start|open", re.I)
_GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
_BARE_VALUE = re.compile(r"=\s*[^\s\"'>=]*/$")
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element: its name, the attributes that matter here, and its children, texts among them."""

    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text, start with its attributes, single (a start without content), or end.

    Linear in the length of any input. A slash at the end of a tag counts only within pictures and
    formulas, where the content of scripts and the like is markup.
    """
    at, n, raw = 0, len(source), ""
    inside: list[str] = []  # pictures, formulas and what holds HTML in them
    missing = set()  # quotes that don't occur any more
    while at < n:
        if raw:
            m = re.compile(rf"</{raw}(?=[\s/>])", re.I).search(source, at)
            end = m.start() if m else n
            if end > at:
                yield "text", raw, source[at:end]
            at, raw = end, ""
            if not m:
                return
        lt = source.find("<", at)
        if lt < 0:
            yield "text", "", source[at:]
            return
        if lt > at:
            yield "text", "", source[at:lt]
        after = source[lt + 1 : lt + 2]
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 2)
            at = n if end < 0 else end + 3
            continue
        if after in ("!", "?"):
            end = source.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        closing = after == "/"
        m = _NAME.match(source, lt + 1 + closing)
        if not m:
            if closing and lt + 2 < n:  # a comment, by the rules
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "", "<"
                at = lt + 1
            continue
        i = m.end()
        while True:
            stop = _STOP.search(source, i)
            if not stop:
                i = n
                break
            i = stop.start()
            quote = source[i]
            if quote == ">":
                break
            if quote not in missing and source[m.end() : i].rstrip().endswith("="):
                j = source.find(quote, i + 1)
                if j >= 0:
                    i = j + 1
                    continue
                missing.add(quote)
            i += 1
        name = m.group().lower()
        at = i + 1
        if closing:
            if inside and name in inside[-2:]:
                while inside.pop() != name:
                    pass
            yield "end", name, ""
            continue
        rest = source[m.end() : i]
        if inside and inside[-1] in _FOREIGN and name in _BREAKS_OUT:
            yield "end", inside[0], ""
            inside.clear()
        foreign = bool(inside) and inside[-1] in _FOREIGN
        if (foreign or name in _FOREIGN) and rest.endswith("/") and not _BARE_VALUE.search(rest):
            yield "single", name, rest
            continue
        yield "start", name, rest
        if name in _FOREIGN or foreign and name in _HOSTS:
            inside.append(name)
        elif name in RAW and not foreign:
            raw = name


def attributes(rest: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    if _TELLING.search(rest):
        for m in _ATTRIBUTE.finditer(rest):
            out.setdefault(m.group(1).lower(), html.unescape(m.group(2) or m.group(3) or m.group(4) or ""))
    return out


def tree(source: str) -> Node:
    """The page's tree, with implied end tags and table rows. Linear in the length of any input, however deep."""
    root = Node("html")
    stack = [root]
    open_at = {"html": [0]}  # places in the stack by tag

    def push(node: Node) -> None:
        open_at.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(place: int) -> None:
        while len(stack) > place:
            open_at[stack.pop().tag].pop()

    def innermost(tags: frozenset) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def close(tags: frozenset, stops: frozenset) -> None:
        """Closes up to the outermost of the tags that is open within the stops."""
        found = [places for t in tags if (places := open_at.get(t))]
        if found:
            stop = innermost(stops)
            found = [places[i] for places in found if (i := bisect(places, stop)) < len(places)]
            if found:
                cut(min(found))

    def add(node: Node) -> None:
        stack[-1].kids.append(node)

    paragraph = frozenset(["p"])
    started = False  # whether a head or anything after it has begun
    for kind, name, rest in tokens(source):
        if stack[-1].tag == "head" and (rest.strip(" \t\n\r\f") if kind == "text" else name in ("body", "html", "br") if kind == "end" else name not in _HEAD):
            cut(len(stack) - 1)
        if kind == "text":
            started = started or bool(rest.strip(" \t\n\r\f"))
            stack[-1].kids.append(rest if name in ("script", "style", "xmp") or "&" not in rest else html.unescape(rest))
        elif kind == "end":
            if name == "br":
                add(Node("br"))
                continue
            if name == "p" and not open_at.get("p"):
                add(Node("p"))
                continue
            stops = frozenset(["table", "html"]) if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else frozenset() if name in ("table", "body", "html") else _SCOPE
            places = open_at.get(name)
            if places and places[-1] and places[-1] >= innermost(stops):
                cut(places[-1])
        else:
            if name == "html" or name == "head" and started:
                continue
            started = True
            if name in _CLOSES_P:
                close(paragraph, _SCOPE)
            if name in _IMPLIED:
                close(*_IMPLIED[name])
            if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr")
                add(row)
                push(row)
            node = Node(name, attributes(rest) if rest else None)
            add(node)
            if kind == "start" and name not in VOID:
                push(node)
    return root


def seen(node: Node) -> bool:
    """Whether an element takes part in the layout, by its name, ``hidden`` and its style."""
    if node.tag in UNSEEN or node.tag == "dialog" and "open" not in node.attrs:
        return False
    a = node.attrs
    return not a or not ("hidden" in a or "style" in a and _GONE.search(a["style"]) or node.tag == "input" and a.get("type", "").lower() == "hidden")


#: How text is shown, as bits: preformatted, and invisible, which an element within can take back.
PRE, INVISIBLE = 1, 2


def mode_in(node: Node, mode: int) -> int:
    """How the text of an element is shown, given that of the element around it."""
    found = _VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else ()
    if not found or found[-1].lower() not in ("hidden", "collapse", "visible", "initial"):
        return mode
    return mode | INVISIBLE if found[-1].lower() in ("hidden", "collapse") else mode & ~INVISIBLE


#: A line as the blanks it is set in by and its text, so that levels of lists don't copy it.
Line = tuple[int, str]


class Flow:
    """Lines of a block: texts run together with single blanks, blocks start lines, margins collapse."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.line: list[str] = []
        self.blank = self.gap = self.item = False

    def text(self, s: str) -> None:
        if s[0] in " \t\n\r\f":
            self.blank = True
        words = _BLANKS.split(s.strip(" \t\n\r\f"))
        if words[0]:
            if self.blank and self.line:
                self.line.append(" ")
            self.line.append(" ".join(words))
            self.blank = s[-1] in " \t\n\r\f"

    def add(self, s: str, mode: int) -> None:
        if mode & INVISIBLE:
            return
        if mode & PRE:
            self.literal(s)
        elif s:
            self.text(s)

    def end_line(self, always: bool = False) -> None:
        if self.line or always:
            self.put(0, "".join(self.line).replace("\xa0", " ").rstrip())
            self.line = []
        self.blank = False

    def put(self, by: int, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append((0, ""))
        self.gap = False
        self.lines.append((by, line) if line else (0, ""))

    def block(self, apart: bool) -> None:
        self.end_line()
        self.gap = self.gap or apart

    def literal(self, s: str) -> None:
        first, *more = s.split("\n")
        self.line.append(first)
        for x in more:
            self.end_line(True)
            self.line.append(x)

    def hang(self, mark: str, lines: list[Line]) -> None:
        """Puts lines with a mark before the first and the others below its text."""
        for i, (by, line) in enumerate(lines):
            if i or not line:
                self.put(by + len(mark), line)
            else:
                self.put(0, mark + " " * by + line)

    def done(self) -> list[Line]:
        self.end_line()
        while self.lines and not self.lines[-1][1]:
            self.lines.pop()
        return self.lines


#: A step of the walk: it yields the steps that it needs the results of.
Step = Generator


def walk(step: Step) -> object:
    """Runs a step and those it yields on a stack of its own, so that no depth of a page is too much."""
    stack, result = [step], None
    while stack:
        try:
            inner = stack[-1].send(result)
        except StopIteration as e:
            stack.pop()
            result = e.value
        else:
            stack.append(inner)
            result = None
    return result


LISTS = frozenset(["ul", "ol", "menu", "dir"])


def lines_of(node: Node, mode: int = 0) -> Step:
    out = Flow()
    out.item = node.tag == "li"
    yield flow(node, out, mode_in(node, mode))
    return out.done()


def listed(node: Node, out: Flow, mode: int) -> Step:
    """A list: a mark before each item, and its other lines below the first."""
    number = int(node.attrs["start"]) if node.attrs.get("start", "").removeprefix("-").isdecimal() else 1
    rest = Flow()
    for kid in node.kids:
        if isinstance(kid, Node) and kid.tag == "li":
            if not seen(kid):
                continue
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            lines = yield lines_of(kid, mode)
            if lines:
                rest.end_line()
            rest.hang(mark, lines)
        elif isinstance(kid, str):
            rest.add(kid, mode)
        else:
            yield one(kid, rest, mode)
    for by, line in rest.done():
        out.put(by, line)


def rows_of(node: Node, mode: int) -> Iterator[tuple[int, Node, int]]:
    """The rows of a table: the number of their group, which no cell spans beyond, the row, and how its text is shown."""
    group = 0
    todo = [(node, iter(node.kids), mode)]
    while todo:
        within, kids, mode = todo[-1]
        kid = next(kids, None)
        if kid is None:
            todo.pop()
            group += 1
        elif isinstance(kid, Node) and seen(kid):
            if kid.tag == "tr":
                yield group, kid, mode_in(kid, mode)
            elif kid.tag in ("thead", "tbody", "tfoot"):
                group += 1
                todo.append((kid, iter(kid.kids), mode_in(kid, mode)))


def _span(cell: Node, name: str, most: int) -> int:
    """What a cell spans; a rowspan of 0 goes to the end of the group."""
    value = cell.attrs.get(name, "").strip()
    if not value.isdecimal():
        return 1
    n = int(value[:9])
    return min(n, most) if n else most if name == "rowspan" else 1


def strays(node: Node, mode: int) -> Iterator[tuple[Node | str, int]]:
    """What is in a table and not in a cell, and how its text is shown."""
    todo = [(iter(node.kids), mode)]
    while todo:
        kids, mode = todo[-1]
        kid = next(kids, None)
        if kid is None:
            todo.pop()
        elif isinstance(kid, Node) and kid.tag in ("thead", "tbody", "tfoot", "tr"):
            if seen(kid):
                todo.append((iter(kid.kids), mode_in(kid, mode)))
        elif not (isinstance(kid, Node) and kid.tag in ("td", "th")):
            yield kid, mode


#: A cell: its first column, the one after its last, and its lines.
Cell = tuple[int, int, list[str]]


class Grid:
    """Which columns the cells of rows above still take, as ranges, so that spans of any size cost nothing."""

    def __init__(self) -> None:
        self.group, self.row = -1, 0
        self.taken: list[tuple[int, int, int]] = []  # first column, end, last row; by first column

    def start(self, group: int) -> None:
        """Begins a row."""
        if group != self.group:
            self.group, self.taken = group, []
        self.row += 1
        self.taken = [x for x in self.taken if x[2] >= self.row]
        self.column, self.at, self.new = 0, 0, []

    def place(self, wide: int, high: int) -> int:
        """The column of the row's next cell."""
        while self.at < len(self.taken) and self.taken[self.at][0] <= self.column:
            self.column = max(self.column, self.taken[self.at][1])
            self.at += 1
        column = self.column
        self.column += wide
        if high > 1:
            last = self.row + high - 1
            if self.new and self.new[-1][1:] == (column, last):
                self.new[-1] = (self.new[-1][0], self.column, last)
            else:
                self.new.append((column, self.column, last))
        return column

    def end(self) -> None:
        """Ends a row."""
        if self.new:
            self.taken = sorted(self.taken + self.new)


def _places(cells: list[tuple[int, int, int]], most: int) -> dict[int, int]:
    """Where columns begin, so that each cell (end, first column, width up to ``most``) and two blanks fit in before the column at its end."""
    place, at, seen = {}, 0, 0
    starts = sorted({first for _, first, _ in cells})
    for end, first, wide in cells:  # by end
        while seen < len(starts) and starts[seen] < end:
            place[starts[seen]] = at
            seen += 1
        at = max(at, place[first] + min(wide, most) + 2)
    return place


def _segments(row: list[Cell], i: int, place: dict[int, int]) -> Iterator[list[tuple[int, str]]]:
    """The i-th line of a row's cells, as lines of (place, text): a cell that its neighbour's text reaches over stands below."""
    line, end = [], 0
    for first, _, lines in row:
        if i < len(lines) and lines[i]:
            at = place[first]
            if line and at < end + 2:
                yield line
                line = []
            line.append((at, lines[i]))
            end = at + len(lines[i])
    if line:
        yield line


def aligned(rows: list[list[Cell]]) -> Iterator[str]:
    """Lines of a table whose cells stand in columns of their widest line."""
    high = [max((len(lines) for _, _, lines in row), default=0) for row in rows]
    cells = sorted((end, first, max(map(len, lines), default=0)) for row in rows for first, end, lines in row)
    bound = SPARE + BLANKS * sum(len(x) for row in rows for _, _, lines in row for x in lines)
    most = max((wide for _, _, wide in cells), default=0)
    while True:
        place = _places(cells, most)
        blanks = sum(line[-1][0] for row, n in zip(rows, high, strict=True) for i in range(n) for line in _segments(row, i, place))
        if blanks <= bound or not most:
            break
        most //= 2
    for row, n in zip(rows, high, strict=True):
        for i in range(n):
            if blanks > bound:  # even narrow columns are too many for the text in them: cells stand two blanks apart
                yield "  ".join(lines[i] for _, _, lines in row if i < len(lines) and lines[i])
                continue
            for parts in _segments(row, i, place):
                line, end = [], 0
                for at, text in parts:
                    line += [" " * (at - end), text]
                    end = at + len(text)
                yield "".join(line)


def table(node: Node, out: Flow, mode: int) -> Step:
    """A table: what isn't in a cell first, then rows of cells in columns of their widest line."""
    for kid, how in strays(node, mode):
        if isinstance(kid, str):
            out.add(kid, how)
        else:
            yield one(kid, out, how)
    out.end_line()
    grid = Grid()
    rows: list[list[Cell]] = []
    for group, row, how in rows_of(node, mode):
        here = []
        grid.start(group)
        for kid in row.kids:
            if not (isinstance(kid, Node) and kid.tag in ("td", "th") and seen(kid)):
                continue
            wide, high = _span(kid, "colspan", MOST_COLUMNS), _span(kid, "rowspan", MOST_ROWS)
            column = grid.place(wide, high)
            lines = [" " * by + line for by, line in (yield lines_of(kid, how))]
            here.append((column, column + wide, lines))
        grid.end()
        rows.append(here)
    for line in aligned(rows):
        out.put(0, line)


def one(kid: Node, out: Flow, mode: int) -> Step:
    """Adds an element to the flow."""
    if not seen(kid):
        return
    tag = kid.tag
    mode = mode_in(kid, mode)
    if tag == "br":
        out.end_line(True)
    elif tag == "input":
        if kid.attrs.get("type", "").lower() in ("submit", "button", "reset") and kid.attrs.get("value") and not mode & INVISIBLE:
            out.text(f" {kid.attrs['value']} ")
    elif tag in BLOCK:
        apart = tag in APART and not (out.item and tag in LISTS)  # a list in an item stands close
        out.block(apart)
        if tag in LISTS:
            yield listed(kid, out, mode)
        elif tag == "table":
            yield table(kid, out, mode)
        elif tag in ("blockquote", "dd"):
            for by, line in (yield lines_of(kid, mode)):
                out.put(by + 2, line)
        elif tag in ("pre", "xmp", "listing"):
            inner = Flow()
            yield flow(kid, inner, mode | PRE)
            lines = inner.done()
            for by, line in lines[1:] if lines and not lines[0][1] else lines:
                out.put(by, line)
        elif tag == "li":
            out.hang("- ", (yield lines_of(kid, mode)))
        else:
            yield flow(kid, out, mode)
        out.block(apart)
    elif tag in ("td", "th"):
        out.text(" ")
        yield flow(kid, out, mode)
        out.text(" ")
    elif tag == "textarea":
        out.block(False)
        if not mode & INVISIBLE:
            out.literal("".join(k for k in kid.kids if isinstance(k, str)).removeprefix("\n"))
        out.block(False)
    else:
        yield flow(kid, out, mode)


def flow(node: Node, out: Flow, mode: int) -> Step:
    for kid in node.kids:
        if isinstance(kid, str):
            out.add(kid, mode)
        else:
            yield one(kid, out, mode)


def _find(node: Node, tag: str) -> Node | None:
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag == tag:
            return x
        todo += [k for k in reversed(x.kids) if isinstance(k, Node)]
    return None


def _count(node: Node, tags: frozenset) -> int:
    n, todo = 0, [(node, 0)]
    while todo:
        x, mode = todo.pop()
        if seen(x):
            mode = mode_in(x, mode)
            n += x.tag in tags and not mode & INVISIBLE
            todo += [(k, mode) for k in x.kids if isinstance(k, Node)]
    return n


def extract(source: str | None) -> tuple[str, str, int, int]:
    """Title, visible text, and the numbers of list items and tables that are shown."""
    source = (source or "").replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    root = tree(source)
    title = _find(root, "title")
    name = " ".join("".join(k for k in title.kids if isinstance(k, str)).split()) if title else ""
    return name, "\n".join(" " * by + line for by, line in walk(lines_of(root))).strip("\n"), _count(root, frozenset(["li"])), _count(root, frozenset(["table"]))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = [extract(x) for x in part.column("html").to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), *columns, pa.array([len(r[1]) for r in rows], pa.int64())], ["page_id", "title", "text", "n_items", "n_tables", "n_chars"])


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, title, text, n_items, n_tables and n_chars of each page.

    A tree builder applies implied start and end tags (head, paragraphs, list items, table parts) and
    passes over broken markup as browsers do. What is not shown is left out: head, scripts, styles,
    templates, closed dialogs, ``hidden``, ``display: none`` and, unless an element within is visible
    again, ``visibility: hidden``; style sheets are not read, and closed details count as shown. Blocks
    start lines, paragraphs, headings, lists and tables stand apart by a blank line, items have marks and
    hang below them, and preformatted text keeps its blanks. No text that is shown is dropped.

    The cells of a column stand below each other at any width. Only where a table would be padded with
    more than ``BLANKS`` blanks for each character of its text are its widest columns narrowed; what
    follows a cell that is wider than its column then stands on a line below, in its own column. So the
    text of a page is bounded by its size, whatever its spans.

    Defined results: a null or empty page has empty texts, and so has a page of any length without
    visible text; an empty table of pages gives no rows; a null page_id is kept; each row is read alone,
    so repeated rows repeat, and other columns, whatever their names, are left out; elements count at
    any depth, and each list or quote around a line sets it in further; a page of any length is read whole.
    """
    bound_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(_extracted, "page_id bigint, title string, text string, n_items bigint, n_tables bigint, n_chars bigint")
