"""HTML to text as it is laid out: a tree with implied tags, visibility rules, blocks, lists and aligned tables.

``parse`` builds the tree: void elements, raw text, and the tags that authors
leave out (``p``, ``li``, ``dt``, ``td``, ``tr``, ``option`` and the end of
``head``). ``render`` walks it: hidden elements go, white space collapses
outside ``pre``, blocks start lines, paragraphs and headings stand apart by an
empty line, list items get their marker and hang under it, table cells of a
column start below one another. Of a closed ``details`` the summary shows; what
is invisible by ``visibility`` may hold visible parts. All visible text comes
out, laid out the same at any depth: the walk keeps its own stack.

Cells of a column are aligned to its widest cell. Only where that would make a
table more than ``PADDING`` times as long as its text (one very long cell beside
thousands of rows) are columns padded less, to the widest measure that keeps
to it.

Cases: null and empty pages give an empty text; text without tags is a
paragraph; unclosed comments, quotes and tags end with the page; repeated rows
get one result each. Columns beside id and page are not looked at.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Generator, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsky.llm.common import fresh, table

#: Characters of padding for each character of a table's text, at most; small tables are always aligned.
PADDING = 64
SMALL_TABLE = 1_000_000

# Element names by what the standard says of them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes noscript textarea title plaintext".split())
HIDDEN = set(
    "head title meta link base script style template noscript iframe object embed datalist audio video canvas map param source "
    "track noembed noframes".split()
)
HEAD_ONLY = set("title meta link base script style template noscript noframes html head".split())
APART = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset menu dir".split())
BLOCK = APART | set(
    "address article aside body caption center dd details dialog div dt figcaption footer form header hgroup html legend li main nav "
    "option search section summary tbody td tfoot th thead tr".split()
)
CLOSES_P = BLOCK - set("body html td th tr tbody thead tfoot caption option legend li dd dt".split()) | {"li", "dd", "dt"}
#: What a start tag ends implicitly, and the elements beyond which it does not look.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
}
LISTS = {"ul", "ol", "menu", "dir"}
ROWS = {"tbody", "thead", "tfoot"}

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\b", re.I)


class Element:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes' text): kinds are text, start, end, raw."""
    at, n = 0, len(page)
    missing: set[str] = set()  # what does not occur any more, so as not to look for it again

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        place = page.find(what, start)
        if place < 0:
            missing.add(what)
        return place

    lowered = ""
    while at < n:
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:], ""
            return
        if start > at:
            yield "text", page[at:start], ""
        if page.startswith("<!--", start):
            end = find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = find(">", start)
            at = n if end < 0 else end + 1
            continue
        name = _NAME.match(page, start)
        if not name:
            yield "text", "<", ""
            at = start + 1
            continue
        place = name.end()
        while True:
            stop = _STOP.search(page, place)
            if stop is None:
                at = n
                break
            if stop[0] == ">":
                at = stop.end()
                break
            close = find(stop[0], stop.end())
            place = stop.end() if close < 0 else close + 1
        tag = name[1].lower()
        if page[start + 1] == "/":
            yield "end", tag, ""
            continue
        yield "start", tag, page[name.end() : at].rstrip(">")
        if tag in RAW:
            if not lowered:
                lowered = page.lower() if len(page.lower()) == n else page
            end = lowered.find(f"</{tag}", at)
            if end < 0:
                end = n
            yield "raw", page[at:end], ""
            at = end


def parse(page: str) -> Element:
    """The tree of a page; its root stands above html."""
    root = Element("#root", {})
    stack = [root]
    opened: Counter = Counter()  # how many of each are on the stack, so as not to look for what is not there

    def close_to(names: set[str], beyond: set[str]) -> None:
        if not any(opened[name] for name in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                for element in stack[i:]:
                    opened[element.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in beyond:
                return

    def push(tag: str, attributes: dict[str, str]) -> Element:
        element = Element(tag, attributes)
        stack[-1].children.append(element)
        stack.append(element)
        opened[tag] += 1
        return element

    def leave_head() -> None:
        if any(e.tag == "head" for e in stack[:4]):
            close_to({"head"}, set())

    for kind, name, rest in tokens(page):
        if kind == "text":
            if name.strip():
                leave_head()
            stack[-1].children.append(html.unescape(name) if "&" in name else name)
        elif kind == "raw":
            stack[-1].children.append(html.unescape(name) if stack[-1].tag in ("textarea", "title") else name)
        elif kind == "end":
            if name == "br":
                stack[-1].children.append(Element("br", {}))
            elif name == "p" and not opened["p"]:
                stack[-1].children.append(Element("p", {}))
            elif name not in VOID:
                inside = set() if name in ("table", "html", "body") else {"table"}
                if name not in {"td", "th", "tr", "table", "caption", *ROWS}:
                    inside |= {"td", "th"}
                close_to({name}, inside - {name})
        else:
            attributes = {}
            if "=" in rest or rest.strip(" /"):
                for m in _ATTRIBUTE.finditer(rest):
                    attributes.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
            if name not in HEAD_ONLY:
                leave_head()
            if name in ("html", "body") and opened[name]:
                continue
            if name in CLOSES_P:
                close_to({"p"}, {"table", "td", "th", "caption", "button", "object"})
            if name in IMPLIED_END:
                names, beyond = IMPLIED_END[name]
                if name == "tr" or name in ROWS:
                    close_to({"td", "th"}, beyond)
                for _ in range(3 if name in ROWS else 1):
                    close_to(names, beyond)
            if name in ("td", "th") and stack[-1].tag in ({"table"} | ROWS):
                push("tr", {})
            if name in VOID:
                stack[-1].children.append(Element(name, attributes))
            else:
                push(name, attributes)
    return root


def displayed(element: Element) -> bool:
    """Whether an element takes part in the layout at all."""
    a = element.attributes
    if element.tag in HIDDEN or "hidden" in a or (element.tag == "dialog" and "open" not in a):
        return False
    return not ("style" in a and _NO_DISPLAY.search(a["style"]))


class Mode(NamedTuple):
    """What an element inherits: whether white space is kept, and whether text shows."""

    pre: bool = False
    shown: bool = True

    def inside(self, element: Element, pre: bool = False) -> Mode:
        told = _VISIBILITY.findall(element.attributes["style"]) if "style" in element.attributes else []
        shown = told[-1].lower() == "visible" if told else self.shown
        return Mode(self.pre or pre, shown)


Step = Generator["Step", Any, Any]


def run(step: Step) -> Any:
    """Result of a step that yields the steps it waits for: calls of any depth on a stack of our own."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


class Writer:
    """Lines of a block under construction: collapses white space and keeps at most one empty line between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = False

    def text(self, text: str) -> None:
        collapsed = _SPACE.sub(" ", text)
        if collapsed.startswith(" ") and (not self.parts or self.parts[-1].endswith((" ", "\n"))):
            collapsed = collapsed[1:]
        if collapsed:
            self.parts.append(collapsed)

    def plain(self, text: str) -> None:
        self.parts.append(text)

    def line_break(self) -> None:
        if self.parts and self.parts[-1].endswith(" "):
            self.parts[-1] = self.parts[-1].rstrip(" ")
        self.parts.append("\n")

    def end_block(self, apart: bool = False) -> None:
        """Finish the line; with ``apart`` an empty line comes before what follows."""
        text = "".join(self.parts)
        self.parts = []
        if text.strip():
            self.add([x.rstrip() for x in text.rstrip().split("\n")])
        if apart and self.lines:
            self.gap = True

    def add(self, lines: list[str]) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        self.lines += lines


def _number(text: str, default: int, most: int = 1000) -> int:
    digits = re.match(r"\s*(\d{1,9})", text)
    return min(most, int(digits[1])) if digits else default


def _blocks(element: Element, mode: Mode) -> Step:
    """The lines of an element's children."""
    writer = Writer()
    yield _walk(element, writer, mode)
    writer.end_block()
    return writer.lines


def _children(element: Element) -> list:
    """What of an element is laid out: of closed details the first summary."""
    if element.tag == "details" and "open" not in element.attributes:
        return [x for x in element.children if not isinstance(x, str) and x.tag == "summary"][:1]
    return element.children


def _walk(element: Element, writer: Writer, mode: Mode) -> Step:
    for child in _children(element):
        if isinstance(child, str):
            if mode.shown:
                (writer.plain if mode.pre else writer.text)(child)
            continue
        tag = child.tag
        if not displayed(child):
            continue
        if tag == "br":
            if mode.shown:
                writer.line_break()
            continue
        if tag == "hr":
            writer.end_block(True)
            continue
        own = mode.inside(child, tag in ("pre", "textarea"))
        if tag not in BLOCK:
            yield _walk(child, writer, own)
            continue
        apart = tag in APART and not (tag in LISTS and element.tag == "li")
        writer.end_block(apart)
        if tag in LISTS:
            yield _list(child, writer, own)
        elif tag == "table":
            yield _table(child, writer, own)
        elif tag in ("blockquote", "dd"):
            _hang(writer, "  ", (yield _blocks(child, own)))
        elif tag == "li":
            _hang(writer, "- ", (yield _blocks(child, own)))
        else:
            yield _walk(child, writer, own)
        writer.end_block(apart)


def _hang(writer: Writer, marker: str, lines: list[str]) -> None:
    if lines:
        writer.add([(marker if i == 0 else " " * len(marker)) + x if x else "" for i, x in enumerate(lines)])


def _list(element: Element, writer: Writer, mode: Mode) -> Step:
    number = _number(element.attributes.get("start", ""), 1, 10**9) if element.tag == "ol" else None
    for child in element.children:
        if isinstance(child, str) or child.tag != "li":
            # what does not belong into a list is shown where it stands
            if isinstance(child, str) or child.tag not in LISTS:
                yield _walk(_of(child), writer, mode)
            elif displayed(child):
                _hang(writer, "  ", (yield _blocks(_of(child), mode)))
            writer.end_block()
        elif displayed(child):
            if number is not None:
                number = _number(child.attributes.get("value", ""), number, 10**9)
            _hang(writer, "- " if number is None else f"{number}. ", (yield _blocks(child, mode.inside(child))))
            if number is not None:
                number += 1


def _of(child: Element | str) -> Element:
    holder = Element("#part", {})
    holder.children.append(child)
    return holder


def _rows(element: Element, mode: Mode) -> Iterator[tuple[Element, Mode]]:
    """Rows, those inside row groups too, with what they inherit."""
    left = [(element, mode, iter(element.children))]
    while left:
        _, own, children = left[-1]
        child = next(children, None)
        if child is None:
            left.pop()
        elif not isinstance(child, str) and displayed(child):
            if child.tag in ROWS:
                left.append((child, own.inside(child), iter(child.children)))
            else:
                yield child, own


def _table(element: Element, writer: Writer, mode: Mode) -> Step:
    """Rows with the cells of a column below one another; a cell that spans columns or rows keeps their places free."""
    for child in element.children:
        if isinstance(child, str) and child.strip() and mode.shown:
            writer.text(child)
    writer.end_block()
    taken: dict[int, int] = {}
    grid: list[list[tuple[int, int, list[str]]]] = []
    for row, inherited in _rows(element, mode):
        if row.tag != "tr":
            lines = yield _blocks(_of(row), inherited)
            if lines:
                grid.append([(0, 0, lines)])
            continue
        cells, at, in_row = [], 0, inherited.inside(row)
        for cell in row.children:
            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                lines = yield _blocks(_of(cell), in_row)
                wide = 0
                if not lines:
                    continue
            elif not displayed(cell):
                continue
            else:
                lines, wide = (yield _blocks(cell, in_row.inside(cell))), _number(cell.attributes.get("colspan", ""), 1)
            while taken.get(at, 0) > 0:
                at += 1
            wide = max(1, wide)
            cells.append((at, wide, lines))
            down = 1 if isinstance(cell, str) else max(1, _number(cell.attributes.get("rowspan", ""), 1, 65_534))
            if down > 1:
                taken.update({at + i: down for i in range(wide)})
            at += wide
        taken = {k: v - 1 for k, v in taken.items() if v > 1}
        grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        for at, wide, lines in cells:
            if wide == 1 and lines:
                width[at] = max(width.get(at, 0), max(map(len, lines)))
    starts = _starts(grid, width, _measure(grid, width))
    for cells in grid:
        height = max((len(lines) for _, _, lines in cells), default=0)
        for i in range(height):
            line = ""
            for at, _, lines in cells:
                if i < len(lines) and lines[i]:
                    line = line.ljust(starts.get(at, 0))
                    line += ("  " if line and not line.endswith("  ") else "") + lines[i]
            writer.add([line.rstrip()])


Grid = list[list[tuple[int, int, list[str]]]]


def _starts(grid: Grid, width: dict[int, int], most: int) -> dict[int, int]:
    """Where each column begins, if none is wider than ``most``."""
    starts, place = {}, 0
    for column in range(max((at + wide for cells in grid for at, wide, _ in cells), default=0)):
        starts[column] = place
        place += min(width.get(column, 0), most) + 2 if width.get(column) else 0
    return starts


def _measure(grid: Grid, width: dict[int, int]) -> int:
    """The widest measure of columns at which padding stays in proportion to the text."""
    own = sum(len(x) for cells in grid for _, _, lines in cells for x in lines)
    # lines are padded as far as the last cell they reach into
    last = Counter()
    for cells in grid:
        for i in range(max((len(lines) for _, _, lines in cells), default=0)):
            last[max((at for at, _, lines in cells if i < len(lines) and lines[i]), default=0)] += 1
    most = max(width.values(), default=0)
    while most > 1:
        starts = _starts(grid, width, most)
        if sum(starts.get(at, 0) * n for at, n in last.items()) <= SMALL_TABLE + PADDING * own:
            break
        most //= 2
    return most


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    writer = Writer()
    run(_walk(parse(page.replace("\r\n", "\n").replace("\0", "")), writer, Mode()))
    writer.end_block()
    return "\n".join(writer.lines).strip("\n")


def extract_text(pages: DataFrame, page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (the id) of every row with ``text``."""
    names = [c for c in (keep or ["page_id"]) if c != "text"]
    own = fresh(names, "_page")

    def rendered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[names].assign(text=[render(x) for x in frame[own]])

    schema = pages.select(*names).schema.add("text", "string")
    return pages.select(*names, F.col(page).alias(own)).mapInPandas(rendered, schema)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
