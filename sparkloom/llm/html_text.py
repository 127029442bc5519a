"""HTML extraction: a tree builder with implied tags, then layout-aware rendering of all visible text."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_back, id_key, in_arrow, table

MARKUP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z]|/)")
#: An attribute: quotes matter behind its sign of equality alone, and hold any text, of any length. Matched once, without going back.
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+"""
TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)>")
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+""")
SPACE = re.compile(r"[ \t\n\r\f]+")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.IGNORECASE)
#: The most columns or rows that a cell spans, as in the standard.
COLUMNS, ROWS = 1000, 65534

#: Elements without content; whose content is raw text; that show nothing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas svg datalist".split())
#: Elements that begin on a line of their own, and those that also have a blank line on both sides.
BLOCK = frozenset("html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table caption thead tbody tfoot tr td th ul xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre table blockquote figure menu xmp".split())
#: An open element on the left of the stack ends before the start tags on its right, unless one of SCOPE lies between.
P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp li dd dt".split())
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "tr": (frozenset({"tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "caption"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th", "caption"}), frozenset({"table", "tr"})),
    "tbody": (frozenset({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "thead": (frozenset({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "tfoot": (frozenset({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset()),
}
SCOPE = frozenset("table td th caption button html template object".split())
#: End tags that close across tables and cells.
OUTER = frozenset("table tr tbody thead tfoot td th body html".split())
HEAD = frozenset("base link meta title style script noscript template head".split())
BREAK = object()
BULLET, CELL = "- ", "  "


class Node:
    """An element: unseen with all that is in it; visible (None: as its parent); number of a list or item; span of a cell in columns and rows."""

    __slots__ = ("tag", "unseen", "visible", "number", "span", "children")

    def __init__(self, tag: str, unseen: bool = False, visible: bool | None = None, number: int | None = None, span: tuple[int, int] = (1, 1)):
        self.tag, self.unseen, self.visible, self.number, self.span, self.children = tag, unseen, visible, number, span, []


class Block:
    """Lines that stand apart from what is around them, by a blank line if spaced. Of a row: its cells, of an item: "item" and its number, of a cell: its span."""

    __slots__ = ("lines", "spaced", "cells", "number", "span")

    def __init__(self, lines: list[str], spaced: bool, cells: list | str | None = None, number: int | None = None, span: tuple[int, int] = (1, 1)):
        self.lines, self.spaced, self.cells, self.number, self.span = lines, spaced, cells, number, span


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        value = m[2] or ""
        out.setdefault(m[1].lower(), unescape(value[1:-1] if value[:1] in "\"'" and value else value))
    return out


def _whole(attrs: dict[str, str], name: str, least: int, most: int) -> int | None:
    """A whole number in an attribute, within bounds; None without one."""
    value = attrs.get(name, "").strip()
    return min(max(int(value), least), most) if re.fullmatch(r"-?\d{1,9}", value) else None


def _node(tag: str, attrs: dict[str, str]) -> Node:
    if not attrs:
        return Node(tag, tag in UNSEEN or tag == "dialog")
    style = attrs.get("style", "")
    unseen = tag in UNSEEN or "hidden" in attrs or bool(NO_DISPLAY.search(style)) or tag == "input" and attrs.get("type", "").lower() == "hidden" or tag == "dialog" and "open" not in attrs
    said = VISIBILITY.findall(style)
    number = _whole(attrs, "start", -(10**9), 10**9) if tag == "ol" else _whole(attrs, "value", -(10**9), 10**9) if tag == "li" else None
    span = (_whole(attrs, "colspan", 1, COLUMNS) or 1, _whole(attrs, "rowspan", 0, ROWS)) if tag in ("td", "th") else (1, 1)
    return Node(tag, unseen, said[-1].lower() == "visible" if said else None, number, (span[0], 1 if span[1] is None else span[1] or ROWS))


def build(html: str) -> Node:
    """The tree: implied ends of p, li, dt, dd, options and table parts, an implied end of head, void and raw-text elements; end tags
    without an open element are ignored, elements open at the end are closed. Tags of any length, elements of any depth: where a tag's elements lie in the
    stack is kept by tag, so that none is searched for."""
    root = Node("#root")
    stack, at, n = [root], 0, len(html)
    lower = None
    places: dict[str, list[int]] = {}

    def last(tag: str) -> int:
        """The depth of the innermost open element of a tag, 0 where there is none."""
        own = places.get(tag)
        return own[-1] if own else 0

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop().tag].pop()

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack[-1].children.append(node)
        stack.append(node)

    while at < n:
        m = MARKUP.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                pop_to(len(stack) - 1)
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.start()
        if m[0] == "<!--":
            end = html.find("-->", at + 2)
            at = end + 3 if end >= 0 else n
            continue
        if not m[0][-1].isalpha():
            end = html.find(">", at)
            at = end + 1 if end >= 0 else n
            continue
        m = TAG.match(html, at)
        if not m:
            break  # a tag that the text ends in shows nothing
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            depth = last(tag)
            if tag in ("p", "br") and not depth:
                stack[-1].children.append(Node(tag))
            elif depth and (tag in OUTER or depth > max(map(last, ("table", "td", "th")))):
                pop_to(depth)
            continue
        if tag == "image":
            tag = "img"
        if stack[-1].tag == "head" and tag not in HEAD:
            pop_to(len(stack) - 1)
        if tag in P_ENDS and last("p") > max(map(last, SCOPE)):
            pop_to(last("p"))
        if rule := IMPLIED.get(tag):
            ends, stop = rule
            floor = max(map(last, (*stop, "table")))
            # The outermost of the elements to end that lie inside the innermost one that stops the search.
            inside = [own[bisect_right(own, floor)] for x in ends if (own := places.get(x)) and own[-1] > floor]
            if inside:
                pop_to(min(inside))
        node = _node(tag, _attributes(m[3]) if m[3] and not m[3].isspace() and m[3] != "/" else {})
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push(Node("tr"))
        if tag in VOID:
            stack[-1].children.append(node)
        elif tag in RAW:
            if lower is None:
                lower = html.lower() if len(html.lower()) == n else re.sub(r"[A-Z]", lambda c: c[0].lower(), html)
            end = lower.find(f"</{tag}", at)
            body = html[at : end if end >= 0 else n]
            stack[-1].children.append(node)
            node.children.append(unescape(body) if tag in ("title", "textarea") else body)
            close = html.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else n
        else:
            push(node)
    return root


def width(line: str) -> int:
    """Columns that a line takes: wide characters two, combining marks none."""
    return len(line) if line.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


def _flow(items: list, pre: bool = False) -> list[Block]:
    """Runs of inline text become blocks of their own between the others."""
    out, run = [], []

    def end():
        if run:
            lines, part = [], []
            for x in [*run, BREAK]:
                if x is BREAK:
                    joined = "".join(part)
                    lines += joined.split("\n") if pre else [SPACE.sub(" ", joined).strip(" ")]
                    part = []
                else:
                    part.append(x)
            while lines and not lines[-1].strip():
                lines.pop()
            while lines and not lines[0].strip():
                lines.pop(0)
            if lines:
                out.append(Block([x.rstrip() for x in lines], False))
            run.clear()

    for x in items:
        if isinstance(x, Block):
            end()
            out.append(x)
        else:
            run.append(x)
    end()
    return out


def _stack(blocks: list[Block]) -> list[str]:
    lines: list[str] = []
    before = False
    for b in blocks:
        if b.lines:
            if lines and (b.spaced or before):
                lines.append("")
            lines += b.lines
            before = b.spaced
    return lines


def _grid(rows: list[list[tuple[list[str], tuple[int, int]]]]) -> list[list[tuple[int, list[str], int]]]:
    """Rows of cells (lines, span) as rows of (column, lines, columns): cells that span rows keep their columns in those below, without text."""
    out, busy = [], {}  # busy: column to the rows that a cell above still covers
    for row in rows:
        line, at, below = [], 0, {}
        for lines, (columns, height) in row:
            while busy.get(at, 0):
                at += 1
            line.append((at, lines, columns))
            if height > 1:
                below.update(dict.fromkeys(range(at, at + columns), height - 1))
            at += columns
        busy = {c: left - 1 for c, left in busy.items() if left > 1} | below
        out.append(line)
    return out


def _table(items: list) -> list[str]:
    """Rows of cells, each column as wide as its widest line. What a cell of several columns needs beyond them goes to its last one."""
    out: list[str] = []
    rows: list[list[tuple[list[str], tuple[int, int]]]] = []

    def end():
        grid = _grid(rows)
        widths: dict[int, int] = {}
        for line in grid:
            for at, cell, columns in line:
                if columns == 1:
                    widths[at] = max([widths.get(at, 0), *map(width, cell)])
        # A column that only wide cells lie in takes no room of its own.
        room = lambda at, columns: sum(widths[c] for c in range(at, at + columns) if c in widths) + len(CELL) * (sum(c in widths for c in range(at, at + columns)) - 1)
        for line in grid:
            for at, cell, columns in line:
                if columns > 1:
                    need = max(map(width, cell), default=0)
                    used = [c for c in range(at, at + columns) if c in widths]
                    if not used:
                        widths[at] = need
                    elif need > room(at, columns):
                        widths[used[-1]] += need - room(at, columns)
        order = sorted(widths)
        left = dict(zip(order, accumulate([0, *(widths[c] + len(CELL) for c in order)]), strict=False))
        for line in grid:
            for k in range(max((len(cell) for _, cell, _ in line), default=0)):
                text, used = "", 0
                for at, cell, columns in line:
                    if k < len(cell) and cell[k]:
                        start = left[next(c for c in range(at, at + columns) if c in left)]
                        text += " " * (start - used) + cell[k]
                        used = start + width(cell[k])
                if text := text.rstrip():
                    out.append(text)
        rows.clear()

    for b in _flow(items):
        if isinstance(b.cells, list):
            rows.append(b.cells)
        else:
            end()
            out.extend(b.lines)
    end()
    return out


def _list(items: list, ordered: bool, number: int) -> list[str]:
    """Items behind bullets or numbers, their further lines indented alike."""
    out: list[str] = []
    for b in _flow(items):
        mark = ""
        if b.cells == "item":
            number = number if b.number is None else b.number
            mark = f"{number}. " if ordered else BULLET
            number += 1
        out += [(" " * len(mark) if i else mark) + x for i, x in enumerate(b.lines)]
    return out


def _close(node: Node, items: list) -> list:
    """What an element makes of what is in it: inline text, breaks and blocks."""
    tag = node.tag
    if tag == "br":
        return [BREAK]
    if tag == "hr":
        return [Block(["---"], False)]
    if tag not in BLOCK:
        return items
    if tag == "tr":
        cells = [(b.lines, b.span) for b in _flow(items)]
        return [Block([CELL.join(" ".join(x) for x, _ in cells)], False, cells)] if cells else []
    if tag in ("thead", "tbody", "tfoot"):
        return items
    if tag == "table":
        return [Block(_table(items), True)]
    if tag in ("ul", "ol", "menu"):
        return [Block(_list(items, tag == "ol", 1 if node.number is None else node.number), True)]
    blocks = _flow(items, tag in ("pre", "xmp"))
    if tag in ("td", "th"):
        return [Block(_stack(blocks), False, None, None, node.span)]
    if tag == "li":
        return [Block([x for b in blocks for x in b.lines], False, "item", node.number)]
    if tag == "dd":
        return [Block(["  " + x if x else x for x in _stack(blocks)], False)]
    if tag == "blockquote":
        return [Block([f"> {x}".rstrip() for x in _stack(blocks)], True)]
    if tag in SPACED:
        return [Block(_stack(blocks), True)]
    return blocks  # a plain block shows through: its blocks keep their own spacing


def render(root: Node) -> str:
    """Children before parents, without recursion: any depth of nesting is fine. Text shows where the innermost element that says so is visible."""
    done: list[list] = [[]]
    work: list = [(root, False, True)]
    while work:
        node, closing, visible = work.pop()
        if isinstance(node, str):
            if visible:
                done[-1].append(node)
        elif closing:
            made = _close(node, done.pop())
            if node.tag == "hr" and not visible:
                made = []
            if done[-1]:
                done[-1] += made
            else:
                done[-1] = made
        elif not node.unseen:
            visible = visible if node.visible is None else node.visible
            done.append([])
            work.append((node, True, visible))
            work += [(child, False, visible) for child in reversed(node.children)]
    return "\n".join(_stack(_flow(done[0])))


def extract_text(html: str | None) -> str:
    return render(build(html)) if html else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row: id (key) and text, all that a reader sees, laid out in lines.

    Unseen are head, scripts, styles, templates, embedded media, comments, elements with a hidden attribute or a style of display: none, and the
    text of those whose visibility is hidden, but for elements in them that are visible again. Tags and nesting may be of any length and depth; a tag that
    never ends shows nothing, a quote that is never closed is part of a name. Paragraphs, headings, lists and tables stand between blank lines, items have bullets or numbers and indents,
    cells are padded to their columns, also where some span several columns or rows, pre keeps its spaces. Null and empty pages give empty texts; null and repeated ids pass;
    an empty table gives no rows; other columns are ignored. A narrow plan without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                texts = [extract_text(x) for x in b.column(1).slice(at, 1024).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 1024), pa.array(texts, pa.string())], ["id", "text"])

    return in_arrow(pages.select(id_key(id_col).alias("id"), F.col(html_col).cast("string")), run, "id bigint, text string")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select(id_back("id").alias("page_id"), "text", F.length("text").cast("bigint").alias("n_chars"))
