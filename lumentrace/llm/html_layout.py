"""HTML to text with the layout kept.

A tree is built from the markup with the tags that HTML lets authors leave out; what a browser would not show is
dropped, by element, attribute, inline style or a page's own style sheet (simple selectors outside at-rules; a closed
``details`` counts as shown); the rest is written out with blank lines between paragraphs, one line per block,
bullets and numbers for list items, and table cells in aligned columns, with column and row spans. Pages are
independent rows: one pass in Arrow batches, no shuffle, memory bounded by the batch.

Time and output grow in proportion to the markup, whatever it holds: markup is read once from left to right (a tag,
quote or comment without end swallows the rest, as in browsers), open elements are found by tag, not by search, and
the blanks that align a table are bounded in all, by a multiple of its text: cells of any width are aligned, and only a table
that would need more blanks than that leaves its widest cells out of the columns' widths. ``Layout`` holds this bound
(None: always as many as it takes) and those on columns, indentation and nested tables. No text is lost by them.

Defined results: null markup gives a null text and no blocks, empty markup an empty text; broken markup is
repaired, never an error; any depth of nesting works, as nothing recurses; repeated rows are rendered each; an
empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Layout:
    #: Blanks that may align a table: so many for each character of its text, and so many beside; ``share`` None: no bound.
    share: int | None = 16
    free: int = 1 << 16
    #: Columns that are aligned, as many as HTML lets one cell span.
    columns: int = 1000
    #: Characters of indentation, and tables within tables that keep columns.
    indent: int = 40
    tables: int = 8


#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never shown.
HIDDEN = frozenset("head title script style template noscript iframe object datalist audio video canvas".split())
#: Inside SVG, elements whose content is not drawn; of the others, text is drawn inside ``text`` and foreignObject only.
UNDRAWN = frozenset("title desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter".split())
#: Inside MathML, elements whose content is not shown; and those whose parts stand apart.
UNSHOWN = frozenset("annotation annotation-xml mphantom".split())
APART = frozenset("mfrac mtable mtr mlabeledtr".split())
#: Elements of SVG and MathML whose content is HTML again.
HTML_AGAIN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: HTML elements that end an open svg or math.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split())
#: Inputs that do not show their value, or not as text.
SILENT_INPUTS = frozenset("hidden password checkbox radio file range color image".split())
#: Elements whose content holds no tags; those of the second set have character references.
RAW = frozenset("script style xmp iframe noembed noframes noscript plaintext".split())
RAW_TEXT = frozenset(("title", "textarea"))
#: Elements on lines of their own, and those with a blank line around them.
BLOCK = frozenset("html body address article aside details dialog dd div dl dt fieldset figcaption figure footer form header hgroup li main nav ol option section summary table ul tr caption thead tbody tfoot legend center".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table hr figure".split())
#: A start tag ends these open elements (up to one of the stops).
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "caption"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: A start tag of these ends an open paragraph.
ENDS_P = (BLOCK | SPACED) - {"html", "body", "li", "option", "tr", "caption", "thead", "tbody", "tfoot", "dd", "dt"}
#: A paragraph inside these belongs to them, not to what is outside.
SCOPE = frozenset("td th caption li dd dt div section article table button object template".split())
SPACE = re.compile(r"[\x20\t\n\r\f]+")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(hidden|collapse)", re.I)
VISIBLE = re.compile(r"display\s*:|visibility\s*:\s*visible", re.I)

TAG_NAME = re.compile(r"[^\t\n\f\r />]+")
GAP = re.compile(r"[\t\n\f\r /]*")
ATTRIBUTE = re.compile(r"=?[^\t\n\f\r />=]*")
EQUALS = re.compile(r"[\t\n\f\r ]*=[\t\n\f\r ]*")
BARE_VALUE = re.compile(r"[^\t\n\f\r >]*")
COMMENT_END = re.compile(r"--!?>")
#: References to numbers beyond any character.
LONG_REFERENCE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
SELECTOR = re.compile(r"([A-Za-z][\w-]*)?(?:\.([\w-]+)|#([\w-]+))?")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


def decoded(text: str) -> str:
    return unescape(LONG_REFERENCE.sub("\ufffd", text)) if "&" in text else text


def attributes(html: str, at: int) -> tuple[dict[str, str | None], int, bool] | None:
    """Attributes from ``at`` on, the place after the tag and whether it ends in a slash; None if the page ends before the tag does."""
    found: dict[str, str | None] = {}
    while True:
        gap = GAP.match(html, at)
        at = gap.end()
        if at >= len(html):
            return None
        if html[at] == ">":
            return found, at + 1, gap[0].endswith("/")
        name = ATTRIBUTE.match(html, at)
        value, at = None, name.end()
        if equals := EQUALS.match(html, at):
            at = equals.end()
            quote = html[at : at + 1]
            if quote in ("'", '"'):
                end = html.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = html[at + 1 : end], end + 1
            else:
                bare = BARE_VALUE.match(html, at)
                value, at = bare[0], bare.end()
        found.setdefault(name[0].lower(), None if value is None else decoded(value))


class Tree:
    """Builds the tree under ``root``."""

    def __init__(self, html: str) -> None:
        self.root = Node("", {})
        self.open = [self.root]
        #: Depths of the open elements of a tag.
        self.depths: dict[str, list[int]] = {}
        #: Open elements at which SVG or MathML begins, or HTML again, with their depth.
        self.borders: list[tuple[int, Node]] = []
        self.sheets: list[str] = []
        self._read(html)

    def _read(self, html: str) -> None:
        """Tokens from left to right; every character is looked at a bounded number of times."""
        at, end = 0, len(html)
        while at < end:
            less = html.find("<", at)
            if less < 0:
                less = end
            if less > at:
                self._text(decoded(html[at:less]))
            at = less + 1
            lead = html[at : at + 1]
            if lead.isascii() and lead.isalpha():
                at = self._start_at(html, at)
            elif lead == "/":
                at = self._end_at(html, at + 1)
            elif lead == "!" and html.startswith("--", at + 1):
                close = COMMENT_END.search(html, at + 1)
                at = close.end() if close else end
            elif lead == "!" and html.startswith("[CDATA[", at + 1) and self._foreign():
                close = html.find("]]>", at)
                self._text(html[at + 8 : close if close >= 0 else end])
                at = close + 3 if close >= 0 else end
            elif lead in ("!", "?") and lead:
                at = self._skip(html, at)
            elif less < end:
                self._text("<")

    def _skip(self, html: str, at: int) -> int:
        return html.find(">", at) + 1 or len(html)

    def _start_at(self, html: str, at: int) -> int:
        name = TAG_NAME.match(html, at)
        tag = name[0].lower()
        if (found := attributes(html, name.end())) is None:
            return len(html)
        attrs, at, slash = found
        foreign = self._foreign() and tag not in BREAKOUT
        self._start(tag, attrs)
        if slash and (foreign or tag in ("svg", "math")):
            self._close(len(self.open) - 1)
        elif not foreign and tag in ("pre", "textarea", "listing"):
            at += html.startswith("\n", at) or 2 * html.startswith("\r\n", at)
        if not foreign and tag in RAW | RAW_TEXT:
            close = None if tag == "plaintext" else re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I).search(html, at)
            stop = close.start() if close else len(html)
            content = html[at:stop]
            if tag == "style" and (attrs.get("media") or "all").strip().lower() in ("all", "screen"):
                self.sheets.append(content)
            self._text(decoded(content) if tag in RAW_TEXT else content)
            at = stop
        return at

    def _end_at(self, html: str, at: int) -> int:
        name = TAG_NAME.match(html, at)
        if not name or not (name[0][0].isascii() and name[0][0].isalpha()):
            return self._skip(html, at)
        if (found := attributes(html, name.end())) is None:
            return len(html)
        tag = name[0].lower()
        if tag == "br":
            self._start("br", {})
        elif tag not in VOID:
            self._end((tag,), ("table",) if tag in ("p", "li", "div", "span", "a", "b", "i") else ())
        return found[1]

    def _text(self, data: str) -> None:
        if data:
            self.open[-1].children.append(data)

    def _foreign(self) -> bool:
        """Whether what follows stands directly in SVG or MathML."""
        while self.borders and (self.borders[-1][0] >= len(self.open) or self.open[self.borders[-1][0]] is not self.borders[-1][1]):
            self.borders.pop()
        return bool(self.borders) and self.borders[-1][1].tag in ("svg", "math")

    def _innermost(self, tags) -> int:
        """Depth of the innermost open element of ``tags``, 0 if there is none."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            self.depths[self.open.pop().tag].pop()

    def _end(self, tags, stops) -> bool:
        """Close the innermost element of ``tags``, and what is in it, unless a stop stands further in."""
        depth = self._innermost(tags)
        if not depth or depth < self._innermost(stops):
            return False
        self._close(depth)
        return True

    def _start(self, tag: str, attrs: dict) -> None:
        while tag in BREAKOUT and self._foreign():
            self._close(self.borders[-1][0])
        if self._foreign():
            self._push(tag, attrs)
            return
        if tag in IMPLIED_END:
            while self._end(*IMPLIED_END[tag]):
                pass
        if tag in ENDS_P:
            self._end(("p",), SCOPE)
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._push("tr", {})
        self._push(tag, attrs)
        if tag in VOID:
            self._close(len(self.open) - 1)

    def _push(self, tag: str, attrs: dict) -> None:
        node = Node(tag, attrs)
        if tag in ("svg", "math") or (tag in HTML_AGAIN and self._foreign()):
            self._foreign()
            self.borders.append((len(self.open), node))
        self.open[-1].children.append(node)
        self.depths.setdefault(tag, []).append(len(self.open))
        self.open.append(node)


def says(declarations: str) -> bool | None:
    """True if a style hides, False if it shows, None if it says nothing of it."""
    if INVISIBLE.search(declarations):
        return True
    return False if VISIBLE.search(declarations) else None


def style_rules(sheets: list[str]) -> dict[tuple[str, str, str], bool]:
    """What style sheets hide or show, by tag, class and id; later rules replace earlier ones."""
    found: dict[tuple[str, str, str], bool] = {}
    for sheet in sheets:
        parts = sheet.split("/*")
        sheet = parts[0] + "".join(p.partition("*/")[2] for p in parts[1:])
        depth, start, body, head = 0, 0, 0, ""
        for brace in re.finditer(r"[{}]", sheet):
            if brace[0] == "{":
                if not depth:
                    head, body = sheet[start : brace.start()].rpartition(";")[2].strip(), brace.end()
                depth += 1
                continue
            depth = max(0, depth - 1)
            if not depth:
                start = brace.end()
                hides = None if head.startswith("@") else says(sheet[body : brace.start()])
                for one in head.split(",") if hides is not None else ():
                    if (m := SELECTOR.fullmatch(one.strip())) and m[0]:
                        found[(m[1] or "").lower(), m[2] or "", m[3] or ""] = hides
    return found


def styled_away(node: Node, rules: dict[tuple[str, str, str], bool]) -> bool:
    """Whether the style sheet hides the element: an id's rule goes before a class's, that before a tag's."""
    name, tag = node.attrs.get("id") or "", node.tag
    levels = [[("", "", name), (tag, "", name)] if name else [], [k for c in (node.attrs.get("class") or "").split() for k in (("", c, ""), (tag, c, ""))], [(tag, "", "")]]
    for keys in levels:
        known = [rules[k] for k in keys if k in rules]
        if known:
            return any(known)
    return False


def visible(node: Node, rules: dict[tuple[str, str, str], bool]) -> bool:
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or (node.tag == "input" and (a.get("type") or "").lower() == "hidden") or (node.tag == "dialog" and "open" not in a):
        return False
    own = says(a.get("style") or "")
    return not (styled_away(node, rules) if own is None and rules else own)


def drawn(node: Node, scope: str) -> bool:
    """Whether an element of SVG or MathML shows its content."""
    if scope == "math":
        return node.tag not in UNSHOWN
    return scope not in ("svg", "text") or not (node.tag in UNDRAWN or node.attrs.get("display") == "none" or node.attrs.get("visibility") in ("hidden", "collapse"))


def inner_scope(tag: str, scope: str) -> str | None:
    """What the content of an element stands in, if not in the same as the element."""
    if tag in ("svg", "math"):
        return tag
    if scope == "svg" and tag in ("text", "foreignobject"):
        return "text" if tag == "text" else ""
    return None


class Flow:
    """Text under construction: lines, and what is due before the next word."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks, self.space, self.indent, self.mark = 0, False, "", ""

    def gap(self, lines: int) -> None:
        """At least so many line breaks before what follows."""
        self.breaks, self.space = max(self.breaks, lines), False

    def _lead(self) -> None:
        if self.parts and self.breaks:
            self.parts.append("\n" * self.breaks)
        if self.breaks or not self.parts:
            self.parts.append(self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent)
            self.mark = ""
        elif self.space:
            self.parts.append(" ")
        self.breaks, self.space = 0, False

    def inner_indent(self, outer: str, mark: str, most: int) -> str:
        return (outer + " " * len(mark))[: max(most, len(mark))]

    def text(self, data: str) -> None:
        words = SPACE.sub(" ", data)
        if words == " " or not words:
            self.space = self.space or bool(words)
            return
        self.space = self.space or words[0] == " "
        self._lead()
        self.parts.append(words.strip(" "))
        self.space = words[-1] == " "

    def raw(self, data: str) -> None:
        if data:
            self._lead()
            self.parts.append(data.replace("\n", "\n" + self.indent))

    def done(self) -> str:
        return "".join(self.parts).strip("\n")


def span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name) or ""
    return min(int(value), most) if value.isascii() and value.isdigit() and len(value) < 9 else 1


def placed(rows: list[list[tuple[str, int, int]]], columns: int) -> list[list[tuple[int, int, list[str]]]]:
    """Cells (text, columns, rows) as (first column, column after it, lines): what reaches down from above pushes cells aside."""
    until: list[int] = []
    out = []
    for r, row in enumerate(rows):
        at, cells = 0, []
        for text, wide, high in row:
            while at < len(until) and until[at] > r:
                at += 1
            after = min(at + max(1, wide), max(columns, at + 1))
            if at < columns:
                until += [0] * (after - len(until))
                until[at:after] = [r + high] * (after - at)
            cells.append((at, after, text.split("\n")))
            at = after
        out.append(cells)
    return out


def offsets_of(grid: list[list[tuple[int, int, list[str]]]], limit: int, columns: int) -> list[int]:
    """Where each column starts, if cells wider than ``limit`` do not count."""
    widths: dict[tuple[int, int], int] = {}
    for row in grid:
        for at, after, lines in row:
            wide = max(map(len, lines))
            if after <= columns and wide <= limit:
                widths[at, after] = max(widths.get((at, after), 0), wide)
    ends: dict[int, list[tuple[int, int]]] = {}
    for (at, after), wide in widths.items():
        ends.setdefault(after, []).append((at, wide))
    offsets = [0]
    for c in range(1, max(ends, default=0) + 1):
        offsets.append(max([offsets[c - 1], *(offsets[at] + wide + 2 for at, wide in ends.get(c, ()))]))
    return offsets


def lines_of(grid: list[list[tuple[int, int, list[str]]]], offsets: list[int]) -> Iterator[list[tuple[int, str]]]:
    """Each line of the table as its cells' lines with the blanks before them."""
    last = len(offsets) - 1
    for row in grid:
        # A row without text takes no line.
        k, live = 0, row if any(any(lines) for _, _, lines in row) else []
        while live:
            parts, length = [], 0
            for at, _, lines in live:
                pad = max(offsets[min(at, last)] - length, 2 if length else 0)
                parts.append((pad, lines[k]))
                length += pad + len(lines[k])
            yield parts
            k += 1
            live = [c for c in live if len(c[2]) > k]


def aligned(rows: list[list[tuple[str, int, int]]], how: Layout) -> str:
    """Cells in columns; further lines of a cell stand below its first."""
    grid = placed(rows, how.columns)
    low, high = 0, max(max(map(len, lines)) for row in grid for _, _, lines in row)
    offsets = offsets_of(grid, high, how.columns)
    if how.share is not None:
        most = how.free + how.share * sum(len(text) for row in rows for text, _, _ in row)
        blanks = lambda offsets: sum(pad for line in lines_of(grid, offsets) for pad, text in line if text)
        if blanks(offsets) > most:
            # The widest limit that keeps the bound; without any width cells stand two blanks apart.
            while low < high:
                limit = (low + high + 1) // 2
                low, high = (limit, high) if blanks(offsets_of(grid, limit, how.columns)) <= most else (low, limit - 1)
            offsets = offsets_of(grid, low, how.columns)
    return "\n".join("".join(" " * pad + text for pad, text in line).rstrip() for line in lines_of(grid, offsets))


def render(html: str, how: Layout = Layout()) -> str:  # noqa: B008
    """Visible text of a page."""
    tree = Tree(html)
    rules = style_rules(tree.sheets)
    flows, tables, lists, pre, deep = [Flow()], [], [], 0, 0
    #: What the place is in: "" for HTML, "math", "svg" (nothing drawn), "text" (of SVG).
    scopes: list[tuple[Node | None, str]] = [(None, "")]
    labels = False
    todo: list[tuple[Node | str, bool]] = [(tree.root, True)]
    while todo:
        node, entering = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if scopes[-1][1] == "svg":
                continue
            (flow.raw if pre else flow.text)(node)
            continue
        tag = node.tag
        cell = tag in ("td", "th") and bool(tables) and not deep
        if entering:
            scope = scopes[-1][1]
            if not visible(node, rules) or not drawn(node, scope):
                continue
            todo.append((node, False))
            parts = node.children
            if scope == "math" and tag in APART:
                parts = [x for c in parts for x in (c, " ")][:-1]
            todo += [(c, True) for c in reversed(parts)]
            if (inner := inner_scope(tag, scope)) is not None:
                scopes.append((node, inner))
                # Labels of a drawing stand apart.
                flow.space = flow.space or (inner == "text" and bool(flow.parts) and not flow.breaks and labels)
                labels = inner == "text" or (labels and tag != "svg")
            if cell:
                flows.append(Flow())
            elif tag in SPACED:
                flow.gap(1 if lists and tag in ("ul", "ol") else 2)
            elif tag in BLOCK:
                flow.gap(1)
            if tag in ("ul", "ol"):
                start = node.attrs.get("start") or ""
                lists.append([tag, int(start) if start.isdecimal() and len(start) < 9 else 1, flow.indent])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1, flow.indent]
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                flow.mark, flow.indent = mark, flow.inner_indent(kind[2], mark, how.indent)
            elif tag == "br":
                flow.gap(flow.breaks + 1)
            elif tag == "table":
                if len(tables) < how.tables:
                    tables.append([])
                else:
                    deep += 1
            elif tag == "tr" and tables and not deep:
                tables[-1].append([])
            elif tag in ("td", "th"):
                flow.space = flow.space or (bool(flow.parts) and not flow.breaks)
            elif tag in ("pre", "xmp", "listing", "plaintext"):
                pre += 1
            elif tag == "input" and (node.attrs.get("type") or "").lower() not in SILENT_INPUTS:
                flow.text(node.attrs.get("value") or node.attrs.get("placeholder") or "")
            elif tag == "img" and (node.attrs.get("alt") or "").strip():
                flow.text(node.attrs["alt"])
            continue
        if scopes[-1][0] is node:
            scopes.pop()
        if cell:
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((flows.pop().done(), span(node, "colspan", 1000), span(node, "rowspan", 65534) or 65534))
        else:
            if tag == "table" and deep:
                deep -= 1
            elif tag == "table" and tables:
                rows = tables.pop()
                if any(text for row in rows for text, _, _ in row):
                    flow.raw(aligned(rows, how))
            elif tag in ("ul", "ol") and lists:
                flow.indent, flow.mark = lists.pop()[2], ""
            elif tag in ("pre", "xmp", "listing", "plaintext"):
                pre -= 1
            elif tag == "li":
                flow.mark = ""
                flow.indent = lists[-1][2] if lists else ""
            if tag in SPACED:
                flow.gap(1 if lists and tag in ("ul", "ol") else 2)
            elif tag in BLOCK:
                flow.gap(1)
    while len(flows) > 1:
        flows[-2].raw(flows.pop().done())
    return flows[0].done()


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", how: Layout | None = None) -> DataFrame:
    """``page_id``, ``text``, ``n_chars`` and ``n_blocks`` (pieces between blank lines) of every page."""
    how = how or Layout()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (h := v.as_py()) is None else render(h, how) for v in batch.column(1)]
            chars = [len(t or "") for t in texts]
            blocks = [sum(1 for b in (t or "").split("\n\n") if b.strip()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(chars, pa.int64()), pa.array(blocks, pa.int64())], ["page_id", "text", "n_chars", "n_blocks"])

    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, text string, n_chars long, n_blocks long")
