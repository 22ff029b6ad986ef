"""HTML extraction by layout-aware rendering.

1. Scanner. Tags, attributes and comments are read in one pass; no input makes it step back. A quote delimits a value
   only right after ``=``.
2. Tree builder. It supplies implied start and end tags (head, p, li, dt, dd, option, rows, cells, table sections) and
   ignores end tags that would cross a block, a list or a table cell. Open elements are indexed by name, so no tag looks
   through the stack.
3. Visibility. Not shown are the elements of ``HIDDEN``, ``hidden``, ``display: none``, closed dialogs and hidden inputs;
   ``visibility: hidden`` holds until ``visibility: visible`` further inside. Rules of style sheets are not applied. What
   a ``details`` or ``select`` holds is shown, text in ``svg`` and ``noscript`` is not.
4. Renderer. All visible text: one blank line around paragraphs and headings, one line break around other blocks; list
   items with bullets or numbers (``start`` and ``value`` count), their lines indented under them; ``pre`` and
   ``textarea`` as they are; tables as grids, in which cells keep their lines, lists and inner tables, span rows and
   columns, and begin at the same place in each line. Columns are padded to ``WIDE`` characters at most and lines to
   ``LINE``; longer cells push their line on. Lists deeper than ``DEEP`` and tables in more than ``NESTED`` others are
   not set in further. So nothing is cut and work stays linear in the page but for that padding.

Null and empty pages give empty text; markup cut off at the end of a page is dropped, what stands before it is kept. A
very long page is held whole by one task. Rows in, rows out, whatever repeats or ties; columns besides page_id and html
are left out, so their names cannot clash.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_batches

_VALUE = r"\"[^\"]*+\"?+|'[^']*+'?+|[^\s>\"'][^\s>]*+"
#: A tag from its name on, all quantifiers possessive: it matches to ">" or the end of the page in one pass.
TAG = re.compile(rf"([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:{_VALUE})?+)?+|=)*+)(>|\Z)")
ATTRIBUTE = re.compile(rf"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+({_VALUE})?+)?+")
WHITE = re.compile(r"[ \t\n\r\f]+")
RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
HIDDEN = {"head", "script", "style", "template", "noscript", "iframe", "object", "svg", "math", "title", "datalist", "audio", "video", "canvas", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Blocks with a blank line around them, and those with line breaks only.
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "dl", "table", "figure", "fieldset"}
SECTIONS = {"thead", "tbody", "tfoot"}
CELLS = {"td", "th", "caption"}
TABLE = {"table", "tr", *SECTIONS, *CELLS}
BLOCK = SPACED | TABLE | {"html", "body", "div", "article", "section", "nav", "header", "footer", "main", "aside", "address", "li", "dt", "dd", "form", "figcaption", "details", "summary", "center", "legend", "option", "optgroup", "select", "textarea", "menu", "dialog", "search"}
CLOSES_P = BLOCK - TABLE - {"html", "body", "option", "optgroup", "select", "textarea"} | {"table", "hr"}
#: Start tag -> open elements that it ends, and elements beyond which it doesn't look.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", *CELLS}), "dt": ({"dt", "dd"}, {"dl", *CELLS}), "dd": ({"dt", "dd"}, {"dl", *CELLS}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"table"}), "th": ({"td", "th", "caption"}, {"table"}), "tr": ({"tr", "caption"}, {"table"}),
    **dict.fromkeys((*SECTIONS, "caption"), (SECTIONS | {"tr", "caption"}, {"table"})),
}
#: What may stand in a head without ending it.
HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "style", "script", "noscript", "template", "noframes", "head", "html"}
#: Inputs whose value is not shown as text.
SILENT = {"hidden", "password", "checkbox", "radio", "file", "image", "range", "color"}
GAP, WIDE, LINE, DEEP, NESTED = 2, 200, 1000, 20, 8


def attributes(text: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        if value[:1] in ("'", '"'):
            value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
        out.setdefault(name.lower(), entities.unescape(value) if "&" in value else value)
    return out


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", name, attributes) and ("end", name, ""); what raw elements hold is text."""
    at, size, begin = 0, len(page), 0
    while at < size:
        at = page.find("<", at)
        if at < 0 or at + 1 >= size:
            at = size if at < 0 else at + 1
            break
        follows, stop = page[at + 1], -1
        end = follows == "/"
        if follows in "!?" or end and at + 2 < size and not page[at + 2].isascii() or end and at + 2 < size and not page[at + 2].isalpha():
            mark = "-->" if page.startswith("<!--", at) else ">"
            stop = page.find(mark, at + 2)
            stop = size if stop < 0 else stop + len(mark)
            tag = None
        elif tag := TAG.match(page, at + 1 + end):
            stop = tag.end()
        elif end and at + 2 >= size:
            stop, tag = size, None
        else:
            at += 1
            continue
        if at > begin:
            yield "text", page[begin:at], ""
        at = begin = stop
        if tag is None or not tag[3]:
            continue
        name = tag[1].lower()
        yield ("end", name, "") if end else ("start", name, tag[2])
        if not end and name in RAW:
            found = RAW[name].search(page, at)
            stop = found.start() if found else size
            if stop > at:
                yield "raw", page[at:stop], name
            at = begin = stop
        elif not end and name == "plaintext":
            if at < size:
                yield "raw", page[at:], name
            return
    if size > begin and page[begin:] not in ("<", "</"):
        yield "text", page[begin:], ""


def events(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("start" or "end", element, attributes) and ("text", text, {}), every start with its end, implied ones included;
    void elements have a start only."""
    stack: list[str] = []
    places: dict[str, list[int]] = {}  # of the open elements, by name
    blocks: list[int] = []
    none: dict[str, str] = {}
    place = lambda names: max((places[n][-1] for n in names if places.get(n)), default=-1)

    def push(name: str, given: dict[str, str]) -> tuple[str, str, dict[str, str]]:
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            blocks.append(len(stack))
        stack.append(name)
        return "start", name, given

    def pop_to(depth: int) -> Iterator[tuple[str, str, dict[str, str]]]:
        while len(stack) > depth:
            name = stack.pop()
            places[name].pop()
            if name in BLOCK:
                blocks.pop()
            yield "end", name, none

    for kind, what, more in scan(page):
        if kind == "text" or kind == "raw":
            if kind == "text" and places.get("head") and stack[-1] == "head" and what.strip():
                yield from pop_to(place({"head"}))
            yield "text", entities.unescape(what) if "&" in what and (kind == "text" or more in ("title", "textarea")) else what, none
            continue
        if kind == "end":
            if what == "br":
                yield "start", "br", none
            elif what == "p" and place({"p"}) < place(CELLS | {"table", "button"}) or what == "p" and not places.get("p"):
                yield push("p", none)
                yield from pop_to(len(stack) - 1)
            elif places.get(what):
                at = places[what][-1]
                if what not in BLOCK:
                    wall = blocks[-1] if blocks else -1
                elif what == "li":
                    wall = place({"ul", "ol", "menu", *CELLS})
                else:
                    wall = -1 if what == "table" else place({"table"}) if what in TABLE else place(CELLS | {"table"})
                if at >= wall:
                    yield from pop_to(at)
            continue
        if what not in HEAD and places.get("head") and not places.get("template"):
            yield from pop_to(place({"head"}))
        if what in CLOSES_P and place({"p"}) > place(CELLS | {"table", "button"}):
            yield from pop_to(place({"p"}))
        if what in IMPLIED_END:
            ends, walls = IMPLIED_END[what]
            wall = place(walls)
            first = min((places[n][-1] for n in ends if places.get(n) and places[n][-1] > wall), default=-1)
            if first >= 0:
                yield from pop_to(first)
            if what in ("td", "th", "tr") and places.get("table"):
                if place(SECTIONS) < place({"table"}):
                    yield from pop_to(place({"table"}) + 1)
                    yield push("tbody", none)
                if what != "tr" and place({"tr"}) < place({"table"}):
                    yield push("tr", none)
        given = attributes(more) if more and not more.isspace() and more != "/" else none
        if what in VOID:
            yield "start", what, given
            continue
        yield push(what, given)
        if more.endswith("/") and (what in ("svg", "math") or place({"svg", "math"}) >= 0):
            yield from pop_to(len(stack) - 1)
    yield from pop_to(0)


def _shown(name: str, given: dict[str, str]) -> tuple[bool, bool | None]:
    """Whether an element has a box, and whether it is visible, if it says so."""
    if name in HIDDEN or "hidden" in given or name == "dialog" and "open" not in given:
        return False, None
    visible = None
    if "style" in given:
        for part in given["style"].lower().split(";"):
            key, _, value = part.partition(":")
            key, value = key.strip(), value.replace("!important", "").strip()
            if key == "display" and value == "none":
                return False, None
            if key == "visibility" and value in ("hidden", "collapse", "visible"):
                visible = value == "visible"
    return True, visible


class _Flow:
    """Lines of one block context: the page, a list item or a table cell."""

    def __init__(self, tight: bool):
        self.tight, self.lines, self.line, self.space, self.mark = tight, [], [], False, ""

    def text(self, text: str, pre: bool) -> None:
        if pre:
            for k, part in enumerate(text.split("\n")):
                if k:
                    self.end(True)
                if part:
                    self.line.append(part)
            return
        words = WHITE.sub(" ", text)
        if words[0] == " ":
            self.space, words = True, words[1:]
        if not words:
            return
        if self.space and self.line:
            self.line.append(" ")
        self.space = words[-1] == " "
        self.line.append(words[:-1] if self.space else words)

    def end(self, blank: bool = False) -> None:
        line = "".join(self.line).rstrip()
        self.line, self.space = [], False
        if line or blank:
            self.lines.append(self.mark + line)
            self.mark = ""

    def gap(self) -> None:
        if not self.tight and self.lines and self.lines[-1]:
            self.lines.append("")

    def result(self) -> list[str]:
        self.end()
        out: list[str] = []
        for line in self.lines:
            if line or out and out[-1]:
                out.append(line)
        while out and not out[-1]:
            out.pop()
        return out


class _Table:
    def __init__(self):
        self.rows, self.above = [], []

    def lines(self) -> list[str]:
        """The rows as lines; cells are (lines, columns, rows) in the order of the page."""
        placed, taken = [], {}  # taken: rows that cells from above still cover, by column
        for row in self.rows:
            column, cells, new = 0, [], {}
            for lines, across, down in row:
                while taken.get(column, 0) > 0:
                    column += 1
                cells.append((column, across, lines))
                if down > 1:
                    new.update((c, down) for c in range(column, column + min(across, 64)))
                column += across
            taken = {c: n - 1 for c, n in {**taken, **new}.items() if n > 1}
            placed.append(cells)
        if len(placed) == 1 and len(placed[0]) == 1:
            return self.above + placed[0][0][2]
        starts = sorted({c for cells in placed for c, _, lines in cells if lines})
        width = dict.fromkeys(starts, 0)
        rank = {c: k for k, c in enumerate(starts)}
        spans = []
        for cells in placed:
            for c, across, lines in cells:
                if lines:
                    size = min(WIDE, max(map(len, lines)))
                    last = rank[c]
                    while last + 1 < len(starts) and last - rank[c] < 64 and starts[last + 1] < c + across:
                        last += 1
                    if last == rank[c]:
                        width[c] = max(width[c], size)
                    else:
                        spans.append((rank[c], last, size))
        for first, last, size in spans:
            have = sum(width[starts[k]] + GAP for k in range(first, last + 1)) - GAP
            width[starts[last]] += max(0, size - have)
        offset, at = {}, 0
        for c in starts:
            offset[c] = min(at, LINE)
            at += width[c] + GAP
        out = list(self.above)
        for cells in placed:
            cells = [(offset[c], lines) for c, _, lines in cells if lines]
            for k in range(max((len(lines) for _, lines in cells), default=0)):
                line, size = [], 0
                for start, lines in cells:
                    if k < len(lines) and lines[k]:
                        space = max(start - size, GAP if size else 0)
                        line += (" " * space, lines[k])
                        size += space + len(lines[k])
                out.append("".join(line).rstrip())
        return out


def _number(text: str | None, least: int, most: int, default: int) -> int:
    found = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return min(most, max(least, int(found[1]))) if found else default


def render(page: str | None) -> tuple[str, int, int, int]:
    """Visible text, and how many blocks, list items and table rows it has."""
    flows, tables, lists = [_Flow(False)], [], []
    hidden, pre, deep, blocks, items, rows = 0, 0, 0, 0, 0, 0
    visible = True
    opened: list[tuple[str, bool, bool, str]] = []  # element, hides, whether its parent was visible, what its end does
    for kind, what, given in events(page or ""):
        flow = flows[-1]
        if kind == "text":
            if not hidden and visible and what:
                flow.text(what, pre > 0)
            continue
        if kind == "start":
            box, says = _shown(what, given)
            if what in VOID:
                if hidden or not box:
                    continue
                if what == "br":
                    flow.end(True)
                elif what == "hr":
                    flow.end()
                    flow.gap()
                elif what == "input" and visible and says is not False and given.get("value") and given.get("type", "").lower() not in SILENT:
                    flow.text(f" {given['value']} ", False)
                continue
            hidden += not box
            act = ""
            if not hidden and what in BLOCK:
                act, blocks = "block", blocks + 1
                in_table = bool(tables) and tables[-1] is not None
                if what in CELLS and in_table and (what == "caption" or tables[-1].rows):
                    flows.append(_Flow(True))
                    act = "caption" if what == "caption" else f"{_number(given.get('colspan'), 1, 1000, 1)} {_number(given.get('rowspan'), 1, 65534, 1)}"
                elif what == "tr" and tables:
                    rows += 1
                    if in_table:
                        tables[-1].rows.append([])
                    else:
                        flow.end()
                elif what in CELLS and tables:
                    flow.text(" " * GAP, True) if flow.line else None
                elif what not in SECTIONS:
                    flow.end()
                    if what in SPACED and not lists:
                        flow.gap()
                    if what in ("ul", "ol", "menu"):
                        lists.append([what == "ol", _number(given.get("start"), -(10**9), 10**9, 1)])
                        act = "list"
                    elif what == "li":
                        items += 1
                        mark = "- "
                        if lists and lists[-1][0]:
                            number = _number(given.get("value"), -(10**9), 10**9, lists[-1][1])
                            mark, lists[-1][1] = f"{number}. ", number + 1
                        if deep < DEEP:
                            deep += 1
                            flows.append(_Flow(True))
                            act = "item " + mark
                        else:
                            flow.mark = mark
                            act = "flat"
                    elif what in ("pre", "textarea"):
                        pre, act = pre + 1, "pre"
                    elif what == "table":
                        tables.append(_Table() if len(tables) < NESTED else None)
                        act = "table"
            opened.append((what, not box, visible, act))
            visible = visible if says is None else says
            continue
        name, hides, visible, act = opened.pop()
        hidden -= hides
        if not act:
            continue
        if act == "block":
            if what in SECTIONS or what == "tr" and tables and tables[-1] is not None or what in CELLS and tables and tables[-1] is None:
                continue
            flow.end()
        elif act == "flat":
            flow.end()
            flow.mark = ""
        elif act == "list":
            flow.end()
            lists.pop()
        elif act == "pre":
            flow.end()
            pre -= 1
        elif act.startswith("item"):
            deep -= 1
            lines, mark = flows.pop().result(), act[5:]
            flow = flows[-1]
            flow.lines += [(mark if k == 0 else " " * len(mark)) + line if line else "" for k, line in enumerate(lines)]
        elif act == "caption":
            tables[-1].above += flows.pop().result()
        elif act == "table":
            flow.end()
            if (table := tables.pop()) is not None:
                flow.lines += table.lines()
        else:
            across, down = map(int, act.split())
            tables[-1].rows[-1].append((flows.pop().result(), across, down))
        if what in SPACED and not lists:
            flows[-1].gap()
    return "\n".join(flows[0].result()), blocks, items, rows


def extract(pages: DataFrame) -> DataFrame:
    """page_id, visible_text, n_blocks, n_items, n_rows of each page (page_id, html)."""

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [render(x.as_py()) for x in part["html"]]
                columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.record_batch([part["page_id"], *columns], ["page_id", "visible_text", "n_blocks", "n_items", "n_rows"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return in_batches(pages.select("page_id", "html"), rendered, f"page_id {kind}, visible_text string, n_blocks long, n_items long, n_rows long")


def op4_rendered_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
