"""Layout-aware rendering of HTML: all visible text, with block spacing, lists and aligned table cells.

Pages are independent, so this is one Arrow pass without a shuffle. A tokenizer feeds a builder that keeps the stack of
open elements and adds the ends that HTML leaves out; what it opens and closes drives the renderer. Both are
iterative, so deep nesting costs memory in proportion and no recursion.

The text is never longer than a fixed multiple of the page. Cells are padded so that columns start at one place. A column
is as wide as its longest line of at most ``WIDEST`` characters, and a longer line sticks out whole; a run of empty cells
takes at most ``WIDEST`` characters. Both hold for every table, whatever its size. Only a table that holds another table
lays the page out: its rows are written without padding and without empty cells. Marks of lists and quotes are drawn for the outermost
``DEEPEST`` levels only.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skyfold.llm.common import without

# Element classes of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
HIDDEN = set("head script style title template iframe noembed noframes svg canvas audio video object datalist".split())
HEAD = set("title meta link script style base noscript template head html".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset details".split())
BLOCK = SPACED | set("address article aside body center dd div dt figcaption footer form header html legend li main menu nav option section summary "
                     "caption search hgroup dialog optgroup".split())
TABLE = {"table", "caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}
LISTS = {"ul", "ol", "menu", "dir"}
# What an opening tag closes, and where the search for it ends.
CLOSES = {
    "li": ({"li"}, LISTS | {"table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **{t: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
}
SHUTS_P = BLOCK - {"option", "optgroup", "body", "html", "legend", "caption"}

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NO_SHOW = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")
BULLETS = ("* ", "- ", "+ ")
WIDEST = 60
MOST_SPAN = 1000  # as HTML bounds it
DEEPEST = 12


def attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


class Lines:
    """Lines under construction, with pending blank lines and the marks of open lists."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap, self.marks = 0, []
        self.blank = True  # the open line has no visible character, or ends in a blank

    def text(self, value: str, pre: bool) -> None:
        if pre:
            first, *rest = value.replace("\r\n", "\n").split("\n")
            self.parts.append(first)
            for line in rest:
                self.end(keep=True)
                self.parts.append(line)
            self.blank = not "".join(self.parts).strip()
            return
        value = SPACES.sub(" ", value)
        if self.blank and value[:1] == " ":
            value = value[1:]
        if value:
            self.parts.append(value)
            self.blank = value[-1] == " "

    def end(self, keep: bool = False) -> bool:
        """Finish the open line; ``keep`` also keeps an empty one."""
        line = "".join(self.parts).rstrip(" \t\n")
        self.parts, self.blank = [], True
        if not line.strip() and not (keep and self.lines):
            return False
        if self.lines and self.gap:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        lead = ""
        for mark in self.marks[:DEEPEST]:
            lead += mark[0]
            mark[0] = mark[1]
        self.lines.append((lead + line).rstrip())
        return True

    def block(self, gap: int) -> None:
        self.end()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.end()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return lines


class Table:
    """Rows of an open table: cells as (lines, columns they span)."""

    def __init__(self):
        self.rows: list[list[tuple[list[str], int]]] = []
        self.layout = False

    def lines(self) -> list[str]:
        """The rows as lines, with columns that start at one place by the module's rule."""
        rows = [r for r in self.rows if any(cell for cell, _ in r)]
        if self.layout:
            return self.plain(rows)
        widths: dict[int, int] = {}
        for row in rows:
            at = 0
            for cell, span in row:
                widths[at] = max([widths.get(at, 0), *(len(line) for line in cell if len(line) <= WIDEST)])
                at += span
        last = max(widths, default=0)
        out = []
        for row in rows:
            texts: list[list[tuple[int, str]]] = [[] for _ in range(max(len(cell) for cell, _ in row))]
            at = 0
            for cell, span in row:
                for k, line in enumerate(cell):
                    if line:
                        texts[k].append((at, line))
                at += span
            end = min(at, last + 1)
            for line in texts:
                cells, at = [], 0
                for start, text in line:
                    cells += self.blanks(widths, at, start)
                    cells.append(text.ljust(widths[start]))
                    at = start + 1
                out.append(" | ".join(cells + self.blanks(widths, at, end)).rstrip())
        return out

    @staticmethod
    def blanks(widths: dict[int, int], start: int, end: int) -> list[str]:
        """Empty cells for a run of columns, as many as ``WIDEST`` characters hold."""
        cells, room = [], WIDEST
        for column in range(start, end):
            room -= widths.get(column, 0) + 3
            if room < 0:
                break
            cells.append(" " * widths.get(column, 0))
        return cells

    @staticmethod
    def plain(rows) -> list[str]:
        """Rows of single lines as one line each; the lines of longer cells below each other."""
        out = []
        for row in rows:
            cells = [cell for cell, _ in row if cell]
            if all(len(cell) == 1 for cell in cells):
                out.append(" | ".join(cell[0] for cell in cells))
            else:
                out.extend(line for cell in cells for line in cell)
        return out


class Renderer:
    """Builds the stack of open elements and renders as elements open and close."""

    def __init__(self):
        self.stack: list[tuple[str, bool, object]] = []  # tag, hidden, what its end needs
        self.open: Counter[str] = Counter()
        self.page, self.outer = Lines(), []  # the sink, and those around open table cells
        self.hidden = self.pre = self.depth = 0

    # The builder.
    def start(self, tag: str, attrs: str) -> None:
        if self.open["head"] and tag not in HEAD:
            self.close("head")
        if tag == "body" and self.open["body"] or tag == "html" and self.open["html"]:
            return
        if tag in SHUTS_P and self.open["p"]:
            self.up_to({"p"}, {"table", "td", "th", "caption", "button"})
        if tag in CLOSES:
            self.up_to(*CLOSES[tag])
        if tag in ("td", "th") and self.open["table"] and not self._inside_row():
            self.push("tr", {})
        self.push(tag, attributes(attrs))
        if tag in VOID:
            self.pop()

    def _inside_row(self) -> bool:
        return next((t for t, _, _ in reversed(self.stack) if t in ("tr", "table")), "") == "tr"

    def up_to(self, tags: set[str], walls: set[str]) -> None:
        """Close everything up to the outermost of ``tags`` that no wall shuts off."""
        if not any(self.open[t] for t in tags):
            return
        found = None
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name in walls:
                break
            if name in tags:
                found = i
                if tags <= {"p", "li", "td", "th", "dt", "dd", "option"}:
                    break
        while found is not None and len(self.stack) > found:
            self.pop()

    def close(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag == "p" and not self.open["p"]:
            self.page.block(1) if not self.hidden else None
        elif self.open[tag]:
            wall = set() if tag in TABLE or tag in ("body", "html", "head") else {"table", "td", "th"}
            self.up_to({tag}, wall) if tag not in TABLE else self._close_table_part(tag)

    def _close_table_part(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i][0] == "table":
                return

    # The renderer.
    def push(self, tag: str, attrs: dict[str, str]) -> None:
        hidden = tag in HIDDEN or "hidden" in attrs or bool(NO_SHOW.search(attrs.get("style", "")))
        self.hidden += hidden
        needs: object = None
        if not self.hidden:
            needs = self.enter(tag, attrs)
        self.stack.append((tag, hidden, needs))
        self.open[tag] += 1

    def pop(self) -> None:
        tag, hidden, needs = self.stack.pop()
        self.open[tag] -= 1
        if not self.hidden:
            self.leave(tag, needs)
        self.hidden -= hidden

    def enter(self, tag: str, attrs: dict[str, str]):
        page = self.page
        if tag == "br":
            if not page.end():
                page.gap = max(page.gap, 1)
        elif tag == "hr":
            page.block(1)
            page.text("---", False)
            page.block(1)
        elif tag in LISTS:
            page.block(0 if self.depth else 1)
            self.depth += 1
            first = re.fullmatch(r"-?\d{1,9}", attrs.get("start", ""))
            return [tag, int(first[0]) if first else 1]
        elif tag == "li":
            page.block(0)
            kind = next((n for t, _, n in reversed(self.stack) if t in LISTS and n), None)
            if kind and kind[0] == "ol":
                mark = f"{kind[1]}. "
                kind[1] += 1
            else:
                mark = BULLETS[max(self.depth - 1, 0) % 3]
            page.marks.append([mark, " " * len(mark)])
            return True
        elif tag in ("dd", "blockquote"):
            page.block(int(tag == "blockquote"))
            page.marks.append(["    ", "    "] if tag == "dd" else ["> ", "> "])
            return True
        elif tag == "pre":
            page.block(1)
            self.pre += 1
        elif tag == "table":
            page.block(1)
            around = self._table()
            if around is not None:
                around.layout = True
            return Table()
        elif tag == "tr":
            table = self._table()
            if table is not None:
                table.rows.append([])
        elif tag in ("td", "th"):
            table = self._table()
            if table is not None and table.rows:
                self.outer.append((page, self.depth))
                self.page, self.depth = Lines(), 0
                span = re.fullmatch(r"\s*(\d+)\s*", attrs.get("colspan", ""))
                return table.rows[-1], min(max(1, int(span[1][:5])), MOST_SPAN) if span else 1
            page.text(" ", False)
        elif tag in BLOCK:
            page.block(int(tag in SPACED))
        return None

    def leave(self, tag: str, needs) -> None:
        page = self.page
        if tag in ("td", "th") and needs:
            row, span = needs
            row.append((page.done(), span))
            self.page, self.depth = self.outer.pop()
        elif tag == "table":
            page.block(1)
            for line in needs.lines() if needs else ():
                page.parts, page.blank = [line], False
                page.end()
            page.gap = max(page.gap, 1)
        elif tag in LISTS:
            self.depth -= 1
            page.block(0 if self.depth else 1)
        elif tag in ("li", "dd", "blockquote"):
            page.block(int(tag == "blockquote"))
            page.marks.pop()
        elif tag == "pre":
            self.pre -= 1
            page.block(1)
        elif tag in BLOCK:
            page.block(int(tag in SPACED))

    def _table(self) -> Table | None:
        return next((n for t, _, n in reversed(self.stack) if t == "table"), None)

    def text(self, value: str) -> None:
        if self.open["head"] and not value.isspace() and self.stack[-1][0] in ("head", "html"):
            self.close("head")
        if not self.hidden:
            self.page.text(html.unescape(value) if "&" in value else value, bool(self.pre))

    def finish(self) -> str:
        while self.stack:
            self.pop()
        return "\n".join(self.page.done())


def render(page: str) -> str:
    """The visible text of a page."""
    renderer, at = Renderer(), 0
    while at < len(page):
        start = page.find("<", at)
        start = len(page) if start < 0 else start
        if start > at:
            renderer.text(page[at:start])
        if start == len(page):
            break
        token = TOKEN.match(page, start)
        if not token:
            renderer.text("<")
            at = start + 1
            continue
        at = token.end()
        tag = (token["tag"] or token["tag2"] or "").lower()
        if token["cdata"] is not None:
            renderer.text(token["cdata"].replace("&", "&amp;"))
        elif tag and (token["end"] or token["end2"]):
            renderer.close(tag)
        elif tag:
            renderer.start(tag, token["attrs"] or token["attrs2"] or "")
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                stop = stop.start() if stop else len(page)
                value = page[at:stop]
                if value:
                    renderer.text(value if tag in ("textarea", "title") else value.replace("&", "&amp;"))
                at = stop
    return renderer.finish()


def extract(pages: DataFrame, html_column: str = "html", output: str = "visible_text") -> DataFrame:
    """``pages`` with the visible text. Null stays null, an empty page gives an empty text, an empty table stays empty.

    A page may be long: time and text grow in proportion to it. Other columns and repeated rows pass unchanged; an earlier column named ``output`` is replaced.
    """
    pages = without(pages, output)

    def run(batches):
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(html_column))
            texts = [None if v is None else render(v) for v in (x.as_py() for x in values)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, output])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(output, T.StringType())]))

