"""HTML extraction: a tree builder with implied tags, visibility rules, and a layout-aware renderer.

The builder turns a page into balanced open, text and close events; the renderer keeps
a stack of flows (the page, and every open table cell) and never recurses, so depth is
bounded by memory only.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklattice.llm.common import steps

# Possessive, so that a part that does not fit is not tried again piece by piece.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))(?![\w-])", re.I)
SPACE = " \t\n\r\f"

# Names of the HTML standard, by their role in the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes datalist object video audio canvas".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure fieldset form details".split())
BLOCKS = PARAGRAPHS | frozenset(
    "html body div section article aside header footer nav main address li dt dd hr center dir summary figcaption legend caption search hgroup option optgroup".split()
)
CLOSES_P = BLOCKS - frozenset("html body caption legend option optgroup".split()) | {"xmp", "listing", "plaintext"}
TABLE_PARTS = frozenset("caption colgroup thead tbody tfoot tr td th".split())
# Start tags that end an open element, and the elements that keep them from looking further out.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th", "caption", "colgroup"), ("table", "tr")),
    "th": (("td", "th", "caption", "colgroup"), ("table", "tr")),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table", "tbody", "thead", "tfoot")),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "caption": (("caption",), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "rt": (("rt", "rp"), ("ruby",)),
    "rp": (("rt", "rp"), ("ruby",)),
    "body": (("head",), ()),
}
HEAD_PARTS = frozenset("base link meta title style script template noscript".split())
SCOPE_ENDS = frozenset("table td th caption html button object".split())
# A column is aligned to its widest cell of at most so many characters.
COLUMN_WIDTH = 60


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """Balanced ("open", name, attributes), ("text", text, "") and ("close", name, "") events."""
    stack: list[str] = []
    at, size = 0, len(page)
    # No tag ends behind the last of these; a tag that begins before it ends, so no search runs to the end in vain.
    last = page.rfind(">") + 1
    match = TOKEN.search(page, 0, last)
    count: dict[str, int] = {}

    def close_to(depth: int) -> Iterator[tuple[str, str, str]]:
        while len(stack) > depth:
            name = stack.pop()
            count[name] -= 1
            yield "close", name, ""

    def innermost(names: tuple[str, ...] | frozenset, stops: tuple[str, ...] | frozenset) -> int | None:
        """Depth of the outermost open element of ``names`` inside the nearest of ``stops``."""
        if not any(count.get(n) for n in names):
            return None
        found = None
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth] in names:
                found = depth
            elif stack[depth] in stops:
                break
        return found

    def push(name: str, attributes: str) -> tuple[str, str, str]:
        stack.append(name)
        count[name] = count.get(name, 0) + 1
        return "open", name, attributes

    while match:
        if match.start() > at:
            if count.get("head") and page[at : match.start()].strip(SPACE):
                yield from close_to(stack.index("head"))
            yield "text", page[at : match.start()], ""
        at = match.end()
        if page.startswith("<!--", match.start()) and not page.endswith("-->", match.start() + 4, at):
            # A comment without an end takes all that follows.
            at = size
        ending, name, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if name:
            name = name.lower()
            if ending:
                if name == "p" and not count.get("p"):
                    yield "open", "p", ""
                    yield "close", "p", ""
                elif count.get(name):
                    stops = (frozenset(("table",)) if name in TABLE_PARTS | {"table"} else SCOPE_ENDS) - {name}
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth] == name:
                            yield from close_to(depth)
                            break
                        if stack[depth] in stops:
                            break
            else:
                if count.get("head") and name not in HEAD_PARTS:
                    yield from close_to(stack.index("head"))
                if name in CLOSES_P and count.get("p"):
                    depth = innermost(("p",), SCOPE_ENDS)
                    if depth is not None:
                        yield from close_to(depth)
                if name in ENDS:
                    depth = innermost(*ENDS[name])
                    if depth is not None:
                        yield from close_to(depth)
                if name in ("td", "th") and (not stack or stack[-1] in ("table", "tbody", "thead", "tfoot")):
                    yield push("tr", "")
                if name in VOID:
                    yield "open", name, attributes
                    yield "close", name, ""
                elif not (name in ("html", "body") and count.get(name)):
                    yield push(name, attributes)
                    if name in RAW:
                        end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at, last)
                        yield "text", page[at : end.start() if end else size], ""
                        yield from close_to(len(stack) - 1)
                        at = end.end() if end else size
        match = TOKEN.search(page, at, last) if at < last else None
    comment = page.find("<!--", at)
    if at < (comment if comment >= 0 else size):
        yield "text", page[at : comment if comment >= 0 else size], ""
    yield from close_to(0)


class _Flow:
    """Lines of one column of text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = False
        self.indent: list[str] = []
        self.marker = ""

    def _begin(self) -> None:
        if not self.parts:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.parts.append("".join(self.indent[:-1]) + self.marker if self.marker else "".join(self.indent))
            self.marker = ""
            self.space = False

    def text(self, text: str) -> None:
        words = text.split()
        if words:
            self.space |= text[0].isspace()
            self._begin()
            if self.space and len(self.parts) > 1:
                self.parts.append(" ")
            self.parts.append(" ".join(words))
            self.space = text[-1].isspace()
        elif text:
            self.space = True

    def plain(self, text: str) -> None:
        for k, line in enumerate(text.split("\n")):
            if k:
                self.newline()
            if line:
                self._begin()
                self.parts.append(line)

    def newline(self) -> None:
        self._begin()
        self.end()

    def end(self) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip())
            self.parts = []
        self.space = False

    def block(self, paragraph: bool) -> None:
        self.end()
        self.gap |= paragraph

    def result(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """The rows of (lines, columns, rows spanned) as text with aligned columns."""
    placed: list[dict[int, list[str]]] = [{} for _ in rows]
    taken: list[set[int]] = [set() for _ in rows]
    for k, row in enumerate(rows):
        column = 0
        for lines, wide, tall in row:
            while column in taken[k]:
                column += 1
            placed[k][column] = lines
            for below in range(k, min(k + tall, len(rows))):
                taken[below].update(range(column, column + wide))
            column += wide
    widths: dict[int, int] = {}
    for row in placed:
        for column, lines in row.items():
            for line in lines:
                if len(line) <= COLUMN_WIDTH:
                    widths[column] = max(widths.get(column, 0), len(line))
    out = []
    for row, full in zip(placed, taken):
        columns = sorted({c for c in full if c in widths or c in row})
        for k in range(max((len(lines) for lines in row.values()), default=0)):
            cells = [(row[c][k] if c in row and k < len(row[c]) else "").ljust(widths.get(c, 0)) for c in columns]
            out.append(" | ".join(cells).rstrip())
    return out


def _span(attributes: dict[str, str], name: str) -> int:
    value = attributes.get(name, "").strip()
    return min(1000, max(1, int(value))) if value.isascii() and value.isdigit() else 1


def _number(attributes: dict[str, str], name: str, otherwise: int) -> int:
    """A list's number as written, of any size and sign."""
    value = re.match(r"[ \t\n\r\f]*([+-]?[0-9]{1,18})", attributes.get(name, ""))
    return int(value[1]) if value else otherwise


def render(page: str | None) -> str:
    """All visible text of a page, laid out; a null or empty page gives an empty text."""
    flow, outer = _Flow(), []
    tables: list[dict] = []
    lists: list[list] = []
    hidden = pre = 0
    marks: list[tuple[str, bool, bool]] = []  # of open elements: name, hides, keeps white space
    for kind, name, extra in events(page or ""):
        if kind == "text":
            if not hidden:
                text = html.unescape(name) if "&" in name else name
                if pre:
                    flow.plain(text)
                elif not (tables and tables[-1]["flow"] is flow) or text.strip():
                    flow.text(text)
            continue
        if kind == "open":
            attributes = _attributes(extra) if extra and not extra.isspace() else {}
            hides = name in UNSEEN or "hidden" in attributes or bool(HIDING.search(attributes.get("style", "")))
            keeps = name in ("pre", "textarea", "listing", "xmp")
            if name not in VOID:
                marks.append((name, hides, keeps))
                hidden += hides
                pre += keeps
            if hidden or hides:
                continue
            if name in BLOCKS:
                flow.block(name in PARAGRAPHS and not (name in ("ul", "ol") and lists))
            if name == "br":
                flow.newline()
            elif name == "hr":
                flow.text("---")
                flow.end()
            elif name in ("ul", "ol", "menu", "dir"):
                lists.append([name == "ol", _number(attributes, "start", 1)])
            elif name == "li":
                marker = "- "
                if lists and lists[-1][0]:
                    number = _number(attributes, "value", lists[-1][1])
                    lists[-1][1] = number + 1
                    marker = f"{number}. "
                flow.indent.append(" " * len(marker))
                flow.marker = marker
            elif name in ("dd", "blockquote"):
                flow.indent.append("  ")
            elif name == "table":
                tables.append({"rows": [], "flow": flow})
            elif name == "tr" and tables:
                tables[-1]["rows"].append([])
            elif name in ("td", "th") and tables and tables[-1]["flow"] is flow:
                if not tables[-1]["rows"]:
                    tables[-1]["rows"].append([])
                outer.append((flow, lists, _span(attributes, "colspan"), _span(attributes, "rowspan")))
                flow, lists = _Flow(), []
            continue
        if name in VOID:
            continue
        _, hides, keeps = marks.pop()
        seen = not hidden
        hidden -= hides
        pre -= keeps
        if not seen:
            continue
        if name in ("td", "th") and outer and tables and tables[-1]["flow"] is outer[-1][0]:
            lines = flow.result()
            flow, lists, wide, tall = outer.pop()
            tables[-1]["rows"][-1].append((lines, wide, tall))
        elif name == "table" and tables:
            for line in _grid(tables.pop()["rows"]):
                flow.plain(line)
                flow.end()
        if name in BLOCKS:
            flow.block(name in PARAGRAPHS and not (name in ("ul", "ol") and len(lists) > 1))
        if name in ("ul", "ol", "menu", "dir") and lists:
            lists.pop()
        elif name in ("li", "dd", "blockquote") and flow.indent:
            flow.indent.pop()
            flow.marker = ""
    while outer:
        flow = outer.pop()[0]
    return "\n".join(flow.result())


def _render_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "_html"):
        texts = [render(p) for p in batch.column("_html").to_pylist()]
        kept = [n for n in batch.schema.names if n != "_html"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(texts, pa.string())], names=[*kept, "text"])


def extract(pages: DataFrame, key_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The key columns with ``text``, one row per page; malformed pages are rendered as far as they go.

    Visible is what a browser shows by itself, the options of a selection and the words of formulas and drawings
    included. A null or empty page has an empty text, repeated rows are rendered each, an empty table has no rows. There
    are no ties to break. Long pages are read once from front to back. Other columns, whatever their names, are not read.
    """
    rows = pages.select(*(pages[c] for c in key_cols), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_render_all, f"{schema}, text string")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
