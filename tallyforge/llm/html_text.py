"""HTML extraction (operator 4): a tree builder with implied tags and visibility rules feeds a layout of blocks, lists and tables."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: what an element's start closes, which elements have no end, no text, or text that isn't markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
UNSEEN = frozenset("audio canvas datalist head iframe noembed noframes noscript object param script style svg template title video".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
BLOCKS = SPACED | frozenset("address article aside body caption center dd details dialog div dt figcaption footer form header hgroup html legend li main menu nav option section summary tr".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "tbody": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "tfoot": {"td", "th", "tr", "tbody", "thead", "tfoot"},
}
BARRIER = {"li": {"ol", "ul", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}} | dict.fromkeys(("tr", "td", "th", "thead", "tbody", "tfoot"), {"table"})
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
OF_TABLES = frozenset("table tr tbody thead tfoot body html".split())
CLOSES_P = BLOCKS - {"body", "html", "option", "tr", "caption", "legend"}

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s\"'>]+)))?")
HIDES = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible|initial)\b", re.I)
#: Bounds of padding, without which a page's text could grow with the square of the page; no text is left out by them.
#: Cells are padded to a column's widest cell of at most so many characters; list items are indented so many levels; a cell spans so many columns.
MOST_WIDTH, MOST_INDENT, MOST_SPAN = 80, 16, 64
#: Tables nested deeper, and rows of more lines times columns, have their cells one below the other.
MOST_TABLES, MOST_GRID = 16, 100_000
SPACES = re.compile(r"[ \t\n\f\r]+")


class Flow:
    """Lines of text; breaks and spaces wait until text follows them."""

    def __init__(self, levels: int = MOST_INDENT, cell: bool = False):
        self.lines: deque[str] = deque()  # finished ones
        self.line: list[str] | None = None  # the open one
        self.levels, self.cell = levels, cell
        self.indents: list[str] = []
        self.breaks = 0
        self.space = False
        self.bare = True  # nothing but markers in the line so far

    def brk(self, lines: int) -> None:
        if self.line is not None:
            self.breaks = max(self.breaks, lines)
        self.space = False

    def _indent(self) -> str:
        return "".join(self.indents[: self.levels])

    def _finish(self) -> None:
        if self.line is not None:
            line = "".join(self.line)
            self.lines.append(line.rstrip() if self.cell else line)

    def _line(self) -> None:
        if self.breaks or self.line is None:
            self._finish()
            self.lines.extend([""] * (self.breaks - (self.line is not None)))
            self.line, self.breaks, self.bare = [self._indent()], 0, True

    def text(self, text: str) -> None:
        words = SPACES.sub(" ", text)
        if words == " " or not words:
            self.space = self.space or (bool(words) and not self.breaks and self.line is not None)
            return
        lead = self.space or words[0] == " "
        self._line()
        self.line.append((" " if lead and not self.bare else "") + words.strip(" "))
        self.space, self.bare = words[-1] == " ", False

    def verbatim(self, text: str) -> None:
        for k, line in enumerate(text.split("\n")):
            if k:
                self.breaks += 1
            if line.strip():
                self._line()
                self.line.append(line)
                self.bare = False

    def place(self, inner: deque[str]) -> None:
        """Takes over lines that are laid out, as they are where nothing indents them; of two rows of lines the shorter one is moved."""
        while inner and not inner[0].strip():
            inner.popleft()
            self.breaks += 1
        after = 0
        while inner and not inner[-1].strip():
            inner.pop()
            after += 1
        if not inner:
            return
        self._line()
        self.line.append(inner.popleft())
        if inner and self._indent():
            for line in inner:
                self._finish()
                self.line = [self._indent(), line] if line.strip() else []
        elif inner:
            self._finish()
            self.line = [inner.pop()]
            if len(self.lines) < len(inner):
                inner.extendleft(reversed(self.lines))
                self.lines = inner
            else:
                self.lines.extend(inner)
        self.breaks, self.bare = after, False

    def marker(self, text: str) -> None:
        self._line()
        self.line.append(text)
        self.bare = True

    def done(self) -> deque[str]:
        """All lines; the flow isn't used after that."""
        self._finish()
        self.line = None
        return self.lines


def _below(cells: list[deque[str]]) -> deque[str]:
    """Cells one below the other; the longest one's lines stay where they are."""
    full = [c for c in cells if c]
    if not full:
        return deque()
    at = max(range(len(full)), key=lambda k: len(full[k]))
    lines = full[at]
    for cell in reversed(full[:at]):
        lines.extendleft(reversed(cell))
    for cell in full[at + 1 :]:
        lines.extend(cell)
    return lines


def _table(rows: list[list[deque[str]]], nested: int) -> deque[str]:
    """Cells in columns of equal width, as far as MOST_WIDTH goes; a cell of several lines fills as many lines of its row."""
    rows = [r for r in rows if any(r)]
    if nested > MOST_TABLES or all(len(r) == 1 for r in rows):
        return _below([c for r in rows for c in r])
    widths: list[int] = []
    for row in rows:
        for k, cell in enumerate(row):
            width = max(map(len, cell), default=0)
            if k == len(widths):
                widths.append(0)
            if width <= MOST_WIDTH:
                widths[k] = max(widths[k], width)
    lines: deque[str] = deque()
    for row in rows:
        height = max(map(len, row))
        if height * len(row) > MOST_GRID:
            lines.extend(_below(row))
            continue
        cells = [list(c) for c in row]
        for n in range(height):
            lines.append(" | ".join((c[n] if n < len(c) else "").ljust(w) for c, w in zip(cells, widths)).rstrip())  # noqa: B905
    return lines


class Open:
    """The open elements, and where those of each name are."""

    def __init__(self):
        self.names: list[str] = []
        self.outside: list[tuple[bool, bool]] = []  # hidden and veiled outside each
        self.at: dict[str, list[int]] = {}

    def __len__(self) -> int:
        return len(self.names)

    def push(self, name: str, hidden: bool, veiled: bool) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.outside.append((hidden, veiled))

    def pop(self) -> tuple[str, bool, bool]:
        name = self.names.pop()
        self.at[name].pop()
        return name, *self.outside.pop()

    def top(self) -> str:
        return self.names[-1] if self.names else ""

    def last(self, *names: str) -> int:
        """The innermost of any of the names, -1 if none is open."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def first_after(self, place: int, names: Iterable[str]) -> int | None:
        """The outermost of any of the names within an element."""
        found = [own[k] for n in names if (own := self.at.get(n)) and (k := bisect_right(own, place)) < len(own)]
        return min(found, default=None)


def visible_text(html: str) -> str:
    """All text that a browser would show, laid out with blank lines round blocks, list markers and aligned cells."""
    flow = Flow()
    open_ = Open()
    lists: list[list] = []  # kind, number
    tables: list[tuple[Flow, list[list[deque[str]]], list[int], list[bool]]] = []  # the flow outside, the rows, columns of the open cell or 0, texts put before it
    hidden = False  # not laid out, nor is anything inside
    veiled = False  # laid out without its text; what is inside may be visible again

    def inner() -> Flow:
        """A flow inside the innermost table, indented by what its surroundings have left."""
        outside = tables[-1][0]
        return Flow(max(0, outside.levels - len(outside.indents)), True)

    def stray() -> None:
        """Puts what a table holds outside its cells before the table."""
        left = flow.done()
        if left:
            outside = tables[-1][0]
            outside.brk(1 if tables[-1][3] else 2)
            outside.place(left)
            outside.brk(1)
            tables[-1][3].append(True)

    def close(down_to: int) -> None:
        nonlocal flow, hidden, veiled
        while len(open_) > down_to:
            name, was_hidden, was_veiled = open_.pop()
            if not hidden:
                if name in ("td", "th") and tables and tables[-1][2][0]:
                    tables[-1][1][-1] += [flow.done(), *[deque() for _ in range(tables[-1][2][0] - 1)]]
                    tables[-1][2][0] = 0
                    flow = inner()
                elif name == "table" and tables:
                    stray()
                    flow, rows, _, before = tables.pop()
                    flow.brk(1 if before else 2)
                    flow.place(_table(rows, len(tables) + 1))
                    flow.brk(2)
                elif name == "li":
                    if flow.indents:
                        flow.indents.pop()
                    flow.brk(1)
                elif name in ("ol", "ul", "menu"):
                    if lists:
                        lists.pop()
                    flow.brk(1 if lists else 2)
                elif name in BLOCKS:
                    flow.brk(2 if name in SPACED else 1)
            hidden, veiled = was_hidden, was_veiled

    def start(name: str, attributes: str) -> None:
        nonlocal flow, hidden, veiled
        if open_.top() == "head" and name not in IN_HEAD:
            close(len(open_) - 1)
        if name in CLOSES_P and open_.last("p") > open_.last("td", "th", "li", "table", "button", "div", "article", "body"):
            close(open_.last("p"))
        ends = CLOSED_BY.get(name)
        if ends:
            at = open_.first_after(open_.last(*BARRIER.get(name, ())), ends)
            if at is not None:
                close(at)
        seen = {a.lower(): b or c or d or "" for a, b, c, d in ATTRIBUTE.findall(attributes)} if attributes else {}
        hides = name in UNSEEN or "hidden" in seen or bool(HIDES.search(seen.get("style", ""))) or (name == "dialog" and "open" not in seen)
        if name not in VOID:
            open_.push(name, hidden, veiled)
            said = VISIBILITY.findall(seen.get("style", ""))
            veiled = said[-1].lower() in ("hidden", "collapse") if said else veiled
        if hidden or hides:
            hidden = hidden or (hides and name not in VOID)
            return
        if name == "br":
            flow.breaks = min(flow.breaks + 1, 2) if flow.line is not None else 0
            flow.space = False
        elif name == "table":
            tables.append((flow, [], [0], []))
            flow = inner()
        elif name == "tr" and tables:
            tables[-1][1].append([])
        elif name in ("td", "th") and tables:
            if not tables[-1][1]:
                tables[-1][1].append([])
            stray()
            span = seen.get("colspan", "1")
            tables[-1][2][0] = max(1, min(int(span), MOST_SPAN)) if re.fullmatch("[0-9]{1,4}", span) else 1
            flow = inner()
        elif name == "li":
            flow.brk(1)
            if lists and lists[-1][0] == "ol":
                lists[-1][1] += 1
                sign = f"{lists[-1][1]}. "
            else:
                sign = "- "
            if not veiled:
                flow.marker(sign)
            flow.indents.append(" " * len(sign))
        elif name in ("ol", "ul", "menu"):
            flow.brk(1 if lists else 2)
            first = seen.get("start", "1")
            lists.append([name, (int(first) if re.fullmatch(r"-?[0-9]{1,9}", first) else 1) - 1])
        elif name in BLOCKS:
            flow.brk(2 if name in SPACED else 1)

    at, end = 0, len(html)
    while at < end:
        found = TOKEN.search(html, at)
        stop = found.start() if found else end
        if stop > at and open_.top() == "head" and unescape(html[at:stop]).strip(" \t\n\f\r"):
            close(len(open_) - 1)
        if stop > at and not hidden and not veiled:
            text = unescape(html[at:stop])
            if open_.at.get("pre"):
                flow.verbatim(text)
            else:
                flow.text(text)
        if not found:
            break
        at = found.end()
        if found[2]:
            name = found[2].lower()
            if found[1]:
                own = open_.last(name)
                if name == "p" and own < 0:
                    flow.brk(2)
                if own >= 0 and (name in OF_TABLES or own >= open_.last("table", "td", "th")):
                    close(own)
            else:
                start(name, found[3])
                if name in RAW:
                    finish = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                    stop = finish.start() if finish else end
                    if not hidden and not veiled:
                        flow.verbatim(unescape(html[at:stop]))
                    at = stop
    close(0)
    return "\n".join(flow.done()).rstrip()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [visible_text(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text. Each page is rendered by itself, so nothing is shuffled.

    Cells stand in columns as wide as their widest cell of MOST_WIDTH characters or fewer; a cell of several columns is followed by
    empty ones, and rows that a cell spans downwards are not moved. Null and empty pages give an empty text; broken markup, whatever its depth, is read as far as a browser would and
    never fails; repeated rows give a row each; an empty table gives no rows; other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string")
