"""Visible text of web pages, laid out as a reader sees it.

A tree builder puts in the tags that authors leave out (a new paragraph ends the
last one, a cell makes its row, stray text in a table goes before it).  A walk
over the tree drops what isn't shown and writes the rest: blocks on lines of
their own, paragraphs set off by a blank line, list items marked and indented,
table cells lined up in columns.  Nothing that is shown is cut, however deep or
wide; both steps take time in proportion to the page (and to the padding).

What style sheets and style attributes say of display and visibility counts in
the order of the cascade, for selectors of one tag, class or id; media queries
are asked of a screen of 1280 by 800.  Scripts are taken to run, so noscript
isn't shown.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of
from .textbytes import slices

# fixed values: groups of HTML elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE_RAW = frozenset("title textarea".split())
UNSEEN = frozenset("head script style template noscript title iframe canvas audio video noembed noframes datalist param colgroup annotation annotation-xml desc metadata defs symbol".split())
TYPED = frozenset("text search email url tel number submit reset button date month week time datetime-local".split())  # kinds of input that show their value
HEAD_ONLY = frozenset("title base link meta style script noscript template".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split())
BLOCKS = SPACED | frozenset(
    "address article aside body center dd details dialog div dt figcaption footer form header html legend li main nav optgroup option search section summary tr thead tbody tfoot caption td th".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt summary".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("td th caption table button html template".split())
# what a start tag ends when it is open, and where the search for it stops
ENDS = {
    "li": ({"li"}, SCOPE | {"ul", "ol", "menu", "object"}), "dt": ({"dt", "dd"}, SCOPE | {"dl", "object"}), "dd": ({"dt", "dd"}, SCOPE | {"dl", "object"}), "option": ({"option"}, SCOPE | {"select", "datalist", "object"}),
    "optgroup": ({"option", "optgroup"}, SCOPE | {"select", "object"}), "tr": ({"tr", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}
CLOSED_WHOLE = frozenset("template select datalist video audio canvas object button svg math".split())  # their end tags end all that is open in them
TABLE_INNER = frozenset("table thead tbody tfoot tr".split())

PADDING = 64  # characters of padding for each of text, beyond which a table's widest cells stick out of their columns
INDENT = 200  # list items and quotes nested deeper aren't indented further
MOST_COLUMNS, MOST_ROWS = 1000, 65534  # fixed values: what HTML lets a cell span
SPACE = re.compile(r"[ \t\n\f\r]+")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?", re.S)
ENDS_OR_QUOTES = re.compile(r"[>\"']")
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
USED_ATTRS = re.compile(r"hidden|style|open|class|id|span|start|value|type", re.I)
BRACES = re.compile(r"[{};]")
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.I)
SCREEN = {"width": 1280.0, "height": 800.0}  # CSS pixels of the screen that media queries are asked of
FEATURE = re.compile(r"\(\s*(min|max)-(?:device-)?(width|height)\s*:\s*([\d.]+)\s*(px|r?em)?\s*\)|\(\s*(width|height)\s*([<>]=?)\s*([\d.]+)\s*(px|r?em)?\s*\)", re.I)
NOT_SO = re.compile(r"\(\s*(?:orientation\s*:\s*portrait|prefers-color-scheme\s*:\s*dark|prefers-reduced-motion\s*:\s*reduce|hover\s*:\s*none|pointer\s*:\s*coarse)\s*\)", re.I)


class Node:
    __slots__ = ("attrs", "before", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.before: list[str] = []  # stray text of a table, which goes before it


def _attributes(text: str) -> dict[str, str]:
    if not text or not USED_ATTRS.search(text):
        return {}
    out: dict[str, str] = {}
    for name, value in ATTR.findall(text):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return out


class Tags:
    """Tags of a page, found in one pass: which ``>`` ends a start tag depends on quotes, and what was learnt about one that never ends is kept."""

    def __init__(self, page: str):
        self.page = page
        self.last_end = page.rfind(">")
        self.marks: list[int] | None = None
        self.endless: set[int] = set()

    def end_of_start(self, at: int) -> int:
        """Place of the ``>`` that ends the start tag at ``at``, or -1."""
        if at > self.last_end:
            return -1
        if self.marks is None:
            self.marks = [m.start() for m in ENDS_OR_QUOTES.finditer(self.page)]
        i, seen = bisect_left(self.marks, at), []
        while i < len(self.marks) and i not in self.endless:
            place = self.marks[i]
            if self.page[place] == ">":
                return place
            seen.append(i)
            close = self.page.find(self.page[place], place + 1) if self.rest(place) else -1
            if close < 0:
                break
            i = bisect_left(self.marks, close) + 1
        self.endless.update(seen)
        return -1

    def rest(self, place: int) -> bool:
        """Whether the quote at ``place`` occurs again."""
        quote = self.page[place]
        if not hasattr(self, "last"):
            self.last = {q: self.page.rfind(q) for q in "\"'"}
        return place < self.last[quote]

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """The next tag or comment from ``at``: begin, end, kind (start, end or none), name, attributes."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            c = page[at + 1 : at + 2]
            if c in ("!", "?") and c:
                found = COMMENT.match(page, at)
                return at, found.end(), "", "", ""
            if c == "/" and page[at + 2 : at + 3].isascii() and page[at + 2 : at + 3].isalpha() and at < self.last_end:
                name = TAG_NAME.match(page, at + 2)
                end = page.find(">", name.end())
                if end >= 0:
                    return at, end + 1, "end", name[0].lower(), ""
            elif c.isascii() and c.isalpha() and (end := self.end_of_start(at + 1)) >= 0:
                name = TAG_NAME.match(page, at + 1, end)
                return at, end + 1, "start", name[0].lower(), page[name.end() : end]
            at += 1
        return None


class Stack:
    """Open elements, with the places of each tag, so that a search needs no walk over them."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks, self.scopes = [root], {}, [], []

    def push(self, node: Node) -> None:
        place = len(self.nodes)
        self.nodes[-1].kids.append(node)
        self.nodes.append(node)
        self.at.setdefault(node.tag, []).append(place)
        if node.tag in BLOCKS:
            self.blocks.append(place)
        if node.tag in SCOPE:
            self.scopes.append(place)

    def pop(self) -> None:
        node = self.nodes.pop()
        self.at[node.tag].pop()
        if node.tag in BLOCKS:
            self.blocks.pop()
        if node.tag in SCOPE:
            self.scopes.pop()

    def last(self, tags) -> int:
        """Place of the innermost open element of ``tags``, 0 if there is none."""
        if tags is BLOCKS:
            return self.blocks[-1] if self.blocks else 0
        if tags is SCOPE:
            return self.scopes[-1] if self.scopes else 0
        return max([self.at[t][-1] for t in tags if self.at.get(t)], default=0)

    def close_to(self, tags, stop) -> bool:
        """Close the innermost element of ``tags``, and all in it, unless one of ``stop`` lies between."""
        place = self.last(tags)
        if not place or self.last(stop) > place:
            return False
        while len(self.nodes) > place:
            self.pop()
        return True

    @property
    def tag(self) -> str:
        return self.nodes[-1].tag if len(self.nodes) > 1 else "html"


SCOPES_BUT = {t: SCOPE - {t} for t in SCOPE}


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree of a page, and the contents of its style elements."""
    root = Node("html", {})
    stack, styles, at, tags = Stack(root), [], 0, Tags(page)
    while at < len(page):
        found = tags.next(at)
        text = page[at : found[0]] if found else page[at:]
        if text:
            if stack.tag == "head" and not text.isspace():
                stack.pop()
            text = html.unescape(text) if "&" in text else text
            place = stack.last(("table",)) if stack.tag in TABLE_INNER and not text.isspace() else 0
            (stack.nodes[place].before if place else stack.nodes[-1].kids).append(text)
        if not found:
            break
        _, at, kind, tag, attrs_text = found
        if kind == "start":
            attrs = _attributes(attrs_text)
            if tag in ("html", "body"):
                stack.close_to(("head",), ())
                root.attrs.update(attrs)
                continue
            if tag not in HEAD_ONLY and stack.tag == "head":
                stack.pop()
            if tag in ENDS_P:
                stack.close_to(("p",), SCOPE)
            if tag in HEADINGS and stack.tag in HEADINGS:
                stack.pop()
            if tag in ENDS:
                ends, stop = ENDS[tag]
                while stack.close_to(ends, stop):
                    pass
                place = stack.last(("table",))
                if tag in ("td", "th", "tr") and place:
                    if stack.last(("tbody", "thead", "tfoot")) < place:
                        stack.push(Node("tbody", {}))
                    if tag != "tr" and stack.last(("tr",)) < place:
                        stack.push(Node("tr", {}))
            if tag in VOID:
                stack.nodes[-1].kids.append(Node(tag, attrs))
            elif tag in RAW or tag in ESCAPABLE_RAW and not (tag == "title" and stack.last(("svg",))):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                inner = page[at : end.start()] if end else page[at:]
                node = Node(tag, attrs)
                node.kids.append(html.unescape(inner) if tag in ESCAPABLE_RAW else inner)
                stack.nodes[-1].kids.append(node)
                if tag == "style":
                    styles.append(inner)
                at = end.end() if end else len(page)
            else:
                stack.push(Node(tag, attrs))
                if attrs_text.endswith("/") and stack.last(("svg", "math")):
                    stack.pop()
        elif kind == "end":
            if tag == "br":
                stack.nodes[-1].kids.append(Node("br", {}))
            elif tag == "p" and not stack.last(("p",)):
                stack.nodes[-1].kids.append(Node("p", {}))
            elif tag in HEADINGS:
                stack.close_to(HEADINGS, SCOPE)
            elif tag in CLOSED_WHOLE:
                stack.close_to((tag,), ())
            elif tag in BLOCKS:
                stack.close_to((tag,), SCOPES_BUT.get(tag, SCOPE) if tag not in TABLE_INNER else {"table"} - {tag})
            else:
                stack.close_to((tag,), BLOCKS)  # an inline element doesn't end the blocks inside it
    return root, styles


def rules(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and bodies of a style sheet's rules, those of media blocks only where these are for screens."""
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S)
    at, open_at, lead, skipped = 0, 0, "", []
    for brace in BRACES.finditer(sheet):
        place, kind = brace.start(), brace[0]
        if kind == "{":
            head = sheet[at:place].strip()
            if head.startswith("@"):  # rules are nested in it
                media = re.match(r"@media\b(.*)", head, re.I | re.S)
                skipped.append(not any(map(_on_screen, media[1].split(","))) if media else bool(re.match(r"@supports\s+not\b|@media\b|@container\b", head, re.I)))
            else:
                lead, open_at = head, place + 1
        elif kind == "}":
            if lead:
                if not any(skipped):
                    yield lead, sheet[open_at:place]
                lead = ""
            elif skipped:
                skipped.pop()
        if kind != ";" or not lead:
            at = place + 1


def _on_screen(query: str) -> bool:
    """Whether one media query holds on ``SCREEN``; features other than size and the commonest preferences are taken to hold."""
    query = query.strip().lower()
    negated = query.startswith("not ")
    query = query.removeprefix("not ").removeprefix("only ").strip()
    kind = "all" if query.startswith("(") else re.split(r"[\s(]", query, maxsplit=1)[0]
    holds = kind in ("all", "screen") and not NOT_SO.search(query)
    for bound, side, n, unit, side2, sign, n2, unit2 in FEATURE.findall(query):
        have, ask = SCREEN[side or side2], float(n or n2) * (16 if (unit or unit2) in ("em", "rem") else 1)
        up = bound == "min" or sign in (">", ">=")
        holds = holds and (have > ask if sign == ">" else have < ask if sign == "<" else have >= ask if up else have <= ask)
    return holds != negated


Declared = dict[str, tuple[bool, int, str]]  # by selector: important, order, value


def declared(body: str) -> dict[str, tuple[bool, str]]:
    """What declarations say of display and visibility: important or not, value; later ones win."""
    out: dict[str, tuple[bool, str]] = {}
    for name, value, important in DECLARED.findall(body):
        name, new = name.lower(), (bool(important), value.lower())
        if name not in out or new[0] >= out[name][0]:
            out[name] = new
    return out


def styled(styles: list[str]) -> dict[str, Declared]:
    """For display and visibility, what each simple selector (tag, .class, #id) last says; compound and nested selectors are not matched."""
    out: dict[str, Declared] = {"display": {}, "visibility": {}}
    order = 0
    for sheet in styles:
        for selectors, body in rules(sheet):
            said = declared(body)
            if not said:
                continue
            order += 1
            for s in selectors.lower().split(","):
                if re.fullmatch(r"[.#]?[\w-]+", s := s.strip()):
                    for name, (important, value) in said.items():
                        new = (important, order, value)
                        if new > out[name].get(s, (False, 0, "")):
                            out[name][s] = new
    return out


def said_of(node: Node, name: str, known: Declared) -> str | None:
    """The value that wins for an element: important ones, then inline, #id, .class and tag, then the later rule."""
    best: tuple[bool, int, int, str] | None = None
    if known:
        a = node.attrs
        named = [(0, node.tag), *((1, f".{c}") for c in a.get("class", "").lower().split()), (2, f"#{a['id'].lower()}" if "id" in a else "")]
        best = max(((k[0], weight, k[1], k[2]) for weight, s in named if (k := known.get(s))), default=None)
    if "style" in node.attrs and (inline := declared(node.attrs["style"]).get(name)) and (best is None or inline[0] >= best[0]):
        return inline[1]
    return best[3] if best else None


class Page:
    """Lines being written; ``gap`` is 1 for a line break that is due, 2 for a blank line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space, self.gap, self.indent, self.marker = False, 0, "", ""

    def text(self, text: str) -> None:
        words = SPACE.split(text)
        if not words[0] and len(words) > 1 and self.line:
            self.space = True
        body = " ".join(w for w in words if w)
        if body:
            if self.space and self.line:
                self.line.append(" ")
            self.line.append(body)
        self.space = (self.space and not body) or (bool(body) and not words[-1])

    def end_line(self, gap: int) -> None:
        if self.line:
            self.put("".join(self.line))
            self.line = []
        self.space = False
        self.gap = max(self.gap, gap)

    def put(self, line: str) -> None:
        if self.gap == 2 and self.lines:
            self.lines.append("")
        lead = self.marker or self.indent
        self.lines.append((lead + line).rstrip())
        self.gap, self.marker = 0, ""


class Table:
    """Rows of cells ``(column, lines)``, and the columns that cells of earlier rows still fill: blocks ``starts[i]`` to ``ends[i]``, apart from one another."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.until: list[tuple[int, int, int]] = []  # a heap of (last row, first column, end)
        self.coming: list[tuple[int, int, int]] = []
        self.run, self.next = 0, 0

    def fill(self, last: int, first: int, end: int) -> None:
        """Columns that are filled already keep the row that frees them."""
        i = bisect_left(self.ends, first)
        j, at = i, first
        low, high = first, end
        while j < len(self.starts) and self.starts[j] <= end:
            if at < self.starts[j]:
                heappush(self.until, (last, at, self.starts[j]))
            at = max(at, self.ends[j])
            low, high = min(low, self.starts[j]), max(high, self.ends[j])
            j += 1
        if at < end:
            heappush(self.until, (last, at, end))
        self.starts[i:j], self.ends[i:j] = [low], [high]

    def free(self, first: int, end: int) -> None:
        i = bisect_right(self.starts, first) - 1
        low, high = self.starts[i], self.ends[i]
        left = [(a, b) for a, b in ((low, first), (end, high)) if a < b]
        self.starts[i : i + 1], self.ends[i : i + 1] = [a for a, _ in left], [b for _, b in left]

    def new_row(self) -> None:
        self.rows.append([])
        while self.until and self.until[0][0] < len(self.rows) - 1:
            self.free(*heappop(self.until)[1:])
        for cell in self.coming:
            self.fill(*cell)
        self.coming.clear()
        self.run = self.next = 0

    def place(self, lines: list[str], cols: int, rows: int) -> None:
        if not self.rows:
            self.new_row()
        while self.run < len(self.starts) and self.starts[self.run] <= self.next:
            self.next = max(self.next, self.ends[self.run])
            self.run += 1
        c = self.next
        if rows > 1:
            self.coming.append((len(self.rows) + rows - 2, c, c + cols))
        self.rows[-1].append((c, lines))
        if cols > 1:
            self.rows[-1].append((c + cols - 1, []))
        self.next = c + cols

    def widths(self) -> dict[int, int] | None:
        """Width of each column: its widest line, unless the padding that makes gets out of proportion; None if even narrow columns do."""
        lengths: dict[int, list[int]] = {}
        for row in self.rows:
            for c, lines in row:
                lengths.setdefault(c, []).extend(map(len, lines))
        text = sum(map(sum, lengths.values()))
        widest = max([max(x, default=0) for x in lengths.values()], default=0)
        while True:
            width = {c: max([n for n in x if n <= widest], default=0) for c, x in lengths.items()}
            ends, total = {}, 0
            for c in sorted(width):
                total += width[c] + 3
                ends[c] = total
            padded = sum(ends[max(c for c, _ in row)] * max(len(x) for _, x in row) for row in self.rows if row)
            if padded <= PADDING * (text + len(self.rows)):
                return width
            if not widest:
                return None
            widest //= 2

    def lines(self) -> Iterator[str]:
        width = self.widths()
        columns = sorted(width or ())
        rank = {c: i for i, c in enumerate(columns)}
        for row in self.rows:
            cells: dict[int, list[str]] = {}
            for c, lines in row:
                cells[c] = lines if lines or c not in cells else cells[c]
            for i in range(max([len(x) for x in cells.values()], default=0)):
                filled = [c for c, x in cells.items() if i < len(x) and x[i].strip()]
                if width is None:
                    yield " | ".join(cells[c][i] for c in sorted(filled))
                    continue
                last = rank[max(filled)] if filled else -1
                yield " | ".join((cells[c][i] if c in cells and i < len(cells[c]) else "").ljust(width[c]) for c in columns[: last + 1]).rstrip()


def _number(text: str | None, least: int, most: int) -> int:
    return min(most, max(least, int(text))) if text and re.fullmatch(r"-?[0-9]{1,9}", text.strip()) else 1


def render(page: str | None) -> str:
    """Visible text of one page; an empty string for null or a page that shows none."""
    if not page:
        return ""
    root, styles = parse(page)
    looks = styled(styles)
    frames, tables, lists = [Page()], [], []

    def shown(node: Node, parent: Node | None) -> bool:
        a = node.attrs
        if node.tag in UNSEEN:
            return False
        if parent is not None and parent.tag == "details" and "open" not in parent.attrs and node.tag != "summary":
            return False
        value = said_of(node, "display", looks["display"]) if a or looks["display"] else None
        if value is not None:
            return value != "none"
        return not ("hidden" in a and a["hidden"].lower() != "until-found" or node.tag == "dialog" and "open" not in a)

    def visible(node: Node, was: bool) -> bool:
        value = said_of(node, "visibility", looks["visibility"]) if node.attrs or looks["visibility"] else None
        return was if value in (None, "inherit") else value in ("visible", "initial", "unset", "revert")

    def enter(node: Node) -> None:
        tag, out = node.tag, frames[-1]
        if tag == "br":
            if out.line:
                out.end_line(1)
            else:
                out.gap = 2
        elif tag in ("td", "th") and tables:
            frames.append(Page())
        elif tag == "tr" and tables:
            tables[-1].new_row()
        elif tag == "input":
            if node.attrs.get("type", "text").strip().lower() in TYPED or node.attrs.get("type", "").strip().lower() not in ("hidden", "password", "checkbox", "radio", "file", "image", "range", "color", ""):
                out.text(" " + node.attrs.get("value", "") + " ")
        elif tag == "text":  # a label in a drawing
            out.text(" ")
        elif tag in BLOCKS:
            out.end_line(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
            if tag == "table":
                tables.append(Table())
            elif tag in ("ul", "ol"):
                lists.append([tag, _number(node.attrs.get("start"), -(10**8), 10**8)])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                if kind[0] == "ol" and "value" in node.attrs:
                    kind[1] = _number(node.attrs["value"], -(10**8), 10**8)
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                out.marker, out.indent = out.indent + mark, (out.indent + " " * len(mark))[:INDENT]
            elif tag in ("dd", "blockquote"):
                out.indent = (out.indent + "  ")[:INDENT]

    def leave(node: Node, indent: str) -> None:
        tag, out = node.tag, frames[-1]
        if tag in ("td", "th") and tables:
            out.end_line(0)
            frames.pop()
            tables[-1].place(out.lines, _number(node.attrs.get("colspan"), 1, MOST_COLUMNS), _number(node.attrs.get("rowspan"), 1, MOST_ROWS))
        elif tag == "table" and tables:
            for line in tables.pop().lines():
                out.put(line)
            out.end_line(2)
        elif tag in BLOCKS and tag != "br":
            if tag in ("ul", "ol"):
                lists.pop()
            out.end_line(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
            out.indent = indent
            if tag == "li":
                out.marker = ""

    def write(text: str, pre: bool) -> None:
        if not pre:
            frames[-1].text(text)
            return
        first, *rest = text.expandtabs(8).split("\n")
        frames[-1].line.append(first)
        for line in rest:
            frames[-1].put("".join(frames[-1].line))
            frames[-1].line = [line]

    def drawn(node: Node, was: bool) -> bool:
        """Whether a node's own text is in a drawing, where only labels are shown."""
        return node.tag == "svg" or (was and node.tag not in ("text", "foreignobject"))

    walk: list = [[root, iter(root.kids), visible(root, True), False, "", False]]
    while walk:
        node, kids, seen, pre, indent, in_drawing = walk[-1]
        kid = next(kids, None)
        if kid is None:
            walk.pop()
            if walk:
                leave(node, indent)
        elif isinstance(kid, str):
            if seen and not in_drawing and (node.tag != "details" or "open" in node.attrs):
                write(kid, pre)
        else:
            if kid.before and seen and not in_drawing:
                for text in kid.before:
                    write(text, pre)
            if shown(kid, node) and (kid.tag != "input" or visible(kid, seen)):
                before = frames[-1].indent
                enter(kid)
                if kid.tag not in VOID:
                    walk.append([kid, iter(kid.kids), visible(kid, seen), pre or kid.tag in ("pre", "textarea"), before, drawn(kid, in_drawing)])
    frames[0].end_line(0)
    return "\n".join(frames[0].lines).strip("\n")


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id",), column: str = "html") -> DataFrame:
    """``keys`` and the visible ``text`` of each row of ``pages``, whole.

    Null and empty pages, and those that show nothing, have empty text.  Rows
    that repeat give a row each; columns other than ``keys`` and the page's own
    are not read, so a ``text`` column among them doesn't clash.
    """
    schema = pages.select(*keys, F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_html"):
                texts = pa.array([render(x) for x in part.column("_html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), texts], [*keys, "text"])

    return pages.select(*keys, text_of(column).alias("_html")).mapInArrow(run, schema)


def op1_html_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page, laid out, and its length; a row for each row of ``pages``, as ``extract`` says."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
