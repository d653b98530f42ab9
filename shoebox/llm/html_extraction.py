"""HTML extraction (operator 7): layout-aware rendering of the visible text.

A small tree builder closes the elements whose end tags HTML lets authors leave out. The renderer walks the tree with a stack of its own
(any nesting depth) and leaves out what a browser does not show: elements that are never rendered, ``hidden`` and ``display: none``
(of the style attribute or of a style sheet, by tag, class and id) with all below them, and text whose inherited visibility is hidden, while a visible part inside it is shown. Inline text
is joined with single spaces, blocks start on new lines, paragraphs and the like
are set off by an empty line, list items are marked and indented, and the cells of a table
are padded so that its columns line up, spans and wide signs counted.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .kernels import lean

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NEVER = frozenset("head script style template noscript title iframe object canvas audio video datalist progress meter rp desc metadata defs symbol clippath mask annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset".split())
BLOCK = SPACED | frozenset("html body address article aside caption center dd details dialog dir div dt fieldset figcaption footer form header hgroup legend li main menu nav optgroup option search section summary tbody td tfoot th thead tr textarea text foreignobject mtr".split())
#: Opening one of the keys ends an open element of the second set, up to an element of the third.
_ROWS = frozenset(("thead", "tbody", "tfoot"))
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "option": ({"option"}, {"select", "optgroup", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"})}
CLOSES |= dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"})) | dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"}))
CLOSES |= {"tr": ({"td", "th", "tr"}, {"table", *_ROWS})} | dict.fromkeys(_ROWS, ({"td", "th", "tr", *_ROWS}, {"table"}))
_ENDS_P = BLOCK - {"html", "body", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup"} | {"hr"}
_RULE = re.compile(r"(?:^|;)\s*(display|visibility|white-space)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
#: HTML's own white space; a no-break space is none and stays.
SPACE = " \t\n\f\r"
_WORDS = re.compile(f"[^{SPACE}]+").findall
_SELECTOR = re.compile(r"([a-z][a-z0-9-]*|\*)?((?:[.#][\w-]+)*)", re.I)
#: white-space values -> how text is set: as it stands, by lines, or run together.
SETTING = {"pre": "pre", "pre-wrap": "pre", "break-spaces": "pre", "pre-line": "line", "normal": "", "nowrap": ""}
#: Input types that show no text of their own, and the labels of buttons without one.
SILENT = frozenset("hidden checkbox radio file password color range image".split())
LABELS = {"submit": "Submit", "reset": "Reset", "button": ""}


class TreeBuilder(HTMLParser):
    """Nodes are [tag, attributes, children]; text is a str child. Hidden subtrees are parsed and left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["html", {}, []]
        self.open = [self.root]
        self.sheets: list[str] = []

    def _close(self, tags, barrier) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in barrier:
                return
            if self.open[i][0] in tags:
                del self.open[i:]
                if not (tags - {"p"}):
                    return
                return self._close(tags, barrier)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and len(self.open) > 1 and any(n[0] == tag for n in self.open):
            return
        if tag == "body":
            self._close({"head"}, set())
        if tag in _ENDS_P:
            self._close({"p"}, {"button", "td", "th", "table", "li", "object"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in BLOCK and tag not in ("html", "body") and self.open[-1][0] == "head":
            self.open.pop()
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        """A slash closes elements of drawings and formulas; elsewhere it means nothing."""
        self.handle_starttag(tag, attrs)
        if self.open[-1][0] == tag and tag not in VOID and any(n[0] in ("svg", "math") for n in self.open):
            self.open.pop()

    def handle_endtag(self, tag):
        barrier = {"table"} if tag not in ("table", "body", "html") else set()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in barrier:
                return

    def handle_data(self, data):
        if self.open[-1][0] == "style":
            self.sheets.append(data)
        self.open[-1][2].append(data)


def declarations(text: str) -> list[tuple[bool, str, str]]:
    """(important, property, value) of the properties that decide what shows."""
    return [(bool(important), name.lower(), value.lower()) for name, value, important in _RULE.findall(text)]


class Sheet:
    """What style sheets say of an element by its tag, classes and id; other selectors are left out, as are rules for other media."""

    def __init__(self, texts: list[str]):
        self.rules, self.used = {}, 0
        for text in texts:
            self._read(re.sub(r"/\*.*?\*/", "", text, flags=re.S))

    def _read(self, text: str) -> None:
        at = 0
        while (start := text.find("{", at)) >= 0:
            depth, end = 1, start + 1
            for sign in re.finditer(r"[{}]", text[start + 1 :]):
                depth += 1 if sign[0] == "{" else -1
                if not depth:
                    end = start + 1 + sign.start()
                    break
            else:
                end = len(text)
            head, body = text[at:start].rpartition(";")[2].strip(), text[start + 1 : end]
            if head.startswith("@"):
                if re.fullmatch(r"@media\s+(all|screen)|@supports.*|@layer.*", head, re.I | re.S):
                    self._read(body)
            elif known := declarations(body):
                for selector in head.split(","):
                    whole = _SELECTOR.fullmatch(selector.strip())
                    if whole and whole[0]:
                        marks = re.findall(r"[.#][\w-]+", whole[2])
                        tag = (whole[1] or "*").lower()
                        rank = (sum(m[0] == "#" for m in marks), sum(m[0] == "." for m in marks), tag != "*")
                        self.used += 1
                        self.rules.setdefault(marks[0] if marks else tag, []).append((tag, frozenset(marks), rank, self.used, known))
            at = end + 1

    def of(self, tag: str, attrs: dict) -> list:
        """(important, rank, order, property, value) of the rules that an element matches."""
        marks = {f".{c}" for c in (attrs.get("class") or "").split()} | ({f"#{attrs['id']}"} if attrs.get("id") else set())
        return [(important, rank, order, name, value) for key in (tag, "*", *marks) for only, need, rank, order, known in self.rules.get(key, ()) if only in ("*", tag) and need <= marks for important, name, value in known]


def styles(tag: str, attrs: dict, sheet: Sheet) -> dict:
    """display, visibility and white-space: important declarations first, then the style attribute, then the closest rule, then the last."""
    own = [(important, (9, 0, 0), i, name, value) for i, (important, name, value) in enumerate(declarations(attrs.get("style") or ""))]
    return {name: value for _, _, _, name, value in sorted(own + (sheet.of(tag, attrs) if sheet.rules else []))} if own or sheet.rules else {}


def in_order(children: list) -> list:
    """A table's children as they show: its caption, its head, its foot last."""
    place = {"caption": 0, "thead": 1, "tfoot": 3}
    seen: dict = {}
    for child in children:
        tag = child[0] if not isinstance(child, str) else ""
        seen.setdefault(tag, child)
    return sorted(children, key=lambda c: 2 if isinstance(c, str) or seen.get(c[0]) is not c else place.get(c[0], 2))


def hidden(tag: str, attrs: dict, style: dict) -> bool:
    """Whether an element and all below it are not rendered."""
    if tag in NEVER or (tag == "dialog" and "open" not in attrs):
        return True
    return style["display"] == "none" if "display" in style else "hidden" in attrs


def field_text(attrs: dict) -> str:
    """What an input shows."""
    kind = (attrs.get("type") or "text").lower()
    if kind in SILENT:
        return (attrs.get("alt") or "") if kind == "image" else ""
    if kind in LABELS:
        return attrs["value"] if attrs.get("value") is not None else LABELS[kind]
    return attrs.get("value") or attrs.get("placeholder") or ""


def shown_options(node) -> list:
    """The children of a select that show: all of a list box, else the selected option, or the first."""
    _, attrs, children = node
    if "multiple" in attrs or _number(attrs.get("size"), 1) > 1:
        return children
    every, stack = [], list(reversed(children))
    while stack:
        child = stack.pop()
        if not isinstance(child, str):
            if child[0] == "option":
                every.append(child)
            elif child[0] == "optgroup":
                stack.extend(reversed(child[2]))
    return [x for x in every if "selected" in x[1]][-1:] or every[:1]


class Page:
    """Lines under construction. ``gap``: empty lines owed before the next text."""

    def __init__(self):
        self.lines, self.now, self.gap, self.space, self.prefix, self.mark = [], [], 0, False, "", ""

    def text(self, data: str, setting: str) -> None:
        if setting == "pre":
            first, *rest = data.split("\n")
            self.now.append(first)
            for line in rest:
                self.end(True)
                self.now.append(line)
            return
        if setting == "line":
            first, *rest = data.split("\n")
            self.text(first, "")
            for line in rest:
                self.end(True)
                self.text(line, "")
            return
        words = _WORDS(data)
        if not words:
            self.space |= bool(data) and bool(self.now)
            return
        if self.now and (self.space or data[0] in SPACE):
            self.now.append(" ")
        self.now.append(" ".join(words))
        self.space = data[-1] in SPACE

    def end(self, keep: bool = False) -> None:
        """Ends the line; an empty one only counts if it is kept."""
        line = "".join(self.now).rstrip(SPACE)
        if line or (keep and self.lines):
            if self.lines and self.gap and line:
                self.lines.extend([""] * self.gap)
            self.lines.append((self.prefix + self.mark + line).rstrip(SPACE))
            self.gap = 0
            self.mark = " " * len(self.mark)
        self.now, self.space = [], False

    def finish(self) -> list[str]:
        self.end()
        return self.lines


def width_of(text: str) -> int:
    """Columns that a text takes: two for a wide sign, none for a combining one."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, colspan, rowspan) as text columns, two spaces apart. Columns in which no cell begins take no room."""
    placed, busy = [], {}  # busy: column -> rows that a cell above still takes
    for row in rows:
        at, cells, taken = 0, [], {}
        for lines, across, down in row:
            while busy.get(at, 0) > 0:
                at += 1
            cells.append((at, across, lines))
            taken.update(dict.fromkeys(range(at, at + across), down))
            at += across
        both = {c: max(busy.get(c, 0), taken.get(c, 0)) for c in busy | taken}
        busy = {c: n - 1 for c, n in both.items() if n > 1}
        placed.append(cells)
    begun = sorted({at for cells in placed for at, _, _ in cells})
    number, width = {c: i for i, c in enumerate(begun)}, [0] * len(begun)
    spans = sorted((bisect.bisect_left(begun, at + across) - number[at], number[at], max(map(width_of, lines), default=0)) for cells in placed for at, across, lines in cells)
    for n, first, size in spans:  # the narrow cells first; a wider one stretches its last column
        width[first + n - 1] += max(0, size - sum(width[first : first + n]) - 2 * (n - 1))
    start = [sum(width[:i]) + 2 * i for i in range(len(width))]
    out = []
    for cells in placed:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line, used = [], 0
            for at, _, lines in cells:
                if k < len(lines) and lines[k]:
                    x = start[number[at]]
                    line.append(" " * (x - used) + lines[k])
                    used = x + width_of(lines[k])
            out.append("".join(line))
    return out


def marker(style: str, n: int) -> str:
    """The number of a list item: decimal, letters (a, A) or Roman (i, I)."""
    if style.lower() == "a" and n > 0:
        text = ""
        while n:
            n, letter = divmod(n - 1, 26)
            text = chr(97 + letter) + text
        return text if style == "a" else text.upper()
    if style.lower() == "i" and 0 < n < 4000:
        text = ""
        for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True):
            text += sign * (n // value)
            n %= value
        return text if style == "i" else text.upper()
    return str(n)


def render(root, sheets: list[str] = ()) -> str:
    page, pages, lists, tables, sheet = Page(), [], [], [], Sheet(list(sheets))
    stack = [(root, False, True, "")]
    while stack:
        node, leaving, visible, setting = stack.pop()
        if isinstance(node, str):
            if visible:
                page.text(node, setting)
            continue
        tag, attrs, children = node
        if leaving:
            if tag in ("td", "th") and tables:
                lines, page = page.finish(), pages.pop()
                if not tables[-1]:
                    tables[-1].append([])
                down = _number(attrs.get("rowspan"), 1)
                tables[-1][-1].append((lines, max(1, min(1000, _number(attrs.get("colspan"), 1))), min(65534, down or 65534)))  # the limits of HTML itself
                continue
            page.end()
            if tag == "table":
                page.gap = max(page.gap, 1)
                for line in aligned(tables.pop()):
                    page.now = [line]
                    page.end()
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            elif tag == "li":
                page.prefix, page.mark = attrs["\0"]
            elif tag in ("blockquote", "dd"):
                page.prefix = page.prefix[:-2]
            if tag in SPACED:
                page.gap = max(page.gap, 0 if lists else 1)
            continue
        style = styles(tag, attrs, sheet)
        if hidden(tag, attrs, style):
            continue
        if "visibility" in style and style["visibility"] != "inherit":
            visible = style["visibility"] == "visible"
        setting = "pre" if tag in ("pre", "textarea") else setting
        setting = SETTING.get(style.get("white-space"), setting)
        if tag == "br":
            page.end(True)
        elif tag == "hr":
            page.end()
            if visible:
                page.now = ["---"]
                page.end()
        elif tag in ("img", "input"):
            if visible:
                page.text(attrs.get("alt") or "" if tag == "img" else field_text(attrs), "")
        elif tag in ("td", "th") and tables:
            pages.append(page)
            page = Page()
        elif tag in BLOCK:
            page.end()
            if tag in SPACED:
                page.gap = max(page.gap, 0 if lists else 1)
            if tag in ("ul", "menu", "dir"):
                lists.append(None)
            elif tag == "ol":
                items = sum(not isinstance(c, str) and c[0] == "li" for c in children) if "reversed" in attrs else 0
                lists.append([_number(attrs.get("start"), items or 1), -1 if "reversed" in attrs else 1, attrs.get("type") or "1"])
            elif tag == "li":
                attrs["\0"] = page.prefix, page.mark
                page.prefix, page.mark = page.prefix + " " * len(page.mark), "- "
                if lists and lists[-1] is not None:
                    n = _number(attrs.get("value"), lists[-1][0])
                    page.mark = f"{marker(attrs.get('type') or lists[-1][2], n)}. "
                    lists[-1][0] = n + lists[-1][1]
            elif tag in ("blockquote", "dd"):
                page.prefix += "  "
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
        if tag in BLOCK:
            stack.append((node, True, visible, setting))
        if tag == "details" and "open" not in attrs:
            children = [c for c in children if not isinstance(c, str) and c[0] == "summary"]
        elif tag == "select":
            children = shown_options(node)
        elif tag == "table":
            children = in_order(children)
        stack.extend((c, False, visible, setting) for c in reversed(children))
    while pages:  # cells are always left, so this only guards a broken tree
        page = pages.pop()
    return "\n".join(page.finish())


def _number(value, other: int) -> int:
    return int(value) if value and re.fullmatch(r"-?[0-9]{1,6}", value.strip()) else other


def visible_text(html: str) -> str:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return render(builder.root, builder.sheets)


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text, n_lines), one row for each page: its whole visible text. Null and empty pages give an empty text and
    no lines; repeated rows and null keys stay; other columns are ignored; an empty table gives no rows."""

    def run(batches):
        for batch in batches:
            texts = [visible_text(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], [key, "text", "n_lines"])

    return pages.select(F.col(key).cast("long"), F.col(html).cast("string")).mapInArrow(lean(run), f"{key} long, text string, n_lines long")


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
