"""Visible text of HTML pages, laid out.

A tree builder with implied tags turns markup into elements; visibility rules leave out what a browser does not show;
a renderer emits the rest with block spacing, list markers and aligned table cells.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Elements nested deeper than this become siblings, as in browsers.
MAX_DEPTH = 400

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title datalist iframe object audio video canvas noframes noembed param rp meta link base".split())
#: in drawings and formulas, what is not drawn
HIDDEN_INSIDE = {"svg": frozenset("defs desc metadata symbol clippath mask pattern marker".split()), "math": frozenset("annotation annotation-xml".split())}
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote dl figure ol ul menu dir pre table fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
#: start tag -> open elements that it ends, up to the elements that bound the search
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
SCOPE = frozenset("table td th caption button object template html".split())
TABLE_PARTS = frozenset("tbody thead tfoot".split())

_BLANK = re.compile(r"[ \t\n\r\f]+")
_CSS = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[{};]", re.S)
_DECLARATION = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.I)
_COMPOUND = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+|\[[^\]]*\])*)\Z", re.I)
_PART = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?)=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]*))\s*[is]?\s*)?\]", re.I)
_WIDTH = re.compile(r"(min|max)-width\s*:\s*([\d.]+)(px|em|rem)", re.I)
#: the screen that media rules are read for
SCREEN_PX = 1280
BLOCKISH = frozenset("block flex grid table list-item flow-root -webkit-box".split())
INLINISH = frozenset("inline inline-block inline-flex inline-grid contents".split())


class Element:
    __slots__ = ("tag", "attrs", "children", "depth", "parent", "display", "visible")

    def __init__(self, tag: str, attrs: dict[str, str], depth: int, parent: Element | None = None):
        self.tag, self.attrs, self.depth, self.parent = tag, attrs, depth, parent
        self.children: list[Element | str] = []
        self.display, self.visible = "", True

    def around(self, child: Element | str) -> Element:
        """A plain block of one child, in the place of this element."""
        holder = Element("div", {}, 0, self)
        holder.children, holder.visible = [child], self.visible
        return holder


class TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {}, 0)
        self.open = [self.root]
        self.sheets: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag in CLOSES_P:
            self._end_implied({"p"}, SCOPE)
        if tag in IMPLIED_END:
            self._end_implied(*IMPLIED_END[tag])
        if tag in ("td", "th") and self.open[-1].tag in TABLE_PARTS | {"table"}:
            self._push("tr", {})
        if tag[0] == "h" and tag[1:].isdigit() and self.open[-1].tag[0] == "h" and self.open[-1].tag[1:].isdigit():
            self.open.pop()
        node = self._push(tag, {k: v or "" for k, v in reversed(attrs)})
        if tag in VOID:
            self.open.pop()
        elif node.depth > MAX_DEPTH:
            self.open.pop()

    handle_startendtag = handle_starttag

    def _push(self, tag: str, attrs: dict[str, str]) -> Element:
        node = Element(tag, attrs, self.open[-1].depth + 1, self.open[-1])
        self.open[-1].children.append(node)
        self.open.append(node)
        return node

    def _end_implied(self, ends: set[str], bounds: frozenset[str] | set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in bounds:
                break
            if self.open[i].tag in ends:
                del self.open[i:]
                if ends == {"p"}:
                    return
        else:
            return

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        for i in range(len(self.open) - 1, 0, -1):
            here = self.open[i].tag
            if here == tag:
                del self.open[i:]
                return
            if here in ("td", "th", "caption") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                break
        if tag == "br":
            self.open[-1].children.append(Element("br", {}, 0, self.open[-1]))
        elif tag == "p":
            self.open[-1].children.append(Element("p", {}, 0, self.open[-1]))

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "style":
            self.sheets.append(data)
        self.open[-1].children.append(data)


def on_screen(condition: str) -> bool:
    """Whether a media query list holds on a screen of SCREEN_PX; features other than widths are taken as given."""
    for one in condition.lower().split(","):
        words = re.sub(r"\([^)]*\)", " ", one).split()
        kind = next((w for w in words if w not in ("and", "only", "not")), "all")
        holds = kind in ("all", "screen")
        for bound, number, unit in _WIDTH.findall(one):
            px = float(number) * (1 if unit.lower() == "px" else 16)
            holds = holds and (SCREEN_PX >= px if bound.lower() == "min" else SCREEN_PX <= px)
        if holds != ("not" in words):
            return True
    return False


def css_rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on a screen, in order; conditional groups are entered."""
    at, prelude, stack = 0, [], []  # stack: for each open brace whether what it holds counts, and the selectors of a rule
    for m in _CSS.finditer(css):
        prelude.append(css[at : m.start()])
        at, token = m.end(), m.group()
        if token[0] in "\"'":
            prelude.append(token)
        elif token == "{":
            head = "".join(prelude).strip()
            counts = all(c for c, _ in stack)
            if head.startswith("@"):
                name, _, rest = head[1:].partition(" ")
                name, _, more = name.lower().partition("(")
                stack.append((counts and (name in ("supports", "layer", "container", "scope") or name == "media" and on_screen(more + rest)), None))
            else:
                stack.append((counts, head))
            prelude = []
        elif token == "}":
            if stack:
                counts, selectors = stack.pop()
                if counts and selectors is not None:
                    yield selectors, "".join(prelude)
            prelude = []
        elif token == ";":
            if stack and stack[-1][1] is not None:
                prelude.append(";")
            else:
                prelude = []  # @import and the like


def declared(text: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of what decides on visibility."""
    return [(k.lower(), v.lower(), bool(i)) for k, v, i in _DECLARATION.findall(text)] if ":" in text else []


class Selector:
    """A selector of tags, classes, ids and attributes with descendants and children; others don't match."""

    def __init__(self, compounds: list[tuple[str, str, list[tuple]]]):
        self.compounds = compounds  # from the right: (combinator to the left of it, tag, conditions)
        conditions = [c for _, _, cs in compounds for c in cs]
        self.weight = (sum(c[0] == "#" for c in conditions), sum(c[0] != "#" for c in conditions), sum(bool(t) for _, t, _ in compounds))
        _, tag, own = compounds[0]
        self.key = next(((c[0], c[1]) for kind in "#." for c in own if c[0] == kind), ("", tag))

    @classmethod
    def read(cls, text: str) -> Selector | None:
        parts = re.sub(r"\s*>\s*", " > ", text.strip()).split()
        out, combinator = [], ""
        for part in parts:
            if part == ">":
                combinator = ">"
                continue
            if not (m := _COMPOUND.match(part)) or not m.group():
                return None
            tag = "" if m.group(1) in (None, "*") else m.group(1).lower()
            conditions = [(p[0], p[1]) if p[0] else ("[", p[2].lower(), p[3], p[4] or p[5] or p[6], "=" in raw) for raw, p in ((x.group(), x.groups(default="")) for x in _PART.finditer(m.group(2)))]
            out.append((combinator, tag, conditions))
            combinator = " "
        return cls(out[::-1]) if out else None

    @staticmethod
    def fits(e: Element, tag: str, conditions: list[tuple]) -> bool:
        if tag and tag != e.tag:
            return False
        for c in conditions:
            if c[0] == ".":
                if c[1] not in e.attrs.get("class", "").split():
                    return False
            elif c[0] == "#":
                if e.attrs.get("id") != c[1]:
                    return False
            else:
                _, name, how, want, compared = c
                if (have := e.attrs.get(name)) is None:
                    return False
                if compared and not {"": have == want, "~": want in have.split(), "|": have == want or have.startswith(want + "-"), "^": want != "" and have.startswith(want), "$": want != "" and have.endswith(want), "*": want != "" and want in have}[how]:
                    return False
        return True

    def matches(self, e: Element, k: int = 0) -> bool:
        combinator, tag, conditions = self.compounds[k]
        if not self.fits(e, tag, conditions):
            return False
        if k + 1 == len(self.compounds):
            return True
        up = e.parent
        if combinator == ">":
            return up is not None and self.matches(up, k + 1)
        while up is not None:
            if self.matches(up, k + 1):
                return True
            up = up.parent
        return False


class Styles:
    """The cascade of display and visibility: importance, inline style, specificity, order."""

    def __init__(self, sheets: list[str]):
        self.by_key: dict[tuple[str, str], list[tuple]] = {}
        for order, (selectors, body) in enumerate(css_rules("\n".join(sheets))):
            if found := declared(body):
                for one in selectors.split(","):
                    if selector := Selector.read(one):
                        self.by_key.setdefault(selector.key, []).append((selector, order, found))

    def of(self, e: Element) -> dict[str, str]:
        best: dict[str, tuple[tuple, str]] = {}

        def offer(found: list[tuple[str, str, bool]], rank: tuple) -> None:
            for n, (name, value, important) in enumerate(found):
                mine = (important, *rank, n)
                if name not in best or mine >= best[name][0]:
                    best[name] = (mine, value)

        if self.by_key:
            keys = [("", ""), ("", e.tag), *(("." , c) for c in e.attrs.get("class", "").split()), ("#", e.attrs.get("id", ""))]
            for key in dict.fromkeys(keys):
                for selector, order, found in self.by_key.get(key, ()):
                    if selector.matches(e):
                        offer(found, (0, selector.weight, order))
        if "style" in e.attrs:
            offer(declared(e.attrs["style"]), (1, (0, 0, 0), 0))
        return {name: value for name, (_, value) in best.items()}

    def apply(self, root: Element) -> None:
        """Set display and visible of every element that is displayed; what is not has display none."""
        todo: list[tuple[Element, str]] = [(root, "")]
        while todo:
            e, inside = todo.pop()
            open_ = "open" in e.attrs
            summary = next((c for c in e.children if isinstance(c, Element) and c.tag == "summary"), None) if e.tag == "details" else None
            for child in e.children:
                if isinstance(child, str):
                    continue
                a = child.attrs
                style = self.of(child)
                child.display = style.get("display", "none" if "hidden" in a or (child.tag == "dialog" and "open" not in a) else "")
                child.visible = style["visibility"] == "visible" if style.get("visibility", "inherit") not in ("inherit", "unset") else e.visible
                if child.tag in HIDDEN or (child.tag == "input" and a.get("type", "").lower() == "hidden") or child.tag in HIDDEN_INSIDE.get(inside, ()):
                    child.display = "none"
                elif e.tag == "details" and not open_ and child is not summary:
                    child.display = "none"
                if child.display != "none":
                    todo.append((child, child.tag if child.tag in HIDDEN_INSIDE else inside))


class Renderer:
    @staticmethod
    def is_block(e: Element) -> bool:
        if e.display in BLOCKISH:
            return True
        return e.tag in BLOCK and e.display not in INLINISH

    def block(self, e: Element, pre: bool = False) -> list[str]:
        """Lines of an element's content; '' is a blank line that neighbours share."""
        lines: list[str] = []
        inline: list[str] = []

        def flush() -> None:
            text = "".join(inline)
            inline.clear()
            if pre:
                if text.strip("\n"):
                    lines.extend(x.rstrip() for x in text.strip("\n").split("\n"))
                return
            for part in text.split("\0"):  # line breaks
                part = _BLANK.sub(" ", part).strip(" ")
                if part:
                    lines.append(part)

        def visit(node: Element, pre: bool) -> None:
            for child in node.children:
                if isinstance(child, str):
                    if node.visible and not (node.tag == "details" and "open" not in node.attrs):
                        inline.append(child.replace("\0", ""))
                    continue
                if child.display == "none":
                    continue
                if child.tag == "br":
                    inline.append("\n" if pre else "\0")
                elif child.tag == "svg" or node.tag == "svg" and child.tag == "text":
                    inline.append(" ")
                    visit(child, pre)
                    inline.append(" ")
                elif child.tag == "input":
                    inline.append(" " if not child.visible else " " + child.attrs.get("value", "") + " " if child.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number") else " ")
                elif child.tag == "q":
                    marks = ("“", "”") if child.visible else ("", "")
                    inline.append(marks[0])
                    visit(child, pre)
                    inline.append(marks[1])
                elif self.is_block(child):
                    flush()
                    spaced = child.tag in SPACED
                    if spaced:
                        self.gap(lines)
                    lines.extend(self.child_block(child, pre))
                    if spaced:
                        self.gap(lines)
                elif child.tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "colgroup", "col"):
                    flush()
                    lines.extend(self.block(child, pre))
                else:
                    visit(child, pre)

        visit(e, pre)
        flush()
        return lines

    @staticmethod
    def gap(lines: list[str]) -> None:
        if lines and lines[-1] != "":
            lines.append("")

    def child_block(self, e: Element, pre: bool) -> list[str]:
        if e.tag == "hr":
            return ["---"] if e.visible else []
        if e.tag == "pre":
            return self.block(e, True)
        if e.tag in ("ul", "ol", "menu", "dir"):
            return self.items(e)
        if e.tag == "table":
            return self.table(e)
        lines = self.block(e, pre)
        if e.tag == "blockquote":
            return ["  " + x if x else x for x in trimmed(lines)]
        if e.tag == "dd":
            return ["    " + x if x else x for x in trimmed(lines)]
        return lines

    def items(self, e: Element) -> list[str]:
        """A list: each item behind its marker, nested content indented by it."""
        lines: list[str] = []
        number = int(e.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", e.attrs.get("start", "")) else 1
        if "reversed" in e.attrs and "start" not in e.attrs:
            number = sum(isinstance(c, Element) and c.tag == "li" for c in e.children)
        for child in e.children:
            if isinstance(child, str):
                if e.visible and (text := _BLANK.sub(" ", child).strip(" ")):
                    lines.append(text)
            elif child.display != "none":
                if child.tag != "li":
                    lines += ["  " + x if x else x for x in trimmed(self.block(e.around(child)))]
                    continue
                if re.fullmatch(r"-?\d{1,9}", child.attrs.get("value", "")):
                    number = int(child.attrs["value"])
                mark = "" if not child.visible else f"{number}. " if e.tag == "ol" else "- "
                number += -1 if "reversed" in e.attrs else 1
                own = [x for x in trimmed(self.block(child)) if x] or [""] * child.visible
                if not own:
                    continue
                lines.append((mark + own[0]).rstrip())
                lines += [" " * len(mark) + x for x in own[1:]]
        return lines

    def table(self, e: Element) -> list[str]:
        """Rows with cells in columns of even width, two spaces apart; a cell of several lines takes several lines.

        A cell that spans columns or rows keeps the others out of its places; its text stands in the first of them.
        """
        head: list[str] = []
        sections: list[list[list[tuple[list[str], int, int]]]] = []
        feet: list[list[list[tuple[list[str], int, int]]]] = []

        def span(cell: Element, name: str) -> int:
            text = cell.attrs.get(name, "1").strip()
            return min(1000, int(text)) if re.fullmatch(r"\d{1,5}", text) else 1

        def collect(node: Element, rows: list) -> None:
            for child in node.children:
                if isinstance(child, str):
                    if node.visible and (text := _BLANK.sub(" ", child).strip(" ")):
                        head.append(text)
                elif child.display == "none":
                    continue
                elif child.tag in TABLE_PARTS:
                    own: list = []
                    (feet if child.tag == "tfoot" else sections).append(own)
                    collect(child, own)
                    if node is e:
                        sections.append(rows := [])
                elif child.tag == "tr":
                    row = []
                    for cell in child.children:
                        if isinstance(cell, str):
                            if child.visible and (text := _BLANK.sub(" ", cell).strip(" ")):
                                row.append(([text], 1, 1))
                        elif cell.display != "none":
                            lines = [x for x in (self.block(cell) if cell.tag in ("td", "th") else self.block(child.around(cell))) if x]
                            row.append((lines, max(1, span(cell, "colspan")), span(cell, "rowspan")))
                    rows.append(row)
                elif child.tag == "caption":
                    head.extend(self.block(child))
                else:
                    head.extend(self.block(e.around(child)))

        sections.append(first := [])
        collect(e, first)
        placed: list[list[tuple[list[str], int, int]]] = []  # (lines, column, columns)
        for rows in [*sections, *feet]:
            taken: dict[int, int] = {}  # column -> row of this section from which it is free again
            for r, row in enumerate(rows):
                at, cells = 0, []
                for lines, wide, high in row:
                    while taken.get(at, 0) > r:
                        at += 1
                    cells.append((lines, at, wide))
                    for c in range(at, at + wide):
                        taken[c] = len(rows) if high == 0 else r + high
                    at += wide
                placed.append(cells)
        widths: dict[int, int] = {}
        for row in placed:
            for lines, at, wide in row:
                if wide == 1:
                    widths[at] = max(widths.get(at, 0), max(map(columns, lines), default=0))
        begins = [0]
        for c in range(max((at + wide for row in placed for _, at, wide in row), default=0)):
            begins.append(begins[-1] + (widths[c] + 2 if widths.get(c) else 0))
        out = list(head)
        for row in placed:
            for k in range(max((len(lines) for lines, _, _ in row), default=0)):
                line = ""
                for lines, at, _ in row:
                    if k < len(lines) and lines[k]:
                        line += " " * max(2 if line else 0, begins[at] - columns(line)) + lines[k]
                out.append(line.rstrip())
        return out


def columns(text: str) -> int:
    """Width on a fixed grid: wide characters take two places, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def trimmed(lines: list[str]) -> list[str]:
    a, z = 0, len(lines)
    while a < z and not lines[a]:
        a += 1
    while z > a and not lines[z - 1]:
        z -= 1
    return lines[a:z]


def visible_text(html: str | None) -> str:
    """All text that a browser would show, laid out in lines; '' for null and empty pages.

    What hides: elements that are never shown, closed details and dialogs, the hidden attribute, and display and
    visibility from style sheets and attributes by the cascade (selectors of tags, classes, ids, attributes, descendants
    and children; media rules as on a screen of SCREEN_PX).  Rules with other selectors, such as :hover, don't hold.
    """
    if not html:
        return ""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * MAX_DEPTH))
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    Styles(builder.sheets).apply(builder.root)
    return "\n".join(trimmed(Renderer().block(builder.root)))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text): the visible text of every whole page.

    Null and empty pages give ''; broken markup is read as far as it goes; very long pages are read whole, elements
    below MAX_DEPTH become siblings; repeated rows and rows with a null id stay; an empty table gives no rows; extra
    columns are ignored.
    """
    source = small_batches(pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")))
    kind = source.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([visible_text(h) for h in b.column("html").to_pylist()], pa.string())], names=["page_id", "text"])

    return source.mapInArrow(run, f"page_id {kind}, text string")
