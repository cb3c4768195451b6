"""HTML extraction by layout-aware rendering.

A tokeniser feeds a tree builder that opens and closes what HTML implies (paragraphs, list items, table rows
and cells, options, definition terms; head, whose end tag may be missing, needs no element, as all that may stand in
it is unseen by itself), flattens what is nested deeper than DEPTH (what hides there stays hidden) and drops what is not shown: title,
script, style, template and the like, the hidden attribute, display:none and visibility:hidden (but for visible parts inside), by the
style attribute or by rules of style elements for tags, classes and ids and their descendants, closed details but for their
summary, dialogs that are not open, hidden inputs, options that are not selected in a drop-down list, all of svg but its texts
and foreign objects, and a comment or tag that the end of the page cuts off.  Scripts do not run, so noscript shows.  The renderer then writes all visible text: white space collapses outside pre,
blocks stand on lines of their own, headings, paragraphs, lists and tables with a blank line around them, list
items with a bullet or number and an indent per level, table cells padded to the width of their column, below cells
that span rows too.

Defined cases: a null or empty page gives an empty text; text without tags is rendered as it is; unclosed and
misnested tags and unknown declarations never fail; very long pages are rendered whole, in time that follows their length; repeated rows give equal texts; an input column named text gives way to the result; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

DEPTH = 256

# Fixed element lists of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template title iframe canvas audio video datalist".split())
SVG_UNSEEN = frozenset("defs symbol clippath mask pattern marker desc metadata lineargradient radialgradient filter".split())
#: HTML start tags that end an open svg or math, unless one of INSIDE is open in it.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
INSIDE = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body address article aside center dd details dialog div dt figcaption footer form header hgroup legend li main menu nav option section summary caption tr thead tbody tfoot td th".split())
#: A start tag of the key closes open elements of the value, up to the element after the bar.
IMPLIED = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("td th tr caption colgroup", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "thead": ("td th tr thead tbody tfoot caption colgroup", "table"),
    "tbody": ("td th tr thead tbody tfoot caption colgroup", "table"),
    "tfoot": ("td th tr thead tbody tfoot caption colgroup", "table"),
    "option": ("option", "select"),
    "optgroup": ("option optgroup", "select"),
}
IMPLIED = {k: (frozenset(closed.split()), frozenset(stop.split())) for k, (closed, stop) in IMPLIED.items()}
CLOSE_P = BLOCK - frozenset("html body td th tr thead tbody tfoot caption option legend".split())
STOP_P = frozenset("table td th caption li button object".split())
#: The most columns and rows that a cell may span.
COLSPAN, ROWSPAN = 1000, 65534
#: The widest gap, in characters, that keeps a cell under its column.
GAP = 1000
NONE = re.compile(r"(?:^|[;\s])display\s*:\s*(\w+)", re.I)
VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(\w+)", re.I)
SIMPLE = re.compile(r"([a-z][\w-]*|\*)?((?:[.#][\w-]+)*)", re.I)
#: What is left of a page that ends inside a comment, a declaration or a tag.
UNENDED = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.deep: list[tuple[str, int]] = []  # open elements past DEPTH, and how many up to each hide their content
        self.styles: list[str] = []
        self.foreign = False  # whether the page has an svg or math

    def parse_marked_section(self, i, report=1):
        """Text inside svg and math, a comment up to the next > elsewhere."""
        if self.foreign_at() and self.rawdata.startswith("<![CDATA[", i):
            end = self.rawdata.find("]]>", i)
            if end >= 0:
                self.handle_data(self.rawdata[i + 9 : end])
                return end + 3
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def end(self) -> None:
        """The end of the page: a comment, declaration or tag that it cuts off is dropped."""
        if self.cdata_elem is None and UNENDED.match(self.rawdata):
            self.rawdata = ""
        self.close()

    def foreign_at(self) -> int:
        """Where the innermost open svg or math is whose content is not HTML again; 0 if there is none."""
        if self.foreign:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in ("svg", "math"):
                    return k
                if self.open[k].tag in INSIDE:
                    break
        return 0

    def close_implied(self, tag: str) -> None:
        if tag in CLOSE_P:
            for k in range(len(self.open) - 1, 0, -1):
                name = self.open[k].tag
                if name == "p":
                    del self.open[k:]
                    break
                if name in STOP_P:
                    break
        if tag in IMPLIED:
            closed, stop = IMPLIED[tag]
            low = None
            for k in range(len(self.open) - 1, 0, -1):
                name = self.open[k].tag
                if name in stop:
                    break
                if name in closed:
                    low = k
            if low is not None:
                del self.open[low:]

    def handle_starttag(self, tag, attrs):
        if self.foreign and tag in BREAKOUT and (k := self.foreign_at()):
            del self.open[k:]
        if tag in ("html", "head", "body"):
            return
        self.foreign |= tag in ("svg", "math")
        if not self.deep:
            self.close_implied(tag)
        if not self.deep and tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self.handle_starttag("tr", [])
        node = Node(tag, {k: v or "" for k, v in attrs if k in KEPT}, self.open[-1])
        if tag in VOID:
            if not (self.deep and self.deep[-1][1]):
                self.open[-1].children.append(node)
        elif len(self.open) < DEPTH:
            self.open[-1].children.append(node)
            self.open.append(node)
        else:
            hides = tag in UNSEEN or hidden_here(node, []) or "hidden" in VISIBILITY.findall(node.attrs.get("style", "").lower())
            self.deep.append((tag, hides + (self.deep[-1][1] if self.deep else 0)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math") or self.foreign_at():
            if self.open[-1].tag == tag and not self.open[-1].children:
                self.open.pop()

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
            return
        for k in range(len(self.deep) - 1, -1, -1):
            if self.deep[k][0] == tag:
                del self.deep[k:]
                return
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k].tag
            if name == tag:
                del self.open[k:]
                self.deep.clear()
                return
            if name in ("td", "th", "table") and tag not in ("table", "tr", "thead", "tbody", "tfoot"):
                return

    def handle_data(self, data):
        if self.open[-1].tag == "style":
            self.styles.append(data)
        elif not (self.deep and self.deep[-1][1]):
            self.open[-1].children.append(data)


KEPT = frozenset("hidden style type start value colspan rowspan selected disabled multiple size label display visibility class id open".split())


def compound(text: str) -> tuple[str, frozenset] | None:
    """(tag or "", classes and ids with their sign) of one compound selector; None for what is not understood."""
    part = SIMPLE.fullmatch(text)
    return ((part[1] or "").lower().replace("*", ""), frozenset(re.findall(r"[.#][\w-]+", part[2]))) if part and text else None


def style_rules(styles: list[str]) -> list[tuple[list, str, str]]:
    """(selector, property, value) of the rules that hide or show; not those inside @ blocks.

    A selector is the list of its compounds from the last to the first, each with whether its parent must be the next (>)
    or any ancestor may be.
    """
    rules = []
    for sheet in styles:
        sheet, at, depth, head, start = re.sub(r"/\*.*?\*/", "", sheet, flags=re.S), 0, 0, "", 0
        for m in re.finditer(r"[{}]", sheet):
            if m[0] == "{":
                if not depth:
                    head, start = sheet[at : m.start()].strip(), m.end()
                depth += 1
            elif depth:
                depth -= 1
                if not depth:
                    at = m.end()
                    body = sheet[start : m.start()]
                    found = [("display", x.lower()) for x in NONE.findall(body)] + [("visibility", x.lower()) for x in VISIBILITY.findall(body)]
                    for selector in head.split(",") if found and not head.startswith("@") else ():
                        words = selector.replace(">", " > ").split()
                        parts = [(compound(w), k > 0 and words[k - 1] == ">") for k, w in enumerate(words) if w != ">"]
                        if parts and all(c for c, _ in parts):
                            rules += [(parts[::-1], k, v) for k, v in found]
    return rules


def chosen(node: Node | None, selector: list, k: int = 0) -> bool:
    """Whether the node matches the selector from its compound k on, counted from the last."""
    (tag, wanted), child = selector[k]
    if node is None or tag and tag != node.tag:
        return False
    a = node.attrs
    if wanted and not wanted <= {"." + x for x in a.get("class", "").split()} | ({"#" + a["id"]} if "id" in a else set()):
        return False
    if k + 1 == len(selector):
        return True
    above = node.parent
    if child:
        return chosen(above, selector, k + 1)
    while above is not None:
        if chosen(above, selector, k + 1):
            return True
        above = above.parent
    return False


def style_of(node: Node, rules: list) -> tuple[str, str]:
    """display and visibility as the rules, then the style attribute, give them; empty where nothing does."""
    found = {"display": "", "visibility": ""}
    for selector, key, value in rules:
        if chosen(node, selector):
            found[key] = value
    style = node.attrs.get("style")
    if style:
        found["display"] = (NONE.findall(style) or [found["display"]])[-1].lower()
        found["visibility"] = (VISIBILITY.findall(style) or [found["visibility"]])[-1].lower()
    return found["display"], found["visibility"]


def hidden_here(node: Node, rules: list) -> bool:
    """Whether the node and all in it are taken out of the page."""
    if node.tag in UNSEEN or "hidden" in node.attrs or (node.tag == "dialog" and "open" not in node.attrs):
        return True
    return bool(node.attrs or rules) and style_of(node, rules)[0] == "none"


class Renderer:
    """Lines of a block context; nested contexts (items, cells) are rendered apart and placed."""

    def __init__(self, rules: list = (), shown: bool = True):
        self.rules, self.shown = rules, shown
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the line that is being written
        self.last = ""  # its last character
        self.space = False

    def visible(self, node: Node) -> bool:
        return not hidden_here(node, self.rules)

    def write(self, data: str) -> None:
        if data and self.shown:
            self.parts.append(data)
            self.last = data[-1]

    def end_line(self, keep_empty: bool) -> None:
        line = "".join(self.parts).rstrip()
        if line.strip() or keep_empty:
            self.lines.append(line)
        self.parts, self.last = [], ""

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *rest = data.split("\n")
            self.write(first)
            for x in rest:
                self.end_line(self.shown)
                self.write(x)
            return
        parts = SPACE.split(data)
        if not parts[0]:
            self.space = True
        for k, word in enumerate(parts):
            if word:
                if (self.space or k) and self.last not in ("", " ", "\n"):
                    self.write(" ")
                self.write(word)
                self.space = False
        if len(parts) > 1 and not parts[-1]:
            self.space = True

    def newline(self) -> None:
        self.end_line(False)
        self.space = False

    def blank(self) -> None:
        self.newline()
        if self.lines and self.lines[-1]:
            self.lines.append("")

    def place(self, lines: list[str], head: str) -> None:
        """lines as one item, the first after head and the others indented under it."""
        self.newline()
        for k, x in enumerate(lines or [""]):
            self.lines.append(((head if not k else " " * len(head)) + x).rstrip() if x or not k else "")

    def finish(self) -> list[str]:
        self.newline()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines

    def children(self, node: Node, pre: bool = False) -> None:
        number = 0
        if node.tag == "ol":
            start = node.attrs.get("start", "")
            number = int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start) else 0
        shown = node.children
        if node.tag == "details" and "open" not in node.attrs:
            shown = [c for c in shown if not isinstance(c, str) and c.tag == "summary"][:1]
        for child in shown:
            if isinstance(child, str):
                self.text(child, pre)
                continue
            if not self.visible(child):
                continue
            tag, outside = child.tag, self.shown
            visibility = style_of(child, self.rules)[1] if child.attrs or self.rules else ""
            self.shown = outside if visibility in ("", "inherit") else visibility == "visible"
            if tag == "br":
                self.end_line(self.shown)
                self.space = False
            elif tag == "hr":
                self.blank()
                self.lines += ["---", ""] if self.shown else []
            elif tag == "input":
                if child.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                    self.text(f" {child.attrs.get('value', '')} ", False)
            elif tag == "textarea":
                self.write(" " if self.last not in ("", " ") else "")
                self.text(re.sub(r"^\r?\n", "", "".join(raw_text(child, self.rules))), True)
                self.space = True
            elif tag == "select":
                self.options(child)
            elif tag == "svg":
                self.drawing(child)
            elif node.tag == "semantics" and tag in ("annotation", "annotation-xml"):
                pass
            elif tag == "li":
                value = child.attrs.get("value", "")
                number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number + 1
                self.place(self.apart(child), (f"{number}. " if node.tag == "ol" else "- ") if self.shown else "")
            elif tag == "dd":
                self.place(self.apart(child), "    ")
            elif tag == "table":
                self.blank()
                self.lines += table_lines(child, self)
                self.blank()
            elif tag in SPACED:
                nested = tag in ("ul", "ol") and node.tag == "li"
                (self.newline if nested else self.blank)()
                self.children(child, pre or tag == "pre")
                (self.newline if nested else self.blank)()
            elif tag in BLOCK:
                self.newline()
                self.children(child, pre)
                self.newline()
            else:
                self.children(child, pre)
            self.shown = outside

    def apart(self, node: Node) -> list[str]:
        """The lines of a nested context."""
        r = Renderer(self.rules, self.shown)
        r.children(node)
        return r.finish()

    def options(self, node: Node) -> None:
        """A list box shows all options and group labels, a drop-down list the one selected (the first if none is)."""
        found = []

        def gather(part: Node) -> None:
            for child in part.children:
                if isinstance(child, str) or not self.visible(child):
                    continue
                if child.tag == "option":
                    found.append((child, child.attrs.get("label") or " ".join(SPACE.split("".join(raw_text(child, self.rules)).strip()))))
                else:
                    if child.tag == "optgroup":
                        found.append((child, child.attrs.get("label", "")))
                    gather(child)

        gather(node)
        size = node.attrs.get("size", "")
        if "multiple" in node.attrs or (re.fullmatch(r"\d{1,9}", size) and int(size) > 1):
            self.newline()
            for _, label in found:
                self.text(label, False)
                self.newline()
            return
        some = [x for x in found if x[0].tag == "option"]
        chosen = [x for x in some if "selected" in x[0].attrs][-1:] or [x for x in some if "disabled" not in x[0].attrs][:1]
        for _, label in chosen:
            self.text(f" {label} ", False)

    def drawing(self, node: Node) -> None:
        for child in node.children:
            if isinstance(child, str) or not self.visible(child) or child.tag in SVG_UNSEEN or child.attrs.get("display") == "none" or child.attrs.get("visibility") in ("hidden", "collapse"):
                continue
            if child.tag in ("text", "foreignobject"):
                self.text(" ", False)
                self.children(child)
                self.text(" ", False)
            else:
                self.drawing(child)


def raw_text(node: Node, rules: list):
    """The texts of a node and of the nodes in it that are not taken out."""
    for child in node.children:
        if isinstance(child, str):
            yield child
        elif not hidden_here(child, rules):
            yield from raw_text(child, rules)


def table_lines(table: Node, at: Renderer) -> list[str]:
    """Captions and what stands outside the cells, then the rows in document order with cells padded to their columns.

    A spanning cell fills its columns, and keeps them free in the further rows that it spans, up to the end of its section.
    Spans are intervals, so the work follows the cells and not their spans.
    """
    visible = at.visible

    def rendered(node: Node, *around: Node) -> list[str]:
        """Lines of a node, as visible as the nodes around it and it make it."""
        shown = at.shown
        for x in (*around, node):
            v = style_of(x, at.rules)[1] if x.attrs or at.rules else ""
            shown = shown if v in ("", "inherit") else v == "visible"
        r = Renderer(at.rules, shown)
        r.children(node)
        return r.finish()

    captions, rows, stray = [], [], Node("div", {})

    def gather(node: Node) -> None:
        for child in node.children:
            if isinstance(child, str) or child.tag not in ("thead", "tbody", "tfoot", "tr", "caption", "col", "colgroup"):
                stray.children.append(child)
            elif not visible(child):
                continue
            elif child.tag == "tr":
                rows.append((node, child))
            elif child.tag == "caption":
                captions.append(child)
            elif child.tag not in ("col", "colgroup"):
                gather(child)

    gather(table)
    grid: list[list[tuple[int, str]]] = []  # of each row, the columns that hold text
    sections = Counter(id(of) for of, _ in rows)
    section, row_at, taken = None, 0, []  # taken: (first column, column after the last, row of the section that frees them), in order
    for of, row in rows:
        if of is not section:
            section, row_at, taken = of, 0, []
        taken = [t for t in taken if t[2] > row_at]
        cells, held, at_column, nth = [], [], 0, 0
        for cell in row.children:
            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                stray.children.append(cell)
            elif visible(cell):
                span = cell.attrs.get("colspan", "")
                wide = min(int(span), COLSPAN) if re.fullmatch(r"[1-9]\d{0,8}", span) else 1
                span = cell.attrs.get("rowspan", "")
                high = min(int(span) or ROWSPAN, ROWSPAN) if re.fullmatch(r"\d{1,9}", span) else 1
                while nth < len(taken) and taken[nth][0] <= at_column:
                    at_column = max(at_column, taken[nth][1])
                    nth += 1
                if high > 1:
                    held.append((at_column, at_column + wide, min(row_at + high, sections[id(of)])))
                text = " ".join(x.strip() for x in rendered(cell, of, row) if x.strip())
                if text:
                    cells.append((at_column, text))
                at_column += wide
        row_at += 1
        merged: list[tuple[int, int, int]] = []
        for first, after, until in sorted(taken + held) if held else taken:
            if merged and merged[-1][1] == first and merged[-1][2] == until:
                merged[-1] = (merged[-1][0], after, until)
            else:
                merged.append((first, after, until))
        taken = merged
        if cells:
            grid.append(cells)
    widths: dict[int, int] = {}
    for row in grid:
        for column, text in row:
            widths[column] = max(widths.get(column, 0), len(text))
    places, total = {}, 0
    for column in sorted(widths):
        places[column], total = total + 2 * column, total + widths[column]
    out = [x for c in captions for x in rendered(c)] + rendered(stray)
    for row in grid:
        parts, end = [], 0
        for column, text in row:
            parts += [" " * min(places[column] - end, GAP), text]
            end = places[column] + len(text)
        out.append("".join(parts).rstrip())
    return out


def html_to_text(html: str | None) -> str:
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.end()
    lines: list[str] = []
    top = Renderer(style_rules(builder.styles))
    top.children(builder.root)
    for x in top.finish():
        if x or (lines and lines[-1]):
            lines.append(x)
    return "\n".join(lines)


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages with the column text after its others: the visible text of html."""
    keep = [c for c in pages.columns if c != "text"]

    def run(batches):
        for batch in slices(batches, 64):
            yield batch.append_column("text", pa.array([html_to_text(h) for h in batch.column("html").to_pylist()], pa.string()))

    rows = pages.select(*keep).withColumn("html", F.col("html").cast("string"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())]))
