"""Text of HTML pages as it would be laid out.

Markup becomes a tree: tags that HTML lets authors leave out are implied (a block ends a paragraph, an item ends the item
before, a cell or row ends its predecessor), void tags have no content, and stray end tags are passed over. The tree is then
rendered: elements that are not displayed give nothing; blocks stand on lines of their own, paragraphs and headings have a blank
line around them; list items have a mark and the indent of their depth; cells of a table are padded to the width of their
column, and a cell that spans rows holds its columns in them; white space collapses but in preformatted text. Formulas give the
text of their parts, drawings that of their text elements, and a choice a line for each group and option, chosen or not. Both
passes keep their own stacks, so depth is not bounded by Python's. Time and memory grow with the page: every search begins where the
last one ended, open elements are found by name, and tables with wider cells than WIDEST have a tab between columns. A tag that never ends hides the
rest of the page, as browsers have it.

A null page gives a null text; an empty one, or one with nothing visible, an empty text. Rows that share a page_id are all kept.
Ids and urls of any kind stay as they are. Other columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import in_batches, tidy

#: Names of HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes datalist object canvas audio video annotation annotation-xml mphantom rp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption td th optgroup option".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
ENDS_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption li dd dt optgroup option".split())
#: What may stand in a head; anything else, and any text, ends an open one.
OF_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements whose own text is not shown: those in them that show text, and those that show nothing.
PARTS = {
    "svg": (frozenset("text foreignobject".split()), frozenset("defs symbol desc metadata clippath mask pattern marker filter lineargradient radialgradient".split())),
    "select": (frozenset("optgroup option".split()), frozenset()),
}
#: Which open elements a start tag ends, and the elements beyond which it does not look for them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
COMMENT = re.compile(r"<!--(?:-?>|.*?--!?>)", re.S)
STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)")
SPACE = re.compile(r"[ \t\n\f\r]+")
#: Characters that a cell before the last of its row, and a row of padded cells, have at most where a table is aligned; columns of a table, beyond which cells span one.
WIDEST, WIDEST_ROW, MOST_COLUMNS = 80, 1000, 1000


class Node:
    __slots__ = ("children", "name", "attributes")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.attributes, self.children = name, attributes, []


class _Open:
    """The stack of open elements, with the places of each name in it."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.places[self.nodes.pop().name].pop()

    def last(self, name: str) -> int:
        """The place of the innermost element of that name, 0 if there is none."""
        found = self.places.get(name)
        return found[-1] if found else 0

    def close(self, names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """End the outermost open element among names above the last one of stop."""
        floor = max((self.last(x) for x in stop), default=0)
        above = [found[i] for x in names if (found := self.places.get(x)) and (i := bisect_right(found, floor)) < len(found)]
        if above:
            self.cut(min(above))

    def end(self, name: str) -> None:
        """Close the innermost open element of that name, but none outside the innermost table."""
        place = self.last(name)
        if place and (place >= self.last("table") or name in ("tr", "td", "th", "tbody", "thead", "tfoot")):
            self.cut(place)


def _tag_end(html: str, at: int) -> int:
    """Where the tag's > is, quoted ones passed over; -1 if it never ends."""
    while m := QUOTE_OR_END.search(html, at):
        if m.group() == ">":
            return m.start()
        at = html.find(m.group(), m.end()) + 1
        if not at:
            return -1
    return -1


def _upto(html: str, what: str, at: int) -> int:
    """Behind the next `what`; the end if there is none."""
    found = html.find(what, at)
    return len(html) if found < 0 else found + len(what)


def parse(html: str) -> Node:
    """The tree of a page; its leaves are strings."""
    root = Node("#page")
    stack = _Open(root)
    at, n = 0, len(html)
    while at < n:
        sign = html.find("<", at)
        while sign >= 0 and not (html[sign + 1 : sign + 2] in ("!", "?") or TAG.match(html, sign)):
            sign = html.find("<", sign + 1)
        if sign != at:
            text = unescape(html[at : n if sign < 0 else sign])
            if stack.nodes[-1].name == "head" and text.strip(" \t\n\f\r"):
                stack.end("head")
            stack.nodes[-1].children.append(text)
        if sign < 0:
            break
        m = TAG.match(html, sign)
        if not m:
            if html.startswith("<!--", sign):
                comment = COMMENT.match(html, sign)
                at = comment.end() if comment else n
            else:
                at = _upto(html, ">", sign + 1)
            continue
        end = _tag_end(html, m.end())
        if end < 0:
            break
        at, name, attributes = end + 1, m[2].lower(), html[m.end() : end]
        if name not in OF_HEAD and (not m[1] or name in ("br", "body")) and stack.last("head") > stack.last("template"):
            stack.end("head")
        if m[1]:
            if name == "br":
                stack.nodes[-1].children.append(Node("br"))
            elif name == "p" and not stack.last("p"):
                stack.nodes[-1].children.append(Node("p"))
            elif name not in ("body", "html"):
                stack.end(name)
            continue
        if name in ENDS_P:
            stack.close({"p"}, {"td", "th", "table", "button"})
        if name in ENDS:
            stack.close(*ENDS[name])
        if name in ("td", "th") and stack.nodes[-1].name in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack.nodes[-1].children.append(row)
            stack.push(row)
        node = Node(name, attributes)
        stack.nodes[-1].children.append(node)
        # a slash closes an element of drawings and formulas alone
        foreign = name in ("svg", "math") or max(stack.last("svg"), stack.last("math")) > stack.last("foreignobject")
        closed = foreign and attributes.endswith("/")
        if name in RAW and not closed:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if name == "textarea" or name == "xmp":
                node.children.append(unescape(html[at : close.start() if close else n]))
            at = close.end() if close else n
        elif name not in VOID and not closed:
            stack.push(node)
    return root


def shown(attributes: str) -> tuple[bool, bool | None]:
    """Whether an element is displayed, and whether it is visible (None: as its parent), by its attributes."""
    lowered = attributes.lower()
    if "hidden" not in lowered and "style" not in lowered:
        return True, None
    found = {k: v.strip("\"'") for k, v in ATTRIBUTE.findall(lowered)}
    style = dict(STYLE.findall(unescape(found.get("style", ""))))
    visibility = style.get("visibility")
    return "hidden" not in found and style.get("display") != "none", None if visibility in (None, "inherit") else visibility == "visible"


class _Lines:
    """Text laid out so far: finished lines, the line being filled, and blank lines owed before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.owed, self.space = "", 0, False

    def text(self, text: str, indent: str, mark: list[str], keep: bool) -> None:
        pieces = text.split("\n") if keep else [SPACE.sub(" ", text)]
        for i, piece in enumerate(pieces):
            if i:
                self.newline()
            if not keep:
                if piece == " " or not piece:
                    self.space |= bool(piece) and bool(self.line)
                    continue
                piece = (" " if self.space and self.line and piece[0] != " " else "") + piece
                if not self.line or self.line.endswith(" "):
                    piece = piece.lstrip(" ")
                self.space = False
            if not self.line:
                if self.lines:
                    self.lines += [""] * self.owed
                self.owed = 0
                self.line = mark.pop() if mark else indent
            self.line += piece

    def newline(self) -> None:
        if self.line:
            self.lines.append(self.line.rstrip(" "))
            self.line = ""
        self.space = False

    def block(self, blank: bool) -> None:
        self.newline()
        if blank:
            self.owed = 1

    def done(self) -> list[str]:
        self.newline()
        return self.lines


class _Rows:
    """Rows of a table as cells come, and for how many rows, with the last one, cells above hold a column."""

    def __init__(self):
        self.rows: list[list[str]] = []
        self.held: dict[int, int] = {}
        self.next: dict[int, int] = {}

    def row(self) -> None:
        self.held = {c: n - 1 for c, n in self.held.items() if n > 1} | self.next
        self.next = {}
        self.rows.append([])

    def group(self) -> None:
        """No cell spans rows of two groups."""
        self.held, self.next = {}, {}

    def cell(self, row: list[str], text: str, wide: int, tall: int) -> None:
        while len(row) in self.held:
            row.append("")
        wide = min(wide, max(1, MOST_COLUMNS - len(row)))
        if tall > 1:
            self.next.update(dict.fromkeys(range(len(row), len(row) + wide), tall - 1))
        row += [text] + [""] * (wide - 1)


def _span(attributes: str, name: str, most: int, none: int) -> int:
    """Columns or rows that a cell takes; `none` where it says 0."""
    found = re.search(rf"(?<![\w-]){name}\s*=\s*[\"']?\s*\+?(\d+)", attributes, re.I)
    return 1 if not found else min(int(found[1]), most) or none


def _label(attributes: str) -> str:
    found = {k.lower(): v for k, v in ATTRIBUTE.findall(attributes)}
    value = found.get("label", "")
    return unescape(value[1:-1] if value[:1] in "\"'" else value)


def _table(rows: list[list[str]]) -> list[str]:
    """Cells side by side: columns as wide as their widest line; with a tab between cells instead where one before the last, or the table, is very wide."""
    rows = [r for r in rows if any(r)]
    widths = [0] * max(map(len, rows), default=0)
    split = [[cell.split("\n") for cell in row] for row in rows]
    for cells in split:
        for c, lines in enumerate(cells):
            widths[c] = max(widths[c], max(map(len, lines)))
    fits, out = sum(widths) + 2 * len(widths) <= WIDEST_ROW and max(widths[:-1], default=0) <= WIDEST, []
    if not fits:
        # a cell's lines stand under each other before the next cell, as in innerText: a tab for each line and column would be a product
        return [line.rstrip() for row in rows for line in "\t".join(cell.replace("\t", " ") for cell in row).rstrip().split("\n")]
    for cells in split:
        for k in range(max(map(len, cells))):
            line = [cell[k] if k < len(cell) else "" for cell in cells]
            out.append("  ".join(text.ljust(widths[c]) for c, text in enumerate(line)).rstrip())
    return out


def render(root: Node) -> str:
    """The visible text of a tree."""
    out = _Lines()
    # frames to come: a node or string to enter, or a function to call when its content is done
    todo: list = [(root, "", [], False, True, "", True)]
    lists: list[list] = []
    tables: list[_Rows] = []
    outer: list[_Lines] = []
    while todo:
        item = todo.pop()
        if callable(item):
            out = item(out) or out
            continue
        node, indent, mark, keep, seen, inside, told = item
        if isinstance(node, str):
            if seen and told:
                out.text(node, indent, mark, keep)
            continue
        name = node.name
        displayed, visible = shown(node.attributes) if node.attributes else (True, None)
        if name in UNSEEN or not displayed or (name == "dialog" and not any(k.lower() == "open" for k, _ in ATTRIBUTE.findall(node.attributes))):
            continue
        seen = seen if visible is None else visible
        if name in PARTS:
            inside, told = name, False
        elif inside and name in PARTS[inside][1]:
            continue
        elif inside and name in PARTS[inside][0]:
            inside, told = ("" if name == "foreignobject" else inside), name != "optgroup"
        if name == "br":
            if not out.line and out.lines:
                out.owed = max(out.owed, 1)
            out.newline()
            continue
        block, after = name in BLOCK or (inside == "svg" and name == "text") or name == "foreignobject", None
        if block and name not in ("td", "th"):
            out.block(name in SPACED and not (lists and name in ("ul", "ol")))
        if name == "pre":
            keep = True
        if inside == "select" and name in ("option", "optgroup") and (label := _label(node.attributes)):
            if seen:
                out.text(label, indent, mark, False)
                out.newline()
            told = False
        if name in ("ul", "ol", "menu"):
            start = re.search(r"start\s*=\s*[\"']?(-?\d+)", node.attributes) if name == "ol" else None
            lists.append([name == "ol", int(start[1]) if start else 1, indent])
            after = lambda o: lists.pop() and None
        elif name == "li":
            depth = lists[-1] if lists else [False, 1, indent]
            mark = [depth[2] + (f"{depth[1]}. " if depth[0] else "- ")]
            if seen:
                depth[1] += 1
            todo.append(lambda o: o.block(False))
            todo += [(c, " " * len(mark[0]), mark, keep, seen, inside, told) for c in reversed(node.children)]
            continue
        elif name in ("blockquote", "dd"):
            indent += "  "
        elif name == "table":
            tables.append(_Rows())
            outer.append(out)
            hold = out

            def after(o: _Lines, hold=hold, indent=indent, mark=mark) -> _Lines:
                outer.pop()
                loose = o.done()
                for line in [*loose, *_table(tables.pop().rows)]:
                    hold.text(line, indent, mark, True)
                    hold.newline()
                hold.block(True)
                return hold

            out = _Lines()
        elif name in ("thead", "tbody", "tfoot") and tables:
            tables[-1].group()

            def after(o: _Lines, table=tables[-1]) -> None:
                table.group()
                o.block(False)

        elif name == "tr" and tables:
            tables[-1].row()
        elif name in ("td", "th") and tables:
            if not tables[-1].rows:
                tables[-1].row()
            hold = out

            def after(o: _Lines, hold=hold, table=tables[-1], row=tables[-1].rows[-1], attributes=node.attributes) -> _Lines:
                table.cell(row, "\n".join(o.done()), _span(attributes, "colspan", 1000, 1), _span(attributes, "rowspan", 65534, 65534))
                return hold

            out, indent, mark = _Lines(), "", []
        if after:
            todo.append(after)
        elif block:
            todo.append(lambda o, blank=name in SPACED: o.block(blank))
        if name in ("ul", "ol", "menu"):
            todo.append(lambda o, blank=len(lists) == 1: o.block(blank))
        todo += [(c, indent, mark, keep, seen, inside, told) for c in reversed(node.children)]
    return "\n".join(out.done()).strip("\n")


def page_text(html: str | None) -> str | None:
    return None if html is None else render(parse(html))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every page."""

    @tidy
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([page_text(h) for h in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return in_batches(pages.select("page_id", "url", "html")).mapInArrow(extract, f"page_id {kinds[0]}, url {kinds[1]}, text string")
