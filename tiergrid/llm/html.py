"""HTML extraction: a tree with implied tags and visibility rules, rendered as text with its layout.

All visible text is kept: blocks stand on lines of their own, paragraphs and headings apart, list
items have markers and indents, and a table's cells are aligned in columns.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, small_batches

# Classes of elements in the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("head script style template noscript title meta link base iframe object embed audio video canvas svg math datalist noembed noframes param source track area map".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table ul tr caption".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure".split())
#: Tags whose start ends an open one: the open one, and where the search for it stops.
CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"), "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "thead": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "tbody": ("thead tbody tfoot tr td th caption colgroup", "table"), "tfoot": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "h1": ("h1 h2 h3 h4 h5 h6", ""), "h2": ("h1 h2 h3 h4 h5 h6", ""), "h3": ("h1 h2 h3 h4 h5 h6", ""), "h4": ("h1 h2 h3 h4 h5 h6", ""), "h5": ("h1 h2 h3 h4 h5 h6", ""), "h6": ("h1 h2 h3 h4 h5 h6", ""),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split()) | {"html", "body", "table", "td", "th", "caption"} - ({"td", "th", "caption"} if k in ("tr", "td", "th", "thead", "tbody", "tfoot") else set())) for k, (a, b) in CLOSES.items()}
ENDS_P = BLOCK - {"body", "html", "option", "optgroup", "caption", "tr"}
#: An end tag doesn't reach past these to an element outside.
FENCE = frozenset("html body table td th caption".split())
HEAD_ONLY = frozenset("head title meta link base style script template noscript".split())

#: What may follow ``<``.  No two alternatives of a tag's inside begin alike and none is tried again, so a tag costs its length.
COMMENT = re.compile(r"!--(?:-?>|.*?--!?>|.*\Z)", re.S)
BOGUS = re.compile(r"(?:[!?]|/(?![A-Za-z]))[^>]*>")
TAG = re.compile(r"(/?)([A-Za-z][^\s/>]*+)((?:[^>\"'=]|=\s*+(?:\"[^\"]*\"|'[^']*')?|[\"'])*+)>")
OPENS = re.compile(r"<[A-Za-z!?/]")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: The most columns and rows of a cell in the HTML standard.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
#: Columns are no wider than this; longer cells stick out.
MAX_WIDTH = 60
SPACES = re.compile(r"[ \t\n\r\f\v]+")
MAX_DEPTH = 200


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None) -> None:
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def parse(html: str) -> Node:
    """The tree under an ``html`` node: missing ends are implied, stray ends are dropped.

    Elements nested deeper than MAX_DEPTH become siblings, which keeps their text.  A tag that the page's end cuts
    off is dropped, as the standard has it.
    """
    root = Node("html")
    body = Node("body")
    head: Node | None = None
    stack: list[Node] = [root]
    at = 0

    def into_body() -> None:
        if body not in stack:
            if not any(c is body for c in root.children):
                root.children.append(body)
            stack[:] = [root, body]

    def text(s: str) -> None:
        if s:
            if stack[-1] is root or stack[-1] is head:
                if not s.strip(" \t\n\r\f"):
                    return
                into_body()
            stack[-1].children.append(unescape(s) if "&" in s else s)

    while True:
        opening = OPENS.search(html, at)
        if not opening:
            text(html[at:])
            return root
        text(html[at : opening.start()])
        at = opening.start() + 1
        m = COMMENT.match(html, at) or BOGUS.match(html, at)
        if m:
            at = m.end()
            continue
        m = TAG.match(html, at)
        if not m:
            return root
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag in ("html", "body"):
                continue
            if tag == "head":
                stack[:] = [root]
                continue
            if tag == "br":
                into_body() if len(stack) == 1 else None
                stack[-1].children.append(Node("br"))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag and stack[k] is not body:
                    del stack[k:]
                    break
                if stack[k].tag in FENCE and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot"):
                    break
            continue
        attributes = {k.lower(): unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3] else {}
        if tag == "html":
            root.attributes |= attributes
            continue
        if tag == "body":
            into_body()
            body.attributes |= attributes
            continue
        if tag == "head":
            if head is None and body not in stack:
                head = Node("head")
                root.children.append(head)
                stack[:] = [root, head]
            continue
        if body not in stack and tag not in HEAD_ONLY:
            into_body()
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in FENCE or stack[k].tag in ("button", "object"):
                    break
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            cut = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    cut = k
                elif stack[k].tag in stops or (cut is not None and stack[k].tag not in ends):
                    break
            if cut is not None:
                del stack[cut:]
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I).search(html, at) if tag != "plaintext" else None
            inside = html[at : end.start()] if end else html[at:]
            node.children.append(unescape(inside) if tag in ("textarea", "title") else inside)
            at = end.end() if end else len(html)
        elif tag not in VOID and not m[3].rstrip().endswith("/") or tag in BLOCK and tag != "hr":
            if len(stack) < MAX_DEPTH:
                stack.append(node)


def visible(node: Node) -> bool:
    a = node.attributes
    if node.tag in HIDDEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False
    if node.tag == "dialog" and "open" not in a:
        return False
    return not (a.get("style") and UNSEEN.search(a["style"]))


def hides(node: Node, inherited: bool) -> bool:
    """Whether the node's own text is hidden; ``visibility`` is inherited, and an element inside may set it back."""
    found = VISIBILITY.findall(node.attributes.get("style", "")) if node.attributes else []
    return found[-1].lower() != "visible" if found else inherited


def shown(node: Node) -> list:
    """The children that may be rendered: of closed ``details`` the first summary alone."""
    if node.tag == "details" and "open" not in node.attributes:
        return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
    return node.children


class Lines:
    """Lines of text under construction; spaces collapse across inline elements."""

    def __init__(self, hidden: bool = False) -> None:
        self.hidden = hidden
        self.done: list[str] = []
        self.now, self.space, self.gap = "", False, False
        self.prefix, self.marker = "", ""

    def inline(self, text: str) -> None:
        if self.hidden:
            return
        collapsed = SPACES.sub(" ", text)
        body = collapsed.strip(" ")
        if not body:
            self.space |= bool(collapsed)
            return
        if self.now and (self.space or collapsed[0] == " "):
            self.now += " "
        self.now += body
        self.space = collapsed[-1] == " "

    def end(self) -> None:
        """End the line, if it holds anything."""
        if self.now:
            self.put(self.now)
        self.now, self.space = "", False

    def put(self, line: str) -> None:
        if self.gap and self.done:
            self.done.append("")
        self.gap = False
        self.done.append(self.prefix + self.marker + line)
        if self.marker:
            self.prefix += " " * len(self.marker)
            self.marker = ""

    def apart(self) -> None:
        self.end()
        self.gap = True


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attributes.get(name, "1")
    return max(1, min(int(value[:9]), most)) if value.isascii() and value.isdigit() else 1


def _table(node: Node, lines: Lines) -> None:
    """A table with its cells aligned.  A cell stands in the first column that no cell from a row above reaches into."""
    rows: list[list[tuple[int, list[str]]]] = []

    def filled(children: list, hidden: bool) -> list[str]:
        inner = Lines(hidden)
        _render(children, inner)
        inner.end()
        return [x for x in inner.done if x]

    def cells(parent: Node, hidden: bool, below: dict[int, int]) -> None:
        """``below`` has the columns that cells from above reach into, and for how many rows more."""
        for row in parent.children:
            if isinstance(row, str):
                if row.strip():
                    lines.inline(row)
                    lines.end()
            elif not visible(row):
                continue
            elif row.tag in ("thead", "tbody", "tfoot"):
                cells(row, hides(row, hidden), {})  # cells don't reach out of their group
            elif row.tag in ("tr", "td", "th"):
                out, at, taken, dark = [], 0, dict(below), hides(row, hidden)
                for column in list(below):
                    below[column] -= 1
                    if not below[column]:
                        del below[column]
                for cell in row.children if row.tag == "tr" else [row]:
                    real = isinstance(cell, Node)
                    if real and not visible(cell):
                        continue
                    found = filled(cell.children, hides(cell, dark)) if real and cell.tag in ("td", "th") else filled([cell], dark)
                    if not real and not found:
                        continue
                    while at in taken:
                        at += 1
                    out.append((at, found or [""]))
                    wide, high = (_span(cell, "colspan", MAX_COLSPAN), _span(cell, "rowspan", MAX_ROWSPAN)) if real else (1, 1)
                    if high > 1:
                        below.update(dict.fromkeys(range(at, at + wide), high - 1))
                    at += wide
                rows.append(out)
            else:
                _render([row], lines)
                lines.end()

    cells(node, lines.hidden, {})
    widths: dict[int, int] = {}
    for row in rows:
        for column, cell in row:
            widths[column] = max(widths.get(column, 0), min(max(map(len, cell)), MAX_WIDTH))
    columns = sorted(widths)  # columns that no cell begins in take no room
    for row in rows:
        held = dict(row)
        last = max(held, default=-1)
        for n in range(max(map(len, held.values()), default=0)):
            line = "  ".join((held[c][n] if c in held and n < len(held[c]) else "").ljust(widths[c]) for c in columns if c <= last).rstrip()
            if line:
                lines.put(line)


def _render(children: list, lines: Lines, ordered: list[int] | None = None) -> None:
    for child in children:
        if isinstance(child, str):
            lines.inline(child)
        elif visible(child):
            hidden, lines.hidden = lines.hidden, hides(child, lines.hidden)
            _render_node(child, lines, ordered)
            lines.hidden = hidden


def _render_node(child: Node, lines: Lines, ordered: list[int] | None) -> None:
    tag = child.tag
    if tag == "br":
        if lines.now:
            lines.end()
        else:
            lines.gap = bool(lines.done)
    elif tag == "hr":
        lines.apart()
    elif tag == "img":
        if child.attributes.get("alt"):
            lines.inline(child.attributes["alt"])
    elif tag == "input":
        if child.attributes.get("type", "text").lower() in ("submit", "button", "reset", "text") and child.attributes.get("value"):
            lines.inline(child.attributes["value"])
    elif tag == "table":
        lines.apart()
        _table(child, lines)
        lines.gap = True
    elif tag == "pre":
        lines.apart()
        for line in _plain(child, lines.hidden).strip("\n").split("\n"):
            lines.put(line.rstrip())
        lines.gap = True
    elif tag == "li":
        lines.end()
        kept, marker = lines.prefix, lines.marker
        if ordered is not None:
            value = child.attributes.get("value", "")
            ordered[0] = int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else ordered[0] + 1
        lines.prefix, lines.marker = kept + " " * len(marker), f"{ordered[0]}. " if ordered is not None else "- "
        _render(shown(child), lines)
        lines.end()
        lines.prefix, lines.marker = kept, "" if not marker else marker
    elif tag in ("ul", "ol", "menu", "dir"):
        nested = bool(lines.prefix or lines.marker)
        lines.end() if nested else lines.apart()
        start = child.attributes.get("start", "")
        _render(shown(child), lines, [int(start) - 1 if re.fullmatch(r"-?[0-9]{1,9}", start) else 0] if tag == "ol" else None)
        lines.end()
        lines.gap |= not nested
    elif tag in BLOCK:
        far = tag in APART and not lines.marker
        lines.apart() if far else lines.end()
        kept = lines.prefix
        if tag in ("dd", "blockquote"):
            lines.prefix += "  "
        _render(shown(child), lines)
        lines.end()
        if tag in ("dd", "blockquote"):
            lines.prefix = kept
        lines.gap |= far
    else:
        _render(shown(child), lines, ordered if tag in ("span", "a") else None)


def _plain(node: Node, hidden: bool) -> str:
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append("" if hidden else c)
        elif c.tag == "br":
            out.append("\n")
        elif visible(c):
            out.append(_plain(c, hides(c, hidden)))
    return "".join(out)


def extract(html: str) -> str:
    """The visible text of a page with its layout."""
    lines = Lines()
    root = parse(html.replace("\r\n", "\n").replace("\r", "\n"))
    if visible(root):
        lines.hidden = hides(root, False)
        _render(root.children, lines)
        lines.end()
    return "\n".join(lines.done)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The visible text of whole pages.

    Returns one row for each input row: ``page_id``, ``text``, ``n_lines`` (0 for no text).  A null or empty page has an empty text.
    Ids pass through unread, null or repeated; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h) if h else "" for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], names=["page_id", "text", "n_lines"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return arrow_map(rows, run, f"page_id {kind}, text string, n_lines long")
