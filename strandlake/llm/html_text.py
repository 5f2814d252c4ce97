"""HTML extraction by layout-aware rendering.

A tree builder makes the element tree of a page (implied and missing end tags, void and raw-text elements), visibility
rules drop what a reader does not see, and a renderer writes all visible text: blocks on lines of their own with blank
lines where pages have margins, lists with marks and indents, tables with aligned columns, preformatted text as it is.

Scale: one pass without a shuffle, a page at a time; trees may be of any depth, as tree walks use no recursion and the
open elements of each kind are counted.

Defined cases: null and empty pages give empty text; broken markup is text or is repaired; very long and very deep pages
are rendered whole; rows with null ids and repeated rows are kept; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from strandlake.llm.common import take_column

#: Fixed values of HTML: what colspan and rowspan may be at most.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript noframes noembed iframe datalist object audio video canvas svg map link meta base".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu hr article section fieldset".split())
#: An open element of the key is ended by the start of one of the values.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main "
    "menu nav ol p pre search section table ul li dd dt".split()
)
#: Start tag -> (elements it ends, elements beyond which it does not look).
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl table".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl table".split())),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset("table tbody thead tfoot".split())),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}

#: Quotes open a string only after the = of an attribute; elsewhere they are part of names and unquoted values.
_ATTRS = r"(?:[ \t\n\r\f/]++|[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^ \t\n\r\f>]*+)|(?![ \t\n\r\f]*=)))*+"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^ \t\n\r\f/>]*+" + _ATTRS + ">", re.S)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*=[ \t\n\r\f]*(?:\"([^\"]*)\"|'([^']*)'|([^ \t\n\r\f>\"'][^ \t\n\r\f>]*))?)?")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def build_tree(page: str) -> tuple[Node, list[str]]:
    """The root of the element tree (children are nodes and strings) and the contents of style elements."""
    root = Node("html", {})
    stack, styles, at, low = [root], [], 0, None
    opened: Counter[str] = Counter()

    def close(i: int) -> None:
        opened.subtract(x.tag for x in stack[i:])
        del stack[i:]

    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
        if not m:
            return root, styles
        at, token = m.end(), m.group()
        if token[1] in "!?":
            continue
        if token[1] == "/":
            name = _NAME.match(token, 2).group().lower()
            if name == "br":
                stack[-1].children.append(Node("br", {}))
            for i in range(len(stack) - 1, 0, -1) if opened[name] > 0 else ():
                if stack[i].tag == name:
                    close(i)
                    break
                if stack[i].tag in ("table", "td", "th") and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "html", "body"):
                    break  # an end tag inside a cell ends nothing around it
            continue
        n = _NAME.match(token, 1)
        name, rest = n.group().lower(), token[n.end() : -1]
        attrs = {a.group(1).lower(): html.unescape(next((g for g in a.groups()[1:] if g is not None), "")) for a in _ATTR.finditer(rest)} if len(rest) > 1 else {}
        if name == "html":
            root.attrs = attrs | root.attrs
            continue
        if name in ENDS_P and opened["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in ("table", "td", "th", "button", "caption"):
                    break
        ended, fence = CLOSES.get(name, (None, None))
        if ended and any(opened[x] > 0 for x in ended):
            cut = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in fence:
                    break
                if stack[i].tag in ended:
                    cut = i
            if cut:
                close(cut)
        if name not in ("meta", "link", "base", "script", "style", "title", "noscript", "template", "head") and stack[-1].tag == "head":
            close(len(stack) - 1)  # the body begins
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name in RAW:
            if low is None:
                low = page.lower()
                if len(low) != len(page):  # lowering can lengthen a few letters
                    low = re.sub(r"[A-Z]", lambda x: x.group().lower(), page)
            end = low.find("</" + name, at)
            body = page[at:] if end < 0 else page[at:end]
            if name == "style":
                styles.append(body)
            node.children.append(html.unescape(body) if name in ("title", "textarea") else body)
            at = len(page) if end < 0 else page.find(">", end) + 1 or len(page)
        elif name not in VOID and not rest.endswith("/") or name in ("p", "div", "span", "li", "td", "th", "tr", "a", "b", "i"):
            stack.append(node)
            opened[name] += 1


def _hidden_selectors(styles: list[str]) -> frozenset[str]:
    """Simple selectors (tag, .class, #id) of rules that hide."""
    out = set()
    for s in styles:
        for names, body in _RULE.findall(re.sub(r"/\*.*?\*/", "", s, flags=re.S)):
            if _HIDES.search(body):
                out.update(x for x in (y.strip() for y in names.split(",")) if re.fullmatch(r"[.#]?[\w-]+", x))
    return frozenset(out)


def _seen(node: Node, parent: Node, hiding: frozenset[str]) -> bool:
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or node.tag == "dialog" and "open" not in a or node.tag == "input":
        return False
    if parent.tag == "details" and "open" not in parent.attrs and node.tag != "summary":
        return False
    if "style" in a and _HIDES.search(a["style"]):
        return False
    if hiding and (node.tag in hiding or "#" + a.get("id", "") in hiding or any("." + c in hiding for c in a.get("class", "").split())):
        return False
    return True


class _Flow:
    """Lines of one flow of text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False  # a space is due before the next word
        self.blank = False  # a blank line is due before the next text
        self.lead: list[str] = []  # indents; a list mark stands in the last until it is used

    def text(self, s: str) -> None:
        parts = _SPACE.split(s)
        for k, w in enumerate(parts):
            if k:
                self.gap = True
            if w:
                if self.gap and self.line:
                    self.line.append(" ")
                self.line.append(w)
                self.gap = False

    def end_line(self) -> None:
        self.gap = False
        if self.line:
            self.put("".join(self.line))
            self.line = []

    def put(self, s: str) -> None:
        if self.blank and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank = False
        self.lines.append(("".join(self.lead) + s).rstrip())
        self.lead = [x if not x.strip() else " " * len(x) for x in self.lead]

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.blank |= spaced

    def result(self) -> list[str]:
        self.end_line()
        return self.lines


def _span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "").strip()
    n = int(value) if re.fullmatch(r"\d{1,6}", value) else 1
    return most if not n and name == "rowspan" else min(max(n, 1), most)


def _table(rows: list[list[tuple[list[str], int, int]]], out: _Flow) -> None:
    """Rows of cells (lines, columns, rows) with aligned columns; a cell stands in the first row and column that it covers."""
    placed: list[list[tuple[int, int, list[str]]]] = []
    covered: dict[int, int] = {}  # column: rows below that a cell from above still covers
    wide: list[int] = []
    for r in rows:
        line, k, fresh = [], 0, {}
        for cell, columns, down in r:
            while covered.get(k):
                k += 1
            line.append((k, columns, cell))
            if down > 1:
                fresh |= dict.fromkeys(range(k, k + columns), down - 1)
            k += columns
        covered = {c: n - 1 for c, n in covered.items() if n > 1} | fresh
        placed.append(line)
    for one in (True, False):  # cells of one column first; wider ones then widen their last column
        for k, columns, cell in (x for line in placed for x in line if (x[1] == 1) == one):
            size = max((len(x) for x in cell), default=0)
            if size or one:
                wide += [0] * (k + columns - len(wide))
                have = sum(wide[k : k + columns]) + 2 * (columns - 1)
                wide[k + columns - 1] += max(0, size - have)
    starts = [0]
    for w in wide:
        starts.append(starts[-1] + w + 2)
    for line in placed:
        if any(any(cell) for *_, cell in line):
            for y in range(max(len(cell) for *_, cell in line)):
                text = ""
                for k, _, cell in line:
                    if y < len(cell) and cell[y]:
                        text = text.ljust(starts[k]) + cell[y]
                out.put(text.rstrip())


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    root, styles = build_tree(page)
    hiding = _hidden_selectors(styles)
    flows = [_Flow()]
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    lists: list[list] = []  # kind and next number
    stack: list[tuple[Node, int]] = [(root, 0)]
    pre = 0
    while stack:
        node, i = stack.pop()
        flow, tag = flows[-1], node.tag
        if i < len(node.children):
            stack.append((node, i + 1))
            child = node.children[i]
            if isinstance(child, str):
                if tag == "details" and "open" not in node.attrs or tag in ("table", "tr", "tbody", "thead", "tfoot", "select") and not child.strip():
                    continue
                if pre:
                    first, *more = child.replace("\r\n", "\n").split("\n")
                    flow.line.append(first)
                    for x in more:
                        flow.put("".join(flow.line))
                        flow.line = [x]
                else:
                    flow.text(child)
                continue
            if not _seen(child, node, hiding):
                continue
            t = child.tag
            if t == "br":
                if flow.line:
                    flow.end_line()
                elif flow.lines:
                    flow.blank = True
                continue
            if t == "hr":
                flow.block(True)
                continue
            if t in BLOCK:
                flow.block(t in SPACED and not (t in ("ul", "ol", "menu") and lists))
            if t in ("td", "th") and tables:
                flows.append(_Flow())
            elif t == "table":
                tables.append([])
            elif t == "tr" and tables:
                tables[-1].append([])
            elif t in ("ul", "ol", "menu", "dir"):
                start = child.attrs.get("start", "1")
                lists.append([t, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
                flow.lead.append("  " if len(lists) > 1 else "")
            elif t == "li":
                value = child.attrs.get("value", "").strip()
                if lists and re.fullmatch(r"-?\d{1,9}", value):
                    lists[-1][1] = int(value)
                mark = f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "
                if lists:
                    lists[-1][1] += 1
                flow.lead.append(mark)
            elif t in ("blockquote", "dd"):
                flow.lead.append("  ")
            elif t == "pre":
                pre += 1
            elif t == "q":
                flow.text('"')
            stack.append((child, 0))
            continue
        # the end of an element
        if tag in ("td", "th") and tables:
            cell = flows.pop().result()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((cell, _span(node, "colspan", MAX_COLSPAN), _span(node, "rowspan", MAX_ROWSPAN)))
            continue
        if tag in BLOCK:
            if tag == "pre" and pre:
                pre -= 1
                if flow.line and not "".join(flow.line).strip():
                    flow.line = []
            flow.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and len(lists) > 1))
        if tag == "table" and tables:
            _table(tables.pop(), flow)
            flow.block(True)
        elif tag in ("ul", "ol", "menu", "dir") and lists:
            lists.pop()
            flow.lead.pop()
        elif tag == "li" or tag in ("blockquote", "dd"):
            flow.lead.pop()
        elif tag == "q":
            flow.text('"')
    return "\n".join(flows[0].result()).strip("\n")


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, text) for every row of pages (page_id, html)."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                text = [render(x) for x in take_column(part, "html").to_pylist()]
                yield pa.RecordBatch.from_arrays([take_column(part, "page_id"), pa.array(text, pa.string())], names=["page_id", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, text string")
