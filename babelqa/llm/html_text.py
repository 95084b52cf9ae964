"""HTML extraction by layout-aware rendering.

A page is read into a tree (raw-text elements, void elements, end tags that HTML implies,
unclosed and stray tags), and the tree is rendered the way a text browser lays it out: all
visible text, blocks on lines of their own, a blank line around paragraphs, headings, lists
and tables, list markers and indents, preformatted text as it is, and table cells padded to
common column widths.

Visibility: elements that are never shown, ``hidden``, closed ``details`` (all but the summary)
and ``dialog``, hidden inputs, and the cascade of ``display`` and ``visibility`` over the page's
own style sheets and style attributes: later and more specific rules win, ``!important`` before
all, a shown ``display`` undoes ``hidden``, and ``@media`` blocks count if they are for screens.
Selectors are tags, classes, ids and ``*``, alone or together, below or as children of
others; rules with any other selector (states, attributes, siblings) are left out. Buttons and
text fields show their value.

Defined results: null or empty html renders as the empty text; broken markup never fails, and
numbers too long to be meant count as the largest allowed; tables nested deeper than
MAX_TABLES are laid out as blocks; repeated rows are rendered each, rows without an id too; an
empty table gives no row; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style title template noscript iframe noembed noframes audio video canvas svg "
                  "math datalist meta link base param source track area col colgroup".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote figure table fieldset hr menu".split())
BLOCK = SPACED | frozenset("html body address article aside center details dialog dd div dt figcaption footer form "
                           "header hgroup legend li main nav optgroup option section summary search caption tr td th "
                           "thead tbody tfoot".split())
CLOSES_P = BLOCK - frozenset("html body option optgroup caption tr td th thead tbody tfoot legend summary".split()) | {"summary"}
# A start tag ends the open element of these kinds, looked for up to the listed limits.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
SCOPE = frozenset("table td th caption template html body button object".split())
IN_HEAD = frozenset("base link meta noframes noscript script style template title".split())   # others end an open head
MAX_TABLES = 100          # each takes two calls of the stack

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
CSS_PART = re.compile(r"([^{};]*)([{};])")
COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
LONG_NUMBER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
SHOWN_VALUE = frozenset("submit button reset text search email url tel number date time month week".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent


def _unescape(text: str) -> str:
    """Character references resolved; a number beyond all characters is the replacement mark."""
    return html.unescape(LONG_NUMBER.sub("\ufffd", text) if "&#" in text else text)


def _number(value: str, most: int) -> int:
    """A positive number of at most ``most``, 1 where there is none."""
    digits = value.strip().lstrip("0") if value.strip().isascii() and value.strip().isdecimal() else ""
    return min(int(digits), most) if 0 < len(digits) <= 9 else most if digits else 1


@lru_cache(1024)
def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): _unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(ATTRIBUTE.finditer(raw)))}


def build(page: str) -> tuple[Node, list[str]]:
    """The page's tree and the texts of its style sheets."""
    root = Node("html")
    stack, at, sheets = [root], 0, []
    opened: Counter[str] = Counter()      # tags on the stack
    strict = True                         # until a quote is found that never ends

    def text(part: str) -> None:
        if part:
            part = _unescape(part) if "&" in part else part
            if stack[-1].tag == "head" and part.strip(" \t\n\r\f"):
                close({"head"}, set())
            stack[-1].children.append(part)

    def close(tags: set[str], limits: set[str]) -> None:
        """End the nearest open element of ``tags``, unless one of ``limits`` comes first."""
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                opened.subtract(n.tag for n in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in limits:
                return

    while True:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            return root, sheets
        m = TOKEN.match(page, start) if strict or page[start + 1:start + 2] in "!?" else None
        if not m and (len(page) > start + 1 and (page[start + 1].isalpha() or page[start + 1] == "/")):
            m = LOOSE.match(page, start)
            strict = strict and m is None
        if not m:
            text(page[at:start + 1])
            at = start + 1
            continue
        text(page[at:start])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not opened["p"]:
                stack[-1].children.append(Node("p", None, stack[-1]))
            elif tag == "br":
                stack[-1].children.append(Node("br", None, stack[-1]))
            else:
                close({tag}, set() if tag in SCOPE else SCOPE)
            continue
        attrs = _attributes(m[3]) if "=" in m[3] or m[3].strip(" /") else {}
        if tag == "html":
            root.attrs = {**attrs, **root.attrs}
            continue
        if tag == "head" and opened["head"]:
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            close({"head"}, set())
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in IMPLIED:
            tags, limits = IMPLIED[tag]
            if tag in ("tr", "thead", "tbody", "tfoot"):
                close({"td", "th"}, {"table"})
                close({"tr"}, {"table"})
                tags = tags - {"td", "th", "tr"}
            close(tags, limits)
        node = Node(tag, attrs, stack[-1])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
            inner = page[at:end.start() if end else len(page)]
            if tag == "style":
                sheets.append(inner)
            node.children.append(_unescape(inner) if tag in ("textarea", "title") else inner)
            at = (page.find(">", end.start()) + 1 or len(page)) if end else len(page)
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("path", "circle", "rect", "use")):
            stack.append(node)
            opened[tag] += 1


def _declared(body: str) -> dict[str, tuple[bool, str]]:
    """display and visibility of a list of declarations: (important, value)."""
    out: dict[str, tuple[bool, str]] = {}
    for part in body.split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if name in ("display", "visibility") and value:
            urgent = value.endswith("important") and "!" in value
            value = value.split("!")[0].strip()
            if value and (urgent or not out.get(name, (False, ""))[0]):
                out[name] = (urgent, value)
    return out


def _chain(selector: str) -> tuple | None:
    """(tag, names, child) from the element up to its ancestors; None for other selectors."""
    out, child = [], False
    for part in reversed(re.sub(r"\s*>\s*", " > ", selector.strip()).split()):
        if part == ">":
            child = True
            continue
        m = COMPOUND.fullmatch(part)
        if not m:
            return None
        out.append((None if m[1] in (None, "*") else m[1].lower(), frozenset(re.findall(r"[.#][\w-]+", m[2])), child))
        child = False
    return tuple(out) or None


def _for_screens(media: str) -> bool:
    """Whether one of the media named has screens in it; conditions on sizes are taken as met."""
    kinds = [m.split()[:2] for m in media.lower().split(",")]
    return any(not k or (k[0] not in ("print", "speech", "not") and k[-1] not in ("print", "speech")) for k in kinds)


@lru_cache(256)
def _rules(sheet: str) -> tuple[tuple[tuple, tuple, dict], ...]:
    """(chain, specificity, declarations) of a sheet's rules, in order, nested blocks opened."""
    out, open_blocks, body = [], [], ""
    if "display" not in sheet.lower() and "visibility" not in sheet.lower():
        return ()
    for m in CSS_PART.finditer(re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S)):
        text, mark = m[1].strip(), m[2]
        if mark == "{":
            open_blocks.append(text)
            body = ""
        elif mark == ";":
            body += text + ";"
        elif open_blocks:
            selectors = open_blocks.pop()
            outer = [b.lower() for b in open_blocks]
            applies = all(b.startswith(("@supports", "@layer", "@container")) or (b.startswith("@media") and _for_screens(b[6:]))
                          for b in outer)
            found = _declared(body + text) if applies and not selectors.startswith("@") else {}
            for selector in selectors.split(",") if found else ():
                chain = _chain(selector)
                if chain:
                    ids = sum(n[0] == "#" for _, names, _ in chain for n in names)
                    classes = sum(n[0] == "." for _, names, _ in chain for n in names)
                    out.append((chain, (ids, classes, sum(t is not None for t, _, _ in chain)), found))
            body = ""
    return tuple(out)


def _fits(part: tuple, node: Node) -> bool:
    tag, names, _ = part
    if tag is not None and tag != node.tag:
        return False
    if not names:
        return True
    own = {"." + c for c in node.attrs.get("class", "").split()}
    return names <= own | {"#" + node.attrs.get("id", "")}


def _matches(chain: tuple, node: Node) -> bool:
    """Whether an element and its ancestors fit a chain of selectors."""
    if not _fits(chain[0], node):
        return False
    above = [node]                       # elements that the parts so far may have ended at
    for part in chain[1:]:
        found, seen = [], set()
        for n in above:
            up = n.parent
            while up is not None and id(up) not in seen:
                seen.add(id(up))
                if _fits(part, up):
                    found.append(up)
                up = None if part[2] else up.parent
        if not found:
            return False
        above = found
    return True


class Renderer:
    def __init__(self, sheets: list[str]):
        self.rules: dict[str, list[tuple]] = {}
        for k, (chain, weight, found) in enumerate(r for sheet in sheets for r in _rules(sheet)):
            tag, names, _ = chain[0]
            self.rules.setdefault(min(names, default=tag or "*"), []).append((weight, k, chain, found))

    def styled(self, node: Node, name: str) -> str | None:
        """The value that wins the cascade for display or visibility, None without one."""
        best = None
        if self.rules:
            attrs = node.attrs
            keys = ["*", node.tag, "#" + attrs.get("id", ""), *("." + c for c in attrs.get("class", "").split())]
            for key in dict.fromkeys(keys):
                for weight, k, chain, found in self.rules.get(key, ()):
                    if name in found and _matches(chain, node):
                        urgent, value = found[name]
                        best = max(best or (), (urgent, 0, weight, k, value))
        if "style" in node.attrs:
            own = _declared(node.attrs["style"]).get(name)
            if own:
                best = max(best or (), (own[0], 1, (), 0, own[1]))
        return best[-1] if best else None

    def shown(self, node: Node) -> bool:
        if node.tag in NEVER:
            return False
        display = self.styled(node, "display") if self.rules or node.attrs else None
        if display is not None:
            return display != "none"
        return "hidden" not in node.attrs and (node.tag != "dialog" or "open" in node.attrs)

    def visible(self, node: Node, inherited: bool) -> bool:
        sight = self.styled(node, "visibility") if self.rules or node.attrs else None
        return inherited if sight in (None, "inherit", "unset") else sight not in ("hidden", "collapse")

    def lines(self, node: Node, depth: int = 0, visible: bool = True) -> list[str]:
        """The node's text as lines, under the visibility in force; an explicit stack, so nesting cannot exhaust it."""
        out, line, gap = [], [], 0     # gap: blank lines asked for before the next text
        indent, marker, pre = "", "", 0
        trailing = True                # the open line is empty or ends in white space

        def flush(blank: int) -> None:
            nonlocal line, gap, trailing, marker
            got = "".join(line)
            got = got.rstrip(" ") if not pre else got
            if got or marker.strip() and line:
                if out:
                    out.extend([""] * gap)
                out.append((indent[:len(indent) - len(marker)] + marker if marker else indent) + got)
                gap, marker = 0, ""
            line, trailing = [], True
            if out:
                gap = max(gap, blank)

        work: list[tuple] = [("node", node)]
        while work:
            kind, x = work.pop()
            if kind == "restore":
                tag, state, blank = x
                flush(blank if tag in SPACED else 0) if tag in BLOCK else None
                indent, marker_before, pre, visible = state
                marker = "" if tag == "li" else marker
            elif kind == "node" and isinstance(x, str):
                if not visible:
                    continue
                if pre:
                    first, *rest = x.split("\n")
                    line.append(first)
                    for more in rest:
                        if out:
                            out.extend([""] * gap)
                        out.append(indent + "".join(line))
                        gap, line = 0, [more]
                    trailing = not line[-1]
                    continue
                x = SPACE.sub(" ", x)
                if trailing:
                    x = x.lstrip(" ")
                if x:
                    line.append(x)
                    trailing = x[-1] == " "
            elif not self.shown(x):
                continue
            elif x.tag == "br":
                if line:
                    flush(0)
                elif visible and out:
                    gap = max(gap, 1)
            elif x.tag == "table" and visible and depth < MAX_TABLES:
                flush(1)
                rows = self.table(x, depth + 1, visible)
                if rows:
                    out.extend([""] * (gap if out else 0))
                    out.extend(indent + r for r in rows)
                    gap = 1
            else:
                blank = 0 if x.tag in ("ul", "ol") and indent else 1
                if x.tag in BLOCK:
                    flush(blank if x.tag in SPACED else 0)
                state = (indent, marker, pre, visible)
                work.append(("restore", (x.tag, state, blank)))
                visible = self.visible(x, visible)
                children = x.children
                if x.tag == "input" and x.attrs.get("type", "text").lower() in SHOWN_VALUE and x.attrs.get("value"):
                    children = [x.attrs["value"]]
                if x.tag in ("pre", "textarea", "xmp"):
                    pre += 1
                    if children and isinstance(children[0], str):
                        children = [children[0].removeprefix("\n"), *children[1:]]
                elif x.tag in ("ul", "ol", "menu"):
                    start = x.attrs.get("start", "1")
                    n = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
                    for c in children:
                        if isinstance(c, Node) and c.tag == "li":
                            c.attrs = {**c.attrs, " marker": f"{n}. " if x.tag == "ol" else "- "}
                            n += 1
                elif x.tag == "li":
                    marker = x.attrs.get(" marker", "- ")
                    indent += " " * len(marker)
                elif x.tag in ("dd", "blockquote"):
                    indent += "  "
                elif x.tag == "details" and "open" not in x.attrs:
                    children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
                work.extend(("node", c) for c in reversed(children))
        flush(0)
        return out

    def table(self, table: Node, depth: int, visible: bool) -> list[str]:
        """Rows of cells padded to the widths of their columns."""
        visible = self.visible(table, visible)
        rows, caption, work = [], [], [(c, visible) for c in reversed(table.children)]
        while work:
            x, visible = work.pop()
            if isinstance(x, str):
                if x.strip() and visible:
                    rows.append([(0, 1, [SPACE.sub(" ", x).strip()])])
            elif not self.shown(x):
                continue
            elif x.tag in ("thead", "tbody", "tfoot"):
                visible = self.visible(x, visible)
                work.extend((c, visible) for c in reversed(x.children))
            elif x.tag == "caption":
                caption += self.lines(_as_block(x), depth, self.visible(x, visible))
            elif x.tag == "tr":
                rows.append((x, self.visible(x, visible)))
            else:
                rows.append([(0, 1, self.lines(_as_block(x), depth, self.visible(x, visible)))])
        grid, taken = [], {}           # taken: column -> rows that a cell above still covers
        for row in rows:
            if isinstance(row, list):
                grid.append(row)
                continue
            row, visible = row
            cells, column, below = [], 0, {}
            for c in row.children:
                if isinstance(c, str):
                    if not c.strip():
                        continue
                    c = _as_block(Node("td"), [c])
                if not self.shown(c):
                    continue
                while taken.get(column, 0):
                    column += 1
                wide, tall = _number(c.attrs.get("colspan", "1"), 1000), _number(c.attrs.get("rowspan", "1"), 65534)
                cells.append((column, wide, self.lines(_as_block(c), depth, self.visible(c, visible))))
                for k in range(column, column + wide):
                    below[k] = tall
                column += wide
            taken = {k: n - 1 for k, n in taken.items() if n > 1} | {k: n - 1 for k, n in below.items() if n > 1}
            grid.append(cells)
        width: dict[int, int] = {}
        for cells in grid:
            for column, wide, text in cells:
                if wide == 1:
                    width[column] = max(width.get(column, 0), *(len(t) for t in text or [""]))
        out = caption
        for cells in grid:
            if not any(text for _, _, text in cells):
                continue
            for k in range(max(len(text) for _, _, text in cells)):
                parts, upto = [], 0
                for column, wide, text in cells:
                    parts += [" " * width.get(c, 0) for c in range(upto, column)]
                    room = sum(width.get(c, 0) for c in range(column, column + wide)) + 3 * (wide - 1)
                    parts.append((text[k] if k < len(text) else "").ljust(room))
                    upto = column + wide
                out.append(" | ".join(parts).rstrip())
        return out


def _as_block(node: Node, children: list | None = None) -> Node:
    block = Node("div")
    block.children = node.children if children is None else children
    return block


def render(page: str | None) -> str:
    """The visible text of one page."""
    if not page:
        return ""
    root, sheets = build(page)
    return "\n".join(Renderer(sheets).lines(root)).strip("\n")


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, text, n_chars, n_lines."""
    prepare(pages.sparkSession)

    def run(batches):
        for batch in batches:
            text = pa.array([render(h) for h in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), text], names=["page_id", "text"])

    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    out = pages.mapInArrow(run, "page_id long, text string")
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"),
                      F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
