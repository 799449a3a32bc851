"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a text renderer."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Generator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.llm.common import map_column, table

START = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)")
#: From a place between attributes to the tag's end or the next quoted value.
GAP = re.compile(r"""(?:[^>=]++|=(?!\s*["']))*+(?:(>)|=\s*(["']))""")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Blocks of style sheets for paper.
PRINT = re.compile(r"@media[^{]*\bprint\b[^{]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SIMPLE = re.compile(r"([a-z][\w-]*|\*)?((?:[.#][\w-]+)*)", re.I)
NONE = re.compile(r"display\s*:\s*none", re.I)
UNSEEN = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title meta link annotation annotation-xml".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset".split())
BLOCK = MARGIN | frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main menu nav option section summary tbody td tfoot th thead tr".split())
CLOSES_P = BLOCK - frozenset("body html option td th tr tbody thead tfoot caption legend".split())
#: What an opening tag ends, and where the search for it stops.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)), "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
}
#: Lists, quotes and table cells nested deeper keep their text and markers, without indentation and columns (the output would grow with the square of the depth).
LEVELS = 512
#: Most columns and rows that a cell spans, as in browsers.
WIDEST, HIGHEST = 1000, 65_534
#: Kinds of input whose value is shown.
SHOWN = frozenset("text search email url tel number date time month week submit button reset".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(self.attrs):
            out.setdefault(m[1].lower(), unescape(next((x for x in m.groups()[1:] if x is not None), "")))
        return out


def tags(html: str) -> Generator:
    """(start, end, slash or "", name, attributes) of tags in order; name is None for comments and declarations.

    A quoted value may hold ``>``.  A tag whose quotes never close ends at its first ``>``, and one without is text.
    Linear: places from which no end was found aren't tried again.
    """
    at, last, hopeless = 0, html.rfind(">"), set()
    while (m := START.search(html, at)) is not None:
        if m[2] is None:
            end = html.find("-->", m.end()) + 3 if m[0] == "<!--" else html.find(">", m.end()) + 1
            at = end if end > 2 or end and m[0] != "<!--" else len(html)
            yield m.start(), at, "", None, ""
            continue
        i, passed, end = m.end(), [], 0
        while i <= last and i not in hopeless and (gap := GAP.match(html, i)) is not None:
            passed.append(i)
            if gap[1]:
                end = gap.end()
                break
            i = html.find(gap[2], gap.end()) + 1
            if not i:
                break
        if not end:
            hopeless.update(passed)
            end = html.find(">", m.end()) + 1 if m.end() <= last else 0
        if not end:
            at = m.end()
            continue
        at = end
        close = yield m.start(), end, m[1], m[2].lower(), html[m.end() : end - 1]
        if close is not None:
            at = close
            yield None


def parse(html: str) -> tuple[Node, list[str]]:
    """The tree and the contents of its style elements.

    Elements may be nested to any depth.
    """
    root = Node("html")
    stack, styles, at = [root], [], 0
    places: dict[str, list[int]] = {}  # of the open elements but the root, by tag

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().tag].pop()

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags, stops) -> None:
        i = last(tags)
        if i > last(stops):
            # an element ends with the outermost of its kind before the stop
            while i > 1 and stack[i - 1].tag in tags:
                i -= 1
            cut(i)

    found = tags(html)
    for start, end, ends, tag, attrs in found:
        if start > at:
            stack[-1].children.append(unescape(html[at:start]))
        at = end
        if tag is None:
            continue
        if ends:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            else:
                stops = ("table",) if tag in ("p", "li", "div", "ul", "ol", "span") else ()
                i = last((tag,))
                if i > last(stops):
                    cut(i)
            continue
        if tag in ("html", "body"):
            root.attrs += " " + attrs
            if tag == "body":
                close(("head",), ())
            continue
        if tag in CLOSES_P:
            close(("p",), ("table", "td", "th", "button", "object", "caption"))
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag not in NEVER and stack[-1].tag == "head" and len(stack) > 1:
            cut(len(stack) - 1)
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            push(row)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in END:
            close_tag = END[tag].search(html, at)
            body = html[at : close_tag.start() if close_tag else len(html)]
            if tag == "style":
                styles.append(body)
            node.children.append(unescape(body) if tag in ("title", "textarea") else body)
            at = close_tag.end() if close_tag else len(html)
            found.send(at)
        elif tag not in VOID and not (attrs.endswith("/") and (tag in ("svg", "math") or places.get("svg") or places.get("math"))):
            push(node)
    if at < len(html):
        stack[-1].children.append(unescape(html[at:]))
    return root, styles


class Hidden:
    """How an element is shown: by kind, attribute, inline style, or a rule of a style element whose selector is one compound of tag, classes and id."""

    def __init__(self, styles: list[str]):
        self.rules: dict[str, list[tuple[str, frozenset[str], str, str]]] = {}
        for css in styles:
            for m in RULE.finditer(PRINT.sub("", COMMENT.sub("", css))):
                says = "none" if NONE.search(m[2]) else unseen[1].lower() if (unseen := UNSEEN.search(m[2])) else ""
                if says:
                    for one in m[1].split(","):
                        if (simple := SIMPLE.fullmatch(one.strip())) and simple[0]:
                            names = re.findall(r"[.#][\w-]+", simple[2])
                            tag = "" if simple[1] in (None, "*") else simple[1].lower()
                            # kept by one name that an element must have
                            self.rules.setdefault(names[0].lower() if names else tag, []).append((tag, frozenset(n.lower() for n in names), says, simple[0]))

    def __call__(self, node: Node) -> str:
        """none: not there; hidden, collapse or visible: what visibility becomes; empty: as around it."""
        if node.tag in NEVER:
            return "none"
        if not node.attrs and not self.rules:
            return "none" if node.tag == "dialog" else ""
        a = node.get() if node.attrs else {}
        if "hidden" in a or node.tag == "dialog" and "open" not in a:
            return "none"
        says = ""
        if self.rules:
            names = {"." + c.lower() for c in a.get("class", "").split()} | ({"#" + a["id"].lower()} if a.get("id") else set())
            for name in (node.tag, "", *sorted(names)):
                for tag, needed, rule, _ in self.rules.get(name, ()):
                    if tag in ("", node.tag) and needed <= names:
                        if rule == "none":
                            return "none"
                        says = rule
        if style := a.get("style"):
            if NONE.search(style):
                return "none"
            if unseen := UNSEEN.search(style):
                says = unseen[1].lower()
        return says


class Lines:
    """Lines in the making; a margin is one empty line between blocks."""

    def __init__(self, level: int = 0) -> None:
        self.level = level
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = False

    def text(self, s: str, pre: bool) -> None:
        if pre:
            head, *rest = s.replace("\r\n", "\n").split("\n")
            self.parts.append(head)
            for line in rest:
                self.flush(True)
                self.parts.append(line)
            return
        s = SPACE.sub(" ", s)
        if s[:1] == " " and (not self.parts or self.parts[-1][-1:] == " "):
            s = s[1:]
        if s:
            self.parts.append(s)

    def flush(self, keep: bool = False) -> None:
        line = "".join(self.parts).rstrip()
        self.parts = []
        if line or keep:
            self.add([line])

    def add(self, lines: list[str]) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines += lines

    def margin(self) -> None:
        self.flush()
        self.gap = True


def _number(text: str, default: int) -> int:
    """The integer that a text begins with, at most 10^9 from 0."""
    m = re.match(r"\s*([+-]?)0*([0-9]+)", text)
    if not m:
        return default
    size = int(m[2]) if len(m[2]) < 10 else 10**9
    return -size if m[1] == "-" else size


def run(step: Generator):
    """Run a generator that yields generators for what it needs, and gets their results; so depth takes no recursion."""
    steps, value = [step], None
    while steps:
        try:
            steps.append(steps[-1].send(value))
            value = None
        except StopIteration as end:
            steps.pop()
            value = end.value
    return value


def svg_texts(node: Node) -> Generator:
    """The text elements of a drawing; other characters in it aren't shown."""
    todo = [node]
    while todo:
        n = todo.pop()
        if n.tag == "text":
            yield n
        elif n.tag not in ("defs", "symbol", "title", "desc", "metadata"):
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]


def render(node: Node, hidden: Hidden, out: Lines, pre: bool = False, seen: bool = True) -> Generator:
    """Put a node's content into lines.  ``seen``: whether visibility lets text show; an element inside may be visible again."""
    flat = out.level >= LEVELS
    for child in node.children:
        if isinstance(child, str):
            if seen:
                out.text(child, pre)
            continue
        tag = child.tag
        if tag == "br":
            out.flush(True)
            continue
        how = hidden(child)
        if how == "none":
            continue
        shown = how == "visible" if how else seen
        if tag == "table" and not flat:
            out.margin()
            out.add((yield table_lines(child, hidden, out.level + 1, shown)))
            out.margin()
        elif tag in ("ul", "ol", "menu", "dir") and not flat:
            nested = node.tag == "li"
            out.flush() if nested else out.margin()
            items = yield list_lines(child, hidden, tag == "ol", out.level + 1, shown)
            if items:
                out.add(items)
            out.flush() if nested else out.margin()
        elif tag == "details" and "open" not in child.get():
            out.flush()
            for x in child.children:
                if isinstance(x, Node) and x.tag == "summary" and hidden(x) != "none":
                    yield render(x, hidden, out, pre, shown)
                    break
            out.flush()
        elif tag == "svg":
            for x in svg_texts(child):
                if hidden(x) != "none":
                    out.text(" ", pre)
                    yield render(x, hidden, out, pre, shown)
                    out.text(" ", pre)
        elif tag == "input":
            a = child.get()
            if shown and a.get("type", "text").lower() in SHOWN and a.get("value"):
                out.text(a["value"], pre)
        elif tag == "textarea":
            if shown:
                out.text("".join(x for x in child.children if isinstance(x, str)), True)
        elif tag == "select":
            options = [x for x in child.children for x in (x.children if isinstance(x, Node) and x.tag == "optgroup" else [x]) if isinstance(x, Node) and x.tag == "option" and hidden(x) != "none"]
            if "multiple" not in child.get():  # one is shown, the last that is selected or else the first
                options = [x for x in options if "selected" in x.get()][-1:] or options[:1]
            for k, x in enumerate(options):
                if k:
                    out.text(" ", pre)
                yield render(x, hidden, out, pre, shown)
        elif tag in BLOCK:
            out.margin() if tag in MARGIN else out.flush()
            if flat and tag == "li" and shown:
                out.text("- ", True)
            if tag in ("blockquote", "dd") and not flat:
                inner = Lines(out.level + 1)
                yield render(child, hidden, inner, pre, shown)
                inner.flush()
                if inner.lines:
                    out.add(["  " + x if x else x for x in inner.lines])
            else:
                yield render(child, hidden, out, pre or tag == "pre", shown)
            out.margin() if tag in MARGIN else out.flush()
        elif tag == "q":
            if shown:
                out.text('"', pre)
            yield render(child, hidden, out, pre, shown)
            if shown:
                out.text('"', pre)
        elif tag not in VOID:
            yield render(child, hidden, out, pre, shown)


def _inner(node: Node, hidden: Hidden, level: int, seen: bool) -> Generator:
    inner = Lines(level)
    yield render(node, hidden, inner, False, seen)
    inner.flush()
    return inner.lines


def list_lines(node: Node, hidden: Hidden, ordered: bool, level: int, seen: bool) -> Generator:
    """A marker before each item, and its other lines indented as far."""
    out, number = [], _number(node.get().get("start", ""), 1) if node.attrs else 1
    loose = Node("li")
    for child in [*node.children, None]:
        if isinstance(child, Node) and child.tag == "li" or child is None:
            if loose.children:
                out += yield _inner(loose, hidden, level, seen)
                loose = Node("li")
            if child is None or (how := hidden(child)) == "none":
                continue
            lines = yield _inner(child, hidden, level, how == "visible" if how else seen)
            mark = f"{number}. " if ordered else "- "
            number += 1
            if lines:
                out += [mark + lines[0], *(" " * len(mark) + x if x else x for x in lines[1:])]
        else:
            loose.children.append(child)
    return out


def table_lines(node: Node, hidden: Hidden, level: int, seen: bool) -> Generator:
    """Rows with cells padded to their columns' widths, two spaces apart; a cell of several lines takes several lines."""
    out: list[str] = []
    rows: list[list[tuple[int, int, list[str]]]] = []
    until: dict[int, int] = {}  # the last row that a cell from above takes of a column

    def walk(n: Node, shown: bool) -> Generator:
        for child in n.children:
            if isinstance(child, str):
                if shown and child.strip():
                    out.append(SPACE.sub(" ", child).strip())
                continue
            if (how := hidden(child)) == "none":
                continue
            inside = how == "visible" if how else shown
            if child.tag in ("tbody", "thead", "tfoot"):
                yield walk(child, inside)
            elif child.tag == "tr":
                row, column, r = [], 0, len(rows)
                for cell in child.children:
                    how = "" if isinstance(cell, str) else hidden(cell)
                    if isinstance(cell, str) and not cell.strip() or how == "none":
                        continue
                    if isinstance(cell, str) or cell.tag not in ("td", "th"):
                        holder = Node("td")
                        holder.children.append(cell)
                        cell = holder
                    while until.get(column, -1) >= r:
                        column += 1
                    a = cell.get() if cell.attrs else {}
                    wide, high = max(1, min(_number(a.get("colspan", ""), 1), WIDEST)), max(1, min(_number(a.get("rowspan", ""), 1), HIGHEST))
                    if high > 1:
                        until.update(dict.fromkeys(range(column, column + wide), r + high - 1))
                    row.append((column, wide, (yield _inner(cell, hidden, level, how == "visible" if how else inside))))
                    column += wide
                rows.append(row)
            else:
                holder = Node("div")
                holder.children.append(child)
                out.extend((yield _inner(holder, hidden, level, shown)))

    yield walk(node, seen)
    width: dict[int, int] = {}
    for row in rows:
        for column, wide, lines in row:
            if wide == 1:
                width[column] = max([width.get(column, 0), *map(len, lines)])
    # a cell over several columns widens the last of them if they are too narrow for it
    for wide, column, lines in sorted(((wide, column, lines) for row in rows for column, wide, lines in row if wide > 1), key=lambda x: x[:2]):
        own = [width[c] + 2 for c in range(column, column + wide) if c in width]
        short = max([0, *map(len, lines)]) - (sum(own) - 2 if own else 0)
        if short > 0:
            last = column + wide - 1
            width[last] = width[last] + short if last in width else max(0, short - 2 * bool(own))
    # where columns start; those without a width take no room
    places, edge = sorted(width), [0]
    for c in places:
        edge.append(edge[-1] + width[c] + 2)
    for row in rows:
        for k in range(max([len(lines) for *_, lines in row], default=0)):
            line = ""
            for column, _, lines in row:
                if k < len(lines) and lines[k]:
                    start = edge[bisect_left(places, column)]
                    line = line.ljust(max(start, len(line.rstrip()) + 2 if line else 0)) + lines[k]
            out.append(line.rstrip())
    return out


def extract(html: str | None) -> str | None:
    """All visible text as laid out; null for null."""
    if html is None:
        return None
    root, styles = parse(html)
    hidden = Hidden(styles)
    if root.attrs.strip():  # attributes of html and body
        root.tag = "body"
        if hidden(root) == "none":
            return ""
    out = Lines()
    run(render(root, hidden, out, False, hidden(root) not in ("hidden", "collapse")))
    out.flush()
    return "\n".join(out.lines).strip("\n")


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, text, n_chars, n_lines.

    Null html gives null text with zero counts, empty html an empty text.
    Broken markup never fails: unclosed, stray and unknown tags follow the tree
    builder's rules.  Very long and deep pages are read whole, repeated rows
    alike.  Visibility follows the hidden attribute, inline styles and rules of
    style elements for one tag, class, id or a compound of them; selectors with
    combinators, linked sheets and scripts aren't followed.  Of controls the
    values shown count, of drawings the text elements.  Other columns aren't
    read, whatever their names.  An empty table gives no rows.
    """

    def make():
        def extract_all(texts):
            done = [extract(t) for t in texts]
            return [pa.array(done, pa.string()), pa.array([len(t or "") for t in done], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in done], pa.int64())]

        return extract_all

    return map_column(pages.select("page_id", F.col("html").cast("string").alias("html")), "html", "text string, n_chars long, n_lines long", make, drop=True)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
