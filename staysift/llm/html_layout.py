"""Visible text of HTML pages, laid out: a tree with implied tags, visibility, blocks, lists, tables."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from staysift.llm.work import texts_of

# Fixed values of the HTML standard: element classes by name.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes textarea title".split())
HEAD = set("base link meta title style script template noscript".split())
UNSEEN = set(
    "head title script style template meta link base area datalist noembed noframes param source track"
    " iframe object audio video canvas embed".split()
)
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre"
    " search section summary table ul xmp caption".split()
)
SPACED = set("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp".split())
CLOSES_P = BLOCK - set("body html li dd dt option optgroup legend summary caption".split()) | {"hr"}
# What a start tag closes, and the elements beyond which it does not look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
SCOPE = {"table", "td", "th", "caption", "html", "template", "button", "object"}
_TAG = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|/[^a-zA-Z][^>]*(?:>|\Z)"
    r"|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_STOP = re.compile(r"[{};]|\"(?:[^\"\\]|\\.)*\"?|'(?:[^'\\]|\\.)*'?", re.S)
_LENGTH = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+))(px|em|rem|in|cm|mm|pt|pc)?$")
_SIDES = re.compile(r"\s*(<=|>=|<|>|=)\s*")
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)$")
DEEPEST = 400
# The screen that pages are read on (px), its other media features, and px per CSS unit.
SCREEN = {"width": 1280.0, "height": 800.0, "device-width": 1280.0, "device-height": 800.0}
FEATURES = {
    "orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine",
    "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "prefers-contrast": "no-preference",
    "scripting": "enabled", "update": "fast", "forced-colors": "none", "display-mode": "browser", "grid": "0",
    "color": "8", "monochrome": "0", "inverted-colors": "none",
}
PIXELS = {"px": 1, "em": 16, "rem": 16, "in": 96, "cm": 96 / 2.54, "mm": 96 / 25.4, "pt": 96 / 72, "pc": 16}


class Node:
    """An element: its tag, attributes and children (nodes and strings)."""

    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def parse(page: str) -> Node:
    """Tree of a page: omitted html, head, body, tbody, tr and end tags are implied."""
    root = Node("html")
    head, body = Node("head"), Node("body")
    root.children = [head, body]
    stack, in_head = [root, head], True

    def to_body():
        nonlocal in_head
        if in_head:
            in_head = False
            stack[:] = [root, body]

    def close(tags, beyond):
        for i in range(len(stack) - 1, 1, -1):
            if stack[i].tag in beyond:
                return
            if stack[i].tag in tags:
                del stack[i:]
                # Go on: a row closes its cell and the row before.
                return close(tags, beyond)

    def text(value):
        if not value:
            return
        if in_head:
            if not value.strip():
                return
            to_body()
        stack[-1].children.append(html.unescape(value))

    at = 0
    lowered = None
    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):  # an end tag
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "head":
                to_body()
            elif tag == "p" and not any(n.tag == "p" for n in stack):
                to_body()
                stack[-1].children.append(Node("p"))
            elif tag not in ("html", "body"):
                for i in range(len(stack) - 1, 1, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in SCOPE and tag not in BLOCK | SCOPE | {"tr", "tbody", "thead", "tfoot"}:
                        break
            continue
        attributes = {}
        for a in _ATTRIBUTE.finditer(m.group(3)):
            value = next((v for v in a.groups()[1:] if v is not None), "")
            attributes.setdefault(a.group(1).lower(), html.unescape(value))
        if tag in ("html", "body", "head"):
            target = {"html": root, "body": body, "head": head}[tag]
            for k, v in attributes.items():
                target.attributes.setdefault(k, v)
            if tag == "body":
                to_body()
            continue
        if in_head and tag not in HEAD:
            to_body()
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", stack[-1].tag):
            stack.pop()
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            tag, cell = "tr", tag
        else:
            cell = None
        if tag == "tr" and stack[-1].tag == "table":
            stack[-1].children.append(Node("tbody"))
            stack.append(stack[-1].children[-1])
        node = Node(tag, {} if cell else attributes)
        stack[-1].children.append(node)
        if cell:
            inner = Node(cell, attributes)
            node.children.append(inner)
            stack += [node, inner]
        elif tag in RAW:
            lowered = lowered or page.lower()
            if len(lowered) != len(page):
                lowered = "".join(c if len(c.lower()) != 1 else c.lower() for c in page)
            end = lowered.find(f"</{tag}", at)
            end = len(page) if end < 0 else end
            raw = page[at:end]
            node.children.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
            close_at = page.find(">", end)
            at = len(page) if close_at < 0 else close_at + 1
        elif tag not in VOID and len(stack) < DEEPEST:
            stack.append(node)  # deeper elements are kept as empty ones; their text goes to the parent
    return root


def declarations(style: str) -> tuple[dict[str, str], dict[str, str]]:
    """Declared values by name: the normal ones and the important ones."""
    normal, important = {}, {}
    for part in style.split(";"):
        name, _, value = part.partition(":")
        value, mark, _ = value.lower().partition("!")
        (important if mark else normal)[name.strip().lower()] = value.strip()
    return normal, important


def _pixels(value: str) -> float | None:
    m = _LENGTH.match(value.strip())
    if not m or not m.group(2) and float(m.group(1)):
        return None
    return float(m.group(1)) * PIXELS[m.group(2) or "px"]


def _feature(test: str) -> bool | None:
    """Whether a media feature (without its parentheses) holds on SCREEN; None if it is unknown."""
    name, colon, value = (x.strip() for x in test.partition(":"))
    if colon:
        low = name.startswith("min-")
        side = SCREEN.get(name[4:] if low or name.startswith("max-") else name)
        if side is not None:
            size = _pixels(value)
            if size is None:
                return None
            return side >= size if low else side <= size if name.startswith("max-") else side == size
        return FEATURES[name] == value if name in FEATURES else None
    parts = _SIDES.split(test.strip())
    if len(parts) in (3, 5):
        sizes = [SCREEN[p] if p in SCREEN else _pixels(p) for p in parts[::2]]
        if None in sizes or not any(p in SCREEN for p in parts[::2]):
            return None
        return all(
            {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "=": a == b}[sign]
            for a, sign, b in zip(sizes, parts[1::2], sizes[1:])
        )
    if name in SCREEN:
        return True
    return FEATURES[name] not in ("0", "none", "no-preference") if name in FEATURES else None


def _terms(text: str) -> list[str]:
    """Words and whole (...) groups of a condition."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text + " "):
        if c.isspace() and not depth:
            if text[at:i].strip():
                out.append(text[at:i].strip())
            at = i
        elif c == "(":
            if not depth and text[at:i].strip():  # "and(": a word ends here
                out.append(text[at:i].strip())
                at = i
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
            if not depth:
                out.append(text[at : i + 1].strip())
                at = i + 1
    return out


def _condition(terms: list[str]) -> bool | None:
    """A media condition of words and groups: all of its terms, any of them, or not the one."""
    if not terms or len(terms) > DEEPEST:
        return None
    if terms[0] == "not":
        inner = _condition(terms[1:])
        return None if inner is None else not inner
    if len(terms) == 1:
        term = terms[0]
        if term in ("screen", "all"):
            return True
        if term in ("print", "speech", "tty", "tv", "projection", "handheld", "braille", "embossed", "aural"):
            return False
        if not (term.startswith("(") and term.endswith(")")):
            return False if re.fullmatch(r"[\w-]+", term) else None
        inner = _terms(term[1:-1])
        nested = inner and (inner[0].startswith("(") or inner[0] == "not")
        return _condition(inner) if nested else _feature(term[1:-1])
    word = terms[1]
    if word not in ("and", "or") or any(t != word for t in terms[1::2]) or len(terms) % 2 == 0:
        # "screen and not (...)"
        if word == "and" and terms[2:3] == ["not"]:
            sides = [_condition(terms[:1]), _condition(terms[2:])]
            return False if False in sides else None if None in sides else True
        return None
    sides = [_condition([t]) for t in terms[::2]]
    sure = word == "or"
    return sure if sure in sides else None if None in sides else not sure


def on_screen(media: str) -> bool:
    """Whether a media query list holds on a wide screen; what is not understood does not hold."""
    if not media.strip():
        return True
    queries, depth, at = [], 0, 0
    media = media.lower()
    for i, c in enumerate(media + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and (depth <= 0 or i == len(media)):
            queries.append(media[at:i])
            at, depth = i + 1, 0
    for query in queries:
        terms = _terms(query)
        if terms[:1] == ["only"]:
            terms = terms[1:]
        negated = terms[:1] == ["not"] and len(terms) > 1 and not terms[1].startswith("(")
        held = _condition(terms[1:] if negated else terms)
        if held is not None and held != negated:
            return True
    return False


def _block(text: str, at: int) -> tuple[str, str, str, int]:
    """The next statement from ``at``: what ends it ("{", ";", "}" or ""), its head, its block, its end."""
    start, depth, opened = at, 0, 0
    for m in _STOP.finditer(text, at):
        c = m.group()
        if c == "{":
            if not depth:
                opened = m.end()
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return "{", text[start : opened - 1].strip(), text[opened : m.start()], m.end()
        elif c in ";}" and not depth:
            return c, text[start : m.start()].strip(), "", m.end()
    if depth:  # an open block ends with the sheet
        return "{", text[start : opened - 1].strip(), text[opened:], len(text)
    return "", text[start:].strip(), "", len(text)


def _holds(head: str) -> bool:
    """Whether the rules inside an at-rule with this head apply on a wide screen."""
    name, rest = re.match(r"@([\w-]*)(.*)", head, re.S).groups()
    if name.lower() == "media":
        return on_screen(rest)
    if name.lower() == "supports":
        return not rest.strip().lower().startswith("not")
    return name.lower() == "layer"


class Styles:
    """Display, visibility and margins by simple selectors (element, class, id), from style elements.

    At-rules count where they hold on a wide screen. Of several rules the more specific one wins,
    then the later one; rules outside layers win over those inside, important ones over all.
    """

    def __init__(self, root: Node):
        self._found, self._layers = [], []
        todo = [root]
        while todo:
            node = todo.pop()
            if node.tag == "style" and on_screen(node.attributes.get("media", "")):
                text = "".join(c for c in node.children if isinstance(c, str))
                text = re.sub(r"/\*.*?(?:\*/|\Z)|<!--|-->", " ", text, flags=re.S)
                self._read(text, None, 0)
            if node.tag != "template":
                todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        self.normal = self._ordered(0)
        self.important = self._ordered(1)

    def _layer(self, name: str) -> str:
        if name not in self._layers:
            self._layers.append(name)
        return name

    def _read(self, text: str, layer: str | None, depth: int) -> None:
        at = 0
        while at < len(text) and depth < DEEPEST:
            end, head, body, at = _block(text, at)
            if head.startswith("@"):
                name = head[6:].strip() if head.lower().startswith("@layer") else None
                if name is not None and end == ";":
                    for n in name.split(","):
                        self._layer(n.strip())
                elif end == "{" and _holds(head):
                    own = layer
                    if name is not None:
                        own = self._layer(name or f"layer {len(self._layers)}")
                    self._read(body, own, depth + 1)
            elif end == "{":
                self._add(head, self._own(body, 0), layer)

    def _own(self, body: str, depth: int) -> str:
        """The declarations of a rule: without nested rules, with those of nested at-rules that hold."""
        if "{" not in body:
            return body
        out, at = [], 0
        while at < len(body) and depth < DEEPEST:
            end, head, inner, at = _block(body, at)
            if end != "{":
                out.append(head)
            elif head.startswith("@") and _holds(head):
                out.append(self._own(inner, depth + 1))
        return ";".join(out)

    def _add(self, selectors: str, body: str, layer: str | None) -> None:
        found = declarations(body)
        for selector in selectors.split(","):
            m = _SIMPLE.match(selector.strip())
            if m and m.group(0):
                marks = re.findall(r"[.#][\w-]+", m.group(2))
                tag = (m.group(1) or "*").lower()
                weight = (sum(x[0] == "#" for x in marks), sum(x[0] == "." for x in marks), tag != "*")
                classes = {x[1:] for x in marks if x[0] == "."}
                self._found.append((layer, weight, tag, classes, {x[1:] for x in marks if x[0] == "#"}, found))

    def _ordered(self, kind: int) -> list[tuple[str, set[str], set[str], dict[str, str]]]:
        """Rules that declare something of a kind, the winning ones last."""

        def rank(rule):
            place = len(self._layers) if rule[0] is None else self._layers.index(rule[0])
            return -place if kind else place, rule[1]

        return [(*r[2:5], r[5][kind]) for r in sorted(self._found, key=rank) if r[5][kind]]

    def of(self, node: Node) -> dict[str, str]:
        classes, ids, out = set(node.attributes.get("class", "").split()), {node.attributes.get("id", "")}, {}
        own = declarations(node.attributes["style"]) if "style" in node.attributes else ({}, {})
        for rules, inline in ((self.normal, own[0]), (self.important, own[1])):
            for tag, needed, named, found in rules:
                if tag in ("*", node.tag) and needed <= classes and named <= ids:
                    out |= found
            out |= inline
        return out


class Writer:
    """Lines of laid-out text; blank lines between blocks never add up."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.space, self.gap = "", False, False

    def put(self, text: str) -> None:
        """Text with white space as in a browser: runs are one blank, none at a line's start."""
        for i, part in enumerate(_SPACE.split(text)):
            if i:
                self.space = True
            if part:
                if self.space and self.line.strip():
                    self.line += " "
                self.line, self.space = self.line + part, False

    def exact(self, text: str) -> None:
        head, *rest = text.split("\n")
        self.line += head
        for part in rest:
            self.end(True)
            self.line = part

    def end(self, always: bool = False) -> None:
        if self.line.strip() or always:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append(self.line.rstrip())
        self.line, self.space = "", False

    def blank(self) -> None:
        self.end()
        self.gap = True

    def text(self) -> str:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def _layout(node: Node, out: Writer, styles: Styles, pre: bool, seen: bool) -> None:
    style, tag = styles.of(node), node.tag
    display = style.get("display", "")
    if display == "none" or (tag in UNSEEN and display != "block"):
        return
    if "hidden" in node.attributes and not display:
        return
    if tag == "dialog" and "open" not in node.attributes:
        return
    if "visibility" in style:
        seen = style["visibility"] not in ("hidden", "collapse")
    if tag in ("br", "wbr"):
        if tag == "br":
            out.end(True)
        return
    pre = pre or tag in ("pre", "textarea", "xmp") or style.get("white-space", "").startswith("pre")
    block = display in ("block", "flex", "grid", "list-item") or (tag in BLOCK and not display.startswith("inline"))
    margin = style.get("margin", style.get("margin-top", ""))
    spaced = block and tag in SPACED and margin not in ("0", "0px")
    if tag in ("ul", "ol", "menu", "dl") and getattr(out, "in_list", 0):
        spaced = False
    if tag == "table" and not display.startswith("inline"):
        out.blank() if spaced else out.end()
        _table(node, out, styles, pre, seen)
        out.blank() if spaced else out.end()
        return
    if block:
        out.blank() if spaced else out.end()
    if tag in ("ul", "ol", "menu"):
        _list(node, out, styles, pre, seen)
    else:
        shut = tag == "details" and "open" not in node.attributes
        for child in node.children:
            if isinstance(child, Node):
                if not shut or child.tag == "summary":
                    _layout(child, out, styles, pre, seen)
            elif seen and not shut:
                out.exact(child.replace("\r\n", "\n")) if pre else out.put(child)
    if block:
        out.blank() if spaced else out.end()


def _inner(node: Node, styles: Styles, pre: bool, seen: bool, in_list: int) -> list[str]:
    """Lines of an element's children on their own."""
    own = Writer()
    own.in_list = in_list
    for child in node.children:
        if isinstance(child, Node):
            _layout(child, own, styles, pre, seen)
        elif seen:
            own.exact(child) if pre else own.put(child)
    text = own.text()
    return text.split("\n") if text else []


def _list(node: Node, out: Writer, styles: Styles, pre: bool, seen: bool) -> None:
    start = node.attributes.get("start", "1").strip()
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in node.children:
        if not isinstance(child, Node) or child.tag != "li":
            if isinstance(child, Node):
                _layout(child, out, styles, pre, seen)
            elif seen:
                out.put(child)
            continue
        style = styles.of(child)
        if style.get("display") == "none" or "hidden" in child.attributes:
            continue
        given = child.attributes.get("value", "").strip()
        number = int(given) if re.fullmatch(r"-?\d{1,9}", given) else number
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += 1
        visible = style["visibility"] not in ("hidden", "collapse") if "visibility" in style else seen
        lines = _inner(child, styles, pre, visible, getattr(out, "in_list", 0) + 1)
        out.end()
        for i, line in enumerate(lines):
            out.line = (mark if i == 0 else " " * len(mark)) + line if line else ""
            out.end(True)


def _table(node: Node, out: Writer, styles: Styles, pre: bool, seen: bool) -> None:
    rows: list[list[tuple[str, int]]] = []

    def collect(part: Node, seen: bool) -> None:
        for child in part.children:
            if not isinstance(child, Node):
                if seen and child.strip():
                    out.put(child)
                continue
            style = styles.of(child)
            if style.get("display") == "none" or "hidden" in child.attributes:
                continue
            shown = style["visibility"] not in ("hidden", "collapse") if "visibility" in style else seen
            if child.tag in ("thead", "tbody", "tfoot"):
                collect(child, shown)
            elif child.tag == "tr":
                row = []
                for cell in child.children:
                    if isinstance(cell, Node) and cell.tag in ("td", "th"):
                        own = styles.of(cell)
                        if own.get("display") == "none" or "hidden" in cell.attributes:
                            continue
                        visible = own["visibility"] not in ("hidden", "collapse") if "visibility" in own else shown
                        text = " ".join(x.strip() for x in _inner(cell, styles, pre, visible, 0) if x.strip())
                        span = cell.attributes.get("colspan", "1")
                        row.append((text, min(1000, int(span)) if re.fullmatch(r"0*[1-9]\d{0,8}", span) else 1))
                    elif isinstance(cell, Node):
                        _layout(cell, out, styles, pre, shown)
                    elif shown and cell.strip():
                        out.put(cell)
                rows.append(row)
            else:
                _layout(child, out, styles, pre, shown)  # a caption, or what does not belong here

    collect(node, seen)
    out.end()
    widths: dict[int, int] = {}
    for row in rows:
        at = 0
        for text, span in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), len(text))
            at += span
    for row in rows:
        at, line = 0, ""
        for text, span in row:
            wide = sum(widths.get(c, 0) for c in range(at, at + span)) + 2 * (span - 1)
            line += text.ljust(wide) + "  "
            at += span
        if line.strip():
            out.line = line.rstrip()
            out.end()


def visible_text(page: str | None) -> str:
    """All visible text of a page, laid out in lines; null and empty pages give an empty text."""
    root = parse((page or "").replace("\0", ""))
    out = Writer()
    _layout(root, out, Styles(root), False, True)
    return out.text().replace("\xa0", " ")


def extract(df: DataFrame, page: str = "html", name: str = "text") -> DataFrame:
    """All rows and columns of ``df``, and ``name``, the visible text of the page.

    Text outside what is hidden (by element, the hidden attribute, style attributes and simple rules
    of style elements) is kept whole. Blocks are lines, paragraphs and the like have a blank line
    between them unless their margin is 0, list items a mark and an indent, table cells aligned
    columns. Broken markup gives some tree, never an error; elements nested deeper than DEEPEST
    lose their layout, not their text. A column called ``name`` is replaced.
    """
    base = df.drop(name) if name != page else df.withColumnRenamed(page, "_page")
    source = page if name != page else "_page"

    def rows(batches):
        for batch in batches:
            texts = [visible_text(p) for p in texts_of(batch.column(source))]
            yield batch.append_column(name, pa.array(texts, pa.string()))

    schema = ", ".join(f"`{n}` {k}" for n, k in base.dtypes)
    return base.mapInArrow(rows, f"{schema}, `{name}` string").select(
        *[F.col(c) for c in base.columns if c != "_page"], name
    )
