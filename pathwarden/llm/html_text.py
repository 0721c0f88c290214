"""Main text of HTML pages by composite text density.

A page is read into a tree of nodes with the implied ends that browsers
supply.  Nodes that never hold an article (menus, forms, scripts and so on, by tag, role or
class) are left out.  Every other node has a density: characters per tag, raised by
how little of the text is links.  A node's sum is that of its children's densities.
The path from the body to the densest node gives the threshold, its least
density; among the nodes at or above it, the one with the greatest sum is the
article, and all blocks of its subtree are the text.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WS = re.compile(r"[ \t\n\r\f\v\xa0 -     　 \x85]+")
# Fixed values of the HTML standard: void elements, raw-text elements, and starts that close an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol ul li p pre section summary table".split())
BLOCK = CLOSE_P | frozenset("body html td th tr thead tbody tfoot caption colgroup legend option optgroup select".split())
IMPLIED = {"li": ("li", ("ul", "ol", "menu", "dir")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "option": ("option", ("select", "datalist")), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tbody": ("thead tbody tfoot tr td th", ("table",)), "tfoot": ("thead tbody tfoot tr td th", ("table",))}
#: Tags and roles that hold no article text.
OUT_TAGS = frozenset("head nav footer aside form script style noscript iframe template svg math canvas object embed audio video button select textarea input datalist dialog menu noembed noframes xmp".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
#: Words of a class or id, between separators, that tell of notices, adverts, menus and comments.
_OUT_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adbox|adslot|adsbygoogle|banner|breadcrumbs?|byline-share|comments?|commentlist|respond|disqus|cookies?|consent|gdpr|footer|foot|sitefooter|masthead|site-header|header|topbar|menu|nav|navbar|navigation|newsletter|subscribe|subscription|signup|login|notices?|alert|popup|modal|overlay|promo|promoted|sponsor|sponsored|recommend|recommended|recommendations|related|share|sharing|social|sidebar|side|skip|tags|toolbar|widget|widgets|pagination|pager|paywall|rating|reviews?|replies|reply|copyright|disclaimer|hidden)(?:$|[\s_-])",
    re.I,
)
_KEEP_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body)(?:$|[\s_-])", re.I)


class Node:
    __slots__ = ("chars", "children", "density", "depth", "links", "link_tags", "out", "parent", "tag", "tags", "total")

    def __init__(self, tag: str, parent: Node | None, out: bool = False):
        self.tag, self.parent, self.out, self.children = tag, parent, out, []
        self.chars = self.tags = self.links = self.link_tags = 0
        self.density = self.total = 0.0
        self.depth = 0 if parent is None else parent.depth + 1


def _is_out(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag in OUT_TAGS or (tag == "header" and not inside_article):
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "role" and value.lower() in OUT_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id") and tag not in ("body", "html", "article", "main") and _OUT_NAME.search(value) and not _KEEP_NAME.search(value):
            return True
    return False


class _Open:
    """The open elements below the body, by tag, so that no step walks the tree up; each is opened and closed once."""

    def __init__(self, body: Node):
        self.top, self.body, self.blocks = body, body, [body]
        self.by_tag: dict[str, list[Node]] = {}

    def push(self, node: Node) -> None:
        self.top = node
        self.by_tag.setdefault(node.tag, []).append(node)
        if node.tag in BLOCK:
            self.blocks.append(node)

    def close(self, node: Node) -> None:
        """Close ``node`` and all that is open inside it."""
        while self.top.depth >= node.depth:
            self.by_tag[self.top.tag].pop()
            if self.top.tag in BLOCK:
                self.blocks.pop()
            self.top = self.top.parent

    def last(self, *tags: str) -> Node | None:
        """The innermost open element of these tags."""
        found = [stack[-1] for t in tags if (stack := self.by_tag.get(t))]
        return max(found, key=lambda n: n.depth, default=None)

    def holds_block(self, node: Node) -> bool:
        """Whether a block is open inside ``node``."""
        return self.blocks[-1].depth > node.depth

    def imply(self, names, stops) -> None:
        """Close the elements of ``names`` that are open inside the innermost of ``stops``, outermost ends implied too."""
        stop = self.last(*stops)
        while (n := self.last(*names)) is not None and (stop is None or n.depth > stop.depth):
            self.close(n)


def parse(page: str) -> Node:
    """The tree of a page: children are nodes and, for text, strings with references decoded."""
    root = Node("html", None)
    body = Node("body", root)
    root.children.append(body)
    open_, at = _Open(body), 0

    def text(s: str) -> None:
        if s:
            open_.top.children.append(html_lib.unescape(s) if "&" in s else s)

    end = len(page)
    # Behind the last end of a noscript none has to be sought.
    last_end = max((m.start() for m in re.finditer(r"</noscript", page, re.I)), default=-1)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        closing, opening, attrs = m.group(1), m.group(2), m.group(3)
        if closing:
            name = closing.lower()
            if name in ("html", "body"):
                continue
            n = open_.last(name)
            if n is not None:
                # An inline end doesn't close a block that began inside it.
                if name in BLOCK or not open_.holds_block(n):
                    open_.close(n)
            elif name in ("p", "br"):
                open_.top.children.append(Node(name, open_.top))
        elif opening:
            name = opening.lower()
            if name in ("html", "body"):
                continue
            if name == "a" and (n := open_.last("a")) is not None and not open_.holds_block(n):
                open_.close(n)
            if name in CLOSE_P:
                open_.imply(("p",), ("table", "td", "th", "button", "object", "caption"))
            if name in IMPLIED:
                names, stops = IMPLIED[name]
                open_.imply(names.split(), stops)
            inside = name == "header" and open_.last("article", "main") is not None
            node = Node(name, open_.top, _is_out(name, attrs or "", inside))
            open_.top.children.append(node)
            if name in VOID or (attrs or "").rstrip().endswith("/") and name in ("svg", "path", "math"):
                continue
            if name in RAW and (name != "noscript" or at <= last_end):
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                if name != "noscript" or stop:
                    at = stop.end() if stop else end
                    continue
            open_.push(node)
    return root


def _order(root: Node) -> list[Node]:
    """Nodes that count, parents first."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node) and not c.out)
    return out


def measure(root: Node) -> list[Node]:
    """Fill in characters, tags, links, densities and sums; the nodes, parents first."""
    nodes = _order(root)
    for n in reversed(nodes):
        for c in n.children:
            if isinstance(c, str):
                n.chars += len(_WS.sub(" ", c).strip())
            elif not c.out:
                n.chars += c.chars
                n.tags += 1 + c.tags
                n.links += c.links
                n.link_tags += c.link_tags + (c.tag == "a")
        if n.tag == "a":
            n.links = n.chars
    whole = nodes[0]
    share = whole.links / whole.chars if whole.chars else 0.0
    for n in nodes:
        if not n.chars:
            continue
        tags, links, link_tags, plain = n.tags or 1, n.links or 1, n.link_tags or 1, max(1, n.chars - n.links)
        base = math.log(n.chars / plain * n.links + share * n.chars + math.e)
        arg = n.chars / links * tags / link_tags
        n.density = n.chars / tags * math.log(max(arg, 1.0 + 1e-9)) / base
    for n in nodes:
        n.total = sum(c.density for c in n.children if isinstance(c, Node) and not c.out)
    return nodes


def select(root: Node) -> Node:
    """The node that holds the article."""
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    inner = [n for n in nodes if n.tag not in ("html",) and n.chars]
    if not inner:
        return body
    densest = max(inner, key=lambda n: n.density)
    path, n = [], densest
    while n is not None and n is not body:
        path.append(n.density)
        n = n.parent
    least = min([body.density, *path]) if body.density else min(path or [0.0])
    near = [n for n in inner if n.density >= least and n.total > 0]
    best = max(near, key=lambda n: n.total, default=body)
    # Text that stands beside the chosen subtree in the same article or main element belongs to it.
    n = best
    while n is not None:
        if n.tag in ("article", "main"):
            return n
        n = n.parent
    return best if best.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "span", "b", "a") else best.parent


def blocks(node: Node) -> list[str]:
    """The text blocks below a node, with white space inside a block made one space."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        s = _WS.sub(" ", "".join(parts)).strip(" ")
        parts.clear()
        if s:
            out.append(s)

    stack: list = [node]
    while stack:
        n = stack.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            parts.append(n)
        elif not n.out:
            if n.tag in ("br", "hr", "img", "wbr"):
                if n.tag == "hr":
                    flush()
                elif n.tag == "br":
                    parts.append(" ")
                continue
            if n.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(n.children))
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text; empty for null or pages without text."""
    if not page:
        return ""
    return "\n".join(blocks(select(parse(page))))


def op4_html(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row, each page whole, in time that grows with its length and not with its depth.

    A null or empty html, or one without text, gives an empty text.  Rows that repeat a page_id or an html are pages of their own; a null
    page_id or url stays null.  An empty table gives an empty one.  Columns but page_id, url and html don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
