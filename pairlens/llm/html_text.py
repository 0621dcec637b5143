"""Main text of web pages by composite text density.

Every block element of the document tree has a density: its characters for each tag
in it, lowered the more of them are in links. The densities of a node's children are
summed; the subtree with the largest sum holds the article. The lowest density on the
path from it up to the body is the threshold at which the neighbours of that path
belong to the article as well; inside an article or main element text elements of the
path's neighbours do too. Inline markup makes no nodes. What HTML itself marks as no part
of an article (menus, footers, forms, scripts and so on) is left out beforehand. A block
whose class or id is one of a few whole names is left out only if the text outside it is
what the page consists of. Pages are read by a scanner that looks at no character twice.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

# Element names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("table ul ol dl select article section div body html main aside nav blockquote".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 hgroup header blockquote pre figure ul ol dl table".split())
# Elements, roles and name words that mark what is no part of an article.
LEFT_OUT = frozenset("head nav footer aside button select datalist dialog menu noscript template svg math canvas audio video object embed applet script style textarea title iframe noembed noframes xmp search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset("ad ads advert advertisement banner comments cookie-banner cookie-notice footer menu nav navbar newsletter notice sidebar sponsored".split())

_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
_NAME = re.compile(r"[^\s/>]++")
_QUOTE_OR_END = re.compile(r"""["'>]""")


def _tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """Place of the > that ends a start tag whose name ends at ``at``; -1 if there is none. Quotes count after an equals sign."""
    if at > last[">"]:
        return -1
    seek = at
    while True:
        m = _QUOTE_OR_END.search(html, seek)
        if m is None:
            return html.find(">", at)
        if m[0] == ">":
            return m.start()
        before = m.start() - 1
        while before >= at and html[before].isspace():
            before -= 1
        if before >= at and html[before] == "=":
            if m.end() > last[m[0]]:  # never closed: the tag ends at its first >
                return html.find(">", at)
            seek = html.find(m[0], m.end()) + 1
        else:
            seek = m.end()


def _tokens(html: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, text or name, attributes, place after it) of texts, start and end tags; comments and declarations are skipped.

    A generator that the parser may send a place to go on from.
    """
    at, size = 0, len(html)
    last = {c: html.rfind(c) for c in ">\"'"}
    while at < size:
        open_ = html.find("<", at)
        while 0 <= open_ < size - 1 and not (html[open_ + 1].isalpha() and html[open_ + 1].isascii() or html[open_ + 1] in "!?/"):
            open_ = html.find("<", open_ + 1)
        if open_ < 0 or open_ >= size - 1:
            yield "text", html[at:], "", size
            return
        if open_ > at:
            yield "text", html[at:open_], "", open_
        mark = html[open_ + 1]
        if html.startswith("<!--", open_):
            end = html.find("-->", open_ + 4)
            at = size if end < 0 else end + 3
        elif mark in "!?" or mark == "/" and not (html[open_ + 2 : open_ + 3].isalpha() and html[open_ + 2].isascii()):
            end = -1 if open_ > last[">"] else html.find(">", open_)
            at = size if end < 0 else end + 1
        else:
            name = _NAME.match(html, open_ + 1 + (mark == "/"))
            end = (html.find(">", name.end()) if open_ <= last[">"] else -1) if mark == "/" else _tag_end(html, name.end(), last)
            if end < 0:
                return  # the page ends inside a tag
            at = (yield "end" if mark == "/" else "start", name[0].lower(), html[name.end() : end], end + 1) or end + 1


class Node:
    """An element: its children are nodes and texts (text, whether in a link) in page order.

    ``out``: 2 for what is left out, 1 for what looks like no part of an article.
    """

    __slots__ = ("tag", "parent", "children", "out", "plain", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, out: int):
        self.tag, self.parent, self.out, self.children = tag, parent, out, []
        self.plain = self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _left_out(tag: str, attributes: str, inside: bool) -> int:
    """``Node.out`` of an element; ``inside``: within an article or main element."""
    if tag in LEFT_OUT:
        return 2
    if tag == "header":  # the head of a page; that of an article holds its title
        return 0 if inside else 2
    out = int(tag == "form")
    if attributes and tag not in ("html", "body", "article", "main"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "role" and value in ROLES and value != "form":
                return 2
            if name == "aria-hidden" and value == "true" or name == "role" and value == "form":
                out = 1
            if name in ("class", "id") and tag not in TEXT and tag not in INLINE and not NAMES.isdisjoint(value.split()):
                out = 1
    return out


class _Stack:
    """Open tags: (name, node or None for inline ones), with the places of each name, of blocks and of scopes."""

    def __init__(self):
        self.tags: list[tuple[str, Node | None]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, tag: str, node: Node | None) -> None:
        self.places[tag].append(len(self.tags))
        if node is not None:
            self.blocks.append(len(self.tags))
        self.tags.append((tag, node))

    def pop(self) -> tuple[str, Node | None]:
        tag, node = self.tags.pop()
        self.places[tag].pop()
        if node is not None:
            self.blocks.pop()
        return tag, node

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open tag of these names; -1 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    @property
    def block(self) -> int:
        return self.blocks[-1] if self.blocks else -1


def parse(html: str) -> Node:
    """The tree of block elements of a page. Unclosed and misnested tags close as browsers close them, roughly."""
    root = Node("html", None, 0)
    stack = _Stack()
    node, links, size = root, 0, len(html)

    def close(down_to: int) -> None:
        nonlocal node, links
        while len(stack.tags) > down_to:
            tag, own = stack.pop()
            if own is not None:
                node = own.parent
                node.children.append("\n")
            elif tag == "a":
                links -= 1

    tokens, go_on = _tokens(html), None
    while True:
        try:
            kind, tag, attributes, at = tokens.send(go_on)
        except StopIteration:
            return root
        go_on = None
        if kind == "text":
            node.children.append((tag, links > 0))
        elif kind == "end":
            if tag == "br":
                node.children.append((" ", False))
            k = stack.last([tag])
            # An end without a beginning here: an inline one beyond a block, another one beyond a table, article or body.
            if k >= 0 and not (tag in INLINE and stack.block > k) and (tag in SCOPES or tag == "html" or stack.last(("table", "article", "body")) < k):
                close(k)
        elif tag in VOID:
            node.children.append((" ", False) if tag != "hr" else "\n")
        else:
            if tag in CLOSES_P:
                k = stack.last(["p"])
                if k >= 0 and k == stack.block:
                    close(k)
            elif tag in SIBLINGS:
                while (k := stack.last(SIBLINGS[tag])) >= 0 and k > stack.last(SCOPES - SIBLINGS[tag]):
                    close(k)
            if tag == "a" and links and (k := stack.last(["a"])) > stack.block:  # links do not nest
                close(k)
            out = _left_out(tag, attributes, bool(stack.places.get("article") or stack.places.get("main")))
            if tag in RAW:
                end = _raw_end(html, tag, at)
                if not out:
                    node.children.append((html[at : end[0]], links > 0))
                go_on = end[1]
                if go_on >= size:
                    return root
            elif tag in INLINE and not out:
                links += tag == "a"
                stack.push(tag, None)
                node.tags += tag == "a"
                node.link_tags += tag == "a"
            elif not attributes.rstrip().endswith("/") or tag in CLOSES_P or tag in INLINE:
                fresh = Node(tag, node, out)
                node.children.append("\n" if tag not in INLINE else (" ", False))
                node.children.append(fresh)
                stack.push(tag, fresh)
                node = fresh


@lru_cache(maxsize=32)
def _raw_close(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I)


def _raw_end(html: str, tag: str, at: int) -> tuple[int, int]:
    """Where the text of a raw element ends, and where the page goes on."""
    m = _raw_close(tag).search(html, at)
    return (m.start(), m.end()) if m else (len(html), len(html))


def _settle(root: Node) -> None:
    """Take back in what looks like no part of an article but holds most of the page's text outside links.

    It stays out if an article or main element beside it has a tenth of its text.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and c.out < 2]
    for node in reversed(order):
        node.plain = sum(c.plain if isinstance(c, Node) else len(" ".join(c[0].split())) for c in node.children if not isinstance(c, str) and (c.out < 2 if isinstance(c, Node) else not c[1]))

    def articles(top: Node) -> list[Node]:
        found, todo = [], [top]
        while todo:
            node = todo.pop()
            found += [node] if node.tag in ("article", "main") else []
            todo += [c for c in node.children if isinstance(c, Node) and not c.out]
        return found

    known, todo = articles(root), [root]
    while todo:
        node = todo.pop()
        if node.out:
            if 2 * node.plain <= root.plain:
                continue
            above, at = set(), node
            while at.parent is not None:
                at = at.parent
                above.add(id(at))
            if any(10 * (k.plain - (node.plain if id(k) in above else 0)) >= node.plain for k in known):
                continue
            node.out = 0
            known += articles(node)
        todo += [c for c in node.children if isinstance(c, Node) and c.out < 2]


def _measure(root: Node) -> list[Node]:
    """Counts and densities of all nodes that are not left out, children before parents."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.out:
            order.append(node)
            todo += [c for c in node.children if isinstance(c, Node)]
    order.reverse()
    for node in order:
        for child in node.children:
            if isinstance(child, tuple):
                n = len(" ".join(child[0].split()))
                node.chars += n
                node.link_chars += n if child[1] else 0
            elif isinstance(child, Node) and not child.out:
                node.chars += child.chars
                node.link_chars += child.link_chars
                node.tags += child.tags + 1
                node.link_tags += child.link_tags
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        if c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            adjust = math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0 + 1e-9)) / math.log(max(base, 1.0 + 1e-9)) if lc else 1.0
            node.density = c / t * min(1.0, max(adjust, 0.0))
        node.total = sum(k.density for k in node.children if isinstance(k, Node) and not k.out)
    return order


def _blocks(tops: list[Node]) -> list[str]:
    out, part = [], []

    def close() -> None:
        line = " ".join(unescape("".join(part)).split())
        part.clear()
        if line:
            out.append(line)

    for top in tops:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                if not x.out:
                    todo += reversed(x.children)
            elif isinstance(x, tuple):
                part.append(x[0])
            else:
                close()
        close()
    return out


def main_text(html: str) -> str:
    """The article's text: white space in a block as one blank, blocks joined by line ends; empty if there is none."""
    if not html or not html.strip():
        return ""
    root = parse(html)
    _settle(root)
    order = _measure(root)
    if not root.chars:
        return ""
    # Of equal sums the node nearest to the root is taken: it stands last in the order.
    best = max(enumerate(order), key=lambda x: (x[1].total or (x[1].density if x[1] is root else 0), x[0]))[1]
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    body = next((n for n in path if n.tag == "body"), path[-1])
    top = path.index(body)
    threshold = min(n.density for n in path[: top + 1])
    marked = max((k for k, n in enumerate(path) if n.tag in ("article", "main")), default=-1)
    chosen = best
    for k, (below, above) in enumerate(zip(path, path[1 : top + 1], strict=False)):
        # Neighbours of the path that are as dense, or marked as a part of the article, belong to it.
        before, kept, more = True, [], False
        for near, run in _runs(above):
            if near is below:
                before = False
            elif near is None:
                n = sum(len(x[0].strip()) for x in run)
                if n <= 2 * sum(len(x[0].strip()) for x in run if x[1]):
                    continue
                more = True
            elif not near.out and near.chars:
                near.out = 0 if near.density >= threshold or _belongs(near, before, k < marked) else 2
                more = more or not near.out
            kept += ["\n", *run, "\n"]
        if more:
            above.children, chosen = kept, above
    if chosen is body and best is body:  # no part of the page stands out: containers must be as dense as the whole
        for near in body.children:
            if isinstance(near, Node) and not near.out and near.tag not in TEXT and near.density < threshold and not _belongs(near, False, False):
                near.out = 2
    return "\n".join(_blocks([chosen]))


def _runs(node: Node) -> Iterator[tuple[Node | None, list]]:
    """Children of a node: block elements one by one, and (None, texts with the inline parts between) of what lies between them."""
    run: list = []
    for child in node.children:
        if isinstance(child, tuple):
            run.append(child)
        elif isinstance(child, Node) or run:
            if any(x[0].strip() for x in run):
                yield None, run
            run = []
            if isinstance(child, Node):
                yield child, [child]
    if any(x[0].strip() for x in run):
        yield None, run


def _belongs(node: Node, before: bool, main: bool) -> bool:
    """Whether a neighbour of the article is marked as a part of it: its title, what main has before it, text of main, other articles."""
    if 2 * node.link_chars >= node.chars:
        return False
    if main and (before or node.tag in TEXT):
        return True
    todo, chars, title = [node], 0, False
    while todo:
        k = todo.pop()
        title = title or k.tag == "h1"
        if k.tag == "article":
            chars += k.chars if 2 * k.link_chars < k.chars else 0
        else:
            todo += [c for c in k.children if isinstance(c, Node) and not c.out]
    return before and title or 2 * chars >= node.chars


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null or empty html, and a page without text, gives an empty text. Null ids and
    urls are kept; repeated rows give repeated results; extra columns are ignored;
    an empty table gives no rows. Long pages are read whole. Of equal density sums
    that of the node nearest to the root is taken, of these the last in page order.
    """
    tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
