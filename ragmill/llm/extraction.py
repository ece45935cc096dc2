"""Main text of web pages by composite text density.

Every node of a page's tree has a density: its characters per tag, weighed down by the share of link characters
and link tags against those of the whole body. A node's sum is the sum of its children's densities; the node with
the largest sum holds the most text-like children. The least density on the way from it to the body is the
threshold: what lies above it at the top is text, and inside it the subtree of the largest sum is taken. The sum favours
one section over the whole of an article, so the choice grows to the article or main element around it, where
there is one, and takes the neighbours of its kind under the same parent that reach the threshold. On other pages all of the
parent is taken, its own texts, headings and short sections too, but for neighbours below the threshold that are mostly links.

Parts that are no text by their kind (menus, page headers and footers, sidebars, forms, scripts) are left out of the tree
before densities are computed. A name (adverts, notices, comments and the like) only makes a part a suspect: what holds the
page's article, or most of its text, stays whatever it is called, and so does the header of an article that holds its
heading. A name is a whole token of a class or id; tokens that tell how a page is laid out (no-sidebar, has-menu) name nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ragmill.llm.texts import column, slices, text_batches

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "script style noscript template iframe object svg canvas nav header footer aside form button select option textarea "
    "input fieldset dialog menu head title audio video map".split()
)
#: What can stand in a page's head; anything else ends it.
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head html".split())
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address hr hgroup details summary center".split()
)
#: An opening tag ends these open elements, up to the given borders.
CLOSES = {
    "li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "thead": ("tr td th tbody tfoot", "table"),
    "tbody": ("tr td th thead tfoot", "table"), "tfoot": ("tr td th thead tbody", "table"),
}
_UNWANTED_NAMES = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar side footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal "
    "newsletter subscribe subscription signup login share sharing social related recommended pagination pager widget toolbar"
).split()
#: Names of what readers write; it may be longer than the article.
_READERS = frozenset("comment comments commentlist respond reply replies disqus discussion discussions feedback talkback".split())
_UNWANTED = _READERS | frozenset(_UNWANTED_NAMES)
#: Tokens with such a first or last word tell the state or layout of what they stand on.
_STATE_FIRST = frozenset("no not has have with without is side hide hides show shows single open enable enabled disable disabled".split())
_STATE_LAST = frozenset("open closed enabled disabled active inactive on off true false none left right layout page visible hidden top bottom below above".split())
_UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("chars", "children", "link_chars", "link_tags", "name", "parent", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, name: str = ""):
        self.tag, self.parent, self.name = tag, parent, name
        self.children: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0


def unwanted(tag: str, attrs) -> bool:
    """Whether an element is no text by its kind, role or style."""
    if tag in DROPPED:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value and value.lower() in _UNWANTED_ROLES:
            return True
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def name_of(tag: str, attrs) -> str:
    """"readers" or "part" for an element whose class or id names something that is no text of the page, else empty."""
    found = ""
    if tag in ("html", "body", "main"):
        return found
    for name, value in attrs:
        if name in ("class", "id") and value:
            for token in value.split():
                words = [w.lower() for w in _WORD.findall(token)]
                if not words or len(words) > 1 and (words[0] in _STATE_FIRST or words[-1] in _STATE_LAST):
                    continue
                if not _READERS.isdisjoint(words):
                    return "readers"
                if not _UNWANTED.isdisjoint(words):
                    found = "part"
    return found


class Tree(HTMLParser):
    """A page as a tree of nodes and texts, without the unwanted parts. Unclosed and stray tags are forgiven."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)
        self.skipped: list[str] = []  # open elements of an unwanted part
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if self.skipped and self._ends_skipped(tag):
            if self.skipped[0] == "head":
                self._end_head(tag)
            self.skipped.clear()
        if self.skipped:
            if tag not in VOID:
                self.skipped.append(tag)
            return
        if tag in ("html", "body") and any(n.tag == tag for n in self._open()):
            return
        titled = tag == "header" and any(n.tag in ("article", "main") for n in self._open())
        if unwanted(tag, attrs) and not titled:
            if tag in BLOCKS or tag in ("nav", "header", "footer", "aside", "form"):
                self._close_p()
                self.at.children.append("\n")
            if tag not in VOID:
                self.skipped.append(tag)
            return
        if tag in BLOCKS or titled:
            self._close_p()
        if tag in CLOSES:
            ended, border = (x.split() for x in CLOSES[tag])
            self._pop(set(ended), set(border))
        node = Node(tag, self.at, "header" if titled else name_of(tag, attrs))
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        # HTML knows no self-closing tags but the void ones.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
                return
            # The end of an element around the unwanted part ends this too; inline elements do not reach over blocks.
            inline = tag not in BLOCKS and any(t in BLOCKS or t in DROPPED for t in self.skipped)
            if inline or all(n.tag != tag for n in self._open()):
                return
            self.skipped.clear()
        if tag in ("html", "body"):
            return
        for node in self._open():
            if node.tag == tag:
                self.at = node.parent
                return
            if (node.name or node.tag in ("article", "main", "td", "th", "table")) and tag not in BLOCKS:
                return

    def handle_data(self, data):
        if self.skipped == ["head"] and data.strip():
            self._end_head("#text")
            self.skipped.clear()
        if not self.skipped:
            self.at.children.append(data)

    def _ends_skipped(self, tag: str) -> bool:
        """Whether an opening tag ends the unwanted part around it, whose own end tag may be left out."""
        root, inner = self.skipped[0], self.skipped[1:]
        if root == "head":
            return tag == "body" or not inner and tag not in HEAD
        if root == "p":
            return (tag in BLOCKS or tag in ("nav", "header", "footer", "aside", "form")) and DROPPED.isdisjoint(inner)
        ended, border = (x.split() for x in CLOSES.get(tag, ("", "")))
        return (root == tag or root in ended) and tag in CLOSES and set(border).isdisjoint(inner)

    def _end_head(self, tag: str):
        """What follows a head without an end tag stands in the body, whose start tag may be left out."""
        if tag != "body" and all(n.tag != "body" for n in self._open()):
            body = Node("body", self.at)
            self.at.children.append(body)
            self.at = body

    def _open(self):
        node = self.at
        while node.parent is not None:
            yield node
            node = node.parent

    def _close_p(self):
        self._pop({"p"}, {"article", "main", "section", "div", "td", "th", "li", "blockquote"})

    def _pop(self, ended: set[str], border: set[str]):
        """Close the outermost open element of ``ended`` below the nearest border."""
        last = None
        for node in self._open():
            if node.tag in border:
                break
            if node.tag in ended:
                last = node
        if last is not None:
            self.at = last.parent


def _measure(root: Node) -> list[Node]:
    """All nodes, parents first, with their counts of characters and tags."""
    nodes = [root]
    for node in nodes:
        nodes.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(nodes):
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        node.chars += own
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags
    return nodes


def _pruned(root: Node) -> list[Node]:
    """All nodes, measured, without the suspects that are no text of the page."""
    nodes = _measure(root)
    if not any(n.name for n in nodes):
        return nodes
    body = next((n for n in nodes if n.tag == "body"), root)
    marks = [n for n in nodes if n.tag in ("article", "main") and not n.name] or [n for n in nodes if n.tag == "article"]
    held: set[int] = set()
    if marks:
        # Small articles, such as readers' comments, do not make what is around them the page's text.
        node = max(marks, key=lambda n: n.chars - n.link_chars)
        while node is not None:
            held.add(id(node))
            node = node.parent
    gone: set[int] = set()
    for node in nodes:
        if node.parent is not None and id(node.parent) in gone:
            gone.add(id(node))
        elif node.name and id(node) not in held and not _is_text(node, body, nodes):
            gone.add(id(node))
            block = node.tag in BLOCKS or node.tag == "header"
            siblings = node.parent.children
            siblings[next(i for i, c in enumerate(siblings) if c is node)] = "\n" if block else ""
    for node in nodes:
        node.chars = node.link_chars = node.tags = node.link_tags = 0
    return _measure(root)


def _is_text(node: Node, body: Node, nodes: list[Node]) -> bool:
    """Whether a suspect is text all the same: a heading's header, or most of what is around it and not links."""
    around = node.parent
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    if node.name == "header":
        inner = list(node.children)
        heading = False
        while inner and not heading:
            c = inner.pop()
            if isinstance(c, Node):
                heading = c.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
                inner += c.children
        return heading and 2 * node.link_chars < max(node.chars, 1)
    if around is None and any(n.tag in ("article", "main") and not n.name for n in nodes):
        return False
    rest = (around or body).chars - node.chars
    if node.name == "readers" and rest > 0:
        return False
    return node.chars > 2 * rest and 2 * node.link_chars < node.chars


def density(node: Node, body: Node) -> float:
    """Composite text density ``C/T * log_b(C/LC * T/LT)``, ``b = 1 + ln(C/(C-LC) * LC + LCb/Cb * C + e)``.

    Counts of links are one at least. The one added to the base keeps pages without links finite.
    """
    c, t = node.chars, max(node.tags, 1)
    if not c:
        return 0.0
    lc, lt = max(node.link_chars, 1), max(node.link_tags, 1)
    base = 1 + math.log(c / max(c - node.link_chars, 1) * node.link_chars + body.link_chars / max(body.chars, 1) * c + math.e)
    return c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(base)


def _beside(chosen: Node, dense: dict[int, float], threshold: float) -> list[Node | str]:
    """The children of the chosen node's parent without the parts that are mostly links.

    A part is a block, or a run of texts and inline elements: a link inside running text is text.
    """
    parts: list[list[Node | str]] = []
    inline = False
    for c in chosen.parent.children:
        block = isinstance(c, Node) and c.tag in BLOCKS
        if block or not inline:
            parts.append([])
        parts[-1].append(c)
        inline = not block
    kept: list[Node | str] = []
    for part in parts:
        nodes = [c for c in part if isinstance(c, Node)]
        chars = sum(c.chars for c in nodes) + sum(len("".join(c.split())) for c in part if isinstance(c, str))
        if 2 * sum(c.link_chars for c in nodes) < chars or any(c is chosen or dense[id(c)] >= threshold for c in nodes):
            kept += part
    return kept


def _main_nodes(root: Node) -> list[Node | str]:
    nodes = _pruned(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    inside = {id(body)}
    within = [body]
    for node in nodes:
        if node is not body and node.parent is not None and id(node.parent) in inside:
            inside.add(id(node))
            within.append(node)
    dense = {id(n): density(n, body) for n in within}
    sums = {id(n): sum(dense[id(c)] for c in n.children if isinstance(c, Node)) for n in within}
    best = max(within, key=lambda n: sums[id(n)])
    if sums[id(best)] <= 0 or best is body:
        return [body]
    threshold, node = math.inf, best
    while node is not body:
        threshold = min(threshold, dense[id(node)])
        node = node.parent
    chosen = best
    node = best
    while node is not body:
        if node.tag in ("article", "main"):
            chosen = node
        node = node.parent
    if chosen.tag in ("article", "main"):
        siblings = [c for c in chosen.parent.children if isinstance(c, Node)]
        return [c for c in siblings if c is chosen or c.tag == chosen.tag and dense[id(c)] >= threshold]
    # A leaf block is not a page's text: its parent is.
    while chosen.parent is not body and chosen.tag in ("p", "li", "ul", "ol", "table", "tbody", "tr", "td", "blockquote", "b", "i", "em", "strong", "span", "a"):
        chosen = chosen.parent
    return _beside(chosen, dense, threshold)


def blocks_of(nodes: list[Node | str]) -> list[str]:
    """Texts of the blocks in page order, white space as one space, empty ones left out."""
    blocks: list[list[str]] = [[]]
    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        item = stack.pop()
        if item is None or item == "\n" and not isinstance(item, Node):
            blocks.append([]) if item is None else blocks[-1].append("\n")
        elif isinstance(item, str):
            blocks[-1].append(item)
        elif item.tag == "br":
            blocks[-1].append(" ")
        elif item.tag in BLOCKS:
            stack += [None, *reversed(item.children), None]
        else:
            stack += reversed(item.children)
    return [t for t in (" ".join("".join(b).split()) for b in blocks) if t]


def main_text(html: str | None) -> str:
    """The blocks of the main text, joined by line ends; empty for null, empty and textless pages."""
    if not html:
        return ""
    return "\n".join(blocks_of(_main_nodes(Tree(html).root)))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html).

    Repeated rows come out repeated, null and empty pages with an empty text, an empty table as an empty one. A page of any
    length is parsed whole by one task. Other columns are not read, whatever their names are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h) for h in column(part, "html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "page_id"), column(part, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return text_batches(pages).select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
