"""Operator 5: main text of web pages by composite text density.

A page is parsed into a tree; furniture that names itself (by tag, role, class
or id) is cut off.  Each node that is left gets its composite text density:
characters for each tag, adjusted by how much of both belongs to links; text
that stands in a node itself is a child without tags.  A node's density sum is
that of its children; the node with the greatest sum is the core of the article
(of equal ones the outermost), and the least density on the way from the body
to it is the threshold.  The subtree grows from the core towards the body while
something beside it is as dense as the threshold or is a heading; what is
sparser there is left out, and so are link lists below the threshold, but not
those of an article element.  All steps take time in proportion to the page, however it
nests.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form button select textarea iframe object svg canvas dialog menu audio video map datalist fieldset".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul br".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class or id, and roles, of furniture.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup popup modal overlay sidebar sidebars aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations pagination pager toolbar login search skip copyright legal disclaimer header topbar".split()
)
#: Of these, words that say little of a paragraph or heading of an article.
VAGUE = frozenset("related recommended legal disclaimer search skip copyright header login respond share".split())
#: Words that make a header an article's own.
TITLED = frozenset("entry post article story content page".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: An opening tag on the left closes open tags on the right, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
CONTAINERS = frozenset("html body div article section main aside nav header footer ul ol dl table form blockquote figure details td th fieldset dialog".split())
CLOSE_P = BLOCKS - {"br", "option", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary", "figcaption"}
FORMATTING = frozenset("a b big code em font i s small strong sub sup tt u span".split())
#: What holds text itself, not other parts of a page.
TEXT_TAGS = HEADINGS | FORMATTING | frozenset("p li dt dd blockquote pre q cite figcaption caption".split())


class Node:
    __slots__ = ("tag", "children", "parent", "furniture", "cut", "article", "within", "articles", "titled", "chars", "tags", "link_chars", "link_tags", "density", "density_sum")

    def __init__(self, tag: str, parent: Node | None, furniture: bool = False):
        self.tag, self.parent, self.furniture = tag, parent, furniture
        self.cut = self.article = False
        #: Whether it is a section, or its class speaks of an article.
        self.titled = tag == "section"
        #: Whether an article is around it.
        self.within = parent is not None and (parent.within or parent.article)
        self.children: list[Node | str] = []


def _is_cut(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Furniture whatever it contains."""
    if tag in DROPPED and tag != "form":
        return True
    for name, value in attrs:
        if name == "hidden":
            return True
        if not value:
            continue
        if name == "role" and value.strip().lower() in ROLES or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _words(attrs: list[tuple[str, str | None]]) -> Iterator[set[str]]:
    """The words of each class and id."""
    for name, value in attrs:
        for one in value.split() if value and name in ("class", "id") else ():
            yield set(re.split(r"[_\-:]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one).lower()))


def _is_hinted(attrs: list[tuple[str, str | None]], vague: bool = False) -> bool:
    """vague: words of VAGUE don't count."""
    for words in _words(attrs):
        hints = words & HINTS - VAGUE if vague else words & HINTS
        if hints and not (hints == {"header"} and words & TITLED):  # entry-header has the title
            return True
    return False


class Tree(HTMLParser):
    """The open elements are a stack; for each tag its places there are kept, so nothing is searched for."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.body: Node | None = None

    @property
    def at(self) -> Node:
        return self.open[-1]

    def _push(self, node: Node) -> None:
        place = len(self.open)
        self.open.append(node)
        self.places.setdefault(node.tag, []).append(place)
        if node.tag in BLOCKS:
            self.blocks.append(place)

    def _pop_to(self, place: int) -> None:
        """Close the element at a place and all within it."""
        while len(self.open) > place:
            node = self.open.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCKS:
                self.blocks.pop()

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag == "body":
            if heads := self.places.get("head"):
                self._pop_to(heads[0])
            if self.body is None:
                self.body = self._add("body", [])
                self._push(self.body)
            return
        if self.at.tag == "head" and tag in BLOCKS:
            self._pop_to(len(self.open) - 1)
        if tag in CLOSE_P:
            self._close({"p"})
        if tag in CLOSES:
            self._close(CLOSES[tag])
        if tag in HEADINGS and self.at.tag in HEADINGS:
            self._pop_to(len(self.open) - 1)
        node = self._add(tag, attrs)
        if tag not in VOID:
            self._push(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # in HTML the slash means nothing

    def _add(self, tag, attrs) -> Node:
        node = Node(tag, self.at)
        if tag in ("article", "main"):
            node.article = not _is_hinted(attrs)
        elif tag != "body":
            node.cut = _is_cut(tag, attrs)
            node.titled = node.titled or any(w & (TITLED - {"page"}) for w in _words(attrs))
            node.furniture = node.cut or tag == "form" or tag == "header" and self._is_page_header(attrs, node) or _is_hinted(attrs, node.within and tag in TEXT_TAGS)
        self.at.children.append(node)
        return node

    def _is_page_header(self, attrs, node: Node) -> bool:
        """A header is an article's if it is in one, or if its own class or its parent's says so."""
        return not node.within and not node.parent.titled and not any(w & TITLED for w in _words(attrs))

    def _close(self, tags) -> None:
        """Close the outermost open one of tags within the nearest container."""
        if not any(self.places.get(t) for t in tags):
            return
        container = max((p[-1] for t in CONTAINERS - tags if (p := self.places.get(t))), default=0)
        inner = [p[k] for t in tags if (p := self.places.get(t)) and (k := bisect.bisect_right(p, container)) < len(p)]
        if inner:
            self._pop_to(min(inner))

    def handle_endtag(self, tag):
        places = self.places.get(tag)
        if tag in ("body", "html") or tag in VOID or not places:
            return
        if tag in FORMATTING and self.blocks and self.blocks[-1] > places[-1]:
            return  # its element was closed with its block
        self._pop_to(places[-1])

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    body = tree.body or tree.root
    body.furniture = False
    _keep_wrappers(body)
    return body


def _keep_wrappers(body: Node) -> None:
    """Elements that only hints or their being forms make furniture stay if most of its articles' text, or of the page's where it has none, is in them."""
    nodes, stack = [], [body]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack += [x for x in node.children if isinstance(x, Node) and not x.cut]
    for node in reversed(nodes):
        inner = [x for x in node.children if isinstance(x, Node) and not x.cut]
        node.chars = sum(len("".join(x.split())) for x in node.children if isinstance(x, str)) + sum(x.chars for x in inner)
        node.articles = node.chars if node.article else sum(x.articles for x in inner)
    for node in nodes:
        if node.furniture and (2 * node.articles > body.articles if body.articles else 2 * node.chars > body.chars):
            node.furniture = False


def _order(root: Node) -> list[Node]:
    """Nodes from the root down, furniture left out; without recursion, since pages nest as deep as they like."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [x for x in reversed(node.children) if isinstance(x, Node) and not x.furniture]
    return out


def measure(root: Node) -> list[Node]:
    nodes = _order(root)
    for node in reversed(nodes):
        node.chars = sum(len("".join(x.split())) for x in node.children if isinstance(x, str))
        node.tags = node.link_chars = node.link_tags = 0
        for x in node.children:
            if isinstance(x, Node) and not x.furniture:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.chars if x.tag == "a" else x.link_chars
                node.link_tags += (x.tag == "a") + x.link_tags
    body = nodes[0]
    links_at_large = body.link_chars / max(1, body.chars)
    for node in nodes:
        node.density = composite_density(node.chars, node.tags, node.link_chars, node.link_tags, links_at_large)
    for node in nodes:
        own = sum(len("".join(x.split())) for x in node.children if isinstance(x, str))
        node.density_sum = composite_density(own, 0, 0, 0, links_at_large)
        node.density_sum += sum(x.density for x in node.children if isinstance(x, Node) and not x.furniture)
    return nodes


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, links_at_large: float) -> float:
    """Characters for each tag, times how far both exceed those of links, on a logarithmic scale whose base grows with the links."""
    if not chars:
        return 0.0
    tags = max(1, tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + links_at_large * chars + math.e)
    return chars / tags * math.log(max(1.0, chars / max(1, link_chars) * tags / max(1, link_tags))) / base


def main_node(body: Node) -> tuple[Node, float]:
    """The article's subtree, and the density threshold on the way to its core."""
    nodes = measure(body)
    core = max(nodes, key=lambda n: n.density_sum)
    threshold, node = math.inf, core
    while node is not None:
        threshold = min(threshold, node.density)
        if node is body:
            break
        node = node.parent
    found = core
    while found is not body and found.tag not in ("article", "main"):
        up = found.parent
        beside = [x for x in up.children if isinstance(x, Node) and x is not found and not x.furniture and x.chars]
        if not found.within and beside:
            sparse = [x for x in beside if x.tag not in HEADINGS and x.density < threshold]
            if len(sparse) == len(beside):
                break
            for x in sparse:
                x.furniture = True
        found = up
    return found, threshold


def _is_link_block(node: Node, threshold: float) -> bool:
    """Whether node is mostly links below the threshold; an article's own are part of it."""
    sparse = node.tag in ("ul", "ol", "div", "section", "table") and node.density < threshold and 2 * node.link_chars > node.chars
    return sparse and not node.within


def extract(html: str) -> str:
    """Main text: blocks in page order, joined by newlines; empty if there is none."""
    body = parse(html)
    found, threshold = main_node(body)
    if not found.chars:
        return ""
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        block = " ".join("".join(run).split())
        if block:
            blocks.append(block)
        run.clear()

    stack: list = [found]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(x)
        elif not x.furniture and not (x is not found and _is_link_block(x, threshold)):
            block = x.tag in BLOCKS
            if block:
                close()
                stack.append(None)
            stack += reversed(x.children)
    close()
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages, whatever other columns it has.

    Null and empty html, and pages of furniture only, have an empty text; null
    ids and urls are kept; rows that repeat a page are rows of their own; an
    empty table gives no row.  No shuffle.
    """
    common.short_batches(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in common.nonempty(batches):
            texts = [extract(x) for x in common.strings(batch.column(2))]
            yield common.record(schema, [batch.column(0), batch.column(1), texts, [len(x) for x in texts]])

    return pages.select(F.col(id_column).cast("long").alias("page_id"), F.col("url"), F.col(html_column).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_density(spark, sf_dir: str) -> DataFrame:
    return extract_pages(common.table(spark, sf_dir, "pages"))
