"""Main text of web pages by composite text density.

For every node of the page's tree: characters, tags, characters inside links and link tags. The composite density of a
node is its characters per tag, damped where links hold much of them; a node's density sum is that of its children. The
subtree with the largest sum, among those whose density reaches the least density on the path from that subtree to the
body, is the article. Subtrees that are never part of an article by their element, or because they are hidden, are cut
before. So are those whose class, id or role names them menus, sidebars, notices, adverts or comments, and forms, but not
where they hold the page's only article, main or h1, or most of the plain text of a page that has no article or main
besides, nor if nothing would be left: then density decides.

Nulls and odd rows: a null or empty page gives an empty text and 0 characters; unclosed and stray tags are repaired as
browsers do for paragraphs, list items and table cells; rows that repeat are extracted each on their own; a null page_id
or url is kept. Further columns are ignored by extract_pages(). An empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Parts of a page: comments, CDATA, declarations, tags with quoted attributes, or a lone "<".
PART = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"']|\"[^\"<]*+\"|'[^'<]*+')*+)>|<", re.S)
#: A tag with "<" in a quoted attribute, which is looked for only where PART finds no tag.
WIDE = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
DEEPEST = 512  # levels; what lies deeper belongs to the element at that level, as in browsers
RAW = {name: re.compile(rf"</{name}\s*>|\Z", re.I) for name in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
ATTRIBUTE = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no article text.
CUT = frozenset("script style template noscript nav footer aside form button select option input textarea dialog menu svg math canvas iframe object audio video map head title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
#: A start tag of the key closes open elements of the value, up to the nearest scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl div article section main body html td th aside nav header footer blockquote form figure".split())
PARAGRAPH_ENDS = frozenset("address article aside blockquote center details div dl dd dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
#: A class, id or role is noise if all its words (between hyphens, underscores or camel case) are, but for NEUTRAL ones.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion popup modal overlay cookie cookies consent gdpr notice alert notification newsletter subscribe subscription signup login paywall nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar side aside widget widgets related recommended recommendations share sharing social comment comments respond reply replies disqus footer masthead toolbar search searchbox skip complementary contentinfo toc tags taglist outbrain taboola hidden".split()
)
NEUTRAL = frozenset("area bar block box container item items list section wrap wrapper".split())
LANDMARKS = frozenset(("article", "main", "h1"))
HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "doubtful", "depth")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False):
        self.tag, self.parent, self.children, self.parts = tag, parent, [], []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.doubtful = False
        self.depth = parent.depth + 1 if parent is not None else 0
        if cut:  # its parent doesn't know it: it is parsed like any other, but no part of the tree
            parent.parts.append(None)
        elif parent is not None:
            parent.children.append(self)
            parent.parts.append(self)


def _noise(tag: str, attributes: str, inside_article: bool) -> str:
    """"cut" for what is never part of an article, "doubtful" for what its name or a form says is none, or ""."""
    if (tag in CUT and tag != "form") or (tag == "header" and not inside_article):
        return "cut"
    verdict = "doubtful" if tag == "form" else ""
    if not attributes or tag in ("html", "body"):
        return verdict
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and HIDING.search(value)):
            if tag not in ("article", "main"):
                return "cut"
        elif name in ("class", "id", "role") and tag not in ("article", "main"):
            for token in value.split():
                words = {w.lower() for w in WORD.findall(token)} - NEUTRAL
                if words and words <= NOISE:
                    verdict = "doubtful"
    return verdict


def _prune(root: Node) -> None:
    """Takes the doubtful subtrees out of the tree, where that is not the page's main part."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(node.children))
    if not any(n.doubtful for n in order):
        return
    plain: dict[Node, int] = {}
    marks: dict[Node, bool] = {}
    for node in reversed(order):
        own = sum(len(SPACE.sub(" ", p).strip()) for p in node.parts if isinstance(p, str))
        plain[node] = 0 if node.tag == "a" else own + sum(plain[c] for c in node.children)
        marks[node] = node.tag in LANDMARKS or any(marks[c] for c in node.children)
    inside: dict[Node, bool] = {root: False}
    for node in order[1:]:
        inside[node] = node.doubtful or inside[node.parent]
    outside = {n.tag for n in order if n.tag in LANDMARKS and not inside[n]}
    kept = {n for n in order if n.doubtful and ((marks[n] and not outside) or (2 * plain[n] > plain[root] and outside <= {"h1"}))}
    left, stack = 0, [root]  # characters outside of what is to go
    while stack:
        node = stack.pop()
        left += sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        stack.extend(c for c in node.children if not c.doubtful or c in kept)
    if not left:
        return
    for node in order:
        if any(c.doubtful and c not in kept for c in node.children):
            node.parts = [None if isinstance(p, Node) and p.doubtful and p not in kept else p for p in node.parts]
            node.children = [c for c in node.children if not c.doubtful or c in kept]


def parse(page: str) -> Node:
    """The tree of the page without what never belongs to an article. A Node's parts are texts, blocks' ends and nodes."""
    root = Node("html", None)
    here, articles = root, 0
    at, end = 0, len(page)
    search, wide = PART.search, True
    while at < end:
        m = search(page, at)
        if m and wide and m[0] == "<":
            wide = WIDE.match(page, m.start())  # one that fails has read to the end: there is no second try
            m = wide or m
        stop = m.start() if m else end
        if stop > at:
            here.parts.append(html.unescape(page[at:stop]) if "&" in page[at:stop] else page[at:stop])
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            if m[0] == "<":
                here.parts.append("<")
            elif m[0].startswith("<![CDATA["):
                here.parts.append(m[0][9:-3])
            continue
        name = name.lower()
        if m[1]:
            if name == "p" and here.tag != "p" and not _open(here, "p"):
                continue
            node = here
            while node is not root and node.tag != name:
                if node.tag in ("article", "main", "body") and name not in ("body", "html", "article", "main", "section", "div"):
                    node = root
                    break
                node = node.parent
            if node is not root:
                while True:
                    articles -= here.tag in ("article", "main")
                    done, here = here is node, here.parent
                    if done:
                        break
            continue
        if name in ("html", "head"):
            continue
        if name in PARAGRAPH_ENDS and _open(here, "p"):
            while here.tag != "p":
                here = here.parent
            here = here.parent
        if name in CLOSES:
            node = here
            while node is not root and node.tag not in CLOSES[name] and node.tag not in SCOPES - CLOSES[name]:
                node = node.parent
            if node.tag in CLOSES[name]:
                here = node.parent
        noise = _noise(name, m[3], articles > 0)
        if name in RAW:
            at = RAW[name].search(page, at).end()
            if noise:
                here.parts.append(None)
            continue
        node = Node(name, here, noise == "cut")
        node.doubtful = noise == "doubtful"
        if name not in VOID and not m[3].endswith("/") and node.depth < DEEPEST:
            here = node
            articles += name in ("article", "main")
    _prune(root)
    return root


def _open(node: Node, tag: str) -> bool:
    while node is not None and node.tag not in SCOPES:
        if node.tag == tag:
            return True
        node = node.parent
    return False


def _measure(root: Node) -> list[Node]:
    """Fills in counts, densities and density sums; returns the nodes, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(node.children))
    for node in reversed(order):
        own = sum(len(SPACE.sub(" ", p).strip()) for p in node.parts if isinstance(p, str))
        node.chars = own + sum(c.chars for c in node.children)
        node.tags = sum(c.tags + 1 for c in node.children)
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        else:
            node.link_chars, node.link_tags = sum(c.link_chars for c in node.children), sum(c.link_tags for c in node.children)
    body = next((n for n in order if n.tag == "body"), root)
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        if not node.chars:
            continue
        tags, plain = max(node.tags, 1), node.chars - node.link_chars
        density = node.chars / tags
        base = math.log(node.chars / max(plain, 1) * node.link_chars + ratio * node.chars + math.e)
        factor = (node.chars / max(node.link_chars, 1)) * (tags / max(node.link_tags, 1))
        node.density = density * max(math.log(max(factor, 1.0 + 1e-9)) / math.log(max(base, 1.0 + 1e-9)), 0.0)
    for node in order:
        node.total = sum(c.density for c in node.children)
    return order


def _choose(order: list[Node]) -> Node:
    """The subtree of the largest density sum among the nodes that reach the threshold of the path to the body."""
    body = next((n for n in order if n.tag == "body"), order[0])
    best = max(order, key=lambda n: n.total)
    threshold, node = best.density, best
    while node is not None and node is not body:
        threshold = min(threshold, node.density)
        node = node.parent
    threshold = min(threshold, body.density)
    best = max((n for n in order if n.density >= threshold and n.chars), key=lambda n: n.total, default=best)
    if not best.total:  # text without any element around its parts
        best = body
    while True:  # a child that holds all the plain text leaves only links behind
        plain = best.chars - best.link_chars
        inner = next((c for c in best.children if plain and c.chars - c.link_chars == plain), None)
        if inner is None or best.tag in ("article", "main") or inner.chars == best.chars:
            break
        best = inner
    node = best  # the enclosing article, if there is one, is the whole of it
    outer = best
    while node is not None:
        if node.tag == "article" or (node.tag == "main" and outer.tag != "article"):
            outer = node
        node = node.parent
    return outer


def _blocks(node: Node) -> list[str]:
    """The texts of the blocks below node, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        else:
            block = x.tag in BLOCK
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(x.parts))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page: its blocks, each with single spaces, joined by a space; empty if there is none."""
    if not page:
        return ""
    order = _measure(parse(page))
    if not order[0].chars:
        return ""
    return " ".join(_blocks(_choose(order)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page: one pass, no shuffle."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
