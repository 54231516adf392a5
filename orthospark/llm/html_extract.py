"""Main-text extraction by composite text density.

For each node of a page's DOM, with C characters, T tags, LC link characters and LT link tags
below it (and LCb, Cb of the body), the link-adjusted density is

    C/T * log(C/LC * T/LT) to the base ln(C/(C-LC) * LC + LCb/Cb * C + e).

The node with the greatest sum of its children's densities is found first. The threshold is the
least density on the path from it to the body, or to the outermost ``article`` or ``main`` on it; every node that reaches it contributes the node
of the greatest density sum below it (an ``article`` reaches it by its own sum), and the selected
subtree is the smallest one that holds all of those. Where the densest node stands in the page's
only ``main``, nodes outside of it don't count. A subtree inside an ``article`` or ``main`` grows to
the whole outermost one, whose title and short blocks lie below the threshold. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are cut by element, role and class name
before densities are taken. A class word doesn't cut an element that holds the ``main`` or a large
``article``, nor (comments aside) most of the page's text where there is no article or the word is
only a part of a name, and a class of a state (``no-sidebar``, ``has-header``) cuts nothing; if class
words would leave no text at all, they are not used. Lists of links go only outside of articles
and where no text or heading precedes them in their parent.

Text: character references decoded, white space inside a block as one space, blocks in page
order joined by one space; nothing is capped. Edge cases: null or text-free html gives an empty
text; unclosed and stray tags, truncated markup and unterminated comments are tolerated; a page
without any density (no tags) gives its plain text; repeated rows give equal results.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, strings, table

#: A quote counts only behind an equals sign and if it is closed before a space or the end of a tag.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')(?=[\s/>]|\Z)|[^>])*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noembed noframes xmp iframe".split())
CUT = frozenset(
    "head script style noscript template iframe object embed svg math canvas audio video map nav header footer aside form "
    "button select option textarea input label fieldset dialog menu title".split()
)
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag on the left closes an open element on the right.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
P_CLOSERS = BLOCK - {"br", "body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"} | {"li", "dd", "dt"}
SCOPE = frozenset("table td th ul ol dl div section article main body html blockquote aside nav".split())
#: Words of a class, id or role that mark what is not the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation sidebar "
    "footer header masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login social share sharing related recommended recommendations comment comments disqus respond reply replies widget "
    "widgets pagination pager toolbar copyright disclaimer complementary contentinfo search skip".split()
)
#: Noise words of reader comments.
TALK = frozenset("comment comments disqus respond reply replies".split())
#: A class that holds one of these words tells a state of the page, not what the element is.
STATE = frozenset("no not non has have with without enabled disabled open opened closed on off collapsed expanded visible".split())
#: Elements whose text is followed by lists that belong to it.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
KEEP = frozenset(("article", "main", "body", "html"))
#: Kinds of noise: by a class word, by one that may be part of a name, by a word of comments, by element or hidden.
NAMED, PARTLY, TALKED, HARD = 1, 2, 3, 4
_E = math.e


class _Node:
    __slots__ = ("tag", "up", "kids", "noise", "own", "size", "links", "holds", "chars", "tags", "lchars", "ltags", "density", "total", "inside", "after", "place", "below")

    def __init__(self, tag: str, up: "_Node | None", noise: int) -> None:
        self.tag, self.up, self.kids, self.noise = tag, up, [], noise
        self.own = self.size = self.links = self.holds = 0
        self.chars = self.tags = self.lchars = self.ltags = 0
        self.density = self.total = 0.0
        self.inside = self.after = False
        self.place = self.below = 0


def _noise(tag: str, attrs: str) -> int:
    """The kind of noise that an element is by itself, or 0."""
    if tag in CUT:
        return HARD
    if not attrs or tag in ("html", "body", "main"):
        return 0
    kind = 0
    for name, a, b, c in _ATTR.findall(attrs):
        name = name.lower()
        if name in ("class", "id", "role"):
            for token in (a or b or c).lower().split():
                words = set(_WORD.findall(token))
                hit = words & NOISE
                if not hit or words & STATE or tag == "article" and not hit & _CARD:
                    continue
                kind = max(kind, TALKED) if hit & TALK else kind if kind in (NAMED, TALKED) else NAMED if hit == words else PARTLY
        elif name == "hidden" or name == "aria-hidden" and (a or b or c).lower() == "true":
            return HARD
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a or b or c, re.I):
            return HARD
    return kind


_CARD = frozenset("comment comments reply ad ads advert sponsored promo related".split())


class _Open:
    """The path of open elements: how many of each tag there are, in all and since the last element of SCOPE."""

    def __init__(self, root: _Node) -> None:
        self.root = self.node = root
        self.every: dict[str, int] = {}
        self.scopes: list[tuple[str, dict[str, int]]] = [("", {})]

    def push(self, node: _Node) -> None:
        self.node, tag = node, node.tag
        self.every[tag] = self.every.get(tag, 0) + 1
        if tag in SCOPE:
            self.scopes.append((tag, {}))
        else:
            inner = self.scopes[-1][1]
            inner[tag] = inner.get(tag, 0) + 1

    def pop(self) -> None:
        tag = self.node.tag
        self.every[tag] -= 1
        if tag in SCOPE:
            self.scopes.pop()
        else:
            self.scopes[-1][1][tag] -= 1
        self.node = self.node.up

    def pop_through(self, tags: frozenset | set) -> None:
        """Close elements up to the nearest of ``tags``, that one too."""
        while self.node.tag not in tags:
            self.pop()
        self.pop()

    def near(self, tags: frozenset | set) -> bool:
        """Is one of ``tags`` open, no other element of SCOPE between?"""
        last, inner = self.scopes[-1]
        return last in tags or any(inner.get(t) for t in tags)


_P = frozenset("p")


def parse(page: str) -> _Node:
    """A tolerant DOM: children are nodes or strings (decoded text). Every element is opened and closed once."""
    root = _Node("html", None, 0)
    path, at, n = _Open(root), 0, len(page)
    add_text = lambda s: path.node.kids.append(_html.unescape(s) if "&" in s else s)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add_text(page[at:])
            break
        if m.start() > at:
            add_text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                path.node.kids.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if path.every.get(tag) if tag in SCOPE else path.scopes[-1][1].get(tag):
                path.pop_through({tag})
            elif tag == "p":
                path.node.kids.append(_Node("p", path.node, 0))
            continue
        if tag == "html":
            continue
        closes = CLOSES.get(tag)
        if closes and path.near(closes):
            path.pop_through(closes)
            while path.node is not root and path.node.tag in closes:
                path.pop()
        if tag in P_CLOSERS and path.near(_P):
            path.pop_through(_P)
        new = _Node(tag, path.node, _noise(tag, m[3]))
        path.node.kids.append(new)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            new.kids.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            path.push(new)
    return root


def _order(root: _Node, least: int = NAMED) -> list[_Node]:
    """All nodes that are not cut (as noise of kind ``least`` or above), parents first."""
    out, i = [root], 0
    while i < len(out):
        out += [k for k in out[i].kids if type(k) is _Node and k.noise < least]
        i += 1
    return out


def _spare(root: _Node) -> None:
    """Take back noise by class where it holds the article or most of the page's text."""
    nodes = _order(root, HARD)
    for x in reversed(nodes):
        for k in x.kids:
            if type(k) is str:
                x.own += len("".join(k.split()))
            elif k.noise < TALKED:
                x.size += k.size
                x.links += k.links
        x.size += x.own
        if x.tag == "a":
            x.links = x.size
    if not any(x.noise for x in nodes):
        return
    hearts = [x for x in nodes if x.tag in ("article", "main") and not x.noise and x.size]
    most = max((x.size for x in hearts), default=0)
    hearts = [x for x in hearts if 2 * x.size >= most]
    for h in hearts:
        h.holds = 1
    for x in reversed(nodes):
        x.holds += sum(k.holds for k in x.kids if type(k) is _Node and k.noise < HARD)
    for x in nodes:
        if not x.noise:
            continue
        if x.noise == TALKED:
            spared = 0 < len(hearts) == x.holds
        else:
            large = 2 * x.size > root.size and 2 * x.links <= x.size
            spared = x.holds or large and (x.noise == PARTLY or not hearts)
        if spared:
            x.noise = 0
    if not any(x.own for x in _order(root)):  # nothing is left
        for x in nodes:
            x.noise = 0


def _measure(nodes: list[_Node], body: _Node) -> None:
    for x in reversed(nodes):
        for k in x.kids:
            if type(k) is _Node and not k.noise:
                x.chars += k.chars
                x.tags += k.tags + 1
                x.lchars += k.lchars
                x.ltags += k.ltags + (k.tag == "a")
        x.chars += x.own
        if x.tag == "a":
            x.lchars, x.ltags = x.chars, x.tags
    share = body.lchars / body.chars if body.chars else 0.0
    for x in nodes:
        if not x.chars:
            continue
        t, lc, lt = x.tags or 1, x.lchars or 1, x.ltags or 1
        base = math.log(x.chars / max(1, x.chars - x.lchars) * x.lchars + share * x.chars + _E)
        inner = max(x.chars / lc * t / lt, 1.0)
        x.density = x.chars / t * math.log(inner) / math.log(max(base, 1.0 + 1e-9)) if base > 1.0 else x.chars / t * math.log(inner) / 1e-9
    for x in nodes:
        x.total = sum(k.density for k in x.kids if type(k) is _Node and not k.noise)
        x.inside = x.tag == "article" or x.up is not None and x.up.inside
        after = False
        for k in x.kids:
            if type(k) is _Node and not k.noise:
                k.after = after
                after = after or k.tag in FLOW and k.chars > 2 * k.lchars
    # places in page order: a node's subtree is place .. below
    for x in reversed(nodes):
        x.below = sum(k.below + 1 for k in x.kids if type(k) is _Node and not k.noise)
    for x in nodes:
        at = x.place + 1
        for k in x.kids:
            if type(k) is _Node and not k.noise:
                k.place = at
                at += k.below + 1
        x.below += x.place


def _path(x: _Node) -> list[_Node]:
    out = [x]
    while x.up is not None:
        x = x.up
        out.append(x)
    return out


def select(root: _Node) -> _Node:
    """The subtree that holds the main text."""
    _spare(root)
    nodes = _order(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    if 2 * body.size < root.size:  # a stray body
        body = root
    _measure(nodes, body)
    best = max((x for x in nodes if body.place <= x.place <= body.below), key=lambda x: x.total)
    if best.total <= 0:
        return body
    path = _path(best)
    mains = [x for x in nodes if x.tag == "main"]
    limit = mains[0] if len(mains) == 1 and mains[0] in path else body
    end = next((x for x in reversed(path) if x.tag in ("article", "main")), body)
    inside = path[: path.index(end) + 1] if end in path else path
    threshold = min(x.density for x in inside)
    top: dict[int, _Node] = {}  # node -> the node of the greatest sum below or at it
    for x in reversed(nodes):
        t = x
        for k in x.kids:
            if type(k) is _Node and not k.noise and top[id(k)].total > t.total:
                t = top[id(k)]
        top[id(x)] = t
    low = high = best.place
    for x in nodes if limit is body else _order(limit):
        reached = x.total if x.tag == "article" else x.density
        if reached >= threshold and x.tag in BLOCK and x is not body and x is not root and x.chars > 2 * x.lchars:
            y = top[id(x)] if top[id(x)].total > 0 else x
            low, high = min(low, y.place), max(high, y.place)
    found = best
    while not found.place <= low <= high <= found.below:
        found = found.up
    return next((x for x in reversed(_path(found)) if x.tag in ("article", "main")), found)


def _linked(x: _Node) -> bool:
    """A list of links, as menus without a telling name are; not in an article or after text of its own parent."""
    if x.tag not in ("ul", "ol", "div", "section", "dl", "table") or x.ltags < 3 or 2 * x.lchars <= x.chars:
        return False
    return not (x.holds or x.inside or x.after)


def collect(x: _Node) -> str:
    """Text of a subtree: blocks in page order, white space as one space."""
    parts: list[str] = []
    stack: list = [x]
    while stack:
        k = stack.pop()
        if type(k) is str:
            parts.append(k)
        elif k.tag == "\n":
            parts.append(" ")
        elif not (k.noise or (k is not x and _linked(k))):
            block = k.tag in BLOCK
            if block:
                parts.append(" ")
                stack.append(_BREAK)
            stack.extend(reversed(k.kids))
    return " ".join("".join(parts).split())


_BREAK = _Node("\n", None, 0)


def main_text(page: str | None) -> str:
    """The main text of one html page."""
    return collect(select(parse(page))) if page else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")
    )
    kinds = dict(rows.dtypes)

    def run(batches):
        release()
        for batch in batches:
            text = [main_text(h) for h in strings(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the main text of all pages."""
    return extract_pages(table(spark, sf_dir, "pages"))
