"""Main text of web pages by minimum-cut labelling of blocks.

A page is cut into blocks of text.  A logistic classifier gives each block a
probability of being content, hence the cost of either label; the costs are the
capacities to the two terminals.  Edges between blocks that follow one another, and
between blocks that are close in the DOM, cost something when cut.  The minimum cut
is the cheapest labelling: blocks that remain on the source's side are the text.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from math import exp, log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import columns_of, written

# Fixed sets of element names.
RAW = {"script", "style", "template", "iframe", "object", "canvas", "audio", "video", "head", "title", "textarea", "select", "datalist", "button", "map", "xmp", "noembed", "noframes"}
#: Elements of RAW whose content is text up to their own end tag, whatever it looks like.
VERBATIM = {"script", "style", "xmp", "textarea", "title", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "noscript", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr",), "tbody": ("thead", "tr"), "tfoot": ("tbody", "tr")}
#: Elements that an implied end does not pass.
SCOPE = {"ul", "ol", "dl", "table", "menu", "article", "aside", "section", "main", "nav", "form", "body", "html"}
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "search", "fieldset"}
MAIN = {"article", "main"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Fixed words in class, id and role values: of boilerplate wherever it stands, of boilerplate outside an article
# only, of content, of layout, and words that tell nothing beside another.
BAD_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "respond", "share", "sharing", "sidebar", "signup", "skip", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets"}
WEAK_WORDS = {"alert", "bar", "dialog", "discussion", "foot", "form", "meta", "reactions", "replies", "reply", "search", "social", "tags"}
GOOD_WORDS = {"article", "body", "content", "entry", "main", "post", "story", "text"}
LAYOUT_WORDS = {"has", "with", "without", "no", "layout", "col", "cols", "columns"}
PLAIN_WORDS = {"area", "block", "bottom", "box", "button", "buttons", "btn", "container", "form", "group", "head", "icon", "icons", "id", "inner", "item", "items", "label", "left", "line", "link", "links", "list", "message", "outer", "page", "panel", "posts", "right", "row", "section", "site", "slot", "title", "top", "unit", "wrap", "wrapper"}

#: Features and their prior weights; training moves them as far as labelled blocks outweigh the prior.
FEATURES = ("bias", "length", "links", "sentences", "main", "chrome", "page_header", "bad_word", "weak_word", "weak_outside", "good_word", "heading", "item")
PRIOR = np.array([-2.0, 0.55, -3.5, 1.0, 4.0, -12.0, -9.0, -12.0, -2.0, -8.0, 2.0, 1.0, -0.5])
PRIOR_STRENGTH = 500.0
#: Pages that the classifier is fitted on, and blocks of them, at most.
SAMPLE_PAGES, SAMPLE_BLOCKS = 300, 20_000
#: Words from which on a block that no other sampled page has is taken as content.
LABEL_WORDS = 10
#: Capacities between neighbours: in page order, between siblings, and in page order across the border of marked regions.
ORDER_EDGE, DOM_EDGE, BORDER_EDGE = 0.35, 1.6, 0.1

#: A comment; a declaration or an end tag without a name; a tag.  A quote only opens a value after an equals sign,
#: and only if one closes it, so a tag with an unbalanced quote ends at its next >.  Nothing is tried twice.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^">]*+"|'[^'>]*+'|"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>]))?+)*+)(?:>|\Z)""",
    re.S,
)
_ATTRS = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ENDS = re.compile(r"[.!?…:;,](?:\s|$)")
_HUGE_REFERENCE = re.compile(r"&#[0-9]{8,}+;?")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I) for tag in VERBATIM}


class _Node:
    """An open element: its tag, its number, and what it tells of the blocks within."""

    __slots__ = ("tag", "no", "parent", "depth", "flags")

    def __init__(self, tag: str, no: int, parent: _Node | None, flags: int):
        self.tag, self.no, self.parent = tag, no, parent
        self.depth = parent.depth + 1 if parent else 0
        self.flags = flags


_MAIN, _CHROME, _HEADER, _BAD, _WEAK, _GOOD, _ITEM, _HIDDEN, _HEADING = (1 << i for i in range(9))


def _class_flags(value: str, above: int) -> int:
    """What the words of a class, id or role tell.

    A word of boilerplate beside one that is not known ("cookie-recipes") is a weak
    sign within an article; an article's own header may hold its title.
    """
    flags = 0
    for one in value.split():
        words = set(_WORDS.findall(_CAMEL.sub(" ", one).lower()))
        if words & LAYOUT_WORDS:
            continue
        good = bool(words & GOOD_WORDS)
        bad = words & BAD_WORDS - ({"header"} if good else set())
        known = words <= BAD_WORDS | WEAK_WORDS | GOOD_WORDS | PLAIN_WORDS
        if bad and (known or not above & _MAIN):
            flags |= _BAD
        elif bad or words & WEAK_WORDS:
            flags |= _WEAK
        elif good:
            flags |= _GOOD
    return flags


def _flags(tag: str, attrs: str, above: int) -> int:
    flags = above & ~_HEADING
    if tag in MAIN:
        flags |= _MAIN
    if tag in CHROME:
        flags |= _CHROME
    if tag == "header" and not above & _MAIN:
        flags |= _HEADER
    if tag == "li":
        flags |= _ITEM
    if tag == "noscript":
        flags |= _WEAK
    if tag in HEADING:
        flags |= _HEADING
    if attrs and tag not in ("html", "body"):
        for name, a, b, c in _ATTRS.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _UNSEEN.search(value):
                flags |= _HIDDEN
            elif name in ("class", "id", "role"):
                flags |= _class_flags(value, above)
    return flags


class _Open:
    """The open elements, with counts by tag, as a whole and since the last element of SCOPE, so that no search runs in vain."""

    def __init__(self) -> None:
        self.root = self.node = _Node("", 0, None, 0)
        self.counts: Counter[str] = Counter()
        self.scopes: list[Counter[str]] = [Counter()]
        self.number = 0

    def push(self, tag: str, attrs: str) -> None:
        self.number += 1
        self.node = _Node(tag, self.number, self.node, _flags(tag, attrs, self.node.flags))
        self.counts[tag] += 1
        if tag in SCOPE:
            self.scopes.append(Counter())
        else:
            self.scopes[-1][tag] += 1

    def pop(self) -> str:
        tag = self.node.tag
        self.node = self.node.parent
        self.counts[tag] -= 1
        if tag in SCOPE:
            self.scopes.pop()
        else:
            self.scopes[-1][tag] -= 1
        return tag

    def end(self, tag: str) -> None:
        """An end tag closes its element and all within it; without such an element it is ignored."""
        if self.counts[tag] > 0:
            while self.pop() != tag:
                pass

    def start(self, tag: str, attrs: str) -> None:
        """A block ends an open paragraph, and elements of its own kind up to the next SCOPE."""
        while self.node.tag == "p":
            self.pop()
        for ended in CLOSED_BY.get(tag, ()):
            if self.scopes[-1][ended] > 0:
                while self.pop() != ended:
                    pass
        self.push(tag, attrs)


def _decoded(text: str) -> str:
    """Character references decoded, white space as single spaces."""
    if "&" in text:
        text = html.unescape(_HUGE_REFERENCE.sub("\ufffd", text))
    return " ".join(text.split())


def blocks(page: str | None) -> list[tuple[str, _Node, int]]:
    """(text, element, characters in links) of every block of a page, in order.

    Markup that is not text (scripts, styles, comments, controls) is left out;
    character references are decoded; white space becomes single spaces.  The time
    taken grows with the length of the page, whatever its markup is like.
    """
    page = page or ""
    out: list[tuple[str, _Node, int]] = []
    tree = _Open()
    pos, links, in_link = 0, 0, 0
    text: list[str] = []
    missing: set[str] = set()  # verbatim elements that have no end tag from here on

    def flush() -> None:
        nonlocal links
        if text:
            own = _decoded("".join(text))
            if own:
                out.append((own, tree.node, min(links, len(own))))
            text.clear()
        links = 0

    def verbatim(tag: str, at: int) -> int:
        """Where an element's verbatim content ends; without an end tag a title has none, and the others go on to the end of the page."""
        end = None if tag in missing else _RAW_END[tag].search(page, at)
        if end:
            return end.end()
        missing.add(tag)
        return at if tag == "title" else len(page)

    skip = None  # a raw element that is being passed over
    inner: list[str] = []  # blocks open within it
    inside: Counter[str] = Counter()
    for m in _TOKEN.finditer(page):
        start, name = m.start(), m.group(2)
        if start < pos:
            continue  # within verbatim content
        if skip:
            if not name:
                continue
            tag = name.lower()
            if m.group(1):
                if tag == skip:
                    skip, pos = None, m.end()
                    continue
                if inside[tag] > 0:
                    while True:
                        last = inner.pop()
                        inside[last] -= 1
                        if last == tag:
                            break
                    continue
                if tree.counts[tag] <= 0:
                    continue
                skip = None  # the end of a block around it: its own end was left out
            elif tag in MAIN or tag == "body" or skip == "head" and tag in ("nav", "header", "div", "p"):
                skip = None
            else:
                if tag in ("script", "style"):
                    pos = verbatim(tag, m.end())
                elif tag in BLOCK and tag != "hr":
                    inner.append(tag)
                    inside[tag] += 1
                continue
            pos = start
        if start > pos:
            chunk = page[pos:start]
            text.append(chunk)
            if in_link:
                links += len(chunk.strip())
        pos = m.end()
        if not name:
            continue
        tag = name.lower()
        if m.group(1):
            if tag == "a":
                in_link = 0
            if tag in BLOCK:
                flush()
                tree.end(tag)
            elif tag == "br":
                text.append(" ")
        elif tag in RAW:
            if tag in VERBATIM:
                pos = verbatim(tag, pos)
            elif not m.group(3).endswith("/"):
                skip = tag
                inner.clear()
                inside.clear()
        elif tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
        else:
            if tag == "a":
                in_link = 1
            if tag in BLOCK:
                flush()
                tree.start(tag, m.group(3))
    if pos < len(page) and not skip:
        text.append(page[pos:])
    flush()
    return out


def features(block: tuple[str, _Node, int]) -> list[float]:
    """The features of one block, in the order of FEATURES."""
    text, node, links = block
    f = node.flags
    has = lambda bit: 1.0 if f & bit else 0.0
    weak = has(_WEAK)
    return [1.0, log1p(len(text)), links / len(text), min(3, len(_ENDS.findall(text))) / 3, has(_MAIN), has(_CHROME | _HIDDEN), has(_HEADER), has(_BAD), weak, weak * (1.0 - has(_MAIN)), has(_GOOD), has(_HEADING), has(_ITEM)]


def fit(rows: np.ndarray, labels: np.ndarray, steps: int = 12) -> np.ndarray:
    """Logistic weights by Newton's method, with a normal prior around PRIOR; without rows they are PRIOR."""
    w = PRIOR.copy()
    for _ in range(steps if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        grad = rows.T @ (p - labels) + PRIOR_STRENGTH * (w - PRIOR)
        hess = (rows * (p * (1 - p))[:, None]).T @ rows + PRIOR_STRENGTH * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return w


_SAMPLED = "no int, text_hash long, words int, longest long, x array<double>"


def labelled_blocks(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """(page_id, no, x, label) of labelled blocks of at most ``sample`` pages, those with the least hash of their id.

    Labels come from what no feature shows, the other pages: a block whose text is
    on sampled pages of several articles is boilerplate, one of LABEL_WORDS or more
    that is on one article's pages only is content; short ones that do not repeat
    have no label.  Pages with the same longest block count as the same article, so
    copies of a page make no boilerplate of its text.
    """
    import xxhash

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("no", T.IntegerType()), T.StructField("text_hash", T.LongType()), T.StructField("words", T.IntegerType()), T.StructField("longest", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])))
    def sampled(batch: pd.Series) -> pd.Series:
        out = []
        for page in batch:
            found = blocks(page)
            hashes = [xxhash.xxh64_intdigest(b[0]) - (1 << 63) for b in found]
            longest = hashes[max(range(len(found)), key=lambda i: len(found[i][0]))] if found else 0
            out.append([{"no": i, "text_hash": h, "words": b[0].count(" ") + 1, "longest": longest, "x": features(b)} for i, (b, h) in enumerate(zip(found, hashes))])
        return pd.Series(out)

    # Ids first, so that tasks send the driver a few bytes a row.
    ids = [r[0] for r in pages.where("page_id IS NOT NULL").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()]
    picked = pages.where(F.col("page_id").isin(ids)).select("page_id", "html").dropDuplicates(["page_id"])
    rows = written(picked.select("page_id", F.inline(sampled("html"))), "page-blocks")
    seen = rows.groupBy("text_hash").agg(F.countDistinct("longest").alias("articles"))
    known = rows.join(seen, "text_hash").where(f"articles > 1 OR words >= {LABEL_WORDS}")
    return known.select("page_id", "no", "x", F.when(F.col("articles") > 1, 0.0).otherwise(1.0).alias("label"))


def train(pages: DataFrame, sample: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights fitted on SAMPLE_BLOCKS labelled blocks at most, those with the least hash."""
    known = labelled_blocks(pages, sample).orderBy(F.xxhash64("page_id", "no"), "page_id", "no").limit(SAMPLE_BLOCKS).select("x", "label").collect()
    return fit(np.array([r[0] for r in known]).reshape(-1, len(FEATURES)), np.array([r[1] for r in known]))


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut.

    source[i] is lost if i ends on the sink's side, sink[i] if on the source's, and
    an edge's capacity if its ends part.  Flow goes along shortest paths in layers.
    """
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        least = min(source[i], sink[i])  # flows straight through
        if source[i] > least:
            link(s, i, source[i] - least, 0.0)
        elif sink[i] > least:
            link(i, t, sink[i] - least, 0.0)
    for a, b, c in edges:
        link(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                b = to[e]
                if level[b] < 0 and cap[e] > tiny:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                del path[k:]
                a = to[path[-1]] if path else s
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(out[a][at[a]])
                a = to[path[-1]]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                at[a] += 1
            else:
                break


def _distance(a: _Node, b: _Node) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def _region(node: _Node) -> int:
    """What marks a block's surroundings; labels are smooth within a region, and less so across its border."""
    return node.flags & (_CHROME | _HEADER | _BAD | _HIDDEN)


def neighbours(found: list[tuple[str, _Node, int]]) -> list[tuple[int, int, float]]:
    """The smoothness edges (i, j, capacity) of a page's blocks: of blocks in order, by their distance in the tree, and of siblings."""
    edges, last = [], {}
    for i, (_, node, _) in enumerate(found):
        if i:
            before = found[i - 1][1]
            edges.append((i - 1, i, (ORDER_EDGE if _region(before) == _region(node) else BORDER_EDGE) / max(1, _distance(before, node))))
        near = ((node.parent or node).no, _region(node))
        if near in last:
            edges.append((last[near], i, DOM_EDGE))
        last[near] = i
    return edges


def reduced_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """min_cut on what is open: a minimum cut of the whole, found piece by piece.

    A node whose terminals differ by more than all its edges together goes to the
    dearer side in every minimum cut; its edges then weigh on its neighbours.  What
    remains falls into connected pieces, and one that leans to the same side
    throughout is cut from the other without any flow.
    """
    n = len(source)
    lean = [a - b for a, b in zip(source, sink)]
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, c in edges:
        near[a].append((b, c))
        near[b].append((a, c))
    open_sum = [sum(c for _, c in edges_of) for edges_of in near]
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(lean[i]) > open_sum[i]:
            side[i] = lean[i] > 0
            for j, c in near[i]:
                if side[j] is None:
                    open_sum[j] -= c
                    lean[j] += c if side[i] else -c
                    queue.append(j)
    for i in range(n):
        if side[i] is not None:
            continue
        piece, stack, seen = [], [i], {i}
        while stack:
            a = stack.pop()
            piece.append(a)
            for j, _ in near[a]:
                if side[j] is None and j not in seen:
                    seen.add(j)
                    stack.append(j)
        if all(lean[a] > 0 for a in piece) or all(lean[a] <= 0 for a in piece):
            for a in piece:
                side[a] = lean[a] > 0
            continue
        at = {a: k for k, a in enumerate(piece)}
        own = [(at[a], at[b], c) for a in piece for b, c in near[a] if a < b and b in at]
        cut = min_cut([max(0.0, lean[a]) for a in piece], [max(0.0, -lean[a]) for a in piece], own)
        for a, s in zip(piece, cut):
            side[a] = s
    return [bool(s) for s in side]


def label(found: list[tuple[str, _Node, int]], weights: np.ndarray) -> list[bool]:
    """Whether each block is content."""
    if not found:
        return []
    scores = np.clip(np.array([features(b) for b in found]) @ weights, -30, 30).tolist()
    source = [log(1 + exp(z)) for z in scores]  # lost if a content-like block goes
    sink = [log(1 + exp(-z)) for z in scores]  # lost if a boilerplate-like block stays
    return reduced_cut(source, sink, neighbours(found))


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    """The content blocks of a page, joined by blank lines."""
    found = blocks(page)
    return "\n\n".join(b[0] for b, stays in zip(found, label(found, weights)) if stays)


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    A null or empty page, and one without content, has an empty text.  Whole pages
    are read, whatever their length; repeated rows stay, and so do rows that share
    an id, each with its own text; an empty table gives an empty result.
    """
    pages = columns_of(pages, ["page_id", "url", "html"])
    own = train(pages) if weights is None else weights

    @F.pandas_udf(T.StringType())
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, own) for p in batch], dtype="object")

    rows = pages.select("page_id", "url", texts("html").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: the main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
