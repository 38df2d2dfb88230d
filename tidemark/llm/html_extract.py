"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of its block elements; inline markup makes no node.  Each run of text that stands in no
block but the body is a node ``#text``, judged like a paragraph.  Each node gets features of
its subtree (text, density of tags, links and sentence marks), attribute tokens of itself and of its ancestors,
depth, and how it compares with its siblings.  Trees fitted on a bounded sample of pages score each
node as article or not.  The best labelling of the whole tree then is found with the rules that
everything inside a dropped node is dropped, and that an article node lies in no dropped one, so an
ancestor and a descendant never contradict each other.

The sample's labels come from markup that says what it is (``article`` and ``main`` against ``nav``,
``footer``, class names of adverts and so on).  Each labelled node is also shown without these names,
so that pages without them are judged by shape.  ``sample_pages`` bounds the sample; all pages are scored.

Scripts, styles, templates, form controls and their labels, comments, the head and its title, and what stands in for
media that a browser cannot show have no text.  Null and empty html give an empty
text; repeated pages are judged alike; unknown or unclosed tags never fail.  Character references are
decoded, white space inside a block becomes one space, and blocks are joined by one space.
"""

from __future__ import annotations

import re
from html import unescape
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.boosting import Trees, fit_trees

#: Fixed values of HTML.
RAW = {"script", "style", "template", "noscript", "textarea", "select", "option", "svg", "iframe", "object", "head", "button", "datalist",
       "title", "label", "video", "audio", "canvas"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
    "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
BREAKS = {"br", "hr", "img", "input"}
#: Raw elements that run to the end of the page when they are not closed; of the others only the tag is skipped.
TO_THE_END = {"script", "style", "textarea", "iframe", "title"}
#: An open element of the key is ended by a start tag of the values.
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
#: Names that say what a region is.
ARTICLE_NAMES = frozenset("article main content post entry story articlebody body text prose blog page".split())
OTHER_NAMES = frozenset(
    "nav navigation navbar menu menubar breadcrumb breadcrumbs footer foot header masthead banner sidebar side aside complementary "
    "contentinfo ad ads advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay toast comment comments commentlist disqus reply replies respond discussion reader form "
    "login signup register subscribe subscription newsletter search share sharing social related recommended recommendations "
    "trending popular widget toolbar pagination pager copyright legal disclaimer skip meta tags author bio rating".split())
OTHER_TAGS = frozenset("nav footer aside form header menu dialog search address".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.DOTALL)
NAMES = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|href)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
MARKS = re.compile(r"[.,;:!?。、]")


class Node:
    __slots__ = ("tag", "parent", "depth", "article", "other", "place", "children", "parts", "own", "links", "marks", "tags")

    def __init__(self, tag: str, parent: int, depth: int, article: int, other: int):
        self.tag, self.parent, self.depth, self.article, self.other = tag, parent, depth, article, other
        self.place = 0  # among its siblings
        self.children: list[int] = []
        self.parts: list[tuple[int, str]] = []
        self.own = self.links = self.marks = self.tags = 0


def _name_counts(tag: str, attributes: str) -> tuple[int, int]:
    article = int(tag in ("article", "main"))
    other = int(tag in OTHER_TAGS)
    if attributes:
        for m in NAMES.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                other += 1
            elif name != "href":
                parts = {p.lower() for p in PART.findall(value)}
                article += len(parts & ARTICLE_NAMES)
                other += len(parts & OTHER_NAMES)
    return article, other


def parse(html: str) -> list[Node]:
    """The block elements of a page in page order, the root first; text pieces are numbered in page order."""
    nodes, stack, link, at, piece = [Node("#root", -1, 0, 0, 0)], [0], 0, 0, []
    order, bare = 0, Node("#text", 0, 1, 0, 0)

    def here() -> Node:
        return nodes[stack[-1]] if len(stack) > 1 else bare

    def flush():
        nonlocal order, bare
        text = " ".join(unescape("".join(piece)).split())
        piece.clear()
        node = here()
        if node is bare:
            if text:
                bare.place = len(nodes[0].children)
                nodes[0].children.append(len(nodes))
                nodes.append(bare)
            else:
                nodes[0].tags += bare.tags
            bare = Node("#text", 0, 1, 0, 0)
        if text:
            node.parts.append((order, text))
            node.own += len(text)
            node.marks += len(MARKS.findall(text))
            order += 1

    while m := TOKEN.search(html, at):  # from the end of a raw element, whatever began inside it
        if m.start() > at:
            piece.append(html[at:m.start()])
            if link:
                here().links += m.start() - at
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = m[1] == "/"
        if tag in RAW:
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
                at = end.end() if end else (len(html) if tag in TO_THE_END else at)
            continue
        if tag == "a":
            link = 0 if closing else 1
        elif tag in BREAKS:
            piece.append(" ")
        if tag not in BLOCKS:
            here().tags += 1
            continue
        flush()
        nodes[stack[-1]].tags += 1
        link = 0
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    break
            continue
        while len(stack) > 1:
            top = nodes[stack[-1]].tag
            if top == "p" or tag in ENDED_BY.get(top, ()):
                stack.pop()
            else:
                break
        if tag in ("html", "body"):
            continue
        article, other = _name_counts(tag, m[3])
        parent = stack[-1]
        stack.append(len(nodes))
        nodes.append(Node(tag, parent, len(stack) - 1, article, other))
        nodes[-1].place = len(nodes[parent].children)
        nodes[parent].children.append(len(nodes) - 1)
    if at < len(html):
        piece.append(html[at:])
    flush()
    return nodes


KINDS = {t: k for k, group in enumerate((
    ("p", "blockquote", "pre", "#text"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "ul", "ol", "dl", "dt", "dd"),
    ("article", "main"), ("nav", "footer", "aside", "form", "header", "menu", "dialog", "search"), ("table", "tr", "td", "th", "tbody"))) for t in group}
NAMED = (0, 1, 2, 3, 14, 15)
WIDTH = 25


def node_features(nodes: list[Node]) -> np.ndarray:
    """One row per node; the columns ``NAMED`` hold what names and structural tags say."""
    n = len(nodes)
    x = np.zeros((n, WIDTH))
    text, links, marks, tags = ([getattr(v, k) for v in nodes] for k in ("own", "links", "marks", "tags"))
    for k in range(n - 1, 0, -1):
        p = nodes[k].parent
        text[p] += text[k]
        links[p] += links[k]
        marks[p] += marks[k]
        tags[p] += tags[k] + 1
    above_article, above_other = [0] * n, [0] * n
    whole = text[0] + 1
    for k, v in enumerate(nodes):
        if k:
            p = v.parent
            inside = above_article[p] + nodes[p].article
            above_article[k], above_other[k] = inside, above_other[p] + nodes[p].other
            if inside and v.tag == "header":
                v.other = 0
            brothers = nodes[p].children
            place = v.place
            before = text[brothers[place - 1]] if place else 0
            after = text[brothers[place + 1]] if place < len(brothers) - 1 else 0
            mean = text[p] / len(brothers)
            x[k, 16:21] = len(brothers), place / len(brothers), log(1 + before), log(1 + after), text[k] / (mean + 1)
        t = text[k]
        x[k, :14] = (
            v.article, v.other, above_article[k], above_other[k], log(1 + t), log(1 + v.own), links[k] / (t + 1),
            marks[k] / (t + 1), tags[k] / (t + 1), t / whole, v.depth, len(v.children), t / (len(v.children) + 1), k / n)
        kind = KINDS.get(v.tag, -1)
        if kind in (3, 4):
            x[k, 11 + kind] = 1
        elif kind >= 0:
            x[k, 21 + (kind if kind < 3 else 3)] = 1
    return x


def _sure(nodes: list[Node]) -> np.ndarray:
    """1 for nodes that names put in the article, 0 for nodes they put elsewhere, -1 if names are silent."""
    out = np.full(len(nodes), -1)
    inside, elsewhere = [False] * len(nodes), [False] * len(nodes)
    for k, v in enumerate(nodes[1:], 1):
        elsewhere[k] = elsewhere[v.parent] or v.other > 0
        inside[k] = inside[v.parent] or v.tag in ("article", "main") or v.article > 0
        out[k] = 0 if elsewhere[k] else 1 if inside[k] else -1
    return out


def fit_model(pages: DataFrame, html: str = "html", sample_pages: int = 300) -> Trees:
    """Trees fitted on the first ``sample_pages`` pages that Spark reads, at most."""
    rows, labels = [np.zeros((0, WIDTH))], [np.zeros(0)]
    for (source,) in pages.select(html).take(sample_pages):
        nodes = parse(source or "")
        x = node_features(nodes)
        sure = _sure(nodes)
        keep = (sure >= 0) & (x[:, 4] > 0)
        rows.append(x[keep])
        labels.append(sure[keep])
    x, y = np.concatenate(rows), np.concatenate(labels).astype(float)
    if not y.any():  # no name says what an article looks like, so names alone drop a node
        x, y = x[:0], y[:0]
    # Other pages use other names: show the shapes without names, with plain elements of either kind of
    # name, and prose in regions that are named as no part of the article.
    own = np.arange(len(x)) % 2 == 0
    bare, renamed = x.copy(), x.copy()
    bare[:, NAMED] = renamed[:, NAMED] = 0
    for at, above, yes in ((0, 2, y > 0), (1, 3, y == 0)):
        renamed[yes & own, at] = 1
        renamed[yes & ~own, above] = 1
    foreign = x[y > 0]
    foreign[:, [1, 3]] = np.where(own[:len(foreign), None], [1, 0], [0, 1])
    hint = np.zeros((5, WIDTH))
    hint[[0, 1, 2, 3], [0, 2, 1, 3]] = 1  # what names mean, should the sample have none; no names are article
    x = np.concatenate([x, renamed, bare, foreign] + [hint] * 5)
    y = np.concatenate([y, y, y, np.zeros(len(foreign))] + [np.array([1, 1, 0, 0, 1.0])] * 5)
    return fit_trees(x, y)


def decode(nodes: list[Node], scores: np.ndarray) -> str:
    """The text of the best labelling.

    A node is a frame around others, article, or dropped.  Inside an article are article and dropped nodes, inside
    a dropped node only dropped ones.  A label gains the node's score, times the weight of its own text.
    """
    n = len(nodes)
    frame, article, dropped = [0.0] * n, [0.0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        v = nodes[k]
        gain = float(scores[k]) * (log(1 + v.own) if v.own else 0.1)
        f, a, d = -0.2 * log(1 + v.own), gain, -gain
        for c in v.children:
            most = max(article[c], dropped[c])
            f += max(frame[c], most)
            a += most
            d += dropped[c]
        frame[k], article[k], dropped[k] = f, (a if k else -1e9), d
    label = [0] * n
    kept = []
    for k in range(n):
        v = nodes[k]
        above = label[v.parent] if k else 0
        options = [(frame[k], 0), (article[k], 1), (dropped[k], 2)] if above == 0 else [(article[k], 1), (dropped[k], 2)] if above == 1 else [(0.0, 2)]
        label[k] = max(options, key=lambda o: o[0])[1]
        if label[k] == 1:
            kept += v.parts
    return " ".join(t for _, t in sorted(kept))


def extract_text(pages: DataFrame, html: str = "html", model: Trees | None = None, sample_pages: int = 300) -> DataFrame:
    """``pages`` with ``text`` instead of the html: one scan, no shuffle."""
    model = model or fit_model(pages, html, sample_pages)
    place = pages.columns.index(html)
    others = [c for c in pages.columns if c not in (html, "text")]
    schema = T.StructType([*(pages.schema[c] for c in others), T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                trees = [parse(s or "") for s in part.column(place).to_pylist()]
                scores = model.score(np.concatenate([node_features(t) for t in trees]))
                cut = np.cumsum([0, *map(len, trees)])
                texts = [decode(t, scores[a:b]) for t, a, b in zip(trees, cut, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in others] + [pa.array(texts, type=pa.string())], names=schema.names)

    return pages.mapInArrow(run, schema)
