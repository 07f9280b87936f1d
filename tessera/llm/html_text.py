"""Main text of web pages by a tree-structured graphical model.

The nodes are the block elements of a page's DOM; each is main text or not. Node potentials come from what is seen of a
node (its element, the words of its names, its text and links), edge potentials from whether parent and child, by the
child's kind, are alike. Both are weights, fitted together to labelled pages by maximum likelihood: the same messages give
what the weights expect, with and without the labels. A name or element that these pages hardly have says nothing. Messages go up and down the tree (sum-product), which gives the exact marginal of every node; text of
nodes more likely main text than not is kept, in the order of the page.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.html_pages import labelled_pages

#: Labelled pages that the model is fitted to.
TRAIN_PAGES, TRAIN_SEED = 1500, 1
#: Evidence is used if so many labelled nodes have it; steps of the fit.
LEAST_SEEN, FIT_STEPS = 20, 150
#: Where no block of a page is more likely main text than not: how likely the likeliest must be, and which share of that others.
LEAST_LIKELY, NEAR = 0.05, 0.8

#: Elements of the HTML standard, by how they are read: without content, with raw text, never shown, and flowing in text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
HIDDEN = frozenset("script style noscript iframe template svg head".split())
FORM = frozenset("form button select option input textarea label fieldset".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements whose start ends an open one of the second set, up to one of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

#: Kinds of elements, by how they go with their parents; others are of none.
KINDS = {
    "text": frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption address".split()),
    "item": frozenset("li td th tr tbody thead ul ol dl table".split()),
    "part": frozenset("article main section nav aside header footer form".split()),
}
_KIND = {tag: kind for kind, tags in KINDS.items() for tag in tags}

_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: An attribute, or the end of the tag; quotes enclose a value only where they begin it.
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|(=?[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?)")
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_PART = re.compile(r"[A-Za-z]{2,}")


class Node:
    __slots__ = ("tag", "names", "parent", "children", "text", "linked", "label", "unseen")

    def __init__(self, tag: str, names: str, parent: Node | None, label: int | None, unseen: bool = False):
        self.tag, self.names, self.parent, self.label, self.unseen = tag, names, parent, label, unseen
        self.children: list[Node] = []
        self.text: list[tuple[int, str]] = []  # place in the page, text
        self.linked = 0  # characters in links


def attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Those of the tag whose name ends at this place, by lower-cased name, and where the tag ends."""
    out: dict[str, str] = {}
    while at < len(page):
        m = _ATTRIBUTE.match(page, at)
        if m.end() == at:
            break
        at = m.end()
        if m[1]:
            break
        if m[2]:
            out.setdefault(m[2].lower(), m[3] or m[4] or m[5] or "")
    return out, at


def unseen(found: dict[str, str]) -> bool:
    return bool(found) and ("hidden" in found or found.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(found.get("style", "")) is not None)


def parse(page: str) -> list[Node]:
    """The block elements of the page, parents first. Unknown, unclosed and misnested tags are borne with."""
    root = Node("html", "", None, None)
    nodes, stack, links, place, at = [root], [root], 0, 0, 0
    standing = Counter()  # open elements by tag: none is looked for in vain, however deep a page is
    piece: list[str] = []
    muted: list[str] = []  # open elements within a text, from the first that is not shown on

    def flush() -> None:
        nonlocal place, piece
        if piece:
            text = html.unescape("".join(piece))
            if not text.isspace():
                stack[-1].text.append((place, text))
                place += 1
            piece = []

    def close_to(depth: int) -> None:
        nonlocal links
        flush()
        standing.subtract(x.tag for x in stack[depth:])
        del stack[depth:]
        links = 0
        muted.clear()

    n = len(page)
    while at < n:
        low = page.find("<", at)
        m = _TAG.match(page, low) if low >= 0 else None
        text = page[at : n if low < 0 else low if m else low + 1]
        if text and not muted:
            piece.append(text)
            if links:
                stack[-1].linked += len(text)
        if not m:
            at = n if low < 0 else low + 1
            continue
        at = m.end()
        if not m[2]:
            continue  # a comment or a declaration; the text goes on
        tag, closing = m[2].lower(), bool(m[1])
        found, at = attributes(page, at)
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else 1
            if closing and tag in muted:
                del muted[len(muted) - 1 - muted[::-1].index(tag) :]
            elif not closing and (muted or unseen(found)):
                muted.append(tag)
            continue
        if tag == "br" or tag == "wbr" or tag == "img":
            piece.append(" " if tag == "br" else "")
            continue
        if closing:
            if standing[tag] > 0:
                close_to(next(d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag))
            else:
                flush()
            continue
        flush()
        inner, borders = CLOSES.get(tag, ((), ()))
        for depth in range(len(stack) - 1, 0, -1) if any(standing[t] > 0 for t in inner) else ():
            if stack[depth].tag in borders:
                break
            if stack[depth].tag in inner:
                close_to(depth)
                break
        if stack[-1].tag == "p":  # a paragraph holds no block
            close_to(len(stack) - 1)
        if tag in VOID:
            continue
        names = " ".join(found[x] for x in ("class", "id", "role") if x in found).lower()
        node = Node(tag, names, stack[-1], int(found["data-y"]) if found.get("data-y") in ("0", "1") else None, unseen(found))
        stack[-1].children.append(node)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag not in HIDDEN:
                node.text.append((place, html.unescape(page[at : end.start() if end else n])))
                place += 1
            at = end.end() if end else n
            continue
        muted.clear()
        stack.append(node)
        standing[tag] += 1
    flush()
    return nodes


def features(node: Node) -> list[str]:
    """What is seen of a node, as names of evidence."""
    out = ["tag:" + ("form" if node.tag in FORM else node.tag)]
    if node.names:
        out += {"name:" + w for w in _PART.findall(node.names)}
    if node.text:
        length = sum(len(t) for _, t in node.text)
        out.append("length:%d" % min(6, length.bit_length() // 2))
        out.append("links:%d" % round(3 * min(1.0, node.linked / max(1, length))))
        out.append("ends:%d" % (node.text[-1][1].rstrip()[-1:] in ".!?…。"))
    return out


class Forest:
    """The nodes of many pages in arrays, for messages level by level."""

    def __init__(self, pages: list[list[Node]], kinds: dict):
        nodes = [x for page in pages for x in page]
        index = {id(x): k for k, x in enumerate(nodes)}
        self.parent = np.array([index[id(x.parent)] if x.parent is not None else -1 for x in nodes])
        self.kind = np.array([kinds[_KIND.get(x.tag)] for x in nodes])
        self.label = np.array([-1 if x.label is None else x.label for x in nodes])
        depth = np.zeros(len(nodes), np.int64)
        for k, p in enumerate(self.parent.tolist()):  # parents come first
            depth[k] = depth[p] + 1 if p >= 0 else 0
        self.levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]

    def expected(self, score: np.ndarray, alike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each node, and of each node and its parent how alike they are, from -1 to 1, by messages up
        and down. score: log odds of each node by itself; alike: the weight of each one's edge."""
        below, up = score.copy(), np.zeros(len(score))
        through = lambda x, w: np.logaddexp(w / 2 + x, -w / 2) - np.logaddexp(x - w / 2, w / 2)
        for own in reversed(self.levels):
            up[own] = through(below[own], alike[own])
            np.add.at(below, self.parent[own], up[own])
        both, held = np.zeros(len(score)), below.copy()
        for own in self.levels:
            above, w = held[self.parent[own]] - up[own], alike[own]  # the parent without this child
            held[own] = below[own] + through(above, w)
            same, other = np.logaddexp(above + below[own] + w / 2, w / 2), np.logaddexp(above - w / 2, below[own] - w / 2)
            both[own] = np.tanh((same - other) / 2)
        return 1 / (1 + np.exp(-np.clip(held, -60, 60))), both


class Model:
    """Weights of evidence, in log odds of being main text, and of a parent and a child of a kind being alike."""

    def __init__(self, pages: list[str]):
        parsed = [parse(page) for page in pages]
        kinds = {kind: k for k, kind in enumerate((None, *KINDS))}
        forest = Forest(parsed, kinds)
        seen = [(k, f) for k, node in enumerate(x for page in parsed for x in page) for f in features(node)]
        often = Counter(f for _, f in seen)
        index = {f: k for k, f in enumerate(sorted(f for f, n in often.items() if n >= LEAST_SEEN))}
        rows, columns = (np.array(x) for x in zip(*((k, index[f]) for k, f in seen if f in index), strict=True))
        n, child = len(forest.kind), forest.parent >= 0
        weights = np.zeros(len(index) + len(kinds) + 1)
        weights[len(index) : -1] = 2.0
        told = np.where(forest.label < 0, 0.0, 60.0 * (2 * forest.label - 1))  # what is not labelled stays open
        moment, square = np.zeros(len(weights)), np.zeros(len(weights))
        for step in range(1, FIT_STEPS + 1):
            score = np.bincount(rows, weights[columns], n) + weights[-1]
            alike = weights[len(index) : -1][forest.kind]
            (p, both), (q, given) = forest.expected(score, alike), forest.expected(score + told, alike)
            off = p - q
            slope = np.concatenate([np.bincount(columns, off[rows], len(index)), np.bincount(forest.kind[child], (both - given)[child] / 2, len(kinds)), [off.sum()]])
            slope = slope / n + 1e-4 * weights
            moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope**2
            weights = weights - 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        self.evidence = dict(zip(index, weights.tolist(), strict=False))
        self.alike = {kind: float(weights[len(index) + k]) for kind, k in kinds.items()}
        self.prior = float(weights[-1])
        self.edges = {kind: [[math.exp(w / 2), math.exp(-w / 2)], [math.exp(-w / 2), math.exp(w / 2)]] for kind, w in self.alike.items()}

    def score(self, node: Node) -> float:
        """The log odds of the node by itself."""
        return self.prior + sum(self.evidence.get(f, 0.0) for f in features(node))

    def edge(self, node: Node) -> list[list[float]]:
        """The potential of the node and its parent, by the parent's state and then the node's."""
        return self.edges[_KIND.get(node.tag)]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of being main text of each node, parents first, by one pass up and one down."""
        n = len(nodes)
        index = {id(x): k for k, x in enumerate(nodes)}
        parent = [index[id(x.parent)] if x.parent is not None else -1 for x in nodes]
        own0, own1 = [1.0] * n, [0.0] * n
        for k, x in enumerate(nodes):
            own1[k] = 1 / (1 + math.exp(-max(-60.0, min(60.0, self.score(x)))))
            own0[k] = 1 - own1[k]
        below0, below1 = own0[:], own1[:]  # own evidence times the messages of the children
        up0, up1 = [1.0] * n, [1.0] * n
        for k in range(n - 1, 0, -1):
            s = below0[k] + below1[k]
            x0, x1 = below0[k] / s, below1[k] / s
            below0[k], below1[k] = x0, x1
            (a, b), (c, d) = self.edge(nodes[k])
            up0[k], up1[k] = a * x0 + b * x1, c * x0 + d * x1
            p = parent[k]
            below0[p] *= up0[k]
            below1[p] *= up1[k]
            s = below0[p] + below1[p]
            below0[p] /= s
            below1[p] /= s
        out = [0.0] * n
        belief0, belief1 = below0, below1
        out[0] = belief1[0] / (belief0[0] + belief1[0])
        for k in range(1, n):
            p = parent[k]
            from0, from1 = belief0[p] / up0[k], belief1[p] / up1[k]  # the parent without this child
            (a, b), (c, d) = self.edge(nodes[k])
            x0, x1 = belief0[k] * (from0 * a + from1 * c), belief1[k] * (from0 * b + from1 * d)
            s = x0 + x1
            belief0[k], belief1[k] = x0 / s, x1 / s
            out[k] = belief1[k]
        return out


@functools.cache
def default_model() -> Model:
    return Model(labelled_pages(TRAIN_PAGES, TRAIN_SEED))


def main_text(page: str | None, model: Model) -> str:
    """The text of blocks that are more likely main text than not. On a page with no such block, as short ones without
    any telling name may be, those that are nearly as likely as the likeliest are kept, if that is likely enough."""
    nodes = parse(page or "")
    shown = [True] * len(nodes)
    index = {id(x): k for k, x in enumerate(nodes)}
    for k, x in enumerate(nodes):  # what is never shown, or is part of a form, is not text of an article
        shown[k] = x.tag not in HIDDEN and x.tag not in FORM and not x.unseen and (x.parent is None or shown[index[id(x.parent)]])
    likely = [(p, x) for x, p, s in zip(nodes, model.marginals(nodes), shown, strict=True) if s and x.text]
    most = max((p for p, _ in likely), default=0.0)
    least = 0.5 if most >= 0.5 else NEAR * most if most >= LEAST_LIKELY else 1.0
    kept = sorted(t for p, x in likely if p >= least for t in x.text)
    return " ".join(" ".join(t.split()) for _, t in kept if t.strip())


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page. A null or empty page has an empty text; repeated rows are read
    alike; a page of any length is read whole. Other columns are ignored. An empty table gives no rows."""
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), sent.value) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
