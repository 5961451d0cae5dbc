"""Main-text extraction with gradient-boosted trees over DOM nodes.

A page is parsed into its block elements (tolerant of missing end tags and of
pages that break off). Each node has features: its own and its ancestors' tag
kinds, tokens of class, id and role attributes, depth, density of text and
links in its subtree, sibling counts and shares. Boosted regression trees give the
log odds that a node belongs to the article. Decoding is hierarchical: a node
may be kept only if its parent is, and of all such choices the one with the
largest sum of log odds (weighted by text) is taken, so an ancestor that is
dropped never has a kept descendant.

The trees are trained on a sample of pages, at most ``most_pages``, chosen by a
hash of the page id. Pages that mark their article (article or main elements)
label their own nodes: what lies in it, outside of menus, asides, notices and
the like, is content. The features don't name these elements for content
nodes' ancestors only, so unmarked pages are decided by the rest. Without any
marked page the rule itself decides.

Nulls and pages without text give an empty text. Character references are
decoded; white space in a block becomes one blank; blocks are joined by an empty
line in page order; nothing is cut off for length. Repeated rows are extracted
alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template svg select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img nobr object noscript param math mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mfenced menclose semantics".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "p": {"div", "td", "th", "li", "article", "section", "main", "body", "aside", "blockquote"}}

GOOD = frozenset("article content entry main post story text body prose".split())
BAD = frozenset("ad ads advert advertisement banner bar breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header login menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo related search share sharing sidebar social sponsor sponsored subscribe tags toolbar widget".split())
BAD_TAGS = frozenset("nav aside footer header form button menu dialog head".split())
KINDS = (("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("article", "main"), ("section", "div"), ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("table", "tr", "td", "th", "tbody"), ("blockquote", "pre", "figure", "figcaption"), ("html", "body"), tuple(sorted(BAD_TAGS)))
_KIND = {t: k for k, tags in enumerate(KINDS) for t in tags}

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TOKEN = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset = frozenset()
    children: list[int] = field(default_factory=list)
    pieces: list[tuple[int, str, bool]] = field(default_factory=list)  # order, text, inside a link


def parse(page: str) -> list[Node]:
    """The block elements of a page; node 0 is the document. Text stands with its nearest block element."""
    nodes = [Node("html", -1, 0)]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with the block they stand for or in
    order = links = at = 0

    def text(raw: str) -> None:
        nonlocal order
        if raw:
            nodes[stack[-1][1]].pieces.append((order, raw, links > 0))
            order += 1

    def pop(to: int) -> None:
        nonlocal links, order
        while len(stack) > to:
            tag, _ = stack.pop()
            links -= tag == "a"
            order += tag not in INLINE  # a block's end separates the texts before and after

    while m := _MARKUP.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        if not m[2] and at >= len(page) and not page.endswith(">"):
            continue  # a tag that the page's end cuts off
        tag = tag.lower()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if stack[k][0] not in INLINE and tag in INLINE:
                    break
            if tag in INLINE:
                text("")
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in VOID:
            text(" ")
            if tag == "hr":
                order += 1
            continue
        if tag in ("html", "body") and len(stack) <= 2:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "head":
                    pop(k)
        ends = ENDS.get(tag) or ({"p"} if tag in CLOSES_P else None)
        if ends:
            scope = SCOPES.get(tag) if tag in ENDS else {"td", "th", "button", "table"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    pop(k)
                    if tag not in ("tr", "td", "th"):
                        break
                elif stack[k][0] in (scope or ()):
                    break
        if tag in INLINE:
            stack.append((tag, stack[-1][1]))
            links += tag == "a"
            continue
        parent = stack[-1][1]
        tokens = frozenset(t for _, v in _NAMES.findall(attributes) for t in _TOKEN.findall(v.lower())) if attributes else frozenset()
        order += 1
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, tokens))
        nodes[parent].children.append(len(nodes) - 1)
        nodes[parent].pieces.append((order, "\0", False))  # a block inside parts the text around it
        order += 1
        stack.append((tag, len(nodes) - 1))
    text(page[at:])
    return nodes


def blocks(nodes: list[Node]) -> list[tuple[int, int, str]]:
    """(order, node, text) of each block of text, in page order."""
    out = []
    for i, node in enumerate(nodes):
        run: list[str] = []
        first = 0
        for order, raw, _ in [*node.pieces, (0, "\0", False)]:
            if raw == "\0":
                if clean := " ".join(entities.unescape("".join(run)).split()):
                    out.append((first, i, clean))
                run = []
            else:
                if not run:
                    first = order
                run.append(raw)
    return sorted(out)


N_FEATURES = len(KINDS) + 19


def features(nodes: list[Node]) -> np.ndarray:
    """A row of features for each node."""
    n = len(nodes)
    chars, linked, words, stops, tags, places = (np.zeros(n) for _ in range(6))
    own = np.zeros(n)
    for i, node in enumerate(nodes):
        for _, raw, link in node.pieces:
            if raw != "\0":
                size = len(raw.strip())
                own[i] += size
                linked[i] += size * link
                words[i] += raw.count(" ") + (size > 0)
                stops[i] += raw.count(".") + raw.count(",")
        tags[i] = 1
    chars += own
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        for a in (chars, linked, words, stops, tags):
            a[p] += a[i]
    for node in nodes:
        for k, c in enumerate(node.children):
            places[c] = k / len(node.children)
    total = max(chars[0], 1.0)
    out = np.zeros((n, N_FEATURES), np.float32)
    good, bad, bad_tag = (np.zeros(n) for _ in range(3))
    base = len(KINDS)
    kinds = [Counter(nodes[c].tag for c in node.children) for node in nodes]
    for i, node in enumerate(nodes):
        p = max(node.parent, 0)
        g, b, t = len(node.tokens & GOOD), len(node.tokens & BAD), node.tag in BAD_TAGS
        good[i], bad[i], bad_tag[i] = g + (good[p] if i else 0), b + (bad[p] if i else 0), t + (bad_tag[p] if i else 0)
        if node.tag in _KIND:
            out[i, _KIND[node.tag]] = 1
        family = nodes[p].children
        out[i, base:] = (
            node.depth, g, b, good[i], bad[i], bad_tag[i], np.log1p(own[i]), np.log1p(chars[i]), linked[i] / max(chars[i], 1), chars[i] / tags[i], words[i] / tags[i],
            stops[i] / max(words[i], 1), len(node.children), len(family), places[i], chars[i] / total, chars[i] / max(chars[p], 1), kinds[p][node.tag] / max(len(family), 1), kinds[i]["p"] > 0,
        )
    return out


def marked(nodes: list[Node]) -> np.ndarray | None:
    """Which nodes a page's own marks make content; None if it marks no article."""
    if not any(x.tag in ("article", "main") for x in nodes):
        return None
    inside, barred, holds = (np.zeros(len(nodes), bool) for _ in range(3))
    for i, x in enumerate(nodes):
        up = x.parent
        inside[i] = x.tag in ("article", "main") or (up >= 0 and inside[up])
        barred[i] = x.tag in BAD_TAGS or bool(x.tokens & BAD) or (up >= 0 and barred[up])
    out = inside & ~barred
    for i in range(len(nodes) - 1, -1, -1):
        holds[i] |= out[i]
        if nodes[i].parent >= 0:
            holds[nodes[i].parent] |= holds[i]
    return holds


@dataclass
class Boosted:
    """Regression trees of depth three on log loss: for each tree 7 splits and 8 leaves."""

    start: float
    columns: np.ndarray
    limits: np.ndarray
    leaves: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for c, t, leaf in zip(self.columns, self.limits, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(3):
                at = 2 * at + 1 + (x[rows, c[at]] > t[at])
            out += leaf[at - 7]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Second-order gradient boosting on histograms."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(x.shape[1])], 1)
    share = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    model = Boosted(float(np.log(share / (1 - share))), np.zeros((rounds, 7), np.int64), np.full((rounds, 7), np.inf), np.zeros((rounds, 8)))
    odds = np.full(len(x), model.start)
    offsets = np.arange(x.shape[1]) * bins
    for r in range(rounds):
        p = 1 / (1 + np.exp(-odds))
        grad, hess = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(x), np.int64)
        for node in range(7):
            on = np.flatnonzero(at == node)
            if len(on):
                flat = (binned[on] + offsets).ravel()
                g = np.bincount(flat, np.repeat(grad[on], x.shape[1]), len(offsets) * bins).reshape(-1, bins).cumsum(1)
                h = np.bincount(flat, np.repeat(hess[on], x.shape[1]), len(offsets) * bins).reshape(-1, bins).cumsum(1)
                gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                for j in range(x.shape[1]):
                    gain[j, len(cuts[j]) :] = -1
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    model.columns[r, node], model.limits[r, node] = best // bins, cuts[best // bins][best % bins]
                at[on] = 2 * node + 1 + (x[on, model.columns[r, node]] > model.limits[r, node])
        leaf = at - 7
        model.leaves[r] = rate * np.bincount(leaf, grad, 8) / (np.bincount(leaf, hess, 8) + ridge)
        odds += model.leaves[r][leaf]
    return model


def decode(nodes: list[Node], odds: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The kept nodes: closed upwards, with the largest sum of weighted log odds."""
    value = odds * weight
    best = value.copy()  # of a node's subtree if the node is kept
    for i in range(len(nodes) - 1, 0, -1):
        best[nodes[i].parent] += max(best[i], 0.0)
    keep = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes):
        keep[i] = best[i] > 0 and (x.parent < 0 or keep[x.parent])
    return keep


def weights(nodes: list[Node]) -> np.ndarray:
    return np.array([0.1 + np.log1p(sum(len(t) for _, t, _ in x.pieces if t != "\0")) for x in nodes])


def main_texts(pages: list[str], model: Boosted | None) -> list[str]:
    """The main text of each page; the nodes of all of them go through the trees together."""
    parsed = [parse(page) for page in pages]
    out = []
    if model and parsed:
        odds = model.odds(np.concatenate([features(nodes) for nodes in parsed]))
        ends = np.cumsum([len(nodes) for nodes in parsed])
    for k, nodes in enumerate(parsed):
        if model:
            keep = decode(nodes, odds[ends[k] - len(nodes) : ends[k]], weights(nodes))
        elif (keep := marked(nodes)) is None:
            keep = np.array([x.tag not in BAD_TAGS and not x.tokens & BAD for x in nodes])
        out.append("\n\n".join(t for _, i, t in blocks(nodes) if keep[i]))
    return out


def fit(pages: DataFrame, most_pages: int = 400) -> Boosted | None:
    """Trees from at most ``most_pages`` pages; None if no page of them marks its article."""
    rows = pages.where("html is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    total = rows.count()
    share = min(1.0, 0.9 * most_pages / max(total, 1))
    sample = rows.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(most_pages)

    def run(batches):
        for batch in batches:
            x, y, w = [np.zeros((0, N_FEATURES), np.float32)], [np.zeros(0, bool)], [np.zeros(0)]
            for page in batch.column(batch.schema.get_field_index("html")).to_pylist():
                nodes = parse(page)
                if (own := marked(nodes)) is not None:
                    x.append(features(nodes))
                    y.append(own)
                    w.append(weights(nodes))
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(x).astype("<f4").tobytes()]), pa.array([np.concatenate(y).tobytes()]), pa.array([np.concatenate(w).astype("<f8").tobytes()])], ["x", "y", "w"])

    found = sample.mapInArrow(run, "x binary, y binary, w binary").orderBy(F.sha1("x")).collect()
    x = np.concatenate([np.zeros((0, N_FEATURES), np.float32), *(np.frombuffer(r[0], "<f4").reshape(-1, N_FEATURES) for r in found)])
    if not len(x):
        return None
    return boost(x, np.concatenate([np.frombuffer(r[1], bool) for r in found]).astype(float), np.concatenate([np.frombuffer(r[2], "<f8") for r in found]))


def extract(pages: DataFrame, model: Boosted | None) -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            get = lambda k: batch.column(batch.schema.get_field_index(k))  # noqa: E731, B023
            pages_ = [page or "" for page in get("html").to_pylist()]
            texts = [t for lo in range(0, len(pages_), 64) for t in main_texts(pages_[lo : lo + 64], shared.value)]
            yield pa.RecordBatch.from_arrays([get("page_id"), get("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
