"""Pages as trees of block nodes with features, and a tree-structured graphical model over them."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np

# fixed values: kinds of elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style noscript template iframe select textarea button title".split())
IN_HEAD = frozenset("title meta link style script base noscript template".split())
GROUPS = {
    "main": "article main", "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside dialog", "form": "form fieldset label legend", "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "paragraph": "p blockquote pre", "item": "li dt dd", "list": "ul ol dl", "box": "div section center details summary address", "cell": "td th caption", "table": "table tbody thead tfoot tr",
    "figure": "figure figcaption", "root": "html body",
}
GROUP = {tag: name for name, tags in GROUPS.items() for tag in tags.split()}
# fixed values: words of class, id and role names
WORDS = {
    "w_nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc skip", "w_header": "header masthead topbar banner branding logo hero",
    "w_footer": "footer foot colophon copyright contentinfo legal", "w_side": "sidebar side aside widget widgets rail complementary secondary",
    "w_notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription toast paywall",
    "w_ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner-ad adsense dfp", "w_form": "form login signin signup search searchbox register contact",
    "w_comment": "comment comments reply replies respond discussion disqus responses reader-comments", "w_related": "related recommended recommendations share sharing social tags more popular trending teaser byline-links",
    "w_main": "article content post entry story main body text copy prose page-content article-body",
}
WORD = {word: name for name, words in WORDS.items() for word in words.split()}
NEGATIVE = frozenset(WORDS) - {"w_main"}
CLOSES_P = frozenset(t for t in GROUP if t not in ("html", "body"))
PEERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}


def closed_markup(html: str) -> str:
    """html in which every comment, marked section and tag that starts has an end, so one pass reads it. Openings of comments and sections that never
    end are dropped and their text stays; a tag that never ends is dropped with the rest of its attributes."""
    html = html.replace("<!-->", "<!---->").replace("<!--->", "<!---->")  # both are empty comments
    for opening, endings in (("<!--", ("-->", "--!>")), ("<![", ("]>",))):
        after = max(0, *(html.rfind(x) for x in endings))
        html = html[:after] + html[after:].replace(opening, " ")
    after = html.rfind(">") + 1
    unended = re.search(r"<[A-Za-z/!?]", html[after:])
    return html[:after + unended.start()] if unended else html


def name_words(attrs: list[tuple[str, str | None]]) -> frozenset[str]:
    found = set()
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            for token in value.split():
                parts = re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", token)
                found |= {WORD[x.lower()] for x in (token, *parts) if x.lower() in WORD}
    return frozenset(found)


@dataclass
class Node:
    tag: str
    parent: int
    words: frozenset[str]
    gold: int | None = None
    letters: int = 0
    linked: int = 0
    stops: int = 0


@dataclass
class Run:
    node: int
    parts: list[str] = field(default_factory=list)


class Page(HTMLParser):
    """Block nodes (parents before children) and runs of text in page order, each run of one node.

    A skipped element without an end tag of its own ends at the next block, the head at what may not stand in it. Which elements
    have no end tag shows at the end of a reading, so a page that has such is read again.
    """

    def __init__(self, html: str):
        self.unclosed: set[int] = set()  # numbers of their start tags
        html = closed_markup(html)
        known = -1
        while known < len(self.unclosed):
            known = len(self.unclosed)
            self._read(html)

    def _read(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("body", -1, frozenset())]
        self.stack: list[tuple[str, int, int]] = []  # open elements: tag, node of its own or -1, number of the start tag
        self.at, self.skipping, self.links, self.tags = [0], 0, 0, 0
        self.opened: Counter[str] = Counter()  # open elements by tag
        self.endless: list[int] = []  # places in the stack of elements known to have no end tag
        self.runs: list[Run] = []
        self.open: dict[int, Run] = {}
        self.feed(html)
        self.close()
        self._pop(0)
        for i in range(len(self.nodes) - 1, 0, -1):
            n, p = self.nodes[i], self.nodes[self.nodes[i].parent]
            p.letters += n.letters
            p.linked += n.linked
            p.stops += n.stops

    def _pop(self, index: int, ended: bool = False) -> None:
        """Close the open elements from ``index`` on, the first of them by its end tag if ``ended``."""
        while self.endless and self.endless[-1] >= index:
            self.endless.pop()
        self.unclosed |= {n for tag, _, n in self.stack[index + ended:] if tag in SKIPPED and tag != "head"}
        for tag, node, _ in reversed(self.stack[index:]):
            self.opened[tag] -= 1
            if node >= 0:
                self.open.pop(node, None)
                self.at.pop()
                if tag in GROUP:
                    self.open.pop(self.at[-1], None)
            if tag == "a":
                self.links -= 1
            if tag in SKIPPED:
                self.skipping -= 1
        del self.stack[index:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if self.skipping:
            if tag == "body" and self.opened["head"]:
                self._pop(next((i for i, (t, _, _) in enumerate(self.stack) if t == "head"), len(self.stack)))
            elif tag in GROUP and tag not in ("html", "body") and self.endless:
                self._pop(self.endless[0])
            if tag not in IN_HEAD and tag not in ("head", "html"):
                self._leave_head()
        if tag in VOID:
            self.handle_data(" ")
            return
        if tag in CLOSES_P and (i := self._last("p", {"table", "div", "article", "section", "li", "td"})) >= 0:
            self._pop(i)
        for peer in PEERS.get(tag, ()):
            if (i := self._last(peer, FENCES[tag])) >= 0:
                self._pop(i)
        words = name_words(attrs)
        node = -1
        if tag in GROUP and tag not in ("html", "body") or words & NEGATIVE and tag not in SKIPPED and tag not in ("html", "body"):
            if tag in GROUP:
                self.open.pop(self.at[-1], None)
            gold = dict(attrs).get("data-gold")
            self.nodes.append(Node(tag, self.at[-1], words, None if gold is None else int(gold)))
            node = len(self.nodes) - 1
            self.at.append(node)
        self.stack.append((tag, node, self.tags))
        self.opened[tag] += 1
        if self.tags in self.unclosed:
            self.endless.append(len(self.stack) - 1)
        self.links += tag == "a"
        self.skipping += tag in SKIPPED

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _leave_head(self) -> None:
        if self.stack and self.stack[-1][0] == "head":
            self._pop(len(self.stack) - 1)

    def _last(self, tag: str, fence: set[str]) -> int:
        if not self.opened[tag]:
            return -1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                return i
            if self.stack[i][0] in fence:
                return -1
        return -1

    def handle_endtag(self, tag):
        if not self.opened[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop(i, True)
                return

    def handle_data(self, data):
        if self.skipping and data.strip():
            self._leave_head()
        if self.skipping:
            return
        at = self.at[-1]
        if at not in self.open:
            if not data.strip():
                return
            self.open[at] = Run(at)
            self.runs.append(self.open[at])
        self.open[at].parts.append(data)
        n, node = sum(map(str.isalnum, data)), self.nodes[at]
        node.letters += n
        node.linked += n if self.links else 0
        node.stops += data.count(".") + data.count("!") + data.count("?") + data.count(",") + data.count("。")

    def blocks(self) -> list[tuple[int, str]]:
        joined = ((r.node, " ".join("".join(r.parts).split())) for r in self.runs)
        return [(n, text) for n, text in joined if text]


UNARY = [*(f"g_{g}" for g in (*GROUPS, "inline")), *WORDS, "no_text", "short", "medium", "long", "few_links", "some_links", "many_links", "sentences", "bias"]
U = {name: i for i, name in enumerate(UNARY)}
EDGES = [*(f"g_{g}" for g in (*GROUPS, "inline")), *WORDS, "any"]
E = {name: i for i, name in enumerate(EDGES)}


def features(n: Node) -> tuple[list[int], list[int]]:
    """Indices of a node's own features and of those of the edge to its parent."""
    group = f"g_{GROUP.get(n.tag, 'inline')}"
    names = [group, *sorted(n.words), "bias"]
    names.append("no_text" if n.letters == 0 else "short" if n.letters < 40 else "medium" if n.letters < 200 else "long")
    if n.letters:
        share = n.linked / n.letters
        names.append("few_links" if share < 0.2 else "some_links" if share < 0.6 else "many_links")
        if n.stops >= 2:
            names.append("sentences")
    return [U[x] for x in names], [E[x] for x in (group, *sorted(n.words), "any")]


class TreeModel:
    """P(labels) ~ exp(sum of unary(node) . label + sum of edge(child)[parent's label, own label]); label 1 is main text."""

    def __init__(self, unary: np.ndarray, edges: np.ndarray):
        self.unary, self.edges = unary, edges  # len(UNARY), len(EDGES) x 2 x 2

    def beliefs(self, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
        """Sum-product: messages up from the leaves, then down from the root. Node marginals (n x 2) and edge marginals (n x 2 x 2; parent, own)."""
        n = len(nodes)
        own, between = np.zeros((n, 2)), np.zeros((n, 2, 2))
        for i, node in enumerate(nodes):
            u, e = features(node)
            own[i, 1] = self.unary[u].sum()
            between[i] = self.edges[e].sum(axis=0)
        top = own.max(axis=1, keepdims=True)
        own = np.exp(own - top)
        between = np.exp(between - between.max(axis=(1, 2), keepdims=True))
        up, inside = np.ones((n, 2)), own.copy()  # up: message to the parent
        for i in range(n - 1, 0, -1):
            m = between[i] @ inside[i]
            up[i] = m / m.sum()
            p = inside[nodes[i].parent] * up[i]
            inside[nodes[i].parent] = p / p.sum()
        marginal, edge = np.zeros((n, 2)), np.zeros((n, 2, 2))
        marginal[0] = inside[0] / inside[0].sum()
        for i in range(1, n):
            p = marginal[nodes[i].parent] / np.maximum(up[i], 1e-300)  # the parent without this child's message
            joint = p[:, None] * between[i] * inside[i][None, :]
            edge[i] = joint / joint.sum()
            marginal[i] = edge[i].sum(axis=0)
        return marginal, edge

    def text(self, page: Page, limit: float = 0.5) -> str:
        marginal, _ = self.beliefs(page.nodes)
        return "\n".join(text for node, text in page.blocks() if marginal[node, 1] >= limit)


def labels(page: Page) -> list[int]:
    """Gold labels: a node without its own takes its parent's; the root is 0."""
    out = [0]
    for node in page.nodes[1:]:
        out.append(out[node.parent] if node.gold is None else node.gold)
    return out


def fit(pages: list[str], steps: int = 60, l2: float = 0.02) -> TreeModel:
    """Maximum likelihood over labelled pages by gradient ascent: counted minus expected features, expectations by sum-product."""
    model = TreeModel(np.zeros(len(UNARY)), np.zeros((len(EDGES), 2, 2)))
    parsed = [(p, labels(p), [features(n) for n in p.nodes]) for p in map(Page, pages)]
    su, se = np.full(model.unary.shape, 1e-6), np.full(model.edges.shape, 1e-6)
    for _ in range(steps):
        gu, ge = -l2 * model.unary, -l2 * model.edges
        for page, gold, feats in parsed:
            marginal, edge = model.beliefs(page.nodes)
            for i, (u, e) in enumerate(feats):
                gu[u] += gold[i] - marginal[i, 1]
                if i:
                    ge[e] -= edge[i]
                    ge[e, gold[page.nodes[i].parent], gold[i]] += 1
        su += gu**2
        se += ge**2
        model.unary = model.unary + 0.5 * gu / np.sqrt(su)
        model.edges = model.edges + 0.5 * ge / np.sqrt(se)
    return model
