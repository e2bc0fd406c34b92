"""Main text of web pages: boosted trees over DOM nodes with hierarchical decoding.

A lenient parser turns a page into block nodes with the text directly below them.
Each node gets features of its subtree (text, links, density), its attribute
tokens and those above it, its depth and its siblings. Boosted trees give the log
odds that the node belongs to the main text. Decoding picks the best set of nodes in
which a kept node's ancestors are kept too: the gain of a node is its own log odds
plus the positive gains of its children, and it stays if that is positive and its
parent stays. So no ancestor and descendant contradict each other.

The trees are fitted on a bounded sample: TRAIN_PAGES pages of the table, those least
by a hash of page_id, labelled by their markup, and MADE_PAGES pages built from
templates with the sample's words, which bring layouts that the sample may lack. The
sample's labels say: inside article or main elements, but not inside menus, forms,
asides or the like there.

Defined results: null or empty html has an empty text; very long and deeply nested pages
are read whole, in linear time; what a browser that runs scripts does not show as text
(noscript, canvas, the text of form fields) is none; page_id and url may be null or repeat; broken markup is closed as browsers do, and a tag that never ends is
dropped; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fibrelark.llm.boosting import BoostedTrees
from fibrelark.llm.common import batches, text_column

TRAIN_PAGES = 200
MADE_PAGES = 300

_TOKEN = re.compile(
    r"<[!?][^>]*+>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>|(?P<text>[^<]++|<)",
    re.S,
)
_NAMED = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_STOPS = re.compile(r"[.!?;:,]")

# Elements by what they mean for blocks and for the main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes svg math select canvas object".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
LISTS = frozenset("ul ol dl menu table".split())
SCOPES = frozenset("p td th li table button caption".split())
MAIN = frozenset("article main".split())
APART = frozenset("nav footer aside form header menu button dialog fieldset".split())
POSITIVE = frozenset("article content post entry main body story text page blog news hentry maincontent".split())
NEGATIVE = frozenset(
    "nav navbar navigation menu header masthead footer foot bottom sidebar aside side ad ads advert advertisement adsbygoogle banner sponsor sponsored promo "
    "promotion cookie consent notice alert popup modal overlay comment comments reply replies respond discussion disqus form newsletter subscribe signup login search share "
    "sharing social related recommended more breadcrumb breadcrumbs pagination pager widget toolbar tags meta byline copyright legal privacy hidden skip contentinfo complementary".split()
)


class _Stack:
    """Open elements; each name's places are kept, so that no end tag searches the whole stack."""

    def __init__(self) -> None:
        self.tags, self.nodes = ["#root"], [0]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []  # places of paragraphs and of what a paragraph's end does not cross

    def node(self) -> int:
        return self.nodes[-1]

    def top(self) -> str:
        return self.tags[-1]

    def last(self, tag: str) -> int:
        """The innermost place of an open element of this name; 0 if there is none."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag in SCOPES:
            self.scopes.append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(node)

    def cut(self, k: int) -> None:
        """Ends the element at place k and all within."""
        for tag in self.tags[k:]:
            self.places[tag].pop()
        while self.scopes and self.scopes[-1] >= k:
            self.scopes.pop()
        del self.tags[k:], self.nodes[k:]

    def end_paragraph(self) -> None:
        if self.scopes and self.tags[self.scopes[-1]] == "p":
            self.cut(self.scopes[-1])

    def end_items(self, tags: set[str]) -> None:
        """Ends the open items of these names in the innermost list or table."""
        within = max(self.last(tag) for tag in LISTS)
        open_ = [places[bisect_right(places, within)] for tag in tags if (places := self.places.get(tag)) and places[-1] > within]
        if open_:
            self.cut(min(open_))


class Page:
    """Block nodes of a page in page order, and its blocks of text, each below one node."""

    __slots__ = ("tags", "tokens", "parents", "depths", "blocks", "links")

    def __init__(self, html: str) -> None:
        self.tags: list[str] = ["#root"]
        self.tokens: list[frozenset[str]] = [frozenset()]
        self.parents: list[int] = [-1]
        self.depths: list[int] = [0]
        self.blocks: list[tuple[int, str]] = []  # node, text
        self.links: list[int] = []  # characters of the block inside links
        self._read(html)

    def _read(self, html: str) -> None:
        stack = _Stack()
        pieces: list[str] = []
        linked = 0
        in_link = False
        at, n, lowered = 0, len(html), None
        # Where the last comment and the last marked section end: what starts after that has no end.
        last_comment, last_section = html.rfind("-->"), html.rfind("]]>")

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join(entities.unescape("".join(pieces)).split())
                if text:
                    self.blocks.append((stack.node(), text))
                    self.links.append(min(linked, len(text)))
                pieces.clear()
            linked = 0

        while at < n:
            if html.startswith("<!--", at) and at + 4 <= last_comment:
                at = html.index("-->", at + 4) + 3
                continue
            if html.startswith("<![CDATA[", at) and at + 9 <= last_section:
                end = html.index("]]>", at + 9)
                pieces.append(html[at + 9 : end])
                at = end + 3
                continue
            m = _TOKEN.match(html, at)
            if m is None:  # an unfinished comment or declaration
                break
            at = m.end()
            text = m["text"]
            if text is not None:
                if text == "<" and at < n and (html[at].isalpha() or html[at] in "/!?"):
                    break  # a tag that never ends
                pieces.append(text)
                if in_link:
                    linked += len(text)
                continue
            tag = m["tag"] or m["tag2"]
            if tag is None:
                continue
            tag = tag.lower()
            closing = m["close"] or m["close2"]
            if closing:
                if tag == "a":
                    in_link = False
                if tag in INLINE:
                    if stack.top() == tag:  # a marked inline element: its text is a block of its own
                        flush()
                        stack.cut(len(stack.tags) - 1)
                elif (k := stack.last(tag)) > 0:
                    flush()
                    stack.cut(k)
                elif tag == "br":
                    pieces.append(" ")
                continue
            attrs = m["attrs"] if m["tag"] else m["attrs2"]
            if tag in RAW:
                if attrs.rstrip().endswith("/") and tag in ("svg", "math"):
                    continue
                lowered = lowered if lowered is not None else _ascii_lower(html)
                end = lowered.find(f"</{tag}", at)
                if end < 0:
                    break
                close = html.find(">", end)
                at = n if close < 0 else close + 1
                pieces.append(" ") if tag not in ("script", "style") else None
                continue
            if tag == "br":
                pieces.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                    stack.end_paragraph()
                continue
            found = _tokens(attrs) if "=" in attrs else frozenset()
            if tag in INLINE:
                if tag == "a":
                    in_link = True
                # A marked inline element is judged apart where it begins a block, never within a sentence.
                if not (found & NEGATIVE) or any(not piece.isspace() for piece in pieces):
                    continue
                flush()
            else:
                flush()
                if tag in ENDS_P:
                    stack.end_paragraph()
                elif tag in CLOSES:
                    stack.end_items(CLOSES[tag])
                in_link = in_link and tag in ENDS_P
            self.tags.append(tag)
            self.tokens.append(found)
            self.parents.append(stack.node())
            self.depths.append(len(stack.tags))
            stack.push(tag, len(self.tags) - 1)
        flush()
        self._split_mixed()

    def _split_mixed(self) -> None:
        """Text beside child nodes becomes a leaf of its own, so that it can be judged apart."""
        has_child = set(self.parents)
        leaf: dict[int, int] = {}
        for k, (node, text) in enumerate(self.blocks):
            if node in has_child:
                # One leaf for each stretch of text between children keeps its place in the page.
                self.tags.append("#text")
                self.tokens.append(frozenset())
                self.parents.append(node)
                self.depths.append(self.depths[node] + 1)
                leaf[k] = len(self.tags) - 1
        self.blocks = [(leaf.get(k, node), text) for k, (node, text) in enumerate(self.blocks)]


def _ascii_lower(text: str) -> str:
    """Lower-cases without changing the length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def _tokens(attrs: str) -> frozenset[str]:
    said = " ".join(a or b or c for a, b, c in _NAMED.findall(attrs))
    return frozenset(_PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", said).lower()))


FEATURES = 32


def features(page: Page) -> np.ndarray:
    """A row for each node."""
    n = len(page.tags)
    own, linked, stops = [0.0] * n, [0.0] * n, [0.0] * n
    start = [-1.0] * n
    total = 0
    for (node, text), in_links in zip(page.blocks, page.links, strict=True):
        own[node] += len(text)
        linked[node] += in_links
        stops[node] += len(_STOPS.findall(text))
        if start[node] < 0:
            start[node] = total
        total += len(text)
    whole, whole_link, whole_stop = own[:], linked[:], stops[:]
    below, paragraphs = [0] * n, [0] * n
    bad = [len(t & NEGATIVE) for t in page.tokens]
    good = [len(t & POSITIVE) for t in page.tokens]
    bad_text = [0.0] * n
    children: list[list[int]] = [[] for _ in range(n)]
    # Leaves made for mixed text come last but lie below earlier nodes; from the back all are complete.
    order = sorted(range(1, n), key=lambda v: -page.depths[v])
    for v in order:
        u = page.parents[v]
        children[u].append(v)
        whole[u] += whole[v]
        whole_link[u] += whole_link[v]
        whole_stop[u] += whole_stop[v]
        below[u] += below[v] + 1
        paragraphs[u] += paragraphs[v] + (page.tags[v] == "p")
        apart = bad[v] > 0 or page.tags[v] in APART
        bad_text[u] += whole[v] if apart else bad_text[v]
        if start[v] >= 0 and (start[u] < 0 or start[v] < start[u]):
            start[u] = start[v]
    above_bad, above_good, above_apart, above_main = [0] * n, [0] * n, [0] * n, [0] * n
    index, siblings, mean, same = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    for v in reversed(order):  # parents first
        u = page.parents[v]
        above_bad[v] = above_bad[u] + bad[u]
        above_good[v] = above_good[u] + good[u]
        above_apart[v] = above_apart[u] + (page.tags[u] in APART)
        above_main[v] = above_main[u] + (page.tags[u] in MAIN)
    for u in range(n):
        kids = sorted(children[u])
        if not kids:
            continue
        average = sum(whole[v] for v in kids) / len(kids)
        alike: dict[str, int] = {}
        for v in kids:
            alike[page.tags[v]] = alike.get(page.tags[v], 0) + 1
        for k, v in enumerate(kids):
            index[v], siblings[v], mean[v], same[v] = k, len(kids), average, alike[page.tags[v]] / len(kids)
    out = np.zeros((n, FEATURES))
    tags = page.tags
    groups = [
        [t == "p" for t in tags],
        [len(t) == 2 and t[0] == "h" and t[1].isdigit() for t in tags],
        [t in ("li", "ul", "ol", "dl", "dt", "dd") for t in tags],
        [t in ("table", "tr", "td", "th", "tbody") for t in tags],
        [t in ("div", "section", "center") for t in tags],
        [t in MAIN for t in tags],
        [t in APART for t in tags],
        [t in ("html", "body", "#root") for t in tags],
        [t in ("pre", "blockquote", "figure", "figcaption", "#text") for t in tags],
        [t in INLINE for t in tags],
    ]
    for k, column in enumerate(groups):
        out[:, k] = column
    text, link, nodes = np.array(whole), np.array(whole_link), np.array(below)
    own_text, stop = np.array(own), np.array(whole_stop)
    share = text / max(total, 1)
    parents = np.array(page.parents)
    parents[0] = 0
    columns = (
        bad, good, np.minimum(above_bad, 3), np.minimum(above_good, 3), above_apart, above_main, page.depths, index, siblings,
        np.array(index) / np.maximum(siblings, 1), np.log1p(text), np.log1p(own_text), link / np.maximum(text, 1),
        nodes, np.log1p(text / (nodes + 1)), paragraphs, share, np.array(start) / max(total, 1), share[parents],
        stop / np.maximum(text, 1), np.log1p(mean), same,
    )
    for k, column in enumerate(columns, len(groups)):
        out[:, k] = column
    return out


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which nodes stay: the closed set with the greatest sum of log odds."""
    n = len(page.tags)
    gain = odds.astype(float).copy()
    order = sorted(range(1, n), key=lambda v: -page.depths[v])
    for v in order:
        if gain[v] > 0:
            gain[page.parents[v]] += gain[v]
    stays = np.zeros(n, bool)
    stays[0] = gain[0] > 0
    for v in reversed(order):
        stays[v] = stays[page.parents[v]] and gain[v] > 0
    return stays


def kept_text(page: Page, stays: np.ndarray) -> str:
    return " ".join(text for node, text in page.blocks if stays[node])


def markup_labels(page: Page) -> np.ndarray | None:
    """Labels of a page whose markup tells its main part; None for others."""
    n = len(page.tags)
    label = np.zeros(n, bool)
    dropped = np.zeros(n, bool)
    order = sorted(range(1, n), key=lambda v: page.depths[v])
    if not any(t in MAIN for t in page.tags):
        return None
    for v in order:
        u = page.parents[v]
        dropped[v] = dropped[u] or page.tags[v] in APART or bool(page.tokens[v] & NEGATIVE)
        label[v] = not dropped[v] and (label[u] or page.tags[v] in MAIN)
    for v in reversed(order):  # what holds main text is kept for it
        if label[v]:
            label[page.parents[v]] = True
    return label


# ---- pages from templates, for layouts that a sample may lack

_FALLBACK = "about after again air all along also always any around ask away back because before below between both came city come could country day do each earth end".split()


class Maker:
    """Builds pages; every element that belongs to the main text is marked for the labels."""

    def __init__(self, words: list[str], seed: int) -> None:
        self.rng = random.Random(seed)
        self.words = words or _FALLBACK

    def said(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(low, high))) + self.rng.choice([".", ".", "", "!"])

    def prose(self) -> str:
        return self.said(1, 6) if self.rng.random() < 0.25 else self.said(8, 120)

    def links(self, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/x">{self.said(1, 4)}</a></{tag}>' for _ in range(self.rng.randint(2, 9)))

    def main(self) -> str:
        rng = self.rng
        parts = [f"<{rng.choice(['h1', 'h1', 'h2'])} data-m>{self.said(3, 12)}</h1>"]
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.7:
                inner = self.prose() if rng.random() < 0.85 else f"{self.prose()} <a href='/y'>{self.said(1, 3)}</a> {self.prose()}"
                parts.append(f"<p data-m>{inner}" + ("</p>" if rng.random() < 0.8 else ""))
            elif kind < 0.78:
                parts.append(f"<p data-m><b>{self.said(2, 12)}<br>")
            elif kind < 0.84:
                parts.append(f"<h{rng.randint(2, 4)} data-m>{self.said(2, 7)}</h2>")
            elif kind < 0.9:
                parts.append("<ul data-m>" + "".join(f"<li data-m>{self.said(3, 25)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.94:
                parts.append(f"<blockquote data-m><p data-m>{self.prose()}</p></blockquote>")
            elif kind < 0.97:
                parts.append("<table data-m><tr data-m>" + "".join(f"<td data-m>{self.said(1, 5)}</td>" for _ in range(3)) + "</tr></table>")
            else:
                parts.append(self.inside())
        if rng.random() < 0.35:
            parts.insert(rng.randint(1, len(parts)), self.inside())
        return "".join(parts)

    def inside(self) -> str:
        """What stands inside the main part without belonging to it."""
        return self.rng.choice(
            [
                lambda: f'<div class="{self.rng.choice(["ad", "ads", "advert", "sponsored", "promo-box"])}">{self.said(3, 30)}</div>',
                lambda: f'<aside class="related"><h3>{self.said(1, 3)}</h3><ul>{self.links()}</ul></aside>',
                lambda: f'<div class="share social">{self.links("span")}</div>',
                lambda: f'<form class="newsletter" action="/s"><label>{self.said(3, 12)}</label><input name=e><button>{self.said(1, 2)}</button></form>',
                lambda: f"<nav><ul>{self.links()}</ul></nav>",
            ]
        )()

    def around(self, where: str) -> str:
        rng = self.rng
        before = [
            lambda: f"<header><a href='/'>{self.said(1, 3)}</a><p>{self.said(2, 8)}</p></header>",
            lambda: f'<div id="header" class="{rng.choice(["masthead", "site-header", "top header"])}"><span>{self.said(1, 4)}</span></div>',
            lambda: f"<nav><ul>{self.links()}</ul></nav>",
            lambda: f'<ul class="menu">{self.links()}</ul>',
            lambda: f'<div class="{rng.choice(["navbar", "main-nav", "breadcrumbs"])}">{self.links("span")}</div>',
            lambda: f'<div class="{rng.choice(["cookie-notice", "notice", "alert banner", "consent"])}" role="alert"><p>{self.said(8, 40)}</p><button>{self.said(1, 2)}</button></div>',
            lambda: f'<div class="{rng.choice(["ad", "ads", "advert", "sponsor"])}">{self.said(4, 30)}</div>',
        ]
        after = [
            lambda: f"<aside><h3>{self.said(1, 4)}</h3><p>{self.said(5, 40)}</p><ul>{self.links()}</ul></aside>",
            lambda: f'<div class="{rng.choice(["sidebar", "side widget", "widget-area"])}"><h4>{self.said(1, 3)}</h4><p>{self.said(5, 60)}</p>{self.links("div")}</div>',
            lambda: self.comments(),
            lambda: f'<form action="/login" class="login"><p>{self.said(3, 14)}</p><input><button>{self.said(1, 2)}</button></form>',
            lambda: f'<div class="related-posts"><ul>{self.links()}</ul></div>',
            lambda: f"<footer>&copy; {self.said(2, 18)}</footer>",
            lambda: f'<div class="{rng.choice(["footer", "site-footer", "copyright bottom"])}"><p>{self.said(4, 25)}</p>{self.links("span")}</div>',
            lambda: f'<div class="{rng.choice(["ad", "advertisement", "promo"])}"><p>{self.said(5, 50)}</p></div>',
        ]
        return "".join(make() for make in rng.sample(before if where == "before" else after, rng.randint(1, 4)))

    def comments(self) -> str:
        rng = self.rng
        tag, name = rng.choice([("section", "comments"), ("div", "comment-list"), ("div", "replies"), ("ol", "discussion comments")])
        item = "li" if tag == "ol" else "div"
        said = "".join(f'<{item} class="{rng.choice(["comment", "reply"])}"><b>{self.said(1, 2)}</b><p>{self.said(3, 80)}</p></{item}>' for _ in range(rng.randint(1, 6)))
        return f'<{tag} class="{name}" id="{rng.choice(["comments", "respond", "c"])}"><h3>{self.said(1, 3)}</h3>{said}</{tag}>'

    def page(self) -> str:
        rng = self.rng
        box = rng.choice(
            ["<article data-m>{}</article>", "<article data-m>{}</article>", "<main data-m>{}</main>", "<main data-m><article data-m>{}</article></main>"]
            + [f'<div data-m class="{c}">{{}}</div>' for c in ("article-body", "post-content", "entry", "content", "story", "col-8")]
            + ['<section data-m id="content">{}</section>', '<div data-m id="main"><div data-m class="post">{}</div></div>']
        )
        body = self.around("before") + box.format(self.main()) + self.around("after")
        if rng.random() < 0.3:
            body = f'<div data-m class="{rng.choice(["wrapper", "container", "page"])}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.said(2, 8)}</title></head><body>{body}</body></html>"


class MarkedPage(Page):
    """A made page with the nodes that its maker marked."""

    __slots__ = ("marked",)

    def __init__(self, html: str) -> None:
        # The mark becomes a token that is taken out again.
        super().__init__(html.replace(" data-m", ' role="zzmarked"'))
        self.marked = np.array(["zzmarked" in t for t in self.tokens])
        self.tokens = [t - {"zzmarked"} for t in self.tokens]
        for v in range(1, len(self.tags)):
            if self.tags[v] == "#text":
                self.marked[v] = self.marked[self.parents[v]] and self.tags[self.parents[v]] not in ("div", "main", "article", "section")
        for v in sorted(range(1, len(self.tags)), key=lambda v: -self.depths[v]):
            if self.marked[v]:
                self.marked[self.parents[v]] = True


def fit_model(sample: list[str], seed: int = 3) -> BoostedTrees:
    """Boosted trees from labelled sample pages and made pages."""
    rows, labels, weights = [], [], []

    def add(page: Page, label: np.ndarray) -> None:
        rows.append(features(page))
        labels.append(label)
        # Nodes weigh by their text, as that is what a wrong label costs.
        size = np.bincount([v for v, _ in page.blocks], [len(t) for _, t in page.blocks], len(page.tags))
        weights.append(0.5 + np.log1p(size) / 4)

    words: list[str] = []
    for html in sample:
        page = Page(html)
        label = markup_labels(page)
        if label is not None:
            add(page, label)
        if len(words) < 20_000:
            words += [w for _, text in page.blocks for w in text.split()[:60]]
    maker = Maker(words, seed)
    for _ in range(MADE_PAGES):
        page = MarkedPage(maker.page())
        add(page, page.marked)
    return BoostedTrees().fit(np.concatenate(rows), np.concatenate(labels).astype(float), np.concatenate(weights))


def _extract(model):  # noqa: ANN001, ANN202
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches(parts):
            texts: list[str] = []
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                pages = [Page(html) for html in text_column(part, "html")]
                rows = [features(p) for p in pages]
                odds = np.split(trees.raw(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
                texts += [kept_text(p, decode(p, o)) for p, o in zip(pages, odds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every page; one pass without exchange after the sample."""
    # The bound comes from keys alone, so that no task sends pages which the sample does not take.
    keyed = pages.filter("html is not null").select(F.xxhash64("page_id").alias("key"), "html")
    bound = keyed.select("key").orderBy("key").limit(TRAIN_PAGES).agg(F.max("key").alias("bound")).first()["bound"]
    sample = keyed.filter(F.col("key") <= F.lit(bound)).orderBy("key", "html").limit(TRAIN_PAGES)
    model = spark.sparkContext.broadcast(fit_model([r["html"] for r in sample.collect()]))
    wanted = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return wanted.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")
