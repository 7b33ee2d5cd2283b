"""Main text of web pages by gradient-boosted trees over DOM nodes (operator 9).

A page is parsed to its block elements. Trees, fitted here on pages that this module composes itself with
known roles, give each block the probability that it belongs to the article, from subtree text and tag
density, link share, attribute tokens of the node and its ancestors, depth and sibling statistics. Decoding
chooses the most likely labels of the whole tree under the rule that nothing inside a dropped block is kept.

Defined results: null and empty pages, and pages without an article, give the empty text. White space is
what str.split takes for it. Scripts, styles, form controls and comments are never text. Unclosed and
unopened tags are repaired as browsers commonly do. Repeated rows are extracted each.
"""

from __future__ import annotations

import math
import random
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cached, ship, slices, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg select xmp noembed noframes".split())
BLOCKS = frozenset(
    "html body main article section div nav header footer aside form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th caption p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary dialog menu center hgroup search".split()
)
#: Start tags that end an open element, up to the given scope.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop|data-role|hidden|style|data-main)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "up", "depth", "tokens", "kids", "runs", "label", "own", "links", "tags", "text", "marks", "paragraphs", "controls", "index", "level")

    def __init__(self, tag, up, tokens=(), label=None):
        self.tag, self.up, self.tokens = tag, up, tokens
        self.depth = up.depth + 1 if up else 0
        self.kids, self.runs = [], []  # runs: (position in the page, text)
        self.label = label
        self.own = self.links = self.tags = self.controls = 0
        if up is not None:
            self.index = len(up.kids)
            up.kids.append(self)
        else:
            self.index = 0


def _tokens(raw: str) -> tuple[tuple[str, ...], str | None, bool]:
    """Words of the naming attributes; the label of composed pages; whether the element is hidden."""
    words, label, hidden = [], None, False
    for m in ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "data-main":
            label = value
        elif name == "hidden":
            hidden = True
        elif name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "").lower()
        else:
            words += [w.lower() for w in PART.findall(value)]
    return tuple(words), label, hidden


def parse(html: str) -> Node:
    """The tree of block elements, with the text runs that each of them holds itself."""
    root = Node("html", None)
    node, link, skip, at, end = root, 0, None, 0, len(html)
    head = False
    inner: dict[str, list[Node]] = {"html": [root]}  # open elements by tag, the innermost last

    def nearest(tags) -> Node | None:
        return max((inner[t][-1] for t in tags if inner.get(t)), key=lambda x: x.depth, default=None)

    def leave(x: Node) -> Node:
        """Close elements up to ``x``; its parent is the open one then."""
        y = node
        while True:
            inner[y.tag].pop()
            if y is x:
                return x.up
            y = y.up

    while at < end:
        if skip is not None:
            close = re.compile(rf"</{re.escape(skip)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at, skip = (close.end() if close else end), None
            continue
        m = TOKEN.match(html, at)
        at = m.end()
        name = m[2]
        if name is None:
            s = m[0]
            if s[0] == "<" and len(s) > 1:
                continue
            if not head:
                node.runs.append((m.start(), unescape(s)))
                if not s.isspace():
                    n = len(s)
                    node.own += n
                    if link:
                        node.links += n
            continue
        name = name.lower()
        if m[1]:
            if name == "head":
                head = False
            elif name == "a":
                link = 0
            elif name in BLOCKS:
                x = nearest((name,))
                if x is not None and x.up is not None:
                    node, link = leave(x), 0
            continue
        if name == "head":
            head = True
        elif name == "body":
            head = False
            root.tokens = root.tokens + _tokens(m[3])[0] if m[3] else root.tokens
        elif name in RAW:
            if not m[3].rstrip().endswith("/") or name not in ("svg", "iframe"):
                skip = name
            node.controls += name in ("select", "textarea")
        elif name == "a":
            link = 1
            node.tags += 1
        elif name in ("br", "hr"):
            node.runs.append((m.start(), " "))
            node.tags += 1
        elif name in ("input", "button", "label", "option"):
            node.controls += 1
            if name == "button":
                skip = "button"
        elif name in BLOCKS and name != "html":
            head = False
            if name in CLOSES:
                close, scope = CLOSES[name]
                x = nearest(close | scope)
                if x is not None and x.tag in close:
                    node = leave(x)
            else:
                while node.tag == "p" and node.up is not None:
                    node = leave(node)
            tokens, label, hidden = _tokens(m[3]) if m[3] else ((), None, False)
            node = Node(name, node, tokens + (("hidden",) if hidden else ()), label)
            inner.setdefault(name, []).append(node)
            link = 0
        else:
            node.tags += 1
    return root


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += reversed(x.kids)
    return out


TAGS = ["html", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "tr", "td", "p", "h1", "h2", "h3", "h4", "blockquote", "pre", "figure", "dl", "dialog"]
_TAG = {t: i for i, t in enumerate(TAGS)}
NUMBERS = 27
FEATURES = NUMBERS + len(TAGS)
MARKS = re.compile(r"[.!?,;:]")


def features(root: Node, odds: dict[str, float]) -> tuple[list[Node], np.ndarray]:
    """Nodes and their features. odds: how much an attribute word speaks for the article (log odds)."""
    nodes = nodes_of(root)
    for x in reversed(nodes):
        own = "".join(r for _, r in x.runs)
        x.marks = len(MARKS.findall(own)) if x.own else 0
        x.text, x.level = x.own, 0
        x.paragraphs = int(x.tag == "p" and x.own > 0)
        x.tags += 1
        for c in x.kids:
            x.text += c.text
            x.links += c.links
            x.tags += c.tags
            x.marks += c.marks
            x.paragraphs += c.paragraphs
            x.controls += c.controls
            x.level = max(x.level, c.level + 1)
    total = max(1, root.text)
    out = np.zeros((len(nodes), FEATURES), np.float32)
    path: dict[int, tuple[float, float, float]] = {id(None): (0.0, 0.0, 0.0)}  # least and greatest so far, and of dropping tags
    before = 0
    log = math.log1p
    for k, x in enumerate(nodes):
        up = x.up
        least, most, tag = path[id(up)]
        said = [odds.get(w, 0.0) for w in x.tokens]
        low, high = min(said, default=0.0), max(said, default=0.0)
        path[id(x)] = (min(least, low), max(most, high), min(tag, odds.get("<" + x.tag, 0.0)))
        siblings = len(up.kids) if up else 1
        sibling_text = up.text - x.text if up else 0
        row = out[k]
        row[:NUMBERS] = (
            log(x.text), log(x.own), x.links / max(1, x.text), x.tags / max(1, x.text) * 100, x.marks / max(1, x.text) * 100, x.text / total, x.depth, x.index, siblings, x.index / siblings,
            log(sibling_text), x.paragraphs, len(x.kids), x.controls, x.level, before / total, up.links / max(1, up.text) if up else 0, up.paragraphs if up else 0, log(up.text) if up else 0,
            low, high, sum(said), least, most, tag, odds.get("<" + x.tag, 0.0), x.text / max(1, x.paragraphs),
        )
        before += x.own
        if x.tag in _TAG:
            row[NUMBERS + _TAG[x.tag]] = 1
    return nodes, out


class BoostedTrees:
    """Binary log-loss boosting with trees of equal depth over binned features."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 32):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def _bin(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for f, edge in enumerate(self.edges):
            out[:, f] = np.searchsorted(edge, x[:, f]) if len(edge) else 0
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> "BoostedTrees":
        self.edges = []
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            self.edges.append(((values[1:] + values[:-1]) / 2 if len(values) <= self.bins else np.unique(np.quantile(x[:, f], np.arange(1, self.bins) / self.bins))).astype(np.float32))
        z = self._bin(x)
        use = [f for f in range(x.shape[1]) if len(self.edges[f])]
        rate = float((weight * y).sum() / weight.sum())
        self.base = math.log(rate / (1 - rate))
        score = np.full(len(y), self.base)
        n_bins = self.bins + 1
        self.feature = np.zeros((self.trees, (1 << self.depth) - 1), np.int32)
        self.cut = np.full(self.feature.shape, 255, np.int32)
        self.leaf = np.zeros((self.trees, 1 << self.depth))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for d in range(self.depth):
                width = 1 << d
                best = np.full(width, 1e-6)
                total_g, total_h = np.bincount(node, g, minlength=width), np.bincount(node, h, minlength=width)
                whole = total_g**2 / (total_h + 1)
                pick_f, pick_c = np.zeros(width, np.int32), np.full(width, 255, np.int32)
                for f in use:
                    key = node * n_bins + z[:, f]
                    left_g = np.cumsum(np.bincount(key, g, minlength=width * n_bins).reshape(width, n_bins), 1)
                    left_h = np.cumsum(np.bincount(key, h, minlength=width * n_bins).reshape(width, n_bins), 1)
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - whole[:, None]
                    gain[(left_h < 1e-3) | (right_h < 1e-3)] = 0
                    c = gain.argmax(1)
                    better = gain[np.arange(width), c] > best
                    best[better], pick_f[better], pick_c[better] = gain[np.arange(width), c][better], f, c[better]
                self.feature[t, width - 1 : 2 * width - 1], self.cut[t, width - 1 : 2 * width - 1] = pick_f, pick_c
                node = 2 * node + (z[np.arange(len(y)), pick_f[node]] > pick_c[node])
            width = 1 << self.depth
            self.leaf[t] = self.rate * np.bincount(node, g, minlength=width) / (np.bincount(node, h, minlength=width) + 1)
            score += self.leaf[t][node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        z = self._bin(x)
        rows = np.arange(len(z))
        score = np.full(len(z), self.base)
        for t in range(self.trees):
            node = np.zeros(len(z), np.int64)
            for d in range(self.depth):
                at = (1 << d) - 1 + node
                node = 2 * node + (z[rows, self.feature[t, at]] > self.cut[t, at])
            score += self.leaf[t][node]
        return score


def compose(seed: int) -> str:
    """A page with known roles: data-main="0" marks what is not the article."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ter", "sa", "on", "the", "ri", "en", "dü", "és"]) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=4, b=18: words(a, b).capitalize() + r.choice([".", ".", ".", "?", "!"])
    prose = lambda a=1, b=6: " ".join(sentence() for _ in range(r.randint(a, b)))
    named = lambda *c: r.choice([f' class="{r.choice(c)}"', f' id="{r.choice(c)}"', f' class="{r.choice(c)} {word()}"', f' class="{word()}-{r.choice(c)}"'])
    maybe = lambda s: s if r.random() < 0.5 else ""
    links = lambda a, b, wrap="li": "".join(f'<{wrap}><a href="/{word()}">{words(1, 3)}</a></{wrap}>' for _ in range(r.randint(a, b)))
    off = ' data-main="0"'

    def menu():
        body = f"<ul>{links(3, 9)}</ul>" if r.random() < 0.7 else links(3, 9, "span")
        return r.choice([f"<nav{off}>{body}</nav>", f'<div{off}{named("menu", "navbar", "navigation", "nav")}>{body}</div>', f'<ul{off}{named("menu", "nav", "breadcrumbs")}>{links(2, 8)}</ul>'])

    def head():
        body = maybe(f"<div>{words(1, 4)}</div>") + maybe(f"<h1>{words(1, 4)}</h1>" if r.random() < 0.4 else f"<p>{sentence()}</p>") + maybe(menu().replace(off, ""))
        return r.choice([f"<header{off}>{body or words(1, 3)}</header>", f'<div{off}{named("header", "masthead", "top", "site-header")}>{body or words(1, 3)}</div>'])

    def foot():
        body = r.choice([f"&copy; {word()}.example &middot; {sentence()}", f"<p>&copy; {word()} 2020</p><ul>{links(2, 6)}</ul>", f"<div>{prose(1, 2)}</div>"])
        return r.choice([f"<footer{off}>{body}</footer>", f'<div{off}{named("footer", "copyright", "bottom", "site-footer")}>{body}</div>'])

    def advert():
        body = r.choice([prose(1, 3), f"<p>{prose(1, 3)}</p>", f'<a href="#">{sentence()}</a>'])
        return f'<{(t := r.choice(["div", "div", "aside", "section", "p"]))}{off}{named("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "sponsor")}>{body}</{t}>'

    def side():
        body = f"<h3>{words(1, 3)}</h3>" + r.choice([f"<ul>{links(3, 8)}</ul>", f"<p>{prose(1, 3)}</p>", f"<ul>{links(2, 4)}</ul><p>{sentence()}</p>"])
        return r.choice([f"<aside{off}>{body}</aside>", f'<div{off}{named("sidebar", "widget", "related", "popular", "recommended", "rail", "side")}>{body}</div>', f'<section{off}{named("related", "recommended", "trending")}>{body}</section>'])

    def notice():
        body = r.choice([prose(1, 3), f"<p>{prose(1, 2)}</p><button>OK</button>", f"<span>{sentence()}</span> <a href='#'>{word()}</a>"])
        return f'<{(t := r.choice(["div", "div", "section", "dialog", "aside"]))}{off}{named("cookie", "cookies", "consent", "notice", "gdpr", "cookie-banner", "alert", "popup", "modal", "newsletter", "subscribe")}>{body}</{t}>'

    def form():
        return f'<form{off}{maybe(named("search", "login", "signup", "newsletter", "subscribe"))}>{maybe("<p>" + sentence() + "</p>")}<label>{words(1, 2)}</label><input name="q">{maybe("<select><option>" + word() + "</option></select>")}<button>{word()}</button></form>'

    def comments():
        one = lambda: r.choice([f"<li><p>{prose(1, 3)}</p></li>", f'<div class="comment"><b>{word()}</b><p>{prose(1, 4)}</p></div>', f"<article><p>{prose(1, 3)}</p></article>"])
        body = f"<h2>{words(1, 3)}</h2>" + "".join(one() for _ in range(r.randint(1, 6)))
        return f'<{(t := r.choice(["div", "section", "ol", "aside"]))}{off}{named("comments", "comment-list", "comments", "respond", "discussion", "disqus", "replies reply")}>{body}</{t}>'

    def share():
        return f'<{(t := r.choice(["div", "ul", "p"]))}{off}{named("share", "social", "tags", "sharing", "pagination", "pager", "breadcrumb")}>{links(2, 5, "span")}</{t}>'

    def block():
        kind = r.random()
        text = prose(1, 6)
        if r.random() < 0.25:
            text = f'{prose(1, 2)} <a href="/{word()}">{words(1, 4)}</a> {prose(1, 2)}'
        if kind < 0.6:
            return f"<p>{text}</p>" if r.random() < 0.85 else f"<p>{text}"
        if kind < 0.66:
            return f"<p><b>{sentence()}<br>"
        if kind < 0.74:
            return f"<h{(n := r.choice('234'))}>{words(1, 7)}</h{n}>"
        if kind < 0.8:
            return f"<ul>{''.join(f'<li>{sentence(2, 12)}</li>' for _ in range(r.randint(2, 6)))}</ul>"
        if kind < 0.84:
            return f"<blockquote>{maybe('<p>')}{prose(1, 3)}</blockquote>"
        if kind < 0.88:
            return f"<table>{''.join(f'<tr><td>{words(1, 3)}</td><td>{words(1, 4)}</td></tr>' for _ in range(r.randint(1, 5)))}</table>"
        if kind < 0.91:
            return f"<pre>{words(3, 20)}</pre>"
        if kind < 0.94:
            return f"<figure><img src='x'><figcaption>{sentence()}</figcaption></figure>"
        return r.choice([f"<div>{text}</div>", f"<p>{sentence(1, 2)}</p>", f"<section><h2>{words(1, 5)}</h2><p>{text}</p></section>"])

    inner = [block() for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 12, 20]))]
    if r.random() < 0.15:
        inner = [f"<p>{word().capitalize()}.</p>" if r.random() < 0.5 else f"<p><b>{words(1, 2)}<br>" for _ in range(r.randint(1, 3))]
    title = r.choice([f"<h1>{words(1, 10)}</h1>", f"<header><h1>{words(2, 8)}</h1>{maybe('<p>' + sentence() + '</p>')}</header>", f"<h1>{words(1, 6)}.</h1>", ""])
    for make in (advert, share, comments, side, form, notice):
        if r.random() < 0.15:
            inner.insert(r.randint(0, len(inner)), make())
    body = title + "".join(inner)
    if not inner and not title:
        body = f"<p>{sentence()}</p>"
    kind = r.random()
    if kind < 0.5:
        body = f"<article>{body}</article>"
    elif kind < 0.6:
        body = f"<main>{body}</main>"
    elif kind < 0.7:
        body = f'<main><article{maybe(named("post", "entry"))}>{body}</article></main>'
    elif kind < 0.92:
        body = f'<div{named("content", "article", "post", "entry-content", "story", "main", "post-body", "text")}>{body}</div>'
    else:
        body = f"<div>{body}</div>"
    if r.random() < 0.3:
        body = f'<div{maybe(named("page", "wrapper", "container", "content"))}>{maybe(side())}{body}{maybe(side())}</div>'
    before = [m() for m in (head, menu, notice, advert, form, share) if r.random() < 0.4]
    after = [m() for m in (side, comments, advert, share, form, notice, menu) if r.random() < 0.3] + ([foot()] if r.random() < 0.85 else [])
    r.shuffle(before)
    page = f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><style>p{{}}</style></head><body>{''.join(before)}{body}{''.join(after)}"
    return page + ("</body></html>" if r.random() < 0.8 else "")


def _labels(nodes: list[Node]) -> np.ndarray:
    kept: dict[int, bool] = {}
    for x in nodes:
        kept[id(x)] = x.label != "0" and (x.up is None or kept[id(x.up)])
    return np.array([kept[id(x)] for x in nodes], float)


class Extractor:
    """Word odds and trees."""

    def __init__(self, odds: dict[str, float], trees: BoostedTrees):
        self.odds, self.trees = odds, trees


def _weights(nodes: list[Node], y: np.ndarray) -> np.ndarray:
    # The node at which a part is dropped decides; what is inside it follows whatever it looks like.
    return np.where(y == 1, 1.0, np.array([3.0 if n.label == "0" else 0.15 for n in nodes]))


def train(pages: int = 900, seed: int = 1) -> Extractor:
    """Fit on composed pages; their number is the bound of the training set."""
    made = [nodes_of(parse(compose(seed * 1_000_003 + i))) for i in range(pages)]
    labels = [_labels(nodes) for nodes in made]
    count: dict[str, list[float]] = {}
    for nodes, y in zip(made, labels):
        for n, keep, w in zip(nodes, y, _weights(nodes, y)):
            for word in {*n.tokens, "<" + n.tag}:
                count.setdefault(word, [0.5, 0.5])[int(keep)] += w
    odds = {w: math.log(k / d) for w, (d, k) in count.items() if k + d >= 5}
    xs = [features(nodes[0], odds)[1] for nodes in made]
    return Extractor(odds, BoostedTrees().fit(np.concatenate(xs), np.concatenate(labels), np.concatenate([_weights(n, y) for n, y in zip(made, labels)])))


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The most likely labels among those in which a kept node has a kept parent; the root is kept."""
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    place = {id(x): k for k, x in enumerate(nodes)}
    best, none = keep.copy(), drop.copy()  # of the subtree if the node is kept, or dropped
    for k in range(len(nodes) - 1, 0, -1):
        up = place[id(nodes[k].up)]
        best[up] += max(best[k], none[k])
        none[up] += none[k]
    out = [True] * len(nodes)
    for k in range(1, len(nodes)):
        out[k] = out[place[id(nodes[k].up)]] and bool(best[k] >= none[k])
    return out


def text_of(nodes: list[Node], kept: list[bool]) -> str:
    """Text runs of the kept nodes in page order; blocks are set off by blanks."""
    runs = sorted((at, k, s) for k, (x, keep) in enumerate(zip(nodes, kept)) if keep for at, s in x.runs)
    out, last = [], None
    for _, k, s in runs:
        if last is not None and k != last:
            out.append(" ")
        out.append(s)
        last = k
    return " ".join("".join(out).split())


def extract(pages: list[str | None], model: Extractor) -> list[str]:
    made = [features(parse(p), model.odds) if p and not p.isspace() else None for p in pages]
    some = [m for m in made if m is not None]
    if not some:
        return [""] * len(pages)
    odds = model.trees.predict(np.concatenate([x for _, x in some]))
    out, at = [], 0
    for m in made:
        if m is None:
            out.append("")
            continue
        nodes = m[0]
        out.append(text_of(nodes, decode(nodes, odds[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extract_pages(pages: DataFrame, model: Extractor) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    ship(pages.sparkSession)
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in slices(batches, rows=256):
            texts = extract(b.column(2).to_pylist(), model)
            yield batch({"page_id": b.column(0), "url": b.column(1), "text": texts, "n_chars": [len(t) for t in texts]}, schema)

    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"), cached(("html", 900, 1), train))
