"""HTML extraction: gradient-boosted trees over DOM nodes, and a decoding over the tree.

Each block element of a page is a node with features of its tag, attribute tokens, depth, subtree density and siblings. The
trees give the odds that it belongs to the article. The decoding takes the most likely set of nodes in which a node is kept
only if its parent is. The trees are trained here: pages whose own article element gives the labels, and variants of them in
which the article stands in another element, often of a random name, among noise that its elements or its name tell. What an
attribute token tells is its log-odds, weighed on the other half of the training pages.
"""

from __future__ import annotations

import html as entities
import pickle
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.llm import common as C

SAMPLE, TREES, DEPTH, BINS, RATE = 400, 40, 4, 32, 0.3

# Fixed values of the HTML standard: elements by their role in parsing and rendering.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary dialog menu center hgroup search select option button label legend iframe noscript template".split())
CLOSES_P = BLOCK - set("html body select option button label legend iframe noscript template".split())
RAW = ("script", "style", "title", "textarea", "noembed", "noframes", "iframe")
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
P_SCOPE = ("button", "td", "th", "table")
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
REST = re.compile(r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+>""")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in (*RAW, "xmp")}
ATTR = re.compile(r"""(?<![^\s=/"'>])([^\s=/"'>]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)""")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPLIT = re.compile(r"[a-z]+")
TAGS = ["html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "dl", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "figcaption", "button", "label", "select", "noscript", "address"]
UP = ["article", "main", "nav", "header", "footer", "aside", "form", "table", "noscript", "select", "button"]
#: Bits of a node's flags: its tag, and the tags above (itself included).
_TAG_BIT = {t: 1 << i for i, t in enumerate(TAGS)}
_UP_BIT = {t: 1 << (len(TAGS) + i) for i, t in enumerate(UP)}
_INHERITED = sum(_UP_BIT.values())
FLAGS = len(TAGS) + len(UP)
#: Attribute tokens are known by a hash; what they tell is learnt, and less of those seen seldom.
BUCKETS, SELDOM = 1 << 14, 20
NODES = 1 << 14


class Node:
    __slots__ = ("tag", "attrs", "parent", "depth", "kids", "chars", "links", "words", "stops", "tags", "blocks", "order", "place", "own")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.depth = parent.depth + 1 if parent else 0
        self.place = len(parent.kids) if parent else 0
        self.kids: list[Node] = []
        self.chars = self.links = self.words = self.stops = self.tags = self.own = 0
        self.blocks: list[tuple[int, str]] = []  # (place in the page, text)
        if parent:
            parent.kids.append(self)


class Open:
    """The open elements, and where each tag stands among them, so that no tag has to walk the stack."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        """The place of the innermost of these, 0 if none is open."""
        return max((own[-1] for t in tags if (own := self.at.get(t))), default=0)

    def first_after(self, tags, place: int) -> int:
        """The place of the outermost of these that is inside of `place`, 0 if none is."""
        found = (own[i] for t in tags if (own := self.at.get(t)) and (i := bisect_right(own, place)) < len(own))
        return min(found, default=0)

    def leave(self, upto: int) -> None:
        for node in self.stack[upto:]:
            self.at[node.tag].pop()
        del self.stack[upto:]


def parse(page: str) -> list[Node]:
    """The block elements in page order, the root first, with the texts that stand directly in them.

    Every byte is read a bounded number of times, whatever the page holds. A < that starts no tag, and a tag that the page
    never closes, is text. A quoted value hides a >, until one hides the page's last; from there on a tag ends at its next >.
    """
    root = Node("html", "", None)
    nodes, open_ = [root], Open(root)
    stack = open_.stack
    buffer: list[str] = []
    place = linked = 0
    pos, n = 0, len(page)
    last_close, quotes, xmp_ends = page.rfind(">"), True, True

    def flush():
        nonlocal place
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                stack[-1].blocks.append((place, text))
                place += 1

    def write(text: str):
        buffer.append(text)
        if linked:
            stack[-1].links += len(text.strip())

    def leave(upto: int):
        flush()
        open_.leave(upto)

    while pos < n:
        at = page.find("<", pos)
        if at != pos:
            at = n if at < 0 else at
            write(entities.unescape(page[pos:at]))
            pos = at
            continue
        if page.startswith(("<!", "<?"), pos):
            end = page.find("-->", pos + 4) + 3 if page.startswith("<!--", pos) else page.find(">", pos) + 1
            pos = end if end > 2 or end and not page.startswith("<!--", pos) else n
            continue
        m = NAME.match(page, pos + 1) if pos < last_close else None
        if m is None:
            upto = page.find("<", pos + 1) if pos < last_close else -1
            if pos >= last_close and (comment := min((x for x in (page.find("<!", pos), page.find("<?", pos)) if x >= 0), default=-1)) >= 0:
                upto = comment
            upto = n if upto < 0 else upto
            write(entities.unescape(page[pos:upto]))
            pos = upto
            continue
        end = REST.match(page, m.end()) if quotes else None
        quotes = end is not None
        start, pos = pos, end.end() if end else page.find(">", m.end()) + 1
        tag, attrs = m[2].lower(), page[m.end() : pos - 1]
        if m[1]:
            if tag == "a":
                linked = 0
            elif tag == "br":
                buffer.append(" ")
            elif tag in BLOCK and tag not in ("html", "body"):
                if k := open_.last((tag,)):
                    linked = 0
                    leave(k)
                else:
                    flush()
            continue
        stack[-1].tags += 1
        if tag in RAW and not attrs.rstrip().endswith("/"):
            close = RAW_END[tag].search(page, pos)
            pos = close.end() if close else n
            continue
        if tag == "xmp" and xmp_ends:  # all of it is text, tags too
            close = RAW_END[tag].search(page, pos)
            xmp_ends = close is not None
            if close:
                flush()
                buffer.append(page[pos : close.start()])
                flush()
                pos = close.end()
        elif tag == "a":
            linked = 1
        elif tag in VOID:
            if tag in ("br", "wbr", "img", "hr"):
                buffer.append(" " if tag != "wbr" else "")
                if tag == "hr":
                    flush()
        elif tag in BLOCK:
            flush()
            if tag in ("html", "body"):
                if tag == "body" and len(stack) == 1:
                    open_.push(Node("body", attrs, root))
                    nodes.append(stack[-1])
                continue
            if (own := open_.at.get("p")) and tag in CLOSES_P and own[-1] > open_.last(P_SCOPE):
                leave(own[-1])
            if tag in IMPLIED and (k := open_.first_after(IMPLIED[tag], open_.last(STOPS[tag]))):
                leave(k)
            open_.push(Node(tag, attrs, stack[-1]))
            nodes.append(stack[-1])
    flush()
    for i, x in enumerate(nodes):
        x.order = i
    for x in reversed(nodes):
        for _, text in x.blocks:
            x.own += len(text)
            x.words += text.count(" ") + 1
            x.stops += sum(map(text.count, ".!?,;:"))
        x.chars += x.own
        if up := x.parent:
            up.chars += x.chars
            up.links += x.links
            up.words += x.words
            up.stops += x.stops
            up.tags += x.tags
    return nodes


def attr_tokens(attrs: str) -> set[str]:
    """Words of the class, id, role and aria-label values."""
    out: set[str] = set()
    if "=" in attrs:
        for m in ATTR.finditer(attrs):
            if m[1].lower() in ("class", "id", "role", "aria-label", "itemprop"):
                out.update(SPLIT.findall(CAMEL.sub(" ", m[2]).lower()))
    return out


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def node_tokens(nodes: list[Node]) -> list[list[int]]:
    return [sorted({zlib.crc32(t.encode()) % BUCKETS for t in attr_tokens(x.attrs)}) if x.attrs else [] for x in nodes]


def token_odds(tokens: list[list[int]], y: np.ndarray) -> np.ndarray:
    """How much each token speaks for a node that is kept: log-odds, shrunk for tokens seen seldom."""
    at = np.concatenate([np.array(t, np.int64) for t in tokens]) if tokens else np.zeros(0, np.int64)
    n = np.bincount(at, minlength=BUCKETS)
    kept = np.bincount(at, np.repeat(y, [len(t) for t in tokens]), BUCKETS)
    return np.log((kept + 1) / (n - kept + 1)) * n / (n + SELDOM)


def features(nodes: list[Node], tokens: list[list[int]], odds: np.ndarray) -> np.ndarray:
    """A row for each node: its tag and those above as flags, then place, density of the subtree, siblings, the parent, and
    the least and greatest odds of its own tokens and of all from the root down to it."""
    total, n = max(1, nodes[0].chars), len(nodes)
    bits, told = [], []
    for x, own in zip(nodes, tokens):
        bits.append((bits[x.parent.order] & _INHERITED if x.parent else 0) | _TAG_BIT.get(x.tag, 0) | _UP_BIT.get(x.tag, 0))
        o = [odds[t] for t in own]
        low, high = min(o, default=0.0), max(o, default=0.0)
        up = told[x.parent.order] if x.parent else (0.0, 0.0, 0.0, 0.0)
        told.append((low, high, min(up[2], low), max(up[3], high)))
    raw = np.array([(x.depth, x.chars, x.links, x.stops, x.words, x.tags, len(x.kids), len(x.parent.kids) if x.parent else 1, x.own, x.place, x.parent.chars if x.parent else 0) for x in nodes], float).reshape(n, 11)
    depth, chars, links, stops, words, tags, kids, peers, own, place, above = raw.T
    some = np.maximum(chars, 1)
    flags = np.unpackbits(np.array(bits, "<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :FLAGS]
    return np.concatenate([flags, np.stack([
        depth, np.log1p(chars), chars / total, links / some, stops / np.maximum(words, 1), chars / np.maximum(words, 1), np.log1p(chars / (1 + tags)), tags, kids, peers,
        own / some, np.arange(n) / n, place == 0, place == peers - 1, np.log1p(above), chars / np.where(above > 0, above, some),
    ], axis=1), np.array(told).reshape(n, 4)], axis=1).astype(np.float32)


class Trees:
    """Logistic boosting with histogram splits."""

    def __init__(self):
        self.bias, self.trees, self.edges, self.tokens = 0.0, [], [], np.zeros(BUCKETS)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
        """All nodes of a level are split at once, from one histogram of (node, feature, bin)."""
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) if j >= FLAGS else np.zeros(1) for j in range(x.shape[1])]
        size, d = BINS + 1, x.shape[1]
        bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)
        varied = np.flatnonzero(bins.max(axis=0) > bins.min(axis=0))
        codes = bins[:, varied] + varied * size
        mean = np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = w * (p - y), w * p * (1 - p)
            nodes = 2 ** (depth + 1) - 1
            tree = {"feature": np.full(nodes, -1), "bin": np.zeros(nodes, np.int64), "value": np.zeros(nodes)}
            at = np.zeros(len(y), np.int64)
            for level in range(depth + 1):
                first, many = 2**level - 1, 2**level
                live = np.flatnonzero(at >= first)
                node = at[live] - first
                gs, hs, ns = (np.bincount(node, v[live], many) for v in (g, h, np.ones(len(y))))
                tree["value"][first : first + many] = -RATE * gs / (hs + 1)
                if level == depth:
                    break
                key = (codes[live] + node[:, None] * (d * size)).ravel()
                lg, lh = (np.bincount(key, np.repeat(v[live], len(varied)), many * d * size).reshape(many, d, size).cumsum(axis=2) for v in (g, h))
                gs, hs = gs[:, None, None], hs[:, None, None]
                gain = lg**2 / (lh + 1) + (gs - lg) ** 2 / (hs - lh + 1) - gs**2 / (hs + 1)
                gain[(lh < 1) | (hs - lh < 1)] = 0
                gain = gain.reshape(many, -1)
                gain[ns <= 20] = 0
                best = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(many), best] > 1e-3).tolist():
                    f, b = divmod(int(best[k]), size)
                    tree["feature"][first + k], tree["bin"][first + k] = f, b
                    mine = live[node == k]
                    at[mine] = 2 * (first + k) + 1 + (bins[mine, f] > b)
            self.trees.append(tree)
            score += tree["value"][at]
        return self

    def odds(self, pages: list[list[Node]]) -> list[np.ndarray]:
        """Of the nodes of each page, worked out together, block by block."""
        x = np.concatenate([features(nodes, node_tokens(nodes), self.tokens) for nodes in pages])
        out = np.full(len(x), self.bias)
        asked = sorted({int(f) for t in self.trees for f in t["feature"] if f >= 0})
        column = np.full(x.shape[1] + 1, -1)  # the last is for nodes without a split
        column[asked] = np.arange(len(asked))
        for lo in range(0, len(x), NODES):
            part = x[lo : lo + NODES]
            values = np.stack([np.searchsorted(self.edges[f], part[:, f], "left") for f in asked], axis=1) if asked else np.zeros((len(part), 0), np.int64)
            rows = np.arange(len(part))
            for t in self.trees:
                at, to = np.zeros(len(part), np.int64), column[t["feature"]]
                for _ in range(DEPTH):
                    f = to[at]
                    at = np.where(f >= 0, 2 * at + 1 + (values[rows, f] > t["bin"][at]), at)
                out[lo : lo + NODES] += t["value"][at]
        return np.split(out, np.cumsum([len(nodes) for nodes in pages])[:-1])


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The likeliest choice with no kept node under a dropped one. A node's vote counts by the text that it adds; the root
    and body are but containers and always open."""
    n = len(nodes)
    weight = np.log1p([x.own for x in nodes]) + 0.1
    p = np.clip(odds, -8, 8)
    keep, drop = (-np.log1p(np.exp(-p)) * weight).tolist(), (-np.log1p(np.exp(p)) * weight).tolist()
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        if x.parent:
            j = x.parent.order
            keep[j] += max(keep[i], drop[i])
            drop[j] += drop[i]
    chosen = [False] * n
    for i, x in enumerate(nodes):
        chosen[i] = x.tag in ("html", "body") or chosen[x.parent.order] and keep[i] > drop[i]
    return np.array(chosen, bool)


def main_texts(pages: list[str], model: Trees) -> list[str]:
    """The odds of all the pages' nodes are worked out together."""
    parsed = [parse(x) for x in pages]
    odds = model.odds(parsed) if parsed else []
    return [_joined(nodes, o) for nodes, o in zip(parsed, odds)]


def main_text(page: str, model: Trees) -> str:
    return main_texts([page], model)[0]


def _joined(nodes: list[Node], odds: np.ndarray) -> str:
    chosen = decode(nodes, odds)
    blocks = []
    for x, c, o in zip(nodes, chosen, odds):
        if c and (x.parent and x.tag != "body" or o > 0):
            blocks += x.blocks
    return "\n".join(t for _, t in sorted(blocks))


# Variants for training ------------------------------------------------------------------------------------------------

_CONTAINERS = ['<div class="post-content">', '<div id="content">', "<main>", '<section class="article-body">', '<div class="entry-content">', '<div id="main-content" role="main">', '<div class="story">', "<article>", '<article class="post">', "<div>", "<section>", "<table><tr><td>"]
#: What names of classes and ids say of a block that is no part of an article.
_NOISE = "ad ads advert advertisement adslot sponsor sponsored promo promoted promotion banner cookie consent gdpr privacy notice alert newsletter subscribe signup share sharing social follow related recommended popular trending more widget sidebar rail menu nav navigation navbar breadcrumb breadcrumbs pagination pager toolbar header masthead footer copyright legal comment comments reply replies discussion respond popup modal overlay dialog login search tags topics".split()
_SHAPES = ["<{t} {n}>{b}</{t}>", "<{t} {n}><p>{b}</p></{t}>", "<{t} {n}><h3>{a}</h3><p>{b}</p></{t}>", '<{t} {n}><ul><li><a href="/1">{a}</a></li><li><a href="/2">{c}</a></li></ul></{t}>', '<{t} {n}><a href="#">{a}</a> <a href="#">{c}</a></{t}>', "<{t} {n}><p>{b}</p><button>{a}</button></{t}>", "<{t} {n}><{t} {m}><p>{b}</p></{t}><{t} {m}><p>{c} {b}</p></{t}></{t}>", "<{t} {n}><span>{a}</span><p>{b}</p><p>{c}</p></{t}>"]
#: Noise by its elements, whatever their names.
_PLAIN = ["<header><div {r}>{a}</div><p>{b}</p></header>", '<aside {r}><h3>{a}</h3><p>{b}</p><ul><li><a href="/x">{c}</a></li></ul></aside>', '<form action="/s"><label>{a}</label><input name="q"><button>{c}</button></form>', "<footer {r}><p>{b}</p></footer>", "<noscript><p>{b}</p></noscript>", '<nav {r}><a href="/">{a}</a><a href="/c">{c}</a></nav>', '<div role="navigation"><a href="/q">{a}</a></div>', '<ul {r}><li><a href="/1">{a}</a></li><li><a href="/2">{c}</a></li><li><a href="/3">{a}</a></li></ul>', "<select><option>{a}</option><option>{c}</option></select>"]
_INSIDE = ["<blockquote>{b}</blockquote>", "<ul><li>{b}</li><li>{c}</li></ul>", "<h2>{a}</h2>", "<div {r}><p>{b}</p></div>", "<table><tr><td>{a}</td><td>{c}</td></tr></table>", "<pre>{b}</pre>", "<figure><figcaption>{a}</figcaption></figure>", '<p {r}>{a} <a href="/l">{c}</a> {b}</p>', "<section {r}><h3>{a}</h3><p>{b}</p></section>", "<ol><li>{c}</li></ol>", "<div {r}>{b}</div>"]
_MARK = "data-kept-by-rule"
_KEPT = f"{_MARK}=1"


def _random_name(rng: np.random.Generator) -> str:
    """An attribute that says nothing."""
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(1, 8)))
    kind = ("class", "class", "id")[rng.integers(3)]
    return f'{kind}="{word()}{["", "-", "_", " "][rng.integers(4)]}{word() if rng.random() < 0.5 else int(rng.integers(99))}"'


def _telling_name(rng: np.random.Generator) -> str:
    words = [_NOISE[rng.integers(len(_NOISE))], *(["box", "block", "list", "wrap", "area", "item", "inner", "left", "top"][i] for i in rng.integers(0, 9, rng.integers(0, 2)))]
    rng.shuffle(words)
    return f'{("class", "class", "id")[rng.integers(3)]}="{("-", "_", " ")[rng.integers(3)].join(words)}"'


def variant(page: str, others: list[str], rng: np.random.Generator) -> str | None:
    """The page with its article in another element, often of a random name, and noise put around and inside. Noise is told by
    its elements or by a telling name; random names stand on what is kept as well as on what is not. Kept parts carry a mark."""
    m = re.search(r"<article\b[^>]*>(.*?)</article>", page, re.S | re.I)
    if not m:
        return None

    def filled(form: str, mark: str = "") -> str:
        w = others[rng.integers(len(others))].split() or ["x"]
        cut = lambda n: entities.escape(" ".join(w[(k := int(rng.integers(len(w)))) : k + int(rng.integers(1, n))]) or w[0])
        names = {"n": _telling_name(rng), "m": _telling_name(rng), "r": _random_name(rng) if rng.random() < 0.5 else "", "t": ("div", "div", "div", "section", "ul", "aside")[rng.integers(6)]}
        out = form.format(a=cut(5), b=cut(60), c=cut(9), **names)
        return re.sub(r"<(\w+)", rf"<\1 {mark}", out) if mark else out

    def noise(most: int) -> str:
        return "".join(filled((_SHAPES if rng.random() < 0.7 else _PLAIN)[rng.integers(8)]) for _ in range(rng.integers(0, most + 1)))

    def told(most: int) -> str:
        return "".join(filled(_SHAPES[rng.integers(len(_SHAPES))] if rng.random() < 0.7 else _PLAIN[rng.integers(1, 7)]) for _ in range(rng.integers(0, most + 1)))

    mark = lambda x: re.sub(r"<(\w+)", lambda t: f"<{t[1]} {_KEPT} {_random_name(rng) if rng.random() < 0.1 else ''}", x)
    parts = re.split(r"(?=<p\b)", m[1])
    body = "".join(mark(x) + (filled(_INSIDE[rng.integers(len(_INSIDE))], _KEPT) if rng.random() < 0.15 else "") + (told(1) if rng.random() < 0.15 else "") for x in parts)
    box = _CONTAINERS[rng.integers(len(_CONTAINERS))]
    if rng.random() < 0.4:
        box = f"<{('div', 'section', 'div')[rng.integers(3)]} {_random_name(rng)}>"
    ends = "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z]+)", box)))
    article = re.sub(r"<(\w+)", rf"<\1 {_KEPT}", box) + body + told(1) + ends
    before, after = page[: m.start()], page[m.end() :]
    mid = noise(3) + article + noise(4)
    for _ in range(rng.integers(0, 3)):
        mid = f'<div {_KEPT} {_random_name(rng) if rng.random() < 0.5 else ("class=wrapper", "class=container", "id=page", "class=row")[rng.integers(4)]}>{mid}</div>'
    return before + mid + after


def labelled(page: str) -> tuple[list[Node], np.ndarray]:
    """Nodes and labels: marked nodes of a variant; else what stands in the page's article element. The mark is taken out."""
    nodes = parse(page)
    if _MARK in page:
        y = [_MARK in x.attrs for x in nodes]
    else:
        y = []
        for x in nodes:
            y.append(x.tag == "article" or bool(x.parent) and y[x.parent.order] and x.tag not in ("nav", "aside", "form", "footer", "header"))
    for x in nodes:
        x.attrs = x.attrs.replace(_KEPT, "")
    return nodes, np.array(y, float)


def train(pages: list[str], variants: int = 3, seed: int = 17) -> Trees:
    """Pages without an article element teach nothing; if there are no others, the model keeps no text."""
    rng = np.random.default_rng(seed)
    texts = [re.sub(r"<[^>]*>", " ", p[-6000:])[-3000:] for p in pages] or ["x"]
    made_pages, ys, ws = [], [], []
    for page in pages:
        for k in range(variants + 1):
            made = page if not k else variant(page, texts, rng)
            if made is None or not k and not re.search(r"<article\b", page, re.I):
                continue
            nodes, y = labelled(made)
            made_pages.append(nodes)
            ys.append(y)
            ws.append(np.array([0.2 + np.log1p(x.own) for x in nodes]) / len(nodes) * 10)
    model = Trees()
    if not made_pages:
        return model
    tokens = [node_tokens(nodes) for nodes in made_pages]
    # the trees see tokens weighed on the other half of the pages, so that they learn how far to trust them
    half = np.arange(len(made_pages)) // (variants + 1) % 2 == 0
    pick = lambda xs, side: [x for x, h in zip(xs, half) if h == side]
    odds = [token_odds([t for own in pick(tokens, side) for t in own], np.concatenate(pick(ys, side) or [np.zeros(0)])) for side in (False, True)]
    model.tokens = token_odds([t for own in tokens for t in own], np.concatenate(ys))
    xs = [features(nodes, own, odds[not h]) for nodes, own, h in zip(made_pages, tokens, half)]
    return model.fit(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def fit(pages: DataFrame, sample: int = SAMPLE) -> Trees:
    """Train on at most `sample` pages, those of the least row hashes."""
    rows = C.sampled(pages.filter("html IS NOT NULL"), sample).select("html").collect()
    return train([r["html"] for r in rows])


def extract(pages: DataFrame, model: Trees) -> DataFrame:
    """pages (html, any other columns) without html, with text and n_chars (its code points).

    Null and empty html, and pages without an article, give text "". Text nodes are decoded, white space in a block becomes
    one space, blocks are joined by a line feed in page order; nothing else is dropped or cut, however long the page.
    Repeated rows give equal texts; input columns named text or n_chars are replaced; an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    carried = pages.drop("text", "n_chars")
    kept = [c for c in carried.columns if c != "html"]

    def run(batches):
        trees = pickle.loads(shared.value)
        for batch in C.pieces(batches, rows=500, mb=8):
            pages_here = [x or "" for x in batch.column("html").to_pylist()]
            texts = [t for lo in range(0, len(pages_here), 64) for t in main_texts(pages_here[lo : lo + 64], trees)]
            cols = [*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "text", "n_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema if f.name in kept), "text string, n_chars long"])
    return carried.mapInArrow(run, schema)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", "n_chars")
