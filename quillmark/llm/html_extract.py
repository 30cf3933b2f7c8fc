"""Main text of web pages: gradient-boosted trees over DOM-node features, and a decoding that fits the tree.

A lenient parser makes the DOM; each run of text between block borders is a leaf. Each node gets features of its
tag, its class and id tokens, its subtree (text, links, density), its depth and its siblings, and boosted trees give
the probability that it holds main text. Decoding picks the likeliest labels in which no node is kept under one that
isn't, so ancestors and descendants can't contradict each other. Kept leaves, in page order, are the text.

The trees are trained here, on pages that a generator makes from a fixed seed: articles in varied wrappers amid
menus, headers, footers, sidebars, notices, adverts, forms and reader comments, with and without telling names.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import common

# Element names of the HTML standard by their role, and name tokens that pages use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object head select textarea button canvas audio video".split())
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr details summary center legend hgroup dialog".split()
)
CLOSES_P = BLOCK - frozenset("html body td th tr thead tbody tfoot caption summary legend".split())
#: Start tags that end an open element of these names, up to the given border.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
GROUPS = ("article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "nav", "header", "footer", "aside", "form fieldset legend dialog", "table tr td th tbody thead", "blockquote pre", "figure figcaption", "html body", "#text")
NAMES = {
    "content": "content article post entry main body story text page single",
    "menu": "nav menu navbar breadcrumb breadcrumbs toc pagination pager tabs topbar links skip",
    "side": "sidebar side widget related recommended popular trending more rail tags social share sharing author bio",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner commercial adsense partner",
    "notice": "cookie cookies consent notice alert popup modal overlay newsletter subscribe signup gdpr privacy toast",
    "comment": "comment comments reply replies discussion discuss respond disqus reader feedback",
    "head": "header head masthead top logo brand site",
    "foot": "footer foot bottom copyright legal credits",
    "form": "form search login register contact input",
}
_GROUP_OF = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
_NAME_OF = {t: i for i, g in enumerate(NAMES.values()) for t in g.split()}
_ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "main": "main", "search": "form", "dialog": "dialog", "alert": "notice", "article": "article"}

#: Elements whose content is never markup, so that one that isn't closed takes the rest of the page.
PLAIN = frozenset("script style textarea title noscript".split())
#: Elements that end an open `p` only up to these.
P_BORDERS = ("td", "th", "table", "li", "div", "article", "section", "body")

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_QUOTE = re.compile("[\"']")
_END = {n: re.compile(rf"</{n}(?=[\s/>])" + (rf"|<{n}(?=[\s/>])" if n in ("button", "select") else ""), re.I) for n in RAW | PLAIN}
_ATTRIBUTE = re.compile(r"(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_TOKEN, _TARGET = re.compile(r"[a-z]+"), re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)


class Node:
    __slots__ = ("ahead", "children", "depth", "hidden", "link", "names", "parent", "tag", "text")

    def __init__(self, tag: str, parent: int, depth: int, names: tuple = (), text: str | None = None, link: int = 0, hidden: bool = False):
        self.tag, self.parent, self.depth, self.names, self.text, self.link, self.hidden = tag, parent, depth, names, text, link, hidden
        self.children: list[int] = []
        self.ahead = 0


def _attributes(raw: str) -> tuple[tuple, bool, str | None]:
    """(kinds of the class and id tokens, hidden, role)."""
    kinds, hidden, role = set(), False, None
    for name, *values in _ATTRIBUTE.findall(raw):
        value, name = next((v for v in values if v), ""), name.lower()
        if name in ("class", "id"):
            kinds |= {_NAME_OF[t] for t in _TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if t in _NAME_OF}
        elif name == "role":
            role = value.lower()
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            hidden |= value.lower() != "false"
    return tuple(kinds), hidden, role


class _Ends:
    """Where tags end: at the first `>` outside quotes. Once a quotation mark turns out to have no partner up to the
    last `>`, the first `>` counts in the rest of the page, so that no stretch is searched again and again."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def find(self, at: int) -> int:
        page = self.page
        if at > self.last:
            return -1
        first = end = page.find(">", at)
        while self.quotes and (m := _QUOTE.search(page, at, end)):
            shut = page.find(m[0], m.end())
            if shut < 0 or shut > self.last:
                self.quotes = False
                return first
            at = shut + 1
            if shut > end:
                end = page.find(">", at)
        return end


class _Opened:
    """Names of open elements, innermost last; each step takes time by what it closes."""

    def __init__(self, *names: str):
        self.names: list[str] = []
        self.at: dict[str, list[int]] = {}
        for n in names:
            self.push(n)

    def push(self, name: str) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        self.names.append(name)

    def last(self, *names: str) -> int:
        """Place of the innermost one that has any of the names; -1 if there is none."""
        best = -1
        for n in names:
            if (at := self.at.get(n)) and at[-1] > best:
                best = at[-1]
        return best

    def first_behind(self, place: int, names: set[str]) -> int:
        """Place of the outermost one behind a place that has any of the names; -1 if there is none."""
        found = [at[k] for n in names if (at := self.at.get(n)) and (k := bisect_right(at, place)) < len(at)]
        return min(found, default=-1)

    def cut(self, place: int) -> None:
        names = self.names
        while len(names) > place:
            self.at[names.pop()].pop()


def parse(page: str) -> list[Node]:
    """The DOM in document order, node 0 the root; text leaves are `#text` nodes with white space made single.

    Takes time linear in the page, whatever is left open in it. Content of RAW elements is left out; one that isn't
    closed before its enclosing block loses its tag only, unless its content is PLAIN."""
    nodes = [Node("html", -1, 0)]
    stack, blocks, inline, ends = [0], _Opened(""), _Opened(), _Ends(page)
    unclosed: set[str] = set()
    pieces: list[str] = []
    linked, plain = 0, 0
    position, end = 0, len(page)

    def leaf() -> None:
        nonlocal linked, plain
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                share = linked / max(1, linked + plain)
                at = stack[-1]
                nodes[at].children.append(len(nodes))
                nodes.append(Node("#text", at, nodes[at].depth + 1, text=text, link=round(share * len(text))))
            pieces.clear()
        linked = plain = 0

    def close(place: int) -> None:
        del stack[place:]
        blocks.cut(place)

    def words(x: int, y: int) -> None:
        nonlocal linked, plain
        if y > x:
            pieces.append(page[x:y])
            if inline.last("a") >= 0:
                linked += y - x
            else:
                plain += y - x

    def behind(name: str, at: int, slash: bool) -> int:
        """Where to go on after the start tag, ending at `at`, of a RAW element or a title."""
        if name not in PLAIN and (slash or name in unclosed):
            return at
        shut = _END[name].search(page, at)
        if shut is None:
            unclosed.add(name)
            return end if name in PLAIN else at
        if name not in PLAIN and name != "head":
            up = blocks.names[-1].lstrip("#")
            around = re.findall(rf"<(/?){up}(?=[\s/>])", page[at : shut.start()], re.I) if up else []
            if 2 * around.count("/") > len(around):
                unclosed.add(name)
                return at
        if page[shut.start() + 1] != "/":  # another start tag, which ends this one
            return shut.start()
        to = page.find(">", shut.end())
        return to + 1 if to >= 0 else end

    while position < end:
        m = _OPEN.search(page, position)
        if m is None:
            words(position, end)
            break
        if m[1]:
            words(position, m.start())
            shut = page.find("-->", m.end())
            position = shut + 3 if shut >= 0 else end
            continue
        shut = ends.find(m.end()) if m[3] else page.find(">", m.end()) if m.end() <= ends.last else -1
        if shut < 0:  # no tag ends any more
            rest = page.find("<!--", m.end())
            words(position, rest if rest >= 0 else end)
            break
        words(position, m.start())
        position = shut + 1
        if not m[3]:
            continue
        name, raw = m[3].lower(), page[m.end() : shut]
        if m[2]:
            if name in BLOCK:
                place = blocks.last(name, "#" + name)
                if place > 0:
                    leaf()
                    close(place)
                inline.cut(0)
            elif (place := inline.last(name, "#" + name)) >= 0:
                inline.cut(place)
            continue
        if name in RAW or name == "title":
            position = behind(name, position, raw.endswith("/"))
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in VOID and name != "hr":
            continue
        if name not in BLOCK:
            # a slash ends void elements only; an anchor without a target is no link
            inline.push(name if name != "a" or _TARGET.search(raw) else "#a")
            continue
        leaf()
        inline.cut(0)
        if name in CLOSES_P and (place := blocks.last("p")) > 0 and place > blocks.last(*P_BORDERS):
            close(place)
        if name in CLOSES:
            which, border = CLOSES[name]
            edge = max(0, blocks.last(*border))
            place = blocks.first_behind(edge, which) if name == "tr" else blocks.last(*which)
            if place > edge:
                close(place)
        if name == "hr" or name == "html":
            continue
        kinds, hidden, role = _attributes(raw) if raw else ((), False, None)
        tag = _ROLES.get(role, name) if role else name
        if tag == "notice":
            tag, kinds = name, (*kinds, list(NAMES).index("notice"))
        at = stack[-1]
        nodes[at].children.append(len(nodes))
        stack.append(len(nodes))
        nodes.append(Node(tag if tag == name else "#" + name, at, nodes[at].depth + 1, kinds, hidden=hidden))
        blocks.push(nodes[-1].tag)
        if tag != name:
            nodes[-1].names = (*kinds, -1 - _GROUP_OF[tag]) if tag in _GROUP_OF else kinds
    leaf()
    return nodes


N_TAGS, N_NAMES = len(GROUPS), len(NAMES)
#: Bits of tags and names that speak against main text, and for it.
_BESIDE = sum(1 << _GROUP_OF[t] for t in ("nav", "header", "footer", "aside", "form")) | sum(1 << N_TAGS + i for i, n in enumerate(NAMES) if n != "content")
_WITHIN = 1 << _GROUP_OF["article"] | 1 << N_TAGS + list(NAMES).index("content")
N_FEATURES = N_TAGS + 2 * N_NAMES + N_TAGS + 23


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    x = np.zeros((n, N_FEATURES), np.float32)
    text = np.array([len(v.text) if v.text else 0 for v in nodes], np.float64)
    link = np.array([v.link for v in nodes], np.float64)
    leaves = (text > 0).astype(np.float64)
    stops = [float(sum(map(v.text.count, ".!?"))) if v.text else 0.0 for v in nodes]
    columns = [text.tolist(), link.tolist(), leaves.tolist(), stops, [float(v.tag == "p") for v in nodes], [1.0] * n]
    up = [v.parent for v in nodes]
    for a in columns:  # sums over subtrees
        for i in range(n - 1, 0, -1):
            a[up[i]] += a[i]
    total, links, kids, ends, ps, size = map(np.array, columns)
    own, above = [], []  # bits: tag groups, then kinds of names; of the node, and of what stands above it
    for v in nodes:
        tag = v.tag if v.tag == "#text" else v.tag.lstrip("#")
        bits = 1 << _GROUP_OF[tag] if tag in _GROUP_OF else 0
        for k in v.names:
            bits |= 1 << (N_TAGS + k if k >= 0 else -1 - k)
        above.append(own[v.parent] | above[v.parent] if v.parent >= 0 else 0)
        own.append(bits)
    bit = np.arange(N_TAGS + N_NAMES)
    x[:, : N_TAGS + N_NAMES] = np.array(own, np.int64)[:, None] >> bit & 1
    over = np.array(above, np.int64)[:, None] >> bit & 1
    x[:, N_TAGS + N_NAMES : N_TAGS + 2 * N_NAMES] = over[:, N_TAGS:]
    x[:, N_TAGS + 2 * N_NAMES : 2 * N_TAGS + 2 * N_NAMES] = over[:, :N_TAGS]
    lo = 2 * N_TAGS + 2 * N_NAMES
    x[:, lo] = np.log1p(total)
    x[:, lo + 1] = links / np.maximum(total, 1)
    x[:, lo + 2] = total / size
    x[:, lo + 3] = total / max(1, total[0])
    x[:, lo + 4] = [v.depth for v in nodes]
    x[:, lo + 5] = np.log1p(kids)
    x[:, lo + 6] = total / np.maximum(kids, 1)
    x[:, lo + 7] = ends / np.maximum(total, 1) * 100
    x[:, lo + 8] = np.log1p(ps)
    x[:, lo + 9] = np.log1p(size)
    x[:, lo + 15] = [v.hidden for v in nodes]
    for k, marks in ((21, _BESIDE), (22, _WITHIN)):  # how much in a node's own path speaks for each side
        x[:, lo + k] = [((a | b) & marks).bit_count() for a, b in zip(own, above, strict=True)]
    above = np.maximum(0, up)  # what a node stands in: link share and text of its parent and of the parent's parent
    for k in (17, 19):
        x[:, lo + k], x[:, lo + k + 1] = x[above, lo + 1], x[above, lo]
        above = np.maximum(0, np.array(up))[above]
    inner = [i for i, v in enumerate(nodes) if v.tag != "#text" and v.depth > 1]
    x[:, lo + 16] = total / max(1.0, total[inner].max(initial=1 if not inner else 0))
    child = np.array([c for v in nodes for c in v.children], np.int64)
    if len(child):  # siblings stand together
        counts = np.array([len(v.children) for v in nodes if v.children])
        begin = np.r_[0, counts.cumsum()[:-1]]
        k, place = np.repeat(counts, counts), np.arange(len(child)) - np.repeat(begin, counts)
        held = total[child]
        logs = np.log1p(held)
        x[child, lo + 10] = k
        x[child, lo + 11] = place / np.maximum(1, k - 1)
        x[child, lo + 12] = np.where(place > 0, np.r_[0, logs[:-1]], -1)
        x[child, lo + 13] = np.where(place + 1 < k, np.r_[logs[1:], 0], -1)
        x[child, lo + 14] = held / np.maximum(1.0, np.repeat(np.maximum.reduceat(held, begin), counts))
    return x


class Boosted:
    """Gradient-boosted trees for a yes-or-no target, fit by histograms."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 8.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
        width = self.bins
        flat = binned + np.arange(x.shape[1]) * width
        self.base = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        f = np.full(len(x), self.base)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(x), np.int64)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            for node in range(size):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = self.rate * gs / (hs + 1)
                if node < 2**self.depth - 1 and hs > 2 * self.least * 0.05:
                    keys = flat[rows].ravel()
                    k = x.shape[1]
                    gh = np.bincount(keys, np.repeat(g[rows], k), k * width).reshape(k, width).cumsum(1)
                    hh = np.bincount(keys, np.repeat(h[rows], k), k * width).reshape(k, width).cumsum(1)
                    nn = np.bincount(keys, minlength=k * width).reshape(k, width).cumsum(1)
                    gain = gh**2 / (hh + 1) + (gs - gh) ** 2 / (hs - hh + 1) - gs**2 / (hs + 1)
                    gain[(nn < self.least) | (len(rows) - nn < self.least)] = -1
                    best = int(gain.argmax())
                    j, b = divmod(best, width)
                    if gain[j, b] > 1e-3 and b < len(cuts[j]):
                        feature[node], cut[node] = j, cuts[j][b]
                        at[rows] = 2 * node + 1 + (binned[rows, j] > b)
            f += value[at]
            self.trees.append((feature, cut, value))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = feature[at]
                at = np.where(j < 0, at, 2 * at + 1 + (x[np.arange(len(x)), j] > cut[at]))
            f += value[at]
        return 1 / (1 + np.exp(-f))


def decode(nodes: list[Node], p: np.ndarray) -> np.ndarray:
    """The likeliest labels with no kept node under one that isn't; the root is kept."""
    q = np.clip(p, 1e-6, 1 - 1e-6)
    yes, no = np.log(q).tolist(), np.log(1 - q).tolist()
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        yes[up] += max(yes[i], no[i])
        no[up] += no[i]
    kept = [True]
    for i in range(1, len(nodes)):
        kept.append(kept[nodes[i].parent] and yes[i] > no[i])
    return np.array(kept)


#: Put before main text by the generator of training pages, and taken out before features are made.
_MARK = "\ue000"


def training_pages(count: int, seed: int) -> list[str]:
    """Pages with marked main text."""
    rng = random.Random(seed)
    syllables = "an be ci do er fa gi ho in ka lo mu ne ou pre qui re sta th un ver wa".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def sentence() -> str:
        return phrase(3, 18).capitalize() + rng.choice(".....!?")

    def prose(a: int, b: int) -> str:
        return " ".join(sentence() for _ in range(rng.randint(a, b)))

    def named(*names: str) -> str:
        """An attribute with one of the names, or none."""
        if rng.random() < 0.3:
            return ""
        return f' {rng.choice(["class", "id"])}="{rng.choice(["", "", "site-", "the ", "page-"])}{rng.choice(names)}{rng.choice(["", "", "-box", " wide", "-1"])}"'

    def links(tag: str, a: int, b: int) -> str:
        items = [f'<a href="/{word()}">{phrase(1, 4)}{rng.choice(["", "", "", ".", ",", "!"])}</a>' for _ in range(rng.randint(a, b))]
        return f"<{tag}>" + "".join(f"<li>{x}</li>" for x in items) + f"</{tag}>" if tag else " | ".join(items)

    def menu() -> str:
        inner = links(rng.choice(["ul", "ul", "ol", ""]), 2, 9)
        return rng.choice([f"<nav{named('menu', 'nav')}>{inner}</nav>", f"<nav>{inner}</nav>", f"<div class=\"{rng.choice(['menu', 'navbar', 'nav', 'breadcrumb', 'topbar'])}\">{inner}</div>", f'<div role="navigation">{inner}</div>'])

    def advert() -> str:
        tag, text = rng.choice(["div", "div", "aside", "section", "p"]), rng.choice([phrase(2, 12), sentence(), prose(1, 3), f'<a href="#">{phrase(2, 9)}</a>', f"<p>{prose(1, 3)}</p>"])
        return f"<{tag} {rng.choice(['class', 'class', 'id'])}=\"{rng.choice(['ad', 'ads', 'advert', 'sponsored', 'promo', 'banner', 'ad-box', 'advertisement', 'partner-ad'])}\">{text}</{tag}>"

    def notice() -> str:
        tag = rng.choice(["div", "div", "section", "aside", "p"])
        return f"<{tag} {rng.choice(['class', 'id'])}=\"{rng.choice(['cookie-notice', 'consent', 'notice', 'alert', 'newsletter', 'popup', 'cookies', 'subscribe', 'gdpr'])}\">{rng.choice([prose(1, 3), f'<p>{prose(1, 3)}</p>'])}</{tag}>"

    def side() -> str:
        inner = "".join(rng.choice([f"<h3>{phrase(1, 4)}</h3>{links('ul', 2, 8)}", f"<p>{prose(1, 3)}</p>", f"<div>{prose(1, 2)}</div>", links("ul", 2, 6)]) for _ in range(rng.randint(1, 3)))
        return rng.choice([f"<aside{named('sidebar', 'side', 'related', 'widget')}>{inner}</aside>", f"<div class=\"{rng.choice(['sidebar', 'related', 'widget', 'side', 'rail', 'share', 'popular'])}\">{inner}</div>"])

    def comments() -> str:
        one = lambda: rng.choice(["<div class=\"comment\"><b>{0}</b><p>{1}</p></div>", "<li><p>{1}</p></li>", "<p>{1}</p>", "<article class=\"comment\"><p>{1}</p></article>", "<div><span>{0}</span> {1}</div>"]).format(phrase(1, 2), prose(1, 6))
        inner = (f"<h{rng.randint(2, 4)}>{phrase(1, 3)}</h{3}>" if rng.random() < 0.6 else "") + "".join(one() for _ in range(rng.randint(1, 6)))
        tag = rng.choice(["div", "section", "section", "ol"])
        return f"<{tag} {rng.choice(['class', 'id'])}=\"{rng.choice(['comments', 'comment-list', 'discussion', 'replies', 'reader-comments', 'respond'])}\">{inner}</{tag}>"

    def form() -> str:
        return f"<form{named('search', 'login', 'contact')}><label>{phrase(1, 4)}</label><input name=\"q\">{rng.choice(['', f'<p>{sentence()}</p>'])}<button>{word()}</button></form>"

    def header() -> str:
        inner = rng.choice([f"<h1>{phrase(1, 3)}</h1>", f"<p>{phrase(2, 8)}</p>", f'<a href="/">{phrase(1, 3)}</a>', f"<div class=\"logo\">{phrase(1, 3)}</div>", f"<h2>{phrase(1, 4)}</h2><p>{sentence()}</p>"]) + (menu() if rng.random() < 0.4 else "")
        return rng.choice([f"<header{named('top', 'masthead')}>{inner}</header>", f"<div class=\"{rng.choice(['header', 'masthead', 'site-header', 'top'])}\">{inner}</div>"])

    def footer() -> str:
        inner = rng.choice([f"&copy; {phrase(1, 3)} &middot; {prose(1, 2)}", f"<p>{prose(1, 3)}</p>", links("ul", 2, 6), phrase(3, 9), f"<div>{links('', 2, 5)}</div><p>&copy; {phrase(2, 6)}</p>"])
        return rng.choice([f"<footer{named('foot', 'bottom')}>{inner}</footer>", f"<footer>{inner}</footer>", f"<div class=\"{rng.choice(['footer', 'foot', 'copyright', 'legal'])}\">{inner}</div>"])

    def inline(text: str) -> str:
        if rng.random() < 0.4:
            text = rng.choice(["<b>{}", "<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>"]).format(text[: rng.randint(1, len(text))]) + rng.choice(["", "<br>"]) + _MARK + text
        return text

    def anchor() -> str:
        return f'<a href="/{word()}">{_MARK}{phrase(1, 7)}{rng.choice(["", "", "."])}</a>'

    def box(chance: float) -> str:
        """A class or id of a box of the article, or none."""
        names = ["info", "message", "warning", "note", "box", "tip", "highlight", "summary", "lead", "quote", "sources", "references", "key-points", word(), word()]
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"' if rng.random() < chance else ""

    def content() -> list[str]:
        out = []
        if rng.random() < 0.75:
            h = rng.choice(["h1", "h1", "h2"])
            out.append(f"<{h}>{_MARK}{phrase(2, 12)}</{h}>")
        most = rng.choice([2, 4, 8, 20])
        for _ in range(rng.randint(1, most)):
            kind = rng.random()
            if kind < 0.72:
                out.append(f"<p>{_MARK}{inline(prose(1, rng.choice([1, 2, 6, 12])))}{rng.choice(['</p>', '</p>', '</p>', ''])}")
            elif kind < 0.78:
                out.append(f"<h3>{_MARK}{phrase(1, 7)}</h3>")
            elif kind < 0.84:
                tag = rng.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{_MARK}{phrase(2, 15)}" for _ in range(rng.randint(2, 6))) + f"</{tag}>")
            elif kind < 0.88:
                out.append(f"<blockquote>{_MARK}{prose(1, 3)}</blockquote>")
            elif kind < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{_MARK}{phrase(1, 4)}</td><td>{_MARK}{phrase(1, 4)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>")
            elif kind < 0.94:
                out.append(f"<div>{_MARK}{prose(1, 5)}</div>")
            elif kind < 0.96:
                out.append(f"<pre>{_MARK}{phrase(4, 20)}</pre>")
            else:
                out.append(f"<figure><img src=x><figcaption>{_MARK}{phrase(3, 12)}</figcaption></figure>")
            kind = rng.random()  # what stands in articles too: links by themselves, lists of sources, boxes
            if kind < 0.06:
                out.append(f"<p>{anchor()}</p>")
            elif kind < 0.12:
                tag = rng.choice(["ul", "ul", "ol"])
                out.append(rng.choice(["", f"<h3>{_MARK}{phrase(1, 3)}</h3>"]) + f"<{tag}{box(0.2)}>" + "".join(f"<li>{anchor()}{rng.choice(['', '', ' ' + phrase(1, 6)])}</li>" for _ in range(rng.randint(1, 8))) + f"</{tag}>")
            elif kind < 0.2:
                tag = rng.choice(["div", "div", "p", "section"])
                inner = _MARK + rng.choice([phrase(3, 12), prose(1, 3), prose(1, 2)])
                out.append(f"<{tag}{box(0.85)}>{inner if tag == 'p' or rng.random() < 0.4 else f'<p>{inner}</p>'}</{tag}>")
            elif kind < 0.23:
                out.append(f"<section{box(0.3)}><h2>{_MARK}{phrase(1, 6)}</h2>" + "".join(f"<p>{_MARK}{prose(1, 5)}</p>" for _ in range(rng.randint(1, 3))) + "</section>")
        for extra, chance in ((advert, 0.2), (side, 0.12), (notice, 0.08), (form, 0.05), (comments, 0.12)):
            if rng.random() < chance:
                out.insert(rng.randint(0, len(out)) if extra is not comments else len(out), extra())
        return out

    def article() -> str:
        inner = "".join(content())
        tag = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
        attr = "" if rng.random() < (0.6 if tag in ("article", "main") else 0.3) else f" {rng.choice(['class', 'id'])}=\"{rng.choice(['content', 'post', 'entry-content', 'article', 'story', 'main', 'text', 'post-body'])}\""
        body = f"<{tag}{attr}>{inner}</{tag}>"
        if rng.random() < 0.3:
            outer = rng.choice(["main", "div", "div class=\"wrapper\"", "div id=\"page\""])
            rest = "".join(f() for f in rng.sample([side, comments, advert, form], rng.randint(0, 2)))
            body = f"<{outer}>{body}{rest}</{outer.split()[0]}>"
        return body

    pages = []
    for _ in range(count):
        before = [f() for f, c in ((header, 0.5), (menu, 0.7), (notice, 0.25), (advert, 0.5), (form, 0.15), (side, 0.1)) if rng.random() < c]
        behind = [f() for f, c in ((advert, 0.3), (side, 0.3), (comments, 0.35), (form, 0.15), (notice, 0.15), (menu, 0.1)) if rng.random() < c]
        if rng.random() < 0.3:
            rng.shuffle(before)
        if rng.random() < 0.3:
            rng.shuffle(behind)
        end = [footer()] if rng.random() < 0.85 else []
        pages.append("<html><body>" + "".join([*before, article(), *behind, *end]) + rng.choice(["</body></html>", "", "</body>"]))
    return pages


#: Training pages, their seed, rounds of boosting and depth of its trees; nodes of pages that are judged at once, about.
PAGES, SEED, ROUNDS, DEPTH, NODES = 600, 20, 60, 4, 20_000


def labelled(page: str) -> tuple[list[Node], np.ndarray]:
    """Nodes and labels of a marked page: 1 where a node holds main text."""
    nodes = parse(page)
    y = np.zeros(len(nodes))
    for i, v in enumerate(nodes):
        if v.text is not None and _MARK in v.text:
            v.text = v.text.replace(_MARK, "")
            while i >= 0 and not y[i]:
                y[i] = 1
                i = nodes[i].parent
    return nodes, y


@cache
def trained(pages: int = PAGES, seed: int = SEED) -> Boosted:
    got = [labelled(p) for p in training_pages(pages, seed)]
    return Boosted(ROUNDS, DEPTH).fit(np.concatenate([features(n) for n, _ in got]), np.concatenate([y for _, y in got]))


def main_texts(pages: list, model: Boosted) -> list[str]:
    """The main text of each page (null: empty)."""
    out: list[str] = []
    waiting: list[list[Node]] = []

    def flush() -> None:
        p = model.probability(np.concatenate([features(d) for d in waiting]))
        at = 0
        for d in waiting:
            kept = decode(d, p[at : at + len(d)])
            at += len(d)
            out.append("\n\n".join(v.text for v, k in zip(d, kept.tolist(), strict=True) if k and v.text))
        waiting.clear()

    for page in pages:
        waiting.append(parse(page or ""))
        if sum(map(len, waiting)) > NODES:
            flush()
    if waiting:
        flush()
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row of pages; null or empty html gives the empty text. Null and repeated
    ids are rows like any other; an empty table gives no rows; other columns are ignored. Very long pages are read
    whole, in time linear in them."""
    common.ship(pages.sparkSession)
    model = trained()
    state = (model.base, model.depth, model.trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.only("html_extract")
        own = Boosted(depth=state[1])
        own.base, own.trees = state[0], state[2]
        for batch in batches:
            for x in range(0, batch.num_rows, 200):
                rows = batch.slice(x, 200)
                texts = main_texts(rows.column(2).to_pylist(), own)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).alias(url_col), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
