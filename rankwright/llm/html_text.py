"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the hierarchy.

A page becomes a tree of block elements.  Boosted trees give each node a
probability of being main content from its own, its siblings' and its subtree's
statistics and its attribute tokens.  The decoding then finds the most probable
labelling in which no node is content below one that is not.  The trees are
fitted on pages that ``training_pages`` makes up, so no labelled table is needed.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require_columns, small_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label|itemprop|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
LABEL = re.compile(r"data-y=\"([01])\"")
WORD = re.compile(r"[a-z]+")

#: What a browser never shows as text of the page, read over up to its end tag; without one, those in RAW take all that
#: follows, as in a browser, and the others nothing.
SILENT = frozenset("script style template noscript head textarea select iframe canvas audio video".split())
RAW = frozenset("script style noscript textarea iframe".split())
#: What may stand in a head; anything else ends a head whose end tag is left out.
HEAD = frozenset("html head title base link meta script style noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label link mark meta output q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr button object svg math".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks whose start ends an open paragraph, as the HTML standard has it.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: Element -> elements whose open end tag its start implies, and where the search stops.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
}
TAG_GROUPS = (
    ("nav", "menu"), ("header", "hgroup"), ("footer",), ("aside",), ("article", "main"), ("section",), ("div", "center"), ("p",),
    ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("form", "fieldset"), ("table", "tbody", "tr", "td", "th"),
    ("blockquote", "pre", "figure", "figcaption"), ("html", "body"), ("dialog", "details"),
)
#: Attribute tokens by what they speak for.
TOKEN_GROUPS = (
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc",
    "header masthead topbar banner hero logo",
    "footer copyright colophon bottom legal",
    "sidebar aside rail widget complementary",
    "ad ads advert adverts advertisement advertising promo promotion sponsor sponsored adsense dfp",
    "cookie cookies consent notice gdpr popup modal overlay alert dialog paywall",
    "comment comments reply replies disqus respond discussion commentlist",
    "form login search subscribe newsletter signup register contact",
    "share sharing social tweet follow",
    "related recommended popular trending more latest tags",
    "content article post main entry story body text page prose",
    "title headline heading lead summary author byline",
)
_TAG = {t: k for k, group in enumerate(TAG_GROUPS) for t in group}
_TOKEN = {t: k for k, group in enumerate(TOKEN_GROUPS) for t in group.split()}
N_TAGS, N_TOKENS, N_PLAIN = len(TAG_GROUPS), len(TOKEN_GROUPS), 15
N_FEATURES = N_PLAIN + 2 * (N_TAGS + N_TOKENS)


class _Open:
    """The open elements, innermost last, and where those of a name stand: every question is answered by a search in a
    sorted list, however many are open."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.places: dict[str, list[int]] = {"html": [0]}
        self.blocks = [0]
        self.links = 0

    def node(self) -> int:
        return self.stack[-1][1]

    def push(self, name: str, node: int) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.links += name == "a"
        self.stack.append((name, node))

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            name, _ = self.stack.pop()
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()
            self.links -= name == "a"

    def last(self, name: str) -> int:
        """Place of the innermost element of that name, 0 if there is none but the root."""
        places = self.places.get(name)
        return places[-1] if places else 0

    def end(self, name: str) -> None:
        """An end tag closes the innermost element of its name; one of an inline element doesn't reach over blocks."""
        place = self.last(name)
        if place and (name not in INLINE or place > self.blocks[-1]):
            self.pop_to(place)

    def end_implied(self, name: str) -> None:
        """Close what the start of a block closes by itself."""
        if name in ENDS_P and (place := self.last("p")) and place == self.blocks[-1]:
            self.pop_to(place)
        if name in IMPLIED:
            ended, stop = IMPLIED[name]
            floor = max(self.last(x) for x in stop)
            inside = (places[k] for x in ended if (places := self.places.get(x)) and (k := bisect_right(places, floor)) < len(places))
            if lowest := min(inside, default=0):
                self.pop_to(lowest)


class Page:
    """Block elements of a page in document order, and its text runs with the node that holds each."""

    __slots__ = ("parent", "tag", "tokens", "label", "runs")

    def __init__(self, html: str):
        self.parent, self.tag, self.tokens, self.label = [-1], ["html"], [0], [1]
        self.runs: list[tuple[int, str, bool]] = []
        open_ = _Open()
        at, n, in_head = 0, len(html), False
        unclosed: set[str] = set()
        find = TOKEN.search
        while at < n:
            m = find(html, at)
            start = n if m is None else m.start()
            if start > at:
                raw = html[at:start]
                if not in_head or not raw.isspace():
                    in_head = False
                    self.runs.append((open_.node(), unescape(raw) if "&" in raw else raw, open_.links > 0))
            if m is None:
                break
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name, ends, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if in_head:
                if name == "title" and not ends:
                    closing = None if "title" in unclosed else re.compile(r"</title\b[^>]*>", re.I).search(html, at)
                    if closing:
                        at = closing.end()
                    else:  # nor have any of those that follow an end
                        unclosed.add("title")
                    continue
                in_head = name in HEAD
                if in_head and (ends or name not in SILENT):
                    continue
            if ends:
                open_.end(name)
            elif name in SILENT:
                if attributes.endswith("/") and name not in ("script", "style"):
                    continue
                closing = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                if closing:
                    at = closing.end()
                elif name in RAW:
                    at = n
                else:  # what holds for this place holds for all later ones
                    unclosed.add(name)
                    in_head = in_head or name == "head"
            elif name == "br":
                self.runs.append((open_.node(), " ", False))
            elif name in INLINE:
                if name not in VOID and not attributes.endswith("/"):
                    open_.push(name, open_.node())
            elif name not in ("html", "body") or not open_.places.get(name):
                self._start(open_, name, attributes)

    def _start(self, open_: _Open, name: str, attributes: str) -> None:
        open_.end_implied(name)
        tokens, label = 0, self.label[open_.node()]
        if "=" in attributes:
            for value in ATTRIBUTE.findall(attributes):
                for word in WORD.findall("".join(value).lower()):
                    k = _TOKEN.get(word)
                    if k is not None:
                        tokens |= 1 << k
            marked = LABEL.search(attributes)
            if marked:
                label = min(label, int(marked[1]))
        self.parent.append(open_.node())
        self.tag.append(name)
        self.tokens.append(tokens)
        self.label.append(label)
        if name not in VOID:
            open_.push(name, len(self.tag) - 1)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own = np.zeros(n)
        linked, marks, begin = np.zeros(n), np.zeros(n), np.full(n, -1.0)
        at = 0
        for node, text, in_link in self.runs:
            size = len(text.strip())
            if size:
                if begin[node] < 0:
                    begin[node] = at
                own[node] += size
                linked[node] += size * in_link
                marks[node] += text.count(".") + text.count(",")
                at += size
        parent = np.array(self.parent)
        size, link, blocks, paras = own.copy(), linked.copy(), np.ones(n), np.array([t == "p" for t in self.tag], float)
        depth, tag_up, token_up = np.zeros(n), [0] * n, [0] * n
        kids, nth = np.zeros(n), np.zeros(n)
        tags = [1 << _TAG[t] if t in _TAG else 0 for t in self.tag]
        for k in range(1, n):
            p = parent[k]
            depth[k] = depth[p] + 1
            nth[k] = kids[p]
            kids[p] += 1
            tag_up[k] = tag_up[p] | tags[p]
            token_up[k] = token_up[p] | self.tokens[p]
        for k in range(n - 1, 0, -1):
            p = parent[k]
            size[p] += size[k]
            link[p] += link[k]
            blocks[p] += blocks[k]
            paras[p] += paras[k]
            if begin[k] >= 0 and (begin[p] < 0 or begin[k] < begin[p]):
                begin[p] = begin[k]
        up = np.maximum(parent, 0)
        siblings = kids[up]
        out = np.empty((n, N_FEATURES), np.float32)
        out[:, :N_PLAIN] = np.stack(
            [
                depth, np.log1p(size), link / np.maximum(size, 1), np.log1p(own), np.log1p(blocks), np.log1p(size / blocks), kids,
                nth / np.maximum(siblings, 1), siblings, np.maximum(begin, 0) / max(at, 1), link[up] / np.maximum(size[up], 1),
                np.log1p((size[up] - size) / np.maximum(siblings - 1, 1)), 100 * marks / np.maximum(own, 1), np.log1p(paras), size / max(size[0], 1),
            ],
            1,
        )
        at = N_PLAIN
        for masks, width in ((tags, N_TAGS), (tag_up, N_TAGS), (self.tokens, N_TOKENS), (token_up, N_TOKENS)):
            out[:, at : at + width] = (np.array(masks, np.int64)[:, None] >> np.arange(width)) & 1
            at += width
        return out

    def decode(self, logit: np.ndarray) -> np.ndarray:
        """Most probable labels among those where each content node's parent is content; the root is content."""
        n = len(self.tag)
        yes = -np.logaddexp(0, -logit)
        no = -np.logaddexp(0, logit)
        gain_yes, gain_no = yes.tolist(), no.tolist()
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            gain_yes[p] += max(gain_yes[k], gain_no[k])
            gain_no[p] += gain_no[k]
        keep = [True] * n
        for k in range(1, n):
            keep[k] = keep[self.parent[k]] and gain_yes[k] >= gain_no[k]
        return np.array(keep)

    def text(self, keep) -> str:
        """Kept text: a change of node is a change of block."""
        parts, last = [], -1
        for node, text, _ in self.runs:
            if keep[node]:
                if node != last:
                    parts.append(" ")
                    last = node
                parts.append(text)
            else:
                last = -1
        return " ".join("".join(parts).split())


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: feature and threshold by inner node, value by leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 24, ridge: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss with histograms over quantile bins."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    width = max(map(len, cuts)) + 1
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    n, m = binned.shape
    flat = binned + np.arange(m) * width
    share = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    logit = np.full(n, base)
    inner = (1 << depth) - 1
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            index = ((at - first)[:, None] * (m * width) + flat).ravel()
            sums = [np.bincount(index, np.repeat(v, m), count * m * width).reshape(count, m, width).cumsum(2) for v in (g, h)]
            total = [s[:, :, -1:] for s in sums]
            score = lambda a, b: a * a / (b + ridge)
            gain = score(*sums) + score(total[0] - sums[0], total[1] - sums[1]) - score(*total)
            gain[(sums[1] < 1) | (total[1] - sums[1] < 1)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for node in range(count):
                f, b = divmod(int(best[node]), width)
                if gain[node, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[t, first + node], threshold[t, first + node] = f, cuts[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        leaf = at - inner
        value[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        logit += value[t, leaf]
    return Trees(base, feature, threshold.astype(np.float32), value)


class _Writer:
    """Made-up pages: every element says in data-y whether it is content (1) or not (0)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice("aeiouäéó" if k % 2 else "bcdfghlmnprstvw") for k in range(self.r.choice((1, 2, 3, 4, 5, 6, 7, 9))))

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        junk = self.r.choice(("", "", "", "###", "%%%", "!!", "&amp;&amp;"))
        out = [self.word() + (junk if self.r.random() < 0.8 else "") + ("." if self.r.random() < 0.1 else "") for _ in range(n)]
        text = " ".join(out).capitalize() + self.r.choice((".", ".", ".", "", "!"))
        return text.upper() if self.r.random() < 0.05 else text

    def pick(self, *names: str) -> str:
        return self.r.choice(names)

    def links(self, low: int, high: int) -> str:
        return "".join(f'<li><a href="/{self.word()}">{self.words(1, 3)}</a></li>' for _ in range(self.r.randint(low, high)))

    def paragraph(self) -> str:
        if self.r.random() < 0.15:
            return f"<p>{self.words(1, 2)}{self.pick('</p>', '')}"
        text = self.words(3, self.pick(12, 40, 90))
        if self.r.random() < 0.2:
            text += f' <a href="#">{self.words(1, 4)}</a> {self.words(1, 12)}'
        if self.r.random() < 0.2:
            return f"<p><b>{text}<br>"
        return f"<p>{text}{self.pick('</p>', '</p>', '</p>', '')}"

    def content(self) -> str:
        out = []
        for _ in range(self.r.choice((1, 1, 2, 3, 5, 8, 14, 25))):
            kind = self.r.random()
            if kind < 0.82:
                out.append(self.paragraph())
            elif kind < 0.88:
                out.append(f"<{(h := self.pick('h2', 'h3', 'h4'))}>{self.words(1, 8)}</{h}>")
            elif kind < 0.92:
                out.append("<ul>" + "".join(f"<li>{self.words(2, 14)}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>")
            elif kind < 0.95:
                out.append(f"<blockquote><p>{self.words(5, 40)}</p></blockquote>")
            elif kind < 0.97:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.985:
                out.append(f"<figure><figcaption>{self.words(3, 12)}</figcaption></figure>")
            else:
                out.append(self.noise())
        return "".join(out)

    def noise(self) -> str:
        """A box that is not content, wherever it stands."""
        kind = self.r.randrange(9)
        sentence = self.words(2, self.pick(8, 30))
        body = self.pick(sentence, f"<p>{sentence}</p>", f"<p>{sentence}</p><p>{self.words(1, 20)}</p>")
        box = self.pick("div", "div", "section", "aside")
        if kind < 2:
            name = self.pick("ad", "ads", "advert", "ad-slot", "advertisement", "promo", "sponsored", "sponsor-box")
        elif kind == 2:
            name = self.pick("cookie-notice", "cookie-banner", "consent", "notice", "gdpr", "popup", "modal", "alert")
            body += self.pick("", "<button>Ok</button>")
        elif kind == 3:
            name = self.pick("share", "social", "share-buttons", "follow")
            body = f"<ul>{self.links(2, 5)}</ul>"
        elif kind == 4:
            name = self.pick("related", "related-posts", "recommended", "popular", "more-stories", "trending")
            body = f"<h3>{self.words(1, 4)}</h3>" + self.pick(f"<ul>{self.links(2, 8)}</ul>", body)
        elif kind == 5:
            box, name = self.pick("form", "div"), self.pick("newsletter", "subscribe", "search", "login", "contact-form", "signup")
            body = f"<label>{self.words(1, 4)}</label><input name='q'><p>{self.words(1, 12)}</p><button>{self.words(1, 2)}</button>"
        elif kind == 6:
            name = self.pick("sidebar", "widget", "side-rail", "sidebar-right")
            body += f"<ul>{self.links(1, 6)}</ul>"
        elif kind == 7:
            name = self.pick("breadcrumb", "breadcrumbs", "pagination", "menu", "nav")
            body = f"<ul>{self.links(1, 6)}</ul>"
        else:
            return self.comments()
        if box in ("aside", "form") and self.r.random() < 0.5:
            return f'<{box} data-y="0">{body}</{box}>'
        return f'<{box} {self.pick("class", "id")}="{name}" data-y="0">{body}</{box}>'

    def comments(self) -> str:
        one = lambda: f'<{(t := self.pick("div", "li", "article"))} class="{self.pick("comment", "reply", "comment-body")}">' + (f"<p>{self.words(1, 3)}</p>" if self.r.random() < 0.5 else "") + f"<p>{self.words(3, 40)}</p></{t}>"
        body = "".join(one() for _ in range(self.r.randint(1, 6)))
        return f'<{(t := self.pick("section", "div", "ol"))} {self.pick("id", "class")}="{self.pick("comments", "comment-list", "discussion", "replies", "disqus_thread")}" data-y="0">{self.pick("", f"<h3>{self.words(1, 3)}</h3>")}{body}</{t}>'

    def menu(self) -> str:
        body = self.pick(f"<ul>{self.links(2, 8)}</ul>", "".join(f'<a href="/">{self.words(1, 2)}</a> ' for _ in range(5)))
        if self.r.random() < 0.7:
            return f'<nav data-y="0">{body}</nav>'
        return f'<div {self.pick("class", "id")}="{self.pick("nav", "menu", "navbar", "main-menu", "navigation")}" data-y="0">{body}</div>'

    def header(self) -> str:
        body = self.pick(f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 5)}</div>", f"<p>{self.words(1, 8)}</p>") + self.pick("", self.menu())
        if self.r.random() < 0.7:
            return f'<header data-y="0">{body}</header>'
        return f'<div {self.pick("class", "id")}="{self.pick("header", "site-header", "masthead", "topbar", "top-banner")}" data-y="0">{body}</div>'

    def footer(self) -> str:
        body = self.pick(f"&copy; {self.word()}.com &middot; {self.words(2, 25)}", f"<p>{self.words(2, 25)}</p>", f"<ul>{self.links(1, 6)}</ul><p>{self.words(1, 9)}</p>")
        if self.r.random() < 0.7:
            return f'<footer data-y="0">{body}</footer>'
        return f'<div {self.pick("class", "id")}="{self.pick("footer", "site-footer", "copyright", "colophon")}" data-y="0">{body}</div>'

    def page(self) -> str:
        some = lambda f, p: f() if self.r.random() < p else ""
        title = some(lambda: f"<h1>{self.words(1, 12)}</h1>", 0.8)
        if self.r.random() < 0.08:
            title = f"<header>{title}<p>{self.words(1, 5)}</p></header>"
        inside = title + some(self.noise, 0.15) + self.content() + some(self.noise, 0.2) + some(self.comments, 0.1)
        style = self.r.randrange(6)
        if style < 3:
            article = f"<article>{inside}</article>"
        elif style == 3:
            article = f"<main>{inside}</main>"
        elif style == 4:
            article = f'<div {self.pick("class", "id")}="{self.pick("content", "post", "article-body", "entry-content", "main", "story")}">{inside}</div>'
        else:
            article = f"<div>{inside}</div>"
        body = some(self.header, 0.4) + some(self.menu, 0.6) + some(self.noise, 0.5) + article + some(self.comments, 0.25) + some(self.noise, 0.4) + some(self.noise, 0.2) + some(self.footer, 0.8)
        if self.r.random() < 0.3:
            body = f'<div {self.pick("class", "id")}="{self.pick("wrapper", "page", "container", "site", "layout")}">{body}</div>'
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{body}</body></html>"


def training_pages(count: int, seed: int = 1) -> list[str]:
    writer = _Writer(seed)
    return [writer.page() for _ in range(count)]


def fit(pages: list[str], **options) -> Trees:
    parsed = [Page(html) for html in pages]
    return boost(np.concatenate([p.features() for p in parsed]), np.concatenate([np.array(p.label, float) for p in parsed]), **options)


@lru_cache(maxsize=1)
def default_trees(pages: int = 500) -> Trees:
    return fit(training_pages(pages))


def extract(html: str, trees: Trees) -> str:
    page = Page(html)
    return page.text(page.decode(trees.logits(page.features())))


def extract_pages(pages: DataFrame, trees: Trees | None = None, *, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row: null html counts as empty and gives an empty text, null ids
    and urls stay, repeated rows stay, an empty table gives an empty result, other columns are ignored.

    White space is what Python's ``str.split`` takes for it: the Unicode property, with no-break spaces, and U+001C
    to U+001F.  A page takes time in proportion to its length, however its elements are nested."""
    require_columns(pages, ["page_id", "url", html_col])
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(trees or default_trees())

    def run(batches):
        trees = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            parsed = [Page(h) for h in batch.column(2).to_pylist()]
            found = [p.features() for p in parsed]
            logits = np.split(trees.logits(np.concatenate(found)), np.cumsum([len(f) for f in found])[:-1])
            texts = [p.text(p.decode(x)) for p, x in zip(parsed, logits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
