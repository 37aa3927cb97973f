"""Main text of web pages by a tree-structured graphical model over the page's DOM.

A page becomes a tree of block elements; the runs of inline content between block boundaries are its
leaves. Each node has a hidden label, content or not. Its own evidence is a log-linear potential of tag,
class and id words, or, for leaves, of length, share of link text and punctuation. Parent-child potentials
make neighbours in the tree agree. Sum-product messages, once upward and once downward, give the exact
marginal of every node, and the leaves more likely content than not are the main text, in page order.

Evidence and parent-child potentials are trained together from labelled pages, pairs of a page and its main
text: each step raises the likelihood of the labels of whole trees, by the gap between what is labelled and
the marginals. ``labelled_pages`` writes a bounded set of such pages (``TRAINING_PAGES``); others can be given.
Scripts, styles and other raw text never become nodes. A page is read once from left to right, in time in
proportion to its length, however broken or deep it is.

Defined cases: null or empty html has no text; broken markup is read as far as it goes (unclosed elements
end with their parent, stray ends are ignored, an open comment or script runs to the end); rows that
share a page_id are separate rows; nothing is dropped for its size.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES = 600
#: Share of training pages without anything around a short text.
BARE = 0.15
#: Features that a node has at once, about; damps the joint steps of training.
SHARED = 6
#: Features met less often in training have no weight.
RARE = 6
#: How elements behave.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template noscript iframe noembed noframes xmp svg math object select button canvas".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table menu body article section div".split())

_NAME = re.compile(r"/?[a-zA-Z][^\s/<>]*+")
_STOP = re.compile("[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}


def _tag_end(page: str, at: int, failed: set[int]) -> int:
    """Where the tag that is open at ``at`` ends: behind the first ``>`` outside quotes, or the first at all; 0 without any.

    ``failed`` holds closing quotes that no such ``>`` follows, so that none is looked behind twice.
    """
    seen, pos = [], at
    while (m := _STOP.search(page, pos)) is not None:
        if m[0] == ">":
            return m.end()
        close = page.find(m[0], m.end())
        if close < 0 or close in failed:
            break
        seen.append(close)
        pos = close + 1
    failed.update(seen)
    return page.find(">", at) + 1


def tree(page: str) -> tuple[list[int], list[str], list[tuple[str, int] | None]]:
    """Parent, description and (text, characters in links) of each node; elements have no text."""
    parent, kind, leaf = [-1], ["html "], [None]
    stack: list[tuple[str, int]] = [("html", 0)]  # tag and node; inline elements have no node
    where: dict[str, list[int]] = {}  # depths at which a tag is open
    blocks, scopes = [0], [0]  # depths of block elements, and of those that siblings can't be closed through
    run: list[str] = []
    links = 0
    failed: set[int] = set()

    def flush() -> None:
        nonlocal links
        if run:
            text = " ".join("".join(run).split())
            if text:
                parent.append(stack[blocks[-1]][1])
                kind.append("")
                leaf.append((text, links))
            run.clear()
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        text = unescape(raw) if "&" in raw else raw
        run.append(text)
        if where.get("a"):
            links += len(text)

    def push(tag: str, node: int) -> None:
        where.setdefault(tag, []).append(len(stack))
        if node >= 0:
            blocks.append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
        stack.append((tag, node))

    def close(depth: int) -> None:
        if blocks[-1] >= depth:
            flush()
        while len(stack) > depth:
            where[stack.pop()[0]].pop()
        while blocks[-1] >= depth:
            blocks.pop()
        while scopes[-1] >= depth:
            scopes.pop()

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        if start > at:
            say(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, start + 1)
        if m is None or start > last:
            say("<")
            at = start + 1
            continue
        at = _tag_end(page, m.end(), failed)
        if not at:
            say("<")
            at = start + 1
            continue
        tag, more = m[0].lower(), page[m.end() : at - 1]
        if tag[0] == "/":
            tag = tag[1:]
            open_ = where.get(tag)
            if open_ and (tag not in INLINE or open_[-1] > blocks[-1]):
                close(open_[-1])
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            stop = None if more.endswith("/") and tag in ("svg", "math", "canvas") else _END[tag].search(page, at)
            at = n if stop is None else stop.end()
            continue
        if tag in ENDS_PARAGRAPH:
            if stack[blocks[-1]][0] == "p":
                close(blocks[-1])
        elif tag in SIBLINGS:
            depth = max((where[t][-1] for t in SIBLINGS[tag] if where.get(t)), default=0)
            if depth > scopes[-1]:
                close(depth)
        if tag in INLINE:
            if tag not in VOID and not more.endswith("/"):
                push(tag, -1)
            continue
        flush()
        if tag in VOID or more.endswith("/"):
            continue
        parent.append(stack[blocks[-1]][1])
        kind.append(f"{tag} {more}" if more else f"{tag} ")
        leaf.append(None)
        push(tag, len(parent) - 1)
    flush()
    return parent, kind, leaf


def element_features(kind: str) -> list[str]:
    tag, _, more = kind.partition(" ")
    out = ["element", f"tag:{tag}"]
    for m in _NAMES.finditer(more):
        words = _WORD.findall(_CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower())
        out += [f"name:{w.removesuffix('s') if len(w) > 3 else w}" for w in words]
    return list(dict.fromkeys(out))


def _share(links: int, size: int) -> int:
    share = links / size if size else 0.0
    return 0 if share < 0.02 else 1 if share < 0.3 else 2 if share < 0.8 else 3


def subtree_features(links: int, size: int) -> tuple[str, str]:
    return f"under:{min(int(math.log2(size + 1)), 12)}", f"under-links:{_share(links, size)}"


def leaf_features(text: str, links: int) -> list[str]:
    return ["leaf", f"size:{min(int(math.log2(len(text) + 1)), 8)}", f"links:{_share(links, len(text))}", f"stop:{text[-1] in '.!?…:;,。'}"]


def _below(parent: list[int], leaf: list) -> list[list[int]]:
    """Characters in links, and of text, under each node."""
    under = [[0, 0] if x is None else [x[1], len(x[0])] for x in leaf]
    for v in range(len(parent) - 1, 0, -1):
        up = under[parent[v]]
        up[0] += under[v][0]
        up[1] += under[v][1]
    return under


class Model:
    """Evidence weights of features, and the parent-child potentials.

    ``under[k]`` is the log potential of content, against none, of a child whose parent has label k.
    """

    def __init__(self, weights: dict[str, float], under: tuple[float, float] = (-8.0, 0.0)):
        self.weights, self.under = weights, under
        self.known: dict[str, float] = {}

    def evidence(self, features: Iterable[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)

    def potentials(self, parent: list[int], kind: list[str], leaf: list) -> list[float]:
        """Each node's own log odds of content."""
        total = []
        for k, x, under in zip(kind, leaf, _below(parent, leaf)):
            if x is not None:
                total.append(self.evidence(leaf_features(*x)))
                continue
            if k not in self.known:
                if len(self.known) > 20_000:
                    self.known.clear()
                self.known[k] = self.evidence(element_features(k))
            total.append(self.known[k] + self.evidence(subtree_features(*under)))
        return total

    def marginals(self, parent: list[int], own: list[float]) -> list[float]:
        """Probability that each node holds content, given that the page does, by messages up and down the tree."""
        total, (without, with_) = list(own), self.under
        for v in range(len(total) - 1, 0, -1):
            total[parent[v]] += _soft(total[v] + with_) - _soft(total[v] + without)
        p = [1.0]
        for v in range(1, len(total)):
            above = p[parent[v]]
            p.append(above * _sigmoid(total[v] + with_) + (1 - above) * _sigmoid(total[v] + without))
        return p

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        parent, kind, leaf = tree(page)
        odds = self.marginals(parent, self.potentials(parent, kind, leaf))
        return " ".join(x[0] for x, o in zip(leaf, odds) if x is not None and o > 0.5)


def _soft(h: float) -> float:
    """log(1 + exp(h))"""
    return h if h > 30 else math.log1p(math.exp(max(h, -700.0)))


def _sigmoid(h: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, h))))


def _labels(parent: list[int], leaf: list, main: str) -> list[bool]:
    """Leaves that stand in the main text, in order, and the nodes above them."""
    good, at = [False] * len(parent), 0
    for v, x in enumerate(leaf):
        if x is not None and 0 <= (found := main.find(x[0], at)) <= at + 1:
            good[v], at = True, found + len(x[0])
    for v in range(len(parent) - 1, 0, -1):
        good[parent[v]] |= good[v]
    return good


def train(pages: Iterable[tuple[str, str]], steps: int = 400, decay: float = 1.0) -> Model:
    """Evidence and potentials of the greatest likelihood of whole labelled trees, with a Gaussian prior."""
    rows, labels, above, depth = [], [], [], []
    for page, main in pages:
        parent, kind, leaf = tree(page)
        first = len(rows)
        labels += _labels(parent, leaf, main)
        for v, under in enumerate(_below(parent, leaf)):
            rows.append([*element_features(kind[v]), *subtree_features(*under)] if leaf[v] is None else leaf_features(*leaf[v]))
            above.append(first + parent[v] if v else -1)
            depth.append(depth[first + parent[v]] + 1 if v else 0)
    often = Counter(f for r in rows for f in r)
    names = {f: i for i, f in enumerate(sorted(f for f in often if often[f] >= RARE))}
    rows = [[f for f in r if f in names] for r in rows]
    i = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    j = np.array([names[f] for r in rows for f in r], np.int64)
    y, up, depth = np.array(labels, float), np.array(above, np.int64), np.array(depth)
    levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]
    child = np.flatnonzero(up >= 0)
    squash = lambda h: 1 / (1 + np.exp(-np.clip(h, -60, 60)))
    w, under = np.zeros(len(names)), np.array([-4.0, 0.0])
    bend, speed = np.bincount(j, minlength=len(names)) * SHARED / 4 + decay, np.zeros(len(names))
    for _ in range(steps):
        h = np.bincount(i, w[j], minlength=len(rows))
        for level in levels[::-1]:
            np.add.at(h, up[level], np.logaddexp(0, h[level] + under[1]) - np.logaddexp(0, h[level] + under[0]))
        p, low, high = squash(h), squash(h + under[0]), squash(h + under[1])
        p[up < 0] = y[up < 0]
        for level in levels:
            p[level] = p[up[level]] * high[level] + (1 - p[up[level]]) * low[level]
        speed = 0.5 * speed + (np.bincount(j, (y - p)[i], minlength=len(names)) - decay * w) / bend
        w += speed
        pu, yu = p[up[child]], y[up[child]]
        gap = np.array([((1 - yu) * y[child] - (1 - pu) * low[child]).sum(), (yu * y[child] - pu * high[child]).sum()])
        under += (gap - decay * under) / (np.array([(1 - yu).sum(), yu.sum()]) / 2 + decay)
    return Model({f: float(w[k]) for f, k in names.items()}, (float(under[0]), float(under[1])))


def labelled_pages(count: int = TRAINING_PAGES, seed: int = 5) -> Iterator[tuple[str, str]]:
    """Pages of many layouts with invented prose, and their main texts."""
    r = random.Random(seed)
    syllables = "ba ce di fo gu la me ni po ru sa te vi wo xu ya ze qui tra blo cre".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    sentences = lambda n: " ".join(phrase(4, 16) + r.choice(".....!?") for _ in range(n))
    anchor = lambda: f'<a href="/{word()}">{phrase(1, 3)}</a>'
    named = lambda *names: r.choice([f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{word()} {r.choice(names)}"', f' class="{r.choice(names)}-{word()}"'])

    def box(tag: str, attrs: str, inside: str) -> str:
        return f"<{tag}{attrs}>{inside}</{tag}>"

    def links() -> str:
        return box(r.choice(["ul", "ol"]), "", "".join(box("li", "", anchor()) for _ in range(r.randint(3, 9))))

    def furniture(kind: str) -> str:
        prose = lambda: sentences(r.randint(1, 3))
        plain = lambda tag, *names: box(*((tag, "") if r.random() < 0.5 else ("div", named(*names))), "{}")
        body = {
            "nav": lambda: r.choice([links(), " | ".join(anchor() for _ in range(5))]),
            "header": lambda: r.choice([phrase(1, 4), box("p", "", phrase(2, 6)), box("h2", "", phrase(1, 3)) + links()]),
            "footer": lambda: r.choice(["&copy; 2020 " + phrase(1, 4), box("p", "", "&copy; " + prose()), links() + box("p", "", prose()), f"&copy; {word()}.example.com &middot; {prose()}"]),
            "aside": lambda: r.choice([box("h3", "", phrase(1, 3)) + links(), box("p", "", prose()), prose()]),
            "notice": lambda: r.choice([prose(), box("p", "", prose()), prose() + anchor()]),
            "ad": lambda: r.choice([prose(), anchor(), box("p", "", prose()), phrase(3, 12)]),
            "form": lambda: box("p", "", phrase(2, 8)) + f'<label>{phrase(1, 3)}</label><input name="q">' + box("button", "", "Go"),
            "comments": lambda: box("h3", "", phrase(1, 2)) + "".join(box(r.choice(["div", "li", "p", "article"]), r.choice(["", named("comment", "reply")]), r.choice([prose(), box("p", "", prose())])) for _ in range(r.randint(1, 4))),
            "share": lambda: r.choice([links(), " ".join(anchor() for _ in range(4))]),
        }[kind]()
        tags = {
            "nav": ("nav", "nav", "menu", "navbar", "navigation", "breadcrumb", "pagination", "topbar"), "header": ("header", "header", "masthead", "banner", "logo", "site-header", "branding"),
            "footer": ("footer", "footer", "copyright", "colophon", "legal", "site-footer", "bottom"), "aside": ("aside", "sidebar", "related", "widget", "rail", "recommended", "popular", "side"),
            "notice": ("div", "notice", "cookie", "consent", "alert", "banner", "gdpr", "popup", "modal", "newsletter", "disclaimer", "paywall"), "ad": ("div", "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner-ad"),
            "form": ("form", "form", "search", "login", "subscribe", "signup", "newsletter"), "comments": ("section", "comments", "comment-list", "responses", "discussion", "replies", "disqus", "respond", "reader-comments"),
            "share": ("div", "share", "social", "tags", "sharing", "follow", "toolbar"),
        }[kind]
        if kind == "form":
            return box("form", r.choice(["", named(*tags[1:])]), body)
        if tags[0] in ("div", "section"):
            return box(r.choice([tags[0], "div", "section", "aside"]), named(*tags[1:]), body)
        return plain(tags[0], *tags[1:]).format(body) if r.random() < 0.8 else box(tags[0], named(*tags[1:]), body)

    for _ in range(count):
        main: list[str] = []

        def prose_block() -> str:
            def keep(text: str) -> str:
                main.append(text)
                return text

            kind = r.random()
            if kind < 0.70:
                text = keep(sentences(r.choice([1, 1, 2, 3, 5, 8])))
                if r.random() < 0.2:
                    a, _, b = text.partition(" ")
                    return box("p", "", f'{a} {r.choice([f"<b>{b}</b>", f"<em>{b}</em>", b])}')
                return r.choice([box("p", "", text), f"<p>{text}", box("p", "", f"<b>{text}")]) if r.random() < 0.4 else box("p", "", text)
            if kind < 0.78:
                return box(r.choice(["h2", "h3"]), "", keep(phrase(1, 6)))
            if kind < 0.86:
                return box(r.choice(["ul", "ol"]), "", "".join(box("li", "", keep(phrase(3, 14) + r.choice([".", "", ";"]))) for _ in range(r.randint(2, 5))))
            if kind < 0.92:
                return box("blockquote", "", box("p", "", keep(sentences(2))))
            if kind < 0.96:
                return box("figure", "", '<img src="x.png">' + box("figcaption", "", keep(phrase(3, 10))))
            return box("table", "", "".join(box("tr", "", "".join(box("td", "", keep(phrase(1, 4))) for _ in range(2))) for _ in range(3)))

        if r.random() < BARE:  # a page of little more than a note
            inside = "".join(box("p", "", (main.append(t := phrase(2, 14) + r.choice([".", "", "!"])) or t)) for _ in range(r.choice([1, 1, 2, 3])))
            page = r.choice([lambda: box("article", "", inside), lambda: box("main", "", inside), lambda: inside, lambda: box("div", named("content", "article", "post", "main"), inside)])()
            yield f"<html><body>{page}</body></html>", " ".join(main)
            continue
        head = box("h1", "", (main.append(h := phrase(2, 9)) or h)) if r.random() < 0.85 else ""
        blocks = [prose_block() for _ in range(r.choice([1, 2, 3, 6, 10, 16]))]
        for kind in ("ad", "notice", "form", "share", "aside"):
            if r.random() < 0.22:
                blocks.insert(r.randint(0, len(blocks)), furniture(kind))
        if r.random() < 0.25:
            blocks.append(furniture("comments"))
        inside = head + "".join(blocks)
        content = r.choice([lambda: box("article", r.choice(["", "", named("post", "article", "entry", "story")]), inside), lambda: box("main", "", box("article", "", inside)), lambda: box("div", named("content", "article", "post", "main", "entry", "story", "text", "article-body"), inside), lambda: box("main", "", inside), lambda: box("div", r.choice(["", f' class="{word()}"']), inside)])()
        top = [furniture(k) for k in ("header", "nav", "notice", "ad") if r.random() < 0.6]
        bottom = [furniture(k) for k in ("comments", "aside", "ad", "share", "form", "footer") if r.random() < (0.85 if k == "footer" else 0.3)]
        r.shuffle(top)
        page = "".join(top) + content + "".join(bottom)
        if r.random() < 0.3:
            page = box("div", r.choice(["", named("page", "wrapper", "container")]), page)
        yield f"<!DOCTYPE html><html><head><title>{phrase(2, 6)}</title></head><body>{page}</body></html>", " ".join(unescape(x) for x in main)


_trained: dict[int, Model] = {}


def default_model() -> Model:
    """The model trained on the labelled pages written here; trained once per process."""
    if TRAINING_PAGES not in _trained:
        _trained[TRAINING_PAGES] = train(labelled_pages())
    return _trained[TRAINING_PAGES]


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """``id_col``, ``url_col``, text, n_chars; a row per input row."""
    used = model or default_model()
    weights, under = used.weights, used.under

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, under)
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                texts = [own.text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_id", "_url", "text", "n_chars"])

    kind, url = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    slim = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    return slim.mapInArrow(extract, f"_id {kind}, _url {url}, text string, n_chars bigint").withColumnsRenamed({"_id": id_col, "_url": url_col})
