"""Main text of web pages by a graphical model on the tree of block elements.

Each block element is content or not. Potentials of an element come from its tag, its
names (class, id, role) and its text; potentials of parent and child depend on the kind of
the child. Sum-product messages go up and down all trees of a batch at once, level by level,
and give the marginals; text is kept where the marginal of its block element is at least a
half. The weights are fitted by the likelihood of labelled pages.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framespan.llm.dom import Page, read
from framespan.llm.shingles import groups
from framespan.llm.worker import parts

_TAGS = {t: k for k, names in enumerate((
    "html body", "article", "main", "section", "div center details hgroup", "p", "h1 h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "table thead tbody tfoot tr",
    "td th caption", "blockquote pre figure figcaption", "nav", "header", "footer", "aside", "form fieldset legend search", "address summary",
)) for t in names.split()}
#: The last one is for plain containers without a name.
_N_TAGS = 19
#: Word beginnings in names of elements, by what they tell of.
_NAMES = (
    ("nav", "menu", "breadcrumb", "pagination", "pager", "toc", "tabs", "navbar", "skip"),
    ("header", "masthead", "topbar", "branding", "logo", "hero"),
    ("foot", "copyright", "legal", "colophon", "bottom", "contentinfo"),
    ("sidebar", "aside", "widget", "related", "recommend", "rail", "complementary", "popular", "trending", "readmore"),
    ("ad", "ads", "advert", "sponsor", "promo", "banner", "dfp", "taboola", "outbrain"),
    ("cookie", "consent", "notice", "alert", "popup", "modal", "overlay", "gdpr", "privacy", "message", "toast", "disclaimer", "warning"),
    ("comment", "reply", "replies", "respond", "disqus", "discussion", "review", "feedback"),
    ("social", "share", "sharing", "follow", "tags", "meta", "byline"),
    ("form", "search", "login", "signin", "signup", "newsletter", "subscribe", "subscription", "register", "contact"),
    ("hidden", "sr", "screenreader", "visually"),
    ("article", "content", "post", "entry", "story", "main", "body", "text", "prose", "page"),
)
_EXACT = {"ad", "ads", "sr", "toc", "nav", "tags", "meta", "foot", "text", "page", "main", "post", "rail", "form", "body"}
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_N_FEATURES = _N_TAGS + 2 * len(_NAMES) + 8
_EDGES = 3


def _names_of(named: str, cache: dict[str, np.ndarray]) -> np.ndarray:
    if named not in cache:
        if len(cache) > 20_000:
            cache.clear()
        words = [w.lower() for w in _SPLIT.findall(named)]
        cache[named] = np.array([any(w == b or (b not in _EXACT and w.startswith(b)) for w in words for b in own) for own in _NAMES], float)
    return cache[named]


_cache: dict[str, np.ndarray] = {}


@dataclass
class Forest:
    parent: np.ndarray
    level: np.ndarray
    edge: np.ndarray
    x: np.ndarray
    #: First element of each page, and one more.
    first: np.ndarray


def forest(pages: list[Page]) -> Forest:
    parents, levels, edges, rows, first = [], [], [], [], [0]
    for page in pages:
        n, base = len(page.tag), first[-1]
        chars, linked, blocks, ends = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        begin = np.full(n, -1.0)
        seen = 0
        for node, text, link in page.texts:
            chars[node] += len(text)
            linked[node] += min(link, len(text))
            blocks[node] += 1
            ends[node] += text[-1] in ".!?…:;\"'”»)"
            if begin[node] < 0:
                begin[node] = seen
            seen += len(text)
        own = chars.copy()
        level = np.zeros(n, int)
        for k in range(1, n):
            level[k] = level[page.parent[k]] + 1
        for k in range(n - 1, 0, -1):
            p = page.parent[k]
            chars[p] += chars[k]
            linked[p] += linked[k]
            blocks[p] += blocks[k]
            ends[p] += ends[k]
            if begin[k] >= 0 and (begin[p] < 0 or begin[k] < begin[p]):
                begin[p] = begin[k]
        x = np.zeros((n, _N_FEATURES))
        tags = np.array([_TAGS.get(t, 4) if named or _TAGS.get(t, 4) != 4 else _N_TAGS - 1 for t, named in zip(page.tag, page.named)])
        x[np.arange(n), tags] = 1
        for k, named in enumerate(page.named):
            if named:
                x[k, _N_TAGS : _N_TAGS + len(_NAMES)] = _names_of(named, _cache)
        at = _N_TAGS + len(_NAMES)
        for k in range(1, n):  # what the elements around it are named
            x[k, at : at + len(_NAMES)] = np.maximum(x[page.parent[k], at : at + len(_NAMES)], x[page.parent[k], _N_TAGS : _N_TAGS + len(_NAMES)])
        at += len(_NAMES)
        some = np.maximum(chars, 1)
        x[:, at] = 1
        x[:, at + 1] = np.log1p(chars) / 8
        x[:, at + 2] = linked / some
        x[:, at + 3] = chars / max(seen, 1)
        x[:, at + 4] = ends / np.maximum(blocks, 1)
        x[:, at + 5] = np.log1p(chars / np.maximum(blocks, 1)) / 6
        x[:, at + 6] = own == 0
        x[:, at + 7] = np.maximum(begin, 0) / max(seen, 1)
        parents.append(np.where(np.array(page.parent) < 0, -1, np.array(page.parent) + base))
        levels.append(level)
        edges.append(np.where(np.isin(tags, (12, 13, 14, 15, 16)), 2, np.where(np.isin(tags, (1, 2, 3)), 1, 0)))
        rows.append(x)
        first.append(base + n)
    return Forest(np.concatenate(parents), np.concatenate(levels), np.concatenate(edges), np.concatenate(rows), np.array(first))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp(x.take(0, axis), x.take(1, axis))


def sum_product(f: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each element (n, 2) and of each with its parent (n, 2 of the parent, 2); ``unary`` and ``pair`` are logarithms."""
    n = len(f.parent)
    inward = unary.copy()
    up, down = np.zeros((n, 2)), np.zeros((n, 2))
    order = np.argsort(f.level, kind="stable")
    bounds = np.searchsorted(f.level[order], np.arange(f.level.max() + 2)) if n else np.zeros(1, int)
    for k in range(len(bounds) - 2, 0, -1):
        own = order[bounds[k] : bounds[k + 1]]
        up[own] = _log_sum(pair[f.edge[own]] + inward[own][:, None, :], 2)
        np.add.at(inward, f.parent[own], up[own])
    both = np.zeros((n, 2, 2))
    for k in range(1, len(bounds) - 1):
        own = order[bounds[k] : bounds[k + 1]]
        p = f.parent[own]
        rest = inward[p] + down[p] - up[own]
        joint = rest[:, :, None] + pair[f.edge[own]]
        down[own] = _log_sum(joint, 1)
        joint = joint + inward[own][:, None, :]
        joint -= joint.max((1, 2), keepdims=True)
        e = np.exp(joint)
        both[own] = e / e.sum((1, 2), keepdims=True)
    total = inward + down
    total -= total.max(1, keepdims=True)
    e = np.exp(total)
    return e / e.sum(1, keepdims=True), both


@dataclass
class TreeModel:
    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, f: Forest) -> np.ndarray:
        unary = np.zeros((len(f.parent), 2))
        unary[:, 1] = f.x @ self.weights
        return sum_product(f, unary, self.pair)[0][:, 1]


def fit(pages: list[Page], steps: int = 120, l2: float = 1e-4, rate: float = 0.25) -> TreeModel:
    """Fit to pages whose elements carry labels; an element without one has that of its parent."""
    f = forest(pages)
    label = np.zeros(len(f.parent), int)
    for page, first in zip(pages, f.first):
        for k, own in enumerate(page.label):
            label[first + k] = own if own is not None else label[first + page.parent[k]] if k else 1
    inner = np.flatnonzero(f.parent >= 0)
    truth = np.zeros((_EDGES, 2, 2))
    np.add.at(truth, (f.edge[inner], label[f.parent[inner]], label[inner]), 1)
    n = len(label)
    params = np.zeros(_N_FEATURES + _EDGES * 4)
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        unary = np.zeros((n, 2))
        unary[:, 1] = f.x @ params[:_N_FEATURES]
        one, both = sum_product(f, unary, params[_N_FEATURES:].reshape(_EDGES, 2, 2))
        expected = np.zeros((_EDGES, 2, 2))
        np.add.at(expected, f.edge[inner], both[inner])
        gradient = np.concatenate([f.x.T @ (label - one[:, 1]), (truth - expected).ravel()]) / n - l2 * params
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.999 * m2 + 0.001 * gradient**2
        params += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return TreeModel(params[:_N_FEATURES], params[_N_FEATURES:].reshape(_EDGES, 2, 2))


class _Writer:
    """Labelled pages of many layouts; ``data-label`` says what an element is, its children inherit it."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(("ka", "lo", "mi", "ter", "un", "de", "ra", "si", "vo", "en")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        return self.words(low, high).capitalize() + self.r.choice("....!?")

    def text(self, most: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def links(self, n: int) -> str:
        tag = self.r.choice(("li", "li", "div", "span"))
        items = "".join(f"<{tag}><a href='/x'>{self.words(1, 4)}</a></{tag}>" for _ in range(n))
        return f"<ul>{items}</ul>" if tag == "li" else items

    def one(self, tag: str, plain: str, names: tuple[str, ...], inner: str) -> str:
        """An element of what is not content: by tag, by name, or both."""
        r, name = self.r, self.r.choice(names)
        kind = r.random()
        if kind < 0.4:
            return f'<{tag} data-label="0">{inner}</{tag}>'
        if kind < 0.8:
            return f'<{plain} data-label="0" {r.choice(("class", "class", "id"))}="{name}">{inner}</{plain}>'
        return f'<{tag} data-label="0" class="{name}">{inner}</{tag}>'

    def aside_parts(self) -> list[str]:
        r = self.r
        heading = lambda: f"<h{r.randint(2, 4)}>{self.words(1, 4)}</h{r.randint(2, 4)}>" if r.random() < 0.6 else ""
        ad = f'<div data-label="0" class="{r.choice(("ad", "ads", "advert", "ad-slot", "sponsored", "promo-box", "banner-ad", "google-ads"))}">{r.choice((self.sentence(), self.text(2), "<p>" + self.text(3) + "</p>"))}</div>'
        notice = self.one(r.choice(("section", "aside")), "div", ("cookie-notice", "cookie-banner", "notice", "consent", "alert alert-info", "gdpr-popup", "site-notice", "modal"), f"<p>{self.text(3)}</p>" + r.choice(("", "<a href='/p'>" + self.words(1, 3) + "</a>")))
        form = self.one("form", "div", ("newsletter", "search-form", "subscribe", "login-box", "signup"), f"{heading()}<p>{self.sentence()}</p><label>{self.words(1, 3)}</label><input name='q'>")
        side = self.one("aside", "div", ("sidebar", "widget", "related-posts", "recommended", "right-rail", "most-popular"), heading() + r.choice((self.links(r.randint(2, 8)), f"<p>{self.text(3)}</p>", f"<p>{self.text(2)}</p>" + self.links(3))))
        comment = lambda: f'<{(t := r.choice(("div", "li", "article")))} class="{r.choice(("comment", "reply", "comment-body"))}"><p>{self.text(4)}</p></{t}>' if r.random() < 0.7 else f"<div><p>{self.text(4)}</p></div>"
        comments = f'<{(t := r.choice(("section", "div", "ol")))} data-label="0" {r.choice(("id", "class"))}="{r.choice(("comments", "comment-list", "discussion", "responses comments-area", "reader-comments", "disqus_thread"))}">{heading()}{"".join(comment() for _ in range(r.randint(1, 6)))}</{t}>'
        share = f'<div data-label="0" class="{r.choice(("share", "social-links", "share-buttons"))}">{self.links(r.randint(2, 5))}</div>'
        line = f'<p data-label="0" class="{r.choice(("ad", "advert", "advertisement", "sponsored", "notice", "promo"))}">{self.text(2)}</p>'
        return [ad, notice, form, side, comments, share, line]

    def content(self) -> list[str]:
        r = self.r
        out = [f"<h{r.choice((1, 1, 2))}>{self.sentence(1, 14)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.7:
                out.append(f"<p>{self.text()}</p>" if r.random() < 0.8 else f"<p>{self.words(1, 2)}.</p>")
            elif kind < 0.76:
                out.append(f"<h{r.randint(2, 4)}>{self.words(1, 7)}</h2>")
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.86:
                out.append(f"<blockquote>{r.choice(('', '<p>'))}{self.text(3)}</blockquote>")
            elif kind < 0.9:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif kind < 0.93:
                out.append(f"<figure><img src='/i'><figcaption>{self.sentence()}</figcaption></figure>")
            elif kind < 0.96:
                out.append(f"<p>{self.text(3)} <a href='/y'>{self.words(1, 4)}</a> {self.sentence()}</p>")
            else:
                out.append(f"<pre>{self.words(3, 20)}</pre>" if r.random() < 0.5 else f"<div>{self.text()}</div>")
        return out

    def page(self) -> str:
        r = self.r
        parts = self.content()
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            parts.insert(r.randint(0, len(parts)), r.choice(self.aside_parts()))
        body = "".join(parts)
        shell = r.random()
        if shell < 0.45:
            body = f'<article data-label="1">{body}</article>'
        elif shell < 0.6:
            body = f'<main data-label="1">{body}</main>'
        elif shell < 0.9:
            body = f'<div data-label="1" {r.choice(("class", "id"))}="{r.choice(("content", "post", "entry-content", "article-body", "main", "story", "page-content", "text"))}">{body}</div>'
        else:
            body = f'<div data-label="1">{body}</div>'
        if r.random() < 0.3:
            body = f'<{(t := r.choice(("main", "div", "section")))} data-label="1">{body}</{t}>'
        if r.random() < 0.06:
            cell = f'<td data-label="0" class="{r.choice(("nav", "menu", "sidebar", "left-nav"))}">{self.links(r.randint(2, 6))}</td>'
            body = f'<table data-label="1"><tr>{cell}<td>{body}</td></tr></table>'
        before, after = [], []
        if r.random() < 0.85:
            before.append(self.one("nav", "div", ("nav", "menu", "main-menu", "navbar", "breadcrumbs"), self.links(r.randint(2, 9))))
        if r.random() < 0.5:
            before.insert(0, self.one("header", "div", ("header", "site-header", "masthead", "top-bar"), r.choice(("", f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.sentence()}</p>")) + r.choice((f"<a href='/'>{self.words(1, 3)}</a>", self.links(3), "<nav>" + self.links(4) + "</nav>", ""))))
        for part in self.aside_parts():
            if r.random() < 0.3:
                r.choice((before, after)).append(part)
        if r.random() < 0.85:
            after.append(self.one("footer", "div", ("footer", "site-footer", "copyright", "colophon"), r.choice((f"&copy; {self.words(1, 4)} &middot; {self.text(2)}", f"<p>{self.text(2)}</p>", self.links(4), self.sentence() + self.links(2)))))
        return f'<html><body data-label="1">{"".join(before)}{body}{"".join(after)}</body></html>'


def labelled_pages(n: int = 300, seed: int = 1) -> list[str]:
    """Pages with labels, written by chance in many layouts; their words mean nothing, so only structure is learned."""
    writer = _Writer(seed)
    return [writer.page() for _ in range(n)]


_models: dict[tuple[int, int], TreeModel] = {}


def default_model(n: int = 300, seed: int = 1) -> TreeModel:
    if (n, seed) not in _models:
        _models[n, seed] = fit([read(h, labels=True) for h in labelled_pages(n, seed)])
    return _models[n, seed]


def extract(model: TreeModel, htmls: list[str]) -> list[str]:
    pages = [read(h) for h in htmls]
    if not pages:
        return []
    f = forest(pages)
    keep = model.marginals(f) >= 0.5
    return ["\n\n".join(t for node, t, _ in page.texts if keep[first + node]) for page, first in zip(pages, f.first)]


def extractor(model: TreeModel):
    """A column function: html to its main text."""

    @F.arrow_udf(T.StringType())
    def text(html: pa.Array) -> pa.Array:
        out: list[str] = []
        for part in parts(html):
            own = [h or "" for h in part]
            for low, high in groups(own):
                out += extract(model, own[low:high])
        return pa.array(out, pa.string())

    return text


def op9(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages have an empty text; repeated rows give equal texts. Further columns,
    whatever their names, are ignored; no rows give none.
    """
    found = pages.select("page_id", "url", extractor(default_model())(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
