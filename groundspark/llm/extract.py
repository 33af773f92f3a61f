"""HTML extraction: boosted trees over DOM nodes with hierarchical decoding.

Every element and text run of a page is a node with features of its own (tag, attribute tokens, depth), of its subtree
(text, links, sentence marks, density), of its ancestors and of its siblings. Boosted trees give each node the log odds
that its subtree holds main text. Decoding takes the set of nodes with the largest sum of log odds among the sets that
hold a node's parent with it, by one pass up and one down the tree: no kept node lies in a dropped one, and a kept
element keeps something. Text is that of the kept runs.

The pages come without labels, so the trees are fitted on TRAINING generated pages of varied layouts in which the main
text is known (a seeded generator in this module; nothing of the tables is learnt from).

Contract: null, empty and markup-less html have defined results (no text; the text itself is judged as one run);
character references are decoded as in HTML; pages are independent, so repeated rows and empty tables need nothing;
further columns pass through, one with the name of the output is replaced.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundspark.llm import trees
from groundspark.llm.common import replaced, small_batches, table
from groundspark.llm.dom import Page

#: Generated pages that the trees are fitted on.
TRAINING = 500
GROUPS = (
    ("article", "main"), ("section", "div", "body", "html", "center", "figure"), ("p", "blockquote", "pre", "figcaption"), ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"),
    ("ul", "ol", "menu", "dl"), ("li", "dt", "dd"), ("a",), ("nav",), ("header",), ("footer",), ("aside", "dialog"), ("form", "fieldset", "button", "label", "legend", "option"),
    ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("#text",),
)
GROUP = {t: k for k, ts in enumerate(GROUPS) for t in ts}
OTHER = len(GROUPS)
#: Attribute tokens by what they usually name.
TOKENS = (
    frozenset("article content main post entry story text prose body articlebody".split()),
    frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar toolbar tabs pagination pager skip".split()),
    frozenset("footer copyright legal foot contentinfo bottom".split()),
    frozenset("sidebar aside rail widget related recommended trending popular more complementary tags archive".split()),
    frozenset("ad ads advert adverts advertisement adsense banner promo promotion sponsor sponsored".split()),
    frozenset("comment comments reply replies respond discussion disqus feedback reader readers".split()),
    frozenset("notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup paywall hidden message warning".split()),
    frozenset("form search login share sharing social follow author byline meta date button btn toolbar".split()),
)
AWAY = (GROUP["nav"], GROUP["header"], GROUP["footer"], GROUP["aside"], GROUP["form"])


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all nodes of all pages, one after another: features, parents (-1: none), depths."""
    starts = np.cumsum([0, *[len(p.tag) for p in pages]])
    n = int(starts[-1])
    group = np.fromiter((GROUP.get(t, OTHER) for p in pages for t in p.tag), np.int64, n)
    page = np.repeat(np.arange(len(pages)), np.diff(starts))
    parent = np.fromiter((q for p in pages for q in p.parent), np.int64, n)
    parent = np.where(parent < 0, -1, parent + starts[page])
    flag = np.zeros((n, len(TOKENS)), bool)
    k = 0
    for p in pages:
        for tokens in p.tokens:
            for t in tokens:
                for j, words in enumerate(TOKENS):
                    if t in words:
                        flag[k, j] = True
            k += 1
    chars = np.fromiter((len(t) for p in pages for t in p.text), np.float64, n)
    marks = np.fromiter((t.count(".") + t.count(",") + t.count("?") + t.count("!") if t else 0 for p in pages for t in p.text), np.float64, n)
    depth = np.zeros(n, np.int64)
    away = np.zeros(n, bool)
    linked = group == GROUP["a"]
    above = np.zeros_like(flag)
    body = np.isin(group, (0,))
    in_body = np.zeros(n, bool)
    leave = np.isin(group, AWAY)
    # Parents come before their children, so one level after another is settled.
    level = np.flatnonzero(parent < 0)
    levels = [level]
    kids_of = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[kids_of], np.arange(n))
    last = np.searchsorted(parent[kids_of], np.arange(n), "right")
    while True:
        counts = last[level] - first[level]
        if not counts.sum():
            break
        at = np.repeat(first[level] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        level = kids_of[at]
        up = parent[level]
        depth[level] = depth[up] + 1
        away[level] = away[up] | leave[up]
        linked[level] |= linked[up]
        above[level] = above[up] | flag[up]
        in_body[level] = in_body[up] | body[up]
        levels.append(level)
    sums = np.column_stack([chars, np.where(linked, chars, 0), marks, (group != GROUP["#text"]).astype(float), (group == GROUP["p"]).astype(float), body.astype(float)])
    order = np.arange(n)
    before = np.concatenate([[0], np.cumsum(chars)[:-1]])
    for level in levels[:0:-1]:
        np.add.at(sums, parent[level], sums[level])
    total = np.bincount(page, chars, len(pages))[page]
    page_start = before[starts[:-1]][page] if n else before
    known = parent >= 0
    up = np.where(known, parent, order)
    n_kids = np.bincount(parent[known], minlength=n).astype(float)
    kid_chars = np.bincount(parent[known], sums[known, 0], n)
    rank = np.zeros(n)
    rank[kids_of] = np.arange(n) - first[np.where(parent[kids_of] < 0, 0, parent[kids_of])]
    rank[~known] = 0
    same = known & (group == group[up])
    # The share of the page's text that lies in its first article or main, for the nodes outside of all of them.
    opens = np.flatnonzero(body)
    _, at = np.unique(page[opens], return_index=True)
    share = np.zeros(len(pages))
    share[page[opens[at]]] = sums[opens[at], 0] / np.maximum(total[opens[at]], 1)
    elsewhere = np.where(in_body | body, 0, share[page]) if n else np.zeros(0)
    alike = np.bincount(parent[known] * (OTHER + 1) + group[known], minlength=n * (OTHER + 1)) if n else np.zeros(0)
    alike = np.where(known, alike[np.where(known, parent * (OTHER + 1) + group, 0)], 1) if n else np.zeros(0)
    one_hot = np.eye(OTHER + 1)
    x = np.column_stack([
        one_hot[group], one_hot[group[up]], flag, above, depth, away, in_body,
        np.log1p(sums[:, 0]), sums[:, 1] / np.maximum(sums[:, 0], 1), sums[:, 2] / np.maximum(sums[:, 0], 1), sums[:, 0] / (sums[:, 3] + 1),
        np.log1p(sums[:, 4]), sums[:, 5], sums[:, 0] / np.maximum(total, 1), (before - page_start) / np.maximum(total, 1),
        np.log1p(sums[up, 0]), sums[up, 1] / np.maximum(sums[up, 0], 1), np.log1p(n_kids[up]), kid_chars[up] / np.maximum(n_kids[up], 1), rank / np.maximum(n_kids[up], 1),
        alike / np.maximum(n_kids[up], 1), same, elsewhere,
    ]) if n else np.zeros((0, 1))
    return x.astype(np.float64), parent, depth


def decode(odds: np.ndarray, parent: np.ndarray, depth: np.ndarray, is_text: np.ndarray) -> np.ndarray:
    """The best set of nodes that holds each node's parent, and of each element some child.

    Elements count by their own odds and the good ones of their children, or else the least bad one (the first, of equals).
    """
    n = len(odds)
    best = odds.astype(np.float64)
    below, top, least_bad = np.zeros(n), np.full(n, -np.inf), np.full(n, n)
    by_depth = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
    for level in reversed(by_depth):
        inner = level[~is_text[level]]
        best[inner] += np.where(below[inner] > 0, below[inner], top[inner])
        held = level[parent[level] >= 0]
        np.add.at(below, parent[held], np.maximum(best[held], 0))
        np.maximum.at(top, parent[held], best[held])
        first = held[best[held] == top[parent[held]]]
        np.minimum.at(least_bad, parent[first], first)
    kept = best > 0
    for level in by_depth[1:]:
        up = parent[level]
        kept[level] = kept[up] & (kept[level] | ((below[up] <= 0) & (least_bad[up] == level)))
    return kept


def mains(pages: list[Page], model: trees.Boosted) -> list[str]:
    x, parent, depth = features(pages)
    if not len(x):
        return [""] * len(pages)
    is_text = np.fromiter((t == "#text" for p in pages for t in p.tag), bool, len(x))
    kept = decode(model.score(x), parent, depth, is_text)
    out, at = [], 0
    for p in pages:
        out.append(p.blocks(kept[at : at + len(p.tag)].tolist()))
        at += len(p.tag)
    return out


#: Stands before each main text of a generated page.
MARK = "\ue000"


class Generator:
    """Pages with known main text, in layouts that real sites use."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice(("ta", "ri", "mo", "ne", "lu", "sha", "ver", "en", "qui", "bo", "é", "ß", "and")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        s = self.words(low, high)
        if self.rng.random() < 0.05:
            s = " ".join(w + self.rng.choice(("***", "%%%", "!!", " |", "&amp;&amp;")) for w in s.split())
        return s.capitalize() + self.rng.choice((".", ".", ".", "?", "!", ""))

    def prose(self, most: int) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))

    def links(self, tag: str) -> str:
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, 2)}</a>' for _ in range(self.rng.randint(2, 9))]
        return f"<{tag}>" + "".join(f"<li>{a}</li>" for a in items) + f"</{tag}>" if tag in ("ul", "ol") else " ".join(items)

    def named(self, tag: str, names: tuple[str, ...], sure: bool = False) -> str:
        r = self.rng
        if not sure and r.random() < 0.4:
            return f"<{tag}>"
        return f'<{tag} {r.choice(("class", "class", "id"))}="{r.choice(names)}{r.choice(("", "", "-1", " box", "-wrap"))}">'

    def aside_parts(self) -> list[str]:
        r, out = self.rng, []
        if r.random() < 0.7:
            t = r.choice(("nav", "nav", "div"))
            out.append(self.named(t, ("menu", "nav", "navbar", "breadcrumbs"), t == "div") + self.links(r.choice(("ul", "ul", "x"))) + f"</{t}>")
        if r.random() < 0.35:
            t = r.choice(("header", "div"))
            out.append(self.named(t, ("header", "masthead", "topbar"), t == "div") + r.choice((f"<h1>{self.words(1, 3)}</h1>", "")) + f"<p>{self.sentence(2, 8)}</p></{t}>")
        if r.random() < 0.6:
            out.append(self.named("div", ("ad", "ads", "advert", "banner", "sponsored", "promo"), True) + r.choice(("", "<p>")) + self.prose(2) + "</div>")
        if r.random() < 0.3:
            out.append(self.named("div", ("notice", "cookie-consent", "newsletter", "alert", "popup"), True) + f"<p>{self.prose(2)}</p>" + r.choice(("", "<button>ok</button>")) + "</div>")
        if r.random() < 0.2:
            out.append(f'<form action="/s"><label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 1)}</button></form>')
        r.shuffle(out)
        return out

    def comments(self, known: bool) -> str:
        """Reader comments; without a name that is ``known``, only their place outside the article and their form tell them apart."""
        r = self.rng
        t = r.choice(("section", "div", "ol"))
        if known:
            inner = "".join(self.named(r.choice(("div", "article", "li")), ("comment", "reply"), True) + f"<p>{self.prose(3)}</p>" for _ in range(r.randint(1, 5)))
            return self.named(t, ("comments", "discussion", "replies"), True) + f"<h2>{self.words(1, 2)}</h2>" + inner + f"</{t}>"
        tag = "li" if t == "ol" else "div"
        who = lambda: r.choice(("", f"<b>{self.words(1, 2)}</b>", f'<a href="/u">{self.words(1, 2)}</a> '))
        inner = "".join(f"<{tag}>{who()}<p>{self.prose(3)}</p></{tag}>" for _ in range(r.randint(2, 6)))
        return self.named(t, ("thread", "talk", "u7", "box", "c")) + r.choice(("", f"<h3>{self.words(1, 2)}</h3>")) + inner + f"</{t}>"

    def late_parts(self, inside: bool) -> list[str]:
        """What follows the main text; ``inside``: that has an element of its own."""
        r, out = self.rng, []
        if r.random() < 0.35:
            t = r.choice(("aside", "div"))
            out.append(self.named(t, ("sidebar", "related", "widget", "trending"), t == "div") + f"<h3>{self.words(1, 3)}</h3>" + r.choice((self.links("ul"), f"<p>{self.prose(2)}</p>")) + f"</{t}>")
        if r.random() < 0.35:
            out.append(self.comments(not inside or r.random() < 0.6))
        if r.random() < 0.15:
            out.append(f"<form><textarea>{self.words(1, 3)}</textarea><p>{self.sentence(2, 6)}</p><button>{self.words(1, 1)}</button></form>")
        r.shuffle(out)
        if r.random() < 0.8:
            t = r.choice(("footer", "footer", "div"))
            out.append(self.named(t, ("footer", "copyright", "legal"), t == "div") + f"&copy; {self.words(1, 2)} &middot; {self.prose(2)}" + r.choice(("", self.links("ul"))) + f"</{t}>")
        return out

    def page(self) -> str:
        r = self.rng
        tag, name = r.choice((("article", ""), ("article", ""), ("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"), ("div", "article"), ("section", "story"), ("div", "entry"), ("div", "")))
        body = [f"<h1>{MARK}{self.sentence(1, 9)}</h1>"] if r.random() < 0.8 else []
        if body and r.random() < 0.25:
            body[0] = self.named("header", ("header", "entry-header", "title")) + body[0] + r.choice(("", f"<p>{MARK}{self.sentence(2, 9)}</p>")) + "</header>"
        for k in range(r.choice((1, 1, 2, 4, 8, 20))):
            kind = r.random()
            text = MARK + r.choice((self.prose(8), self.prose(3), self.sentence(1, 4)))
            if kind < 0.78:
                bold = r.random()
                body.append(f"<p><b>{text}<br>" if bold < 0.15 else f"<p>{text}</p>" if bold < 0.9 else f'<p>{text} <a href="/x">{MARK}{self.words(1, 3)}</a> {MARK}{self.words(1, 5)}.</p>')
            elif kind < 0.84:
                body.append("<ul>" + "".join(f"<li>{MARK}{self.sentence(1, 9)}" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.88:
                body.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.92:
                body.append(f"<h2>{MARK}{self.sentence(1, 5)}</h2>")
            elif kind < 0.95:
                body.append(f"<table><tr><td>{MARK}{self.words(1, 3)}<td>{MARK}{self.words(1, 3)}</table>")
            else:
                body.append(f"<div>{text}</div>")
            if k and r.random() < 0.04:
                body.append(self.named("div", ("ad", "share", "related", "newsletter"), True) + self.prose(1) + "</div>")
        main = f'<{tag}{f" class={chr(34)}{name}{chr(34)}" if name else ""}>' + "".join(body) + f"</{tag}>"
        parts = [*self.aside_parts(), main, *self.late_parts(tag in ("article", "main"))]
        inner = "".join(parts)
        if r.random() < 0.3:
            inner = self.named("div", ("wrapper", "page", "container")) + inner + "</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title><script>track(1)</script></head><body>{inner}</body></html>"


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of generated pages: does the subtree hold main text?"""
    made = Generator(seed)
    pages = [Page(made.page()) for _ in range(n)]
    main = np.fromiter((MARK in t for p in pages for t in p.text), float)
    for p in pages:
        p.text = [t.replace(MARK, "") for t in p.text]
    x, parent, depth = features(pages)
    for d in range(int(depth.max()), 0, -1):
        level = np.flatnonzero(depth == d)
        np.maximum.at(main, parent[level], main[level])
    return x, main


@lru_cache(maxsize=1)
def fitted(n: int = TRAINING, seed: int = 1) -> trees.Boosted:
    x, y = labelled(n, seed)
    return trees.boost(x, y, rounds=30, depth=4, rate=0.35, bins=48, share=0.8, column_share=0.7)


def extract(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Adds the main text of a column of pages; the empty text where there is none."""
    small_batches(df.sparkSession)
    schema = replaced(df.schema, text, T.StringType())
    model = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(mains([Page(h) for h in batch.column(html).to_pylist()], model), pa.string())
            yield pa.RecordBatch.from_arrays([values if f.name == text else batch.column(f.name) for f in schema.fields], names=schema.names)

    return df.mapInArrow(run, schema)


def op4_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
