"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into blocks of text between the tags that break lines. Each block is described by its ancestors' tags and
the words of their classes and ids, and by its text: length, links, punctuation. The field, trained on labelled pages
(which a seeded generator writes in many layouts, as no labelled ones are at hand), gives each block a weight for
being part of the article, and a weight to each step from block to block; the best sequence is found by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Pages the field is trained on, and steps of the training.
PAGES, STEPS = 600, 150
#: Fixed values of HTML: elements without content, elements whose content is no text, and elements inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript svg head title iframe textarea select datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br label math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtext munder munderover semantics audio canvas object video".split())
ALONE = frozenset("p li dt dd td th tr option".split())
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    path: tuple[tuple[str, tuple[str, ...]], ...]  # tag and name words of each ancestor, outermost first


@lru_cache(maxsize=4096)
def _names(attributes: str) -> tuple[str, ...]:
    found = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
    return tuple(dict.fromkeys(w.lower() for w in _WORD.findall(found)))


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks in page order; references decoded, white space turned into single spaces, empty ones left out."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        if parts and (text := " ".join("".join(parts).split())):
            out.append(Block(text, min(linked, len(text)), tuple(stack)))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        closing = bool(m[1])
        if tag in HIDDEN and not closing:
            if tag == "head" or m[3].endswith("/"):
                continue  # what is in a head is hidden by its own elements
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = max(0, links + (-1 if closing else 1))
            continue
        flush()
        links = 0
        if closing:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
        elif tag not in VOID and not m[3].endswith("/"):
            if stack and stack[-1][0] == "p" or (stack and tag in ALONE and stack[-1][0] == tag):
                stack.pop()
            stack.append((tag, _names(m[3])))
    add(page[at:])
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features of each block."""
    out, before = [], ()
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        link = b.linked / len(b.text)
        own = {"bias", f"parent={b.path[-1][0] if b.path else ''}", f"words={min(words.bit_length(), 8)}", f"links={int(link * 4)}", f"long&links={words > 12}{link > 0.4}"}
        for tag, names in b.path:
            own.add(f"in={tag}")
            own.update(f"name={n}" for n in names)
        own.add(f"end={b.text[-1] if b.text[-1] in '.!?:,;' else 'x'}")
        if b.text[0] == "©" or "©" in b.text[:40]:
            own.add("copyright")
        own.add("first" if i == 0 else "last" if i == len(blocks) - 1 else "middle")
        shared = 0
        for x, y in zip(before, b.path, strict=False):
            if x != y:
                break
            shared += 1
        own.add(f"same-parent={shared == len(b.path) - 1}")
        before = b.path
        out.append(sorted(own))
    return out


@dataclass
class Field:
    ids: dict[str, int]
    weights: np.ndarray  # of the article label, by feature
    steps: np.ndarray  # (2, 2)

    def decode(self, rows: list[list[str]]) -> list[bool]:
        """The most likely labels, by Viterbi."""
        get, w = self.ids.get, self.weights
        a = self.steps.tolist()
        back, best = [], None
        for names in rows:
            gain = sum(w[k] for n in names if (k := get(n)) is not None)
            if best is None:
                best = [0.0, gain]
                continue
            came = [int(best[1] + a[1][y] > best[0] + a[0][y]) for y in (0, 1)]
            best = [best[came[y]] + a[came[y]][y] + (gain if y else 0.0) for y in (0, 1)]
            back.append(came)
        if best is None:
            return []
        at = int(best[1] > best[0])
        labels = [at]
        for came in reversed(back):
            at = came[at]
            labels.append(at)
        return [bool(x) for x in reversed(labels)]


def train(pages: list[tuple[list[list[str]], list[bool]]], steps: int = STEPS, ridge: float = 2e-3) -> Field:
    """Maximises the conditional likelihood of the labels by full gradients (forward-backward over all pages at once)."""
    ids: dict[str, int] = {}
    for rows, _ in pages:
        for names in rows:
            for n in names:
                ids.setdefault(n, len(ids))
    count, length = len(pages), max(len(r) for r, _ in pages)
    wide = max(len(n) for r, _ in pages for n in r)
    at = np.full((count, length, wide), len(ids))
    y, real = np.zeros((count, length), dtype=int), np.zeros((count, length), dtype=bool)
    for i, (rows, labels) in enumerate(pages):
        for j, names in enumerate(rows):
            at[i, j, : len(names)] = [ids[n] for n in names]
        y[i, : len(labels)], real[i, : len(labels)] = labels, True
    w, a = np.zeros(len(ids) + 1), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)]
    blocks = real.sum()
    for step in range(1, steps + 1):
        gain = np.stack([np.zeros(real.shape), w[at].sum(2)], axis=2)
        forward, backward = np.zeros(gain.shape), np.zeros(gain.shape)
        forward[:, 0] = gain[:, 0]
        for j in range(1, length):
            new = np.logaddexp(forward[:, j - 1, :1] + a[0], forward[:, j - 1, 1:] + a[1]) + gain[:, j]
            forward[:, j] = np.where(real[:, j, None], new, forward[:, j - 1])
        for j in range(length - 2, -1, -1):
            x = gain[:, j + 1] + backward[:, j + 1]
            new = np.logaddexp(a[:, 0] + x[:, :1], a[:, 1] + x[:, 1:])
            backward[:, j] = np.where(real[:, j + 1, None], new, 0.0)
        whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        p = np.exp(forward + backward - whole[:, None, None])[:, :, 1]
        error = np.where(real, y - p, 0.0)
        gw = np.bincount(at.ravel(), np.repeat(error.ravel(), wide), len(w)) / blocks - ridge / 10 * w
        gw[-1] = 0
        pair = forward[:, :-1, :, None] + a + (gain + backward)[:, 1:, None, :] - whole[:, None, None, None]
        both = real[:, 1:]
        expected = np.exp(pair[both]).sum(0)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
        ga = (seen - expected) / blocks - ridge / 10 * a
        for k, (x, g) in enumerate(((w, gw), (a, ga))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(ids, w[:-1], a)


def labelled_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page in a random layout, and for each of its blocks whether it is of the article."""
    vowels = "aeiou"
    word = lambda: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice(vowels) for _ in range(rng.randint(1, 4)))
    sentence = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi))).capitalize() + rng.choice([".", ".", ".", "", "!", "?"])
    para = lambda: " ".join(sentence(2, 18) for _ in range(rng.choice([1, 1, 1, 2, 3, 6])))
    link = lambda t: f'<a href="/{word()}">{t}</a>'
    labels: list[bool] = []

    def put(text: str, good: bool, tag: str = "p") -> str:
        labels.append(good)
        return f"<{tag}>{text}</{tag}>"

    def named(tag: str, *names: str) -> str:
        return f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(names)}">'

    def menu(tag: str) -> str:
        return "<ul>" + "".join(put(link(word()), False, "li") for _ in range(rng.randint(2, 7))) + "</ul>" if rng.random() < 0.8 else put(" ".join(link(word()) for _ in range(4)), False, tag)

    def box(kind: str) -> str:
        n = rng.randint(1, 3)
        prose = lambda: "".join(put(para(), False, rng.choice(["p", "div"])) for _ in range(n))
        bare = lambda: put(para(), False, "div")[5:-6]
        if kind == "nav":
            start = rng.choice(["<nav>", named("nav", "menu", "main-nav"), named("div", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav")])
            return start + menu("div") + f"</{start[1:4]}>"
        if kind == "header":
            return rng.choice(["<header>", named("header", "site-header", "top")]) + put(sentence(1, 4), False, rng.choice(["div", "h1", "h2", "p"])) + (put(sentence(2, 7), False) if rng.random() < 0.5 else "") + "</header>"
        if kind == "footer":
            start = rng.choice(["<footer>", "<footer>", named("div", "footer", "site-footer", "copyright", "bottom")])
            return start + rng.choice([prose, bare])() + (put("&copy; " + sentence(1, 6), False) if rng.random() < 0.6 else "") + ("</footer>" if start.startswith("<footer") else "</div>")
        if kind == "side":
            start = rng.choice(["<aside>", named("aside", "sidebar", "related"), named("div", "sidebar", "side", "widget", "related", "recommended", "popular", "rail", "links")])
            return start + (put(sentence(1, 3), False, "h3") if rng.random() < 0.6 else "") + rng.choice([menu, lambda _: prose()])("div") + f"</{'aside' if start.startswith('<aside') else 'div'}>"
        if kind == "ad":
            return named(rng.choice(["div", "section"]), "ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "ad-slot").replace("<section", "<div") + rng.choice([bare, prose])() + "</div>"
        if kind == "notice":
            return named("div", "cookie", "cookies", "notice", "consent", "alert", "cookie-banner", "gdpr", "popup", "modal", "newsletter", "subscribe", "paywall") + rng.choice([bare, prose])() + (put(word(), False, "button") if rng.random() < 0.5 else "") + "</div>"
        if kind == "form":
            return "<form>" + put(sentence(1, 5), False, rng.choice(["p", "div", "legend", "fieldset"])) + (put(word(), False, "button") if rng.random() < 0.7 else "") + "</form>"
        if kind == "share":
            return named("div", "share", "social", "tags", "toolbar", "pagination", "pager") + put(" ".join(link(word()) for _ in range(3)), False, "div")[5:-6] + "</div>"
        start = rng.choice([named("section", "comments", "comment-list", "responses", "discussion", "replies"), named("div", "comments", "comment", "disqus", "responses", "reviews")])
        inner = "".join(f'<{t} class="{rng.choice(["comment", "reply", "comment-body", "response"])}">' + put(para(), False) + f"</{t}>" for t in [rng.choice(["div", "li", "article"])] * n) if rng.random() < 0.7 else prose()
        return start + (put(sentence(1, 3), False, "h3") if rng.random() < 0.6 else "") + inner + f"</{start[1:4] if start[1] == 'd' else 'section'}>"

    def body() -> str:
        out = []
        if rng.random() < 0.9:
            out.append(put(sentence(1, 12), True, rng.choice(["h1", "h1", "h2"])))
        for _ in range(rng.choice([1, 2, 4, 8, 14, 22])):
            kind = rng.random()
            if kind < 0.72:
                text = para()
                out.append(put(text if rng.random() < 0.8 else text + " " + link(sentence(1, 3)), True, "p"))
            elif kind < 0.78:
                out.append(put(sentence(1, 7), True, rng.choice(["h2", "h3"])))
            elif kind < 0.84:
                out.append("<ul>" + "".join(put(sentence(1, 9), True, "li") for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.88:
                out.append("<blockquote>" + put(para(), True) + "</blockquote>")
            elif kind < 0.9:
                out.append(put(sentence(3, 12), True, rng.choice(["pre", "figcaption", "div"])))
            elif kind < 0.92:
                out.append("<table><tr>" + "".join(put(word(), True, "td") for _ in range(4)) + "</tr></table>")
            elif kind < 0.96:
                out.append(box("ad"))
            else:
                out.append(box(rng.choice(["share", "side", "form", "notice"])))
        return "".join(out)

    parts = ["<html><head><title>x</title><style>p{}</style></head><body>"]
    for kind, often in (("notice", 0.3), ("header", 0.5), ("nav", 0.7), ("form", 0.2), ("ad", 0.4), ("side", 0.2)):
        if rng.random() < often:
            parts.append(box(kind))
    outer = rng.choice(["<article>", "<article>", "<article>", named("article", "post", "entry"), "<main>", "<main><article>", named("div", "content", "article", "post", "entry-content", "story", "main", "main-content", "post-body", "article-body", "text")])
    parts.append(outer + body())
    if rng.random() < 0.25:
        parts.append(box(rng.choice(["comments", "share", "side", "ad"])))
    parts.append("".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", outer))))
    for kind, often in (("comments", 0.4), ("side", 0.4), ("share", 0.2), ("form", 0.2), ("ad", 0.3), ("footer", 0.8), ("notice", 0.2)):
        if rng.random() < often:
            parts.append(box(kind))
    return "".join(parts) + "</body></html>", labels


def training_pages(count: int = PAGES, seed: int = 11) -> list[tuple[list[list[str]], list[bool]]]:
    rng, out = random.Random(seed), []
    while len(out) < count:
        page, labels = labelled_page(rng)
        rows = features(blocks_of(page))
        assert len(rows) == len(labels)
        out.append((rows, labels))
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(training_pages())


def main_text(field: Field, page: str | None) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, good in zip(blocks, field.decode(features(blocks)), strict=True) if good)


def extract(pages: DataFrame, html_column: str = "html", field: Field | None = None) -> DataFrame:
    """pages with the column text (replaced if there is one): the article's blocks, in order, joined by line feeds.

    A null or empty page, or one without blocks of an article, has the empty text. Pages are read whole and one by one,
    however long, without a shuffle; repeated rows are treated alike, and there are no ties: Viterbi's path takes the first
    of equals. White space is what Unicode calls so, no-break and ideographic spaces included. An empty table gives no
    rows. Other columns stay as they are.
    """
    sent = pages.sparkSession.sparkContext.broadcast(field or default_field())  # bounded by the training pages

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([main_text(sent.value, p) for p in part], dtype=object)

    return pages.withColumn("text", run(F.col(html_column)))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
