"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read into blocks of text with the tags and class names around them.
Label 1 is main text. The field is trained on labelled pages: a bounded sample
of pages whose one article element tells main blocks from others, each shown in
its own markup and in other common layouts made of the same blocks. Pages are
decoded by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm import crf
from ledgerline.llm.common import map_batches

# At most so many pages are learnt from, taken by a hash of their id.
SAMPLE = 240
# So many other layouts are made of their blocks, however few pages there are.
LAYOUTS = 1_000

# HTML element names and the name parts of the classes looked for.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "head", "title", "object", "canvas", "math")
REGIONS = ["nav", "header", "footer", "aside", "form", "article", "main", "section", "table", "ul", "ol", "dialog", "menu", "figure", "button", "blockquote", "pre", "dl"]
NAMES = {
    "navigation": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc topbar",
    "page head": "header masthead banner hero logo",
    "page foot": "footer foot copyright colophon legal",
    "side": "sidebar side aside widget widgets rail related recommended recommendations more popular trending",
    "notice": "notice notices cookie cookies consent gdpr alert popup modal overlay announcement warning",
    "advert": "ad ads advert adverts advertisement advertising promo promotion sponsor sponsored sponsors banner-ad",
    "reader": "comment comments reply replies respond discussion disqus thread feedback review reviews",
    "act": "form share sharing social login signup subscribe subscription newsletter search button buttons follow",
    "text": "article content contents post entry story body text main page prose",
}
_CLASS_OF = {w: i for i, (_, ws) in enumerate(NAMES.items()) for w in ws.split()}
BLOCK_TAGS = ["p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "div", "td", "span", "blockquote", "pre", "dd", "dt", "other"]

_HIDDEN = "|".join(t for t in HIDDEN if t not in ("head", "object"))
_OPENS = re.compile(rf"<(?:(!--)|({_HIDDEN})\b|(/?)([A-Za-z][^\s/>]*+)|([!?]))", re.I)
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in _HIDDEN.split("|")}
_ATTRIBUTES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BREAK = set(REGIONS) | {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "dt", "dd", "address", "html", "body", "head", "hr", "tbody", "thead", "fieldset", "details", "summary", "figcaption", "legend", "option"}
# What an opening tag of these closes by itself.
_CLOSES_P = _BREAK - {"td", "th", "tr", "html", "body", "head"}


@dataclass
class Block:
    text: str
    tag: str
    regions: int  # bit per region around it
    names: int  # bit per class of names around it
    linked: int  # characters inside links


@lru_cache(maxsize=4096)
def _marks(tag: str, attributes: str) -> tuple[int, int]:
    """Region and name bits of one opening tag."""
    region = 1 << REGIONS.index(tag) if tag in REGIONS else 0
    names = 0
    for _, value in _ATTRIBUTES.findall(attributes):
        for part in _PARTS.findall(value.strip("\"'")):
            i = _CLASS_OF.get(part.lower())
            if i is not None:
                names |= 1 << i
    return region, names


def markup(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, tag, attributes) of everything that is markup, in page order; no tag for what is left out whole.

    Comments and hidden elements reach to their end or that of the page. A tag ends at the
    first > outside quotes; one that has none is text. Quotes, ends and names that led nowhere
    are not followed a second time, so the work grows with the page, whatever it holds.
    """
    marks = [(m.start(), m[0]) for m in re.finditer("[>\"']", page)]
    places = [p for p, _ in marks]
    partner: list[int] = [0] * len(marks)
    later = {">": -1, '"': -1, "'": -1}
    for i in range(len(marks) - 1, -1, -1):
        partner[i] = later[marks[i][1]]
        later[marks[i][1]] = i
    last, dead = page.rfind(">"), set()

    def tag_end(at: int) -> int:
        i, passed = bisect_left(places, at), []
        while 0 <= i < len(marks) and i not in dead:
            if marks[i][1] == ">":
                return places[i]
            passed.append(i)
            i = partner[i] + 1 if partner[i] >= 0 else -1
        dead.update(passed)
        return -1

    at = page.find("<")
    while at >= 0:
        m = _OPENS.match(page, at)
        end, slash, tag, attributes = 0, "", "", ""
        if m is None:
            pass
        elif m[1]:
            close = page.find("-->", m.end())
            end = close + 3 if close >= 0 else len(page)
        elif m.end() > last:
            pass
        elif m[2] or m[5]:
            end = page.find(">", m.end()) + 1
            if m[2] and not page.endswith("/", m.end(), end - 1):
                close = _ENDS[m[2].lower()].search(page, end)
                end = close.end() if close else len(page)
        else:
            close = tag_end(m.end())
            if close >= 0:
                end, slash, tag, attributes = close + 1, m[3], m[4].lower(), page[m.end() : close]
        if end:
            yield at, end, slash, tag, attributes
        # Every < inside a name that led nowhere would lead there as well.
        at = page.find("<", end or (m.end() if m else at + 1))


class _Open:
    """Elements that are open: (tag, regions, names) from the page inwards, found again without a search."""

    def __init__(self):
        self.stack: list[tuple[str, int, int]] = [("", 0, 0)]
        self.blocks = [0]  # places of those that are not inline
        self.inline = [Counter()]  # open inline tags inside each of these
        self.tags: Counter = Counter()  # open other tags

    def push(self, tag: str, region: int, names: int):
        _, regions, around = self.stack[-1]
        if tag in INLINE:
            self.inline[-1][tag] += 1
        else:
            self.blocks.append(len(self.stack)), self.inline.append(Counter())
            self.tags[tag] += 1
        self.stack.append((tag, regions | region, around | names))

    def cut(self, place: int):
        while len(self.stack) > place:
            tag = self.stack.pop()[0]
            if tag in INLINE:
                self.inline[-1][tag] -= 1
            else:
                self.blocks.pop(), self.inline.pop()
                self.tags[tag] -= 1

    def end(self, tag: str):
        """An end tag; an inline one does not close the blocks it is in."""
        if tag in INLINE:
            if self.inline[-1][tag]:
                self.cut(next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i][0] == tag))
        elif self.tags[tag]:
            self.cut(next(i for i in reversed(self.blocks) if self.stack[i][0] == tag))

    def block(self) -> tuple[str, int, int]:
        return self.stack[self.blocks[-1]]


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: references decoded, white space one space, trimmed, empty ones left out."""
    out: list[Block] = []
    open_ = _Open()
    pieces: list[str] = []
    place = open_.stack[0]
    linked = anchors = at = 0
    blank = True

    def close():
        nonlocal linked, blank
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, place[0], place[1], place[2], linked))
            pieces.clear()
        linked, blank = 0, True

    def add(text: str):
        nonlocal place, linked, blank
        if text:
            if blank:
                place = (open_.block()[0], *open_.stack[-1][1:])
                blank = not text.strip()
            pieces.append(text)
            if anchors:
                linked += len(text)

    for start, end, slash, tag, attributes in markup(page):
        add(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            close()
        if slash:
            if tag == "a":
                anchors = max(0, anchors - 1)
            open_.end(tag)
            continue
        if tag in VOID or attributes.endswith("/") and tag in INLINE:
            continue
        if tag in _CLOSES_P or tag == "li":
            same = {"p"} | ({"li"} if tag == "li" else {"dt", "dd"} if tag in ("dt", "dd") else set())
            if open_.block()[0] in same:
                open_.cut(open_.blocks[-1])
        if tag == "a":
            anchors += 1
        open_.push(tag, *_marks(tag, attributes))
    add(page[at:])
    close()
    return out


_N_TEXT = 14
N_FEATURES = 1 + len(REGIONS) + 2 * len(NAMES) + len(BLOCK_TAGS) + _N_TEXT
_BYLINE = re.compile(r"©|\bcopyright\b|all rights reserved", re.I)


def features(page: list[Block]) -> list[list[int]]:
    """Numbers of each block's features: around it, its tag, its text and place."""
    out = []
    inside = 1 << REGIONS.index("article") | 1 << REGIONS.index("main")
    for k, b in enumerate(page):
        f = [0]
        f += [1 + i for i in range(len(REGIONS)) if b.regions >> i & 1]
        at = 1 + len(REGIONS)
        within = len(NAMES) if b.regions & inside else 0
        f += [at + within + i for i in range(len(NAMES)) if b.names >> i & 1]
        at += 2 * len(NAMES)
        f.append(at + (BLOCK_TAGS.index(b.tag) if b.tag in BLOCK_TAGS else len(BLOCK_TAGS) - 1))
        at += len(BLOCK_TAGS)
        n = b.text.count(" ") + 1
        f.append(at + (0 if n < 3 else 1 if n < 8 else 2 if n < 20 else 3 if n < 60 else 4))
        share = b.linked / len(b.text)
        f.append(at + (5 if share < 0.05 else 6 if share < 0.5 else 7))
        if b.text[-1] in ".!?…\"”":
            f.append(at + 8)
        if _BYLINE.search(b.text):
            f.append(at + 9)
        f.append(at + (10 if k * 10 < len(page) else 11 if (len(page) - k) * 10 <= len(page) else 12))
        if not b.regions & inside:
            f.append(at + 13)
        out.append(f)
    return out


_ARTICLE = 1 << REGIONS.index("article")


def _layouts(main: list[str], others: list[str], count: int, rng: random.Random) -> list[tuple[str, list[int]]]:
    """Pages of other layouts made of the same blocks, with the labels of their blocks."""
    spare = [" ".join(o.split()[: rng.randint(2, 14)]) for o in others + main if o.strip()] or ["menu"]
    pick = lambda: rng.choice(spare)
    esc = html.escape

    def wrap(kind: str) -> tuple[str, list[int]]:
        many = [pick() for _ in range(rng.randint(1, 4))]
        long = [rng.choice(main) for _ in range(rng.randint(1, 2))] if rng.random() < 0.5 else many
        p = "".join(f"<p>{esc(t)}</p>" for t in long)
        li = "".join(f'<li><a href="#">{esc(t)}</a></li>' for t in many)
        name = rng.choice(
            {
                "side": ["sidebar", "side-bar", "widget", "related-posts", "rail"],
                "notice": ["cookie-notice", "notice", "cookie-banner", "alert", "consent", "gdpr-popup"],
                "ad": ["ad", "advert", "ads", "sponsored", "promo", "advertisement"],
                "reader": ["comments", "comment-list", "replies", "discussion"],
                "foot": ["footer", "site-footer", "copyright"],
                "head": ["header", "site-header", "masthead", "top-banner"],
                "nav": ["menu", "nav", "navbar", "breadcrumbs"],
                "act": ["share", "newsletter", "subscribe-form", "login", "search"],
            }[kind]
        )
        key = rng.choice(["class", "id"])
        shape = {
            "side": [f"<aside>{p}</aside>", f'<aside {key}="{name}"><ul>{li}</ul></aside>', f'<div {key}="{name}">{p}</div>', f'<div {key}="{name}"><h3>{esc(pick())}</h3><ul>{li}</ul></div>'],
            "notice": [f'<div {key}="{name}">{p}</div>', f'<section {key}="{name}">{p}</section>', f'<div {key}="{name}" role="alert">{esc(pick())}</div>', f"<dialog>{p}</dialog>"],
            "ad": [f'<div {key}="{name}">{p}</div>', f'<div {key}="{name}">{esc(pick())}</div>', f'<section {key}="{name}">{p}</section>', f'<aside {key}="{name}">{p}</aside>'],
            "reader": [f'<section {key}="{name}"><h2>{esc(pick())}</h2>{p}</section>', f'<div {key}="{name}">{p}</div>', f'<div {key}="{name}"><article class="comment">{p}</article></div>', f'<ol {key}="{name}"><li class="comment">{p}</li></ol>'],
            "foot": [f"<footer>{p}</footer>", f'<footer {key}="{name}">{esc(pick())}</footer>', f'<div {key}="{name}">{p}</div>', f"<footer>© {esc(pick())}</footer>"],
            "head": [f"<header>{esc(pick())}</header>", f'<header {key}="{name}"><h1>{esc(pick())}</h1></header>', f'<div {key}="{name}">{esc(pick())}</div>', f"<header><h1>{esc(pick())}</h1><p>{esc(pick())}</p></header>"],
            "nav": [f"<nav><ul>{li}</ul></nav>", f'<nav>{"".join(f"<a href=x>{esc(t)}</a> " for t in many)}</nav>', f'<div {key}="{name}"><ul>{li}</ul></div>', f'<ul {key}="{name}">{li}</ul>', f"<menu>{li}</menu>"],
            "act": [f"<form><label>{esc(pick())}</label><button>{esc(pick())}</button></form>", f'<form {key}="{name}"><p>{esc(pick())}</p></form>', f'<div {key}="{name}">{esc(pick())}</div>', f"<form>{p}</form>"],
        }[kind]
        text = rng.choice(shape)
        return text, [0] * len(blocks(text))

    def body() -> tuple[str, list[int]]:
        start = rng.randrange(len(main))
        own = main[start : start + rng.randint(2, 12)]
        parts, labels = [], []
        if rng.random() < 0.7:
            h = esc(pick())
            parts.append(rng.choice([f"<h1>{h}</h1>", f"<h2>{h}</h2>", f"<header><h1>{h}</h1></header>"])), labels.append(1)
        for i, t in enumerate(own):
            shape = rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p><b>{}</b></p>", "<p>{}", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<div>{}</div>", "<h2>{}</h2>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>"])
            short = esc(t if rng.random() < 0.7 else " ".join(t.split()[: rng.randint(1, 8)]))
            parts.append(shape.format(short)), labels.append(1)
            if rng.random() < 0.2:
                x, y = wrap(rng.choice(["ad", "ad", "side", "act", "notice"]))
                parts.append(x), labels.extend(y)
        return "\n".join(parts), labels

    pages = []
    for _ in range(count):
        own, labels = body()
        inner, ends = "", []
        if rng.random() < 0.3:
            inner, ends = wrap("reader")
        frame = rng.choice(
            ["<article>{}</article>", "<div>{}</div>", "<div>{}</div>", "{}", '<div id="wrapper"><div>{}</div></div>', "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<div class="post-body">{}</div>', '<section class="entry">{}</section>', '<article class="post"><div class="entry-content">{}</div></article>']
        )
        before = [wrap(k) for k in ("head", "nav", "notice", "ad", "side") if rng.random() < 0.6]
        after = [wrap(k) for k in ("reader", "act", "ad", "side", "notice", "foot") if rng.random() < 0.6]
        text = "<html><body>" + "".join(x for x, _ in before) + frame.format(own + inner) + "".join(x for x, _ in after) + "</body></html>"
        want = [y for _, ys in before for y in ys] + labels + ends + [y for _, ys in after for y in ys]
        if len(blocks(text)) == len(want):
            pages.append((text, want))
    return pages


def fit(pages: list[str], seed: int = 5) -> crf.Crf:
    """Train on the pages that have article elements with text outside them, and on layouts made of their blocks."""
    rng = random.Random(seed)
    labelled = [(own, [int(bool(b.regions & _ARTICLE)) for b in own]) for own in map(blocks, pages)]
    labelled = [(own, label) for own, label in labelled if 0 < sum(label) < len(label)]
    examples = list(labelled)
    for own, label in labelled:
        main = [b.text for b, y in zip(own, label) if y]
        other = [b.text for b, y in zip(own, label) if not y]
        examples += [(blocks(text), want) for text, want in _layouts(main, other, -(-LAYOUTS // len(labelled)), rng)]
    if not examples:
        weights = np.zeros(N_FEATURES)
        weights[1 + REGIONS.index("article")] = 4.0
        return crf.Crf(weights, np.zeros((2, 2)))
    feats = [f for own, _ in examples for f in features(own)]
    bounds = np.concatenate([[0], np.cumsum([len(f) for f in feats])])
    start = np.concatenate([[i == 0 for i in range(len(own))] for own, _ in examples])
    label = np.concatenate([y for _, y in examples]).astype(np.int64)
    return crf.fit(np.concatenate(feats).astype(np.int64), bounds, start, label, N_FEATURES, rounds=150)


def main_text(model: crf.Crf, page: str | None) -> str:
    """The blocks the field labels as main text, joined by one space."""
    own = blocks(page or "")
    score = [float(sum(model.weights[f])) for f in features(own)]
    return " ".join(b.text for b, y in zip(own, crf.viterbi(score, model.cross.tolist())) if y)


def train(pages: DataFrame, most: int = SAMPLE, id_column: str = "page_id", html_column: str = "html") -> crf.Crf:
    chosen = pages.where(F.col(html_column).isNotNull()).select(F.col(html_column).alias("h"), F.xxhash64(F.col(id_column), F.col(html_column)).alias("k"))
    return fit([r["h"] for r in chosen.orderBy("k").limit(most).collect()])


def extract(pages: DataFrame, model: crf.Crf | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null, empty and text-free pages have an empty text. Markup that is never
    closed, stray end tags and broken references are read as far as they go.
    Repeated rows give the same text; other columns are not read.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or train(pages, id_column=id_column, html_column=html_column))

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(sent.value, h) for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return map_batches(rows, read, "page_id long, url string, text string, n_chars long")
