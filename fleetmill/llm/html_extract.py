"""HTML extraction: flat text blocks, classified by a decision tree that is trained on the labelled blocks of some pages.

A page is cut into blocks at block-level tags. A block's features are its words and link density, those of the blocks
before and after it, where it stands (in an article; in a page that has none; outside of the page's article), whether
an element around it is a menu, header, footer, sidebar or form, what a class, id or role around it suggests (advertising,
menus, comments and the like; or a word that articles use too, such as notice or related), and whether it is a heading.
A tree fitted to the blocks of PAGES keeps or drops it; which features decide is what the fit finds.

Defined cases: a null or empty page, or one without kept blocks, has an empty text; markup that isn't closed ends with
the page; repeated pages are treated alike; an empty table gives an empty result; other columns pass through unless
named text or n_chars, which this operator sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "frame", "hint", "heading")

#: The labelled table, as pages: +n is a block's text of n words to keep, -n one of n words to drop.
PAGES = [
    # a weblog with an article's element, an advert, a notice and an aside within it
    """<header><div>-2</div><nav><ul><li><a>-1</a></li><li><a>-1</a></li><li><a>-2</a></li></ul></nav></header><div class="ad">-12</div>
    <article><header><h1>+9</h1><p>+6</p></header><p>+60</p><p>+45 <a>+3</a></p><p>+2</p><div class="advert">-14</div><p>+80</p><aside><h3>-3</h3><p>-30</p><a>-5</a></aside><p>+1</p><p>+14</p>
    <div class="notice">-13</div><blockquote>+22</blockquote><p>+35</p></article><aside><h4>-2</h4><p>-25</p></aside><footer>-8 <a>-2</a></footer>""",
    # medical advice: class names that elsewhere are the frame's
    """<nav><a>-1</a><a>-2</a></nav><main><h1>+5</h1><div class="intro"><p>+40</p></div><section class="side-effects"><h2>+2</h2><p>+55</p><ul><li>+4</li><li>+3</li><li>+5</li></ul></section>
    <section class="reviews"><h2>+3</h2><p>+62</p><p>+48</p></section><section class="related"><h2>-2</h2><ul><li><a>-5</a></li><li><a>-6</a></li><li><a>-4</a></li></ul></section><div class="notice"><p>+58</p></div>
    <div class="social"><a>-1</a><a>-1</a></div></main><footer><p>-20</p></footer>""",
    # an exhibition of one article with readers' comments and a form behind it
    """<div class="topbar"><a>-3</a></div><div class="cookie-notice"><p>-28</p><a>-2</a></div><article><h1>+8</h1><p>+120</p><h2>+4</h2><p>+70</p><p>+3</p><p>+90 <a>+8</a></p></article>
    <section class="comments"><h3>-2</h3><div><p>-2</p><p>-40</p></div><div><p>-2</p><p>-65</p></div></section><form><p>-12</p><label>-2</label></form><footer><a>-2</a><a>-2</a><p>-9</p></footer>""",
    # no elements or names that tell anything: bars of links, text, a short line in it, a list
    """<div><a>-1</a></div><div><a>-1</a></div><div>-1</div><div><a>-2</a></div><div><a>-1</a></div><div>+7</div><div>+50</div><div>+41</div><div>+3</div><div>+66 <a>+4</a></div><div>+28</div>
    <div><a>-4</a></div><div>-2</div><div><a>-5</a></div><div><a>-3</a></div><div><a>-4</a></div><div>-4 <a>-2</a></div>""",
    # the same, with a teaser list between
    """<table><tr><td><a>-1</a></td><td><a>-2</a></td><td>-2</td><td><a>-1</a></td></tr></table><h1>+6</h1><p>+75</p><p>+9</p><p>+33</p><ul><li><a>-7</a></li><li><a>-6</a></li><li>-3</li><li><a>-8</a></li></ul>
    <h2>+3</h2><p>+52</p><p>+5</p><p>+88</p><p><a>-2</a></p><p>-3 <a>-3</a></p><p><a>-2</a></p>""",
    # a shop's page without an article's element; sidebar and advert by name only
    """<div id="nav"><a>-1</a><a>-1</a></div><div class="sidebar"><h3>-2</h3><p>-34</p><p>-16</p></div><div class="content"><h1>+4</h1><p>+38</p><p>+11</p><p>+57</p><p>+2</p><p>+44</p></div>
    <div class="sponsored"><p>-31</p></div><div class="newsletter"><p>-18</p></div><div id="footer"><p>-22</p><a>-2</a></div>""",
    # a recipe: many short blocks
    """<header>-3</header><nav><ul><li><a>-1</a></li><li><a>-1</a></li></ul></nav><article><h1>+4</h1><p>+20</p><ul><li>+2</li><li>+3</li><li>+2</li><li>+4</li><li>+1</li></ul><h2>+1</h2><ol><li>+12</li><li>+9</li><li>+15</li></ol>
    <div class="share"><a>-1</a><a>-2</a></div><p>+7</p></article><div class="recommended"><a>-5</a><a>-6</a></div><footer>-11</footer>""",
    # an encyclopedia's page: links inside text
    """<nav><a>-1</a><a>-2</a><a>-1</a></nav><main><h1>+2</h1><p>+30 <a>+20</a></p><p>+60 <a>+15</a></p><p><a>+4</a></p><h2>+2</h2><p>+25 <a>+22</a></p><ul><li>+3 <a>+2</a></li><li>+2 <a>+2</a></li></ul></main><footer>-15 <a>-6</a></footer>""",
    # menus and notes of many words, outside and inside an article
    """<nav><p>-40</p></nav><div class="banner">-45</div><article><p>+25</p><form><p>-50</p></form><div class="comment"><p>-55</p></div><p>+30</p><div class="promo"><p>-70</p></div><p>+12</p></article><div>-40</div><p>-25</p><div><a>-3</a></div><div>-60</div>""",
    # a page of one paragraph, and a page with nothing but the frame
    """<p>+26</p>""", """<div><a>-2</a></div><div>-1</div><div><a>-3</a></div>""", """<h1>+5</h1><div>+15</div><div>+200</div>""",
    """<div class="menu"><ul><li>-2</li><li>-1</li><li>-3</li></ul></div><p>+48</p><div class="disclaimer">-12</div><p>+21</p><div class="alert">-9</div><p>+64</p><p>+6</p><div class="search">-3</div><div class="copyright">-10</div>""",
    # articles whose links are part of them, that end the page, or that are very short
    """<nav><a>-1</a><a>-1</a></nav><article><h1>+3</h1><p>+40</p><p><a>+6</a></p><ul><li><a>+3</a></li><li><a>+5</a></li><li><a>+2</a></li></ul><p>+4</p></article><div><a>-4</a></div>""",
    """<article><p>+2</p></article>""", """<article><h1>+4</h1><p>+31</p><p><a>+2</a></p><p>+3</p></article>""", """<main><p><a>+1</a></p><p>+1</p></main>""",
    """<article><p>+44</p><p><a>+3</a></p><p><a>+70</a></p><p>+5</p></article><footer><a>-2</a></footer>""", """<div role="navigation"><a>-2</a><a>-3</a></div><div role="main"><div>+12</div><div><a>+3</a></div><div>+9</div><div role="complementary">-26</div></div>""",
    # no names: teasers of many linked words with short labels between, then dialogue in short lines and text with many links
    """<div><a>-11</a></div><div>-3</div><div><a>-14</a></div><div>-2</div><div><a>-12</a></div><div>-4</div><div><a>-13</a></div><h1>+5</h1><div>+34</div><div>+6</div><div>+4</div><div>+7</div><div>+3</div><div>+5</div><div>+2</div><div>+8</div>
    <div>+45 <a>+15</a></div><div>+30 <a>+12</a></div><div>+4</div><div>+21 <a>+8</a></div><div>+38</div><div><a>-15</a></div><div>-3</div><div><a>-12</a></div><div>-5</div><div><a>-18</a></div>""",
    """<p><a>-16</a></p><p>-2</p><p><a>-22</a></p><p>+44 <a>+14</a></p><p>+3</p><p>+5</p><p>+26 <a>+9</a></p><p>+2</p><p>+6</p><p>+58</p><p>-4 <a>-3</a></p><p>-3 <a>-5</a></p><p><a>-20</a></p><p>-3</p><p><a>-9</a></p>""",
    # parts of articles with names that frames have too, and frames with such names
    """<article><h1>+4</h1><p>+30</p><section class="reviews"><h2>+3</h2><p>+24</p><p>+26</p></section><section class="side-notes"><h3>+2</h3><p>+22</p></section><div class="notice"><p>-9</p></div><p>+41</p><section class="feedback"><h2>+3</h2><p>+35</p><p>+20</p></section></article>""",
    """<article><p>+52</p><div class="related"><h3>-2</h3><p><a>-7</a></p><p><a>-5</a></p></div><p>+27</p><div class="alert">-11</div><p>+12</p><div class="notice">+29</div><p>+3</p><div class="share"><p>-3</p><p><a>-1</a></p></div><section class="discussion"><h2>+1</h2><p>+60</p></section><div class="search">-2</div></article>""",
    """<main><p>+21</p><div class="recommended"><h4>-3</h4><a>-6</a><a>-8</a></div><p>+70</p><section class="side-effects"><h2>+2</h2><p>+20</p><p>+75</p></section><p>+15</p><div class="register">-8</div><p>+58</p><div class="skip-list"><p>+25</p></div><div class="social">-4 <a>-3</a></div></main>""",
    # frames by element in pages without an article's element
    """<nav>-14 <a>-1</a></nav><p>+40</p><aside>-24</aside><p>+25</p><p>+2</p><form>-21</form><p>+60</p><aside><h3>-3</h3><p>-45</p></aside><footer>-26</footer>""",
    """<header><h2>-4</h2><p>-18</p></header><div>+33</div><div>+5</div><aside>-62</aside><div>+48</div><footer><p>-35</p><p>-4</p></footer>""",
    # short lines and headings before links that are parts of the article
    """<article><h1>+3</h1><p><a>+4</a></p><p>+2</p><p><a>+9</a></p><p>+31</p><h2>+2</h2><ul><li><a>+3</a></li><li><a>+2</a></li></ul><p>+1</p><p><a>+5</a></p><p>+3</p><p><a>+30</a></p></article><div>-3</div><div><a>-2</a></div>""",
    """<main><p>+2</p><p><a>+2</a></p><h2>+1</h2><p><a>+6</a></p><p>+18</p><p>+3</p><p><a>+12</a></p></main>""",
    # forum posts without an article's element
    """<div class="breadcrumbs"><a>-1</a><a>-2</a></div><h1>+7</h1><div>+3</div><div>+72</div><div>+4</div><div>+18</div><div class="pagination"><a>-1</a><a>-1</a></div><div class="login">-14</div>""",
]


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the blocks of a page with +n and -n for texts."""
    found = blocks(re.sub(r"([+-])(\d+)", lambda m: " ".join([m[1] + "w"] * int(m[2])), page))
    return features(found), np.array([b[0][0] == "+" for b in found], float)


_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_LEAF = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd td th tr option br hr caption legend summary figcaption".split())
_FRAME = frozenset("nav aside footer form menu dialog head fieldset".split())
#: Elements whose content is never text of the page.
_RAW = "script|style|noscript|template|textarea|select|button|svg|math|iframe|object|canvas|audio|video|map"
#: Names of the frame's parts, and names that parts of articles have too.
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies consent gdpr comment comments commentlist respond disqus "
    "sidebar widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer copyright sharing newsletter subscribe subscription signup login popup modal "
    "overlay toolbar masthead topbar hidden".split())
_WEAK = frozenset("notice notices alert side rail reviews related recommended feedback discussion replies reply social share search register skip disclaimer popover".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</\1\s*>|\Z)|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I)
_NAMED = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PART = re.compile(r"[A-Za-z]+")


def _named(attributes: str) -> tuple[int, bool]:
    """(hint, article) that an element's attributes give; hint: 2 of the frame, 1 perhaps, 0 none."""
    hint, article = 0, False
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            # A name such as has-sidebar tells what else the page has, not what this element is.
            parts = [p for p in map(_PART.findall, value.split()) if p and p[0] not in ("has", "with", "no", "not")]
            hint = max(hint, *(2 if not _HINTS.isdisjoint(p) else int(not _WEAK.isdisjoint(p)) for p in parts), 0)
        elif name == "role":
            hint, article = max(hint, 2 * (value in _ROLES)), article or value in ("main", "article")
        elif name == "itemprop":
            article = article or value == "articlebody"
        elif name == "style":
            hint = max(hint, 2 * (re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None))
        else:
            hint = max(hint, 2 * (name == "hidden" or value == "true"))
    return hint, article


def blocks(html: str | None) -> list[tuple[str, int, int, bool, bool, int, bool]]:
    """(text, words, linked words, in article, frame, hint, heading) of the page's blocks that have text."""
    html = html or ""
    out: list[tuple] = []
    open_: list[tuple[str, bool, bool, int]] = []  # element, in article, frame, hint, of itself or around it
    article = frame = heading = False
    hint = leaf_hint = 0
    parts: list[str] = []
    linked: list[str] = []
    in_link = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                n = text.count(" ") + 1
                out.append((text, n, min(n, len(unescape(" ".join(linked)).split())) if linked else 0, article, frame, max(hint, leaf_hint), heading))
        parts, linked = [], []

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            parts.append(html[at:lt])
            if in_link:
                linked.append(html[at:lt])
        if lt == size:
            break
        m = _TAG.match(html, lt)
        if not m:  # a bare "<"
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag, closing = tag.lower(), m[2]
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag not in _BLOCK:
            continue
        flush()
        in_link = 0
        if tag in _LEAF:
            leaf_hint = _named(m[4])[0] if not closing and m[4] else 0
            heading = not closing and tag[0] == "h" and tag[1:].isdigit()
            continue
        leaf_hint, heading = 0, False
        if closing:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    del open_[i:]
                    break
        elif not m[4].endswith("/"):
            named = _named(m[4]) if m[4] else (0, False)
            own = tag in _FRAME or (tag == "header" and not article)
            open_.append((tag, article or tag in ("article", "main") or named[1], frame or own, max(hint, named[0] if tag not in ("body", "html", "article", "main") else 0)))
        article, frame, hint = open_[-1][1:] if open_ else (False, False, 0)
    flush()
    return out


def features(found: list[tuple]) -> np.ndarray:
    """A row of FEATURES for each block of one page."""
    n = len(found)
    words = np.array([b[1] for b in found], float)
    links = np.array([b[2] for b in found], float) / np.maximum(words, 1)
    inside = np.array([b[3] for b in found], bool)
    place = np.where(inside, 2, 0 if inside.any() else 1)
    pad = lambda v: np.concatenate([[0.0], v, [0.0]])
    w, k = pad(words), pad(links)
    return np.column_stack([words, links, w[:n], k[:n], w[2:], k[2:], place, [b[4] for b in found], [b[5] for b in found], [b[6] for b in found]])


def fit(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple | float:
    """A decision tree by Gini impurity: (feature, threshold, at most it, above it), or the share of 1 in a leaf.

    Of equally good splits the first feature in the order of FEATURES, then the least threshold is taken.
    """
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            impurity = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(t), low)
    if best is None:
        return float(y.mean())
    _, f, t, low = best
    return f, t, fit(x[low], y[low], depth - 1), fit(x[~low], y[~low], depth - 1)


@cache
def tree() -> tuple | float:
    rows = [labelled(p) for p in PAGES]
    return fit(np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows]))


def predict(node: tuple | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), node >= 0.5)
    out = np.empty(len(x), bool)
    low = x[:, node[0]] <= node[1]
    out[low], out[~low] = predict(node[2], x[low]), predict(node[3], x[~low])
    return out


def main_texts(pages: list[str | None]) -> list[str]:
    """The main text of each page; all their blocks are classified together."""
    found = [blocks(p) for p in pages]
    rows = [features(b) for b in found if b]
    keep = predict(tree(), np.concatenate(rows)) if rows else np.empty(0, bool)
    out, at = [], 0
    for b in found:
        out.append(" ".join(x[0] for x, k in zip(b, keep[at : at + len(b)], strict=True) if k))
        at += len(b)
    return out


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without html but with text and n_chars (its code points)."""
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    kind = T.StructType([pages.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = main_texts(part.column(len(kept)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*kept, "text", "n_chars"])

    return pages.select(*kept, html).mapInArrow(of, kind)
