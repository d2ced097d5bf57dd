"""Main text of web pages from flat text blocks.

The whole HTML is cut into blocks at block-level tags. Each block has its word count and link
density, those of the blocks before and after it, and the kind of elements it stands in; a decision
tree, grown on the small labelled table below, keeps or drops it. Names of classes and ids are a hint
among others: the tree sees how plain the name is, and what share of the page's words the element so
named holds, so that a page that is whole within such an element isn't lost.

Parsing takes time proportional to the page, however deep it is nested.

Defined results: null and empty html give an empty text, as do pages without a kept block. Unclosed
tags, comments, scripts and styles end with the page; a quote that isn't closed ends with its tag.
Malformed references stay as they stand. Texts of any length are kept whole. Repeated rows and ties
don't matter, as each page is handled alone; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import common

_NAME = r"[a-zA-Z][a-zA-Z0-9:-]*"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)({_NAME})((?:[^>\"']++|\"[^\"]*+\"(?=[\s/>]|\Z)|'[^']*+'(?=[\s/>]|\Z))*+)(?:>|\Z)|<(/?)({_NAME})([^>]*)(?:>|\Z)",
    re.S,
)
_RAW = {x: re.compile(rf"</{x}\b[^>]*(?:>|\Z)", re.I) for x in ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "select", "object", "canvas", "math")}
_ATTR = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_BOILER = frozenset("nav aside form button menu dialog fieldset".split())
_EDGE = frozenset("header footer".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words in names of what isn't the article, and words that say nothing beside them.
_HINT = re.compile(
    r"ads?|advert\w*|adsense|banners?|sponsor\w*|promo\w*|sidebars?|comments?|commentlist|replies|respond|disqus|menus?|nav\w*|breadcrumbs?|footer|foot|masthead|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|widgets?|pagination|pager|toolbar|topbar|search|copyright|legal|disclaimer",
    re.I,
)
_PLAIN = re.compile(r"site|page|main|top|bottom|left|right|side|inner|outer|wrap|wrapper|container|box|bar|list|item|items|area|section|block|panel|group|row|col|column|body|text|content|links?|icons?|buttons?|btn|form|slot|unit|module|primary|secondary|global|user|reader|js|the|for|policy|info|posts?|media|\d+", re.I)
#: Names such as has-sidebar tell of what stands elsewhere.
_ABOUT = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no|is)[_-]\S+", re.I)

FEATURES = ("words", "link_density", "prev_words", "prev_density", "next_words", "next_density", "hint", "hint_share", "edge", "article", "page_article", "heading", "item")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    hint: float = 0.0
    #: The element that the hint is from, as a number.
    by: int = -1
    share: float = 0.0
    edge: bool = False
    article: bool = False
    heading: bool = False
    item: bool = False
    label: str = ""


@dataclass
class _Open:
    tag: str
    hint: float
    by: int
    edge: bool
    article: bool
    label: str = ""


@dataclass
class _State:
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def hint(tag: str, attrs: str) -> float:
    """1 if an element is named as what isn't the article, 0.5 if such a word is only a part of a name, else 0."""
    if tag in _BOILER:
        return 1.0
    if not attrs or tag in ("html", "body", "main", "article"):
        return 0.0
    most = 0.0
    for found in _ATTR.findall(attrs):
        for name in _ABOUT.sub(" ", next(filter(None, found), "")).split():
            parts = re.findall(r"[A-Za-z]+|\d+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name))
            told = [bool(_HINT.fullmatch(x)) for x in parts]
            if any(told):
                most = max(most, 1.0 if all(t or _PLAIN.fullmatch(x) for t, x in zip(told, parts)) else 0.5)
    return most


def blocks(page: str | None, label_attr: str = "") -> list[Block]:
    """Text blocks of a page in order. label_attr: an attribute that marks training examples."""
    page = page or ""
    out: list[Block] = []
    stack: list[_Open] = []
    opened: Counter[str] = Counter()
    #: The blocks of each hinted element, from and to.
    ranges: list[list[int]] = []
    now = _State()
    at, base = 0, _Open("", 0.0, -1, False, False)

    def flush() -> None:
        text = " ".join(html_lib.unescape("".join(now.parts)).split())
        if text:
            top = stack[-1] if stack else base
            tags = [o.tag for o in stack[-3:]]
            out.append(Block(text, len(text.split()), now.linked, top.hint, top.by, 0.0, top.edge, top.article, any(re.fullmatch("h[1-6]", t) for t in tags), "li" in tags, top.label))
        now.parts, now.linked = [], 0

    def pop() -> str:
        gone = stack.pop()
        opened[gone.tag] -= 1
        if gone.by >= 0 and (not stack or stack[-1].by != gone.by):
            ranges[gone.by][1] = len(out)
        return gone.tag

    def add(raw: str) -> None:
        if raw:
            now.parts.append(raw)
            if opened["a"]:
                now.linked += len(raw.split())

    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        closing, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = (name or "").lower()
        if not tag:
            continue
        if closing:
            if not opened[tag]:
                if tag not in _INLINE:
                    flush()
                continue
            if tag not in _INLINE:
                flush()
            while pop() != tag:
                pass
            continue
        if tag in _RAW:
            if not attrs.rstrip().endswith("/"):
                end = _RAW[tag].search(page, at)
                at = end.end() if end else len(page)
            if tag not in _INLINE:
                now.parts.append(" ")
            continue
        if tag == "br":
            now.parts.append(" ")
            continue
        if tag not in _INLINE:
            flush()
        if tag in _VOID:
            continue
        if tag in _CLOSES_P and opened["p"]:
            while pop() != "p":  # what p left open, such as b, ends with it
                pass
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1].tag == tag:
            pop()
        up = stack[-1] if stack else base
        own = hint(tag, attrs)
        if own and own >= up.hint:
            ranges.append([len(out), -1])
            told, by = own, len(ranges) - 1
        else:
            told, by = up.hint, up.by
        label = re.search(rf'{label_attr}="(\w+)"', attrs) if label_attr else None
        stack.append(_Open(tag, told, by, up.edge or (tag in _EDGE and (tag == "footer" or not up.article)), up.article or tag in ("article", "main"), label[1] if label else up.label))
        opened[tag] += 1
    add(page[at:])
    flush()
    total = np.cumsum([0, *(b.words for b in out)])
    for b in out:
        if b.by >= 0:
            first, last = ranges[b.by]
            b.share = float(total[last if last >= 0 else len(out)] - total[first]) / float(total[-1])
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row for each block, in the order of FEATURES; neighbours beyond the ends count as empty."""
    words = np.array([0.0, *(b.words for b in found), 0.0])
    density = np.array([0.0, *(min(1.0, b.linked / b.words) for b in found), 0.0])
    whole = any(b.article and b.hint < 1 and not b.edge for b in found)
    own = np.array([[b.hint, b.share, b.edge, b.article, whole, b.heading, b.item] for b in found], dtype=float).reshape(-1, 7)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], own])


#: The labelled table: small pages whose blocks carry k="main" or k="drop" (inherited).
_LONG = "this is a long paragraph of running text that goes on for many words, as the body of an article does, with clauses and a full stop at its end so that it reads as prose and not as a label"
_MID = "a sentence of a dozen words or so stands here as text"
_LINKS = '<ul k="drop"><li><a href="/1">One page</a></li><li><a href="/2">Another page of the site</a></li><li><a href="/3">And</a></li></ul>'
_NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">News</a></li></ul></nav>'
LABELLED = (
    # an article element, with all that stands around it
    f'<body k="drop">{_NAV}<div class="ad">{_MID}</div><article k="main"><h1>A title</h1><p>{_LONG}</p><p>{_LONG}</p><p>Short.</p></article><footer>&copy; site &middot; {_MID}</footer></body>',
    f'<body k="drop">{_NAV}<div class="ad">{_LONG}</div><article k="main"><h1>{_MID}</h1><p>{_MID}</p></article><footer>{_LONG}</footer></body>',
    f'<body k="drop"><header><h1>Site name</h1><p>{_MID}</p></header><main k="main"><h1>Title</h1><p>{_LONG}</p><ul><li>One point</li><li>{_MID}</li></ul></main><aside><h3>More</h3><p>{_LONG}</p></aside><footer>{_MID}</footer></body>',
    f'<body k="drop"><div class="cookie-notice">{_LONG}</div><article k="main"><header><h2>Title</h2></header><p>{_LONG}</p><blockquote>{_MID}</blockquote><h2>Part</h2><p>{_LONG}</p><div class="share" k="drop">Share this</div><section class="comments" k="drop"><p>{_LONG}</p></section></article></body>',
    '<body k="drop"><article k="main"><h1>One.</h1><p>Two words.</p><p>A.</p></article><footer>Three words here</footer></body>',
    f'<body k="drop"><article k="main"><p>{_MID}</p><p>{_LONG}</p></article></body>',
    f'<body k="drop">{_NAV}<article k="main"><p>{_LONG}</p><p>{_MID}</p></article><p>{_MID}</p></body>',
    '<body k="drop"><article k="main"><p>A.</p><p>Two words.</p></article></body>',
    '<body k="drop"><article k="main"><p>A.</p></article></body>',
    f'<body k="drop"><p>Log in</p><article k="main"><p>{_LONG}</p></article><p>Some closing words of the site</p></body>',
    f'<body k="drop"><div class="ad">{_LONG}</div><article k="main"><p>Short.</p></article><section class="comments"><p>{_LONG}</p><p>{_LONG}</p><p>{_MID}</p></section></body>',
    f'<body k="drop">{_NAV}<article k="main"><h1>T</h1><p>{_MID}</p></article><div class="ad">{_LONG}</div><div>{_LONG}</div></body>',
    f'<body k="drop"><article k="main"><h1>A short title</h1><p>{_LONG}</p></article></body>',
    f'<body k="drop"><main k="main"><p>Two words.</p><p>{_LONG}</p><p>{_MID}</p></main></body>',
    f'<body k="drop"><p>{_LONG}</p><article k="main"><p>{_MID}</p></article><p>{_LONG}</p><p>{_MID}</p></body>',
    f'<body k="drop"><div>Log in here</div><article k="main"><h1>Title</h1><p>{_MID}</p></article></body>',
    # links inside an article: a menu is links beside links, a linked line stands between text
    f'<body k="drop"><article k="main"><p>{_LONG} <a href="/z">link</a></p><p><a href="/y">A linked line</a></p><p>{_LONG}</p></article><div><a href="/q">{_LONG}</a></div></body>',
    f'<body k="drop"><article k="main"><h1>Title</h1>{_LINKS}<p>{_LONG}</p><p>{_MID} with <a href="/w">a link</a></p></article></body>',
    f'<body k="drop">{_NAV}<article k="main"><p>{_LONG}</p><p>{_MID}</p>{_LINKS}</article><footer>{_MID}</footer></body>',
    f'<body k="drop"><main k="main"><p>{_LONG}</p><ul><li>A first point of the list</li><li><a href="/s">A source</a> and what it says about it</li><li>Third</li></ul>{_LINKS}<p>{_MID}</p></main></body>',
    f'<body k="drop"><article k="main"><h1><a href="/self">A title that is a link</a></h1><p>{_MID}</p><p>{_LONG}</p></article></body>',
    f'<body k="drop"><article k="main"><p><a href="/l">The one line</a></p></article></body>',
    f'<body k="drop"><article k="main"><p>{_MID}</p><ul><li><a href="/e">{_LONG}</a></li><li><a href="/f">{_LONG}</a></li></ul></article></body>',
    f'<body k="main"><p>{_LONG}</p><p><a href="/g">{_LONG}</a></p><p>{_MID}</p></body>',
    # no article element: running text, apart from what is linked, named or at the edges
    f'<body k="drop"><div><a href="/">Home</a> <a href="/x">About us</a></div><div k="main"><h1>Title</h1><p>{_LONG}</p><p>{_MID}</p><p>{_LONG}</p></div><div class="sidebar"><p>{_LONG}</p></div><div><a href="/t">Terms of use</a></div></body>',
    f'<body k="drop"><div class="menu">Menu</div><div k="main"><p>{_LONG}</p><p>{_LONG}</p></div><div id="comments"><p>{_LONG}</p><p>{_MID}</p></div><form><label>Your name</label><p>{_MID}</p></form></body>',
    f'<body k="drop">{_LINKS}<p k="main">{_LONG}</p><p k="main">Ends.</p></body>',
    f'<body k="drop"><ul><li><a href="/1">{_MID}</a></li><li><a href="/2">{_MID}</a></li></ul><p k="main">{_LONG}</p><footer>All rights reserved</footer></body>',
    f'<body k="main"><p>{_LONG}</p></body>',
    f'<body k="main"><p>{_LONG}</p><p>{_LONG}</p><p>{_LONG}</p></body>',
    '<body k="main"><div><p>A short note.</p></div></body>',
    f'<body k="main"><div><h1>Title</h1><p>{_MID}</p><ul><li>One</li><li>Two</li></ul><p>Ends.</p></div></body>',
    f'<body k="drop"><header>Site name</header><h1 k="main">A heading of some words</h1><p k="main">{_LONG}</p><h2 k="main">Part two</h2><p k="main">{_LONG} <a href="/m">more</a></p><p><a href="/i">Imprint</a></p></body>',
    f'<body k="main"><h1>The title</h1><p>{_LONG}</p></body>',
    f'<body k="main"><p>Two words.</p><p>{_MID}</p></body>',
    f'<body k="main"><p>{_MID} <a href="/u">with two words</a></p><p>{_MID}</p><div k="drop"><a href="/p">Previous</a> <a href="/n">Next</a></div></body>',
    # a page whole within an element whose name has such a word, or within a form
    f'<body k="drop">{_NAV}<div class="legal-news" k="main"><h1>Title</h1><p>{_LONG}</p><p>{_MID}</p><p>{_LONG}</p></div><footer>{_MID}</footer></body>',
    f'<body k="main"><section class="search-results-study"><p>{_LONG}</p><p>{_MID}</p></section></body>',
    f'<body k="main"><form><h1>Title</h1><p>{_LONG}</p><p>{_MID}</p><p>{_LONG}</p><p>Ends.</p></form></body>',
    f'<body k="main"><p>{_LONG}</p><p>{_LONG}</p><div class="share-story" k="drop">Tell others</div></body>',
    f'<body k="drop"><div k="main"><p>{_LONG}</p><p>{_LONG}</p></div><div class="comment-thread-view"><p>{_MID}</p></div></body>',
    f'<body k="drop"><article k="main"><div class="social-history"><p>{_LONG}</p><p>{_MID}</p></div></article></body>',
    f'<body k="drop"><div k="main"><p>{_MID}</p></div><div class="related"><p>{_LONG}</p></div></body>',
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 1):
    """A Gini tree as nested tuples (feature, threshold, left, right) or a class; ties go to the earlier feature and lower threshold."""
    p = y.mean()
    if depth == 0 or p in (0.0, 1.0) or len(y) < 2 * least:
        return int(p >= 0.5)
    best = None
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for t in (values[:-1] + values[1:]) / 2:
            left = x[:, j] <= t
            n = left.sum()
            if n < least or len(y) - n < least:
                continue
            a, b = y[left].mean(), y[~left].mean()
            impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, j, float(t), left)
    if best is None or best[0] >= len(y) * p * (1 - p) - 1e-12:
        return int(p >= 0.5)
    _, j, t, left = best
    return (j, t, grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least))


def classify(tree, row) -> int:
    while isinstance(tree, tuple):
        j, t, left, right = tree
        tree = left if row[j] <= t else right
    return tree


@lru_cache(maxsize=1)
def trained():
    rows, labels = [], []
    for page in LABELLED:
        found = blocks(page, "k")
        rows.append(features(found))
        labels += [b.label == "main" for b in found]
    return grow(np.concatenate(rows), np.array(labels, dtype=float))


def shown(tree, indent: str = "") -> str:
    """The tree as text, one test a line."""
    if not isinstance(tree, tuple):
        return f"{indent}{'keep' if tree else 'drop'}\n"
    j, t, left, right = tree
    return f"{indent}{FEATURES[j]} <= {t:g}\n{shown(left, indent + '  ')}{indent}else\n{shown(right, indent + '  ')}"


def main_text(page: str | None, tree=None) -> str:
    tree = trained() if tree is None else tree
    found = blocks(page)
    return "\n".join(b.text for b, row in zip(found, features(found).tolist()) if classify(tree, row))


def extract(pages: DataFrame, tree=None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""
    common.bound_batches(pages.sparkSession)
    tree = trained() if tree is None else tree
    rows = pages.select("page_id", "url", F.col("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, tree) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op3(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
