"""Main text of web pages: flat text blocks classified by a decision tree.

A page is one pass over its tags.  Text between two block-level tags is a block; inline tags and <br>
stay inside it.  A block's features are its own number of words and link density, those of the
blocks before and after it, how many text-like blocks (of LONG words or more, few of them linked) come before and after it, what kind
of tag holds it, and what the nearest enclosing element that says so is for: an article, or a menu, header, footer, sidebar, notice, advert,
form or comment list.  The tree is grown from a small table (`labelled`) of pages made of parts whose blocks are labelled by
hand, each page as it is and once more with all elements' names and classes taken away; so words, link density and neighbours
decide, and names only where these can't.  Nothing of the data is used to fit it.

Defined results: null and empty html, and pages without text, give an empty string; rows are kept one
for one; unclosed and stray tags, an unfinished tag at the end and unknown references are handled as
browsers do, approximately; only the id, url and html columns are read.  Time and memory are linear in a
page's length, however its tags are nested; one page at a time is in memory beside the batch.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels, stats
from .tables import mapped, pick

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:\s|^)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?=\s|/|$))", re.I)
#: Elements of HTML by what they do to the text around them.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button datalist noframes map".split())
RAW = frozenset("script style textarea title noscript iframe noframes".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
GOOD_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay toast "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot bottombar sidebar side rail aside complementary related recommended widget widgets share sharing social "
    "comment comments commentlist discussion disqus replies reply respond subscribe subscription newsletter signup login search searchbox pagination pager toolbar copyright legal disclaimer contentinfo skip toc tags".split()
)
GOOD_WORDS = frozenset("article post story entry content main body text articlebody".split())


@dataclass
class Block:
    text: str
    words: int
    linked: int
    context: int  # 1 inside an article, -1 inside what is none, 0 neither
    kind: int  # 0 other, 1 paragraph, 2 heading, 3 list item or cell


def _context(tag: str, attributes: str, inside_article: bool) -> int | None:
    """What an element says about its text: 1, -1, None for nothing; -2 hides it."""
    if tag in GOOD_TAGS:
        own: int | None = 1
    elif tag in BAD_TAGS or tag == "header" and not inside_article:
        own = -1
    else:
        own = None
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return -2
            if name in ("class", "id", "role") and tag not in GOOD_TAGS and tag != "body" and tag != "html":
                tokens = re.split(r"[^a-z0-9]+", value)
                if own is None and any(t in BAD_WORDS for t in tokens):
                    own = -1
                elif own is None and any(t in GOOD_WORDS for t in tokens):
                    own = 1
    return own


@lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(r"</head\s*>|<body\b" if tag == "head" else rf"</{re.escape(tag)}(?=[\s/>])", re.I)


class _Open:
    """Open elements; each carries what it inherits, so that no step walks the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int, int, bool]] = []  # tag, nearest context, nearest kind, hidden elements, inside an article
        self.places: dict[str, list[int]] = {}

    @property
    def top(self) -> tuple[str, int, int, int, bool]:
        return self.stack[-1] if self.stack else ("", 0, 0, 0, False)

    def push(self, tag: str, own: int | None, kind: int) -> None:
        _, context, above, hidden, article = self.top
        self.places.setdefault(tag, []).append(len(self.stack))
        if own in (1, -1):
            context, above = own, 0
        self.stack.append((tag, context, kind or above, hidden + (own == -2), article or own == 1))

    def close(self, tag: str) -> None:
        """Ends the nearest element of a tag with all inside it; a stray end tag does nothing."""
        if self.places.get(tag):
            self.cut(self.places[tag][-1])

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.places[self.stack.pop()[0]].pop()


def blocks(page: str) -> list[Block]:
    """All text blocks of a page in order."""
    out: list[Block] = []
    open_ = _Open()
    now: list[str] = []
    links: list[bool] = []
    linking = False
    endless: set[str] = set()  # tags without an end tag in the rest of the page
    place = 0

    def end() -> None:
        if now:
            joined = html.unescape("".join(now))
            if words := joined.split():
                linked = 0
                if any(links):
                    linked = len(html.unescape(" ".join(t for t, yes in zip(now, links, strict=True) if yes)).split())
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), *open_.top[1:3]))
            now.clear()
            links.clear()

    def add(piece: str) -> None:
        if piece and not open_.top[3]:
            now.append(piece)
            links.append(linking)

    size = len(page)
    while place < size:
        m = TOKEN.search(page, place)
        if m is None:
            add(page[place:])
            break
        add(page[place : m.start()])
        place = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1] or m[4]:
            if tag == "a":
                linking = False
            elif tag not in INLINE:
                end()
                open_.close(tag)
                if tag in GOOD_TAGS or tag in BAD_TAGS:
                    linking = False
            continue
        attributes = m[3] or m[6] or ""
        if tag == "br":
            add(" ")
            continue
        if tag == "a":
            linking = True
            continue
        if tag in VOID:
            if tag == "hr":
                end()
            continue
        if tag in UNSEEN:
            if tag not in ("svg", "math", "button", "label"):
                end()
            close = None if tag in endless else _closing(tag).search(page, place)
            if close:
                place = close.start()
                if page.startswith("</", place):
                    shut = page.find(">", place)
                    place = size if shut < 0 else shut + 1
            elif tag in RAW:
                place = size
            else:
                endless.add(tag)
            continue
        if tag in INLINE:
            continue
        end()
        linking = False
        last = open_.top[0]
        if tag in CLOSES_P and last == "p" or tag == "li" and last == "li" or tag in HEADINGS and last in HEADINGS:
            open_.cut(len(open_.stack) - 1)
        own = _context(tag, attributes, open_.top[4])
        kind = 1 if tag == "p" or tag == "pre" or tag == "blockquote" else 2 if tag in HEADINGS else 3 if tag in ("li", "td", "th", "dd", "dt", "option") else 0
        if not attributes.endswith("/"):
            open_.push(tag, own, kind)
    end()
    return out


LONG, LINKED = 12, 0.34


def features(found: list[Block]) -> np.ndarray:
    """Words and link density of each block and of both its neighbours, text-like blocks before and after (up to 2 count), kind, context."""
    words = np.array([0, *(b.words for b in found), 0], float)
    density = np.array([0.0, *(b.linked / b.words for b in found), 0.0])
    texts = ((words >= LONG) & (density < LINKED))[1:-1].astype(float)
    before = np.minimum(np.cumsum(texts) - texts, 2)
    after = np.minimum(texts.sum() - np.cumsum(texts), 2)
    own = np.array([[b.kind, b.context] for b in found], float).reshape(len(found), 2)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], before, after, own])


_A = "The river rose for three days before anyone in the valley thought of moving the animals up to the old summer barns above the mill."
_B = "Nobody had written down how the water ran in other years, so the older farmers were asked, and each of them remembered something else."
_C = "By noon the bridge was closed and the road behind it too, and the post came on foot over the hill."
_D = "It took nine days until the road was open again."
#: The labelled table: parts of pages, and for each of their blocks whether it belongs to the article.
HEADS = (
    ("<nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>Sport</a></li></ul></nav>", "---"),
    ("<div class=menu><a href=a>Start</a> | <a href=b>Contact us</a> | <a href=c>The valley in pictures</a></div>", "-"),
    ("<header><p>Valley Press, printed since long ago</p><nav><a href=a>Home</a> <a href=b>Weather today</a></nav></header>", "--"),
    ("<ul class=nav><li><a href=a>Home</a><li><a href=b>Weather</a><li><a href=c>All the news of the upper valley</a></ul>", "---"),
    ("<table><tr><td><a href=a>One</a></td><td><a href=b>Two</a></td></tr></table>", "--"),
    ("", ""),
)
NOTICES = (
    ("<div class=ad>Buy the new lamp today, it is bright.</div>", "-"),
    ("<div class=ad>New lamps.</div>", "-"),
    ("<div class=banner>The best of all lamps from the shop by the old bridge. Come in. It is dry.</div>", "-"),
    ("<div id=cookie-notice><p>We use cookies.</p><a href=x>More about it</a></div>", "--"),
    ("<div class=ad>Lamps of all kinds, made by hand.<br>Sold here.</div>", "-"),
    ("", ""),
)
ARTICLES = (
    (f"<article><h1>The flood</h1><p>{_A}</p><p>It rose.</p><p>{_B}</p><p>Rain.</p></article>", "+++++"),
    (f"<article><h1>What the valley remembers of the water</h1><p><b>{_A} {_C}<br><p>{_D}</p><p>{_B}</p><p>And then the sun came out again over all of it.</p></article>", "+++++"),
    (f"<div class=content><h2>After the flood</h2><div>{_B}</div><div>{_C} <a href=x>See the list</a></div><div>{_A}</div></div>", "++++"),
    (f"<main><h1>Levels</h1><p>{_C}</p><ul><li>First came the rain.</li><li>Then <a href=w>wind</a> from the west.</li></ul><p>{_A} {_B}</p><p>So it went.</p></main>", "++++++"),
    (f"<article><header><h1>Title of it</h1></header><p>{_D}</p><p>{_A} {_C}</p><h3>Later</h3><p><a href=q>{_C}</a></p><p>{_B}</p><p>Nine barns stand.</p></article>", "+++++++"),
    (f"<div><h1>A word | and | another | of the flood</h1><p>{_A} {_B} {_C}</p><p>No.</p><p>Only one man stayed.</p><p>{_D}</p></div>", "+++++"),
    (f"<table><tr><td>{_A} {_B}</td></tr><tr><td>{_C}</td></tr></table>", "++"),
    ("<article><h1>Closed</h1><p>No paper today.</p></article>", "++"),
    ("<article><p>No paper today, as the house is under water.</p></article>", "+"),
    (f"<article><p>{_B}</p><pre>level 4\nlevel 5</pre><blockquote>{_D}</blockquote><p>{_A}</p></article>", "++++"),
)
TAILS = (
    ("<footer>&copy; valley.example &middot; Printed in the valley by the sons of the old printer, for all.</footer>", "-"),
    ("<footer>(c) Valley Press</footer>", "-"),
    ("<div><a href=a>Older</a></div><div><a href=b>Newer stories of the valley and of its mills</a></div><footer>Terms of use</footer>", "---"),
    ("<div class=share><a href=s>Share</a> <a href=t>Send this to a friend</a></div><div class=copyright>All rights kept by the writers and the paper.</div>", "--"),
    ("<div class=footer>Valley Press, the house by the bridge. Ring twice. We are open all days but one.</div>", "-"),
    ("", ""),
)
#: Parts whose text reads like an article's; only their names tell.
NAMED = (
    (f"<section id=comments><p>{_C}</p><p>I was there and it was worse than that, believe me.</p></section>", "--"),
    (f"<aside><h3>Most read</h3><p>{_B}</p></aside>", "--"),
    (f"<form><p>Your mail address please</p><p>{_C}</p></form>", "--"),
    (f"<footer><p>{_A} {_D}</p></footer>", "-"),
    (f"<div class=sidebar><p>{_D} {_C}</p><ul><li><a href=e>Ten lamps</a></li></ul></div>", "--"),
)


def labelled() -> list[tuple[str, str]]:
    """Pages of every head, notice and article, with tails and parts that only their names tell in turn; each with and without names."""
    out = []
    for i, parts in enumerate(product(HEADS, NOTICES, ARTICLES)):
        parts = (*parts, TAILS[(i + i // 10) % len(TAILS)])
        page, marks = ("".join(p[k] for p in parts) for k in (0, 1))
        out += [(page, marks), (nameless(page), marks)]
        parts = (*parts[:3], NAMED[i % len(NAMED)], parts[3])
        out.append(("".join(p[0] for p in parts), "".join(p[1] for p in parts)))
    return out


def nameless(page: str) -> str:
    """A page whose elements say nothing of what they are for: landmarks are plain divisions, without attributes."""
    page = re.sub(r"<(/?)(?:nav|header|footer|aside|main|article|section|form)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"<(div|p|ul|table)\s[^>]*>", r"<\1>", page)


@lru_cache(maxsize=1)
def tree() -> stats.Node:
    """The decision tree of the labelled table."""
    rows, labels = [], []
    for page, marks in labelled():
        found = blocks(page)
        if len(found) != len(marks):
            raise ValueError(f"{len(found)} blocks, {len(marks)} labels: {[b.text[:20] for b in found]}")
        rows.append(features(found))
        labels += [m == "+" for m in marks]
    return stats.grow(np.vstack(rows), np.array(labels, float), depth=8, least=3)


def main_text(page: str | None, root: stats.Node | None = None) -> str:
    """The blocks that the tree takes for the article, joined by newlines."""
    root = root or tree()
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b.text for b, share in zip(found, stats.shares(root, features(found)).tolist(), strict=True) if share >= 0.5)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    root = tree()  # grown once, and sent with the plan

    def run(batches):
        for batch in batches:
            texts = [main_text(p, root) for _, some in kernels.text_lists(batch.column(2)) for p in some]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return mapped(pick(pages, **{id_col: "long", url_col: "string", html_col: "string"}), run, "page_id long, url string, text string, n_chars long")
