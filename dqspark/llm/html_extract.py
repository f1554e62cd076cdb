"""Operator 13: main text of web pages by a linear-chain conditional random field.

A page becomes the sequence of its leaf blocks (runs of text between block-level tags). Each
block has binary features of its ancestors (tags, words of ``class``, ``id`` and ``role``) and of
its text (length, link share, punctuation, digits, place on the page, neighbours' lengths). The
field scores two labels per block and the step between neighbouring blocks; Viterbi gives the
best labelling of the page, and the blocks labelled main are joined.

Training: pages of the table whose markup says what is what (``article`` or ``main`` around some
blocks, ``nav``, ``footer``, ``aside`` and the like around others) are the labelled pages. At most
``fit_pages`` of them, those with the smallest hashes, are fitted on, each as it stands and
re-clothed: the same labelled blocks in other containers, as pages without those tags have them,
with notices, sidebars, forms, share bars, adverts and reader comments between (``LAYOUTS``), so the field
knows markup that the table's pages may not show. Without a labelled page the built-in sentences
fill the layouts. The model is a few thousand weights.

Defined cases: a null or empty page gives the empty text and 0 characters; text outside any block-level
tag is a block of its own; tags never closed end with their parent; closing tags that match nothing
are passed over; an unclosed comment, script or style runs to the page's end; hidden elements
(``hidden``, ``aria-hidden="true"``, ``display:none``) hold no text. Equal scores of a block's labels count as not main. Repeated rows are
extracted alike; pages of any length and depth are read whole in one pass, and no element is dropped for its
place or size. An empty table gives no rows. Columns other than ``page_id``, ``url`` and ``html`` are never read.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import shared

#: Labelled pages fitted on at most, and characters of a page that may be one of them, blocks of a re-clothed page's article.
FIT_PAGES, FIT_CHARS, FIT_BLOCKS = 300, 60_000, 40
#: Re-clothed copies of each labelled page.
COPIES = 6
#: Hashed feature space, training rounds, step size, weight decay.
DIM, ROUNDS, STEP, DECAY = 1 << 13, 40, 0.3, 1e-3

# Elements of the HTML standard by how they divide text.
BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td
tfoot th thead tr ul""".split())
#: Blocks that only set text, or hold anything.
PLAIN_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote center tr td th tbody table hr div body html".split())
#: No text of theirs is ever shown as text.
SILENT_TAGS = frozenset("script style noscript template iframe object svg math canvas audio video select datalist textarea button "
                        "title head noframes noembed map progress meter".split())
RAW_TAGS = frozenset("script style noscript iframe noframes noembed title textarea xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Foreign elements that may close themselves.
FOREIGN_TAGS = frozenset("svg math path use circle rect line polygon g".split())
#: A new element of the key closes an open one of the values (the nearest, within its container).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

# A tag or quoted value that never ends runs to the end of the page, so every search stays linear.
_TOKEN = re.compile(r"""<(?:(!--)|(/?)([A-Za-z][^\s/>]*)([^>"']*(?:(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))[^>"']*)*)(?:>|\Z)|[!?/])""")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block:
    """Text of one leaf block, its characters inside links, and what is around it."""

    __slots__ = ("pieces", "linked", "around", "tag", "places", "text")

    def __init__(self, around: tuple[str, ...], tag: str, places: frozenset):
        self.pieces: list[str] = []
        self.linked = 0
        self.around, self.tag, self.places = around, tag, places


@lru_cache(maxsize=4096)
def _marks(tag: str, attrs: str) -> tuple[list[str], bool]:
    """Ancestor features of an element, and whether it is hidden."""
    attrs = attrs.rstrip("/")
    found, hidden = [f"tag={tag}"], False
    if attrs.strip():
        for m in _ATTR.finditer(attrs):
            name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                words = [w.lower() for w in _WORDS.findall(value)]
                found += [f"word={w}" for w in words if not w.isdigit()]
                found += [f"stem={w[:4]}" for w in words if len(w) > 4]
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                hidden = True
    return found, hidden


class Open:
    """An open element: its place in the stack, its marks, and what it inherits from its parent."""

    __slots__ = ("tag", "marks", "silent", "depth", "live", "near", "block")

    def __init__(self, tag: str, marks: list[str], silent: bool, depth: int, parent: "Open | None"):
        self.tag, self.marks, self.silent, self.depth, self.live = tag, marks, silent, depth, True
        self.near: tuple = parent.near if parent else ()        # marks of the two nearest containers that say more than
        self.block: str = parent.block if parent else ""        # how text is set; nearest block-level tag
        if tag in BLOCK_TAGS:
            self.block = tag
            if len(marks) > 1 or tag not in PLAIN_TAGS:
                self.near = (marks, *self.near[:1])


class Page:
    """The open elements while a page is read, and the blocks found so far. Every step is amortised constant time."""

    def __init__(self, places: bool):
        self.blocks: list[Block] = []
        self.stack: list[Open] = []
        self.where: dict[str, list[Open]] = {}          # live elements by tag, outermost first
        self.active: Counter = Counter()
        self.silent = self.links = 0
        self.block: Block | None = None
        self.around: tuple[str, ...] | None = None
        self.places = places

    def open(self, tag: str, marks: list[str], silent: bool) -> None:
        e = Open(tag, marks, silent, len(self.stack), self.stack[-1] if self.stack else None)
        self.stack.append(e)
        self.where.setdefault(tag, []).append(e)
        self.silent += silent
        self.links += tag == "a"
        for mark in marks:
            self.active[mark] += 1
        if tag in BLOCK_TAGS:
            self.around = self.block = None
        elif len(marks) > 1:
            self.around = None

    def end(self, e: Open) -> None:
        """Take back what an element added; it may stay in the stack, without effect, until its parent ends."""
        e.live = False
        mine = self.where[e.tag]
        mine.pop()
        if not mine:
            del self.where[e.tag]
        self.silent -= e.silent
        self.links -= e.tag == "a"
        for mark in e.marks:
            self.active[mark] -= 1
            if not self.active[mark]:
                del self.active[mark]
        if e.tag in BLOCK_TAGS:
            self.around = self.block = None

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            e = self.stack.pop()
            if e.live:
                self.end(e)

    def close(self, tag: str) -> None:
        """An end tag: a block ends with all it holds; an inline element leaves blocks opened inside it open."""
        e = self.where[tag][-1]
        if tag in BLOCK_TAGS or self.stack[-1].block == e.block and e is self.stack[-1]:
            self.close_to(e.depth)
        else:
            self.end(e)

    def make_room(self, tag: str) -> None:
        """End what a new element of this tag ends: an open paragraph, the list item or cell before it."""
        if tag in BLOCK_TAGS and "p" in self.where:
            self.close_to(self.where["p"][-1].depth)
        if tag in CLOSES:
            holder = max((self.where[t][-1].depth for t in HOLDS.get(tag, ()) if t in self.where), default=-1)
            before = [self.where[t][-1].depth for t in CLOSES[tag] if t in self.where and self.where[t][-1].depth > holder]
            if before:
                self.close_to(min(before))

    def say(self, text: str) -> None:
        if self.silent or not text:
            return
        if "&" in text:
            text = html.unescape(text)
        if self.block is None:
            if text.isspace():
                return
            top = self.stack[-1] if self.stack else None
            if self.around is None:
                self.around = (*self.active, *(f"near{i}:{m}" for i, marks in enumerate(top.near if top else ()) for m in marks))
            self.block = Block(self.around, top.block if top else "", frozenset(self.where) if self.places else frozenset())
            self.blocks.append(self.block)
        self.block.pieces.append(text)
        if self.links:
            self.block.linked += len(text)


def blocks_of(text: str, places: bool = False) -> list[Block]:
    """Leaf blocks of a page in page order, empty ones left out; one pass, no recursion.

    White space is what ``str.split`` splits at, no-break spaces included. ``places`` keeps the
    tags open around each block, which only the labelled pages need.
    """
    page = Page(places)
    at, n = 0, len(text)
    raw_ends: dict[str, re.Pattern] = {}
    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            page.say(text[at:])
            break
        if m.start() > at:
            page.say(text[at:m.start()])
        at = m.end()
        comment, closing, tag, attrs = m.groups()
        if tag is None:
            mark = "-->" if comment else ">"
            end = text.find(mark, at)
            at = n if end < 0 else end + len(mark)
            continue
        tag = tag.lower()
        if tag == "br":
            if page.block is not None:
                page.say(" ")
        elif tag == "hr" or closing and tag == "p" and "p" not in page.where:
            page.block = None
        elif closing:
            if tag in page.where:
                page.close(tag)
        elif tag not in VOID_TAGS:
            page.make_room(tag)
            marks, hidden = _marks(tag, attrs)
            quiet = hidden or tag in SILENT_TAGS
            if tag in RAW_TAGS:                         # text up to its own end tag, markup or not
                if tag not in raw_ends:
                    raw_ends[tag] = re.compile(rf"</{tag}(?=[\s/>])", re.I)
                end = raw_ends[tag].search(text, at)
                if not quiet:
                    page.say(text[at:end.start() if end else n])
                close = text.find(">", end.end()) if end else -1
                at = n if close < 0 else close + 1
            elif not (attrs.endswith("/") and tag in FOREIGN_TAGS):
                page.open(tag, marks, quiet)
    for b in page.blocks:
        b.text = " ".join("".join(b.pieces).split())
    return [b for b in page.blocks if b.text]


_ENDS = (".", "!", "?", "…", "。", ":", ";", "\"", "”", "»")


_NAMES = ("own", "words", "links", "end", "first", "stops", "commas", "length", "place", "start", "last", "before", "after", "sign")


def block_values(blocks: list[Block]) -> Iterator[tuple]:
    """Values of each block's text features, in the order of ``_NAMES``."""
    words = [b.text.count(" ") + 1 for b in blocks]
    sizes = [0, *(min(8, n.bit_length()) for n in words), 0]
    n = len(blocks)
    for i, b in enumerate(blocks):
        t = b.text
        share = b.linked / max(1, sum(map(len, b.pieces))) if b.linked else 0
        yield (b.tag, sizes[i + 1], 3 if share > 0.9 else 2 if share > 0.3 else 1 if share else 0, t[-1] in _ENDS, t[0].isupper(),
               min(3, t.count(".") + t.count("!") + t.count("?")), min(2, t.count(",")), min(12, len(t) // words[i]),
               10 * i // n, i == 0, i == n - 1, sizes[i], sizes[i + 2], "\u00a9" in t or "|" in t or "\u00bb" in t)


def _named(values: tuple) -> list[str]:
    """Names of the features a tuple of values stands for, some taken together."""
    own, size, links = values[:3]
    return ["bias", f"words,links={size},{links}", f"own,words={own},{size}"] + [f"{k}={v}" for k, v in zip(_NAMES, values, strict=True)]


def _indices(features: list[str] | tuple[str, ...]) -> np.ndarray:
    return np.fromiter((crc32(f.encode("utf-8", "surrogatepass")) % DIM for f in features), np.int64, len(features))


def page_features(blocks: list[Block]) -> list[np.ndarray]:
    """Hashed features of each block of a page."""
    return [_indices([*_named(v), *b.around]) for b, v in zip(blocks, block_values(blocks), strict=True)]


class Chain:
    """Weights of the field: two labels a block (0 other, 1 main), steps, and both ends."""

    def __init__(self) -> None:
        self.weights = np.zeros((DIM, 2))
        self.steps = np.zeros((2, 2))

    def page_scores(self, blocks: list[Block], known: dict) -> list[tuple[float, float]]:
        """Label scores of a page's blocks; ``known`` keeps the sums of feature tuples met before."""
        out = []
        for b, values in zip(blocks, block_values(blocks), strict=True):
            x = known.get(values)
            if x is None:
                x = known[values] = tuple(self.weights[_indices(_named(values))].sum(axis=0).tolist())
            y = known.get(b.around)
            if y is None:
                y = known[b.around] = tuple(self.weights[_indices(b.around)].sum(axis=0).tolist())
            out.append((x[0] + y[0], x[1] + y[1]))
        return out

    def viterbi(self, rows: list[tuple[float, float]]) -> list[int]:
        """Best labelling of one page."""
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b = rows[0]
        back: list[tuple[int, int]] = []
        for x, y in rows[1:]:
            from0 = 1 if b + s10 > a + s00 else 0
            from1 = 1 if b + s11 > a + s01 else 0
            a, b = x + (b + s10 if from0 else a + s00), y + (b + s11 if from1 else a + s01)
            back.append((from0, from1))
        label = 1 if b > a else 0
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]

    def gradients(self, pages: list[tuple[list[np.ndarray], list[int]]]) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradients of the mean negative log-likelihood per block, and its sum, by forward-backward.

        All pages of the batch move on together, padded to the longest; a page's padding is held out by masks.
        """
        lens = np.array([len(y) for _, y in pages])
        total, longest = int(lens.sum()), int(lens.max())
        feats = [f for fs, _ in pages for f in fs]
        flat, sizes = np.concatenate(feats), np.array([len(f) for f in feats])
        row = np.repeat(np.arange(len(pages)), lens)
        col = np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens)
        scores = np.zeros((len(pages), longest, 2))
        scores[row, col] = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0)
        truth = np.zeros((len(pages), longest), np.int64)
        truth[row, col] = [y for _, ys in pages for y in ys]
        real = np.arange(longest) < lens[:, None]
        forward, backward = scores.copy(), np.zeros_like(scores)
        for i in range(1, longest):
            forward[:, i] += np.logaddexp.reduce(forward[:, i - 1, :, None] + self.steps, axis=1)
        for i in range(longest - 2, -1, -1):
            ahead = np.logaddexp.reduce(self.steps + (scores[:, i + 1] + backward[:, i + 1])[:, None, :], axis=2)
            backward[:, i] = np.where(real[:, i + 1, None], ahead, 0.0)
        norm = np.logaddexp.reduce(forward[np.arange(len(pages)), lens - 1], axis=1)
        node = np.exp(forward + backward - norm[:, None, None])
        weight = 1.0 / np.sqrt(lens)
        node[row, col, truth[row, col]] -= 1
        pull = node[row, col] * weight[row][:, None]
        grad_w = np.stack([np.bincount(flat, np.repeat(pull[:, k], sizes), DIM) for k in (0, 1)], axis=1)
        pair = np.exp(np.minimum(forward[:, :-1, :, None] + self.steps + (scores + backward)[:, 1:, None, :]
                                 - norm[:, None, None, None], 0.0)) * (real[:, 1:] * weight[:, None])[:, :, None, None]
        grad_s = pair.sum(axis=(0, 1))
        r, c = np.nonzero(real[:, 1:])
        np.subtract.at(grad_s, (truth[r, c], truth[r, c + 1]), weight[r])
        path = scores[row, col, truth[row, col]].sum() + self.steps[truth[r, c], truth[r, c + 1]].sum()
        return grad_w, grad_s, float(norm.sum() - path)

    def fit(self, pages: list[tuple[list[np.ndarray], list[int]]], rounds: int = ROUNDS) -> "Chain":
        """AdaGrad over batches of pages of like length, in a fixed order."""
        order = random.Random(0)
        past_w, past_s = np.full((DIM, 2), 1e-6), np.full((2, 2), 1e-6)
        pages = sorted((p for p in pages if p[1]), key=lambda p: len(p[1]))
        batches = [pages[at:at + 32] for at in range(0, len(pages), 32)]
        for _ in range(rounds):
            order.shuffle(batches)
            for batch in batches:
                grad_w, grad_s, _ = self.gradients(batch)
                grad_w += DECAY * self.weights
                past_w += grad_w ** 2
                past_s += grad_s ** 2
                self.weights -= STEP * grad_w / np.sqrt(past_w)
                self.steps -= STEP * grad_s / np.sqrt(past_s)
        return self


# ---------------------------------------------------------------------------------- labelled pages

_MAIN = frozenset({"article", "main"})
_OTHER = frozenset("nav footer aside form header menu dialog search".split())


def labels_by_markup(blocks: list[Block]) -> list[int] | None:
    """1 inside ``article`` or ``main`` (unless deeper in a ``nav``, ``aside``, ``form`` ...), else 0; None if the
    markup names neither kind."""
    labels = [int(bool(b.places & _MAIN) and not b.places & (_OTHER - {"header"})) for b in blocks]
    return labels if any(labels) and any(b.places & _OTHER for b in blocks) else None


_SENTENCES = ["The report was read in the town hall on Monday evening.", "Members asked how the work would be paid for.",
              "A second meeting follows in spring, when the figures are known, and the plans will be shown to all.",
              "Nobody objected.", "The bridge, which was built a century ago, needs new beams before winter comes."]
#: Containers by role; words of ``class`` and ``id`` as page authors use them.
LAYOUTS = {
    "main": ["article", "main", "div class='content'", "div class='post-content entry'", "div id='article-body'", "section class='story'",
             "div class='entry-content'", "div itemprop='articleBody'", "div class='text'", "div role='main'", "td class='maincontent'",
             "div class='page-body post'", "article class='post hentry'", "div"],
    "nav": ["nav", "div class='menu'", "ul class='navigation'", "div id='nav'", "div class='navbar topbar'", "div role='navigation'",
            "div class='breadcrumbs'", "div class='main-menu'", "ul id='menu'"],
    "header": ["header", "div id='header'", "div class='site-header masthead'", "div class='top-bar'", "div class='banner' role='banner'",
               "div class='logo'"],
    "footer": ["footer", "div id='footer'", "div class='site-footer'", "div class='copyright legal'", "div role='contentinfo'",
               "div class='bottom'"],
    "side": ["aside", "div class='sidebar'", "div id='side'", "div class='widget'", "div class='related-posts'", "section class='recommended more'",
             "div role='complementary'", "div class='promo teaser'", "div class='popular trending'"],
    "ad": ["div class='ad'", "div class='advertisement'", "div class='ads sponsored'", "div id='ad-banner'", "aside class='advert'",
           "div class='sponsor'", "div class='adsbygoogle'", "section class='promotion'", "p class='ad'"],
    "notice": ["div class='cookie-notice'", "div id='cookie-consent'", "div class='gdpr-banner'", "div class='alert notice'",
               "div role='alert'", "div class='modal popup'", "dialog", "div class='paywall subscribe'", "section class='consent notice'",
               "div class='disclaimer'", "p class='notice'", "div class='newsletter signup'"],
    "form": ["form", "form class='search'", "form class='newsletter-form'", "form id='login'", "div class='search-box'", "form class='comment-form'"],
    "comments": ["section class='comments'", "div id='comments'", "div class='comment-list'", "ol class='commentlist'", "div class='disqus thread'",
                 "div class='reader-comments'", "section id='discussion' class='replies'", "div class='comment'", "div class='responses'",
                 "div class='user-reviews feedback'", "article class='comment'"],
    "share": ["div class='share'", "ul class='social-links'", "div class='tags meta'", "p class='byline meta'", "div class='author-bio'"],
}


def _closing(opening: str) -> str:
    return f"</{opening.split()[0]}>"


def _clothe(r: random.Random, main: list[str], other: list[str]) -> tuple[str, list[int]]:
    """One page from labelled texts in random containers, and the label of each of its blocks."""
    parts: list[str] = []
    labels: list[int] = []

    def esc(t: str) -> str:
        return html.escape(t, quote=False)

    def some(k: int, long: bool) -> list[str]:
        return [_short(r, r.choice(other + main if long else other), 40 if long and r.random() < 0.7 else 8) for _ in range(k)]

    def put(role: str) -> None:
        """A container that is no part of the article."""
        opening = r.choice(LAYOUTS[role])
        tag = opening.split()[0]
        texts = some(r.randint(2, 8) if role == "nav" else r.randint(1, 4 if role in ("comments", "side", "footer") else 2),
                     role in ("notice", "ad", "comments", "side", "form", "footer"))
        inner = "li" if tag in ("ul", "ol") else "span" if tag == "p" else r.choice(["p", "div", "li", "p"])
        bare = tag == "p" or inner != "li" and len(texts) == 1 and r.random() < 0.5
        linked = role == "nav" or role in ("side", "share", "footer") and r.random() < 0.4
        body = []
        if role in ("header", "side", "comments", "form", "notice") and not bare and inner != "li" and r.random() < 0.6:
            head = r.choice(["h1", "h2", "h1"] if role == "header" else ["h2", "h3", "h4"])
            body.append(f"<{head}>{esc(_short(r, r.choice(other + main), 4))}</{head}>")
            labels.append(0)
        if role == "nav" and inner != "li" and r.random() < 0.4:      # one run of links
            body.append(" ".join(f"<a href='/'>{esc(t)}</a>" for t in texts))
            labels.append(0)
        elif bare:
            body.append(f"<a href='#'>{esc(texts[0])}</a>" if linked else esc(texts[0]))
            labels.append(0)
        else:
            mark = r.choice([" class='comment'", " class='reply'", "", ""]) if role == "comments" else ""
            for t in texts:
                body.append(f"<{inner}{mark}>" + (f"<a href='#'>{esc(t)}</a>" if linked else esc(t)) + f"</{inner}>")
                labels.append(0)
        if role == "form":
            body.append("<input name='q'><button>Go</button>")
        parts.append(f"<{opening}>{''.join(body)}{_closing(opening)}")

    alone = r.random() < 0.15                           # an article with nothing around it
    if alone and r.random() < 0.3:
        return "".join(f"{esc(t)}<hr>" for t in main), [1] * len(main)
    outer = r.random() < 0.5
    if outer:
        parts.append(r.choice(["<div class='wrapper'>", "<div id='page' class='container'>", "<div>"]))
    for role, chance in (("notice", 0.35), ("header", 0.5), ("nav", 0.8), ("ad", 0.4), ("form", 0.25), ("side", 0.2)):
        if not alone and r.random() < chance:
            put(role)
    opening = r.choice(LAYOUTS["main"])
    table = opening.startswith("td")
    wide = not table and r.random() < 0.2               # comments and sidebars may share ``main`` with the article
    parts.append("<table><tr>" if table else "<main>" if wide else "")
    parts.append(f"<{opening}>")
    if r.random() < 0.7:
        head = r.choice(["h1", "h2", "h1"])
        wrap = r.random() < 0.3
        parts.append(("<header>" if wrap else "") + f"<{head}>{esc(_short(r, main[0], 12))}</{head}>" + ("</header>" if wrap else ""))
        labels.append(1)
    if not alone and r.random() < 0.25:
        put("share")
    plain = r.random()
    for i, t in enumerate(main):
        if i and not alone and r.random() < 0.12:
            put(r.choice(["ad", "side", "notice", "share", "form", "nav"]))
        if i and r.random() < 0.1:
            head = r.choice(["h2", "h3"])
            parts.append(f"<{head}>{esc(_short(r, t, 6))}</{head}>")
            labels.append(1)
        kind = r.choice(["p", "div", "blockquote", "pre", "li"]) if plain < 0.3 else "p"
        text = esc(t if r.random() < 0.8 else _short(r, t, 8))
        if r.random() < 0.15:
            parts.append(f"<{kind}><b>{text}<br></b></{kind}>")
        elif r.random() < 0.1:
            parts.append(f"<{kind}>{text} <a href='/x'>{esc(_short(r, t, 3))}</a></{kind}>")
        else:
            parts.append(f"<{kind}>{text}</{kind}>")
        labels.append(1)
    if not alone and r.random() < 0.3:
        put(r.choice(["comments", "share", "side", "form"]))
    parts.append(_closing(opening) + ("</tr></table>" if table else ""))
    for role, chance in (("share", 0.3), ("comments", 0.45), ("side", 0.5)):
        if not alone and r.random() < chance:
            put(role)
    parts.append("</main>" if wide else "")
    for role, chance in (("form", 0.3), ("ad", 0.3), ("notice", 0.2), ("footer", 0.85)):
        if not alone and r.random() < chance:
            put(role)
    if outer:
        parts.append("</div>")
    return "<html><body>" + "".join(parts) + "</body></html>", labels


def _short(r: random.Random, text: str, words: int) -> str:
    w = text.split()
    k = min(len(w), r.randint(1, words))
    at = r.randint(0, len(w) - k)
    return " ".join(w[at:at + k])


def training_pages(labelled: list[str], copies: int = COPIES) -> list[tuple[list[np.ndarray], list[int]]]:
    """Feature sequences and labels of the labelled pages, as they stand and re-clothed.

    A third of the re-clothed pages show the field only what is around the blocks, so that it does not lean
    on the texts alone.
    """
    r = random.Random(13)
    out, stock = [], []
    for page in labelled:
        blocks = blocks_of(page, places=True)
        labels = labels_by_markup(blocks)
        if labels is None:
            continue
        out.append((page_features(blocks), labels))
        texts = [b.text for b in blocks]
        stock.append(([t for t, y in zip(texts, labels, strict=True) if y], [t for t, y in zip(texts, labels, strict=True) if not y]))
    if not stock:
        stock = [(r.choices(_SENTENCES, k=r.randint(1, 8)), [_short(r, s, 5) for s in _SENTENCES]) for _ in range(FIT_PAGES // 2)]
    for main, other in stock:
        for _ in range(copies):
            page, labels = _clothe(r, main[:FIT_BLOCKS], other)
            blocks = blocks_of(page)
            if len(blocks) == len(labels):          # a text that markup splits or swallows is left out
                out.append(([_indices(["bias", *b.around]) for b in blocks] if r.random() < 0.33 else page_features(blocks), labels))
    return out


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Chain:
    """The field fitted on at most ``fit_pages`` labelled pages of at most ``FIT_CHARS`` characters.

    They are looked for among about ``4 * fit_pages`` different pages whose hash lies under a cut that
    follows from the number of rows, so what meets in the last step does not grow with the table.
    """
    span = int(2 ** 64 * min(1.0, 4 * fit_pages / max(1, pages.count())))
    page = F.col("html").cast("string")
    rows = pages.select(page.alias("html"), F.xxhash64(page).alias("h")).where(F.col("h") <= span - 2 ** 63 - 1).where(
        (F.length("html") <= FIT_CHARS) & F.col("html").rlike("(?i)<(article|main)[\\s>]")
        & F.col("html").rlike("(?i)<(nav|footer|aside|form|header|menu|dialog)[\\s>]"))
    chosen = rows.groupBy("h").agg(F.min("html").alias("html")).orderBy("h").limit(fit_pages)
    return Chain().fit(training_pages([r["html"] for r in chosen.collect()]))


# ---------------------------------------------------------------------------------- extraction

#: Feature sums that a task keeps at most.
KNOWN = 200_000


def main_text(chain: Chain, page: str, known: dict) -> str:
    """Main text of one page."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    if len(known) > KNOWN:
        known.clear()
    return " ".join(b.text for b, y in zip(blocks, chain.viterbi(chain.page_scores(blocks, known)), strict=True) if y)


def extract(pages: DataFrame, chain: Chain | None = None, fit_pages: int = FIT_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    model = shared(pages.sparkSession, chain or fit(pages, fit_pages))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, known = model(), {}
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = [main_text(chain, page, known) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
