"""Main-text extraction with a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with its chain of block-level
ancestors. A block's features are the tags and the class, id and role words of its ancestors, those of
the nearest one apart, and what its text looks like (length, share of linked text, final punctuation,
tell-tale words, place in the page). The field has two states (main text or not); its transitions depend
on whether two blocks have the same parent. It is trained on labelled pages by conditional
likelihood, and decoded by Viterbi, all pages of a batch advancing together.

The labelled pages are made by ``labelled_pages``: layouts of the kinds that sites use (semantic tags, classed
boxes, tables, bare boxes), with invented prose and known labels; their number is the parameter ``n_pages``
and nothing of the corpus goes into them. Training takes a few seconds on the driver and gives the same weights each time.

Extraction is one pass without shuffle; the weights are sent to all tasks. Text of main-text blocks
has its character references decoded and white space turned into single spaces; blocks are joined by a space.
Scripts, styles, form controls, comments and the head have no text.

Defined cases: null or empty html, and html without main text, give an empty text; unclosed tags, a page that
ends inside a tag and stray ends are tolerated; repeated rows are extracted each; other columns pass;
an empty table gives no rows. Time is linear in the page's length.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import inner_name, map_batches, packed, unpacked
from .words import portions

# Fixed values of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var"
    " math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mstyle mspace mover munder munderover mpadded mphantom menclose mmultiscripts semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe svg annotation annotation-xml title textarea select button object canvas audio video head".split())
#: Tags that say what a box is for: the last two of them above a block are a feature together.
TELLING = frozenset("article aside footer form header main nav section".split())
#: Of these, those that run to the page's end if they aren't closed.
RAW = frozenset("script style title textarea".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}}

_token = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z""", re.S)
_attribute = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_name = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words in a block's own text that tell of what it is.
TELLTALE = frozenset(
    "cookie cookies consent subscribe newsletter advertisement sponsored copyright privacy terms share tweet follow login register reply replies comment comments related copy rights reserved menu search sitemap contact".split()
)
_plain = re.compile(r"[a-z]+").findall
#: Boxes nested deeper than this, and words of a tag beyond so many, give no features of their own; their text counts as any other.
DEEPEST, MOST_WORDS = 256, 64


def _attribute_words(attributes: str) -> tuple[str, ...]:
    out = []
    for name, value in _attribute.findall(attributes):
        if name.lower() == "hidden":
            out.append("hidden")
        for w in _name.findall(value):
            w = w.lower()
            out.append(w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w)
    return tuple(dict.fromkeys(out))[:MOST_WORDS]


class Node:
    """A chain of block-level ancestors: the tag and words of the last, and the features of all."""

    __slots__ = ("tag", "depth", "above", "nearest", "chain", "children", "score")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Node | None) -> None:
        self.tag, self.depth = tag, parent.depth + 1 if parent else 0
        own = {f"above:{tag}", *(f"word:{w}" for w in words)}
        above = parent.above if parent else frozenset()
        self.above = above if own <= above or self.depth > DEEPEST else above | own
        self.nearest = (f"in:{tag}", *(f"near:{w}" for w in words)) if words or tag not in ("div", "p", "li", "ul", "ol", "tr", "td", "table", "tbody", "h1", "h2", "h3", "h4") or not parent else parent.nearest
        chain = parent.chain if parent else ("", "")
        self.chain = (chain[1], tag) if tag in TELLING else chain
        self.children: dict[tuple[str, str], Node] = {}
        self.score: float | None = None

    def features(self) -> list[str]:
        return [f"own:{self.tag}", f"chain:{self.chain[0]}>{self.chain[1]}", *self.nearest, *self.above]


class Trees:
    """Nodes of all pages seen, shared where tags and attributes are equal; forgotten when they are many."""

    def __init__(self, most: int = 200_000) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.root, self.count = Node("html", (), None), 1

    def child(self, parent: Node, tag: str, attributes: str) -> Node:
        got = parent.children.get((tag, attributes))
        if got is None:
            got = parent.children[tag, attributes] = Node(tag, _attribute_words(attributes) if attributes.strip() else (), parent)
            self.count += 1
        return got


def blocks(page: str, trees: Trees) -> list[tuple[str, Node, int]]:
    """(text, node, characters of it inside links) of each leaf block in page order."""
    if trees.count > trees.most:
        trees.clear()
    out: list[tuple[str, Node, int]] = []
    stack, open_ = [trees.root], {"html": 1}
    pieces: list[str] = []
    linked, in_link, node = 0, False, trees.root
    at, n = 0, len(page)
    never: set[str] = set()  # tags that nothing closes any more

    def close() -> None:
        nonlocal pieces, linked, in_link
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, node, min(linked, len(text))))
            pieces, linked = [], 0
        in_link = False

    def pop() -> None:
        open_[stack.pop().tag] -= 1

    def add(raw: str) -> None:
        nonlocal node, linked
        if not pieces:
            if raw.isspace():
                return
            node = stack[-1]
        raw = _html.unescape(raw) if "&" in raw else raw
        pieces.append(raw)
        if in_link:
            linked += len(raw.strip())

    while at < n:
        m = _token.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        ends, tag, attributes = bool(m[1] or m[4]), tag.lower(), m[3] or m[6] or ""
        if tag in INLINE:
            if tag == "a":
                in_link = not ends
        elif tag == "br":
            if pieces:
                pieces.append(" ")
        elif tag in SILENT:
            if tag not in ("button", "object", "canvas"):
                close()
            if not ends and not attributes.endswith("/"):
                stop = None if tag in never else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>" + ("|(?=<body[ >])" if tag == "head" else ""), re.I).search(page, at)
                if stop is None:
                    never.add(tag)
                at = stop.end() if stop else n if tag in RAW else at
        elif tag in VOID:
            if tag == "hr":
                close()
        elif ends:
            close()
            if open_.get(tag, 0) > 0 and tag != "html":
                while stack[-1].tag != tag:
                    pop()
                pop()
        else:
            close()
            if stack[-1].tag == "p":
                pop()
            while len(stack) > 1 and stack[-1].tag in CLOSED_BY.get(tag, ()):
                pop()
            if tag != "html":
                stack.append(trees.child(stack[-1], tag, attributes))
                open_[tag] = open_.get(tag, 0) + 1
    close()
    return out


def _bin(x: int) -> int:
    return min(x, 3) if x < 4 else min(x.bit_length() + 1, 9)


def text_features(text: str, linked: int, place: float) -> tuple[tuple, set[str]]:
    """(features of a block's text, tell-tale words in it)."""
    words = text.count(" ") + 1
    share = linked * 4 // max(1, len(text))
    last = text[-1]
    return (
        (f"words:{_bin(words)}", f"linked:{share}", f"linked_words:{share > 1}:{_bin(words)}", f"last:{'s' if last in '.!?…。' else 'p' if not last.isalnum() else 'w'}",
         f"commas:{_bin(text.count(','))}", f"place:{int(place * 8)}", f"mark:{'©' in text or '|' in text or '»' in text}"),
        TELLTALE.intersection(_plain(text.lower())) if words < 40 else set(),
    )


# -- the field -------------------------------------------------------------------------------


def _padded(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each block in a pages-by-steps matrix, flattened; pages as rows)."""
    rows = np.repeat(np.arange(len(lens)), lens)
    return rows, np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)


def viterbi(score: np.ndarray, same: np.ndarray, lens: np.ndarray, move: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Best states of all blocks. score: of state 1 (state 0 has 0); same: 1 if the block before has the same parent; move[same, from, to]."""
    out = np.zeros(len(score), np.int8)
    order = np.argsort(-lens, kind="stable")
    lens_s, firsts = lens[order], (np.cumsum(lens) - lens)[order]
    steps = int(lens_s[0]) if len(lens_s) else 0
    # Pages in falling order of length: those still running are a prefix.
    live = np.searchsorted(-lens_s, -np.arange(steps), side="left")
    best = np.zeros((len(lens), 2))
    back = []
    for t in range(steps):
        k = live[t]
        own = np.stack([np.zeros(k), score[firsts[:k] + t]], 1)
        if t == 0:
            best[:k] = own + start
            continue
        total = best[:k, :, None] + move[same[firsts[:k] + t]]
        pick = total.argmax(1)
        best[:k] = np.take_along_axis(total, pick[:, None], 1)[:, 0] + own
        back.append(pick.astype(np.int8))
    if steps:
        state = np.zeros(len(lens), np.int64)
        for t in range(steps - 1, -1, -1):
            k = live[t]
            ending = live[t + 1] if t + 1 < steps else 0
            state[ending:k] = (best[ending:k] + end).argmax(1)
            if t + 1 < steps:
                state[:ending] = back[t][np.arange(ending), state[:ending]]
            out[firsts[:k] + t] = state[:k]
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def _gradient(score: np.ndarray, same: np.ndarray, lens: np.ndarray, truth: np.ndarray, move: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(log-likelihood, its gradient by score, move, start and end) by forward and backward sums; all pages non-empty."""
    rows, cols = _padded(lens)
    m, steps = len(lens), int(lens.max())
    own = np.zeros((m, steps, 2))
    own[rows, cols, 1] = score
    link = np.zeros((m, steps), np.int64)
    link[rows, cols] = same
    inside = np.arange(steps) < lens[:, None]
    alpha, beta = np.zeros((m, steps, 2)), np.zeros((m, steps, 2))
    alpha[:, 0] = own[:, 0] + start
    for t in range(1, steps):
        new = _log_sum(alpha[:, t - 1, :, None] + move[link[:, t]], 1) + own[:, t]
        alpha[:, t] = np.where(inside[:, t, None], new, alpha[:, t - 1])
    z = _log_sum(alpha[:, -1] + end, 1)
    beta[:, -1] = end
    for t in range(steps - 2, -1, -1):
        new = _log_sum(move[link[:, t + 1]] + (own[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(inside[:, t + 1, None], new, end)
    p = np.exp(alpha + beta - z[:, None, None])
    y = np.zeros((m, steps), np.int64)
    y[rows, cols] = truth
    pair = alpha[:, :-1, :, None] + move[link[:, 1:]] + (own[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
    pair = np.where(inside[:, 1:, None, None], np.exp(np.minimum(pair, 0)), 0)
    d_move = np.zeros((2, 2, 2))
    both = inside[:, 1:]
    for s in (0, 1):
        at = both & (link[:, 1:] == s)
        np.add.at(d_move[s], (y[:, :-1][at], y[:, 1:][at]), 1)
        d_move[s] -= pair[at].sum(0)
    last = y[np.arange(m), lens - 1]
    d_start = np.bincount(y[:, 0], minlength=2) - p[:, 0].sum(0)
    d_end = np.bincount(last, minlength=2) - p[np.arange(m), lens - 1].sum(0)
    gold = (score * truth).sum() + start[y[:, 0]].sum() + end[last].sum() + move[link[:, 1:], y[:, :-1], y[:, 1:]][both].sum()
    return gold - z.sum(), truth - p[rows, cols, 1], d_move, d_start, d_end


class Field:
    """Weights of features and transitions."""

    def __init__(self, weights: dict[str, float], move: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.weights, self.move, self.start, self.end = weights, move, start, end
        self._trees, self._texts = Trees(), {}

    def __getstate__(self):
        return self.weights, self.move, self.start, self.end

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def _score(self, text: str, node: Node, linked: int, place: float) -> float:
        w = self.weights
        if node.score is None:
            node.score = sum(w.get(f, 0.0) for f in node.features())
        plain, tell = text_features(text, linked, place)
        got = self._texts.get(plain)
        if got is None:
            if len(self._texts) > 100_000:
                self._texts.clear()
            got = self._texts[plain] = sum(w.get(f, 0.0) for f in plain)
        return node.score + got + sum(w.get(f"tell:{t}", 0.0) for t in tell)

    def decode(self, pages: list[str]) -> list[list[tuple[str, bool]]]:
        """(text, is main text) of the leaf blocks of each page."""
        found = [blocks(p, self._trees) for p in pages]
        lens = np.array([len(b) for b in found], np.int64)
        score = np.array([self._score(*b, k / len(own)) for own in found for k, b in enumerate(own)])
        nodes = [b[1] for own in found for b in own]
        same = np.array([0] + [int(a.above is b.above) for a, b in zip(nodes, nodes[1:], strict=False)], np.int64)[: len(nodes)]
        states = iter(viterbi(score, same, lens, self.move, self.start, self.end).tolist())
        return [[(b[0], bool(next(states))) for b in own] for own in found]

    def main_texts(self, pages: list[str]) -> list[str]:
        return [" ".join(t for t, main in own if main) for own in self.decode(pages)]


def train(pages: list[list[tuple[str, Node, int]]], labels: list[list[int]], steps: int = 160, rate: float = 0.15, decay: float = 0.02) -> Field:
    """Conditional likelihood with a quadratic penalty, by Adam over all pages."""
    names: dict[str, int] = {}
    flat, sizes, same, truth, lens = [], [], [], [], []
    for own, y in zip(pages, labels, strict=True):
        if not own:
            continue
        before = None
        for k, ((text, node, linked), state) in enumerate(zip(own, y, strict=True)):
            plain, tell = text_features(text, linked, k / len(own))
            features = [*node.features(), *plain, *(f"tell:{t}" for t in tell)]
            flat += [names.setdefault(f, len(names)) for f in features]
            sizes.append(len(features))
            same.append(int(before is not None and before.above is node.above))
            truth.append(state)
            before = node
        lens.append(len(own))
    flat, same, truth, lens = (np.array(x, np.int64) for x in (flat, same, truth, lens))
    cut = np.cumsum(sizes) - sizes
    block = np.repeat(np.arange(len(sizes)), sizes)
    n = len(names)
    x = np.zeros(n + 12)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        score = np.add.reduceat(x[flat], cut)
        _, d_score, d_move, d_start, d_end = _gradient(score, same, lens, truth, x[n : n + 8].reshape(2, 2, 2), x[n + 8 : n + 10], x[n + 10 :])
        g = np.concatenate([np.bincount(flat, d_score[block], n), d_move.ravel(), d_start, d_end]) / len(lens) - decay * x / len(lens) * 10
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-6)
    weights = {f: float(x[i]) for f, i in names.items()}
    return Field(weights, x[n : n + 8].reshape(2, 2, 2).copy(), x[n + 8 : n + 10].copy(), x[n + 10 :].copy())


# -- labelled pages --------------------------------------------------------------------------

MAIN, REST = "\ue000", "\ue001"
_SYLLABLES = "an er on re in at is or ti es en le de la un ka mo ri ta su vi zo el ma no pe qua ch st th sch ung lich que eau ción é ñ ß ü".split()
_NAMES = {
    "main": "content main article post entry story body text page-content post-content entry-content article-body articleBody storyText main-content blog-post single hentry prose td-post-content rich-text",
    "nav": "nav menu navigation navbar main-menu topnav site-nav breadcrumb breadcrumbs pagination pager tabs submenu",
    "header": "header masthead top site-header page-header topbar branding logo banner",
    "footer": "contentinfo footer site-footer bottom colophon copyright legal page-footer foot",
    "side": "complementary sidebar side aside widget widget-area rail right-column left-col secondary related recommended more-stories popular trending read-more teaser",
    "notice": "notice cookie cookie-banner cookie-notice consent gdpr alert message warning overlay popup modal disclaimer privacy-notice notification paywall",
    "ad": "ad ads advert advertisement ad-slot banner-ad sponsored sponsor promo promotion google-ad adsense commercial",
    "form": "form search search-form newsletter subscribe signup login contact-form newsletter-signup",
    "comment": "comments comment comment-list commentlist respond discussion replies reply disqus reader-comments feedback user-comments comment-section",
    "share": "share social social-share sharing share-buttons follow tags tag-list byline-links",
}
_NAMES = {k: v.split() for k, v in _NAMES.items()}
_PHRASES = {
    "nav": "Home|About|Contact|News|Sport|Archive|Menu|Sitemap",
    "footer": "© 2024 All rights reserved|Privacy|Terms|Copyright|Contact",
    "notice": "We use cookies|This site needs your consent|Accept cookies|Privacy",
    "ad": "Advertisement|Sponsored|Buy now",
    "form": "Search|Subscribe to our newsletter|Login|Register",
    "comment": "Reply|Comments|Leave a comment|Login to comment",
    "share": "Share|Tweet|Follow us|Copy link",
    "side": "Related|Popular|Read more|Newsletter",
    "header": "Menu|Search|Login",
}
_PHRASES = {k: v.split("|") for k, v in _PHRASES.items()}


class _Writer:
    """One labelled page."""

    def __init__(self, rng: random.Random) -> None:
        self.r = rng
        self.words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(80)]
        self.junk = rng.random() < 0.08
        self.named = rng.random() < 0.85  # else boxes have no class
        self.semantic = rng.random() < 0.55
        self.closed = rng.random() < 0.7

    def say(self, n: int, mark: str, stop: float = 0.8) -> str:
        out = [self.r.choice(self.words) + (self.r.choice(["###", "%%%", "&amp;&amp;", "***"]) if self.junk and self.r.random() < 0.7 else "") + ("," if self.r.random() < 0.08 else "") for _ in range(n)]
        for k in range(0, n, self.r.randrange(4, 14)):
            out[k] = out[k].capitalize()
            if k and self.r.random() < 0.8:
                out[k - 1] = out[k - 1].rstrip(",") + "."
        return mark + " ".join(out) + ("." if self.r.random() < stop else "")

    def phrase(self, kind: str) -> str:
        if self.r.random() < 0.5:
            return REST + self.r.choice(_PHRASES[kind])
        return self.say(self.r.randrange(1, 4), REST, 0.1)

    def attr(self, kind: str, force: bool = False) -> str:
        if not (self.named or force):
            return ""
        name = self.r.choice(_NAMES[kind])
        if self.r.random() < 0.2:
            name += self.r.choice(["-wrapper", "-inner", "-box", " clearfix", " col-md-8", "_1"])
        return f' {self.r.choice(["class", "class", "id", "role"])}="{name}"'

    def box(self, kind: str, inner: str, tag: str | None = None, force: bool = False) -> str:
        own = {"nav": "nav", "header": "header", "footer": "footer", "side": self.r.choice(["aside", "aside", "section", "div"]), "form": "form", "main": "article", "comment": self.r.choice(["section", "div"]), "ad": "aside", "notice": "div", "share": "div"}[kind]
        if tag is None:
            tag = own if self.semantic or kind == "form" and self.r.random() < 0.7 else self.r.choice(["div", "div", "section"])
        plain = tag in ("nav", "footer", "header", "aside", "form", "article")
        a = self.attr(kind, force) if not plain or self.r.random() < 0.5 else ""
        if self.r.random() < 0.15:
            inner = f"<div>{inner}</div>"
        return f"<{tag}{a}>{inner}</{tag}>"

    def links(self, kind: str, n: int) -> str:
        each = [f'<a href="/{k}">{self.phrase(kind)}</a>' for k in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>" if self.r.random() < 0.7 else self.r.choice([" | ", " ", ""]).join(each)

    def prose(self, n: int, mark: str) -> list[str]:
        out = []
        for _ in range(n):
            kind, r = self.r.random(), self.r
            length = r.choice([1, 2, 4, 8, 15, 30, 50, 80, 120])
            text = self.say(length, mark)
            if kind < 0.72:
                if r.random() < 0.15:
                    text = f"<b>{text}<br>" if r.random() < 0.5 else f'{text} <a href="#">{self.say(2, "", 0)}</a> {self.say(6, "")}'
                out.append(f"<p>{text}" + ("</p>" if self.closed or r.random() < 0.8 else ""))
            elif kind < 0.80:
                level = r.choice("234")
                out.append(f"<h{level}>{self.say(r.randrange(1, 7), mark, 0.2)}</h{level}>")
            elif kind < 0.87:
                items = "".join(f"<li>{self.say(r.randrange(1, 12), mark, 0.4)}</li>" for _ in range(r.randrange(2, 5)))
                out.append(f"<ul>{items}</ul>")
            elif kind < 0.91:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.94:
                out.append(f"<pre>{text}</pre>")
            elif kind < 0.97:
                out.append(f"<figure><img src=x><figcaption>{self.say(r.randrange(3, 12), mark)}</figcaption></figure>")
            else:
                rows = "".join("<tr>" + "".join(f"<td>{self.say(r.randrange(1, 4), mark, 0)}</td>" for _ in range(3)) + "</tr>" for _ in range(2))
                out.append(f"<table>{rows}</table>")
        return out

    def insert(self) -> str:
        """A box that stands among the article's paragraphs."""
        r = self.r
        kind = r.choice(["ad", "ad", "share", "side", "side", "form", "notice"])
        say = self.phrase(kind) if r.random() < 0.4 else self.say(r.randrange(3, 25), REST)
        if kind in ("ad", "notice") and r.random() < 0.4:
            return self.box(kind, say, tag="p", force=True)
        if kind in ("ad", "notice"):
            return self.box(kind, r.choice(["", "<p>"]) + say, force=True)
        if kind == "form":
            return self.box(kind, f"<p>{say}</p><label>{self.phrase(kind)}</label><input name=q>", tag=r.choice(["form", "div"]), force=True)
        inner = self.links(kind, r.randrange(1, 5)) if kind == "share" or r.random() < 0.6 else f"<p>{say}</p>"
        head = f"<h4>{self.phrase(kind)}</h4>" if r.random() < 0.7 else ""
        return self.box(kind, head + inner, force=True)

    def comments(self) -> str:
        one = lambda: f"<{t}{self.attr('comment') if self.r.random() < 0.5 else ''}><p>{self.say(self.r.randrange(1, 45), REST)}</p></{t}>"
        t = self.r.choice(["li", "div", "article"])
        inner = "".join(one() for _ in range(self.r.randrange(1, 7)))
        inner = f"<ol>{inner}</ol>" if t == "li" else inner
        return self.box("comment", f"<h3>{self.phrase('comment')}</h3>{inner}", force=True)

    def page(self) -> str:
        r = self.r
        body = self.prose(r.choice([1, 2, 3, 5, 9, 14, 22]), MAIN)
        if r.random() < 0.85:
            body.insert(0, f"<h1>{self.say(r.randrange(3, 12), MAIN, 0.3)}</h1>")
        if self.semantic and r.random() < 0.25:
            body[0] = f"<header>{body[0]}</header>"
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            body.insert(r.randrange(1, len(body) + 1), self.insert())
        if r.random() < 0.2:
            k = r.randrange(1, len(body) + 1)
            body = [f"<section>{''.join(body[:k])}</section>", *([f"<section>{''.join(body[k:])}</section>"] if body[k:] else [])]
        comments = self.comments() if r.random() < 0.3 else ""
        inside = r.random() < 0.4
        text = "".join(body) + (comments if inside else "")
        if r.random() < 0.1 and not self.semantic:
            main = f"<table><tr><td>{self.links('nav', 5)}</td><td>{text}</td></tr></table>"
        elif r.random() < 0.15 and not self.semantic:
            main = text
        else:
            main = self.box("main", text, tag=r.choice(["main", "article", "article"]) if self.semantic else "div", force=r.random() < 0.5)
        sides = [self.box("side", "".join(self.box("side", f"<h3>{self.phrase('side')}</h3>" + (self.links("side", r.randrange(2, 7)) if r.random() < 0.6 else f"<p>{self.say(r.randrange(4, 40), REST)}</p>"), tag="div") for _ in range(r.randrange(1, 3)))) for _ in range(r.choice([0, 0, 1, 1, 2]))]
        parts = [main, *sides] if r.random() < 0.6 else [*sides, main]
        middle = "".join(parts)
        if r.random() < 0.4:
            middle = f"<div{r.choice(['', ' class=container', ' id=wrapper', ' class=row'])}>{middle}</div>"
        top = ""
        if r.random() < 0.75:
            top += self.box("nav", self.links("nav", r.randrange(2, 9)))
        if r.random() < 0.5:
            top = self.box("header", (f"<h1>{self.phrase('header')}</h1>" if r.random() < 0.3 else f"<div>{self.phrase('header')}</div>") + top)
        if r.random() < 0.4:
            say = self.say(r.randrange(3, 25), REST) if r.random() < 0.6 else self.phrase("ad")
            top += self.box("ad", say, tag=r.choice(["div", "div", "aside"]), force=True)
        if r.random() < 0.3:
            top += self.box("form", f"<label>{self.phrase('form')}</label><input><p>{self.say(r.randrange(2, 12), REST)}</p>")
        notice = self.box("notice", f"<p>{self.phrase('notice')} {self.say(r.randrange(2, 25), '')}</p>", force=True) if r.random() < 0.35 else ""
        bottom = (comments if not inside else "") + (self.box("side", f"<h3>{self.phrase('side')}</h3>" + self.links("side", 4), force=True) if r.random() < 0.25 else "")
        foot = self.phrase("footer") + " " + (self.say(r.randrange(2, 25), "") if r.random() < 0.6 else "")
        foot = f"<p>{foot}</p>" if r.random() < 0.4 else foot
        if r.random() < 0.3:
            foot += self.links("footer", r.randrange(2, 6))
        if r.random() < 0.2:
            bottom += f"{r.choice(['<hr>', ''])}<p>{REST}{r.choice(['Copyright', '©', '&copy;'])} {r.randrange(1995, 2030)} {self.phrase('footer')}</p>"
        else:
            bottom += self.box("footer", foot, force=not self.semantic and r.random() < 0.7) if r.random() < 0.9 else ""
        page = (notice + top + middle + bottom) if r.random() < 0.5 else (top + middle + notice + bottom)
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{page}</body></html>"


def labelled_pages(n: int, seed: int = 5) -> Iterator[str]:
    """Invented pages; MAIN and REST in front of the texts are the labels."""
    rng = random.Random(seed)
    for _ in range(n):
        yield _Writer(rng).page()


def labelled_blocks(page: str, trees: Trees) -> tuple[list[tuple[str, Node, int]], list[int]]:
    own = [b for b in blocks(page, trees) if MAIN in b[0] or REST in b[0]]
    y = [int(MAIN in b[0]) for b in own]
    return [(b[0].replace(MAIN, "").replace(REST, "") or "x", b[1], b[2]) for b in own], y


@lru_cache(4)
def default_field(n_pages: int = 1200, seed: int = 5) -> Field:
    trees = Trees(1 << 40)
    both = [labelled_blocks(p, trees) for p in labelled_pages(n_pages, seed)]
    return train([b for b, _ in both], [y for _, y in both])


# -- the operator ----------------------------------------------------------------------------


def extract(pages: DataFrame, field: Field | None = None, n_pages: int = 1200) -> DataFrame:
    """``pages``, all columns, with __text (main text) and __n_blocks (leaf blocks of the page)."""
    sent = pages.sparkSession.sparkContext.broadcast(field or default_field(n_pages))
    own = pages.select(packed(pages, "html"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            for start, end in portions(batch.column("html"), 2 << 20):
                part = batch.slice(start, end - start)
                found = field.decode([t or "" for t in part.column("html").to_pylist()])
                texts = pa.array([" ".join(t for t, main in b if main) for b in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("html"), texts, pa.array([len(b) for b in found], pa.int64())], names=["row", "html", "text", "n_blocks"])

    out = map_batches(own, run, StructType([own.schema["row"], own.schema["html"], StructField("text", StringType()), StructField("n_blocks", LongType())]))
    return out.select(*unpacked(pages, "html"), *[F.col(c).alias(inner_name(pages, f"__{c}")) for c in ("text", "n_blocks")])
