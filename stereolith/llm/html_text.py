"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element that holds text is a node, and so is every run of text, as a leaf below its element. An element is *on* if
text of the story lies below it, a leaf if it is such text. A node's features (tag, words of class and id, length and link
density of its text, whether it stands in an article or main element or beside one, whether a heading like "3 comments" precedes it) give
its own potential. Each parent is tied to its child by a potential of their two labels, one for each pair of kinds that they are of
(a wrapper of a story, an element of other purpose, any other element, text). Messages are passed upward from the leaves and
downward from the root (sum-product), which on a tree gives exact marginals; leaves of a marginal of 0.5 or more are the text.

All potentials are fitted together, by gradient ascent of the likelihood of labelled pages, whose gradient is made of the same
marginals. The labelled pages are laid out here by rule (``labelled_pages``): stories with and without a wrapper, beside
menus, headers, footers, sidebars, notices, adverts, forms and comments, with semantic tags, with classes alone or, beside a wrapper, with neither.
Pages that have no labels are never trained on, so a result doesn't depend on which pages are scored together.

The parser takes time in proportion to the page, however deep or broken: open elements are found by depth, not by search.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stereolith.llm import text as T

# fixed values: element names of HTML
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEAD = frozenset("base link meta noscript script style template title head".split())
#: Elements whose content is left out; the second kind hides nothing where it is never closed.
RAW = frozenset("script style noscript textarea iframe title".split())
HIDDEN = frozenset("template svg math select option button".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"]}
SCOPE = {"li": ["ul", "ol", "menu"], "dt": ["dl"], "dd": ["dl"], "tr": ["table"], "td": ["table", "tr"], "th": ["table", "tr"]}
CELLS = ("td", "th", "table")
TAGS = "main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form fieldset address details summary".split()
#: Groups of words in class, id, role and itemprop.
HINTS = {
    "advert": "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toolbar tabs pagination pager",
    "comments": "comments commentlist commentary replies disqus discussion respond responses",
    "comment": "comment reply",
    "footer": "footer foot colophon copyright legal",
    "header": "masthead topbar siteheader header logo branding",
    "side": "sidebar side aside related widget widgets rail right left recommended popular trending complementary more",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay paywall disclaimer",
    "form": "subscribe newsletter signup login search form contact share sharing social",
    "content": "content article articlebody post entry story body text main maincontent hentry prose",
}
_HINT = {w: k for k, words in HINTS.items() for w in words.split()}
_SIZES = (25, 80, 200)
#: Where a node stands: in an article or main element, or outside of those the page has; the same of elements named as content, where there are none; or neither.
PLACES = ("in", "beside", "in named", "beside named", "open")
#: Elements of running text: a hint on one is told from the same hint on a block.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td".split())
OTHER = frozenset("nav header footer aside form fieldset".split())
_NOTE = re.compile(r"\bcookies?\b|\bconsent\b|©|\bcopyright\b|all rights reserved|privacy policy|\bsubscribe\b|\bsign up\b|\bnewsletter\b|\blog in\b", re.I)
_COMMENTS = re.compile(r"\W*(?:\d+\W+)?(?:reader |user )?(?:comments?|replies|responses)(?:\W+\d+)?\W*", re.I)
FEATURES = ["root", *(f"tag {t}" for t in TAGS), *(f"hint {k}{w}" for k in HINTS for w in ("", " line")), *(f"{x}{y} {z}" for x in ("", "leaf ") for y in ("links", "some links") for z in PLACES), *(f"below {k}" for k in range(4)), "leaf", *(f"leaf in {t}" for t in ["body", *TAGS]), *(f"leaf {k}" for k in range(4)), *(f"{x}{z}" for x in ("at ", "leaf at ") for z in PLACES), "after comments", "leaf note", *(f"leaf note {z}" for z in PLACES)]
_AT = {f: k for k, f in enumerate(FEATURES)}
#: Kinds of elements, for the potentials of pairs.
KINDS = ("wrapper", "other", "block", "line", "text")
RIDGE, STEPS, RATE = 1e-6, 400, 0.1

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW | HIDDEN}


@dataclass
class Tree:
    """Nodes in page order (a node follows its parent; -1 is the root's): tag, hint words; text of leaves, else null; own text and link letters."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["body"])
    hints: list[str] = field(default_factory=lambda: [""])
    text: list[str | None] = field(default_factory=lambda: [None])
    size: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])

    def add(self, parent: int, tag: str, hints: str = "", text: str | None = None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.hints.append(hints)
        self.text.append(text)
        self.size.append(len(text or ""))
        self.linked.append(linked)
        return len(self.tag) - 1


class Markup:
    """The tags of a page, one after another."""

    def __init__(self, page: str):
        self.page = page
        #: From where on a quote has no partner and an element no end tag: looked for once.
        self.lost: dict[str, int] = {}

    def _past(self, what: str, at: int) -> int:
        found = self.page.find(what, at)
        return len(self.page) if found < 0 else found + len(what)

    def _end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``; a quote that is never closed opens nothing."""
        page, name_end = self.page, at
        while True:
            m = _STOP.search(page, at)
            if m is None:
                return len(page)
            at = m.end()
            if m[0] == ">":
                return at
            k = m.start() - 1
            while k >= name_end and page[k].isspace():
                k -= 1
            if k >= name_end and page[k] == "=" and m.start() < self.lost.get(m[0], len(page)):
                close = page.find(m[0], at)
                if close < 0:
                    self.lost[m[0]] = m.start()
                else:
                    at = close + 1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(begin, end, closing, name, attributes) of the next tag; comments and declarations have no name."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                return at, self._past("-->", at + 2), False, "", ""
            closing = page.startswith("</", at)
            m = _NAME.match(page, at + 1 + closing)
            if m:
                end = self._end(m.end())
                return at, end, closing, m[0].lower(), page[m.end() : end - 1]
            if closing or page[at + 1 : at + 2] in ("!", "?"):
                return at, self._past(">", at), False, "", ""
            at += 1
        return None

    def skip(self, name: str, at: int) -> int | None:
        """Behind the end tag of an element whose start tag ends at ``at``; null if there is none."""
        if at >= self.lost.get(name, len(self.page) + 1):
            return None
        m = _END[name].search(self.page, at)
        if m is None:
            self.lost[name] = at
        return m.end() if m else None


def parse(page: str) -> Tree:
    """The page's block elements and runs of text; inline elements are part of the run, unclosed ones end where HTML ends them."""
    t, tags = Tree(), Markup(page)
    stack, opened = [0], defaultdict(list)
    links, linked, pieces, at, begun = 0, 0, [], 0, False

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                t.add(stack[-1], "#text", t.tag[stack[-1]], text, min(linked, len(text)))
            pieces.clear()
            linked = 0

    def close(depth: int) -> None:
        """Ends all elements from this depth on."""
        nonlocal links
        while len(stack) > depth:
            opened[t.tag[stack.pop()]].pop()
            links = 0

    def deepest(names: Sequence[str]) -> int:
        return max((opened[n][-1] for n in names if opened[n]), default=0)

    def take(text: str) -> None:
        nonlocal linked
        if opened["head"] and not text.isspace():
            close(opened["head"][-1])
        pieces.append(text)
        linked += len(text) if links else 0

    while (m := tags.next(at)) is not None:
        begin, end, closing, name, attributes = m
        if begin > at:
            take(page[at:begin])
        at = end
        if not name or name in ("html", "body") and closing:
            continue
        if closing:
            if name == "a":
                links = max(0, links - 1)
            if name not in INLINE:
                depth = opened[name][-1] if opened[name] else 0
                if depth and (name in CELLS or name == "tr" or depth > deepest(CELLS)):
                    flush()
                    close(depth)
                elif name == "p":
                    flush()
            continue
        if name in RAW or name in HIDDEN:
            past = tags.skip(name, at)
            at = past if past is not None else (len(page) if name in RAW else at)
            if name in RAW:
                flush()
            continue
        if name in INLINE:
            if name == "a":
                links += not attributes.rstrip().endswith("/")
            elif name == "br":
                take(" ")
            continue
        flush()
        if name in ("html", "body"):
            if name == "body" and not begun:
                begun = True
                close(1)
            continue
        if opened["head"] and name not in HEAD:
            close(opened["head"][-1])
        if name in CLOSES_P:
            if opened["p"] and opened["p"][-1] > deepest(CELLS):
                close(opened["p"][-1])
        elif name in SIBLINGS:
            depth = deepest(SIBLINGS[name])
            if depth > deepest(SCOPE[name]):
                close(depth)
                # a row ends with its cells
                depth = deepest(SIBLINGS[name])
                if name == "tr" and depth > deepest(SCOPE[name]):
                    close(depth)
        if name not in VOID:
            hints = " ".join(x for a in _ATTR.findall(attributes) for x in a[1:] if x).lower() if "=" in attributes else ""
            opened[name].append(len(stack))
            stack.append(t.add(stack[-1], name, hints))
    if at < len(page):
        take(page[at:])
    flush()
    return t


def hinted(t: Tree, i: int) -> set[str]:
    return {_HINT[w] for w in re.split(r"[^a-z]+", t.hints[i]) if w in _HINT} if t.text[i] is None and t.hints[i] else set()


def active(t: Tree) -> tuple[list, list[int]]:
    """Each node's features, as positions in ``FEATURES`` (null for elements without text), and the kinds of it and its parent as one number."""
    n = len(t.tag)
    size, linked, shut = t.size[:], t.linked[:], [False] * n
    for i in range(n - 1, 0, -1):
        size[t.parent[i]] += size[i]
        linked[t.parent[i]] += linked[i]
    hints = [hinted(t, i) for i in range(n)]
    # what has another purpose holds no wrapper
    aside, inside, named, late = [False] * n, [False] * n, [False] * n, [False] * n
    ended: set[int] = set()
    kind = [2] * n
    for i in range(n):
        up = t.parent[i]
        leaf = t.text[i] is not None
        bad = t.tag[i] in OTHER or bool(hints[i] & {"advert", "menu", "comments", "comment", "footer", "side", "notice", "form"}) and t.tag[i] not in LINES
        aside[i] = bad or i > 0 and aside[up]
        own = not leaf and t.tag[i] in ("article", "main") and not aside[i]
        inside[i] = own or i > 0 and inside[up]
        named[i] = not leaf and "content" in hints[i] and not aside[i] and t.tag[i] not in LINES or i > 0 and named[up]
        kind[i] = 4 if leaf else 0 if own else 1 if bad else 3 if t.tag[i] in LINES else 2
        late[i] = i > 0 and (late[up] or up in ended)
        if leaf and size[i] < 40 and _COMMENTS.fullmatch(t.text[i]) and up > 0:
            # a heading: what follows it in the same element are comments
            ended.add(t.parent[up] if t.tag[up] in LINES or t.tag[up] in ("header", "summary") else up)
            late[i] = late[up] = True
    holds = [False] * n  # a wrapper or named element lies below
    holds_named = [False] * n
    for i in range(n - 1, 0, -1):
        holds[t.parent[i]] |= holds[i] or inside[i]
        holds_named[t.parent[i]] |= holds_named[i] or named[i]
    wrapped = any(inside[i] and t.text[i] is not None for i in range(n))
    called = any(named[i] and t.text[i] is not None for i in range(n))
    out: list = []
    for i in range(n):
        # what stands in the head is no text of the page
        shut[i] = t.tag[i] == "head" or i > 0 and shut[t.parent[i]]
        if not size[i] or shut[i]:
            out.append(None)
            continue
        at = PLACES[(0 if inside[i] else 1) if wrapped else (2 if named[i] else 3) if called else 4]
        leaf = "leaf " if t.text[i] is not None else ""
        f = [_AT["leaf"]] if leaf else []
        name = f"leaf in {t.hints[i]}" if leaf else f"tag {t.tag[i]}" if i else "root"
        if name in _AT:
            f.append(_AT[name])
        f += sorted(_AT[f"hint {k}{' line' if t.tag[i] in LINES else ''}"] for k in hints[i])
        share = linked[i] / size[i]
        if share > 0.1:
            f.append(_AT[f"{leaf}{'links' if share > 0.5 else 'some links'} {at}"])
        f.append(_AT[f"{leaf or 'below '}{sum(size[i] >= s for s in _SIZES)}"])
        if i and not (at == "beside" and holds[i] or at == "beside named" and holds_named[i]):
            f.append(_AT[f"{leaf}at {at}"])
        if late[i]:
            f.append(_AT["after comments"])
        if leaf and size[i] < 300 and _NOTE.search(t.text[i]):
            f += [_AT["leaf note"], _AT[f"leaf note {at}"]]
        out.append(f)
    return out, [len(KINDS) * kind[max(p, 0)] + k for p, k in zip(t.parent, kind, strict=True)]


@dataclass
class Model:
    weights: list[float]
    #: For each pair of kinds, the score of a parent's label (off, on) with its child's.
    ties: list[list[list[float]]]

    def marginals(self, t: Tree) -> list[float]:
        """Each node's probability of being on (0 for elements without text), by sum-product over the tree."""
        w, parent = self.weights, t.parent
        ties = [[[math.exp(x) for x in row] for row in tie] for tie in self.ties]
        features, pair = active(t)
        # log odds that a node and all that lies below it give, and what each sends to its parent
        odds = [0.0 if f is None else sum(w[k] for k in f) for f in features]
        sent = [0.0] * len(odds)
        for i in range(len(odds) - 1, 0, -1):
            if features[i] is not None:
                (e00, e01), (e10, e11) = ties[pair[i]]
                b = math.exp(max(-60.0, min(60.0, odds[i])))
                sent[i] = math.log((e10 + e11 * b) / (e00 + e01 * b))
                odds[parent[i]] += sent[i]
        # downward: with what the rest of the tree says
        for i in range(1, len(odds)):
            if features[i] is not None:
                (e00, e01), (e10, e11) = ties[pair[i]]
                c = math.exp(max(-60.0, min(60.0, odds[parent[i]] - sent[i])))
                odds[i] += math.log((e01 + e11 * c) / (e00 + e10 * c))
        return [0.0 if f is None else 1 / (1 + math.exp(-max(-60.0, min(60.0, x)))) for f, x in zip(features, odds, strict=True)]

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        t = parse(page)
        m = self.marginals(t)
        return "\n\n".join(x for x, p in zip(t.text, m, strict=True) if x is not None and p >= 0.5)


#: Ways to enclose a story.
WRAPPERS = [("", ""), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="post-content">', "</div>"), ('<div id="content"><div class="entry">', "</div></div>"), ('<section class="story-body">', "</section>"), ('<div class="article-body" itemprop="articleBody">', "</div>"), ("<div>", "</div>"), ('<div id="page"><div class="row"><div>', "</div></div></div>"), ("<table><tr><td>", "</td></tr></table>"), ("<section>", "</section>")]
NAVS = ["", "<nav>{words}</nav>", "<nav><p>{words}</p></nav>", "<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul id="navbar">{}</ul>', "<ul>{}</ul>"]
HEADS = ["", "<header><div>{}</div></header>", '<div class="masthead"><p>{}</p></div>', '<header><a href="/">{}</a></header>']
FEET = ["", "<footer>{}</footer>", '<div id="footer"><p>{}</p></div>', '<footer><p>{}</p><ul><li><a href="/">About us</a></li></ul></footer>']
#: What stands within a story and is none of it, and what stands beside one; the last where there is a wrapper of the story.
INNER = ["<aside>{}</aside>", "<form>{}</form>", "<form><label>{}</label><input></form>", '<div class="ad">{}</div>', "<aside><h3>Related</h3><p>{}</p></aside>", '<div class="sidebar"><p>{}</p><ul><li><a href="/x">More to read here</a></li></ul></div>', '<div class="cookie-notice"><p>{}</p></div>', "<form><fieldset><p>{}</p><input></fieldset></form>", '<div class="newsletter"><p>{}</p></div>', '<div class="banner">{}</div>', '<div class="alert">{}</div>', '<div class="share"><a href="/s">Share</a></div>', '<p class="advertisement">{}</p>', '<nav><a href="/t">{}</a></nav>']
COMMENTS = ['<section class="comments"><h3>Comments</h3><div class="comment"><p>{}</p></div><div class="comment"><p>{}</p></div></section>', '<div id="comments"><ul><li>{}</li></ul></div>', '<div class="comment">{}</div>', '<div class="comment"><p>{}</p></div><div class="comment"><p>{}</p></div>', '<ol class="comment-list"><li>{}</li><li><p>{}</p></li></ol>', '<div class="user-comment"><p>{}</p></div>', '<article class="comment"><p>{}</p></article>', "<section><h2>3 comments</h2><p>{}</p><p>{}</p></section>", "<div><h3>Comments (2)</h3><ul><li>{}</li><li>{}</li></ul></div>", '<ul class="replies"><li class="reply"><div>{}</div></li></ul>']
EXTRAS = [*INNER, *COMMENTS, '<p><a href="/a">{}</a></p>']
PLAIN = ["<div>{}</div>", "<div>{}</div>", "<div><p>{}</p></div>", "<p>{}</p>", '<div class="top">{}</div>', '<div class="right-col"><h3>Related</h3><p>{}</p></div>', '<div class="right-col">Related<ul><li><a href="/r">{}</a></li></ul></div>', "<section><p>{}</p></section>", '<div><a href="/b">{}</a></div>', "<h2>{}</h2>", '<div class="row"><div class="col"><p>{}</p></div></div>', "<ul><li>{}</li></ul>"]
NOTES = ["This site uses cookies to make it work better.", "We use cookies. By staying here you consent to that.", "Our site", "All rights reserved.", "Sign up for our newsletter and get the news first."]
#: Forms that text of a story has within a wrapper alone.
LINKED = ['<p><a href="/l">{}</a></p>', '<ul><li><a href="/l">{}</a></li><li><a href="/m">{}</a></li></ul>', '<p class="notice">{}</p>', '<h2 class="alert">{}</h2>', '<p class="comment">{}</p>', '<p class="related">{}</p>', '<div><a href="/l">{}</a></div>']
FORMS = ["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<h2>{}</h2>", "<p>{}</p>", "<ul><li>{}</li></ul>", "<h3>{}</h3>", "<p>{}</p>", "<blockquote><p>{}</p></blockquote>", "<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>", "<div>{}</div>", "<h4>{}</h4>", "<ol><li>{}</li></ol>", "<section><p>{}</p></section>", '<p>See <a href="/l">this</a> {}</p>', "<figure><figcaption>{}</figcaption></figure>", "<dl><dd>{}</dd></dl>"]


def labelled_pages(wrappers: Sequence[tuple[str, str]] = tuple(WRAPPERS), each: int = 60, seed: int = 1) -> Iterator[tuple[str, list[str]]]:
    """(page, texts of its story): ``each`` pages for every way to enclose a story, parts and lengths by chance."""
    r = random.Random(seed)
    lorem = "The river rises in the hills, and for most of the year it is quiet; after rain it fills the meadows, so people keep to the old road. "
    other = "Readers who liked this also looked at our shop, where many things are cheaper this week than they were, or so we have heard. "

    said = "I grew up by that river and remember how high it stood in some years, though nobody believed us when we told them about it. "

    def noise() -> str:
        return r.choice(["Some words that are not of the story.", other.strip(), other[:70], (other * 2).strip(), "Offer"])

    def remark() -> str:
        return r.choice([noise(), said.strip(), (said * 2).strip(), (said * 4).strip(), "I agree."])

    def extra(forms: Sequence[str]) -> str:
        form = r.choice(forms)
        say = remark if form in COMMENTS else noise
        return form.format(*(r.choice([*NOTES, noise()]) if form in PLAIN else say() for _ in range(2)))

    for a, z in wrappers:
        wrapper = "<article" in a or "<main" in a
        for _ in range(each):
            alike, bare = r.random() < 0.3, r.random() < 0.25
            texts, body = [], []
            if r.random() < 0.8:
                texts.append("A title of the page")
                body.append("<h1>A title of the page</h1>")
            for _ in range(r.choice([1, 2, 3, 4, 6, 9, 24])):
                text = "A short line." if r.random() < 0.3 and texts else (lorem * r.randint(1, 3)).strip()
                form = "<p>{}</p>" if alike else r.choice(LINKED) if wrapper and r.random() < 0.25 else r.choice(FORMS)
                body.append(form.format(text, text))
                texts += [f"See this {text}" if "See" in form else text] * max(1, form.count("{}"))
            if not bare and r.random() < 0.3:
                body.insert(r.randint(1, len(body)), extra(INNER))
            if not bare and r.random() < 0.15:
                body.append(extra(COMMENTS))
            if bare and r.random() < 0.3:
                body = texts = [(lorem * r.randint(1, 4)).strip()]
            links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("home", "news", "sport", "about"))
            around = [extra(PLAIN if wrapper and r.random() < 0.5 else EXTRAS) for _ in range(r.choice([0, 0, 1]) if bare else r.randint(0, 4))]
            cut = r.randint(0, len(around))
            nav, head, foot = ("", "", "") if bare else (r.choice(NAVS).format(links, words=noise()), r.choice(HEADS).format(r.choice(["Our site", noise()])), r.choice(FEET).format(r.choice(["&copy; our site", noise()])))
            yield f"<!DOCTYPE html><html><head><title>A title of the page</title><style>p{{}}</style></head><body>{nav}{head}{''.join(around[:cut])}{a}{''.join(body)}{z}{''.join(around[cut:])}{foot}</body></html>", texts


class Forest:
    """Labelled trees as arrays, by depth, for the likelihood and its gradient."""

    def __init__(self, pages: Iterator[tuple[str, list[str]]]):
        parent, depth, on, rows, kinds = [], [], [], [], []
        for page, story in pages:
            t, wanted = parse(page), set(story)
            features, pair = active(t)
            label = [x is not None and x in wanted for x in t.text]
            for i in range(len(label) - 1, 0, -1):
                label[t.parent[i]] |= label[i]
            at: dict[int, int] = {}
            for i, f in enumerate(features):
                if f is not None:
                    at[i] = len(parent)
                    parent.append(at[t.parent[i]] if i else -1)
                    depth.append(depth[parent[-1]] + 1 if i else 0)
                    on.append(label[i])
                    rows.append(f)
                    kinds.append(pair[i])
        self.pair, self.parent, self.y = np.array(kinds), np.array(parent), np.array(on, float)
        self.x = np.zeros((len(rows), len(FEATURES)))
        for i, f in enumerate(rows):
            self.x[i, f] = 1
        levels = np.array(depth)
        self.levels = [np.flatnonzero(levels == k) for k in range(1, levels.max() + 1)]
        self.child = np.flatnonzero(self.parent >= 0)

    def gradient(self, w: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood, a node: observed less expected features and label pairs (by pair of kinds)."""
        e = np.exp(ties)[self.pair]
        odds, sent = self.x @ w, np.zeros(len(self.y))
        for at in reversed(self.levels):
            b, f = np.exp(np.clip(odds[at], -60, 60)), e[at]
            sent[at] = np.log((f[:, 1, 0] + f[:, 1, 1] * b) / (f[:, 0, 0] + f[:, 0, 1] * b))
            np.add.at(odds, self.parent[at], sent[at])
        below, above = odds.copy(), np.zeros(len(odds))
        for at in self.levels:
            above[at] = odds[self.parent[at]] - sent[at]
            c, f = np.exp(np.clip(above[at], -60, 60)), e[at]
            odds[at] += np.log((f[:, 0, 1] + f[:, 1, 1] * c) / (f[:, 0, 0] + f[:, 1, 0] * c))
        p = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        b, c, f = np.exp(np.clip(below[self.child], -60, 60)), np.exp(np.clip(above[self.child], -60, 60)), e[self.child]
        joint = np.stack([f[:, 0, 0], f[:, 0, 1] * b, f[:, 1, 0] * c, f[:, 1, 1] * b * c], 1)
        joint /= joint.sum(1, keepdims=True)
        y, q = self.y[self.child], self.y[self.parent[self.child]]
        seen = np.stack([(1 - q) * (1 - y), (1 - q) * y, q * (1 - y), q * y], 1)
        out = np.zeros((len(ties), 4))
        np.add.at(out, self.pair[self.child], seen - joint)
        return self.x.T @ (self.y - p) / len(p), out.reshape(-1, 2, 2) / len(p)


@lru_cache(maxsize=2)
def train(wrappers: tuple[tuple[str, str], ...] = tuple(WRAPPERS)) -> Model:
    """All potentials together, by gradient steps with a rate of their own for each (Adam)."""
    forest = Forest(labelled_pages(wrappers))
    pairs = len(KINDS) ** 2
    theta = np.zeros(len(FEATURES) + 4 * pairs)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, STEPS + 1):
        gw, gt = forest.gradient(theta[: -4 * pairs], theta[-4 * pairs :].reshape(pairs, 2, 2))
        g = np.concatenate([gw, gt.ravel()]) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model(theta[: -4 * pairs].tolist(), theta[-4 * pairs :].reshape(pairs, 2, 2).tolist())


def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without ``html_col``, with the main text in ``out``.

    Every row gives one, repeated rows and null ids too. Null and empty pages and pages without a story give an empty text;
    a text without tags is all story. Other columns are kept, one named as ``out`` is replaced. Pages are read whole, however
    long or deep; what follows a script, style or comment that never ends is part of it.
    """
    model = model or train()
    names = [n for n in pages.columns if n not in (html_col, out)]

    @T.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(x.as_py()) for x in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(texts, pa.string())], [*names, out])

    types = dict(pages.dtypes)
    return pages.select(*names, F.col(html_col).cast("string")).mapInArrow(run, ", ".join([*(f"`{n}` {types[n]}" for n in names), f"`{out}` string"]))
