"""Main text of web pages by a linear-chain CRF over DOM leaf blocks.

One scan of the markup keeps a stack of open elements and cuts the page's text into leaf blocks: what stands between two
block-level tags. A block's features are its own tag, the roles of its ancestors (by tag, ``role``, and the tokens of
``class`` and ``id``), each by how near the ancestor is, and facts of its whole text (length, links, punctuation, a few
cue words). ``html`` and ``body`` have no role: their classes describe the page. A token counts as a whole or by its head
word (``main-nav``, ``cookie-notice``, ``ad-box``), not where it says what is absent (``no-sidebar``, ``has-comments``). The
chain runs over the blocks in page order; it is trained on labelled pages made by rule in several layouts, and decoded by
Viterbi for many pages at once. Scripts, styles and other elements without text of their own never make blocks.

The scan is linear in the page: an element carries the roles of its three nearest ancestors with any and of all
together, open elements are found by tag, and comments, raw text and tags by forward search.

Defined cases: null html gives an empty text, as do pages without a block of the article. Null ids and repeated rows are
carried row by row. Extra columns are ignored. Unclosed and stray tags are taken as browsers take the common cases:
paragraphs, list items and cells end where the next begins, an end tag closes what is open inside it, one without its
start is nothing.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, crf

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ROUGH = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style|data-ad[\w-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp".split())
SILENT = frozenset("head script style title textarea noscript template svg math iframe object canvas audio video select datalist button xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img br picture".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPE = frozenset("ul ol dl table".split())
# Roles by tag, and by the tokens of class, id, role and itemprop: whole, or by their last word that is not only a
# container's.
ROLES = {
    "article": ("article", "articlebody", "post", "entry", "story", "hentry"), "main": ("main", "content", "body", "text"), "nav": ("nav", "navigation", "navbar", "menu", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "skip"),
    "header": ("header", "masthead", "banner", "topbar", "logo"), "footer": ("footer", "copyright", "colophon", "contentinfo"), "aside": ("aside", "sidebar", "rail", "complementary", "widget", "related", "recommended", "trending", "popular"),
    "form": ("form", "search", "login", "signup", "subscribe", "newsletter", "subscription"), "comment": ("comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "discussion", "feedback", "responses", "remark", "remarks", "reactions", "guestbook"),
    "ad": ("ad", "ads", "adv", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "adsense"), "notice": ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "paywall", "toast"),
    "share": ("share", "social", "sharing", "follow", "tags", "tools"), "hidden": ("hidden",),
    "list": (), "table": (), "figure": (), "link": (), "quote": (),
}
BIT = {r: 1 << i for i, r in enumerate(ROLES)}
BY_WORD: dict[str, int] = {}
for _role, _words in ROLES.items():
    for _word in _words:
        BY_WORD.setdefault(_word, BIT[_role])
BY_TAG = {"article": "article", "main": "main", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "dialog": "notice", "ul": "list", "ol": "list", "dl": "list", "table": "table", "figure": "figure", "blockquote": "quote"}
GOOD = BIT["article"] | BIT["main"]
BAD = sum(BIT[r] for r in ("nav", "header", "footer", "aside", "form", "comment", "ad", "notice", "share", "hidden"))
CONTAINERS = frozenset("area articles bar block body box bottom buttons cell column container content entries frame group holder icons id inner item items left link links list menu news number outer pane panel posts right row section slot space stories text this thread title top unit us widget wrap wrapper zone".split())
ABSENT = frozenset("no not non without has have with is hide hides show shows toggle js enable enabled disable disabled free less".split())
ROOTS = frozenset(("html", "body"))
CUES = (("©", "copyright", "all rights reserved"), ("cookie", "consent", "privacy"), ("comment", "reply", "replies"), ("subscribe", "newsletter", "sign up", "log in"), ("advert", "sponsored"), ("share", "follow us"), ("read more", "related"))
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
SIZE = 8192


class Block:
    """A text with its block's tag, the roles of all ancestors together, of the three nearest that have any (the block's
    own first, where it has some), and the share of its characters in links."""

    __slots__ = ("linked", "near", "roles", "tag", "text")

    def __init__(self, text: str, tag: str, roles: int, near: tuple[int, int, int], linked: float):
        self.text, self.tag, self.roles, self.near, self.linked = text, tag, roles, near, linked


def token_roles(token: str) -> int:
    """The role of a token of ``class``, ``id``, ``role`` or ``itemprop``."""
    if found := BY_WORD.get(token.lower(), 0):
        return found
    words = [w.lower() for w in WORD.findall(token)]
    if any(w in ABSENT for w in words):
        return 0
    last = len(words) - 1
    while last > 0 and (words[last] in CONTAINERS or words[last].isdigit()):
        last -= 1
    return next((BY_WORD[w] for w in words[max(last, 0) :] if w in BY_WORD), 0)


def _roles(tag: str, attributes: str, known: dict) -> int:
    if tag in ROOTS:
        return 0
    if not attributes.strip():
        return BIT.get(BY_TAG.get(tag, ""), 0)
    key = (tag, attributes)
    if key in known:
        return known[key]
    bits = BIT.get(BY_TAG.get(tag, ""), 0)
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            bits |= BIT["hidden"]
        elif name.startswith("data-ad"):
            bits |= BIT["ad"] * (name in ("data-ad", "data-ads") or name.startswith(("data-ad-", "data-adv")))
        elif name in ("class", "id", "role", "itemprop"):
            for token in value.split():
                bits |= token_roles(token)
    if len(known) > 20_000:
        known.clear()
    known[key] = bits
    return bits


NOWHERE = ("", 0, (0, 0, 0), 0)


def blocks(page: str, known: dict | None = None) -> list[Block]:
    """Leaf blocks in page order, white space joined, character references decoded; blocks without text are left out."""
    known = {} if known is None else known
    out: list[Block] = []
    stack = [NOWHERE]  # tag, roles of all open elements, of the three nearest that have any, place of the nearest block
    where: defaultdict[str, list[int]] = defaultdict(list)  # places of the open elements of a tag
    parts: list[str] = []
    linked = silent = at = 0
    shared = -1  # roles that all text of the block has, by inline elements too
    n = len(page)

    def flush() -> None:
        nonlocal linked, shared
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                tag, roles, near, _ = stack[stack[-1][3]]
                if inner := shared & ~roles & ~BIT["link"]:
                    roles, near = roles | inner, (inner, *near[:2])
                out.append(Block(text, tag, roles, near, min(1.0, linked / len(text))))
            parts.clear()
        linked, shared = 0, -1

    def say(raw: str) -> None:
        nonlocal linked, shared
        if raw and not silent:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if not text.isspace():
                shared &= stack[-1][1]
            if where["a"]:
                linked += len(text.strip())

    def close(depth: int) -> None:
        """Close everything from ``depth`` of the stack on."""
        nonlocal silent
        if stack[-1][3] >= depth:
            flush()
        for tag, *_ in stack[depth:]:
            where[tag].pop()
            silent -= tag in SILENT
        del stack[depth:]

    def find(names: tuple[str, ...], stop: frozenset) -> int:
        """The outermost of the open elements of these names that stand inside the nearest of ``stop``."""
        edge = max((where[x][-1] for x in stop if x not in names and where[x]), default=0)
        return min((where[x][i] for x in names if (i := bisect_right(where[x], edge)) < len(where[x])), default=0)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        say(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = end + 1 if end >= 0 else n
            continue
        begins = start + 1 < n and (page[start + 1].isalpha() or page[start + 1] == "/")
        if begins and page.find(">", start) < 0:
            break  # a tag that the page's end cuts off
        m = (TAG.match(page, start) or ROUGH.match(page, start)) if begins else None
        if not m:
            say("<")
            at = start + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not where["p"]:
                flush()
            elif where[tag]:
                close(where[tag][-1])
            continue
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag in ("svg", "math") and m[3].endswith("/"):
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        inline = tag in INLINE
        if not inline:
            flush()
            if where["p"] and (depth := find(("p",), SCOPE)):
                close(depth)
            if tag in ENDS and any(where[x] for x in ENDS[tag]) and (depth := find(ENDS[tag], SCOPE)):
                close(depth)
            if tag == "body" and where["head"]:
                close(where["head"][0])
        own = _roles(tag, m[3], known)
        if tag == "a":
            own |= BIT["link"]
        _, roles, near, block = stack[-1]
        if roles & GOOD:  # a header inside an article heads the article, not the site
            own &= ~BIT["header"]
        if tag in ("article", "main"):  # its classes say what it is about
            own &= ~BAD | BIT["comment"] | BIT["hidden"]
        if m[3].endswith("/") and inline:
            continue
        where[tag].append(len(stack))
        stack.append((tag, roles | own, (own, *near[:2]) if own else near, block if inline else len(stack)))
        silent += tag in SILENT
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = end.start() if end else n
    flush()
    return out


class Features:
    """Feature ids of blocks; remembered for sets of roles and tags."""

    def __init__(self):
        self.of_place: dict = {}

    @staticmethod
    def _id(name: str) -> int:
        return zlib.crc32(name.encode()) % (SIZE - 1) + 1

    def place(self, tag: str, roles: int, near: tuple[int, int, int]) -> list[int]:
        key = (tag, roles, near)
        if key not in self.of_place:
            if len(self.of_place) > 20_000:
                self.of_place.clear()
            good, bad = bool(roles & GOOD), bool(roles & BAD)
            decisive = next((x & (GOOD | BAD) for x in near if x & (GOOD | BAD)), 0)
            word = "bad" if decisive & BAD else "good" if decisive else "none"
            names = [f"tag {tag}", f"tag {tag} {word}", f"good {good} bad {bad}", f"near {word}", f"good {good} bad {bad} near {word} list {bool(roles & BIT['list'])}"]
            names += [f"in {r}" for r, b in BIT.items() if roles & b]
            names += [f"at {k} {r}" for k, x in enumerate(near) for r, b in BIT.items() if x & b]
            self.of_place[key] = [self._id(x) for x in names]
        return self.of_place[key]

    def page(self, found: list[Block]) -> list[list[int]]:
        any_good = any(b.roles & GOOD and not b.roles & BAD for b in found)
        rows = []
        for i, b in enumerate(found):
            text, low = b.text, b.text.lower()
            placed = bool(b.roles & GOOD) + 2 * bool(b.roles & BAD) if any_good else 4 + 2 * bool(b.roles & BAD)
            ids = self.place(b.tag, b.roles, b.near) + [
                self._id(f"page {any_good} place {placed}"), self._id(f"length {min(len(text).bit_length(), 9)} place {placed}"), self._id(f"links {round(b.linked * 3)} place {placed}"),
                self._id(f"end {text[-1] in '.!?:;…'} place {placed}"), self._id(f"where {min(3, 4 * i // len(found))} place {placed}"),
            ]
            rows.append(ids + [self._id(f"cue {k} long {len(text) >= 400} place {placed}") for k, cues in enumerate(CUES) if any(c in low for c in cues)])
        return rows


def matrix(rows: list[list[int]]) -> np.ndarray:
    """Feature ids as rows as wide as the longest, filled with 0, whose weight is none."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    out = np.zeros((len(rows), int(lengths.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.fromiter((x for row in rows for x in row), np.int32, int(lengths.sum()))
    return out


# --- labelled pages

def labelled(pages: int = 240, seed: int = 3) -> list[tuple[str, list[str]]]:
    """Pages made by rule, each with the texts of its article's blocks."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    chance = lambda p: rng.random() < p
    serial = 0

    def words(least: int, most: int) -> str:
        nonlocal serial
        serial += 1
        made = ["".join(pick(*"aeiou") if k % 2 else pick(*"bcdfghklmnprst") for k in range(int(rng.integers(2, 9)))) for _ in range(int(rng.integers(least, most + 1)))]
        made[0] = f"{made[0]}{serial}" if chance(0.3) else made[0] + pick(*"qxz") + "".join(pick(*"abcdefgh") for _ in range(4))
        text = " ".join(made)
        return (text[0].upper() + text[1:] if chance(0.8) else text) + pick(".", ".", ".", "", "!", "?")

    # Classes that say nothing of a block's part, as sites have them everywhere.
    plain = lambda: pick("", "", f' class="{pick("col-8", "inner", "row", "box", "u-mt", "wp-block", "lead", "clearfix", words(1, 1).strip(".!?").lower())}"', f' id="{pick("top", "c1", "x")}{int(rng.integers(99))}"')
    rows = []
    for _ in range(pages):
        truth: list[str] = []

        def main(least: int, most: int, truth=truth) -> str:
            truth.append(words(least, most))
            return truth[-1]

        link = lambda: f'<a href="/{words(1, 1)}">{words(1, 3)}</a>'
        links = lambda n: "".join(f"<li>{link()}</li>" for _ in range(n))

        def boiler(kind: str) -> str:
            if kind == "nav":
                return pick(f"<nav><ul>{links(6)}</ul></nav>", f'<div class="{pick("menu", "main-nav", "navbar")}"><ul>{links(5)}</ul></div>', f'<ul id="nav">{links(4)}</ul>', f'<nav class="breadcrumbs">{link()} &gt; {link()}</nav>', f'<a class="{pick("skip-link", "skip")}" href="#m">{words(1, 3)}</a>', f'<div role="navigation"><a href="/">{words(1, 2)}</a> {link()}</div>', f'<div class="top-menu"><div{plain()}>{link()}</div><div>{link()}</div></div>')
            if kind == "header":
                return pick(f"<header><h1>{words(1, 3)}</h1><p>{words(3, 8)}</p></header>", f'<div id="header"><a href="/">{words(1, 2)}</a></div>', f'<header class="masthead"><div class="logo">{words(1, 2)}</div></header>', f'<div class="site-header"><p>{words(2, 9)}</p><div{plain()}>{words(1, 4)}</div></div>', f'<div role="banner"><h2>{words(1, 3)}</h2></div>')
            if kind == "footer":
                return pick(f"<footer>&copy; {words(1, 2)} &middot; {words(4, 9)}</footer>", f'<div id="footer"><p>{words(3, 9)}</p><p>Copyright {words(1, 2)}</p></div>', f"<footer><ul>{links(3)}</ul><p>{words(5, 20)}</p></footer>", f'<div class="page-footer"><div{plain()}><p>{words(4, 30)}</p></div></div>', f'<div role="contentinfo"><p>{words(4, 12)}</p></div>')
            if kind == "ad":
                return pick(f'<div class="ad">{words(2, 12)}</div>', f'<div class="{pick("ads", "advert", "sponsored", "ad-slot", "promo")}"><p>{words(4, 20)}</p></div>', f'<div id="ad-{int(rng.integers(9))}"><a href="/x">{words(2, 6)}</a></div>', f'<aside class="advertisement"><p>{words(4, 25)}</p></aside>', f'<div class="{pick("adv-box", "ad-wrapper", "promo-unit", "sponsored-content")}"><div{plain()}><p>{words(4, 25)}</p></div></div>', f'<div data-ad="{int(rng.integers(9))}"><p>{words(4, 20)}</p></div>')
            if kind == "aside":
                return pick(f"<aside><h3>{words(1, 3)}</h3><ul>{links(4)}</ul></aside>", f'<div class="sidebar"><h2>{words(1, 3)}</h2><p>{words(5, 30)}</p></div>', f'<div class="related"><h3>Related</h3><ul>{links(4)}</ul></div>', f"<aside><p>{words(10, 40)}</p></aside>", f'<div class="{pick("left-sidebar", "sidebar-inner", "related-posts", "popular-stories", "widget-area")}"><div{plain()}><h4>{words(1, 3)}</h4><p>{words(4, 30)}</p></div></div>')
            if kind == "form":
                return pick(f'<form><label>{words(1, 3)}</label><input name="q"><button>Go</button></form>', f'<form class="newsletter"><p>{words(4, 15)}</p><input type="email"></form>', f'<form action="/s"><p>{words(2, 9)}</p><select><option>{words(1, 1)}</option></select><textarea>{words(2, 4)}</textarea></form>')
            if kind == "notice":
                return pick(f'<div class="cookie-notice"><p>{words(5, 25)}</p></div>', f'<div id="consent">{words(5, 20)}</div>', f'<div class="{pick("notice", "alert", "popup", "modal")}" role="dialog"><p>{words(4, 20)}</p></div>', f'<p class="notice">{words(4, 20)}</p>')
            if kind == "share":
                return f'<div class="{pick("share", "social-links")}"><ul>{links(3)}</ul></div>'
            many = "".join(pick(f'<div class="comment"><p>{words(3, 40)}</p></div>', f'<li class="comment"><b>{words(1, 2)}</b><p>{words(3, 40)}</p></li>', f"<li><p>{words(3, 40)}</p></li>", f"<article class='comment'><p>{words(5, 30)}</p></article>", f"<div{plain()}><div{plain()}><p>{words(3, 40)}</p></div></div>") for _ in range(int(rng.integers(1, 5))))
            return pick(f'<section class="comments"><h2>{words(1, 3)}</h2>{many}</section>', f'<div id="comments"><h3>{words(1, 2)}</h3><ol>{many}</ol></div>', f'<ol class="commentlist">{many}</ol>', f'<section id="disqus_thread">{many}</section>', f'<div class="{pick("user-remarks", "reader-comments", "comment-list", "discussion")}">{many}</div>')

        def paragraph() -> str:
            kind = rng.random()
            if kind < 0.5:
                return f"<p{plain()}>{main(*pick((1, 1), (1, 3), (4, 20), (10, 60), (20, 90)))}" + pick("</p>", "</p>", "</p>", "")
            if kind < 0.58:
                return f"<p><b>{main(2, 30)}<br>"
            if kind < 0.66:
                return f"<h{(k := int(rng.integers(2, 5)))}>{main(1, 7)}</h{k}>"
            if kind < 0.76:
                return f"<{(k := pick('ul', 'ol'))}>" + "".join(f"<li>{main(1, 12)}" + pick("</li>", "") for _ in range(int(rng.integers(1, 5)))) + f"</{k}>"
            if kind < 0.83:
                return f"<blockquote><p>{main(4, 40)}</p></blockquote>"
            if kind < 0.9:
                return f"<table><tr><td>{main(1, 3)}</td><td>{main(1, 3)}</td></tr></table>"
            if kind < 0.95:
                return f"<figure><img src='a.png'><figcaption>{main(2, 14)}</figcaption></figure>"
            return f"<div{plain()}>{main(3, 40)}</div>" if chance(0.6) else f"<pre>{main(3, 20)}</pre>"

        head = pick("", f"<title>{words(2, 8)}</title>", f'<meta charset="utf-8"><title>{words(2, 8)}</title><link rel="stylesheet" href="/s.css">', f"<title>{words(1, 4)}</title><style>.a > .b {{ color: red }}</style><script>if (a < b) document.write('<p>' + {words(1, 1)!r})</script>")
        body = pick("", "", ' class="home has-sidebar"', ' class="single no-comments ad-free"', ' id="page" class="article-page theme-light"')
        out = [pick("<!DOCTYPE html>", ""), pick("<html>", '<html lang="en">', ""), f"<head>{head}</head>", f"<body{body}>"]
        for kind in ("notice", "header", "nav", "ad", "aside"):
            if chance(0.5):
                out.append(boiler(kind))
        wrap = pick("article", "article", "article class", "main", "main article", "deep", "div post", "div content", "div id", "section", "div", "nothing")
        out.append({"article": f"<article{plain()}>", "article class": f'<article class="{pick("ad-review", "notice-board", "post hentry", "comment-policy", "menu-guide")}">', "deep": f'<div{plain()}><div class="{pick("site-content", "main-column", "entry-content")}"><div{plain()}>', "main": "<main>", "main article": "<main><article>", "div post": '<div class="post">', "div content": '<div class="content">', "div id": '<div id="article-body">', "div": '<div class="wrap">', "nothing": "", "section": '<section itemprop="articleBody">'}[wrap])
        out.append(f"<h1>{main(1, 9)}</h1>" if chance(0.7) else pick(f"<header><h1>{main(1, 9)}</h1></header>", f'<div class="{pick("post-header", "entry-header", "article-head")}"><h1>{truth[-1]}</h1></div>') if "article" in wrap and chance(0.7) else "")
        for _ in range(int(rng.integers(1, 12))):
            out.append(paragraph())
            if chance(0.14):
                out.append(boiler(pick("ad", "aside", "form", "notice", "share", "nav")))
        if chance(0.2):
            out.append(boiler(pick("share", "comment")))
        out.append({"article": "</article>", "article class": "</article>", "deep": "</div></div></div>", "main": "</main>", "main article": "</article></main>", "section": "</section>", "nothing": ""}.get(wrap, "</div>"))
        for kind in ("share", "comment", "aside", "ad", "form", "nav", "footer"):
            if chance(0.45):
                out.append(boiler(kind))
        rows.append(("".join(out) + ("</body></html>" if chance(0.9) else ""), truth))
    return rows


def train(pages: int = 240) -> crf.Crf:
    features, ids, lengths, labels = Features(), [], [], []
    for page, truth in labelled(pages):
        found = blocks(page)
        wanted = {" ".join(t.split()) for t in truth}
        ids += features.page(found)
        lengths.append(len(found))
        labels += [int(b.text in wanted) for b in found]
    model = crf.train(matrix(ids), np.array(lengths), np.array(labels), SIZE, 2, rounds=150, decay=0.005)
    model.weights[0] = 0  # the filling of short rows says nothing
    model.weights = model.weights.astype(np.float32)
    return model


def main_texts(model: crf.Crf, pages: list[str], features: Features, known: dict) -> list[str]:
    found = [blocks(p, known) for p in pages]
    lengths = np.array([len(x) for x in found], np.int64)
    if not lengths.sum():
        return [""] * len(pages)
    labels = model.viterbi(model.emissions(matrix([row for x in found for row in features.page(x)])), lengths)
    at, out = 0, []
    for own in found:
        out.append("\n\n".join(b.text for b, k in zip(own, labels[at : at + len(own)], strict=True) if k))
        at += len(own)
    return out


def _extracting(model: crf.Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, known = Features(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = main_texts(model, [x or "" for x in part.column(2).to_pylist()], features, known)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, model: crf.Crf | None = None) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.transform(common.in_arrow, _extracting(model or train()), "page_id long, url string, text string, n_chars long")
