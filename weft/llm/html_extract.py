"""Operator 2: main-text extraction with a tree-structured graphical model.

A page's block elements form a tree; each is structure (holds several kinds),
content or boilerplate. A log-linear model of the element's look (tag, names
in class, id and role, amount of text, share of link text, what header, footer or layout
table it stands in, whether that is inside an article, first or last place in the body)
gives its potential, and a table of parent-child potentials connects it to its parent. Sum-product
message passing, once up and once down the tree, gives exact marginals; text
whose block is content with a marginal over one half is kept. Both parts are
trained from labelled pages: a generator writes pages of many layouts with the
label of every block, because no labelled pages are given (``labelled_pages``,
a fixed seed and number).

Scripts, styles, forms, comments, the head and hidden elements are never text; a
form around an <article> or <main> counts as a plain element (whole pages stand in
one form on some sites). Scripts and the like end at their own end tag only, and a
"<" with a name is text where an end tag (or, if no element has that name, any tag)
begins before its ">".
Inline elements and <br> do not end a block. Character references are decoded,
white space within a block becomes one space, and blocks join by one newline.

Defined edge cases: null or empty html gives an empty text; tags that never close
end with their parent or where HTML closes them; a page without tags is one
block of text, kept; a marginal of exactly one half is not kept; repeated rows each
get a result; a very long page is one row of a batch of its own, read whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

STRUCTURE, CONTENT, BOILER = 0, 1, 2
N_PAGES, SEED = 600, 11

# Element names by what HTML makes of them.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("head script style form template noscript select textarea title button svg annotation annotation-xml object canvas audio video iframe option datalist dialog".split())
ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
KNOWN = INLINE | VOID | RAW | SILENT | ENDS_P | frozenset("html body li dt dd tr td th thead tbody tfoot caption colgroup legend label output summary slot picture search meter progress".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
# Words in class, id and role by what they announce.
NAMES = {
    "main": "article content post entry story main text body prose markdown",
    "ad": "ad ads adv advert adverts advertisement banner promo promotion promoted sponsor sponsored adsense",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs pagination pager skip topbar",
    "head": "header head masthead hero logo sitename top branding",
    "foot": "footer foot bottom copyright legal colophon contentinfo",
    "side": "sidebar side aside rail widget right left complementary",
    "note": "cookie cookies consent notice alert gdpr popup modal overlay warning announcement toast privacy banner",
    "talk": "comment comments commentlist reply replies respond discussion disqus thread reviews",
    "share": "share sharing social related recommended newsletter subscribe signup follow tags trending popular more login search author meta",
}
GROUP = {w: g for g, ws in NAMES.items() for w in ws.split()}

FRAMES = frozenset("header footer aside nav".split())
HOLDS = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol article section blockquote pre".split())
LEGAL = re.compile(r"©|&copy;|&#169;|\bcopyright\b|all rights reserved", re.I)

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>|<[!?][^>]*+>""", re.S)
ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
NAME = re.compile(r"[a-z]+")
QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
ARTICLE = re.compile(r"<(?:article|main)\b|</form\b", re.I)
END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I) for tag in RAW}


class Page:
    """The block tree of one page: nodes in page order, parents first."""

    def __init__(self, html: str):
        self.tag, self.parent, self.attrs = ["html"], [-1], [""]
        self.words, self.linked = [0], [0]
        self.pieces: list[tuple[int, list[str]]] = []  # a block's node and its texts
        self._fresh, self._links, self._silent = True, 0, 0
        self._count: Counter[str] = Counter()  # open elements by name
        self._article = (-1, False)  # where the next sign of an article or a form's end is, and whether it is the former
        self._stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # open element, its block, whether it hides
        self._read(html)

    def _text(self, text: str) -> None:
        if self._silent or not text:
            return
        node = self._stack[-1][1]
        n = len(text.split())
        if not n and self._fresh:
            return
        self.words[node] += n
        self.linked[node] += n if self._links > 0 else 0
        if self._fresh or self.pieces[-1][0] != node:
            self.pieces.append((node, []))
            self._fresh = False
        self.pieces[-1][1].append(text)

    def _pop(self, k: int) -> None:
        for tag, _, hides in self._stack[k:]:
            self._count[tag] -= 1
            self._silent -= hides
            self._links -= tag == "a"
        del self._stack[k:]

    def _open(self, tag: str, attrs: str) -> None:
        stack = self._stack
        close = ({"p"}, {"table", "button"}) if tag in ENDS_P else CLOSES.get(tag)
        if close and any(self._count[t] for t in close[0]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in close[1]:
                    break
                if stack[k][0] in close[0]:
                    self._pop(k)
                    break
        inline = tag in INLINE
        self._fresh |= not inline
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            return
        hides = tag in SILENT or bool(attrs) and HIDDEN.search(attrs) is not None
        block = stack[-1][1]
        if not (inline or hides or self._silent):
            self.parent.append(block)
            block = len(self.tag)
            self.tag.append(tag)
            self.attrs.append(attrs)
            self.words.append(0)
            self.linked.append(0)
        self._silent += hides
        self._links += tag == "a"
        self._count[tag] += 1
        stack.append((tag, block, hides))

    def _close(self, tag: str) -> None:
        stack = self._stack
        if not self._count[tag]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                break
            if tag in INLINE and stack[k][0] not in INLINE:
                return  # an inline element does not close around blocks that are open in it
        self._pop(k)
        self._fresh |= tag not in INLINE

    def _holds_article(self, html: str, at: int) -> bool:
        """Whether an article begins after ``at`` before any form ends."""
        if self._article[0] < at:
            found = ARTICLE.search(html, at)
            self._article = (found.start(), found.group()[1] != "/") if found else (len(html), False)
        return self._article[1]

    def _read(self, html: str) -> None:
        at, end_of_tags = 0, html.rfind(">") + 1  # behind the last ">" no tag ends, only a comment may begin
        while m := TOKEN.search(html, at, end_of_tags):
            self._text(html[at : m.start()])
            at = m.end()
            tag = (m.group(2) or "").lower()
            if tag and "<" in m.group(3) and ("</" if tag in KNOWN else "<") in QUOTED.sub("", m.group(3)):
                at = m.start() + 1  # a sign of comparison, as in "x<y": the next tag begins before a ">"
                self._text("<")
            elif tag == "form" and not m.group(1) and self._holds_article(html, at):
                self._open("div", "")  # a form around the page's article is no form of its own
                self._stack[-1] = ("form", *self._stack[-1][1:])
                self._count.subtract(["div"])
                self._count["form"] += 1
            elif m.group(1):
                self._close(tag)
            elif tag in RAW:  # nothing but its own end tag ends it
                end = END[tag].search(html, at)
                at = end.end() if end else len(html)
            elif tag:
                self._open(tag, m.group(3))
        self._text(html[at:].partition("<!--")[0])


def places(page: Page) -> list[list[str]]:
    """Names of where each block stands: in which header, footer or the like, inside or outside an
    article, in which part of a layout table, first or last in the body."""
    n = len(page.tag)
    last, layout = [0] * n, [False] * n  # last child; tables that hold blocks
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        last[p] = last[p] or i
        layout[p] |= layout[i] and page.tag[p] != "table" or page.tag[i] in HOLDS or page.tag[i] == "table"
    out: list[list[str]] = [[]]
    inside, frame, laid = [False] * n, [""] * n, [False] * n
    for i in range(1, n):
        p, tag, got = page.parent[i], page.tag[i], []
        inside[i] = inside[p] or tag in ("article", "main")
        frame[i], laid[i] = frame[p], tag in ("tr", "td", "th", "tbody") and laid[p]
        if frame[p]:
            got.append("under=" + frame[p])
        if tag in FRAMES:
            frame[i] = f"{tag}@{'in' if inside[p] else 'out'}"
            got.append("frame=" + frame[i])
        if tag == "table" and layout[i]:
            laid[i] = True
        if laid[i]:
            got.append(f"laid={tag}")
            row = i if tag == "tr" else p
            if page.tag[row] == "tr":
                got.append(f"{tag} of the last row" if last[page.parent[row]] == row else f"{tag} of a row")
        if page.tag[p] == "body" and (last[p] == i or i == p + 1):
            got.append("body=last" if last[p] == i else "body=first")
        out.append(got)
    return out


def traits(page: Page) -> list[list[str]]:
    """Names of what each block looks like."""
    out = []
    legal = {node for node, texts in page.pieces if page.words[node] < 40 and LEGAL.search("".join(texts))}
    story = [False] * len(page.tag)  # inside what calls itself an article, by tag or name
    for i, (tag, attrs, n, linked, where) in enumerate(zip(page.tag, page.attrs, page.words, page.linked, places(page), strict=True)):
        got = ["tag=" + tag, "any", *where]
        story[i] = tag in ("article", "main") or i > 0 and story[page.parent[i]]
        if attrs:
            names = {GROUP[w] for _, v in ATTR.findall(attrs) for w in NAME.findall(v.lower()) if w in GROUP}
            got += ["is=" + g for g in names]
            if "main" in names and len(names) > 1:
                got.append("mixed")
            story[i] |= names == {"main"}
        got.append("words=" + ("0" if not n else "1" if n < 5 else "5" if n < 15 else "15" if n < 40 else "40"))
        if n:
            share = linked / n
            got.append("links=" + ("none" if not share else "some" if share < 0.4 else "most"))
        if i in legal:
            got.append("legal@" + ("story" if story[i] else "page"))
        out.append(got)
    return out


class Model:
    """Potentials of looks and of parent-child pairs, over three states."""

    def __init__(self, weights: dict[str, tuple[float, float, float]], pair: list[list[float]]):
        self.weights, self.pair = weights, pair

    def content(self, page: Page) -> list[float]:
        """Each block's marginal probability of being content, by sum-product."""
        zero, pair, parent = (0.0, 0.0, 0.0), self.pair, page.parent
        own = []
        for names in traits(page):
            a = b = c = 0.0
            for name in names:
                x, y, z = self.weights.get(name, zero)
                a, b, c = a + x, b + y, c + z
            top = max(a, b, c)
            own.append(_exp3(a - top, b - top, c - top))
        n = len(own)
        up: list = [None] * n  # messages to the parents
        inside = [list(o) for o in own]
        for i in range(n - 1, 0, -1):
            x, y, z = inside[i]
            m = [r[0] * x + r[1] * y + r[2] * z for r in pair]
            t = m[0] + m[1] + m[2]
            up[i] = m = [m[0] / t, m[1] / t, m[2] / t]
            q = inside[parent[i]]
            q[0] *= m[0]
            q[1] *= m[1]
            q[2] *= m[2]
            t = q[0] + q[1] + q[2]
            q[0], q[1], q[2] = q[0] / t, q[1] / t, q[2] / t
        belief: list = [None] * n
        out = [0.0] * n
        for i in range(n):
            x, y, z = inside[i]
            if i:
                p, m = belief[parent[i]], up[i]
                a, b, c = p[0] / m[0], p[1] / m[1], p[2] / m[2]  # the parent without this child
                x *= a * pair[0][0] + b * pair[1][0] + c * pair[2][0]
                y *= a * pair[0][1] + b * pair[1][1] + c * pair[2][1]
                z *= a * pair[0][2] + b * pair[1][2] + c * pair[2][2]
            t = x + y + z
            belief[i] = (x / t, y / t, z / t)
            out[i] = y / t
        return out


def _exp3(a: float, b: float, c: float) -> tuple[float, float, float]:
    return max(math.exp(a), 1e-12), max(math.exp(b), 1e-12), max(math.exp(c), 1e-12)


def extract(html: str | None, model: Model) -> str:
    if not html:
        return ""
    page = Page(html)
    if len(page.tag) == 1:
        keep = [1.0]
    else:
        keep = model.content(page)
    lines = (" ".join(entities.unescape("".join(texts)).split()) for node, texts in page.pieces if keep[node] > 0.5)
    return "\n".join(x for x in lines if x)


def labelled_pages(n: int = N_PAGES, seed: int = SEED):
    """(html, states) pairs; states are those of the page's blocks in order, the root first."""
    return [_Writer(random.Random(seed * 1_000_003 + i)).page() for i in range(n)]


class _Writer:
    """Writes one page of a random layout and notes the state of each block."""

    def __init__(self, rng: random.Random):
        self.r, self.states, self.out = rng, [STRUCTURE], []

    def text(self, lo: int, hi: int, links: float = 0.0) -> str:
        words = ["".join(self.r.choice("aeioulnrst") for _ in range(self.r.randint(2, 8))) for _ in range(self.r.randint(lo, hi))]
        return " ".join(f'<a href="/{w}">{w}</a>' if self.r.random() < links else w for w in words)

    def block(self, opening: str, state: int, inner) -> None:
        """``inner``: text, or a call that writes what is inside."""
        self.states.append(state)
        self.out.append(f"<{opening}>")
        if callable(inner):
            inner()
        else:
            self.out.append(inner)
        self.out.append(f"</{opening.split()[0]}>")

    def pick(self, *options):
        return self.r.choice(options)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def menu(self, state=BOILER):
        self.block(self.pick("ul", "ul", 'ul class="menu"', "ol"), state, lambda: [self.block("li", state, self.text(1, 2, 1.0)) for _ in range(self.r.randint(2, 8))])

    def nav(self):
        self.block(self.pick("nav", 'nav class="main-nav"', 'div class="menu"', 'div id="nav"', 'div class="breadcrumbs"', 'div role="navigation"'), BOILER, self.menu if self.chance(0.7) else self.text(3, 9, 1.0))

    def header(self):
        def inside():
            if self.chance(0.7):
                self.block(self.pick("h1", "p", "div", 'div class="logo"'), BOILER, self.text(1, 5, 0.3))
            if self.chance(0.5):
                self.block(self.pick("p", 'p class="tagline"', "div"), BOILER, self.text(3, 14))
            if self.chance(0.5):
                self.nav()

        self.block(self.pick("header", "header", "header", 'div class="header"', 'div id="masthead"', 'header class="site-header"', 'div class="topbar"'), BOILER, inside if self.chance(0.8) else self.text(2, 12, 0.2))

    def plain(self, opening: str, lo: int, hi: int, links: float = 0.05):
        """A boilerplate box of text, or of paragraphs."""
        if self.chance(0.5):
            self.block(opening, BOILER, self.text(lo, hi, links))
        else:
            self.block(opening, BOILER, lambda: [self.block(self.pick("p", "p", "div", "h3", "span2"), BOILER, self.text(lo, hi, links)) for _ in range(self.r.randint(1, 3))])

    def ad(self):
        self.plain(self.pick('div class="ad"', 'div class="advert"', 'div class="ads banner"', 'aside class="sponsored"', 'div id="promo"', 'section class="promotion"', 'div class="ad-slot"', 'div class="advertisement"'), 3, 45)

    def notice(self):
        self.plain(self.pick('div class="cookie-notice"', 'div class="notice"', 'div id="consent"', 'section class="alert"', 'div class="cookie-banner"', 'div class="gdpr"', 'aside class="notice"'), 5, 50)

    def share(self):
        self.plain(self.pick('div class="share"', 'div class="related"', 'div class="social"', 'section class="newsletter"', 'ul class="tags"', 'div class="related-posts"'), 2, 20, self.pick2(0.2, 1.0))

    def pick2(self, *options):
        return self.r.choice(options)

    def sidebar(self):
        def inside():
            for _ in range(self.r.randint(1, 4)):
                kind = self.r.randint(0, 3)
                if kind == 0:
                    self.menu()
                elif kind == 1:
                    self.ad()
                elif kind == 2:
                    self.block(self.pick("h2", "h3", "h4"), BOILER, self.text(1, 4))
                else:
                    self.block(self.pick("p", "p", "div", 'div class="widget"'), BOILER, self.text(4, 50, 0.1))

        self.block(self.pick("aside", "aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="right-rail"', 'aside class="widget-area"', 'div role="complementary"'), BOILER, inside if self.chance(0.8) else self.text(5, 40))

    def comments(self):
        def one():
            def said():
                if self.chance(0.5):
                    self.block(self.pick("div", 'div class="meta"', "h4", 'p class="author"'), BOILER, self.text(1, 4))
                for _ in range(self.r.randint(1, 3)):
                    self.block("p", BOILER, self.text(1, 70))

            opening = self.pick('div class="comment"', "li", 'article class="comment"', 'div class="comment-body"', 'li class="comment"', 'div class="reply"')
            self.block(opening, BOILER, said if self.chance(0.7) else self.text(2, 60))

        def inside():
            if self.chance(0.5):
                self.block(self.pick("h2", "h3"), BOILER, self.text(1, 3))
            for _ in range(self.r.randint(1, 5)):
                one()

        self.block(self.pick('section class="comments"', 'div id="comments"', 'div class="comment-list"', 'section id="discussion"', 'ol class="commentlist"', 'div class="comments-area"'), BOILER, inside)

    def legal(self) -> str:
        return self.pick("&copy; ", "© ", "Copyright ", "Copyright &copy; ", "") + str(self.r.randint(1995, 2030)) + " " + self.text(1, 8, 0.1) + self.pick("", ". All rights reserved.", "") if self.chance(0.8) else "All rights reserved."

    def footer(self):
        def inside():
            for _ in range(self.r.randint(1, 3)):
                if self.chance(0.3):
                    self.menu()
                else:
                    self.block(self.pick("p", "div", "p", "small2"), BOILER, self.legal() if self.chance(0.4) else self.text(3, 35, 0.1))

        self.block(self.pick("footer", "footer", 'div class="footer"', 'div id="footer"', 'footer class="site-footer"', 'div class="copyright"'), BOILER, inside if self.chance(0.6) else self.legal() if self.chance(0.5) else self.text(3, 30, 0.05))

    def table_page(self):
        """The whole page in a table: rows for head and foot, cells for menu, text and side."""

        def cell(state, inner):
            self.block(self.pick("td", "td", 'td valign="top"'), state, inner)

        def links():
            cell(BOILER, self.text(1, 8, 1.0) if self.chance(0.6) else self.menu)

        def middle():
            if self.chance(0.5):
                links()
            cell(CONTENT, lambda: (self.block("h1", CONTENT, self.text(2, 12)) if self.chance(0.7) else None, self.prose()))
            if self.chance(0.3):
                cell(BOILER, self.sidebar if self.chance(0.5) else self.menu)

        def rows():
            if self.chance(0.5):
                self.block("tr", BOILER, lambda: cell(BOILER, self.text(1, 6, 0.2)))
            if self.chance(0.6):
                self.block("tr", BOILER, links)
            self.block("tr", STRUCTURE, middle)
            if self.chance(0.7):
                self.block("tr", BOILER, lambda: cell(BOILER, self.legal() if self.chance(0.7) else self.text(2, 25, 0.2)))

        self.block(self.pick("table", 'table width="100%"', 'table border="0"'), STRUCTURE, rows)

    def prose(self):
        for _ in range(self.r.randint(1, 12)):
            kind = self.r.random()
            if kind < 0.72:
                short = self.chance(0.25)
                text = self.legal() if self.chance(0.03) else self.text(1, 6) if short else self.text(8, 120, self.pick2(0.0, 0.0, 0.04))
                self.block(self.pick("p", "p", "p", "p", 'p class="lead"', "div"), CONTENT, f"<b>{text}</b>" if self.chance(0.1) else text)
            elif kind < 0.8:
                self.block(self.pick("h2", "h3", "h4"), CONTENT, self.text(1, 8))
            elif kind < 0.86:
                self.block(self.pick("ul", "ol"), CONTENT, lambda: [self.block("li", CONTENT, self.text(1, 25, 0.03)) for _ in range(self.r.randint(2, 6))])
            elif kind < 0.9:
                self.block("blockquote", CONTENT, self.text(5, 40) if self.chance(0.5) else lambda: self.block("p", CONTENT, self.text(5, 40)))
            elif kind < 0.93:
                self.block("pre", CONTENT, self.text(3, 30))
            elif kind < 0.96:
                self.block("table", CONTENT, lambda: [self.block("tr", CONTENT, lambda: [self.block("td", CONTENT, self.text(1, 4)) for _ in range(3)]) for _ in range(self.r.randint(1, 4))])
            else:
                self.block(self.pick("section", "div", "figure"), CONTENT, lambda: [self.block(self.pick("p", "figcaption"), CONTENT, self.text(3, 60)) for _ in range(self.r.randint(1, 3))])
            if self.chance(0.1):
                self.r.choice((self.ad, self.share, self.sidebar, self.notice, self.nav, self.footer, self.comments, self.header))()

    def article(self):
        def inside():
            if self.chance(0.8):
                if self.chance(0.3):
                    self.block("header", CONTENT, lambda: [self.block(x, CONTENT, self.text(2, 12)) for x in self.pick(("h1",), ("h1",), ("h1", "p"))])
                else:
                    self.block("h1", CONTENT, self.text(2, 12))
            self.prose()
            for part, p in ((self.share, 0.15), (self.comments, 0.12), (self.ad, 0.1)):
                if self.chance(p):
                    part()

        if self.chance(0.1):
            return inside()
        self.block(self.pick("article", "article", "article", 'article class="post"', "main", 'div class="content"', 'div class="post-body"', 'div id="story"', 'section class="entry-content"', 'div class="article-body"', 'div id="main-content"', "div", 'div itemprop="articleBody"'), CONTENT, inside)

    def column(self):
        for part, p in ((self.notice, 0.12), (self.ad, 0.25)):
            if self.chance(p):
                part()
        self.article()
        for part, p in ((self.ad, 0.2), (self.share, 0.2), (self.comments, 0.3)):
            if self.chance(p):
                part()

    def page(self):
        def middle():
            side = self.r.random()
            if side < 0.25:
                self.sidebar()
            opening = self.pick("", "", "main", 'div class="main"', 'div id="primary"', "div", 'div class="row"')
            self.block(opening, STRUCTURE, self.column) if opening else self.column()
            if side > 0.6:
                self.sidebar()

        def body():
            if self.chance(0.2):
                return self.table_page()
            for part, p in ((self.notice, 0.25), (self.header, 0.55), (self.nav, 0.6), (self.ad, 0.3)):
                if self.chance(p):
                    part()
            opening = self.pick("", "", "", 'div class="wrapper"', 'div id="page"', 'div class="container"', "div")
            self.block(opening, STRUCTURE, middle) if opening else middle()
            for part, p in ((self.ad, 0.15), (self.notice, 0.1), (self.footer, 0.85)):
                if self.chance(p):
                    part()

        self.block("body", STRUCTURE, body)
        return "".join(self.out), self.states


@lru_cache(maxsize=1)
def trained(n: int = N_PAGES, seed: int = SEED) -> Model:
    """Softmax regression on looks, and parent-child ratios, from the labelled pages."""
    names: dict[str, int] = {}
    rows, states, pair = [], [], np.full((3, 3), 0.5)
    for html, want in labelled_pages(n, seed):
        page = Page(html)
        assert len(page.tag) == len(want), "the generator and the parser disagree"
        rows += [[names.setdefault(x, len(names)) for x in got] for got in traits(page)]
        states += want
        for i, p in enumerate(page.parent[1:], 1):
            pair[want[p], want[i]] += 1
    y = np.array(states)
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, r] = 1
    w, seen = np.zeros((len(names), 3)), np.full((len(names), 3), 1e-12)
    for _ in range(500):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = x.T @ p / len(y) + 1e-5 * w
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)  # rare looks get long steps
    prior = np.bincount(y, minlength=3) / len(y)
    joint = pair / pair.sum()
    ratio = joint / joint.sum(axis=1, keepdims=True) / prior  # the looks already hold the child's prior
    return Model({k: tuple(map(float, w[i])) for k, i in names.items()}, ratio.tolist())


def texts(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    model = model or trained()

    def run(batches):
        for batch in slices(batches, "html"):
            got = [extract(x, model) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string())], ["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    out = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op2(pages: DataFrame) -> DataFrame:
    return texts(pages)
