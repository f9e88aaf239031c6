"""Main-text extraction by a tree-structured graphical model over the DOM.

Each block element of a page is a binary variable: its subtree holds article text, or not. Emission tables (tag, role
named by class or id, text length, link share, share of the page's text, punctuation) score each node, a parent-child
table couples it with its parent. Sum-product messages go from the leaves to the root and back and give every node's
exact marginal; the text directly inside nodes with a marginal of 0.5 or more is the article. The tables are smoothed
counts over labelled pages. `training_pages` makes those pages, from a fixed seed, in the layouts that publishing
systems use; pages of one's own can be given to `train` in their place.

A page never leaves its row: no shuffle, memory is bounded by the longest page of a batch, and time is linear in it.

Defined cases: null or empty html gives an empty text; broken markup is closed as browsers do (a new paragraph ends the
open one, unclosed inline tags end with their block), but loses less: what no end tag ends - a comment, a quote, a
title, a text area, a button - is over at the next tag or block, not at the end of the page, scripts and styles alone
excepted; text without any element is content; a null page_id or url is
kept; repeated rows each get a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
SILENT = frozenset("script style noscript template head title iframe noembed noframes object svg math canvas audio video select option textarea button meta link".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
TABLE_PARTS = frozenset("table caption colgroup thead tbody tfoot tr td th body html".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": ("tr", "td", "th")}
HOLDERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "tbody": ("table",), "thead": ("table",)}
# Words in class, id and role that name a part of a page, by order of precedence.
HINTS = (
    ("hidden", ("hidden", "visually-hidden", "sr-only")),
    ("comment", ("comment", "reply", "replies", "disqus", "discussion", "respond", "response", "feedback", "talkback", "reaction", "thread", "guestbook", "remark")),
    ("notice", ("cookie", "consent", "gdpr", "notice", "alert", "banner", "popup", "modal", "paywall", "toast")),
    ("ad", ("ad", "ads", "advert", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "adbox", "dfp")),
    ("form", ("form", "search", "newsletter", "subscribe", "subscription", "signup", "login")),
    ("share", ("share", "sharing", "social", "follow")),
    ("related", ("related", "recommended", "more", "popular", "trending", "tags", "pagination", "pager", "breadcrumb", "breadcrumbs", "toc")),
    ("nav", ("nav", "menu", "navbar", "navigation", "topbar", "links")),
    ("side", ("sidebar", "side", "aside", "widget", "rail", "complementary")),
    ("foot", ("footer", "foot", "copyright", "legal", "colophon", "contentinfo")),
    ("head", ("header", "masthead", "logo", "branding", "site-title", "tagline")),
    ("content", ("content", "article", "post", "entry", "story", "main", "body", "text", "prose", "page")),
)
_ROLE = {w: name for name, ws in reversed(HINTS) for w in ws}
_RANK = {name: i for i, (name, _) in enumerate(HINTS)}
_PARTS = re.compile(r"[^a-z]+")
_NAME, _GAP = re.compile(r"[^\s/>]+"), re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"""(=?[^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")


class Node:
    __slots__ = ("tag", "hint", "parent", "own", "links", "label", "total", "link_total", "last")

    def __init__(self, tag: str, hint: str, parent: int, label: str | None) -> None:
        self.tag, self.hint, self.parent, self.label = tag, hint, parent, label
        self.own = self.links = self.total = self.link_total = 0
        self.last = ""


def hint_of(attrs: Iterable[tuple[str, str | None]]) -> str:
    """The part of a page that an element's attributes name, or none."""
    roles = set()
    for key, value in attrs:
        value = (value or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return "hidden"
        if key in ("class", "id", "role"):
            roles.update(r for w in _PARTS.split(value) if (r := _ROLE.get(w) or _ROLE.get(w.rstrip("s"))))
    if roles == {"head", "content"}:  # the head of an article, not of the page
        return "none"
    return min(roles, key=_RANK.__getitem__, default="none")


class Page:
    """Block nodes in page order, and the runs of text directly inside them.

    One pass from left to right: open elements are a stack with the places of each tag in it, so ending elements costs
    what it ends, and whether an end tag is ahead is known from one search for each tag. Time grows with the length of
    the page, however deep or broken it is.
    """

    def __init__(self, html: str) -> None:
        self.html = html
        self.nodes = [Node("#root", "none", 0, None)]
        self.open: list[tuple[str, int]] = [("#root", 0)]  # tag and block node of the open elements
        self.where: dict[str, list[int]] = defaultdict(list)  # places in open of each tag
        self.blocks, self.loose = [0], []  # places of those that are no inline elements, of silent ones without an end
        self.silent = 0
        self.runs: list[tuple[int, list[str]]] = []
        self.fresh = True
        self.marks: dict[str, tuple[list[int], list[int]]] = {}
        self._read()
        for n in reversed(self.nodes[1:]):
            n.total += n.own
            n.link_total += n.links
            up = self.nodes[n.parent]
            up.total += n.total
            up.link_total += n.link_total
        self.nodes[0].total += self.nodes[0].own

    def _read(self) -> None:
        html, at, seek, last = self.html, 0, 0, self.html.rfind(">")
        open_comment = False
        while (lt := html.find("<", seek)) >= 0 and lt < last:
            c, end = html[lt + 1], 0
            if c == "/" and html[lt + 2].isascii() and html[lt + 2].isalpha():
                name, end = _NAME.match(html, lt + 2)[0].lower(), html.index(">", lt) + 1
                self._text(html[at:lt])
                self._end(name)
            elif c.isascii() and c.isalpha():
                self._text(html[at:lt])
                name = _NAME.match(html, lt + 1)[0].lower()
                attrs, end, slash = self._attributes(lt + 1 + len(name))
                end = self._start(name, attrs, end, slash)
            elif c in "!?/":
                self._text(html[at:lt])
                if html.startswith("<!--", lt) and not html.startswith(("<!-->", "<!--->"), lt) and not open_comment:
                    end = html.find("-->", lt + 4) + 3
                    open_comment = end == 2  # none ends from here on: such a comment goes to the next >, as others do
                if end < 3:
                    end = html.index(">", lt) + 1
            else:  # no markup
                seek = lt + 1
                continue
            at = seek = end
        rest = html[at:]  # without a >: text, but for a declaration
        self._text(rest[: m.start()] if (m := re.search("<[!?]", rest)) else rest)

    def _attributes(self, at: int) -> tuple[list[tuple[str, str]], int, bool]:
        """The attributes from a place behind a tag's name, the place behind the tag, and whether a slash ends it."""
        html, attrs, begin = self.html, [], at
        while True:
            gap = _GAP.match(html, at).end()
            if gap == len(html):  # a quote that nothing ends
                return [], html.index(">", begin) + 1, False
            if html[gap] == ">":
                return attrs, gap + 1, html[gap - 1] == "/"
            m = _ATTRIBUTE.match(html, gap)
            attrs.append((m[1].lower(), unescape((m[2] or "").strip("\"'"))))
            at = m.end()

    def _marks(self, tag: str) -> tuple[list[int], list[int]]:
        """The places of the start and the end tags of one name."""
        if tag not in self.marks:
            found = [(m.start(), m[1]) for m in re.finditer(rf"<(/?){tag}(?=[\s/>])", self.html, re.I)]
            self.marks[tag] = ([p for p, s in found if not s], [p for p, s in found if s])
        return self.marks[tag]

    def _ahead(self, tag: str, at: int) -> int:
        """The place of the end tag that ends an element begun before a place: the next, if no other such element begins first."""
        starts, ends = self._marks(tag)
        i, j = bisect_left(starts, at), bisect_left(ends, at)
        return ends[j] if j < len(ends) and (i == len(starts) or ends[j] < starts[i] or tag in RAW) else -1

    def _push(self, tag: str, block: int) -> None:
        place = len(self.open)
        self.open.append((tag, block))
        self.where[tag].append(place)
        self.silent += tag in SILENT
        if tag not in INLINE:
            self.blocks.append(place)

    def _pop(self, to: int) -> None:
        """End the open elements from a place on."""
        while len(self.open) > to:
            tag, _ = self.open.pop()
            self.where[tag].pop()
            self.silent -= tag in SILENT
            if tag not in INLINE:
                self.fresh = True
                self.blocks.pop()
        while self.loose and self.loose[-1] >= to:
            self.loose.pop()

    def _place(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of some tags."""
        return max((w[-1] for t in tags if (w := self.where.get(t))), default=0)

    def _close(self, tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        """End the open elements down to the outermost of tags inside the innermost of stop."""
        floor, lowest = self._place(stop), len(self.open)
        for t in tags:
            own = self.where.get(t, ())
            k = bisect_right(own, floor)
            if k < len(own):
                lowest = min(lowest, own[k])
        self._pop(lowest)

    def _start(self, tag: str, attrs: list[tuple[str, str]], end: int, slash: bool) -> int:
        """Begin an element whose start tag ends at a place; the place to read on from."""
        if self.open[-1][0] == "head" and tag not in IN_HEAD:
            self._pop(len(self.open) - 1)
        if tag in CLOSES_P:
            if self.loose:
                self._pop(self.loose[0])
            self._close(("p",), ("button", "td", "th", "table"))
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], HOLDERS[tag])
        if tag == "a" and self.where["a"]:
            self._close(("a",), ("td", "table"))
        hint = hint_of(attrs) if attrs else "none"
        block = self.open[-1][1]
        if tag not in INLINE or (hint not in ("none", "content") and tag == "span"):
            label = next((v for k, v in attrs if k == "data-y"), None)
            self.nodes.append(Node(tag, hint, block, label))
            block = len(self.nodes) - 1
            self.fresh = True
        elif tag in ("br", "img", "wbr") and self.runs and not self.silent:
            self.runs[-1][1].append(" ")
        if tag in VOID or (slash and tag in ("svg", "math")):  # a slash ends these alone
            return end
        if tag in RAW:
            stop = self._ahead(tag, end)
            if stop < 0:  # an unended script or style goes on to the end of the page, others are empty
                return len(self.html) if tag in ("script", "style") else end
            return self.html.find(">", stop) + 1 or len(self.html)
        if tag in SILENT and tag not in ("head", "body") and self._ahead(tag, end) < 0:
            self.loose.append(len(self.open))  # what has no end is over where the next block begins
        self._push(tag, block)
        return end

    def _end(self, tag: str) -> None:
        own = self.where.get(tag)
        if not own or (tag in INLINE and self.blocks[-1] > own[-1]):  # the block that held it ended already
            return
        if tag not in TABLE_PARTS and self._place(("table", "td", "th")) > own[-1]:  # a cell's content ends nothing around its table
            return
        self._pop(own[-1])

    def _text(self, data: str) -> None:
        if not data:
            return
        if self.open[-1][0] == "head" and data.strip():
            self._pop(len(self.open) - 1)
        if self.silent:
            return
        data = unescape(data)
        block = self.open[-1][1]
        if self.fresh or not self.runs or self.runs[-1][0] != block:
            self.runs.append((block, []))
            self.fresh = False
        self.runs[-1][1].append(data)
        size = len(data.strip())
        if size:
            n = self.nodes[block]
            n.own += size
            n.last = data
            if self.where["a"]:
                n.links += size


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n > e for e in edges)


def features(page: Page, i: int) -> tuple:
    """Discrete observations of a node; each has its own emission table."""
    n = page.nodes[i]
    share = n.link_total / n.total if n.total else -1
    end = n.last.rstrip()[-1:] if n.own else ""
    return (
        ("tag", n.tag),
        ("hint", n.hint),
        ("own", _bucket(n.own, (0, 25, 100, 400))),
        ("links", -1 if share < 0 else _bucket(int(100 * share), (0, 20, 50, 90))),
        ("share", _bucket(100 * n.total // max(1, page.nodes[0].total), (0, 2, 10, 40, 75))),
        ("end", "none" if not end else "stop" if end in ".!?…:;\"'”»)" else "open"),
    )


def kind_of(n: Node) -> int:
    """What a node is to its children: 0 a page or plain box, 1 an article's box, 2 a part of running text or of a list."""
    if n.tag in ("article", "main") or n.hint == "content":
        return 1
    return 0 if n.tag in ("#root", "html", "body", "div", "section") else 2


class Model:
    """Log tables: emission[name, value] for labels 0 and 1, and edge[kind of parent][parent label][child label]."""

    def __init__(self, emission: dict, unseen: dict, edge: list[list[list[float]]], prior: list[float], power: dict[str, float]) -> None:
        self.emission, self.unseen, self.edge, self.prior, self.power = emission, unseen, edge, prior, power

    def marginals(self, page: Page) -> list[float]:
        """The probability, for each node, that its subtree holds article text."""
        nodes = page.nodes
        edges = [self.edge[kind_of(n)] for n in nodes]
        up = []
        for i in range(len(nodes)):
            a = b = 0.0
            if i:
                for f in features(page, i):
                    e = self.emission.get(f) or self.unseen[f[0]]
                    w = self.power[f[0]]
                    a += w * e[0]
                    b += w * e[1]
            up.append([a, b])
        up[0][0] += self.prior[0]
        up[0][1] += self.prior[1]
        sent: list[tuple[float, float]] = [(0.0, 0.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
            a, b = up[i]
            edge = edges[nodes[i].parent]
            m = tuple(_sum(edge[p][0] + a, edge[p][1] + b) for p in (0, 1))
            sent[i] = m
            up[nodes[i].parent][0] += m[0]
            up[nodes[i].parent][1] += m[1]
        whole = [up[0]]
        for i in range(1, len(nodes)):
            p, edge = whole[nodes[i].parent], edges[nodes[i].parent]
            x, y = p[0] - sent[i][0], p[1] - sent[i][1]  # the parent without this child
            a = up[i][0] + _sum(edge[0][0] + x, edge[1][0] + y)
            b = up[i][1] + _sum(edge[0][1] + x, edge[1][1] + y)
            top = max(a, b)
            whole.append([a - top, b - top])
        return [1 / (1 + math.exp(max(-700.0, min(700.0, a - b)))) for a, b in whole]

    def text(self, html: str | None) -> str:
        page = Page(html or "")
        likely = self.marginals(page)
        out = []
        for node, parts in page.runs:
            if likely[node] >= 0.5:
                t = " ".join("".join(parts).split())
                if t:
                    out.append(t)
        return " ".join(out)


def _sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


#: Exponents of the emission tables: what the observations share must not count twice.
POWER = {"tag": 1.0, "hint": 2.5, "own": 0.4, "links": 1.0, "share": 0.2, "end": 0.5}


def train(pages: Iterable[str], smooth: float = 0.5) -> Model:
    """Smoothed counts over labelled pages: data-y="1" marks article blocks, data-y="0" the rest, both for what lies inside."""
    seen: dict[tuple, list[float]] = defaultdict(lambda: [smooth, smooth])
    of: dict[str, set] = defaultdict(set)
    edge, labels = [[[20.0, 0.02], [1.0, 1.0]] for _ in range(3)], [1.0, 1.0]
    for html in pages:
        page = Page(html)
        y = [0] * len(page.nodes)
        for i, n in enumerate(page.nodes):
            y[i] = int(n.label) if n.label in ("0", "1") else (y[n.parent] if i else 0)
        for i in range(len(y) - 1, 0, -1):
            y[page.nodes[i].parent] |= y[i]
        for i in range(1, len(y)):
            labels[y[i]] += 1
            up = page.nodes[i].parent
            edge[kind_of(page.nodes[up])][y[up]][y[i]] += 1
            for f in features(page, i):
                seen[f][y[i]] += 1
                of[f[0]].add(f[1])
    norm = {k: [labels[y] + smooth * (len(v) + 1) for y in (0, 1)] for k, v in of.items()}
    emission = {f: [math.log(c[y] / norm[f[0]][y]) for y in (0, 1)] for f, c in seen.items()}
    unseen = {k: [math.log(smooth / min(norm[k])), math.log(smooth / min(norm[k]))] for k in norm}
    logs = [[[math.log(c / sum(row)) for c in row] for row in kind] for kind in edge]
    return Model(emission, unseen, logs, [math.log(0.02), math.log(0.98)], POWER)


def training_pages(count: int = 400, seed: int = 11) -> Iterator[str]:
    """Labelled pages: an article of blocks of many kinds among the parts that publishing systems put around it."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiourstnlmdcp") for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(4, 18).capitalize() + rng.choice("....!?")
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    links = lambda a, b: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(a, b))) + "</ul>"

    def named(part: str) -> str:
        own = dict(HINTS)[part]
        w = rng.choice(own)
        return rng.choice([f'class="{w}"', f'id="{w}"', f'class="{w} {word()}"', f'class="{word()}-{w}"', f'class="{w}-{word()}"'])

    def wrap(part: str | None, tags: str, inside: str, label: int = 0) -> str:
        tag = rng.choice(tags.split())
        attrs = f" {named(part)}" if part else ""
        return f'<{tag}{attrs} data-y="{label}">{inside}</{tag}>'

    def boilerplate(kind: str) -> str:
        bare = rng.random() < 0.4
        if kind == "nav":
            return wrap(None if bare else "nav", "nav" if bare else "nav div ul", rng.choice([links(3, 9), " ".join(link() for _ in range(5))]))
        if kind == "head":
            return wrap(None if bare else "head", "header" if bare else "header div", rng.choice([f"<a href='/'>{words(1, 3)}</a><p>{words(2, 6)}</p>", f"<h1>{words(1, 3)}</h1>{links(2, 5)}", f"<p>{sentence()}</p>"]))
        if kind == "foot":
            return wrap(None if bare else "foot", "footer" if bare else "footer div", rng.choice([f"&copy; {words(1, 3)} &middot; {sentence()}", f"<p>{sentence()}</p>{links(2, 5)}", prose(1, 3)]))
        if kind == "side":
            return wrap(None if bare else "side", "aside" if bare else "aside div section", rng.choice([f"<h3>{words(1, 4)}</h3>{links(3, 7)}", f"<p>{prose(1, 3)}</p>", prose(1, 2)]))
        if kind in ("notice", "ad"):
            return wrap(kind, "div section aside", rng.choice([prose(1, 3), f"<p>{prose(1, 3)}</p>", f"<p>{sentence()}</p><button>{word()}</button>", f"{link()} {words(2, 6)}"]))
        if kind == "form":
            return wrap(None if bare else "form", "form" if bare else "form div section", rng.choice([f"<label>{words(1, 4)}</label><input>", f"<p>{sentence()}</p><input><button>{word()}</button>", f"<form><p>{prose(1, 2)}</p></form>"]))
        if kind == "comment":
            one = lambda: rng.choice([f"<li><b>{word()}</b> <p>{prose(1, 4)}</p></li>", f"<div><p>{prose(1, 4)}</p></div>", f"<p>{prose(1, 3)}</p>"])
            return wrap("comment", "section div ol ul", (f"<h2>{words(1, 2)}</h2>" if rng.random() < 0.5 else "") + "".join(one() for _ in range(rng.randint(1, 6))))
        if kind == "share":
            return wrap("share", "div ul", " ".join(link() for _ in range(rng.randint(2, 5))))
        if kind == "hidden":
            return wrap("hidden", "div section", prose(1, 2))
        return wrap("related", "div section ul nav", f"<h3>{words(1, 3)}</h3>{links(2, 6)}")

    def body() -> str:
        out = []
        loose = rng.random() < 0.5  # unclosed paragraphs and inline tags
        for _ in range(rng.randint(2, 14)):
            r = rng.random()
            text = prose(1, 7)
            if rng.random() < 0.25:
                text += f" {link()} {sentence()}"
            if r < 0.62:
                out.append(f"<p><b>{sentence()}<br><p>{text}</p>" if loose and rng.random() < 0.3 else f"<p>{text}" if loose and rng.random() < 0.2 else f"<p>{text}</p>")
            elif r < 0.72:
                out.append(f"<h{(k := rng.randint(2, 4))}>{words(2, 7)}</h{k}>")
            elif r < 0.79:
                out.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.84:
                out.append(f"<blockquote>{rng.choice([text, f'<p>{text}</p>'])}</blockquote>")
            elif r < 0.88:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            elif r < 0.92:
                out.append(f"<pre>{words(3, 12)}</pre>")
            elif r < 0.95:
                out.append(f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>")
            else:
                out.append(boilerplate(rng.choice(["ad", "share", "related", "form", "notice", "hidden"])))
        return "".join(out)

    for _ in range(count):
        title = f"<h1>{words(2, 9).capitalize()}</h1>" if rng.random() < 0.85 else ""
        if title and rng.random() < 0.3:
            title = f"<header>{title}</header>"
        inner = title + body()
        article = (
            f'<article data-y="1">{inner}</article>' if rng.random() < 0.45
            else f'<main data-y="1">{inner}</main>' if rng.random() < 0.3
            else wrap("content", "div section main article", inner, 1)
        )
        if rng.random() < 0.3:
            article = f"<{(t := rng.choice(['div', 'main', 'section']))}>{article}{boilerplate('comment') if rng.random() < 0.4 else ''}</{t}>"
        before = [boilerplate(k) for k in ("notice", "head", "nav", "ad", "form", "related") if rng.random() < 0.45]
        after = [boilerplate(k) for k in ("ad", "side", "comment", "related", "form", "share", "foot") if rng.random() < 0.45]
        page = "".join([*before, article, *after])
        if rng.random() < 0.25:
            page = f"<div class='wrapper'>{page}</div>"
        yield f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>{page}</body></html>"


@cache
def default_model() -> Model:
    return train(training_pages())


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html)."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [model.text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
