"""Main-text extraction with a tree-structured graphical model.

A page becomes a tree of its block elements with one leaf per text block. Every
node has a hidden state, content or not, with a potential from its tag, its class
and id words, its amount of text and links; every edge has a potential over the
states of parent and child. Sum-product messages run up and down the tree, all pages of a
batch level by level, and give the marginal of every text block. The weights
maximise the likelihood of labelled pages; where no labelled pages are
given, a seeded generator of labelled layouts supplies them.
"""

from __future__ import annotations

import html as _html
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tables import beside, small, without

OUT = ["text", "n_chars"]
#: Generated training pages, gradient steps.
PAGES, STEPS = 400, 160
#: Pages whose messages run together.
TOGETHER = 256

# Fixed values of the markup language: which elements are blocks, which close themselves, whose content is not text.
BLOCKS = set(
    "html body main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "form fieldset legend blockquote pre figure figcaption details summary address hr center hgroup menu dialog search".split()
)
RAW_TEXT = set("script style title textarea iframe".split())
NO_TEXT = RAW_TEXT | set("noscript template object svg canvas select button audio video map datalist".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
}
TAGS = sorted(BLOCKS) + ["#text"]
# Words of class, id and role that tell a block's purpose, by purpose.
CUES = {
    "content": "article content post entry story body text main blog news prose maincontent articlebody single",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs tab topbar skip",
    "head": "header masthead banner logo branding top hero",
    "foot": "footer bottom copyright legal colophon imprint",
    "side": "sidebar side aside widget rail complementary secondary",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner outbrain taboola dfp commercial",
    "notice": "cookie cookies consent gdpr notice popup modal overlay alert newsletter subscribe subscription signup paywall disclaimer toast",
    "comment": "comment comments commentlist respond reply replies disqus discussion feedback reviews",
    "more": "related recommended recommendations more trending popular latest readmore also share sharing social tags meta byline author",
    "form": "form search login contact register field",
}
_CUE = {w: k for k, words in CUES.items() for w in words.split()}
# Headings that announce other matter than the article.
HEADINGS = {
    "comment": "comments comment kommentare kommentar commentaires comentarios responses replies discussion",
    "more": "related recommended popular trending tags share weitere mehr articles similaires relacionados archives categories",
    "notice": "newsletter subscribe cookies advertisement anzeige publicité publicidad",
}
_HEADING = {w: k for k, words in HEADINGS.items() for w in words.split()}
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/!?a-zA-Z][^>]*\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CUE_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


def ends(source: str, name: str) -> dict[int, int]:
    """End of the content of each start tag of `name` that has its own end tag, by the end of the start tag.

    Tags are paired by nesting in one pass; those in comments, scripts and styles are none.
    """
    out, open_ = {}, []
    for m in re.finditer(rf"<!--.*?(?:-->|\Z)|<(script|style)\b.*?</\1\b|<(/?){name}(?=[\s/>])[^>]*>", source, re.S | re.I):
        if m[2] is None:
            continue
        if m[2]:
            if open_:
                out[open_.pop()] = m.end()
        elif not m[0].endswith("/>"):
            open_.append(m.end())
    return out


@dataclass
class Page:
    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    cues: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)


def parse(source: str) -> Page:
    """The page's block tree; text blocks are leaves in page order. Never fails: what is no tag is text."""
    page = Page()
    parent, tag, cues, text, links, label = page.parent, page.tag, page.cues, page.text, page.links, page.label

    def add(p, t, c=(), s="", n=0, y=0):
        parent.append(p)
        tag.append(t)
        cues.append(c)
        text.append(s)
        links.append(n)
        label.append(y)

    add(-1, "html")
    stack, held, linked, in_link = [0], [], 0, False
    paired: dict[str, dict[int, int]] = {}

    def flush():
        nonlocal held, linked
        if held:
            s = " ".join("".join(held).split())
            if s:
                add(stack[-1], "#text", (), s, min(linked, len(s)), label[stack[-1]])
            held, linked = [], 0

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        stop = m.start() if m else n
        if stop > at:
            piece = source[at:stop]
            if "&" in piece:
                piece = _html.unescape(piece)
            held.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                held.append(m[0][9:-3])
            continue
        closing = m[1] or m[4]
        if name in NO_TEXT and not closing:
            if name in RAW_TEXT:
                # such an element without an end takes the rest of the page, as a browser has it
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else n
            elif not (m[3] or m[6] or "").endswith("/"):
                # any other one without an end is nothing but its tag
                if name not in paired:
                    paired[name] = ends(source, name)
                at = paired[name].get(at, at)
            continue
        if name == "a":
            in_link = not closing
            continue
        if name == "br":
            held.append(" ")
            continue
        if name not in BLOCKS:
            if name == "img" or name == "wbr":
                continue
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if tag[stack[k]] == name:
                    del stack[k:]
                    break
                if name not in ("html", "body") and tag[stack[k]] in ("article", "main", "body", "table") and name in ("p", "li", "td", "tr", "th"):
                    break
            in_link = False
            continue
        if name == "hr":
            continue
        if name in ("html", "body") and len(stack) == 1 and name == "html":
            continue
        if tag[stack[-1]] == "p":
            stack.pop()
        if name in CLOSES:
            own, bound = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1):
                if tag[stack[k]] in own:
                    del stack[k:]
                    break
                if tag[stack[k]] in bound:
                    break
        found, y = [], label[stack[-1]]
        for a in _ATTRIBUTE.finditer(m[3] or m[6] or ""):
            value = a[2] or a[3] or a[4] or ""
            if a[1].lower() == "data-label":
                y = int(value == "1")
            else:
                found += [_CUE[w] for w in map(str.lower, _CUE_SPLIT.split(value)) if w in _CUE]
        add(stack[-1], name, tuple(dict.fromkeys(found)), "", 0, y)
        stack.append(len(tag) - 1)
    flush()
    return page


#: Feature numbers, given out in a fixed order.
_FEATURES: dict[str, int] = {}
for _name in (
    [f"tag {t}" for t in TAGS]
    + [f"in {t}" for t in TAGS]
    + [f"cue {c}" for c in CUES]
    + [f"cue {c} of parent" for c in CUES]
    + [f"heading {c}" for c in HEADINGS]
    + [f"size {k}" for k in range(8)]
    + [f"text size {k}" for k in range(8)]
    + [f"links {k}" for k in range(5)]
    + [f"text links {k}" for k in range(5)]
    + [f"share {k}" for k in range(5)]
    + ["sentence", "first heading", "words few", "rights"]
):
    _FEATURES[_name] = len(_FEATURES)
#: Kinds of edges, by the child.
EDGES = ("#text", "heading", "paragraph", "list", "box", "frame")
_EDGE = {"#text": 0} | {f"h{k}": 1 for k in range(1, 7)} | dict.fromkeys(("p", "blockquote", "pre", "figcaption", "dd", "dt"), 2) | dict.fromkeys(("ul", "ol", "li", "dl", "table", "tr", "td", "th", "tbody"), 3) | dict.fromkeys(("nav", "header", "footer", "aside", "form"), 5)
_SIZES = (10, 25, 60, 120, 300, 800, 2500)


def _bucket(n: float, edges: tuple) -> int:
    k = 0
    while k < len(edges) and n >= edges[k]:
        k += 1
    return k


def featurise(page: Page) -> tuple[list[int], list[int], list[int], list[int]]:
    """(node of each active feature, feature, depth of each node, edge kind of each node)."""
    f, parent, tag = _FEATURES, page.parent, page.tag
    n = len(parent)
    size, links = [len(s) for s in page.text], list(page.links)
    depth, kind = [0] * n, [0] * n
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
        kind[i] = _EDGE.get(tag[i], 4)
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
        links[parent[i]] += links[i]
    nodes, feats = [], []
    total, headed, first = max(1, size[0]), {}, False
    for i in range(n):
        own = []
        t = tag[i]
        own.append(f[f"tag {t}"])
        if i:
            own.append(f[f"in {tag[parent[i]]}"])
            for c in page.cues[parent[i]]:
                own.append(f[f"cue {c} of parent"])
        for c in page.cues[i]:
            own.append(f[f"cue {c}"])
        density = _bucket(links[i] / max(1, size[i]), (0.01, 0.25, 0.5, 0.8))
        if t == "#text":
            s = page.text[i]
            own += [f[f"text size {_bucket(len(s), _SIZES)}"], f[f"text links {density}"]]
            if s[-1] in ".!?…:\"”'»":
                own.append(f["sentence"])
            if len(s) < 40 and s.count(" ") < 5:
                own.append(f["words few"])
            if "©" in s or "all rights reserved" in s.lower():
                own.append(f["rights"])
            up = parent[i]
            if tag[up][0] == "h" and tag[up][1:].isdigit():
                if not first and tag[up] == "h1":
                    own.append(f["first heading"])
                    first = True
                if len(s) < 60:
                    for w in s.lower().split():
                        k = _HEADING.get(w.strip(".,:()"))
                        if k and parent[up] > 0:
                            headed.setdefault(parent[up], k)
        else:
            own += [f[f"size {_bucket(size[i], _SIZES)}"], f[f"links {density}"], f[f"share {_bucket(size[i] / total, (0.05, 0.2, 0.5, 0.8))}"]]
        nodes += [i] * len(own)
        feats += own
    for i, k in headed.items():
        nodes.append(i)
        feats.append(f[f"heading {k}"])
    return nodes, feats, depth, kind


class Forest:
    """The trees of many pages side by side, with the two message passes."""

    def __init__(self, pages: list[Page]):
        node, feat, depth, kind, parent, leaf = [], [], [], [], [], []
        base, self.base = 0, []
        for p in pages:
            a, b, c, d = featurise(p)
            node.append(np.array(a) + base)
            feat.append(np.array(b))
            depth += c
            kind += d
            parent.append(np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + base))
            self.base.append(base)
            base += len(c)
        self.n = base
        self.node, self.feat = np.concatenate(node), np.concatenate(feat)
        self.depth, self.kind, self.parent = np.array(depth), np.array(kind), np.concatenate(parent)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(self.depth))[:-1])

    def marginals(self, w: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(content) of each node, joint of each node with its parent as [node, parent state, own state])."""
        unary = np.zeros((self.n, 2))
        unary[:, 1] = np.bincount(self.node, w[self.feat], self.n)
        up, message = unary.copy(), np.zeros((self.n, 2))
        psi = edge[self.kind]
        for level in self.levels[:0:-1]:
            both = psi[level] + up[level][:, None, :]
            message[level] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            np.add.at(up, self.parent[level], message[level])
        belief = up.copy()
        joint = np.zeros((self.n, 2, 2))
        for level in self.levels[1:]:
            around = belief[self.parent[level]] - message[level]
            both = around[:, :, None] + psi[level] + up[level][:, None, :]
            top = both.max(axis=(1, 2), keepdims=True)
            e = np.exp(both - top)
            joint[level] = e / e.sum(axis=(1, 2), keepdims=True)
            down = np.logaddexp(around[:, 0, None] + psi[level][:, 0], around[:, 1, None] + psi[level][:, 1])
            belief[level] = up[level] + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), joint


@dataclass
class HtmlModel:
    weights: np.ndarray
    edges: np.ndarray

    def extract(self, sources: list[str | None]) -> list[str]:
        out = [""] * len(sources)
        pages = [(i, parse(s)) for i, s in enumerate(sources) if s]
        for k in range(0, len(pages), TOGETHER):
            part = pages[k : k + TOGETHER]
            forest = Forest([p for _, p in part])
            p1, _ = forest.marginals(self.weights, self.edges)
            for (i, page), base in zip(part, forest.base):
                out[i] = "\n\n".join(s for j, s in enumerate(page.text) if s and p1[base + j] >= 0.5)
        return out


def fit(labelled: list[str], steps: int = STEPS, ridge: float = 0.002) -> HtmlModel:
    """Maximum likelihood on pages whose elements carry data-label="1" or "0" (inherited, 0 at the root)."""
    pages = [parse(s) for s in labelled]
    for p in pages:  # a box is content if most of its text is
        n = len(p.parent)
        size, own = [len(s) for s in p.text], [len(s) * y for s, y in zip(p.text, p.label)]
        for i in range(n - 1, 0, -1):
            size[p.parent[i]] += size[i]
            own[p.parent[i]] += own[i]
        p.label = [int(2 * own[i] > size[i]) if size[i] else p.label[i] for i in range(n)]
    forest = Forest(pages)
    y = np.array([v for p in pages for v in p.label])
    w, edge = np.zeros(len(_FEATURES)), np.zeros((len(EDGES), 2, 2))
    inner = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros_like(edge)
    np.add.at(seen, (forest.kind[inner], y[forest.parent[inner]], y[inner]), 1.0)
    hits = np.bincount(forest.feat, y[forest.node], len(w))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, edge)]
    for t in range(1, steps + 1):
        p1, joint = forest.marginals(w, edge)
        expect = np.zeros_like(edge)
        np.add.at(expect, forest.kind[inner], joint[inner])
        grads = ((hits - np.bincount(forest.feat, p1[forest.node], len(w))) / len(pages) - ridge * w, (seen - expect) / len(pages) - ridge * edge)
        for x, g, (a, b) in zip((w, edge), grads, state):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            x += 0.15 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return HtmlModel(w, edge)


def training_pages(n: int = PAGES, seed: int = 5) -> list[str]:
    """Labelled layouts: an article in one of many wrappings among menus, notices, adverts, forms, lists and comments."""
    r = random.Random(seed)
    syllables = "an be co da el fi go ha in ja ko le mi no or pa qui re sa ti un va wo ya zen".split()

    def words(lo, hi):
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi)))

    def sentence(lo=4, hi=18):
        return words(lo, hi).capitalize() + r.choice("...!?")

    def para(lo=1, hi=6):
        s = " ".join(sentence() for _ in range(r.randint(lo, hi)))
        if r.random() < 0.3:
            s += f' <a href="/x">{words(1, 3)}</a> {sentence()}'
        return r.choice(("<b>{}</b>", "{}", "{}", "{}<br>", "<em>{}", "<span>{}</span>")).format(s)

    def links(k):
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))

    def cls(*names):
        a = r.choice(names)
        return r.choice((f' class="{a}"', f' id="{a}"', f' class="x1 {a}"')) if a else ""

    def block():
        k = r.random()
        if k < 0.7:
            return f"<p>{para()}" + r.choice(("</p>", "</p>", ""))
        if k < 0.78:
            h = r.choice(("h2", "h3", "h4"))
            return f"<{h}>{words(2, 7)}</{h}>"
        if k < 0.84:
            return "<ul>" + "".join(f"<li>{para(1, 2)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if k < 0.89:
            return f"<blockquote><p>{para(1, 3)}</p></blockquote>"
        if k < 0.93:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{words(1, 6)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if k < 0.97:
            return f"<p>{sentence(1, 4)}</p>"
        return f"<pre>{words(5, 30)}</pre>"

    def menu():
        return r.choice(
            (
                lambda: f"<nav><ul>{links(r.randint(3, 9))}</ul></nav>",
                lambda: f"<div{cls('menu', 'navbar', 'main-nav', 'topbar')}><ul>{links(r.randint(3, 9))}</ul></div>",
                lambda: f"<ul{cls('nav', 'breadcrumbs', '')}>{links(r.randint(2, 6))}</ul>",
                lambda: "<div>" + " | ".join(f'<a href="/{i}">{words(1, 2)}</a>' for i in range(r.randint(3, 7))) + "</div>",
            )
        )()

    def head():
        return r.choice(
            (
                lambda: f"<header><div{cls('logo', 'branding')}>{words(1, 3)}</div>{menu()}</header>",
                lambda: f"<div{cls('header', 'site-header', 'masthead')}><a href='/'>{words(1, 3)}</a><p>{sentence(2, 7)}</p></div>",
                lambda: f"<header><p>{sentence(2, 9)}</p></header>",
                menu,
            )
        )()

    def foot():
        return r.choice(
            (
                lambda: f"<footer>&copy; {words(1, 3)} &middot; {sentence()}</footer>",
                lambda: f"<footer><p>{sentence()} {sentence()}</p><ul>{links(4)}</ul></footer>",
                lambda: f"<div{cls('footer', 'site-footer', 'copyright')}><p>Copyright {words(1, 4)}. All rights reserved. {sentence()}</p></div>",
                lambda: f"<footer><div>{para(1, 3)}</div></footer>",
            )
        )()

    def extra():
        return r.choice(
            (
                lambda: f"<div{cls('ad', 'advert', 'ads', 'sponsored', 'promo-box')}>{para(1, 3)}</div>",
                lambda: f"<aside><h3>{words(1, 3)}</h3><p>{para(1, 3)}</p><ul>{links(3)}</ul></aside>",
                lambda: f"<div{cls('sidebar', 'widget', 'right-rail')}><h3>{words(1, 3)}</h3><ul>{links(5)}</ul><p>{para(1, 2)}</p></div>",
                lambda: f"<div{cls('cookie-notice', 'consent', 'gdpr', 'popup', 'newsletter-signup')}><p>{para(1, 3)}</p><button>{words(1, 2)}</button></div>",
                lambda: f"<form action='/s'><label>{words(1, 3)}</label><input name='q'><p>{sentence()}</p><button>{words(1, 1)}</button></form>",
                lambda: f"<div{cls('related', 'recommended', 'trending')}><h3>{r.choice(('Related', 'More', words(1, 2)))}</h3><ul>{links(5)}</ul></div>",
                lambda: f"<div{cls('share', 'social', 'tags', 'byline')}>{words(1, 4)} <a href='#'>{words(1, 1)}</a></div>",
                lambda: f"<aside{cls('', 'sidebar')}><div>{para(1, 4)}</div></aside>",
                lambda: f"<div role='alert'{cls('notice', 'alert')}>{para(1, 2)}</div>",
            )
        )()

    def comments():
        say = lambda tag: "".join(f"<{tag}{cls('comment', 'reply', '')}><p>{para(1, 4)}</p></{tag}>" for _ in range(r.randint(1, 5)))
        return r.choice(
            (
                lambda: f"<section{cls('comments', 'comment-list', 'disqus')}><h2>{r.choice(('Comments', words(1, 2)))}</h2>{say('div')}</section>",
                lambda: f"<div{cls('comments', 'respond', 'discussion')}>{say('div')}<form><p>{sentence()}</p></form></div>",
                lambda: f"<section><h3>{r.choice(('Comments', '3 Comments', 'Kommentare', 'Commentaires', 'Comentarios'))}</h3>{say('article' if r.random() < 0.2 else 'div')}</section>",
                lambda: f"<ol{cls('commentlist', 'comments')}>{say('li')}</ol>",
            )
        )()

    def article():
        title = f"<h1>{words(3, 9)}</h1>" if r.random() < 0.85 else ""
        inner = []
        for _ in range(r.randint(1, 12)):
            inner.append(block())
            if r.random() < 0.08:
                inner.append(f'<div data-label="0"{cls("ad", "promo", "related", "newsletter", "share")}>{para(1, 2)}</div>')
            if r.random() < 0.03:
                inner.append(f"<aside data-label='0'>{para(1, 2)}</aside>")
        body = title + "".join(inner)
        wrap = r.choice(
            (
                "<article data-label='1'>{}</article>",
                "<article data-label='1'>{}</article>",
                "<article data-label='1'>{}</article>",
                "<main><article data-label='1'>{}</article></main>",
                "<main data-label='1'>{}</main>",
                "<div data-label='1' class='content'>{}</div>",
                "<div data-label='1' id='main-content'>{}</div>",
                "<div class='post'><div data-label='1' class='entry-content'>{}</div></div>",
                "<div class='wrap'><div data-label='1'>{}</div></div>",
                "<section data-label='1'>{}</section>",
                "<section class='story-body' data-label='1'><div>{}</div></section>",
                "<table><tr><td data-label='1'>{}</td></tr></table>",
            )
        )
        return wrap.format(body)

    out = []
    for k in range(n):
        parts = [head()] if r.random() < 0.8 else []
        parts += [menu() for _ in range(r.randint(0, 2))] + [extra() for _ in range(r.randint(0, 2))]
        parts += [article()] + [extra() for _ in range(r.randint(0, 3))]
        if r.random() < 0.4:
            parts.append(comments())
        if r.random() < 0.3:
            parts.append(extra())
        if r.random() < 0.85:
            parts.append(foot())
        body = "".join(parts)
        if r.random() < 0.3:
            body = f"<div{cls('page', 'wrapper', 'container', '')}>{body}</div>"
        page = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{body}</body></html>"
        out.append(page)
    return out


@lru_cache(maxsize=1)
def default_model() -> HtmlModel:
    return fit(training_pages())


def _extract(model: HtmlModel, at: int, n: int):
    def run(it):
        for batch in small(it):
            got = model.extract(batch.column(at).to_pylist())
            cols = [batch.column(i) for i in range(n)]
            yield pa.record_batch([*cols, pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], [*batch.schema.names[:n], *OUT])

    return run


def extract_main_text(pages: DataFrame, source: str = "html", model: HtmlModel | None = None) -> DataFrame:
    """pages but for the markup, plus text (main text, blocks joined by an empty line) and n_chars.

    A null or empty page gives an empty text, and so does one without content. Broken, truncated and very long pages are
    read to their end; what cannot be a tag is text. Repeated rows are read alike, an empty table gives none. Input columns named like an output are replaced.
    """
    base, at, n = beside(pages, OUT, source, without(pages, [source]))
    schema = T.StructType([*base.schema.fields[:n], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return base.mapInArrow(_extract(model or default_model(), at, n), schema)
