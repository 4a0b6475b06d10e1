"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of elements and text blocks. Every node is boilerplate or content. A node's
own potential comes from what is seen of it (tag, words of class and id, link and text shares,
depth of menus and forms); parent and child are joined by a potential that depends on the child's
kind. Messages passed up to the root and down again give every node's exact marginal, and blocks
that are content more likely than not are the text.

The potentials are estimated from labelled pages: :func:`labelled_pages` builds them from seeded
layouts whose parts are known (articles, menus, headers, footers, sidebars, notices, adverts,
forms, reader comments); pages labelled by hand may be passed instead. Nothing is learned from
the pages to be extracted.

Null and empty html give an empty text; unclosed, truncated and misnested markup is closed as a
browser would for blocks; markup without content gives an empty text. The whole page is read, in
time linear in it. Each row is read by itself, so repeated rows and ids give their text each; an
empty table gives an empty one; a block as likely content as not is left out.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fenloom.llm.common import packed, small_batches

#: Fixed values of the HTML language: elements without an end, whose text is not shown, inside a line.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template head title textarea select option svg iframe object canvas datalist".split())
RAW = set("script style textarea title iframe noscript".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rp rt s samp small "
             "span strike strong sub sup time tt u var br wbr img input".split())
#: Parts of forms that stand inside lines; what they hold is not text.
FORM = set("button label legend output meter progress".split())
#: Elements that end an open paragraph, and those that end an open one of their own kind.
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
             "h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt tr td th thead tbody tfoot".split())
ENDS_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}}
STOP = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
        "tbody": {"table"}, "thead": {"table"}, "option": {"select"}}

#: No part gives back what it has taken, and a value without its closing quote runs to the end of the page.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*+(?:>|$)|<\?[^>]*+(?:>|$)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|$)"
                   r"|<([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$))|[^>])*+)(?:>|$)", re.S)
END = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*+(?:>|$)", re.I) for tag in sorted(HIDDEN | RAW)}
ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
LINE = re.compile(r"\s+")
#: Elements that stand by their tag even when they have a name.
PLAIN = set("h1 h2 h3 h4 h5 h6 p li dl dt dd table tr td th caption figure figcaption blockquote pre".split())
#: Parts of lists and tables: there are many of them, and what they hold is seen at their text and at the whole.
PARTS = set("li dt dd tr td th caption figcaption".split())
#: Share of a tag's nodes that may be of the label it was not seen with.
RARE = 0.02


@dataclass
class Node:
    tag: str
    parent: int
    words: tuple[str, ...] = ()
    text: str | None = None  # of a block
    linked: int = 0
    top: bool = False  # stands in the body itself
    children: list[int] = field(default_factory=list)


def parse(page: str) -> list[Node]:
    """The tree of a page, parents before children; leaves with text are its blocks.

    Time is linear in the page: the places of each tag among the open elements are kept, and a tag
    whose end was not found once is not looked for again.
    """
    nodes, open_ = [Node("root", -1)], [0]
    places: dict[str, list[int]] = defaultdict(list)  # of open elements, by tag
    endless: set[str] = set()
    line: list[str] = []
    links = linked = at = 0
    muted: tuple[str, int] | None = None  # part of a form, and how many elements were open around it

    def end_block():
        nonlocal linked
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if text:
            add(Node("#text", open_[-1], text=text, linked=min(linked, len(text))))
        linked = 0

    def add(node: Node) -> int:
        nodes.append(node)
        nodes[node.parent].children.append(len(nodes) - 1)
        return len(nodes) - 1

    def say(text: str):
        nonlocal linked
        if muted:
            return
        line.append(text)
        if links:
            linked += len(text)

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def cut(to: int):
        """Only the first ``to`` elements stay open."""
        nonlocal muted
        while len(open_) > to:
            places[nodes[open_.pop()].tag].pop()
        if muted and to < muted[1]:
            muted = None

    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at: m.start()])
        at = m.end()
        close, tag, attrs = m[1], m[2], m[3]
        if close:
            close = close.lower()
            if close in FORM:
                if muted and muted[0] == close:
                    muted = None
            elif close in INLINE:
                if close == "a":
                    links = max(0, links - 1)
            elif places.get(close):
                end_block()
                links = 0
                cut(places[close][-1])
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW or tag in HIDDEN and tag != "head":
            line.append(" ")
            if not attrs.endswith("/"):
                done = None if tag in endless else END[tag].search(page, at)
                if done:
                    at = done.end()
                else:
                    endless.add(tag)
                    at = len(page) if tag in RAW else at
            continue
        if tag == "br":
            line.append(" ")
            continue
        if tag in FORM:
            line.append(" ")
            if not muted and not attrs.endswith("/"):
                muted = (tag, len(open_))
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        if tag in ENDS_P and places["p"]:
            # a paragraph still open ends here, with what was opened inside it
            end_block()
            cut(places["p"][-1])
        end_block()
        links = 0
        if tag in ENDS_SELF:
            own = last(ENDS_SELF[tag])
            if own > last(STOP.get(tag, ())):
                cut(own)
        if tag in VOID or tag == "html":
            continue
        if tag == "body" and places["head"]:
            cut(places["head"][0])
        words = []
        for k, v in ATTR.findall(attrs):
            k, v = k.lower(), v.strip("\"'").lower()
            if k in ("class", "id", "role"):
                words += [w for w in re.split(r"[^a-z]+", v) if w]
            elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*:\s*none", v):
                words.append("#hidden")
        places[tag].append(len(open_))
        open_.append(add(Node(tag, open_[-1], tuple(dict.fromkeys(words)), top=nodes[open_[-1]].tag == "body")))
    end_block()
    return nodes


def features(nodes: list[Node]) -> list[list[str]]:
    """What is seen of each node, as names; sums over what lies below come in one pass from the leaves."""
    size, linked, blocks = ([0] * len(nodes) for _ in range(3))
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if n.text is not None:
            size[i], linked[i], blocks[i] = len(n.text), n.linked, 1
        if n.parent >= 0:
            size[n.parent] += size[i]
            linked[n.parent] += linked[i]
            blocks[n.parent] += blocks[i]
    out = []
    for i, n in enumerate(nodes):
        share = linked[i] / size[i] if size[i] else 0
        f = [f"word={w}" for w in n.words]
        if n.tag not in PARTS:
            f.append(f"tag={n.tag}")
            # the links of a list's items are seen once, at the list: many items do not decide alone
            if not linked[i] or n.text is None or nodes[n.parent].tag not in PARTS:
                f.append("links=" + ("none" if not linked[i] else "some" if share < 0.5 else "most"))
        if n.text is not None:
            f.append(f"length={min(6, int(math.log2(1 + len(n.text) / 12)))}")
            f.append("symbol" if re.match(r"[©®]", n.text) else "plain")
        out.append(f)
    return out


def log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


class Model:
    """Log potentials: of what is seen for each label, and of parent and child labels by the child's kind."""

    def __init__(self, pages: list[tuple[str, list[int]]], smooth: float = 0.02):
        """``pages``: html and the label (1 content) of every node of its tree."""
        seen, joint, start = defaultdict(lambda: np.full(2, smooth)), defaultdict(lambda: np.full((2, 2), smooth)), np.full(2, smooth)
        n_label = np.zeros(2)
        for page, labels in pages:
            nodes = parse(page)
            for i, (n, f) in enumerate(zip(nodes, features(nodes))):
                y = labels[i]
                n_label[y] += 1
                for name in f:
                    seen[name][y] += 1
                if n.parent < 0:
                    start[y] += 1
                else:
                    joint[self.kind(n)][labels[n.parent], y] += 1
        for name, v in seen.items():
            if name.startswith("tag="):  # a tag seen with one label only must not decide alone
                v += RARE * v.sum() * n_label / n_label.sum()
        self.own = {k: np.log(v / (n_label + 2 * smooth)) for k, v in seen.items()}
        self.pair = {k: np.log(v / v.sum(axis=1, keepdims=True)) for k, v in joint.items()}
        self.other = np.log(sum(np.exp(v) for v in self.pair.values()) / max(1, len(self.pair)))
        self.start = np.log(start / start.sum())

    @staticmethod
    def kind(n: Node) -> str:
        if n.text is not None:
            return "text"
        if n.words and n.tag not in PLAIN:
            return "named"
        return f"{n.tag} at the top" if n.top and n.tag in ("ul", "ol", "header") else n.tag

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """Probability of content for each node, by messages up and down the tree."""
        own = {k: v.tolist() for k, v in self.own.items()}
        pair = {k: v.ravel().tolist() for k, v in self.pair.items()}
        other = np.ravel(self.other).tolist()
        n = len(nodes)
        total = []
        for f in features(nodes):
            known = [own[name] for name in f if name in own]  # unseen words say nothing
            total.append((sum(v[0] for v in known), sum(v[1] for v in known)))
        total[0] = total[0][0] + float(self.start[0]), total[0][1] + float(self.start[1])
        links = [pair.get(self.kind(x), other) for x in nodes]
        up = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):  # children stand after their parents
            (a, b, c, d), (u, v), above = links[i], total[i], nodes[i].parent
            up[i] = x, y = log_sum(a + u, b + v), log_sum(c + u, d + v)
            total[above] = total[above][0] + x, total[above][1] + y
        for i in range(1, n):
            (a, b, c, d), (u, v), (x, y), (s, t) = links[i], total[i], up[i], total[nodes[i].parent]
            total[i] = u + log_sum(a + s - x, c + t - y), v + log_sum(b + s - x, d + t - y)
        return np.array([1 / (1 + math.exp(min(700.0, u - v))) for u, v in total])

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        p = self.marginals(nodes)
        return "\n".join(n.text for n, q in zip(nodes, p) if n.text is not None and q > 0.5)


def labelled_pages(n: int = 400, seed: int = 17) -> list[tuple[str, list[int]]]:
    """Pages in seeded layouts with the label of every node; invented words."""
    out = []
    for k in range(n):
        page, marks = _layout(random.Random(seed * 100_003 + k))
        nodes = parse(page)
        labels = [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            x = nodes[i]
            if x.text is not None:
                labels[i] = int(any(w.strip(".") in marks for w in x.text.split()))
            elif x.children:  # an element is content if content lies in it and outweighs the rest
                inside = sum(len(nodes[c].text or "xx") * (1 if labels[c] else -1) for c in x.children)
                labels[i] = int(any(labels[c] for c in x.children) and (inside > 0 or x.tag in ("root", "body")))
        out.append((page, labels))
    return out


#: Names pages give to their parts, in the layouts that teach the model.
CONTENT_NAMES = ["content", "main content", "article", "post", "entry content", "article body", "story", "post content", "text", "main"]
MENU_NAMES = ["nav", "menu", "navbar", "navigation", "breadcrumb", "top menu", "main nav", "pagination", "tabs", "toc links"]
SIDE_NAMES = ["sidebar", "aside", "related", "widget", "recommended", "side", "popular posts", "tags", "more stories"]
AD_NAMES = ["ad", "ads", "advert", "banner", "sponsored", "promo", "ad slot", "advertisement", "sponsor"]
NOTICE_NAMES = ["cookie notice", "cookie banner", "consent", "notice", "newsletter signup", "popup", "modal", "alert", "gdpr", "subscribe", "paywall"]
HEADER_NAMES = ["header", "site header", "masthead", "logo", "top bar", "page header"]
FOOTER_NAMES = ["footer", "site footer", "copyright", "legal", "bottom", "colophon"]
COMMENT_NAMES = ["comments", "comment list", "reader comments", "discussion", "replies", "comment", "responses"]
SHARE_NAMES = ["share", "social", "share buttons", "social links", "byline share"]
#: Names of single parts, in articles and beside them.
PART_NAMES = ["title", "heading", "section title", "lead", "intro", "caption", "figure", "block", "text", "note", "list"]
HEADINGS = ("h2", "h2", "h3", "h3", "h4", "h5", "h6")
SYLLABLES = "ka to mi ren sol ta vek lu pra ni do shi mar el un be gor ti la zem".split()


def _layout(r: random.Random) -> tuple[str, set[str]]:
    marks: set[str] = set()

    def word(content: bool = False) -> str:
        w = "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
        if content:
            w = w + "q"  # content words are told apart by their ending
            marks.add(w)
        return w

    def words(n: int, content: bool = False) -> str:
        return " ".join(word(content) for _ in range(n)) + r.choice(["", ".", ".", " ."])

    def link(n: int = 2) -> str:
        return f'<a href="/{word()}">{words(n)}</a>'

    def named(names: list[str], inner: str, tags: tuple[str, ...] = ("div", "div", "section")) -> str:
        name = r.choice(names)
        name = r.choice(["-", "_", " "]).join(name.split())
        tag = r.choice(tags)
        return f'<{tag} {r.choice(["class", "class", "id"])}="{name}">{inner}</{tag}>'

    def source() -> str:
        return f'<a href="/{word()}">{words(r.randint(1, 4), True)}</a>' + (f" {words(r.randint(1, 6), True)}" if r.random() < 0.2 else "")

    def items(n: int, of) -> str:
        tag = r.choice(["ul", "ul", "ul", "ol"])
        return f"<{tag}>" + "".join(f"<li>{of()}</li>" for _ in range(n)) + f"</{tag}>"

    def heading(level: str, inner: str) -> str:
        if r.random() < 0.25:
            return named(PART_NAMES + [word()], inner, (level,))
        return f"<{level}>{inner}</{level}>"

    def prose(n: int, depth: int = 0) -> str:
        out = []
        for _ in range(n):
            long = r.choice([1, 2, 4, 12, 30, 60, 120])
            body = words(long, True)
            if r.random() < 0.2:
                body += f" <a href='/{word()}'>{words(2, True)}</a> " + words(3, True)
            if r.random() < 0.2:
                body = f"<b>{body}</b>" if r.random() < 0.5 else f"<b>{body}<br>"
            kind = r.random()
            if kind < 0.56:
                out.append(f"<p>{body}" + ("</p>" if r.random() < 0.85 else ""))
            elif kind < 0.59:
                out.append(named(PART_NAMES + [word()], body, ("p", "p", "div")))
            elif kind < 0.62:  # a list of sources belongs to the article
                out.append((heading(r.choice(HEADINGS), words(r.randint(1, 3), True)) if r.random() < 0.5 else "") + items(r.randint(1, 8), source))
            elif kind < 0.69:
                out.append(items(r.randint(1, 5), lambda: words(r.randint(1, 12), True) + (
                    items(2, lambda: words(r.randint(1, 4), True)) if r.random() < 0.05 else "")))
            elif kind < 0.73:
                out.append(f"<blockquote><p>{body}</p></blockquote>")
            elif kind < 0.85:
                out.append(heading(r.choice(HEADINGS), words(r.randint(1, 8), True)))
            elif kind < 0.88:
                cell = r.choice(["td", "td", "th"])
                rows = "".join(f"<tr><{cell}>{words(1, True)}</{cell}><td>{words(2, True)}</td></tr>" for _ in range(3))
                out.append("<table>" + r.choice(["", "", f"<caption>{words(3, True)}</caption>"]) + rows + "</table>")
            elif kind < 0.905:
                out.append("<dl>" + "".join(f"<dt>{words(r.randint(1, 3), True)}</dt><dd>{words(r.randint(1, 15), True)}</dd>"
                                            for _ in range(r.randint(1, 4))) + "</dl>")
            elif kind < 0.935:
                inner = f"<img src=x><figcaption>{words(r.randint(2, 12), True)}</figcaption>"
                out.append(f"<figure>{inner}</figure>" if r.random() < 0.7 else named(PART_NAMES + [word()], inner, ("figure",)))
            elif kind < 0.96 and depth < 2:
                inner = heading(r.choice(HEADINGS), words(3, True)) + prose(r.randint(1, 3), depth + 1)
                out.append(f"<section>{inner}</section>" if r.random() < 0.7 else named(PART_NAMES + [word()], inner, ("section",)))
            else:
                out.append(f"<pre>{words(8, True)}</pre>" if r.random() < 0.5 else f"<div>{body}</div>")
        return "".join(out)

    parts = []
    menu = items(r.randint(3, 8), link)
    parts.append(r.choice([lambda: f"<nav>{menu}</nav>", lambda: f"<nav>{menu}</nav>", lambda: menu, lambda: named(MENU_NAMES, menu), lambda: f"<header>{link(1)}<nav>{menu}</nav></header>",
                           lambda: named(HEADER_NAMES, f"<h1>{words(2)}</h1><p>{words(5)}</p>{menu}", ("div", "header"))])())
    if r.random() < 0.4:
        parts.append(r.choice([f"<header><p>{words(4)}</p></header>", named(HEADER_NAMES, f"<p>{words(4)}</p>", ("div", "header"))]))

    def advert() -> str:
        return named(AD_NAMES, r.choice([words(r.randint(3, 14)), f"<p>{words(r.randint(3, 20))}</p>", link(4),
                                        f"<figure><img src=x><figcaption>{words(r.randint(2, 8))}</figcaption></figure>"]), ("div", "div", "aside", "section"))

    def notice() -> str:
        return named(NOTICE_NAMES, r.choice([words(12), f"<p>{words(r.randint(6, 30))}</p>" + "<button>ok</button>", f"<p>{words(8)} {link(2)}</p>"]),
                     ("div", "div", "section", "aside", "dialog"))

    def form() -> str:
        return f"<form><p>{words(3)}</p><label>{words(2)}</label><input name=q><button>{word()}</button></form>"

    def comments() -> str:
        one = lambda: r.choice([f"<p>{words(r.randint(2, 40))}</p>", f"<blockquote><p>{words(r.randint(2, 20))}</p></blockquote>", f'<div class="comment"><p>{words(2)}</p><p>{words(r.randint(4, 50))}</p></div>'])
        return named(COMMENT_NAMES, heading(r.choice(HEADINGS), words(2)) + "".join(one() for _ in range(r.randint(1, 6))) + (form() if r.random() < 0.4 else ""),
                     ("div", "div", "section", "ol", "ul"))

    def side() -> str:
        inner = heading(r.choice(HEADINGS), words(2)) + r.choice([items(r.randint(2, 6), link), f"<p>{words(r.randint(4, 30))}</p>", items(3, lambda: words(5)),
                                                                   "<table>" + "".join(f"<tr><td>{words(1)}</td><td>{words(2)}</td></tr>" for _ in range(r.randint(2, 7))) + "</table>",
                                                                   "<dl>" + "".join(f"<dt>{words(1)}</dt><dd>{words(3)}</dd>" for _ in range(r.randint(1, 4))) + "</dl>"])
        return r.choice([f"<aside>{inner}</aside>", named(SIDE_NAMES, inner, ("div", "aside", "section"))])

    for make, chance in ((advert, 0.6), (notice, 0.3), (side, 0.2), (form, 0.1)):
        if r.random() < chance:
            parts.append(make())
    article = f"<h1>{words(r.randint(2, 9), True)}</h1>" if r.random() < 0.85 else ""
    if article and r.random() < 0.4:
        article = f"<header>{article}" + (f"<p>{words(r.randint(3, 20), True)}</p>" if r.random() < 0.5 else "") + "</header>"
    article += prose(r.randint(1, 14))
    for make, chance in ((advert, 0.25), (side, 0.1), (notice, 0.1), (lambda: named(SHARE_NAMES, items(3, lambda: link(1))), 0.2)):
        if r.random() < chance:
            article += make() + (prose(r.randint(1, 4)) if r.random() < 0.6 else "")
    body = r.choice([
        lambda: f"<article>{article}</article>", lambda: f"<article>{article}</article>", lambda: f"<main>{article}</main>",
        lambda: f"<main><article>{article}</article></main>", lambda: named(CONTENT_NAMES, article), lambda: named(CONTENT_NAMES, article),
        lambda: f'<div class="container">{named(CONTENT_NAMES, article)}</div>', lambda: f"<article>{named(CONTENT_NAMES, article)}</article>",
        lambda: f"<div><div>{article}</div></div>", lambda: f"<section>{article}</section>"])()
    if r.random() < 0.03:
        body = ""  # a page without an article
    if r.random() < 0.25:  # comments inside the main part
        body = body.replace("</main>", comments() + "</main>") if "</main>" in body else body
    parts.append(body)
    for make, chance in ((comments, 0.35), (side, 0.35), (advert, 0.25), (form, 0.15), (notice, 0.2)):
        if r.random() < chance:
            parts.append(make())
    foot = r.choice([f"&copy; {words(r.randint(2, 14))}", f"<p>{words(6)}</p>", items(3, link), f"&copy; {words(2)} &middot; {words(9)}"])
    parts.append(r.choice([f"<footer>{foot}</footer>", named(FOOTER_NAMES, foot, ("div", "footer"))]))
    return f"<!DOCTYPE html><html><head><title>{words(4)}</title></head><body>{''.join(parts)}</body></html>", marks


def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html") -> DataFrame:
    """(row, text) for each page."""
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model or Model(labelled_pages()))

    @F.pandas_udf("string")
    def main_text(column: pd.Series) -> pd.Series:
        return column.map(sent.value.extract)

    return packed(pages).withColumn("text", main_text(F.coalesce(F.col("row").getField(html_col), F.lit(""))))
