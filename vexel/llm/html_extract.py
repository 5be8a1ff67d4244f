"""HTML extraction: gradient-boosted trees over DOM nodes, decoded along the tree.

A page is parsed into its block elements; text that stands beside block children gets an anonymous block of its own.
Each block has features of its subtree (text, link and tag density), its attribute tokens and those of its ancestors,
its depth, its place and its siblings. Boosted trees give each block the probability that it holds main text. The
decoding keeps the most probable set of blocks in which every kept block's ancestors are kept too, so a paragraph can't
be kept inside a dropped sidebar.

The trees are trained on pages from a generator of layouts (`training_pages`), in which each block is known to be main
text or not; word lengths and link texts are random, so only structure, attributes and densities can be learnt.

What is inside scripts, styles, forms' controls, templates, frames and the head is dropped by name; the words of any other
element (math, svg, label, noscript, object, ...) belong to the block that they stand in. Character references are decoded, white space inside a block becomes one space, blocks are joined by one newline in page order; br is white
space. Defined results: null or empty html, or a page without main text, gives an empty text; unclosed and misnested
tags are repaired as browsers do for the common cases; repeated rows are extracted alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Elements by their role in HTML.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = set("script style template iframe head title button select option optgroup datalist textarea input".split())
RAW = set("script style textarea title iframe".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
KEEPS_P = set("html body td th tbody thead tfoot tr".split())
#: What a start tag closes, up to the listed boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*>", re.S)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
KNOWN = re.compile(r'data-main="(\d)"')

#: Attribute tokens by what they tell.
HINTS = {
    "main": "article articlebody body content entry hentry main maincontent post story text".split(),
    "nav": "breadcrumb breadcrumbs crumb menu menubar nav navbar navigation pager pagination tabs toc topnav".split(),
    "header": "banner branding header logo masthead site top topbar toolbar".split(),
    "footer": "bottom colophon contentinfo copyright credits foot footer imprint legal".split(),
    "side": "aside complementary popular recommended related rail secondary sidebar side trending widget widgets".split(),
    "ad": "ad ads advert advertisement adslot adsense dfp promo promoted sponsor sponsored outbrain taboola".split(),
    "notice": "alert alertdialog banner consent cookie cookies disclaimer gdpr modal newsletter notice notification overlay paywall popup signup subscribe toast warning".split(),
    "comment": "comment commentlist comments discussion disqus replies reply respond responses thread reader".split(),
    "form": "button buttons form login register search searchbox share sharing social".split(),
}
HINT_NAMES = list(HINTS)
HINT_OF: dict[str, list[int]] = {}
for _i, _k in enumerate(HINT_NAMES):
    for _w in HINTS[_k]:
        HINT_OF.setdefault(_w, []).append(_i)
TAG_GROUPS = [{"article", "main"}, {"nav", "menu"}, {"header", "hgroup"}, {"footer", "address"}, {"aside"}, {"form", "fieldset", "legend", "search", "dialog"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dd", "dt"}, {"div", "section", "center"}, {"table", "tr", "td", "th", "tbody", "thead"}, {"blockquote", "pre", "figure", "figcaption"}, {""}, {"body", "html"}]
GROUP_OF = {t: i for i, g in enumerate(TAG_GROUPS) for t in g}
UP_GROUPS = range(6)


@dataclass(slots=True)
class Node:
    tag: str
    attrs: str
    up: int
    depth: int
    kids: list[int]
    text: list[str]
    links: int = 0
    link_chars: int = 0
    breaks: int = 0


def parse(page: str) -> list[Node]:
    """Block nodes in page order; node 0 is the root."""
    nodes = [Node("html", "", -1, 0, [], [])]
    stack, block, link, dropped, at = [0], 0, False, [], 0  # block: the node that gets text

    def add(tag: str, attrs: str) -> int:
        up = stack[-1]
        nodes.append(Node(tag, attrs, up, nodes[up].depth + 1, [], []))
        nodes[up].kids.append(len(nodes) - 1)
        return len(nodes) - 1

    def put(piece: str) -> None:
        nonlocal block
        if dropped or not piece:
            return
        if block < 0:
            if piece.isspace():
                return
            block = add("", "")
        nodes[block].text.append(piece)
        if link:
            nodes[block].link_chars += len(piece.strip())

    def close(names: set[str], stop: set[str]) -> None:
        """Ends the open blocks up to the outermost of `names` that is inside of `stop`."""
        nonlocal block
        for i in range(len(stack) - 1, 0, -1):
            t = nodes[stack[i]].tag
            if t in stop:
                return
            if t in names:
                del stack[i:]
                block = -1
                return

    while m := TOKEN.search(page, at):
        put(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, end, attrs = tag.lower(), m[1] or m[4], m[3] or ""
        if end:
            if dropped:
                if tag in dropped:
                    del dropped[dropped.index(tag) :]
                elif tag in BLOCKS:  # a control that was left open
                    dropped.clear()
                else:
                    continue
            if tag in BLOCKS and tag not in ("html", "body"):
                close({tag}, {"td", "th"} - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {tag})
            elif tag == "a":
                link = False
            continue
        if tag in DROPPED:
            if tag in RAW:
                found = re.compile(f"</{tag}", re.I).search(page, at)
                at = len(page) if not found else (page.find(">", found.end()) + 1 or len(page))
                put(" ")
            elif tag not in VOID and not attrs.endswith("/"):
                dropped.append(tag)
            continue
        if dropped:
            if dropped == ["head"] and tag in BLOCKS:
                dropped.clear()
            else:
                continue
        if tag == "a":
            link = True
            if block >= 0:
                nodes[block].links += 1
            else:
                block = add("", "")
                nodes[block].links += 1
        elif tag == "br":
            put(" ")
            if block >= 0:
                nodes[block].breaks += 1
        elif tag in BLOCKS:
            if tag in ("html", "body"):
                nodes[0].attrs += " " + attrs
                continue
            if tag not in KEEPS_P:
                close({"p"}, {"td", "th", "table"})
            if tag in CLOSES:
                close(*CLOSES[tag])
            link = False
            if tag == "hr":
                block = -1
                continue
            if block == stack[-1] and nodes[block].text and "".join(nodes[block].text).strip():  # text before a block child
                own = nodes[block]
                anonymous = add("", "")
                nodes[anonymous].text, nodes[anonymous].links, nodes[anonymous].link_chars = own.text, own.links, own.link_chars
                own.text, own.links, own.link_chars = [], 0, 0
            elif block == stack[-1]:
                nodes[block].text = []
            new = add(tag, attrs)
            stack.append(new)
            block = new
        elif tag == "img":
            put(" ")
    put(page[at:])
    return nodes


def block_text(n: Node) -> str:
    return " ".join(html.unescape("".join(n.text)).split())


def hints_of(attrs: str) -> list[int]:
    out = [0] * len(HINTS)
    for m in NAMED.finditer(attrs):
        for w in PART.findall(m[1]):
            for i in HINT_OF.get(w.lower(), ()):
                out[i] = 1
    return out


def features(nodes: list[Node], texts: list[str]) -> np.ndarray:
    """A row for each node."""
    n, h, g = len(nodes), len(HINTS), len(TAG_GROUPS)
    own = np.array([hints_of(x.attrs) if x.attrs else [0] * h for x in nodes], dtype=np.float32).reshape(n, h)
    group = np.zeros((n, g), dtype=np.float32)
    group[np.arange(n), [GROUP_OF.get(x.tag, 10) for x in nodes]] = 1
    up = np.array([x.up for x in nodes])
    chars = np.array([len(t) for t in texts], dtype=np.float64)
    stats = np.stack([chars, [x.link_chars for x in nodes], [x.links for x in nodes], [t.count(",") + t.count(".") for t in texts], [t.count(" ") + 1 if t else 0 for t in texts], np.ones(n), [x.tag == "p" for x in nodes]], axis=1).astype(np.float64)
    above = np.zeros((n, h + len(UP_GROUPS)), dtype=np.float32)
    for i in range(1, n):  # parents stand before their children
        above[i] = np.maximum(above[up[i]], np.concatenate([own[up[i]], group[up[i], :6]]))
    sub = stats.copy()
    for i in range(n - 1, 0, -1):
        sub[up[i]] += sub[i]
    total = max(1.0, sub[0, 0])
    before = np.concatenate([[0], np.cumsum(chars)[:-1]])
    kids = np.array([len(x.kids) for x in nodes])
    sums, counts = np.zeros(n), kids.astype(np.float64)
    np.add.at(sums, up[1:], sub[1:, 0])
    tags = Counter((x.up, x.tag) for x in nodes)
    same = np.array([tags[x.up, x.tag] for x in nodes], dtype=np.float64)
    same[0] = 0
    place = np.zeros(n)
    for x in nodes:
        for j, k in enumerate(x.kids):
            place[k] = j / max(1, len(x.kids) - 1)
    up0 = np.maximum(up, 0)
    mean_sibling = (sums[up0] - sub[:, 0]) / np.maximum(1, counts[up0] - 1)
    text = np.maximum(1.0, sub[:, 0])
    dense = np.stack([
        np.minimum(12, [x.depth for x in nodes]), np.log1p(sub[:, 0]), sub[:, 1] / text, np.minimum(50, sub[:, 2]), sub[:, 5] * 100 / text, sub[:, 3] * 100 / text,
        text / np.maximum(1, sub[:, 4]), sub[:, 6] / sub[:, 5], sub[:, 0] / total, before / total, np.minimum(30, counts[up0]), np.minimum(30, same), place,
        np.log1p(np.maximum(0, mean_sibling)), np.minimum(30, kids), np.log1p(chars), np.full(n, np.log1p(total)),
    ], axis=1)
    return np.hstack([group, own, above, dense]).astype(np.float32)


class Trees:
    """Boosted regression trees of fixed depth for the logistic loss."""

    def __init__(self, depth: int = 4, rounds: int = 80, rate: float = 0.2, bins: int = 32):
        self.depth, self.rounds, self.rate, self.bins = depth, rounds, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        inner = 2**self.depth - 1
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        self.feature, self.cut, self.value = np.zeros((self.rounds, inner), int), np.full((self.rounds, inner), np.inf, np.float32), np.zeros((self.rounds, inner + 1))
        f = np.full(len(y), self.base)
        for r in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            grad, hess, at = y - p, p * (1 - p), np.zeros(len(y), int)
            for level in range(self.depth):
                width, first = 2**level, 2**level - 1
                best = np.full(width, 1e-6)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = (at - first) * self.bins + code[:, j]
                    gs = np.bincount(key, weights=grad, minlength=width * self.bins).reshape(width, self.bins).cumsum(axis=1)
                    hs = np.bincount(key, weights=hess, minlength=width * self.bins).reshape(width, self.bins).cumsum(axis=1)
                    gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                    gain = gain[:, : len(e)]
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(width), k] > best
                    best = np.where(better, gain[np.arange(width), k], best)
                    self.feature[r, first : first + width] = np.where(better, j, self.feature[r, first : first + width])
                    self.cut[r, first : first + width] = np.where(better, e[k], self.cut[r, first : first + width])
                at = 2 * at + 1 + (x[np.arange(len(y)), self.feature[r, at]] > self.cut[r, at])
            leaf = at - inner
            g, h = np.bincount(leaf, weights=grad, minlength=inner + 1), np.bincount(leaf, weights=hess, minlength=inner + 1)
            self.value[r] = self.rate * g / (h + 1)
            f += self.value[r][leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), 2**self.depth - 1
        for r in range(self.rounds):
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[r, at]] > self.cut[r, at])
            out += self.value[r][at - inner]
        return out


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the likeliest choice in which the ancestors of kept nodes are kept."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    keep, drop = yes.copy(), no.copy()
    for i in range(len(nodes) - 1, 0, -1):
        keep[nodes[i].up] += max(keep[i], drop[i])
        drop[nodes[i].up] += drop[i]
    out = np.zeros(len(nodes), dtype=bool)
    out[0] = True  # the root holds no text of its own
    for i in range(1, len(nodes)):
        out[i] = out[nodes[i].up] and keep[i] >= drop[i]
    return out


def main_text(nodes: list[Node], texts: list[str], odds: np.ndarray) -> str:
    kept = decode(nodes, odds)
    order: list[str] = []
    todo = [0]
    while todo:
        i = todo.pop()
        if kept[i]:
            if texts[i]:
                order.append(texts[i])
            todo.extend(reversed(nodes[i].kids))
    return "\n".join(order)


# --- training pages ---


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvwé") for _ in range(r.randint(1, 12))) + (r.choice([",", ".", ".", ""]) if r.random() < 0.25 else "") for _ in range(n)).capitalize()


def _name(r: random.Random, kind: str, odds: float) -> str:
    """class or id attribute with a token of that kind, often with another word, or none."""
    if r.random() > odds:
        return r.choice(["", "", f' class="{r.choice(["row", "col", "box", "wrap", "c1", "x-2", "inner"])}"'])
    token = r.choice(HINTS[kind])
    token = r.choice([token, token, f"{token}-{r.choice(['box', 'wrap', 'item', 'list', 'inner', '1'])}", f"{r.choice(['page', 'site', 'the', 'js'])}-{token}", f"{r.choice(['page', 'site'])}{token.capitalize()}"])
    return f' {r.choice(["class", "class", "id"])}="{token}"'


def _links(r: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{_words(r, r.randint(1, 5))}</a></li>' for i in range(n))


def _extra(r: random.Random, kind: str) -> str:
    """One piece that isn't main text."""
    y, a = ' data-main="0"', _name(r, kind, 0.8)
    if kind == "nav":
        tag = r.choice(["nav", "nav", "div", "ul"])
        return f"<{tag}{y}{a}>{_links(r, r.randint(2, 12)) if tag == 'ul' else '<ul>' + _links(r, r.randint(2, 12)) + '</ul>'}</{tag}>" if r.random() < 0.8 else f"<{'nav' if tag == 'ul' else tag}{y}{a}>" + " | ".join(f'<a href="#">{_words(r, 1)}</a>' for _ in range(r.randint(2, 8))) + f"</{'nav' if tag == 'ul' else tag}>"
    if kind == "header":
        tag = r.choice(["header", "header", "div"])
        return f"<{tag}{y}{a if tag == 'header' else _name(r, kind, 1)}>{r.choice(['<h1>', '<p>', '<div>'])}{_words(r, r.randint(1, 6))}{r.choice(['', '<p>' + _words(r, r.randint(2, 10))])}</{tag}>"
    if kind == "footer":
        tag = r.choice(["footer", "footer", "div"])
        return f"<{tag}{y}{a if tag == 'footer' else _name(r, kind, 1)}>{r.choice(['&copy; ', '', '<p>'])}{_words(r, r.randint(3, 40))}{r.choice(['', '<a href=/x>' + _words(r, 2) + '</a>'])}</{tag}>"
    if kind == "side":
        tag = r.choice(["aside", "aside", "div", "section"])
        return f"<{tag}{y}{a if tag == 'aside' else _name(r, kind, 1)}>{r.choice(['<h3>' + _words(r, 2) + '</h3>', ''])}{r.choice(['<ul>' + _links(r, r.randint(2, 8)) + '</ul>', '<p>' + _words(r, r.randint(5, 60)) + '</p>', '<p>' + _words(r, 30) + '</p><p>' + _words(r, 20) + '</p>'])}</{tag}>"
    if kind in ("ad", "notice"):
        tag = r.choice(["div", "div", "p", "section", "aside"])
        inner = _words(r, r.randint(2, 50))
        return f"<{tag}{y}{_name(r, kind, 1)}{r.choice(['', '', ' style=margin:0'])}>{inner if tag == 'p' or r.random() < 0.6 else '<p>' + inner + '</p>'}</{tag}>"
    if kind == "comment":
        tag = r.choice(["div", "section", "ol", "ul", "article", "aside"])
        item = {"ol": "li", "ul": "li"}.get(tag, r.choice(["div", "p", "article"]))
        named = _name(r, kind, 0.5)
        items = "".join(f"<{item}{named}>{r.choice(['', '<b>' + _words(r, 1) + '</b> '])}{_words(r, r.randint(3, 70))}</{item}>" for _ in range(r.randint(1, 6)))
        return f"<{tag}{y}{_name(r, kind, 1)}>{r.choice(['', '<h3>' + _words(r, 2) + '</h3>' if item != 'li' else ''])}{items}</{tag}>"
    return f'<form{y}{a}><p>{_words(r, r.randint(1, 20))}</p><div>{_words(r, r.randint(1, 6))}</div><input type="text"></form>'


def _main(r: random.Random) -> list[str]:
    out = [f"<h1>{_words(r, r.randint(2, 10))}</h1>"] if r.random() < 0.8 else []
    para = r.choice(["p", "p", "p", "p", "div"])
    for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12])):
        kind = r.random()
        words = r.choice([r.randint(1, 6), r.randint(5, 40), r.randint(20, 120)])
        if kind < 0.72:
            inner = _words(r, words)
            inner += r.choice(["", "", f' <a href="/y">{_words(r, 2)}</a>', f"<br>{_words(r, 5)}", f" <b>{_words(r, 2)}</b> {_words(r, 3)}"])
            out.append(f"<{para}>{r.choice(['', '', '<b>'])}{inner}{r.choice(['</' + para + '>', '</' + para + '>', ''])}" if para == "p" else f"<div>{inner}</div>")
        elif kind < 0.8:
            out.append(f"<h2>{_words(r, r.randint(1, 8))}</h2>")
        elif kind < 0.88:
            out.append("<ul>" + "".join(f"<li>{_words(r, r.randint(2, 25))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif kind < 0.93:
            out.append(f"<blockquote>{r.choice(['', '<p>'])}{_words(r, words)}</blockquote>")
        elif kind < 0.96:
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{_words(r, 2)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
        else:
            out.append(f"<pre>{_words(r, 8)}</pre>" if r.random() < 0.5 else f"<section><h3>{_words(r, 3)}</h3><p>{_words(r, words)}</p></section>")
    return out


def training_page(r: random.Random) -> str:
    def extras(kinds: list[str], odds: float) -> str:
        return "".join(_extra(r, k) for k in kinds if r.random() < odds)

    parts = _main(r)
    for k in ("ad", "notice", "nav", "side", "form"):
        if r.random() < 0.15:
            parts.insert(r.randint(1, len(parts)), _extra(r, k))
    if r.random() < 0.2:
        parts.append(_extra(r, "comment"))
    if r.random() < 0.15:
        parts.insert(0, f'<header data-main="0">{_words(r, 4)}</header>' if r.random() < 0.5 else f'<div data-main="0"{_name(r, "form", 1)}>{_words(r, 3)}</div>')
    if r.random() < 0.1:
        parts.append(f'<footer data-main="0">{_words(r, r.randint(2, 12))}</footer>')
    tag = r.choice(["article", "article", "article", "main", "div", "section"])
    core = f'<{tag} data-main="1"{_name(r, "main", 0.4 if tag in ("article", "main") else 1)}>{"".join(parts)}</{tag}>'
    if r.random() < 0.3:
        core = f'<{r.choice(["main", "div"])}{_name(r, "main", 0.6)}>{core}{extras(["side", "comment", "ad"], 0.2)}</div>'
    top, low = extras(r.sample(["notice", "header", "nav", "ad", "form"], 5), 0.45), extras(r.sample(["comment", "side", "nav", "footer", "ad", "form", "notice"], 7), 0.35)
    if r.random() < 0.3:
        core = f'<div{_name(r, "side", 0)}>{extras(["side", "nav"], 0.3)}{core}{extras(["side", "ad"], 0.4)}</div>'
    return f"<html><head><title>x</title></head><body>{top}{core}{low}</body></html>"


def labels_of(nodes: list[Node]) -> np.ndarray:
    """1: main text, or a block around some."""
    out = np.zeros(len(nodes))
    inherited = np.zeros(len(nodes))
    for i, x in enumerate(nodes):
        m = KNOWN.search(x.attrs)
        inherited[i] = float(m[1]) if m else (inherited[x.up] if x.up >= 0 else 0)
    out[:] = inherited
    for i in range(len(nodes) - 1, 0, -1):
        out[nodes[i].up] = max(out[nodes[i].up], out[i])
    return out


@cache
def train(pages: int = 1000, seed: int = 11) -> Trees:
    """Trees fitted on so many generated pages; once a session."""
    r, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        nodes = parse(training_page(r))
        xs.append(features(nodes, [block_text(n) for n in nodes])[1:])
        ys.append(labels_of(nodes)[1:])
    return Trees().fit(np.vstack(xs), np.concatenate(ys))


def extract_all(pages: list[str | None], trees: Trees) -> list[str]:
    parsed = [parse(p) if p else [] for p in pages]
    texts = [[block_text(n) for n in nodes] for nodes in parsed]
    full = [i for i, nodes in enumerate(parsed) if nodes]
    if not full:
        return [""] * len(pages)
    odds = trees.log_odds(np.vstack([features(parsed[i], texts[i]) for i in full]))
    out, at = [""] * len(pages), 0
    for i in full:
        out[i] = main_text(parsed[i], texts[i], odds[at : at + len(parsed[i])])
        at += len(parsed[i])
    return out


def extract(pages: DataFrame, trees: Trees | None = None, step: int = 64) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages."""
    sent = pages.sparkSession.sparkContext.broadcast(trees or train())  # a few thousand numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t for at in range(0, len(b), step) for t in extract_all(b["html"].iloc[at : at + step].tolist(), sent.value)]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    narrow = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    return narrow.mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
