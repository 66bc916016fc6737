"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A tolerant parser makes a tree of each page (void and raw elements, implied end tags, stray end tags), in time linear in its length.  Every
block element, and every other element with a class, id or role, has features: text and link density of its subtree,
tags in it, depth, place among its siblings and share of their text, attribute and tag tokens of its own and of its
ancestors.  Boosted trees give each the log-odds of belonging to the article.  The decoder keeps the set
of nodes with the largest sum of log-odds such that no kept node has a dropped ancestor, in one pass from the leaves.

No labelled pages are given, so the trees are fitted, once and in under a few seconds, on pages that ``training_pages``
writes from many layouts with known parts; they don't depend on the table.

Text: character references decoded; white space inside a block becomes one space, ends are trimmed, blocks are joined by one
line feed in page order; a line break (br) counts as white space.

Defined cases: a null page or one without an article gives an empty text; repeated rows get equal rows; null ids are
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the HTML standard: elements by how they nest and break lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag, and elements that are never part of an article if they have an end tag.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
DROPPED = frozenset("noscript template select button svg audio video canvas".split())
#: Elements that can't do without an end tag and hold what an article may not.
NEED_END = DROPPED | frozenset("form fieldset dialog figure label option optgroup datalist object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt figcaption head html legend li tbody td tfoot th thead tr".split())
#: A start tag ends an open element of the second set, up to one of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_STOP = re.compile("[>\"']")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: What attribute tokens say, as groups of tokens.
TOKEN_GROUPS = (
    "article content post entry story main text body prose markdown page",
    "nav navigation navbar menu menubar breadcrumb breadcrumbs pager pagination tabs toc links topbar",
    "header masthead banner logo branding hero top toolbar",
    "footer foot bottom copyright colophon contentinfo legal",
    "sidebar side aside complementary widget widgets rail related recommended recommendations trending popular more",
    "ad ads advert adverts advertisement sponsor sponsored promo promotion doubleclick outbrain taboola banner",
    "cookie cookies consent gdpr notice alert modal popup overlay dialog alertdialog toast newsletter paywall",
    "comment comments reply replies respond disqus discussion reader readers response responses",
    "share sharing social follow twitter facebook tags tag meta byline author subscribe",
    "form search login signin signup register input contact hidden",
)
GROUP_OF = {t: {g for g, s in enumerate(TOKEN_GROUPS) if t in s.split()} for s in TOKEN_GROUPS for t in s.split()}
TAG_KINDS = ("p", "h1 h2 h3 h4 h5 h6 hgroup", "li", "ul ol dl menu dir", "div center", "section", "article", "main", "nav", "header", "footer", "aside", "form fieldset search", "table tbody tr td th thead tfoot", "blockquote pre figure figcaption", "span a b i em strong small")
KIND_OF = {t: k for k, s in enumerate(TAG_KINDS) for t in s.split()}
#: Tags that say what the tokens of these groups say.
TAG_GROUP = {"article": 0, "main": 0, "nav": 1, "header": 2, "footer": 3, "aside": 4, "form": 9, "dialog": 6}


def _attributes(tag: str, raw: str) -> tuple[int, int, bool, int]:
    return _read_attributes(tag, raw) if len(raw) > 500 else _known_attributes(tag, raw)


@lru_cache(maxsize=1 << 14)
def _known_attributes(tag: str, raw: str) -> tuple[int, int, bool, int]:
    return _read_attributes(tag, raw)


def _read_attributes(tag: str, raw: str) -> tuple[int, int, bool, int]:
    """(bits of token groups, number of tokens, decides for itself, training label or -1) of a start tag."""
    bits, tokens, label, named = 1 << TAG_GROUP[tag] if tag in TAG_GROUP else 0, 0, -1, False
    for name, a, b, c in ATTRIBUTE.findall(raw):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            named = named or bool(value)
            for word in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                tokens += 1
                for g in GROUP_OF.get(word, ()):
                    bits |= 1 << g
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value.lower()) or name == "aria-hidden" and value.lower() == "true":
            bits, named = bits | 1 << 9 | 1 << len(TOKEN_GROUPS), True
        elif name == "data-y":
            label = int(value)
    return bits, tokens, named or tag in BLOCK, label


@dataclass
class Pages:
    """Elements of some pages in document order, and their text runs."""

    page: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    bits: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    tokens: list[int] = field(default_factory=list)
    decides: list[bool] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    in_link: list[bool] = field(default_factory=list)
    runs: list[tuple[int, int, int, str]] = field(default_factory=list)  # page, block, element, text
    unclosed: set[int] = field(default_factory=set)  # of the page that is being read
    count: int = 0

    def add(self, html: str) -> None:
        """Every character is looked at a bounded number of times, whatever the markup."""
        number, self.count = self.count, self.count + 1
        root, first_run = len(self.tag), len(self.runs)
        self._open(number, "", "", -1)
        self.decides[root], self.depth[root] = True, 0
        stack = OpenElements(root)
        block = at = seek = 0  # at: where the text begins that is not read yet
        last, quotes = html.rfind(">"), True

        def text(end: int) -> None:
            if end > at:
                self.runs.append((number, block, stack.top(), html[at:end]))

        while (lt := html.find("<", seek)) >= 0:
            seek = lt + 1
            after = html[seek : seek + 1]
            if after in ("!", "?"):
                if html.startswith("<!--", lt):
                    end = html.find("-->", lt + 2)
                    end = end + 3 if end >= 0 else len(html)
                else:
                    end = html.find(">", seek) + 1 if seek <= last else len(html)
                text(lt)
                at = seek = end
                continue
            closing = after == "/"
            m = NAME.match(html, seek + closing)
            if not m:
                if closing and seek < last and html[seek + 1 : seek + 2] != "<":
                    text(lt)
                    at = seek = html.find(">", seek) + 1
                continue
            if seek > last:  # the page ends inside a tag: an end tag is dropped, all else is text
                text(lt if closing else len(html))
                at = len(html)
                break
            end = html.find(">", m.end()) if closing or not quotes else _tag_end(html, m.end())
            if end < 0:
                quotes, end = False, html.find(">", m.end())
            name, raw = m[0].lower(), html[m.end() : end]
            text(lt)
            at = seek = end + 1
            if closing:
                block += name in BLOCK
                k = stack.matching(name)
                if k >= 0:
                    mark = stack.marks.get(stack.nodes[k])
                    self._pop(stack, k, True)
                    if mark:  # as if it had never been opened
                        block = self._forget(*mark)
                continue
            if name in BLOCK:
                block += 1
                if name in CLOSES_P:
                    self._close(stack, {"p"}, P_SCOPE)
                if name in IMPLIED:
                    self._close(stack, *IMPLIED[name])
            if name in RAW and not stack.inside("svg"):
                at = seek = RAW_END[name].search(html, at).end()
            elif name == "br":
                self.runs.append((number, block, stack.top(), " "))
            elif name not in VOID and not raw.endswith("/"):
                x = self._open(number, name, raw, stack.top())
                stack.push(x, name)
                if name in DROPPED:
                    stack.marks[x] = (x, len(self.runs), block)
        text(len(html))
        self._pop(stack, 0)
        self._dissolve(root, first_run)

    def _dissolve(self, root: int, first_run: int) -> None:
        """Elements that need an end tag and have none hold nothing: what is in them belongs to what they are in."""
        if not self.unclosed:
            return
        for x in self.unclosed:
            self.bits[x], self.tokens[x], self.decides[x] = 0, 0, False
        for x in range(root + 1, len(self.tag)):
            up = self.parent[x]
            if up in self.unclosed:  # parents come first, so that of up is settled
                up = self.parent[x] = self.parent[up]
            self.depth[x] = self.depth[up] + 1
            self.above[x] = self.above[up] | self.bits[up]
        for k in range(first_run, len(self.runs)):
            page, block, x, words = self.runs[k]
            if x in self.unclosed:
                self.runs[k] = page, block, self.parent[x], words
        self.unclosed.clear()

    def _forget(self, first: int, runs: int, block: int) -> int:
        """Remove the elements and text runs from these numbers on."""
        for column in (self.page, self.tag, self.parent, self.end, self.depth, self.bits, self.above, self.tokens, self.decides, self.label, self.in_link):
            del column[first:]
        self.unclosed = {x for x in self.unclosed if x < first}
        del self.runs[runs:]
        return block

    def _open(self, number: int, tag: str, raw: str, parent: int) -> int:
        bits, tokens, decides, label = _attributes(tag, raw)
        self.page.append(number)
        self.tag.append(tag)
        self.parent.append(parent)
        self.end.append(0)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.bits.append(bits)
        self.above.append(self.above[parent] | self.bits[parent] if parent >= 0 else 0)
        self.tokens.append(tokens)
        self.decides.append(decides)
        self.label.append(label if label >= 0 or parent < 0 else self.label[parent])
        self.in_link.append(tag == "a" or parent >= 0 and self.in_link[parent])
        return len(self.tag) - 1

    def _close(self, stack: OpenElements, which: set[str], until: set[str]) -> None:
        lowest = stack.highest(which)
        if lowest > stack.highest(until):
            while lowest > 1 and stack.names[lowest - 1] in which:
                lowest -= 1
            self._pop(stack, lowest)

    def _pop(self, stack: OpenElements, k: int, ended: bool = False) -> None:
        """Close the open elements from k on; ended: the first of them by its own end tag."""
        for i, x in enumerate(stack.cut(k)):
            self.end[x] = len(self.tag)
            if self.tag[x] in NEED_END and not (ended and i == 0):
                self.unclosed.add(x)


#: What a p element is not looked for beyond.
P_SCOPE = {"table", "td", "th", "object"} | DROPPED


class OpenElements:
    """The stack of open elements, with the places of each name."""

    def __init__(self, root: int) -> None:
        self.nodes, self.names = [root], [""]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.marks: dict[int, tuple[int, int, int]] = {}

    def top(self) -> int:
        return self.nodes[-1]

    def push(self, node: int, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.nodes))
        if name in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.names.append(name)

    def cut(self, k: int) -> list[int]:
        out = self.nodes[k:]
        for name, node in zip(self.names[k:], out, strict=True):
            if self.places.get(name):
                self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()
            self.marks.pop(node, None)
        del self.nodes[k:], self.names[k:]
        return out

    def highest(self, names: set[str]) -> int:
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=0)

    def inside(self, name: str) -> bool:
        return bool(self.places.get(name))

    def matching(self, name: str) -> int:
        """The place that an end tag closes, or -1: one of an inline element does not reach out of a block."""
        places = self.places.get(name)
        return places[-1] if places and (name in BLOCK or not self.blocks or self.blocks[-1] < places[-1]) else -1


def _tag_end(html: str, at: int) -> int:
    """Where the tag ends whose name ends at ``at``, or -1: a quote counts only after an equals sign."""
    while m := TAG_STOP.search(html, at):
        at = m.end()
        if m[0] == ">":
            return m.start()
        k = m.start() - 1
        while html[k].isspace():
            k -= 1
        if html[k] == "=":
            at = html.find(m[0], at) + 1
            if not at:
                return -1
    return -1


def features(p: Pages) -> np.ndarray:
    """A row of features for each element."""
    n = len(p.tag)
    own = np.zeros((n, 4))  # characters, of them in links, sentence marks, words
    for _, _, x, text in p.runs:
        size = len(text) - text.count(" ")
        own[x] += size, size * p.in_link[x], text.count(". ") + text.count(".\n") + text.rstrip().endswith((".", "!", "?")) + text.count(", "), text.count(" ")
    run = np.concatenate([np.zeros((1, 4)), np.cumsum(own, axis=0)])
    index, end = np.arange(n), np.array(p.end)
    sub = run[end] - run[index]
    parent = np.maximum(np.array(p.parent), 0)
    page = np.array(p.page)
    whole = sub[np.searchsorted(page, page)]
    tags = end - index
    children = np.bincount(parent[1:] if n else [], minlength=n)
    order = np.lexsort((index, parent))
    rank = np.empty(n)
    starts = np.searchsorted(parent[order], parent[order])
    rank[order] = np.arange(n) - starts
    bits, above = np.array(p.bits), np.array(p.above)
    flags = [(bits >> g) & 1 for g in range(len(TOKEN_GROUPS) + 1)] + [(above >> g) & 1 for g in range(len(TOKEN_GROUPS) + 1)]
    kind = np.array([KIND_OF.get(t, -1) for t in p.tag])
    columns = [
        np.log1p(sub[:, 0]),
        np.log1p(own[:, 0]),
        sub[:, 1] / (1 + sub[:, 0]),
        sub[:, 0] / tags,
        sub[:, 2] / (1 + sub[:, 3]),
        np.log1p(tags),
        np.array(p.depth),
        children,
        rank / np.maximum(1, children[parent]),
        sub[:, 0] / (1 + sub[parent, 0]),
        sub[:, 0] * children[parent] / (1 + sub[parent, 0]),
        sub[:, 0] / (1 + whole[:, 0]),
        sub[parent, 1] / (1 + sub[parent, 0]),
        np.array(p.tokens),
        kind[parent],
        *flags,
        *(kind == k for k in range(len(TAG_KINDS))),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass
class BoostedTrees:
    """Trees of fixed depth on binned features, for the logistic loss."""

    cuts: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature and bin by inner node, value by leaf
    start: float
    depth: int

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 24, pull: float = 1.0) -> BoostedTrees:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        b = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
        mean = (weight * y).sum() / weight.sum()
        out = BoostedTrees(cuts, [], float(np.log(mean / (1 - mean))), depth)
        margin = np.full(len(y), out.start)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-margin))
            g, h = weight * (q - y), weight * q * (1 - q)
            feature, cut = np.zeros(2**depth - 1, int), np.full(2**depth - 1, bins)
            node = np.zeros(len(y), int)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                best = np.zeros(width)
                for f in range(x.shape[1]):
                    cell = (node - first) * bins + b[:, f]
                    gs, hs = (np.bincount(cell, weights=v, minlength=width * bins).reshape(width, bins).cumsum(axis=1) for v in (g, h))
                    gain = gs**2 / (hs + pull) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + pull) - gs[:, -1:] ** 2 / (hs[:, -1:] + pull)
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(width), k]
                    for w in np.flatnonzero(top > best + 1e-9):
                        best[w], feature[first + w], cut[first + w] = top[w], f, k[w]
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**depth - 1)
            gs, hs = (np.bincount(leaf, weights=v, minlength=2**depth) for v in (g, h))
            value = -rate * gs / (hs + pull)
            out.trees.append((feature, cut, value))
            margin += value[leaf]
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], axis=1)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def training_pages(count: int, seed: int = 1) -> list[str]:
    """Pages of known structure; data-y tells which elements belong to the article."""
    r = random.Random(seed)
    syllables = [a + b for a in "bcdfghklmnprstvw" for b in ("a", "e", "i", "o", "u", "an", "er", "in")]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def text(low: int, high: int, stop: str = ".") -> str:
        n = r.randint(low, high)
        words = [word() for _ in range(n)]
        for k in range(7, n - 1, r.randint(6, 14)):
            words[k] += r.choice((".", ",", "."))
        return " ".join(words).capitalize() + stop

    def links(n: int, inner: str = "li") -> str:
        items = "".join(f'<{inner}><a href="/{word()}">{text(1, 3, "")}</a></{inner}>' for _ in range(n))
        return f"<ul>{items}</ul>" if inner == "li" else items

    def named(*names: str) -> str:
        k = r.random()
        name = r.choice(names)
        return f' class="{name}"' if k < 0.6 else f' id="{name}"' if k < 0.85 else f' class="{word()} {name}-{word()}"'

    def paragraph() -> str:
        k = r.random()
        if k < 0.06:
            return f"<p>{text(1, 4)}</p>"
        if k < 0.2:
            return f'<p>{text(5, 40)} <a href="/x">{text(1, 4, "")}</a> {text(5, 30)}</p>'
        if k < 0.26:
            return f"<p><b>{text(4, 30)}<br><p>{text(10, 60)}</p>"
        if k < 0.32:
            return f"<ul>{''.join(f'<li>{text(3, 25)}</li>' for _ in range(r.randint(2, 6)))}</ul>"
        if k < 0.36:
            return f"<blockquote>{text(8, 40)}</blockquote>"
        if k < 0.4:
            return f"<pre>{text(5, 30)}</pre>"
        if k < 0.43:
            return f"<table>{''.join(f'<tr><td>{text(1, 4)}</td><td>{text(1, 8)}</td></tr>' for _ in range(r.randint(2, 5)))}</table>"
        if k < 0.46:
            return f"<figure><img src=x><figcaption>{text(3, 14)}</figcaption></figure>"
        if k < 0.49:
            return f"<div>{text(10, 60)}</div>"
        return f"<p>{text(8, 110)}</p>"

    def no(tag: str, attributes: str, inner: str) -> str:
        return f'<{tag}{attributes} data-y="0">{inner}</{tag}>'

    def notices() -> list[str]:
        both = lambda *t: r.choice(t)
        return [
            no(both("div", "aside"), named("ad", "ads", "advert", "sponsored", "promo", "advertisement"), r.choice((f"<p>{text(3, 25)}</p>", text(2, 20), f"<a href=/x>{text(2, 6)}</a>"))),
            no("div", named("cookie", "cookie-banner", "consent", "notice", "popup", "alert"), f"<p>{text(6, 30)}</p>{text(1, 2, '')}"),
            no(both("div", "section"), named("newsletter", "subscribe", "signup"), f"<p>{text(4, 20)}</p>"),
            no("div", named("share", "social", "share-buttons"), links(r.randint(2, 5), r.choice(("li", "span")))),
            no("form", named("search", "login", "contact") if r.random() < 0.6 else "", f"<label>{text(1, 4, '')}</label><input name=q><p>{text(2, 12)}</p>"),
        ]

    def comments() -> str:
        items = "".join(f"<div{named('comment', 'reply') if r.random() < 0.7 else ''}><p>{text(3, 50)}</p></div>" for _ in range(r.randint(1, 6)))
        return no(r.choice(("section", "div", "div")), named("comments", "disqus", "discussion", "responses"), f"<h3>{text(1, 3, '')}</h3>{items}")

    out = []
    for _ in range(count):
        inside = [paragraph() for _ in range(r.choice((1, 2, 3, 5, 8, 12, 20)))]
        if r.random() < 0.15:  # hardly any text
            inside = [f"<p>{r.choice(('', '<b>'))}{text(1, 5, r.choice(('.', '', '.###', ' |')))}{r.choice(('', '<br>'))}</p>" for _ in range(r.randint(1, 2))]
        head = f"<h1>{text(1, 9, r.choice(('', '.', '...')))}</h1>" if r.random() < 0.85 else ""
        if r.random() < 0.35:
            inside.insert(r.randint(0, len(inside)), f"<h2>{text(1, 6, '')}</h2>")
        for extra in notices():
            if r.random() < 0.1:
                inside.insert(r.randint(0, len(inside)), extra)
        if r.random() < 0.12:
            inside.append(comments())
        if r.random() < 0.1:
            inside.insert(0, no("nav", named("toc", "breadcrumb"), links(r.randint(2, 6))))
        body = head + "".join(inside)
        k = r.random()
        if k < 0.45:
            main = f"<article>{body}</article>"
        elif k < 0.6:
            main = f"<main>{f'<article>{body}</article>' if r.random() < 0.5 else body}</main>"
        elif k < 0.9:
            main = f"<div{named('content', 'post', 'entry', 'article', 'main', 'story', 'post-content', 'article-body', 'page-content')}>{body}</div>"
        else:
            main = f"<div><div>{body}</div></div>"
        before = [no("nav", named("nav", "menu", "navbar") if r.random() < 0.5 else "", links(r.randint(2, 12)))] if r.random() < 0.6 else []
        if r.random() < 0.5:
            before.insert(r.randint(0, len(before)), no("header", named("header", "masthead") if r.random() < 0.4 else "", f"<div>{text(1, 5, '')}</div>{links(r.randint(0, 5)) if r.random() < 0.5 else ''}"))
        if r.random() < 0.25:
            before.append(no("div", named("menu", "nav", "topbar", "breadcrumbs"), links(r.randint(2, 9), r.choice(("li", "span")))))
        after = []
        if r.random() < 0.45:
            side = f"<h3>{text(1, 3, '')}</h3>{links(r.randint(2, 8))}<p>{text(3, 40)}</p>"
            (after if r.random() < 0.6 else before).append(no(r.choice(("aside", "div")), named("sidebar", "related", "widget", "side"), side))
        if r.random() < 0.35:
            after.append(comments())
        if r.random() < 0.8:
            plain = r.random() < 0.7
            after.append(no("footer" if plain else "div", "" if plain else named("footer", "copyright", "bottom"), r.choice((f"&copy; {text(2, 18)}", f"<p>{text(3, 25)}</p>", links(r.randint(2, 6)) + f"<p>&copy; {text(1, 6)}</p>"))))
        for extra in notices():
            if r.random() < 0.22:
                (before if r.random() < 0.5 else after).insert(0, extra)
        if r.random() < 0.04:
            main = ""
        page = "".join([*before, main, *after])
        if r.random() < 0.3:
            page = f"<div{named('wrapper', 'container', 'site', 'page')}>{page}</div>"
        out.append(f'<!DOCTYPE html><html data-y="1"><head><meta charset=utf-8><title>{word()}</title><script>var x="</p>"</script></head><body>{page}</body></html>')
    return out


@lru_cache(maxsize=1)
def trained(pages: int = 700) -> BoostedTrees:
    p = Pages()
    for html in training_pages(pages):
        p.add(html)
    use = np.array(p.decides) & (np.array(p.label) >= 0)
    return BoostedTrees.fit(features(p)[use], np.array(p.label)[use].astype(float), np.ones(int(use.sum())))


def decode(p: Pages, margin: np.ndarray) -> np.ndarray:
    """Which elements are kept: the best set in which every kept element's ancestors are kept."""
    n = len(p.tag)
    decides = p.decides
    value = np.where(decides, margin, 0.0).tolist()
    for x in range(n - 1, -1, -1):  # children come after their parents
        if p.parent[x] >= 0 and value[x] > 0:
            value[p.parent[x]] += value[x]
    kept = [False] * n
    for x in range(n):
        up = p.parent[x]
        kept[x] = (up < 0 or kept[up]) and (not decides[x] or value[x] > 0 or up < 0)
    return np.array(kept)


SPACE = re.compile(r"\s+")


def extract(pages: list[str | None], trees: BoostedTrees) -> list[str]:
    p = Pages()
    for html in pages:
        p.add(html or "")
    if not p.tag:
        return []
    some = np.zeros(len(p.tag))
    np.add.at(some, [x for _, _, x, _ in p.runs], 1)
    run = np.concatenate([[0], np.cumsum(some)])
    x = features(p)
    margin = np.full(len(p.tag), -1.0)
    asked = np.flatnonzero(np.array(p.decides) & (run[np.array(p.end)] > run[:-1]))
    margin[asked] = trees.margin(x[asked])
    kept = decode(p, margin)
    blocks: list[list[list[str]]] = [[] for _ in pages]
    last = None
    for number, block, node, text in p.runs:
        if kept[node]:
            if last != (number, block):
                blocks[number].append([])
                last = (number, block)
            blocks[number][-1].append(text)
    return ["\n".join(t for b in parts if (t := SPACE.sub(" ", _decoded("".join(b))).strip())) for parts in blocks]


ZEROS, LONG_NUMBER = re.compile(r"&#0{2,}(?=[0-9])"), re.compile(r"&#[1-9][0-9]{7,};?")


def _decoded(text: str) -> str:
    """Character references decoded; numbers beyond any character are the replacement character, however many digits they have."""
    return unescape(LONG_NUMBER.sub("\uFFFD", ZEROS.sub("&#", text)))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    trees = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                texts = extract(part.column(2).to_pylist(), trees.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
