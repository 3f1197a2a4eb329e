"""Operator 4, HTML extraction: a tree-structured graphical model over the DOM, solved by sum-product.

Every element is a binary node (main content or not). Node potentials come from its tag, class and id words, text
length, link density and punctuation; parent-child potentials say how likely content continues downward. One upward
and one downward pass of messages give exact marginals. All potentials are fitted to labelled pages.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup; without an end tag the first two run to the end, as browsers have it, and the
#: others are taken as empty, so that no text behind them is lost.
RAW = ("script", "style", "title", "textarea", "iframe")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img math mi mo mn ms mrow mtext msup msub mfrac msqrt object svg".split())
#: A start tag ends these open elements first.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[A-Za-z]+")


class Page:
    """A forgiving parse: elements in page order with parents, and runs of text with their element and block."""

    def __init__(self, source: str):
        self.tag, self.parent, self.words, self.label = ["#page"], [-1], [()], [None]
        self.runs: list[tuple[int, int, str]] = []  # element, block, text
        self._open, self._count, self._block = [0], Counter(), 0
        self._none: dict[str, bool] = {}  # what the rest of the page is known not to hold
        at = 0
        while True:
            lt = source.find("<", at)
            if lt < 0:
                self._text(source[at:])
                break
            self._text(source[at:lt])
            if source.startswith("<!--", lt):
                end = self._find(source, "-->", lt + 4)
                at = end + 3 if end >= 0 else len(source)
                continue
            if source.startswith(("<!", "<?"), lt):
                end = self._find(source, ">", lt + 2)
                at = end + 1 if end >= 0 else len(source)
                continue
            m = TAG.match(source, lt)
            if m is None:  # a plain less-than sign
                self._text("<")
                at = lt + 1
                continue
            end = self._tag_end(source, m.end())
            at, tag, attributes = min(end + 1, len(source)), m[2].lower(), source[m.end() : end]
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, attributes)
            if tag in RAW and not attributes.endswith("/"):
                close = None if self._none.get(tag) else re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                self._none[tag] = close is None
                if close:
                    at = close.end()
                elif tag in RAW[:2]:
                    at = len(source)
                self._pop()

    def _find(self, source: str, what: str, at: int) -> int:
        """As find; a failure is remembered, so that a page is searched for what it lacks only once."""
        if self._none.get(what):
            return -1
        got = source.find(what, at)
        self._none[what] = got < 0
        return got

    def _tag_end(self, source: str, at: int) -> int:
        """Where the tag's ``>`` is, quoted ones skipped, or the page's end; a quote that nothing closes is a character."""
        while m := STOP.search(source, at):
            if m[0] == ">":
                return m.start()
            close = self._find(source, m[0], m.end())
            at = close + 1 if close >= 0 else m.end()
        return len(source)

    def _text(self, s: str) -> None:
        if s:
            self.runs.append((self._open[-1], self._block, s))

    def _pop(self) -> None:
        tag = self.tag[self._open.pop()]
        self._count[tag] -= 1
        self._block += tag not in INLINE

    def _end(self, tag: str) -> None:
        self._block += tag not in INLINE
        if self._count[tag] > 0:
            while self.tag[self._open[-1]] != tag:
                self._pop()
            self._pop()

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text("\n")
            return
        if tag not in INLINE:
            self._block += 1
            if self._count["p"] > 0:
                k = len(self._open) - 1
                while self.tag[self._open[k]] in INLINE:
                    k -= 1
                if self.tag[self._open[k]] == "p":
                    while len(self._open) > k:
                        self._pop()
        if any(self._count[t] > 0 for t in ENDS.get(tag, ())):
            k = len(self._open) - 1
            while k and self.tag[self._open[k]] not in SCOPE.get(tag, ()) and self.tag[self._open[k]] not in ENDS[tag]:
                k -= 1
            if self.tag[self._open[k]] in ENDS[tag]:
                while len(self._open) > k:
                    self._pop()
        words, label = [], None
        if attributes:
            for name, *value in ATTRIBUTE.findall(attributes):
                value = value[0] or value[1] or value[2]
                if name.lower() == "data-label":
                    label = int(value)
                else:
                    words += [w.lower() for w in WORDS.findall(value)]
        self.tag.append(tag)
        self.parent.append(self._open[-1])
        self.words.append(tuple(words))
        self.label.append(label)
        if tag not in VOID:
            self._open.append(len(self.tag) - 1)
            self._count[tag] += 1

    def features(self) -> list[list[str]]:
        n = len(self.tag)
        chars, linked, stops = [0] * n, [0] * n, [0] * n
        for e, _, s in self.runs:
            chars[e] += len(s)
            stops[e] += s.count(".") + s.count("!") + s.count("?")
        for e in range(n - 1, 0, -1):
            if self.tag[e] == "a":
                linked[e] = chars[e]
            for column in (chars, linked, stops):
                column[self.parent[e]] += column[e]
        out = []
        for e in range(n):
            f = [f"tag {self.tag[e]}", f"length {min(chars[e], 4000).bit_length() // 2}", f"stops {min(stops[e], 3)}", f"links {4 * linked[e] // chars[e] if chars[e] else -1}"]
            f.append(f"share {4 * chars[e] // chars[0] if chars[0] else -1}")
            f += [f"word {w}" for w in dict.fromkeys(self.words[e])]
            out.append(f)
        if n == 1:
            out[0].append("no markup")
        return out


class Model:
    """Log-potentials: a weight for each feature of a content element, and ``pair[parent][child]``."""

    def __init__(self, weights: dict[str, float], bias: float, pair: tuple[tuple[float, float], tuple[float, float]]):
        self.weights, self.bias, self.pair = weights, bias, pair

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each element: messages from the leaves to the root, then from the root to the leaves."""
        n, get, parent = len(page.tag), self.weights.get, page.parent
        ((e00, e01), (e10, e11)) = ((exp(x) for x in row) for row in self.pair)
        below = [self.bias + sum(get(f, 0.0) for f in fs) for fs in page.features()]  # log-odds from the subtree
        up = [0.0] * n
        for e in range(n - 1, 0, -1):
            odds = exp(max(-300.0, min(300.0, below[e])))
            up[e] = log((e11 * odds + e10) / (e01 * odds + e00))
            below[parent[e]] += up[e]
        belief = [below[0]] + [0.0] * (n - 1)
        for e in range(1, n):
            odds = exp(max(-300.0, min(300.0, belief[parent[e]] - up[e])))  # the parent without this child's word
            belief[e] = below[e] + log((e11 * odds + e01) / (e10 * odds + e00))
        return [1 / (1 + exp(-max(-300.0, min(300.0, b)))) for b in belief]

    def text(self, source: str | None, least: float = 0.5) -> str:
        """The text of content elements: references decoded, white space folded in each block, blocks joined by a space."""
        page = Page(source or "")
        keep = self.marginals(page)
        blocks: dict[int, list[str]] = {}
        for e, block, s in page.runs:
            if keep[e] >= least:
                blocks.setdefault(block, []).append(s)
        folded = (" ".join(entities.unescape("".join(b)).split()) for b in blocks.values())
        return " ".join(b for b in folded if b)


def train(pages: list[str], ridge: float = 0.5, rounds: int = 250, rate: float = 0.15) -> Model:
    """Fit the potentials by maximum likelihood on pages whose elements say ``data-label="1"`` (content) or ``"0"``; a
    label holds below until another one. All pages are one forest: each round passes the messages depth by depth and
    moves the weights by (observed - expected) counts. Words seen on fewer than three elements have no weight."""
    fs, y, parent, depth = [], [], [], []
    for source in pages:
        page = Page(source)
        label, base = [page.label[0] or 0] + [0] * (len(page.tag) - 1), len(y)
        deep = [0] * len(label)
        for e in range(1, len(label)):
            label[e] = page.label[e] if page.label[e] is not None else label[page.parent[e]]
            deep[e] = deep[page.parent[e]] + 1
        if not any(x is not None for x in page.label):  # bare text
            label = [1] * len(label)
        fs += page.features()
        y += label
        depth += deep
        parent += [base + q if q >= 0 else -1 for q in page.parent]
    often = Counter(f for f in fs for f in f)
    names = {f: i for i, f in enumerate(sorted(f for f, k in often.items() if k >= 3))}
    x = np.zeros((len(y), len(names) + 1))
    x[:, -1] = 1
    for i, own in enumerate(fs):
        x[i, [names[f] for f in own if f in names]] = 1
    y, parent, depth = np.array(y, float), np.array(parent), np.array(depth)
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    child = np.flatnonzero(parent >= 0)
    a, b = y[parent[child]], y[child]
    seen = np.array([((1 - a) * b).sum(), (a * (1 - b)).sum(), (a * b).sum()])
    w = np.zeros(x.shape[1] + 3)  # features, bias, pair[0][1], pair[1][0], pair[1][1]
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        e01, e10, e11 = np.exp(w[-3:])
        below, up = x @ w[:-3], np.zeros(len(y))
        for at in reversed(levels):
            odds = np.exp(np.clip(below[at], -300, 300))
            up[at] = np.log((e11 * odds + e10) / (e01 * odds + 1))
            np.add.at(below, parent[at], up[at])
        belief, joint = below.copy(), np.zeros(3)
        for at in levels:
            odds, own = np.exp(np.clip(belief[parent[at]] - up[at], -300, 300)), np.exp(np.clip(below[at], -300, 300))
            both = np.stack([np.ones(len(at)), e01 * own, e10 * odds, e11 * odds * own])
            joint += (both / both.sum(0))[1:].sum(1)
            belief[at] = below[at] + np.log((e11 * odds + e01) / (e10 * odds + 1))
        slope = np.r_[x.T @ (y - 1 / (1 + np.exp(-np.clip(belief, -300, 300)))), seen - joint] - ridge * w
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w += rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return Model({f: float(w[i]) for f, i in names.items()}, float(w[-4]), ((0.0, float(w[-3])), (float(w[-2]), float(w[-1]))))


#: Class and id words of page parts, as sites commonly use them; used to write labelled pages.
CONTENT = "article content post entry story main body text page blog single hentry".split()
PARTS = {
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs topnav links",
    "header": "header masthead topbar branding logo banner",
    "footer": "footer copyright legal bottom colophon",
    "aside": "sidebar aside widget related rail trending popular recommended",
    "ad": "ad ads advert advertisement sponsor sponsored promo adsbygoogle banner",
    "notice": "cookie cookies notice consent gdpr popup modal alert newsletter subscribe",
    "form": "form search login signup contact subscribe",
    "comments": "comment comments reply replies discussion respond disqus thread",
    "share": "share social sharing buttons follow tags meta pagination pager",
}


def labelled_pages(n: int = 700, seed: int = 7) -> list[str]:
    """Pages written for training: an article among page parts of many kinds, with labels, some without closing tags."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9)))

    def prose(lo: int, hi: int) -> str:
        return " ".join(word() + r.choice(["", "", "", "", ",", "."]) for _ in range(int(exp(r.uniform(log(lo), log(hi)))))) + r.choice([".", ".", ""])

    def named(words: list[str]) -> str:
        w = r.choice(words)
        return r.choice([f' class="{w}"', f' id="{w}"', f' class="{w} {word()}x"', f' class="{w}-{r.choice(["box", "area", "wrap", "list", "item"])}"'])

    def part(kind: str) -> str:
        words = PARTS[kind].split()
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        plain = tag != "div" and r.random() < 0.6
        tag = tag if plain or tag == "form" else r.choice(["div", "section", tag])
        items = [f'<li><a href="/{word()}">{prose(1, 4)}</a></li>' for _ in range(r.randint(2, 9))]
        if kind in ("nav", "share", "aside") and r.random() < 0.8:
            inner = f"<ul>{''.join(items)}</ul>"
        elif kind == "form":
            inner = f"<label>{prose(1, 3)}</label><input><button>{prose(1, 2)}</button>"
        elif kind == "comments":
            inner = f"<h3>{prose(1, 3)}</h3>" + "".join(f"<div{named(words)}><p>{prose(2, 60)}</p></div>" for _ in range(r.randint(1, 5)))
        else:
            inner = r.choice([prose(2, 30), f"<p>{prose(2, 40)}</p>", f"<p>{prose(1, 9)} <a href='/x'>{prose(1, 3)}</a></p>"])
        return f'<{tag} data-label="0"{"" if plain else named(words)}>{inner}</{tag}>'

    pages = [prose(1, 400) for _ in range(max(1, n // 20))]
    for _ in range(max(1, n // 6)):  # short pages of nothing but an article, in any plain elements
        inner = "".join(f"<p>{prose(3, 40)}</p>" for _ in range(r.randint(1, 3)))
        for _ in range(r.randint(0, 3)):
            inner = f"<{(tag := r.choice(['div', 'section', 'article', 'main']))}>{inner}</{tag}>"
        pages.append(f'<html data-label="0"><head><title>{prose(2, 9)}</title></head><body data-label="1">{inner}</body></html>' if r.random() < 0.7 else f'<body data-label="1">{inner}</body>')
    while len(pages) < n:
        body = [f"<{r.choice(['h1', 'h1', 'h2'])}>{prose(2, 14)}</h1>"]
        for _ in range(r.randint(1, 14)):
            k = r.random()
            if k < 0.72:
                end = "</p>" if r.random() < 0.9 else ""
                body.append(f"<p>{r.choice(['', '', '', '<b>'])}{prose(1, 160)}{r.choice(['', '', '<br>'])}{end}")
            elif k < 0.77:
                body.append(f"<h2>{prose(1, 8)}</h2>")
            elif k < 0.81:
                body.append("<ul>" + "".join(f"<li>{prose(2, 25)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.84:
                body.append(f"<blockquote><p>{prose(4, 60)}</p></blockquote>")
            elif k < 0.87:
                t = r.choice(["em", "code", "span", "object", "sub", "cite", "svg", "math"])
                bit = "".join(f"<{m}>{word()[:2]}</{m}>" for m in r.choices(["mi", "mo", "mn"], k=3)) if t == "math" else word()
                body.append(f"<p>{prose(2, 30)} <{t}>{bit}</{t}> {prose(2, 30)}</p>")
            elif k < 0.9:
                body.append(f"<p>{prose(2, 30)} <a href='/{word()}'>{prose(1, 4)}</a> {prose(2, 30)}</p>")
            else:
                body.append(part(r.choice(list(PARTS))))
        tag = r.choice(["article", "article", "main", "div", "div", "section", ""])
        own = "" if tag in ("article", "main") and r.random() < 0.6 else named(CONTENT)
        article = "".join(b.replace(">", ' data-label="1">', 1) if "data-label" not in b else b for b in body) if not tag else f'<{tag} data-label="1"{own}>{"".join(body)}</{tag}>'
        if tag and r.random() < 0.3:
            article = f"<div{named(['wrap', 'container', 'site', 'layout', 'row'])}>{article}{part('aside')}</div>"
        before = [part(k) for k in r.sample(["nav", "header", "ad", "notice", "form"], r.randint(0, 4))]
        after = [part(k) for k in r.sample(["footer", "comments", "ad", "aside", "share", "form", "notice"], r.randint(0, 4))]
        head = f"<head><meta charset=utf-8><title>{prose(2, 9)}</title><style>p{{}}</style></head>"
        whole = f'{"".join(before)}{article}{"".join(after)}'
        if r.random() < 0.3:
            whole = f"<div{named(['wrap', 'container', 'page', 'site', 'layout', 'main'])}>{whole}</div>"
        pages.append(f'<html data-label="0">{head}<body>{whole}</body></html>')
    return pages


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = (), model: Model | None = None) -> DataFrame:
    """``id, *keep, text`` of every page, without a shuffle. Null, empty and markup-only pages have an empty text;
    a page without markup is its text; repeated rows and null ids pass through; an empty table gives no rows; columns
    not named in ``keep`` are ignored, and names in ``keep`` may be any but ``id`` and ``text``. Pages of any length are
    parsed whole; no part of one is searched again and again for what it lacks."""
    model = model or default_model()
    cols = [F.col(id_col).alias("id"), *keep]
    schema = pages.select(*cols).schema.add("text", "string")

    n, names = len(cols), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([model.text(h.as_py()) for h in b.column(n)], pa.string())
            yield pa.record_batch([*b.columns[:n], text], names=names)

    return pages.select(*cols, F.coalesce(F.col(html_col), F.lit("")).alias("_html")).mapInArrow(run, schema)


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    got = extract(read(spark, sf_dir, "pages"), keep=("url",))
    return got.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
