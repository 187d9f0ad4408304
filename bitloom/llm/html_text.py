"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements, with the text blocks as leaves. Every node has a hidden label,
content or not, a unary potential from its own look (tag, class and id words, length, links) and a potential
with its parent. One sum-product pass up and one down give the exact marginals; the blocks that are likelier
content than not make the text.

The potentials are trained from labelled pages: the pages of the table that mark their article themselves
(``<article>``, ``<main>``, ``itemprop="articleBody"``), at most ``SAMPLE`` of them, chosen by hash, and a set of small pages
that name the usual parts of pages without such marks.

Elements that are never main text (scripts, styles, forms, menus, headers, footers, sidebars by tag) are left
out of the tree, but for headers inside an article. Null and empty pages give an empty text, pages are read whole, repeated rows give repeated
results, null ids and addresses stay null, an empty table gives an empty result, a marginal of exactly one half is not content, other columns are
ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import hash_sample

#: Self-labelled pages that the potentials are trained on, at most (in expectation).
SAMPLE = 2000
#: Names of the weights with which a parent's label pulls an element and a text.
PULL = ("up:element", "up:text")

#: Fixed values of HTML: elements by how they take part in a page.
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe", "noscript"))
DROPPED = frozenset(("head", "template", "svg", "math", "canvas", "object", "select", "datalist", "button", "audio", "video", "nav", "header", "footer", "aside", "dialog", "menu"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
))
#: A start tag ends open elements of these names, unless one of the second set lies between.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",)), "body": (("head",), ("html",)),
}
#: Words of classes and ids of parts that are not main text, and of those that are, for the small pages (fixed values).
PARTS_OUT = (
    "ad ads advert advertisement banner sponsor sponsored promo promotion nav navigation navbar menu breadcrumb breadcrumbs sidebar side widget related recommended recommendations more "
    "share sharing social follow cookie cookies consent notice alert newsletter subscribe signup login comment comments reply respond disqus footer foot header masthead topbar copyright "
    "pagination pager popup modal overlay form search skip toolbar teaser trending popular tags author-box legal disclaimer gdpr"
).split()
PARTS_IN = "article content post entry story body main text article-body post-content entry-content story-body page-content prose article-text single".split()

_TAG = re.compile(r"""<(?:(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|!--(?P<note>.*?)(?:-->|$)|[!?/][^>]*>)""", re.DOTALL)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Page:
    """The pruned tree of one page: for each node its parent (-1: none), features, and text (None: an element)."""

    __slots__ = ("features", "parents", "tags", "texts")

    def __init__(self, source: str):
        self.parents: list[int] = []
        self.features: list[tuple[str, ...]] = []
        self.texts: list[str | None] = []
        self.tags: list[str] = []
        #: Open elements: tag, node or -1 (inline: the node of the block around it), inside a dropped element, inside a link.
        stack: list[tuple[str, int, bool, bool]] = [("", -1, False, False)]
        #: The pieces of the block being read, and how many of its characters lie in links.
        pieces: list[str] = []
        linked = 0
        owner = -1

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join(html.unescape("".join(pieces)).split())
                if text:
                    self._leaf(owner, text, linked)
                pieces.clear()
            linked = 0

        #: How many elements of each name are open, so that nothing is looked for in vain; forms as ranges of nodes.
        opened: Counter = Counter()
        forms: list[tuple[int, int]] = []

        def close(depth: int) -> None:
            while len(stack) > depth:
                if stack[-1][0] in BLOCKS:
                    flush()
                tag, node, dropped, _ = stack.pop()
                opened[tag] -= 1
                if tag == "form" and not dropped:
                    forms.append((node, len(self.parents)))

        def last(names: tuple[str, ...], below: int) -> int:
            """The innermost open element of one of the names, below a depth; 0 if there is none."""
            return next((d for d in range(below - 1, 0, -1) if stack[d][0] in names), 0) if any(opened[x] for x in names) else 0

        pos, n, ended = 0, len(source), 0  # the next end of a tag, -1 if there is none
        while pos < n:
            at = source.find("<", pos)
            at = n if at < 0 else at
            if at > pos and not stack[-1][2]:
                owner = stack[-1][1]
                pieces.append(source[pos:at])
                linked += (at - pos) * stack[-1][3]
            if at == n:
                break
            ended = ended if ended >= at or ended < 0 else source.find(">", at)
            m = _TAG.match(source, at) if ended >= 0 or source.startswith("<!--", at) else None
            if not m:
                if not stack[-1][2]:
                    owner = stack[-1][1]
                    pieces.append("<")
                pos = at + 1
                continue
            pos = m.end()
            tag = (m.group("name") or "").lower()
            if not tag:
                continue
            if m.group("end"):
                depth = last((tag,), len(stack))
                if depth:
                    close(depth)
                elif tag == "p":
                    flush()
                continue
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(source, pos)
                stop = end.start() if end else n
                pos = source.find(">", stop) + 1 or n
                continue
            if tag in BLOCKS:
                names, guards = CLOSES.get(tag, (("p",), ("table", "td", "th", "button", "object", "caption")))
                lowest = 0
                if any(opened[x] for x in names):
                    depth = last(names + guards, len(stack))
                    while depth and stack[depth][0] in names:
                        lowest = depth
                        depth = last(names + guards, depth) if tag in CLOSES else 0
                if lowest:
                    close(lowest)
                flush()
            if tag in VOID:
                if tag == "br" and not stack[-1][2]:
                    owner = stack[-1][1]
                    pieces.append(" ")
                continue
            _, node, dropped, in_link = stack[-1]
            own = tag == "header" and (opened["article"] or opened["main"])  # an article's own headline is for the model to judge
            dropped = dropped or tag in DROPPED and not own
            if tag in BLOCKS and not dropped:
                node = self._element(node, tag, m.group("rest"))
            if not (m.group("rest").endswith("/") and tag not in BLOCKS):
                stack.append((tag, node, dropped, in_link or tag == "a"))
                opened[tag] += 1
        close(1)
        flush()
        self._drop_forms(forms)
        self._prune()

    def _drop_forms(self, forms: list[tuple[int, int]]) -> None:
        """Forms go, but not one that holds the page: a headline or article, or most of the text with paragraphs among it."""
        if not forms:
            return
        size = np.concatenate([[0], np.cumsum([len(t or "") for t in self.texts])])
        prose = np.concatenate([[0], np.cumsum([t is not None and len(t) >= 80 and self.tags[p] == "p" for t, p in zip(self.texts, self.parents, strict=True)])])
        holds = np.concatenate([[0], np.cumsum([t in ("h1", "article", "main") for t in self.tags])])
        for first, end in forms:
            if holds[end] == holds[first] and (2 * (size[end] - size[first]) <= size[-1] or prose[end] - prose[first] < 2):
                self.texts[first:end] = [None] * (end - first)

    def _element(self, parent: int, tag: str, rest: str) -> int:
        words = [f"e:{tag}"]
        if rest:
            for name, a, b, c in _ATTR.findall(rest):
                value = a or b or c
                words += [f"c:{w.lower()}" for w in _WORD.findall(value)]
                if name.lower() == "itemprop" and "articlebody" in value.lower():
                    words.append("c:articlebody")
        self.parents.append(parent)
        self.features.append(tuple(dict.fromkeys(words)))
        self.texts.append(None)
        self.tags.append(tag)
        return len(self.parents) - 1

    def _leaf(self, parent: int, text: str, linked: int) -> None:
        words = text.count(" ") + 1
        share = linked / len(text)
        tag = self.tags[parent] if parent >= 0 else ""
        self.parents.append(parent)
        self.features.append((f"t:in:{tag}", f"t:size:{min(6, int(math.log2(words + 1)))}", f"t:link:{0 if share < 0.1 else 1 if share < 0.6 else 2}", f"t:end:{text[-1] in '.!?:;…»”"' + chr(39)}"))
        self.texts.append(text)
        self.tags.append("#text")

    def _prune(self) -> None:
        """Elements without text below them say nothing and go."""
        full = [t is not None for t in self.texts]
        for i in range(len(full) - 1, -1, -1):
            if full[i] and self.parents[i] >= 0:
                full[self.parents[i]] = True
        number = {-1: -1}
        for i, f in enumerate(full):
            if f:
                number[i] = len(number) - 1
        keep = [i for i, f in enumerate(full) if f]
        self.parents = [number[self.parents[i]] for i in keep]
        self.features = [self.features[i] for i in keep]
        self.texts = [self.texts[i] for i in keep]
        self.tags = [self.tags[i] for i in keep]

    def own_labels(self) -> list[int] | None:
        """Labels of a page that marks its article: leaves in it and in no part that is named as something else; None without a mark."""
        marked = [t in ("article", "main") or "c:articlebody" in f for t, f in zip(self.tags, self.features, strict=True)]
        if not any(marked):
            return None
        out_words = {f"c:{w}" for w in PARTS_OUT}
        inside = []
        for i, p in enumerate(self.parents):
            named_out = self.texts[i] is None and any(f in out_words for f in self.features[i]) and not marked[i]
            inside.append((marked[i] or p >= 0 and inside[p]) and not named_out)
        return self._majority([int(v) for v in inside])

    def _majority(self, leaf_labels: list[int]) -> list[int]:
        """An element's label is that of most of the text below it."""
        size = [(len(t) * y if t is not None else 0, len(t) if t is not None else 0) for t, y in zip(self.texts, leaf_labels, strict=True)]
        for i in range(len(size) - 1, -1, -1):
            if (p := self.parents[i]) >= 0:
                size[p] = (size[p][0] + size[i][0], size[p][1] + size[i][1])
        return [int(2 * a >= b) for a, b in size]


def small_pages() -> Iterator[tuple[Page, list[int]]]:
    """The small labelled pages: a main part and one that isn't, under the names that such parts go by."""
    prose = "The committee met on Monday and agreed to publish its report, which had been delayed for several weeks. "
    good = f"<h1>Report is out</h1><p>{prose * 2}</p><p>{prose}</p><h2>Next</h2><h3>Then</h3><p>Yes, it is.</p><p>Short</p><p>No.</p><p>Two words</p><p>One | two | three</p><ul><li>{prose}</li><li>milk</li></ul><table><tr><td>Size</td><td>12</td></tr></table>"
    bad = (f"<p>{prose}</p>", '<ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul>', "<p>Accept all</p><p>We use these to improve the site. Read more.</p>", f"Buy now and save. {prose}", f"<h3>Join in</h3><p>{prose * 2}</p>")
    for i, out in enumerate(PARTS_OUT):
        for j, within in enumerate(PARTS_IN):
            if (i + j) % 3:
                continue
            attr, holder = ("class", "id")[(i + j) % 2], ("div", "section")[j % 2]
            outer = f'<{holder} {attr}="{out}">{bad[(i + 2 * j) % 5]}</{holder}>'
            inner = f'<{holder} {attr}="{within}">{good}{outer if j % 3 == 0 else ""}</{holder}>'
            if j % 4 == 1:
                inner = f'<div {attr}="wrap">{inner}{outer}</div>'
            elif j % 4 == 2:
                inner = f'<div {attr}="{within}">{prose * 2}<br>{prose}</div>'
            page = Page(f"<html><body>{outer}{inner}{outer if j % 2 else ''}</body></html>")
            word = f"c:{out.split('-')[0]}"
            inside = []
            for k, p in enumerate(page.parents):
                named = page.texts[k] is None and word in page.features[k]
                held = page.texts[k] is None and all(f"c:{w}" in page.features[k] for w in within.split("-")) and not named
                inside.append((held or p >= 0 and inside[p]) and not named)
            yield page, page._majority([int(v) for v in inside])


def _tally(page: Page, labels: list[int], total: Counter, times: int = 1) -> None:
    for i, (f, y) in enumerate(zip(page.features, labels, strict=True)):
        p = page.parents[i]
        total["\x1f".join(f), y, labels[p] if p >= 0 else -1] += times


def fit(pages: DataFrame, sample: int = SAMPLE) -> dict:
    """Potentials from at most about ``sample`` self-labelled pages and the small pages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for source in batch.column("html").to_pylist():
                page = Page(source or "")
                labels = page.own_labels()
                if labels:
                    _tally(page, labels, total)
            cols = list(zip(*total, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(total.values(), pa.int64())], ["f", "y", "up", "n"])

    counted = hash_sample(pages.select("page_id", "html"), sample, "page_id").select("html").mapInArrow(count, "f string, y long, up long, n long")
    total: Counter = Counter()
    for r in counted.groupBy("f", "y", "up").agg(F.sum("n").alias("n")).collect():  # as many rows as the sample has kinds of nodes
        total[r.f, r.y, r.up] += r.n
    whole = max(1, sum(total.values()))
    small: Counter = Counter()
    for page, labels in small_pages():
        _tally(page, labels, small)
    times = max(1.0, 3 * whole / sum(small.values()))  # else the table's own layout would drown the names of parts that it lacks
    names: dict[str, int] = {PULL[0]: 0, PULL[1]: 1}
    rows, cols, signs, y, n = [], [], [], [], []
    for counts, weight in ((total, 1.0), (small, times)):
        for (f, label, up), k in sorted(counts.items()):
            words = [(w, 1.0) for w in f.split("\x1f")] + ([(PULL[f.startswith("t:")], 2.0 * up - 1)] if up >= 0 else [])
            for w, sign in words:
                rows.append(len(y))
                cols.append(names.setdefault(w, len(names)))
                signs.append(sign)
            y.append(label)
            n.append(k * weight)
    rows, cols, signs, y, n = np.array(rows), np.array(cols), np.array(signs), np.array(y, float), np.array(n)
    n = n / n.sum()
    w, b, gw, gb = np.zeros(len(names)), 0.0, np.full(len(names), 1e-9), 1e-9
    for _ in range(3000):  # regression of labels on looks and the parent's label, AdaGrad over the counted kinds of nodes
        z = b + np.bincount(rows, w[cols] * signs, len(y))
        g = n * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        d = np.bincount(cols, g[rows] * signs, len(names)) + 1e-6 * w
        gw += d * d
        w -= 0.3 * d / np.sqrt(gw)
        gb += g.sum() ** 2
        b -= 0.3 * g.sum() / math.sqrt(gb)
    weights = {k: float(w[i]) for k, i in names.items()}
    return {"pull": [max(0.0, weights.pop(k)) for k in PULL], "weights": weights, "bias": float(b)}


def marginals(page: Page, model: dict) -> list[float]:
    """P(content) of each node, by one pass up the tree and one down."""
    weights, pull = model["weights"], model["pull"]
    n = len(page.parents)
    own = [model["bias"] + sum(weights.get(f, 0.0) for f in fs) for fs in page.features]  # log odds
    sent = [0.0] * n

    def through(odds: float, a: float) -> float:
        """What log odds say across an edge that favours equal labels by a factor of exp(a) at most."""
        return math.log((math.exp(a + odds) + 1) / (math.exp(odds) + math.exp(a))) if odds < 0 else math.log((math.exp(a) + math.exp(-odds)) / (1 + math.exp(a - odds)))

    for i in range(n - 1, -1, -1):  # children come after their parents
        if (p := page.parents[i]) >= 0:
            sent[i] = through(max(-300.0, min(300.0, own[i])), pull[page.texts[i] is not None])
            own[p] += sent[i]
    out = own[:]
    for i in range(n):
        if (p := page.parents[i]) >= 0:
            out[i] = own[i] + through(max(-300.0, min(300.0, out[p] - sent[i])), pull[page.texts[i] is not None])
    return [1 / (1 + math.exp(-max(-300.0, min(300.0, v)))) for v in out]


def extract(source: str | None, model: dict, threshold: float = 0.5) -> str:
    """The main text: content blocks in page order, joined by two newlines."""
    if not source:
        return ""
    page = Page(source)
    return "\n\n".join(t for t, p in zip(page.texts, marginals(page, model), strict=True) if t is not None and p > threshold)


def main_text(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """Per page: page_id, url, text and n_chars (code points)."""
    model = model or fit(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(s, model) for s in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
