"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

The nodes of a document's graph are its tokens that show any evidence (a digit or an @ sign) and every token
that repeats one of them, or the name before the @ of an address. Neighbouring nodes are joined by chain
edges; occurrences of the same or a similar token, however far apart, by skip edges. Nodes inside a base match
are observed, and only what skip edges lead to from one may get its label. Loopy sum-product messages then give every other node its label marginals, so a repeated user
name or a number written again without its plus sign takes the label that its twin has.

The potentials are estimated from the text itself: base matches serve as labels of their tokens on a sample of
at most ``SAMPLE`` documents (chosen by hash, so alike at every size), from which shape-label, neighbour and
skip-pair counts are summed on the executors.

Nulls and empty texts give no spans, whole texts are read however long, repeated rows give repeated results, null ids stay null, an empty
table gives an empty result, labels of equal marginals go to the first as listed, and other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import hash_sample, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents that the potentials are estimated on, at most (in expectation).
SAMPLE = 20_000
#: Rounds of message passing at most (it ends when messages don't move any more), damping, and the marginal from which a label counts.
ROUNDS, DAMP, ACCEPT = 200, 0.3, 0.6
#: Shorter keys don't make a skip edge.
KEY = 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_EDGE = "\"'.,;:!?()[]{}<>*%$&#|"


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from the @ signs so that long words cost no more than their length."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", max(at + 1, last))
    return found


def _ips(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _DOTTED.finditer(text):
        parts, start = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((start, start + size))
            start += size + 1
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(m.span())
    return found


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches by kind as listed, then by start; places count code points, the end is exclusive."""
    if not text:
        return []
    return [(kind, a, b) for kind, find in zip(KINDS, (_emails, _ips, _cards, _phones), strict=True) for a, b in find(text)]


def _keys(core: str) -> list[str]:
    """What makes tokens alike: the text itself, the name before an @, the digits of a number."""
    low = core.lower()
    keys = [low]
    if "@" in low:
        keys.append(low.split("@")[0])
    digits = _NOT_DIGIT.sub("", low)
    if len(digits) > KEY and 2 * len(digits) > len(low):
        keys.append("#" + digits)
        if low[0] == "+":
            keys.append("#" + digits[-10:])
    return [k for k in dict.fromkeys(keys) if len(k.lstrip("#")) >= KEY]


def _shape(core: str) -> str:
    digits = sum(c in "0123456789" for c in core)
    letters = sum(c.isalpha() for c in core)
    size = min(digits, 8) if digits < 8 else 8 if digits < 12 else 12 if digits < 16 else 16
    return f"{size}{'a' if letters else ''}{'@' if '@' in core else ''}{'+' if '+' in core else ''}{min(core.count('.'), 3)}{'-' if '-' in core else ''}"


class Graph:
    """The nodes, observed labels (-1: not observed) and edges of one text."""

    __slots__ = ("chain", "labels", "places", "shapes", "skip")

    def __init__(self, text: str, spans: list[tuple[str, int, int]]):
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        cores, keyed, places = [], [], []
        seeds: set[str] = set()
        evident = []
        for i, (a, b) in enumerate(tokens):
            word = text[a:b]
            if "@" in word or not word.isalpha() and any(c in "0123456789" for c in word):
                core = word.strip(_EDGE) or word
                evident.append(i)
                seeds.update(_keys(core))
        chosen = set(evident)
        names = {s for s in seeds if s[0] != "#"}
        if names:
            chosen.update(i for i, (a, b) in enumerate(tokens) if text[a:b].strip(_EDGE).lower() in names)
        self.labels, self.shapes = [], []
        cover = sorted((a, b, LABELS.index(k)) for k, a, b in spans)
        at, last_token = 0, -9
        self.chain, self.skip = [], []
        seen: dict[str, list[int]] = {}
        for i in sorted(chosen):
            a, b = tokens[i]
            word = text[a:b]
            core = word.strip(_EDGE) or word
            a += word.find(core)
            b = a + len(core)
            while at < len(cover) and cover[at][1] <= a:
                at += 1
            node = len(self.labels)
            self.labels.append(next((c[2] for c in cover[at : at + 4] if c[0] < b and a < c[1]), -1))
            self.shapes.append(_shape(core))
            places.append((a, b))
            if i == last_token + 1:
                self.chain.append((node - 1, node))
            for k in _keys(core):
                seen.setdefault(k, []).append(node)
            last_token = i
        self.places = places
        # An occurrence that isn't observed is joined to the observed one before it, or else the first after it; occurrences among which none, or all, are
        # observed are joined to the one before.
        joined: set[tuple[int, int]] = set()
        for nodes in seen.values():
            known = [x for x in nodes if self.labels[x] >= 0]
            joined.update(zip(known, known[1:], strict=False))
            if not known:
                joined.update(zip(nodes, nodes[1:], strict=False))
            for x in nodes if known else []:
                if self.labels[x] < 0:
                    at = bisect.bisect_left(known, x)
                    twin = known[at - 1 if at else 0]
                    joined.add((min(x, twin), max(x, twin)))
        self.skip = sorted(joined)

    def possible(self) -> list[set[int]]:
        """The labels that observed nodes have in each node's component of skip edges: others are out of the question."""
        root = list(range(len(self.labels)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in self.skip:
            root[top(b)] = top(a)
        labels: dict[int, set[int]] = {}
        for x, y in enumerate(self.labels):
            if y >= 0:
                labels.setdefault(top(x), set()).add(y)
        return [labels.get(top(x), set()) for x in range(len(root))]


def _counts(graph: Graph) -> Counter:
    """What one text adds to the estimates. Nodes outside every base match count as "none", but for those that a skip edge
    joins to a match: what these are is what the field has to say, so they count as nothing."""
    open_ = {x for a, b in graph.skip for x, y in ((a, b), (b, a)) if graph.labels[x] < 0 <= graph.labels[y]}
    y = [max(v, 0) for v in graph.labels]
    out = Counter(("shape", s, str(v)) for i, (s, v) in enumerate(zip(graph.shapes, y, strict=True)) if i not in open_)
    for kind, edges in (("chain", graph.chain), ("skip", graph.skip)):
        out.update((kind, str(y[a]), str(y[b])) for a, b in edges if not open_ & {a, b})
    return out


def fit(docs: DataFrame, rows: int = SAMPLE) -> dict:
    """Potentials from a sample of at most about ``rows`` documents; an empty table gives flat ones with a mild pull to agree."""
    sample = _triggered(hash_sample(docs, rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for text in batch.column("text").to_pylist():
                if text:
                    total.update(_counts(Graph(text, base_spans(text))))
            cols = list(zip(*total, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in cols], pa.array(total.values(), pa.int64())], ["kind", "a", "b", "n"])

    summed = sample.select("text").mapInArrow(count, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    size = len(LABELS)
    shapes: dict[str, np.ndarray] = {}
    prior = np.ones(size)
    pair = {"chain": np.ones((size, size)), "skip": np.ones((size, size)) + 20 * np.eye(size)}
    for kind, a, b, n in summed.collect():  # at most a few hundred rows: shapes and labels are few
        if kind == "shape":
            shapes.setdefault(a, np.full(size, 0.5))[int(b)] += n
            prior[int(b)] += n
        else:
            pair[kind][int(a), int(b)] += n
    share = prior / prior.sum()

    def lift(m: np.ndarray) -> np.ndarray:
        p = (m + m.T) / (m + m.T).sum()
        return np.clip(np.log(p / np.outer(p.sum(0), p.sum(0))), -4, 4)

    unary = {s: np.log(v / v.sum()) for s, v in shapes.items()}
    return {"unary": unary, "rest": np.log(share), "chain": lift(pair["chain"]) / 2, "skip": lift(pair["skip"])}


def marginals(graph: Graph, model: dict) -> np.ndarray:
    """Label marginals of all nodes by damped loopy sum-product; exact where the graph has no cycle."""
    n, size = len(graph.labels), len(LABELS)
    unary = np.empty((n, size))
    for i, (s, y) in enumerate(zip(graph.shapes, graph.labels, strict=True)):
        unary[i] = model["unary"].get(s, model["rest"])
        if y >= 0:
            unary[i] = -1e12  # whatever arrives from however many others
            unary[i, y] = 0.0
    edges = np.array(graph.chain + graph.skip, dtype=np.int64).reshape(-1, 2)
    m = len(edges)
    if not m:
        belief = unary
    else:
        pots = np.concatenate([np.repeat(np.exp(model[k])[None], len(e), 0) for k, e in (("chain", graph.chain), ("skip", graph.skip))])
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pots = np.concatenate([pots, pots.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        msg = np.zeros((2 * m, size))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, dst, msg)
            out = belief[src] - msg[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(np.einsum("es,est->et", out, pots) + 1e-300)
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - msg).max()
            msg = DAMP * msg + (1 - DAMP) * new
            if moved < 1e-3:
                break
        belief = unary.copy()
        np.add.at(belief, dst, msg)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, spans: list[tuple[str, int, int]], model: dict) -> list[tuple[str, int, int]]:
    """The spans that the random field adds: runs of neighbouring nodes outside base matches with one accepted label."""
    graph = Graph(text, spans)
    if all(v >= 0 for v in graph.labels) or not (graph.chain or graph.skip):
        return []
    p = marginals(graph, model)
    best, possible = p.argmax(1), graph.possible()
    out: list[list] = []
    joined = set(graph.chain)
    for i, k in enumerate(best):
        if graph.labels[i] >= 0 or k not in possible[i] or p[i, k] < ACCEPT:
            continue
        a, b = graph.places[i]
        if out and out[-1][0] == LABELS[k] and (i - 1, i) in joined and out[-1][3] == i - 1:
            out[-1][2:] = [b, i]
        else:
            out.append([LABELS[k], a, b, i])
    return [(k, a, b) for k, a, b, _ in out]


def _triggered(docs: DataFrame) -> DataFrame:
    """Without a digit or an @ sign a text has no match and no node, so it isn't sent to Python."""
    return docs.select("*").withColumn("text", F.when(F.col("text").rlike("[0-9@]"), F.col("text")))


def _digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Per document: doc_id, counts of base matches, base_sha256, and all spans, base and added, as text."""
    model = model or fit(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                spans = sorted(base + (added_spans(text, base, model) if text else []), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
                n = Counter(s[0] for s in base)
                rows.append((*[n[k] for k in KINDS], hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(spans)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return _triggered(docs.select("doc_id", "text")).mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in angle brackets, and n_chars counted anew where it exists.

    All rows, repeated ones too, and all other columns of any name stay; null and empty texts stay as they are; an empty table gives an empty result.
    Of spans that overlap, the first takes the place of all of them.
    """
    model = model or fit(docs)
    look = f"__look_{uuid.uuid4().hex[:12]}"

    def scrub(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in slices(texts):
            at = batch.schema.get_field_index("text")
            hot = batch.schema.get_field_index(look)
            out = []
            for text, marked in zip(batch.column(at).to_pylist(), batch.column(hot).to_pylist(), strict=True):
                if text and marked:
                    base = base_spans(text)
                    last, parts = 0, []
                    for k, a, b in sorted(base + added_spans(text, base, model), key=lambda s: (s[1], -s[2])):
                        if a >= last:
                            parts += [text[last:a], f"<{k.upper()}>"]
                        last = max(last, b)
                    text = "".join(parts) + text[last:]
                out.append(text)
            cols = [pa.array(out, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(batch.num_columns) if i != hot]
            yield pa.RecordBatch.from_arrays(cols, [f.name for i, f in enumerate(batch.schema) if i != hot])

    out = docs.withColumn(look, F.col("text").rlike("[0-9@]")).mapInArrow(scrub, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
