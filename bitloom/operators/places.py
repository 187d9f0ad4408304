"""Sequence models by place: what each symbol would cost at each place of a sequence, given what comes before it.

A model is a small object that states the costs of all symbols before it is told which one came, so it can't look ahead. Whatever the model, its costs
are checked: at every place the chances sum to one. Tables of costs or chances that come from elsewhere, as rows (key, pos, sym, bits) or (key, pos, p), are
checked alike and laid out in pieces of bounded size, which aligner windows join.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A place's chances may miss one by this many bits.
TOLERANCE = 1e-10


class SequenceModel(Protocol):
    """A model that goes along a sequence."""

    def costs(self) -> np.ndarray:
        """Bits of each symbol, were it the next one."""

    def update(self, symbol: int) -> None:
        """Tells the model which symbol came."""


class Fixed:
    """Chances that depend on the symbol before, table[before, symbol]; the first symbol is uniform."""

    def __init__(self, table: np.ndarray):
        self.bits, self.size, self.last = -np.log2(table), len(table), None

    def costs(self) -> np.ndarray:
        return np.full(self.size, np.log2(self.size)) if self.last is None else self.bits[self.last]

    def table(self, codes: np.ndarray) -> np.ndarray:
        """Costs at all places of a sequence, each by the symbol before it."""
        first = np.full((min(1, len(codes)), self.size), np.log2(self.size))
        return np.concatenate([first, self.bits[codes[:-1]]])

    def update(self, symbol: int) -> None:
        self.last = symbol


class Adaptive:
    """Order k, learned on the way, one count beforehand; order -1 is uniform."""

    def __init__(self, size: int, order: int):
        self.size, self.order, self.past, self.counts = size, order, (), {}

    def costs(self) -> np.ndarray:
        seen = self.counts.get(self.past) if self.order >= 0 and len(self.past) == self.order else None
        return np.full(self.size, np.log2(self.size)) if seen is None else np.log2(seen.sum()) - np.log2(seen)

    def table(self, codes: np.ndarray) -> np.ndarray | None:
        """Costs at all places of a sequence, if nothing is learned."""
        return np.full((len(codes), self.size), np.log2(self.size)) if self.order < 0 else None

    def update(self, symbol: int) -> None:
        if self.order < 0:
            return
        if len(self.past) == self.order:
            self.counts.setdefault(self.past, np.ones(self.size))[symbol] += 1
        self.past = (*self.past, symbol)[-self.order :] if self.order else ()


class Blend:
    """Models weighed by what each has cost of late: its evidence m becomes (m + cost) / decay, its weight is 2 ** -m."""

    def __init__(self, parts: list[SequenceModel], decay: float = 1.5):
        self.parts, self.decay, self.evidence = parts, decay, np.ones(len(parts))

    def costs(self) -> np.ndarray:
        weight = np.exp2(self.evidence.min() - self.evidence)
        return -np.log2(weight @ np.exp2(-np.array([m.costs() for m in self.parts])) / weight.sum())

    def table(self, codes: np.ndarray) -> np.ndarray | None:
        """Costs at all places of a sequence, each by the symbols before it, if the parts can tell theirs."""
        each = [m.table(codes) if hasattr(m, "table") else None for m in self.parts]
        if any(t is None for t in each):
            return None
        cost = np.stack(each)  # part, place, symbol
        paid, evidence = cost[:, np.arange(len(codes)), codes], np.empty((len(each), len(codes)))
        for part, start in enumerate(self.evidence.tolist()):
            now, of = start, evidence[part]
            for i, c in enumerate(paid[part].tolist()):
                of[i] = now
                now = (now + c) / self.decay
        weight = np.exp2(evidence.min(0) - evidence)
        return -np.log2((weight[:, :, None] * np.exp2(-cost)).sum(0) / weight.sum(0)[:, None])

    def update(self, symbol: int) -> None:
        self.evidence = (self.evidence + [m.costs()[symbol] for m in self.parts]) / self.decay
        for m in self.parts:
            m.update(symbol)


#: Models by name: (size of the alphabet, order) -> a model. :func:`register` adds to them.
MODELS: dict[str, Callable[[int, int], SequenceModel]] = {
    "uniform": lambda size, order: Adaptive(size, -1),
    "adaptive": Adaptive,
    "markov": Adaptive,
    "blend": lambda size, order: Blend([Adaptive(size, k) for k in range(-1, order + 1)]),
}


def register(name: str, make: Callable[[int, int], SequenceModel]) -> None:
    """Makes ``name`` and ``name(k)`` known to :func:`chances`; also on executors, if called where the query is defined and shipped with ``models``."""
    MODELS[name] = make


def along(model: SequenceModel, codes: np.ndarray, size: int) -> np.ndarray:
    """p[i, s]: the chance that the model gives symbol s at place i. A place that doesn't sum to one raises. A fresh model that has ``table`` is asked for all places at once."""
    known = model.table(codes) if hasattr(model, "table") else None
    if known is not None:
        return summing_to_one(np.exp2(-known))
    bits = np.empty((len(codes), size))
    for i, s in enumerate(codes):
        bits[i] = model.costs()
        model.update(int(s))
    return summing_to_one(np.exp2(-bits))


def summing_to_one(p: np.ndarray) -> np.ndarray:
    """``p``, if each of its rows sums to one."""
    if len(p):
        off = np.abs(np.log2(np.maximum(p.sum(1), 1e-300)))
        if off.max() > TOLERANCE:
            raise ValueError(f"the chances at place {int(off.argmax())} don't sum to one")
    return p


def fitted(codes: np.ndarray, order: int, size: int) -> np.ndarray:
    """p[i, s] under a model of the given order fitted to the sequence itself; order -1 is uniform."""
    p = np.full((len(codes), size), 1.0 / size)
    if order >= 0 and len(codes) > order:
        ctx = np.zeros(len(codes) - order, np.int64)
        for j in range(order):
            ctx = ctx * size + codes[j : len(codes) - order + j]
        counts = np.ones((size**order, size))
        np.add.at(counts, (ctx, codes[order:]), 1)
        p[order:] = (counts / counts.sum(1, keepdims=True))[ctx]
    return p


def chances(name: str, codes: np.ndarray, size: int, models: dict[str, Callable[[int, int], SequenceModel]] | None = None) -> np.ndarray:
    """p[i, s] under the model that a string names: ``uniform``, ``fitted(k)``, ``adaptive(k)``, ``blend(k)``, or one of ``models``."""
    m = re.fullmatch(r"(\w+)(?:\((-?\d+)\))?", name)
    known = MODELS | (models or {})
    if m and m.group(1) == "fitted":
        return fitted(codes, int(m.group(2) or 0), size)
    if not m or m.group(1) not in known:
        raise ValueError(f"unknown model: {name}")
    return along(known[m.group(1)](size, int(m.group(2) or 0)), codes, size)


def coded(seq: str, alphabet: str) -> np.ndarray:
    """Places of the symbols in the alphabet; a symbol that it lacks raises."""
    at = np.full(0x110000 if alphabet and max(alphabet) > "\x7f" else 128, -1, np.int64)
    at[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    codes = np.frombuffer(seq.encode("utf-32-le"), np.uint32)
    if len(codes) and (codes.max() >= len(at) or at[codes].min() < 0):
        raise ValueError("a symbol that the alphabet lacks")
    return at[codes]


PIECE = "tile int, start int, n int, first int, seq string, p array<double>, bits double"


def pieces(df: DataFrame, key: str, tile: int, overlap: int, model: str = "fitted(0)", alphabet: str = "acgt", seq: str = "seq", models: dict | None = None) -> DataFrame:
    """(key, tile, start, n, first, seq, p, bits): each sequence in pieces.

    Tile t has the symbols from t * tile on, and ``overlap`` more before them. start: where the piece begins, n: the whole sequence's length, first: the first cell
    (number of symbols used) that is the tile's own, p: the chances of all symbols at each place, one place after another, bits: what the
    tile's own symbols cost. A null or empty sequence has no pieces.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, s in zip(pdf[key], pdf[seq], strict=True):
                if not s:
                    continue
                codes = coded(s, alphabet)
                p = chances(model, codes, len(alphabet), models)
                cost, rows = -np.log2(p[np.arange(len(s)), codes]), []
                for t in range(-(-len(s) // tile)):
                    start = max(0, t * tile - overlap)
                    part = slice(start, (t + 1) * tile)
                    rows.append((k, t, start, len(s), t * tile - start + 1 if t else 0, s[part], p[part].ravel(), float(cost[t * tile : part.stop].sum())))
                yield pd.DataFrame(rows, columns=[key, "tile", "start", "n", "first", "seq", "p", "bits"])

    return df.select(key, seq).mapInPandas(run, f"{key} {kind}, {PIECE}")


def checked(p: Column, size: int) -> Column:
    """An array of chances, if it has ``size`` of them that sum to one within TOLERANCE bits; else the query fails."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    good = (F.size(p) == size) & (F.abs(F.log2(total)) <= TOLERANCE)
    return F.when(F.coalesce(good, F.lit(False)), p).otherwise(F.raise_error(F.lit("the chances at a place don't sum to one")))


def pieces_of_table(df: DataFrame, table: DataFrame, key: str, tile: int, overlap: int, alphabet: str = "acgt", seq: str = "seq") -> DataFrame:
    """:func:`pieces` of sequences whose chances come from a table (key, pos, p), p in the order of the alphabet.

    A place that is missing, twice there, or doesn't sum to one fails the query. Places go to the tiles that show them, so no sequence's table is in one row.
    """
    size = len(alphabet)
    good = table.select(key, "pos", checked(F.col("p"), size).alias("p"))
    last = F.floor((F.col("pos") + overlap) / tile)
    shown = good.withColumn("tile", F.explode(F.sequence(F.floor(F.col("pos") / tile).cast("int"), last.cast("int"))))
    rows = shown.groupBy(key, "tile").agg(F.sort_array(F.collect_list(F.struct("pos", "p"))).alias("rows"))  # a tile and its overlap
    n = F.char_length(seq)
    cut = df.filter(n > 0).select(key, seq, n.alias("n"), F.explode(F.sequence(F.lit(0), F.ceil(n / tile).cast("int") - 1)).alias("tile"))
    begin = F.greatest(F.lit(0), F.col("tile") * tile - overlap)
    cut = cut.withColumn("start", begin.cast("int")).withColumn("first", F.when(F.col("tile") == 0, 0).otherwise(F.col("tile") * tile - F.col("start") + 1).cast("int"))
    part = cut.select(key, "tile", "start", "n", "first", F.col(seq).substr(F.col("start") + 1, (F.col("tile") + 1) * tile - F.col("start")).alias("seq"))
    got = part.join(rows, [key, "tile"], "left")
    places = F.transform("rows", lambda r: r["pos"])
    want = F.sequence(F.col("start").cast("long"), (F.col("start") + F.char_length("seq") - 1).cast("long"))
    whole = F.coalesce(places == want, F.lit(False))
    p = F.when(whole, F.flatten(F.transform("rows", lambda r: r["p"]))).otherwise(F.raise_error(F.lit("a place without chances, or twice")))
    got = got.select(key, "tile", "start", "n", "first", "seq", p.alias("p"))
    own = F.sequence(F.greatest(F.col("first") - 1, F.lit(0)), F.char_length("seq") - 1)
    symbol = lambda i: F.instr(F.lit(alphabet), F.col("seq").substr(i + 1, F.lit(1))) - 1
    return got.withColumn("bits", F.aggregate(own, F.lit(0.0), lambda a, i: a - F.log2(F.get("p", i * size + symbol(i)))))


def bits_to_chances(table: DataFrame, key: str, alphabet: str = "acgt") -> DataFrame:
    """(key, pos, p) of a long table (key, pos, sym, bits)."""
    order = F.transform(F.sort_array(F.collect_list(F.struct(F.instr(F.lit(alphabet), F.col("sym")).alias("at"), F.pow(F.lit(2.0), -F.col("bits")).alias("p")))), lambda x: x["p"])
    return table.groupBy(key, "pos").agg(order.alias("p"))
