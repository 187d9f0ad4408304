"""Approximate-repeat compression: bits of each symbol when it may also be copied, with mutations, from an earlier place.

At every symbol the sequence is either in the base state (its symbol comes from a sequence model) or inside a copy of the text from an earlier place, made by
one of any number of machines: forward, or as a reverse complement, of one or three states. A copy keeps, for each source place, the chance of three states
(diagonal, inserted, skipped). A symbol costs what it adds to the code length of the whole past; the mass of copies that end joins the base state only for the
next symbol.

A machine holds its live places only, in order. In full mode all earlier places are live. With seeds, places become live around an earlier occurrence of the next
symbols, move along with the copy, and die when they are old and no better than a new copy by some bits, which also splits what was one stretch.

Chances run as weights, scaled at each symbol, and the expected numbers of all events go along with them, so that a pass over the sequence gives what the
next pass needs to estimate the parameters anew.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from bitloom.operators import places
from bitloom.operators.align import AFFINE, EVENTS, LINEAR, NAMES, PAIR, estimate

#: Costs of staying in the base state, of starting a copy (shared by all machines), and of ending and continuing one (fixed values of the method).
COSTS = {"nostart": -math.log2(0.9), "start": -math.log2(0.1), "end": -math.log2(0.1), "cont": -math.log2(0.9)}
COMPLEMENT = {"a": "t", "t": "a", "c": "g", "g": "c"}
#: Kinds of machines by name: states and start costs of a copy's events.
MACHINES: dict[str, tuple[int, dict[str, float]]] = {"1state": (1, LINEAR), "3state": (3, AFFINE)}
#: A pass that gains fewer bits is the last one.
LEAST_GAIN, MAX_PASSES = 1e-4, 50


def start_params(kinds: list[str], table: np.ndarray | None = None) -> dict[str, dict]:
    """Parameters before any estimate: those of copying (``copy``) and those of each kind of machine; ``table`` is a chance [symbol, source symbol]."""
    own = {k: {**PAIR, **MACHINES[k][1]} | ({"table": np.asarray(table, float)} if table is not None else {}) for k in dict.fromkeys(kinds)}
    return {"copy": dict(COSTS)} | own


class Machine:
    """One copy machine: its live source places, the weights of their states, and with each weight its products with the numbers of events so far.

    ``at`` names where the events of the machine's kind stand among all events.
    """

    def __init__(self, source: np.ndarray, step: int, params: dict, events: int, at: int, size: int):
        self.source, self.step, self.at, self.size = source, step, at, size
        self.w = {k: 2.0 ** -params[k] for k in (*NAMES, *PAIR)}
        self.table = params.get("table")
        self.live = np.zeros(0, np.int64)
        self.age = np.zeros(0, np.int64)
        self.cells = np.zeros((events, 3, 0))

    def activate(self, new: np.ndarray) -> None:
        """Makes places live, with no weight yet."""
        new = np.setdiff1d(new, self.live)
        if len(new):
            live = np.concatenate([self.live, new])
            order = np.argsort(live)
            self.live, self.age = live[order], np.concatenate([self.age, np.zeros(len(new), np.int64)])[order]
            self.cells = np.concatenate([self.cells, np.zeros((*self.cells.shape[:2], len(new)))], 2)[:, :, order]

    def cull(self, limit: float, age: int) -> None:
        """Places older than ``age`` with no state above ``limit`` die."""
        keep = (self.age <= age) | (self.cells[0].max(0) >= limit) if len(self.live) else np.zeros(0, bool)
        if not keep.all():
            self.live, self.age, self.cells = self.live[keep], self.age[keep], self.cells[:, :, keep]

    def advance(self, i: int, symbol: int) -> np.ndarray:
        """Copies symbol i; the weights of all cells after it, summed (and with the numbers of events)."""
        w, live, k = self.w, self.live, self.at
        match, from_d_, start_d, from_i_, start_i, cont = (k + EVENTS.index(e) for e in EVENTS)
        d, h, v = self.cells[:, 0], self.cells[:, 1], self.cells[:, 2]
        into_d, into_i = w["diag_fromD"] * d, w["diag_fromI"] * (h + v)
        into = into_d + into_i
        equal = self.source[live] == symbol
        counted = len(self.cells) > 1
        if counted:
            into[match] += np.where(equal, into[0], 0)
            into[from_d_] += into_d[0]
            into[from_i_] += into_i[0]
        if self.table is None:
            into *= np.where(equal, w["match"], w["change"] / max(1, self.size - 1))
        else:
            if counted:
                which = symbol * self.size + self.source[live] + k + len(EVENTS)
                into[which, np.arange(len(live))] += into[0]
            into *= self.table[symbol, self.source[live]]
        starts, goes, turns = w["start_fromD"] * d, w["cont_fromI"] * h, w["start_fromI"] * v
        ins = starts + goes + turns
        if counted:
            ins[start_d] += starts[0]
            ins[cont] += goes[0]
            ins[start_i] += turns[0]
        ins /= self.size
        moved = live + self.step
        good = (moved >= 0) & (moved <= i)
        after = np.union1d(live, moved[good])
        new = np.zeros((len(self.cells), 3, len(after)))
        new[:, 0, np.searchsorted(after, moved[good])] = into[:, good]
        stay = np.searchsorted(after, live)
        new[:, 1, stay] = ins
        age = np.zeros(len(after), np.int64)
        age[np.searchsorted(after, moved[good])] = self.age[good] + 1
        age[stay] = np.maximum(age[stay], self.age + 1)
        # skipped source symbols: a decaying sum along the copy's direction, over places that follow each other
        a, b = w["start_fromD"] * new[:, 0], w["start_fromI"] * new[:, 1]
        gain = a + b
        if counted:
            gain[start_d] += a[0]
            gain[start_i] += b[0]
        skip = self._beside(gain, after, 1)
        reach = 1
        while reach < len(after) and reach * -math.log2(max(w["cont_fromI"], 1e-300)) < 60:
            far = w["cont_fromI"] ** reach * self._beside(skip, after, reach)
            if counted:
                far[cont] += reach * far[0]
            skip = skip + far
            reach *= 2
        new[:, 2] = skip
        self.live, self.age, self.cells = after, age, new
        return new.sum((1, 2))

    def _beside(self, x: np.ndarray, live: np.ndarray, by: int) -> np.ndarray:
        """``x`` of the place that lies ``by`` places before each one, along the copy's direction; nothing where a place between isn't live."""
        out = np.zeros_like(x)
        if by < len(live):
            whole = live[by:] - live[:-by] == by
            if self.step > 0:
                out[:, by:] = np.where(whole, x[:, :-by], 0)
            else:
                out[:, :-by] = np.where(whole, x[:, by:], 0)
        return out


def _seeds(text: bytes, i: int, length: int, seen: dict[bytes, list[int]], around: int, reverse: bytes | None) -> np.ndarray:
    """Source places around earlier occurrences of the ``length`` symbols from i on, or of what their reverse complement spells."""
    if i + length > len(text):
        return np.zeros(0, np.int64)
    if reverse is None:
        hits = np.array([j for j in seen.get(text[i : i + length], ()) if j < i - 1], np.int64)
    else:
        hits = np.array([j + length - 1 for j in seen.get(reverse[i : i + length][::-1], ()) if j + length <= i], np.int64)
    if not len(hits):
        return hits
    near = (hits[:, None] + np.arange(-around, around + 1)).ravel()
    return np.unique(near[(near >= 0) & (near < i)])


def one_pass(seq: str, params: dict[str, dict], alphabet: str, machines: list[tuple[str, int]], model: str, models: dict | None, seed: int, window: int, around: int, cut: float, each: Callable | None = None, counted: bool = True) -> tuple[np.ndarray, dict[str, dict]]:
    """(bits of each symbol, expected numbers of events by kind of machine and of copying, if ``counted``) under the given parameters.

    ``each`` gets (i, live places, their shares, step) for every machine after every symbol, and (i, None, share, 0) for the base state: shares sum to one.
    """
    size = len(alphabet)
    x = places.coded(seq, alphabet)
    chance = places.chances(model, x, size, models)
    kinds = list(dict.fromkeys(k for k, _ in machines))
    per = len(EVENTS) + (size**2 if any("table" in params[k] for k in kinds) else 0)
    at = {k: 5 + n * per for n, k in enumerate(kinds)}  # place 0: the weight itself
    events = 5 + per * len(kinds) if counted else 1
    nostart, start, end, cont = 1, 2, 3, 4
    go = {k: 2.0**-v for k, v in params["copy"].items()}
    y = places.coded("".join(COMPLEMENT[c] for c in seq), alphabet) if any(s < 0 for _, s in machines) else None
    made = [Machine(x if s > 0 else y, s, params[k], events, at[k], size) for k, s in machines]
    text, turned = x.astype(np.uint8).tobytes(), None if y is None else y.astype(np.uint8).tobytes()
    base, before, shift, seen = np.zeros(events), 1.0, 0.0, {}
    base[0] = 1.0
    bits = np.zeros(len(x))
    last = base
    for i, s in enumerate(x):
        new_copy = base * go["start"] / max(1, len(made)) / (i + 1)
        if counted:
            new_copy[start] += new_copy[0]
        for m in made:
            if seed:
                m.cull(new_copy[0] * 2.0**cut, window)
                m.activate(_seeds(text, i, seed, seen, around, None if m.step > 0 else turned))
            elif i:
                m.activate(np.arange(i))
            if i:
                early = m.live < i
                m.cells[:, 0, early] += new_copy[:, None]
        alone = base * chance[i, s]
        if i and made:
            alone *= go["nostart"]
            if counted:
                alone[nostart] += alone[0]
        back = last = alone
        for m in made:
            total = m.advance(i, int(s))
            ended = total * go["end"]
            m.cells *= go["cont"]
            if counted:
                ended[end] += ended[0]
                m.cells[cont] += m.cells[0]
            back = back + ended
            last = last + m.cells.sum((1, 2))
        bits[i] = math.log2(before / last[0])
        if each:
            each(i, None, alone[0] / last[0], 0)
            for m in made:
                each(i, m.live, m.cells[0].sum(0) / last[0], m.step)
        before, base = last[0], back
        scale = 2.0 ** -math.frexp(before)[1]  # keeps weights within range
        shift += math.log2(scale)
        base, before, last = base * scale, before * scale, last * scale
        for m in made:
            m.cells *= scale
        if seed and i + 1 >= seed:
            seen.setdefault(text[i + 1 - seed : i + 1], []).append(i + 1 - seed)
    if not counted:
        return bits, {}
    number = last / last[0]
    counts: dict[str, dict] = {"copy": dict(zip(("nostart", "start", "end", "cont"), number[1:5], strict=True))}
    for k in kinds:
        own = dict(zip(EVENTS, number[at[k] : at[k] + len(EVENTS)], strict=True))
        own["change"] = own["diag_fromD"] + own["diag_fromI"] - own["match"]
        if "table" in params[k]:
            own["table"] = number[at[k] + len(EVENTS) : at[k] + per].reshape(size, size)
        counts[k] = own
    return bits, counts


def full_bits(seqs: list[str], alphabet: str, kinds: list[str], model: str, models: dict | None = None) -> list[np.ndarray]:
    """Bits of each symbol of each sequence under the start parameters, all earlier places being live, by forward machines: :func:`one_pass` of many sequences
    of similar lengths at once."""
    size, params = len(alphabet), start_params(kinds)
    codes = [places.coded(s, alphabet) for s in seqs]
    many, longest = len(seqs), max(map(len, seqs))
    x, chance = np.zeros((many, longest), np.int64), np.ones((many, longest))
    for n, c in enumerate(codes):
        x[n, : len(c)] = c
        chance[n, : len(c)] = places.chances(model, c, size, models)[np.arange(len(c)), c]
    go = {k: 2.0**-v for k, v in params["copy"].items()}
    made = [({k: 2.0 ** -params[name][k] for k in (*NAMES, *PAIR)}, np.zeros((3, many, longest))) for name in kinds]
    base, before, bits = np.ones(many), np.ones(many), np.zeros((many, longest))
    for i in range(longest):
        new_copy = base * go["start"] / max(1, len(made)) / (i + 1)
        alone = base * chance[:, i]
        if i and made:
            alone *= go["nostart"]
        back, last = alone, alone.copy()
        equal = x[:, :i] == x[:, i : i + 1]
        for w, cells in made:
            d, h, v = cells[:, :, :i]
            d += new_copy[:, None]
            into = (w["diag_fromD"] * d + w["diag_fromI"] * (h + v)) * np.where(equal, w["match"], w["change"] / max(1, size - 1))
            h[:] = (w["start_fromD"] * d + w["cont_fromI"] * h + w["start_fromI"] * v) / size
            new = cells[:, :, : i + 1]
            new[0, :, 0], new[0, :, 1:] = 0, into
            # skipped source symbols: a decaying sum along the sequence
            skip, reach = np.zeros((many, i + 1)), 1
            skip[:, 1:] = w["start_fromD"] * new[0, :, :-1] + w["start_fromI"] * new[1, :, :-1]
            while reach < i + 1 and reach * -math.log2(max(w["cont_fromI"], 1e-300)) < 60:
                far = w["cont_fromI"] ** reach * skip[:, :-reach]
                skip[:, reach:] += far
                reach *= 2
            new[2] = skip
            back = back + new.sum((0, 2)) * go["end"]
            new *= go["cont"]
            last += new.sum((0, 2))
        bits[:, i] = np.log2(before / last)
        scale = np.ldexp(1.0, -np.frexp(last)[1])  # keeps weights within range
        base, before = back * scale, last * scale
        for _, cells in made:
            cells[:, :, : i + 1] *= scale[:, None]
    return [b[: len(c)] for b, c in zip(bits, codes, strict=True)]


def next_params(params: dict[str, dict], counts: dict[str, dict]) -> dict[str, dict]:
    """Parameters from the expected numbers of events of a pass, half an event of each kind added."""
    c = {k: v + 0.5 for k, v in counts["copy"].items()}
    bits = lambda a, b: (-math.log2(c[a] / (c[a] + c[b])), -math.log2(c[b] / (c[a] + c[b])))
    copy = dict(zip(("nostart", "start"), bits("nostart", "start"), strict=True)) | dict(zip(("end", "cont"), bits("end", "cont"), strict=True))
    out = {"copy": copy}
    for k, own in counts.items():
        if k != "copy":
            pair, cost = estimate({e: v + 0.5 for e, v in own.items() if e != "table"}, MACHINES[k][0])
            out[k] = {**pair, **cost}
            if "table" in own:
                table = own["table"] + 0.5
                out[k]["table"] = table / table.sum(0)
    return out


def passes_of(seq: str, alphabet: str = "acgt", order: int = 0, forward: tuple[str, ...] = ("3state",), reverse: tuple[str, ...] = ("3state",), seed: int = 0, window: int = 10, around: int = 10, cut: float = 4.0, skip: int = 0, passes: int = 1, model: str | None = None, models: dict | None = None, table: np.ndarray | None = None, each: Callable | None = None) -> tuple[np.ndarray, int, dict[str, dict]]:
    """(bits of each symbol from ``skip`` on, passes made, parameters of the last one).

    ``forward``, ``reverse``: names of machines (reverse ones are left out where letters have no complement). ``seed`` 0 lets copies start anywhere; k > 0 only
    within ``around`` places of where the next k symbols have occurred before, and places older than ``window`` symbols live on only while they are ``cut``
    bits better than a new copy. ``passes``: 0 goes on until a pass gains less than LEAST_GAIN (MAX_PASSES at most). ``model``: the base state's, adaptive of
    the given order by default. ``table``: chances [symbol, source symbol] of a copied symbol, in place of match and change; estimated anew like all others.
    """
    machines = [(k, 1) for k in forward] + [(k, -1) for k in reverse if set(alphabet) <= set(COMPLEMENT)]
    for k, _ in machines:
        if k not in MACHINES:
            raise ValueError(f"unknown machine: {k}")
    params = start_params([k for k, _ in machines], table)
    length = math.inf
    for made in range(1, (passes or MAX_PASSES) + 1):
        final = each if made == passes else None
        bits, counts = one_pass(seq, params, alphabet, machines, model or f"adaptive({order})", models, seed, window, around, cut, final, counted=made != passes)
        now = float(bits.sum())
        if made == passes or length - now < LEAST_GAIN:
            break
        length, used = now, params
        params = next_params(used, counts)
    return bits[skip:], made, params


#: Cells of sequences that are worked on together: what a core's cache holds.
TOGETHER = 16_384


def passes_all(seqs: list[str], skips: list[int], **options) -> list[tuple[np.ndarray, int]]:
    """(bits of each symbol from its skip on, passes made) of each sequence. One pass over all earlier places by forward machines goes over sequences of similar lengths at once."""
    plain = {"alphabet": "acgt", "order": 0, "forward": ("3state",), "reverse": ("3state",), "model": None, "models": None} | options
    turned = plain["reverse"] and set(plain["alphabet"]) <= set(COMPLEMENT)
    if turned or set(plain) - {"alphabet", "order", "forward", "reverse", "model", "models"} or any(k not in MACHINES for k in plain["forward"]):
        return [passes_of(s, skip=n, **options)[:2] for s, n in zip(seqs, skips, strict=True)]
    out: list[tuple[np.ndarray, int]] = [(np.zeros(0), 1)] * len(seqs)
    order, at = sorted((i for i, s in enumerate(seqs) if s), key=lambda i: -len(seqs[i])), 0
    while at < len(order):
        part = order[at : at + max(1, TOGETHER // len(seqs[order[at]]))]
        at += len(part)
        for i, bits in zip(part, full_bits([seqs[i] for i in part], plain["alphabet"], list(plain["forward"]), plain["model"] or f"adaptive({plain['order']})", plain["models"]), strict=True):
            out[i] = (bits[skips[i] :], 1)
    return out


def symbol_bits(seq: str, **options) -> list[float]:
    """Bits of each symbol; options as of :func:`passes_of`."""
    return passes_of(seq, **options)[0].tolist()


def matches(seq: str, bins: int = 1, **options) -> list[tuple[int, int, int, float]]:
    """(i, j, direction, share): after symbol i, the share of each source place j, the largest within squares of ``bins`` places; direction 0 is the base state.

    With ``bins`` 1 the shares of a symbol sum to one.
    """
    best: dict[tuple[int, int, int], float] = {}

    def each(i: int, live: np.ndarray | None, share, step: int) -> None:
        for j, p in [(i, share)] if live is None else zip(live.tolist(), share.tolist(), strict=True):
            if p > 0:
                cell = (i // bins, j // bins, step)
                best[cell] = max(best.get(cell, 0.0), float(p)) if bins > 1 else best.get(cell, 0.0) + float(p)

    passes_of(seq, each=each, **{"passes": 1} | options)
    return [(*cell, p) for cell, p in best.items()]


def match_map(df: DataFrame, key: str, bins: int = 1, least: float = 0.0, seq: str = "seq", **options) -> DataFrame:
    """(key, i, j, direction, share) of :func:`matches` with a share above ``least``; a row of the frame at a time."""
    kind = df.schema[key].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for k, s in zip(pdf[key], pdf[seq], strict=True):
                rows = [(k, *cell) for cell in matches(s, bins, **options) if cell[3] > least] if s else []
                yield pd.DataFrame(rows, columns=[key, "i", "j", "direction", "share"])

    return df.select(key, seq).mapInPandas(run, f"{key} {kind}, i int, j int, direction int, share double")


def compress(df: DataFrame, key: str, seq: str = "seq", prefix: str | None = None, per_symbol: bool = False, **options) -> DataFrame:
    """Per sequence (key, length, bits, passes), or per symbol (key, pos, sym, bits); ``prefix`` names a column that is known beforehand.

    Options as of :func:`passes_of`. Memory is that of a sequence and its live places; with seeds, time follows the live places.
    """
    kind = df.schema[key].dataType.simpleString()
    cols = [key, seq, *([prefix] if prefix else [])]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            given = pdf.to_dict("records")
            told = [((r[prefix] or "") if prefix else "", r[seq] or "") for r in given]
            for r, (_, s), (bits, made) in zip(given, told, passes_all([p + s for p, s in told], [len(p) for p, _ in told], **options), strict=True):
                rows += [(r[key], i, c, b) for i, (c, b) in enumerate(zip(s, bits.tolist(), strict=True))] if per_symbol else [(r[key], len(s), float(bits.sum()), made)]
            yield pd.DataFrame(rows, columns=[key, "pos", "sym", "bits"] if per_symbol else [key, "length", "bits", "passes"])

    schema = f"{key} {kind}, pos int, sym string, bits double" if per_symbol else f"{key} {kind}, length long, bits double, passes int"
    # a fixed number of tasks, since adaptive execution would put these small rows, which cost a lot each, into a few
    return df.select(*cols).repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key).mapInPandas(run, schema)
