"""Edit distances of long, similar sequences by furthest-reaching points: what a pair costs grows with its length and the square of its distance.

For each cost and each diagonal only the furthest cell that can be reached is kept. From one cost to the next it moves on by a change, a deletion or an
insertion and then slides along equal symbols. All diagonals of many pairs move together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Symbols of the pairs that are worked on together, cells of the points that they keep for a script, and a point that can't be reached.
SYMBOLS, POINTS, NEVER = 1 << 20, 1 << 23, -(1 << 40)


def _joined(texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
    """All code points, a mark ``end`` after each text, and where each text starts."""
    size = np.array([len(t) + 1 for t in texts])
    start = np.cumsum(size) - size
    out = np.full(int(size.sum()), end, np.int32)
    inside = np.ones(len(out), bool)
    inside[start + size - 1] = False
    out[inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return out, start


def _slide(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols are equal from each place x of ``a`` and y of ``b`` on; the end marks differ, so none slides out of its pair."""
    far, going, width = np.zeros(len(x), np.int64), np.arange(len(x)), 4
    while len(going):
        step = np.arange(width)
        at = far[going, None] + step
        differs = a.take(x[going, None] + at, mode="clip") != b.take(y[going, None] + at, mode="clip")
        stop = differs.argmax(1)
        whole = ~differs[np.arange(len(going)), stop]
        far[going] += np.where(whole, width, stop)
        going = going[whole]
        width = int(min(2 * width, max(4, SYMBOLS // max(1, len(going)))))
    return far


def _points(pairs: list[tuple[str, str]], limit: int | None, kept: list | None) -> np.ndarray:
    """Distance of each pair, -1 above ``limit``. ``kept`` gets the furthest places in the first text for each cost: (pairs still open, points)."""
    (a, start_a), (b, start_b) = _joined([x for x, _ in pairs], -1), _joined([y for _, y in pairs], -2)
    n, m = np.array([len(x) for x, _ in pairs]), np.array([len(y) for _, y in pairs])
    out = np.full(len(pairs), -1)
    live = np.arange(len(pairs))
    if limit is not None:
        live = live[abs(n - m)[live] <= limit]
    far, cost = np.full((len(live), 1), 0), 0
    while len(live):
        k = np.arange(-cost, cost + 1)  # place in the first text less place in the second
        if cost:
            before, far = far, np.full((len(live), 2 * cost + 1), NEVER)
            np.maximum(far[:, 1:-1], before + 1, out=far[:, 1:-1])
            np.maximum(far[:, 2:], before + 1, out=far[:, 2:])
            np.maximum(far[:, :-2], before, out=far[:, :-2])
        far[(far < 0) | (far > n[live, None]) | (far - k < 0) | (far - k > m[live, None])] = NEVER
        row, at = np.nonzero(far >= 0)
        x, y = far[row, at], far[row, at] - k[at]
        far[row, at] += _slide(a, b, start_a[live[row]] + x, start_b[live[row]] + y)
        if kept is not None:
            kept.append((live, far))
        # the diagonal of the end is among those of a cost once the cost is not less than the difference in length
        target = n[live] - m[live] + cost
        done = (target >= 0) & (target <= 2 * cost)
        done[done] = far[done, target[done]] == n[live[done]]
        out[live[done]] = cost
        live, far = live[~done], far[~done]
        if cost == limit:
            break
        cost += 1
    return out


def distances(pairs: list[tuple[str, str]], limit: int | None = None) -> list[int]:
    """Least number of changed, inserted and deleted symbols of each pair, -1 if it is above ``limit``."""
    out = np.full(len(pairs), -1)
    for part in _parts(pairs, None):
        out[part] = _points([pairs[p] for p in part], limit, None)
    return out.tolist()


def scripts(pairs: list[tuple[str, str]], limit: int) -> list[tuple[int, str | None]]:
    """(distance, script) of each pair; (-1, None) above ``limit``. A script has runs such as ``12=1X2D1I``: equal, changed, only in the first, only in the second.

    Points of all costs are kept for it: 8 bytes times the square of the limit for a pair that comes near to it.
    """
    out: list[tuple[int, str | None]] = [(-1, None)] * len(pairs)
    for part in _parts(pairs, limit):
        kept: list = []
        some = [pairs[p] for p in part]
        found = _points(some, limit, kept)
        for x, p in enumerate(part):
            if found[x] >= 0:
                out[p] = int(found[x]), _script(len(some[x][0]), len(some[x][1]), x, int(found[x]), kept)
    return out


def _script(n: int, m: int, pair: int, cost: int, kept: list) -> str:
    """Runs from the end: on each diagonal the point that the furthest one of a cost came from, then the slide."""
    runs: list[tuple[int, str]] = []
    i, k = n, n - m
    for c in range(cost, 0, -1):
        live, far = kept[c - 1]
        row = far[np.searchsorted(live, pair)]
        ways = [(int(row[q + c - 1]) + step, name, q) for q, step, name in ((k, 1, "X"), (k - 1, 1, "D"), (k + 1, 0, "I")) if -c < q < c]
        # only points inside both texts count, as they did on the way here
        at, name, q = max((w for w in ways if 0 <= w[0] <= n and 0 <= w[0] - k <= m), key=lambda w: w[0])
        runs += [(i - at, "="), (1, name)]
        i, k = at - (name != "I"), q
    runs.append((i, "="))
    merged: list[list] = []
    for size, name in reversed(runs):
        if merged and merged[-1][1] == name:
            merged[-1][0] += size
        elif size:
            merged.append([size, name])
    return "".join(f"{size}{name}" for size, name in merged)


def _parts(pairs: list[tuple[str, str]], limit: int | None) -> Iterator[list[int]]:
    """Places of pairs of similar size, so that symbols and points of a part stay bounded (but for single pairs)."""
    part: list[int] = []
    for p in sorted(range(len(pairs)), key=lambda p: len(pairs[p][0]) + len(pairs[p][1])):
        size = len(pairs[p][0]) + len(pairs[p][1]) + 1
        points = 0 if limit is None else (min(limit, size) + 1) ** 2
        if part and ((len(part) + 1) * size > SYMBOLS or (len(part) + 1) * points > POINTS):
            yield part
            part = []
        part.append(p)
    if part:
        yield part


def edit_pairs(pairs: DataFrame, limit: int | None = None, script: bool = False) -> DataFrame:
    """``pairs`` (with seq_a, seq_b; null: empty) without the sequences, with ``distance``, null above ``limit``, and on wish ``script`` as of :func:`scripts`.

    Unlike pairs cost the square of the limit; without one, of their distance.
    """
    if script and limit is None:
        raise ValueError("scripts need a limit")
    keys = [f for f in pairs.schema if f.name not in ("seq_a", "seq_b")]
    names = [f.name for f in keys]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = list(zip(pdf.seq_a.fillna(""), pdf.seq_b.fillna(""), strict=True))
            got = scripts(rows, limit) if script else [(d, None) for d in distances(rows, limit)]
            found = pdf[names].copy()
            found["distance"] = pd.array([None if d < 0 else d for d, _ in got], "Int32")
            if script:
                found["script"] = [s for _, s in got]
            yield found

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), "distance int", *(["script string"] if script else [])])
    return pairs.mapInPandas(run, schema)
