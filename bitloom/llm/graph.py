"""A flat neighbourhood graph over unit vectors: robust pruning, greedy search, range expansion. Many vectors at a time, in numpy."""

from __future__ import annotations

import numpy as np

#: Edges of a node, length of the list of a greedy search, and how much nearer a kept neighbour must be than what it stands for.
DEGREE, BEAM, ALPHA = 16, 24, 1.2
#: Nodes that are put into the graph, or searched from, at once; nodes expanded in one step of a search; candidates for pruning.
BATCH, WIDTH, CANDIDATES = 256, 4, 64
#: Ties of a node in each pass: to the nearest that a search has found in range.
TIES = 4


def medoid(x: np.ndarray) -> int:
    """The vector nearest to the mean."""
    return int(np.argmax(x @ x.mean(0)))


def _without_repeats(ids: np.ndarray) -> np.ndarray:
    """Rows of ids, sorted, where repeats are -1."""
    ids = np.sort(ids, 1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


def greedy(x: np.ndarray, edges: np.ndarray, q: np.ndarray, start: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each query the ``beam`` nearest nodes met on the way from ``start`` and their cosines, then which nodes were met, and which expanded."""
    many, rows = len(q), np.arange(len(q))
    met, expanded = np.zeros((many, len(x)), bool), np.zeros((many, len(x)), bool)
    ids, near, done = np.full((many, beam), -1), np.full((many, beam), -np.inf, x.dtype), np.ones((many, beam), bool)
    ids[:, 0], near[:, 0], done[:, 0] = start, q @ x[start], False
    met[:, start] = True
    while len(rows):
        waiting = np.where(done[rows], -np.inf, near[rows])
        pick = np.argpartition(-waiting, min(WIDTH, beam) - 1, 1)[:, :WIDTH]
        open_ = np.take_along_axis(waiting, pick, 1) > -np.inf
        going = open_.any(1)
        rows, pick, open_ = rows[going], pick[going], open_[going]
        if not len(rows):
            break
        node = np.where(open_, ids[rows[:, None], pick], -1)
        done[rows[:, None], pick] = True
        at, col = np.nonzero(node >= 0)
        expanded[rows[at], node[at, col]] = True
        new = np.where((node >= 0)[:, :, None], edges[node], -1).reshape(len(rows), -1)
        new = _without_repeats(new)
        new[(new >= 0) & met[rows[:, None], new]] = -1
        at, col = np.nonzero(new >= 0)
        met[rows[at], new[at, col]] = True
        cosine = np.full(new.shape, -np.inf, x.dtype)
        cosine[at, col] = np.einsum("pd,pd->p", x[new[at, col]], q[rows[at]])
        ids_, near_ = np.concatenate([ids[rows], new], 1), np.concatenate([near[rows], cosine], 1)
        done_ = np.concatenate([done[rows], new < 0], 1)
        top = np.argpartition(-near_, beam - 1, 1)[:, :beam]
        ids[rows], near[rows], done[rows] = (np.take_along_axis(v, top, 1) for v in (ids_, near_, done_))
    return ids, near, met, expanded


def prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, split: float, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Up to ``degree`` of the candidates (rows, -1: none) of each node: the nearest, then again and again the nearest of those that no kept one stands for.

    Those of cosine ``split`` or more get half of the edges, the others the other half, so that a group of near vectors, all equally far from each other, keeps
    edges to the rest.
    """
    candidates = _without_repeats(np.where(candidates == nodes[:, None], -1, candidates))
    vectors = x[candidates]
    near = np.einsum("bcd,bd->bc", vectors, x[nodes])
    near[candidates < 0] = -np.inf
    rows, close = np.arange(len(nodes)), near >= split
    out = np.full((len(nodes), degree), -1)
    for k in range(degree):
        if k in (0, degree // 2):
            left = (candidates >= 0) & (close if k == 0 else ~close)
        best = np.where(left, near, -np.inf).argmax(1)
        some = left[rows, best]
        if not some.any():
            continue
        out[some, k] = candidates[some, best[some]]
        between = np.einsum("bcd,bd->bc", vectors, vectors[rows, best])
        # squared distances of unit vectors are 2 - 2 * cosine
        left &= ~(some[:, None] & (alpha * alpha * (1 - between) <= 1 - near))
        left[rows, best] = False
    return out


def _link_back(x: np.ndarray, edges: np.ndarray, nodes: np.ndarray, split: float) -> None:
    """Edges from the neighbours of ``nodes`` back to them, pruned where a node gets too many."""
    degree = edges.shape[1]
    source, target = np.repeat(nodes, degree), edges[nodes].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    for a in range(0, len(nodes), BATCH):
        part, size = nodes[a : a + BATCH], count[a : a + BATCH]
        wide = np.full((len(part), int(size.max())), -1)
        at = np.repeat(np.arange(len(part)), size)
        wide[at, np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)] = source[first[a] : first[a] + size.sum()]
        both = _without_repeats(np.concatenate([edges[part], wide], 1))
        fits = (both >= 0).sum(1) <= degree
        edges[part[fits]] = -np.sort(-both[fits], 1)[:, :degree]
        if not fits.all():
            edges[part[~fits]] = prune(x, part[~fits], both[~fits], split, degree)


def build(x: np.ndarray, split: float, degree: int = DEGREE, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, int]:
    """(edges, ties, medoid) of a graph over the rows of x.

    Nodes enter in batches, each as large as what is there already at most: what a search for a node has met on its way is pruned to its edges. A second
    pass searches the whole graph, so that nodes of one batch meet. Ties are pairs of nodes within ``split``, each node with the nearest found; they are
    never pruned, so that a group of near vectors stays in one piece for range expansion.
    """
    ties = []
    n, start = len(x), medoid(x) if len(x) else 0
    edges = np.full((n, degree), -1)
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[start], order[order != start]]).astype(int) if n else order
    for again in (False, True):
        at = 0 if again else 1
        while at < n:
            part = order[at : at + (BATCH if again else min(at, BATCH))]
            ids, near, met, expanded = greedy(x, edges, x[part], start, beam)
            row, node = np.nonzero(expanded)
            size = np.bincount(row, minlength=len(part))
            wide = np.full((len(part), int(size.max())), -1)
            wide[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = node
            found = np.concatenate([ids, wide, edges[part]], 1)
            if found.shape[1] > 2 * CANDIDATES:
                cosine = np.einsum("bcd,bd->bc", x[found], x[part])
                cosine[found < 0] = -np.inf
                found = np.take_along_axis(found, np.argpartition(-cosine, 2 * CANDIDATES - 1, 1)[:, : 2 * CANDIDATES], 1)
            edges[part] = prune(x, part, found, split, degree)
            near = np.where((ids == part[:, None]) | (ids < 0), -np.inf, near)
            top = np.argsort(-near, 1)[:, :TIES]
            row, col = np.nonzero(np.take_along_axis(near, top, 1) >= split)
            ties.append(np.stack([part[row], ids[row, top[row, col]]]))
            _link_back(x, edges, part, split)
            at += len(part)
    return edges, np.concatenate([np.zeros((2, 0), int), *ties], 1), start


def lists(n: int, edges: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All neighbours of the n nodes, by edge or tie, one after another, and the bounds of each node's."""
    row, col = np.nonzero(edges >= 0)
    source, target = np.concatenate([row, ties[0], ties[1]]), np.concatenate([edges[row, col], ties[1], ties[0]])
    source, target = np.divmod(np.unique(source * n + target), max(1, n))
    return target, np.searchsorted(source, np.arange(n + 1))


def within(x: np.ndarray, edges: np.ndarray, around: tuple[np.ndarray, np.ndarray], q: np.ndarray, start: int, least: float, slack: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of what lies within cosine ``least`` of each query, as far as the graph leads there; ``around`` as of :func:`lists`.

    After the greedy search, nodes within ``least - slack`` are expanded until there are no more of them.
    """
    _, _, met, _ = greedy(x, edges, q, start, beam)
    row, node = np.nonzero(met)
    inside, go_on = np.zeros(met.shape, bool), np.zeros(met.shape, bool)
    flat, bounds = around
    while len(row):
        for a in range(0, len(row), 1 << 16):
            r, v = row[a : a + (1 << 16)], node[a : a + (1 << 16)]
            cosine = np.einsum("pd,pd->p", x[v], q[r])
            inside[r, v] = cosine >= least
            go_on[r, v] = cosine >= least - slack
        keep = go_on[row, node]
        row, node = row[keep], node[keep]
        size = bounds[node + 1] - bounds[node]
        place = np.arange(size.sum()) + np.repeat(bounds[node] - np.cumsum(size) + size, size)
        row, node = np.repeat(row, size), flat[place]
        fresh = ~met[row, node]
        row, node = np.divmod(np.unique(row[fresh] * met.shape[1] + node[fresh]), met.shape[1])
        met[row, node] = True
    return np.nonzero(inside)
