import math

import numpy as np
import pytest

from bitloom.llm import embeddings, graph

SCHEMA = "vec_id long, embedding array<float>, label int, id long, n_links string"


def near(rng, base, angle, n):
    """n vectors at about ``angle`` degrees from base."""
    noise = rng.normal(size=(n, len(base)))
    noise -= np.outer(noise @ base, base)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    a = math.radians(angle)
    return math.cos(a) * base + math.sin(a) * noise


def plain(rows):
    """vec_id -> list of (n_links, component_id, kept), by brute force."""
    ok = [i for i, (_, e, label, *_) in enumerate(rows) if label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    link = {i: [] for i in range(len(rows))}
    groups = {}
    for i in ok:
        groups.setdefault((rows[i][2], len(rows[i][1])), []).append(i)
    for g in groups.values():
        x = np.array([rows[i][1] for i in g], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= 0.98), strict=True):
            if a != b:
                link[g[a]].append(g[b])
    out, seen = [], set()
    for i in range(len(rows)):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            for j in link[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        first = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        out += [(rows[j][0], len(link[j]), first, first is not None and rows[j][0] == first) for j in group]
    return sorted(out, key=str)


def groups(seed, sizes, loose, dim=24):
    rng = np.random.default_rng(seed)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(n, dim)))
    parts = [unit(loose), *[near(rng, unit(1)[0], angle, n) for n, angle in sizes]]
    x = np.concatenate(parts)[rng.permutation(loose + sum(n for n, _ in sizes))] * rng.uniform(0.1, 9, (loose + sum(n for n, _ in sizes), 1))
    return x.astype(np.float32)


@pytest.mark.parametrize(("shard", "sizes"), [(64, [(150, 3), (60, 5.5), (20, 5), (5, 4), (2, 2)]), (4096, [(40, 5), (3, 1)]), (32, [(200, 5.6)])])
def test_as_brute_force(spark, shard, sizes):
    x = groups(shard, sizes, 250)
    rows = [(i, v.tolist(), i % 7 == 0, 0, "") for i, v in enumerate(x)]
    rows = [(i, e, int(label), a, b) for i, e, label, a, b in rows]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), shard=shard).collect()
    want = plain(rows)
    true, found = sum(r[1] for r in want), sum(r.n_links for r in got)
    assert len(got) == len(want) and 0.99 * true <= found <= true
    if found == true:
        assert sorted((tuple(r) for r in got), key=str) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    e = [1.0, 2.0, 3.0]
    rows = [(1, e, 0), (2, [2.0, 4.0, 6.0], 0), (3, e, 1), (4, e, None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 3.0], 0), (9, [1.0, nan, 3.0], 0), (10, [inf, 2.0, 3.0], 0)]
    rows += [(11, [1.0, 2.0], 0), (12, [-0.0, 1.0, 0.0], 0), (13, [0.0, 1.0, 0.0], 0), (14, [1e-30, 2e-30, 3e-30], 0), (15, [1e30, 2e30, 3e30], 0), (16, [-1.0, -2.0, -3.0], 0)]
    rows += [(20, e, 2), (20, e, 2), (21, e, 2), (None, e, 2), (None, [9.0, 0.0, 1.0], 2), (None, None, None), (22, None, 0), (22, [5.0, 0.0, 0.0], 0), (0, [5.0, 0.1, 0.0], 0)]
    rows = [(*r, 0, "") for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=str) == plain(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_copies_are_counted(spark):
    x = groups(5, [(4, 3)], 30)
    rows = [(k, x[i].tolist(), 0, 0, "") for k, i in enumerate([*range(34)] * 3 + [7] * 200)]
    assert sorted((tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == plain(rows)


def test_pruned_edges_stand_for_the_others():
    x = np.random.default_rng(1).normal(size=(400, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    edges, ties, start = graph.build(x, 0.96)
    assert start == graph.medoid(x) and (edges < len(x)).all() and not (edges == np.arange(400)[:, None]).any()
    kept = graph.prune(x, np.arange(50), np.tile(np.arange(400), (50, 1)), 0.96)
    for p, row in enumerate(kept):
        row = row[row >= 0]
        near = x[row] @ x[p]
        assert (np.diff(near) <= 1e-6).all()  # nearest first
        between = x[row] @ x[row].T
        for a in range(len(row)):
            for b in range(a + 1, len(row)):
                assert graph.ALPHA**2 * (1 - between[a, b]) > 1 - near[b] - 1e-5
    ids, near, _, _ = graph.greedy(x, edges, x, start)
    assert (ids[np.arange(400), near.argmax(1)] == np.arange(400)).mean() > 0.95  # a node is found by a search for it


def test_audit_sees_what_is_missing(spark):
    x = groups(2, [(20, 3)], 50)
    v = spark.createDataFrame([(i, 1, 5, e.astype(float).tolist()) for i, e in enumerate(x)], "id long, w long, g long, e array<double>")
    none = spark.createDataFrame([], "id long, n long")
    assert embeddings.audit(v, none, 0.98) == (0, 380)
