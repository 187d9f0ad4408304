import random
import re

import numpy as np

from bitloom.llm import neardup


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows = [None, "", " \n", "one", "One", "one two", "two one"]
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 12, 40, 90]))]
        for _ in range(rng.randint(1, 7)):
            w = base[:]
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w))
    base = [f"x{i}" for i in range(60)]
    for i in range(40):  # a chain: neighbours are similar, the ends are not
        base[(3 * i) % 60] = f"y{i}"
        rows.append(" ".join(base))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_groups_equal_brute_force(spark):
    for words in (2, 5):
        rows = corpus(words)
        docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long")
        got = neardup.groups(docs, words, 80).toPandas()
        want = brute(rows, words, 80)
        assert len(got) == len(rows)
        for r in got.itertuples():
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.component_id == r.doc_id)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None), (3, "word " * 60_000)], "doc_id long, text string")
    got = neardup.groups(docs, 2, 80).toPandas()
    assert len(got) == 5 and got.kept.all()
    assert neardup.groups(docs.limit(0)).count() == 0


def test_chunks_give_the_same_groups(spark, monkeypatch):
    """Lists and neighbourhoods cut into many chunks: copies of one text, edited less or more, so that pairs lie on both sides of the threshold."""
    monkeypatch.setattr(neardup, "LIST_CHUNK", 8)
    monkeypatch.setattr(neardup, "CHUNK", 6)
    monkeypatch.setattr(neardup, "HUBS", 1)
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    rows = []
    for i in range(70):
        w = base[:]
        for _ in range(rng.choice([1, 2, 4, 5, 6, 8])):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).toPandas()
    want = brute(rows, 2, 80)
    assert {r.doc_id: r.component_id for r in got.itertuples()} == {i: root for i, (_, root) in want.items()}
    assert 3 < got.kept.sum() < 60


def test_overlaps_count_shared_values():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, rng.integers(0, 30))) for _ in range(17)]
    ends = np.cumsum([0, *map(len, rows)])
    got = neardup.overlaps(np.concatenate(rows), ends)
    assert all(got[i, j] == len(np.intersect1d(rows[i], rows[j])) for i in range(17) for j in range(17) if i != j)
    assert neardup.overlaps(np.zeros(0, np.int64), np.zeros(3, np.int64)).tolist() == [[0, 0], [0, 0]]


def test_equal_floats_lose_no_link():
    """Values that become equal as 24-bit floats are one value on both sides: pairs at the very threshold are still seen, in lists of two and of more."""
    rng = np.random.default_rng(7)
    for trial in range(300):
        shared, own = rng.integers(0, 1 << 20, 100), rng.integers(0, 1 << 20, 25)
        other = rng.integers(0, 1 << 20, 0)
        sets = [np.unique(np.concatenate([shared, own]).astype(np.float32)), np.unique(np.concatenate([shared, other]).astype(np.float32))]
        if trial % 3:  # some values of one document become equal
            sets = [np.unique(np.where(s < s[2], s[2], s)) for s in sets]
        n = np.array([125, 100])
        flat, ends = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
        assert neardup._may_be_similar(n, flat, ends, 80)[0, 1]
        low = np.full((2, neardup.SKETCH), np.inf, np.float32)
        for i, s in enumerate(sets):
            low[i, : len(s)] = s[: neardup.SKETCH]
        assert neardup._pairs_of(np.arange(2), n, low, 80)[0]
