import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from bitloom.llm import search

TERM = re.compile(search.TERM)


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def plain(docs, items, k):
    """Every document scored for every item."""
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        asked, scores = Counter(w for w in words(text) if w in df), []
        for i, b, n in bags:
            m = 75 + 25 * n * n_docs // total
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 12 * m)) for w, r in asked.items() if b[w])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if gone else i, -s) for rank, (s, gone, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def key(row):
    return tuple(str(x) for x in row)


def corpus(rng, n):
    vocabulary = ["".join(rng.choice("abcdé1") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    pick = lambda m: " ".join(rng.choice((str.lower, str.upper, str.title))(vocabulary[min(299, int(rng.expovariate(1 / 40)))]) + rng.choice(["", ",", ".", "\n"]) for _ in range(m))
    docs = [(i, pick(rng.choice([0, 3, 30, 200]))) for i in range(n)]
    docs += [(i, docs[i][1]) for i in range(0, n, 7)] + [(n + 1, None), (n + 2, "..."), (None, docs[2][1]), (None, docs[3][1]), (n + 3, pick(30_000)), (n + 4, docs[5][1])]
    items = [(i, pick(rng.choice([1, 5, 40]))) for i in range(30)] + [(40, None), (41, "zzzzzz"), (42, ""), (3, "other text of the same id a b")]
    return docs, items


@pytest.mark.parametrize(("k", "batch", "block"), [(20, 10_000, 800_000), (3, 40, 200)])
def test_as_plain(spark, k, batch, block):
    docs, items = corpus(random.Random(k), 400)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    d = spark.createDataFrame([(i, t, 0.5, 1) for i, t in docs], "doc_id long, text string, score double, rank int").repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in [*items, items[0]]], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in search.search(d, q, k=k, block_terms=block).collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=key) == sorted(plain(docs, items, k), key=key)


def test_empty_tables(spark):
    none, some = (spark.createDataFrame(rows, "doc_id long, text string") for rows in ([], [(1, "a b"), (2, None)]))
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(none, items).count() == 0
    assert search.search(some, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in search.search(some, items).collect()] == [(1, 1, 1)]


def test_accumulators_are_limited():
    """Once two documents are out of reach, a list of all others makes no more accumulators, and the survivors are exact."""
    rare, common = np.array([3, 8]), np.arange(1000)
    lists = {0: (rare, np.array([900, 800]), 900), 1: (common, np.full(1000, 5), 5)}
    found, score = search.accumulate([(0, 10), (1, 1)], lists, 1000, search.Best(2))
    assert found.tolist() == [3, 8] and score.tolist() == [9005, 8005]
    assert len(search.accumulate([(0, 10), (1, 1)], lists, 1000, search.Best(3))[0]) == 1000
