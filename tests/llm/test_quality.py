import random
import re

import pandas as pd
from pyspark.sql import functions as F

from bitloom.llm import quality
from bitloom.llm.common import words_of


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, w in enumerate(wins):
        if wins.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def test_counts_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a", "a a a a a a", "x y z\nx y z\n\n x y z", "é ü ß |#\x0bq", "tick " * 5000]
    texts += [" ".join(rng.choice("abcd") + rng.choice(["", "\n", "#"]) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + [(0, None, "x", 2)], "doc_id long, text string, w string, kept int")
    got = quality.score(docs).toPandas()
    assert len(got) == len(texts) + 1
    for r in got.itertuples():
        want = brute(texts[r.doc_id]) if len(texts[r.doc_id] or "") < 5000 else (5000, 20000, 0, 0, 5000)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score(docs).count() == 0


def test_verdicts_agree_with_labels(spark):
    d = "/root/testdata/sf0.01"
    got = quality.score(spark.read.parquet(f"{d}/documents.parquet")).toPandas()
    m = got.merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id", suffixes=("", "_label"))
    m = m[~m.base_failed]
    assert (m.kept == (m.quality_label == 1)).mean() > 0.97


def test_repeats_survive_clashes_of_hash_bits(spark):
    """With a mask that leaves two hash bits, other windows lie between equal ones; the count stays that of brute force."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for bits in (61, 62, 20):
        got = frame.select(quality._repeated(words_of(F.col("text")), F.lit((1 << bits) - 1))).collect()
        for t, (n,) in zip(texts, got, strict=True):
            w = t.split()
            at = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
            assert n == len({i + k for i, x in enumerate(at) if at.count(x) > 1 for k in range(3)}), (bits, t)


def test_posterior_equals_plain_expectation_maximisation(spark):
    rng = random.Random(6)
    rules = [r[0] for r in quality.RULES]
    rows = [[1 if rng.random() < (0.9 if good else 0.2) else -1 if rng.random() < 0.8 else 0 for _ in rules] for good in (rng.random() < 0.7 for _ in range(400))]
    voted = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["doc_id", *[f"v_{r}" for r in rules]])
    share, rates = quality.fit(voted)
    s, ab = 0.8, [(0.9, 0.3)] * len(rules)
    clip = lambda x: min(0.995, max(0.005, x))

    def posterior(r, s, ab):
        good, bad = s, 1 - s
        for v, (a, b) in zip(r, ab, strict=True):
            good, bad = good * (a if v == 1 else 1 - a if v == -1 else 1), bad * (b if v == 1 else 1 - b if v == -1 else 1)
        return good / (good + bad)

    for _ in range(500):
        p = [posterior(r, s, ab) for r in rows]
        s = clip((sum(p) + 1) / (len(rows) + 2))
        new = []
        for k in range(len(rules)):
            on = lambda q, v, k=k: sum(x for x, r in zip(q, rows, strict=True) if r[k] == v)
            q = [1 - x for x in p]
            a = clip((on(p, 1) + 4) / (on(p, 1) + on(p, -1) + 5))
            new.append((a, min(a, clip((on(q, 1) + 1) / (on(q, 1) + on(q, -1) + 5)))))
        ab = new
    assert abs(share - s) < 1e-3 and all(abs(x - y) < 2e-3 for m, n in zip(rates, ab, strict=True) for x, y in zip(m, n, strict=True))
    got = voted.select(quality._posterior(share, rates)).collect()
    assert all(abs(g[0] - posterior(r, s, ab)) < 1e-2 for g, r in zip(got, rows, strict=True))
