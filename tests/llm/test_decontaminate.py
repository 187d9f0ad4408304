import random
import re
from collections import Counter

from bitloom.llm import decontaminate


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def shingles(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items, percent=80):
    found = {}
    for d, t in docs:
        w = words(t)
        for i, q in items:
            v = words(q)
            if not v:
                continue
            k = min(5, len(v))
            want = shingles(v, k)
            for p in range(max(1, len(w))):
                own = shingles(w[p : p + len(v)], k)
                small, large = sum((own & want).values()), sum((own | want).values())
                if large and 100 * small >= percent * large:
                    found[d, i] = max(found.get((d, i), 0), small / large)
    return found


def test_matches_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = ["the", "of", "and", "to"] * 6 + [f"v{i}" for i in range(300)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [say(rng.choice([1, 3, 5, 8, 20, 35, 35, 60, 90])) for _ in range(25)]
    docs = []
    for i in range(120):
        w = say(rng.randint(0, 150))
        if i % 2:
            q = rng.choice(items)[:]
            kind = rng.randrange(5)
            if kind == 1:
                q = q[rng.randint(0, max(0, len(q) // 9)) :]
            elif kind == 2:
                q = q[: len(q) - rng.randint(0, max(0, len(q) // 9))]
            elif kind == 3:
                q[rng.randrange(len(q))] = "edit"
            elif kind == 4:
                q.insert(rng.randrange(len(q) + 1), "more")
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + rng.choice(["", ",", "."]) for x in q]
        docs.append((i, " ".join(w)))
    docs += [(900, None), (901, ""), (902, "word " * 30_000)]
    bench = [(i, " ".join(q)) for i, q in enumerate(items)] + [(98, None), (99, " . ")]
    d = spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*r, 7) for r in bench], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(d, b).collect()}
    want = brute([r for r in docs if r[0] != 902], bench)
    lost = {k: v for k, v in want.items() if k not in got}
    assert set(got) <= set(want)
    assert not lost
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_blocks_tiles_and_items_that_share_their_shingles(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 7)
    monkeypatch.setattr(decontaminate, "TILE", 16)
    rng = random.Random(8)
    vocab = ["the", "of", "and", "to"] * 6 + [f"v{i}" for i in range(300)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    opening = say(20)
    items = [(i, " ".join(opening + say(rng.choice([4, 6, 12])))) for i in range(12)]
    items += [(20, items[0][1]), (21, items[0][1] + " more"), (22, "again " * 9), (23, "ab ba " * 8)]
    docs = [(i, " ".join(say(rng.randint(0, 60)) + rng.choice(items)[1].split()[rng.randint(0, 2) :] + say(rng.randint(0, 60)))) for i in range(60)]
    docs += [(70, "again " * 50), (71, "ba ab " * 40), (72, " ".join(opening)), (72, " ".join(say(70)) + " " + items[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(d, b).collect()}
    want = brute(docs, items)
    assert set(got) == set(want) and len(want) > 50
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_edges(spark):
    d = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (None, "x")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "One, two: three four five SIX!"), (5, "One, two: three four five SIX!")], "item_id long, text string")
    got = decontaminate.matches(d, b).collect()
    assert [(r.doc_id, r.item_id, r.start, r.similarity) for r in got] == [(1, 5, 0, 1.0)]
    assert [r.doc_id for r in decontaminate.keep_clean(d, b).collect()] == [None]
    assert decontaminate.matches(d.limit(0), b).count() == 0
    assert decontaminate.matches(d, b.limit(0)).count() == 0
    assert decontaminate.keep_clean(d, b.limit(0)).count() == 3
