"""Edit distances and scripts, entropy rates of any order, views of streams, long traces and written-out alignments against plain versions."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import align, edits, generate
from bitloom.streaming import online


def near(rng, a, rate=0.15):
    return "".join(c if rng.random() > rate else rng.choice(["", "a", c + "b"]) for c in a)


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(5)
    out = [("", ""), ("", "ab"), ("ab", ""), ("a", "a"), ("é𝄞x", "é𝄟x"), ("aaaa", "aa"), ("ab" * 30, "ba" * 30)]
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(40)))
        out.append((a, near(rng, a) if rng.random() < 0.6 else "".join(rng.choice("abc") for _ in range(rng.randrange(40)))))
    return out


def followed(a, b, script):
    """(what a script makes of ``a``, its cost)."""
    out, i, j, cost = [], 0, 0, 0
    for n, name in re.findall(r"(\d+)([=XDI])", script):
        n = int(n)
        if name == "=":
            assert a[i : i + n] == b[j : j + n]
        out.append("" if name == "D" else b[j : j + n])
        i, j, cost = i + n * (name != "I"), j + n * (name != "D"), cost + n * (name != "=")
    assert i == len(a)
    return "".join(out), cost


def test_furthest_points_give_edit_distances(pairs):
    want = [align.edit_distance(a, b) for a, b in pairs]
    assert edits.distances(pairs) == want
    for limit in (0, 3, 9):
        assert edits.distances(pairs, limit) == [d if d <= limit else -1 for d in want]
    for (a, b), (d, script), w in zip(pairs, edits.scripts(pairs, 60), want, strict=True):
        assert d == w and followed(a, b, script) == (b, d)
    assert edits.scripts([("abc", "xyz")], 2) == [(-1, None)] and edits.distances([]) == []


def test_long_near_copies_cost_little():
    rng = random.Random(2)
    a = "".join(rng.choices("acgt", k=400_000))
    b = near(rng, a, 0.0005)
    tracemalloc.start()
    (d, script), = edits.scripts([(a, b)], 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 100 < d < 400 and followed(a, b, script) == (b, d) and peak < 60e6


def test_edit_pairs_as_rows(spark, pairs):
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)] + [(-1, None, "ab"), (-2, None, None)]
    df = spark.createDataFrame(rows, "id long, seq_a string, seq_b string")
    got = {r.id: r.distance for r in edits.edit_pairs(df, 6).collect()}
    native = df.select("id", F.levenshtein(F.coalesce("seq_a", F.lit("")), F.coalesce("seq_b", F.lit(""))).alias("d")).collect()
    assert got == {r.id: r.d if r.d <= 6 else None for r in native}
    assert {r.id: r.script for r in edits.edit_pairs(df, 6, script=True).collect()}[-1] == "2I"
    assert edits.edit_pairs(df.limit(0)).columns == ["id", "distance"] and edits.edit_pairs(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="limit"):
        edits.edit_pairs(df, script=True)


def test_entropy_rates_of_any_order(spark):
    """Against the linear equations; a model with a period, one with a context that has no row."""
    rows, want = [], {}
    for order in (0, 1, 2, 3):
        p = generate.random_model(order, seed=order)
        want[f"random {order}"] = generate.entropy_rate(p, order)
        for s in range(len(p)):
            ctx = "".join("acgt"[s // 4**i % 4] for i in reversed(range(order)))
            rows += [(f"random {order}", ctx, c, float(p[s, i])) for i, c in enumerate("acgt")]
    rows += [("period", "a", "c", 1.0), ("period", "c", "a", 1.0), ("open", "a", "c", 1.0)]
    full = np.full((4, 4), 0.25)
    full[0] = [0, 1, 0, 0]
    want |= {"period": 0.0, "open": generate.entropy_rate(full)}
    got = generate.entropy_rates(spark.createDataFrame(rows, "name string, ctx string, sym string, p double"), list("acgt"), ["name"]).collect()
    assert {r.name: r.bits_per_symbol for r in got} == pytest.approx(want, abs=1e-9)
    assert {r.name: r.contexts for r in got} == {"random 0": 1, "random 1": 4, "random 2": 16, "random 3": 64, "period": 2, "open": 4}


def test_view_after_restarts_and_repeated_batches(spark, tmp_path):
    rng, rows = random.Random(7), []
    view = online.View(spark, f"{tmp_path}/view", ["k", "j"], ["t"], merge_every=2)
    assert view.read() is None

    def feed(n):
        some = [(rng.choice([None, 1, 2, 3]), rng.choice("xy"), rng.choice([None, *range(50)]), rng.choice("abc")) for _ in range(n)]
        rows.extend(some)
        spark.createDataFrame(some, "k long, j string, t long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def want():
        best = {}
        for k, j, t, v in rows:
            now = (-1 if t is None else t, v)
            best[k, j] = max(best.get((k, j), now), now)
        return {key: (None if t < 0 else t, v) for key, (t, v) in best.items()}

    def held():
        got = view.read().collect()
        assert len(got) == len({(r.k, r.j) for r in got})
        return {(r.k, r.j): (r.t, r.v) for r in got}

    for batch in range(5):
        feed(12)
        stream = spark.readStream.schema("k long, j string, t long, v string").parquet(f"{tmp_path}/in")
        view.follow(stream, f"{tmp_path}/checkpoint").awaitTermination()
        assert held() == want()
    again = spark.createDataFrame(rows[36:48], "k long, j string, t long, v string")
    view._put(again, 3)  # a batch that was written, and merged, before the run was lost
    assert held() == want()
    (tmp_path / "view" / "new" / "batch=3" / "_SUCCESS").unlink()  # and one that wasn't finished
    view._put(again, 3)
    assert held() == want()


@pytest.mark.parametrize("local", [True, False])
def test_traces_in_blocks_are_the_same(local, monkeypatch):
    rng = random.Random(4)
    some = [("".join(rng.choices("acgt", k=n)), "") for n in (60, 75, 90, 1)]
    some = [(a, near(rng, a, 0.2).replace("b", "t") or "a") for a, _ in some]
    whole = align.m_align_all(some, total=False, local=local, max_rounds=2)
    monkeypatch.setattr(align, "POINTERS", 10)
    assert align.m_align_all(some, total=False, local=local, max_rounds=2) == whole


def test_long_traces_take_little_memory(monkeypatch):
    monkeypatch.setattr(align, "POINTERS", 1 << 20)
    rng = random.Random(1)
    a = "".join(rng.choices("acgt", k=3000))
    tracemalloc.start()
    row = align.m_align(a, near(rng, a, 0.1).replace("b", "t"), total=False, max_rounds=0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row["row_a"].replace("-", "").lower() == a[row["a_start"] : row["a_end"]] and peak < 12e6  # a byte a cell would be 18e6


def test_alignments_written_out(spark):
    a, b = "ttttttttttttacgtacggtacaggcatcg", "acgtacggtaaggcatcgaaaa"
    df = spark.createDataFrame([(1, a, b), (2, "", "ac")], "id long, seq_a string, seq_b string")
    rows = align.score_pairs(df, total=False, max_rounds=0)
    got = {r.id: r for r in align.shown(rows.join(df, "id")).withColumn("operations", align.operations(F.col("counts"))).collect()}
    r = got[1]
    assert r.cuts == f"A[{r.a_start}..{r.a_end}] B[{r.b_start}..{r.b_end}]" and r.a_start == 12 and r.b_start == 0
    assert r.text_a == "t" * 12 + "   " + r.row_a + "   " + a[r.a_end :] and r.text_b == " " * 12 + "   " + r.row_b + "   " + b[r.b_end :]
    assert r.operations == len(r.row_a) and len(r.row_a) == len(r.row_b)
    assert got[2].text_b == "   ac" and got[2].cuts == "A[0..0] B[0..0]"
