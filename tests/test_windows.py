import random

import numpy as np
import pytest

from bitloom.operators import align, places, windows


def letters(rng, n):
    return "".join(rng.choice("acgt") for _ in range(n))


@pytest.fixture(scope="module")
def sequences(spark):
    rng = random.Random(11)
    core = letters(rng, 60)
    a = {1: letters(rng, 30) + core + letters(rng, 20), 2: letters(rng, 45), 3: "", 4: letters(rng, 90)}
    b = {1: letters(rng, 150) + core[:35] + "ga" + core[35:] + letters(rng, 120), 2: letters(rng, 70) + a[2][5:40] + letters(rng, 10), 3: letters(rng, 30), 4: letters(rng, 40) + a[4][:50] + a[4][52:] + letters(rng, 200)}
    frame = lambda x, key: spark.createDataFrame(list(x.items()), f"{key} long, seq string")
    pairs = spark.createDataFrame([(i, j) for i in a for j in b], "x long, y long")
    return a, b, frame(a, "x"), frame(b, "y"), pairs


@pytest.mark.parametrize(("total", "states", "overlap"), [(True, 3, 96), (False, 3, 96), (True, 1, 128)])
def test_all_tiles_equal_the_full_recurrence(spark, sequences, total, states, overlap):
    a, b, da, db, pairs = sequences
    pieces = [places.pieces(d, k, 32, overlap) for d, k in ((da, "x"), (db, "y"))]
    wide = windows.windows(windows.all_tiles(pairs, *pieces, "x", "y"), *pieces, "x", "y")
    got = {(r.x, r.y): r.log_odds for r in windows.window_odds(wide, ["x", "y"], total, states).collect()}
    some = [(i, j) for i in a for j in b if a[i] and b[j]]
    assert sorted(got) == some
    want = align.fixed_odds([(a[i], b[j]) for i, j in some], total=total, states=states)
    for at, v in zip(some, want, strict=True):
        assert got[at] == pytest.approx(v, abs=1e-4)


@pytest.mark.parametrize(("total", "tile", "alone"), [(True, 64, 1024), (False, 64, 1024), (True, 256, 2)])
def test_windows_hand_alignments_on(spark, monkeypatch, total, tile, alone):
    rng = random.Random(12)
    core = letters(rng, 300)
    a = {1: core, 2: letters(rng, 40) + core[:100] + core[160:] + letters(rng, 30)}
    b = {1: letters(rng, 50) + core[:150] + letters(rng, 130) + core[150:], 2: letters(rng, 700) + core + core + letters(rng, 20), 3: core * 4}  # gaps and diagonals far beyond any overlap
    monkeypatch.setattr(windows, "ALONE", alone)
    pairs = spark.createDataFrame([(i, j) for i in a for j in b], "x long, y long")
    for model in ("fitted(0)", "blend(1)")[alone < 9 :]:
        pieces = [places.pieces(spark.createDataFrame(list(d.items()), f"{k} long, seq string"), k, tile, 8, model) for d, k in ((a, "x"), (b, "y"))]
        wide = windows.windows(windows.all_tiles(pairs, *pieces, "x", "y"), *pieces, "x", "y")
        got = {(r.x, r.y): r.log_odds for r in windows.window_odds(wide, ["x", "y"], total).collect()}
        for (i, j), v in got.items():
            codes = [(places.coded(a[i], "acgt"), places.coded(b[j], "acgt"))]
            batch = align.Batch(codes, [tuple(places.chances(model, z, 4) for z in codes[0])])
            pair, cost = ({k: np.array([v]) for k, v in x.items()} for x in (align.PAIR, align.AFFINE))
            want = align.summed_by_diagonals(batch, pair, cost, True, counted=False)[0] if total else align.likeliest(batch, pair, cost, True, False)[0]
            assert v == pytest.approx(want[0], abs=1e-9)
        assert len(got) == 6 and min(got.values()) > 100


def test_windows_of_chances_by_place_hand_alignments_on(spark):
    rng, draw = random.Random(13), np.random.default_rng(13)
    core = letters(rng, 120)
    seqs = {"x": core, "y": letters(rng, 30) + core[:70] + letters(rng, 90) + core[70:]}
    chance = {k: draw.dirichlet([9] * 4, len(s)) for k, s in seqs.items()}
    pieces = []
    for k, s in seqs.items():
        table = spark.createDataFrame([(1, i, p.tolist()) for i, p in enumerate(chance[k])], f"{k} long, pos long, p array<double>")
        pieces.append(places.pieces_of_table(spark.createDataFrame([(1, s)], f"{k} long, seq string"), table, k, 32, 0))
    wide = windows.windows(windows.all_tiles(spark.createDataFrame([(1, 1)], "x long, y long"), *pieces, "x", "y"), *pieces, "x", "y")
    batch = align.Batch([tuple(places.coded(s, "acgt") for s in seqs.values())], [tuple(chance.values())])
    pair, cost = ({k: np.array([v]) for k, v in x.items()} for x in (align.PAIR, align.AFFINE))
    assert windows.window_odds(wide, ["x", "y"]).first().log_odds == pytest.approx(align.summed_by_diagonals(batch, pair, cost, True, counted=False)[0][0], abs=1e-9)


def test_long_sums_leave_the_range_of_doubles():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 4, 700), rng.integers(0, 4, 30)
    b = np.concatenate([a[:400], b, a[400:], a])
    p = [places.chances("fitted(0)", x, 4) for x in (a, b)]
    pair, cost = ({k: np.array([v]) for k, v in x.items()} for x in (align.PAIR, align.AFFINE))
    want = align.summed_by_diagonals(align.Batch([(a, b)], [tuple(p)]), pair, cost, True, np.longdouble, False)[0][0]
    assert want > 1000 and align.local_odds(a, b, *p, align.PAIR, align.AFFINE, True) == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("total", [True, False])
def test_rounds_equal_those_of_whole_pairs(spark, sequences, total):
    a, b, da, db, pairs = sequences
    own = pairs.filter("x = y")
    for r in windows.align_long(own, da, db, "x", "y", k=None, tile=64, overlap=160, total=total).collect():
        want = align.m_align(a[r.x], b[r.y], total=total)
        assert r.log_odds == pytest.approx(want["log_odds"], abs=1e-3) and r.rounds == want["rounds"]
        assert r.enc_null == pytest.approx(want["enc_null"]) and r.enc_align == pytest.approx(want["enc_align"], abs=1e-3) and r.enc_model == pytest.approx(want["enc_model"], abs=1e-2)
        for c in windows.COUNTS:
            assert r[f"p_{c}"] == pytest.approx(want["params"][c], abs=0.02) and r[f"n_{c}"] == pytest.approx(want["counts"][c], rel=0.02, abs=0.02)
        cuts = (r.a_start, r.a_end, r.b_start, r.b_end)
        assert cuts == ((None,) * 4 if total else tuple(want[c] for c in windows.PLACES))


@pytest.mark.parametrize("total", [True, False])
def test_one_task_does_all_rounds_of_a_pair(spark, sequences, monkeypatch, total):
    a, b, da, db, pairs = sequences
    some = pairs.filter("x = 1 and y = 1 or x = 4 and y = 4")
    rounds, by_key = windows._in_rounds, lambda df: {(r.x, r.y): r for r in df.collect()}
    monkeypatch.setattr(windows, "AT_ONCE", 5)
    monkeypatch.setattr(windows, "_in_rounds", lambda *_: pytest.fail("a round of jobs"))
    got = by_key(windows.align_long(some, da, db, "x", "y", k=None, tile=64, overlap=96, total=total, max_rounds=2))
    monkeypatch.setattr(windows, "_in_rounds", rounds)
    monkeypatch.setattr(windows, "TOGETHER", 1)
    want = by_key(windows.align_long(some, da, db, "x", "y", k=None, tile=64, overlap=96, total=total, max_rounds=2))
    assert sorted(got) == sorted(want) == [(1, 1), (4, 4)]
    for at, r in got.items():
        for c, v in r.asDict().items():
            assert v == (pytest.approx(want[at][c], abs=1e-9) if v is not None else want[at][c])


def test_seeds_choose_tiles(spark, sequences):
    a, b, da, db, pairs = sequences
    tiles = {(r.x, r.y): set() for r in pairs.collect()}
    for r in windows.seed_tiles(pairs, da, db, "x", "y", k=12, tile=16, reach=8).collect():
        tiles[r.x, r.y].add((r.tile_a, r.tile_b))
    for (x, y), got in tiles.items():
        seeds = [(i, j) for i in range(len(a[x]) - 11) for j in range(len(b[y]) - 11) if a[x][i : i + 12] == b[y][j : j + 12]]
        span = lambda p, n: range(max(0, (p - 8) // 16), min((n - 1) // 16, (p + 12 + 8) // 16) + 1)
        assert got == {(s, t) for i, j in seeds for s in span(i, len(a[x])) for t in span(j, len(b[y]))}
    near = {(r.x, r.y): r for r in windows.align_long(pairs, da, db, "x", "y", k=12, tile=64, overlap=64, reach=64).collect()}
    assert set(near) == {at for at, t in tiles.items() if t} >= {(1, 1), (2, 2), (4, 4)}
    assert all(near[i, i].log_odds > 10 for i in (1, 2, 4))


def test_seeds_of_few_kmers_leave_the_others_out_first(spark, sequences):
    _, _, da, db, pairs = sequences
    plan = windows.seed_tiles(pairs, da, db, "x", "y", k=12)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_a_long_pair_is_many_rows(spark):
    rng = random.Random(3)
    a = letters(rng, 30_000)
    b = letters(rng, 8_000) + a[10_000:10_400] + letters(rng, 8_000) + a[2_000:2_300] + letters(rng, 10_000)
    da, db = (spark.createDataFrame([(1, s)], f"{k} long, seq string") for s, k in ((a, "x"), (b, "y")))
    pairs = spark.createDataFrame([(1, 1)], "x long, y long")
    tiles = windows.seed_tiles(pairs, da, db, "x", "y", 20)
    assert 2 <= tiles.count() < 20  # of 30 x 27
    r = windows.align_long(pairs, da, db, "x", "y", total=False, max_rounds=0).first()
    assert abs(r.a_start - 10_000) < 5 and abs(r.a_end - 10_400) < 5 and abs(r.b_start - 8_000) < 5


def test_models_by_place(spark):
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 4, 80)
    for name in ("uniform", "fitted(1)", "adaptive(2)", "blend(1)"):
        p = places.chances(name, codes, 4)
        assert p.shape == (80, 4) and p.sum(1) == pytest.approx(np.ones(80))
        if not name.startswith("fitted"):  # what comes later changes nothing before
            assert (places.chances(name, np.append(codes[:50], 3 - codes[50:]), 4)[:51] == p[:51]).all()
    counts = np.ones(4)
    for s, q in zip(codes, places.chances("adaptive(0)", codes, 4), strict=True):
        assert q == pytest.approx(counts / counts.sum())
        counts[s] += 1

    class Cheat(places.Adaptive):
        def costs(self):
            return np.array([1.0, 1.0, 1.0, 1.0])

    with pytest.raises(ValueError, match="sum to one"):
        places.chances("cheat", codes, 4, {"cheat": Cheat})
    with pytest.raises(ValueError, match="unknown"):
        places.chances("nothing(2)", codes, 4)
    assert places.along(places.Fixed(np.array([[0.1, 0.9], [0.4, 0.6]])), np.array([0, 1, 1]), 2) == pytest.approx(np.array([[0.5, 0.5], [0.1, 0.9], [0.4, 0.6]]))


def test_tables_by_place(spark):
    rng = np.random.default_rng(5)
    seqs = {1: "acgtacgtaa", 2: "ggg", 3: ""}
    chance = {k: rng.dirichlet([1] * 4, len(s)) for k, s in seqs.items()}
    rows = [(k, i, p.tolist()) for k, t in chance.items() for i, p in enumerate(t)]
    df = spark.createDataFrame(list(seqs.items()), "k long, seq string")
    table = lambda rows: spark.createDataFrame(rows, "k long, pos long, p array<double>")
    got = places.pieces_of_table(df, table(rows), "k", 4, 3).collect()
    for r in got:
        start = max(0, 4 * r.tile - 3)
        part = seqs[r.k][start : 4 * r.tile + 4]
        assert (r.start, r.n, r.seq, r.first) == (start, len(seqs[r.k]), part, 4 * r.tile - start + 1 if r.tile else 0)
        assert r.p == pytest.approx(chance[r.k][start : start + len(part)].ravel())
        own = range(4 * r.tile, min(4 * r.tile + 4, len(seqs[r.k])))
        assert r.bits == pytest.approx(sum(-np.log2(chance[r.k][i]["acgt".index(seqs[r.k][i])]) for i in own))
    assert len(got) == 4
    long = [(k, i, "acgt"[s], float(-np.log2(p[s]))) for k, t in chance.items() for i, p in enumerate(t) for s in (2, 0, 3, 1)]
    back = places.bits_to_chances(spark.createDataFrame(long, "k long, pos long, sym string, bits double"), "k").collect()
    assert all(r.p == pytest.approx(chance[r.k][r.pos]) for r in back) and len(back) == 13
    for bad in (rows[:-1], [*rows, rows[0]], [(1, 0, [0.5, 0.5, 0.1, 0.0]), *rows[1:]]):
        with pytest.raises(Exception, match="chances"):
            places.pieces_of_table(df, table(bad), "k", 4, 3).collect()


def test_blends_of_fixed_models_tell_all_places_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    table, codes = rng.dirichlet([1] * 4, 4), rng.integers(0, 4, 3000)
    make = lambda: places.Blend([places.Adaptive(4, -1), places.Fixed(table)])
    model, want = make(), np.empty((len(codes), 4))
    for i, s in enumerate(codes):
        want[i] = model.costs()
        model.update(int(s))
    for n in (0, 1, 2, 3000):
        monkeypatch.setattr(places.Blend, "update", lambda *_: pytest.fail("a place at a time"))
        assert places.along(make(), codes[:n], 4) == pytest.approx(np.exp2(-want[:n]), abs=1e-12)
        monkeypatch.undo()
    assert places.Blend([places.Adaptive(4, 1)]).table(codes) is None


def test_blends_go_by_whole_pairs_and_write_no_chances(spark, monkeypatch):
    from bitloom.plans import catalog, placed  # noqa: F401

    monkeypatch.setattr(places, "pieces", lambda *_, **__: pytest.fail("chances as rows"))
    out = catalog.QUERIES["align_odds_blend"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["item_id", "doc_id", "log_odds"] and out.count() == 12
    rng = random.Random(14)
    core = letters(rng, 90)
    pairs = [(core, letters(rng, 50) + core[:45] + letters(rng, 700) + core[45:]), (core * 2, core), (core, "")]
    codes = [tuple(places.coded(s, "acgt") for s in p) for p in pairs[:2]]
    batch = align.Batch(codes, [tuple(places.chances("blend(1)", z, 4) for z in both) for both in codes])
    pair, cost = ({k: np.full(2, v) for k, v in x.items()} for x in (align.PAIR, align.AFFINE))
    for total, want in ((True, align.summed_by_diagonals(batch, pair, cost, True, counted=False)[0]), (False, align.likeliest(batch, pair, cost, True, False)[0])):
        assert align.fixed_odds(pairs, total=total, model="blend(1)") == pytest.approx([*want, 0.0], abs=1e-9)
