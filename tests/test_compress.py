import itertools
import math
import random

import numpy as np
import pytest

from bitloom.operators import compress as C
from bitloom.operators.align import AFFINE, LINEAR, NAMES, PAIR
from bitloom.operators.compress import COMPLEMENT, COSTS, compress, symbol_bits


def say(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("acgt") for _ in range(n))


def test_without_copies_it_is_the_base_model():
    bits = symbol_bits("aaaa", order=0, forward=(), reverse=())
    assert abs(sum(bits) - math.log2(35)) < 1e-9


def test_repeats_cost_less():
    a = say(150, 1)
    comp = a[::-1].translate(str.maketrans("acgt", "tgca"))
    mutated = a[:50] + "a" + a[50:90] + a[92:]
    plain = sum(symbol_bits(a + say(150, 2)))
    for other in (a, comp, mutated):
        for seed in (0, 12):
            assert sum(symbol_bits(a + other, seed=seed)) < plain - 100, (other == comp, seed)
    assert all(b > 0 for b in symbol_bits(a + a))
    assert sum(symbol_bits(a + a, reverse=())) < sum(symbol_bits(a + a, reverse=(), seed=12)) + 30
    assert sum(symbol_bits(a + a, skip=150)) < 100


def test_frame(spark):
    a = say(60, 3)
    df = spark.createDataFrame([(1, a, a), (2, "", a), (3, "acgt", "")], "id long, seq string, pre string")
    rows = {r.id: r for r in compress(df, "id").collect()}
    assert rows[2].bits == 0 and rows[1].length == 60
    assert {r.id: r.bits for r in compress(df, "id", prefix="pre").collect()}[1] < rows[1].bits - 40
    assert compress(df, "id", per_symbol=True).count() == 64


def plain_bits(seq, machines, params=None, table=None):
    """The same model in chances, cell by cell; machines are (name, direction)."""
    params = params or C.start_params([k for k, _ in machines], table)
    go = {k: 2.0**-v for k, v in params["copy"].items()}
    cells, base, before, seen, out = [{} for _ in machines], 1.0, 1.0, {c: 1 for c in "acgt"}, []
    for i, s in enumerate(seq):
        alone = base * (go["nostart"] if i and machines else 1) * seen[s] / sum(seen.values())
        seen[s] += 1
        now = back = alone
        for m, (kind, step) in enumerate(machines):
            p = {k: 2.0**-v for k, v in params[kind].items() if k != "table"}
            own = params[kind].get("table")
            source = seq if step > 0 else "".join(COMPLEMENT[c] for c in seq)
            if i:
                for at in range(1, i + 1):
                    cells[m][0, at] = cells[m].get((0, at), 0) + base * go["start"] / len(machines) / (i + 1)
            new = {}
            for at in range(1, i + 2):
                d, h, v = (cells[m].get((k, at), 0) for k in range(3))
                chance = (p["match"] if source[at - 1] == s else p["change"] / 3) if own is None else own["acgt".index(s), "acgt".index(source[at - 1])]
                if at + step > 0:
                    new[0, at + step] = (d * p["diag_fromD"] + (h + v) * p["diag_fromI"]) * chance
                new[1, at] = (d * p["start_fromD"] + h * p["cont_fromI"] + v * p["start_fromI"]) / 4
            for at in range(1, i + 2):  # source symbols that are passed over on the way here
                passed = [(q, (q - at) * -step) for q in range(1, i + 3) if (at - q) * step > 0]
                new[2, at] = sum((new.get((0, q), 0) * p["start_fromD"] + new.get((1, q), 0) * p["start_fromI"]) * p["cont_fromI"] ** (n - 1) for q, n in passed)
            total = sum(new.values())
            cells[m] = {k: x * go["cont"] for k, x in new.items()}
            now, back = now + total * go["cont"], back + total * go["end"]
        out.append(math.log2(before / now))
        before, base = now, back
    return out


MIXES = [[("3state", 1)], [("3state", -1)], [("1state", 1), ("3state", 1)], [("3state", 1), ("1state", -1), ("3state", 1)]]
TABLE = np.array([[0.7, 0.1, 0.2, 0.1], [0.1, 0.6, 0.1, 0.1], [0.1, 0.1, 0.6, 0.2], [0.1, 0.2, 0.1, 0.6]])


def names(machines):
    return {"forward": tuple(k for k, s in machines if s > 0), "reverse": tuple(k for k, s in machines if s < 0)}


def sample(seed, n=9):
    a = say(n, seed)
    return a + a[::-1].translate(str.maketrans("acgt", "tgca")) + a + say(3, seed + 9)


@pytest.mark.parametrize("machines", MIXES)
@pytest.mark.parametrize("table", [None, TABLE])
def test_bits_equal_the_plain_model(machines, table):
    machines = sorted(machines, key=lambda m: -m[1])
    for seed in range(3):
        s = sample(seed)
        got = symbol_bits(s, table=table, **names(machines))
        assert got == pytest.approx(plain_bits(s, machines, table=table), abs=1e-8)


@pytest.mark.parametrize("table", [None, TABLE])
def test_counts_are_derivatives_of_the_code_length(table):
    machines, s, h = [("1state", 1), ("3state", 1), ("3state", -1)], sample(4), 1e-5
    run = lambda p: C.one_pass(s, p, "acgt", machines, "adaptive(0)", None, 0, 10, 10, 4.0)
    params = C.start_params([k for k, _ in machines], table)
    bits, counts = run(params)
    for kind, values in counts.items():
        for name in values:
            if name == "table":
                for x, y in itertools.product(range(4), repeat=2):
                    moved = {k: dict(v) for k, v in params.items()}
                    moved[kind]["table"] = TABLE.copy()
                    moved[kind]["table"][x, y] *= 2.0**-h
                    assert values[name][x, y] == pytest.approx((run(moved)[0].sum() - bits.sum()) / h, abs=1e-3)
            elif table is None or name not in PAIR:
                moved = {k: dict(v) for k, v in params.items()}
                moved[kind][name] += h
                assert values[name] == pytest.approx((run(moved)[0].sum() - bits.sum()) / h, abs=1e-3), (kind, name)


def test_passes_never_cost_more():
    s = sample(6, 60) + say(40, 7)
    lengths = [sum(symbol_bits(s, passes=n)) for n in (1, 2, 3, 6)]
    assert all(a >= b - 0.5 for a, b in zip(lengths, lengths[1:], strict=False)) and lengths[-1] < lengths[0]
    bits, made, params = C.passes_of(s, passes=0)
    assert 2 < made <= C.MAX_PASSES and bits.sum() <= lengths[-1] + 0.1
    assert sum(2.0 ** -params["3state"][k] for k in ("diag_fromI", "start_fromI", "cont_fromI")) == pytest.approx(1)
    assert set(params["3state"]) == {*NAMES, *PAIR} and set(C.start_params(["1state"])["1state"]) == set(LINEAR) | set(PAIR)


def test_seeds_and_the_cut():
    a = say(80, 8)
    s = a + say(30, 9) + a[:35] + "g" + a[36:] + a[10:60][::-1].translate(str.maketrans("acgt", "tgca"))
    full = sum(symbol_bits(s))
    # every place stays live, once it is: the more seeds, the nearer to the full mode
    near = [sum(symbol_bits(s, seed=k, around=300, cut=-1e9)) for k in (1, 4, 8)]
    assert near[0] == pytest.approx(full, abs=0.5) and near[0] <= near[1] + 0.5 <= near[2] + 1.5
    assert full <= sum(symbol_bits(s, seed=8)) + 1e-6 and sum(symbol_bits(s, seed=8)) < sum(symbol_bits(s, forward=(), reverse=())) - 60
    got = C._seeds(b"abcabcabc", 3, 3, {b"abc": [0], b"bca": [1]}, 0, None)
    assert got.tolist() == [0]
    assert C._seeds(b"aaaa", 2, 2, {b"aa": [0, 1]}, 0, None).tolist() == [0]  # not the one that overlaps by all but one
    assert len(C._seeds(b"abcab", 4, 3, {}, 0, None)) == 0


def test_time_follows_the_live_places():
    a = say(3000, 12)
    machine_sizes = []

    def each(i, live, share, step):
        if live is not None:
            machine_sizes.append(len(live))

    C.passes_of(a + say(500, 13) + a[:2000], seed=14, passes=1, each=each)
    assert sum(machine_sizes) < 40 * 2 * 5500 and max(machine_sizes) < 600


def test_match_map(spark):
    s = sample(3, 12)
    cells = C.matches(s)
    total = {}
    for i, _, _, p in cells:
        total[i] = total.get(i, 0) + p
    assert set(total) == set(range(len(s))) and all(p == pytest.approx(1) for p in total.values())
    got = C.match_map(spark.createDataFrame([(1, s), (2, None), (3, "")], "id long, seq string"), "id", bins=4, least=0.01).collect()
    assert {(r.i, r.j, r.direction) for r in got} == {c[:3] for c in C.matches(s, 4) if c[3] > 0.01} and all(r.id == 1 for r in got)


def test_unknown_machine():
    with pytest.raises(ValueError, match="unknown machine"):
        symbol_bits("acgt", forward=("2state",))
    assert COSTS["nostart"] < COSTS["start"] and AFFINE["cont_fromI"] > 0


def test_many_sequences_at_once_cost_what_each_does():
    rng = random.Random(9)
    seqs = ["".join(rng.choice("cepsv") for _ in range(n)) for n in (0, 1, 2, 30, 31, 66, 90, 200)] + ["cep" * 60, "c" * 150]
    for options in ({}, {"forward": ("3state", "1state")}, {"forward": ()}, {"order": 1}):
        skips = [len(s) // 2 for s in seqs]
        got = C.passes_all(seqs, skips, alphabet="cepsv", reverse=(), **options)
        for s, n, (bits, made) in zip(seqs, skips, got, strict=True):
            want, passes, _ = C.passes_of(s, alphabet="cepsv", reverse=(), skip=n, **options)
            assert made == passes and bits == pytest.approx(want, abs=1e-9)
    assert len(C.passes_all(["acgt" * 5], [3])[0][0]) == 17  # with reverse machines one by one
