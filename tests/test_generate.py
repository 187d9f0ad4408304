import numpy as np
import pytest

from bitloom.operators import generate as G

TEST_MODEL = np.array([[11, 2, 1, 1], [1, 12, 1, 1], [1, 1, 11, 2], [1, 1, 1, 12]]) / 15


def test_entropies():
    assert G.entropy_rate(TEST_MODEL) == pytest.approx(1.11800865) and G.mean_row_entropy(TEST_MODEL) == pytest.approx(1.13776067, abs=1e-4)
    assert G.entropy_rate(np.array([[0.2, 0.1, 0.5, 0.2]]), 0) == pytest.approx(1.76096404)
    assert G.entropy_rate(np.full((1, 4), 0.25), -1) == 2
    p = np.array([[0.22705, 0.77258, 4.3e-6, 3.7e-4]])
    assert G.negate_model(p / p.sum())[0] == pytest.approx([0.25765, 0.07581, 0.33333, 0.33321], abs=2e-4)
    q = G.uniform_stats(G.random_model(1, seed=3))
    assert q.sum(0) == pytest.approx(np.ones(4)) and q.sum(1) == pytest.approx(np.ones(4))
    assert G.model_power(TEST_MODEL, 1) == pytest.approx(TEST_MODEL)


def test_generators_follow_their_model():
    rng = np.random.default_rng(1)
    s = G.generate(TEST_MODEL, 1, 6000, rng)
    same = sum(a == b for a, b in zip(s, s[1:], strict=False)) / len(s)
    assert same == pytest.approx(11.5 / 15, abs=0.03)
    t, counts = G.mutate(s[:300], 40, TEST_MODEL, 1, rng)
    assert sum(counts.values()) == 40 and len(t) == 300 + counts["insert"] - counts["delete"]
    assert len(G.generate_blend([TEST_MODEL, TEST_MODEL.T / TEST_MODEL.T.sum(1, keepdims=True)], 200, rng)) == 200


def test_population_is_repeatable(spark):
    parents = spark.createDataFrame([(1, "acgtacgtacgtaacc"), (2, "ttttggggccccaaaa")], "id long, seq string")
    a = sorted(G.population(parents, "id", [0, 3]).collect())
    assert a == sorted(G.population(parents.repartition(2), "id", [0, 3]).collect())
    assert [r.seq for r in a if r.mutates == 0] == ["acgtacgtacgtaacc", "ttttggggccccaaaa"]
    fade = G.fading_bits(parents, "id", 0, 0).collect()
    assert all(r.bits > 0 for r in fade)


def test_counts_of_all_sizes_from_one_look(spark):
    from bitloom.operators import markov

    rows = spark.createDataFrame([(s,) for s in ("", "a", "ac", "acg", "acgt", "aaaaaa", "gattacagattaca", "cg")], "seq string")
    got = markov.kmer_counts_by_size(rows, 1, 4)
    for k in range(1, 5):
        want = {(r.kmer, r.n) for r in markov.kmer_counts(rows, k).collect()}
        assert {(r.kmer, r.n) for r in got.filter(f"k = {k}").collect()} == want and all(len(x) == k for x, _ in want)
    looks = got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + got._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation")
    assert looks == 1
