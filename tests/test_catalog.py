import random

import pytest

from bitloom.operators import align, generate, repeats
from bitloom.plans import catalog


def letters(rng, n):
    return "".join(rng.choice("acgt") for _ in range(n))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Items and documents that share one 20-mer (1), all of a short item (2), an exact long copy (3) and nothing (4)."""
    rng, folder = random.Random(3), str(tmp_path_factory.mktemp("small"))
    core, short, whole = letters(rng, 20), letters(rng, 12), letters(rng, 60)
    items = [(1, letters(rng, 15) + core + letters(rng, 15)), (2, short), (3, whole), (4, letters(rng, 50)), (5, "")]
    docs = [(1, letters(rng, 40) + core + letters(rng, 40)), (2, letters(rng, 50) + short + letters(rng, 50)), (3, letters(rng, 30) + whole[:40] + letters(rng, 3) + whole[42:])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_every_met_pair_is_scored(spark, small):
    assert sorted((r.item_id, r.doc_id) for r in catalog.QUERIES["sw_score"](spark, small).select("item_id", "doc_id").collect()) == [(1, 1), (2, 2), (3, 3)]


def test_documents_are_cut_to_letters_once(spark, small):
    """The k-mers, the short items and the pairs themselves read letters that were written once, not the texts."""
    got = catalog.met_pairs(spark, small)
    assert not any("documents.parquet" in f for f in got.inputFiles())
    assert sorted((r.item_id, r.doc_id, len(r.seq_b)) for r in got.collect()) == [(1, 1, 100), (2, 2, 112), (3, 3, 91)]


@pytest.mark.parametrize(("name", "total"), [("m_align_global_sum", True), ("m_align_global_best", False)])
def test_rounds_go_on_until_they_gain_nothing(spark, small, name, total):
    text = lambda table, key: {r[key]: r.text for r in spark.read.parquet(f"{small}/{table}.parquet").collect()}
    items, docs = text("benchmark", "item_id"), text("documents", "doc_id")
    rows = catalog.QUERIES[name](spark, small).collect()
    for r in rows:
        want = align.m_align(items[r.item_id], docs[r.doc_id], local=False, total=total)
        assert r.rounds == want["rounds"] and r.log_odds == round(want["log_odds"], 4)
    assert max(r.rounds for r in rows) > 4


def test_each_child_meets_each_item(spark, small):
    rows = catalog.QUERIES["population_roc"](spark, small).collect()
    assert len(rows) == len({r.id for r in rows}) == 4 * 3 * 4 and sum(r.truth for r in rows) == 4 * 3


def test_fading_bits_reads_events_as_a_stream(spark, sf):
    got = catalog.QUERIES["fading_bits"](spark, sf)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    want = generate.fading_bits(catalog._event_strings(spark, sf), "user_id", 1, 16, alphabet="cepsv").collect()
    assert {(r.user_id, r.length, r.bits) for r in got.collect()} == {(r.user_id, r.length, round(r.bits, 4)) for r in want}
    rows = [(None, 1, "v"), (1, 2, "c"), (1, 1, "v"), (2, 1, None), (None, 2, "v")] + [(3, i, "ev"[i % 2]) for i in range(500)]
    strings = [(None, "vv"), (1, "vc"), (2, ""), (3, "ev" * 250)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    for order in (0, 1, 2):
        events = spark.createDataFrame(rows, "k long, t long, s string")
        out = generate.fading_event_bits(events, "k", ["t"], "s", order, 16, "cepsv").collect()
        plain = generate.fading_bits(spark.createDataFrame([(k or 0, q) for k, q in strings], "k long, seq string"), "k", order, 16, alphabet="cepsv").collect()
        assert {(r.k or 0, r.length, round(r.bits, 6)) for r in out} == {(r.k, r.length, round(r.bits, 6)) for r in plain}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pairs_that_meet_need_no_pass_for_each_length(spark):
    rng = random.Random(6)
    items = [(i, letters(rng, n)) for i, n in enumerate([1, 3, 5, 9, 12, 12, 19, 20, 21, 40, 60, 0])]
    docs = [(100 + i, letters(rng, 30) + items[i][1] + letters(rng, 30)) for i in range(12)] + [(200, None), (201, ""), (202, items[9][1][5:26])]
    want = {(i, d) for i, s in items for d, t in docs if s and t and (s in t if len(s) < 20 else any(s[j : j + 20] in t for j in range(len(s) - 19)))}
    a, b = spark.createDataFrame(items, "item_id long, seq string"), spark.createDataFrame(docs, "doc_id long, seq string")
    for few in (256, 2):
        got = repeats.met_pairs(a, b, "item_id", "doc_id", 20, few=few)
        rows = [(r.item_id, r.doc_id) for r in got.collect()]
        assert sorted(rows) == sorted(want)
        passes = got._jdf.queryExecution().optimizedPlan().toString().count("Generate")
        assert passes == 2 if few == 256 else passes > 6  # the k-mers of either side; then those of each length
