"""Orders over whole tables against plain sorting, with ties, nulls, frequent values and columns of awkward names."""

import random

import pytest

from bitloom.operators import repeats, tables
from bitloom.session import shared_folder


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([0.5, 0.5, 0.5, None, rng.random()]), i % 3 == 0, "b", i, "k", "r") for i in range(500)]
    return spark.createDataFrame(data, "id long, score double, truth boolean, bucket string, _k long, run string, _hit string"), data


def by(data, ascending):
    key = lambda r: (r[1] is not None, r[1] or 0.0) if ascending else (r[1] is None, -(r[1] or 0.0))
    return sorted(data, key=lambda r: (key(r), r[0]))


@pytest.mark.parametrize("ascending", [True, False])
def test_ranks_and_running_totals(rows, ascending):
    df, data = rows
    want = {r[0]: i for i, r in enumerate(by(data, ascending))}
    out = tables.rank(df, "score", "id", "place", ascending)
    assert out.columns == [*df.columns, "place"]
    got = {r.id: r for r in out.collect()}
    assert {i: r.place for i, r in got.items()} == want and all(r.bucket == "b" and r._k == i for i, r in got.items())
    both = tables.ranks(df, "id", {"one": ("score", ascending), "two": ("id", True)}).collect()
    assert {r.id: (r.one, r.two) for r in both} == {i: (want[i], i) for i in want} and both[0].bucket == "b"


def test_roc_keeps_the_columns_of_its_input(rows):
    df, data = rows
    out = tables.roc(df, "score", "truth", "id")
    assert out.columns == [*df.columns, "tp", "fp", "coverage", "errors"]
    tp = fp = 0
    want = {}
    for r in by(data, False):
        tp, fp = tp + r[2], fp + (not r[2])
        want[r[0]] = (tp, fp)
    assert {r.id: (r.tp, r.fp) for r in out.collect()} == want
    assert tables.roc(df.limit(0), "score", "truth", "id").count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://somewhere:7077"

    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Cluster())
    assert shared_folder(spark) != shared_folder(spark)


@pytest.mark.parametrize("key", ["new", "island", "user"])
def test_merged_intervals_of_any_names(spark, key):
    rows = [(1, 0, 4), (1, 4, 6), (1, 3, 5), (1, 9, 10), (2, 5, 7)]
    df = spark.createDataFrame(rows, f"{key} int, low int, high int")
    assert sorted(map(tuple, repeats.merge_intervals(df, key, "low", "high").collect())) == [(1, 0, 6, 3), (1, 9, 10, 1), (2, 5, 7, 1)]
    assert sorted(map(tuple, repeats.cell_stats(df, key, "low", "high").collect())) == [(1, 2, 4, 7, 2), (2, 1, 1, 2, 0)]


def test_parameters_are_parsed_once_a_row(spark):
    from pyspark.sql import functions as F

    from bitloom.operators import tables

    rows = spark.createDataFrame([("a=1,B=2\na=3,x",), ("",)], "t string")
    merged = rows.select(tables.merge_params(tables.params_from_text(F.lower("t")), tables.params_from_text(F.col("t"))).alias("m"))
    assert [r.m for r in merged.collect()] == [{"a": 3.0, "b": 2.0}, {}]
    assert merged._jdf.queryExecution().analyzed().toString().count("split(") == 2
