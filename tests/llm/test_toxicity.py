import math
import zlib

import pandas as pd

from bitloom.llm import toxicity


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())
    m = got.merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m.toxic).mean() > 0.95


def test_pairs_count_beyond_single_words(spark):
    rows = [(i, f"{a} {b} filler{i % 7}", int(a == "dumb" and b == "tribe")) for i, (a, b) in enumerate([("dumb", "tribe"), ("dumb", "luck"), ("kind", "tribe"), ("kind", "luck")] * 150)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).toPandas().set_index("doc_id").predicted
    assert all(got[i] == y for i, _, y in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (3, "b " * 100_000), (3, "b " * 100_000)], "doc_id long, text string")
    none = spark.createDataFrame([(None, None), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    got = toxicity.score(docs, model).toPandas()
    assert len(got) == 5 and (got.predicted == 0).all()
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0
    assert toxicity.keep_clean(docs, model).count() == 5


def test_scores_equal_the_plain_formula_and_conflicting_labels_count_as_toxic(spark):
    rows = [(i, f"{a} {b} filler{i % 7}", int(a == "dumb" and b == "tribe")) for i, (a, b) in enumerate([("dumb", "tribe"), ("dumb", "luck"), ("kind", "tribe"), ("kind", "luck")] * 60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = [(i, y) for i, _, y in rows]
    twice = spark.createDataFrame([(i, 0) for i, _ in labels] + labels, "doc_id long, toxic int").repartition(5)
    model = toxicity.fit(docs, twice)
    again = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model["chosen"] == again["chosen"] and abs(model["w"] - again["w"]).max() == 0
    for text, got in [(r.text, r.score) for r in docs.join(toxicity.score(docs, model), "doc_id").limit(20).collect()]:
        terms = {zlib.crc32(t.encode()) % toxicity.BUCKETS for w in text.lower().split() for t in (f"w:{w}", *(f"p:{w[:n]}" for n in (3, 4, 5) if len(w) >= n))}
        on = sorted(model["chosen"][t] for t in terms if t in model["chosen"])
        z = model["b"] + sum(float(model["w"][i]) for i in on)
        z += sum(float(a) * float(b) for x, i in enumerate(on) for j in on[x + 1 :] for a, b in zip(model["v"][i], model["v"][j], strict=True))
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-5
