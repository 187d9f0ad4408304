import pandas as pd
from test_decontaminate import brute as leaks
from test_neardup import brute as groups

import corpus_pipeline
from bitloom.llm import pii, toxicity

D = "/root/testdata/sf0.001"


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    now = docs.toPandas()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]

    model = toxicity.fit(docs, spark.read.parquet(f"{D}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted == 0}
    out = stages["toxicity"](spark, docs, D)
    assert out.columns == columns and {r.doc_id for r in out.select("doc_id").collect()} == clean
    now = now[now.doc_id.isin(clean)]

    docs = spark.createDataFrame(now)
    want = {i for i, (_, root) in groups(list(zip(now.doc_id, now.text, strict=True)), 5, 80).items() if i == root}
    out = stages["near_dedup"](spark, docs, D)
    assert out.columns == columns and sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(want)
    now = now[now.doc_id.isin(want)]

    docs = spark.createDataFrame(now)
    bench = pd.read_parquet(f"{D}/benchmark.parquet")
    short = now[now.text.str.len() < 1500]
    bad = {d for d, _ in leaks(list(zip(short.doc_id, short.text, strict=True)), list(zip(bench.item_id, bench.text, strict=True)))}
    out = {r.doc_id for r in stages["decontamination"](spark, docs, D).collect()}
    assert set(short.doc_id) & out == set(short.doc_id) - bad
    now = now[now.doc_id.isin(out)]

    docs = spark.createDataFrame(now)
    out = stages["pii"](spark, docs, D).toPandas()
    assert list(out.columns) == columns and sorted(out.doc_id) == sorted(now.doc_id)
    before = now.set_index("doc_id").text
    assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in out.itertuples())
    assert all(r.text == before[r.doc_id] for r in out.itertuples() if not any(c in before[r.doc_id] for c in "@0123456789"))

    pieces = stages["packing"](spark, spark.createDataFrame(out), D).toPandas()
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all() and pieces.doc_id.nunique() == len(out)


def test_run(spark):
    rows = corpus_pipeline.run(spark, D)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(rows.columns)


def test_stages_on_awkward_rows(spark):
    """Nulls in any column, empty and long texts, equal rows, ids that repeat or lack, and columns whose names operators use."""
    bench = pd.read_parquet(f"{D}/benchmark.parquet")
    item = max(bench.text, key=len)
    words = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, words, "en", "a"), (1, words, "en", "a"), (1, "quite another text of a few words", None, None), (None, words + " more", "en", "b"), (None, None, None, None), (2, None, "en", "a"), (3, "", None, "b"), (4, "  ", "en", None),
        (None, item, "en", "b"), (5, "some words before " + item + " and after", "en", "a"), (6, "long " * 60_000, "en", "a"), (7, "write to a.b@c.de", "en", "b"), (7, "write to a.b@c.de", "en", "b"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, s string, g long, node string, look string, kept boolean"
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "s", 1, None, "l", True) for r in rows], schema)
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())

    out = stages["near_dedup"](spark, docs, D)
    assert out.columns == docs.columns
    got = texts(out)
    assert got.count((1, words)) == 1 and got.count((7, "write to a.b@c.de")) == 1 and (0, words + " more") not in got
    assert len(got) == len(rows) - 4  # a copy each of ids 1 and 7, the longer one without an id, and the bare item, which follows the text around it

    out = stages["decontamination"](spark, docs, D)
    assert out.columns == docs.columns
    got = texts(out)
    assert (0, item) not in got and not any(i == 5 for i, _ in got) and len(got) == len(rows) - 2

    for name in ("toxicity", "pii"):
        out = stages[name](spark, docs, D)
        assert out.columns == docs.columns and out.count() == len(rows)
    pieces = stages["packing"](spark, docs, D).toPandas()
    assert pieces[pieces.start == 0].shape[0] == len(rows)

    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, D).count() == 0
