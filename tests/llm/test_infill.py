import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bitloom.llm import infill
from bitloom.llm.common import text_bytes


def plain(doc_id, text, seed=7, rate=100, spm=50, unit="line"):
    """The contract, a text at a time."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+" if unit == "line" else r"(?s).", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out


ROWS = [
    (1, "one\ntwo\nthree\n"), (2, "one line"), (3, ""), (4, None), (5, "\n\n\n"), (6, "a <P> b\nc\n"), (7, "<\nS>\n<S\n>\n"), (8, "héé\n日本\n\U0001f600x\nend"),
    (None, "no id\nat all\n"), (9, "same\nrows\n"), (9, "same\nrows\n"), (10, "x\n" * 70_000 + "y" * 900_000), (11, "<\n" * 50), (12, "tail<P\n>"),
]


@pytest.mark.parametrize("options", [{}, {"rate": 40, "spm": 100}, {"unit": "char", "seed": 3}])
def test_as_one_by_one(spark, options):
    docs = spark.createDataFrame([(i, t, 1, "o") for i, t in ROWS], "doc_id long, text string, n int, output string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    got = infill.restore(infill.transform(docs, **options)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((plain(i, t, **options) for i, t in ROWS), key=key)
    assert {(r.doc_id, r.restored) for r in got} == {(i, t or "") for i, t in ROWS}


def test_empty_table_and_digests(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert infill.digests(none).count() == 0
    one = infill.digests(spark.createDataFrame([(8, ROWS[7][1])], "doc_id long, text string")).first()
    assert one.output_sha256 == hashlib.sha256(plain(*ROWS[7])[-1].encode()).hexdigest() and one.restored_sha256 == hashlib.sha256(ROWS[7][1].encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="a\n<PSM>é😀", max_size=40), max_size=6), st.integers(0, 1 << 62))
def test_scatter_and_gather(texts, seed):
    rng = np.random.default_rng(seed)
    data, bounds = text_bytes(pa.array(texts, pa.string()))
    got, out, new = infill.scatter(data, bounds, [rng.integers(0, 1 << 32, len(texts)) for _ in range(4)], 100, 50, "line")
    back, again = infill.gather(out, new, got["moved"], got["swapped"])
    assert back.tobytes() == "".join(texts).encode() and again.tolist() == bounds.tolist()
    assert got["moved"].tolist() == [bool(t) and not re.search("<[PSM]>", t) for t in texts]


def test_broken_output(spark):
    broken = spark.createDataFrame([(1, "psm", "<P>a<S>b")], "doc_id long, form string, output string")
    with pytest.raises(Exception, match="three marks"):
        infill.restore(broken).collect()
