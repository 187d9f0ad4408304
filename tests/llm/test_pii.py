import hashlib
import itertools
import math
import random
import re

import numpy as np

from bitloom.llm import pii


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in tests.items() for m in re.finditer(p, text) if ok(m.group())]


def test_base_spans_equal_plain_regex():
    rng = random.Random(1)
    for _ in range(6000):
        text = "".join(rng.choice(["1", "2", "25", "0", ".", ".", "@", "a", "b-", "+", " ", "-", "(", "é", "_", "4111111111111111", "a@b.c", "1.2.3.4"]) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == brute(text), text


def test_rows_and_digest(spark):
    texts = [None, "", "no digits", "mail a.b@c.de and 1.2.3.4", "é +1 (586) 555-8430 4111 1111 1111 1111", "9" * 200_000, "a@" * 50_000]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(3, texts[3], 9)], "doc_id long, text string, n_email int")
    got = pii.find(docs).toPandas()
    assert len(got) == len(texts) + 1
    for r in got.itertuples():
        want = pii.base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_repeats_take_the_label_of_their_twin(spark):
    text = "write to knsh.99@mail.example.com today , the user knsh.99 said so , call +15865558430 or 5865558430 now"
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "version 12345678 and 12345678 again", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    at = text.index("user knsh.99") + 5
    assert f"email:{at}:{at + 7}" in got[1]
    at = text.index("5865558430 now")
    assert f"phone:{at}:{at + 10}" in got[1]
    assert got[2] == ""
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert "knsh" not in clean[1].text and "555" not in clean[1].text and clean[1].n_chars == len(clean[1].text)
    assert clean[2].text == "version 12345678 and 12345678 again"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(docs).count() == 0 and pii.redact(docs).count() == 0


def test_marginals_equal_enumeration():
    """On a graph without cycles messages are exact; with a short cycle the likeliest labels are the same."""
    rng = np.random.default_rng(2)
    size = len(pii.LABELS)
    for chain, skip, exact in (([(0, 1), (1, 2), (2, 3)], [(1, 4)], True), ([(0, 1), (2, 3)], [(0, 3), (3, 4)], True), ([(0, 1), (1, 2)], [(0, 2), (2, 3)], False)):
        graph = object.__new__(pii.Graph)
        n = 1 + max(max(e) for e in chain + skip)
        graph.labels, graph.shapes, graph.chain, graph.skip = [-1] * n, [f"s{i}" for i in range(n)], chain, skip
        graph.labels[1] = 2
        tables = {k: rng.normal(0, 0.5, (size, size)) for k in ("chain", "skip")}
        model = {"unary": {f"s{i}": rng.normal(0, 1, size) for i in range(n)}, "rest": np.zeros(size), "chain": tables["chain"] + tables["chain"].T, "skip": tables["skip"] + tables["skip"].T + 2 * np.eye(size)}
        want = np.zeros((n, size))
        for y in itertools.product(range(size), repeat=n):
            if y[1] == 2:
                w = sum(model["unary"][f"s{i}"][v] for i, v in enumerate(y) if i != 1) + sum(model[k][y[a], y[b]] for k, edges in (("chain", chain), ("skip", skip)) for a, b in edges)
                want[range(n), y] += math.exp(w)
        want /= want.sum(1, keepdims=True)
        got = pii.marginals(graph, model)
        assert (abs(got - want) < (0.01 if exact else 0.15)).all() and (got.argmax(1) == want.argmax(1)).all()


def test_redact_keeps_columns_of_any_name_and_repeated_rows(spark):
    rows = [(1, "a.b@c.de", "x", 3), (1, "a.b@c.de", "x", 3), (None, None, None, None), (2, "", "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hot string, spans int")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "<EMAIL>", "x", 3), (1, "<EMAIL>", "x", 3), (None, None, None, None), (2, "", "y", 0)], key=repr)


def test_a_name_stays_what_its_address_is(spark):
    model = pii.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    for n in (1, 3, 8, 40, 200):
        text = "write to knsh.99@mail.example.com " + "user knsh.99 said so " * n
        base = pii.base_spans(text)
        added = pii.added_spans(text, base, model)
        assert [k for k, _, _ in added] == ["email"] * n and all(text[a:b] == "knsh.99" for _, a, b in added)


def test_repeats_without_an_observed_twin_are_nothing(spark):
    model = pii.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    for text in ("ticket 44871234 and ticket 44871234 and again ticket 44871234", "id 4111111111111112 " * 30, "a1b2c3d4 " * 50 + "mail x@y.org"):
        assert pii.added_spans(text, pii.base_spans(text), model) == []
    text = "call +49 (30) 4487-1234 or 493044871234, but not 493044871235"
    assert [(k, text[a:b]) for k, a, b in pii.added_spans(text, pii.base_spans(text), model)] in ([], [("phone", "493044871234")])
    graph = pii.Graph("x@y.org 12345 12345 x@y.org", pii.base_spans("x@y.org 12345 12345 x@y.org"))
    assert graph.possible() == [{1}, set(), set(), {1}]
