import math
import zlib
from collections import Counter

import pandas as pd

from bitloom.llm import langid


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = langid.predict(docs, langid.fit(docs)).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.itertuples())
    m = got.merge(pd.read_parquet(f"{d}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    m = m[m.held_out]
    print("accuracy", (m.lang_pred == m["lang"]).mean())
    assert (m.lang_pred == m["lang"]).mean() > 0.96


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "de"), (3, "12 34 !", None), (None, "hello there", None), (5, "the cat and the dog " * 40, "en"), (6, "der Hund und die Katze " * 40, "de"), (6, "der Hund und die Katze " * 40, "de")]
    rows += [(10 + i, "the cat sat on the mat with hats" if i % 2 else "die Katze sass auf der Matte mit Hut", "en" if i % 2 else "de") for i in range(40)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    model = langid.fit(docs)
    got = langid.predict(docs, model).toPandas()
    assert list(got.lang_pred[:3]) == ["und"] * 3 and len(got) == len(rows)
    assert list(got.lang_pred[4:7]) == ["en", "de", "de"]
    none = langid.fit(docs.limit(0))
    assert set(langid.predict(docs, none).toPandas().lang_pred) == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_predictions_equal_plain_duels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)

    def winner(names, machines, x):
        votes, margin, least = Counter(), Counter(), dict.fromkeys(names, 30.0)
        for (a, b), w in machines.items():
            if a in names and b in names:
                m = sum(float(p) * float(q) for p, q in zip(x, w, strict=False)) + 0.1 * float(w[-1])
                votes[a if m >= 0 else b] += 1
                for n, v in ((a, m), (b, -m)):
                    margin[n] += v
                    least[n] = min(least[n], v)
        best = max(names, key=lambda n: (votes[n], margin[n], n))
        return best, 1 / (1 + math.exp(-2 * least[best]))

    for r in docs.join(langid.predict(docs, model), "doc_id").limit(25).collect():
        grams = Counter()
        raw = f" {r.text.lower()} ".encode()
        for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
            grams[(((a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ c * 0xC2B2AE35) & 0xFFFFFFFF) * 0x27D4EB2F & 0xFFFFFFFF) >> 20] += 1
        size = math.sqrt(sum(grams.values()))
        x = [math.sqrt(grams[i]) / size for i in range(langid.SIZE)]
        fam, sure = winner(list(model["families"]), model["split"], x)
        lang, inside = winner(model["families"][fam], model["within"], x)
        assert r.lang_pred == lang and abs(r.score - sure * inside) < 1e-3
