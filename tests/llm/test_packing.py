import random
import zlib
from collections import Counter

import numpy as np
import pytest

from bitloom.llm import packing


def expected_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


@pytest.mark.parametrize(("targets", "bucket"), [(None, 1 << 22), (None, 500), ({"a": 0.7, "b": 0.3}, 500)])
def test_round_trip(spark, targets, bucket):
    rng = random.Random(2)
    texts = [None, "", "<|endoftext|> x <| y", "é 漢字 \n\n  tabs\t", "long word " * 3000] + [" ".join(rng.choice(["the", "Cat", "12", "naïve"]) for _ in range(rng.randint(0, 300))) for _ in range(120)]
    rows = [(i, t, rng.choice(["a", "a", "b", "c", None]), i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, start long")
    got = packing.pack(docs, targets=targets, window=1024, sequence=256, bucket=bucket).toPandas()
    ids = expected_ids(texts)
    for doc, part in got.groupby("doc_id"):
        part = part.sort_values("start")
        assert list(part.start) == [0, *part.length.cumsum()[:-1]] and part.length.sum() == len(ids[doc]) and (part.length > 0).all()
        for r in part.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[doc][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[doc])
    assert got.doc_id.nunique() == len(texts)
    total = sum(map(len, ids))
    sizes = []
    for seq, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert list(part.offset) == [0, *part.length.cumsum()[:-1]]
        sizes.append((seq, part.length.sum()))
    assert [s for _, s in sizes[:-1]] == [256] * (len(sizes) - 1) and [q for q, _ in sizes] == list(range(-(-total // 256)))
    share = Counter()
    for r, t in zip(rows, ids, strict=True):
        share[r[2] or ""] += len(t)
    if targets is None:
        for first in range(0, total // 1024 - 1):
            part = got[(got.sequence_id >= 4 * first) & (got.sequence_id < 4 * first + 4)].groupby("source").length.sum()
            assert all(abs(part.get(s, 0) - 1024 * n / total) <= len(share) + 2 for s, n in share.items())


def test_every_sequence_holds_the_mixture(spark):
    rng = random.Random(3)
    kinds = ["a"] * 8 + ["b"] * 6 + ["c"] * 4 + ["d"] * 2
    rows = [(None if i % 3 else i, " ".join(rng.choice(["the", "Cat", "12", "naïve"]) for _ in range(rng.randint(0, 400))), rng.choice(kinds)) for i in range(700)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), bucket=5000).toPandas()
    total, whole = got.groupby("source").length.sum(), got.length.sum()
    parts = got.groupby(["sequence_id", "source"]).length.sum().unstack(fill_value=0)
    assert len(parts) > 50 and len(total) == 4
    for source, n in total.items():
        assert (abs(parts[source].iloc[:-2] - packing.SEQUENCE * n / whole) <= len(total) + 1).all()


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(5, "same text", "a")] * 3, "doc_id long, text string, source string")
    got = packing.pack(docs).toPandas()
    assert got.length.sum() == 3 * len(expected_ids(["same text"])[0])
    assert packing.pack(docs.limit(0)).count() == 0
