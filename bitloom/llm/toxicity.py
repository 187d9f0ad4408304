"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their beginnings of three to five letters (so unseen inflections of a known stem
count), hashed to ``BUCKETS`` values. Counts of (bucket, label) over the training sample, summed on the
executors, choose the ``TERMS`` buckets that tell most about the label; the machine learns a weight and a
``RANK``-dimensional vector for each, so pairs such as insult and group mention add to the score beyond the sum
of their weights. Training takes at most ``SAMPLE`` labelled documents, chosen by hash, so the labels that are broadcast
to the scan of the texts are bounded and no text is shuffled.

Null and empty texts get the score of a text without any term. Repeated rows score alike, whole texts of any length are read, null ids stay null
and aren't held out, a score of exactly one half counts as toxic, extra columns are ignored, an empty table gives an empty result; without
training rows every score is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import hash_sample, materialize, slices

#: Hash buckets of terms, and those that the machine learns on, at most.
BUCKETS, TERMS = 1 << 20, 4096
#: Labelled training documents, at most (in expectation).
SAMPLE = 20_000
RANK, EPOCHS, RATE, DECAY = 4, 12, 0.05, 1e-4
#: Words are bared of these at both ends.
_EDGE = "\"'.,;:!?()[]{}<>*%$&#|-_=+/\\"
_MEMO = 50_000


def is_held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id, as text, leaves ``fold`` when divided by ``folds``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


class Terms:
    """Hashed terms of texts; the buckets of a word are kept for its next occurrence."""

    def __init__(self, chosen: dict[int, int] | None = None):
        self.memo: dict[str, tuple[int, ...]] = {}
        self.chosen = chosen

    def _of_word(self, word: str) -> tuple[int, ...]:
        core = word.strip(_EDGE)
        if not core:
            return ()
        terms = [f"w:{core}", *(f"p:{core[:n]}" for n in (3, 4, 5) if len(core) >= n)]
        ids = [zlib.crc32(t.encode()) % BUCKETS for t in terms]
        return tuple(ids) if self.chosen is None else tuple(self.chosen[i] for i in ids if i in self.chosen)

    def __call__(self, text: str | None) -> set[int]:
        found: set[int] = set()
        memo = self.memo
        for word in set((text or "").lower().split()):
            ids = memo.get(word)
            if ids is None:
                ids = self._of_word(word)
                if len(memo) >= _MEMO:
                    memo.clear()
                if len(word) < 40:
                    memo[word] = ids
            if ids:
                found.update(ids)
        return found


def _informative(labelled: DataFrame, terms: int) -> dict[int, int]:
    """The buckets that tell most about the label, numbered from 0: by log-likelihood ratio."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Terms()
        total: dict[int, int] = {}
        n, toxic = 0, 0
        for batch in slices(batches):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                n, toxic = n + 1, toxic + y
                add = 1 + (y << 32)
                for i in of(text):
                    total[i] = total.get(i, 0) + add
        both = np.fromiter(total.values(), np.int64, len(total))
        ids = np.fromiter(total.keys(), np.int64, len(total))
        ids, both = np.append(ids, -1), np.append(both, n + (toxic << 32))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(both & 0xFFFFFFFF), pa.array(both >> 32)], ["term", "n", "toxic"])

    counts = labelled.mapInArrow(count, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    counts = materialize(counts, "toxic-terms")
    whole = counts.filter("term = -1").first()
    if not whole or not whole.toxic or whole.toxic == whole.n:
        return {}
    rate = whole.toxic / whole.n
    a, b = F.col("toxic"), F.col("n") - F.col("toxic")

    def part(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    gain = part(a, F.col("n") * rate) + part(b, F.col("n") * (1 - rate))
    top = counts.filter("term >= 0 and n >= 3").withColumn("gain", gain).orderBy(F.desc("gain"), "term").limit(terms)
    return {r.term: i for i, r in enumerate(top.select("term").collect())}


def _descend(rows: list[np.ndarray], y: np.ndarray, size: int) -> dict:
    """Weights by AdaGrad on the logistic loss; rows hold the terms that are present."""
    rng = np.random.default_rng(7)
    w, v, b = np.zeros(size), rng.normal(0, 0.05, (size, RANK)), -2.0
    gw, gv, gb = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            vx = v[x]
            s = vx.sum(0)
            z = b + w[x].sum() + 0.5 * float((s @ s) - (vx * vx).sum())
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]
            gb += g * g
            b -= RATE * g / np.sqrt(gb)
            d = g + DECAY * w[x]
            gw[x] += d * d
            w[x] -= RATE * d / np.sqrt(gw[x])
            d = g * (s - vx) + DECAY * vx
            gv[x] += d * d
            v[x] -= RATE * d / np.sqrt(gv[x])
    return {"w": w.astype(np.float32), "v": v.astype(np.float32), "b": float(b)}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> dict:
    """A machine from the documents that have a label and aren't held out. A document whose labels differ counts as toxic."""
    labels = labels.select("doc_id", F.col("toxic").cast("long").alias("toxic")).filter(F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    labels = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = F.broadcast(hash_sample(labels, sample))  # bounded by ``sample``, whatever the size of the tables
    labelled = docs.select("doc_id", "text").join(few, "doc_id")
    chosen = _informative(labelled.select("text", "toxic"), terms)
    if not chosen:
        return {"chosen": {}, "w": np.zeros(1, np.float32), "v": np.zeros((1, RANK), np.float32), "b": -30.0}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Terms(chosen)
        for batch in batches:
            packed = [np.array(sorted(of(t)), np.int32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary()), batch.column("toxic")], ["doc_id", "x", "toxic"])

    got = labelled.mapInArrow(encode, "doc_id long, x binary, toxic long").toPandas().sort_values(["doc_id", "x"], kind="stable")
    rows = [np.frombuffer(x, np.int32) for x in got.x]
    return {"chosen": chosen} | _descend(rows, got.toxic.to_numpy(), len(chosen))


def _scorer(model: dict):
    of, w, v, b = Terms(model["chosen"]), model["w"], model["v"], model["b"]

    def score(text: str | None) -> float:
        x = np.fromiter(of(text), np.int64) if model["chosen"] else np.zeros(0, np.int64)
        x.sort()
        z = b
        if len(x):
            vx = v[x].astype(np.float64)
            s = vx.sum(0)
            z += float(w[x].sum(dtype=np.float64)) + 0.5 * float(s @ s - (vx * vx).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return score


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _scorer(model)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f(t) for t in batch.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, all columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _scorer(model)
        for batch in slices(batches):
            yield batch.filter(pa.array([f(t) < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
