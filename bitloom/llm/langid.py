"""Language identification in two steps: the family first, then support vector machines inside it.

A text is the square root of its counts of hashed byte trigrams of lower-cased text, scaled to length one. One
linear machine for each pair of families picks the family, then one for each pair of languages of that
family votes (one-versus-one), ties going to the larger summed margin. All are trained with hinge loss on at
most ``SAMPLE`` training documents of each language, and ``TOTAL`` of all, which languages share evenly.

Texts that are null or have no letter are ``und`` with score 0. Whole texts are read, repeated rows are
predicted alike, null ids stay null and aren't held out, extra columns are ignored, an empty table gives an empty result; without training
rows every text is ``und``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Families of languages (fixed values); a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"),
    "turkic": ("tr", "az", "kk", "uz"),
}
#: Training documents of each language, and of all, at most (in expectation); hashed features; rounds and step of the training.
SAMPLE, TOTAL, SIZE, EPOCHS, DECAY = 1500, 9000, 4096, 8, 1e-4


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def is_held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id, as text, leaves ``fold`` when divided by ``folds``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def features(text: str) -> np.ndarray:
    """The scaled trigram vector of a whole text, counted in pieces so that long texts need little memory."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    total = np.zeros(SIZE, np.int64)
    for i in range(0, len(raw) - 2, 1 << 20):
        b = raw[i : i + (1 << 20) + 2].astype(np.uint32)
        code = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
        total += np.bincount(code >> np.uint32(20), minlength=SIZE)
    x = np.sqrt(total, dtype=np.float64)
    return (x / max(1e-12, np.sqrt((x * x).sum()))).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last one is the bias) of a linear machine; y is 1 or -1, both sides weigh the same."""
    x = np.hstack([x, np.full((len(x), 1), 0.1, np.float32)])
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w, mean, n, rng = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0, np.random.default_rng(5)
    parts = max(1, len(x) // 16)
    for e in range(max(EPOCHS, 400 // parts)):
        for at in np.array_split(rng.permutation(len(x)), parts):
            n += 1
            rate = 1.0 / (DECAY * (n + 1.0 / DECAY))
            miss = y[at] * (x[at] @ w) < 1
            w *= 1 - rate * DECAY
            w += rate * 2 * ((weight[at] * y[at] * miss) @ x[at]) / len(at)
            if e:
                mean += w
    return mean / max(1, np.sqrt((mean * mean).sum()) / 25)


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Machines from the documents that have a language and a letter and aren't held out."""
    train = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    sizes = train.groupBy("lang").count().collect()  # one row for each language
    if not sizes:
        return {"families": {}, "split": {}, "within": {}}
    sample = min(sample, TOTAL // len(sizes))
    place = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(1 << 30))
    picked = F.lit(False)
    for r in sizes:
        picked = picked | ((F.col("lang") == r["lang"]) & (place < int((1 << 30) * min(1.0, sample / r["count"]))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).astype(np.float16).tobytes() if has_letter(t) else None for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(x, pa.binary())], ["doc_id", "lang", "x"])

    got = train.filter(picked).mapInArrow(encode, "doc_id long, lang string, x binary").filter("x is not null").toPandas().sort_values(["doc_id", "lang", "x"], kind="stable")
    if got.empty:
        return {"families": {}, "split": {}, "within": {}}
    x = np.stack([np.frombuffer(b, np.float16) for b in got.x]).astype(np.float32)
    lang = got["lang"].to_numpy()
    fam = np.array([family(v) for v in lang])
    families = {f: sorted(set(lang[fam == f])) for f in sorted(set(fam))}

    def duels(names: list[str], of: np.ndarray) -> dict:
        out = {}
        for a, b in itertools.combinations(names, 2):
            at = (of == a) | (of == b)
            out[a, b] = _machine(x[at], np.where(of[at] == a, 1.0, -1.0)).astype(np.float32)
        return out

    within: dict = {}
    for langs in families.values():
        within |= duels(langs, lang)
    return {"families": families, "split": duels(list(families), fam), "within": within}


def _winner(names: list[str], machines: dict, x: np.ndarray) -> tuple[str, float]:
    """The name with most won duels, and how sure: the logistic of its smallest margin."""
    votes, margins, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 30.0)
    for a, b in itertools.combinations(names, 2):
        w = machines[a, b]
        m = float(x @ w[:-1] + 0.1 * w[-1])
        votes[a if m >= 0 else b] += 1
        for name, v in ((a, m), (b, -m)):
            margins[name] += v
            least[name] = min(least[name], v)
    best = max(names, key=lambda n: (votes[n], margins[n], n))
    return best, 1 / (1 + float(np.exp(-np.clip(2 * least[best], -30, 30))))


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families = model["families"]
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                if not families or not has_letter(text):
                    rows.append(("und", 0.0))
                    continue
                x = features(text)
                fam, sure = _winner(list(families), model["split"], x)
                lang, in_it = _winner(families[fam], model["within"], x)
                rows.append((lang, sure * in_it))
            cols = list(zip(*rows, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
