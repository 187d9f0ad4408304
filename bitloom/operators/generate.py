"""Models as tables or dictionaries, entropy rates, generators and mutation, all seeded by row so that reruns give the same rows.

Per-row Python is a small helper here; rows are the given sequences or ids, so the work is dealt by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.session import small, written


def stationary(p: np.ndarray) -> np.ndarray:
    """Long-run share of each state of a transition matrix."""
    n = len(p)
    a = np.vstack([p.T - np.eye(n), np.ones(n)])
    return np.linalg.lstsq(a, np.append(np.zeros(n), 1.0), rcond=None)[0]


def entropy_rate(p: np.ndarray, order: int = 1) -> float:
    """Bits per symbol of a model of the given order: rows are contexts (last symbol fastest), columns symbols; order -1 or 0 needs one row."""
    size = p.shape[1]
    if order < 0:
        return math.log2(size)
    rows = -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1.0)), 0.0).sum(1)
    if order == 0:
        return float(rows[0])
    states = size**order
    move = np.zeros((states, states))
    for s in range(states):
        for c in range(size):
            move[s, (s * size + c) % states] += p[s, c]
    return float(stationary(move) @ rows)


def mean_row_entropy(p: np.ndarray) -> float:
    """The unweighted mean over contexts; not the entropy rate, kept for comparison."""
    return float(-np.where(p > 0, p * np.log2(np.where(p > 0, p, 1.0)), 0.0).sum(1).mean())


def entropy_rate_of(model: DataFrame, alphabet: list[str]) -> DataFrame:
    """One row with the entropy rate of an order-1 model table (ctx, sym, p): a table of size A * A, whatever it was counted from."""
    code = {c: i for i, c in enumerate(alphabet)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.full((len(code), len(code)), 1.0 / len(code))
        for c, s, v in zip(pdf.ctx, pdf.sym, pdf.p, strict=True):
            p[code[c], code[s]] = v
        return pd.DataFrame({"bits_per_symbol": [entropy_rate(p)], "mean_row_bits": [mean_row_entropy(p)]})

    return model.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "bits_per_symbol double, mean_row_bits double")


def entropy_rates(models: DataFrame, alphabet: list[str], keys: list[str], tolerance: float = 1e-10, steps: int = 16, most: int = 2000) -> DataFrame:
    """(keys, contexts, bits_per_symbol, mean_row_bits) of each model in ``models`` (keys, ctx, sym, p), whose contexts may be of any length.

    The long-run share of each context is found by walking: shares move along the edges from a context to that which follows it, ``steps`` moves to a written
    table, until no share moves by more than ``tolerance`` (an error after ``most`` moves). A tenth stays where it is, so models with a period settle
    too. Contexts that are reached without a row of their own have uniform chances. The walk begins with equal shares of the contexts that have rows, which tells
    only for models that fall into several parts. Rows are dealt by context: nothing holds a whole model.
    """
    uniform = F.array(*[F.lit(1.0 / len(alphabet))] * len(alphabet))
    chance = [F.coalesce(F.max(F.when(F.col("sym") == a, F.col("p"))), F.lit(0.0)) for a in alphabet]
    rows = written(models.groupBy(*keys, "ctx").agg(F.array(*chance).alias("chances")))
    rows = small(rows, 16 * len(alphabet) + 64)
    share = written(rows.join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys).select(*keys, "ctx", (1 / F.col("n")).alias("share")))
    given = F.coalesce("chances", uniform)
    for done in range(0, most, steps):
        last = share
        for _ in range(steps):
            goes = [F.struct(F.expr(f"substring(concat(ctx, '{a}'), 2)").alias("to"), (0.9 * F.col("share") * given[i]).alias("part")) for i, a in enumerate(alphabet)]
            stays = F.struct(F.col("ctx").alias("to"), (0.1 * F.col("share")).alias("part"))
            moved = share.join(rows, [*keys, "ctx"], "left").select(*keys, F.explode(F.array(stays, *goes)).alias("m")).filter("m.part > 0")
            share = moved.groupBy(*keys, F.col("m.to").alias("ctx")).agg(F.sum("m.part").alias("share"))
        share = written(share)
        off = share.join(last.withColumnRenamed("share", "old"), [*keys, "ctx"], "left").agg(F.max(F.abs(F.col("share") - F.coalesce("old", F.lit(0.0)))).alias("off"))
        if (off.first().off or 0.0) <= tolerance:
            break
        if done + steps >= most:
            raise ValueError(f"shares of contexts still move after {most} moves")
    cost = F.aggregate(given, F.lit(0.0), lambda x, p: x - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    each = share.join(rows, [*keys, "ctx"], "left").withColumn("bits", cost)
    return each.groupBy(*keys).agg(F.count("*").alias("contexts"), F.sum(F.col("share") * F.col("bits")).alias("bits_per_symbol"), F.avg("bits").alias("mean_row_bits"))


def random_model(order: int, size: int = 4, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng([seed, order + 1])
    return np.full((1, size), 1.0 / size) if order < 0 else rng.dirichlet(np.ones(size), size**order)


def uniform_stats(p: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """A model with the same ratios whose symbols are uniform in the long run: rows and columns scaled in turn."""
    p = p.copy()
    for _ in range(10_000):
        p /= p.sum(0, keepdims=True) / (p.shape[0] / p.shape[1])
        p /= p.sum(1, keepdims=True)
        if abs(p.sum(0) - p.shape[0] / p.shape[1]).max() < tolerance:
            break
    return p


def model_power(p: np.ndarray, power: float) -> np.ndarray:
    q = p**power
    return q / q.sum(1, keepdims=True)


def negate_model(p: np.ndarray) -> np.ndarray:
    """Likely symbols become unlikely: chances in proportion to 1 - p."""
    q = 1 - p
    return q / q.sum(1, keepdims=True)


def generate(p: np.ndarray, order: int, length: int, rng: np.random.Generator, alphabet: str = "acgt") -> str:
    size, out, state = p.shape[1], [], 0
    for i in range(length):
        row = p[state] if order > 0 and i >= order else p[0] if order == 0 else np.full(size, 1.0 / size)
        s = int(rng.choice(size, p=row))
        out.append(alphabet[s])
        state = (state * size + s) % size ** max(order, 0) if order > 0 else 0
    return "".join(out)


def generate_blend(models: list[np.ndarray], length: int, rng: np.random.Generator, stay: int = 50, alphabet: str = "acgt") -> str:
    """Stretches of about ``stay`` symbols from the models in turn."""
    out, k = "", 0
    while len(out) < length:
        out += generate(models[k % len(models)], 1, int(rng.integers(stay // 2, 3 * stay // 2 + 1)), rng, alphabet)
        k += 1
    return out[:length]


def mutate(seq: str, times: int, p: np.ndarray, order: int, rng: np.random.Generator, change: float = 0.6, alphabet: str = "acgt") -> tuple[str, dict[str, int]]:
    """``times`` accepted changes, insertions and deletions that keep a sequence typical of its model (Metropolis rule on its likelihood)."""
    code, size = {c: i for i, c in enumerate(alphabet)}, len(alphabet)
    s, done, counts = [code[c] for c in seq], 0, {"change": 0, "insert": 0, "delete": 0}

    def bits(x: list[int], lo: int, hi: int) -> float:
        if order < 0:
            return 2.0 * (min(hi, len(x)) - lo)
        total = 0.0
        for i in range(max(lo, 0), min(hi, len(x))):
            if i < order:
                total += math.log2(size)
                continue
            state = 0
            for c in x[i - order : i]:
                state = state * size + c
            total -= math.log2(max(p[state, x[i]], 1e-300))
        return total

    tries = 0
    while done < times and tries < 100 * times + 1000:
        tries += 1
        u, n = rng.random(), len(s)
        if u < change and n:
            kind, at = "change", int(rng.integers(n))
            t = [*s[:at], int(rng.integers(size)), *s[at + 1 :]]
            ratio = 1.0
        elif u < change + (1 - change) / 2 or not n:
            kind, at = "insert", int(rng.integers(n + 1))
            t = [*s[:at], int(rng.integers(size)), *s[at:]]
            ratio = float(size)
        else:
            kind, at = "delete", int(rng.integers(n))
            t = s[:at] + s[at + 1 :]
            ratio = 1.0 / size
        grown = len(t) - n
        old, new = bits(s, at, at + 1 + order + (grown < 0)), bits(t, at, at + 1 + order + (grown > 0))
        if t != s and rng.random() < min(1.0, ratio * 2.0 ** (old - new)):
            s, done = t, done + 1
            counts[kind] += 1
    return "".join(alphabet[c] for c in s), counts


def population(parents: DataFrame, key: str, children: list[int], seed: int = 0, order: int = 0) -> DataFrame:
    """(parent, child, mutates, seq, changes, inserts, deletes): for each parent sequence one child for each number of mutations in ``children``."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for parent, seq in zip(pdf[key], pdf.seq, strict=True):
                x = np.array(["acgt".index(c) for c in seq], np.int64)
                p = np.ones((4**order, 4))
                state = np.zeros(max(0, len(x) - order), np.int64)
                for j in range(order):
                    state = state * 4 + x[j : len(x) - order + j]
                np.add.at(p, (state, x[order:]), 1)
                p /= p.sum(1, keepdims=True)
                for child, times in enumerate(children):
                    out, n = mutate(seq, times, p, order, np.random.default_rng([seed, abs(int(parent)), child]))
                    rows.append((parent, child, times, out, n["change"], n["insert"], n["delete"]))
            yield pd.DataFrame(rows, columns=["parent", "child", "mutates", "seq", "changes", "inserts", "deletes"])

    return parents.select(key, "seq").mapInPandas(run, "parent long, child int, mutates int, seq string, changes int, inserts int, deletes int")


def fading_bits(df: DataFrame, key: str, order: int, fade: int, seq: str = "seq", alphabet: str = "acgt") -> DataFrame:
    """(key, length, bits) of an adaptive model that halves a context's counts (to 1 at least) when their sum reaches ``fade``."""
    kind = df.schema[key].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for k, s in zip(pdf[key], pdf[seq], strict=True):
                counts: dict[str, dict[str, int]] = {}
                bits = min(order, len(s)) * math.log2(len(alphabet))
                for i in range(order, len(s)):
                    c = counts.setdefault(s[i - order : i], dict.fromkeys(alphabet, 1))
                    bits -= math.log2(c[s[i]] / sum(c.values()))
                    c[s[i]] += 1
                    if fade and sum(c.values()) >= fade:
                        for a in c:
                            c[a] = max(1, c[a] // 2)
                rows.append((k, len(s), bits))
            yield pd.DataFrame(rows, columns=[key, "length", "bits"])

    return df.select(key, seq).mapInPandas(run, f"{key} {kind}, length long, bits double")


def fading_event_bits(df: DataFrame, key: str, by: list[str], sym: str, order: int, fade: int, alphabet: str) -> DataFrame:
    """:func:`fading_bits` of one symbol a row, in the order of ``by``: a key's rows are read as a stream, so memory doesn't grow with their number.

    A null or empty symbol adds nothing.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [key, "length", "bits"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, past, counts, length, bits, kept = none, "", {}, 0, 0.0, None
        for batch in it:
            keys = batch.column(0)
            kept, rows = keys.type, []
            for k, s in zip(keys.to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now is none or k != now:
                    if now is not none:
                        rows.append((now, length, bits))
                    now, past, counts, length, bits = k, "", {}, 0, 0.0
                if not s:
                    continue
                if length < order:
                    bits += math.log2(len(alphabet))
                else:
                    c = counts.setdefault(past, dict.fromkeys(alphabet, 1))
                    bits -= math.log2(c[s] / sum(c.values()))
                    c[s] += 1
                    if fade and sum(c.values()) >= fade:
                        for a in c:
                            c[a] = max(1, c[a] // 2)
                past = (past + s)[-order:] if order else ""
                length += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (kept, pa.int64(), pa.float64()), strict=True)], names)
        if now is not none:
            yield pa.RecordBatch.from_arrays([pa.array([now], kept), pa.array([length], pa.int64()), pa.array([bits], pa.float64())], names)

    dealt = df.repartition(key).sortWithinPartitions(key, *by, sym)
    return dealt.select(key, sym).mapInArrow(run, f"{key} {kind}, length long, bits double")
