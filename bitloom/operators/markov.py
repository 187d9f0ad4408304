"""Markov models of symbol sequences and the code lengths that they give, in bits.

Counts of one sequence are made in its row, from its sorted k-mers, so sequences are never shuffled, and a code length that needs no other row
is a projection. Only counts leave their rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.operators.sequences import gram_runs, kmers, let, run_sizes, run_starts


def gram_counts(df: DataFrame, key: str, order: int, seq: str = "seq") -> DataFrame:
    """(key, ctx, sym, n): how often a symbol follows a context of ``order`` symbols in each sequence."""
    counts = df.select(key, F.explode(gram_runs(F.col(seq), order + 1)).alias("x")).select(key, "x.*")
    return counts.select(key, F.substring("gram", 1, order).alias("ctx"), F.substring("gram", order + 1, 1).alias("sym"), "n")


def kmer_counts(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, n) over all sequences; what is shuffled is a row's counts, not its k-mers."""
    return df.select(F.explode(gram_runs(F.col(seq), k)).alias("x")).groupBy(F.col("x.gram").alias("kmer")).agg(F.sum("x.n").alias("n"))


def kmer_counts_by_size(df: DataFrame, least: int, most: int, seq: str = "seq") -> DataFrame:
    """(k, kmer, n) over all sequences, of all sizes from ``least`` to ``most``, from one look at them: a shorter k-mer begins a longer one or ends its sequence."""
    last = [F.when(F.char_length(seq) >= k, F.struct(F.substring(seq, -k, k).alias("gram"), F.lit(1).cast("long").alias("n"))) for k in range(least, most)]
    grams = F.concat(gram_runs(F.col(seq), most), F.array_compact(F.array(*last))) if last else gram_runs(F.col(seq), most)
    counts = df.select(F.explode(grams).alias("x")).groupBy("x.gram").agg(F.sum("x.n").alias("n"))
    heads = F.transform(F.sequence(F.lit(least), F.char_length("gram")), lambda k: F.struct(k.alias("k"), F.substring(F.col("gram"), F.lit(1), k).alias("kmer")))
    return counts.select(F.explode(heads).alias("x"), "n").groupBy("x.k", "x.kmer").agg(F.sum("n").alias("n"))


def _log_sum(first: Column, last: Column) -> Column:
    """log2(first) + ... + log2(last)."""
    terms = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + F.log2(x))


def head_bits(length: Column, order: int, size: int) -> Column:
    """The first ``order`` symbols cost log2 of the alphabet's size each and teach nothing."""
    return F.least(length, F.lit(order)) * math.log2(size)


def _sum_over(values: Column, each) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + each(x))


def _row_bits(seq: Column, order: int, size: int, of_symbol, of_context) -> Column:
    """Bits of a sequence: the sum of ``of_context`` over the sizes of contexts, less that of ``of_symbol`` over those of symbols in them."""

    def cost(g: Column) -> Column:
        contexts = run_starts(g, lambda x: F.substring(x, 1, order)) if order else F.array(F.lit(0), F.size(g))
        return _sum_over(run_sizes(contexts), of_context) - _sum_over(run_sizes(run_starts(g)), of_symbol)

    return let(F.sort_array(kmers(seq, order + 1)), cost) + head_bits(F.char_length(seq), order, size)


def fitted_bits(df: DataFrame, key: str, order: int, size: int = 4, seq: str = "seq") -> DataFrame:
    """(key, length, bits) under a model fitted to the sequence itself, whose own cost isn't charged: a projection."""
    bits = _row_bits(F.col(seq), order, size, lambda n: n * F.log2(n + 1), lambda t: t * F.log2(t + size))
    return df.select(key, F.char_length(seq).cast("long").alias("length"), bits.alias("bits"))


def adaptive_column(seq: Column, order: int, size: int = 4) -> Column:
    """Bits of a sequence under a model that learns from left to right.

    The product of (1 + earlier) / (size + earlier in context) over a sequence depends on the final counts alone.
    """
    one, first = F.lit(1).cast("long"), F.lit(size).cast("long")
    return _row_bits(seq, order, size, lambda n: _log_sum(one, n), lambda t: _log_sum(first, t + size - 1))


def adaptive_bits(df: DataFrame, key: str, order: int, size: int = 4, seq: str = "seq") -> DataFrame:
    """(key, length, bits) under a model that learns from left to right: a projection."""
    return df.select(key, F.char_length(seq).cast("long").alias("length"), adaptive_column(F.col(seq), order, size).alias("bits"))


def running_bits(events: DataFrame, key: str, order_by: list[str], sym: str, size: int) -> DataFrame:
    """``events`` with ``bits`` of each symbol under an adaptive order-1 model of its sequence, and their running sum ``cum``."""
    along = Window.partitionBy(key).orderBy(*order_by)
    given = events.withColumn("ctx", F.lag(sym).over(along))
    seen_both = F.row_number().over(Window.partitionBy(key, "ctx", sym).orderBy(*order_by)) - 1
    seen = F.row_number().over(Window.partitionBy(key, "ctx").orderBy(*order_by)) - 1
    cost = F.when(F.col("ctx").isNull(), math.log2(size)).otherwise(-F.log2((1 + seen_both) / (seen + size)))
    return given.withColumn("bits", cost).withColumn("cum", F.sum("bits").over(along.rowsBetween(Window.unboundedPreceding, 0)))


def event_counts(events: DataFrame, key: str, order_by: list[str], sym: str) -> DataFrame:
    """(key, ctx, sym, n) of order 1 for sequences given as one row per symbol."""
    given = events.withColumn("ctx", F.lag(sym).over(Window.partitionBy(key).orderBy(*order_by)))
    return given.filter("ctx is not null").groupBy(key, "ctx", F.col(sym).alias("sym")).agg(F.count("*").alias("n"))


def event_bits(events: DataFrame, model: DataFrame, key: str, order_by: list[str], sym: str, size: int) -> DataFrame:
    """(key, length, bits) of sequences given as one row per symbol under a model (ctx, sym, p) of order 1; uniform where it has no row."""
    given = events.select(key, F.col(sym).alias("sym"), F.lag(sym).over(Window.partitionBy(key).orderBy(*order_by)).alias("ctx"))
    cost = F.when(F.col("ctx").isNull() | F.col("p").isNull(), math.log2(size)).when(F.col("p") == 0, float("inf")).otherwise(-F.log2("p"))
    return given.join(model.select("ctx", "sym", "p"), ["ctx", "sym"], "left").groupBy(key).agg(F.count("*").alias("length"), F.sum(cost).alias("bits"))


def predict(counts: DataFrame, alphabet: list[str], prior: float = 1) -> DataFrame:
    """(ctx, sym, n, p): next-symbol probabilities of every seen context and every symbol, unseen ones from the prior alone."""
    summed = counts.groupBy("ctx", "sym").agg(F.sum("n").alias("n"))
    seen = F.map_from_entries(F.collect_list(F.struct("sym", "n")))  # at most one entry for each symbol
    contexts = summed.groupBy("ctx").agg(seen.alias("seen"), F.sum("n").alias("total"))
    grid = contexts.select("ctx", "seen", "total", F.explode(F.array(*map(F.lit, alphabet))).alias("sym"))
    n = F.coalesce(F.try_element_at("seen", F.col("sym")), F.lit(0).cast("long"))
    return grid.select("ctx", "sym", n.alias("n"), ((n + prior) / (F.col("total") + prior * len(alphabet))).alias("p"))


def cross_entropy(df: DataFrame, model: DataFrame, key: str, order: int, size: int = 4, seq: str = "seq") -> DataFrame:
    """(key, length, bits) of sequences under a model (ctx, sym, p), uniform where it has no row. A probability of 0 gives Infinity."""
    counts = df.select(key, F.char_length(seq).cast("long").alias("length"), F.explode_outer(gram_runs(F.col(seq), order + 1)).alias("x"))
    counts = counts.select(key, "length", F.substring("x.gram", 1, order).alias("ctx"), F.substring("x.gram", order + 1, 1).alias("sym"), F.col("x.n").alias("n"))
    got = counts.join(model.select("ctx", "sym", "p"), ["ctx", "sym"], "left")
    p = F.coalesce("p", F.lit(1.0 / size))
    cost = F.coalesce(F.when(p == 0, float("inf")).otherwise(-F.log2(p)) * F.col("n"), F.lit(0.0))
    return got.groupBy(key, "length").agg(F.sum(cost).alias("bits")).select(key, "length", (F.col("bits") + head_bits(F.col("length"), order, size)).alias("bits"))


def entropy_by_order(df: DataFrame, key: str, orders: range, size: int = 4, seq: str = "seq") -> DataFrame:
    """(order, length, bits, bits_per_symbol, saving) over all sequences, one adaptive model per sequence: one scan for all orders."""
    each = df
    for k in orders:
        each = each.withColumn(f"__bits_{k}", adaptive_column(F.col(seq), k, size))
    total = each.agg(F.sum(F.char_length(seq).cast("long")).alias("length"), *[F.sum(f"__bits_{k}").alias(f"__bits_{k}") for k in orders])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("order"), F.col(f"__bits_{k}").alias("bits")) for k in orders]))
    out = total.select("length", rows.alias("x")).select("x.order", "length", "x.bits")
    return out.select("order", "length", "bits", (F.col("bits") / F.col("length")).alias("bits_per_symbol"), (F.col("length") * math.log2(size) - F.col("bits")).alias("saving"))


def blend_bits(df: DataFrame, key: str, models: list[dict[str, float]], decay: float = 1.5, seq: str = "seq") -> DataFrame:
    """(key, length, bits) under a blend of order-1 models, weighed by what each has cost of late.

    ``models``: two-symbol strings and their probabilities; the first symbol costs 2 bits. The evidence m of a
    model becomes (m + cost) / decay after each symbol and its weight is 2 ** -m, so the fold is one higher-order function.
    """
    costs = [F.create_map(*[F.lit(x) for g, p in m.items() for x in (g, -math.log2(p))]) for m in models]
    zero = F.struct(F.lit(2.0).alias("bits"), *[F.lit(1.0).alias(f"m{i}") for i in range(len(models))])

    def step(acc: Column, gram: Column) -> Column:
        each = [F.try_element_at(c, gram) for c in costs]
        weights = [F.pow(F.lit(2.0), -acc[f"m{i}"]) for i in range(len(models))]
        p = sum((w * F.pow(F.lit(2.0), -e) for w, e in zip(weights[1:], each[1:], strict=True)), weights[0] * F.pow(F.lit(2.0), -each[0])) / sum(weights[1:], weights[0])
        return F.struct((acc["bits"] - F.log2(p)).alias("bits"), *[((acc[f"m{i}"] + e) / decay).alias(f"m{i}") for i, e in enumerate(each)])

    folded = let(kmers(F.col(seq), 2), lambda g: F.aggregate(g, zero, step, lambda acc: acc["bits"]))
    n = F.char_length(seq)
    return df.select(key, n.cast("long").alias("length"), F.when(n == 0, 0.0).otherwise(folded).alias("bits"))


def normalise(df: DataFrame, keys: list[str], weight: str, name: str) -> DataFrame:
    """``df`` with ``name``: the weight over the sum of the weights of its keys."""
    return df.withColumn(name, F.col(weight) / F.sum(weight).over(Window.partitionBy(*keys)))


def merge_by_length(df: DataFrame, keys: list[str], length: str, counts: list[str]) -> DataFrame:
    """(keys, counts): the mean of each count over the rows of a key, a row of code length b weighing 2 ** -b; counts may be fractions."""
    w = F.pow(F.lit(2.0), F.min(length).over(Window.partitionBy(*keys)) - F.col(length))
    weighed = df.select(*keys, w.alias("__weight"), *[(w * F.col(c)).alias(c) for c in counts])
    return weighed.groupBy(*keys).agg(*[(F.sum(c) / F.sum("__weight")).alias(c) for c in counts])


def model_bits(df: DataFrame, key: str, model: str, size: int = 4, seq: str = "seq") -> DataFrame:
    """(key, length, bits) under the model that a string names: ``uniform``, ``adaptive(k)``, ``fitted(k)`` or, for the adaptive one, ``markov(k)``."""
    m = re.fullmatch(r"(uniform|adaptive|markov|fitted)(?:\((-?\d+)\))?", model)
    if not m or (m.group(1) == "uniform") != (m.group(2) is None):
        raise ValueError(f"unknown model: {model}")
    order = -1 if m.group(1) == "uniform" else int(m.group(2))
    if order < 0:
        n = F.char_length(seq).cast("long")
        return df.select(key, n.alias("length"), (n * math.log2(size)).alias("bits"))
    return (fitted_bits if m.group(1) == "fitted" else adaptive_bits)(df, key, order, size, seq)
