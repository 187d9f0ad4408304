"""Exact, inverted and cross repeats by equal k-mers, and the intervals around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.operators.sequences import gram_runs, kmers, let, reverse_complement, run_sizes, run_starts
from bitloom.session import small


def positions(df: DataFrame, key: str, k: int, seq: str = "seq") -> DataFrame:
    """(key, pos, kmer), pos from 0."""
    return df.select(key, F.posexplode(kmers(F.col(seq), k)).alias("pos", "kmer"))


def _pairs_in(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + F.shiftright(n * (n - 1), 1))


def repeat_counts(df: DataFrame, key: str, k: int, inverted: bool = False, seq: str = "seq") -> DataFrame:
    """(key, n): pairs of places, the second before the first, with equal (or reverse-complementary) k-mers; sequences without a k-mer are left out.

    Counted in the row, from runs of its sorted k-mers, so long runs of one symbol make no pairs and nothing is shuffled.
    """
    if not inverted:
        n = let(F.sort_array(kmers(F.col(seq), k)), lambda g: _pairs_in(run_sizes(run_starts(g))))
        return df.filter(F.char_length(seq) >= k).select(key, n.alias("n"))

    def both(x: Column) -> Column:
        """A k-mer and its reverse complement under the smaller of both, with a mark of which it is: its own, the smaller, the larger."""
        return let(reverse_complement(x), lambda r: F.concat(F.least(x, r), F.when(x == r, "=").when(x < r, "<").otherwise(">")))

    def count(g: Column) -> Column:
        squares = lambda sizes: F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n * n)
        # of a k-mer that occurs a times, and b times as its complement, (a + b) ** 2 - a ** 2 - b ** 2 is twice the number of pairs
        met = squares(run_sizes(run_starts(g, lambda x: F.substring(x, 1, k)))) - squares(run_sizes(run_starts(g)))
        return F.shiftright(met, 1) + _pairs_in(run_sizes(run_starts(F.filter(g, lambda x: F.substring(x, k + 1, 1) == "="))))

    marked = F.sort_array(F.transform(kmers(F.col(seq), k), both))
    return df.filter(F.char_length(seq) >= k).select(key, let(marked, count).alias("n"))


def repeat_pairs(df: DataFrame, key: str, k: int, inverted: bool = False, seq: str = "seq") -> DataFrame:
    """(key, pos, earlier): every such pair; its size is what :func:`repeat_counts` says."""
    at = positions(df, key, k, seq)
    other = at.select(key, F.col("pos").alias("earlier"), (reverse_complement(F.col("kmer")) if inverted else F.col("kmer")).alias("kmer"))
    return at.join(other, [key, "kmer"]).filter("earlier < pos").select(key, "pos", "earlier")


def nearest_repeats(df: DataFrame, key: str, k: int, seq: str = "seq") -> DataFrame:
    """(key, pos, earlier): for each place its last earlier occurrence, at most one row per place. Found in the row, among its sorted k-mers."""
    placed = F.sort_array(F.transform(kmers(F.col(seq), k), lambda x, i: F.struct(x.alias("g"), i.alias("i"))))

    def last(g: Column) -> Column:
        again = F.filter(F.sequence(F.lit(1), F.size(g) - 1), lambda j: F.get(g, j)["g"] == F.get(g, j - 1)["g"])
        return F.when(F.size(g) > 1, F.transform(again, lambda j: F.struct(F.get(g, j)["i"].alias("pos"), F.get(g, j - 1)["i"].alias("earlier"))))

    return df.select(key, F.explode(let(placed, last)).alias("x")).select(key, "x.pos", "x.earlier")


def shared_kmers(a: DataFrame, b: DataFrame, key_a: str, key_b: str, k: int, seq: str = "seq") -> DataFrame:
    """(key_a, key_b, n_kmers, n_pairs): sequences of both sides that share k-mers, the blocking step before costly scoring."""

    def counts(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(key, F.explode(gram_runs(F.col(seq), k)).alias("x")).select(key, F.col("x.gram").alias("kmer"), F.col("x.n").alias(name))

    met = counts(a, key_a, "na").join(counts(b, key_b, "nb"), "kmer")
    return met.groupBy(key_a, key_b).agg(F.count("*").alias("n_kmers"), F.sum(F.col("na") * F.col("nb")).alias("n_pairs"))


def met_pairs(a: DataFrame, b: DataFrame, key_a: str, key_b: str, k: int, seq: str = "seq", few: int = 256) -> DataFrame:
    """(key_a, key_b): each sequence of ``a`` with those of ``b`` that share one k-mer with it or, if it is shorter than k, hold all of it.

    The k-mers of ``a``, if they are few, go to the places of ``b``, so that those of ``b`` are never shuffled. Up to ``few`` shorter sequences are sought in each
    sequence of ``b`` in one pass; more of them meet its pieces of their lengths.
    """
    size = F.char_length(seq)
    grams = lambda df, key, n: df.filter(F.char_length(seq) >= n).select(key, F.explode(kmers(F.col(seq), n)).alias("gram"))
    own = small(grams(a, key_a, k).distinct(), 64)
    met = grams(b, key_b, k).join(own, "gram").select(key_a, key_b).distinct()
    short = a.filter((size > 0) & (size < k)).select(key_a, F.col(seq).alias("gram"))
    lengths = short.groupBy(F.char_length("gram").alias("n")).count().collect()  # fewer than k lengths
    if sum(r["count"] for r in lengths) <= few:
        held = F.broadcast(short)
        return met.union(b.select(key_b, seq).join(held, F.contains(F.col(seq), F.col("gram"))).select(key_a, key_b).distinct()) if lengths else met
    for r in lengths:
        held = small(short.filter(F.char_length("gram") == r.n), 64)
        met = met.union(grams(b, key_b, r.n).join(held, "gram").select(key_a, key_b).distinct())
    return met


def bands(hits: DataFrame, width: int) -> DataFrame:
    """``hits`` (pos, earlier) with the half-open range [start, end) of cells that a hit activates."""
    return hits.withColumn("start", F.greatest(F.lit(0), F.col("earlier") - width)).withColumn("end", F.least(F.col("pos"), F.col("earlier") + 1 + width))


def merge_intervals(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, start, end, n): touching and overlapping ranges joined, with the number of ranges in each; the key may have any name but these three."""
    df = df.select(key, F.col(start).alias("__start"), F.col(end).alias("__end"))
    start, end = "__start", "__end"
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    island = df.withColumn("__new", new).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("__island")


def cell_stats(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, lists, hits, cells, wasted): merged ranges, the ranges they came from, the cells that they cover, and how often cells were covered again."""
    touched = df.groupBy(key).agg(F.sum(F.col(end) - F.col(start)).cast("long").alias("touched"))
    merged = merge_intervals(df, key, start, end).groupBy(key).agg(F.count("*").alias("lists"), F.sum("n").alias("hits"), F.sum(F.col("end") - F.col("start")).cast("long").alias("cells"))
    return merged.join(touched, key).select(key, "lists", "hits", "cells", (F.col("touched") - F.col("cells")).alias("wasted"))
