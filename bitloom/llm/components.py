"""Connected components of a link table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    """Count and checksums of the distinct edges: equal for equal tables."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every end of the links (columns a, b); root is the smallest id that can be reached.

    Each round links every neighbour of a node to the smallest of them and of the node itself, first for the
    larger neighbours, then for the smaller ones, so paths shrink by half or more and no node's neighbours
    are gathered in one place. It ends when a round changes nothing: then every node points at its root.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: the larger neighbours of a node go to its smallest
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        turned = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(turned, "links")
        now = _state(new)
        discard(edges)
        edges = new
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("a")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots.select(F.col("a").alias("id"), F.col("a").alias("root")))
