"""Benchmark decontamination: item-sized windows, exact weighted-shingle similarity, SimHash distances.

Texts are sequences of lower-cased runs of letters and digits. A window of a document has as many words as the
benchmark item that it is compared with. The similarity is the sum of smaller over the sum of larger shingle weights, a
shingle's weight being how often it occurs.

Candidates come from shingles, without loss: an item of n shingles that reaches a similarity of p percent shares at least p * n / 100 of
them, so every window like it holds one of any n - p * n / 100 + 1 of them, and the rarest in the benchmark are taken. A shingle that many items
share finds an item only where it has no rarer ones. Where one is found, all windows around it are compared with the item.
The 64-bit SimHash of the best window, over its words, each weighing as often as it occurs, gives the distance in bits that is reported.

SimHash doesn't choose the windows, since it can't without loss: no radius is a bound for a similarity, and where one keeps nearly all (15 bits),
blocks of bits thin out next to nothing, as nearly two in three pairs of unlike fingerprints agree in one of 16 blocks of four. All is
DataFrame expressions. The benchmark's shingles meet the documents as broadcast tables of bounded size; of documents only those found are shuffled, in tiles.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import broadcast_if_small, let, materialize, numbered

#: Words of a shingle; similarity in percent.
WORDS, PERCENT = 5, 80
#: Shingles of the benchmark that one broadcast table holds (some 64 MB): 100,000 items of 200 words have 4 million.
BLOCK_ROWS = 1 << 20
#: Words of a tile, in which documents are shuffled.
TILE = 512

_LANES = 32  # longs with two 32-bit counters each


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(w: Column, size: int) -> Column:
    """Hashes of all ``size``-word shingles in order."""
    heads = F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0)))
    return F.transform(heads, lambda x, i: F.xxhash64(F.lit(size), x, *[F.get(w, i + k) for k in range(1, size)]))


def _own_shingles(w: Column, size: Column) -> Column:
    """Shingles of a window of an item whose shingles have ``size`` words (fewer than WORDS only for shorter items)."""
    return reduce(lambda other, k: F.when(size == k, _shingles(w, k)).otherwise(other), range(1, WORDS), _shingles(w, WORDS))


def simhash(w: Column) -> Column:
    """64-bit SimHash of an array of words: a bit is set if more than half of the words' hashes have it. The 64 bit sums
    are kept as two 32-bit counters in each of 32 longs; lane k counts bits k and 32 + k."""
    zero = F.array_repeat(F.lit(0).cast("long"), _LANES)
    lane = lambda x, k: F.call_function("shiftrightunsigned", x, k).bitwiseAND(F.lit(0x100000001))
    sums = F.aggregate(F.transform(w, lambda x: F.xxhash64(x)), zero, lambda acc, x: F.transform(acc, lambda a, k: a + lane(x, k)))
    half = lambda c: 2 * c > F.size(w)
    low = lambda s: F.transform(s, lambda x: half(x.bitwiseAND(F.lit(0xFFFFFFFF))))
    high = lambda s: F.transform(s, lambda x: half(F.shiftrightunsigned(x, 32)))
    bits = let(sums, lambda s: F.concat(low(s), high(s)))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit.cast("long")))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of shingles: sum of smaller over sum of larger counts."""

    def runs(s: Column) -> Column:  # (value, how many like it came before) makes repeated values distinct
        return let(F.sort_array(s), lambda v: F.transform(v, lambda x, i: F.struct(x.alias("x"), (i - F.array_position(v, x)).alias("i"))))

    shared = F.size(F.array_intersect(runs(a), runs(b)))
    whole = F.size(a) + F.size(b) - shared
    return F.when(whole > 0, shared / whole).otherwise(0.0)


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, its words, size in words, words of its shingles, and shingles; items without words are left out."""
    w = materialize(benchmark.select("item_id", words(F.col("text")).alias("w")), "benchmark-words").filter(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(WORDS))
    sized = w.select("item_id", "w", F.size("w").alias("m"), k.alias("k"))
    return sized.select("*", _own_shingles(F.col("w"), F.col("k")).alias("sh"))


def _placed(docs: DataFrame, kinds: list[int]) -> DataFrame:
    """(doc_id, t, p, h): each shingle of k words, for all ``kinds``, with its place, in one pass over the texts."""
    placed = lambda w, k: F.transform(_shingles(w, k), lambda h, p: F.struct(p.alias("p"), h.alias("h")))
    every = let(words(F.col("text")), lambda w: F.concat(*[placed(w, k) for k in kinds]))
    return docs.select("doc_id", "t", F.explode(every).alias("s")).select("doc_id", "t", "s.*")


def _probes(known: DataFrame, percent: int) -> DataFrame:
    """(h, u, m): of each item so many shingles, the rarest of the benchmark, that every window like it holds one of them."""
    rows = known.select("u", "m", "n", F.explode("sh").alias("h"))
    held = rows.select("u", "h").distinct().groupBy("h").agg(F.count("*").alias("items"))
    place = F.row_number().over(Window.partitionBy("u").orderBy("items", "h"))
    ranked = rows.join(held, "h").withColumn("place", place)
    return ranked.filter(F.col("place") <= F.expr(f"({100 - percent} * n) div 100 + 1")).select("h", "u", "m").distinct()


def _regions(given: DataFrame, hits: DataFrame) -> DataFrame:
    """``hits`` with the words lo.. of their document, up to three items' lengths of them; documents go through the shuffle in tiles."""
    held = materialize(hits.select(F.col("doc_id").alias("id"), F.col("t").alias("u_t")).distinct(), "hit-documents")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("u_t"))
    texts = given.join(broadcast_if_small(held, 64), same, "left_semi")
    cut = let(words(F.col("text")), lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(w) - 1, F.lit(0)) / TILE).cast("int")), lambda i: F.struct(i.alias("i"), F.slice(w, i * TILE + 1, TILE).alias("w"))))
    tiles = texts.select(F.col("doc_id").alias("id"), F.col("t").alias("u_t"), F.explode(cut).alias("tile"))
    asked = hits.select("*", F.explode(F.sequence(F.expr(f"lo div {TILE}"), F.expr(f"(hi - 1) div {TILE}"))).alias("at"))
    met = asked.join(tiles, same & (F.col("at") == F.col("tile.i")))
    parts = met.groupBy(*hits.columns).agg(F.sort_array(F.collect_set("tile")).alias("tiles"))
    w = F.slice(F.flatten(F.transform("tiles", lambda x: x["w"])), F.expr(f"cast(lo % {TILE} + 1 as int)"), F.expr("cast(hi - lo as int)"))
    return parts.select(*hits.columns, w.alias("w"))


def _best(own: Column, percent: int) -> Column:
    """(similarity, -place) of the first best window of ``n`` shingles among ``own``; null if none has ``percent``. Windows
    that start with a shared shingle are enough: sliding another one along to the next shared shingle doesn't lower its similarity."""
    window = lambda x, i: F.slice(x, i + 1, F.col("n"))

    def enough(flags: Column, i: Column) -> Column:  # shared shingles, however often they occur, are no fewer than counts shared
        shared = F.aggregate(window(flags, i), F.lit(0), lambda a, x: a + x)
        return (100 + percent) * shared >= percent * (F.size(window(flags, i)) + F.col("n"))

    def best(x: Column) -> Column:
        flags = F.transform(x, lambda h: F.array_contains("sh", h).cast("int"))
        starts = let(flags, lambda f: F.array_compact(F.transform(f, lambda y, i: F.when((y == 1) & (i < F.col("last")) & enough(f, i), i))))
        scored = F.transform(starts, lambda i: F.struct(similarity(window(x, i), F.col("sh")).alias("similarity"), (-i).alias("back")))
        return F.array_max(F.filter(scored, lambda y: y["similarity"] >= percent / 100))

    return let(own, best)


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Contaminated documents: doc_id, item_id, start (first word of the best window), n_words, distance (bits) and similarity.

    One row for each document and item with a window of similarity ``percent`` or more, ties to the window that comes first. Null and empty texts
    match nothing, nor do items without words; items of fewer than five words are one shingle. Texts of any length are read whole. Repeated rows of
    documents or items give one row for each pair of ids; a null id counts as an id. Empty tables give an empty result; other columns are ignored.
    """
    prints = [F.xxhash64("w").alias("u"), F.size("sh").alias("n"), simhash(F.col("w")).alias("fp")]
    items = materialize(items_of(benchmark.select("item_id", "text")).select("*", *prints), "benchmark-items")
    kinds = sorted(r.k for r in items.select("k").distinct().collect())  # at most WORDS
    if not kinds:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start int, n_words int, distance int, similarity double")
    known = items.dropDuplicates(["u"]).drop("item_id", "w")  # equal items are compared once
    probes = materialize(_probes(known, percent), "benchmark-probes")
    # The table is dealt into blocks by shingle and item, so that a shingle of many items is split too.
    blocks = -(-max(1, probes.count()) // BLOCK_ROWS)
    given = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).filter("text is not null")
    hits = []
    for j in range(blocks):
        part = probes.filter(F.pmod(F.xxhash64("h", "u"), F.lit(blocks)) == j)
        hits.append(_placed(given, kinds).join(F.broadcast(part), "h").select("doc_id", "t", "u", "m", F.expr("cast(p as bigint) div m").alias("b")))
    # Windows that hold a place of the b-th stretch of m words start after (b - 1) * m and before (b + 1) * m.
    found = reduce(DataFrame.union, hits).distinct().select("doc_id", "t", "u", F.expr("greatest((b - 1) * m, 0L)").alias("lo"), F.expr("(b + 1) * m").alias("to"), F.expr("(b + 2) * m").alias("hi"))
    regions = _regions(given, materialize(found, "hits", "lz4"))
    mean = items.agg(F.avg("m")).first()[0] or 0.0
    pairs = regions.join(broadcast_if_small(known, 96 + 8 * int(mean)), "u").withColumn("last", F.expr("to - lo"))
    scored = pairs.select("doc_id", "u", "lo", "m", "w", "fp", _best(_own_shingles(F.col("w"), F.col("k")), percent).alias("x")).filter("x is not null")
    at = (-F.col("x.back")).cast("int")
    differs = simhash(F.slice("w", at + 1, F.col("m"))).bitwiseXOR(F.col("fp"))
    verified = scored.select("doc_id", "u", (F.col("lo") + at).cast("int").alias("start"), "m", F.bit_count(differs).alias("distance"), "x.similarity")
    ids = items.select("item_id", "u").distinct()
    best = F.max_by(F.struct("start", "m", "distance", "similarity"), F.struct("similarity", -F.col("start"), -F.col("distance")))
    out = verified.join(broadcast_if_small(ids, 32), "u").groupBy("doc_id", "item_id").agg(best.alias("best"))
    return out.select("doc_id", "item_id", F.col("best.start").alias("start"), F.col("best.m").alias("n_words"), F.col("best.distance").alias("distance"), F.col("best.similarity").alias("similarity"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns unchanged. Rows with a repeated id or none are judged one by one."""
    node = f"__node_{uuid.uuid4().hex[:12]}"
    rows = numbered(docs, node)
    found = materialize(matches(rows.select(F.col(node).alias("doc_id"), "text"), benchmark, percent).select(F.col("doc_id").alias(node)).distinct(), "contaminated")
    return rows.join(broadcast_if_small(found, 32), node, "left_anti").select(*docs.columns)
