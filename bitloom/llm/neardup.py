"""Near-duplicate groups by bottom-k sketches from one hash function.

A document's shingles have 64-bit hashes; its sketch is the k smallest of them.

1. Documents with equal sets form a class, with the smallest id as its representative.
2. Inverted lists: each representative is in the list of every two neighbours among its smallest retained values. Of two sets of similarity
   0.8 or more, the smallest values of the union are shared ones with chance 0.8 each, and two shared values that are neighbours there are
   neighbours in both sketches. Sets that are no larger than the sketch always share such a pair if they are similar; of larger ones one pair in
   two thousand million at the very threshold doesn't (see ``lists_for``). Two values select far better than one, so the lists of frequent shingles don't meet.
3. Inside a list, in blocks of bounded size, the overlap of all sketches at once estimates the similarity, out of the union of both sketches.
   A block gives a spanning forest of the pairs that may be similar, not the pairs: no more rows than it has members.
   Long lists are cut into chunks, and each two chunks make a block.
4. The components of these forests are neighbourhoods: similar documents are in the same one. Inside a neighbourhood full sets give the
   exact Jaccard similarities, again in blocks and as a spanning forest: first within each chunk of a neighbourhood and with a few
   members that all chunks see, then between chunks, but for those that the first step has already put into one group.
5. Components of all links, with the classes, are the groups.

So candidates never become rows, large groups of copies cost linear work, and no link that would join two groups is lost, but for the
estimate's margin of five standard deviations.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import broadcast_if_small, discard, materialize, numbered, whole_groups
from bitloom.llm.components import components
from bitloom.llm.shingles import with_sets

#: Values of a sketch that the estimate uses, and its margin in standard deviations.
SKETCH, MARGIN = 128, 5.0
#: Members of a chunk of a list; documents and shingles of a chunk of a neighbourhood; members that all of its chunks see.
LIST_CHUNK, CHUNK, CHUNK_SHINGLES, HUBS = 1024, 512, 1 << 20, 8
#: Cells of the matrices by which overlaps are counted.
CELLS = 1 << 21


def lists_for(percent: int) -> int:
    """Lists of a document: so many that two sets of ``percent`` similarity share one but for a chance of 10 ** -9.

    If each value of the union is shared with chance t, the chance that no two neighbours of n + 1 are shared falls by the
    larger root of x * x = (1 - t) * x + t * (1 - t) a value.
    """
    t = percent / 100
    root = ((1 - t) + math.sqrt((1 - t) ** 2 + 4 * t * (1 - t))) / 2
    return 1 if t == 1 else math.ceil(-9 * math.log(10) / math.log(root)) + 1


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), two fingerprints of the set, and its smallest values ``low`` in order.

    They are floats, which keep order and 24 bits of each; values that become equal are one value then, in every set alike.
    """
    unsigned = lambda v: (v.cast("double") + 2.0**63).cast("float")
    return with_sets(docs, words).select("doc_id", F.size("s").cast("long").alias("n"), F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(3), "s").alias("k2"), F.array_distinct(F.transform(F.slice("s", 1, SKETCH), unsigned)).alias("low"))


def overlaps(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many values each two of the rows share; row i is flat[ends[i]:ends[i + 1]], without repeats."""
    rows = len(ends) - 1
    row = np.repeat(np.arange(rows), np.diff(ends))
    order = np.argsort(flat, kind="stable")
    value, row = flat[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    at = np.cumsum(new) - 1
    often = np.bincount(at, minlength=1)[at] > 1 if len(at) else np.zeros(0, bool)
    at, row = at[often], row[often]
    out = np.zeros((rows, rows), np.float32)
    if not len(at):
        return out.astype(np.int64)
    at = np.cumsum(np.diff(at, prepend=at[0]) != 0)
    width = max(64, CELLS // rows)
    for a in range(0, int(at[-1]) + 1, width):
        x, y = np.searchsorted(at, [a, a + width])
        cells = np.zeros((rows, min(width, int(at[-1]) + 1 - a)), np.float32)
        cells[row[x:y], at[x:y] - a] = 1
        out += cells @ cells.T
    return np.rint(out).astype(np.int64)


def _may_be_similar(n: np.ndarray, flat: np.ndarray, ends: np.ndarray, percent: int) -> np.ndarray:
    """Which sketches leave a similarity of ``percent`` possible.

    Up to the smaller of both largest values, two sketches hold all values of either set: a sample of the union, drawn without
    replacement, so the margin vanishes where it is all of it.
    """
    t = percent / 100
    size = np.diff(ends)
    last = np.where(n > size, flat[ends[1:] - 1], np.inf)
    upto = np.stack([np.searchsorted(flat[ends[i] : ends[i + 1]], last, "right") for i in range(len(n))])
    shared = overlaps(flat, ends)
    union = upto + upto.T - shared
    rest = np.maximum(0, 1 - union * (1 + t) / (n[:, None] + n[None, :]))
    return shared >= union * t - MARGIN * np.sqrt(union * t * (1 - t) * rest) - 1


def _are_similar(n: np.ndarray, flat: np.ndarray, ends: np.ndarray, percent: int) -> np.ndarray:
    shared = overlaps(flat, ends)
    return 100 * shared >= percent * (n[:, None] + n[None, :] - shared)


def forest(link: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    left = np.ones(len(link), bool)
    a: list[int] = []
    b: list[int] = []
    for root in range(len(link)):
        if not left[root]:
            continue
        left[root] = False
        reached = [root]
        while reached:
            x = reached.pop()
            new = np.flatnonzero(link[x] & left)
            left[new] = False
            a.extend([x] * len(new))
            b.extend(new.tolist())
            reached.extend(new.tolist())
    return a, b


def _pairs_of(ids: np.ndarray, n: np.ndarray, low: np.ndarray, percent: int) -> np.ndarray:
    """Which of many pairs of full sketches (rows 2i and 2i + 1 of ``low``) may be similar: ``_may_be_similar`` for lists of two."""
    t = percent / 100
    a, b, na, nb = low[0::2], low[1::2], n[0::2], n[1::2]
    both = np.sort(np.concatenate([a, b], 1), 1)
    equal = (both[:, 1:] == both[:, :-1]) & np.isfinite(both[:, 1:])
    last = [x[np.arange(len(x)), np.maximum(np.isfinite(x).sum(1) - 1, 0)] for x in (a, b)]
    top = np.minimum(*[np.where(m > np.isfinite(x).sum(1), y, np.inf) for m, x, y in ((na, a, last[0]), (nb, b, last[1]))])
    shared = equal.sum(1)
    union = ((both <= top[:, None]) & np.isfinite(both)).sum(1) - shared
    rest = np.maximum(0, 1 - union * (1 + t) / (na + nb))
    return shared >= union * t - MARGIN * np.sqrt(union * t * (1 - t) * rest) - 1


def _blocks(percent: int, exact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (g, doc_id, n, comp, values) sorted by g: spanning forests (a, b) of what is, or may be, similar in each group, between different comps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, "g"):
            starts, stops = bounds[:-1], bounds[1:]
            ids, n, comp = (table.column(c).to_numpy() for c in ("doc_id", "n", "comp"))
            values = table.column("values").combine_chunks()
            values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
            ends = values.offsets.to_numpy().astype(np.int64)
            flat = values.values.to_numpy(zero_copy_only=False)
            one: list[np.ndarray] = []
            other: list[np.ndarray] = []
            if not exact:  # lists of two, all at once
                two = starts[stops - starts == 2]
                fit = 100 * np.minimum(n[two], n[two + 1]) >= percent * np.maximum(n[two], n[two + 1])
                two = two[fit & (comp[two] != comp[two + 1])]
                for x in range(0, len(two), 4096):
                    at = np.stack([two[x : x + 4096], two[x : x + 4096] + 1], 1).ravel()
                    low = np.full((len(at), SKETCH), np.inf, np.float32)
                    size = ends[at + 1] - ends[at]
                    cells = np.arange(SKETCH)[None, :] < size[:, None]
                    low[cells] = flat[(ends[at][:, None] + np.arange(SKETCH)[None, :])[cells]]
                    yes = _pairs_of(ids[at], n[at], low, percent)
                    one.append(ids[at[0::2]][yes])
                    other.append(ids[at[1::2]][yes])
            for x, y in zip(starts, stops, strict=True):
                if y - x < 2 or (y - x == 2 and not exact):
                    continue
                # by size, so that what can't be similar to its neighbour in size ends a run
                order = x + np.argsort(n[x:y], kind="stable")
                size = n[order]
                for part in np.split(order, np.flatnonzero(100 * size[:-1] < percent * size[1:]) + 1):
                    if len(part) < 2 or (comp[part] == comp[part[0]]).all():
                        continue
                    own = np.concatenate([flat[ends[i] : ends[i + 1]] for i in part])
                    at = np.concatenate([[0], np.cumsum(ends[part + 1] - ends[part])])
                    m = n[part]
                    link = (_are_similar if exact else _may_be_similar)(m, own, at, percent)
                    link &= (100 * np.minimum(m[:, None], m[None, :]) >= percent * np.maximum(m[:, None], m[None, :])) & (comp[part][:, None] != comp[part][None, :])
                    a, b = forest(link)
                    one.append(ids[part[a]] if a else ids[:0])
                    other.append(ids[part[b]] if b else ids[:0])
            if one:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(np.concatenate(other))], ["a", "b"])

    return run


def _in_blocks(rows: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Links (a, b) out of rows (g, doc_id, n, comp, values); a group is one row set of bounded size."""
    return rows.select("g", "doc_id", "n", "comp", "values").repartition("g").sortWithinPartitions("g").mapInArrow(_blocks(percent, exact), "a long, b long")


def _chunk_pairs(chunk: Column, chunks: Column) -> Column:
    """The pairs of chunks that a chunk is in: itself if there is no other."""
    others = F.filter(F.sequence(F.lit(0), chunks - 1), lambda j: j != chunk)
    return F.when(chunks == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.transform(others, lambda j: F.struct(F.least(chunk, j).alias("i"), F.greatest(chunk, j).alias("j"))))


def _dealt(key: Column, chunks: Column) -> Column:
    """The chunk of a document id."""
    return F.pmod(F.xxhash64(F.lit(5), key), chunks).cast("int")


def _may_link(reps: DataFrame, percent: int) -> DataFrame:
    """Spanning forests (a, b) of the pairs whose sketches leave the similarity possible; reps has doc_id, n, low."""
    many = F.least(F.size("low") - 1, F.lit(lists_for(percent)))
    key = lambda x, i: F.xxhash64(x, F.get("low", i + 1))
    entries = reps.filter("n > 1").select("doc_id", "n", F.explode(F.transform(F.slice("low", 1, many), key)).alias("v"))
    sizes = entries.groupBy("v").agg(F.count("*").alias("c"), F.min("n").alias("least"), F.max("n").alias("most"))
    sizes = sizes.filter((F.col("c") > 2) | (F.col("c") == 2) & (100 * F.col("least") >= percent * F.col("most")))
    sizes = materialize(sizes.select("v", F.ceil(F.col("c") / LIST_CHUNK).cast("int").alias("chunks")), "lists")
    every = materialize(entries.join(broadcast_if_small(sizes, 64), "v").select("doc_id", "v", "chunks"), "list-members")
    # Lists of the same members say the same: copies share nearly all of their lists. One of them, told by two 64-bit checksums, stays.
    prints = [F.bit_xor(F.xxhash64(F.lit(k), "doc_id")).alias(f"x{k}") for k in (1, 2)]
    once = every.groupBy("v").agg(F.count("*").alias("c"), *prints).groupBy("c", "x1", "x2").agg(F.min("v").alias("v")).select("v")
    members = materialize(every.join(broadcast_if_small(materialize(once, "lists-once"), 32), "v", "left_semi"), "list-members-once")
    discard(every)
    blocks = members.select("doc_id", "v", F.explode(_chunk_pairs(_dealt(F.col("doc_id"), F.col("chunks")), F.col("chunks"))).alias("p")).select("doc_id", F.xxhash64("v", "p.i", "p.j").alias("g"))
    rows = blocks.join(reps, "doc_id").select("g", "doc_id", "n", F.col("doc_id").alias("comp"), F.col("low").alias("values"))
    found = materialize(_in_blocks(rows, percent, exact=False).distinct(), "may-link")
    discard(sizes, members)
    return found


def _exact(blocks: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) by full sets inside the blocks (doc_id, comp, g)."""
    dealt = blocks.groupBy("doc_id").agg(F.collect_list(F.struct("g", "comp")).alias("gs"))  # a document's blocks are as many as the chunks of its neighbourhood at most
    dealt = materialize(dealt, "dealt")
    sets = with_sets(docs.join(broadcast_if_small(dealt, 128), "doc_id").select("doc_id", "text", "gs"), words, "gs")
    rows = sets.select("doc_id", F.size("s").cast("long").alias("n"), F.col("s").alias("values"), F.explode("gs").alias("x")).select("*", "x.g", "x.comp")
    out = materialize(_in_blocks(rows, percent, exact=True).distinct(), "links")
    discard(dealt)
    return out


def _similar(reps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) whose components are those of all similar pairs of reps (doc_id, n, low)."""
    may = _may_link(reps, percent)
    near = components(may).select(F.col("id").alias("doc_id"), F.col("root").alias("near"))
    near = materialize(near.join(reps.select("doc_id", "n"), "doc_id"), "neighbourhoods")
    discard(may)
    count = lambda n, c: F.greatest(F.ceil(c / CHUNK), F.ceil(n / CHUNK_SHINGLES)).cast("int")
    sizes = near.groupBy("near").agg(F.count("*").alias("c"), F.sum("n").alias("w")).select("near", "c", count(F.col("w"), F.col("c")).alias("chunks"))
    large = materialize(sizes.filter("chunks > 1"), "large")
    # First: each chunk by itself, and with the members that all chunks see.
    known = near.join(broadcast_if_small(large, 64), "near", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    hub = (F.col("doc_id") == F.col("near")) | (F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.col("c")) < HUBS)
    own = F.when((F.col("chunks") > 1) & hub, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(_dealt(F.col("doc_id"), F.col("chunks"))))
    links = _exact(known.select("doc_id", F.col("doc_id").alias("comp"), F.col("near"), F.explode(own).alias("i")).select("doc_id", "comp", F.xxhash64("near", "i").alias("g")), docs, words, percent)
    if not large.isEmpty():
        # Then: between the chunks of large neighbourhoods. A group that fills chunks of its own has chunks of nothing else; these needn't meet.
        comp = components(links).select(F.col("id").alias("doc_id"), F.col("root").alias("comp"))
        members = near.join(F.broadcast(large.select("near")) if large.count() * 32 <= 8 << 20 else large.select("near"), "near")
        members = materialize(members.join(comp, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id")), "large-members")
        groups = members.groupBy("near", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
        groups = materialize(groups.withColumn("full", (F.col("c") >= CHUNK) | (F.col("w") >= CHUNK_SHINGLES)), "large-groups")
        rest = groups.filter("not full").groupBy("near").agg(count(F.sum("w"), F.sum("c")).alias("rest"))
        groups = groups.join(rest, "near", "left").select("near", "comp", "full", F.when(F.col("full"), count(F.col("w"), F.col("c"))).otherwise(F.col("rest")).alias("chunks"))
        placed = members.join(groups, ["near", "comp"])
        chunk = F.when(F.col("full"), F.xxhash64("near", "comp", _dealt(F.col("doc_id"), F.col("chunks")))).otherwise(F.xxhash64("near", F.lit(-1), _dealt(F.col("comp"), F.col("chunks"))))
        placed = materialize(placed.select("doc_id", "near", "comp", "n", chunk.alias("chunk"), F.when(F.col("full"), F.col("comp")).alias("label")), "placed")
        chunks = materialize(placed.select("near", "chunk", "label").distinct(), "chunks")
        x, y = chunks.alias("x"), chunks.alias("y")
        meet = x.join(y, (F.col("x.near") == F.col("y.near")) & (F.col("x.chunk") <= F.col("y.chunk")) & ~F.coalesce(F.col("x.label") == F.col("y.label"), F.lit(False)))
        meet = meet.select(F.col("x.chunk").alias("c1"), F.col("y.chunk").alias("c2"), F.xxhash64("x.chunk", "y.chunk").alias("g"))
        meet = materialize(meet.select(F.explode(F.array_distinct(F.array("c1", "c2"))).alias("chunk"), "g"), "meet")
        more = _exact(placed.join(meet, "chunk").select("doc_id", "comp", "g"), docs, words, percent)
        links = materialize(links.union(more), "links")
        discard(members, placed, chunks, meet, more)
    discard(near, large)
    return links


def groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest id of its group) and kept (whether that is itself).

    Null and empty texts have no shingles and are linked with nothing. Texts of any length count whole. Of repeated ids with different texts each
    row counts as the same node; documents with a null id are returned as groups of their own, with a null component. Ties go to the smallest id.
    Other columns are ignored; an empty table gives an empty result. ``percent`` is from 60 to 100.
    """
    if not 60 <= percent <= 100:
        raise ValueError("percent: from 60 to 100")
    given = docs.select("doc_id", "text")
    every = materialize(sketches(given, words), "sketches")
    full = every.filter("n > 0 and doc_id is not null")
    prints = full.select("doc_id", "n", "k1", "k2")
    classes = prints.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).filter("c > 1")
    # the rows of a class but its first: what a representative stands for
    copies = materialize(prints.join(broadcast_if_small(materialize(classes, "classes"), 64), ["k1", "k2", "n"]).filter("doc_id <> rep").select("doc_id", "rep", "k1", "k2"), "copies")
    again = materialize(prints.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id"), "repeated-ids")
    first = full.join(broadcast_if_small(copies, 64), ["doc_id", "k1", "k2"], "left_anti")
    again = broadcast_if_small(again, 32)
    reps = first.join(again, "doc_id", "left_anti").union(first.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "k1", "k2"])).select("doc_id", "n", "low")
    links = _similar(reps, given, words, percent)
    root = components(links.union(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
    out = every.select("doc_id", F.col("n").alias("n_shingles")).join(root, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), (F.coalesce("root", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, all columns unchanged: that with the smallest id. Rows with a repeated id or none are judged one by one,
    so of equal rows one stays; rows without words all stay."""
    node = f"__node_{uuid.uuid4().hex[:12]}"
    rows = numbered(docs, node)
    dropped = groups(rows.select(F.col(node).alias("doc_id"), "text"), words, percent).filter("not kept").select(F.col("doc_id").alias(node))
    return rows.join(broadcast_if_small(materialize(dropped, "duplicates"), 32), node, "left_anti").select(*docs.columns)
