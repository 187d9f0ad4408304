"""Near-duplicate embeddings by robust-pruned flat graphs.

1. Vectors of one label (and size) that are equal, component by component, form a class; one of them stands for it, with a weight.
2. A bounded sample of each large label gives centres, and leaders: means of balls so dense that they would fill half a shard. What lies within half the
   link angle of a leader is a bundle: all of it is linked, whatever its size, without a look at pairs.
3. All other vectors go to the shards of their two nearest centres. Each shard builds a graph of its own (:mod:`bitloom.llm.graph`).
4. The adjacency lists of a vector are united, and each shard is searched again with the united lists, from its medoid, for each of its vectors: a greedy
   search, then expansion of all that is in range. Tied vectors of other shards take part, so a neighbourhood that shards have cut is seen whole.
5. What is found is verified in double precision; a pair counts in the first shard that both are in. Bundles meet what is near their leader in blocks.
6. An audit compares a hash sample of vectors with all vectors; if too few of their links were found, the search goes on with a longer list.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm import graph
from bitloom.llm.common import broadcast_if_small, discard, hash_sample, materialize, numbered, slices, whole_groups
from bitloom.llm.components import components

#: Rows of a shard, about; rows of a label's sample, besides 8 for each centre; rounds of moving centres; centres of all labels together.
SHARD, SAMPLE, MOVES, CENTRES = 1024, 2048, 8, 1 << 16
#: Rows of a block in which a bundle meets what is near it; vectors of the audit; cosine by which range expansion goes beyond the range.
BLOCK, AUDIT, SLACK = 2048, 256, 0.02
#: Rounding of single precision in the search; what it lets through is verified.
ROUNDING = 1e-4


def _unit(e: np.ndarray) -> np.ndarray:
    e = e / np.abs(e).max(1, keepdims=True)
    return e / np.linalg.norm(e, axis=1, keepdims=True)


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and sizes of lists of doubles."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False), bounds[:-1], np.diff(bounds)


def _matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """The unit vectors of rows that have the same size."""
    flat, starts, sizes = _vectors(column)
    return _unit(flat[starts[rows][:, None] + np.arange(sizes[rows[0]])])


def _mixed(g: np.ndarray, number: np.ndarray, salt: int) -> np.ndarray:
    return (g.astype(np.uint64) ^ ((number.astype(np.uint64) + np.uint64(1)) * np.uint64(salt))).astype(np.int64)


def read(vectors: DataFrame) -> DataFrame:
    """vec_id, node (tells all rows apart), g (label and size, hashed; null for what links with nothing), two fingerprints and the vector as doubles."""
    e = F.col("embedding").cast("array<double>")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce((F.size(e) > 0) & ~odd & F.exists(e, lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    rows = numbered(vectors.select("vec_id", "label", "embedding"), "node", "vec_id")
    # plus 0.0: the zero with a sign equals the other
    e = F.when(good, F.transform(e, lambda x: x + F.lit(0.0)))
    kept = rows.select("vec_id", "node", F.when(good, F.xxhash64("label", F.size("embedding"))).alias("g"), e.alias("e"))
    return materialize(kept.select("vec_id", "node", "g", F.xxhash64("e").alias("k1"), F.xxhash64(F.lit(3), "e").alias("k2"), "e"), "vectors")


def _fit(half: float, parts: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Centres and leaders of the sample of a label; its columns k (number of centres) and share (of a ball for a leader)."""

    def run(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("id")
        x = _unit(np.stack(sample.e.to_numpy()))
        rng = np.random.default_rng(len(x))
        x = x[rng.permutation(len(x))]
        centres = x[: int(sample.k.iloc[0])].copy()
        for _ in range(MOVES):
            nearest = np.concatenate([(x[a : a + parts] @ centres.T).argmax(1) for a in range(0, len(x), parts)])
            total = np.zeros_like(centres)
            np.add.at(total, nearest, x)
            size = np.linalg.norm(total, axis=1, keepdims=True)
            centres = np.where(size > 0, total / np.where(size > 0, size, 1), centres)
        some = x[:SAMPLE]
        close = some @ some.T >= half
        leaders, left = [], np.ones(len(some), bool)
        while left.any():
            count = np.where(left, (close & left).sum(1), 0)
            best = int(count.argmax())
            if count[best] < max(8, sample.share.iloc[0] * len(some)):
                break
            leader = _unit(some[close[best] & left].mean(0, keepdims=True))[0]
            leaders.append(leader)
            left &= (some @ leader < half) & ~close[best]
        every = [*centres, *leaders]
        return pd.DataFrame({"g": sample.g.iloc[0], "leader": [False] * len(centres) + [True] * len(leaders), "e": [v.tolist() for v in every]})

    return run


def centres(v: DataFrame, least: float, shard: int = SHARD) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each label with more rows than half a shard: its centres and its leaders. Their number is bounded by CENTRES, beyond which shards get larger."""
    sizes = materialize(v.groupBy("g").agg(F.count("*").alias("n")), "label-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shard = max(shard, math.ceil(2 * total / CENTRES))
    large = sizes.filter(F.col("n") > shard / 2)
    k = F.greatest(F.lit(3), F.ceil(2 * F.col("n") / shard)).cast("int")
    large = large.select("g", k.alias("k"), (F.lit(shard / 2) / F.col("n")).alias("share"), ((SAMPLE + 8 * k) / F.col("n")).alias("rate"))
    sample = v.join(broadcast_if_small(large, 64), "g").filter(F.pmod(F.xxhash64(F.lit(23), "id"), F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    half = math.cos(math.acos(least) / 2) + 1e-12
    out: dict[int, tuple[list, list]] = {}
    for r in sample.select("id", "g", "k", "share", "e").groupBy("g").applyInPandas(_fit(half, 4096), "g long, leader boolean, e array<double>").collect():
        out.setdefault(r.g, ([], []))[r.leader].append(r.e)
    return {g: (np.array(c), np.array(d).reshape(len(d), len(c[0]))) for g, (c, d) in out.items()}


def place(v: DataFrame, found: dict[int, tuple[np.ndarray, np.ndarray]], least: float) -> DataFrame:
    """``v`` (id, w, g, e) with the bundle of each vector, or else the shards of its two nearest centres, and the bundles that it is near."""
    shared = v.sparkSession.sparkContext.broadcast(found)
    angle = math.acos(least)
    half, near = math.cos(angle / 2) + 1e-12, math.cos(1.5 * angle) - 1e-12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            g = batch.column("g").to_numpy()
            bundle = np.zeros(len(g), np.int64)
            in_bundle = np.zeros(len(g), bool)
            shards: list[list[int]] = [[] for _ in g]
            fringe: list[list[int]] = [[] for _ in g]
            for one in np.unique(g):
                rows = np.flatnonzero(g == one)
                if int(one) not in shared.value:
                    for r in rows:
                        shards[r] = [int(one)]
                    continue
                middle, leaders = shared.value[int(one)]
                x = _matrix(batch.column("e"), rows)
                if len(leaders):
                    cosine, names = x @ leaders.T, _mixed(np.full(len(leaders), one), np.arange(len(leaders)), 0xC2B2AE3D27D4EB4F)
                    best = cosine.argmax(1)
                    inside = cosine[np.arange(len(x)), best] >= half
                    in_bundle[rows], bundle[rows] = inside, names[best]
                    cosine[np.flatnonzero(inside), best[inside]] = -1
                    for r, c in zip(*np.nonzero(cosine >= near), strict=True):
                        fringe[rows[r]].append(int(names[c]))
                two = np.argpartition(-(x @ middle.T), 1, 1)[:, :2]
                names = np.sort(_mixed(np.full(two.shape, one), two, 0x9E3779B97F4A7C15), 1)
                for r, pair in zip(rows, names, strict=True):
                    shards[r] = [] if in_bundle[r] else pair.tolist()
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bundle, mask=~in_bundle), pa.array(shards, kind), pa.array(fringe, kind)], ["id", "w", "g", "e", "bundle", "shards", "fringe"])

    return v.select("id", "w", "g", "e").mapInArrow(run, "id long, w long, g long, e array<double>, bundle long, shards array<long>, fringe array<long>")


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int64)))


def _build(split: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (s, id, e) sorted by s: edges and ties of each vector in its shard's graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, "s"):
            ids, e = table.column("id").to_numpy(), table.column("e").combine_chunks()
            e = e.chunk(0) if isinstance(e, pa.ChunkedArray) else e
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = ids[a:b]
                edges, ties, _ = graph.build(_matrix(e, np.arange(a, b)).astype(np.float32), split)
                some = edges >= 0
                ends, other = np.concatenate([ties[0], ties[1]]), np.concatenate([ties[1], ties[0]])
                order = np.argsort(ends, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array(own), _lists(own[edges[some]], some.sum(1)), _lists(own[other[order]], np.bincount(ends, minlength=len(own)))], ["id", "edges", "ties"])

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over links (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _search(least: float, beam: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (s, id, w, g, e, shards, edges, ties) sorted by s: (id, other, n, m, cross).

    ``cross`` rows are pairs that share no shard, with the weights of other and id; the rest tell for a vector the weight of its links that count in this
    shard, and one that it is connected with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, "s"):
            columns = {c: table.column(c).combine_chunks() for c in table.column_names}
            columns = {c: v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for c, v in columns.items()}
            ids, w, g, s = (columns[c].to_numpy() for c in ("id", "w", "g", "s"))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                order = a + np.argsort(ids[a:b])
                own, n = ids[order], b - a
                e = _matrix(columns["e"], order)
                flat, starts, sizes = _vectors(columns["shards"])
                homes = np.stack([flat[starts[order]], flat[starts[order] + sizes[order] - 1]], 1)
                member = (homes == s[a]).any(1)

                def local(column: str) -> tuple[np.ndarray, np.ndarray]:
                    """Pairs of places: a row, and one in its list that is here."""
                    flat, starts, sizes = _vectors(columns[column])
                    size = sizes[order]
                    row = np.repeat(np.arange(n), size)
                    value = flat[np.repeat(starts[order] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                    place = np.minimum(np.searchsorted(own, value), n - 1)
                    here = own[place] == value
                    return row[here], place[here]

                row, to = local("edges")
                size = np.bincount(row, minlength=n)
                edges = np.full((n, max(1, int(size.max()))), -1)
                edges[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = to
                around = graph.lists(n, edges, np.stack(local("ties")))
                x = e.astype(np.float32)
                inside = np.flatnonzero(member)
                start = int(inside[graph.medoid(x[inside])])
                codes = [np.zeros(0, np.int64)]
                for at in range(0, len(inside), graph.BATCH):
                    part = inside[at : at + graph.BATCH]
                    q, node = graph.within(x, edges, around, x[part], start, least - ROUNDING, SLACK, beam)
                    q = part[q]
                    codes.append(np.unique(np.minimum(q, node) * n + np.maximum(q, node))[:])
                one, other = np.divmod(np.unique(np.concatenate(codes)), n)
                one, other = one[one != other], other[one != other]
                cosine = np.concatenate([np.einsum("pd,pd->p", e[one[i : i + 65536]], e[other[i : i + 65536]]) for i in range(0, len(one), 65536)] or [np.zeros(0)])
                yes = (cosine >= least) & (g[order[one]] == g[order[other]])
                one, other = one[yes], other[yes]
                h1, h2 = homes[one], homes[other]
                shared_first = (h1[:, 0] == h2[:, 0]) | (h1[:, 0] == h2[:, 1])
                first = np.where(shared_first, h1[:, 0], h1[:, 1])
                common = shared_first | (h1[:, 1] == h2[:, 0]) | (h1[:, 1] == h2[:, 1])
                counted = common & (first == s[a])
                links = np.zeros(n, np.int64)
                np.add.at(links, one[counted], w[order[other[counted]]])
                np.add.at(links, other[counted], w[order[one[counted]]])
                root = _roots(n, one, other)
                some = np.unique(np.concatenate([one, other]))
                x1, x2 = one[~common], other[~common]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in ((own[some], own[x1]), (own[root[some]], own[x2]), (links[some], w[order[x2]]), (np.zeros(len(some), np.int64), w[order[x1]]), (np.zeros(len(some), bool), np.ones(len(x1), bool)))], ["id", "other", "n", "m", "cross"]
                )

    return run


def _in_shards(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    return rows.repartition("s").sortWithinPartitions("s").mapInArrow(run, schema)


def searchable(placed: DataFrame, least: float) -> DataFrame:
    """Rows (s, id, w, g, e, shards, edges, ties) of all shards: their vectors with united lists, and vectors of other shards that those are tied to."""
    split = least - SLACK
    loose = placed.filter("bundle is null").select("id", "w", "g", "e", "shards")
    built = _in_shards(loose.select("id", "e", F.explode("shards").alias("s")), _build(split), "id long, edges array<long>, ties array<long>")
    united = built.groupBy("id").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("edges", "ties")])  # two shards, two lists
    nodes = materialize(loose.join(united, "id"), "graph")
    pairs = nodes.select("shards", F.explode("ties").alias("id")).join(nodes.select("id", F.col("shards").alias("own")), "id")
    beyond = pairs.select("id", F.explode(F.array_except("shards", "own")).alias("s")).distinct()
    columns = ["s", "id", "w", "g", "e", "shards", "edges", "ties"]
    return nodes.withColumn("s", F.explode("shards")).select(columns).union(nodes.join(beyond, "id").select(columns))


def bundled(placed: DataFrame, least: float) -> DataFrame:
    """(id, n, other): what the bundles add to the links of their own vectors and of those near them, and one that each of these is connected with."""
    inside = placed.filter("bundle is not null").select("id", "w", "e", F.col("bundle").alias("b"))
    outside = placed.filter(F.size("fringe") > 0).select("id", "w", "e", F.explode("fringe").alias("b"), F.col("bundle").isNull().alias("loose"))
    sizes = materialize(inside.groupBy("b").agg(F.count("*").alias("c"), F.sum("w").alias("all"), F.min("id").alias("rep")), "bundles")
    near = materialize(outside.groupBy("b").agg(F.count("*").alias("f")), "bundle-fringes")
    sizes_ = broadcast_if_small(sizes, 64)
    own = inside.join(sizes_, "b").select("id", (F.col("all") - F.col("w")).alias("n"), F.col("rep").alias("other"))
    blocks = sizes.join(near, "b").select("b", F.ceil(F.col("c") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("f") / BLOCK).cast("int").alias("columns"))
    blocks = broadcast_if_small(materialize(blocks, "bundle-blocks"), 64)
    at = lambda n: F.pmod(F.xxhash64(F.lit(29), "id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = inside.join(blocks, "b").withColumn("i", at("rows")).withColumn("j", every("columns")).withColumn("kind", F.lit(0))
    y = outside.join(blocks, "b").withColumn("j", at("columns")).withColumn("i", every("rows")).withColumn("kind", F.when(F.col("loose"), 1).otherwise(2))
    rows = x.unionByName(y.drop("loose")).select(F.xxhash64("b", "i", "j").alias("s"), "id", "w", "e", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, "s"):
            ids, w, kind = (table.column(c).to_numpy() for c in ("id", "w", "kind"))
            e = table.column("e").combine_chunks()
            e = e.chunk(0) if isinstance(e, pa.ChunkedArray) else e
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                place_ = np.arange(a, b)
                x, y = place_[kind[a:b] == 0], place_[kind[a:b] > 0]
                if not len(x) or not len(y):
                    continue
                link = _matrix(e, x) @ _matrix(e, y).T >= least
                to_y, to_x = w[x] @ link, (link & (kind[y] == 1)[None, :]) @ w[y]  # bundled ones have their links counted in their own bundle's blocks
                some = np.flatnonzero(link.any(0))
                more = np.flatnonzero(to_x)
                other = ids[x[link[:, some].argmax(0)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ((ids[y[some]], ids[x[more]]), (to_y[some], to_x[more]), (other, ids[x[more]]))], ["id", "n", "other"])

    return own.union(_in_shards(rows, run, "id long, n long, other long"))


def audit(v: DataFrame, counts: DataFrame, least: float, rows: int = AUDIT) -> tuple[int, int]:
    """(links found, links there are) of a hash sample of about ``rows`` of the vectors ``v``, each compared with all of them."""
    sample = hash_sample(v, rows, "id").select("id", "g", "e").collect()  # bounded by ``rows``
    ids, g, q = [r.id for r in sample], np.array([r.g for r in sample]), [_unit(np.array([r.e]))[0] for r in sample]
    shared = v.sparkSession.sparkContext.broadcast({int(k): (np.flatnonzero(g == k), np.stack([q[i] for i in np.flatnonzero(g == k)])) for k in np.unique(g)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in slices(batches, 4096):
            own, w = batch.column("g").to_numpy(), batch.column("w").to_numpy()
            for one in np.unique(own):
                if int(one) in shared.value:
                    at, asked = shared.value[int(one)]
                    mine = np.flatnonzero(own == one)
                    total[at] += w[mine] @ (_matrix(batch.column("e"), mine) @ asked.T >= least)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[some]), pa.array(total[some])], ["id", "n"])

    there = v.select("g", "w", "e").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("there"))
    both = there.join(v.select("id", "w"), "id").join(counts, "id", "left").select((F.col("there") - F.col("w")).alias("there"), F.coalesce("n", F.lit(0)).alias("n"))
    found, true = both.agg(F.sum(F.least("n", "there")), F.sum("there")).first()
    return found or 0, true or 0


def near_duplicates(vectors: DataFrame, least: float = 0.98, shard: int = SHARD, recall: float = 0.98, beam: int = graph.BEAM) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two rows are linked if their labels and sizes are equal and their cosine is ``least`` or more. A row with a null label links with nothing, and so do vectors that
    are null, empty, zero, or hold a null or a component that isn't finite. component_id is the smallest vec_id that links reach, kept tells whether that
    is the row's own. Equal rows are linked with each other; rows that share a vec_id, or have none, are rows of their own (an unlinked row without id has
    a null component and isn't kept). Other columns are ignored; an empty table gives an empty one.
    The sample that centres and leaders come from is bounded (SAMPLE and 8 for each centre, a label); all vectors are indexed.
    """
    every = read(vectors)
    good = every.filter("g is not null")
    classes = materialize(good.groupBy("g", "k1", "k2").agg(F.min("node").alias("rep"), F.count("*").alias("w")).filter("w > 1"), "classes")
    copies = good.join(broadcast_if_small(classes, 64), ["g", "k1", "k2"]).filter("node <> rep").select("node", "rep")
    copies = materialize(copies, "copies")
    single = good.select(F.col("node").alias("id"), "g", "e").join(broadcast_if_small(copies.select(F.col("node").alias("id")), 32), "id", "left_anti")
    weights = broadcast_if_small(classes.select(F.col("rep").alias("id"), "w"), 32)
    v = materialize(single.join(weights, "id", "left").select("id", F.coalesce("w", F.lit(1)).cast("long").alias("w"), "g", "e"), "distinct-vectors")
    placed = materialize(place(v, centres(v, least, shard), least), "placed")
    shards = searchable(placed, least)
    apart = materialize(bundled(placed, least), "bundle-links")
    while True:
        found = materialize(_in_shards(shards, _search(least, beam), "id long, other long, n long, m long, cross boolean"), "found")
        cross = found.filter("cross").select("id", "other", "n", "m").distinct()
        cross = cross.select("id", "n").union(cross.select("other", "m"))
        counts = found.filter("not cross").select("id", "n").union(cross).union(apart.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
        counts = materialize(counts, "link-counts")
        hit, true = audit(v, counts, least)
        if hit >= recall * true or beam >= 8 * graph.BEAM:
            break
        discard(found, counts)
        beam *= 2
    links = found.select(F.col("id").alias("a"), F.col("other").alias("b")).union(apart.select("id", "other")).union(copies.select("node", "rep"))
    root = materialize(components(links).select(F.col("id").alias("node"), "root"), "roots")
    n_links = v.join(counts, "id", "left").select(F.col("id").alias("rep"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")).filter("n_links > 0")
    rows = every.select("vec_id", "node").join(copies, "node", "left").withColumn("rep", F.coalesce("rep", "node")).join(n_links, "rep", "left").join(root, "node", "left")
    least_id = broadcast_if_small(materialize(rows.filter("root is not null").groupBy("root").agg(F.min("vec_id").alias("first")), "components"), 64)
    out = rows.join(least_id, "root", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def oracle(least: float = 0.98) -> str:
    """DuckDB SQL for :func:`near_duplicates` of ``embeddings``."""
    return f"""
    WITH RECURSIVE d AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    g AS (SELECT * FROM d WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= {least}),
    l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    r AS (SELECT vec_id AS a, vec_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM d JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""
