"""Local alignment of long pairs, cut by Spark into windows that are rows.

Both sequences are cut into tiles. A window is a tile of the first and one of the second sequence; an alignment counts in the window in whose own cells it ends.

Odds under given parameters (:func:`window_odds`) are those of the full recurrence: a window is handed the last cells of the windows above and beside it, so an alignment may have
begun in any window before. The windows of a pair go through one task in their order or, if they are many, a wave of them after another over all tasks.

Where parameters are re-estimated (:func:`score_windows`), a tile has an overlap before it and an alignment may start anywhere in that window. So every alignment counts once, but for
those that reach back beyond the overlap. Only tiles near a seed, a k-mer that both sequences have, become windows, or all of them. These windows are scored apart from each other, by the kernels of :mod:`bitloom.operators.align`, and meet in aggregates: the log-sum of their odds and
the mean of their event counts, weighed by the odds, or the best of them. Re-estimation goes in rounds over all pairs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.operators import align, places
from bitloom.operators.sequences import kmers
from bitloom.session import small, written

TILE, OVERLAP = 1024, 512
#: Windows of a pair up to which one task does them all.
ALONE = 1024
#: Windows of a pair up to which one task does all its rounds of re-estimation, and windows of pairs that it works on together.
TOGETHER, AT_ONCE = 64, 512
COUNTS = ("match", "change", *align.NAMES)
PLACES = ("a_start", "a_end", "b_start", "b_end")


def seed_tiles(pairs: DataFrame, a: DataFrame, b: DataFrame, key_a: str, key_b: str, k: int, tile: int = TILE, reach: int = 256, seq: str = "seq") -> DataFrame:
    """(key_a, key_b, tile_a, tile_b): the tiles of each pair that lie within ``reach`` of a k-mer that both of its sequences have.

    K-mers meet by the tiles that they stand in, once for each tile, so a frequent one makes no more rows than the pair has tiles. If those of ``a`` are few, no others of ``b`` are
    looked at.
    """
    own = a.select(F.explode(kmers(F.col(seq), k)).alias("gram")).distinct()
    few = own.count() * 64 <= 8 << 20

    def near(df: DataFrame, key: str, name: str) -> DataFrame:
        placed = df.select(key, F.char_length(seq).alias("n"), F.posexplode(kmers(F.col(seq), k)).alias("pos", "gram"))
        if few and df is b:
            placed = placed.join(F.broadcast(own), "gram", "left_semi")
        low = F.greatest(F.lit(0), F.floor((F.col("pos") - reach) / tile)).cast("int")
        high = F.least(F.floor((F.col("n") - 1) / tile), F.floor((F.col("pos") + k + reach) / tile)).cast("int")
        spans = placed.select(key, "gram", low.alias("low"), high.alias("high")).distinct()
        return spans.select(key, "gram", F.explode(F.sequence("low", "high")).alias(name)).distinct()

    met = near(a, key_a, "tile_a").join(pairs.select(key_a, key_b), key_a).join(near(b, key_b, "tile_b"), [key_b, "gram"])
    return met.select(key_a, key_b, "tile_a", "tile_b").distinct()


def all_tiles(pairs: DataFrame, pieces_a: DataFrame, pieces_b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """(key_a, key_b, tile_a, tile_b): every tile of each pair, the exact way."""
    one, other = pieces_a.select(key_a, F.col("tile").alias("tile_a")), pieces_b.select(key_b, F.col("tile").alias("tile_b"))
    return pairs.select(key_a, key_b).join(one, key_a).join(other, key_b)


def windows(tiles: DataFrame, pieces_a: DataFrame, pieces_b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """One row for each window: the keys and tiles, and of both sides start, n, first, seq and p, with _a or _b."""

    def side(pieces: DataFrame, key: str, end: str) -> DataFrame:
        return pieces.select(key, *[F.col(c).alias(f"{c}_{end}") for c in ("tile", "start", "n", "first", "seq", "p")])

    return tiles.join(side(pieces_a, key_a, "a"), [key_a, "tile_a"]).join(side(pieces_b, key_b, "b"), [key_b, "tile_b"])


def _batches(pdf: pd.DataFrame, alphabet: str) -> Iterator[tuple[list[int], pd.DataFrame, align.Batch]]:
    """Places, rows and batch of windows of similar sizes."""
    for part in align.alike([(len(a), len(b)) for a, b in zip(pdf.seq_a, pdf.seq_b, strict=True)]):
        rows = pdf.iloc[part]
        pairs = [(places.coded(a, alphabet), places.coded(b, alphabet)) for a, b in zip(rows.seq_a, rows.seq_b, strict=True)]
        probs = [tuple(np.asarray(p).reshape(-1, len(alphabet)) for p in both) for both in zip(rows.p_a, rows.p_b, strict=True)]
        yield part, rows, align.Batch(pairs, probs, first=list(zip(rows.first_a, rows.first_b, strict=True)))


def _ends(path: list[tuple[int, int, int]], start_a: int, start_b: int) -> tuple[int, int, int, int]:
    return path[0][1] + start_a, path[-1][1] + start_a, path[0][2] + start_b, path[-1][2] + start_b


def _kernel(keys: list[str], total: bool, alphabet: str, counted: bool):
    """Scores the windows of a batch under the parameters in their columns; the counts are 0, as are the places, unless ``counted``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[[*keys, "tile_a", "tile_b"]].copy()
            out["odds"] = -np.inf
            for c in (*COUNTS, *PLACES):
                out[c] = 0.0
            for part, rows, batch in _batches(pdf, alphabet):
                pair, cost = ({c: rows[f"p_{c}"].to_numpy() for c in names} for names in (align.PAIR, align.NAMES))
                odds, found, ways = align.odds_of(batch, pair, cost, True, total, counted)
                at = out.index[part]
                out.loc[at, "odds"] = odds
                for c in COUNTS if counted else ():
                    out.loc[at, c] = found[c]
                if counted and not total:
                    ends = np.array([_ends(*x) for x in zip(ways, rows.start_a, rows.start_b, strict=True)], float)
                    for i, c in enumerate(PLACES):
                        out.loc[at, c] = ends[:, i]
            yield out

    return run


def _tasks(wide: DataFrame) -> int:
    """Tasks for windows, which cost a lot each."""
    return max(1, min(4 * wide.sparkSession.sparkContext.defaultParallelism, wide.count()))


def _scored(wide: DataFrame, params: DataFrame, keys: list[str], total: bool, alphabet: str, tasks: int, counted: bool = True) -> DataFrame:
    """(keys, odds, counts, places) of each pair that has a row in ``params``."""
    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in wide.schema if f.name in keys), "tile_a int, tile_b int, odds double", *(f"{c} double" for c in (*COUNTS, *PLACES))])
    ready = wide.join(params, keys).repartition(tasks, *keys, "tile_a", "tile_b")
    order = [*keys, "tile_a", "tile_b"]
    each = written(ready.mapInPandas(_kernel(keys, total, alphabet, counted), ", ".join(_in_order(fields, order))))
    if not total:
        best = F.max(F.struct("odds", (-F.col("tile_a")).alias("x"), (-F.col("tile_b")).alias("y"), *COUNTS, *PLACES)).alias("s")
        return each.groupBy(*keys).agg(best).select(*keys, "s.odds", *[f"s.{c}" for c in (*COUNTS, *PLACES)])
    top = each.groupBy(*keys).agg(F.max("odds").alias("top"))
    weight = F.pow(F.lit(2.0), F.col("odds") - F.col("top"))
    summed = each.join(top, keys).groupBy(*keys, "top").agg(F.sum(weight).alias("w"), *[F.sum(weight * F.col(c)).alias(c) for c in (*COUNTS, *PLACES)])
    return summed.select(*keys, (F.col("top") + F.log2("w")).alias("odds"), *[(F.col(c) / F.col("w")).alias(c) for c in (*COUNTS, *PLACES)])


def _in_order(fields: str, first: list[str]) -> list[str]:
    """Fields of a schema text, those named ``first`` in their order before the others."""
    by_name = {f.split()[0]: f for f in fields.split(", ")}
    return [by_name.pop(c) for c in first] + list(by_name.values())


def _start(states: int) -> list[Column]:
    values = {**align.PAIR, **(align.AFFINE if states == 3 else align.LINEAR)}
    return [F.lit(float(values[c])).alias(f"p_{c}") for c in COUNTS]


def _handed(r: dict, top: np.ndarray | None, left: np.ndarray | None, total: bool, states: int, alphabet: str) -> tuple[float, np.ndarray, np.ndarray]:
    """:func:`align.window_of` of a window's own cells, with those at the edge of the table. Where a window before it was left out, alignments start there."""
    cost, sides = align.AFFINE if states == 3 else align.LINEAR, []
    for end in "ab":
        skip = max(r[f"first_{end}"] - 1, 0)  # the overlap
        codes = places.coded(r[f"seq_{end}"], alphabet)
        sides.append((codes[skip:], np.asarray(r[f"p_{end}"]).reshape(-1, len(alphabet))[skip:], r[f"start_{end}"] + skip))
    (a, p_a, i), (b, p_b, j) = sides
    begun = [align.edge(at + np.arange(len(codes) + 1), cost, total) for codes, _, at in sides[::-1]]
    begun[1] = begun[1][[0, 2, 1]]
    value, either = -np.inf, np.logaddexp2 if total else np.maximum
    for k, before in enumerate((i, j)):
        if before:
            begun[k][1:] = -np.inf
        else:  # the corner counts once
            value = either(value, align.ended(begun[k][:, 0 if i == j == k else 1 :], cost, total))
    odds, bottom, right = align.window_of(a, b, p_a, p_b, align.PAIR, cost, total, begun[0] if top is None else top, begun[1] if left is None else left)
    return float(either(value, odds)), bottom, right


def window_odds(wide: DataFrame, keys: list[str], total: bool = True, states: int = 3, alphabet: str = "acgt") -> DataFrame:
    """(keys, log_odds) of local alignments under the start parameters, before any cost of stating them.

    If ``wide`` has all tiles of a pair, these are the odds of the full recurrence, however far an alignment reaches, and the pieces need no overlap. Memory is that of a window and of
    the last cells above it. Pairs of more than ``ALONE`` windows go in waves.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wide.schema if f.name in keys)
    names = [f.split()[0] for f in kinds.split(", ")]
    either = np.logaddexp2 if total else np.maximum
    counted = written(wide.groupBy(*keys).agg(F.count("*").alias("c")))
    many = small(written(counted.filter(F.col("c") > ALONE).select(*keys)), 64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, value, cells = None, -np.inf, {}
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                if (now := tuple(r[c] for c in names)) != key:
                    if key is not None:
                        rows.append((*key, float(value)))
                    key, value, cells = now, -np.inf, {}
                i, j = r["tile_a"], r["tile_b"]
                odds, cells["top", i + 1, j], cells["left", i, j + 1] = _handed(r, cells.pop(("top", i, j), None), cells.pop(("left", i, j), None), total, states, alphabet)
                value = either(value, odds)
            yield pd.DataFrame(rows, columns=[*names, "log_odds"])
        if key is not None:
            yield pd.DataFrame([(*key, float(value))], columns=[*names, "log_odds"])

    tasks = max(1, min(4 * wide.sparkSession.sparkContext.defaultParallelism, counted.count()))
    ordered = wide.join(many, keys, "left_anti").repartition(tasks, *keys).sortWithinPartitions(*keys, "tile_a", "tile_b")
    out = ordered.mapInPandas(run, f"{kinds}, log_odds double").select(*keys, "log_odds")
    return out if many.isEmpty() else out.union(_in_waves(wide.join(many, keys), keys, kinds, total, states, alphabet))


def _in_waves(wide: DataFrame, keys: list[str], kinds: str, total: bool, states: int, alphabet: str) -> DataFrame:
    """:func:`window_odds` of pairs of many windows: those whose tiles have the same sum go together, and hand on their last cells as rows."""
    wide = written(wide)
    names = [*(f.split()[0] for f in kinds.split(", ")), "tile_a", "tile_b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                top, left = (None if r[c] is None else np.asarray(r[c]).reshape(3, -1) for c in ("top", "left"))
                odds, bottom, right = _handed(r, top, left, total, states, alphabet)
                rows.append((*(r[c] for c in names), odds, bottom.ravel(), right.ravel()))
            yield pd.DataFrame(rows, columns=[*names, "odds", "bottom", "right"])

    made, each, tasks = None, None, _tasks(wide)
    for wave in range(wide.agg(F.max(F.col("tile_a") + F.col("tile_b"))).first()[0] + 1):
        here, order = wide.filter(F.col("tile_a") + F.col("tile_b") == wave), [*keys, "tile_a", "tile_b"]
        if made is None:
            here = here.withColumns({c: F.lit(None).cast("array<double>") for c in ("top", "left")})
        else:
            above = made.select(*keys, (F.col("tile_a") + 1).alias("tile_a"), "tile_b", F.col("bottom").alias("top"))
            beside = made.select(*keys, "tile_a", (F.col("tile_b") + 1).alias("tile_b"), F.col("right").alias("left"))
            here = here.join(above, order, "left").join(beside, order, "left")
        made = written(here.repartition(tasks, *order).mapInPandas(run, f"{kinds}, tile_a int, tile_b int, odds double, bottom array<double>, right array<double>"))
        odds = made.select(*keys, "odds")
        each = odds if each is None else each.union(odds)
    top = each.groupBy(*keys).agg(F.max("odds").alias("top"))
    if not total:
        return top.select(*keys, F.col("top").alias("log_odds"))
    return each.join(top, keys).groupBy(*keys, "top").agg(F.sum(F.pow(F.lit(2.0), F.col("odds") - F.col("top"))).alias("w")).select(*keys, (F.col("top") + F.log2("w")).alias("log_odds"))


def score_windows(wide: DataFrame, keys: list[str], total: bool = True, states: int = 3, max_rounds: int = -1, keep: str = "best", alphabet: str = "acgt") -> DataFrame:
    """(keys, log_odds, rounds, enc_model, p_*, n_*, a_start, a_end, b_start, b_end): the rows of :func:`align.score_pairs` for windows.

    p_*: the parameters of the round that is kept, in bits; n_*: its expected numbers of events. Of sums the cut points are null. Pairs of up to ``TOGETHER`` windows go
    through their rounds in one pass; for the others a round is one pass over the windows of the pairs that go on.
    """
    wide = written(wide)
    several = written(wide.groupBy(*keys).agg(F.count("*").alias("c")).filter("c > 1"))
    some, many = (small(several.filter(f"c {than} {TOGETHER}").select(*keys), 64) for than in ("<=", ">"))
    names = [*keys, "log_odds", "rounds", "enc_model", *(f"p_{c}" for c in COUNTS), *(f"n_{c}" for c in COUNTS), *PLACES]

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            place, rows = align.place_bits(pdf.n_a.to_numpy(), pdf.n_b.to_numpy()), pdf.to_dict("records")

            def made(i: int) -> tuple[tuple, tuple, tuple[int, int]]:
                r = rows[i]
                return tuple(places.coded(r[c], alphabet) for c in ("seq_a", "seq_b")), tuple(np.asarray(r[c]).reshape(-1, len(alphabet)) for c in ("p_a", "p_b")), (r["first_a"], r["first_b"])

            out = []
            for i, _, g in align.rounds([(len(r["seq_a"]), len(r["seq_b"])) for r in rows], made, True, total, states, max_rounds, keep, alphabet, place=place):
                ends = (0,) * 4 if total else _ends(g["path"], rows[i]["start_a"], rows[i]["start_b"])
                told = [g[c] for c in ("log_odds", "rounds", "enc_model")] + [g[of][c] for of in ("params", "counts") for c in COUNTS]
                out.append([rows[i][k] for k in keys] + told + [float(e) for e in ends])
            yield pd.DataFrame(out, columns=names)

    kinds = {f.name: f.dataType.simpleString() for f in wide.schema}
    fields = ", ".join(f"{c} {kinds[c] if c in keys else 'int' if c == 'rounds' else 'double'}" for c in names)
    tasks = _tasks(wide)
    out = wide.join(small(several.select(*keys), 64), keys, "left_anti").repartition(tasks, *keys).mapInPandas(alone, fields).select(*names)
    together = wide.join(some, keys).repartition(tasks, *keys).sortWithinPartitions(*keys, "tile_a", "tile_b")
    out = written(out.union(together.mapInPandas(_together(keys, names, total, states, max_rounds, keep, alphabet), fields).select(*names)))
    if not many.isEmpty():
        out = out.union(_in_rounds(wide.join(many, keys), keys, total, states, max_rounds, keep, alphabet).select(*names))
    return out.select(*names[: -len(PLACES)], *[(F.lit(None) if total else F.col(c)).cast("int").alias(c) for c in PLACES])


def _estimated(r: dict, where: float, states: int, keep: str) -> None:
    """The costs of a pair's round, what is kept of it, and the next parameters."""
    counts = {c: r[c] + 0.5 for c in COUNTS}
    pair, cost = {c: r[f"p_{c}"] for c in align.PAIR}, {c: r[f"p_{c}"] for c in align.NAMES}
    stated = align.model_bits(pair, cost, counts, states) + where
    r["last"], r["rounds"] = r["odds"] - stated, r["rounds"] + 1
    if r["last"] > r["log_odds"] or keep != "best":
        r |= {"log_odds": r["last"], "enc_model": stated} | {f"kept_{c}": r[f"p_{c}"] for c in COUNTS} | {f"n_{c}": counts[c] for c in COUNTS} | {c: r[f"new_{c}"] for c in PLACES}
    r["going"] = not (-r["last"] <= r["length"] and r["length"] + r["last"] < align.LEAST_GAIN)
    r["length"] = -r["last"]
    pair, cost = align.estimate(counts, states)
    r |= {f"p_{c}": v for c, v in {**pair, **cost}.items()}


def _together(keys: list[str], names: list[str], total: bool, states: int, max_rounds: int, keep: str, alphabet: str):
    """All rounds of pairs whose windows come one after another; the windows of some pairs are worked on together."""
    most = align.MAX_ROUNDS if max_rounds < 0 else max_rounds + 1
    start = {**align.PAIR, **(align.AFFINE if states == 3 else align.LINEAR)}
    nothing = dict.fromkeys(("enc_model", *(f"kept_{c}" for c in COUNTS), *(f"n_{c}" for c in COUNTS), *PLACES), 0.0) | {"log_odds": -np.inf, "length": np.inf, "rounds": 0, "going": True}

    def scored(pairs: list[list[dict]]) -> pd.DataFrame:
        rows, made = [], []
        for of, each in enumerate(pairs):
            rows.append({k: each[0][k] for k in keys} | {f"p_{c}": float(start[c]) for c in COUNTS} | nothing)
            for r in each:
                codes = tuple(places.coded(r[c], alphabet) for c in ("seq_a", "seq_b"))
                probs = tuple(np.asarray(r[c]).reshape(-1, len(alphabet)) for c in ("p_a", "p_b"))
                made.append((of, codes, probs, (r["first_a"], r["first_b"]), (r["start_a"], r["start_b"])))
        place = align.place_bits(np.array([each[0]["n_a"] for each in pairs]), np.array([each[0]["n_b"] for each in pairs]))
        for _ in range(most):
            going = [w for w in made if rows[w[0]]["going"]]
            if not going:
                break
            of = np.array([w[0] for w in going])
            odds, counts, ends = np.empty(len(going)), np.zeros((len(COUNTS), len(going))), np.zeros((len(PLACES), len(going)))
            for part in align.alike([tuple(map(len, w[1])) for w in going]):
                batch = align.Batch([going[i][1] for i in part], [going[i][2] for i in part], first=[going[i][3] for i in part])
                pair, cost = ({c: np.array([rows[k][f"p_{c}"] for k in of[part]]) for c in told} for told in (align.PAIR, align.NAMES))
                odds[part], found, ways = align.odds_of(batch, pair, cost, True, total)
                counts[:, part] = [found[c] for c in COUNTS]
                if not total:
                    ends[:, part] = np.array([_ends(way, *going[i][4]) for i, way in zip(part, ways, strict=True)]).T
            bounds = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
            for begin, end in zip(bounds, bounds[1:], strict=False):
                value, r = odds[begin:end], rows[of[begin]]
                top = begin + int(value.argmax())  # of equal ones the first tiles
                if total:
                    weight = np.exp2(value - odds[top])
                    r |= {"odds": float(odds[top] + np.log2(weight.sum()))} | dict(zip(COUNTS, (counts[:, begin:end] @ weight / weight.sum()).tolist(), strict=True))
                else:
                    r |= {"odds": float(odds[top])} | dict(zip(COUNTS, counts[:, top].tolist(), strict=True))
                r |= {f"new_{c}": float(v) for c, v in zip(PLACES, ends[:, top], strict=True)}
                _estimated(r, place[of[begin]], states, keep)
        kept = {f"p_{c}": f"kept_{c}" for c in COUNTS}
        return pd.DataFrame([[r[kept.get(c, c)] for c in names] for r in rows], columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, count = [], 0
        for pdf in batches:
            for r in pdf.to_dict("records"):
                if not pairs or any(pairs[-1][0][k] != r[k] for k in keys):
                    if count >= AT_ONCE:
                        yield scored(pairs)
                        pairs, count = [], 0
                    pairs.append([])
                pairs[-1].append(r)
                count += 1
        if pairs:
            yield scored(pairs)

    return run


def _in_rounds(wide: DataFrame, keys: list[str], total: bool, states: int, max_rounds: int, keep: str, alphabet: str) -> DataFrame:
    """Rounds of pairs of many windows: all windows are scored, their sums meet, and the pairs get new parameters."""
    wide = written(wide)
    kept = ["log_odds", "enc_model", *(f"kept_{c}" for c in COUNTS), *(f"n_{c}" for c in COUNTS), *PLACES]
    nothing = [F.lit(float("-inf")).alias("log_odds"), F.lit(0.0).alias("last"), F.lit(float("inf")).alias("length"), F.lit(0).alias("rounds"), F.lit(True).alias("going"), *[F.lit(0.0).alias(c) for c in kept[1:]]]
    state = written(wide.groupBy(*keys).agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")).select(*keys, "n_a", "n_b", *_start(states), *nothing))

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The round's costs, what is kept, and the next parameters of each pair."""
        for pdf in batches:
            place = align.place_bits(pdf.n_a.to_numpy(), pdf.n_b.to_numpy())
            rows = pdf.to_dict("records")
            for r, where in zip(rows, place, strict=True):
                _estimated(r, where, states, keep)
            yield pd.DataFrame(rows, columns=state_columns)

    state_columns, done = state.columns, None
    tasks, few = _tasks(wide), state.count() * 128 <= 8 << 20  # the pairs that go on get fewer
    for _ in range(align.MAX_ROUNDS if max_rounds < 0 else max_rounds + 1):
        params = state.select(*keys, *[f"p_{c}" for c in COUNTS])
        found = _scored(wide, F.broadcast(params) if few else params, keys, total, alphabet, tasks)
        found = found.select(*keys, "odds", *COUNTS, *[F.col(c).alias(f"new_{c}") for c in PLACES])
        now = written(state.join(found, keys).mapInPandas(step, state.schema))
        ended, state = now.filter("not going"), now.filter("going")
        done = ended if done is None else done.union(ended)
        if state.isEmpty():
            break
    out = done.union(state)
    return out.select(*keys, "log_odds", "rounds", "enc_model", *[F.col(f"kept_{c}").alias(f"p_{c}") for c in COUNTS], *[f"n_{c}" for c in COUNTS], *PLACES)


def align_long(pairs: DataFrame, a: DataFrame, b: DataFrame, key_a: str, key_b: str, k: int | None = 20, tile: int = TILE, overlap: int = OVERLAP, reach: int = 256, model: str = "fitted(0)", alphabet: str = "acgt", models: dict | None = None, **options) -> DataFrame:
    """:func:`score_windows` of the pairs (key_a, key_b) of sequences in ``a`` and ``b``, with enc_null and enc_align.

    ``k``: length of seeds; None takes all tiles. Pairs without a seed, or with an empty sequence, have no row. Memory is that of a few windows, however long the
    sequences.
    """
    pieces_a = written(places.pieces(a, key_a, tile, overlap, model, alphabet, models=models))
    pieces_b = written(places.pieces(b, key_b, tile, overlap, model, alphabet, models=models))
    tiles = all_tiles(pairs, pieces_a, pieces_b, key_a, key_b) if k is None else seed_tiles(pairs, a, b, key_a, key_b, k, tile, reach)
    out = score_windows(windows(tiles, pieces_a, pieces_b, key_a, key_b), [key_a, key_b], alphabet=alphabet, **options)
    alone = [p.groupBy(key).agg(F.sum("bits").alias(f"null_{key}")) for p, key in ((pieces_a, key_a), (pieces_b, key_b))]
    enc_null = F.col(f"null_{key_a}") + F.col(f"null_{key_b}")
    out = out.join(alone[0], key_a).join(alone[1], key_b)
    return out.withColumn("enc_null", enc_null).withColumn("enc_align", enc_null - F.col("log_odds")).drop(f"null_{key_a}", f"null_{key_b}")
