"""What experiments do with result tables: smoothing, ranks, ROC, runs, histograms, nested hits, merges.

Orders over a whole table never gather it in one task: rows are dealt by ranges of the order, ties included, so that no frequent value makes a
large range; ranges are summed (one small row each), and ranks or running totals inside a range start from the sum of the earlier ones.
Columns that functions add on their way have names of their own, so that the caller's columns can have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.session import written


def own_name(word: str) -> str:
    """A column name that no table of a caller has."""
    return f"__{word}_{uuid.uuid4().hex[:12]}"


def _ranges(df: DataFrame, order: list[Column]) -> tuple[DataFrame, str, str]:
    """``df`` in order, written, with the number of a row's range and its place there; and the names of these two columns."""
    part, place = own_name("range"), own_name("place")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return written(dealt.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(place))), part, place


def _before(per: DataFrame, part: str, sums: list[str]) -> DataFrame:
    """Sums over all earlier ranges; ``per`` has one row for each range, of which there are no more than shuffle partitions."""
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(per.select(part, *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(k) for k in sums]))


def running(df: DataFrame, col: str, tie: str, sums: dict[str, Column], ascending: bool = True) -> DataFrame:
    """``df`` with the running total, in order of ``col`` then ``tie``, of each of ``sums``."""
    order = [F.asc(col) if ascending else F.desc(col), F.asc(tie)]
    own, base = {k: own_name(k) for k in sums}, {k: own_name(k) for k in sums}
    ranged, part, _ = _ranges(df.select("*", *[c.alias(own[k]) for k, c in sums.items()]), order)
    per = _before(ranged.groupBy(part).agg(*[F.sum(own[k]).alias(base[k]) for k in sums]), part, list(base.values()))
    along = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(per, part).select(*df.columns, *[(F.sum(own[k]).over(along) + F.col(base[k])).alias(k) for k in sums])


def rank(df: DataFrame, col: str, tie: str, name: str, ascending: bool = True) -> DataFrame:
    """``df`` with the 0-based rank ``name`` under ``col``: one shuffle, by ranges; the place inside a range is counted as it is written."""
    ranged, part, place = _ranges(df, [F.asc(col) if ascending else F.desc(col), F.asc(tie)])
    size = own_name("size")
    per = _before(ranged.groupBy(part).agg(F.count("*").alias(size)), part, [size])
    return ranged.join(per, part).select(*df.columns, (F.col(place) + F.col(size)).alias(name))


def ranks(df: DataFrame, tie: str, measures: dict[str, tuple[str, bool]]) -> DataFrame:
    """A rank for each of ``measures``: name -> (column, ascending). ``tie`` is a key of ``df``.

    Each order deals out no more than its own column and the key; the ranks then meet by the key.
    """
    for name, (col, ascending) in measures.items():
        narrow = df.select(tie) if col == tie else df.select(tie, col)
        df = df.join(rank(narrow, col, tie, name, ascending).select(tie, name), tie)
    return df


def roc(df: DataFrame, score: str, truth: str, tie: str, ascending: bool = False) -> DataFrame:
    """``df`` with running true and false positives in order of the score, as counts and as shares of all."""
    is_true = F.when(F.col(truth), 1).otherwise(0).cast("long")
    totals = df.agg(F.sum(is_true).alias("t"), F.sum(1 - is_true).alias("f")).first()
    out = running(df, score, tie, {"tp": is_true, "fp": 1 - is_true}, ascending)
    return out.withColumn("coverage", F.col("tp") / max(1, totals.t or 0)).withColumn("errors", F.col("fp") / max(1, totals.f or 0))


def confusion_at(df: DataFrame, score: str, truth: str, cutoff: float) -> DataFrame:
    hit, true = F.col(score) > cutoff, F.col(truth)
    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    return df.agg(count(hit & true, "tp"), count(hit & ~true, "fp"), count(~hit & true, "fn"), count(~hit & ~true, "tn"))


def smooth(df: DataFrame, key: str, order_by: list[str], value: str, size: int, at: str = "start", ends: str = "raw", name: str = "smoothed") -> DataFrame:
    """Moving average of ``size`` rows set at the window's start or end; where the window isn't full: the raw value, the partial average, or no row ("drop")."""
    frame = (0, size - 1) if at == "start" else (1 - size, 0)
    over = Window.partitionBy(key).orderBy(*order_by).rowsBetween(*frame)
    full, mean = F.count(F.lit(1)).over(over) == size, F.avg(value).over(over)
    if ends == "drop":
        kept = own_name("full")
        return df.select("*", full.alias(kept), mean.alias(name)).filter(F.col(kept)).drop(kept)
    return df.withColumn(name, mean if ends == "partial" else F.when(full, mean).otherwise(F.col(value)))


def run_stats(df: DataFrame, key: str, order_by: list[str], run_of: str, value: str) -> DataFrame:
    """(key, run_of, first place, n, avg, min, max) of each run of equal neighbours."""
    along = Window.partitionBy(key).orderBy(*order_by)
    new = F.when(F.lag(run_of).over(along).eqNullSafe(F.col(run_of)) & (F.row_number().over(along) > 1), 0).otherwise(1)
    begins = own_name("new")
    marked = df.select(key, *order_by, run_of, value, new.alias(begins))
    marked = marked.select(key, run_of, value, F.sum(begins).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    return marked.groupBy(key, "run", run_of).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def histogram(df: DataFrame, value: str, per_unit: int) -> DataFrame:
    """(bin, n): values rounded to 1 / per_unit, halves away from zero."""
    from bitloom.functions.bits import round_away

    return df.groupBy((round_away(F.col(value), per_unit) + 0.0).alias("bin")).agg(F.count("*").alias("n"))


def fit_gauss(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def nest(df: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """One row per key with its rows as an array of structs, in field order."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def flatten_hits(df: DataFrame, name: str) -> DataFrame:
    """One row for each nested element, the parent's columns copied into it."""
    hit = own_name("hit")
    return df.select(*[c for c in df.columns if c != name], F.explode(name).alias(hit)).select("*", f"{hit}.*").drop(hit)


def repair_evalue(c: Column) -> Column:
    """"e-10" is written for 1e-10 in result files."""
    return F.when(c.startswith("e"), F.concat(F.lit("1"), c)).otherwise(c).cast("double")


def cutoff(df: DataFrame, by: str, tie: str, most: float | None = None, n: int | None = None) -> DataFrame:
    """The rows with ``by`` up to ``most``, or the first ``n`` of them in order."""
    if (most is None) == (n is None):
        raise ValueError("give either most or n")
    return df.filter(F.col(by) <= most) if n is None else df.orderBy(by, tie).limit(n)


def kept_range(df: DataFrame, value: str) -> DataFrame:
    """(n, first, last): how many rows a cutoff kept, and the range of their values."""
    return df.agg(F.count("*").alias("n"), F.min(value).alias("first"), F.max(value).alias("last"))


def pick_column(line: Column, number: int) -> Column:
    """Column ``number`` (from 0) of a line parted by white space; null where it has none."""
    parts = F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), "")
    return F.get(parts, F.lit(number))


def index_counts(df: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """How many there are of what is numbered from 0, as the highest number plus one: unlike a count, it includes what has no row."""
    return df.groupBy(*keys).agg(*[(F.max(c) + 1).alias(name) for name, c in columns.items()])


def log_sum(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): -log2 of the sum of 2 ** -value over the rows of a key.

    Sums are taken in strips of 256 bits, partially before the shuffle, then strips are put together relative to the first, so nothing underflows.
    """
    strip, part, low = own_name("strip"), own_name("sum"), own_name("low")
    strips = df.filter(F.col(value) < float("inf")).withColumn(strip, F.floor(F.col(value) / 256) * 256)
    strips = strips.groupBy(*keys, strip).agg(F.sum(F.pow(F.lit(2.0), F.col(strip) - F.col(value))).alias(part))
    first = strips.withColumn(low, F.min(strip).over(Window.partitionBy(*keys)))
    return first.groupBy(*keys, low).agg(F.sum(F.col(part) * F.pow(F.lit(2.0), F.col(low) - F.col(strip))).alias(part)).select(*keys, (F.col(low) - F.log2(part)).alias(name))


def crossings(df: DataFrame, key: str, order_by: list[str], value: str, cutoff: float) -> DataFrame:
    """The rows whose ``value`` is over the cutoff while that of the row ``before`` (its value is added) is not."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order_by))
    return df.withColumn("before", before).filter((F.col("before") <= cutoff) & (F.col(value) > cutoff))


def best_and_cheapest(df: DataFrame, keys: list[str], value: str, state: str, order: list[str]) -> DataFrame:
    """(keys, best, cheapest): the highest value, and the state with the lowest; of equal ones that which comes first in ``order``."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(state))
    return df.groupBy(*keys).agg(F.max(value).alias("best"), F.min(F.struct(value, place.alias("place"), state))[state].alias("cheapest"))


def positional_merge(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows of both sides that have the same place in their order; the right side may be shorter (its columns are then null)."""
    return rank(left, left_order, left_order, "place").join(rank(right, right_order, right_order, "place"), "place", "left")


def latest_lookup(left: DataFrame, right: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """Each left row with the last right row of its keys."""
    row = own_name("row")
    last = right.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in right.columns if c not in keys]), order_by).alias(row))
    return left.join(last, keys, "left").select(*left.columns, f"{row}.*")


def image_bins(df: DataFrame, row: str, col: str, scale: float, channels: list[str]) -> DataFrame:
    """(row_bin, col_bin, channels): the largest value of each channel in a bin, 0 to 255."""
    return df.groupBy(F.floor(F.col(row) * scale).alias("row_bin"), F.floor(F.col(col) * scale).alias("col_bin")).agg(*[F.max(c).alias(c) for c in channels])


def params_from_text(c: Column) -> Column:
    """``name=value`` pairs separated by commas or newlines, names in lower case, the last of a name wins."""
    pairs = F.filter(F.split(F.lower(c), r"[,\n]"), lambda x: x.contains("="))
    entry = lambda x: F.struct(F.trim(F.split_part(x, F.lit("="), F.lit(1))).alias("k"), F.trim(F.split_part(x, F.lit("="), F.lit(2))).cast("double").alias("v"))
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(_once(F.transform(pairs, entry), last))


def merge_params(a: Column, b: Column) -> Column:
    """Both maps; where both have a name the right one wins."""
    return _once(b, lambda kept: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(kept, k)), kept))


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once a row, however often its lambdas read it."""
    return F.transform(F.array(c), use)[0]
