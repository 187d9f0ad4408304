"""Registered queries of the aligner over windows, and with models and pair costs other than the standard ones."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.operators import align, places, repeats, windows
from bitloom.plans.catalog import MET_SQL, ORACLE_SQL, TA_RICH, met_pairs, query, recurrence_sql, seqs, written_out
from bitloom.session import shared_folder, written
from bitloom.sources import files

KEYS = ["item_id", "doc_id"]
#: Chances of a letter of the first sequence (row) where the second has another (column), as a table that a user might bring (fixed values of the queries).
TABLE = np.array([[0.85, 0.03, 0.09, 0.04], [0.04, 0.82, 0.03, 0.08], [0.08, 0.04, 0.84, 0.05], [0.03, 0.11, 0.04, 0.83]])


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pairs that meet, and the sequences of both sides that are in one."""
    a, b = seqs(spark, sf_dir, "benchmark", "item_id"), written(seqs(spark, sf_dir).filter("seq <> ''"))  # read several times
    met = written(repeats.met_pairs(a, b, "item_id", "doc_id", 20).distinct())
    return met, a.join(met.select("item_id").distinct(), "item_id"), b.join(met.select("doc_id").distinct(), "doc_id")


def _all_windows(spark, sf_dir, **options) -> DataFrame:
    """All windows of the pairs; they hand their cells on, so tiles have no overlap."""
    met, a, b = _sides(spark, sf_dir)
    one, other = (written(places.pieces(d, key, windows.TILE, 0, **options)) for d, key in ((a, "item_id"), (b, "doc_id")))
    return windows.windows(windows.all_tiles(met, one, other, *KEYS), one, other, *KEYS)


def _window_odds(name: str, total: bool) -> None:
    """All tiles of a pair: the same odds as the full recurrence, which is what SQL computes."""

    @query(ORACLE_SQL[f"align_odds_local_{name}_3"], f"align_window_{name}")
    def run(spark, sf_dir):
        return windows.window_odds(_all_windows(spark, sf_dir), KEYS, total).withColumn("log_odds", F.round("log_odds", 4))


_window_odds("sum", True)
_window_odds("best", False)


@query()
def m_align_window_sum(spark, sf_dir):
    """Re-estimated log odds over the windows near seeds."""
    met, a, b = _sides(spark, sf_dir)
    out = windows.align_long(met, a, b, *KEYS)
    return out.select(*KEYS, *[F.round(c, 4).alias(c) for c in ("log_odds", "enc_null", "enc_align", "enc_model", *(f"p_{c}" for c in windows.COUNTS), *(f"n_{c}" for c in windows.COUNTS))], "rounds", (F.col("log_odds") > 0).alias("related"))


#: What a pair of letters costs under chances by place: ``sub`` has those of the first sequence, a place after another, then those of the second.
_CELL = f"""(CASE WHEN a[i] = b[d + 1 - i] THEN {1 + align.PAIR['match']} - log2(1 / sub[4 * (i - 1) + a[i] + 1] + 1 / sub[4 * n + 4 * (d - i) + b[d + 1 - i] + 1])
    ELSE {1 + align.PAIR['change']} - log2(1 / (1 - sub[4 * (i - 1) + b[d + 1 - i] + 1]) + 1 / (1 - sub[4 * n + 4 * (d - i) + a[i] + 1])) END)"""
_PLACED = written_out(recurrence_sql(align.AFFINE, True, True, _CELL))
_BLEND_P = f"list_transform(range(4), lambda s: (pow(2, -m0) * 0.25 + pow(2, -m1) * CASE WHEN i = 0 THEN 0.25 ELSE rich[4 * q[i] + s + 1] END) / (pow(2, -m0) + pow(2, -m1)))"


def _placed_sql(before: str, sub: str) -> str:
    return f"WITH RECURSIVE {MET_SQL}, {before}, ready AS (SELECT *, {sub} AS sub FROM coded), {_PLACED} SELECT item_id, doc_id, round(best, 4) AS log_odds FROM done"


_PHASES = """
    letter AS (SELECT instr('acgt', substr(seq, CAST(pos AS INTEGER), 1)) AS s, CAST((pos - 1) % 3 AS INTEGER) AS phase FROM (SELECT seq, unnest(generate_series(1, length(seq))) AS pos FROM seqs)),
    freq AS (SELECT phase, s, count(*) AS c FROM letter GROUP BY ALL), grid AS (SELECT phase, s FROM range(3) t(phase), range(1, 5) u(s)),
    chance AS (SELECT list((coalesce(c, 0) + 1) / (total + 4) ORDER BY phase, s) AS p FROM (SELECT phase, s, c, sum(coalesce(c, 0)) OVER (PARTITION BY phase) AS total FROM grid LEFT JOIN freq USING (phase, s)))"""


@query(_placed_sql(_PHASES, "(SELECT list_concat(list_transform(range(4 * n), lambda k: p[(k // 4 % 3) * 4 + k % 4 + 1]), list_transform(range(4 * m), lambda k: p[(k // 4 % 3) * 4 + k % 4 + 1])) FROM chance)"))
def align_odds_file_chances(spark, sf_dir):
    """Chances that files give for each place, read back and checked: here those of a letter by its place modulo 3, over all documents."""
    met, a, b = _sides(spark, sf_dir)
    letters = seqs(spark, sf_dir).select(F.posexplode(F.split("seq", "")).alias("pos", "s")).filter("s <> ''")
    count = [F.count(F.when(F.col("s") == c, 1)).alias(c) for c in "acgt"]
    phases = letters.groupBy((F.col("pos") % 3).alias("phase")).agg(*count)
    p = phases.select("phase", F.array(*[(F.col(c) + 1) / (sum(map(F.col, "acgt"), F.lit(4))) for c in "acgt"]).alias("p"))
    p = spark.range(3).select(F.col("id").cast("int").alias("phase")).join(p, "phase", "left").select("phase", F.coalesce("p", F.array(*[F.lit(0.25)] * 4)).alias("p"))
    p, folder = F.broadcast(p), shared_folder(spark)  # three rows

    def table(df: DataFrame, key: str) -> DataFrame:
        by_place = df.filter("seq <> ''").select(key, F.posexplode(F.split("seq", "")).alias("pos", "s")).filter("s <> ''")
        files.write_probs(by_place.withColumn("phase", F.col("pos") % 3).join(p, "phase"), f"{folder}/{key}", key)
        got = files.read_probs(spark, f"{folder}/{key}")
        return got.select(F.col("seq").try_cast("long").alias(key), "pos", "p")

    one, other = (written(places.pieces_of_table(d, table(d, key), key, windows.TILE, 0)) for d, key in ((a, "item_id"), (b, "doc_id")))
    wide = windows.windows(windows.all_tiles(met, one, other, *KEYS), one, other, *KEYS)
    return windows.window_odds(wide, KEYS).withColumn("log_odds", F.round("log_odds", 4))


def _ta_rich() -> np.ndarray:
    return np.array([[TA_RICH[a + b] for b in "acgt"] for a in "acgt"])


_rich = "[" + ", ".join(str(x) for x in _ta_rich().ravel()) + "]"
_BLENDED = f"""
    side AS (SELECT 0 AS side, item_id AS id, seq FROM items WHERE item_id IN (SELECT item_id FROM met) UNION ALL SELECT 1, doc_id, seq FROM seqs WHERE doc_id IN (SELECT doc_id FROM met)),
    walk AS (
        SELECT side, id, list_transform(string_split(seq, ''), lambda c: instr('acgt', c) - 1) AS q, length(seq) AS len, {_rich} AS rich, 0 AS i, CAST(1 AS DOUBLE) AS m0, CAST(1 AS DOUBLE) AS m1 FROM side
        UNION ALL SELECT side, id, q, len, rich, i + 1, (m0 + 2) / 1.5, (m1 + CASE WHEN i = 0 THEN 2 ELSE -log2(rich[4 * q[i] + q[i + 1] + 1]) END) / 1.5 FROM walk WHERE i + 1 < len),
    placed AS (SELECT side, id, flatten(list({_BLEND_P} ORDER BY i)) AS p FROM walk GROUP BY ALL)"""


@query(_placed_sql(_BLENDED, "list_concat((SELECT p FROM placed x WHERE x.side = 0 AND x.id = item_id), (SELECT p FROM placed x WHERE x.side = 1 AND x.id = doc_id))"))
def align_odds_blend(spark, sf_dir):
    """Both population models blend a uniform one with one that prefers TA and AT, weighed by what each has cost of late. Tasks make the chances from the letters: a row has only these."""
    mixed = {"mixed": lambda size, order: places.Blend([places.Adaptive(size, -1), places.Fixed(_ta_rich())])}
    return align.odds_of_pairs(met_pairs(spark, sf_dir), model="mixed", models=mixed).select(*KEYS, F.round("log_odds", 4).alias("log_odds"))


_TABLE_SUB = "[" + ", ".join(str(-math.log2(x)) for x in TABLE.ravel()) + "]"


@query(f"WITH RECURSIVE {MET_SQL}, ready AS (SELECT *, list_transform({_TABLE_SUB}, lambda x, k: x + log2(pa[(k - 1) // 4 + 1])) AS sub FROM coded), {written_out(recurrence_sql(align.AFFINE, True, True))} SELECT item_id, doc_id, round(best, 4) AS log_odds FROM done")
def align_odds_pair_table(spark, sf_dir):
    """Pairs of letters cost what a table of chances says, whatever letters they are, in place of match and change."""
    return align.odds_of_pairs(met_pairs(spark, sf_dir), table=TABLE).withColumn("log_odds", F.round("log_odds", 4))


@query()
def m_align_pair_table(spark, sf_dir):
    """The same with the table, and the gap costs, re-estimated for each pair."""
    out = align.score_pairs(met_pairs(spark, sf_dir), table=TABLE)
    return out.select(*KEYS, F.round("log_odds", 4).alias("log_odds"), "rounds", *[F.round(F.col("params")[f"{a}|{b}"], 4).alias(f"{a}_{b}") for a in "acgt" for b in "acgt"])
