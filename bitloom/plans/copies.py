"""Registered queries of the approximate-repeat compressor over benchmark sequences and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.operators import align, compress
from bitloom.plans.catalog import query, seqs

_P = {k: 2.0**-v for k, v in {**align.PAIR, **align.AFFINE, **compress.COSTS}.items()}
ITEMS = "items AS (SELECT item_id, regexp_replace(lower(coalesce(text, '')), '[^acgt]', '', 'g') AS seq FROM benchmark)"


def _copy_sql(given: str) -> str:
    """The compressor with a forward and a reverse machine of three states, all places live, as a recursive query: a row for each sequence and symbol.

    ``given``: a query of item_id, seq and skip, the number of symbols that are known beforehand.
    """
    places = lambda x: f"list_transform(range(n), lambda j: {x})"
    live = lambda x, top="i": f"CASE WHEN j <= {top} THEN {x} ELSE 0.0 END"
    begun = ", ".join(f"{places(f'd{m}[j + 1] + CASE WHEN j < i THEN base * {_P["start"] / 2} / (i + 1) ELSE 0.0 END')} AS e{m}" for m in "fr")
    source = {"f": "q[j + 1]", "r": "3 - q[j + 1]"}
    into = ", ".join(f"{places(f'(e{m}[j + 1] * {_P["diag_fromD"]} + (h{m}[j + 1] + v{m}[j + 1]) * {_P["diag_fromI"]}) * CASE WHEN {source[m]} = q[i + 1] THEN {_P["match"]} ELSE {_P["change"] / 3} END')} AS t{m}" for m in "fr")
    moved = {"f": live("CASE WHEN j > 0 THEN tf[j] ELSE 0.0 END"), "r": live("CASE WHEN j + 1 < n THEN tr[j + 2] ELSE 0.0 END")}
    step = ", ".join(f"{places(moved[m])} AS nd{m}, {places(f'(e{m}[j + 1] * {_P["start_fromD"]} + h{m}[j + 1] * {_P["cont_fromI"]} + v{m}[j + 1] * {_P["start_fromI"]}) / 4')} AS nh{m}" for m in "fr")
    gain = ", ".join(f"{places(f'nd{m}[j + 1] * {_P["start_fromD"]} + nh{m}[j + 1] * {_P["start_fromI"]}')} AS g{m}" for m in "fr")
    ci = _P["cont_fromI"]
    skipped = {"f": f"list_sum(list_transform(range(j), lambda k: gf[k + 1] * pow({ci}, j - k - 1)))", "r": f"list_sum(list_transform(range(j + 1, n), lambda k: gr[k + 1] * pow({ci}, k - j - 1)))"}
    skip = ", ".join(f"{places(live(f'coalesce({skipped[m]}, 0.0)'))} AS nv{m}" for m in "fr")
    total = " + ".join(f"list_sum({x}{m})" for m in "fr" for x in ("nd", "nh", "nv"))
    kept = ", ".join(f"list_transform(n{x}{m}, lambda w: w * {_P['cont']}) AS {x}{m}" for m in "fr" for x in "dhv")
    zero = ", ".join(f"{places('CAST(0 AS DOUBLE)')} AS {x}{m}" for m in "fr" for x in "dhv")
    names = ", ".join(f"{x}{m}" for m in "fr" for x in "dhv")
    seen = "len(list_filter(q[1:i], lambda c: c = q[i + 1]))"
    return f"""
    given AS ({given}),
    ready AS (SELECT item_id, skip, length(seq) AS n, list_transform(string_split(seq, ''), lambda c: instr('acgt', c) - 1) AS q FROM given WHERE seq <> ''),
    walk AS (
        SELECT item_id, skip, n, q, 0 AS i, CAST(1 AS DOUBLE) AS base, CAST(1 AS DOUBLE) AS before, CAST(0 AS DOUBLE) AS bits, {zero} FROM ready
        UNION ALL
        SELECT item_id, skip, n, q, i + 1, alone + total * {_P['end']}, alone + total * {_P['cont']}, bits + CASE WHEN i >= skip THEN log2(before / (alone + total * {_P['cont']})) ELSE 0 END, {kept}
        FROM (SELECT *, {total} AS total, base * CASE WHEN i > 0 THEN {_P['nostart']} ELSE 1 END * ({seen} + 1) / (i + 4) AS alone
        FROM (SELECT *, {skip} FROM (SELECT *, {gain} FROM (SELECT *, {step} FROM (SELECT *, {into} FROM (SELECT *, {begun} FROM walk WHERE i < n))))))),
    done AS (SELECT item_id, n - skip AS length, bits FROM walk WHERE i = n)"""


@query(f"WITH RECURSIVE {ITEMS}, {_copy_sql('SELECT item_id, seq, 0 AS skip FROM items')} SELECT item_id, CAST(length(seq) AS BIGINT) AS length, round(coalesce(bits, 0), 4) AS bits FROM items LEFT JOIN done USING (item_id)")
def repeat_compress_items(spark, sf_dir):
    """Each item, with forward and reverse copies from anywhere in its past."""
    out = compress.compress(seqs(spark, sf_dir, "benchmark", "item_id"), "item_id")
    return out.select("item_id", "length", F.round("bits", 4).alias("bits"))


_PREVIOUS = "SELECT i.item_id, coalesce(p.seq, '') || i.seq AS seq, length(coalesce(p.seq, '')) AS skip FROM items i LEFT JOIN items p ON p.item_id = i.item_id - 1"


def _with_previous(spark, sf_dir):
    items = seqs(spark, sf_dir, "benchmark", "item_id")
    before = items.select((F.col("item_id") + 1).alias("item_id"), F.col("seq").alias("pre"))
    return items.join(before, "item_id", "left")


@query(f"WITH RECURSIVE {ITEMS}, {_copy_sql(_PREVIOUS)} SELECT item_id, CAST(length(seq) AS BIGINT) AS length, round(CASE WHEN seq = '' THEN 0 ELSE coalesce(bits, 0) END, 4) AS bits FROM items LEFT JOIN done USING (item_id)")
def conditional_compress_items(spark, sf_dir):
    """Each item, the one before it being known."""
    out = compress.compress(_with_previous(spark, sf_dir), "item_id", prefix="pre")
    return out.select("item_id", "length", F.round("bits", 4).alias("bits"))


@query()
def compress_passes_items(spark, sf_dir):
    """Each item, with forward machines of one and three states and a reverse one; parameters are estimated anew until a pass gains nothing."""
    out = compress.compress(seqs(spark, sf_dir, "benchmark", "item_id"), "item_id", forward=("1state", "3state"), passes=0)
    return out.withColumn("bits", F.round("bits", 3))


@query()
def seeded_compress_items(spark, sf_dir):
    """Each item after the one before it, copies only around places where the next eight letters have occurred."""
    out = compress.compress(_with_previous(spark, sf_dir), "item_id", prefix="pre", seed=8)
    return out.withColumn("bits", F.round("bits", 4))


@query()
def match_map_items(spark, sf_dir):
    """Where the letters of each item come from: shares of source places, the largest within squares of eight."""
    out = compress.match_map(seqs(spark, sf_dir, "benchmark", "item_id"), "item_id", bins=8, least=0.01)
    return out.withColumn("share", F.round("share", 5))
