"""Fill-in-the-middle by displacement scatter: texts become prefix, suffix and middle with marks, in a new order.

The bytes of many texts lie in one array. A scan finds the places where a text may be cut. A piece moves as a whole, so the shift of its
bytes is one number; a difference array over the pieces' first bytes, summed up, gives the shift of every byte, and one scatter writes all outputs
of the batch. Restoring is the inverse: the marks are found in the outputs, shifts summed up in the same way, and one gather reads the texts back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.llm.common import slices_of_bytes, text_bytes

#: The marks before prefix, suffix and middle; a text that holds one of them stays plain.
MARKS = (b"<P>", b"<S>", b"<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers: the first 8-digit groups of the hex sha256 of ``seed:doc_id`` (null: no digits)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def marks_in(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, kind) of all marks that lie inside one text."""
    first = np.flatnonzero((data[:-2] == MARKS[0][0]) & (data[2:] == MARKS[0][2])) if len(data) > 2 else np.zeros(0, np.int64)
    kind = np.full(len(first), -1)
    for k, mark in enumerate(MARKS):
        kind[data[first + 1] == mark[1]] = k
    inside = (kind >= 0) & (first + 3 <= bounds[np.searchsorted(bounds, first, "right")])
    return first[inside], kind[inside]


def _shifts(size: int, starts: list[np.ndarray], moves: list[np.ndarray]) -> np.ndarray:
    """The shift of each byte, out of pieces that follow each other: where each starts, and how far it moves. Empty pieces cancel out."""
    at, by = np.stack(starts, 1).ravel(), np.stack(moves, 1).ravel()
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, at, np.diff(by, prepend=0))
    return np.cumsum(change[:-1])


def ends_of_units(data: np.ndarray, unit: str) -> np.ndarray:
    """The places after which a text may be cut: line ends, or ends of code points."""
    return np.flatnonzero(data == 10) + 1 if unit == "line" else np.append(np.flatnonzero((data[1:] & 0xC0) != 0x80) + 1, len(data))


def scatter(data: np.ndarray, bounds: np.ndarray, draw: list[np.ndarray], rate: int, spm: int, unit: str) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Columns n, moved, swapped, prefix_chars, middle_chars, then the bytes of the outputs and their bounds."""
    start, end = bounds[:-1], bounds[1:]
    units = ends_of_units(data, unit)
    low, high = np.searchsorted(units, start, "right"), np.searchsorted(units, end, "right")
    last_is_open = (end > start) & ((high == low) | (units[np.maximum(high - 1, 0)] < end if len(units) else True))
    n = high - low + last_is_open
    h1, h2, h3, h4 = draw
    one, two = h1 % (n + 1), h2 % (n + 1)

    def cut(k: np.ndarray) -> np.ndarray:
        """The byte after k units of each text."""
        place = units[np.minimum(low + np.maximum(k, 1) - 1, len(units) - 1)] if len(units) else end
        return np.where(k == 0, start, np.where(k > high - low, end, place))

    p, m = cut(np.minimum(one, two)), cut(np.maximum(one, two))
    marked = np.zeros(len(n), bool)
    marked[np.searchsorted(bounds, marks_in(data, bounds)[0], "right") - 1] = True
    moved = (end > start) & ~marked & (h3 % 100 < rate)
    swapped = moved & (h4 % 100 < spm)
    new_bounds = bounds + np.concatenate([[0], np.cumsum(9 * moved)])
    own = new_bounds[:-1]
    prefix, middle, suffix = p - start, m - p, end - m
    to_prefix = own + np.where(swapped, 6 + suffix, np.where(moved, 3, 0))
    to_suffix = own + np.where(swapped, 3, np.where(moved, 6 + prefix, prefix + middle))
    to_middle = own + np.where(moved, 9 + prefix + suffix, prefix)
    shift = _shifts(len(data), [start, p, m], [to_prefix - start, to_middle - p, to_suffix - m])
    out = np.empty(new_bounds[-1], np.uint8)
    out[np.arange(len(data)) + shift] = data
    for mark, to in zip(MARKS, (to_prefix, to_suffix, to_middle), strict=True):
        for i, byte in enumerate(mark):
            out[to[moved] - 3 + i] = byte
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    columns = {"n": n, "moved": moved, "swapped": swapped, "prefix_chars": points[p] - points[start], "middle_chars": points[m] - points[p]}
    return columns, out, new_bounds


def gather(data: np.ndarray, bounds: np.ndarray, moved: np.ndarray, swapped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts, and their bounds, that outputs of :func:`scatter` were made of."""
    place, kind = marks_in(data, bounds)
    where = np.searchsorted(bounds, place, "right") - 1
    of = where[moved[where]]
    if len(of) and np.any(np.bincount(of, minlength=len(moved))[moved] != 3):
        raise ValueError("an output of form psm or spm has three marks")
    at = np.zeros((3, len(moved)), np.int64)
    at[kind[moved[where]], of] = place[moved[where]]
    own, end = bounds[:-1], bounds[1:]
    from_prefix, from_suffix, from_middle = (np.where(moved, x + 3, own) for x in at)
    prefix = np.where(moved, np.where(swapped, at[2], at[1]) - from_prefix, end - own)
    suffix = np.where(moved, np.where(swapped, at[0], at[2]) - from_suffix, 0)
    middle = np.where(moved, end - from_middle, 0)
    text_bounds = np.concatenate([[0], np.cumsum(prefix + middle + suffix)])
    start = text_bounds[:-1]
    shift = _shifts(int(text_bounds[-1]), [start, start + prefix, start + prefix + middle], [from_prefix - start, from_middle - start - prefix, from_suffix - start - prefix - middle])
    return data[np.arange(len(shift)) + shift], text_bounds


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row of ``docs`` (doc_id, text).

    ``rate`` of 100 texts are cut at two places between units (``line``, or ``char`` for code points), ``spm`` of 100 of them with the suffix first; the
    seeded hash of doc_id decides, so equal rows give equal outputs. A null text counts as empty; empty texts, and texts that hold one of the
    marks, stay plain, with null counts. Texts are whole, however long. Other columns are ignored, rows are kept as often as they are
    there, and an empty table gives an empty one.
    """
    given = docs.select("doc_id", "text", *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of_bytes(batches, "text"):
            data, bounds = text_bytes(batch.column("text"))
            got, out, new_bounds = scatter(data, bounds, [batch.column(f"h{i}").to_numpy() for i in range(4)], rate, spm, unit)
            form = np.where(got["swapped"], SPM, np.where(got["moved"], PSM, PLAIN))
            counts = [pa.array(got[c], pa.int64(), mask=~got["moved"]) for c in ("prefix_chars", "middle_chars")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got["n"], pa.int64()), pa.array(form), *counts, _strings(out, new_bounds)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame) -> DataFrame:
    """``outputs`` with one more column, ``restored``: the text that output and form stand for. A null output counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of_bytes(batches, "output"):
            data, bounds = text_bytes(batch.column("output"))
            form = batch.column("form").to_numpy(zero_copy_only=False)
            text, text_bounds = gather(data, bounds, (form == PSM) | (form == SPM), form == SPM)
            yield pa.RecordBatch.from_arrays([*batch.columns, _strings(text, text_bounds)], [*batch.schema.names, "restored"])

    return outputs.mapInArrow(run, T.StructType([*outputs.schema.fields, T.StructField("restored", T.StringType())]))


def digests(docs: DataFrame, **options) -> DataFrame:
    """:func:`transform` and :func:`restore`, with sha256 digests in place of the texts."""
    both = restore(transform(docs, **options))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def oracle() -> str:
    """DuckDB SQL for :func:`digests` of ``documents`` as registered."""
    holds = " OR ".join(f"contains(t, '{m.decode()}')" for m in MARKS)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    u AS (SELECT *, string_split(t, chr(10)) AS parts, CAST(length(t) - length(replace(t, chr(10), '')) + CAST(t <> '' AND NOT ends_with(t, chr(10)) AS INTEGER) AS BIGINT) AS n,
        CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR {holds} OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
    x AS (SELECT *, least(length(t), coalesce(list_sum(list_transform(parts[1:a], lambda s: length(s) + 1)), 0)) AS p, least(length(t), coalesce(list_sum(list_transform(parts[1:b], lambda s: length(s) + 1)), 0)) AS m FROM c),
    y AS (SELECT *, substr(t, 1, CAST(p AS BIGINT)) AS pre, substr(t, CAST(p AS BIGINT) + 1, CAST(m - p AS BIGINT)) AS mid, substr(t, CAST(m AS BIGINT) + 1) AS suf FROM x)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(p AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(m - p AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM y"""
