"""Ranked lexical search: term-at-a-time with limited accumulators, over a term index that is cut by documents.

1. One pass over the texts counts the queries' terms in every document and writes an index: a row per document, with its length, its terms
   and how often it holds them, and a row per task with the statistics of what the task has read.
2. The statistics, added up, give every term its weight.
3. Each task takes batches of indexed documents, turns them into lists by term, and answers every query: its terms are taken rarest first; a
   document that a list names gets an accumulator; as soon as all terms to come, at their highest in this batch, can't reach the score of the
   k-th best document so far, no more accumulators are made, and the remaining lists only add to those that there are. So each accumulator ends with
   the exact score, and no document that belongs to the best is left out. The best of earlier batches go on to the next.
4. The best of each task meet in a ranking by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import materialize, slices_of_bytes, text_bytes

#: Characters between terms; everything else belongs to one.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Places of terms in the queries of one block: what tasks hold of the queries is bounded by it, and each block reads the texts once.
BLOCK_TERMS = 800_000

_byte = np.arange(256)
_is_term = (_byte >= 0x80) | (_byte >= 0x30) & (_byte <= 0x39) | (_byte >= 0x41) & (_byte <= 0x5A) | (_byte >= 0x61) & (_byte <= 0x7A)
_lower = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, in order, and the row that each is in; null has none."""
    data, at = text_bytes(texts)
    inside = _is_term[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = at[1:-1]  # a term ends with its text
    edge = cuts[(cuts > 0) & (cuts < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.concatenate([[0], np.cumsum(end - begin)])
    terms = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(_lower[data[inside]])])
    return terms, np.searchsorted(at, begin, "right") - 1


INDEX = "stat boolean, doc_id {}, docs long, n long, terms array<int>, counts array<int>"


def index(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """Rows (stat, doc_id, docs, n, terms, counts) for the given terms.

    A document's row has its number of terms n and what it holds of the given ones; documents without any aren't listed. A row with ``stat`` has
    the number of documents with a term, the number of terms, and for the given terms how many documents hold them, of one task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        holding, docs_seen, terms_seen, id_type = np.zeros(len(known), np.int64), 0, 0, None
        for batch in slices_of_bytes(batches, "text"):
            id_type = batch.schema.field("doc_id").type
            found, row = terms_of(batch.column("text"))
            n = np.bincount(row, minlength=batch.num_rows)
            docs_seen, terms_seen = docs_seen + int((n > 0).sum()), terms_seen + len(row)
            which = pc.index_in(found, value_set=known)
            hit = pc.is_valid(which).to_numpy(zero_copy_only=False)
            which = which.fill_null(0).to_numpy(zero_copy_only=False)[hit].astype(np.int64)
            cell, count = np.unique(row[hit] * len(known) + which, return_counts=True)
            term, doc = cell % max(1, len(known)), cell // max(1, len(known))
            holding += np.bincount(term, minlength=len(known))
            kept, sizes = np.unique(doc, return_counts=True)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            rows = len(kept)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, bool)), batch.column("doc_id").take(pa.array(kept)), pa.nulls(rows, pa.int64()), pa.array(n[kept]), lists(term, ends), lists(count, ends)], ["stat", "doc_id", "docs", "n", "terms", "counts"])
        if id_type is not None:
            held = np.flatnonzero(holding)
            ends = np.array([0, len(held)])
            yield pa.RecordBatch.from_arrays([pa.array([True]), pa.nulls(1, id_type), pa.array([docs_seen]), pa.array([terms_seen]), lists(held, ends), lists(holding[held], ends)], ["stat", "doc_id", "docs", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, INDEX.format(kind))


def weight(docs: int, holding: int) -> int:
    """The weight of a term that ``holding`` of ``docs`` documents hold."""
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


class Best:
    """The k best (score, doc) of a query so far, in order; equal scores by ascending id, rows without id last."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, object)

    def least(self) -> int:
        """What a further document has to reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = sorted(range(len(score)), key=lambda i: (-score[i], doc[i] is None, doc[i] if doc[i] is not None else 0))[: self.k]
        self.score, self.doc = score[order], doc[order]


def accumulate(query: list[tuple[int, int]], lists: dict[int, tuple[np.ndarray, np.ndarray, int]], size: int, best: Best) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a batch that may be among the best, and their exact scores.

    ``query``: (term, weight times its repeats), rarest first. ``lists``: documents that hold a term, in order, their factors, and the highest factor.
    """
    terms = [(w, *lists[t]) for t, w in query if w > 0 and t in lists]
    left = sum(w * top for w, _, _, top in terms)
    score = np.zeros(size, np.int64)
    least, at = best.least(), 0
    while at < len(terms) and left >= least:
        w, docs, factors, top = terms[at]
        score[docs] += w * factors
        left -= w * top
        at += 1
        if at < len(terms) and left >= least:  # the k-th partial score may forbid new accumulators
            made = score[score > 0]
            if len(made) >= best.k:
                least = max(least, int(np.partition(made, len(made) - best.k)[len(made) - best.k]))
    kept = np.flatnonzero(score)
    score = score[kept]
    for w, docs, factors, top in terms[at:]:
        # what can't come up to the best any more goes, too: its bound is below the score of k others
        if len(kept) > best.k:
            most = np.partition(score, len(score) - best.k)[len(score) - best.k]
            stays = score + left >= max(least, int(most))
            kept, score = kept[stays], score[stays]
        if len(kept) * 16 < len(docs):
            place = np.minimum(np.searchsorted(docs, kept), len(docs) - 1)
            hit = docs[place] == kept
            score[hit] += w * factors[place[hit]]
        else:
            dense = np.zeros(size, np.int64)
            dense[docs] = factors
            score += w * dense[kept]
        left -= w * top
    enough = score >= least
    return kept[enough], score[enough]


def _answer(indexed: DataFrame, queries: list[list[tuple[int, int]]], documents: int, length: int, k: int) -> DataFrame:
    """(i, doc_id, score): the best k of each task for query number i."""
    kind = indexed.schema["doc_id"].dataType.simpleString()
    shared = indexed.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = [Best(k) for _ in asked]
        types = None
        for batch in batches:
            types = batch.schema.field("doc_id").type
            if not batch.num_rows:
                continue
            column = batch.column("terms")
            ends = column.offsets.to_numpy()
            term, count = column.flatten().to_numpy(), batch.column("counts").flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            m = 75 + 25 * batch.column("n").to_numpy() * documents // length
            factor = 1_000_000_000 * count // (1000 * count + 12 * m[doc])
            order = np.argsort(term, kind="stable")  # by term, then by document
            term, doc, factor = term[order], doc[order], factor[order]
            starts = np.flatnonzero(np.diff(term, prepend=-1))
            tops = np.maximum.reduceat(factor, starts) if len(starts) else []
            lists = {int(term[a]): (doc[a:b], factor[a:b], int(top)) for a, b, top in zip(starts, [*starts[1:], len(term)], tops, strict=True)}
            ids = np.array(batch.column("doc_id").to_pylist(), object)
            for query, so_far in zip(asked, best, strict=True):
                found, score = accumulate(query, lists, batch.num_rows, so_far)
                if len(found):
                    if len(found) > k:  # of many, those that reach the k-th
                        enough = score >= np.partition(score, len(score) - k)[len(score) - k]
                        found, score = found[enough], score[enough]
                    so_far.add(score, ids[found])
        if types is not None:
            rows = [(i, d, int(s)) for i, b in enumerate(best) for s, d in zip(b.score, b.doc, strict=True)]
            if rows:
                i, d, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(d, types), pa.array(s, pa.int64())], ["i", "doc_id", "score"])

    return indexed.select("doc_id", "n", "terms", "counts").mapInArrow(run, f"i long, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. Texts count whole; a null or empty text has no terms, an
    item without known terms gets no rows, and so do empty tables. Equal scores go by ascending doc_id, a row without id last; each row is a document
    or an item of its own, so repeated rows are ranked side by side. Repeated item ids share one ranking key: items with the same id are told
    apart by their text, and equal ones answer once.
    """
    spark = docs.sparkSession
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.select("item_id", "text").distinct().select("item_id", F.xxhash64("text").alias("form"), F.regexp_extract_all(low, F.lit(TERM), F.lit(0)).alias("words"))
    asked = materialize(asked.filter(F.size("words") > 0), "search-items")
    item_type, kind = (x.schema[c].dataType.simpleString() for x, c in ((items, "item_id"), (docs, "doc_id")))
    places = asked.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = math.ceil(places / block_terms)
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {kind}, score long")
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64(F.lit(b"search"), "item_id", "form"), F.lit(blocks)) == b).collect()  # bounded by block_terms
        names = sorted({w for r in part for w in r.words})
        number = {w: i for i, w in enumerate(names)}
        indexed = materialize(index(docs, pa.array(names, pa.large_string())), "search-index")
        stats = indexed.filter("stat")
        documents, length = stats.agg(F.sum("docs"), F.sum("n")).first()
        if not documents:
            continue
        each = stats.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("t")).agg(F.sum("x.counts").alias("c"))
        holding = {r.t: r.c for r in each.collect()}  # one number for each term of the block
        weights = {t: weight(documents, c) for t, c in holding.items()}
        queries = []
        for r in part:
            repeats: dict[int, int] = {}
            for w in r.words:
                repeats[number[w]] = repeats.get(number[w], 0) + 1
            order = sorted((t for t in repeats if t in weights), key=lambda t: (holding[t], t))
            queries.append([(t, weights[t] * repeats[t]) for t in order])
        found = _answer(indexed.filter("not stat"), queries, documents, length, k)
        keys = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(part)], f"i long, item_id {item_type}")
        order = Window.partitionBy("i").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        out = out.union(ranked.join(F.broadcast(keys), "i").select("item_id", "rank", "doc_id", "score"))
    return out


def oracle(k: int = 20) -> str:
    """DuckDB SQL for :func:`search` of ``benchmark`` in ``documents``."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({low}, '{TERM}') AS w FROM documents),
    s AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d),
    p AS (SELECT doc_id, t, CAST(count(*) AS BIGINT) AS tf, CAST(n AS BIGINT) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
    f AS (SELECT t, CAST(count(*) AS BIGINT) AS df FROM p GROUP BY 1),
    q AS (SELECT item_id, t, CAST(count(*) AS BIGINT) AS r FROM (SELECT item_id, unnest(regexp_extract_all({low}, '{TERM}')) AS t FROM benchmark) GROUP BY ALL),
    x AS (SELECT item_id, doc_id, CAST(sum(r * CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
        FROM q JOIN f USING (t) JOIN p USING (t) CROSS JOIN s GROUP BY 1, 2),
    y AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM y WHERE rank <= {k}"""
