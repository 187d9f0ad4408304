"""Mixture-controlled packing into fixed-length training sequences.

Each source is a queue of documents. A window of ``window`` tokens takes from each queue its quota, the target
share of the window; what a share leaves as a fraction of a token is its deficit and is carried to the next
window, so after any number of windows every source is within one token of its target. A window is a sequence, so each sequence holds the mixture, to a token
for each source. Larger windows cut documents less often. In closed form a
queue with share p has given ``floor(p * window * j)`` tokens after window j. So the place of any token
follows from its place in its queue alone: there is no serial pass, and deficits carry over between
partitions as over windows. The windows' tokens, one after another, are cut into sequences; only the last
sequence of all is padded.

The default targets are the sources' shares of all tokens, so all queues end together. With other targets a
queue that runs out leaves its share to the rest, in a new phase of windows.

A source is cut into buckets of bounded size by hash, sums over buckets give each bucket's place in its
queue, and one shuffle by bucket gives each document its own, so a source with a third of all rows spreads over
many tasks. Equal rows are interchangeable, null texts count as empty, null sources as the source '', null ids stay null, a text longer than
a sequence fills as many as it needs, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import materialize, slices

SEQUENCE = 2048
#: Tokens of a window over which the mixture holds: every sequence is one.
WINDOW = SEQUENCE
#: The id that ends each document.
END_ID = 1
#: Tokens of a bucket, about.
BUCKET = 1 << 22

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of texts as the tokenizer file gives them.

    Where the same vocabulary lies beside it as byte ranks, those encode (the ids are the same and come several times as
    fast); texts with a special token's mark, and files without ranks, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        self.path, self.whole, self.fast = path, None, None
        ranks = path.removesuffix(".json") + ".tiktoken"
        try:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        except (ImportError, OSError):
            pass

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or "<|" in text:
            if self.whole is None:  # loaded where it is needed, since it takes much memory
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def tokenize(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, n (tokens with the end id) and ids (little-endian, 16 bits each where they fit, else 32) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for batch in slices(batches):
            ids, n = [], []
            for text in batch.column("text").to_pylist():
                x = np.array([*encode(text or ""), END_ID], "<u4")
                ids.append((x.astype("<u2") if x.max() < 1 << 16 else x).tobytes())
                n.append(len(x))
            n = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), n, pa.array(ids, pa.binary())], ["doc_id", "source", "n", "ids"])

    source = F.coalesce("source", F.lit("")) if "source" in docs.columns else F.lit("")
    return docs.select("doc_id", source.alias("source"), "text").mapInArrow(run, "doc_id long, source string, n long, ids binary")


class Schedule:
    """Which place in the packed stream a place in a queue has."""

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None, window: int):
        self.window = window
        self.names = sorted(k for k, v in totals.items() if v)
        left = {k: totals[k] for k in self.names}
        want = {k: Fraction(totals[k] if targets is None else max(0.0, targets.get(k, 0.0))).limit_denominator(10**15) for k in self.names}
        given, begin = dict.fromkeys(self.names, 0), 0
        #: Of each phase: place in the stream, share of each source, tokens given before, and tokens of each in it.
        self.phases = []
        while any(left.values()):
            active = [k for k in self.names if left[k]]
            if not any(want[k] for k in active):
                want |= {k: Fraction(left[k]) for k in active}
            active = [k for k in active if want[k]]
            whole = sum(want[k] for k in active)
            share = {k: want[k] / whole for k in active}
            span = min(left[k] / share[k] for k in active)
            take = {k: min(left[k], -(-(share[k] * span).numerator // (share[k] * span).denominator)) for k in active}
            self.phases.append((begin, [(k, share[k], given[k], take[k]) for k in active]))
            for k in active:
                given[k] += take[k]
                left[k] -= take[k]
            begin += sum(take.values())
        self.starts = {k: [(p[2], i) for i, (_, part) in enumerate(self.phases) for p in part if p[0] == k] for k in self.names}

    def _given(self, share: Fraction, take: int, j: int) -> int:
        return min(take, j * self.window * share.numerator // share.denominator)

    def runs(self, source: str, first: int, n: int) -> Iterator[tuple[int, int]]:
        """(place in the stream, length) of the runs that tokens first.. of a queue fall into."""
        while n:
            starts = self.starts[source]
            _, i = starts[bisect_right(starts, (first, len(self.phases))) - 1]
            begin, part = self.phases[i]
            share, before, take = next(p[1:] for p in part if p[0] == source)
            at = first - before
            j = at * share.denominator // (self.window * share.numerator)
            while self._given(share, take, j + 1) <= at and self._given(share, take, j + 1) < take:
                j += 1
            while self._given(share, take, j) > at:
                j -= 1
            low, high = self._given(share, take, j), self._given(share, take, j + 1)
            place = begin + sum(self._given(s, t, j + 1 if k < source else j) for k, s, _, t in part)
            length = min(n, high - at)
            yield place + at - low, length
            first, n = first + length, n - length


def pack(docs: DataFrame, tokenizer: str | None = None, targets: dict[str, float] | None = None, window: int = WINDOW, sequence: int = SEQUENCE, bucket: int = BUCKET) -> DataFrame:
    """One row per piece; ``targets`` maps sources to weights (sources left out come last).

    The number of sources is taken to be small enough for a list of their totals.
    """
    tokens = materialize(tokenize(docs, tokenizer or default_tokenizer()), "packing-tokens")
    totals = {r.source: r.n for r in tokens.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    plan = Schedule(totals, targets, window)
    parts = 1 + max(totals.values(), default=0) // bucket
    sized = F.lit(1)
    for name, n in totals.items():
        sized = F.when(F.col("source") == name, 1 + n // bucket).otherwise(sized) if 1 + n // bucket > 1 else sized
    dealt = tokens.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.crc32("ids")), sized.cast("long"))) if parts > 1 else tokens.withColumn("bucket", F.lit(0).cast("long"))
    # Sums over buckets (one small row each) give where each bucket begins in its queue.
    sums = dealt.groupBy("source", "bucket").agg(F.sum("n").alias("n"))
    begins = sums.select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("begin"))
    order = Window.partitionBy("source", "bucket").orderBy("doc_id", "n", F.crc32("ids"))
    placed = dealt.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    placed = placed.join(begins, ["source", "bucket"]).select("doc_id", "source", "n", "ids", (F.col("begin") + F.col("before")).alias("first"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, source, n, ids, first in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                start = 0
                ids = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                for place, length in plan.runs(source, first, n):
                    while length:
                        seq, offset = divmod(place, sequence)
                        size = min(length, sequence - offset)
                        rows.append((doc_id, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, seq, offset, source))
                        start, place, length = start + size, place + size, length - size
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 7 else pa.int64()) for i, c in enumerate(cols)], [f.split()[0] for f in PIECES.split(", ")])

    return placed.mapInArrow(cut, PIECES)
