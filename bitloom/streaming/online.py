"""Online scoring: each symbol's cost is known as soon as it arrives, state is kept per sequence and survives restarts."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bits(stream: DataFrame, key: str, order_by: list[str], sym: str, alphabet: list[str], order: int = 1) -> DataFrame:
    """``stream`` as (key, order columns, sym, bits, cum) under an adaptive model of each sequence.

    The state of a sequence is its last ``order`` symbols, its counts and its sum. Within a batch symbols are taken in ``order_by``;
    over batches in order of arrival.
    """
    fields = {f.name: f.dataType.simpleString() for f in stream.schema}
    cols = [key, *order_by, sym]
    size = len(alphabet)

    def update(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, counts, cum = json.loads(state.get[0]) if state.exists else ([], {}, 0.0)
        rows = pd.concat(parts).sort_values(order_by)
        bits, sums = [], []
        for s in rows[sym]:
            cost = math.log2(size)
            if len(past) >= order:
                c = counts.setdefault("\x1f".join(past[len(past) - order :]), {})
                cost = -math.log2((1 + c.get(s, 0)) / (size + sum(c.values())))
                c[s] = c.get(s, 0) + 1
            past = [*past, s][-order:] if order else []
            cum += cost
            bits.append(cost)
            sums.append(cum)
        state.update((json.dumps([past, counts, cum]),))
        yield rows[cols].assign(bits=bits, cum=sums)

    schema = ", ".join(f"{c} {fields[c]}" for c in cols) + ", bits double, cum double"
    return stream.select(*cols).groupBy(key).applyInPandasWithState(update, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def follow_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the text files in a folder as they are added."""
    return spark.readStream.text(path)


def write(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """A started query that appends Parquet; with ``every`` (such as "500 milliseconds") it runs on, else it ends when all input is read.

    Started again on the same checkpoint it goes on where it stopped, and a batch that was written isn't written twice.
    """
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


class View:
    """A table that keeps the newest row of each key of a stream, in a folder that all executors share.

    A batch writes its own newest rows to ``new/batch=<id>``, over what an earlier try of the same batch left; every ``merge_every`` batches the view so far is
    written to ``all/batch=<id>``. What a batch costs follows its own rows, and on average a ``merge_every``-th of the view. Readers take the last
    whole ``all`` and the whole batches after it, and keep one row of each key, so neither a lost run nor a batch that is done twice shows.
    Files that readers may still hold aren't deleted.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order_by: list[str], merge_every: int = 20) -> None:
        """``order_by`` tells which of two rows of a key is newer (nulls are oldest); of rows that are equal in it the greatest as a whole is kept, so that results
        don't depend on how rows fell into batches."""
        self.spark, self.path, self.keys, self.order_by, self.merge_every = spark, path, keys, order_by, merge_every

    def newest(self, df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in self.keys and c not in self.order_by]
        rows = df.groupBy(*self.keys).agg(F.max(F.struct(*self.order_by, *rest)).alias("__row"))
        return rows.select(*[F.col(c) if c in self.keys else F.col("__row")[c].alias(c) for c in df.columns])

    def _batches(self, kind: str) -> list[int]:
        """Numbers of the batches that are whole: those with the mark that Spark leaves last."""
        jvm = self.spark._jvm
        marks = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/batch=*/_SUCCESS")
        found = marks.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(marks)
        return sorted(int(f.getPath().getParent().getName().removeprefix("batch=")) for f in found or [])

    def read(self) -> DataFrame | None:
        """The view; None before the first batch."""
        return self._after(self._batches("all"), self._batches("new"))

    def _after(self, merged: list[int], new: list[int]) -> DataFrame | None:
        paths = [f"{self.path}/all/batch={b}" for b in merged[-1:]] + [f"{self.path}/new/batch={b}" for b in new if not merged or b > merged[-1]]
        return self.newest(self.spark.read.parquet(*paths)) if paths else None

    def _put(self, batch: DataFrame, number: int) -> None:
        self.newest(batch).write.mode("overwrite").parquet(f"{self.path}/new/batch={number}")
        if (number + 1) % self.merge_every == 0:
            merged, new = ([b for b in self._batches(kind) if b < number + at] for kind, at in (("all", 0), ("new", 1)))
            self._after(merged, new).write.mode("overwrite").parquet(f"{self.path}/all/batch={number}")

    def follow(self, stream: DataFrame, checkpoint: str, every: str | None = None):
        """A started query that keeps the view up to date; as :func:`write`, it runs on with ``every``, else it ends with its input."""
        w = stream.writeStream.foreachBatch(self._put).option("checkpointLocation", checkpoint)
        return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
