"""Helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are separated by the six ASCII white-space characters, and by these only.
SPACES = r"[\x20\x09-\x0D]+"

#: A table is broadcast only if its measured size stays below this many bytes.
BROADCAST_BYTES = 8 << 20

_own_dirs: dict[str, str] = {}


def words_of(text: Column) -> Column:
    """The words of a text, in order; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once; a plain reference inside a lambda would be evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a local session (as in tests) gets a temporary folder; on a cluster, whose executors couldn't see it, this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dirs.setdefault(app, "") or tempfile.mkdtemp(prefix="spark-bitloom-")
        _own_dirs[app] = base
    return f"{base}/bitloom-{app}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back.

    This cuts the lineage, survives lost executors, and gives the optimizer the true size.
    """
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables. Whatever was made of them must be materialized itself by then."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: texts become Python objects a slice at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def slices_of_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, whose texts in ``column`` have no more than ``most`` bytes together; a longer text is a batch alone."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (null: empty) as one array, and the bounds of each text in it."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and the bounds between which each of them lies, of batches that come sorted by the integer column ``key``.

    No more is held than a batch and the group that it cuts.
    """
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        keys = table.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if len(cuts):
            yield table.slice(0, cuts[-1]).combine_chunks(), np.concatenate([[0], cuts])
            table = table.slice(cuts[-1])
        held = table
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows, at ``row_bytes`` each, stay below ``limit``; else unchanged."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def hash_sample(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """About ``rows`` rows of ``df``, or all if it has no more: those whose hashed ``key`` is small, the same in every run."""
    count = df.count()
    if count <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * rows / count))


def numbered(docs: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """``docs`` with a column ``name`` that tells all rows apart: ``key``, where that is set and no other row has it.

    Rows that share a key, and those without one, get numbers above all keys, so that each of them is judged by itself, after the others.
    """
    odd = docs.groupBy(key).agg(F.count("*").alias("c")).filter(f"c > 1 or {key} is null").select(F.col(key).alias(name))
    odd = materialize(odd, "odd-ids")
    if odd.isEmpty():
        return docs.withColumn(name, F.col(key))
    top = docs.agg(F.max(key)).first()[0] or 0
    odd = broadcast_if_small(odd, 32)
    match = F.col(key).eqNullSafe(F.col(name))
    rest = docs.join(odd, match, "left_semi").withColumn(name, F.monotonically_increasing_id() + F.lit(top + 1))
    return docs.join(odd, match, "left_anti").withColumn(name, F.col(key)).union(materialize(rest, "odd-rows"))
