"""Word-shingle sets, hashed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import let, words_of


def shingle_set(text: Column, size: int) -> Column:
    """Sorted distinct 64-bit hashes of a text's ``size``-word shingles (A-Z in lower case).

    Fewer words make the whole sequence one shingle; null and empty texts have the empty set.
    """
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def windows(w: Column) -> Column:
        heads = F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0)))
        many = F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) == 0, none).when(F.size(w) < size, F.array(F.xxhash64(F.lit("short"), F.array_join(w, " ")))).otherwise(F.array_distinct(many))

    return F.sort_array(let(words_of(low), windows))


def with_sets(docs: DataFrame, size: int, *more: str) -> DataFrame:
    """doc_id, the columns ``more``, and the shingle set ``s``."""
    return docs.select("doc_id", *more, shingle_set(F.col("text"), size).alias("s"))
