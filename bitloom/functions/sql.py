"""Functions for SQL text: ``register(spark)`` makes them known to a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bitloom.operators import align


def register(spark: SparkSession) -> None:
    """``m_align(a, b)`` log odds in bits, ``sw_score(a, b)``, ``revcomp(s)``, and the table function ``kmers(s, k)``."""

    @F.pandas_udf("double")
    def m_align(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([align.m_align(x or "", y or "")["log_odds"] for x, y in zip(a, b, strict=True)])

    @F.pandas_udf("int")
    def sw_score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([align.sw_score(x or "", y or "") for x, y in zip(a, b, strict=True)])

    @F.udtf(returnType="pos int, kmer string")
    class Kmers:
        def eval(self, s: str, k: int) -> Iterator[tuple[int, str]]:
            for i in range(len(s or "") - k + 1):
                yield i, s[i : i + k]

    spark.udf.register("m_align", m_align)
    spark.udf.register("sw_score", sw_score)
    spark.udtf.register("kmers", Kmers)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION revcomp(s STRING) RETURNS STRING RETURN reverse(translate(s, 'acgtACGT', 'tgcaTGCA'))")
