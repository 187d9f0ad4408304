"""Session settings that the operators are tuned for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str = "local[8]", app: str = "bitloom", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` overrides any setting (dots written as ``__``)."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names.

    Where that is unset, a local session (as in tests) gets a temporary one; on a cluster, whose executors couldn't see it, this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-bitloom-")
    return f"{base}/bitloom-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: later passes don't repeat its work, and lost executors don't undo it."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small(df: DataFrame, row_bytes: int, limit: int = 8 << 20) -> DataFrame:
    """``df``, to be broadcast if its rows, counted, at ``row_bytes`` each, stay below ``limit``; else unchanged."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
