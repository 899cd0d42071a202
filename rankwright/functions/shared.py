"""The folder that the driver and all executors share, tables written there, and joins on keys of uneven weight."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it is known to hold at most this many bytes.
BROADCAST_BYTES = 8 << 20


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where that is unset, a temporary folder if the session runs in this one process,
    else an error: what executors wrote to their own disks, nobody else could read."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (master {master})")
        root = getattr(spark, "_rankwright_shared", None)
        if root is None:
            root = spark._rankwright_shared = "file://" + tempfile.mkdtemp(prefix="rankwright-")
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/rankwright/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only for a counted side whose bytes stay under BROADCAST_BYTES."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
