"""Rows of Parquet tables by where they stand: which file, and which row of it.

A set of such places is written in blocks of a file's rows, and a task asks only for
the blocks of the rows it reads.  So rows are picked out of a table, or left out of
it, where they are: neither the table nor the set is moved to meet the other, however
large either is.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, whole_row, written

#: Rows of a file that make a block, and places that a bucket of blocks holds about.
BLOCK_ROWS, BUCKET_PLACES = 1_000_000, 200_000
#: The most buckets, and how many blocks a worker remembers.
MOST_BUCKETS, REMEMBERED = 65_536, 8


def is_located(docs: DataFrame) -> bool:
    """Whether the rows of a table have places: it is a Parquet table as it is, so that no row stands in it twice."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return False
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018  analysed here
        return True
    except AnalysisException:
        return False  # not Parquet: rows have no numbers


def located(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` if its rows have places, else a written copy of it."""
    return docs if is_located(docs) else written(docs, name)


def place() -> tuple[Column, Column]:
    """file and row of the rows of a located table."""
    return F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")


class RowSet:
    """The places (file, row) in ``rows``, written; ``holds`` says of a row whether its place is among them."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        rows = rows.select("file", "row")
        self.size = rows.count()
        self.buckets = max(1, min(MOST_BUCKETS, self.size // BUCKET_PLACES))
        self.folder = shared_folder(spark, "row-set")
        block = F.floor(F.col("row") / BLOCK_ROWS)
        marked = rows.withColumn("bucket", F.pmod(F.xxhash64("file", block.cast("long")), F.lit(self.buckets)).cast("int"))
        marked.repartition(max(1, min(self.buckets, 2000)), "bucket").sortWithinPartitions("bucket", "file", "row").write.partitionBy("bucket").parquet(self.folder)

    def holds(self, file: Column, row: Column) -> Column:
        if not self.size:
            return F.lit(False)
        folder = self.folder
        known: OrderedDict[tuple, np.ndarray] = OrderedDict()

        def rows_of(fs, path: str, bucket: int, name: str, block: int) -> np.ndarray:
            key = bucket, name, block
            if key not in known:
                found = []
                for info in fs.get_file_info(pafs.FileSelector(f"{path}/bucket={bucket}", allow_not_found=True)):
                    if info.base_name.endswith(".parquet"):
                        part = pq.ParquetFile(fs.open_input_file(info.path)).read(columns=["file", "row"]).to_pandas()
                        found.append(part.loc[part["file"] == name, "row"].to_numpy())
                rows = np.concatenate(found) if found else np.zeros(0, np.int64)
                known[key] = np.sort(rows[rows // BLOCK_ROWS == block])
                while len(known) > REMEMBERED:
                    known.popitem(last=False)
            known.move_to_end(key)
            return known[key]

        @F.pandas_udf("boolean")
        def member(file: pd.Series, row: pd.Series, bucket: pd.Series) -> pd.Series:
            out = np.zeros(len(row), bool)
            if len(row):
                fs, path = pafs.FileSystem.from_uri(folder)
                where = pd.DataFrame({"bucket": bucket.to_numpy(), "file": file.to_numpy(), "block": row.to_numpy() // BLOCK_ROWS, "row": row.to_numpy()})
                for (b, name, block), part in where.groupby(["bucket", "file", "block"], sort=False):
                    out[part.index] = np.isin(part["row"].to_numpy(), rows_of(fs, path, int(b), name, int(block)))
            return pd.Series(out)

        block = F.floor(row / BLOCK_ROWS).cast("long")
        return member(file, row, F.pmod(F.xxhash64(file, block), F.lit(self.buckets)).cast("int"))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` (located) without the rows whose places (file, row) are in ``gone``."""
    rows = docs.select(whole_row(docs), *place())
    return rows.where(~RowSet(gone).holds(F.col("file"), F.col("row"))).select("_row.*")
