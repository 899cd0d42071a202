"""Scoring of prediction files as they arrive.

The engine's tables are batch tables; this is an extension for predictions that
are still being written.  New rows are appended to a table partitioned by their
context, and the scores of the contexts that changed are computed anew from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import inner_scores, ok_rows


def absorb_predictions(spark: SparkSession, inbox: str, schema: str, folder: str, *, cap: int = 1000, files_per_batch: int = 100) -> None:
    """Take in all files of ``inbox`` that are new since the last call.

    A batch writes its rows under its own number, so one that is run again replaces itself; scores
    of a context are replaced as a whole.
    """

    def batch(rows: DataFrame, number: int) -> None:
        ok = ok_rows(rows).withColumn("batch", F.lit(number))
        ok.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "outer_fold", "round_name").parquet(f"{folder}/predictions")
        changed = ok.select("outer_fold", "round_name").distinct()
        known = spark.read.parquet(f"{folder}/predictions")
        scores = inner_scores(known.join(F.broadcast(changed), ["outer_fold", "round_name"], "left_semi").drop("batch"), cap=cap)
        scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("outer_fold", "round_name").parquet(f"{folder}/scores")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(inbox)
    stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
