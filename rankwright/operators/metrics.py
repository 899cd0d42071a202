"""Ranking metrics over all rows, from counts by distinct score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import running_totals


def score_counts(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives of every distinct score: ties meet before any order is needed."""
    return df.groupBy(*groups, F.col("score").cast("double").alias("score")).agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))


def _cumulated(df: DataFrame, groups: Sequence[str], descending: bool) -> DataFrame:
    return running_totals(score_counts(df, groups), "score", ["pos", "neg"], groups=groups, descending=descending)


def roc_auc(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counting half; null if a class is missing."""
    c = _cumulated(df, groups, descending=False)
    won = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg")) + F.col("pos") * F.col("neg") / F.lit(2.0))
    return c.groupBy(*groups).agg(F.try_divide(won, (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"))


def average_precision(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Sum over distinct thresholds of the recall gained there times the precision there; null without positives."""
    c = _cumulated(df, groups, descending=True)
    part = F.sum(F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")).cast("double")))
    return c.groupBy(*groups).agg(F.try_divide(part, F.sum("pos").cast("double")).alias("average_precision"))
