"""Isotonic regression from pooled blocks that can be merged.

Adjacent values that violate the order are pooled.  Pooling a part of the values first
changes nothing in the end, so each range of the scores is pooled in its own task, and
the blocks of neighbouring ranges are pooled together, level by level, until one list
is left.  Labels are 0 or 1 or weights between them; equal scores are one value from
the start.  Of n binary labels at most some n ** (2/3) blocks of different means can
stand in a row, which is what the last level and the driver hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import in_ranges
from ..functions.shared import written

#: Neighbouring lists of blocks that are merged in one task of a level.
FAN_IN = 8
_BLOCK = "part long, low double, high double, total double, n double"


def pooled(low: np.ndarray, high: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks in the order of their scores, of which a next one of no greater mean is pooled with the one before it."""
    lows, highs, totals, counts = [], [], [], []
    for a, b, t, c in zip(low.tolist(), high.tolist(), total.tolist(), n.tolist()):
        while totals and totals[-1] * c >= t * counts[-1]:
            a = lows.pop()
            highs.pop()
            t, c = t + totals.pop(), c + counts.pop()
        lows.append(a)
        highs.append(b)
        totals.append(t)
        counts.append(c)
    return tuple(np.array(v, float) for v in (lows, highs, totals, counts))


def _pool_parts(blocks: DataFrame, fan_in: int) -> DataFrame:
    """Blocks pooled together by part // ``fan_in``."""

    def run(key, table):
        t = table.to_pandas().sort_values("low", kind="stable")
        out = pooled(*(t[c].to_numpy(float) for c in ("low", "high", "total", "n")))
        return pa.table([pa.array(np.full(len(out[0]), key[0].as_py(), np.int64)), *map(pa.array, out)], names=["part", "low", "high", "total", "n"])

    return blocks.withColumn("_to", F.floor(F.col("part") / fan_in).cast("long")).groupBy("_to").applyInArrow(run, _BLOCK)


def isotonic_blocks(train: DataFrame, *, ranges: int | None = None) -> DataFrame:
    """low, high, value of the blocks of the isotonic fit of y on score, in the order of the scores; rows without either
    don't count, and an empty table has no blocks."""
    values = train.where(F.col("score").isNotNull() & F.col("y").isNotNull() & ~F.isnan(F.col("score").cast("double")))
    values = values.groupBy(F.col("score").cast("double").alias("low")).agg(F.sum(F.col("y").cast("double")).alias("total"), F.count("*").cast("double").alias("n"))
    marked = in_ranges(values, [], [F.col("low")], ranges)
    blocks = marked.select(F.col("_part").cast("long").alias("part"), "low", F.col("low").alias("high"), "total", "n")
    parts = blocks.agg(F.max("part").alias("m")).first().m
    blocks, fan_in = written(_pool_parts(blocks, 1), "isotonic-blocks"), FAN_IN
    while parts:
        blocks = written(_pool_parts(blocks, fan_in), "isotonic-blocks")
        parts //= fan_in
    return blocks.select("low", "high", (F.col("total") / F.col("n")).alias("value"))


def calibrated(train: DataFrame, df: DataFrame, *, ranges: int | None = None) -> DataFrame:
    """``df`` with ``score`` replaced by its isotonic fit on ``train`` (y, score), within 0..1: the block's value, between two
    blocks what lies on the line from one to the other, and beyond the ends that of the outer ones.

    Scores that are null or NaN, and all scores if ``train`` has no rows, become null; rows and other columns stay."""
    found = isotonic_blocks(train, ranges=ranges).orderBy("low").collect()
    # Either end of a block, once where they are one.
    x = np.array([v for r in found for v in ((r.low,) if r.low == r.high else (r.low, r.high))], float)
    y = np.clip([v for r in found for v in ((r.value,) if r.low == r.high else (r.value, r.value))], 0.0, 1.0)
    shared = df.sparkSession.sparkContext.broadcast((x, y))

    @F.pandas_udf("double")
    def fitted(score):
        x, y = shared.value
        return score.where(score.isna(), np.interp(score, x, y)) if len(x) else score * np.nan

    new = fitted(F.col("score").cast("double"))
    return df.withColumn("score", F.when(F.isnan(new), None).otherwise(new)).select(*df.columns)
