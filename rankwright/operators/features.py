"""Feature statistics and filters on the long view (id, feature, value) and on small correlation matrices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ledger import guarded_corr
from ..functions.ranges import quantiles
from ..functions.shared import written


def long_view(df: DataFrame, vector: str, *carry: str, prefix: str = "var_") -> DataFrame:
    """carry, feature, value of an array column."""
    return df.select(*carry, F.posexplode(vector).alias("_p", "value")).select(*carry, F.concat(F.lit(prefix), F.col("_p").cast("string")).alias("feature"), F.col("value").cast("double").alias("value"))


def variance_filter(long: DataFrame, *, least: float = 0.01) -> DataFrame:
    """feature, variance of those whose population variance is above ``least``."""
    return long.groupBy("feature").agg(F.var_pop("value").alias("variance")).where(F.col("variance") > least)


def standardised(long: DataFrame) -> DataFrame:
    """id, feature, value as z-score by the population spread; a constant feature is only centred."""
    stats = long.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return long.join(F.broadcast(stats), "feature").select("id", "feature", ((F.col("value") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).alias("value"))


def robust_scaled(long: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """id, feature, value centred by the median and scaled by the interquartile range of ``train``."""
    stats = quantiles(long if train is None else train, "feature", "value", (0.25, 0.5, 0.75))
    spread = F.col("q")[2] - F.col("q")[0]
    return long.join(F.broadcast(stats), "feature").select("id", "feature", ((F.col("value") - F.col("q")[1]) / F.when(spread > 0, spread).otherwise(1.0)).alias("value"))


def quantile_thresholds(train: DataFrame, *, at: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """feature, quantile, threshold."""
    cuts = quantiles(train, "feature", "value", at)
    rows = F.arrays_zip(F.array(*map(F.lit, at)).alias("quantile"), F.col("q").alias("threshold"))
    return cuts.select("feature", F.explode(rows).alias("r")).select("feature", "r.quantile", "r.threshold")


def binarised(long: DataFrame, thresholds: DataFrame) -> DataFrame:
    """id, feature, quantile, value: 1 where the value reaches the training threshold."""
    return long.join(F.broadcast(thresholds), "feature").select("id", "feature", "quantile", F.when(F.col("value") >= F.col("threshold"), 1).otherwise(0).alias("value"))


def shift_report(train: DataFrame, test: DataFrame) -> DataFrame:
    """Means, spreads, the standardised mean difference, and the share of test rows outside the training p1..p99."""
    ends = written(quantiles(train, "feature", "value", (0.01, 0.99)), "shift-ends")
    a = train.groupBy("feature").agg(F.avg("value").alias("train_mean"), F.stddev_pop("value").alias("train_std"))
    inside = F.broadcast(ends)
    b = test.join(inside, "feature").groupBy("feature").agg(
        F.avg("value").alias("test_mean"), F.stddev_pop("value").alias("test_std"),
        F.avg(F.when((F.col("value") < F.col("q")[0]) | (F.col("value") > F.col("q")[1]), 1.0).otherwise(0.0)).alias("outside_share"),
    )
    pooled = F.sqrt((F.col("train_std") * F.col("train_std") + F.col("test_std") * F.col("test_std")) / 2)
    j = a.join(b, "feature")
    return j.withColumn("smd", F.abs(F.col("test_mean") - F.col("train_mean")) / F.greatest(pooled, F.lit(1e-12)))


def gram(df: DataFrame, vector: str, size: int) -> DataFrame:
    """a, b, n, sa, sb, saa, sbb, sab for all places a <= b of an array column: what correlations are made of.

    Tasks add up whole blocks of rows as matrices, so that a row for each pair and task is moved, whatever the number
    of rows.  Values are taken from the first row's, against loss of digits; pairs in which one is null, NaN or
    missing don't count.
    """
    first = df.select(vector).where(F.size(vector) >= size).first()
    origin = np.nan_to_num(np.array([np.nan if v is None else v for v in first[0][:size]], float)) if first else np.zeros(size)
    a, b = np.triu_indices(size)

    def add(batches):
        n, one, two, sab = (np.zeros((size, size)) for _ in range(4))
        for batch in batches:
            column = batch.column(0)
            if not len(column):
                continue
            offsets, values = np.asarray(column.offsets), column.values.to_numpy(zero_copy_only=False)
            lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.minimum(np.diff(offsets), size))
            x = np.full((len(column), size), np.nan)
            there = np.arange(size) < lengths[:, None]
            x[there] = values[(offsets[:-1, None] + np.arange(size))[there]]
            x -= origin
            known = ~np.isnan(x)
            x, seen = np.where(known, x, 0.0), known.astype(float)
            n += seen.T @ seen
            one += x.T @ seen
            two += (x * x).T @ seen
            sab += x.T @ x
        parts = [a, b, n[a, b].astype(np.int64), one[a, b], one[b, a], two[a, b], two[b, a], sab[a, b]]
        yield pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, (pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 5))], names=["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"])

    parts = df.select(F.transform(vector, lambda v: v.cast("double")).alias("v")).mapInArrow(add, "a int, b int, n long, sa double, sb double, saa double, sbb double, sab double")
    return parts.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")))


def correlations(df: DataFrame, vector: str, size: int) -> DataFrame:
    """a, b, corr for all places a <= b; null where one of the two is constant."""
    spread = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / F.col("n")
    both = spread("sa", "saa") * spread("sb", "sbb")
    return gram(df, vector, size).select("a", "b", F.when(both > 0, (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(both)).alias("corr"))


def correlated_pairs(df: DataFrame, vector: str, *, size: int, least: float) -> DataFrame:
    """a, b, corr with a < b of all pairs of the array's places whose absolute correlation reaches ``least``."""
    return correlations(df, vector, size).where((F.col("a") < F.col("b")) & (F.abs("corr") >= least))


def correlation_matrix(df: DataFrame, vector: str, places: Sequence[int]) -> np.ndarray:
    """Pearson matrix of the array's ``places`` (their number squared comes to the driver); NaN for constant ones."""
    narrow = df.select(F.array(*(F.get(vector, F.lit(p)) for p in places)).alias("v"))
    out = np.full((len(places), len(places)), np.nan)
    for r in correlations(narrow, "v", len(places)).collect():
        if r.corr is not None:
            out[r.a, r.b] = out[r.b, r.a] = r.corr
    return out


def best_univariate_feature(df: DataFrame, vector: str = "features") -> DataFrame:
    """feature, abs_corr: the feature of the greatest absolute correlation with the label; ties by name."""
    long = long_view(df, vector, "y")
    corr = long.groupBy("feature").agg(F.coalesce(F.abs(guarded_corr("value", "y")), F.lit(0.0)).alias("abs_corr"))
    return corr.orderBy(F.desc("abs_corr"), "feature").limit(1)


def cluster_set_summary(report: DataFrame) -> DataFrame:
    """One row for each feature_set of a report by cluster (feature_set, cluster, n, rate): its clusters, the least and
    greatest size and rate."""
    return report.groupBy("feature_set").agg(F.count("*").alias("clusters"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"))


def prune_correlated(features: Sequence[str], corr: np.ndarray, strength: dict[str, float], *, least: float = 0.85) -> list[str]:
    """Of each pair that correlates, in column order, the weaker feature goes, unless one is gone already."""
    gone: set[str] = set()
    for i, a in enumerate(features):
        for j in range(i + 1, len(features)):
            b = features[j]
            if a not in gone and b not in gone and abs(corr[i, j]) >= least:
                gone.add(a if strength[a] < strength[b] else b)
    return [f for f in features if f not in gone]


def independent_columns(corr: np.ndarray, *, least: float = 1e-9) -> list[int]:
    """Places of a largest set of columns of which none is a combination of the others, in the order in which a pivoted
    Cholesky factorisation takes them: each time the one of which those before explain least."""
    n = len(corr)
    left = np.diag(corr).astype(float).copy()
    factor = np.zeros((n, n))
    chosen: list[int] = []
    while len(chosen) < n:
        p = int(left.argmax())
        if left[p] <= least:
            break
        k = len(chosen)
        factor[:, k] = (corr[:, p] - factor[:, :k] @ factor[p, :k]) / np.sqrt(left[p])
        left = left - factor[:, k] ** 2
        chosen.append(p)
        left[chosen] = 0.0
    return chosen


def variance_inflation(corr: np.ndarray, *, least: float = 1e-9) -> np.ndarray:
    """Variance inflation 1 / (1 - R2) of each feature when regressed on all others, from their correlation matrix.

    It is NaN for a constant feature (NaN in the matrix), which the others are regressed without, and infinite for one
    of which the others explain all but ``least``; such features leave the values of the others as they are.
    """
    n = len(corr)
    out = np.full(n, np.nan)
    known = np.flatnonzero(~np.isnan(np.diag(corr)))
    if not len(known):
        return out
    own = np.nan_to_num(corr[np.ix_(known, known)])
    base = independent_columns(own, least=least)
    rest = [k for k in range(len(known)) if k not in set(base)]
    inverse = np.linalg.inv(own[np.ix_(base, base)])
    values = np.full(len(known), np.inf)
    # One that takes part in the combination that makes up another column is itself a combination of the others.
    bound = np.abs(inverse @ own[np.ix_(base, rest)]).max(1, initial=0.0) > np.sqrt(least)
    values[base] = np.where(bound, np.inf, np.diag(inverse))
    out[known] = values
    return out


def prune_inflated(features: Sequence[str], corr: np.ndarray, *, most: float = 5.0) -> list[str]:
    """All features above the bound go at once, as one look at the table decides; constant ones have no value and stay."""
    return [f for f, v in zip(features, variance_inflation(corr)) if not v > most]


def inflation_report(df: DataFrame, vector: str, size: int, *, most: float = 5.0) -> DataFrame:
    """place, inflation (null for a constant column, and where the others explain a column wholly), dependent, kept: the
    verdict on each place of an array column.  The Gram matrix, of the number of places squared, comes to the driver."""
    values = variance_inflation(correlation_matrix(df, vector, range(size)))
    rows = [(k, float(v) if np.isfinite(v) else None, bool(np.isinf(v)), not bool(v > most)) for k, v in enumerate(values)]
    return df.sparkSession.createDataFrame(rows, "place int, inflation double, dependent boolean, kept boolean")


def class_weight(df: DataFrame, *, multiplier: float = 1.0) -> DataFrame:
    """Negatives over positives, times ``multiplier``; 1 if there are no positives."""
    pos, neg = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    return df.agg(F.when(pos > 0, neg / pos.cast("double") * multiplier).otherwise(1.0).alias("scale_pos_weight"))


def cluster_profile(df: DataFrame) -> DataFrame:
    """cluster, n, pos, neg, rate, lift against the rate of all rows."""
    whole = df.agg(F.avg(F.col("y").cast("double")).alias("base"))
    per = df.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    j = per.join(F.broadcast(whole)).withColumn("rate", F.col("pos") / F.col("n").cast("double"))
    return j.select("cluster", "n", "pos", "neg", "rate", F.coalesce(F.try_divide(F.col("rate"), F.col("base")), F.lit(0.0)).alias("lift"))


def cluster_summary(profile: DataFrame) -> DataFrame:
    return profile.agg(
        F.min("n").alias("min_size"), F.max("n").alias("max_size"), (F.max("n") / F.min("n").cast("double")).alias("imbalance"), F.max("rate").alias("max_rate"), F.min("rate").alias("min_rate"), F.max("lift").alias("max_lift")
    )


def spline_basis(value: np.ndarray, knots: np.ndarray, degree: int = 3) -> np.ndarray:
    """B-spline basis over clamped-uniform knots, without its first column, by the recurrence of de Boor and Cox."""
    step = knots[1] - knots[0] or 1.0
    grid = np.concatenate([knots[0] - step * np.arange(degree, 0, -1), knots, knots[-1] + step * np.arange(1, degree + 1)])
    x = np.clip(value, knots[0], knots[-1] - 1e-12 * step)[:, None]
    basis = ((x >= grid[:-1]) & (x < grid[1:])).astype(float)
    for d in range(1, degree + 1):
        left = (x - grid[: -d - 1]) / (grid[d:-1] - grid[: -d - 1])
        right = (grid[d + 1 :] - x) / (grid[d + 1 :] - grid[1:-d])
        basis = left * basis[:, :-1] + right * basis[:, 1:]
    return basis[:, 1:]


def collapse_basis(coefficients: np.ndarray, features: int) -> np.ndarray:
    """Sum of absolute coefficients of each source feature."""
    size = len(coefficients) // features * features
    return np.abs(coefficients[:size]).reshape(features, -1).sum(1)
