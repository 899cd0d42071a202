"""Ranked cumulative curves and what is read off them.

Input is one row for each scored row: ``id``, ``y`` (0 or 1), ``score``, and any
grouping columns.  Rows are ranked by score, then id, both from high to low.
Without groups the best ``cap`` rows are taken by a top-k before any window, so
that the window runs over ``cap`` rows and not over the table.  In groups Spark
limits each task's rows to the best ``cap`` of a group before they are shuffled; a
larger ``cap`` than that works for is first taken from hashed parts of each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ledger import BREAK_EVEN, FEATURE_COST, HIT_VALUE, MAX_TARGETS, MISS_COST, best_first, profit, ratio, require_columns
from ..functions.ranges import placed

#: Largest cap that Spark pushes below the shuffle of a grouped window, and the parts a group is cut into beyond it.
GROUP_LIMIT, SALTS = 1000, 64


def join_groups(rows: DataFrame, sides: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``rows`` with what ``sides`` says of their group.  One row is broadcast; of groups, whose number may grow with
    the table, Spark decides by their size."""
    return rows.join(sides, list(groups)) if groups else rows.join(F.broadcast(sides))


def ranked(df: DataFrame, groups: Sequence[str] = (), cap: int | None = None) -> DataFrame:
    """``df`` with ``k``, the rank from 1 on; only ranks up to ``cap`` if given."""
    require_columns(df, ["id", "score", *groups])
    if cap is None:
        return placed(df, groups, best_first())
    if not groups:
        df = df.orderBy(*best_first()).limit(cap)
    elif cap > GROUP_LIMIT:
        part = F.pmod(F.xxhash64("id"), F.lit(SALTS))
        df = df.withColumn("_k", F.row_number().over(Window.partitionBy(*groups, part).orderBy(*best_first()))).where(F.col("_k") <= cap).drop("_k")
    return df.withColumn("k", F.row_number().over(Window.partitionBy(*groups).orderBy(*best_first()))).where(F.col("k") <= cap)


def ranked_curve(df: DataFrame, groups: Sequence[str] = (), *, cap: int = MAX_TARGETS, zero: bool = False) -> DataFrame:
    """groups, k, tp, fp, threshold for every k up to ``cap``; with ``zero`` also k = 0, whose threshold is null."""
    up_to = Window.partitionBy(*groups).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    top = ranked(df, groups, cap)
    curve = top.select(
        *groups,
        F.col("k").cast("long").alias("k"),
        F.sum(F.col("y").cast("long")).over(up_to).alias("tp"),
        F.sum(1 - F.col("y").cast("long")).over(up_to).alias("fp"),
        F.col("score").cast("double").alias("threshold"),
    )
    if not zero:
        return curve
    none = df.select(*groups).distinct() if groups else df.sparkSession.range(1).select()
    start = none.select(*groups, F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(None).cast("double").alias("threshold"))
    return curve.unionByName(start)


def profit_curve(df: DataFrame, groups: Sequence[str] = (), *, features: int, cap: int = MAX_TARGETS, zero: bool = False) -> DataFrame:
    curve = ranked_curve(df, groups, cap=cap, zero=zero)
    return curve.withColumn("business_score", profit(F.col("tp"), F.col("fp"), features).cast("long"))


def best_point(curve: DataFrame, groups: Sequence[str] = (), score: str = "business_score") -> DataFrame:
    """The row of the highest ``score``; of equal ones the smallest k."""
    rest = [c for c in curve.columns if c not in groups]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col("k"))).alias("_best")
    return curve.groupBy(*groups).agg(best).select(*groups, "_best.*")


def break_even_k(df: DataFrame, groups: Sequence[str] = (), *, cap: int = MAX_TARGETS, least: float = BREAK_EVEN, floor: float | None = None) -> DataFrame:
    """How many rows score at least ``least`` (and ``floor``), up to ``cap``: ranked rows that pass are a prefix."""
    bound = least if floor is None else max(least, floor)
    return df.groupBy(*groups).agg(F.least(F.count_if(F.col("score") >= bound), F.lit(cap)).cast("long").alias("breakeven_k"))


def effective_point(df: DataFrame, groups: Sequence[str] = (), *, features: int, cap: int = MAX_TARGETS, least: float = BREAK_EVEN) -> DataFrame:
    """profit_k, breakeven_k, effective_k (the smaller, or profit_k if no row breaks even), score and threshold there."""
    curve = profit_curve(df, groups, features=features, cap=cap)
    best = best_point(curve, groups).select(*groups, F.col("k").alias("profit_k"))
    even = break_even_k(df, groups, cap=cap, least=least)
    both = best.join(even, list(groups)) if groups else best.join(F.broadcast(even))
    chosen = F.when(F.col("breakeven_k") > 0, F.least("profit_k", "breakeven_k")).otherwise(F.col("profit_k"))
    both = both.withColumn("effective_k", chosen)
    on = [curve["k"] == both["effective_k"], *(curve[g] == both[g] for g in groups)]
    joined = both.join(curve, on)
    return joined.select(*(both[g] for g in groups), "profit_k", "breakeven_k", "effective_k", "tp", "fp", "business_score", "threshold")


def capped_best(df: DataFrame, groups: Sequence[str] = (), *, features: int, cap: int = MAX_TARGETS) -> DataFrame:
    """Best k from 0 on, without the break-even rule."""
    return best_point(profit_curve(df, groups, features=features, cap=cap, zero=True), groups)


def scaled_curve(
    df: DataFrame, groups: Sequence[str] = (), *, features: int, cap: int = MAX_TARGETS, reference_rows: int = 1000,
    feature_cost: float = FEATURE_COST, hit: float = HIT_VALUE, miss: float = MISS_COST,
) -> DataFrame:
    """Profit all of whose values, of hits, misses and features, are scaled by the number of rows over ``reference_rows``.

    gross is the scaled value before features, scaled_score what is left after their scaled price and
    unscaled_cost_score after their whole price; k = 0 stands alone where ``cap`` is 0.
    """
    if reference_rows <= 0:
        raise ValueError("reference_rows must be positive")
    sizes = df.groupBy(*groups).agg(F.count("*").alias("n"))
    curve = ranked_curve(df, groups, cap=cap, zero=cap == 0)
    joined = join_groups(curve, sizes, groups)
    scale = F.col("n") / F.lit(float(reference_rows))
    gross = profit(F.col("tp"), F.col("fp"), hit=hit, miss=miss) * scale  # scaled last: points of equal profit stay equal
    price = float(features * feature_cost)
    return joined.select(
        *groups, "k", "tp", "fp", "threshold", gross.alias("gross"), scale.alias("scale"), (gross - price * scale).alias("scaled_score"), (gross - price).alias("unscaled_cost_score")
    )


def score_at(df: DataFrame, ks: Sequence[int], groups: Sequence[str] = (), *, features: int) -> DataFrame:
    """Exact score at given k, each clamped to 0..n: one aggregate, no curve."""
    wide = ranked(df, groups, max([0, *ks]))
    asked = sorted({max(0, k) for k in ks})
    sums = []
    for k in asked:
        inside = F.col("k") <= k
        sums += [F.count_if(inside & (F.col("y") == 1)).alias(f"tp{k}"), F.count_if(inside & (F.col("y") == 0)).alias(f"fp{k}")]
    totals = wide.groupBy(*groups).agg(*sums)
    rows = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("asked_k"), F.col(f"tp{k}").alias("tp"), F.col(f"fp{k}").alias("fp")) for k in asked)))
    out = totals.select(*groups, rows.alias("r")).select(*groups, "r.*")
    return out.withColumn("k", F.col("tp") + F.col("fp")).withColumn("business_score", profit(F.col("tp"), F.col("fp"), features).cast("long"))


def threshold_score(df: DataFrame, threshold: float, *, features: int, cap: int = MAX_TARGETS) -> DataFrame:
    """tp, fp and profit of the best ``cap`` rows at or above a threshold."""
    top = ranked(df.where(F.col("score") >= threshold), (), cap)
    sums = top.agg(F.count_if(F.col("y") == 1).alias("tp"), F.count_if(F.col("y") == 0).alias("fp"))
    return sums.withColumn("business_score", profit(F.col("tp"), F.col("fp"), features).cast("long"))


def f1_curve(df: DataFrame, groups: Sequence[str] = (), *, cap: int = MAX_TARGETS) -> DataFrame:
    """k, tp, fp, fn, tn, precision, recall, f1, accuracy, specificity, threshold; a rate over nothing is 0."""
    totals = df.groupBy(*groups).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    curve = ranked_curve(df, groups, cap=cap)
    c = join_groups(curve, totals, groups)
    c = c.withColumns({"fn": F.col("pos") - F.col("tp"), "tn": F.col("neg") - F.col("fp")})
    c = c.withColumns({"precision": ratio(F.col("tp"), F.col("k")), "recall": ratio(F.col("tp"), F.col("pos"))})
    return c.select(
        *groups, "k", "tp", "fp", "fn", "tn", "precision", "recall",
        ratio(2 * F.col("tp"), F.col("k") + F.col("pos")).alias("f1"),  # one division: equal fractions stay equal
        ratio(F.col("tp") + F.col("tn"), F.col("pos") + F.col("neg")).alias("accuracy"),
        ratio(F.col("tn"), F.col("neg")).alias("specificity"),
        "threshold",
    )


def elbow_k(curve: DataFrame, groups: Sequence[str] = (), *, share: float = 0.95) -> DataFrame:
    """Smallest k whose score reaches ``share`` of the best; 0 where none does (a negative best)."""
    best = curve.groupBy(*groups).agg(F.max("business_score").alias("best"))
    c = join_groups(curve, best, groups)
    return c.groupBy(*groups).agg(F.coalesce(F.min(F.when(F.col("business_score") >= share * F.col("best"), F.col("k"))), F.lit(0)).alias("elbow_k"))


def fold_grid_k(df: DataFrame, grid: Sequence[int], *, features: int, fold: str = "fold") -> DataFrame:
    """Mean over folds of the score at each k of a grid (clamped to the fold), best first."""
    at = score_at(df, grid, [fold], features=features)
    mean = at.groupBy(F.col("asked_k").alias("k")).agg(F.avg(F.col("business_score").cast("double")).alias("mean_score"))
    return mean.orderBy(F.desc("mean_score"), "k")


def combined_k(*ks: Column) -> Column:
    """The smallest positive one, or 0."""
    return F.coalesce(F.least(*(F.when(k > 0, k) for k in ks)), F.lit(0)) if len(ks) > 1 else F.coalesce(F.when(ks[0] > 0, ks[0]), F.lit(0))


def expected_value(p: Column, *, hit: float = HIT_VALUE, miss: float = MISS_COST) -> Column:
    return hit * p - miss * (1 - p)


def select_targets(df: DataFrame, k: int, *, floor: float | None = None, cap: int = MAX_TARGETS) -> DataFrame:
    """The best min(k, cap) rows with a score of at least ``floor``: rank, id, score, expected_value."""
    kept = df if floor is None else df.where(F.col("score") >= floor)
    top = ranked(kept, (), min(k, cap))
    return top.select(F.col("k").cast("long").alias("rank"), "id", "score", expected_value(F.col("score")).alias("expected_value"))


def target_diagnostics(df: DataFrame, k: int, *, floor: float | None = None, cap: int = MAX_TARGETS) -> DataFrame:
    """Asked, allowed, eligible and selected counts and the lowest selected score; a floor of 0 or none counts
    as the break-even probability."""
    bound = floor or BREAK_EVEN
    eligible = df.agg(F.count_if(F.col("score") >= bound).alias("eligible"))
    picked = select_targets(df, k, floor=floor, cap=cap).agg(F.count("*").alias("selected"), F.min("score").alias("lowest_score"))
    return picked.join(F.broadcast(eligible)).select(F.lit(k).cast("long").alias("requested"), F.lit(min(k, cap)).cast("long").alias("allowed"), "eligible", "selected", "lowest_score")


def confusion_at(df: DataFrame, k: int) -> DataFrame:
    """The full 2 x 2 grid of actual and predicted at the top k."""
    top = ranked(df, (), k).agg(F.count_if(F.col("y") == 1).alias("tp"), F.count_if(F.col("y") == 0).alias("fp"))
    both = df.agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")).join(F.broadcast(top))
    cells = F.array(*(F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), n.alias("n")) for a, p, n in ((1, 1, F.col("tp")), (0, 1, F.col("fp")), (1, 0, F.col("pos") - F.col("tp")), (0, 0, F.col("neg") - F.col("fp")))))
    return both.select(F.explode(cells).alias("c")).select("c.*")


def score_bands(df: DataFrame, k: int, *, bands: int = 10) -> DataFrame:
    """The top k in ``bands`` bands of equal width; what is left over behind the last band is dropped."""
    width = max(1, k // bands)
    top = ranked(df, (), k).withColumn("band", (F.floor((F.col("k") - 1) / width) + 1).cast("long")).where(F.col("band") <= bands)
    out = top.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("tp"), F.sum(1 - F.col("y").cast("long")).alias("fp"))
    return out.withColumns({"precision": ratio(F.col("tp"), F.col("n")), "fp_rate": ratio(F.col("fp"), F.col("n"))})


def cumulative_fp_rate(bands: DataFrame) -> DataFrame:
    so_far = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)  # ten rows
    return bands.select("band", "n", "fp", ratio(F.sum("fp").over(so_far), F.sum("n").over(so_far)).alias("cumulative_fp_rate"))


def rescale(score: Column, features: int, factor: float, *, feature: float = FEATURE_COST) -> Column:
    """Scale the gross part of a score and charge the features once."""
    return (score + features * feature) * factor - features * feature
