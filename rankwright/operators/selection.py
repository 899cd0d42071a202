"""Choosing feature sets, recipes and finalists from score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import names_from_text, set_key


def top_targets(df: DataFrame, k: int) -> DataFrame:
    """rank, id, score of the best k rows."""
    best = df.orderBy(F.col("score").desc_nulls_last(), F.desc("id")).limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.col("score").desc_nulls_last(), F.desc("id"))).cast("long").alias("rank"), "id", "score")


def only_pairs(df: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are among the selected pairs."""
    return df.join(pairs.select(*keys), list(keys), "left_semi")


def missing_keys(wanted: DataFrame, have: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(have.select(*keys), list(keys), "left_anti")


def with_fallback(predicted: DataFrame, original: DataFrame, keys: Sequence[str], fill: Sequence[str], *, always: Sequence[str] = ()) -> DataFrame:
    """``original`` with ``fill`` taken from ``predicted`` where it has them, the first row of each key; an empty string
    counts as missing, as null does."""
    first = predicted.groupBy(*keys).agg(*(F.min_by(c, "sample_index").alias(f"_{c}") for c in fill))
    joined = original.join(first, list(keys), "left")
    known = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c))
    return joined.select(*(F.coalesce(known(f"_{c}"), known(c)).alias(c) if c in fill and c not in always else F.col(c) for c in original.columns))


def suffix_join(a: DataFrame, b: DataFrame, key: str, suffixes: tuple[str, str]) -> DataFrame:
    """Left join on ``key`` in which only columns that both sides have get a suffix."""
    both = (set(a.columns) & set(b.columns)) - {key}
    left = a.select(*(F.col(c).alias(c + suffixes[0] if c in both else c) for c in a.columns))
    right = b.select(*(F.col(c).alias(c + suffixes[1] if c in both else c) for c in b.columns))
    return left.join(right, key, "left")


def top_recipes(aggregated: DataFrame, *, top: int, least_folds: int = 1, runs: str = "runs", scope: str = "table") -> DataFrame:
    """The best ``top`` of the whole table, or of each outer fold with ``scope`` "outer_fold"; recipes with too few runs go
    after the ranking, so ranks may have gaps."""
    kept = aggregated.where(F.col(runs) >= least_folds)
    if scope == "table":
        order = [F.asc(c) for c in ("inner_selection_rank", *(c for c in ("outer_fold", "pipeline_recipe_id") if c in aggregated.columns))]
        kept = kept.orderBy(*order).limit(top)
        return kept.withColumn("selected_rank", F.row_number().over(Window.orderBy(*order)).cast("long"))  # ``top`` rows
    if scope != "outer_fold":
        raise ValueError(f"unknown scope {scope}")
    own = Window.partitionBy("outer_fold").orderBy("inner_selection_rank")
    return kept.withColumn("selected_rank", F.row_number().over(own).cast("long")).where(F.col("selected_rank") <= top)


def global_candidates(scores: DataFrame, by: Sequence[str], folds: DataFrame, *, top: int = 20, least_runs: int = 5, most_features: int | None = None) -> DataFrame:
    """The best configurations over all outer folds (outer_fold, mean_score, runs, feature_size, ...), repeated for each
    of ``folds`` (outer_fold): by mean and least score, number of folds, size and AUC, ties by the keys."""
    kept = scores.where(F.col("runs") >= least_runs)
    if most_features is not None:
        kept = kept.where(F.col("feature_size") <= most_features)
    value = F.col("mean_score")
    auc = F.avg("mean_roc_auc") if "mean_roc_auc" in scores.columns else F.lit(None).cast("double")
    stats = kept.groupBy(*by).agg(
        F.avg(value).alias("global_mean"), F.median(value).alias("global_median"), F.min(value).alias("global_min"), F.max(value).alias("global_max"),
        F.max("feature_size").cast("long").alias("feature_size"), F.count_distinct("outer_fold").alias("outer_folds"), auc.alias("global_roc_auc"),
    )
    order = [*(F.desc_nulls_last(c) for c in ("global_mean", "global_min", "outer_folds")), F.asc_nulls_last("feature_size"), F.desc_nulls_last("global_roc_auc"), *(F.asc(k) for k in by)]
    best = stats.orderBy(*order).limit(top).withColumn("global_rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return best.crossJoin(F.broadcast(folds.select("outer_fold").distinct()))


def stable_configurations(summary: DataFrame, *, top: int = 10, least_folds: int = 2) -> DataFrame:
    """Best configurations seen in at least ``least_folds`` outer folds; if there are none, of all, with a note."""
    enough = F.col("outer_folds") >= least_folds
    known = summary.withColumn("_any", F.max(enough).over(Window.partitionBy()))  # one row a configuration
    kept = known.where(enough | ~F.col("_any"))
    best = kept.orderBy("outer_config_rank").limit(top)
    return best.select("*", F.row_number().over(Window.orderBy("outer_config_rank")).cast("long").alias("finalist_rank"), F.when(F.col("_any"), "stable").otherwise("fallback_all").alias("selection_note")).drop("_any")


def cost_aware_configurations(
    summary: DataFrame, *, top: int, least_folds: int, most_features: int | None = None, fallback_folds: int = 1, exact_folds: bool = False, incomplete: bool = True
) -> DataFrame:
    """Up to ``top`` configurations in tiers: few features and enough folds (or exactly that many); then, only if
    ``incomplete`` is allowed, few features and ``fallback_folds``, then whatever is left.

    Within a tier they go by mean and least score, number of folds, size and id.
    """
    cheap = F.col("feature_size") <= most_features if most_features is not None else F.lit(True)
    folds = F.col("outer_folds") == least_folds if exact_folds else F.col("outer_folds") >= least_folds
    tier = F.when(cheap & folds, 1)
    if incomplete:
        tier = tier.when(cheap & (F.col("outer_folds") >= fallback_folds), 2).otherwise(3)
    note = F.element_at(F.array(F.lit("primary"), F.lit("fewer_folds"), F.lit("any_size")), F.col("tier"))
    order = [F.col("tier"), *(F.desc_nulls_last(c) for c in ("mean_score", "min_score", "outer_folds")), F.asc_nulls_last("feature_size"), F.asc("recipe_config_id")]
    best = summary.withColumn("tier", tier).where(F.col("tier").isNotNull()).orderBy(*order).limit(top)
    return best.withColumn("selection_note", note).withColumn("finalist_rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def candidate_pools(scores: DataFrame, rankings: DataFrame, *, top: int = 60, pools: int = 6, include: Sequence[str] = ()) -> DataFrame:
    """pool, features: the best ``pools`` names by score and size, those in ``include`` first, each with its top features."""
    value = [F.desc("score"), F.asc("size")]
    best = scores.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy(*value))).where("_r = 1")
    first = F.when(F.col("name").isin(*include), 0).otherwise(1) if include else F.lit(1)
    chosen = best.withColumn("_first", first).orderBy("_first", *value, "name").limit(pools).select("name")
    listed = rankings.where(F.col("order") <= top).join(F.broadcast(chosen), "name")
    return listed.groupBy(F.col("name").alias("pool")).agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "feature"))), lambda x: x["feature"]).alias("features"))


def unique_feature_sets(results: DataFrame, available: Sequence[str], *, top: int = 50, most: int = 60) -> DataFrame:
    """Distinct sets of available features, the first of each by rank and size: feature_set_id, origin, features."""
    own = F.array_intersect(set_key(names_from_text(F.col("features"))), F.array(*map(F.lit, available)))
    rows = results.withColumn("_set", own).where((F.size("_set") > 0) & (F.size("_set") <= most))
    first = Window.partitionBy("_set").orderBy("rank", "n_features", "origin")
    kept = rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").orderBy("rank", "n_features", "origin").limit(top)
    number = F.row_number().over(Window.orderBy("rank", "n_features", "origin"))
    return kept.select(F.format_string("fs_%03d", number).alias("feature_set_id"), "origin", F.col("_set").alias("features"))


def prefix_candidates(rankings: DataFrame, sizes: Sequence[int], *, most: int | None = None) -> DataFrame:
    """Prefix sets of every ranking (name, feature, order, ensemble_score), one for each distinct set, by heuristic.

    The heuristic is the mean ensemble_score of the set; of equal sets the best, then the first by name, stays.
    """
    listed = rankings.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("order", "feature", "ensemble_score"))).alias("all"))
    cut = listed.select("name", F.explode(F.array(*(F.lit(s) for s in sorted(set(sizes))))).alias("size"), "all").where(F.col("size") <= F.size("all"))
    cut = cut.withColumn("top", F.slice("all", 1, F.col("size")))
    made = cut.select(
        "name", F.col("size").cast("long").alias("size"), set_key(F.transform("top", lambda x: x["feature"])).alias("features"),
        (F.aggregate("top", F.lit(0.0), lambda a, x: a + x["ensemble_score"]) / F.col("size")).alias("heuristic"),
    )
    first = Window.partitionBy("features").orderBy(F.desc("heuristic"), "name")
    kept = made.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    order = [F.desc("heuristic"), F.asc("size"), F.asc("name")]
    best = kept.orderBy(*order) if most is None else kept.orderBy(*order).limit(most)
    number = F.row_number().over(Window.orderBy(*order))
    return best.select(F.format_string("gen_%04d", number).alias("candidate_id"), "name", "size", "features", "heuristic")


def merged_sets(frames: Sequence[DataFrame], *, top: int) -> DataFrame:
    """Sets of several tables (origin, place, features) in their order, each set once, numbered anew."""
    out = None
    for k, frame in enumerate(frames):
        part = frame.select(F.lit(k).alias("source"), "origin", "place", set_key(F.col("features")).alias("features"))
        out = part if out is None else out.unionByName(part)
    first = Window.partitionBy("features").orderBy("source", "place", "origin")
    kept = out.withColumn("_r", F.row_number().over(first)).where("_r = 1").orderBy("source", "place", "origin").limit(top)
    return kept.select(F.format_string("fs_%03d", F.row_number().over(Window.orderBy("source", "place", "origin"))).alias("feature_set_id"), "origin", "features")


def winner(comparison: DataFrame) -> DataFrame:
    """The row of the highest score; of equal ones the smaller set, then the first names."""
    return comparison.orderBy(F.desc_nulls_last("score"), "n_features", "feature_set", "model").limit(1)


def with_best_params(comparison: DataFrame, model: str, params_json: str) -> DataFrame:
    return comparison.withColumn("best_params", F.when(F.col("model") == model, F.lit(params_json)).otherwise(F.lit("")))
