"""Whole runs: feature filters, candidate sets in folds, inner and outer evaluation, refits, scenarios."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ledger import FEATURE_COST, HIT_VALUE, MAX_TARGETS, MISS_COST
from ..functions.parsing import set_key
from ..functions.shared import broadcast_if_small, written
from .boosters import SAMPLE, leafwise_boosted
from .curves import best_point, profit_curve, ranked
from .fanout import TASKS, fan_out, plain_split, predictions_of
from .features import correlation_matrix, long_view, prune_correlated, prune_inflated, variance_filter
from .folds import outer_folds
from .models import Fit, out_of_fold
from .rankings import binned_mutual_information, floored_weights, normalised_ranks, rank_sum, top_rank_scores
from .search import banded_features, sparse_path

Prescreen = Callable[[DataFrame], DataFrame]


def univariate_filter(df: DataFrame, *, least_variance: float = 0.01, keep: int = 80, least_rows: int = 20) -> list[str]:
    """Names of the features that vary, by the sum of their places in mutual information and in the number of splits that
    leaf-wise boosted trees make by them."""
    long = long_view(df, "features", "id", "y")
    varying = variance_filter(long, least=least_variance).select("feature")
    information = binned_mutual_information(long.join(F.broadcast(varying), "feature", "left_semi")).select("feature", F.col("mutual_info").alias("score"))
    importance = df.sparkSession.createDataFrame([(f"var_{k}", float(s)) for k, s in enumerate(leafwise_boosted(leaf=least_rows)(df).splits)], "feature string, score double")
    both = rank_sum(information, importance.join(F.broadcast(varying), "feature", "left_semi"))
    return [r.feature for r in both.orderBy("combined", "feature").limit(keep).collect()]


def multicollinearity_filter(
    df: DataFrame, features: Sequence[str], folds: DataFrame | None = None, *, correlation: float = 0.85, inflation: float = 5.0,
    cs: Sequence[float] = tuple(np.logspace(-4, 2, 50)), band: tuple[int, int] = (20, 30), target: int | None = None, cap: int = MAX_TARGETS,
) -> list[str]:
    """Correlated, then inflated features go; last, those without a coefficient at the best point of the L1 path.

    The path has a balanced model for each of ``cs`` and is judged over ``folds`` (five stratified ones by default): the
    best score with ``band`` features, or the number nearest to ``target``.  Matrices are as large as the number of
    features squared, and come to the driver.
    """
    long = long_view(df, "features", "id", "y").where(F.col("feature").isin(*features))
    strength = {r.feature: r.mutual_info for r in binned_mutual_information(long).collect()}
    corr = correlation_matrix(df, "features", [int(f.removeprefix("var_")) for f in features])
    left = prune_correlated(features, corr, strength, least=correlation)
    places = [list(features).index(f) for f in left]
    left = prune_inflated(left, corr[np.ix_(places, places)], most=inflation)
    if not left:
        return []
    path = sparse_path(narrowed(df, left), folds if folds is not None else outer_folds(df, n_splits=5), cs=cs, cap=cap)
    return banded_features(path, left, band=band, target=target)


def narrowed(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The table with only the named features, in their order."""
    return df.withColumn("features", F.array(*(F.col("features")[int(f.removeprefix("var_"))] for f in features)))


def materialised_rankings(rankings: DataFrame, recipes: DataFrame) -> DataFrame:
    """prescreen_recipe_id, feature, ensemble_score, mean_rank, order for every recipe in one job.

    Mean recipes weigh their methods alike; adaptive ones as ``train_only_weights`` does over the recipe's own methods,
    of which the top ones count where the recipe says so.  Recipes of which a method has no ranking give no rows.
    """
    members = recipes.select("prescreen_recipe_id", "prescreen_method_count", "rank_aggregation", "adaptive_method_count", F.explode("prescreen_methods").alias("method"))
    known = members.join(F.broadcast(top_rank_scores(rankings)), "method")
    own = Window.partitionBy("prescreen_recipe_id")  # a row for each method of a recipe
    weights = floored_weights(known, ["prescreen_recipe_id"]).withColumnRenamed("weight", "w")
    place = F.row_number().over(own.orderBy(F.desc("w"), "method"))
    used = weights.withColumns({"_place": place, "_whole": F.count("*").over(own) == F.col("prescreen_method_count")}).where("_whole")
    used = used.withColumn("weight", F.when(F.col("rank_aggregation") == "mean", 1.0).when((F.col("rank_aggregation") == "weighted_top_k") & (F.col("_place") > F.col("adaptive_method_count")), 0.0).otherwise(F.col("w")))
    total = F.sum("weight").over(Window.partitionBy("prescreen_recipe_id"))
    shares = used.withColumn("share", F.col("weight") / total).select("prescreen_recipe_id", "method", "share")
    joined = rankings.join(F.broadcast(shares), "method")
    scored = joined.groupBy("prescreen_recipe_id", "feature").agg(F.sum(F.col("share") * F.col("rank_score")).alias("ensemble_score"), F.sum(F.col("share") * F.col("rank")).alias("mean_rank"))
    # Sums of the same numbers in another order tie.
    order = Window.partitionBy("prescreen_recipe_id").orderBy(F.desc(F.round("ensemble_score", 12)), F.round("mean_rank", 12), "feature")
    return scored.withColumn("order", F.row_number().over(order).cast("long"))


def recipe_failures(rankings: DataFrame, recipes: DataFrame) -> DataFrame:
    """Recipes and the methods that they miss."""
    members = recipes.select("prescreen_recipe_id", F.explode("prescreen_methods").alias("method"))
    return members.join(rankings.select("method").distinct(), "method", "left_anti").groupBy("prescreen_recipe_id").agg(F.array_join(F.array_sort(F.collect_set("method")), ",").alias("missing_methods"))


def fold_candidates(rankings: DataFrame, recipes: DataFrame, sizes: Sequence[int], *, most: int | None = 300, distinct: bool = True) -> DataFrame:
    """feature_recipe_id, prescreen_recipe_id, feature_size, features, heuristic: prefix sets of every recipe.

    Of equal sets the first by recipe and size stays if ``distinct``; the heuristic is the mean ensemble score.
    """
    whole = materialised_rankings(rankings, recipes)
    listed = whole.groupBy("prescreen_recipe_id").agg(F.array_sort(F.collect_list(F.struct("order", "feature", "ensemble_score"))).alias("all"))
    cut = listed.select("prescreen_recipe_id", "all", F.explode(F.array(*map(F.lit, sorted(set(sizes))))).alias("size")).where(F.col("size") <= F.size("all"))
    cut = cut.withColumn("top", F.slice("all", 1, F.col("size")))
    made = cut.select(
        F.format_string("%s__k_%03d", "prescreen_recipe_id", "size").alias("feature_recipe_id"), "prescreen_recipe_id", F.col("size").cast("long").alias("feature_size"),
        set_key(F.transform("top", lambda x: x["feature"])).alias("features"), (F.aggregate("top", F.lit(0.0), lambda a, x: a + x["ensemble_score"]) / F.col("size")).alias("heuristic"),
    )
    if distinct:
        first = Window.partitionBy("features").orderBy("prescreen_recipe_id", "feature_size")
        made = made.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    best = made.orderBy(F.desc("heuristic"), "feature_size", "prescreen_recipe_id")
    return best if most is None else best.limit(most)


def correlation_prescreen(df: DataFrame) -> DataFrame:
    """A ranking by two simple methods, for runs that bring none of their own."""
    from .rankings import abs_corr

    long = long_view(df, "features", "id", "y")
    a = abs_corr(long).select("feature", F.lit("abs_corr").alias("method"), F.col("abs_corr").alias("raw_score"))
    b = binned_mutual_information(long).select("feature", F.lit("mutual_info").alias("method"), F.col("mutual_info").alias("raw_score"))
    return normalised_ranks(a.unionByName(b))


#: A model: a fit, or the family and parameters that ``fanout`` has it by.
Model = Fit | tuple[str, Mapping]


def _places(features: Sequence[str]) -> list[int]:
    return [int(f.removeprefix("var_")) for f in features]


def _fanned(df: DataFrame, members: DataFrame, jobs: Sequence[tuple], keys: str, *, sample: int) -> DataFrame | None:
    """Predictions of ``jobs`` (key values, split, fold, features, (family, params)) with the columns ``keys`` (a schema) in
    front; None if there are no jobs."""
    if not jobs:
        return None
    spark = df.sparkSession
    tasks = written(spark.createDataFrame([(k, s, f, m[0], json.dumps(dict(m[1])), _places(names)) for k, (_, s, f, names, m) in enumerate(jobs)], TASKS), "fan-out-tasks")
    named = spark.createDataFrame([(k, *key) for k, (key, *_) in enumerate(jobs)], f"task_id long, {keys}")
    found = predictions_of(fan_out(df, members, tasks, sample=sample))
    return found.join(broadcast_if_small(named, len(jobs), 200), "task_id").drop("task_id")


def inner_round(
    df: DataFrame, outer: DataFrame, inner: DataFrame, recipes: DataFrame, sizes: Sequence[int], fits: Mapping[str, Model], *, prescreen: Prescreen = correlation_prescreen, most: int = 300, round_name: str = "round_1", sample: int = SAMPLE
) -> DataFrame:
    """Predictions of every candidate and model on every inner validation part, ranked anew on each training part.

    Folds are walked on the driver, for their rankings.  Models given as (family, parameters) are all fitted in one
    fan-out, on at most ``sample`` rows; a task that fails becomes one row with its error.  Models given as fits, which
    may be any Spark estimator, are jobs of their own.
    """
    keys = "outer_fold int, inner_fold int, round_name string, pipeline_recipe_id string, feature_size long"
    jobs, out = [], None
    for o, i in sorted((r.outer_fold, r.inner_fold) for r in inner.select("outer_fold", "inner_fold").distinct().collect()):
        own = inner.where(F.col("outer_fold") == o).select("id", "inner_fold")
        rows = df.join(own, "id")
        train = rows.where(F.col("inner_fold") != i)
        val = rows.where(F.col("inner_fold") == i)
        for c in fold_candidates(prescreen(train), recipes, sizes, most=most).collect():
            for name, model in fits.items():
                key = o, i, round_name, f"{c.feature_recipe_id}__{name}", c.feature_size
                if isinstance(model, tuple):
                    jobs.append((key, o, i, c.features, model))
                    continue
                columns = (F.lit(v).alias(k) for v, k in zip(key, ("outer_fold", "inner_fold", "round_name", "pipeline_recipe_id", "feature_size")))
                part = _fitted(train, val, c.features, model).select(*columns, F.col("id").alias("sample_index"), F.col("y").alias("y_true"), "score", "status")
                out = part if out is None else out.unionByName(part)
    members = inner.select(F.col("outer_fold").cast("int").alias("split"), "id", F.col("inner_fold").cast("int").alias("fold"))
    fanned = _fanned(df, members, jobs, keys, sample=sample)
    both = [p for p in (out, fanned) if p is not None]
    found = both[0] if len(both) == 1 else both[0].unionByName(both[1])
    return found.select("outer_fold", "inner_fold", "round_name", "pipeline_recipe_id", "sample_index", "y_true", "score", "feature_size", "status")


def _fitted(train: DataFrame, val: DataFrame, features: Sequence[str], fit: Fit) -> DataFrame:
    try:
        return written(fit(narrowed(train, features)).score(narrowed(val, features)).select("id", "y", "score", F.lit("ok").alias("status")), "scores")
    except Exception as e:
        return val.select("id", "y", F.lit(None).cast("double").alias("score"), F.lit(f"error: {type(e).__name__}").alias("status"))


def outer_evaluation(
    df: DataFrame, outer: DataFrame, configs: Sequence[tuple[str, str, int, str]], recipes: DataFrame, fits: Mapping[str, Model], *, prescreen: Prescreen = correlation_prescreen, sample: int = SAMPLE
) -> tuple[DataFrame, DataFrame]:
    """Predictions on the outer validation parts and the features of each refit, for (config, recipe, size, model); models
    are as in ``inner_round``."""
    out, chosen, jobs = None, [], []
    for o in sorted(r.outer_fold for r in outer.select("outer_fold").distinct().collect()):
        rows = df.join(outer, "id")
        train, val = rows.where(F.col("outer_fold") != o), rows.where(F.col("outer_fold") == o)
        sets = {(c.prescreen_recipe_id, c.feature_size): c.features for c in fold_candidates(prescreen(train), recipes, sorted({c[2] for c in configs}), most=None, distinct=False).collect()}
        for config, recipe, size, name in configs:
            names, model = sets[recipe, size], fits[name]
            chosen.append((o, config, names))
            if isinstance(model, tuple):
                jobs.append(((o, config), 0, o, names, model))
                continue
            part = _fitted(train, val, names, model).select(F.lit(o).alias("outer_fold"), F.lit(config).alias("recipe_config_id"), F.col("id").alias("sample_index"), F.col("y").alias("y_true"), "score", "status")
            out = part if out is None else out.unionByName(part)
    fanned = _fanned(df, plain_split(outer), jobs, "outer_fold int, recipe_config_id string", sample=sample)
    both = [p for p in (out, fanned) if p is not None]
    found = both[0] if len(both) == 1 else both[0].unionByName(both[1])
    return found.select("outer_fold", "recipe_config_id", "sample_index", "y_true", "score", "status"), df.sparkSession.createDataFrame(chosen, "outer_fold int, recipe_config_id string, features array<string>")


def refit_finalists(train: DataFrame, test: DataFrame, finalists: Sequence[tuple[str, str, int, str]], recipes: DataFrame, fits: Mapping[str, Fit], *, top: int, prescreen: Prescreen = correlation_prescreen) -> DataFrame:
    """recipe_config_id, rank, id, score, selected_for_top_n of every test row for every finalist."""
    sets = {(c.prescreen_recipe_id, c.feature_size): c.features for c in fold_candidates(prescreen(train), recipes, sorted({f[2] for f in finalists}), most=None, distinct=False).collect()}
    out = None
    for config, recipe, size, model in finalists:
        names = sets[recipe, size]
        scored = fits[model](narrowed(train, names)).score(narrowed(test, names)).select(F.lit(config).alias("recipe_config_id"), "id", "score")
        out = scored if out is None else out.unionByName(scored)
    placed = ranked(out, ["recipe_config_id"])
    return placed.select("recipe_config_id", F.col("k").cast("long").alias("rank"), "id", "score", (F.col("k") <= top).alias("selected_for_top_n"))


def scenarios(scored: DataFrame, folds: DataFrame, *, features: int, cap: int, in_sample: DataFrame | None = None) -> DataFrame:
    """scenario, k, tp, fp, business_score: pooled, each fold at its share of the cap added up, and in-sample."""
    columns = ["scenario", "k", "tp", "fp", "business_score"]
    pooled = best_point(profit_curve(scored, features=features, cap=cap)).withColumn("scenario", F.lit("pooled")).select(*columns)
    rows = scored.join(folds.withColumnRenamed("outer_fold", "fold"), "id") if "fold" not in scored.columns else scored
    count = rows.select("fold").distinct().count()
    per = best_point(profit_curve(rows, ["fold"], features=0, cap=max(1, cap // max(count, 1))), ["fold"])
    sums = per.agg(F.sum("k").alias("k"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    score = (HIT_VALUE * F.col("tp") - MISS_COST * F.col("fp") - FEATURE_COST * features).cast("long")
    out = pooled.unionByName(sums.withColumns({"scenario": F.lit("per_fold"), "business_score": score}).select(*columns))
    if in_sample is not None:
        out = out.unionByName(best_point(profit_curve(in_sample, features=features, cap=cap)).withColumn("scenario", F.lit("in_sample")).select(*columns))
    return out


def final_pipeline(train: DataFrame, test: DataFrame, folds: DataFrame, features: Sequence[str], fit: Fit, *, k: int) -> tuple[DataFrame, DataFrame]:
    """The best ``k`` test rows of a model on fixed features, and the scenarios that speak for it."""
    own = narrowed(train, features)
    scorer = fit(own)
    best = ranked(scorer.score(narrowed(test, features)).select("id", "score"), (), k).select(F.col("k").cast("long").alias("rank"), "id", "score")
    oof = out_of_fold(own, folds, fit).where("status = 'ok'").select("id", "y", "score")
    return best, scenarios(oof, folds, features=len(features), cap=k, in_sample=scorer.score(own).select("id", "y", "score"))
