"""Searches over parameters, rankings and feature sets: each candidate is judged by its out-of-fold scores.

Candidates of a search or of a table of specs are fitted together (``out_of_fold_all``); the greedy search goes one step
after the other.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import product
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ledger import FEATURE_COST, MAX_TARGETS
from ..functions.shared import written
from . import fanout
from .boosters import additive_boosted, best_subset_scores, lambdamart, leafwise_boosted
from .curves import best_point, profit_curve
from .features import long_view
from .models import WHOLE, Fit, Scorer, compare, extra_trees, forest_feature_scores, kmeans_diagnostics, l1_feature_scores, logistic, out_of_fold, out_of_fold_sets, pairwise_ranker, principal_components, random_forest, scaled, scaling, shared_scores, spline_feature_scores, with_mixed
from .paths import LogisticTask, fit_many, held_out_scores
from .rankings import abs_corr, binned_mutual_information, combined_ranking, normalised_ranks
from .records import fold_scores, scored_record

RANKINGS = "feature string, raw_score double"


def scaled_logistic(*, c: float = 1.0, l1_ratio: float = 0.5, robust: bool = True, balanced: bool = True) -> Fit:
    """Logistic regression of features that are centred and scaled by the training rows' own statistics."""

    def fit(train: DataFrame) -> Scorer:
        change = scaling(train, robust=robust)
        inner = logistic(c=c, l1_ratio=l1_ratio, balanced=balanced)(change(train))

        class Scaled(Scorer):
            def score(self, df: DataFrame) -> DataFrame:
                own = df.withColumn("_own", F.col("features"))
                scored = inner.score(change(own))
                return scored.withColumn("features", F.col("_own")).select(*df.columns, "score")

        return Scaled(inner.model, inner.features)

    fit.together = {"c": c, "l1_ratio": l1_ratio, "balanced": balanced, "robust": robust}
    return fit


def _tasked(fit: Fit, family: str, params: Mapping) -> Fit:
    """``fit`` marked with the row of a task table that stands for it."""
    marked = lambda train: fit(train)
    marked.task = family, json.dumps(dict(params))
    return marked


def model_factories() -> dict[str, Callable[..., Fit]]:
    """The models that feature sets are compared with, by name: leaf-wise and level-wise trees of the logistic loss, grown
    on the shares of rows and columns that a search draws.  A parameter that a model hasn't got is an error."""
    return {
        "lightgbm": lambda **p: _tasked(leafwise_boosted(**fanout.boosting_ways(p, levels=False)), "lightgbm", p),
        "logistic_regression": lambda C=1.0, l1_ratio=0.5: scaled_logistic(c=C, l1_ratio=l1_ratio),
        "xgboost": lambda **p: _tasked(leafwise_boosted(**fanout.boosting_ways(p, levels=True)), "xgboost", p),
    }


def fit_of_spec(family: str, params: Mapping) -> Fit:
    """The fit that a model spec (family and parameters, as ``recipes`` lists them) stands for; a family or a parameter that
    there isn't is an error."""
    balanced = params.get("class_weight", "balanced") is not None
    p = {k: v for k, v in params.items() if k != "class_weight"}
    if family in ("lightgbm", "xgboost"):
        return model_factories()[family](**p)
    if family == "logistic":
        return scaled_logistic(c=p.get("C", 1.0), l1_ratio=p.get("l1_ratio", 0.5), balanced=balanced)
    if family == "additive":
        return _tasked(additive_boosted(**fanout.additive_ways(p)), family, p)
    if family == "ranker":
        return _tasked(lambdamart(**fanout.ranker_ways(p)), family, p)
    if family not in ("extra_trees", "random_forest"):
        raise ValueError(f"unknown family {family}")
    ways = fanout.forest_ways(params)
    ways["depth"] = ways["depth"] or 14
    if family == "random_forest":  # Spark's own, on all rows
        return random_forest(**ways)
    return _tasked(extra_trees(**ways), family, {**params, "max_depth": ways["depth"]})


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"


def out_of_fold_all(df: DataFrame, folds: DataFrame, sets: Sequence[Sequence[int]], fits: Sequence[Fit]) -> tuple[DataFrame, dict[tuple[int, int], str]]:
    """fit, set (places in ``fits`` and ``sets``), fold, id, y, score of the out-of-fold scores of every fit on every set, and
    the error of each fit and set that has one; folds that could be fitted keep their scores.

    Logistic models share their passes.  Boosters and forests are tasks of one fan-out, each fitted on all rows outside its
    fold.  Others, and all on ids that aren't whole numbers, go one by one.  A set without features, or with one that the
    table hasn't got, is an error.
    """
    spark = df.sparkSession
    width = df.agg(F.max(F.size("features")).alias("n")).first().n or 0
    errors = {(k, s): "ValueError: no features, or some that the table hasn't got" for s, p in enumerate(sets) if not p or not all(0 <= q < width for q in p) for k in range(len(fits))}
    good = [s for s in range(len(sets)) if (0, s) not in errors]
    parts, done = [], set()
    if good and (shared := shared_scores(df, folds, [sets[s] for s in good], fits)) is not None:
        parts.append(shared.withColumn("set", F.array(*map(F.lit, good))[F.col("set")]))
        done |= {k for k, f in enumerate(fits) if getattr(f, "together", None)}
    tasked = [k for k, f in enumerate(fits) if getattr(f, "task", None)]
    held = sorted(r[0] for r in folds.select("outer_fold").distinct().collect())
    if good and tasked and len(held) > 1 and dict(df.dtypes)["id"] in WHOLE:
        jobs = [(k, s, h) for k in tasked for s in good for h in held]
        tasks = spark.createDataFrame([(n, 0, h, *fits[k].task, list(sets[s])) for n, (k, s, h) in enumerate(jobs)], fanout.TASKS)
        blocks = fanout.fan_out(df, fanout.plain_split(folds), tasks, sample=None)
        for r in blocks.where("status <> 'ok'").select("task_id", "error").collect():  # a row a failed task
            errors[jobs[r.task_id][:2]] = r.error
        named = spark.createDataFrame([(n, *job) for n, job in enumerate(jobs)], "task_id long, fit int, set int, fold int")
        rows = fanout.predictions_of(blocks.where("status = 'ok'")).join(F.broadcast(named), "task_id")  # a row a task
        parts.append(rows.select("fit", "set", "fold", F.col("sample_index").alias("id"), F.col("y_true").alias("y"), "score"))
        done |= set(tasked)
    for k, s in ((k, s) for k in range(len(fits)) if k not in done for s in good):
        try:
            scores = out_of_fold(df.withColumn("features", F.array(*(F.col("features")[q] for q in sets[s]))), folds, fits[k])
            if failed := scores.where("status <> 'ok'").first():
                errors[k, s] = failed.status.removeprefix("error: ")
            parts.append(scores.where("status = 'ok'").select(F.lit(k).alias("fit"), F.lit(s).alias("set"), F.col("outer_fold").alias("fold"), "id", "y", "score"))
        except Exception as e:
            errors[k, s] = _said(e)
    empty = spark.createDataFrame([], "fit int, set int, fold int, id long, y int, score double")
    return written(reduce(DataFrame.unionByName, parts) if parts else empty, "all-scores"), errors


def evaluated_specs(df: DataFrame, folds: DataFrame, specs: Sequence[tuple[str, str, str, Mapping]], sets: Mapping[str, Sequence[str]], *, cap: int = MAX_TARGETS) -> DataFrame:
    """model_spec_id, base_model_family, feature_set_id, n_features, status, error, score, k, f1_score, roc_auc_score of every spec
    on every feature set; a pair that fails says so and has no score.  All are fitted together and judged by one grouped curve."""
    schema = "model_spec_id string, base_model_family string, feature_set_id string, n_features long, status string, error string, score double, k long, f1_score double, roc_auc_score double"
    fits, place, refused = [], {}, {}
    for n, (_, family, _, params) in enumerate(specs):
        try:
            fits.append(fit_of_spec(family, params))
            place[n] = len(fits) - 1
        except Exception as e:
            refused[n] = _said(e)
    scores, errors = out_of_fold_all(df, folds, [[int(f.removeprefix("var_")) for f in features] for features in sets.values()], fits)
    found = {(r.fit, r.set): r for r in scored_record(scores, [], ["fit", "set"], method="", cap=cap).collect()}  # a row a spec and set
    rows = []
    for s, (name, features) in enumerate(sets.items()):
        for n, (spec, family, _, _) in enumerate(specs):
            key = place.get(n), s
            error = refused.get(n) or errors.get(key) or (None if key in found else "ValueError: no rows")
            if error:
                rows.append((spec, family, name, len(features), "error", error, None, None, None, None))
                continue
            r = found[key]
            rows.append((spec, family, name, len(features), "ok", None, r.oof_business_score - float(len(set(features)) * FEATURE_COST), r.oof_optimal_k, r.f1_score, r.roc_auc_score))
    return df.sparkSession.createDataFrame(rows, schema)


def cluster_counts_by_set(df: DataFrame, sets: Mapping[str, Sequence[str]], ks: Sequence[int], *, seed: int = 42) -> DataFrame:
    """feature_set, k, inertia, silhouette of k-means on the standardised features of every set."""
    out = []
    for name, features in sets.items():
        wide, *_ = scaled(_named(df, features), robust=False)
        out.append(kmeans_diagnostics(wide, ks, seed=seed).select(F.lit(name).alias("feature_set"), "k", "inertia", "silhouette"))
    return reduce(DataFrame.unionByName, out)


#: Grids and distributions of the winner's search (fixed values).
LOGISTIC_GRID = {"C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0], "l1_ratio": [1.0, 0.0]}
LEAFWISE_CHOICES = {"num_leaves": [15, 31, 63, 127], "learning_rate": [0.01, 0.03, 0.05, 0.1], "n_estimators": [100, 200, 400], "max_depth": [3, 4, 6, 8, -1], "subsample": [0.6, 0.8, 1.0], "colsample_bytree": [0.6, 0.8, 1.0]}
LEVELWISE_CHOICES = {"n_estimators": [100, 200, 400], "learning_rate": [0.01, 0.03, 0.05, 0.1], "max_depth": [3, 4, 6, 8], "subsample": [0.6, 0.8, 1.0], "colsample_bytree": [0.6, 0.8, 1.0]}


def grid_points(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def drawn_points(choices: Mapping[str, Sequence], n: int, *, seed: int = 42) -> list[dict]:
    """``n`` different points of the product of the choices, or all if there are fewer."""
    sizes = [len(v) for v in choices.values()]
    whole = int(np.prod(sizes, dtype=object))
    picked = random.Random(seed).sample(range(whole), min(n, whole))
    return [{k: v[i] for (k, v), i in zip(choices.items(), np.unravel_index(p, sizes))} for p in picked]


def parameter_search(
    df: DataFrame, folds: DataFrame, make: Callable[..., Fit], *, features: int, grid: Mapping[str, Sequence] | None = None, choices: Mapping[str, Sequence] | None = None, n_iter: int = 20, seed: int = 42, cap: int = MAX_TARGETS
) -> DataFrame:
    """params (JSON), mean_score, mean_f1 of each point of a grid, or of ``n_iter`` points drawn from choices, by the mean
    over folds of the best score less the features' price; best first, ties by params.  All points are fitted together."""
    if (grid is None) == (choices is None):
        raise ValueError("give a grid or choices, not both")
    points = grid_points(grid) if grid is not None else drawn_points(choices, n_iter, seed=seed)
    width = df.agg(F.max(F.size("features")).alias("n")).first().n or 0
    scores, _ = out_of_fold_all(df, folds, [range(width)], [make(**p) for p in points])
    means = fold_scores(scores, features, groups=["fit"], cap=cap).groupBy("fit").agg(F.avg("business_with_var_penalty").alias("mean_score"), F.avg("f1_topk").alias("mean_f1"))
    named = df.sparkSession.createDataFrame([(k, json.dumps(p, sort_keys=True)) for k, p in enumerate(points)], "fit int, params string")
    return named.join(F.broadcast(means), "fit", "left").select("params", "mean_score", "mean_f1").orderBy(F.desc_nulls_last("mean_score"), "params")  # a row a point


def winner_search(df: DataFrame, folds: DataFrame, model: str, *, features: int, n_iter: int = 20, save: Callable[[str, Mapping, float], None] | None = None, **ways) -> tuple[Fit, dict, float]:
    """The winning model tuned: its fit, parameters and mean score.  Logistic regression goes over its grid, the boosters
    over drawn points; ``save`` (such as ``write_search_results`` of a folder) is handed the result."""
    make = model_factories()[model]
    if model == "logistic_regression":
        found = parameter_search(df, folds, make, features=features, grid=ways.get("grid", LOGISTIC_GRID))
    else:
        found = parameter_search(df, folds, make, features=features, n_iter=n_iter, choices=ways.get("choices", LEAFWISE_CHOICES if model == "lightgbm" else LEVELWISE_CHOICES))
    best = found.first()
    params = json.loads(best.params)
    if save:
        save(model, params, best.mean_score)
    return make(**params), params, best.mean_score


def _by_place(df: DataFrame, values: Sequence[float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(f"var_{k}", float(v)) for k, v in enumerate(values)], RANKINGS)


#: Name of a ranking method -> raw scores of the features (feature, raw_score) of a training table (id, y, features).
METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "abs_corr": lambda df: abs_corr(long_view(df, "features", "id", "y")).toDF("feature", "raw_score"),
    "mutual_info": lambda df: binned_mutual_information(long_view(df, "features", "id", "y")).toDF("feature", "raw_score"),
    "logistic_l1": lambda df: _by_place(df, l1_feature_scores(df)),
    "sparse_gam": lambda df: _by_place(df, spline_feature_scores(df)),
    "boosted_gain": lambda df: _by_place(df, leafwise_boosted()(df).gains),
    "lambdamart_gain": lambda df: _by_place(df, lambdamart()(df).gains),
    "additive": lambda df: _by_place(df, additive_boosted()(df).importance),
    "best_subset": lambda df: _by_place(df, best_subset_scores(df)),
    "forest_gain": lambda df: _by_place(df, forest_feature_scores(df, random_forest(trees=50))),
    "pairwise_sparse": lambda df: _by_place(df, np.abs(pairwise_ranker()(df).weights)),
}


def collected_rankings(df: DataFrame, methods: Sequence[str], registry: Mapping[str, Callable[[DataFrame], DataFrame]] = METHODS) -> tuple[DataFrame, DataFrame]:
    """Long rankings (feature, method, raw_score, rank, rank_score) by every method that works, written, and (method,
    error) of those that don't."""
    spark, out, failed = df.sparkSession, None, []
    for method in methods:
        try:
            if method not in registry:
                raise ValueError("unknown method")
            part = written(registry[method](df).select("feature", F.lit(method).alias("method"), F.col("raw_score").cast("double").alias("raw_score")), "ranking")
            out = part if out is None else out.unionByName(part)
        except Exception as e:
            failed.append((method, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
    empty = spark.createDataFrame([], "feature string, method string, raw_score double")
    return normalised_ranks(empty if out is None else out), spark.createDataFrame(failed, "method string, error string")


def ensemble_ranking(df: DataFrame, methods: Sequence[str], registry: Mapping[str, Callable[[DataFrame], DataFrame]] = METHODS) -> DataFrame:
    """feature, ensemble_score, mean_rank, order and score__<method>: methods fitted on ``df`` and their ranks averaged; a
    method that fails is an error."""
    rankings, failed = collected_rankings(df, methods, registry)
    if bad := failed.collect():
        raise ValueError("; ".join(f"{r.method}: {r.error}" for r in bad))
    return combined_ranking(rankings, methods)


def _named(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumn("features", F.array(*(F.col("features")[int(n.removeprefix("var_"))] for n in names)))


def evaluated_rankings(df: DataFrame, folds: DataFrame, rankings: DataFrame, fit: Fit, *, sizes: Sequence[int] = (1, 2, 3, 5, 8, 10, 15, 20, 30), cap: int = MAX_TARGETS) -> DataFrame:
    """Records of the out-of-fold scores of the first features, in every size, of every ranking (name, feature, order):
    best score first, then fewer features.  Sets that several rankings share are fitted once, and logistic models of all
    sets and folds in the same passes."""
    listed = rankings.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "feature"))), lambda x: x["feature"]).alias("features")).orderBy("name").collect()
    wanted = [(ranking.name, size, tuple(ranking.features[:size])) for ranking in listed for size in sorted({s for s in sizes if 0 < s <= len(ranking.features)})]
    distinct = list(dict.fromkeys(names for _, _, names in wanted))
    places = [[int(n.removeprefix("var_")) for n in names] for names in distinct]
    shared = out_of_fold_sets(df, folds, places, [fit]).get(0)
    if shared is not None:
        fitted = {names: shared.where(F.col("set") == s).drop("set") for s, names in enumerate(distinct)}
    else:
        fitted = {names: written(out_of_fold(_named(df, names), folds, fit).where("status = 'ok'").select("id", "y", "score"), "ranking-scores") for names in distinct}
    rows = []
    for name, size, names in wanted:
        record = scored_record(fitted[names], list(names), method=f"{name}::top_{size:02d}", cap=cap)
        rows.append(record.select("*", F.lit(name).alias("prescreen_name"), F.lit(f"top_{size:02d}").alias("feature_set_name")))
    if not rows:
        raise ValueError("no ranking holds a feature")
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc_nulls_last("oof_business_score"), "source_feature_count", "method")


def nonzero_features(coefficients: Sequence[float], features: Sequence[str]) -> list[str]:
    """Names of the features whose coefficient isn't zero; all of them if the two don't go together."""
    if len(coefficients) != len(features):
        return list(features)
    return [f for f, c in zip(features, coefficients) if abs(c) > 1e-12]


def sparse_path(df: DataFrame, folds: DataFrame, *, cs: Sequence[float] = tuple(np.logspace(-4, 2, 50)), cap: int = MAX_TARGETS, penalise_intercept: bool = True) -> list[dict]:
    """c, nonzero, coefficients and score (mean over folds of the best score less the price of all features) of balanced L1
    logistic models of standardised features; every penalty, on all rows and without each fold, is fitted in the same passes.

    The intercept is penalised as the coefficients are, unless told otherwise."""
    wide, *_ = scaled(df, robust=False)
    wide = written(wide.select("id", "y", "features").join(folds.select("id", F.col("outer_fold").alias("fold")), "id"), "sparse-path")
    held = sorted(r.fold for r in wide.select("fold").distinct().collect())
    tasks = [LogisticTask(float(c), 1.0, f) for c in cs for f in (None, *held)]
    fits = fit_many(wide, tasks, penalise_intercept=penalise_intercept)
    width = max((len(f.coefficients) for f in fits), default=0)
    scores = written(held_out_scores(wide, fits).withColumnRenamed("fold", "_fold"), "sparse-path-scores")
    gross = {r.model: r.business_score for r in best_point(profit_curve(scores, ["model"], features=width, cap=cap), ["model"]).collect()}  # a row a model
    out = []
    for k, c in enumerate(cs):
        own = range(k * (len(held) + 1), (k + 1) * (len(held) + 1))
        coefficients = fits[own[0]].coefficients
        found = [float(gross[m]) for m in own[1:] if m in gross]
        out.append({"c": float(c), "nonzero": int((np.abs(coefficients) > 1e-12).sum()), "coefficients": coefficients, "score": float(np.mean(found)) if found else float("nan")})
    return out


def banded_features(path: Sequence[Mapping], features: Sequence[str], *, band: tuple[int, int] = (20, 30), target: int | None = None) -> list[str]:
    """Features of the path's best point: the one nearest to ``target`` features, or the best score within the band, or, if
    none lies in it, of all points with any feature; the first of equal ones."""
    if target is not None:
        best = min(path, key=lambda p: abs(p["nonzero"] - target))
    else:
        some = [p for p in path if p["nonzero"] > 0]
        if not some:
            return []
        inside = [p for p in some if band[0] <= p["nonzero"] <= band[1]]
        best = max(inside or some, key=lambda p: p["score"])
    return nonzero_features(best["coefficients"], features)


def greedy_selection(df: DataFrame, folds: DataFrame, fit: Fit, features: Sequence[str], *, gain: float = FEATURE_COST, most: int | None = None) -> list[tuple[str, float]]:
    """(feature, score) in the order in which they were added: each time the one that raises the best score, which has paid
    for its features, the most; it stops when that is not more than ``gain``."""
    chosen, best, left = [], None, list(features)
    while left and (most is None or len(chosen) < most):
        sets = {f: [int(x.removeprefix("var_")) for x in (*(c for c, _ in chosen), f)] for f in left}
        row = compare(df, folds, sets, {"m": fit}).orderBy(F.desc("score"), "feature_set").first()
        if best is not None and row.score - best <= gain:
            break
        best = float(row.score)
        chosen.append((row.feature_set, best))
        left.remove(row.feature_set)
    return chosen


def component_comparison(df: DataFrame, folds: DataFrame, fit: Fit, ks: Sequence[int], *, cap: int = MAX_TARGETS) -> DataFrame:
    """method, f1_score, roc_auc_score of all scaled features ("raw") and of their first principal components."""
    wide, *_ = scaled(df, robust=False)
    tables = {"raw": wide} | {f"pca_{k}": principal_components(wide, k) for k in ks}
    rows = []
    for name, table in tables.items():
        scores = out_of_fold(table, folds, fit).where("status = 'ok'").select("id", "y", "score")
        rows.append(scored_record(scores, [], method=name, cap=cap).select("method", "f1_score", "roc_auc_score"))
    return reduce(DataFrame.unionByName, rows)


def shadow_selection(df: DataFrame, width: int, *, rounds: int = 20, alpha: float = 0.05, fit: Fit | None = None, seed: int = 42) -> list[tuple[str, int, str]]:
    """(feature, hits, verdict): how often a feature's importance was above that of every shadow, a feature whose values are
    dealt out anew among all rows, each on its own; "confirmed" or "rejected" where chance would hardly give that many or
    that few."""
    hits = np.zeros(width, int)
    for r in range(rounds):
        both = with_mixed(df, width, seed=seed + r)
        both = both.withColumn("features", F.concat("features", "mixed")).drop("mixed")
        found = np.array(forest_feature_scores(both, fit or random_forest(trees=50, seed=seed + r)))
        hits += found[:width] > found[width:].max()
    tail = lambda k: sum(comb(rounds, j) for j in range(k, rounds + 1)) / 2**rounds
    level = alpha / width
    verdict = lambda h: "confirmed" if tail(h) < level else "rejected" if tail(rounds - h) < level else "tentative"
    return [(f"var_{k}", int(h), verdict(int(h))) for k, h in enumerate(hits)]


def without_features(df: DataFrame) -> DataFrame:
    """``df`` with no features at all, for baselines that use none."""
    return df.withColumn("features", F.array().cast("array<double>"))
