"""One-row records of scored predictions, random baselines, and summaries of baselines and experts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ledger import FEATURE_COST, HIT_VALUE, MAX_TARGETS, MISS_COST, profit
from ..functions.parsing import paid_sources
from .curves import best_point, effective_point, f1_curve, join_groups, profit_curve, scaled_curve
from .metrics import roc_auc

#: What a record of scaled validation scores says it is (fixed value).
SCORING_VERSION = "scaled_full_objective_v1"


def best_f1(df: DataFrame, groups: Sequence[str] = (), *, cap: int = MAX_TARGETS) -> DataFrame:
    """groups, f1_k, best_f1, f1_threshold: the point of the highest F1 among the best ``cap`` rows, the smallest k of equal ones."""
    best = best_point(f1_curve(df, groups, cap=cap), groups, score="f1")
    return best.select(*groups, F.col("k").alias("f1_k"), F.col("f1").alias("best_f1"), F.col("threshold").alias("f1_threshold"))


def f1_scorer(model, df: DataFrame, *, cap: int = MAX_TARGETS) -> float:
    """The best F1 among the ``cap`` best rows of ``df`` by a model's score; 0 where there is no positive row or none at all."""
    found = best_f1(model.score(df).select("id", "y", "score"), cap=cap).first()
    return float(found.best_f1) if found and found.best_f1 is not None else 0.0


def _quality(df: DataFrame, groups: Sequence[str], cap: int) -> DataFrame:
    """groups, n, f1_score, roc_auc_score; both null where one of the classes is missing."""
    sizes = df.groupBy(*groups).agg(F.count("*").alias("n"), (F.count_if(F.col("y") == 1) * F.count_if(F.col("y") == 0) > 0).alias("_both"))
    found = join_groups(join_groups(sizes, best_f1(df, groups, cap=cap), groups), roc_auc(df, groups), groups)
    known = lambda c: F.when(F.col("_both"), F.col(c))
    return found.select(*groups, "n", known("best_f1").alias("f1_score"), known("roc_auc").alias("roc_auc_score"))


def _sources(features: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(features))


def scored_record(df: DataFrame, features: Sequence[str], groups: Sequence[str] = (), *, method: str, columns: int | None = None, cap: int = MAX_TARGETS) -> DataFrame:
    """One row (a group) of out-of-fold scores (id, y, score): the score at the effective k, with hits and misses there,
    price of the distinct ``features``, F1 and AUC.  ``columns`` counts the candidate columns if they are more."""
    paid = _sources(features)
    point = effective_point(df, groups, features=len(paid), cap=cap)
    both = join_groups(point, _quality(df, groups, cap), groups)
    price = float(len(paid) * FEATURE_COST)
    return both.select(
        *groups, F.lit(method).alias("method"), F.lit(columns or len(paid)).cast("long").alias("candidate_column_count"), F.lit(len(paid)).cast("long").alias("source_feature_count"),
        F.col("business_score").cast("double").alias("oof_business_score"), F.col("effective_k").alias("oof_optimal_k"), F.col("tp").alias("oof_tp_at_optimal_k"), F.col("fp").alias("oof_fp_at_optimal_k"),
        F.col("n").alias("oof_n_predictions"), (F.col("effective_k") / F.col("n").cast("double")).alias("oof_selected_rate"), F.lit(price).alias("feature_penalty"),
        (F.col("business_score") + price).alias("gross_score"), "f1_score", "roc_auc_score", F.array(*map(F.lit, paid)).cast("array<string>").alias("source_features"),
    )


def scaled_record(df: DataFrame, features: Sequence[str], groups: Sequence[str] = (), *, method: str, columns: int | None = None, cap: int = MAX_TARGETS, reference_rows: int = MAX_TARGETS) -> DataFrame:
    """One row (a group) of validation scores (id, y, score) at the best point of the scaled curve."""
    paid = _sources(features)
    curve = scaled_curve(df, groups, features=len(paid), cap=cap, reference_rows=reference_rows)
    both = join_groups(best_point(curve, groups, score="scaled_score"), _quality(df, groups, cap), groups)
    price = float(len(paid) * FEATURE_COST)
    return both.select(
        *groups, F.lit(method).alias("method"), F.lit(columns or len(paid)).cast("long").alias("candidate_column_count"), F.lit(len(paid)).cast("long").alias("source_feature_count"),
        F.array(*map(F.lit, paid)).cast("array<string>").alias("source_features"), F.lit(SCORING_VERSION).alias("scoring_version"), F.lit(reference_rows).cast("long").alias("feature_cost_reference_row_count"),
        F.col("n").alias("evaluation_row_count"), F.least(F.lit(max(cap, 0)), F.col("n")).cast("long").alias("target_limit"), F.col("scale").alias("feature_cost_scale"),
        (F.col("scale") * float(HIT_VALUE)).alias("scaled_true_positive_value"), (F.col("scale") * float(MISS_COST)).alias("scaled_false_positive_cost"), (F.col("scale") * price).alias("scaled_feature_cost"),
        F.lit(price).alias("unscaled_feature_cost"), F.col("scaled_score").alias("oof_business_score"), F.col("unscaled_cost_score").alias("oof_business_score_unscaled_feature_cost"),
        F.col("gross").alias("oof_business_value_before_feature_cost"), F.col("k").alias("oof_optimal_k"), F.col("tp").alias("oof_tp_at_optimal_k"), F.col("fp").alias("oof_fp_at_optimal_k"), "f1_score", "roc_auc_score",
    )


def random_score(seed: int, *keys: Column) -> Column:
    """A score in [0, 1) that hangs on the seed and the keys only."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def random_baselines(samples: DataFrame, groups: Sequence[str], *, repeats: int, seed: int = 42, cap: int = MAX_TARGETS) -> DataFrame:
    """groups, random_repeat and the best point (k from 0 on) of scores drawn by hash for ``samples`` (groups, id, y), once
    for each repeat, with F1 and AUC: what scores that know nothing reach."""
    drawn = samples.withColumn("random_repeat", F.explode(F.array(*(F.lit(r) for r in range(repeats))))).withColumn("score", random_score(seed, F.col("random_repeat"), F.col("id")))
    keys = [*groups, "random_repeat"]
    point = best_point(profit_curve(drawn, keys, features=0, cap=cap, zero=True), keys)
    both = join_groups(point, _quality(drawn, keys, cap), keys)
    return both.select(*keys, "k", "tp", "fp", "n", F.col("business_score").cast("double").alias("business_score"), (F.col("k") / F.col("n").cast("double")).alias("contact_rate"), "f1_score", "roc_auc_score")


def fold_summary(scores: DataFrame, metrics: Sequence[str], *, name: str = "name", fold: str = "fold") -> DataFrame:
    """name, metric, mean, std (of the population), folds (scores in the order of the folds) of each metric of a baseline."""
    each = scores.select(name, fold, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("e")).select(name, fold, "e.*")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(fold, "value"))), lambda x: x["value"])  # a handful of folds
    return each.groupBy(name, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), listed.alias("folds"))


def fold_scores(df: DataFrame, features: int, *, groups: Sequence[str] = (), cap: int = MAX_TARGETS, fold: str = "fold") -> DataFrame:
    """groups, fold, business_with_var_penalty, business_no_var_penalty, f1_topk of out-of-fold scores (groups, id, y, score,
    fold): the best score with and without the price of the features, and the best F1."""
    keys = [*groups, fold]
    point = best_point(profit_curve(df, keys, features=0, cap=cap), keys)
    both = join_groups(point, best_f1(df, keys, cap=cap), keys)
    gross = profit(F.col("tp"), F.col("fp")).cast("double")
    return both.select(*keys, (gross - float(features * FEATURE_COST)).alias("business_with_var_penalty"), gross.alias("business_no_var_penalty"), F.col("best_f1").alias("f1_topk"))


def experts_summary(experts: DataFrame) -> DataFrame:
    """expert, model, feature_set, n_features, cv_business_mean, cv_business_std, fusion_weight: the experts of a fusion
    (with their features), the weightiest first."""
    return experts.select(
        "expert", "model", "feature_set", F.size("features").cast("long").alias("n_features"), "cv_business_mean", "cv_business_std", F.col("weight").alias("fusion_weight")
    ).orderBy(F.desc("fusion_weight"), "expert")


def union_features(experts: DataFrame) -> DataFrame:
    """feature, once each: what the experts of a fusion use together."""
    return experts.select(F.explode("features").alias("feature")).distinct()


def distinct_paid(experts: DataFrame, sources: DataFrame) -> DataFrame:
    """expert, paid: the distinct originals behind each expert's features, of which ``sources`` (feature, originals) knows
    the derived ones."""
    known = sources.agg(F.map_from_entries(F.collect_list(F.struct("feature", "originals"))).alias("m"))  # a row a derived feature
    return experts.join(F.broadcast(known)).select("expert", paid_sources(F.col("features"), F.col("m")).alias("paid"))
