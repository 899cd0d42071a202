"""Whole runs on a small separable table."""

from __future__ import annotations

from pyspark.sql import functions as F
from rankwright.operators import folds, models, pipelines, recipes, scoring

from .test_operators import matrix, rank_table


def test_candidates_in_a_fold(spark):
    space = recipes.prescreen_recipes(spark, ["m1", "m2"])
    got = pipelines.fold_candidates(rank_table(spark), space, [1, 2]).collect()
    assert len({tuple(c.features) for c in got}) == len(got)
    single = {c.prescreen_recipe_id: c.features for c in pipelines.fold_candidates(rank_table(spark), space, [1], distinct=False).collect()}
    assert single["ps_mean_0001"] == ["var_1"] and single["ps_mean_0002"] == ["var_3"]
    lost = recipes.prescreen_recipes(spark, ["m1", "none"])
    assert {r.prescreen_recipe_id for r in pipelines.recipe_failures(rank_table(spark), lost).collect()} >= {"ps_mean_0002", "ps_mean_0003"}
    assert {c.prescreen_recipe_id for c in pipelines.fold_candidates(rank_table(spark), lost, [1], distinct=False).collect()} == {"ps_mean_0001"}


def test_filters(spark):
    df = matrix(spark)
    names = pipelines.univariate_filter(df, keep=3)
    assert len(names) == 3 and "var_0" in names
    doubled = df.withColumn("features", F.concat("features", F.array(F.col("features")[0])))
    left = pipelines.multicollinearity_filter(doubled, [f"var_{k}" for k in range(5)])
    assert len({"var_0", "var_4"} & set(left)) == 1


def test_inner_and_outer_runs(spark):
    df = matrix(spark, n=120, width=3)
    outer = folds.outer_folds(df, n_splits=2)
    inner = folds.inner_folds(df, outer, n_splits=2)
    space = recipes.prescreen_recipes(spark, ["abs_corr", "mutual_info"]).where("prescreen_recipe_id = 'ps_mean_0001'")
    fits = {"lr": models.logistic(iterations=10), "bad": lambda train: 1 / 0}
    p = pipelines.inner_round(df, outer, inner, space, [1], fits)
    scores = scoring.inner_scores(p.where("status = 'ok'"), cap=50)
    assert scores.count() == 2 and scores.where("roc_auc > 0.8").count() == 2
    assert p.where("status LIKE 'error%'").select("pipeline_recipe_id").distinct().count() == 1
    predictions, chosen = pipelines.outer_evaluation(df, outer, [("c1", "ps_mean_0001", 1, "lr")], space, fits)
    assert predictions.count() == 120 and {tuple(r.features) for r in chosen.collect()} == {("var_0",)}
    final = pipelines.refit_finalists(df, df, [("c1", "ps_mean_0001", 1, "lr")], space, fits, top=10)
    assert final.where("selected_for_top_n").count() == 10 and final.count() == 120
    best, table = pipelines.final_pipeline(df, df, outer, ["var_0"], fits["lr"], k=40)
    assert best.count() == 40 and {r.scenario for r in table.collect()} == {"pooled", "per_fold", "in_sample"}
