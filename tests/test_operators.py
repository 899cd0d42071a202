"""Hand-computed cases of the ranking, scoring and selection operators."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from rankwright.functions import parsing, ranges, shared
from rankwright.operators import boosters, curves, features, folds, metrics, models, rankings, recipes, records, scoring, search, selection
from rankwright.sources import tables
from rankwright.streaming.predictions import absorb_predictions


def scored(spark, ys, ps):
    return spark.createDataFrame([(k, y, float(p)) for k, (y, p) in enumerate(zip(ys, ps))], "id long, y int, score double")


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


FIVE = ([1, 1, 0, 0, 0], [0.9, 0.8, 0.7, 0.2, 0.1])


def test_business_scores(spark):
    s = scored(spark, *FIVE)
    assert only(curves.best_point(curves.profit_curve(s, features=1, cap=2))).business_score == -180
    assert only(curves.threshold_score(s, 0.5, features=1)).business_score == -185
    assert only(curves.break_even_k(scored(spark, [0] * 5, [0.9, 0.8, 0.34, 0.2, 0.1]))).breakeven_k == 3
    assert only(curves.break_even_k(scored(spark, [0] * 5, [0.9, 0.8, 0.4, 0.2, 0.1]))).breakeven_k == 3
    ev = [r[0] for r in scored(spark, [0, 0], [1 / 3, 0.2]).orderBy("id").select(curves.expected_value(F.col("score"))).collect()]
    assert abs(ev[0]) < 1e-9 and ev[1] < 0
    targets = curves.select_targets(scored(spark, [0] * 5, [0.9, 0.8, 0.2, 0.7, 0.1]), 2, floor=0.5).collect()
    assert len(targets) == 2 and all(t.score >= 0.5 for t in targets)
    at = only(curves.score_at(scored(spark, [1, 0, 1, 0], [0.4, 0.3, 0.2, 0.1]), [0], features=1))
    assert (at.business_score, at.tp, at.fp) == (-200, 0, 0)
    nothing = only(curves.capped_best(scored(spark, [0, 0], [0.9, 0.8]), features=1, cap=2))
    assert (nothing.k, nothing.business_score, nothing.threshold) == (0, -200, None)


def test_scaled_curve(spark):
    s = scored(spark, [1, 1, 0, 0, 0], [0.95, 0.9, 0.4, 0.3, 0.2])
    best = only(curves.best_point(curves.scaled_curve(s, features=2, cap=3, reference_rows=10), score="scaled_score"))
    assert (best.k, best.scale, best.gross, best.scaled_score, best.unscaled_cost_score) == (2, 0.5, 10.0, -190.0, -390.0)
    none = only(curves.scaled_curve(s, features=2, cap=0, reference_rows=10))
    assert (none.k, none.gross, none.scaled_score, none.unscaled_cost_score) == (0, 0.0, -200.0, -400.0)
    with pytest.raises(ValueError):
        curves.scaled_curve(s, features=1, reference_rows=0)


def test_points_of_equal_worth_are_equal(spark):
    ys = [0, 1, 1, 1, 0, 0, 1, 0, 0]  # at k = 4 and k = 7 the profit is 25
    record = only(records.scaled_record(scored(spark, ys, [1 - k / 10 for k in range(9)]), ["a", "b"], method="m", reference_rows=7))
    assert (record.oof_optimal_k, record.oof_tp_at_optimal_k, record.oof_fp_at_optimal_k) == (4, 3, 1)
    ys = [0, 0, 1, 1, 1, 0, 0, 1]  # at k = 5 and k = 8 F1 is 2 / 3
    assert only(records.best_f1(scored(spark, ys, [1 - k / 10 for k in range(8)]))).f1_k == 5


def test_orders_of_aggregated_scores(spark):
    inner = spark.createDataFrame([("ok", 1, 1, "a", 10.0), ("ok", 1, 2, "a", 20.0), ("ok", 1, 1, "b", 25.0), ("error", 1, 2, "b", None)], "status string, outer_fold int, inner_fold int, recipe string, score double")
    inner = inner.withColumn("feature_size", F.lit(3))
    ranked = scoring.aggregate_inner(inner, ["outer_fold", "recipe"], score="score").orderBy("inner_selection_rank").collect()
    assert [(r.recipe, r.runs) for r in ranked] == [("b", 1), ("a", 2)]
    # Pooled scores: of equal means the higher AUC goes first whatever the size; those that miss predictions go.
    pooled = spark.createDataFrame([("a", 5.0, 0.6, 1, 0), ("b", 5.0, 0.7, 9, 0), ("c", 9.0, 0.9, 1, 2)], "recipe string, oof_score double, roc_auc double, feature_size int, missing_samples int").withColumn("status", F.lit("ok"))
    assert [r.recipe for r in scoring.aggregate_inner(pooled, ["recipe"]).orderBy("inner_selection_rank").collect()] == ["b", "a"]
    # Outer scores: mean, median, number of folds, spread, size; the least score doesn't count.
    rows = [("few", f, x, 1) for f, x in ((1, 0.0), (2, 30.0), (3, 30.0))] + [("many", f, x, 1) for f, x in ((1, 20.0), (2, 20.0), (3, 20.0), (4, 20.0))]
    outer = spark.createDataFrame(rows, "recipe_config_id string, outer_fold int, business_score double, feature_size int").withColumns({"status": F.lit("ok"), "k": F.lit(1)})
    assert [r.recipe_config_id for r in scoring.aggregate_outer(outer).orderBy("outer_config_rank").collect()] == ["few", "many"]
    # Over all folds: mean, least score, number of folds, size, AUC.
    scores = [("a", 1, 10.0, 3, 0.5), ("a", 2, 30.0, 3, 0.5), ("b", 1, 20.0, 3, 0.5), ("b", 2, 20.0, 3, 0.5), ("c", 1, 20.0, 2, 0.9), ("d", 1, 20.0, 2, 0.95)]
    table = spark.createDataFrame(scores, "config string, outer_fold int, mean_score double, feature_size int, mean_roc_auc double").withColumn("runs", F.lit(5))
    best = selection.global_candidates(table, ["config"], table.where("outer_fold = 1")).orderBy("global_rank").collect()
    assert [r.config for r in best] == ["b", "d", "c", "a"]


def test_weights_add_the_floor(spark):
    values = spark.createDataFrame([("a", 0.9), ("b", 0.6), ("c", 0.5)], "method string, score double")
    got = {r.method: round(r.weight, 3) for r in rankings.weights_from_scores(values).collect()}
    assert got == {"a": 0.692, "b": 0.231, "c": 0.077}
    flat = {r.weight for r in rankings.weights_from_scores(values.withColumn("score", F.lit(0.5))).collect()}
    assert flat == {1 / 3}
    assert rankings.weights_from_scores(values.limit(0)).collect() == []


def test_ties_go_to_the_highest_id_and_the_smallest_k(spark):
    s = scored(spark, [1, 0, 0, 1], [0.5, 0.5, 0.5, 0.5])
    assert [r.id for r in curves.ranked(s).orderBy("k").collect()] == [3, 2, 1, 0]
    assert only(curves.best_point(curves.profit_curve(s, features=0, zero=True))).k == 1


def test_ranking_metrics(spark):
    s = scored(spark, [1, 0, 1, 1, 0, 0], [0.9, 0.8, 0.8, 0.4, 0.4, 0.1])
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a in (0.9, 0.8, 0.4) for b in (0.8, 0.4, 0.1)]
    assert abs(only(metrics.roc_auc(s)).roc_auc - sum(pairs) / 9) < 1e-12
    want = 1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5
    assert abs(only(metrics.average_precision(s)).average_precision - want) < 1e-12
    assert only(metrics.roc_auc(scored(spark, [1, 1], [0.1, 0.2]))).roc_auc is None
    assert only(metrics.average_precision(scored(spark, [0], [0.1]))).average_precision is None


def test_running_totals_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).cast("double").alias("k"), F.lit(1).cast("long").alias("n"))
    got = {r.k: r.cum_n for r in ranges.running_totals(df, "k", ["n"], ranges=8).collect()}
    assert got == {float(k): 1000 - k for k in range(1000)}
    split = df.withColumn("g", F.when(F.col("k") % 3 > 0, F.lit("hot")))
    got = {(r.g, r.k): r.cum_n for r in ranges.running_totals(split, "k", ["n"], groups=["g"], descending=False, ranges=8).collect()}
    seen = {"hot": 0, None: 0}
    for k in range(1000):
        g = "hot" if k % 3 else None
        seen[g] += 1
        assert got[g, float(k)] == seen[g]
    assert ranges.running_totals(df.limit(0), "k", ["n"]).count() == 0


def test_places_in_groups_that_span_ranges(spark):
    rows = [(k, "hot" if k % 3 else ["a", None][k % 2], None if k % 11 == 0 else float(k % 5), "x") for k in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, v double, k_extra string")
    out = ranges.placed(df, ["g"], [F.col("v").asc_nulls_first(), F.col("id").desc()], ranges=7)
    assert out.columns == [*df.columns, "k"] and ranges.in_ranges(df, ["g"], [F.col("v"), F.col("id")], 7).select("_part").distinct().count() > 3
    got = {r.id: r.k for r in out.collect()}
    for g in ("hot", "a", None):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, -r[0]))
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))
    assert sorted(r.k for r in ranges.placed(df, [], [F.lit(0)], ranges=3).collect()) == list(range(1, 601))
    assert ranges.placed(df.limit(0), ["g"], [F.col("v")]).count() == 0


def test_caps_beyond_the_group_limit(spark):
    s = spark.range(5000).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") * 37 % 101).cast("double").alias("score"), (F.col("id") % 10 == 0).alias("grp"))
    whole = {(r.grp, r.k): r.id for r in curves.ranked(s, ["grp"]).collect()}
    assert {(r.grp, r.k): r.id for r in curves.ranked(s, ["grp"], 2500).collect()} == {at: v for at, v in whole.items() if at[1] <= 2500}
    assert "WindowGroupLimit" in curves.ranked(s, ["grp"], curves.GROUP_LIMIT)._jdf.queryExecution().toString()


def test_baselines_of_more_samples_than_the_cap(spark):
    rows = [(f, 1, "r", "p", "q", k, int(k >= 6), 0.5, "ok", 1) for f in (1, 2) for k in range(8 * f - 4)]
    df = spark.createDataFrame(rows, "outer_fold int, inner_fold int, round_name string, pipeline_recipe_id string, prescreen_name string, sample_index long, y_true int, score double, status string, feature_size int")
    got = {(r.outer_fold, r.baseline): r.business_score for r in scoring.baselines(df, cap=7).collect()}
    assert got == {(1, "select_all_0"): -20, (1, "select_all_1"): -220, (2, "select_all_0"): -20, (2, "select_all_1"): -220, (2, "select_all_full_0"): 30, (2, "select_all_full_1"): -170}


def test_rank_mean_shares_ranks_of_ties(spark):
    rows = [(c, i, s) for c, ss in (("a", (1.0, 1.0, 2.0, 0.0)), ("b", (0.0, 3.0, 3.0, 3.0)), ("short", (9.0,))) for i, s in enumerate(ss)]
    out = rankings.rank_mean_ensemble(spark.createDataFrame(rows, "config string, id long, score double"), top=4)
    assert {r.id: r.mean_rank for r in out.collect()} == {0: (2.5 + 1) / 8, 1: (2.5 + 3) / 8, 2: (4 + 3) / 8, 3: (1 + 3) / 8}


def test_elbow_of_a_negative_best_is_zero(spark):
    curve = spark.createDataFrame([(1, -10), (2, -20)], "k long, business_score long")
    assert only(curves.elbow_k(curve)).elbow_k == 0
    assert only(spark.range(1).select(curves.combined_k(F.lit(0), F.lit(7), F.lit(5)).alias("k"))).k == 5


def test_folds(spark):
    s = spark.createDataFrame([(k, int(k >= 80), 0.0) for k in range(100)], "id long, y int, score double")
    outer = folds.outer_folds(s)
    inner = folds.inner_folds(s, outer, n_splits=4)
    assert folds.summarise_outer(s, outer).count() == 5 and folds.summarise_inner(s, inner).count() == 20
    assert {(r.val_n, r.val_pos) for r in folds.summarise_outer(s, outer).collect()} == {(20, 4)}
    folds.assert_split_integrity(outer, inner, s)
    with pytest.raises(ValueError):
        folds.assert_split_integrity(outer, inner.limit(10).unionByName(inner), s)
    train, val = (folds.inner_part(s, inner, 1, 2, train=t) for t in (True, False))
    assert train.count() + val.count() == 80 and train.join(val, "id").count() == 0


def rank_table(spark):
    raw = [(f"var_{k}", m, v) for m, vs in (("m1", (3.0, 2.0, 1.0)), ("m2", (1.0, 2.0, 3.0))) for k, v in enumerate(vs, 1)]
    return rankings.normalised_ranks(spark.createDataFrame(raw, "feature string, method string, raw_score double"))


def test_rankings(spark):
    r = rank_table(spark)
    assert [x.feature for x in rankings.combined_ranking(r, ["m1"]).orderBy("order").collect()] == ["var_1", "var_2", "var_3"]
    both = rankings.combined_ranking(r, ["m1", "m2"]).orderBy("order").collect()
    assert [x.feature for x in both] == ["var_1", "var_2", "var_3"] and {x.ensemble_score for x in both} == {0.5}
    with pytest.raises(ValueError):
        rankings.combined_ranking(r, ["m1", "nothing"])
    tied = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 1.0), ("c", "m", float("nan"))], "feature string, method string, raw_score double")
    assert {x.feature: x["rank"] for x in rankings.normalised_ranks(tied).collect()} == {"a": 1.5, "b": 1.5, "c": 3.0}
    weights = rankings.fusion_weights(spark.createDataFrame([("a", 100.0), ("b", 300.0)], "expert string, cv_mean double"))
    assert {x.expert: x.weight for x in weights.collect()} == {"a": 0.25, "b": 0.75}
    assert only(rankings.weights_text(spark.createDataFrame([("b", 1.0), ("a", 3.0)], "method string, weight double"))).weights == "a=0.750000;b=0.250000"
    assert rankings.all_ensembles(r, ["m1", "m2"]).select("ensemble").distinct().count() == 3
    names = [rankings.combination_name(c, 4) for c in (["a"], ["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"])]
    assert names == ["single__a", "pair__a__b", "triple__a__b__c", "all__a__b__c__d"]


def test_recipe_space(spark):
    assert recipes.prescreen_recipes(spark, ["a", "b", "c"]).count() == 9
    assert recipes.prescreen_recipes(spark, list("abcdefgh")).count() == 257
    assert len(recipes.default_model_specs()) == 42
    assert recipes.leakage_contract(spark).count() == 6 and recipes.empty_log(spark).count() == 0
    specs = recipes.model_specs(spark, recipes.default_model_specs())
    assert recipes.filter_specs(specs, []).count() == 42 and recipes.filter_specs(specs, ["ranker_01"]).count() == 1
    assert recipes.filter_prescreens(recipes.prescreen_recipes(spark, ["a", "b"]), adaptive=False, most=2).count() == 2


def inner_rows(spark):
    out = []
    for recipe, ps in (("fr1__m1", (0.9, 0.8, 0.7, 0.1)), ("fr2__m1", (0.9, 0.2, 0.8, 0.1))):
        out += [(1, "r1", recipe, 1 + k // 2, k, (1, 0, 1, 0)[k], p, 1, "ok") for k, p in enumerate(ps)]
    return spark.createDataFrame(out, "outer_fold int, round_name string, pipeline_recipe_id string, inner_fold int, sample_index long, y_true int, score double, feature_size int, status string")


def test_inner_scores(spark):
    p = inner_rows(spark)
    got = {r.pipeline_recipe_id: r for r in scoring.inner_scores(p, cap=3).collect()}
    best = got["fr2__m1"]
    assert (best.oof_score, best.oof_k, best.gross_score, best.contact_rate) == (-180, 2, 20, 0.5)
    assert got["fr1__m1"].oof_score == -185
    base = {r.baseline: r.business_score for r in scoring.baselines(p, cap=3).collect()}
    assert (base["select_all_0"], base["select_all_1"]) == (15, -185)
    merged = {r.pipeline_recipe_id: r.beats_select_all_1 for r in scoring.with_baselines(scoring.inner_scores(p, cap=3), scoring.baselines(p, cap=3)).collect()}
    assert merged == {"fr1__m1": False, "fr2__m1": True}
    with pytest.raises(ValueError, match="duplicate"):
        scoring.inner_scores(p.unionByName(p.limit(1)))
    with pytest.raises(ValueError, match="feature_size"):
        scoring.inner_scores(p.withColumn("feature_size", F.when(F.col("sample_index") == 0, 2).otherwise(1)))
    manifest = p.where("pipeline_recipe_id = 'fr1__m1'").select("outer_fold", "inner_fold", "sample_index")
    part = scoring.inner_scores(p.where("inner_fold = 1 AND pipeline_recipe_id = 'fr1__m1'"), manifest=manifest).first()
    assert (part.status, part.missing_folds, part.missing_samples, part.oof_score) == ("incomplete", 1, 2, None)
    with pytest.raises(ValueError, match="manifest"):
        scoring.inner_scores(p, manifest=manifest.where("sample_index < 2"))
    assert scoring.aggregate_inner(scoring.inner_scores(p.where("inner_fold = 1 AND pipeline_recipe_id = 'fr1__m1'"), manifest=manifest), ["pipeline_recipe_id"]).count() == 0


def test_streamed_predictions_score_as_a_batch(spark, tmp_path):
    p = inner_rows(spark)
    for recipe in ("fr1__m1", "fr2__m1"):
        p.where(F.col("pipeline_recipe_id") == recipe).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    absorb_predictions(spark, str(tmp_path / "in"), p._jdf.schema().toDDL(), str(tmp_path / "out"), cap=3, files_per_batch=1)
    got = spark.read.parquet(str(tmp_path / "out/scores")).select("pipeline_recipe_id", "oof_score", "oof_k").collect()
    want = scoring.inner_scores(p, cap=3).select("pipeline_recipe_id", "oof_score", "oof_k").collect()
    assert sorted(got) == sorted(want)


def test_validation_rank(spark):
    rows = [("fs_1", "ok", 100, 5, "m"), ("fs_2", "error", None, 2, "m"), ("fs_3", "ok", 100, 3, "m")]
    df = spark.createDataFrame(rows, "feature_set_id string, status string, score long, n_features int, model string")
    assert [(r.feature_set_id, r.validation_rank) for r in scoring.validation_rank(df).collect()] == [("fs_3", 1), ("fs_1", 2), ("fs_2", None)]
    assert only(scoring.best_by(df, "model")).feature_set_id == "fs_3"


def test_outer_points_and_finalists(spark):
    rows = [(1, c, k, y, s, "ok") for c, ss in (("cheap", (0.9, 0.8, 0.1)), ("dear", (0.9, 0.8, 0.1))) for k, (y, s) in enumerate(zip((1, 1, 0), ss))]
    p = spark.createDataFrame(rows, "outer_fold int, recipe_config_id string, sample_index long, y_true int, score double, status string")
    sizes = spark.createDataFrame([("cheap", 1), ("dear", 3)], "recipe_config_id string, feature_size long")
    got = {r.recipe_config_id: r for r in scoring.outer_points(p, sizes, caps={1: 2}, scale={1: 3.0}).collect()}
    assert (got["cheap"].k, got["cheap"].business_score, got["cheap"].unscaled_score) == (2, -140, -180)
    scores = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 1, 100.0)], "recipe_config_id string, outer_fold int, business_score double")
    summary = scoring.aggregate_outer(scores.withColumns({"status": F.lit("ok"), "k": F.lit(1), "feature_size": F.lit(1)}))
    assert summary.orderBy("outer_config_rank").first().recipe_config_id == "b"
    assert only(selection.stable_configurations(summary, least_folds=2)).recipe_config_id == "a"
    assert selection.stable_configurations(summary, least_folds=9).first().selection_note == "fallback_all"
    tiers = selection.cost_aware_configurations(summary, top=2, least_folds=2, most_features=1).collect()
    assert [(t.recipe_config_id, t.tier) for t in tiers] == [("a", 1), ("b", 2)]
    strict = selection.cost_aware_configurations(summary, top=2, least_folds=2, most_features=1, incomplete=False).collect()
    assert [t.recipe_config_id for t in strict] == ["a"]
    assert selection.cost_aware_configurations(summary, top=2, least_folds=2, most_features=0, incomplete=False).collect() == []
    relaxed = selection.cost_aware_configurations(summary, top=3, least_folds=2, most_features=0).collect()
    assert [(t.recipe_config_id, t.tier) for t in relaxed] == [("b", 3), ("a", 3)]
    exact = selection.cost_aware_configurations(summary, top=1, least_folds=1, exact_folds=True)
    assert only(exact).recipe_config_id == "b"
    outer = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "outer_fold int, id long")
    assert scoring.complete_pairs(p.where("recipe_config_id = 'cheap' OR sample_index > 0"), outer).collect() == [(1, "cheap")]
    assert only(scoring.pooled_best(p.unionByName(p).where("recipe_config_id = 'cheap'"), ["recipe_config_id"], features=1)).status == "duplicate"


def test_feature_sets(spark):
    rows = [("m_a", 2, 2, "['var_1','var_2']"), ("m_b", 1, 2, "['var_2','var_1']"), ("m_c", 4, 1, "['gone']"), ("m_d", 3, 1, "var_4")]
    results = spark.createDataFrame(rows, "origin string, rank int, n_features int, features string")
    got = selection.unique_feature_sets(results, ["var_1", "var_2", "var_4"]).orderBy("feature_set_id").collect()
    assert [(g.origin, g.features) for g in got] == [("m_b", ["var_1", "var_2"]), ("m_d", ["var_4"])]
    rk = spark.createDataFrame([("a", "x", 1, 0.9), ("a", "y", 2, 0.5), ("b", "y", 1, 0.8), ("b", "x", 2, 0.7)], "name string, feature string, order int, ensemble_score double")
    sets = selection.prefix_candidates(rk, [1, 2]).orderBy("candidate_id").collect()
    assert [(s.name, s.features) for s in sets] == [("a", ["x"]), ("b", ["y"]), ("b", ["x", "y"])]
    one = spark.createDataFrame([("p", 1, ["b", "a"]), ("p", 2, ["c"])], "origin string, place int, features array<string>")
    two = spark.createDataFrame([("q", 1, ["a", "b"]), ("q", 2, ["d"])], "origin string, place int, features array<string>")
    assert [(m.origin, m.features) for m in selection.merged_sets([one, two], top=9).orderBy("feature_set_id").collect()] == [("p", ["a", "b"]), ("p", ["c"]), ("q", ["d"])]
    pools = selection.candidate_pools(spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1)], "name string, score double, size int"), rk, pools=1, include=["a"])
    assert only(pools).features == ["x", "y"]
    ranked = spark.createDataFrame([(f"v{k}", k) for k in range(1, 6)], "feature string, order int")
    assert [s.set_name for s in rankings.prefix_sets(ranked, [1, 3], whole=True).orderBy("size").collect()] == ["top_01", "top_03", "top_05"]


def test_joins(spark):
    a = spark.createDataFrame([("x", 1, 5)], "k string, s int, only_a int")
    b = spark.createDataFrame([("x", 2, 6)], "k string, s int, only_b int")
    assert selection.suffix_join(a, b, "k", ("_final", "_outer")).columns == ["k", "s_final", "only_a", "s_outer", "only_b"]
    assert selection.missing_keys(a, b.where("false"), ["k"]).collect() == [("x",)]
    predicted = spark.createDataFrame([("x", 9, 1), ("x", 8, 0)], "k string, s int, sample_index int")
    assert only(selection.with_fallback(predicted, a, ["k"], ["s"])).s == 8


def test_parsing(spark):
    row = spark.createDataFrame([("['a', 'b']", '["c"]', "x, y", "one", '{"k": 12}', "mi_top05", "a b//c")], "p string, j string, c string, s string, d string, n string, f string")
    got = row.select(
        parsing.names_from_text(F.col("p")), parsing.names_from_text(F.col("j")), parsing.names_from_text(F.col("c")), parsing.names_from_text(F.col("s")), parsing.list_or_nothing(F.col("s")),
        parsing.dict_from_text(F.col("d")), parsing.set_name_parts(F.col("n")), parsing.safe_name(F.col("f")), parsing.config_id(F.col("s"), F.lit(7), F.lit("m")),
        parsing.prescreen_of(F.lit("ps__k_003__m")), parsing.variable_number(F.lit("var_42")), parsing.set_key(F.array(F.lit("b"), F.lit("a"), F.lit("b"))),
        parsing.paid_sources(F.array(F.lit("d"), F.lit("var_2"), F.lit("z")), F.create_map(F.lit("d"), F.array(F.lit("var_10"), F.lit("var_2")))),
    ).first()
    assert tuple(got)[:5] == (["a", "b"], ["c"], ["x", "y"], ["one"], [])
    assert (got[5], tuple(got[6]), got[7], got[8], got[9], got[10]) == ({"k": "12"}, ("mi", 5), "a_b_c", "one__k_007__m", "ps", 42)
    assert (got[11], got[12]) == (["a", "b"], ["var_2", "var_10", "z"])
    with pytest.raises(Exception, match="no variable name"):
        row.select(parsing.variable_number(F.lit("x"))).collect()


def test_feature_filters(spark):
    corr = np.array([[1.0, 0.9, 0.0], [0.9, 1.0, 0.0], [0.0, 0.0, 1.0]])
    assert features.prune_correlated(["a", "b", "c"], corr, {"a": 1, "b": 2, "c": 0}) == ["b", "c"]
    assert features.prune_inflated(["a", "b", "c"], corr) == ["c"]
    long = spark.createDataFrame([(k, f, float(v), k % 2) for k in range(40) for f, v in (("x", k % 2), ("z", 1.0))], "id long, feature string, value double, y int")
    assert {r.feature: round(r.abs_corr, 9) for r in rankings.abs_corr(long).collect()} == {"x": 1.0, "z": 0.0}
    vectors = spark.createDataFrame([([float(k % 2), 1.0, 5.0 - k % 2, None if k == 3 else 1e9 + k],) for k in range(40)] + [(None,), ([],)], "v array<double>").repartition(3)
    matrix = features.correlation_matrix(vectors, "v", [0, 1, 2, 3])
    assert abs(matrix[0, 0] - 1) < 1e-9 and np.isnan(matrix[0, 1]) and abs(matrix[0, 2] + 1) < 1e-9
    kept = [k for k in range(40) if k != 3]
    assert abs(matrix[0, 3] - np.corrcoef([k % 2 for k in kept], kept)[0, 1]) < 1e-9
    assert [(r.a, r.b) for r in features.correlated_pairs(vectors, "v", size=3, least=0.9).collect()] == [(0, 2)]
    assert features.correlated_pairs(vectors.limit(0), "v", size=3, least=0.0).collect() == []
    basis = features.spline_basis(np.linspace(0, 1, 11), np.linspace(0, 1, 4))
    assert basis.shape == (11, 5) and (basis >= 0).all()
    assert features.collapse_basis(np.array([1.0, -2.0, 3.0, 4.0]), 2).tolist() == [3.0, 7.0]
    assert only(features.class_weight(scored(spark, [1, 0, 0], [0, 0, 0]))).scale_pos_weight == 2.0
    assert only(features.class_weight(scored(spark, [0, 0], [0, 0]))).scale_pos_weight == 1.0


def matrix(spark, n=240, width=4):
    r = np.random.default_rng(0)
    x = r.normal(size=(n, width))
    y = (x[:, 0] + 0.3 * r.normal(size=n) > 0).astype(int)
    return spark.createDataFrame([(k, int(y[k]), x[k].tolist()) for k in range(n)], "id long, y int, features array<double>")


def auc(df) -> float:
    return only(metrics.roc_auc(df)).roc_auc


@pytest.mark.parametrize("name", ["logistic", "random_forest", "boosted", "extra_trees", "pairwise"])
def test_estimators_rank_better_than_chance(spark, name):
    fits = {
        "logistic": models.logistic(c=1.0), "random_forest": models.random_forest(trees=10, depth=3), "boosted": models.boosted(trees=5, depth=2),
        "extra_trees": models.extra_trees(trees=16, depth=4), "pairwise": models.pairwise_ranker(pairs=500),
    }
    df = matrix(spark)
    assert auc(fits[name](df.where("id % 2 = 0")).score(df.where("id % 2 = 1"))) > 0.85


def test_out_of_fold_and_calibration(spark):
    df = matrix(spark)
    f = folds.outer_folds(df, n_splits=2)
    scores = models.out_of_fold(df, f, models.logistic())
    assert scores.where("status = 'ok'").count() == df.count() and auc(scores) > 0.85
    broken = models.out_of_fold(df, f, lambda train: 1 / 0).collect()
    assert {r.status for r in broken} == {"error: ZeroDivisionError"}
    flat = models.calibrated(scores, scores).agg(F.min("score").alias("a"), F.max("score").alias("b")).first()
    assert 0 <= flat.a <= flat.b <= 1


def test_segments_and_features(spark):
    df = matrix(spark)
    train, test = models.kmeans_clusters(df.where("id % 2 = 0"), df.where("id % 2 = 1"), k=2, restarts=1)
    assert models.per_cluster_scores(train, test, models.logistic(), models.logistic(), least=20).count() == test.count()
    mixed, = models.mixture_segments(df, k=2, components=2, restarts=1)
    assert mixed.count() == df.count()
    assert int(np.argmax(models.l1_feature_scores(df))) == 0
    assert int(np.argmax(models.spline_feature_scores(df))) == 0
    assert int(np.argmax(models.forest_feature_scores(df, models.boosted(trees=3, depth=2)))) == 0
    scorer = models.logistic()(df)
    assert int(np.argmax(models.permutation_ranking(df, scorer, auc, 4))) == 0
    assert models.kmeans_diagnostics(df, [2, 3]).count() == 2
    assert models.availability(spark).count() == len(models.KIND)


def test_committee_and_fan_out(spark):
    df = matrix(spark)
    f = folds.outer_folds(df, n_splits=2)
    fused = models.committee(df, f, {"a": (models.logistic(), [0, 1]), "b": (models.logistic(), [0])})
    assert auc(fused.join(df.select("id", "y"), "id")) > 0.85
    tasks = spark.createDataFrame([(1, 1, [0]), (1, 2, [0]), (2, 1, [99])], "task_id long, fold int, places array<int>")
    got = models.evaluate_tasks(df.join(f.withColumnRenamed("outer_fold", "fold"), "id"), tasks, trees=4)
    assert {(r.task_id, r.status) for r in got.collect()} == {(1, "ok"), (2, "error")}
    assert scoring.from_blocks(got).count() == df.count()


def test_fan_out_of_a_table_that_is_not_collected(spark):
    df = matrix(spark, n=2000)
    f = folds.outer_folds(df, n_splits=2).withColumnRenamed("outer_fold", "fold")
    tasks = spark.createDataFrame([(1, 1, [0, 1]), (1, 2, [0, 1]), (2, 1, [99]), (3, 2, [2]), (4, 9, [0])], "task_id long, fold int, places array<int>")
    rows = df.join(f, "id")
    runs = [models.evaluate_tasks(rows.repartition(n), tasks, trees=30).cache() for n in (3, 7)]
    assert {(r.task_id, r.status) for r in runs[0].collect()} == {(1, "ok"), (2, "error"), (3, "ok"), (4, "ok")}
    first, again = ({(r.task_id, r.sample_index): (r.fold, r.score) for r in scoring.from_blocks(g).collect()} for g in runs)
    assert first == again and len(first) == df.count() + rows.where("fold = 2").count()
    ones = scoring.from_blocks(runs[0]).where("task_id = 1").select(F.col("sample_index").alias("id"), F.col("y_true").alias("y"), "score")
    own = {r.id: r.score for r in models.out_of_fold(df, rows.select("id", F.col("fold").alias("outer_fold")), models.extra_trees(trees=30, depth=4)).collect()}
    assert auc(ones) > 0.9 and len(own) == df.count()
    # A node holds the balanced share of positives of every training row that reaches it.
    (feature, threshold, value), = models.grow_spread_trees(rows, [(1, 1, [0, 1])], trees=1, depth=3, leaf=8).values()
    train = rows.where("fold <> 1").collect()
    x, y = np.array([r.features[:2] for r in train]), np.array([r.y for r in train])
    at = models.reached_nodes(feature, threshold, x)
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for node in set(at):
        assert (at == node).sum() >= 8 and abs(value[node] - (w * y)[at == node].sum() / w[at == node].sum()) < 1e-12


def test_sources(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1 2 oops\n3  4 5\n6 7 8\n")
    (tmp_path / "y.txt").write_text("y\n1\n2\n0\n")
    rows = tables.read_training(spark, str(tmp_path / "x.txt"), str(tmp_path / "y.txt")).orderBy("id").collect()
    # The second file's header pairs with the first line: labels 1 and 2 belong to the lines after it, 0 to none.
    assert [(r.id, r.y, r.features) for r in rows] == [(0, 1, [3.0, 4.0, 5.0])]
    ranking = selection.top_targets(scored(spark, *FIVE).withColumn("id", F.col("id") * 10), 2)
    tables.export_ranking(ranking, ["var_1", "var_42"], {"approach": "a", "oof_business_score": 3.5, "features": ["var_1"]}, str(tmp_path / "a"))
    assert [r.value for r in spark.read.text(str(tmp_path / "a/customers")).collect()] == ["1", "11"]
    assert [r.value for r in spark.read.text(str(tmp_path / "a/variables")).collect()] == ["2", "43"]
    summaries = tables.read_summaries(spark, str(tmp_path), ["a", "b"])
    assert only(tables.compared_approaches(summaries)).score == 3.5
    assert tables.missing_approaches(summaries, ["a", "b"]).collect() == [("b",)]
    assert tables.read_json_or(spark, str(tmp_path / "none.json"), 7) == 7
    assert tables.read_csv_or_empty(spark, str(tmp_path / "none.csv"), "a int").columns == ["a"]
    built = []
    for _ in range(2):
        tables.load_or_build(spark, str(tmp_path / "t"), lambda: built.append(1) or spark.range(3)).count()
    assert built == [1]
    tables.log_event(spark, str(tmp_path / "log"), "s", "m", a=1)
    tables.log_event(spark, str(tmp_path / "log"), "s", "m", b="x")
    assert sorted(len(r.payload) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [1, 1]
    (tmp_path / "p.csv").write_text("outer_fold,round_name\n1,r\n")
    assert tables.has_columns(spark, str(tmp_path / "p.csv"), ["outer_fold"]) and not tables.has_columns(spark, str(tmp_path / "p.csv"), ["x"])
    assert tables.prediction_contexts(inner_rows(spark), rounds=["r1"]).collect() == [(1, "r1")]


def test_shared_root_wants_a_shared_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        def __init__(self, master):
            self.sparkContext = type("Context", (), {"master": master})

    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,3000]", "k8s://h"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared.shared_root(Session(master))
    for master in ("local", "local[8]", "local[*]"):
        assert shared.shared_root(Session(master)).startswith("file:///")


def test_training_rows_are_matched_by_line(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1 1\n? ?\n\n3 3\n4 4 9\n")
    (tmp_path / "y.txt").write_text("1\n0\n1\n   \n0\n")
    rows = tables.read_training(spark, str(tmp_path / "x.txt"), str(tmp_path / "y.txt")).orderBy("id").collect()
    assert [(r.id, r.y, r.features) for r in rows] == [(0, 1, [1.0, 1.0, 0.0]), (1, 0, [0.0, 0.0, 0.0]), (2, 1, [3.0, 3.0, 0.0]), (3, 0, [4.0, 4.0, 9.0])]
    assert [(r.sample_index, r.features) for r in tables.read_matrix(spark, str(tmp_path / "x.txt")).orderBy("sample_index").collect()] == [(0, [1.0, 1.0, 0.0]), (1, [3.0, 3.0, 0.0]), (2, [4.0, 4.0, 9.0])]


def test_long_matrices_of_many_blocks(spark, tmp_path):
    n, part = 30_000, spark.conf.get("spark.sql.files.maxPartitionBytes")
    (tmp_path / "x.txt").write_text("".join(f"{k} {'?' if k % 2 else k} {'x' * (k % 50)}\n" if k % 5 else "? header\n" for k in range(n)))
    (tmp_path / "y.txt").write_text("".join(f"{2 if k % 7 == 0 else k % 2}\n" for k in range(n)))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
        matrix = tables.read_matrix(spark, str(tmp_path / "x.txt"))
        assert [(r.sample_index, r.features[0]) for r in matrix.orderBy("sample_index").collect()] == list(enumerate(float(k) for k in range(n) if k % 5))
        train = tables.read_training(spark, str(tmp_path / "x.txt"), str(tmp_path / "y.txt"))
        want = [(j, k % 2, float(k) if k % 5 else 0.0) for j, k in enumerate(k for k in range(n) if k % 7)]
        assert [(r.id, r.y, r.features[0]) for r in train.orderBy("id").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", part)


@pytest.fixture()
def stage_folder(tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data/x_train.txt").write_text("var_0 var_1\n1 2\n3 4\n")
    (tmp_path / "data/y_train.txt").write_text("y\n1\n0\n")
    (tmp_path / "data/x_test.txt").write_text("var_0 var_1\n5 6\n")
    (tmp_path / "outputs").mkdir()
    (tmp_path / "outputs/stage3_feature_set_scores.csv").write_text("feature_set_name,feature_count,features\ntop_01,1,\"['var_1']\"\ntop_02,2,\"['var_1', 'var_0']\"\n")
    (tmp_path / "outputs/feature_selection_results.csv").write_text("feature,order\nvar_1,1\nvar_0,2\n")
    return str(tmp_path)


def test_root_folder(stage_folder, monkeypatch):
    assert tables.find_root(f"{stage_folder}/data") == stage_folder
    with pytest.raises(FileNotFoundError):
        tables.find_root("/proc", marker="no such file at all")
    seen = Path.exists

    def exists(path):
        if str(path).startswith(f"{stage_folder}/data/closed"):
            raise PermissionError(13, "Permission denied")
        return seen(path)

    monkeypatch.setattr(Path, "exists", exists)
    assert tables.find_root(f"{stage_folder}/data/closed/deep") == stage_folder


def test_stage_tables(spark, stage_folder):
    context = tables.run_context(spark, stage_folder, "a")
    assert [r.features for r in context["widest"].orderBy("id").collect()] == [[2.0, 1.0], [4.0, 3.0]] and context["outputs"] == f"{stage_folder}/outputs/a"
    assert [r.features for r in context["test"].collect()] == [[5.0, 6.0]]
    assert tables.stage_data(spark, f"{stage_folder}/data", f"{stage_folder}/outputs", without=["top_02"])["candidates"].count() == 1
    assert [(r.set_name, r.features) for r in tables.feature_sets_from_selection(spark, f"{stage_folder}/outputs").orderBy("size").collect()] == [("top_01", ["var_1"]), ("top_02", ["var_1", "var_0"])]


def test_cached_artefacts(spark, stage_folder):
    made = []
    build = lambda: made.append(1) or {"a": len(made)}
    assert [tables.load_or_build_json(spark, f"{stage_folder}/j.json", build, force=f) for f in (False, False, True)] == [{"a": 1}, {"a": 1}, {"a": 2}]
    assert tables.usable_outputs(spark, f"{stage_folder}/none", ["j.json"], legacy=stage_folder) == stage_folder and tables.usable_outputs(spark, stage_folder, ["j.json", "k"]) is None
    tables.write_search_results(spark, stage_folder, "m", {"C": 1}, 2.5)
    assert tables.read_json_or(spark, f"{stage_folder}/hpo/hpo_summary.json") == {"m": {"best_params": {"C": 1}, "cv_business_mean": 2.5}}


def test_baseline_reference_rows(spark, stage_folder):
    tables.write_json(spark, f"{stage_folder}/b.json", {"summary": {"k0_reference": {"business_with_var_penalty": 0}, "prior_dummy": {"business_with_var_penalty": {"mean": 5.0}}, "logistic_500feat_x": {"business_no_var_penalty": {"mean": 7}}}})
    got = tables.baseline_reference_rows(spark, f"{stage_folder}/b.json", ["prior_dummy", "logistic_500feat_x", "absent"]).collect()
    assert [tuple(r) for r in got] == [("baseline_k0", 0, 0.0, None), ("baseline_prior_dummy", 0, 5.0, None), ("baseline_logistic_500feat_x", 500, None, 7.0)]
    assert tables.baseline_reference_rows(spark, f"{stage_folder}/none.json", ["x"]).collect() == []


def test_expanded_grids():
    specs = recipes.expanded_specs()
    count = lambda family, found=specs: sum(f == family for _, f, _, _ in found)
    assert [count(f) for f in ("extra_trees", "random_forest", "lightgbm", "logistic", "xgboost", "additive", "ranker")] == [8, 6, 8, 6, 8, 0, 3]
    assert count("additive", recipes.expanded_specs(additive=True)) == 3 and count("xgboost", recipes.expanded_specs(xgboost=False)) == 0 == count("ranker", recipes.expanded_specs(ranker=False))
    by_id = {i: p for i, _, _, p in specs}
    assert by_id["lightgbm_deep07"] == {"n_estimators": 260, "learning_rate": 0.04, "num_leaves": 15, "min_child_samples": 40, "subsample": 0.8, "colsample_bytree": 0.8}
    assert by_id["extra_trees_deep08"]["class_weight"] is None and by_id["xgboost_deep08"]["reg_lambda"] == 3.0 and "subsample" not in by_id["xgboost_deep08"]


def test_recipes_of_an_inner_stage(spark, tmp_path):
    rows = [("1", "2.0", "ps1__k_002__m1", None), ("x", "1", "ps2__k_001__m1", "ps2"), ("2", "1", "ps3__k_001__m2", "")]
    raw = spark.createDataFrame(rows, "outer_fold string, feature_size string, recipe_config_id string, prescreen_recipe_id string")
    assert [(r.outer_fold, r.feature_size, r.prescreen_recipe_id, r.inner_selection_rank) for r in tables.normalised_recipes(raw).orderBy("outer_fold").collect()] == [(1, 2, "ps1", 1), (2, 1, "ps3", 1)]
    folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        tables.load_or_select_recipes(spark, folder, score=scoring.inner_scores)


def test_exact_quantiles_over_ranges(spark):
    r = np.random.default_rng(5)
    groups = {"a": r.normal(size=1001), "b": np.full(300, 2.5), "c": np.array([1.0, 4.0]), "d": np.array([7.0]), None: r.integers(0, 5, 400).astype(float)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("e", None)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {x.g: x.q for x in ranges.quantiles(table.where("g IS NOT NULL"), "g", "v", (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    for g, q in got.items():
        assert np.allclose(q, np.quantile(groups[g], (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)), atol=1e-12)
    assert ranges.quantiles(table.limit(0), "g", "v", (0.5,)).collect() == []


def test_records_of_scored_predictions(spark):
    s = scored(spark, *FIVE)
    record = only(records.scored_record(s, ["var_1", "var_2", "var_1"], method="m", columns=7, cap=3))
    assert (record.oof_business_score, record.oof_optimal_k, record.oof_tp_at_optimal_k, record.oof_fp_at_optimal_k, record.source_feature_count, record.candidate_column_count) == (-380.0, 2, 2, 0, 2, 7)
    assert (record.gross_score, record.feature_penalty, record.oof_selected_rate, record.f1_score, record.roc_auc_score) == (20.0, 400.0, 0.4, 1.0, 1.0)
    assert record.source_features == ["var_1", "var_2"]
    alike = only(records.scored_record(scored(spark, [1, 1], [0.9, 0.8]), ["a"], method="m"))
    assert alike.f1_score is None and alike.roc_auc_score is None
    scaled = only(records.scaled_record(scored(spark, [1, 1, 0, 0, 0], [0.95, 0.9, 0.4, 0.3, 0.2]), ["a", "b"], method="m", cap=3, reference_rows=10))
    assert (scaled.oof_business_score, scaled.oof_business_score_unscaled_feature_cost, scaled.oof_business_value_before_feature_cost, scaled.oof_optimal_k) == (-190.0, -390.0, 10.0, 2)
    assert (scaled.feature_cost_scale, scaled.scaled_true_positive_value, scaled.scaled_feature_cost, scaled.target_limit, scaled.evaluation_row_count) == (0.5, 5.0, 200.0, 3, 5)
    point = only(records.best_f1(s, cap=2))
    assert (point.f1_k, point.best_f1) == (2, 1.0)


def test_random_baselines_know_nothing(spark):
    rows = [(1, "r", k, int(k % 3 == 0)) for k in range(3000)]
    samples = spark.createDataFrame(rows, "outer_fold int, round_name string, id long, y int")
    got = records.random_baselines(samples, ["outer_fold", "round_name"], repeats=3, cap=500).collect()
    assert {r.random_repeat for r in got} == {0, 1, 2} and all(abs(r.roc_auc_score - 0.5) < 0.05 and 0 <= r.k <= 500 for r in got)
    again = records.random_baselines(samples.repartition(7), ["outer_fold", "round_name"], repeats=3, cap=500).collect()
    assert sorted(again) == sorted(got)
    p = inner_rows(spark)
    base = scoring.baselines(p, cap=3, random_repeats=2)
    assert base.where("baseline = 'random_score'").count() == 2
    manifest = spark.createDataFrame([(1, k, 1) for k in range(4)], "outer_fold int, sample_index long, y int")
    by_manifest = {r.baseline: r.business_score for r in scoring.baselines(p, cap=3, manifest=manifest).collect()}
    assert by_manifest["select_all_0"] == 30 and by_manifest["select_all_full_1"] == -160
    assert scoring.with_baselines(scoring.inner_scores(p, cap=3), base).count() == 2


def test_blocks_that_failed_have_a_row(spark):
    block = "block array<struct<sample_index: long, y_true: int, score: double>>"
    rows = [(1, "r1", "a", 1, 1, [(0, 1, 0.9), (1, 0, 0.1)], "ok", None, 2.0), (1, "r1", "a", 2, 1, [(2, 1, 0.8)], "ok", None, 4.0), (1, "r1", "b", 1, 1, [(0, 1, 0.9)], "ok", None, 1.0), (1, "r1", "b", 2, 1, [], "error", "boom", 1.0)]
    blocks = spark.createDataFrame(rows, f"outer_fold int, round_name string, pipeline_recipe_id string, inner_fold int, feature_size int, {block}, status string, error string, duration_seconds double")
    got = {r.pipeline_recipe_id: r for r in scoring.block_scores(blocks).collect()}
    assert (got["a"].status, got["a"].oof_score, got["a"].error, got["b"].status, got["b"].oof_score, got["b"].error) == ("ok", -180, None, "error", None, "boom")
    assert abs(got["a"].mean_duration_seconds - 8 / 3) < 1e-9


def test_summaries_of_baselines_and_experts(spark):
    scores = spark.createDataFrame([("b", 2, 3.0), ("b", 1, 1.0)], "name string, fold int, m double")
    row = only(records.fold_summary(scores, ["m"]))
    assert (row["mean"], row["std"], row.folds) == (2.0, 1.0, [1.0, 3.0])
    s = scored(spark, *FIVE).withColumn("fold", F.lit(1))
    each = only(records.fold_scores(s, 1, cap=2))
    assert (each.business_with_var_penalty, each.business_no_var_penalty, each.f1_topk) == (-180.0, 20.0, 1.0)
    experts = spark.createDataFrame([("x", "m", "top_1", ["var_2", "d"], 1.0, 0.1, 0.25), ("y", "m", "top_2", ["var_10"], 2.0, 0.1, 0.75)], "expert string, model string, feature_set string, features array<string>, cv_business_mean double, cv_business_std double, weight double")
    assert [(r.expert, r.n_features) for r in records.experts_summary(experts).collect()] == [("y", 1), ("x", 2)]
    assert sorted(r.feature for r in records.union_features(experts).collect()) == ["d", "var_10", "var_2"]
    sources = spark.createDataFrame([("d", ["var_10", "var_1"])], "feature string, originals array<string>")
    assert {r.expert: r.paid for r in records.distinct_paid(experts, sources).collect()} == {"x": ["var_1", "var_2", "var_10"], "y": ["var_10"]}


def test_searches(spark):
    df = shared.written(matrix(spark, n=120, width=3).coalesce(1), "t")
    f = shared.written(folds.outer_folds(df, n_splits=2).coalesce(1), "t")
    with pytest.raises(ValueError, match="not both"):
        search.parameter_search(df, f, models.logistic, features=1, grid={"c": [1.0]}, choices={"c": [1.0]})
    drawn = search.drawn_points(search.LEAFWISE_CHOICES, 20)
    assert len(drawn) == 20 == len({tuple(sorted(p.items())) for p in drawn}) and len(search.drawn_points({"a": [1, 2]}, 9)) == 2
    saved = []
    fit, params, score = search.winner_search(df, f, "logistic_regression", features=3, grid={"C": [1.0], "l1_ratio": [0.0]}, save=lambda *a: saved.append(a))
    assert params == {"C": 1.0, "l1_ratio": 0.0} and saved == [("logistic_regression", params, score)]
    assert auc(fit(df).score(df)) > 0.9 and fit(df).score(df).columns == [*df.columns, "score"]
    assert search.nonzero_features([0.0, 2.0], ["a", "b"]) == ["b"] and search.nonzero_features([1.0], ["a", "b"]) == ["a", "b"]
    path = [{"c": c, "nonzero": n, "coefficients": [1.0] * n + [0.0] * (4 - n), "score": s} for c, n, s in ((1, 0, 99.0), (2, 1, 5.0), (3, 2, 3.0), (4, 4, 9.0))]
    names = list("abcd")
    assert search.banded_features(path, names, band=(1, 2)) == ["a"] and search.banded_features(path, names, band=(3, 3)) == names and search.banded_features(path, names, target=2) == ["a", "b"]
    assert search.banded_features(path[:1], names) == []
    real = search.sparse_path(df, f, cs=(0.05,))
    assert 0 < real[0]["nonzero"] <= 3
    greedy = search.greedy_selection(df, f, models.logistic(iterations=5), ["var_0", "var_1"], most=2)
    assert greedy[0][0] == "var_0" and len(greedy) == 1
    assert search.without_features(df).first().features == []
    assert len(recipes.search_specs()) == 15 and recipes.model_specs(spark, recipes.search_specs(["logistic"])).count() == 3


def test_rankings_by_method(spark):
    df = shared.written(matrix(spark, n=120, width=3).coalesce(1), "t")
    f = shared.written(folds.outer_folds(df, n_splits=2).coalesce(1), "t")
    long, failed = search.collected_rankings(df, ["abs_corr", "nothing", "mutual_info"])
    assert [r.method for r in failed.collect()] == ["nothing"] and long.count() == 6
    with pytest.raises(ValueError, match="nothing"):
        search.ensemble_ranking(df, ["abs_corr", "nothing"])
    ranking = search.ensemble_ranking(df, ["abs_corr", "logistic_l1", "pairwise_sparse"])
    assert ranking.orderBy("order").first().feature == "var_0" and "score__pairwise_sparse" in ranking.columns
    named = shared.written(ranking, "t").select(F.lit("r").alias("name"), "feature", "order")
    judged = search.evaluated_rankings(df, f, named.unionByName(named.withColumn("name", F.lit("s"))), models.logistic(), sizes=(1, 2, 9)).collect()
    assert [(r.prescreen_name, r.feature_set_name) for r in judged] == [("r", "top_01"), ("s", "top_01"), ("r", "top_02"), ("s", "top_02")]
    both = search.component_comparison(df, f, models.logistic(), [2]).collect()
    assert {r.method for r in both} == {"raw", "pca_2"} and both[0].roc_auc_score > 0.9
    verdicts = {n: v for n, _, v in search.shadow_selection(df, 3, rounds=6, fit=models.random_forest(trees=10))}
    assert verdicts["var_0"] == "confirmed"
    best = only(features.best_univariate_feature(df))
    assert best.feature == "var_0" and best.abs_corr > 0.5
    report = spark.createDataFrame([("s", 0, 5, 0.1), ("s", 1, 7, 0.4)], "feature_set string, cluster int, n long, rate double")
    assert tuple(only(features.cluster_set_summary(report))) == ("s", 2, 5, 7, 0.1, 0.4)


def test_comparisons_of_models(spark):
    df = shared.written(matrix(spark, n=120, width=3).coalesce(1), "t")
    f = shared.written(folds.outer_folds(df, n_splits=2).coalesce(1), "t")
    both = models.compare(df, f, {"good": [0], "bad": [2]}, {"m": models.logistic()}).collect()
    assert {r.feature_set: r.n_features for r in both} == {"good": 1, "bad": 1}
    assert {r.feature_set: r.score for r in both}["good"] > {r.feature_set: r.score for r in both}["bad"]
    dropped = models.drop_column_ranking(df.withColumn("features", F.slice("features", 1, 2)), f, models.logistic(iterations=5), 2).collect()
    assert dropped[0].feature == "var_0" and dropped[0].delta < dropped[-1].delta
    assert models.grid_search(df, f, lambda **p: models.logistic(iterations=5, **p), [{"c": 1.0}], features=3).count() == 1


def test_permuted_values_come_from_all_rows(spark):
    df = matrix(spark, n=200, width=3)

    class First:
        def score(self, table):
            return table.withColumn("score", F.col("features")[0])

    loss = models.permutation_ranking(df, First(), lambda t: auc(t.select("id", "y", "score")), 3)
    assert loss[0] > 0.3 and abs(loss[1]) < 1e-12 and abs(loss[2]) < 1e-12


def test_boosters_on_held_out_rows(spark):
    df = shared.written(matrix(spark, n=600, width=5), "t")
    train, test = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    for make in (boosters.leafwise_boosted(trees=20), boosters.leafwise_boosted(trees=20, depth=2, leaves=4, leaf=1), boosters.lambdamart(trees=20), boosters.additive_boosted(rounds=30)):
        fitted = make(train)
        assert auc(fitted.score(test)) > 0.9 and fitted.score(test).columns == [*test.columns, "score"]
        assert fitted.score(test.limit(0)).count() == 0
        weights = fitted.importance if isinstance(fitted, boosters.Additive) else fitted.gains
        assert int(np.argmax(weights)) == 0
    scores = boosters.best_subset_scores(train, sizes=(1, 2))
    assert scores[0] > 0 and sum(s > 0 for s in scores) <= 2
    with pytest.raises(ValueError, match="no training rows"):
        boosters.leafwise_boosted()(train.limit(0))


def test_lambda_gradients_match_brute_force():
    r = np.random.default_rng(2)
    y, score = (r.random(30) < 0.3).astype(float), r.normal(size=30)
    place = {i: k for k, i in enumerate(np.argsort(-score, kind="stable"))}
    ideal = sum(1 / np.log2(k + 2) for k in range(int(y.sum())))
    g, h = np.zeros(30), np.zeros(30)
    for i in range(30):
        for j in range(30):
            if y[i] == 1 and y[j] == 0:
                p = 1 / (1 + np.exp(score[i] - score[j]))
                stake = abs(1 / np.log2(place[i] + 2) - 1 / np.log2(place[j] + 2)) / ideal
                g[i], g[j] = g[i] + p * stake, g[j] - p * stake
                h[i], h[j] = h[i] + p * (1 - p) * stake, h[j] + p * (1 - p) * stake
    got = boosters.lambda_gradients(y, score, at_once=4)
    assert np.allclose(got[0], g) and np.allclose(got[1], h)


def test_splicing_finds_the_subset_that_all_subsets_would():
    from itertools import combinations

    r = np.random.default_rng(3)
    x = r.normal(size=(400, 7))
    x[:, 6] = x[:, 0] + x[:, 1] + 0.3 * r.normal(size=400)  # strongest alone, of no use beside the two
    y = (1.5 * x[:, 0] + 1.5 * x[:, 1] - x[:, 3] + r.logistic(size=400) > 0).astype(float)
    want = min(combinations(range(7), 3), key=lambda c: boosters._newton(x[:, list(c)], y)[2])
    assert tuple(boosters.spliced_subset(x, y, 3)[0]) == want == (0, 1, 3)


def test_leafwise_trees_split_where_there_is_most_to_gain():
    x = np.arange(100.0)[:, None]
    g = np.where(x[:, 0] < 90, 0.0, 1.0) + np.where(x[:, 0] < 50, -0.2, 0.0)
    gains = np.zeros(1)
    tree, out = boosters.grow_leafwise(boosters.binned(x, 200), g, np.ones(100), leaves=3, depth=9, leaf=1, ridge=1e-12, gains=gains)
    assert [int(t) for t in sorted(t for f, t in zip(tree.feature, tree.threshold) if f == 0)] == [49, 89] and gains[0] > 0
    assert np.allclose(out, g) and np.allclose(tree.predict(x), g)


def test_predictions_from_a_csv_file(spark, tmp_path):
    path = str(tmp_path / "p.csv")
    inner_rows(spark).unionByName(inner_rows(spark).withColumn("outer_fold", F.lit(2))).coalesce(1).write.csv(path, header=True)
    file = next(str(f) for f in (tmp_path / "p.csv").iterdir() if f.name.startswith("part"))
    got = {r.pipeline_recipe_id: r for r in tables.scored_predictions_csv(spark, file, outer_folds=[1], cap=3, random_repeats=1, scores_path=str(tmp_path / "s"), baselines_path=str(tmp_path / "b")).collect()}
    assert (got["fr2__m1"].oof_score, got["fr2__m1"].beats_select_all_1, got["fr1__m1"].beats_select_all_1) == (-180, True, False)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2 and spark.read.parquet(str(tmp_path / "b")).where("baseline = 'random_score'").count() == 1
    (tmp_path / "q.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="lacks"):
        tables.scored_predictions_csv(spark, str(tmp_path / "q.csv"))


def test_specs_on_feature_sets(spark):
    df = shared.written(matrix(spark, n=120, width=3).coalesce(1), "t")
    f = shared.written(folds.outer_folds(df, n_splits=2).coalesce(1), "t")
    specs = [("a", "additive", "classifier", {"max_bins": 8}), ("l", "lightgbm", "classifier", {"n_estimators": 5, "num_leaves": 4, "min_child_samples": 5}), ("x", "nothing", "classifier", {})]
    got = {(r.model_spec_id, r.feature_set_id): r for r in search.evaluated_specs(df, f, specs, {"good": ["var_0"], "gone": ["var_9"]}).collect()}
    assert got["a", "good"].status == got["l", "good"].status == "ok" and got["a", "good"].roc_auc_score > 0.8
    assert {got[k].status for k in got if k[0] == "x" or k[1] == "gone"} == {"error"} and "nothing" in got["x", "good"].error
    for _, family, _, params in (*recipes.default_model_specs(), *recipes.search_specs()):
        search.fit_of_spec(family, params)
    ks = search.cluster_counts_by_set(df, {"s": ["var_0", "var_1"]}, [2, 3]).collect()
    assert [(r.feature_set, r.k) for r in ks] == [("s", 2), ("s", 3)] and ks[0].inertia > ks[1].inertia
