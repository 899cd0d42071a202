"""Fits of many models at once, inflation of dependent columns, permutations and ties."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F
from rankwright.functions import permute, ranges, shared
from rankwright.operators import boosters, fanout, features, folds, isotonic, models, paths, pipelines, recipes, records, search

from .test_operators import matrix


def inflation_brute(x):
    """1 / (1 - R2) by one least-squares regression a column."""
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1.0)
    out = []
    for k in range(x.shape[1]):
        rest = np.delete(x, k, 1)
        total = (x[:, k] ** 2).sum()
        left = ((x[:, k] - rest @ np.linalg.lstsq(rest, x[:, k], rcond=None)[0]) ** 2).sum()
        out.append(np.nan if total == 0 else np.inf if left < 1e-9 * total else total / left)
    return np.array(out)


def test_inflation_of_dependent_columns(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(200, 5))
    base[:, 4] += base[:, 3]
    for x in (base, np.c_[base, np.ones(200)], np.c_[base, base[:, 1]], np.c_[base, base[:, 0] + base[:, 2]], np.c_[base, 2 * base[:, 0], base[:, 0] - base[:, 1], np.zeros(200)], np.ones((200, 2)), base[:, :1]):
        with np.errstate(invalid="ignore", divide="ignore"):
            corr = np.atleast_2d(np.corrcoef(x.T))
        got, want = features.variance_inflation(corr), inflation_brute(x)
        assert np.isnan(got).tolist() == np.isnan(want).tolist() and np.isinf(got).tolist() == np.isinf(want).tolist()
        some = np.isfinite(want)
        assert np.allclose(got[some], want[some], rtol=1e-6)
    df = spark.createDataFrame([(k, [float(v) for v in (*row, 1.0, row[1])]) for k, row in enumerate(base)], "id long, features array<double>")
    rows = features.inflation_report(df, "features", 7, most=5.0).collect()
    assert [x.dependent for x in rows] == [False, True, False, False, False, False, True]
    assert [x.kept for x in rows] == [True, False, True, True, True, True, False] and rows[5].inflation is None
    assert features.prune_inflated(list("ab"), np.full((2, 2), np.nan)) == ["a", "b"] and features.prune_inflated([], np.zeros((0, 0))) == []


def test_models_fitted_together_equal_single_fits(spark):
    df = matrix(spark, n=300, width=5)
    outer = folds.outer_folds(df, n_splits=3)
    rows = shared.written(df.join(outer.select("id", F.col("outer_fold").alias("fold")), "id"), "t")
    tasks = [paths.LogisticTask(c, l, held) for c, l in ((0.02, 1.0), (0.3, 0.5), (5.0, 0.0)) for held in (None, 1, 3)]
    tasks += [paths.LogisticTask(1.0, 1.0, 2, (3, 0)), paths.LogisticTask(1.0, 1.0, 9)]
    fits = paths.fit_many(rows, tasks)
    for task, fit in zip(tasks, fits):
        own = rows if task.held_out is None else rows.where(F.col("fold") != task.held_out)
        if task.places is not None:
            own = own.withColumn("features", F.array(*(F.col("features")[p] for p in task.places)))
        single = models.logistic(c=task.c, l1_ratio=task.l1_ratio, iterations=300)(own).model
        assert fit.converged and np.abs(fit.coefficients - np.array(single.coefficients)).max() < 1e-4 and abs(fit.intercept - single.intercept) < 1e-4
    scores = paths.held_out_scores(rows, fits)
    assert {(r.model, r.fold) for r in scores.select("model", "fold").distinct().collect()} == {(k, t.held_out) for k, t in enumerate(tasks) if t.held_out in (1, 2, 3)}
    one = {r.id: r.score for r in scores.where("model = 9").collect()}
    held = rows.where("fold = 2").select("id", "features").collect()
    assert all(abs(one[r.id] - 1 / (1 + np.exp(-(fits[9].intercept + fits[9].coefficients @ [r.features[3], r.features[0]])))) < 1e-9 for r in held) and len(one) == len(held)
    # Few models a pass give the same.
    paths.CELLS, before = 60, paths.CELLS
    try:
        again = paths.fit_many(rows, tasks[:3])
    finally:
        paths.CELLS = before
    assert all(np.allclose(a.coefficients, b.coefficients, atol=1e-6) for a, b in zip(fits, again))
    none = paths.fit_many(rows.limit(0), tasks[:1])
    assert none[0].coefficients.tolist() == []
    odd = spark.createDataFrame([(1, 1, [1.0, None], 1), (2, 0, [0.5, 2.0], 1), (3, 1, None, 2), (4, None, [1.0, 1.0], 2), (5, 1, [float("nan"), 0.0], 2)], "id long, y int, features array<double>, fold int")
    assert all(np.isfinite(f.coefficients).all() for f in paths.fit_many(odd, [paths.LogisticTask(1.0), paths.LogisticTask(1.0, 0.5, 1)]))


def test_penalised_intercept(spark):
    df = matrix(spark, n=200, width=2).withColumn("fold", F.lit(1))
    weak, strong = paths.fit_many(df, [paths.LogisticTask(1e-4), paths.LogisticTask(1.0)], penalise_intercept=True, balanced=False)
    assert weak.intercept == 0 and not weak.coefficients.any() and strong.coefficients.any()


def test_path_and_filter(spark):
    df = shared.written(matrix(spark, n=240, width=4), "t")
    outer = shared.written(folds.outer_folds(df, n_splits=3), "t")
    path = search.sparse_path(df, outer, cs=(1e-4, 0.05, 1.0))
    assert [p["nonzero"] for p in path][0] == 0 and path[-1]["nonzero"] == 4 and path[1]["score"] > path[0]["score"]
    odd = df.withColumn("features", F.concat("features", F.array(F.lit(3.0), F.col("features")[0])))
    left = pipelines.multicollinearity_filter(odd, [f"var_{k}" for k in range(6)], outer, band=(1, 2))
    assert len({"var_0", "var_5"} & set(left)) == 1 and 1 <= len(left) <= 2 and "var_4" not in left
    assert len(pipelines.multicollinearity_filter(odd, [f"var_{k}" for k in range(6)], outer, target=4)) >= 3


@pytest.mark.parametrize("count", [1, 2, 3, 17, 64, 1000, 4097])
def test_permuted_places(count):
    for key in (0, 1, 12345678901):
        assert sorted(permute.permuted_places(np.arange(count), count, key).tolist()) == list(range(count))
    if count > 60:
        assert (permute.permuted_places(np.arange(count), count, 1) != permute.permuted_places(np.arange(count), count, 2)).mean() > 0.9


def test_columns_are_permuted_apart(spark):
    r = np.random.default_rng(0)
    common = r.normal(size=2000)
    rows = [(k, k % 2, [float(v), float(v), float(v) + 1e-3]) for k, v in enumerate(common)]
    df = spark.createDataFrame(rows, "id long, y int, features array<double>").repartition(5)
    got = models.with_mixed(df, 3).collect()
    x, mixed = np.array([g.features for g in got]), np.array([g.mixed for g in got])
    assert all(sorted(x[:, k]) == sorted(mixed[:, k]) for k in range(3))
    corr = np.corrcoef(np.c_[x, mixed].T)
    assert np.abs(corr[3:, :3]).max() < 0.1 and np.abs(corr[3:, 3:] - np.eye(3)).max() < 0.1


def test_ties_are_spread_and_counted(spark):
    df = spark.range(200_000).select(F.lit("g").alias("g"), F.when(F.col("id") < 180_000, 0.0).otherwise(F.col("id").cast("double")).alias("v"), "id")
    marked = ranges.in_ranges(df, ["g"], [F.col("v")], 8).groupBy("_part").count().collect()
    assert len(marked) >= 7 and max(r["count"] for r in marked) < 60_000
    q = ranges.quantiles(df, "g", "v", (0.0, 0.25, 0.89, 0.95, 1.0)).first().q
    v = np.r_[np.zeros(180_000), np.arange(180_000, 200_000)]
    assert np.allclose(q, np.quantile(v, (0.0, 0.25, 0.89, 0.95, 1.0)))
    odd = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("a", float("nan")), ("b", 2.0)], "g string, v double")
    assert {r.g: r.q for r in ranges.quantiles(odd, "g", "v", (0.5,)).collect()} == {None: [2.0], "b": [2.0]}
    k = ranges.placed(df, ["g"], [F.col("v")], ranges=8)
    assert k.agg(F.countDistinct("k").alias("n"), F.max("k").alias("m")).first()[:] == (200_000, 200_000) and k.where("k > 180000 AND v = 0").count() == 0


def test_fan_out_of_every_family(spark):
    df = shared.written(matrix(spark, n=240, width=4), "t")
    outer = shared.written(folds.outer_folds(df, n_splits=3), "t")
    small = {"extra_trees": {"n_estimators": 8}, "random_forest": {"n_estimators": 8, "class_weight": None, "max_depth": None}, "lightgbm": {"n_estimators": 10}, "xgboost": {"n_estimators": 10, "max_depth": 2}, "logistic": {"C": 0.5}, "additive": {}, "ranker": {}}
    specs = [*((f, json.dumps(p), [0, 1]) for f, p in small.items()), ("logistic", "{}", []), ("lightgbm", json.dumps({"bagging": 1}), [0]), ("nothing", "{}", [0]), ("logistic", "{}", [99])]
    rows = [(10 * k + f, 0, f, family, params, places) for k, (family, params, places) in enumerate(specs) for f in (1, 2, 3)]
    rows.append((999, 0, 9, "logistic", "{}", [0]))
    tasks = spark.createDataFrame(rows, fanout.TASKS)
    blocks = shared.written(fanout.fan_out(df, fanout.plain_split(outer), tasks), "t")
    per = {r.task_id: r for r in blocks.groupBy("task_id").agg(F.max("status").alias("s"), F.sum(F.size("block")).alias("n"), F.max("error").alias("e"), F.max("fit_seconds").alias("t")).collect()}
    assert set(per) == {r[0] for r in rows} and all(p.t >= 0 for p in per.values())
    assert sum(per[k].n for k in (1, 2, 3)) == 240 and per[999].s == "ok" and per[999].n == 0
    for k, text in ((7, "without features"), (8, "bagging"), (9, "nothing"), (10, "IndexError")):
        assert all(per[10 * k + f].s == "error" and text in per[10 * k + f].e and per[10 * k + f].n == 0 for f in (1, 2, 3))
    flat = fanout.predictions_of(blocks)
    assert flat.where("status LIKE 'error%' AND sample_index IS NULL").count() == 12
    for k in range(len(small)):
        own = flat.where(f"task_id BETWEEN {10 * k} AND {10 * k + 9} AND status = 'ok'")
        good = own.groupBy("y_true").agg(F.avg("score").alias("m")).orderBy("y_true").collect()
        assert own.count() == 240 and good[0].m < good[1].m
    fanout.PACK, before = 2000, fanout.PACK  # many packs give the same blocks
    try:
        again = fanout.predictions_of(fanout.fan_out(df, fanout.plain_split(outer), tasks))
    finally:
        fanout.PACK = before
    key = lambda t: sorted((r.task_id, r.sample_index or -1, round(r.score or 0, 9), r.status) for r in t.collect())
    assert key(again) == key(flat)
    assert {r.status for r in fanout.fan_out(df.limit(0), fanout.plain_split(outer), tasks).collect()} == {"error"}


def test_rounds_as_task_tables(spark):
    df = shared.written(matrix(spark, n=150, width=3), "t")
    outer = shared.written(folds.outer_folds(df, n_splits=2), "t")
    inner = shared.written(folds.inner_folds(df, outer, n_splits=2), "t")
    space = recipes.prescreen_recipes(spark, ["abs_corr", "mutual_info"]).where("prescreen_recipe_id = 'ps_mean_0001'")
    fits = {"lr": ("logistic", {"C": 1.0}), "et": ("extra_trees", {"n_estimators": 5}), "bad": ("logistic", {"C": "x"})}
    p = pipelines.inner_round(df, outer, inner, space, [1, 2], fits)
    good = p.where("status = 'ok'")
    # Each outer fold's training rows are scored once by each candidate and model.
    counts = {(r.outer_fold, r.pipeline_recipe_id): r["count"] for r in good.groupBy("outer_fold", "pipeline_recipe_id").count().collect()}
    assert len(counts) == 8 and all(n == inner.where(F.col("outer_fold") == o).count() for (o, _), n in counts.items())
    assert p.where("status LIKE 'error%'").count() == 8
    trained = good.join(inner, (good.outer_fold == inner.outer_fold) & (good.sample_index == inner.id) & (good.inner_fold == inner.inner_fold), "left_anti")
    assert trained.count() == 0
    predictions, chosen = pipelines.outer_evaluation(df, outer, [("c1", "ps_mean_0001", 1, "lr"), ("c2", "ps_mean_0001", 1, "et")], space, fits)
    assert predictions.groupBy("recipe_config_id").count().collect()[0]["count"] == 150 and chosen.count() == 4


def test_every_parameter_counts():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 6))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + r.normal(size=400) > 0.5).astype(float)
    for family, base, changes in (
        ("lightgbm", {"n_estimators": 12}, {"n_estimators": 5, "learning_rate": 0.2, "num_leaves": 5, "max_depth": 2, "min_child_samples": 60, "subsample": 0.6, "colsample_bytree": 0.5, "scale_pos_weight_multiplier": 1.5, "min_child_weight": 20.0, "reg_lambda": 50.0}),
        ("xgboost", {"n_estimators": 12}, {"n_estimators": 5, "learning_rate": 0.2, "max_depth": 2, "subsample": 0.6, "colsample_bytree": 0.5, "scale_pos_weight_multiplier": 1.5, "min_child_weight": 20.0}),
        ("extra_trees", {"n_estimators": 6}, {"n_estimators": 3, "max_depth": 2, "min_samples_leaf": 60, "class_weight": None}),
        ("random_forest", {"n_estimators": 6}, {"n_estimators": 3, "max_depth": 2, "min_samples_leaf": 60, "class_weight": None}),
        ("logistic", {}, {"C": 0.01, "l1_ratio": 1.0, "class_weight": None}),
    ):
        plain = fanout.FAMILIES[family](x, y, base).predict(x)
        assert np.allclose(plain, fanout.FAMILIES[family](x, y, base).predict(x))
        for name, value in changes.items():
            assert not np.allclose(plain, fanout.FAMILIES[family](x, y, base | {name: value}).predict(x)), (family, name)
        if family not in ("logistic",):
            with pytest.raises(ValueError, match="bagging"):
                fanout.FAMILIES[family](x, y, base | {"bagging": 1})


def isotonic_brute(x, y):
    """Greatest of the least means, of each distinct score."""
    at = np.unique(x)
    t, n = (np.array([f(y[x == v]) for v in at], float) for f in (np.sum, len))
    mean = lambda j, k: t[j : k + 1].sum() / n[j : k + 1].sum()
    return at, np.array([max(min(mean(j, k) for k in range(i, len(at))) for j in range(i + 1)) for i in range(len(at))])


def test_isotonic_over_many_ranges(spark):
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=300), 1)  # many ties
    y = (r.random(300) < 1 / (1 + np.exp(-x))).astype(int)
    at, want = isotonic_brute(x, y)
    train = spark.createDataFrame([(k, int(b), float(a)) for k, (a, b) in enumerate(zip(x, y))] + [(900, 1, None), (901, None, 0.3)], "id long, y int, score double").repartition(4)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate([*at, at[0] - 5, at[-1] + 5, (at[3] + at[4]) / 2])] + [(950, None), (951, float("nan"))], "id long, score double")
    for parts in (1, 5, 64):
        got = {g.id: g.score for g in isotonic.calibrated(train, df, ranges=parts).collect()}
        assert np.allclose([got[k] for k in range(len(at))], want)
        assert got[len(at)] == want[0] and got[len(at) + 1] == want[-1] and abs(got[len(at) + 2] - (want[3] + want[4]) / 2) < 1e-12 and got[950] is None and got[951] is None
    assert {g.score for g in isotonic.calibrated(train.limit(0), df).collect()} == {None}
    rising = isotonic.isotonic_blocks(spark.createDataFrame([(0, 1.0), (1, 2.0)], "y int, score double")).collect()
    assert [tuple(b) for b in rising] == [(1.0, 1.0, 0.0), (2.0, 2.0, 1.0)]


def test_sets_fitted_together_compare_as_single_ones(spark):
    df = matrix(spark, n=300, width=4)
    outer = folds.outer_folds(df, n_splits=3)
    sets = {"first": [0], "pair": [2, 0]}  # no set that a penalty empties: constant scores tie but for the solver's last digits
    fits = {"plain": models.logistic(c=0.5), "sparse": models.logistic(c=0.1, l1_ratio=1.0, balanced=False)}
    alone = {name: (lambda train, f=f: f(train)) for name, f in fits.items()}  # without the mark that they can share passes
    assert not models.out_of_fold_sets(df, outer, [[0]], list(alone.values()))
    key = lambda rows: sorted((r.model, r.feature_set, r.n_features, r.k, r.score) for r in rows)
    both = models.compare(df, outer, sets, fits)
    assert key(both.collect()) == key(models.compare(df, outer, sets, alone).collect())
    single = models.out_of_fold(df.withColumn("features", F.array(F.col("features")[2], F.col("features")[0])), outer, fits["sparse"])
    shared = models.out_of_fold_sets(df, outer, [[1], [2, 0]], [models.extra_trees(trees=2), fits["sparse"]])
    assert list(shared) == [1]
    gap = shared[1].where("set = 1").select("id", F.col("score").alias("other")).join(single, "id").select(F.max(F.abs(F.col("score") - F.col("other"))), F.count("*")).first()
    assert gap[0] < 1e-4 and gap[1] == 300
    assert not models.out_of_fold_sets(df.where("y = 1"), outer, [[0]], [fits["plain"]])
    ranked = spark.createDataFrame([("a", "var_0", 1), ("a", "var_1", 2), ("b", "var_0", 1), ("b", "var_3", 2)], "name string, feature string, order int")
    one, two = (search.evaluated_rankings(df, outer, ranked, f, sizes=(1, 2)).select("method", "oof_business_score", "oof_optimal_k").collect() for f in (fits["plain"], alone["plain"]))
    assert one == two and len(one) == 4


def test_candidates_fitted_together_score_as_single_ones(spark):
    df = shared.written(matrix(spark, n=240, width=4).coalesce(1), "t")
    outer = shared.written(folds.outer_folds(df, n_splits=3).coalesce(1), "t")
    sets = [[0, 1, 2, 3], [2, 0]]
    specs = [("logistic", {"C": 0.5, "l1_ratio": 0.0}), ("logistic", {"C": 0.2, "l1_ratio": 1.0, "class_weight": None}), ("extra_trees", {"n_estimators": 6, "max_depth": None}), ("lightgbm", {"n_estimators": 6, "subsample": 0.7, "min_child_samples": 5}), ("ranker", {"n_estimators": 4, "num_leaves": 7}), ("random_forest", {"n_estimators": 3})]
    fits = [search.fit_of_spec(*s) for s in specs]
    scores, errors = search.out_of_fold_all(df, outer, [*sets, [9], []], fits)
    assert set(errors) == {(k, s) for k in range(len(fits)) for s in (2, 3)}
    got = {(r.fit, r.set, r.id): (r.fold, r.y, r.score) for r in scores.collect()}
    assert len(got) == scores.count() == len(fits) * 2 * 240
    for k, fit in enumerate(fits):
        alone = models.out_of_fold(df.withColumn("features", F.array(F.col("features")[2], F.col("features")[0])), outer, fit).collect()
        assert len(alone) == 240 and {r.status for r in alone} == {"ok"}
        assert all(got[k, 1, r.id][:2] == (r.outer_fold, r.y) and abs(got[k, 1, r.id][2] - r.score) < 2e-3 for r in alone), specs[k]
    none, failed = search.out_of_fold_all(df.limit(0), outer, sets, fits[:1])
    assert none.count() == 0 and set(failed) == {(0, 0), (0, 1)}
    with pytest.raises(ValueError, match="unknown parameters"):
        search.fit_of_spec("ranker", {"depth": 3})


def test_scalings_by_held_out_fold(spark):
    df = shared.written(matrix(spark, n=90, width=3).join(spark.range(90).select("id", (F.col("id") % 4).cast("int").alias("fold")), "id").withColumn("features", F.concat("features", F.array(F.lit(2.0)))), "t")
    for robust in (True, False):
        for held, (centre, scale) in models.held_out_scalings(df, [0, 1, 2, 3], robust=robust).items():
            x = np.array([r.features for r in df.where(F.col("fold") != held).collect()])
            low, middle, high = np.quantile(x, (0.25, 0.5, 0.75), axis=0)
            spread = high - low if robust else x.std(axis=0)
            assert np.allclose(centre, middle if robust else x.mean(axis=0)) and np.allclose(scale, np.where(spread > 0, spread, 1))


def test_search_of_points_fitted_together(spark):
    df = shared.written(matrix(spark, n=200, width=3).coalesce(1), "t")
    outer = shared.written(folds.outer_folds(df, n_splits=2).coalesce(1), "t")
    for make, grid in ((search.model_factories()["lightgbm"], {"n_estimators": [2, 8], "subsample": [0.5, 1.0]}), (search.model_factories()["logistic_regression"], {"C": [0.01, 1.0], "l1_ratio": [0.0]})):
        rows = search.parameter_search(df, outer, make, features=3, grid=grid).collect()
        assert len(rows) == np.prod([len(v) for v in grid.values()]) and [r.mean_score for r in rows] == sorted((r.mean_score for r in rows), reverse=True)
        for r in rows[:2]:
            alone = models.out_of_fold(df, outer, make(**json.loads(r.params))).withColumnRenamed("outer_fold", "fold")
            each = records.fold_scores(alone, 3).agg(F.avg("business_with_var_penalty").alias("s"), F.avg("f1_topk").alias("f")).first()
            assert abs(each.s - r.mean_score) <= 10 and abs(each.f - r.mean_f1) < 0.02


def test_of_a_large_leaf_only_the_smaller_side_is_added_up(monkeypatch):
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(6000, 5)), 2)
    y = (r.random(6000) < 1 / (1 + np.exp(-x[:, 0] * x[:, 1]))).astype(float)
    ways = {"trees": 4, "leaves": 40, "row_share": 0.8, "column_share": 0.6}
    seen, plain = [], boosters._bin_sums
    monkeypatch.setattr(boosters, "_bin_sums", lambda b, rows, *rest: seen.append(len(rows)) or plain(b, rows, *rest))
    got, some = boosters.fit_leafwise(x, y, **ways), sum(seen)
    seen.clear()
    monkeypatch.setattr(boosters, "FEW", 10**9)
    want = boosters.fit_leafwise(x, y, **ways)
    assert [vars(t) for t in got.trees] == [vars(t) for t in want.trees]
    assert some < 0.6 * sum(seen)


def test_fits_of_a_fan_out_do_not_share_a_task(spark):
    def place(x, y, params):
        raise ValueError(TaskContext.get().partitionId())

    df = spark.createDataFrame([(k, k % 2, [float(k)]) for k in range(20)], "id long, y int, features array<double>")
    members = spark.createDataFrame([(0, k, k // 2 % 2 + 1) for k in range(20)], "split int, id long, fold int")
    tasks = spark.createDataFrame([(k, 0, 1 + k % 2, "place", "{}", [0]) for k in range(40)], fanout.TASKS)
    places = [r.error for r in fanout.fan_out(df, members, tasks, families={"place": place}).collect()]
    assert len(places) == len(set(places)) == 40


def test_candidates_see_all_rows_outside_their_fold(spark, monkeypatch):
    monkeypatch.setitem(fanout.FAMILIES, "lightgbm", lambda x, y, p: boosters.Boosted(float(len(y)), 0.0, [], x[0], x[0], False, 1))
    df = spark.range(36_000).select("id", (F.col("id") % 2).cast("int").alias("y"), F.array(F.col("id").cast("double")).alias("features"))
    outer = df.select("id", (F.col("id") % 3 + 1).cast("int").alias("outer_fold"))
    scores, errors = search.out_of_fold_all(df, outer, [[0]], [search.fit_of_spec("lightgbm", {})])
    assert not errors and [tuple(r) for r in scores.groupBy("score").count().collect()] == [(24_000.0, 36_000)]


def test_fits_of_all_rows_equal_those_of_a_sample_that_holds_all(spark):
    def place(x, y, params):
        raise ValueError(TaskContext.get().partitionId())

    df = matrix(spark, n=240, width=4).withColumn("y", F.when(F.col("id") % 20 > 0, F.col("y"))).withColumn("features", F.when(F.col("id") % 30 > 0, F.col("features")))
    df = shared.written(df.withColumn("features", F.when(F.col("id") % 7 > 0, F.col("features")).otherwise(F.array(F.lit(None), F.lit(float("nan")), F.lit(1.0)))), "t")
    members = shared.written(fanout.plain_split(folds.outer_folds(df.select("id", F.coalesce("y", F.lit(0)).alias("y")), n_splits=3)), "t")
    specs = [("lightgbm", '{"n_estimators": 4, "subsample": 0.7}', [3, 0]), ("extra_trees", '{"n_estimators": 3}', [0, 1]), ("logistic", "{}", []), ("nothing", "{}", [0]), ("logistic", "{}", [99]), ("place", None, [0])]
    rows = [(1000 - 10 * k - f, 0, f, *spec) for k, spec in enumerate(specs) for f in (1, 2, 3)] + [(2000, 0, 9, "logistic", "{}", [0]), (2001, 5, 1, "logistic", "{}", [0])]
    tasks = spark.createDataFrame(rows, fanout.TASKS)
    found = []
    for sample in (None, 1000):
        flat = fanout.predictions_of(fanout.fan_out(df, members, tasks, sample=sample, families={**fanout.FAMILIES, "place": place}))
        found.append(sorted((r.task_id, -1 if r.sample_index is None else r.sample_index, r.y_true is None or r.y_true, None if r.score is None else round(r.score, 9), r.status) for r in flat.collect()))
    keep = lambda rows: [r for r in rows if not 940 < r[0] < 950]
    assert keep(found[0]) == keep(found[1]) and len(keep(found[0])) > 480
    places = [r[4] for r in found[0] if 940 < r[0] < 950]
    assert len(places) == len(set(places)) == 3  # a fit is a Spark task of its own
    assert {r.status for r in fanout.fan_out(df.limit(0), members, tasks, sample=None).collect()} == {"error"}
