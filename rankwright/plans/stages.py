"""Registered queries of what a stage leaves behind and reads again, of scores from files and blocks, and of fitted searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import shared_folder
from ..operators import folds, models, rankings, scoring, search, selection
from ..operators.features import long_view
from ..sources import tables
from .frames import LONG, ORDERS, PREDICTIONS, embedding_rows, predictions, scored_orders
from .queries import _CORR, _FOLDS, _INNER, _KEYS, _six, query

_SCORED = ("outer_fold", "round_name", "pipeline_recipe_id", "feature_size", "n", "oof_k", "oof_score", "roc_auc")


@query(f"WITH {_INNER} SELECT {', '.join(_SCORED)} FROM sc WHERE outer_fold = 2")
def csv_oof_scores(spark, d):
    """Predictions left as a CSV file, scored with all checks."""
    path = f"{shared_folder(spark, 'stage')}/inner_predictions.csv"
    predictions(spark, d).write.csv(path, header=True)
    return _six(tables.scored_predictions_csv(spark, path, outer_folds=[2]).select(*_SCORED), "roc_auc")


@query(f"""WITH {_INNER} SELECT {', '.join(_SCORED)}, 'ok' AS status, CAST(NULL AS VARCHAR) AS error FROM sc WHERE outer_fold <> 1 OR pipeline_recipe_id <> 'fr2__m1'
UNION ALL SELECT outer_fold, round_name, pipeline_recipe_id, feature_size, NULL, NULL, NULL, NULL, 'error', 'no model' FROM sc WHERE outer_fold = 1 AND pipeline_recipe_id = 'fr2__m1'""")
def block_oof_scores(spark, d):
    """Prediction blocks of up to 4,096 order numbers; of one recipe a block has failed."""
    keys = ["outer_fold", "inner_fold", "round_name", "pipeline_recipe_id", "feature_size"]
    rows = predictions(spark, d).withColumn("part", F.floor(F.col("sample_index") / 4096))
    blocks = rows.groupBy(*keys, "part").agg(F.collect_list(F.struct("sample_index", "y_true", "score")).alias("block"))
    bad = (F.col("outer_fold") == 1) & (F.col("inner_fold") == 2) & (F.col("pipeline_recipe_id") == "fr2__m1") & (F.col("part") == 0)
    blocks = blocks.withColumns({"status": F.when(bad, "error").otherwise("ok"), "error": F.when(bad, "no model"), "block": F.when(~bad, F.col("block"))}).drop("part")
    return _six(scoring.block_scores(blocks).select(*_SCORED, "status", "error"), "roc_auc")


@query(f"""WITH {ORDERS}, {_FOLDS} SELECT 'outer' AS kind, o.outer_fold, CAST(NULL AS INTEGER) AS inner_fold, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM o GROUP BY outer_fold
UNION ALL SELECT 'inner', outer_fold, inner_fold, count(*), CAST(sum(id) AS BIGINT) FROM i GROUP BY outer_fold, inner_fold""")
def stage_one_tables(spark, d):
    """Fold tables of the orders, written as a first stage leaves them and read again."""
    folder = shared_folder(spark, "stage-one")
    s = scored_orders(spark, d)
    outer = folds.outer_folds(s)
    inner = folds.inner_folds(s, outer, n_splits=4)
    kept = {"outer_folds": outer.select(F.col("id").alias("sample_index"), "outer_fold"), "inner_folds": inner.select("outer_fold", F.col("id").alias("sample_index"), "inner_fold")}
    tables.write_relations(kept, folder, kind="csv")
    first, second = (tables.read_csv_or_empty(spark, f"{folder}/{n}.csv", tables.STAGE_ONE[n]) for n in kept)
    sums = (F.count("*").alias("n"), F.sum("sample_index").alias("ids"))
    one = first.groupBy("outer_fold").agg(*sums).select(F.lit("outer").alias("kind"), "outer_fold", F.lit(None).cast("int").alias("inner_fold"), "n", "ids")
    return one.unionByName(second.groupBy("outer_fold", "inner_fold").agg(*sums).withColumn("kind", F.lit("inner")))


@query(f"WITH {PREDICTIONS} SELECT outer_fold, pipeline_recipe_id, count(*) AS n FROM pr GROUP BY outer_fold, pipeline_recipe_id")
def appended_predictions(spark, d):
    """Predictions appended fold by fold, and nothing for a fold without rows; a table that is there isn't built again."""
    path = f"{shared_folder(spark, 'stage')}/predictions"
    for fold in (1, 2, 3):
        tables.append(predictions(spark, d).where(F.col("outer_fold") == fold), path)
    kept = tables.load_or_build(spark, path, lambda: predictions(spark, d).limit(0))
    return kept.groupBy("outer_fold", "pipeline_recipe_id").agg(F.count("*").alias("n"))


@query(f"WITH {ORDERS} SELECT CAST(id + 1 AS VARCHAR) AS line FROM s ORDER BY score DESC, id DESC LIMIT 1000")
def submission_lines(spark, d):
    """The thousand best orders as the lines of a submission."""
    folder = shared_folder(spark, "submission")
    tables.write_submission(selection.top_targets(scored_orders(spark, d), 1000), ["var_3", "var_0"], folder)
    return spark.read.text(f"{folder}/customers").withColumnRenamed("value", "line")


@query(f"WITH {ORDERS} SELECT id, round((SELECT avg(CAST(y AS DOUBLE)) FROM s WHERE id % 3 <> 0), 6) AS score FROM s WHERE id % 3 = 0")
def prior_baseline(spark, d):
    s = scored_orders(spark, d).drop("score")
    return _six(models.prior_scores(s.where("id % 3 = 0"), s.where("id % 3 <> 0")).select("id", "score"), "score")


@query(f"""WITH {LONG}, a AS (SELECT feature, round(coalesce(abs({_CORR}), 0), 8) AS abs_corr, round(var_pop(value), 8) AS spread FROM l GROUP BY feature),
r AS (SELECT feature, 'abs_corr' AS method, abs_corr AS v FROM a UNION ALL SELECT feature, 'spread', spread FROM a),
k AS (SELECT feature, method, rank() OVER (PARTITION BY method ORDER BY v DESC) + (count(*) OVER (PARTITION BY method, v) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY method) AS p FROM r)
SELECT feature, round(avg(1 - (CAST(rank AS DOUBLE) - 1) / (p - 1)), 6) AS ensemble_score, round(avg(CAST(rank AS DOUBLE)), 6) AS mean_rank FROM k GROUP BY feature""")
def fitted_ensemble(spark, d):
    """Two methods fitted on the embeddings by name, and their ranks averaged."""
    eight = lambda df, name: df.select("feature", F.round(name, 8).alias("raw_score"))
    registry = {
        "abs_corr": lambda df: eight(rankings.abs_corr(long_view(df, "features", "id", "y")), "abs_corr"),
        "spread": lambda df: eight(long_view(df, "features", "id", "y").groupBy("feature").agg(F.var_pop("value").alias("v")), "v"),
    }
    return _six(search.ensemble_ranking(embedding_rows(spark, d), ["abs_corr", "spread"], registry).select("feature", "ensemble_score", "mean_rank"), "ensemble_score", "mean_rank")


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS features, CAST(sum(CASE WHEN label < 5 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM embeddings")
def featureless_rows(spark, d):
    return search.without_features(embedding_rows(spark, d)).agg(F.count("*").alias("rows"), F.sum(F.size("features")).alias("features"), F.sum("y").alias("hits"))


@query()
def evaluated_prefixes(spark, d):
    """Out-of-fold records of the first features of two rankings."""
    df = embedding_rows(spark, d)
    order = [(name, f"var_{k}", place) for name, places in (("front", (0, 1, 2, 3, 4)), ("back", (0, 1, 63, 62, 61))) for place, k in enumerate(places, 1)]
    ranked = spark.createDataFrame(order, "name string, feature string, order int")
    out = search.evaluated_rankings(df, folds.outer_folds(df, n_splits=3), ranked, models.logistic(c=0.1), sizes=(1, 2, 5))
    return out.select("method", "prescreen_name", "feature_set_name", "source_feature_count", "oof_business_score", "f1_score", "roc_auc_score")


@query()
def evaluated_model_specs(spark, d):
    """Specs of two families, and one that there isn't, on two feature sets."""
    df = embedding_rows(spark, d)
    specs = [("logistic_01", "logistic", "classifier", {"C": 0.1, "l1_ratio": 0.0}), ("extra_trees_01", "extra_trees", "classifier", {"n_estimators": 20, "max_depth": 4}), ("absent_01", "absent", "classifier", {})]
    sets = {"all": [f"var_{k}" for k in range(64)], "half": [f"var_{k}" for k in range(0, 64, 2)]}
    return search.evaluated_specs(df, folds.outer_folds(df, n_splits=3), specs, sets)


@query()
def searched_parameters(spark, d):
    """The logistic grid, and drawn points of leaf-wise and level-wise boosting, on the embeddings: all points of a model at once."""
    df = embedding_rows(spark, d)
    outer = folds.outer_folds(df, n_splits=3)
    made = search.model_factories()
    out = search.parameter_search(df, outer, made["logistic_regression"], features=64, grid=search.LOGISTIC_GRID).withColumn("model", F.lit("logistic_regression"))
    for model, choices in (("lightgbm", search.LEAFWISE_CHOICES), ("xgboost", search.LEVELWISE_CHOICES)):
        out = out.unionByName(search.parameter_search(df, outer, made[model], features=64, choices=choices).withColumn("model", F.lit(model)))
    return _six(out, "mean_score", "mean_f1")


@query()
def mixture_segment_targets(spark, d):
    """Gaussian mixtures over five components segment the embeddings; each large segment has a model of its own."""
    df = embedding_rows(spark, d)
    train, test = models.mixture_segments(df.where("id % 2 = 0"), df.where("id % 2 = 1"), k=3)
    scored = models.per_cluster_scores(train, test, models.logistic(c=0.1), models.logistic(c=0.1))
    return selection.top_targets(scored, 100)
