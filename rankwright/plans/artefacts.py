"""Registered queries of records, artefacts, text functions and small relational helpers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.shared import shared_folder
from ..operators import boosters, curves, features, folds, models, pipelines, rankings, recipes, records, scoring, selection
from ..sources import tables
from .frames import LONG, METHODS, ORDERS, PREDICTIONS, PRESCREENS, PROBABILITY, RANKED, RAW, by_probability, embedding_rows, ordered_methods, predictions, scored_orders, table
from .frames import rankings as long_rankings
from .queries import _AGGREGATED, _EFFECTIVE, _FOLDS, _INNER, _KEYS, _MATERIALISED, _PROFILE, _VALIDATION, _auc_sql, _curve_sql, _profile, _scores, _six, _validation, _zero_sql, query

# --- records ----------------------------------------------------------------------------------------------------------


def _f1_sql(src: str, groups: str, curve: str) -> str:
    """CTE f1: best F1 among the curve's points, and the smallest k that has it."""
    return f"""fp1 AS (SELECT {groups}, k, threshold, coalesce(2.0::DOUBLE * tp / nullif(k + pos, 0), 0) AS f1, pos > 0 AND neg > 0 AS twofold FROM {curve} JOIN (SELECT {groups}, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY {groups}) USING ({groups})),
f1 AS (SELECT {groups}, k AS f1_k, f1 AS best_f1, threshold AS f1_threshold, twofold FROM fp1 QUALIFY row_number() OVER (PARTITION BY {groups} ORDER BY round(f1, 12) DESC, k) = 1)"""


@query(f"WITH {PROBABILITY}, {_curve_sql('q', 1000, 'grp')}, {_f1_sql('q', 'grp', 'c')} SELECT grp, f1_k, round(best_f1, 6) AS best_f1, f1_threshold FROM f1")
def best_f1(spark, d):
    return _six(records.best_f1(by_probability(scored_orders(spark, d)), ["grp"]), "best_f1")


@query(f"""WITH {_EFFECTIVE}, {_f1_sql('q', 'grp', 'c')}, {_auc_sql('q', 'grp')}, n AS (SELECT grp, count(*) AS n FROM q GROUP BY grp)
SELECT z.grp, 'm' AS method, CAST(9 AS BIGINT) AS candidate_column_count, CAST(2 AS BIGINT) AS source_feature_count, CAST(business_score AS DOUBLE) AS oof_business_score, effective_k AS oof_optimal_k, tp AS oof_tp_at_optimal_k, fp AS oof_fp_at_optimal_k,
  n AS oof_n_predictions, round(CAST(effective_k AS DOUBLE) / n, 6) AS oof_selected_rate, 400.0::DOUBLE AS feature_penalty, CAST(business_score + 400 AS DOUBLE) AS gross_score, round(CASE WHEN twofold THEN best_f1 END, 6) AS f1_score,
  round(CASE WHEN twofold THEN roc_auc END, 6) AS roc_auc_score, 'a,b' AS source_features FROM z JOIN b ON z.grp = b.grp AND b.k = z.effective_k JOIN f1 ON f1.grp = z.grp JOIN auc ON auc.grp = z.grp JOIN n ON n.grp = z.grp""")
def scored_record(spark, d):
    out = records.scored_record(by_probability(scored_orders(spark, d)), ["a", "b", "a"], ["grp"], method="m", columns=9)
    return _six(out, "oof_selected_rate", "f1_score", "roc_auc_score").withColumn("source_features", F.array_join("source_features", ","))


@query(f"""WITH {ORDERS}, {_curve_sql('s', 500, 'grp')}, {_f1_sql('s', 'grp', 'c')}, {_auc_sql('s', 'grp')}, n AS (SELECT grp, count(*) AS n FROM s GROUP BY grp),
w AS (SELECT c.*, n, n / 1000.0::DOUBLE AS sc FROM c JOIN n ON c.grp = n.grp), v AS (SELECT *, tp * (10 * sc) - fp * (5 * sc) AS gross FROM w), b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(gross, 9) DESC, k) = 1)
SELECT b.grp, 'm' AS method, CAST(2 AS BIGINT) AS candidate_column_count, CAST(2 AS BIGINT) AS source_feature_count, 'a,b' AS source_features, 'scaled_full_objective_v1' AS scoring_version, CAST(1000 AS BIGINT) AS feature_cost_reference_row_count,
  n AS evaluation_row_count, CAST(least(500, n) AS BIGINT) AS target_limit, round(sc, 6) AS feature_cost_scale, round(10 * sc, 6) AS scaled_true_positive_value, round(5 * sc, 6) AS scaled_false_positive_cost, round(400 * sc, 6) AS scaled_feature_cost,
  400.0::DOUBLE AS unscaled_feature_cost, round(gross - 400 * sc, 6) AS oof_business_score, round(gross - 400, 6) AS oof_business_score_unscaled_feature_cost, round(gross, 6) AS oof_business_value_before_feature_cost, b.k AS oof_optimal_k,
  tp AS oof_tp_at_optimal_k, fp AS oof_fp_at_optimal_k, round(CASE WHEN twofold THEN best_f1 END, 6) AS f1_score, round(CASE WHEN twofold THEN roc_auc END, 6) AS roc_auc_score FROM b JOIN f1 ON f1.grp = b.grp JOIN auc ON auc.grp = b.grp""")
def scaled_record(spark, d):
    out = records.scaled_record(scored_orders(spark, d), ["a", "b"], ["grp"], method="m", cap=500)
    doubles = [f.name for f in out.schema.fields if f.dataType.simpleString() == "double"]
    return _six(out, *doubles).withColumn("source_features", F.array_join("source_features", ","))


_DRAWN = f"""{ORDERS}, dr AS (SELECT grp, r AS random_repeat, id, y, CAST(CAST('0x' || substr(md5('42:' || CAST(r AS VARCHAR) || ':' || CAST(id AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE AS score
FROM s, (SELECT unnest([0, 1, 2]) AS r)), {_curve_sql('dr', 200, 'grp, random_repeat')}, {_zero_sql('dr', 'grp, random_repeat')}, {_f1_sql('dr', 'grp, random_repeat', 'c')}, {_auc_sql('dr', 'grp, random_repeat')},
n AS (SELECT grp, random_repeat, count(*) AS n FROM dr GROUP BY ALL), b AS (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY grp, random_repeat ORDER BY 10 * tp - 5 * fp DESC, k) = 1)"""


@query(f"""WITH {_DRAWN} SELECT grp, random_repeat, b.k, tp, fp, n, CAST(10 * tp - 5 * fp AS DOUBLE) AS business_score, round(CAST(b.k AS DOUBLE) / n, 6) AS contact_rate, round(CASE WHEN twofold THEN best_f1 END, 6) AS f1_score,
round(CASE WHEN twofold THEN roc_auc END, 6) AS roc_auc_score FROM b JOIN n USING (grp, random_repeat) JOIN f1 USING (grp, random_repeat) JOIN auc USING (grp, random_repeat)""")
def random_baselines(spark, d):
    samples = scored_orders(spark, d).select("grp", "id", "y")
    return _six(records.random_baselines(samples, ["grp"], repeats=3, cap=200), "contact_rate", "f1_score", "roc_auc_score")


_FOLDED = f"{ORDERS}, {_FOLDS}, z AS (SELECT s.*, outer_fold AS fold FROM s JOIN o ON s.id = o.id), {_curve_sql('z', 400, 'fold')}, {_f1_sql('z', 'fold', 'c')}, g AS (SELECT fold, max(10 * tp - 5 * fp) AS gross FROM c GROUP BY fold)"


def _fold_scores(spark, d) -> DataFrame:
    s = scored_orders(spark, d)
    return records.fold_scores(s.join(folds.outer_folds(s).withColumnRenamed("outer_fold", "fold"), "id"), 2, cap=400)


@query(f"WITH {_FOLDED} SELECT fold, CAST(gross - 400 AS DOUBLE) AS business_with_var_penalty, CAST(gross AS DOUBLE) AS business_no_var_penalty, round(best_f1, 6) AS f1_topk FROM g JOIN f1 USING (fold)")
def baseline_fold_scores(spark, d):
    return _six(_fold_scores(spark, d), "f1_topk")


@query(f"""WITH {_FOLDED}, m AS (SELECT fold, 'business_with_var_penalty' AS metric, CAST(gross - 400 AS DOUBLE) AS v FROM g UNION ALL SELECT fold, 'f1_topk', best_f1 FROM f1)
SELECT 'price' AS name, metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, string_agg(CAST(CAST(round(v * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY fold) AS folds FROM m GROUP BY metric""")
def baseline_summary(spark, d):
    out = records.fold_summary(_fold_scores(spark, d).withColumn("name", F.lit("price")), ["business_with_var_penalty", "f1_topk"])
    return _six(out, "mean", "std").withColumn("folds", F.array_join(F.transform("folds", lambda v: F.round(v * 1000).cast("long").cast("string")), ","))


_EXPERTS = f"""{RANKED}, x AS (SELECT method AS expert, feature, row_number() OVER (PARTITION BY method ORDER BY raw_score DESC, feature) AS r FROM nr),
ex AS (SELECT expert, list(feature ORDER BY r) AS features, CASE expert WHEN 'variance' THEN 0.5::DOUBLE WHEN 'peak' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS weight FROM x WHERE r <= CASE expert WHEN 'variance' THEN 3 ELSE 5 END GROUP BY expert)"""


def _experts(spark, d) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("method").orderBy(F.desc("raw_score"), "feature"))
    best = long_rankings(spark, d).withColumn("r", place).where(F.col("r") <= F.when(F.col("method") == "variance", 3).otherwise(5))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", "feature"))), lambda x: x["feature"])
    weight = F.when(F.col("expert") == "variance", 0.5).when(F.col("expert") == "peak", 0.3).otherwise(0.2)
    rows = best.groupBy(F.col("method").alias("expert")).agg(listed.alias("features")).withColumn("weight", weight)
    return rows.select("*", F.lit("m").alias("model"), F.concat(F.lit("set_"), "expert").alias("feature_set"), (F.col("weight") * 100).alias("cv_business_mean"), F.lit(1.5).alias("cv_business_std"))


@query(f"WITH {_EXPERTS} SELECT expert, 'm' AS model, 'set_' || expert AS feature_set, len(features) AS n_features, weight * 100 AS cv_business_mean, 1.5::DOUBLE AS cv_business_std, weight AS fusion_weight FROM ex")
def experts_summary(spark, d):
    return records.experts_summary(_experts(spark, d))


@query(f"WITH {_EXPERTS} SELECT DISTINCT unnest(features) AS feature FROM ex")
def expert_features(spark, d):
    return records.union_features(_experts(spark, d))


@query(f"""WITH {_EXPERTS}, o AS (SELECT feature, CASE WHEN CAST(substr(feature, 5) AS INTEGER) % 2 = 0 THEN ['var_1', 'raw'] ELSE [feature] END AS originals FROM (SELECT DISTINCT feature FROM nr)),
p AS (SELECT DISTINCT expert, unnest(originals) AS f FROM (SELECT expert, unnest(features) AS feature FROM ex) JOIN o USING (feature))
SELECT expert, string_agg(f, ',' ORDER BY CASE WHEN f = 'raw' THEN 1000000000 ELSE CAST(substr(f, 5) AS BIGINT) END, f) AS paid FROM p GROUP BY expert""")
def paid_sources(spark, d):
    even = long_rankings(spark, d).select("feature").distinct().where(F.substring("feature", 5, 9).cast("int") % 2 == 0)
    sources = even.select("feature", F.array(F.lit("var_1"), F.lit("raw")).alias("originals"))
    return records.distinct_paid(_experts(spark, d), sources).withColumn("paid", F.array_join("paid", ","))


# --- artefacts --------------------------------------------------------------------------------------------------------

#: Lines of the two files by the id of a row: blank lines, lines without a number, and labels that are none.
_X_LINES = """x AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS line, f0, f1, width, every - CASE WHEN id % 3 = 0 THEN f1 ELSE 0 END AS total
FROM (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding[1] AS DOUBLE) AS f0, CAST(embedding[2] AS DOUBLE) AS f1, len(embedding) AS width, list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE))) AS every FROM embeddings) WHERE id % 50 <> 7)"""


def _text_files(spark, d) -> tuple[str, str]:
    """The embeddings as two text files: of every 50 lines one is blank, of every 5 one has no number, of every 7 no label."""
    rows = embedding_rows(spark, d).orderBy("id")
    number = F.array_join(F.transform("features", lambda v, i: F.when((i == 1) & (F.col("id") % 3 == 0), F.lit("?")).otherwise(v.cast("string"))), " \t")
    x = F.when(F.col("id") % 50 == 7, F.lit("  ")).when(F.col("id") % 5 == 1, F.lit("var_0 var_1")).otherwise(number)
    y = F.when(F.col("id") % 50 == 7, F.lit("")).when(F.col("id") % 7 == 0, F.lit("y")).otherwise((F.col("id") % 2).cast("string"))
    paths = shared_folder(spark, "x-lines"), shared_folder(spark, "y-lines")
    for path, line in zip(paths, (x, y)):
        rows.select("id", line.alias("value")).orderBy("id").select("value").write.text(path)
    return paths


def _seen(rows: DataFrame, *names: str) -> DataFrame:
    """Of the features that were read: the first two, how many there are, and what they add up to."""
    total = F.round(F.aggregate("features", F.lit(0.0), lambda a, v: a + v), 4)
    return _six(rows.select(*names, F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"), F.size("features").cast("long").alias("width"), total.alias("total")), "f0", "f1")


@query(f"""WITH {_X_LINES} SELECT row_number() OVER (ORDER BY line) - 1 AS id, CAST(id % 2 AS INTEGER) AS y, round(CASE WHEN id % 5 = 1 THEN 0 ELSE f0 END, 6) AS f0, round(CASE WHEN id % 5 = 1 OR id % 3 = 0 THEN 0 ELSE f1 END, 6) AS f1,
width, round(CASE WHEN id % 5 = 1 THEN 0 ELSE total END, 4) AS total FROM x WHERE id % 7 <> 0""")
def training_rows(spark, d):
    x, y = _text_files(spark, d)
    return _seen(tables.read_training(spark, x, y), "id", "y")


@query(f"WITH {_X_LINES} SELECT row_number() OVER (ORDER BY line) - 1 AS sample_index, round(f0, 6) AS f0, round(CASE WHEN id % 3 = 0 THEN 0 ELSE f1 END, 6) AS f1, width, round(total, 4) AS total FROM x WHERE id % 5 <> 1")
def test_rows(spark, d):
    return _seen(tables.read_matrix(spark, _text_files(spark, d)[0]), "sample_index")


@query(f"WITH {PREDICTIONS} SELECT DISTINCT outer_fold, round_name FROM pr WHERE outer_fold = 2")
def prediction_contexts(spark, d):
    return tables.prediction_contexts(predictions(spark, d), outer_folds=[2], rounds=["r1"])


@query(f"""WITH {ORDERS}, g AS (SELECT grp, count(*) AS n, round(avg(CASE WHEN y = 1 THEN 10.0::DOUBLE ELSE -5.0::DOUBLE END), 6) AS mean FROM s GROUP BY grp)
SELECT grp AS approach, CASE WHEN n % 2 = 0 THEN 'm' || substr(grp, 1, 1) END AS best_model, 'fs' AS best_feature_set, CASE WHEN n % 2 = 0 THEN mean * 2 ELSE mean END AS score, CAST(n % 3 AS INTEGER) AS n_features,
CASE WHEN n % 2 = 0 THEN mean * 2 END AS oof_business_score FROM g""")
def compared_approaches(spark, d):
    """An approach for each priority of the orders, with a summary file of its own."""
    root = shared_folder(spark, "approaches")
    value = F.round(F.avg(F.when(F.col("y") == 1, 10.0).otherwise(-5.0)), 6)
    groups = scored_orders(spark, d).groupBy("grp").agg(F.count("*").alias("n"), value.alias("mean")).collect()  # five
    for r in groups:
        found = {"best_model": f"m{r.grp[0]}", "oof_business_score": r.mean * 2} if r.n % 2 == 0 else {"best_model": ""}
        tables.write_json(spark, f"{root}/{r.grp}/modeling_summary.json", {"approach": r.grp, "best_feature_set": "fs", "features": [f"var_{k}" for k in range(r.n % 3)], "cv_business_mean": r.mean, **found})
    summaries = tables.read_summaries(spark, root, [*(r.grp for r in groups), "absent"])
    return tables.compared_approaches(summaries).select("approach", "best_model", "best_feature_set", "score", "n_features", "oof_business_score")


@query(f"""WITH {_INNER} SELECT outer_fold, CAST(feature_size AS INTEGER) AS feature_size, pipeline_recipe_id, substr(pipeline_recipe_id, 1, 3) AS prescreen_recipe_id, substr(pipeline_recipe_id, 1, 3) || '__k_' || lpad(CAST(feature_size AS VARCHAR), 3, '0') || '__' || substr(pipeline_recipe_id, 6) AS recipe_config_id,
row_number() OVER (PARTITION BY outer_fold ORDER BY pipeline_recipe_id) AS inner_selection_rank FROM sc""")
def normalised_recipes(spark, d):
    raw = _scores(spark, d).select(
        F.format_string("%d.0", "outer_fold").alias("outer_fold"), F.col("feature_size").cast("string").alias("feature_size"), "pipeline_recipe_id", F.substring("pipeline_recipe_id", 1, 3).alias("prescreen_recipe_id"),
        F.substring("pipeline_recipe_id", 6, 99).alias("model_spec_id"),
    )
    lost = raw.limit(1).withColumn("outer_fold", F.lit("none"))
    return tables.normalised_recipes(raw.unionByName(lost)).select("outer_fold", "feature_size", "pipeline_recipe_id", "prescreen_recipe_id", "recipe_config_id", "inner_selection_rank")


@query(f"WITH {_AGGREGATED} SELECT outer_fold, pipeline_recipe_id, inner_selection_rank AS selected_rank, 'round2_inner_oof_scores' AS selection_artifact FROM ar WHERE inner_selection_rank <= 2")
def selected_stage_recipes(spark, d):
    folder = shared_folder(spark, "stage")
    predictions(spark, d).write.parquet(f"{folder}/round2_inner_predictions")
    tables.load_or_select_recipes(spark, folder, score=lambda p: scoring.inner_scores(p, check=False), top=2, least_runs=3)
    again = tables.load_or_select_recipes(spark, folder, score=None)  # what the first call has left
    return again.select("outer_fold", "pipeline_recipe_id", "selected_rank", F.lit("round2_inner_oof_scores").alias("selection_artifact"))


# --- text functions ---------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderkey % 4 AS form, 'var_' || CAST(o_orderkey % 5 AS VARCHAR) AS a, 'x ' || CAST(o_orderkey % 7 AS VARCHAR) AS b FROM orders)
SELECT id, CASE WHEN form = 3 THEN a ELSE a || '|' || b END AS names, CASE WHEN form < 2 THEN a || '|' || b ELSE '' END AS listed, CAST(substr(a, 5) AS INTEGER) AS number, CASE WHEN form = 3 THEN a ELSE a || '|' || b END AS set_key FROM o""")
def parsed_names(spark, d):
    o = table(spark, d, "orders")
    a, b = F.concat(F.lit("var_"), (F.col("o_orderkey") % 5).cast("string")), F.concat(F.lit("x "), (F.col("o_orderkey") % 7).cast("string"))
    form = F.col("o_orderkey") % 4
    text = F.when(form == 0, F.concat(F.lit("['"), a, F.lit("', '"), b, F.lit("', '']"))).when(form == 1, F.concat(F.lit(' ["'), a, F.lit('","'), b, F.lit('"]'))).when(form == 2, F.concat(a, F.lit(" , "), b, F.lit(","))).otherwise(a)
    names = parsing.names_from_text(text)
    return o.select(
        F.col("o_orderkey").cast("long").alias("id"), F.array_join(names, "|").alias("names"), F.array_join(parsing.list_or_nothing(text), "|").alias("listed"), parsing.variable_number(a).alias("number"),
        F.array_join(parsing.set_key(F.concat(names, names)), "|").alias("set_key"),
    )


@query("""SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'mi ' || o_orderstatus ELSE 'mi' END AS base, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 90 AS INTEGER) END AS size,
'a_' || o_orderstatus || '_' || CAST(o_orderkey % 10 AS VARCHAR) || '___b.c' AS safe, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS known,
CASE WHEN o_orderkey % 10 < 3 THEN 'var_' || CAST(o_orderkey % 10 AS VARCHAR) || '|var_3|var_20|raw' WHEN o_orderkey % 10 = 3 THEN 'var_3|var_3|var_20|raw' ELSE 'var_3|var_' || CAST(o_orderkey % 10 AS VARCHAR) || '|var_20|raw' END AS ordered FROM orders""")
def named_parts(spark, d):
    o, key, status = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_orderstatus")
    name = F.when(key % 3 == 0, F.concat(F.lit("mi "), status)).otherwise(F.format_string("mi_top%02d", (key % 90).cast("int")))
    parts = parsing.set_name_parts(name)
    listed = F.array(F.lit("raw"), F.lit("var_20"), F.concat(F.lit("var_"), (key % 10).cast("string")), F.lit("var_3"))
    return o.select(
        key.cast("long").alias("id"), parts["base"].alias("base"), parts["size"].alias("size"), parsing.safe_name(F.concat(F.lit("  a//"), status, F.lit(" #"), (key % 10).cast("string"), F.lit("__!b.c!!"))).alias("safe"),
        parsing.missing_when_empty(F.when(key % 2 == 0, status).otherwise("")).alias("known"), F.array_join(F.transform(F.array_sort(F.transform(listed, parsing.variable_order)), lambda x: x["name"]), "|").alias("ordered"),
    )


# --- relational helpers -----------------------------------------------------------------------------------------------


@query(f"WITH {ORDERS}, {_FOLDS} SELECT s.id, s.y FROM s JOIN i ON s.id = i.id WHERE outer_fold = 2 AND inner_fold <> 3")
def inner_train_rows(spark, d):
    s = scored_orders(spark, d)
    return folds.inner_part(s, folds.inner_folds(s, folds.outer_folds(s), n_splits=4), 2, 3, train=True).select("id", "y")


@query("""WITH o AS (SELECT DISTINCT o_orderkey % 12 AS n FROM orders) SELECT 'extra_trees_' || lpad(CAST(n AS VARCHAR), 2, '0') AS model_spec_id, 'extra_trees' AS base_model_family FROM o WHERE n BETWEEN 1 AND 8
UNION ALL SELECT 'logistic_hpo' || lpad(CAST(n AS VARCHAR), 2, '0'), 'logistic' FROM o WHERE n BETWEEN 1 AND 3""")
def filtered_specs(spark, d):
    """The specs that the orders name; some that they name aren't there."""
    number = F.format_string("%02d", (F.col("o_orderkey") % 12).cast("int"))
    named = table(spark, d, "orders").select(F.explode(F.array(F.concat(F.lit("extra_trees_"), number), F.concat(F.lit("logistic_hpo"), number))).alias("id")).distinct()
    specs = recipes.model_specs(spark, [*recipes.default_model_specs(), *recipes.search_specs()])
    return recipes.filter_specs(specs, [r.id for r in named.collect()]).select("model_spec_id", "base_model_family")  # 24 ids at most


@query("""WITH f AS (SELECT * FROM (VALUES ('extra_trees', 3, 8), ('random_forest', 3, 6), ('lightgbm', 3, 8), ('xgboost', 3, 8), ('logistic', 3, 6), ('ranker', 0, 3)) t(family, small, deep)),
g AS (SELECT family, unnest(range(1, small + 1)) AS k, 'hpo' AS part FROM f WHERE small > 0 UNION ALL SELECT family, unnest(range(1, deep + 1)), 'deep' FROM f),
n AS (SELECT family, row_number() OVER (ORDER BY family || '_' || part || lpad(CAST(k AS VARCHAR), 2, '0')) - 1 AS place FROM g)
SELECT family AS base_model_family, count(DISTINCT place) AS specs, count(*) AS runs, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM n JOIN orders ON o_orderkey % 54 = place GROUP BY family""")
def search_specs(spark, d):
    """The small and the larger grids by family, with the orders dealt out to their specs as runs."""
    specs = sorted([*recipes.search_specs(), *recipes.expanded_specs()])
    placed = recipes.model_specs(spark, specs).join(F.broadcast(spark.createDataFrame([(s[0], k) for k, s in enumerate(specs)], "model_spec_id string, place long")), "model_spec_id")
    runs = table(spark, d, "orders").select((F.col("o_orderkey") % len(specs)).cast("long").alias("place"), (F.col("o_orderstatus") == "F").cast("long").alias("hit"))
    return runs.join(F.broadcast(placed), "place").groupBy("base_model_family").agg(F.count_distinct("model_spec_id").alias("specs"), F.count("*").alias("runs"), F.sum("hit").alias("hits"))


@query(f"""WITH {PRESCREENS} SELECT id AS prescreen_recipe_id, n AS prescreen_method_count FROM px WHERE id IN ('ps_mean_0001', 'ps_mean_0002')
UNION ALL SELECT unnest(['ps_adaptive_top3', 'ps_adaptive_weighted']), CAST(count(*) AS INTEGER) FROM mo""")
def filtered_prescreens(spark, d):
    space = recipes.prescreen_recipes(spark, ordered_methods(spark, d))
    plain = recipes.filter_prescreens(space, adaptive=False, most=2)
    return plain.unionByName(space.where("adaptive")).select("prescreen_recipe_id", "prescreen_method_count")


@query(f"""WITH {RANKED}, o AS (SELECT method, feature, row_number() OVER (PARTITION BY method ORDER BY raw_score DESC, feature) AS ord FROM nr), p AS (SELECT unnest(['centre', 'peak']) AS method)
SELECT method AS pool, string_agg(feature, ',' ORDER BY ord) AS features FROM o JOIN p USING (method) WHERE ord <= 4 GROUP BY method""")
def candidate_pools(spark, d):
    place = F.row_number().over(Window.partitionBy("method").orderBy(F.desc("raw_score"), "feature"))
    ranked = long_rankings(spark, d).select(F.col("method").alias("name"), "feature", place.alias("order"))
    scores = spark.createDataFrame([("peak", 5.0, 3), ("peak", 9.0, 5), ("variance", 8.0, 1), ("centre", 1.0, 1)], "name string, score double, size int")
    return selection.candidate_pools(scores, ranked, top=4, pools=2, include=["centre"]).withColumn("features", F.array_join("features", ","))


@query(f"WITH {_VALIDATION} SELECT feature_set_id, model, score, n_features FROM vs WHERE status = 'ok' ORDER BY score DESC, n_features, feature_set_id, model LIMIT 1")
def winning_candidate(spark, d):
    rows = _validation(spark, d).where("status = 'ok'").withColumnRenamed("feature_set_id", "feature_set")
    return selection.winner(rows).select(F.col("feature_set").alias("feature_set_id"), "model", "score", "n_features")


@query(f"WITH {PREDICTIONS} SELECT DISTINCT {_KEYS}, CAST(2 AS BIGINT) AS sizes FROM pr WHERE pipeline_recipe_id = 'fr2__m1'")
def inconsistent_sizes(spark, d):
    odd = (F.col("pipeline_recipe_id") == "fr2__m1") & (F.col("sample_index") % 10 == 1) | (F.col("pipeline_recipe_id") == "fr2__m1") & (F.col("sample_index") % 10 == 2)
    p = predictions(spark, d).withColumn("feature_size", F.when(odd, F.col("feature_size") + 1).otherwise(F.col("feature_size")))
    return scoring.inconsistent_sizes(p).select("outer_fold", "round_name", "pipeline_recipe_id", "sizes")


@query(f"WITH {_INNER} SELECT outer_fold, pipeline_recipe_id, round((oof_score + feature_size * 200) * 2.5::DOUBLE - feature_size * 200, 6) AS rescaled FROM sc")
def rescaled_scores(spark, d):
    s = _scores(spark, d)
    # One price for each size, which is a column here.
    each = F.when(F.col("feature_size") == 1, curves.rescale(F.col("oof_score"), 1, 2.5)).otherwise(curves.rescale(F.col("oof_score"), 2, 2.5))
    return s.select("outer_fold", "pipeline_recipe_id", F.round(each.cast("double"), 6).alias("rescaled"))


@query(f"""WITH {_INNER} SELECT a.pipeline_recipe_id, a.oof_score AS oof_score_one, b.oof_score AS oof_score_two, a.feature_size AS size_one FROM (SELECT * FROM sc WHERE outer_fold = 1) a
LEFT JOIN (SELECT * FROM sc WHERE outer_fold = 2 AND pipeline_recipe_id <> 'fr1__m2') b ON a.pipeline_recipe_id = b.pipeline_recipe_id""")
def suffix_joined(spark, d):
    s = _scores(spark, d)
    one = s.where("outer_fold = 1").select("pipeline_recipe_id", "oof_score", F.col("feature_size").alias("size_one"))
    two = s.where("outer_fold = 2 AND pipeline_recipe_id <> 'fr1__m2'").select("pipeline_recipe_id", "oof_score")
    return selection.suffix_join(one, two, "pipeline_recipe_id", ("_one", "_two"))


@query(f"""WITH {PREDICTIONS} SELECT DISTINCT outer_fold, pipeline_recipe_id, CASE WHEN pipeline_recipe_id LIKE 'fr1%' THEN 'seen' ELSE 'kept' END AS note, 'always' AS fixed FROM pr""")
def filled_metadata(spark, d):
    p = predictions(spark, d)
    known = p.where("pipeline_recipe_id LIKE 'fr1%'").select("outer_fold", "pipeline_recipe_id", "sample_index", F.lit("seen").alias("note"), F.lit("other").alias("fixed"))
    rows = p.select("outer_fold", "pipeline_recipe_id").distinct().select("*", F.lit("kept").alias("note"), F.lit("always").alias("fixed"))
    return selection.with_fallback(known, rows, ["outer_fold", "pipeline_recipe_id"], ["note", "fixed"], always=["fixed"])


@query(f"WITH {PREDICTIONS} SELECT DISTINCT outer_fold, pipeline_recipe_id FROM pr WHERE pipeline_recipe_id = 'fr2__m2'")
def missing_keys(spark, d):
    p = predictions(spark, d)
    return selection.missing_keys(p, p.where("pipeline_recipe_id <> 'fr2__m2'"), ["outer_fold", "pipeline_recipe_id"])


@query(f"WITH {_VALIDATION} SELECT *, CASE WHEN model = 'm1_1' THEN '{{\"C\": 1}}' ELSE '' END AS best_params FROM vs")
def with_best_params(spark, d):
    return selection.with_best_params(_validation(spark, d), "m1_1", '{"C": 1}')


@query(f"WITH {LONG}, a AS (SELECT feature, coalesce(abs(corr(value, y)), 0) AS abs_corr FROM l GROUP BY feature) SELECT feature, round(abs_corr, 6) AS abs_corr FROM a ORDER BY abs_corr DESC, feature LIMIT 1")
def best_univariate_feature(spark, d):
    return _six(features.best_univariate_feature(embedding_rows(spark, d)), "abs_corr")


@query(f"WITH {_PROFILE} SELECT 'orders' AS feature_set, count(*) AS clusters, min(n) AS min_size, max(n) AS max_size, round(min(rate), 6) AS min_rate, round(max(rate), 6) AS max_rate FROM pl")
def cluster_set_summary(spark, d):
    return _six(features.cluster_set_summary(_profile(spark, d).withColumn("feature_set", F.lit("orders"))), "min_rate", "max_rate")


@query(f"""WITH {_MATERIALISED}, o AS (SELECT r, feature, es, row_number() OVER (PARTITION BY r ORDER BY round(es, 12) DESC, round(mr, 12), feature) AS ord FROM e), z AS (SELECT unnest([1, 3, 5, 10]) AS size),
c AS (SELECT r, size, string_agg(feature, ',' ORDER BY feature) AS features, sum(es) / size AS heuristic FROM o, z WHERE ord <= size GROUP BY r, size), k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY features ORDER BY r, size) = 1)
SELECT r || '__k_' || lpad(CAST(size AS VARCHAR), 3, '0') AS feature_recipe_id, r AS prescreen_recipe_id, CAST(size AS BIGINT) AS feature_size, features, round(heuristic, 6) AS heuristic FROM k""")
def fold_candidates(spark, d):
    out = pipelines.fold_candidates(long_rankings(spark, d), recipes.prescreen_recipes(spark, METHODS), [1, 3, 5, 10])
    return _six(out.withColumn("features", F.array_join("features", ",")), "heuristic")


@query("SELECT * FROM (VALUES ('ps_mean_0002', 'peak'), ('ps_mean_0004', 'peak'), ('ps_mean_0006', 'peak'), ('ps_mean_0007', 'peak'), ('ps_adaptive_top3', 'peak'), ('ps_adaptive_weighted', 'peak')) t(prescreen_recipe_id, missing_methods)")
def recipe_failures(spark, d):
    return pipelines.recipe_failures(long_rankings(spark, d).where("method <> 'peak'"), recipes.prescreen_recipes(spark, METHODS))


@query(f"""WITH {ORDERS}, n AS (SELECT grp, CAST(count(*) AS DOUBLE) AS w FROM s WHERE grp <> '5-LOW' GROUP BY grp) SELECT string_agg(grp || '=' || printf('%.6f', w / (SELECT sum(w) FROM n)), ';' ORDER BY grp) AS weights FROM n""")
def weights_text(spark, d):
    sizes = scored_orders(spark, d).groupBy(F.col("grp").alias("method")).agg(F.count("*").cast("double").alias("weight"))
    return rankings.weights_text(sizes.withColumn("weight", F.when(F.col("method") == "5-LOW", -F.col("weight")).otherwise(F.col("weight"))))


@query(f"""WITH {ORDERS}, m AS (SELECT grp AS expert, avg(CASE WHEN y = 1 THEN 10.0::DOUBLE ELSE -5.0::DOUBLE END) - CASE WHEN grp = '5-LOW' THEN 100 ELSE 0 END AS cv FROM s GROUP BY grp),
r AS (SELECT expert, greatest(cv, 0.0::DOUBLE) AS w FROM m) SELECT expert, round(w / sum(w) OVER (), 6) AS weight FROM r""")
def fusion_weights(spark, d):
    mean = F.avg(F.when(F.col("y") == 1, 10.0).otherwise(-5.0)) - F.when(F.col("grp") == "5-LOW", 100.0).otherwise(0.0)
    return _six(rankings.fusion_weights(scored_orders(spark, d).groupBy("grp").agg(mean.alias("cv_mean")).withColumnRenamed("grp", "expert")), "weight")


@query(f"WITH {LONG} SELECT id, count(*) AS n, round(sum(value), 4) AS total FROM l WHERE feature IN ('var_3', 'var_0') GROUP BY id")
def column_subset(spark, d):
    narrow = pipelines.narrowed(embedding_rows(spark, d), ["var_3", "var_0"])
    return narrow.select("id", F.size("features").cast("long").alias("n"), F.round(F.col("features")[0] + F.col("features")[1], 4).alias("total"))


@query("""WITH m AS (SELECT unnest(['logistic', 'random_forest', 'gbt', 'borda', 'random', 'pairwise']) AS method, 'native' AS kind UNION ALL SELECT unnest(['extra_trees', 'lightgbm', 'xgboost', 'ranker', 'additive', 'best_subset']), 'own'),
n AS (SELECT *, row_number() OVER (ORDER BY method) - 1 AS place FROM m) SELECT method, kind, count(*) AS runs FROM n JOIN orders ON o_orderkey % 12 = place GROUP BY method, kind""")
def availability(spark, d):
    """What each method is made of, with the orders dealt out to the methods as runs."""
    names = F.array(*(F.lit(m) for m in sorted(models.KIND)))
    runs = table(spark, d, "orders").select(names[(F.col("o_orderkey") % len(models.KIND)).cast("int")].alias("method"))
    return runs.join(F.broadcast(models.availability(spark)), "method").groupBy("method", "kind").agg(F.count("*").alias("runs"))


# --- estimators: no SQL gives their numbers ---------------------------------------------------------------------------


@query()
def leafwise_targets(spark, d):
    df = embedding_rows(spark, d)
    return models.select_and_score(df.where("id % 2 = 0"), df.where("id % 2 = 1"), boosters.leafwise_boosted(trees=20), k=100)


@query()
def lambdamart_targets(spark, d):
    df = embedding_rows(spark, d)
    return selection.top_targets(boosters.lambdamart(trees=20)(df.where("id % 2 = 0")).score(df.where("id % 2 = 1")), 100)


@query()
def additive_targets(spark, d):
    df = embedding_rows(spark, d)
    return models.select_and_score(df.where("id % 2 = 0"), df.where("id % 2 = 1"), boosters.additive_boosted(rounds=20), k=100)


@query()
def best_subset_ranking(spark, d):
    scores = boosters.best_subset_scores(embedding_rows(spark, d), sizes=(1, 2, 4, 8))
    return spark.createDataFrame([(f"var_{k}", float(s)) for k, s in enumerate(scores)], "feature string, raw_score double")
