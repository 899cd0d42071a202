"""Readers and writers of matrices, labels, rankings, summaries and logs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ledger import no_nan, require_columns
from ..functions.parsing import config_id, missing_when_empty, names_from_text, prescreen_of
from ..functions.ranges import placed
from ..functions.shared import written
from ..operators.rankings import prefix_sets
from ..operators.scoring import aggregate_inner, baselines, inner_scores, with_baselines
from ..operators.selection import top_recipes

STAGE_ONE = {
    "outer_folds": "sample_index long, outer_fold int",
    "inner_folds": "outer_fold int, sample_index long, inner_fold int",
    "prescreen_recipes": "prescreen_recipe_id string, prescreen_name string, prescreen_methods string, prescreen_method_count int, rank_aggregation string, adaptive boolean, adaptive_method_count int, leakage_rule string",
    "feature_sizes": "feature_size_id string, feature_size int",
    "model_specs": "model_spec_id string, base_model_family string, model_kind string, model_params string",
    "pipeline_recipes": "pipeline_recipe_id string, prescreen_recipe_id string, prescreen_name string, feature_size int, model_spec_id string, base_model_family string, model_kind string, search_stage string",
    "leakage_contract": "step string, may_see string, rule string",
}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def find_root(start: str, marker: str = "data/x_train.txt") -> str:
    """The nearest folder from ``start`` (on this machine) upwards that holds ``marker``; what can't be read doesn't."""
    for folder in (p := Path(start).resolve(), *p.parents):
        try:
            if (folder / marker).exists():
                return str(folder)
        except OSError:
            continue
    raise FileNotFoundError(f"no folder from {start} upwards holds {marker}")


def _numbered(spark: SparkSession, path: str, keep: Callable[[Column], Column]) -> DataFrame:
    """line (from 0 on, in file order), values (array of double, null where there is no number) of the lines that aren't
    blank and whose values pass ``keep``.

    Lines are numbered by task as they are read, and what earlier blocks of the files hold is added; a block's rows
    stand in one task, one after the other.
    """
    values = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("double"))
    read = spark.read.text(path).where(F.trim(F.regexp_replace("value", r"\s", " ")) != "")
    read = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), values.alias("values"))
    rows = written(read.where(keep(F.col("values"))).withColumn("nth", F.monotonically_increasing_id()), "matrix-lines")
    blocks = rows.groupBy("file", "block").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of the files
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(blocks, ["file", "block"]).select((F.col("nth") + F.col("shift")).alias("line"), "values")


def _filled(rows: DataFrame) -> DataFrame:
    """``values`` as ``features`` of one width, with 0 for what is no number or missing at the end of a line."""
    width = rows.agg(F.coalesce(F.max(F.size("values")), F.lit(0)).alias("w")).first().w
    every = F.sequence(F.lit(0), F.lit(width - 1)) if width else F.array().cast("array<int>")
    return rows.withColumn("features", F.transform(every, lambda i: F.coalesce(F.get("values", i), F.lit(0.0)))).drop("values")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """sample_index, features of white-space delimited numbers; what is no number is 0; blank lines and lines without any
    number, such as a header, are left out and the rest numbered from 0 on, in file order."""
    rows = _numbered(spark, path, lambda v: F.exists(v, lambda x: x.isNotNull()))
    return _filled(rows.withColumnRenamed("line", "sample_index"))


def read_training(spark: SparkSession, x_path: str, y_path: str) -> DataFrame:
    """id, y, features: lines of both files are matched by their number, blank lines aside, and those whose label is 0 or
    1 are kept, whatever their features, and numbered from 0 on in file order."""
    every = lambda v: F.lit(True)
    y = _numbered(spark, y_path, every).select("line", F.get("values", F.lit(0)).alias("y")).where(F.col("y").isin(0.0, 1.0))
    both = _numbered(spark, x_path, every).join(y, "line")
    numbered = placed(both, [], [F.col("line")], name="id")
    return _filled(numbered.select((F.col("id") - 1).alias("id"), F.col("y").cast("int").alias("y"), "values"))


def read_stage_one(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).csv(f"{folder}/{name}.csv", header=True) for name, schema in STAGE_ONE.items()}


def write_relations(relations: Mapping[str, DataFrame], folder: str, *, kind: str = "parquet") -> None:
    for name, df in relations.items():
        writer = df.write.mode("overwrite")
        writer.parquet(f"{folder}/{name}") if kind == "parquet" else writer.csv(f"{folder}/{name}.csv", header=True)


def read_csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True) if _exists(spark, path) else spark.createDataFrame([], schema)


def read_json_or(spark: SparkSession, path: str, default=None):
    """A small JSON document, or ``default`` where there is none."""
    if not _exists(spark, path):
        return default
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_json(spark: SparkSession, path: str, payload) -> None:
    """A small JSON document with sorted keys, through the file system of the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps(payload, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], *, use_existing: bool = True, force: bool = False) -> DataFrame:
    """The table at ``path`` if it may be used, else a new one that is written there."""
    if not (use_existing and not force and _exists(spark, f"{path}/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_or_build_json(spark: SparkSession, path: str, build: Callable[[], object], *, use_existing: bool = True, force: bool = False):
    """The JSON document at ``path`` if it may be used, else a new one that is written there."""
    if use_existing and not force and _exists(spark, path):
        return read_json_or(spark, path)
    payload = build()
    write_json(spark, path, payload)
    return payload


def usable_outputs(spark: SparkSession, folder: str, names: Sequence[str], *, legacy: str | None = None, use_existing: bool = True, force: bool = False) -> str | None:
    """``folder``, or else ``legacy``, if all of ``names`` are there and may be used; null if they have to be made."""
    if not use_existing or force:
        return None
    return next((f for f in (folder, legacy) if f and all(_exists(spark, f"{f}/{n}") for n in names)), None)


def append(df: DataFrame, path: str) -> None:
    if not df.isEmpty():
        df.write.mode("append").parquet(path)


def has_columns(spark: SparkSession, path: str, names: Sequence[str]) -> bool:
    """Whether a CSV's header has the names; only the header is read."""
    if not _exists(spark, path):
        return False
    first = spark.read.text(path).limit(1).collect()
    return bool(first) and set(names) <= set(first[0].value.split(","))


def prediction_contexts(predictions: DataFrame, *, outer_folds: Sequence[int] | None = None, rounds: Sequence[str] | None = None) -> DataFrame:
    """Distinct (outer_fold, round_name), filtered and sorted, in one pass."""
    require_columns(predictions, ["outer_fold", "round_name"])
    kept = predictions.where(F.col("outer_fold").isin(*outer_folds)) if outer_folds else predictions
    kept = kept.where(F.col("round_name").isin(*rounds)) if rounds else kept
    return kept.select("outer_fold", "round_name").distinct().orderBy("outer_fold", "round_name")


#: Columns of a file of inner predictions that scoring reads, and their types.
PREDICTION_COLUMNS = {"outer_fold": "int", "inner_fold": "int", "round_name": "string", "pipeline_recipe_id": "string", "feature_size": "int", "sample_index": "long", "y_true": "int", "score": "double"}


def scored_predictions_csv(
    spark: SparkSession, path: str, *, outer_folds: Sequence[int] | None = None, rounds: Sequence[str] | None = None, cap: int = 1000, random_repeats: int = 0, seed: int = 42, manifest: DataFrame | None = None,
    scores_path: str | None = None, baselines_path: str | None = None,
) -> DataFrame:
    """``inner_scores`` with their baselines of a CSV file of predictions, all contexts in one pass over the file; written
    to the paths that are given."""
    if not has_columns(spark, path, list(PREDICTION_COLUMNS)):
        raise ValueError(f"{path} lacks some of {', '.join(PREDICTION_COLUMNS)}")
    raw = spark.read.csv(path, header=True)
    rows = raw.select(*(F.col(c).try_cast(PREDICTION_COLUMNS[c]).alias(c) if c in PREDICTION_COLUMNS else F.col(c) for c in raw.columns))
    rows = rows.where(F.col("outer_fold").isin(*outer_folds)) if outer_folds else rows
    rows = rows.where(F.col("round_name").isin(*rounds)) if rounds else rows
    rows = written(rows, "predictions")
    base = baselines(rows, cap=cap, random_repeats=random_repeats, seed=seed)
    out = with_baselines(inner_scores(rows, cap=cap, manifest=manifest), base)
    for df, target in ((out, scores_path), (base, baselines_path)):
        if target:
            df.write.mode("overwrite").parquet(target)
    return out


def write_submission(ranking: DataFrame, features: Sequence[str], folder: str) -> None:
    """One-based row numbers, best first, and one-based variable numbers, one a line; at most as many as are ranked."""
    spark = ranking.sparkSession
    rows = ranking.orderBy("rank").select((F.col("id") + 1).cast("string").alias("value"))
    rows.coalesce(1).write.mode("overwrite").text(f"{folder}/customers")
    numbers = sorted(int(f.removeprefix("var_")) + 1 for f in features)
    spark.createDataFrame([(str(n),) for n in numbers], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/variables")


def export_ranking(ranking: DataFrame, features: Sequence[str], summary: Mapping, folder: str) -> None:
    """Predictions, summary and submission files of one approach."""
    ranking.write.mode("overwrite").parquet(f"{folder}/model_predictions")
    write_json(ranking.sparkSession, f"{folder}/modeling_summary.json", dict(summary))
    write_submission(ranking, features, folder)


SUMMARY = "approach string, best_model string, best_feature_set string, features array<string>, cv_business_mean double, oof_optimal_k long, oof_business_score double, test_targets long"


def read_summaries(spark: SparkSession, root: str, approaches: Sequence[str]) -> DataFrame:
    """The summaries that exist, one row for each."""
    paths = [f"{root}/{a}/modeling_summary.json" for a in approaches]
    found = [p for p in paths if _exists(spark, p)]
    return spark.read.schema(SUMMARY).json(found, multiLine=True) if found else spark.createDataFrame([], SUMMARY)


def missing_approaches(summaries: DataFrame, approaches: Sequence[str]) -> DataFrame:
    wanted = summaries.sparkSession.createDataFrame([(a,) for a in approaches], "approach string")
    return wanted.join(summaries, "approach", "left_anti")


def compared_approaches(summaries: DataFrame) -> DataFrame:
    """Approaches by out-of-fold score, then by cross-validated mean; unknown ones last."""
    clean = no_nan(summaries, "oof_business_score", "cv_business_mean").withColumns({c: missing_when_empty(F.col(c)) for c in ("best_model", "best_feature_set")})
    score = F.coalesce("oof_business_score", "cv_business_mean")
    return clean.withColumn("score", score).withColumn("n_features", F.size(F.coalesce("features", F.array().cast("array<string>")))).orderBy(F.desc_nulls_last("score"), "approach")


def log_event(spark: SparkSession, path: str, stage: str, message: str, **payload) -> None:
    """Append one event; the payload is a map, so the schema never drifts."""
    row = spark.range(1).select(
        F.lit(stage).alias("stage"), F.lit(message).alias("message"), F.current_timestamp().alias("logged_at"),
        F.create_map(*(F.lit(str(x)) for kv in sorted(payload.items()) for x in kv)).cast("map<string,string>").alias("payload"),
    )
    row.write.mode("append").parquet(path)


def normalised_recipes(recipes: DataFrame) -> DataFrame:
    """Recipes with a whole outer_fold and feature_size; prescreen_recipe_id, recipe_config_id and inner_selection_rank
    are made where they are missing, the last by the order of pipeline_recipe_id.  Rows without a fold go."""
    out = recipes.withColumn("outer_fold", F.col("outer_fold").try_cast("double").cast("int")).where(F.col("outer_fold").isNotNull())
    out = out.withColumn("feature_size", F.col("feature_size").try_cast("double").cast("int"))
    source = next((c for c in ("recipe_config_id", "feature_recipe_id", "pipeline_recipe_id") if c in out.columns), None)
    made = prescreen_of(F.col(source)) if source else F.lit(None).cast("string")
    known = missing_when_empty(F.col("prescreen_recipe_id")) if "prescreen_recipe_id" in out.columns else F.lit(None).cast("string")
    out = out.withColumn("prescreen_recipe_id", F.coalesce(known, made))
    if "recipe_config_id" not in out.columns:
        made = config_id(F.col("prescreen_recipe_id"), F.col("feature_size"), F.col("model_spec_id")) if "model_spec_id" in out.columns else F.col("pipeline_recipe_id")
        out = out.withColumn("recipe_config_id", made)
    if "inner_selection_rank" not in out.columns:
        order = Window.partitionBy("outer_fold").orderBy("pipeline_recipe_id" if "pipeline_recipe_id" in out.columns else "recipe_config_id")  # recipes that a stage has chosen
        out = out.withColumn("inner_selection_rank", F.row_number().over(order).cast("long"))
    return out


def load_or_select_recipes(
    spark: SparkSession, folder: str, *, score: Callable[[DataFrame], DataFrame], top: int = 10, least_runs: int = 5, outer_folds: Sequence[int] | None = None, most_features: int | None = None, prefer_selected: bool = True, write: bool = True
) -> DataFrame:
    """The recipes chosen by an inner stage: the table of selected ones, or else the best ``top`` of each outer fold by
    the stage's scores, or else by scores made with ``score`` from its predictions; ``selection_artifact`` says which."""
    selected, scores, predictions = (f"{folder}/{n}" for n in ("outer_selected_pipeline_recipes", "round2_inner_oof_scores", "round2_inner_predictions"))
    small = lambda df: df if most_features is None else df.where(F.col("feature_size") <= most_features)
    if prefer_selected and _exists(spark, f"{selected}/_SUCCESS"):
        return small(normalised_recipes(spark.read.parquet(selected)).withColumn("selection_artifact", F.lit("outer_selected_pipeline_recipes")))
    if not _exists(spark, f"{scores}/_SUCCESS"):
        if not _exists(spark, f"{predictions}/_SUCCESS"):
            raise FileNotFoundError(f"{folder} holds neither selected recipes nor scores nor predictions")
        score(spark.read.parquet(predictions)).write.mode("overwrite").parquet(scores)
    found = small(spark.read.parquet(scores))
    found = found.where(F.col("outer_fold").isin(*outer_folds)) if outer_folds else found
    ranked = aggregate_inner(found, ["outer_fold", "pipeline_recipe_id"], scope="outer_fold")
    kept = top_recipes(ranked, top=top, least_folds=least_runs, runs="runs" if "inner_folds" not in found.columns else "inner_folds", scope="outer_fold")
    out = normalised_recipes(kept.withColumn("selection_artifact", F.lit("round2_inner_oof_scores")))
    if not write:
        return out
    out.write.mode("overwrite").parquet(selected)
    return spark.read.parquet(selected)


def feature_sets_from_selection(spark: SparkSession, folder: str, sizes: Sequence[int] | None = None) -> DataFrame:
    """set_name, size, features of the ranking that a selection stage left in ``folder``/feature_selection_results.csv."""
    ranked = spark.read.schema("feature string, order long").csv(f"{folder}/feature_selection_results.csv", header=True, enforceSchema=False)
    if ranked.isEmpty():
        raise ValueError(f"no ranked features in {folder}")
    return prefix_sets(ranked, sizes if sizes is not None else STAGE_SIZES, whole=sizes is None)


#: Sizes of the sets that a selection stage hands on (fixed values).
STAGE_SIZES = (1, 3, 4, 5, 8, 10, 15, 20)


def stage_data(spark: SparkSession, data: str, folder: str, *, without: Sequence[str] = ()) -> dict[str, DataFrame]:
    """What a modelling stage starts from: train, test, the scores of feature sets, the candidates (those not named in
    ``without``), and the training table narrowed to the widest set."""
    train, test = read_training(spark, f"{data}/x_train.txt", f"{data}/y_train.txt"), read_matrix(spark, f"{data}/x_test.txt")
    scores = spark.read.csv(f"{folder}/stage3_feature_set_scores.csv", header=True, inferSchema=True).withColumn("features", names_from_text(F.col("features")))
    widest = scores.orderBy(F.desc("feature_count"), "feature_set_name").first().features
    narrow = train.withColumn("features", F.array(*(F.col("features")[int(f.removeprefix("var_"))] for f in widest)))
    return {"train": train, "test": test, "scores": scores, "candidates": scores.where(~F.col("feature_set_name").isin(*without)) if without else scores, "widest": narrow}


def write_search_results(spark: SparkSession, folder: str, model: str, params: Mapping, score: float) -> None:
    """The best parameters of a search, by model and as the summary."""
    payload = {"best_params": dict(params), "cv_business_mean": score}
    write_json(spark, f"{folder}/hpo/{model}_hpo.json", payload)
    write_json(spark, f"{folder}/hpo/hpo_summary.json", {model: payload})


def outputs_folder(root: str, approach: str) -> str:
    return f"{root.rstrip('/')}/outputs/{approach}"


def run_context(spark: SparkSession, root: str, approach: str, *, cap: int = 1000, seed: int = 42) -> dict:
    """Folders and settings of a modelling run, and its data read from them."""
    shared = f"{root.rstrip('/')}/outputs"
    return {"outputs": outputs_folder(root, approach), "cap": cap, "seed": seed, **stage_data(spark, f"{root.rstrip('/')}/data", shared)}


def baseline_reference_rows(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """approach, n_features, cv_business_mean, cv_business_no_cost of the named entries of a JSON summary of baselines
    (name -> metric -> mean, std, folds), and of its reference without targets; no rows where there is no file."""
    schema = "approach string, n_features int, cv_business_mean double, cv_business_no_cost double"
    summary = (read_json_or(spark, path) or {}).get("summary", {})
    mean = lambda m: m.get("mean") if isinstance(m, dict) else m
    rows = []
    for name in ("k0_reference", *names):
        found = summary.get(name)
        if isinstance(found, dict):
            size = 0 if name == "k0_reference" or "dummy" in name else int((re.search(r"(\d+)feat", name) or [0, 1])[1])
            rows.append((f"baseline_{name.removesuffix('_reference')}", size, *(None if (v := mean(found.get(m))) is None else float(v) for m in ("business_with_var_penalty", "business_no_var_penalty"))))
    return spark.createDataFrame(rows, schema)
