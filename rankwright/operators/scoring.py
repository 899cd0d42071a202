"""Scoring of experiments: predictions of many recipes over folds become score tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ledger import FEATURE_COST, MAX_TARGETS, profit, require_columns
from ..functions.multisets import PIECES, multiset_print
from .curves import best_point, profit_curve, ranked_curve
from .metrics import roc_auc
from .records import best_f1, random_baselines

CONTEXT = ("outer_fold", "round_name")
RECIPE = (*CONTEXT, "pipeline_recipe_id")
#: Columns that say what a recipe is; the same on every row of it.
NAMES = ("prescreen_recipe_id", "prescreen_name", "prescreen_methods", "rank_aggregation", "feature_recipe_id", "pipeline_recipe_id", "model_spec_id", "base_model_family", "model_kind", "model_params", "selected_features_text")
REQUIRED = (*RECIPE, "inner_fold", "sample_index", "y_true", "score", "feature_size")


def ok_rows(predictions: DataFrame) -> DataFrame:
    """Rows that count: status ok (or none), and nothing missing."""
    require_columns(predictions, REQUIRED)
    status = F.coalesce(F.col("status"), F.lit("ok")) if "status" in predictions.columns else F.lit("ok")
    whole = F.lit(True)
    for c in ("pipeline_recipe_id", "inner_fold", "sample_index", "y_true", "score"):
        whole = whole & F.col(c).isNotNull()
    return predictions.where((status == "ok") & whole & ~F.isnan("score"))


def duplicated(predictions: DataFrame, keys: Sequence[str] = (*RECIPE, "sample_index")) -> DataFrame:
    """Keys that stand more than once."""
    return predictions.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def label_conflicts(predictions: DataFrame) -> DataFrame:
    """Samples with more than one label."""
    return predictions.groupBy("sample_index").agg(F.count_distinct("y_true").alias("labels")).where("labels > 1")


def inconsistent_sizes(predictions: DataFrame) -> DataFrame:
    """Recipes whose feature_size is missing, negative, not whole, or not the same on every row."""
    per = predictions.groupBy(*RECIPE).agg(
        F.count_distinct("feature_size").alias("sizes"), F.min("feature_size").alias("least"), F.count_if(F.col("feature_size").isNull()).alias("missing"), F.count_if(F.col("feature_size") != F.floor("feature_size")).alias("broken")
    )
    return per.where("sizes <> 1 OR least < 0 OR missing > 0 OR broken > 0")


def require_none(bad: DataFrame, message: str) -> None:
    found = bad.limit(3).collect()
    if found:
        raise ValueError(f"{message}: {[r.asDict() for r in found]}")


def inner_scores(predictions: DataFrame, *, cap: int = MAX_TARGETS, manifest: DataFrame | None = None, check: bool = True) -> DataFrame:
    """One row for each (outer_fold, round_name, recipe): the pooled inner predictions' best k from 0 on, its
    score, gross value, rate, AUC and status.

    With ``manifest`` (outer_fold, inner_fold, sample_index) a recipe that misses a fold or a sample is
    "incomplete" and its score is null; samples that the manifest doesn't know are an error.
    """
    ok = ok_rows(predictions)
    if check:
        require_none(duplicated(ok), "duplicate inner-OOF predictions")
        require_none(label_conflicts(ok), "labels differ")
        require_none(inconsistent_sizes(ok), "feature_size is not one whole number")
    keyed = ok.select(*RECIPE, F.col("sample_index").alias("id"), F.col("y_true").alias("y"), "score")
    point = best_point(profit_curve(keyed, RECIPE, features=0, cap=cap, zero=True), RECIPE)
    names = [c for c in NAMES if c in predictions.columns and c not in RECIPE] + (["mean_duration_seconds"] if "duration_seconds" in predictions.columns else [])
    meta = ok.groupBy(*RECIPE).agg(
        F.max("feature_size").cast("long").alias("feature_size"), F.count("*").alias("n"), F.count_distinct("inner_fold").alias("inner_folds"),
        *(F.avg("duration_seconds").alias(c) if c == "mean_duration_seconds" else F.min(c).alias(c) for c in names),
    )
    both = F.count_if(F.col("y") == 1) * F.count_if(F.col("y") == 0) > 0
    f1 = best_f1(keyed, RECIPE, cap=cap).join(keyed.groupBy(*RECIPE).agg(both.alias("_both")), list(RECIPE)).select(*RECIPE, F.when(F.col("_both"), F.col("best_f1")).alias("f1_score"))
    scored = point.join(meta, list(RECIPE)).join(roc_auc(keyed, RECIPE), list(RECIPE), "left").join(f1, list(RECIPE), "left")
    out = scored.select(
        *RECIPE, "feature_size", "n", "inner_folds", F.col("k").alias("oof_k"), F.col("business_score").alias("gross_score"),
        (F.col("feature_size") * FEATURE_COST).alias("feature_penalty"), (F.col("business_score") - F.col("feature_size") * FEATURE_COST).alias("oof_score"),
        (F.col("k") / F.col("n").cast("double")).alias("contact_rate"), "threshold", "roc_auc", "tp", "fp", "f1_score", *names,
    )
    if manifest is None:
        return out.withColumn("status", F.lit("ok"))
    if check:
        require_none(ok.join(manifest, ["outer_fold", "inner_fold", "sample_index"], "left_anti").select("outer_fold", "inner_fold", "sample_index"), "samples outside the manifest")
    wanted = manifest.groupBy("outer_fold").agg(F.count("*").alias("_rows"), F.count_distinct("inner_fold").alias("_folds"))
    j = out.join(F.broadcast(wanted), "outer_fold", "left")
    j = j.withColumns({"missing_folds": F.col("_folds") - F.col("inner_folds"), "missing_samples": F.col("_rows") - F.col("n")})
    whole = (F.col("missing_folds") == 0) & (F.col("missing_samples") == 0)
    return j.withColumn("status", F.when(whole, "ok").otherwise("incomplete")).withColumn("oof_score", F.when(whole, F.col("oof_score"))).drop("_rows", "_folds")


def from_blocks(blocks: DataFrame) -> DataFrame:
    """Rows of prediction blocks: ``block`` is array<struct<sample_index, y_true, score>>."""
    return blocks.select(*(c for c in blocks.columns if c != "block"), F.inline("block"))


def block_scores(blocks: DataFrame, *, cap: int = MAX_TARGETS, manifest: DataFrame | None = None, check: bool = True) -> DataFrame:
    """``inner_scores`` of prediction blocks (one row a recipe and inner fold).  A recipe of which a block failed (status
    "error") has a row of its own instead, with that status, the error and no score."""
    failed = blocks.where("status = 'error'").groupBy(*RECIPE).agg(F.max("feature_size").cast("long").alias("feature_size"), F.min("error").alias("error"))
    whole = blocks.join(failed.select(*RECIPE), list(RECIPE), "left_anti")
    scores = inner_scores(from_blocks(whole.withColumn("status", F.lit("ok"))), cap=cap, manifest=manifest, check=check)
    return scores.withColumn("error", F.lit(None).cast("string")).unionByName(failed.withColumn("status", F.lit("error")), allowMissingColumns=True)


def baselines(predictions: DataFrame, *, cap: int = MAX_TARGETS, random_repeats: int = 0, seed: int = 42, manifest: DataFrame | None = None) -> DataFrame:
    """One row for each context and baseline: contacting the first ``cap`` samples at no feature or at one, contacting all
    of them, which the rules don't allow where there are more, and the best point of scores drawn at random.

    With ``manifest`` (outer_fold, sample_index, y) labels come from it, not from the predictions.  Columns: baseline,
    random_repeat, business_score, k, n, contact_rate, n_features, feature_penalty, gross_score, tp, fp, f1_score,
    roc_auc_score, legal, status.
    """
    ok = ok_rows(predictions)
    if manifest is None:
        samples = ok.groupBy(*CONTEXT, "sample_index").agg(F.max("y_true").cast("long").alias("y"))
    else:
        samples = ok.select(*CONTEXT).distinct().join(manifest.select("outer_fold", "sample_index", F.col("y").cast("long").alias("y")).distinct(), "outer_fold").select(*CONTEXT, "sample_index", "y")
    order = F.row_number().over(Window.partitionBy(*CONTEXT).orderBy("sample_index"))
    # The first rows are picked apart from the totals, so that no window sees a whole context.
    first = samples.withColumn("r", order).where(F.col("r") <= cap).groupBy(*CONTEXT).agg(F.sum("y").alias("tp"), F.sum(1 - F.col("y")).alias("fp"))
    first = first.toDF(*(f"_{c}" for c in CONTEXT), "tp", "fp")
    every = samples.groupBy(*CONTEXT).agg(F.count("*").alias("n"), F.sum("y").alias("all_tp"), F.sum(1 - F.col("y")).alias("all_fp"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CONTEXT]
    sums = every.join(first, same)
    entry = lambda name, tp, fp, size, legal: F.struct(F.lit(name).alias("baseline"), F.col(tp).alias("tp"), F.col(fp).alias("fp"), F.lit(size).alias("n_features"), F.lit(legal).alias("legal"))
    capped = F.array(entry("select_all_0", "tp", "fp", 0, True), entry("select_all_1", "tp", "fp", 1, True))
    whole = F.array(entry("select_all_full_0", "all_tp", "all_fp", 0, False), entry("select_all_full_1", "all_tp", "all_fp", 1, False))
    rows = sums.select(*CONTEXT, "n", F.explode(F.concat(capped, F.when(F.col("n") > cap, whole).otherwise(F.slice(capped, 1, 0)))).alias("b")).select(*CONTEXT, "n", "b.*")
    none = lambda kind: F.lit(None).cast(kind)
    rows = rows.withColumns({"random_repeat": none("int"), "k": F.col("tp") + F.col("fp"), "f1_score": none("double"), "roc_auc_score": none("double")})
    if random_repeats:
        drawn = random_baselines(samples.withColumnRenamed("sample_index", "id"), CONTEXT, repeats=random_repeats, seed=seed, cap=cap)
        rows = rows.unionByName(drawn.select(*CONTEXT, "n", F.lit("random_score").alias("baseline"), "tp", "fp", F.lit(0).alias("n_features"), F.lit(True).alias("legal"), "random_repeat", "k", "f1_score", "roc_auc_score"))
    gross = profit(F.col("tp"), F.col("fp")).cast("long")
    price = (F.col("n_features") * int(FEATURE_COST)).cast("long")
    return rows.select(
        *CONTEXT, "baseline", "random_repeat", (gross - price).alias("business_score"), F.col("k").cast("long").alias("k"), "n", (F.col("k") / F.col("n").cast("double")).alias("contact_rate"), "n_features",
        price.alias("feature_penalty"), gross.alias("gross_score"), F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), "f1_score", "roc_auc_score", "legal",
        F.when(F.col("legal"), "ok").otherwise("illegal_max_targets_exceeded").alias("status"),
    )


def with_baselines(scores: DataFrame, base: DataFrame, names: Sequence[str] = ("select_all_0", "select_all_1")) -> DataFrame:
    """Scores with <baseline>_business_score and beats_<baseline> (strictly) of their context."""
    base = base.where(F.col("random_repeat").isNull() | (F.col("random_repeat") == 0))
    wide = base.groupBy(*CONTEXT).pivot("baseline", list(names)).agg(F.first("business_score"))
    joined = scores.join(F.broadcast(wide.toDF(*CONTEXT, *(f"{n}_business_score" for n in names))), list(CONTEXT), "left")
    return joined.withColumns({f"beats_{n}": F.col("oof_score") > F.col(f"{n}_business_score") for n in names})


def aggregate_inner(scores: DataFrame, by: Sequence[str], *, score: str = "oof_score", scope: str = "table") -> DataFrame:
    """Scores of recipes over inner folds or contexts, with inner_selection_rank over the whole table or, with ``scope``
    "outer_fold", within each outer fold.

    Pooled scores (no ``inner_fold`` column) are ranked by mean score, mean AUC and size; those that miss predictions
    or folds are left out.  Scores of single inner folds are ranked by mean, median and least score and size.
    Other columns that are known (k, F1, contact rate, gross score, penalty, baselines, names) are carried on as means
    or, for names, as those of the first row.  Ties go by the keys.
    """
    pooled = "inner_fold" not in scores.columns
    ok = scores.where((F.col("status") == "ok") & F.col(score).isNotNull())
    for key in by:
        ok = ok.where(F.col(key).isNotNull())
    for gap in ("missing_samples", "missing_folds"):
        if pooled and gap in scores.columns:
            ok = ok.where(F.col(gap) == 0)
    value = F.col(score).cast("double")
    folds = F.count("*") if pooled else F.count_distinct("inner_fold")
    stats = ok.groupBy(*by).agg(
        folds.alias("runs"), F.avg(value).alias("mean_score"), F.median(value).alias("median_score"), F.min(value).alias("min_score"), F.max(value).alias("max_score"),
        F.stddev_samp(value).alias("std_score"), F.max("feature_size").cast("long").alias("feature_size"), *([F.avg("roc_auc").alias("mean_roc_auc")] if "roc_auc" in scores.columns else []),
        *([F.min("inner_folds").alias("inner_folds")] if "inner_folds" in scores.columns else []),
        *_means(scores, {"oof_k": "mean_k", "k": "mean_k", "f1_score": "mean_f1", "contact_rate": "mean_contact_rate", "gross_score": "mean_gross_score", "feature_penalty": "mean_feature_penalty"}),
        *_shares(scores), *_firsts(scores, by),
    )
    if scope not in ("table", "outer_fold"):
        raise ValueError(f"unknown scope {scope}")
    groups = ["outer_fold"] if scope == "outer_fold" and "outer_fold" in by else []
    keys = ["mean_score", "mean_roc_auc"] if pooled else ["mean_score", "median_score", "min_score"]
    order = [*(F.desc_nulls_last(k) for k in keys if k in stats.columns), F.asc_nulls_last("feature_size"), *(F.asc(k) for k in by)]
    return stats.withColumn("inner_selection_rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).cast("long"))


def _means(scores: DataFrame, wanted: Mapping[str, str]) -> list:
    found = {}
    for column, name in wanted.items():
        if column in scores.columns and name not in found:
            found[name] = F.avg(F.col(column).cast("double")).alias(name)
    return list(found.values())


def _shares(scores: DataFrame) -> list:
    """Mean of the scores of baselines, and the share of rows that beat each."""
    return [
        *(F.avg(F.col(c).cast("double")).alias(c) for c in scores.columns if c.endswith("_business_score") and c.startswith(("select_all", "random"))),
        *(F.avg(F.col(c).cast("double")).alias(f"share_{c}") for c in scores.columns if c.startswith("beats_")),
    ]


def _firsts(scores: DataFrame, by: Sequence[str]) -> list:
    return [F.min(c).alias(c) for c in NAMES if c in scores.columns and c not in by]


def aggregate_outer(scores: DataFrame, by: Sequence[str] = ("recipe_config_id",)) -> DataFrame:
    """Statistics of the outer folds by configuration, best first with outer_config_rank: by mean and median score,
    number of folds, spread and size, ties by the keys."""
    ok = scores.where((F.col("status") == "ok") & F.col("business_score").isNotNull())
    value, k = F.col("business_score").cast("double"), F.col("k").cast("double")
    stats = ok.groupBy(*by).agg(
        F.count_distinct("outer_fold").alias("outer_folds"), F.avg(value).alias("mean_score"), F.median(value).alias("median_score"), F.min(value).alias("min_score"), F.max(value).alias("max_score"),
        F.stddev_samp(value).alias("std_score"), F.avg(k).alias("mean_k"), F.median(k).alias("median_k"), F.max("feature_size").cast("long").alias("feature_size"),
        *_means(scores, {"f1_score": "mean_f1", "roc_auc": "mean_roc_auc", "inner_oof_score": "mean_inner_score", "inner_selection_rank": "mean_inner_rank"}),
        *([F.median(F.col("selected_feature_count").cast("double")).alias("selected_feature_count")] if "selected_feature_count" in scores.columns else []), *_firsts(scores, by),
    )
    order = [*(F.desc_nulls_last(c) for c in ("mean_score", "median_score", "outer_folds")), F.asc_nulls_last("std_score"), F.asc_nulls_last("feature_size"), *(F.asc(c) for c in by)]
    return stats.withColumn("outer_config_rank", F.row_number().over(Window.orderBy(*order)).cast("long"))  # one row a configuration


def outer_points(predictions: DataFrame, features: DataFrame, *, caps: Mapping[int, int] | None = None, cap: int = MAX_TARGETS, scale: Mapping[int, float] | None = None) -> DataFrame:
    """Score of each (outer_fold, config) at its best k under the fold's cap; k is chosen on the unscaled score,
    then the gross value is scaled and the features are charged once."""
    keys = ("outer_fold", "recipe_config_id")
    spark = predictions.sparkSession
    keyed = predictions.where("status = 'ok'").select(*keys, F.col("sample_index").alias("id"), F.col("y_true").alias("y"), "score")
    curve = ranked_curve(keyed, keys, cap=max([cap, *(caps or {}).values()]), zero=True)
    folds = [(f, (caps or {}).get(f, cap), float((scale or {}).get(f, 1.0))) for f in sorted({*(caps or {}), *(scale or {})})]
    params = spark.createDataFrame(folds, "outer_fold int, _cap long, _scale double")
    limited = curve.join(F.broadcast(params), "outer_fold", "left").where(F.col("k") <= F.coalesce("_cap", F.lit(cap)))
    limited = limited.withColumn("gross", profit(F.col("tp"), F.col("fp")).cast("long"))
    point = best_point(limited.select(*keys, "k", "tp", "fp", "gross", "threshold", "_scale"), keys, "gross")
    sized = point.join(F.broadcast(features), "recipe_config_id")
    charge = F.col("feature_size") * FEATURE_COST
    return sized.select(*keys, "k", "tp", "fp", "threshold", "feature_size", (F.col("gross") - charge).alias("unscaled_score"), (F.col("gross") * F.coalesce("_scale", F.lit(1.0)) - charge).alias("business_score"))


def complete_pairs(predictions: DataFrame, outer: DataFrame) -> DataFrame:
    """(outer_fold, config) whose samples are exactly the fold's, each once.

    Predictions are only added up to a fingerprint a pair (see ``multiset_print``), so no row of them is moved; the manifest
    is shuffled once by sample.  A fold whose manifest repeats a sample or holds a null one has no complete pair,
    nor has a pair that holds a null sample.
    """
    keys = ["outer_fold", "recipe_config_id"]
    names = ["n", *PIECES]
    times = outer.groupBy("outer_fold", "id").agg(F.count("*").alias("times"))
    wanted = times.groupBy("outer_fold").agg(F.max("times").alias("times"), *multiset_print("id")).where("times = 1 AND n = known")
    wanted = wanted.select("outer_fold", F.struct(*names).alias("want"))
    seen = predictions.groupBy(*keys).agg(*multiset_print("sample_index")).where("n = known").select(*keys, F.struct(*names).alias("seen"))
    return seen.join(F.broadcast(wanted), "outer_fold").where("seen = want").select(*keys)


def pooled_best(predictions: DataFrame, by: Sequence[str], *, features: int, cap: int = MAX_TARGETS) -> DataFrame:
    """Best k from 1 on over all folds pooled, for each configuration without repeated samples; others say so."""
    keyed = predictions.select(*by, F.col("sample_index").alias("id"), F.col("y_true").alias("y"), "score")
    repeated = keyed.groupBy(*by, "id").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max("n").alias("n"))
    point = best_point(profit_curve(keyed, by, features=features, cap=cap), by)
    both = point.join(repeated, list(by))
    ok = F.col("n") == 1
    return both.select(*by, F.when(ok, "ok").otherwise("duplicate").alias("status"), F.when(ok, F.col("k")).alias("k"), F.when(ok, F.col("business_score")).alias("business_score"))


def feature_frequency(selected: DataFrame) -> DataFrame:
    """feature, times, folds, configs, mean_order over refits (outer_fold, recipe_config_id, features)."""
    rows = selected.select("outer_fold", "recipe_config_id", F.posexplode("features").alias("pos", "feature"))
    return rows.groupBy("feature").agg(F.count("*").alias("times"), F.count_distinct("outer_fold").alias("folds"), F.count_distinct("recipe_config_id").alias("configs"), F.avg((F.col("pos") + 1).cast("double")).alias("mean_order"))


def validation_rank(scores: DataFrame) -> DataFrame:
    """Ok rows ranked by score, then by fewer features; errors and others behind them without a rank."""
    state = F.when(F.col("status") == "ok", 0).when(F.col("status") == "error", 1).otherwise(9)
    order = [F.desc_nulls_last("score"), F.asc_nulls_last("n_features"), F.asc("feature_set_id")]
    place = F.row_number().over(Window.partitionBy("_state").orderBy(*order))
    ranked = scores.withColumn("_state", state).withColumn("validation_rank", F.when(F.col("_state") == 0, place).cast("long"))
    return ranked.orderBy("_state", F.asc_nulls_last("validation_rank"), F.desc_nulls_last("score"), "feature_set_id").drop("_state")


def best_by(scores: DataFrame, key: str) -> DataFrame:
    """The best ok row of each ``key``."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("n_features"), "feature_set_id", "model")
    return scores.where("status = 'ok'").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def stability(scores: DataFrame) -> DataFrame:
    """Statistics of each feature set over models."""
    value = F.col("score").cast("double")
    ok = scores.where("status = 'ok'")
    return ok.groupBy("feature_set_id").agg(F.count("*").alias("models"), F.avg(value).alias("mean_score"), F.max(value).alias("best_score"), F.min(value).alias("worst_score"), F.stddev_samp(value).alias("std_score"))

