"""Recipe spaces: which rankings, feature counts and models an experiment runs over."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rankings import combination_name

PRESCREENS = (
    "prescreen_recipe_id string, prescreen_name string, prescreen_methods array<string>, prescreen_method_count int, "
    "rank_aggregation string, adaptive boolean, adaptive_method_count int"
)


def prescreen_recipes(spark: SparkSession, methods: Sequence[str]) -> DataFrame:
    """Every non-empty combination by mean rank, then two adaptive ones whose weights are learnt on training rows."""
    rows = []
    for k in range(1, len(methods) + 1):
        for c in combinations(methods, k):
            rows.append((f"ps_mean_{len(rows) + 1:04d}", combination_name(c, len(methods)), list(c), k, "mean", False, None))
    rows.append(("ps_adaptive_weighted", "adaptive__weighted", list(methods), len(methods), "weighted", True, None))
    rows.append(("ps_adaptive_top3", "adaptive__top3", list(methods), len(methods), "weighted_top_k", True, min(3, len(methods))))
    return spark.createDataFrame(rows, PRESCREENS)


def feature_sizes(spark: SparkSession, sizes: Sequence[int]) -> DataFrame:
    return spark.createDataFrame([(f"k_{s:03d}", s) for s in sizes], "feature_size_id string, feature_size int")


def model_specs(spark: SparkSession, specs: Sequence[tuple[str, str, str, Mapping]]) -> DataFrame:
    """(id, family, kind, parameters): parameters are kept as JSON with sorted keys."""
    rows = [(i, family, kind, json.dumps(dict(p), sort_keys=True)) for i, family, kind, p in specs]
    return spark.createDataFrame(rows, "model_spec_id string, base_model_family string, model_kind string, model_params string")


def default_model_specs() -> list[tuple[str, str, str, dict]]:
    """The 42 specs of the grid, by rule: eight depths and leaf sizes of extra trees, six forests, eight of each
    boosting, six penalties of logistic regression, three additive and three ranking models."""
    out: list[tuple[str, str, str, dict]] = []

    def add(family: str, kind: str, grid: list[dict]) -> None:
        out.extend((f"{family}_{k:02d}", family, kind, p) for k, p in enumerate(grid, 1))

    add("extra_trees", "classifier", [{"max_depth": d, "min_samples_leaf": m, "n_estimators": 400} for d in (3, 4, 5, 6) for m in (8, 16)])
    add("random_forest", "classifier", [{"max_depth": d, "min_samples_leaf": m, "n_estimators": 300} for d in (3, 4, 5) for m in (8, 16)])
    for family in ("lightgbm", "xgboost"):
        add(family, "classifier", [{"max_depth": d, "learning_rate": r, "n_estimators": n} for d in (2, 3) for r in (0.03, 0.1) for n in (100, 200)])
    add("logistic", "classifier", [{"C": c, "l1_ratio": m} for c in (0.01, 0.1, 1.0) for m in (0.0, 0.5)])
    add("additive", "classifier", [{"max_bins": b} for b in (16, 32, 64)])
    add("ranker", "ranker", [{"num_leaves": n} for n in (7, 15, 31)])
    return out


#: Small grids for the families that came out best (fixed values): family -> rows of parameters under SEARCH_NAMES.
SEARCH_NAMES = {
    "extra_trees": ("n_estimators", "max_depth", "min_samples_leaf", "class_weight"),
    "random_forest": ("n_estimators", "max_depth", "min_samples_leaf", "class_weight"),
    "lightgbm": ("n_estimators", "learning_rate", "num_leaves", "min_child_samples", "scale_pos_weight_multiplier"),
    "xgboost": ("n_estimators", "learning_rate", "max_depth", "min_child_weight", "scale_pos_weight_multiplier"),
    "logistic": ("C", "l1_ratio", "class_weight"),
}
SEARCH_ROWS = {
    "extra_trees": ((240, 4, 12, "balanced"), (240, 5, 20, "balanced_subsample"), (300, 7, 25, None)),
    "random_forest": ((220, 4, 12, "balanced_subsample"), (220, 6, 20, "balanced"), (300, 7, 25, None)),
    "lightgbm": ((120, 0.05, 15, 15, 0.75), (160, 0.04, 24, 25, 1.0), (200, 0.03, 31, 35, 1.25)),
    "xgboost": ((120, 0.05, 2, 1.0, 0.75), (160, 0.04, 3, 3.0, 1.0), (200, 0.03, 4, 5.0, 1.25)),
    "logistic": ((0.2, 0.2, "balanced"), (0.5, 0.5, "balanced"), (1.0, 0.8, None)),
}


def search_specs(families: Sequence[str] | None = None) -> list[tuple[str, str, str, dict]]:
    """Specs of the small grids, as ``model_specs`` takes them."""
    return [
        (f"{family}_hpo{k:02d}", family, "classifier", dict(zip(SEARCH_NAMES[family], row)))
        for family in families or SEARCH_ROWS for k, row in enumerate(SEARCH_ROWS[family], 1)
    ]


#: The larger grids of the last stage (fixed values): family -> rows of parameters under the names before them; None in the
#: last places leaves a parameter out.
_FOREST = ("n_estimators", "max_depth", "min_samples_leaf", "class_weight")
EXPANDED = {
    "extra_trees": (_FOREST, (
        (320, 3, 8, "balanced"), (320, 4, 12, "balanced"), (400, 5, 16, "balanced"), (400, 6, 20, "balanced"), (500, 7, 24, "balanced"), (500, 8, 30, "balanced"), (400, None, 35, "balanced"), (500, 5, 20, None),
    )),
    "random_forest": (_FOREST, (
        (320, 4, 10, "balanced_subsample"), (400, 5, 16, "balanced_subsample"), (400, 6, 20, "balanced"), (500, 7, 24, "balanced"), (500, 8, 30, None), (600, None, 40, "balanced_subsample"),
    )),
    "lightgbm": (("n_estimators", "learning_rate", "num_leaves", "min_child_samples", "scale_pos_weight_multiplier", "subsample", "colsample_bytree", "reg_lambda"), (
        (160, 0.05, 7, 10, 0.75), (220, 0.04, 11, 15, 0.9), (260, 0.035, 15, 20, 1.0), (300, 0.03, 23, 25, 1.1), (360, 0.025, 31, 30, 1.25), (420, 0.02, 39, 35, 1.4),
        (260, 0.04, 15, 40, None, 0.8, 0.8), (320, 0.03, 23, 50, None, None, None, 3.0),
    )),
    "logistic": (("C", "l1_ratio", "class_weight"), (
        (0.05, 0.0, "balanced"), (0.1, 0.2, "balanced"), (0.2, 0.5, "balanced"), (0.5, 0.8, "balanced"), (1.0, 1.0, "balanced"), (2.0, 0.5, None),
    )),
    "xgboost": (("n_estimators", "learning_rate", "max_depth", "min_child_weight", "scale_pos_weight_multiplier", "subsample", "colsample_bytree", "reg_lambda"), (
        (160, 0.05, 2, 1.0, 0.75), (220, 0.04, 2, 2.0, 1.0), (260, 0.035, 3, 3.0, 1.0), (300, 0.03, 3, 5.0, 1.2), (360, 0.025, 4, 5.0, 1.3), (420, 0.02, 4, 8.0, 1.5),
        (300, 0.03, 2, 8.0, None, 0.8, 0.8), (360, 0.025, 3, 10.0, None, None, None, 3.0),
    )),
    "additive": (("interactions", "max_bins", "outer_bags", "max_rounds"), ((0, 64, 4, 3000), (0, 128, 6, 4000), (2, 64, 4, 3000))),
    "ranker": (("n_estimators", "learning_rate", "num_leaves"), ((160, 0.05, 15), (240, 0.04, 23), (320, 0.03, 31))),
}


def expanded_specs(*, xgboost: bool = True, additive: bool = False, ranker: bool = True) -> list[tuple[str, str, str, dict]]:
    """Specs of the larger grids; three families can be left out or taken in.  A class weight or depth of None is one."""
    left_out = {f for f, wanted in (("xgboost", xgboost), ("additive", additive), ("ranker", ranker)) if not wanted}
    kept = ("class_weight", "max_depth")
    out = []
    for family, (names, rows) in EXPANDED.items():
        if family not in left_out:
            kind = "ranker" if family == "ranker" else "classifier"
            out += [(f"{family}_deep{k:02d}", family, kind, {n: v for n, v in zip(names, row) if v is not None or n in kept}) for k, row in enumerate(rows, 1)]
    return out


def pipeline_recipes(prescreens: DataFrame, sizes: DataFrame, models: DataFrame, *, stage: str = "round_1") -> DataFrame:
    """The cartesian space, numbered in the order of its three tables' ids: a product that is asked for, of small tables."""
    crossed = prescreens.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(models))
    counts = models.agg(F.count("*").alias("m")).crossJoin(sizes.agg(F.count("*").alias("s")))
    place = lambda df, key, name: df.select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias(name))  # noqa: E731  at most hundreds of rows
    numbered = (
        crossed.join(F.broadcast(place(prescreens, "prescreen_recipe_id", "_p")), "prescreen_recipe_id")
        .join(F.broadcast(place(sizes, "feature_size_id", "_s")), "feature_size_id")
        .join(F.broadcast(place(models, "model_spec_id", "_m")), "model_spec_id")
        .crossJoin(F.broadcast(counts))
    )
    number = (F.col("_p") * F.col("s") + F.col("_s")) * F.col("m") + F.col("_m") + 1
    return numbered.select(
        F.format_string("pipe_%07d", number).alias("pipeline_recipe_id"), "prescreen_recipe_id", "prescreen_name", "feature_size",
        "model_spec_id", "base_model_family", "model_kind", F.lit(stage).alias("search_stage"),
    )


def space_summary(pipelines: DataFrame) -> DataFrame:
    return pipelines.groupBy("base_model_family", "feature_size").agg(F.count("*").alias("recipes"))


def filter_specs(specs: DataFrame, ids: Sequence[str] | None = None, *, most: int | None = None, key: str = "model_spec_id") -> DataFrame:
    """Specs with the given ids (none given: all), at most ``most`` of them in id order."""
    kept = specs.where(F.col(key).isin(*ids)) if ids else specs
    return kept if most is None else kept.orderBy(key).limit(most)


def filter_prescreens(recipes: DataFrame, ids: Sequence[str] | None = None, *, adaptive: bool = True, most: int | None = None) -> DataFrame:
    kept = recipes if adaptive else recipes.where("NOT adaptive")
    return filter_specs(kept, ids, most=most, key="prescreen_recipe_id")


def required_methods(recipes: DataFrame) -> DataFrame:
    """Distinct methods in the order in which the recipes first name them."""
    rows = recipes.select("prescreen_recipe_id", F.posexplode("prescreen_methods").alias("pos", "method"))
    first = rows.groupBy("method").agg(F.min(F.struct("prescreen_recipe_id", "pos")).alias("o"))
    return first.select("method", F.row_number().over(Window.orderBy("o")).cast("long").alias("place"))  # one row a method


def leakage_contract(spark: SparkSession) -> DataFrame:
    """What each step may see."""
    rows = [
        ("outer_split", "all rows", "labels only to stratify"),
        ("inner_split", "outer training rows", "never the outer validation rows"),
        ("prescreen", "inner training rows", "rankings are fitted anew in each fold"),
        ("model_fit", "inner training rows", "class weights come from the training labels"),
        ("recipe_choice", "inner validation predictions", "pooled over inner folds"),
        ("outer_audit", "outer validation rows", "only to report, not to choose"),
    ]
    return spark.createDataFrame(rows, "step string, may_see string, rule string")


LOG_SCHEMA = "stage string, message string, logged_at timestamp, payload map<string,string>"


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG_SCHEMA)
