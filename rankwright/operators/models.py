"""Estimators behind one protocol, out-of-fold scoring, calibration, segments and pairwise ranking.

A scorer is made from a training table (id, y, features) and adds ``score`` to
another one.  ``KIND`` says of each family whether it is made of Spark's own
estimators and functions ("native") or grown here, on a bounded sample ("own").
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ledger import FEATURE_COST
from ..functions.permute import permuted_columns
from ..functions.ranges import placed, quantiles
from ..functions.shared import written
from .curves import best_point, expected_value, profit_curve, ranked
from .features import class_weight, collapse_basis, spline_basis
from .isotonic import calibrated  # noqa: F401
from .paths import LogisticTask, fit_many, held_out_scores
from .rankings import fused_scores, fusion_weights
from .segments import kmeans_clusters, kmeans_diagnostics, mixture_segments  # noqa: F401

KIND = {
    "logistic": "native", "random_forest": "native", "gbt": "native", "borda": "native", "random": "native", "pairwise": "native",
    "extra_trees": "own", "lightgbm": "own", "xgboost": "own", "ranker": "own", "additive": "own", "best_subset": "own",
}


def availability(spark) -> DataFrame:
    return spark.createDataFrame(sorted(KIND.items()), "method string, kind string")


def _statistics(long: DataFrame, key: str, robust: bool) -> DataFrame:
    """key, q: quartiles of ``v``, or its mean and half a population spread to either side."""
    if robust:
        return quantiles(long, key, "v", (0.25, 0.5, 0.75))
    return long.groupBy(key).agg(F.array(F.avg("v") - F.stddev_pop("v") / 2, F.avg("v"), F.avg("v") + F.stddev_pop("v") / 2).alias("q"))


def held_out_scalings(rows: DataFrame, held: Sequence[int], *, robust: bool = True) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """held-out fold -> centre and scale of the features by the rows (features, fold) outside it, as ``scaling`` takes them;
    a row a feature and fold comes to the driver.  A feature without values stays as it is."""
    width = rows.agg(F.max(F.size("features")).alias("n")).first().n or 0
    others = F.filter(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(h).alias("h")) for i, h in enumerate(held))), lambda x: x["h"] != F.col("fold"))
    long = rows.select(F.explode(others).alias("o"), "features").select("o.i", F.posexplode("features").alias("p", "v")).select((F.col("i") * width + F.col("p")).alias("g"), "v")
    out = {h: (np.zeros(width), np.ones(width)) for h in held}
    for r in _statistics(long, "g", robust).collect():
        centre, scale = out[held[r.g // width]]
        centre[r.g % width], scale[r.g % width] = r.q[1], r.q[2] - r.q[0] or 1.0
    return out


def scaling(train: DataFrame, *, robust: bool = True) -> Callable[[DataFrame], DataFrame]:
    """What centres and scales ``features`` by the median and interquartile range (or mean and population spread) of
    ``train``; only one row of statistics, as wide as the array, comes to the driver."""
    stats = _statistics(train.select(F.posexplode("features").alias("p", "v")), "p", robust)
    rows = sorted(stats.collect(), key=lambda r: r.p)
    centre = F.array(*(F.lit(float(r.q[1])) for r in rows))
    scale = F.array(*(F.lit(float(r.q[2] - r.q[0]) or 1.0) for r in rows))
    one = F.zip_with(F.zip_with("features", centre, lambda x, c: x - c), scale, lambda x, s: x / s)
    return lambda df: df.withColumn("features", one)


def scaled(train: DataFrame, *others: DataFrame, robust: bool = True) -> list[DataFrame]:
    """Tables scaled by the statistics of ``train``."""
    return list(map(scaling(train, robust=robust), (train, *others)))


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("_v", array_to_vector("features"))


def _weighted(train: DataFrame, balanced: bool) -> tuple[DataFrame, float]:
    """Class-balanced weights n / (2 * n_class), and their sum."""
    counts = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    if not balanced or len(counts) < 2:
        return train.withColumn("_w", F.lit(1.0)), float(n)
    return train.withColumn("_w", F.when(F.col("y") == 1, n / (2.0 * counts[1])).otherwise(n / (2.0 * counts[0]))), float(n)


@dataclass(frozen=True)
class Scorer:
    """A fitted model; ``score`` adds a double column ``score``."""

    model: object
    features: int

    def score(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(_vectors(df))
        return out.withColumn("score", vector_to_array("probability")[1]).select(*df.columns, "score")


Fit = Callable[[DataFrame], Scorer]

#: Types of ids that blocks of predictions can hold.
WHOLE = ("tinyint", "smallint", "int", "bigint")


def _width(df: DataFrame) -> int:
    row = df.select(F.size("features").alias("n")).first()
    return row.n if row else 0


def logistic(*, c: float = 1.0, l1_ratio: float = 0.0, balanced: bool = True, iterations: int = 200) -> Fit:
    """Logistic regression; the penalty 1 / (C * sum of weights) makes MLlib's mean loss that of C times the sum."""

    def fit(train: DataFrame) -> Scorer:
        data, total = _weighted(train, balanced)
        lr = LogisticRegression(featuresCol="_v", labelCol="y", weightCol="_w", regParam=1 / (c * total), elasticNetParam=l1_ratio, standardization=False, maxIter=iterations)
        return Scorer(lr.fit(_vectors(data)), _width(train))

    fit.together = {"c": c, "l1_ratio": l1_ratio, "balanced": balanced}  # what ``out_of_fold_sets`` fits in shared passes
    return fit


def random_forest(*, trees: int = 100, depth: int = 5, leaf: int = 8, seed: int = 42, balanced: bool = True) -> Fit:
    def fit(train: DataFrame) -> Scorer:
        data, _ = _weighted(train, balanced)
        rf = RandomForestClassifier(featuresCol="_v", labelCol="y", weightCol="_w", numTrees=trees, maxDepth=min(depth, 30), minInstancesPerNode=leaf, seed=seed)
        return Scorer(rf.fit(_vectors(data)), _width(train))

    return fit


def boosted(*, trees: int = 50, depth: int = 3, rate: float = 0.1, seed: int = 42) -> Fit:
    """Spark's gradient-boosted trees; leaf-wise ones are in ``boosters``."""

    def fit(train: DataFrame) -> Scorer:
        data, _ = _weighted(train, True)
        gbt = GBTClassifier(featuresCol="_v", labelCol="y", weightCol="_w", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
        return Scorer(gbt.fit(_vectors(data)), _width(train))

    return fit


def grow_extra_trees(x: np.ndarray, y: np.ndarray, *, trees: int, depth: int, leaf: int, seed: int, balanced: bool = True) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Trees on all rows with one random threshold for each candidate feature; balanced class weights, unless told otherwise."""
    r = np.random.default_rng(seed)
    pos = max(y.mean(), 1e-9)
    weight = np.where(y == 1, 0.5 / pos, 0.5 / max(1 - pos, 1e-9)) if balanced else np.ones(len(y))
    tried = max(1, int(np.sqrt(x.shape[1])))
    out = []
    for _ in range(trees):
        feature, threshold, value = np.full(2 ** (depth + 1), -1), np.zeros(2 ** (depth + 1)), np.zeros(2 ** (depth + 1))
        stack = [(1, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            w = weight[rows]
            value[node] = (w * y[rows]).sum() / max(w.sum(), 1e-12)
            if node >= 2**depth or len(rows) < 2 * leaf or value[node] in (0.0, 1.0):
                continue
            best = None
            for f in r.choice(x.shape[1], tried, replace=False):
                lo, hi = x[rows, f].min(), x[rows, f].max()
                if lo == hi:
                    continue
                cut = r.uniform(lo, hi)
                left = x[rows, f] <= cut
                n = left.sum()
                if n < leaf or len(rows) - n < leaf:
                    continue
                impurity = 0.0
                for side in (left, ~left):
                    ws = w[side].sum()
                    p = (w[side] * y[rows][side]).sum() / ws
                    impurity += ws * p * (1 - p)
                if best is None or impurity < best[0]:
                    best = (impurity, f, cut, left)
            if best is not None:
                _, feature[node], threshold[node], left = best
                stack += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]
        out.append((feature, threshold, value))
    return out


def reached_nodes(feature: np.ndarray, threshold: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The node without a split at which each row ends."""
    node = np.ones(len(x), int)
    while True:
        inner = feature[node] >= 0
        if not inner.any():
            return node
        go = x[np.arange(len(x)), np.maximum(feature[node], 0)] > threshold[node]
        node = np.where(inner, 2 * node + go, node)


def tree_scores(trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Mean over the trees of the value at the node that a row ends at; all trees go down a level at once."""
    feature, threshold, value = (np.concatenate(part) for part in zip(*trees))
    size = len(trees[0][0])
    begin = (np.arange(len(trees)) * size)[:, None]
    out, step = np.empty(len(x)), max(1, 1_000_000 // len(trees))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        rows, node = np.arange(len(part)), np.ones((len(trees), len(part)), int)
        while True:
            place = begin + node
            split = feature[place]
            inner = split >= 0
            if not inner.any():
                break
            node = np.where(inner, 2 * node + (part[rows, np.maximum(split, 0)] > threshold[place]), node)
        out[at : at + step] = value[place].sum(0)
    return out / len(trees)


@dataclass(frozen=True)
class TreeScorer:
    trees: object
    features: int

    def score(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.trees)

        @F.pandas_udf("double")
        def run(features: pd.Series) -> pd.Series:
            return pd.Series(tree_scores(shared.value, np.stack(features.to_numpy())) if len(features) else [], dtype=float)

        return df.withColumn("score", run("features"))


def extra_trees(*, trees: int = 100, depth: int = 5, leaf: int = 8, seed: int = 42, sample: int = 20_000, balanced: bool = True) -> Fit:
    """Extremely randomised trees, grown in parallel tasks on a training sample of at most ``sample`` rows
    (the least hashes of id), which is broadcast; growing on a bounded sample is part of the operator."""

    def fit(train: DataFrame) -> Scorer:
        rows = train.orderBy(F.xxhash64("id"), "id").limit(sample).select("features", "y").collect()
        x, y = np.array([r.features for r in rows], float), np.array([r.y for r in rows], float)
        spark = train.sparkSession
        shared = spark.sparkContext.broadcast((x, y))
        parts = min(trees, 16)

        def grow(group: pd.DataFrame) -> pd.DataFrame:
            x, y = shared.value
            made = [(int(k), *grow_extra_trees(x, y, trees=1, depth=depth, leaf=leaf, seed=seed + int(k), balanced=balanced)[0]) for k in group["k"]]
            return pd.DataFrame(made, columns=["k", "feature", "threshold", "value"])

        tasks = spark.range(trees).select(F.col("id").alias("k"), F.pmod("id", F.lit(parts)).alias("part"))
        grown = tasks.groupBy("part").applyInPandas(grow, "k long, feature array<long>, threshold array<double>, value array<double>").orderBy("k").collect()
        return TreeScorer([(np.array(r.feature), np.array(r.threshold), np.array(r.value)) for r in grown], x.shape[1])

    return fit


def random_scores(df: DataFrame, *, seed: int = 42) -> DataFrame:
    """A score in [0, 1) that depends on seed and id only."""
    return df.withColumn("score", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30)))


def prior_scores(df: DataFrame, train: DataFrame) -> DataFrame:
    return df.join(F.broadcast(train.agg(F.avg(F.col("y").cast("double")).alias("score"))))


def out_of_fold(df: DataFrame, folds: DataFrame, fit: Fit, *, fold: str = "outer_fold") -> DataFrame:
    """id, y, fold, score of every row from the model fitted on the other folds; a fold that can't be fitted or
    scored gives no rows but an error row in ``status``.  Scores are written, so that an error shows here."""
    rows = df.join(folds, "id")
    out = None
    for k in sorted(r[0] for r in folds.select(fold).distinct().collect()):
        part = rows.where(F.col(fold) == k)
        try:
            scored = written(fit(rows.where(F.col(fold) != k)).score(part).select("id", "y", fold, "score", F.lit("ok").alias("status")), "fold-scores")
        except Exception as e:
            scored = df.sparkSession.createDataFrame([(None, None, k, None, f"error: {type(e).__name__}")], f"id long, y int, {fold} int, score double, status string")
        out = scored if out is None else out.unionByName(scored)
    return out


def shared_scores(df: DataFrame, folds: DataFrame, sets: Sequence[Sequence[int]], fits: Sequence[Fit], *, fold: str = "outer_fold") -> DataFrame | None:
    """fit and set (places in ``fits`` and ``sets``), fold, id, y, score of the out-of-fold scores of all sets, written, for
    those fits whose models share their passes: logistic ones, on whole-numbered ids and folds whose other rows hold both
    classes.  Models of one weighting and scaling go together; scaled ones by the rows that they see.  None without any."""
    spark = df.sparkSession
    able = [k for k, f in enumerate(fits) if getattr(f, "together", None)]
    if not able or not sets or dict(df.dtypes)["id"] not in WHOLE:
        return None
    rows = written(df.select("id", "y", "features").join(folds.select("id", F.col(fold).alias("fold")), "id"), "set-rows")
    counts = {(r.fold, r.y): r.n for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}  # two rows a fold
    held = sorted({f for f, _ in counts})
    if len(held) < 2 or not all(any(f != h and y == v for f, y in counts) for h in held for v in (0, 1)):
        return None
    out, scalings = None, {}
    way = lambda k: (fits[k].together["balanced"], fits[k].together.get("robust"))
    for balanced, robust in dict.fromkeys(map(way, able)):  # six at most
        if robust is not None and robust not in scalings:
            scalings[robust] = held_out_scalings(rows, held, robust=robust)
        jobs = [(k, s, h) for k in able if way(k) == (balanced, robust) for s in range(len(sets)) for h in held]
        models = fit_many(rows, [LogisticTask(fits[k].together["c"], fits[k].together["l1_ratio"], h, tuple(sets[s])) for k, s, h in jobs], balanced=balanced, scalings=scalings.get(robust))
        named = spark.createDataFrame([(m, k, s) for m, (k, s, _) in enumerate(jobs)], "model int, fit int, set int")
        scores = written(held_out_scores(rows, models, scalings=scalings.get(robust)).join(F.broadcast(named), "model").select("fit", "set", "fold", "id", "y", "score"), "set-scores")  # a row a model
        out = scores if out is None else out.unionByName(scores)
    return out


def out_of_fold_sets(df: DataFrame, folds: DataFrame, sets: Sequence[Sequence[int]], fits: Sequence[Fit], *, fold: str = "outer_fold") -> dict[int, DataFrame]:
    """Place in ``fits`` -> set, id, y, score, for the fits that ``shared_scores`` knows."""
    scores = shared_scores(df, folds, sets, fits, fold=fold)
    if scores is None:
        return {}
    return {k: scores.where(F.col("fit") == k).select("set", "id", "y", "score") for k, f in enumerate(fits) if getattr(f, "together", None)}


def select_and_score(train: DataFrame, test: DataFrame, fit: Fit, *, k: int) -> DataFrame:
    """Fit on all of ``train`` and rank the best ``k`` of ``test``: rank, id, score, expected_value."""
    scored = fit(train).score(test)
    return ranked(scored.select("id", "score"), (), k).select(F.col("k").cast("long").alias("rank"), "id", "score", expected_value(F.col("score")).alias("expected_value"))


def compare(df: DataFrame, folds: DataFrame, sets: Mapping[str, Sequence[int]], fits: Mapping[str, Fit]) -> DataFrame:
    """model, feature_set, n_features and the best point of the out-of-fold curve for every model and set.

    Logistic models of all sets and folds are fitted in the same passes and judged by one grouped curve; the others go set
    by set."""
    shared = out_of_fold_sets(df, folds, list(sets.values()), list(fits.values()))
    names = df.sparkSession.createDataFrame([(s, name, len(places)) for s, (name, places) in enumerate(sets.items())], "set int, feature_set string, n_features int")
    out = None

    def add(row: DataFrame) -> None:
        nonlocal out
        out = row if out is None else out.unionByName(row)

    for f, (model, fit) in enumerate(fits.items()):
        if f in shared:
            point = best_point(profit_curve(shared[f], ["set"], features=0, zero=True), ["set"]).join(F.broadcast(names), "set")
            add(point.select(F.lit(model).alias("model"), "feature_set", "n_features", "k", (F.col("business_score") - F.col("n_features") * FEATURE_COST).alias("score")))
            continue
        for name, places in sets.items():
            narrow = df.withColumn("features", F.array(*(F.col("features")[p] for p in places)))
            scores = out_of_fold(narrow, folds, fit).where("status = 'ok'")
            point = best_point(profit_curve(scores, features=len(places), zero=True))
            add(point.select(F.lit(model).alias("model"), F.lit(name).alias("feature_set"), F.lit(len(places)).alias("n_features"), "k", F.col("business_score").alias("score")))
    return out


def drop_column_ranking(df: DataFrame, folds: DataFrame, fit: Fit, width: int) -> DataFrame:
    """feature, delta: the best score without a feature less that with all, which includes the saved price; ascending."""
    every = compare(df, folds, {"all": range(width)}, {"m": fit}).select(F.col("score").alias("all_score"))
    without = compare(df, folds, {f"var_{k}": [p for p in range(width) if p != k] for k in range(width)}, {"m": fit})
    return without.join(F.broadcast(every)).select(F.col("feature_set").alias("feature"), (F.col("score") - F.col("all_score")).alias("delta")).orderBy("delta", "feature")


def grid_search(df: DataFrame, folds: DataFrame, make: Callable[..., Fit], grid: Sequence[Mapping], *, features: int) -> DataFrame:
    """params (JSON), k, score of each point of a grid, best first."""
    import json

    fits = {json.dumps(dict(p), sort_keys=True): make(**p) for p in grid}
    return compare(df, folds, {"all": range(features)}, fits).select(F.col("model").alias("params"), "k", "score").orderBy(F.desc("score"), "params")


def per_cluster_scores(train: DataFrame, test: DataFrame, fit: Fit, fallback: Fit, *, least: int = 80) -> DataFrame:
    """``test`` with ``score`` from the model of its cluster; clusters with few training rows use one for all rows."""
    counts = train.groupBy("cluster").agg(F.count("*").alias("n"), F.count_distinct("y").alias("c")).collect()
    big = sorted(r.cluster for r in counts if r.n >= least and r.c > 1)
    out = fallback(train).score(test.where(~F.col("cluster").isin(*big)) if big else test)
    for c in big:
        out = out.unionByName(fit(train.where(F.col("cluster") == c)).score(test.where(F.col("cluster") == c)))
    return out


def principal_components(train: DataFrame, k: int) -> DataFrame:
    return PCA(k=k, inputCol="_v", outputCol="_c").fit(_vectors(train)).transform(_vectors(train)).select(*(c for c in train.columns if c != "features"), vector_to_array("_c").alias("features"))


def pair_differences(df: DataFrame, *, pairs: int = 20_000, seed: int = 42) -> DataFrame:
    """id, y, features: differences of sampled (positive, negative) pairs, and their opposites with label 0.

    min(pairs, positives * negatives) pairs are drawn with replacement by hash; rows are numbered by rank of hash
    among the at most ``pairs`` rows of each class that can be drawn.
    """
    order = [F.xxhash64(F.lit(seed), "id"), F.col("id")]
    side = lambda y: df.where(F.col("y") == y).orderBy(*order).limit(pairs).withColumn("r", F.row_number().over(Window.orderBy(*order)) - 1)
    pos, neg = side(1), side(0)
    n_pos, n_neg = pos.count(), neg.count()
    n = min(pairs, n_pos * n_neg)
    if not n:
        return df.limit(0).select("id", "y", "features")
    draw = df.sparkSession.range(n).select(F.col("id").alias("pair"), F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(n_pos)).alias("rp"), F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(n_neg)).alias("rn"))
    joined = draw.join(pos.select(F.col("r").alias("rp"), F.col("features").alias("a")), "rp").join(neg.select(F.col("r").alias("rn"), F.col("features").alias("b")), "rn")
    both = F.array(*(F.struct((2 * F.col("pair") + k).alias("id"), F.lit(1 - k).alias("y"), F.zip_with("a" if k == 0 else "b", "b" if k == 0 else "a", lambda x, z: x - z).alias("features")) for k in (0, 1)))
    return joined.select(F.explode(both).alias("p")).select("p.*")


def pairwise_ranker(*, c: float = 0.1, pairs: int = 20_000, seed: int = 42) -> Fit:
    """An L1 logistic model of pair differences; rows are scored by its linear part."""

    @dataclass(frozen=True)
    class Linear:
        weights: list
        features: int

        def score(self, df: DataFrame) -> DataFrame:
            products = F.zip_with("features", F.array(*map(F.lit, self.weights)), lambda x, w: x * w)
            return df.withColumn("score", F.aggregate(products, F.lit(0.0), lambda a, x: a + x))

    def fit(train: DataFrame):
        fitted = logistic(c=c, l1_ratio=1.0, balanced=False)(pair_differences(train, pairs=pairs, seed=seed))
        return Linear([float(w) for w in fitted.model.coefficients], fitted.features)

    return fit


def l1_feature_scores(df: DataFrame, *, cs: Sequence[float] = (0.02, 0.05, 0.1, 0.5, 1.0)) -> list[float]:
    """Absolute coefficients of the first penalty that leaves any feature in."""
    for c in cs:
        found = np.abs(np.array(logistic(c=c, l1_ratio=1.0)(df).model.coefficients))
        if (found > 1e-12).any():
            break
    return found.tolist()


def spline_feature_scores(df: DataFrame, *, knots: int = 4, cs: Sequence[float] = (0.01, 0.03, 0.1, 0.3)) -> list[float]:
    """Sparse additive scores: cubic splines of each feature, an L1 model, absolute coefficients summed by feature."""
    width = _width(df)
    ends = df.select(F.posexplode("features").alias("p", "v")).groupBy("p").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("p").collect()
    grids = [np.linspace(r.a, r.b if r.b > r.a else r.a + 1, knots) for r in ends]

    @F.pandas_udf("array<double>")
    def expand(features: pd.Series) -> pd.Series:
        x = np.stack(features.to_numpy())
        return pd.Series(list(np.concatenate([spline_basis(x[:, k], g) for k, g in enumerate(grids)], 1)))

    wide, *_ = scaled(df.withColumn("features", expand("features")), robust=False)
    return collapse_basis(np.array(l1_feature_scores(wide, cs=cs)), width).tolist()


def forest_feature_scores(df: DataFrame, fit: Fit | None = None) -> list[float]:
    return [float(v) for v in (fit or boosted(trees=20))(df).model.featureImportances.toArray()]


def with_mixed(df: DataFrame, width: int, *, seed: int = 42) -> DataFrame:
    """``df`` (written) with ``mixed``, its features with every column permuted among all rows on its own."""
    numbered = written(placed(df, [], [F.col("id")], name="_r").withColumn("place", F.col("_r") - 1).drop("_r"), "permutation-rows")
    mixed = permuted_columns(numbered.select("place", "features"), numbered.count(), width, seed)
    return written(numbered.join(mixed, "place").drop("place"), "permutation-mixed")


def permutation_ranking(df: DataFrame, scorer: Scorer, metric: Callable[[DataFrame], float], width: int, *, seed: int = 42) -> list[float]:
    """Loss of ``metric`` when one feature's values are dealt out anew among all rows.  All columns are permuted in one
    pass; after that each feature costs a scoring of the table."""
    both = with_mixed(df, width, seed=seed)
    base = metric(scorer.score(both.drop("mixed")))
    out = []
    for k in range(width):
        new = F.transform("features", lambda x, i: F.when(i == k, F.get("mixed", F.lit(k))).otherwise(x))
        out.append(base - metric(scorer.score(both.withColumn("features", new).drop("mixed"))))
    return out


def committee(df: DataFrame, folds: DataFrame, experts: Mapping[str, tuple[Fit, Sequence[int]]]) -> DataFrame:
    """Out-of-fold scores of experts on their own features, fused by their best scores as weights."""
    means, rows = [], None
    for name, (fit, places) in experts.items():
        scores = out_of_fold(df.withColumn("features", F.array(*(F.col("features")[p] for p in places))), folds, fit).where("status = 'ok'")
        means.append((name, float(best_point(profit_curve(scores, features=len(places), zero=True)).first().business_score)))
        part = scores.select(F.lit(name).alias("expert"), "id", "score")
        rows = part if rows is None else rows.unionByName(part)
    weights = fusion_weights(df.sparkSession.createDataFrame(means, "expert string, cv_mean double"))
    return fused_scores(rows, weights)


def _tallies(df: DataFrame, jobs: list, grown: dict, asked: list[tuple]) -> dict[int, tuple]:
    """n, positives, least and greatest value of what each of ``asked`` (job, tree, node, place, cut) sees of all training
    rows: those in the node whose value is at most the cut, if there is one.  Tasks add up first, so a row each is moved."""
    by_tree: dict[tuple, list] = {}
    for k, (j, t, *rest) in enumerate(asked):
        by_tree.setdefault((j, t), []).append((k, *rest))

    def run(batches):
        n, pos = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        lo, hi = np.full(len(asked), np.inf), np.full(len(asked), -np.inf)
        for batch in batches:
            if not len(batch):
                continue
            x, y, fold = np.stack(batch["features"].to_numpy()).astype(float), batch["y"].to_numpy(), batch["fold"].to_numpy()
            for j, (_, own, places) in enumerate(jobs):
                rest = fold != own
                xs, ys = x[rest][:, places], y[rest] == 1
                for t in sorted(t for i, t in by_tree if i == j):
                    # Rows by node, so that what is asked of a node looks at its own rows only.
                    at = reached_nodes(*grown[j, t][:2], xs)
                    order = np.argsort(at, kind="stable")
                    nodes, begins = np.unique(at[order], return_index=True)
                    rows_of = dict(zip(nodes.tolist(), np.split(order, begins[1:])))
                    for k, node, place, cut in by_tree[j, t]:
                        rows = rows_of.get(node)
                        if rows is None:
                            continue
                        v, hit = xs[rows, place], ys[rows]
                        if cut is not None:
                            under = v <= cut
                            v, hit = v[under], hit[under]
                        if len(v):
                            n[k], pos[k], lo[k], hi[k] = n[k] + len(v), pos[k] + hit.sum(), min(lo[k], v.min()), max(hi[k], v.max())
        yield pd.DataFrame({"k": np.arange(len(asked)), "n": n, "pos": pos, "lo": lo, "hi": hi})

    parts = df.select("y", "fold", "features").mapInPandas(run, "k long, n long, pos long, lo double, hi double")
    return {r.k: (r.n, r.pos, r.lo, r.hi) for r in parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}


def grow_spread_trees(df: DataFrame, jobs: list[tuple[int, int, list[int]]], *, trees: int, depth: int, leaf: int) -> dict:
    """(job, tree) -> feature, threshold, value: the trees of ``grow_extra_trees`` on all training rows of each job
    (seed, own fold, places), grown level by level for all jobs at once, with draws that hang on seed, tree and node.

    What comes to the driver are counts and ranges of nodes, whatever the number of rows."""
    grown = {(j, t): (np.full(2 ** (depth + 1), -1), np.zeros(2 ** (depth + 1)), np.zeros(2 ** (depth + 1))) for j in range(len(jobs)) for t in range(trees)}
    known: dict[tuple, tuple] = {}
    share: dict[int, float] = {}
    weighed = lambda j, n, pos: (0.5 / share[j] * pos, 0.5 / max(1 - share[j], 1e-9) * (n - pos))

    def settle(j, t, node, n, pos):
        known[j, t, node] = n, pos
        one, zero = weighed(j, n, pos)
        grown[j, t][2][node] = one / max(one + zero, 1e-12)

    frontier = [(j, t, 1) for j, t in grown]
    for level in range(depth):
        draws, asked = {}, []
        for j, t, node in frontier:
            draws[j, t, node] = r = np.random.default_rng([jobs[j][0], t, node])
            width = len(jobs[j][2])
            asked += [(j, t, node, int(f), None) for f in r.choice(width, max(1, int(np.sqrt(width))), replace=False)]
        found = _tallies(df, jobs, grown, asked) if asked else {}
        cuts = []
        for k, (j, t, node, f, _) in enumerate(asked):
            n, pos, lo, hi = found.get(k, (0, 0, np.inf, -np.inf))
            if not level:
                share[j] = max(pos / n, 1e-9) if n else 1e-9
                settle(j, t, node, n, pos)
            if n >= 2 * leaf and 0 < pos < n and lo < hi:
                cuts.append((j, t, node, f, float(draws[j, t, node].uniform(lo, hi))))
        left, best = _tallies(df, jobs, grown, cuts) if cuts else {}, {}
        for k, (j, t, node, f, cut) in enumerate(cuts):
            n, pos = known[j, t, node]
            n_left, pos_left = left[k][:2]
            if n_left < leaf or n - n_left < leaf:
                continue
            sides = weighed(j, n_left, pos_left), weighed(j, n - n_left, pos - pos_left)
            impurity = sum(one * zero / (one + zero) for one, zero in sides)
            if (j, t, node) not in best or impurity < best[j, t, node][0]:
                best[j, t, node] = impurity, f, cut, n_left, pos_left
        frontier = []
        for (j, t, node), (_, f, cut, n_left, pos_left) in best.items():
            n, pos = known[j, t, node]
            grown[j, t][0][node], grown[j, t][1][node] = f, cut
            for child, m, p in ((2 * node, n_left, pos_left), (2 * node + 1, n - n_left, pos - pos_left)):
                settle(j, t, child, m, p)
                if m >= 2 * leaf and 0 < p < m:
                    frontier.append((j, t, child))
    return grown


_BLOCKS = "task_id long, fold int, block array<struct<sample_index: long, y_true: int, score: double>>, status string, error string"


def evaluate_tasks(df: DataFrame, tasks: DataFrame, *, trees: int = 30, depth: int = 4) -> DataFrame:
    """Fan-out of many small fits: each task (task_id, fold, places) is fitted on the rows of the other folds and scores
    its own; a fit that fails becomes a row with its error.

    The table stays where it is: the trees of all tasks are grown level by level from counts over all rows, and a task
    has a block for each batch of its rows.  A task whose fold has no rows has one empty block; an empty table gives an error row a task."""
    spark = df.sparkSession
    df = written(df.select("id", "y", "fold", "features"), "fan-out")
    first = df.first()
    sample = np.array([first.features if first else []], float)
    folds = {r.fold for r in df.select("fold").distinct().collect()}
    jobs, rest = [], []
    for r in tasks.orderBy("task_id", "fold").collect():
        try:
            if not sample[:, list(r.places)].shape[1]:
                raise ValueError("a task without features")
            jobs.append((int(r.task_id), r.fold, list(r.places)))
            if r.fold not in folds:
                rest.append((r.task_id, r.fold, [], "ok", None))
        except Exception as e:
            rest.append((r.task_id, r.fold, [], "error", f"{type(e).__name__}: {e}"))
    grown = grow_spread_trees(df, jobs, trees=trees, depth=depth, leaf=8)
    shared = spark.sparkContext.broadcast([(job, [grown[j, t] for t in range(trees)]) for j, job in enumerate(jobs)])

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, fold = np.stack(batch["features"].to_numpy()).astype(float), batch["fold"].to_numpy()
            for (task, own, places), forest in shared.value:
                if (mine := fold == own).any():
                    scores = tree_scores(forest, x[mine][:, places])
                    block = [{"sample_index": int(i), "y_true": int(v), "score": float(s)} for i, v, s in zip(batch["id"][mine], batch["y"][mine], scores)]
                    yield pd.DataFrame([(task, own, block, "ok", None)], columns=["task_id", "fold", "block", "status", "error"])

    return df.mapInPandas(run, _BLOCKS).unionByName(spark.createDataFrame(rest, _BLOCKS))


def class_weight_of(df: DataFrame) -> float:
    return class_weight(df).first().scale_pos_weight
