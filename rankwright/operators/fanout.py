"""Many candidates fitted and scored as rows of a task table.

A task is a feature set, a model family with its parameters, and a fold of a split.
All fits are one job: each task row is fitted where it lies, on a labelled sample that
is broadcast or on all rows outside its fold, which one shuffle deals out to the tasks;
a fit that fails becomes an error.  Scoring is one narrow pass over all rows for each
pack of models of a bounded size, so the number of jobs follows the bytes of the models
and not the number of tasks.
"""

from __future__ import annotations

import json
import pickle
import time
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import broadcast_if_small, shared_folder, written
from .boosters import SAMPLE, fit_additive, fit_lambdamart, fit_leafwise
from .models import grow_extra_trees, tree_scores
from .paths import as_matrix, descend

TASKS = "task_id long, split int, fold int, family string, params string, places array<int>"
MODELS = "task_id long, split int, fold int, places array<int>, model binary, error string, fit_seconds double"
BLOCKS = "task_id long, split int, fold int, block array<struct<sample_index: long, y_true: int, score: double>>, status string, error string, fit_seconds double"
#: Bytes of models that one scoring pass broadcasts, and of the sample that the fits are handed.
PACK, MOST_SAMPLE = 64 << 20, 1 << 30


class Logistic:
    """Logistic regression of features centred and scaled by median and interquartile range (mean and spread where that is 0)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, c: float, l1_ratio: float, balanced: bool, steps: int = 60):
        low, self.centre, high = np.quantile(x, (0.25, 0.5, 0.75), axis=0)
        self.scale = np.where(high > low, high - low, 1.0)
        z = np.column_stack([np.ones(len(x)), (x - self.centre) / self.scale])
        pos = y.sum()
        weight = np.where(y == 1, len(y) / (2 * pos), len(y) / (2 * (len(y) - pos))) if balanced and 0 < pos < len(y) else np.ones(len(y))
        paid = np.ones(z.shape[1])
        paid[0] = 0.0
        ridge, l1 = (1 - l1_ratio) * paid, l1_ratio * paid
        objective = lambda b: c * (weight * (np.logaddexp(0, z @ b) - y * (z @ b))).sum() + (ridge * b * b).sum() / 2 + (l1 * np.abs(b)).sum()
        beta = np.zeros(z.shape[1])
        value = objective(beta)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -500, 500)))
            g = c * z.T @ (weight * (p - y)) + ridge * beta
            h = c * (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
            new = descend(h[None], g[None], beta[None], l1[None])[0]
            while (after := objective(new)) > value + 1e-12 * abs(value) and np.abs(new - beta).max() > 1e-12:
                new = (beta + new) / 2
            moved, beta, value = np.abs(new - beta).max(), new, after
            if moved < 1e-8:
                break
        self.beta = beta

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.beta[0] + (x - self.centre) / self.scale @ self.beta[1:], -500, 500)))


class Forest:
    """Extremely randomised trees, on all rows or each on rows drawn with replacement."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, trees: int, depth: int | None, leaf: int, drawn: bool, seed: int, balanced: bool = True):
        r = np.random.default_rng(seed)
        deep = depth or max(1, int(np.log2(max(2, len(x) / max(1, leaf)))) + 2)
        self.trees = []
        for k in range(trees):
            rows = r.integers(0, len(x), len(x)) if drawn else slice(None)
            self.trees += grow_extra_trees(x[rows], y[rows], trees=1, depth=min(deep, 14), leaf=leaf, seed=seed + k, balanced=balanced)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return tree_scores(self.trees, x)


def boosting_ways(params: Mapping, *, levels: bool) -> dict:
    """Parameters of leaf-wise (or, with ``levels``, level-wise) boosting under the names that ``fit_leafwise`` has."""
    known = {
        "n_estimators": "trees", "learning_rate": "rate", "num_leaves": "leaves", "max_depth": "depth", "min_child_samples": "leaf", "min_child_weight": "least", "subsample": "row_share", "colsample_bytree": "column_share",
        "scale_pos_weight_multiplier": "multiplier", "reg_lambda": "ridge", "random_state": "seed",
    }
    if other := sorted(set(params) - set(known)):
        raise ValueError(f"unknown parameters: {', '.join(other)}")
    ways = {known[k]: v for k, v in params.items()}
    if ways.get("depth", 1) is None or ways.get("depth", 1) < 0:
        del ways["depth"]
    if levels:
        depth = ways.setdefault("depth", 4)
        ways = {"rate": 0.05, "trees": 200, "leaf": 1, "leaves": 2**depth, **ways}
    return ways


def forest_ways(params: Mapping) -> dict:
    if other := sorted(set(params) - {"n_estimators", "max_depth", "min_samples_leaf", "class_weight", "random_state"}):
        raise ValueError(f"unknown parameters: {', '.join(other)}")
    return {"trees": params.get("n_estimators", 100), "depth": params.get("max_depth", 5), "leaf": params.get("min_samples_leaf", 8), "seed": params.get("random_state", 42), "balanced": params.get("class_weight", "balanced") is not None}


def _renamed(params: Mapping, names: Mapping[str, str], fixed: Mapping | None = None) -> dict:
    """Parameters under their names here; those that are ``fixed`` have one value, and any other is refused."""
    for name, value in (fixed or {}).items():
        if params.get(name, value) != value:
            raise ValueError(f"{name} can only be {value}")
    if other := sorted(set(params) - set(names) - set(fixed or {})):
        raise ValueError(f"unknown parameters: {', '.join(other)}")
    return {names[k]: v for k, v in params.items() if k in names}


def additive_ways(params: Mapping) -> dict:
    return _renamed(params, {"max_bins": "bins", "max_rounds": "rounds", "learning_rate": "rate"}, fixed={"interactions": 0, "outer_bags": 1})


def ranker_ways(params: Mapping) -> dict:
    return _renamed(params, {"n_estimators": "trees", "learning_rate": "rate", "num_leaves": "leaves"})


#: family -> what fits a model with ``predict`` on features and labels.
FAMILIES: dict[str, Callable[[np.ndarray, np.ndarray, Mapping], object]] = {
    "logistic": lambda x, y, p: Logistic(x, y, c=p.get("C", 1.0), l1_ratio=p.get("l1_ratio", 0.5), balanced=p.get("class_weight", "balanced") is not None),
    "extra_trees": lambda x, y, p: Forest(x, y, drawn=False, **forest_ways(p)),
    "random_forest": lambda x, y, p: Forest(x, y, drawn=True, **forest_ways(p)),
    "lightgbm": lambda x, y, p: fit_leafwise(x, y, **boosting_ways(p, levels=False)),
    "xgboost": lambda x, y, p: fit_leafwise(x, y, **boosting_ways(p, levels=True)),
    "additive": lambda x, y, p: fit_additive(x, y, **additive_ways(p)),
    "ranker": lambda x, y, p: fit_lambdamart(x, y, **ranker_ways(p)),
}


def plain_split(folds: DataFrame, fold: str = "outer_fold") -> DataFrame:
    """Memberships (split 0, id, fold) of folds that cover the whole table."""
    return folds.select(F.lit(0).alias("split"), "id", F.col(fold).cast("int").alias("fold"))


def _fitted(task, training: Callable[[], tuple[np.ndarray, np.ndarray]], families: Mapping[str, Callable]) -> tuple:
    """The row of ``MODELS`` of a task whose features and labels ``training`` gives."""
    began, model, error = time.perf_counter(), None, None
    try:
        if task.places is None or not len(task.places):
            raise ValueError("a task without features")
        x, y = training()
        if len(set(y.tolist())) < 2:
            raise ValueError("no training rows of both classes")
        model = pickle.dumps(families[task.family](x[:, list(task.places)], y, json.loads(task.params or "{}")))
    except Exception as e:
        error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return task.task_id, task.split, task.fold, task.places, model, error, time.perf_counter() - began


def _fits_of_sample(df: DataFrame, members: DataFrame, tasks: DataFrame, sample: int, families: Mapping[str, Callable]) -> DataFrame:
    """``MODELS`` of fits that see the ``sample`` labelled rows with the least hash of the id, which every task is handed."""
    spark = df.sparkSession
    picked = df.where("y IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "y", "features")
    rows = picked.collect()  # bounded by ``sample``
    width = max((len(r.features or ()) for r in rows), default=0)
    if len(rows) * width * 8 > MOST_SAMPLE:
        raise ValueError(f"a sample of {len(rows)} rows with {width} features is too large to be handed to every task; give a smaller one")
    x = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        own = r.features or ()
        x[k, : len(own)] = [0.0 if v is None else v for v in own]
    x, y, place = np.nan_to_num(x), np.array([r.y for r in rows], float), {r.id: k for k, r in enumerate(rows)}
    known = spark.createDataFrame([(k,) for k in place], "id long")
    parts: dict[int, np.ndarray] = {}
    for m in members.join(F.broadcast(known), "id").select("split", "fold", "id").collect():  # ``sample`` rows a split
        parts.setdefault(m.split, np.full(len(rows), -1))[place[m.id]] = m.fold
    shared = spark.sparkContext.broadcast((x, y, parts))

    def fit(batches):
        x, y, parts = shared.value
        for batch in batches:
            out = []
            for t in batch.itertuples(index=False):
                at = parts.get(t.split, np.full(len(y), -1))
                train = (at >= 0) & (at != t.fold)
                out.append(_fitted(t, lambda: (x[train], y[train]), families))
            if out:
                yield pd.DataFrame(out, columns=["task_id", "split", "fold", "places", "model", "error", "fit_seconds"])

    # By ranges of the hash a fit is a Spark task of its own, up to that many: a few long ones don't wait for each other.
    apart = max(1, min(tasks.count(), 32 * spark.sparkContext.defaultParallelism))
    spread = tasks.select("task_id", "split", "fold", "family", "params", "places").repartitionByRange(apart, F.xxhash64("task_id"))
    return spread.mapInPandas(fit, MODELS)


def _fits_of_all(rows: DataFrame, tasks: DataFrame, families: Mapping[str, Callable]) -> DataFrame:
    """``MODELS`` of fits that see every labelled row of their split outside their fold (``rows``: id, y, features, split, fold).

    A fit is a Spark task of its own, and the rows that it needs are dealt out to it, in the order of the hash of the id."""
    spark = rows.sparkSession
    listed = tasks.select("task_id", "split", "fold", "family", "params", "places").collect()  # a row a task
    width = rows.agg(F.max(F.size("features")).alias("n")).first().n or 0
    jobs = spark.createDataFrame([(k, *r) for k, r in enumerate(listed)], f"place int, {TASKS}")
    each = F.broadcast(jobs.select("place", "split", F.col("fold").alias("held")))
    dealt = rows.where("y IS NOT NULL").join(each, "split").where("fold <> held").select("place", F.xxhash64("id").alias("hash"), F.col("id").cast("long").alias("id"), F.col("y").cast("double").alias("y"), "features")
    both = jobs.unionByName(dealt, allowMissingColumns=True).repartitionById(max(1, len(listed)), F.col("place"))

    def fit(batches):
        asked, parts = {}, {}
        for batch in batches:
            wanted = pc.is_valid(batch.column("task_id"))
            for t in pd.DataFrame(batch.filter(wanted).to_pylist()).astype(object).itertuples(index=False):
                asked[t.place] = t
            batch = batch.filter(pc.invert(wanted))
            for place in pc.unique(batch.column("place")).to_pylist():
                own = batch.filter(pc.equal(batch.column("place"), place))
                parts.setdefault(place, []).append((*(own.column(c).to_numpy() for c in ("hash", "id", "y")), as_matrix(own.column("features"), width)))

        def training(place):
            if place not in parts:
                return np.zeros((0, width)), np.zeros(0)
            hashes, ids, y, x = (np.concatenate(c) for c in zip(*parts.pop(place)))
            order = np.lexsort((ids, hashes))
            return x[order], y[order]

        for place, t in asked.items():
            row = _fitted(t, lambda: training(place), families)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.string(), pa.float64()))], names=["task_id", "split", "fold", "places", "model", "error", "fit_seconds"])

    return both.mapInArrow(fit, MODELS)


def fan_out(df: DataFrame, members: DataFrame, tasks: DataFrame, *, sample: int | None = SAMPLE, families: Mapping[str, Callable] = FAMILIES) -> DataFrame:
    """Blocks of predictions (``BLOCKS``) of every task: fitted on the rows of its split (``members``: split, id, fold) outside
    its fold, scored on those inside it.

    Fits see at most ``sample`` labelled rows of the table, those with the least hash of the id, or all of them if it is
    None (ids are whole numbers then); scoring sees all rows.  A task has a block for each batch of its rows, an empty one
    if it has none; one that fails has one row with its error.  ``fit_seconds`` is what its fit took.  Null features count
    as 0; an empty table gives an error for each task.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "fan-out-rows")
    joined = df.select("id", "y", "features").join(members.select("split", "id", "fold"), "id")
    joined.write.partitionBy("split", "fold").parquet(folder)
    cut = spark.read.schema("id long, y int, features array<double>, split int, fold int").parquet(folder)
    models = written(_fits_of_all(cut, tasks, families) if sample is None else _fits_of_sample(df, members, tasks, sample, families), "fan-out-models")
    # In the order of their folds, so that a pack meets few of them.  A row a task.
    sizes = models.where("model IS NOT NULL").select("split", "fold", "task_id", F.length("model").alias("n")).orderBy("split", "fold", "task_id").collect()
    packs, full = [], PACK
    for r in sizes:
        if full + r.n > PACK:
            packs.append([])
            full = 0
        packs[-1].append(r)
        full += r.n
    blocks = shared_folder(spark, "fan-out-blocks")
    for k, pack in enumerate(packs):
        _score_pack(cut, models, pack).write.parquet(f"{blocks}/pack={k}")
    failed = models.select("task_id", "split", "fold", F.array().cast("array<struct<sample_index: long, y_true: int, score: double>>").alias("block"), F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "error", "fit_seconds")
    if not packs:
        return failed
    found = spark.read.schema(BLOCKS).parquet(blocks).select(*(c.split()[0] for c in BLOCKS.replace("<sample_index: long, y_true: int, score: double>", "").split(", ")))
    scored = found.select("task_id").distinct()
    return found.unionByName(failed.join(broadcast_if_small(scored, len(sizes), 64), "task_id", "left_anti"))


def _score_pack(rows: DataFrame, models: DataFrame, pack: Sequence) -> DataFrame:
    """Blocks of the tasks of one pack, whose models are broadcast."""
    spark = rows.sparkSession
    at = sorted({(r.split, r.fold) for r in pack})
    ids = spark.createDataFrame([(r.task_id,) for r in pack], "task_id long")
    by_fold: dict[tuple, list] = {}
    for m in models.join(F.broadcast(ids), "task_id", "left_semi").where("model IS NOT NULL").collect():
        by_fold.setdefault((m.split, m.fold), []).append((m.task_id, list(m.places), bytes(m.model), m.fit_seconds))
    shared = spark.sparkContext.broadcast(by_fold)

    def run(batches):
        for batch in batches:
            for (split, fold), part in batch.groupby(["split", "fold"]):
                raw = part["features"].to_numpy()
                width = max((len(v) for v in raw if v is not None), default=0)
                x = np.zeros((len(raw), width))
                for k, v in enumerate(raw):
                    if v is not None:
                        x[k, : len(v)] = v
                x = np.nan_to_num(x)
                ids, labels = part["id"].tolist(), part["y"].tolist()
                for task, places, model, seconds in shared.value.get((split, fold), ()):
                    scores = pickle.loads(model).predict(x[:, places]).tolist()
                    block = [{"sample_index": int(i), "y_true": None if v != v else int(v), "score": s} for i, v, s in zip(ids, labels, scores)]
                    yield pd.DataFrame([(task, split, fold, block, "ok", None, seconds)], columns=["task_id", "split", "fold", "block", "status", "error", "fit_seconds"])

    wanted = spark.createDataFrame(at, "split int, fold int")
    return rows.join(F.broadcast(wanted), ["split", "fold"], "left_semi").mapInPandas(run, BLOCKS)


def predictions_of(blocks: DataFrame) -> DataFrame:
    """task_id, sample_index, y_true, score, status: a row a prediction, and one without a sample for each error."""
    good = blocks.where("status = 'ok'").select("task_id", F.explode("block").alias("b"), "status").select("task_id", "b.*", "status")
    bad = blocks.where("status <> 'ok'").select("task_id", F.lit(None).cast("long").alias("sample_index"), F.lit(None).cast("int").alias("y_true"), F.lit(None).cast("double").alias("score"), F.concat(F.lit("error: "), F.coalesce("error", F.lit(""))).alias("status"))
    return good.unionByName(bad)
