"""Many logistic models fitted together, in one pass over the rows for each step of all of them.

A model is a penalty, a set of features and the fold whose rows it doesn't see.  In a
pass every task adds up, for each model that isn't done, the loss, gradient and
curvature of its own rows; the sums of a model meet in one task, which solves the
penalised quadratic by coordinate descent and hands back the next coefficients.  So a
path of 50 penalties over five folds takes as many passes as its slowest model takes
Newton steps, and what moves is a row a model and task, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written

#: Numbers that a task holds for the models of a pass; more models than fit go in further passes.
CELLS = 4_000_000


@dataclass(frozen=True)
class LogisticTask:
    """``c`` times the summed loss, plus the penalty, of the features at ``places`` (all if none) on the rows outside
    ``held_out`` (all rows if None)."""

    c: float
    l1_ratio: float = 1.0
    held_out: int | None = None
    places: tuple[int, ...] | None = None


@dataclass
class LogisticFit:
    """Coefficients of the task's features and the intercept; ``steps`` is the number of passes it took part in."""

    task: LogisticTask
    intercept: float = 0.0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(0))
    steps: int = 0
    converged: bool = False


def descend(h: np.ndarray, g: np.ndarray, beta: np.ndarray, l1: np.ndarray, *, sweeps: int = 500) -> np.ndarray:
    """The least of g'd + d'hd / 2 + sum l1 |b|, b = beta + d, by coordinate descent; models [model, place] side by side."""
    b = beta.copy()
    slope = g.copy()  # of the smooth part at b
    diagonal = np.maximum(np.einsum("mii->mi", h), 1e-12)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(b.shape[1]):
            aim = b[:, j] - slope[:, j] / diagonal[:, j]
            new = np.sign(aim) * np.maximum(np.abs(aim) - l1[:, j] / diagonal[:, j], 0.0)
            step = new - b[:, j]
            if step.any():
                slope += h[:, j] * step[:, None]
                b[:, j] = new
                moved = max(moved, float(np.abs(step * np.sqrt(diagonal[:, j])).max()))
        if moved < 1e-10:
            break
    return b


def _class_weights(df: DataFrame, fold: str, balanced: bool) -> dict[int | None, tuple[float, float]]:
    """held-out fold (or None) -> weights of negatives and positives among the rows outside it."""
    counts = {(r.f, r.y): r.n for r in df.groupBy(F.col(fold).alias("f"), "y").agg(F.count("*").alias("n")).collect()}  # two rows a fold
    out: dict[int | None, tuple[float, float]] = {}
    for held in {None, *(f for f, _ in counts)}:
        sides = [sum(n for (f, y), n in counts.items() if (held is None or f != held) and y == v) for v in (0, 1)]
        out[held] = tuple(sum(sides) / (2.0 * n) for n in sides) if balanced and all(sides) else (1.0, 1.0)
    return out


def fit_many(
    df: DataFrame, tasks: Sequence[LogisticTask], *, fold: str = "fold", balanced: bool = True, penalise_intercept: bool = False, scalings: Mapping[int | None, tuple[np.ndarray, np.ndarray]] | None = None, steps: int = 60, tolerance: float = 1e-8
) -> list[LogisticFit]:
    """The models of all ``tasks`` on ``df`` (id, y, features, fold), in their order.

    Steps are proximal Newton ones; one that raises a model's objective is halved.  ``scalings`` gives the centre and
    scale of the features by held-out fold, so that each model can be scaled by its own rows.  Null or missing features
    count as 0, rows without a label are left out; without rows all coefficients are 0.
    """
    spark = df.sparkSession
    rows = written(df.where("y IS NOT NULL").select(F.col("y").cast("double").alias("y"), F.col(fold).cast("int").alias("f"), F.transform("features", lambda v: v.cast("double")).alias("v")), "logistic-rows")
    width = rows.agg(F.max(F.size("v")).alias("n")).first().n or 0
    weights = _class_weights(rows, "f", balanced)
    fits = [LogisticFit(t, 0.0, np.zeros(len(t.places) if t.places is not None else width)) for t in tasks]
    if not width:
        return fits
    group: list[int] = []
    size = 0
    for k, f in enumerate(fits):
        cells = (len(f.coefficients) + 1) * (len(f.coefficients) + 4) // 2
        if group and size + cells > CELLS:
            _fit_group(rows, [fits[g] for g in group], width, weights, penalise_intercept, scalings, steps, tolerance)
            group, size = [], 0
        group.append(k)
        size += cells
    if group:
        _fit_group(rows, [fits[g] for g in group], width, weights, penalise_intercept, scalings, steps, tolerance)
    return fits


def _fit_group(rows: DataFrame, fits: list[LogisticFit], width: int, weights: Mapping, penalise_intercept: bool, scalings: Mapping | None, steps: int, tolerance: float) -> None:
    """Newton steps of some models together; each goes on until it stands still."""
    spark = rows.sparkSession
    parts = max(1, min(len(fits), spark.sparkContext.defaultParallelism))
    # Of each model: the point that was good last, its objective, and the point tried now.
    good = [np.zeros(len(f.coefficients) + 1) for f in fits]
    tried = [g.copy() for g in good]
    value = [np.inf] * len(fits)
    ahead: list[np.ndarray | None] = [None] * len(fits)
    live = list(range(len(fits)))
    for _ in range(steps):
        found = _step(rows, [(k, fits[k].task, tried[k]) for k in live], width, weights, penalise_intercept, scalings, parts)
        still = []
        for k in live:
            fits[k].steps += 1
            if k not in found:  # no rows at all
                fits[k].converged = True
                continue
            objective, new = found[k]
            if objective > value[k] + 1e-12 * abs(value[k]) and np.abs(tried[k] - good[k]).max() > 1e-14:
                tried[k] = (good[k] + tried[k]) / 2
                still.append(k)
                continue
            good[k], value[k], ahead[k] = tried[k], objective, new
            if np.abs(new - good[k]).max(initial=0.0) <= tolerance * max(1.0, np.abs(good[k]).max(initial=0.0)):
                good[k], fits[k].converged = new, True
            else:
                tried[k] = new
                still.append(k)
        live = still
        if not live:
            break
    for f, g in zip(fits, good):
        f.intercept, f.coefficients = float(g[0]), g[1:].copy()


def _step(rows: DataFrame, models: list, width: int, weights: Mapping, penalise_intercept: bool, scalings: Mapping | None, parts: int) -> dict[int, tuple[float, np.ndarray]]:
    """model -> objective at the point given, and the point that the next step goes to."""

    def local(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(0).to_numpy(zero_copy_only=False)
            own = batch.column(1).to_numpy(zero_copy_only=False)
            x = as_matrix(batch.column(2), width)
            scaled: dict = {}
            for k, task, beta in models:
                key = task.held_out
                if key not in scaled:
                    kept = np.ones(len(y), bool) if key is None else own != key
                    part = x[kept]
                    if scalings is not None:
                        centre, scale = scalings[key]
                        part = (part - centre) / scale
                    zero, one = weights.get(key, weights[None])  # a fold without rows holds none out
                    scaled[key] = np.column_stack([np.ones(len(part)), part]), y[kept], np.where(y[kept] == 1, one, zero)
                wide, label, weight = scaled[key]
                if not len(wide):
                    continue
                z = wide if task.places is None else wide[:, [0, *(p + 1 for p in task.places)]]
                margin = z @ beta
                chance = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                loss = (weight * (np.logaddexp(0.0, margin) - label * margin)).sum()
                slope = z.T @ (weight * (chance - label))
                bend = (z * (weight * chance * (1 - chance))[:, None]).T @ z
                upper = bend[np.triu_indices(len(beta))]
                sums = np.concatenate([[loss], slope, upper])
                total[k] = total[k] + sums if k in total else sums
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([s.tolist() for s in total.values()], pa.list_(pa.float64()))], names=["k", "sums"])

    points = {k: (task, beta) for k, task, beta in models}

    def solve(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:  # a row a model and task, added up as they come
            for k, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = sums.values.to_numpy()
                total[k] = total[k] + s if k in total else s.copy()
        out = []
        by_size: dict[int, list[int]] = {}
        for k in total:
            by_size.setdefault(len(points[k][1]), []).append(k)
        for n, ks in by_size.items():
            upper = np.triu_indices(n)
            h, g, beta, l1 = np.zeros((len(ks), n, n)), np.zeros((len(ks), n)), np.zeros((len(ks), n)), np.zeros((len(ks), n))
            values = []
            for r, k in enumerate(ks):
                task, b = points[k]
                loss, slope, bend = total[k][0], total[k][1 : n + 1], total[k][n + 1 :]
                h[r][upper] = bend
                h[r] = (np.triu(h[r]) + np.triu(h[r], 1).T) * task.c
                paid = np.ones(n)
                paid[0] = float(penalise_intercept)
                ridge = (1 - task.l1_ratio) * paid
                h[r][np.arange(n), np.arange(n)] += ridge
                g[r], beta[r], l1[r] = task.c * slope + ridge * b, b, task.l1_ratio * paid
                values.append(task.c * loss + (ridge * b * b).sum() / 2 + (l1[r] * np.abs(b)).sum())
            new = descend(h, g, beta, l1)
            out += [(k, v, b.tolist()) for k, v, b in zip(ks, values, new)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.float64(), pa.list_(pa.float64())))], names=["k", "value", "beta"])

    sums = rows.select("y", "f", "v").mapInArrow(local, "k int, sums array<double>")
    solved = sums.repartition(parts, "k").mapInArrow(solve, "k int, value double, beta array<double>")
    return {r.k: (r.value, np.array(r.beta)) for r in solved.collect()}  # a row a model


def as_matrix(column, width: int) -> np.ndarray:
    """An Arrow column of lists as rows of ``width`` numbers; what is null or missing is 0."""
    offsets = np.asarray(column.offsets)
    values = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    lengths[np.asarray(column.is_null().to_numpy(zero_copy_only=False))] = 0
    if len(lengths) and (lengths == width).all():
        return np.nan_to_num(values[offsets[0] : offsets[-1]].reshape(len(lengths), width))
    out = np.zeros((len(lengths), width))
    for r, (at, n) in enumerate(zip(offsets[:-1], lengths)):
        out[r, : min(n, width)] = values[at : at + min(n, width)]
    return np.nan_to_num(out)


def held_out_scores(df: DataFrame, fits: Sequence[LogisticFit], *, fold: str = "fold", scalings: Mapping[int | None, tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """model (place in ``fits``), fold, id, y, score: every row of ``df`` scored by the models that didn't see its fold."""
    by_fold: dict[int, list] = {}
    for k, f in enumerate(fits):
        if f.task.held_out is not None:
            by_fold.setdefault(f.task.held_out, []).append((k, f.task.places, f.intercept, f.coefficients))

    def run(batches):
        for batch in batches:
            own = batch.column(2).to_numpy(zero_copy_only=False)
            for held, models in by_fold.items():
                at = np.flatnonzero(own == held)
                if not len(at):
                    continue
                sizes = [len(places) if places is not None else len(b) for _, places, _, b in models]
                width = max(*sizes, *(max(places, default=-1) + 1 for _, places, _, _ in models if places is not None), 0)
                part = batch.take(pa.array(at))
                x = as_matrix(part.column(3), width)
                if scalings is not None:
                    centre, scale = scalings[held]
                    x = (x - centre[:width]) / scale[:width]
                for k, places, start, b in models:
                    score = 1 / (1 + np.exp(-np.clip((x if places is None else x[:, list(places)]) @ b + start, -500, 500)))
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), part.column(2), part.column(0), part.column(1), pa.array(score)], names=["model", "fold", "id", "y", "score"])

    rows = df.select(F.col("id").cast("long").alias("id"), F.col("y").cast("int").alias("y"), F.col(fold).cast("int").alias("fold"), F.transform("features", lambda v: v.cast("double")).alias("v"))
    return rows.mapInArrow(run, "model int, fold int, id long, y int, score double")
