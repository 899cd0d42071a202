"""Boosters and subset selection that Spark lacks: leaf-wise trees, LambdaMART, additive boosting, best subsets.

Each is fitted on a bounded sample of labelled rows, the ``sample`` rows with the least hash of the id; the bound is a
parameter of the operator.  The sample meets in one task, where the model is grown, and only the model comes to the
driver.  Scoring runs over all rows in Arrow batches.  The functions ``fit_...`` are what a task runs.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import Fit

#: Rows a model is fitted on, and rows of a leaf whose bins are always added up from its own rows.
SAMPLE, FEW = 20_000, 512


def fitted_in_task(train: DataFrame, sample: int, grow: Callable[[np.ndarray, np.ndarray], object]):
    """What ``grow`` makes, in a task, of the features and labels of the ``sample`` rows with the least hash of the id."""

    def run(batches):
        rows = [b for b in batches if len(b)]
        if rows:
            both = pd.concat(rows)
            model = grow(np.stack(both["features"].to_numpy()).astype(float), both["y"].to_numpy().astype(float))
            yield pd.DataFrame({"model": [pickle.dumps(model)]})

    # A limit leaves one partition: the sample is one task's.
    picked = train.where("y IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample).select("features", "y")
    made = picked.mapInPandas(run, "model binary").collect()
    if not made:
        raise ValueError("no training rows")
    return pickle.loads(bytes(made[0].model))


@dataclass
class Tree:
    """Nodes in the order of their making: feature (-1 for a leaf), threshold, children, value."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(x)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right = map(np.array, (self.feature, self.threshold, self.left, self.right))
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        while (inner := feature[at] >= 0).any():
            go = x[rows, np.maximum(feature[at], 0)] > threshold[at]
            at = np.where(inner, np.where(go, right[at], left[at]), at)
        return np.array(self.value)[at]


@dataclass(frozen=True)
class Bins:
    """Features cut at quantiles: place of each value, by row and once more by feature, and the cuts."""

    places: np.ndarray
    by_feature: np.ndarray
    cuts: list[np.ndarray]
    width: int


def binned(x: np.ndarray, bins: int) -> Bins:
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    width = max(map(len, cuts)) + 1
    by_feature = np.stack([np.searchsorted(c, x[:, f], side="left").astype(np.min_scalar_type(width)) for f, c in enumerate(cuts)])
    return Bins(np.ascontiguousarray(by_feature.T), by_feature, cuts, width)


def _bin_sums(b: Bins, rows: np.ndarray, g: np.ndarray, h: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Slopes, curvatures and numbers of ``rows`` in each bin of each of ``columns``, added up in the order of the rows."""
    m, g, h = len(columns), g[rows], h[rows]
    if len(rows) > FEW:
        out = np.empty((3, m, b.width))
        for j, f in enumerate(columns):
            own = b.by_feature[f, rows]
            out[0, j], out[1, j], out[2, j] = np.bincount(own, g, b.width), np.bincount(own, h, b.width), np.bincount(own, None, b.width)
        return out
    index = (b.places[rows][:, columns] + np.arange(m) * b.width).ravel()
    return np.stack([np.bincount(index, w, m * b.width) for w in (np.repeat(g, m), np.repeat(h, m), None)]).reshape(3, m, b.width)


def _best_split(sums: np.ndarray, leaf: int, ridge: float, least: float, columns: np.ndarray) -> tuple[float, int, int]:
    """Gain, feature and last bin on the left of the best split, by one of ``columns`` whose bins hold ``sums``, with ``leaf``
    rows and curvature of ``least`` on either side."""
    sums = sums.cumsum(2)
    whole = sums[:, :, -1:]
    score = lambda a, c: a * a / (c + ridge)
    gain = score(sums[0], sums[1]) + score(whole[0] - sums[0], whole[1] - sums[1]) - score(whole[0], whole[1])
    gain[(sums[2] < leaf) | (whole[2] - sums[2] < leaf) | (sums[1] < least) | (whole[1] - sums[1] < least)] = -np.inf
    j, k = divmod(int(gain.argmax()), gain.shape[1])
    return float(gain[j, k]), int(columns[j]), k


def grow_leafwise(b: Bins, g: np.ndarray, h: np.ndarray, *, leaves: int, depth: int, leaf: int, ridge: float, gains: np.ndarray, splits: np.ndarray | None = None, least: float = 0.0, rows: np.ndarray | None = None, columns: np.ndarray | None = None) -> tuple[Tree, np.ndarray]:
    """A tree, grown on ``rows`` and ``columns`` (all if none), that always splits the leaf with the most to gain, and its value
    for each of the rows; ``gains`` and ``splits`` add up by feature.

    Of the two sides of a large leaf only the smaller is added up; the other has what is left of the leaf's sums.
    """
    tree, out = Tree(), np.zeros(len(g))
    columns = np.arange(b.places.shape[1]) if columns is None else columns
    waiting: list[tuple] = []

    def offer(rows: np.ndarray, level: int, sums: np.ndarray | None = None) -> int:
        node = tree.add(float(g[rows].sum() / (h[rows].sum() + ridge)))
        out[rows] = tree.value[node]
        if level < depth and len(rows) >= 2 * leaf:
            sums = _bin_sums(b, rows, g, h, columns) if sums is None else sums
            gain, f, k = _best_split(sums, leaf, ridge, least, columns)
            if gain > 1e-9 and k < len(b.cuts[f]):
                heapq.heappush(waiting, (-gain, node, f, k, level, rows, sums if len(rows) > FEW else None))
        return node

    offer(np.arange(len(g)) if rows is None else rows, 0)
    made = 1
    while waiting and made < leaves:
        gain, node, f, k, level, rows, sums = heapq.heappop(waiting)
        gains[f] -= gain
        if splits is not None:
            splits[f] += 1
        under = b.by_feature[f, rows] <= k
        sides, known = (rows[under], rows[~under]), [None, None]
        large = int(len(sides[1]) > len(sides[0]))
        if level + 1 < depth and sums is not None and len(sides[large]) > max(FEW, 2 * leaf):
            known[1 - large] = _bin_sums(b, sides[1 - large], g, h, columns)
            known[large] = np.where(sums[2] == known[1 - large][2], 0.0, sums - known[1 - large])  # a bin without rows holds nothing
        tree.feature[node], tree.threshold[node] = f, float(b.cuts[f][k])
        tree.left[node] = offer(sides[0], level + 1, known[0])
        tree.right[node] = offer(sides[1], level + 1, known[1])
        made += 1
    return tree, out


def _scored(df: DataFrame, model) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(features: pd.Series) -> pd.Series:
        return pd.Series(shared.value.predict(np.stack(features.to_numpy()).astype(float)) if len(features) else [], dtype=float)

    return df.withColumn("score", run("features"))


@dataclass(frozen=True)
class Boosted:
    """Summed trees, as a probability or as they are; ``gains`` and ``splits`` say what each feature's splits gained and how
    many there are."""

    base: float
    rate: float
    trees: list
    gains: np.ndarray
    splits: np.ndarray
    probability: bool
    features: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = self.base + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500))) if self.probability else total

    def score(self, df: DataFrame) -> DataFrame:
        return _scored(df, self)


def _boost(
    x: np.ndarray, gradients: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], base: float, *, trees: int, rate: float, leaves: int, depth: int, leaf: int, ridge: float, bins: int, probability: bool,
    least: float = 0.0, row_share: float = 1.0, column_share: float = 1.0, seed: int = 42,
) -> Boosted:
    """Each tree is grown on a share of the rows and of the columns, drawn anew; all rows move by its values."""
    b, score, made = binned(x, bins), np.full(len(x), base), []
    gains, splits, r = np.zeros(x.shape[1]), np.zeros(x.shape[1], int), np.random.default_rng(seed)
    for _ in range(trees):
        g, h = gradients(score)
        rows = None if row_share >= 1 else np.sort(r.permutation(len(x))[: max(1, round(row_share * len(x)))])
        columns = None if column_share >= 1 else np.sort(r.permutation(x.shape[1])[: max(1, round(column_share * x.shape[1]))])
        tree, step = grow_leafwise(b, g, h, leaves=leaves, depth=depth, leaf=leaf, ridge=ridge, gains=gains, splits=splits, least=least, rows=rows, columns=columns)
        score += rate * (step if rows is None else tree.predict(x))
        made.append(tree)
    return Boosted(base, rate, made, gains, splits, probability, x.shape[1])


def fit_leafwise(
    x: np.ndarray, y: np.ndarray, *, trees: int = 100, rate: float = 0.05, leaves: int = 31, depth: int = 64, leaf: int = 20, ridge: float = 1.0, bins: int = 64, multiplier: float | None = 1.0,
    least: float = 0.0, row_share: float = 1.0, column_share: float = 1.0, seed: int = 42,
) -> Boosted:
    weight = np.where(y == 1, 1.0 if multiplier is None else multiplier * (len(y) - y.sum()) / max(y.sum(), 1), 1.0)
    share = np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99)

    def gradients(score):
        p = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        return weight * (y - p), weight * p * (1 - p)

    return _boost(
        x, gradients, float(np.log(share / (1 - share))), trees=trees, rate=rate, leaves=leaves, depth=depth, leaf=leaf, ridge=ridge, bins=bins, probability=True,
        least=least, row_share=row_share, column_share=column_share, seed=seed,
    )


def leafwise_boosted(*, sample: int = SAMPLE, **ways) -> Fit:
    """Boosted leaf-wise trees of the logistic loss (``fit_leafwise`` has the parameters).

    Positives weigh ``multiplier`` times negatives over positives (1 if it is None); a split leaves ``leaf`` rows and
    curvature of ``least`` on either side; ``row_share`` and ``column_share`` of the sample are drawn for each tree.  With
    ``leaves`` 2 ** ``depth`` the trees are level-wise."""
    return lambda train: fitted_in_task(train, sample, lambda x, y: fit_leafwise(x, y, **ways))


def lambda_gradients(y: np.ndarray, score: np.ndarray, *, at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of all pairs of a positive and a negative row: how much their order is in doubt, times
    what changing places would do to the normalised discounted gain of the whole sample, which is one list."""
    place = np.empty(len(y), int)
    place[np.argsort(-score, kind="stable")] = np.arange(len(y))
    discount = 1 / np.log2(place + 2)
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    ideal = (1 / np.log2(np.arange(len(pos)) + 2)).sum() or 1.0
    g, h = np.zeros(len(y)), np.zeros(len(y))
    for k in range(0, len(pos), at_once):
        own = pos[k : k + at_once]
        doubt = 1 / (1 + np.exp(np.clip(score[own][:, None] - score[neg], -500, 500)))
        stake = np.abs(discount[own][:, None] - discount[neg]) / ideal
        force, bend = doubt * stake, doubt * (1 - doubt) * stake
        g[own] += force.sum(1)
        g[neg] -= force.sum(0)
        h[own] += bend.sum(1)
        h[neg] += bend.sum(0)
    return g, h


def fit_lambdamart(x: np.ndarray, y: np.ndarray, *, trees: int = 100, rate: float = 0.1, leaves: int = 15, leaf: int = 20, ridge: float = 1e-3, bins: int = 64) -> Boosted:
    return _boost(x, lambda s: lambda_gradients(y, s), 0.0, trees=trees, rate=rate, leaves=leaves, depth=64, leaf=leaf, ridge=ridge, bins=bins, probability=False)


def lambdamart(*, sample: int = SAMPLE, **ways) -> Fit:
    """Leaf-wise trees boosted on the gradients of ``lambda_gradients``; scores order rows and are no probabilities."""
    return lambda train: fitted_in_task(train, sample, lambda x, y: fit_lambdamart(x, y, **ways))


@dataclass(frozen=True)
class Additive:
    """A sum of one step function a feature, as a probability."""

    base: float
    cuts: list
    values: list
    importance: np.ndarray
    features: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = self.base + sum((v[np.searchsorted(c, x[:, f], side="left")] for f, (c, v) in enumerate(zip(self.cuts, self.values))), np.zeros(len(x)))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))

    def score(self, df: DataFrame) -> DataFrame:
        return _scored(df, self)


def fit_additive(x: np.ndarray, y: np.ndarray, *, rounds: int = 200, rate: float = 0.05, bins: int = 32, leaf: int = 5, ridge: float = 1.0) -> Additive:
    b = binned(x, bins)
    share = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    values, score = [np.zeros(len(c) + 1) for c in b.cuts], np.full(len(x), base)
    counts = [np.bincount(b.places[:, f], minlength=len(v)).cumsum() for f, v in enumerate(values)]
    for _ in range(rounds):
        for f, v in enumerate(values):
            p = 1 / (1 + np.exp(-score))
            g, h = (np.bincount(b.places[:, f], w, len(v)).cumsum() for w in (y - p, p * (1 - p)))
            fits = (counts[f] >= leaf) & (counts[f][-1] - counts[f] >= leaf)
            if not fits.any():
                continue
            gain = np.where(fits, g * g / (h + ridge) + (g[-1] - g) ** 2 / (h[-1] - h + ridge), -np.inf)
            k = int(gain.argmax())
            step = rate * np.where(np.arange(len(v)) <= k, g[k] / (h[k] + ridge), (g[-1] - g[k]) / (h[-1] - h[k] + ridge))
            v += step
            score += step[b.places[:, f]]
    importance = np.array([np.abs(v[b.places[:, f]] - v[b.places[:, f]].mean()).mean() for f, v in enumerate(values)])
    return Additive(base, b.cuts, values, importance, x.shape[1])


def additive_boosted(*, sample: int = SAMPLE, **ways) -> Fit:
    """Additive boosting: in each round every feature in turn gets one small step, the best split of its own bins, so that
    no feature speaks for another; its importance is the mean size of its function."""
    return lambda train: fitted_in_task(train, sample, lambda x, y: fit_additive(x, y, **ways))


def _newton(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients (the intercept first), probabilities and negative log-likelihood of a logistic model."""
    wide = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(wide.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(wide @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((wide * w[:, None]).T @ wide + ridge * np.eye(len(beta)), wide.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(wide @ beta, -30, 30))), 1e-12, 1 - 1e-12)
    return beta, p, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def spliced_subset(x: np.ndarray, y: np.ndarray, size: int, *, rounds: int = 20) -> tuple[list[int], np.ndarray, float]:
    """The best ``size`` columns that exchanging finds: those inside that the loss would miss least change places with
    those outside that would lower it most, as long as the loss falls."""
    strength = np.abs((x * (y - y.mean())[:, None]).sum(0)) / np.sqrt((x * x).sum(0) + 1e-12)
    inside = sorted(np.argsort(-strength, kind="stable")[:size].tolist())
    beta, p, loss = _newton(x[:, inside], y)
    for _ in range(rounds):
        w = p * (1 - p)
        missed = beta[1:] ** 2 * (w @ x[:, inside] ** 2) / 2
        outside = [k for k in range(x.shape[1]) if k not in set(inside)]
        if not outside:
            break
        promised = ((y - p) @ x[:, outside]) ** 2 / (2 * (w @ x[:, outside] ** 2) + 1e-12)
        go, come = np.argsort(missed, kind="stable"), np.argsort(-promised, kind="stable")
        for n in range(min(size, len(outside), 3), 0, -1):
            tried = sorted(set(inside) - {inside[k] for k in go[:n]} | {outside[k] for k in come[:n]})
            found = _newton(x[:, tried], y)
            if found[2] < loss - 1e-6:
                inside, (beta, p, loss) = tried, found
                break
        else:
            break
    return inside, beta[1:], loss


def fit_best_subset(x: np.ndarray, y: np.ndarray, *, sizes: Sequence[int] = tuple(range(1, 11))) -> list[float]:
    spread = x.std(0)
    x = (x - x.mean(0)) / np.where(spread > 0, spread, 1.0)
    found = [(2 * loss + len(inside) * np.log(len(y)), inside, beta) for inside, beta, loss in (spliced_subset(x, y, s) for s in sorted({min(s, x.shape[1]) for s in sizes}))]
    _, inside, beta = min(found, key=lambda f: f[0])
    out = np.zeros(x.shape[1])
    out[inside] = np.abs(beta)
    return out.tolist()


def best_subset_scores(train: DataFrame, *, sizes: Sequence[int] = tuple(range(1, 11)), sample: int = SAMPLE) -> list[float]:
    """Absolute coefficients, of standardised features, of the best subset; its size is the one with the least information
    criterion (log n for each feature), and features outside it have 0."""
    return fitted_in_task(train, sample, lambda x, y: fit_best_subset(x, y, sizes=sizes))
