"""k-means and Gaussian mixtures of many sizes and starts, fitted together, and the Euclidean silhouette.

In a pass over the rows every task adds up, for each model that still moves, what the
next step needs of its own rows: counts and sums of each cluster, or weights, means and
products of each component.  The sums of a model meet in one task.  So ten starts of
nine values of k take as many passes as the slowest of the 90 models takes steps, and
what moves is a row a model and task, whatever the number of rows.

Starts are drawn by k-means++ from all rows: a pass draws the next centre of every model.
Silhouettes are those of all rows, whose distances to each other are worked out in tiles of
bounded size.  Rows whose features are null, or hold a null or a number that isn't finite,
take no part in a fit and get a null cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written
from .paths import CELLS, as_matrix

#: Rows whose distances to all rows on the other side of a tile are held at a time, and rows on a side that are worth a tile.
BLOCK, TILE = 128, 1024
#: Distances of a batch to the centres of all models that are held at a time.
AWAY = 1 << 19


@dataclass
class Means:
    """Centres of one k-means model; ``inertia`` is the sum of squared distances of all rows to the nearest of them."""

    k: int
    seed: int
    centres: np.ndarray
    inertia: float = 0.0
    steps: int = 0
    converged: bool = False


@dataclass
class Mixture:
    """Weights, means and the factors of the inverse covariances; ``fit`` is the mean log-likelihood of the rows."""

    k: int
    seed: int
    weights: np.ndarray
    means: np.ndarray
    factors: np.ndarray | None = None
    fit: float = -np.inf
    steps: int = 0
    converged: bool = False


def usable(features: Column) -> Column:
    """Whether a row takes part: features that are there, and finite."""
    v = lambda x: x.cast("double")
    return F.coalesce(features.isNotNull() & F.forall(features, lambda x: x.isNotNull() & ~F.isnan(v(x)) & (F.abs(v(x)) < float("inf"))), F.lit(False))


def _rows(df: DataFrame, *extra: str) -> tuple[DataFrame, int, int]:
    """The usable rows, written; their number; their width."""
    rows = written(df.where(usable(F.col("features"))).select(*extra, F.transform("features", lambda x: x.cast("double")).alias("v")), "segment-rows")
    seen = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b")).first()
    if seen.n and seen.a != seen.b:
        raise ValueError(f"features have {seen.a} to {seen.b} values; segments need rows of one length")
    return rows, seen.n, seen.a or 0


def _sampled(rows: DataFrame, n: int, sample: int, seed: int) -> DataFrame:
    return rows if n <= sample else rows.where(F.rand(seed) < sample / n)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0.0)


def spread_start(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each further centre is a row drawn by its squared distance to the nearest one so far."""
    r = np.random.default_rng(seed)
    centres = x[[r.integers(len(x))]]
    near = squared_distances(x, centres)[:, 0]
    while len(centres) < k:
        chance = near / near.sum() if near.sum() > 0 else np.full(len(x), 1 / len(x))
        new = x[[r.choice(len(x), p=chance)]]
        centres = np.vstack([centres, new])
        near = np.minimum(near, squared_distances(x, new)[:, 0])
    return centres


def _starts(rows: DataFrame, width: int, jobs: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """The start of each (k, seed) as ``spread_start`` draws it, from all rows: each row has an exponential time over its
    squared distance to the nearest centre so far, and the first is the next centre, so a task hands on a row a model."""
    starts = [np.zeros((0, width)) for _ in jobs]
    for step in range(max(k for k, _ in jobs)):
        live = {j: starts[j] for j, (k, _) in enumerate(jobs) if k > step}

        def first(batches):
            drawn = {j: np.random.default_rng([abs(jobs[j][1]), step, TaskContext.get().partitionId()]) for j in live}
            best: dict[int, tuple] = {}
            for batch in batches:
                x = as_matrix(batch.column(0), width)
                for j, centres in live.items() if len(x) else ():
                    near = squared_distances(x, centres).min(1) if step else np.ones(len(x))
                    time = drawn[j].exponential(size=len(x))
                    far = near > 0  # rows on a centre come after all others
                    time[far] /= near[far]
                    at = int(np.lexsort((time, ~far))[0])
                    best[j] = min(best.get(j, (True, np.inf)), (not far[at], time[at], x[at].tolist()))
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), *(pa.array([b[c] for b in best.values()], t) for c, t in enumerate((pa.bool_(), pa.float64(), pa.list_(pa.float64()))))], names=["j", "late", "time", "v"])

        found = rows.select("v").mapInArrow(first, "j int, late boolean, time double, v array<double>").groupBy("j").agg(F.min_by("v", F.struct("late", "time")).alias("v"))
        for r in found.collect():  # a row a model
            starts[r.j] = np.vstack([starts[r.j], r.v])
    return starts


def _totals(rows: DataFrame, width: int, models: dict, sums_of: Callable) -> dict[int, np.ndarray]:
    """model -> the sum over all rows of what ``sums_of`` (rows, models) gives, model by model, for a batch of them."""

    def local(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x = as_matrix(batch.column(0), width)
                for j, s in sums_of(x, models):
                    total[j] = total[j] + s if j in total else s
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([s.tolist() for s in total.values()], pa.list_(pa.float64()))], names=["j", "sums"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for j, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = sums.values.to_numpy()
                total[j] = total[j] + s if j in total else s.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([s.tolist() for s in total.values()], pa.list_(pa.float64()))], names=["j", "sums"])

    schema = "j int, sums array<double>"
    parts = max(1, min(len(models), rows.sparkSession.sparkContext.defaultParallelism))
    return {r.j: np.array(r.sums) for r in rows.select("v").mapInArrow(local, schema).repartition(parts, "j").mapInArrow(add, schema).collect()}  # a row a model


def _groups(sizes: Sequence[int]) -> list[list[int]]:
    """Models that go through the rows together: no more numbers than CELLS, or a single model."""
    out: list[list[int]] = []
    held = 0
    for j, size in enumerate(sizes):
        if not out or held + size > CELLS:
            out.append([])
            held = 0
        out[-1].append(j)
        held += size
    return out


def _mean_sums(x: np.ndarray, models: Mapping[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Of each model (its centres), the number and the sum of the rows nearest to each centre.  The distances to the centres of
    all models are one product of matrices, and so are the sums; of centres that are equally near the first has the row."""
    ends = np.cumsum([len(c) for c in models.values()])
    starts, every = np.concatenate([[0], ends[:-1]]), np.vstack(list(models.values()))
    sizes, lengths = ends - starts, (every * every).sum(1)[:, None]
    counts, sums = np.zeros(len(every)), np.zeros(every.shape)
    step = max(1, AWAY // len(every))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        away = every @ part.T
        away *= -2
        away += (part * part).sum(1)
        away += lengths
        np.maximum(away, 0.0, out=away)
        one = (away == np.repeat(np.minimum.reduceat(away, starts), sizes, axis=0)).astype(float)
        if one.sum() != len(part) * len(models):
            for a, b in zip(starts, ends):
                own = one[a:b].argmax(0)
                one[a:b] = 0.0
                one[a + own, np.arange(len(part))] = 1.0
        counts += one.sum(1)
        sums += one @ part
    for j, a, b in zip(models, starts, ends):
        yield j, np.concatenate([counts[a:b], sums[a:b].ravel()])


def _mean_inertia(x: np.ndarray, models: Mapping[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    for j, centres in models.items():
        yield j, np.array([((x - centres[squared_distances(x, centres).argmin(1)]) ** 2).sum()])


def fit_means(df: DataFrame, jobs: Sequence[tuple[int, int]], *, steps: int = 300, tolerance: float = 1e-4) -> list[Means]:
    """A k-means model for each (k, seed), all moved in the same passes.

    A model stands still when its centres move by no more than ``tolerance`` of the mean variance of a feature.  A cluster
    that loses all its rows keeps its centre; ties go to the lower number.  Without usable rows there are no centres.
    """
    rows, n, width = _rows(df)
    return _means_of(rows, n, width, jobs, steps, tolerance)


def _means_of(rows: DataFrame, n: int, width: int, jobs: Sequence[tuple[int, int]], steps: int, tolerance: float) -> list[Means]:
    if not n or not jobs:
        return [Means(k, s, np.zeros((0, width)), converged=True) for k, s in jobs]
    fits = [Means(k, s, c) for (k, s), c in zip(jobs, _starts(rows, width, jobs))]
    about = fits[0].centres[0]
    first, second = _totals(rows, width, {0: about}, lambda x, models: [(0, np.concatenate([(x - about).sum(0), ((x - about) ** 2).sum(0)]))])[0].reshape(2, width) / n
    still = tolerance * float(np.maximum(second - first * first, 0.0).mean())
    for group in _groups([f.k * (width + 1) for f in fits]):
        live = list(group)
        for _ in range(steps):
            found = _totals(rows, width, {j: fits[j].centres for j in live}, _mean_sums)
            for j in list(live):
                f = fits[j]
                counts, sums = found[j][: f.k], found[j][f.k :].reshape(f.k, width)
                new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], f.centres)
                moved, f.centres, f.steps = float(((new - f.centres) ** 2).sum()), new, f.steps + 1
                if moved <= still:
                    f.converged = True
                    live.remove(j)
            if not live:
                break
        for j, sums in _totals(rows, width, {j: fits[j].centres for j in group}, _mean_inertia).items():
            fits[j].inertia = float(sums[0])
    return fits


def log_densities(x: np.ndarray, model: Mixture) -> np.ndarray:
    """log of weight times density, row by component."""
    out = np.empty((len(x), model.k))
    for c in range(model.k):
        z = (x - model.means[c]) @ model.factors[c]
        out[:, c] = np.log(model.weights[c]) - 0.5 * (x.shape[1] * np.log(2 * np.pi) + (z * z).sum(1)) + np.log(np.diag(model.factors[c])).sum()
    return out


def _mixture_sums(x: np.ndarray, model: Mixture) -> np.ndarray:
    """Log-likelihood and, about the present means, the weights, first and second moments of each component.  A model without
    factors is new: there a row belongs to the nearest mean alone."""
    if model.factors is None:
        share = np.zeros((len(x), model.k))
        share[np.arange(len(x)), squared_distances(x, model.means).argmin(1)] = 1.0
        likely = 0.0
    else:
        logs = log_densities(x, model)
        top = logs.max(1)
        whole = top + np.log(np.exp(logs - top[:, None]).sum(1))
        share, likely = np.exp(logs - whole[:, None]), whole.sum()
    parts = [[likely], share.sum(0)]
    for c in range(model.k):
        d = x - model.means[c]
        parts += [share[:, c] @ d, ((d * share[:, [c]]).T @ d).ravel()]
    return np.concatenate(parts)


def _renewed(model: Mixture, sums: np.ndarray, n: int, floor: float) -> None:
    """The step to the next weights, means and covariances, whose diagonals are raised by ``floor``."""
    width = model.means.shape[1]
    weights = sums[1 : model.k + 1] + 10 * np.finfo(float).eps
    moments = sums[model.k + 1 :].reshape(model.k, width + width * width)
    first = moments[:, :width] / weights[:, None]
    second = moments[:, width:].reshape(model.k, width, width) / weights[:, None, None]
    spread = second - first[:, :, None] * first[:, None, :] + floor * np.eye(width)
    lower = np.linalg.cholesky(spread)
    model.factors = np.linalg.inv(lower).transpose(0, 2, 1)
    model.weights, model.means = weights / n, model.means + first


def fit_mixtures(df: DataFrame, jobs: Sequence[tuple[int, int]], *, steps: int = 100, tolerance: float = 1e-3, floor: float = 1e-6) -> list[Mixture]:
    """A Gaussian mixture with full covariances for each (k, seed), all moved in the same passes from the clusters of a k-means
    model of the same start; one stands still when the mean log-likelihood changes by less than ``tolerance``."""
    rows, n, width = _rows(df)
    fits = [Mixture(m.k, m.seed, np.zeros(m.k), m.centres) for m in _means_of(rows, n, width, jobs, 300, 1e-4)]
    if not n:
        return fits
    for group in _groups([f.k * (1 + width + width * width) for f in fits]):
        live = list(group)
        for step in range(steps + 1):
            found = _totals(rows, width, {j: fits[j] for j in live}, lambda x, models: ((j, _mixture_sums(x, m)) for j, m in models.items()))
            for j in list(live):
                f = fits[j]
                likely = found[j][0] / n if step else -np.inf
                f.converged = bool(step) and abs(likely - f.fit) < tolerance
                f.fit, f.steps = likely, step
                if f.converged or step == steps:
                    live.remove(j)
                else:
                    _renewed(f, found[j], n, floor)
            if not live:
                break
    return fits


def _with_cluster(df: DataFrame, column: Column, width: int, choose: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    @F.arrow_udf("int")
    def chosen(v: pa.Array) -> pa.Array:
        return pa.array(choose(as_matrix(v, width)), pa.int32())

    return df.withColumn("cluster", F.when(usable(F.col("features")), chosen(F.transform(column, lambda x: x.cast("double")))))


def with_means(df: DataFrame, model: Means) -> DataFrame:
    """``df`` with ``cluster``, the number of the nearest centre."""
    if not len(model.centres):
        return df.withColumn("cluster", F.lit(None).cast("int"))
    centres = model.centres
    return _with_cluster(df, F.col("features"), centres.shape[1], lambda x: squared_distances(x, centres).argmin(1))


def kmeans_clusters(train: DataFrame, *others: DataFrame, k: int, restarts: int = 10, seed: int = 42) -> list[DataFrame]:
    """Tables with ``cluster`` from the best of several k-means runs on ``train``."""
    best = min(fit_means(train, [(k, seed + s) for s in range(restarts)]), key=lambda m: m.inertia)
    return [with_means(df, best) for df in (train, *others)]


def mixture_segments(train: DataFrame, *others: DataFrame, k: int = 5, components: int | None = 5, restarts: int = 3, seed: int = 42) -> list[DataFrame]:
    """Tables with ``cluster`` from the likeliest of several Gaussian mixtures, after an optional PCA."""
    good = train.where(usable(F.col("features")))
    row = good.select(F.size("features").alias("n")).first()
    if row is None:
        return [df.withColumn("cluster", F.lit(None).cast("int")) for df in (train, *others)]
    column = F.col("features")
    if components and components < row.n:
        turn = PCA(k=components, inputCol="_v", outputCol="_c").fit(good.select(array_to_vector("features").alias("_v"))).pc.toArray()
        axes = F.array(*(F.array(*(F.lit(float(w)) for w in turn[:, c])) for c in range(components)))
        column = F.transform(axes, lambda a: F.aggregate(F.zip_with("features", a, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, x: s + x))
    fits = fit_mixtures(good.select(column.alias("features")), [(k, seed + s) for s in range(restarts)])
    best = max(fits, key=lambda m: m.fit)
    return [_with_cluster(df, column, best.means.shape[1], lambda x: log_densities(x, best).argmax(1)) for df in (train, *others)]


def _tile_sums(x: np.ndarray, one: np.ndarray, other: np.ndarray, other_one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances from each row of ``x`` to the rows of ``other``, added up by cluster (columns of 0 and 1), and the other way."""
    there, back = np.empty((len(x), one.shape[1])), np.zeros(other_one.shape)
    for at in range(0, len(x), BLOCK):
        away = np.sqrt(squared_distances(x[at : at + BLOCK], other))
        if other is x:
            away[np.arange(len(away)), at + np.arange(len(away))] = 0.0
        there[at : at + BLOCK] = away @ other_one
        if other is not x:
            back += away.T @ one[at : at + BLOCK]
    return there, back


def _row_silhouettes(sums: np.ndarray, own: np.ndarray, counts: Sequence[np.ndarray]) -> np.ndarray:
    """row by model: the silhouette by the distances to the rows of each cluster, 0 for a row alone in its cluster."""
    out, at = np.zeros(own.shape), 0
    for m, count in enumerate(counts):
        part, mine, rows = sums[:, at : at + len(count)], own[:, m], np.arange(len(own))
        at += len(count)
        inner = part[rows, mine] / np.maximum(count[mine] - 1, 1)
        means = np.where(count > 0, part / np.maximum(count, 1), np.inf)
        means[rows, mine] = np.inf
        outer = means.min(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            value = (outer - inner) / np.maximum(inner, outer)
        out[:, m] = np.where((count[mine] > 1) & np.isfinite(value), value, 0.0)
    return out


def _silhouettes(rows: DataFrame, width: int, sizes: Sequence[int]) -> list[float]:
    """The mean silhouette of all rows (v, own: a cluster below its size for each of several labellings) by each labelling.
    NaN for fewer than two clusters, or as many as there are rows.

    Rows are dealt into groups of bounded size.  A task has the distances between two groups, once for all labellings, and
    hands on their sums by row and cluster; those of a group meet in one task.
    """
    spark = rows.sparkSession
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()), "silhouette-rows")
    counts = [np.zeros(size) for size in sizes]
    for r in rows.select(F.posexplode("own").alias("m", "c")).groupBy("m", "c").count().collect():  # a row a cluster
        counts[r.m][r.c] = r["count"]
    n, ends = int(counts[0].sum()) if sizes else 0, np.cumsum([0, *sizes])
    if not n:
        return [float("nan")] * len(sizes)
    wide, cores = int(ends[-1]), spark.sparkContext.defaultParallelism
    groups = max(-(-n // max(1, CELLS // (width + wide))), min(-(-n // TILE), int(np.ceil(np.sqrt(4 * cores)))))
    a, b, g = F.least("g", "h"), F.greatest("g", "h"), F.col("g")
    dealt = rows.withColumn("g", F.pmod("at", F.lit(groups)).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    tile = (a * (2 * groups + 1 - a) / 2).cast("int") + b - a
    dealt = dealt.select(tile.alias("tile"), (g != a).alias("other"), a.alias("a"), b.alias("b"), "at", "v", "own").repartitionById(groups * (groups + 1) // 2, F.col("tile"))

    def sums(batches):
        tiles: dict[tuple[int, int], list] = {}
        for batch in batches:
            if batch.num_rows:
                side, pair = batch.column("other").to_numpy(zero_copy_only=False), (batch.column("a")[0].as_py(), batch.column("b")[0].as_py())
                own = batch.column("own").flatten().to_numpy().reshape(len(side), len(sizes))
                tiles.setdefault(pair, []).append((side, batch.column("at").to_numpy(), as_matrix(batch.column("v"), width), own))
        for (a, b), parts in tiles.items():
            side, at, x, own = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(at)
            first, second = order[~side[order]], order[side[order]]
            one = np.zeros((len(x), wide))
            for m, start in enumerate(ends[:-1]):
                one[np.arange(len(x)), start + own[:, m]] = 1.0
            left, left_one = x[first], one[first]
            right, right_one = (left, left_one) if a == b else (x[second], one[second])
            there, back = _tile_sums(left, left_one, right, right_one)
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([there.ravel()], pa.list_(pa.float64())), pa.array([own[first].ravel() if a == b else None], pa.list_(pa.int32()))], names=["g", "sums", "own"])
            if a != b:
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([back.ravel()], pa.list_(pa.float64())), pa.array([None], pa.list_(pa.int32()))], names=["g", "sums", "own"])

    def finish(batches):
        total: dict[int, np.ndarray] = {}
        labels: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, part, own in zip(batch.column("g").to_pylist(), batch.column("sums"), batch.column("own")):
                part = part.values.to_numpy()
                total[g] = total[g] + part if g in total else part.copy()
                if own.is_valid:
                    labels[g] = own.values.to_numpy().reshape(-1, len(sizes))
        for g, part in total.items():
            found = _row_silhouettes(part.reshape(-1, wide), labels[g], counts).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sizes), dtype=np.int32)), pa.array(found)], names=["m", "s"])

    added = dealt.mapInArrow(sums, "g int, sums array<double>, own array<int>").repartitionById(groups, F.col("g")).mapInArrow(finish, "m int, s double")
    totals = {r.m: r.s for r in added.groupBy("m").agg(F.sum("s").alias("s")).collect()}
    return [totals[m] / n if 1 < (count > 0).sum() < n else float("nan") for m, count in enumerate(counts)]


def silhouette(df: DataFrame, *, cluster: str = "cluster", sample: int | None = None, seed: int = 42) -> float:
    """The mean Euclidean silhouette of a table (features, ``cluster``): of all usable rows or, where asked for, of a sample
    of about ``sample`` of them, exact among those.  The work grows with the square of the rows that it is taken on, the
    memory of a task doesn't; rows without a cluster are left out."""
    rows, n, width = _rows(df.where(F.col(cluster).isNotNull()), cluster)
    rows = rows if sample is None else _sampled(rows, n, sample, seed)
    names = rows.select(cluster).distinct().collect()  # a row a cluster
    numbers = df.sparkSession.createDataFrame([(r[0], k) for k, r in enumerate(names)], f"_name {rows.schema[cluster].dataType.simpleString()}, _number int")
    return _silhouettes(rows.join(F.broadcast(numbers), F.col(cluster) == F.col("_name")).select("v", F.array("_number").alias("own")), width, [len(names)])[0]


def kmeans_diagnostics(df: DataFrame, ks: Sequence[int], *, restarts: int = 10, seed: int = 42) -> DataFrame:
    """k, inertia and Euclidean silhouette of the best of ``restarts`` k-means runs, for each k of at least two and below the
    number of rows.  All runs of all k share their passes; inertia and silhouette are those of all rows."""
    spark = df.sparkSession
    rows, n, width = _rows(df)
    wanted = sorted({int(k) for k in ks if 2 <= int(k) < n})
    best: dict[int, Means] = {}
    for m in _means_of(rows, n, width, [(k, seed + s) for k in wanted for s in range(restarts)], 300, 1e-4):
        if m.k not in best or m.inertia < best[m.k].inertia:
            best[m.k] = m
    centres = [best[k].centres for k in wanted]

    @F.arrow_udf("array<int>")
    def nearest(v: pa.Array) -> pa.Array:
        x = as_matrix(v, width)
        own = np.stack([squared_distances(x, c).argmin(1) for c in centres], 1).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, len(centres), dtype=np.int32)), pa.array(own.ravel()))

    values = _silhouettes(rows.select("v", nearest("v").alias("own")), width, wanted) if wanted else []
    return spark.createDataFrame([(k, best[k].inertia, v) for k, v in zip(wanted, values)], "k int, inertia double, silhouette double")
