"""k-means and mixtures fitted together, and silhouettes, held against plain versions in NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from rankwright.operators import segments


def blobs(n=600, width=3, k=4, seed=1):
    r = np.random.default_rng(seed)
    own = r.integers(0, k, n)
    return r.normal(size=(k, width))[own] * 6 + r.normal(size=(n, width)), own


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>").repartition(5)


def plain_lloyd(x, centres, steps=300):
    for _ in range(steps):
        own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.array([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        if np.abs(new - centres).max() < 1e-12:
            break
        centres = new
    return centres, ((x[:, None] - centres) ** 2).sum(2).min(1).sum()


def plain_silhouette(x, own):
    away = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        means = {c: away[i][own == c] for c in set(own.tolist())}
        a, b = means[own[i]].sum() / max(len(means[own[i]]) - 1, 1), min(v.mean() for c, v in means.items() if c != own[i])
        out.append((b - a) / max(a, b) if len(means[own[i]]) > 1 and max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def test_many_means_equal_plain_ones(spark):
    x, _ = blobs()
    jobs = [(k, s) for k in (2, 4, 7) for s in (1, 2, 3)]
    fits = segments.fit_means(frame(spark, x), jobs, tolerance=0.0)
    for (k, _), fit in zip(jobs, fits):
        again, value = plain_lloyd(x, fit.centres)  # where plain steps stand still too
        assert fit.converged and len(fit.centres) == k and np.allclose(again, fit.centres) and fit.inertia == pytest.approx(value)
    best = min(f.inertia for f in fits if f.k == 4)
    assert best <= 1.02 * min(plain_lloyd(x, segments.spread_start(x, 4, s))[1] for s in range(5))


def test_silhouette_is_exact_on_its_sample(spark):
    x, own = blobs(n=2000)
    df = frame(spark, x).join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(own)], "id long, cluster int"), "id")
    want = plain_silhouette(x, own)
    assert segments.silhouette(df) == pytest.approx(want, abs=1e-9)
    assert abs(segments.silhouette(df, sample=800) - want) < 0.05
    assert np.isnan(segments.silhouette(df.withColumn("cluster", F.lit(1)))) and np.isnan(segments.silhouette(df.where("id < 0")))
    rows = segments.kmeans_diagnostics(df, [1, 4, 2, 4, 9999], restarts=3).collect()
    assert [r.k for r in rows] == [2, 4] and rows[1].inertia < rows[0].inertia
    labelled, = segments.kmeans_clusters(df.drop("cluster"), k=4, restarts=3)
    got = labelled.orderBy("id").select("cluster").toPandas().cluster.to_numpy()
    assert rows[1].silhouette == pytest.approx(plain_silhouette(x, got), abs=2e-3)


def test_silhouette_of_lone_rows_and_ties(spark):
    x = np.array([[0.0, 0], [0, 0], [0, 0], [5, 5], [5, 5], [9, 9]])
    own = [0, 0, 1, 1, 1, 2]
    df = spark.createDataFrame([(c, v.tolist()) for c, v in zip(own, x)], "cluster int, features array<double>")
    assert segments.silhouette(df) == pytest.approx(plain_silhouette(x, np.array(own)))


def test_mixture_reaches_a_likelihood_that_plain_steps_keep(spark):
    x, own = blobs(n=900, width=2, k=3, seed=5)
    x = x + 1e4  # far from the origin
    fits = segments.fit_mixtures(frame(spark, x), [(3, s) for s in range(3)], tolerance=1e-8, steps=200)
    best = max(fits, key=lambda m: m.fit)
    logs = segments.log_densities(x, best)
    assert best.converged and best.weights.sum() == pytest.approx(1.0)
    share = np.exp(logs - np.logaddexp.reduce(logs, axis=1)[:, None])
    assert best.fit == pytest.approx(np.logaddexp.reduce(logs, axis=1).mean(), abs=1e-6)
    assert np.allclose(share.T @ x / share.sum(0)[:, None], best.means, atol=1e-2)
    for c in range(3):
        d = x - best.means[c]
        cov = (d * share[:, [c]]).T @ d / share[:, c].sum()
        assert np.allclose(np.linalg.inv(best.factors[c] @ best.factors[c].T), cov, rtol=1e-2, atol=1e-2)
    mixed, = segments.mixture_segments(frame(spark, x), k=3, components=None)
    named = mixed.orderBy("id").toPandas().cluster.to_numpy()
    assert sum(np.bincount(named[own == c]).max() for c in range(3)) / len(x) > 0.9


def test_rows_that_take_no_part(spark):
    x, _ = blobs(n=50, width=2, k=2)
    odd = spark.createDataFrame([(100, None), (101, [1.0, None]), (102, [float("nan"), 1.0]), (103, [float("inf"), 1.0])], "id long, features array<double>")
    df = frame(spark, x).unionByName(odd)
    for table in (segments.kmeans_clusters(df, k=2, restarts=2)[0], segments.mixture_segments(df, k=2, components=1, restarts=1)[0]):
        assert {r.id for r in table.where("cluster IS NULL").collect()} == {100, 101, 102, 103} and table.where("cluster IN (0, 1)").count() == 50
    none = df.where("id > 99")
    assert segments.kmeans_clusters(none, k=2, restarts=1)[0].where("cluster IS NULL").count() == 4
    assert segments.mixture_segments(none, k=2)[0].where("cluster IS NULL").count() == 4
    assert segments.kmeans_diagnostics(none, [2]).count() == 0
    with pytest.raises(ValueError):
        segments.fit_means(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "features array<double>"), [(1, 1)])
    same = spark.createDataFrame([([1.0, 1.0],)] * 6, "features array<double>")
    assert segments.fit_means(same, [(3, 1)])[0].inertia == 0.0


def test_sums_of_all_models_of_a_pass(monkeypatch):
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(300, 3)))
    models = {4: x[:5], 1: np.vstack([x[:2], x[:2]]), 7: r.normal(size=(2, 3))}  # equal centres: the first has the rows
    for most in (1 << 19, 50):
        monkeypatch.setattr(segments, "AWAY", most)
        got = dict(segments._mean_sums(x, models))
        assert list(got) == [4, 1, 7]
        for j, centres in models.items():
            own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
            one = np.eye(len(centres))[own]
            assert np.allclose(got[j], np.concatenate([one.sum(0), (one.T @ x).ravel()]))
            assert np.isclose(dict(segments._mean_inertia(x, models))[j][0], ((x - centres[own]) ** 2).sum())


def test_silhouettes_and_starts_are_of_all_rows(spark, monkeypatch):
    x, own = blobs(n=6000, k=3, seed=3)
    df = frame(spark, x).join(spark.createDataFrame([(i, f"c{c}") for i, c in enumerate(own)], "id long, cluster string"), "id")
    want = plain_silhouette(x, own)
    assert segments.silhouette(df) == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(segments, "CELLS", 6000)  # 1,000 rows a group at most
    assert segments.silhouette(df) == pytest.approx(want, abs=1e-9)
    row, = segments.kmeans_diagnostics(df, [3], restarts=2).collect()
    centres = segments.fit_means(df, [(3, 42), (3, 43)])
    near = segments.squared_distances(x, min(centres, key=lambda m: m.inertia).centres).argmin(1)
    assert row.silhouette == pytest.approx(plain_silhouette(x, near), abs=1e-9)
    far = np.vstack([np.zeros((7000, 2)), [[1.0, 1.0]], [[1.0, 3.0]]])  # whatever the first row, the others come next
    for s in range(3):
        fit, = segments.fit_means(frame(spark, far), [(3, s)])
        assert sorted(map(tuple, fit.centres.tolist())) == [(0.0, 0.0), (1.0, 1.0), (1.0, 3.0)] and fit.inertia == 0.0
