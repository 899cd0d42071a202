"""Registered queries of filters and fits over the embeddings, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fanout, features, folds, isotonic, models, pipelines, search, segments
from .frames import embedding_rows, table
from .queries import _six, query

_WIDTH = 66


def _with_odd_columns(df):
    """The embeddings with a constant column and one that doubles the first."""
    return df.withColumn("features", F.concat("features", F.array(F.lit(1.0), F.col("features")[0] * 2)))


def _inflation_sql() -> str:
    """The correlation matrix swept by one column after the other; a column that those before explain isn't swept."""
    steps, sweeps = [*range(64), 65], ""  # column 64 is constant
    for n, k in enumerate(steps):
        sweeps += f""",
s{n + 1} AS MATERIALIZED (SELECT a.i, a.j, CASE WHEN d.v <= 1e-9 THEN a.v WHEN a.i = {k} AND a.j = {k} THEN -1 / d.v WHEN a.i = {k} OR a.j = {k} THEN a.v / d.v ELSE a.v - b.v * c.v / d.v END AS v,
  a.done OR (a.i = {k} AND d.v > 1e-9) AS done FROM s{n} a JOIN s{n} b ON b.i = a.i AND b.j = {k} JOIN s{n} c ON c.i = {k} AND c.j = a.j JOIN s{n} d ON d.i = {k} AND d.j = {k})"""
    return f"""
WITH x AS (SELECT vec_id, list_concat(list_transform(embedding, lambda e: CAST(e AS DOUBLE)), [CAST(1 AS DOUBLE), 2 * CAST(embedding[1] AS DOUBLE)]) AS w FROM embeddings),
n AS (SELECT CAST(unnest(range({_WIDTH})) AS INTEGER) AS i), p AS (SELECT a.i, b.i AS j FROM n a, n b WHERE a.i <> 64 AND b.i <> 64),
v AS (SELECT i, j, w[i + 1] AS a, w[j + 1] AS b FROM x, p), s0 AS MATERIALIZED (SELECT i, j, covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) AS v, false AS done FROM v GROUP BY i, j){sweeps},
t AS (SELECT i, bool_or(done AND i = j) AS done FROM s{len(steps)} GROUP BY i), bound AS (SELECT s.i, max(abs(v)) > sqrt(1e-9) AS bound FROM s{len(steps)} s JOIN t ON s.j = t.i AND NOT t.done WHERE s.i <> s.j GROUP BY s.i),
r AS (SELECT t.i, NOT t.done OR coalesce(bound, false) AS dependent, -v AS inflation FROM t JOIN s{len(steps)} s ON s.i = t.i AND s.j = t.i LEFT JOIN bound ON bound.i = t.i)
SELECT n.i AS place, CASE WHEN NOT dependent THEN round(inflation, 6) END AS inflation, coalesce(dependent, false) AS dependent, NOT coalesce(dependent OR inflation > 1.3, false) AS kept FROM n LEFT JOIN r ON n.i = r.i
"""


@query(_inflation_sql())
def inflation_verdicts(spark, d):
    return _six(features.inflation_report(_with_odd_columns(embedding_rows(spark, d)), "features", _WIDTH, most=1.3), "inflation")


@query()
def sparse_path_points(spark, d):
    df = embedding_rows(spark, d)
    path = search.sparse_path(df, folds.outer_folds(df, n_splits=5))
    return spark.createDataFrame([(p["c"], p["nonzero"], p["score"]) for p in path], "c double, nonzero int, score double")


@query()
def multicollinearity_survivors(spark, d):
    left = pipelines.multicollinearity_filter(_with_odd_columns(embedding_rows(spark, d)), [f"var_{k}" for k in range(_WIDTH)])
    return spark.createDataFrame([(k, f) for k, f in enumerate(left)], "place int, feature string")


@query()
def fan_out_predictions(spark, d):
    """Two feature sets, four families and three folds as one table of tasks; every row of the embeddings is scored by each."""
    df = embedding_rows(spark, d)
    members = fanout.plain_split(folds.outer_folds(df, n_splits=3))
    specs = [("logistic", '{"C": 0.1}'), ("extra_trees", '{"n_estimators": 16}'), ("lightgbm", '{"n_estimators": 20, "subsample": 0.8}'), ("ranker", '{"n_estimators": 10}')]
    sets = [list(range(64)), list(range(0, 64, 2))]
    rows = [(100 * s + 10 * m + f, 0, f, family, params, places) for s, places in enumerate(sets) for m, (family, params) in enumerate(specs) for f in (1, 2, 3)]
    return fanout.predictions_of(fanout.fan_out(df, members, spark.createDataFrame(rows, fanout.TASKS)))


@query("""WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, round(CAST(embedding[1] AS DOUBLE), 2) AS score FROM embeddings),
g AS (SELECT score, sum(y) AS t, count(*) AS n, row_number() OVER (ORDER BY score) AS i FROM v GROUP BY score), c AS (SELECT i, score, sum(t) OVER (ORDER BY i) AS ct, sum(n) OVER (ORDER BY i) AS cn, t, n FROM g),
m AS (SELECT a.i AS j, b.i AS k, CAST(b.ct - a.ct + a.t AS DOUBLE) / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON b.i >= a.i), l AS (SELECT j, k AS i, min(mean) OVER (PARTITION BY j ORDER BY k DESC) AS low FROM m),
f AS (SELECT i, max(low) AS value FROM l GROUP BY i) SELECT id, y, round(value, 6) AS score FROM v JOIN g ON v.score = g.score JOIN f ON f.i = g.i""")
def calibrated_scores(spark, d):
    df = embedding_rows(spark, d).select("id", "y", F.round(F.col("features")[0], 2).alias("score"))
    return _six(isotonic.calibrated(df, df), "score")


@query()
def final_refit(spark, d):
    """A finalist refitted on all rows, and all rows ranked by it: 400 trees of depth 5 and leaves of 16 on six features."""
    df = pipelines.narrowed(embedding_rows(spark, d), [f"var_{k}" for k in range(6)])
    return models.select_and_score(df, df, models.extra_trees(trees=400, depth=5, leaf=16), k=1000)


@query()
def sparse_additive_ranking(spark, d):
    scores = models.spline_feature_scores(embedding_rows(spark, d))
    return spark.createDataFrame([(f"var_{k}", float(s)) for k, s in enumerate(scores)], "feature string, raw_score double")


@query()
def pair_difference_rows(spark, d):
    return models.pair_differences(embedding_rows(spark, d)).select("id", "y", F.size("features").alias("features"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query()
def split_count_selection(spark, d):
    """The univariate filter: places in mutual information and in the splits of leaf-wise trees."""
    kept = pipelines.univariate_filter(embedding_rows(spark, d), keep=20)
    return spark.createDataFrame(list(enumerate(kept)), "place int, feature string")


@query("""WITH v AS (SELECT vec_id AS id, label AS c, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS w FROM embeddings WHERE label IS NOT NULL),
d AS (SELECT a.id, a.c AS own, b.c AS c, sum(list_distance(a.w, b.w)) AS total, count(*) AS n FROM v a JOIN v b ON a.id <> b.id GROUP BY a.id, a.c, b.c),
m AS (SELECT id, max(CASE WHEN c = own THEN total / n END) AS a, min(CASE WHEN c <> own THEN total / n END) AS b FROM d GROUP BY id)
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM m""")
def label_silhouette(spark, d):
    """How well the labels of the embeddings part them, by the distances between all of them."""
    labelled = embedding_rows(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label").alias("cluster")), "id")
    return spark.createDataFrame([(round(segments.silhouette(labelled), 6),)], "silhouette double")


@query()
def segment_diagnostics(spark, d):
    """Ten starts of each number of segments, fitted in the same passes over all embeddings."""
    return _six(segments.kmeans_diagnostics(embedding_rows(spark, d), range(2, 9)), "inertia", "silhouette")
