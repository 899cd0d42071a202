"""Registered queries: each operator on the provided tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import curves, features, folds, metrics, models, pipelines, rankings, recipes, scoring, selection
from .frames import (
    LONG, METHODS, ORDERS, PREDICTIONS, PRESCREENS, PROBABILITY, RANKED, RAW, SIZES, by_probability, embedding_long, embedding_rows, ordered_methods, predictions, ranked_sizes, raw_rankings, scored_orders, table,
)
from .frames import rankings as long_rankings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _six(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to six places, as both engines add up in their own order."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


# --- curves ---------------------------------------------------------------------------------------------------------


def _curve_sql(src: str, cap: int, groups: str = "", name: str = "c") -> str:
    """CTEs r and ``name``: rank, and cumulated hits and misses, of a relation with id, y, score."""
    by, g = (f"PARTITION BY {groups} ", f"{groups}, ") if groups else ("", "")
    return f"""r_{name} AS (SELECT {g}id, y, score, row_number() OVER ({by}ORDER BY score DESC, id DESC) AS k FROM {src}),
{name} AS (SELECT {g}CAST(k AS BIGINT) AS k, CAST(sum(y) OVER ({by}ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
  CAST(sum(1 - y) OVER ({by}ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp, score AS threshold FROM r_{name} WHERE k <= {cap})"""


def _zero_sql(src: str, groups: str = "", name: str = "c") -> str:
    g = f"{groups}, " if groups else ""
    keys = f"(SELECT DISTINCT {groups} FROM {src})" if groups else "(SELECT 1)"
    return f"{name}0 AS (SELECT {g}k, tp, fp, threshold FROM {name} UNION ALL SELECT {g}0, 0, 0, NULL FROM {keys})"


SCORE2 = "CAST(10 * tp - 5 * fp - 400 AS BIGINT) AS business_score"


@query(f"WITH {ORDERS}, {_curve_sql('s', 1000)} SELECT k, tp, fp, threshold, {SCORE2} FROM c")
def profit_curve(spark, d):
    return curves.profit_curve(scored_orders(spark, d), features=2)


@query(f"WITH {ORDERS}, {_curve_sql('s', 200, 'grp')} SELECT grp, k, tp, fp, threshold, {SCORE2} FROM c")
def profit_curve_by_group(spark, d):
    return curves.profit_curve(scored_orders(spark, d), ["grp"], features=2, cap=200)


@query(f"WITH {ORDERS}, {_curve_sql('s', 1000)}, {_zero_sql('s')} SELECT k, tp, fp, threshold, {SCORE2} FROM c0")
def topk_curve_k0(spark, d):
    return curves.profit_curve(scored_orders(spark, d), features=2, zero=True)


@query(f"""WITH {ORDERS}, {_curve_sql('s', 1000, 'grp')}, {_zero_sql('s', 'grp')}, b AS (SELECT grp, k, tp, fp, threshold, {SCORE2} FROM c0)
SELECT grp, k, tp, fp, threshold, business_score FROM b QUALIFY row_number() OVER (PARTITION BY grp ORDER BY business_score DESC, k) = 1""")
def capped_best_k0(spark, d):
    return curves.capped_best(scored_orders(spark, d), ["grp"], features=2)


_EFFECTIVE = f"""{PROBABILITY}, {_curve_sql('q', 1000, 'grp')}, b AS (SELECT grp, k, tp, fp, threshold, {SCORE2} FROM c),
p AS (SELECT grp, k AS profit_k FROM b QUALIFY row_number() OVER (PARTITION BY grp ORDER BY business_score DESC, k) = 1),
e AS (SELECT grp, CAST(least(count(*) FILTER (WHERE score >= 1.0::DOUBLE / 3.0::DOUBLE), 1000) AS BIGINT) AS breakeven_k FROM q GROUP BY grp),
z AS (SELECT p.grp, profit_k, breakeven_k, CASE WHEN breakeven_k > 0 THEN least(profit_k, breakeven_k) ELSE profit_k END AS effective_k FROM p JOIN e ON p.grp = e.grp)"""


@query(f"WITH {_EFFECTIVE} SELECT z.grp, profit_k, breakeven_k, effective_k, tp, fp, business_score, threshold FROM z JOIN b ON z.grp = b.grp AND b.k = z.effective_k")
def profit_curve_effective_k(spark, d):
    return curves.effective_point(by_probability(scored_orders(spark, d)), ["grp"], features=2)


@query(f"""WITH {ORDERS}, {_curve_sql('s', 500)}, n AS (SELECT count(*) AS n FROM s)
SELECT k, tp, fp, threshold, round((10 * tp - 5 * fp) * (n / 1000.0::DOUBLE), 6) AS gross, round(n / 1000.0::DOUBLE, 6) AS scale, round((10 * tp - 5 * fp - 400) * (n / 1000.0::DOUBLE), 6) AS scaled_score,
  round((10 * tp - 5 * fp) * (n / 1000.0::DOUBLE) - 400, 6) AS unscaled_cost_score FROM c, n""")
def scaled_curve(spark, d):
    return _six(curves.scaled_curve(scored_orders(spark, d), features=2, cap=500), "gross", "scale", "scaled_score", "unscaled_cost_score")


@query(f"""WITH {ORDERS}, {_curve_sql('s', 1000, 'grp')}, a AS (SELECT unnest([0, 10, 100, 500]) AS asked_k),
x AS (SELECT grp, asked_k, count(*) FILTER (WHERE k <= asked_k AND y = 1) AS tp, count(*) FILTER (WHERE k <= asked_k AND y = 0) AS fp FROM r_c, a GROUP BY grp, asked_k)
SELECT grp, CAST(asked_k AS BIGINT) AS asked_k, tp, fp, tp + fp AS k, {SCORE2} FROM x""")
def exact_score_at_k(spark, d):
    return curves.score_at(scored_orders(spark, d), [0, 10, 100, 500], ["grp"], features=2)


@query(f"""WITH {PROBABILITY}, t AS (SELECT * FROM q WHERE score >= 0.5 ORDER BY score DESC, id DESC LIMIT 1000), x AS (SELECT count(*) FILTER (WHERE y = 1) AS tp, count(*) FILTER (WHERE y = 0) AS fp FROM t)
SELECT tp, fp, {SCORE2} FROM x""")
def threshold_score(spark, d):
    return curves.threshold_score(by_probability(scored_orders(spark, d)), 0.5, features=2)


_RATE = "round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0), 6)"


@query(f"""WITH {ORDERS}, {_curve_sql('s', 1000)}, n AS (SELECT count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM s),
f AS (SELECT k, tp, fp, pos - tp AS fn, neg - fp AS tn, pos, neg, coalesce(CAST(tp AS DOUBLE) / nullif(k, 0), 0) AS pr, coalesce(CAST(tp AS DOUBLE) / nullif(pos, 0), 0) AS re, threshold FROM c, n)
SELECT k, tp, fp, fn, tn, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1,
  {_RATE.format(a='tp + tn', b='pos + neg')} AS accuracy, {_RATE.format(a='tn', b='neg')} AS specificity, threshold FROM f""")
def f1_curve(spark, d):
    return _six(curves.f1_curve(scored_orders(spark, d)), "precision", "recall", "f1", "accuracy", "specificity")


def _auc_sql(src: str, groups: str = "") -> str:
    by, g = (f"PARTITION BY {groups} ", f"{groups}, ") if groups else ("", "")
    end = f"GROUP BY {groups}" if groups else ""
    return f"""ct AS (SELECT {g}score, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY {g}score),
cm AS (SELECT *, sum(neg) OVER ({by}ORDER BY score ROWS UNBOUNDED PRECEDING) AS cn, sum(pos) OVER ({by}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(neg) OVER ({by}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp FROM ct),
auc AS (SELECT {g}CAST(sum(CAST(pos * (cn - neg) AS DOUBLE) + CAST(pos * neg AS DOUBLE) / 2) AS DOUBLE) / nullif(sum(pos) * sum(neg), 0) AS roc_auc,
  sum(CAST(pos AS DOUBLE) * (CAST(tp AS DOUBLE) / (tp + fp))) / nullif(sum(pos), 0) AS average_precision FROM cm {end})"""


@query(f"WITH {ORDERS}, {_auc_sql('s')} SELECT round(roc_auc, 6) AS roc_auc FROM auc")
def roc_auc(spark, d):
    return _six(metrics.roc_auc(scored_orders(spark, d)), "roc_auc")


@query(f"WITH {ORDERS}, {_auc_sql('s', 'grp')} SELECT grp, round(roc_auc, 6) AS roc_auc FROM auc")
def roc_auc_by_group(spark, d):
    return _six(metrics.roc_auc(scored_orders(spark, d), ["grp"]), "roc_auc")


@query(f"WITH {ORDERS}, {_auc_sql('s')} SELECT round(average_precision, 6) AS average_precision FROM auc")
def average_precision(spark, d):
    return _six(metrics.average_precision(scored_orders(spark, d)), "average_precision")


@query(f"WITH {PROBABILITY} SELECT grp, CAST(least(count(*) FILTER (WHERE score >= 0.4), 1000) AS BIGINT) AS breakeven_k FROM q GROUP BY grp")
def break_even_k(spark, d):
    return curves.break_even_k(by_probability(scored_orders(spark, d)), ["grp"], floor=0.4)


@query(f"""WITH {ORDERS}, {_curve_sql('s', 1000, 'grp')}, b AS (SELECT grp, k, 10 * tp - 5 * fp AS business_score FROM c), m AS (SELECT grp, max(business_score) AS best FROM b GROUP BY grp)
SELECT b.grp, coalesce(min(k) FILTER (WHERE business_score >= 0.95::DOUBLE * best), 0) AS elbow_k FROM b JOIN m ON b.grp = m.grp GROUP BY b.grp""")
def elbow_k(spark, d):
    s = scored_orders(spark, d)
    return curves.elbow_k(curves.profit_curve(s, ["grp"], features=0), ["grp"])


# --- folds ----------------------------------------------------------------------------------------------------------


def _folds_sql(src: str = "s") -> str:
    return f"""o AS (SELECT id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) - 1) % 5 + 1 AS INTEGER) AS outer_fold FROM {src}),
iw AS (SELECT o.id, o.y, f.outer_fold FROM o JOIN (SELECT DISTINCT outer_fold FROM o) f ON o.outer_fold <> f.outer_fold),
i AS (SELECT outer_fold, id, y, CAST((row_number() OVER (PARTITION BY outer_fold, y ORDER BY md5(CAST(42 + 1009 * outer_fold AS VARCHAR) || ':' || CAST(id AS VARCHAR)), id) - 1) % 4 + 1 AS INTEGER) AS inner_fold FROM iw)"""


_FOLDS = _folds_sql()
_COMPLEMENT = """SELECT {k}, CAST(sum(val_n) OVER w - val_n AS BIGINT) AS train_n, CAST(sum(val_pos) OVER w - val_pos AS BIGINT) AS train_pos,
round(coalesce(CAST(sum(val_pos) OVER w - val_pos AS DOUBLE) / nullif(sum(val_n) OVER w - val_n, 0), 0), 6) AS train_rate, val_n, val_pos, round(coalesce(CAST(val_pos AS DOUBLE) / nullif(val_n, 0), 0), 6) AS val_rate FROM v WINDOW w AS ({w})"""


@query(f"WITH {ORDERS}, {_folds_sql()} SELECT id, outer_fold FROM o")
def outer_folds(spark, d):
    return folds.outer_folds(scored_orders(spark, d))


@query(f"WITH {ORDERS}, {_folds_sql()} SELECT outer_fold, id, inner_fold FROM i")
def inner_folds(spark, d):
    s = scored_orders(spark, d)
    return folds.inner_folds(s, folds.outer_folds(s), n_splits=4)


@query(f"WITH {ORDERS}, {_folds_sql()}, v AS (SELECT outer_fold, count(*) AS val_n, CAST(sum(y) AS BIGINT) AS val_pos FROM o GROUP BY outer_fold) {_COMPLEMENT.format(k='outer_fold', w='')}")
def outer_fold_summary(spark, d):
    s = scored_orders(spark, d)
    return _six(folds.summarise_outer(s, folds.outer_folds(s)), "train_rate", "val_rate")


@query(
    f"WITH {ORDERS}, {_folds_sql()}, v AS (SELECT outer_fold, inner_fold, count(*) AS val_n, CAST(sum(y) AS BIGINT) AS val_pos FROM i GROUP BY outer_fold, inner_fold) {_COMPLEMENT.format(k='outer_fold, inner_fold', w='PARTITION BY outer_fold')}"
)
def inner_fold_summary(spark, d):
    s = scored_orders(spark, d)
    return _six(folds.summarise_inner(s, folds.inner_folds(s, folds.outer_folds(s), n_splits=4)), "train_rate", "val_rate")


@query(
    "SELECT unnest(['outer_missing', 'outer_extra', 'outer_repeated', 'inner_repeated', 'inner_holds_outer_validation', 'inner_incomplete']) AS name, CAST(0 AS BIGINT) AS violations"
)
def split_integrity(spark, d):
    s = scored_orders(spark, d)
    outer = folds.outer_folds(s)
    return folds.split_integrity(outer, folds.inner_folds(s, outer, n_splits=4), s)


@query(f"WITH {ORDERS} SELECT id, CAST(floor(CAST((row_number() OVER (PARTITION BY y ORDER BY id) - 1) * 5 AS DOUBLE) / count(*) OVER (PARTITION BY y)) + 1 AS INTEGER) AS fold FROM s")
def contiguous_folds(spark, d):
    return folds.contiguous_folds(scored_orders(spark, d))


@query(f"WITH {ORDERS}, {_folds_sql()} SELECT s.id, s.y FROM s JOIN o ON s.id = o.id WHERE outer_fold <> 2")
def outer_train_rows(spark, d):
    s = scored_orders(spark, d)
    return folds.outer_part(s, folds.outer_folds(s), 2, train=True).select("id", "y")


@query(f"""WITH {ORDERS}, {_folds_sql()}, z AS (SELECT s.*, outer_fold AS fold FROM s JOIN o ON s.id = o.id), {_curve_sql('z', 400, 'fold')}, a AS (SELECT unnest([10, 100, 400]) AS asked_k),
x AS (SELECT fold, asked_k, 10 * count(*) FILTER (WHERE k <= asked_k AND y = 1) - 5 * count(*) FILTER (WHERE k <= asked_k AND y = 0) - 200 AS sc FROM r_c, a GROUP BY fold, asked_k)
SELECT CAST(asked_k AS BIGINT) AS k, round(avg(CAST(sc AS DOUBLE)), 6) AS mean_score FROM x GROUP BY asked_k""")
def nested_cv_k(spark, d):
    s = scored_orders(spark, d)
    return _six(curves.fold_grid_k(s.join(folds.outer_folds(s).withColumnRenamed("outer_fold", "fold"), "id"), [10, 100, 400], features=1), "mean_score")


# --- targeting ------------------------------------------------------------------------------------------------------


@query(f"WITH {ORDERS} SELECT id, round(10 * p - 5 * (1 - p), 9) AS expected_value FROM s")
def ev_per_contact(spark, d):
    return scored_orders(spark, d).select("id", F.round(curves.expected_value(F.col("p")), 9).alias("expected_value"))


@query(f"""WITH {PROBABILITY}, t AS (SELECT * FROM q WHERE score >= 0.3 ORDER BY score DESC, id DESC LIMIT 250)
SELECT CAST(row_number() OVER (ORDER BY score DESC, id DESC) AS BIGINT) AS rank, id, score, round(10 * score - 5 * (1 - score), 9) AS expected_value FROM t""")
def rank_test_floor(spark, d):
    return curves.select_targets(by_probability(scored_orders(spark, d)), 250, floor=0.3).withColumn("expected_value", F.round("expected_value", 9))


@query(f"""WITH {PROBABILITY}, t AS (SELECT * FROM q WHERE score >= 0.3 ORDER BY score DESC, id DESC LIMIT 1000)
SELECT CAST(5000 AS BIGINT) AS requested, CAST(1000 AS BIGINT) AS allowed, (SELECT count(*) FROM q WHERE score >= 0.3) AS eligible, count(*) AS selected, min(score) AS lowest_score FROM t""")
def target_diagnostics(spark, d):
    return curves.target_diagnostics(by_probability(scored_orders(spark, d)), 5000, floor=0.3)


@query(f"""WITH {ORDERS}, r AS (SELECT y, row_number() OVER (ORDER BY score DESC, id DESC) <= 300 AS hit FROM s), g AS (SELECT * FROM (VALUES (1, 1), (0, 1), (1, 0), (0, 0)) t(actual, predicted))
SELECT actual, predicted, count(y) AS n FROM g LEFT JOIN r ON r.y = actual AND r.hit = (predicted = 1) GROUP BY actual, predicted""")
def confusion_at_k(spark, d):
    return curves.confusion_at(scored_orders(spark, d), 300)


_BANDS = f"""{ORDERS}, r AS (SELECT y, row_number() OVER (ORDER BY score DESC, id DESC) AS k FROM s),
b AS (SELECT CAST(((k - 1) // 99) + 1 AS BIGINT) AS band, count(*) AS n, CAST(sum(y) AS BIGINT) AS tp, CAST(sum(1 - y) AS BIGINT) AS fp FROM r WHERE k <= 997 GROUP BY 1 HAVING band <= 10)"""


@query(f"WITH {_BANDS} SELECT band, n, tp, fp, round(CAST(tp AS DOUBLE) / n, 6) AS precision, round(CAST(fp AS DOUBLE) / n, 6) AS fp_rate FROM b")
def score_bands(spark, d):
    return _six(curves.score_bands(scored_orders(spark, d), 997), "precision", "fp_rate")


@query(f"WITH {_BANDS} SELECT band, n, fp, round(CAST(sum(fp) OVER (ORDER BY band) AS DOUBLE) / sum(n) OVER (ORDER BY band), 6) AS cumulative_fp_rate FROM b")
def cumulative_fp_rate(spark, d):
    return _six(curves.cumulative_fp_rate(curves.score_bands(scored_orders(spark, d), 997)), "cumulative_fp_rate")


@query(f"""WITH {ORDERS}, t AS (SELECT * FROM s ORDER BY score DESC, id DESC LIMIT 500) SELECT CAST(row_number() OVER (ORDER BY score DESC, id DESC) AS BIGINT) AS rank, id, score FROM t""")
def rank_test_customers(spark, d):
    return selection.top_targets(scored_orders(spark, d), 500)


@query(f"""WITH {ORDERS}, t AS (SELECT * FROM s ORDER BY score DESC, id DESC LIMIT 100) SELECT CAST(row_number() OVER (ORDER BY score DESC, id DESC) AS BIGINT) AS rank, CAST(id + 1 AS VARCHAR) AS line FROM t""")
def submission_ids(spark, d):
    return selection.top_targets(scored_orders(spark, d), 100).select("rank", (F.col("id") + 1).cast("string").alias("line"))


# --- rankings -------------------------------------------------------------------------------------------------------


@query(f"WITH {RANKED} SELECT feature, method, raw_score, rank, round(CAST(rank_score AS DOUBLE), 6) AS rank_score FROM nr")
def normalized_ranks(spark, d):
    return _six(long_rankings(spark, d), "rank_score")


_CORR = "CASE WHEN stddev_pop(value) * stddev_pop(y) <> 0 THEN covar_pop(value, y) / (stddev_pop(value) * stddev_pop(y)) END"


@query(f"WITH {LONG} SELECT feature, round(coalesce(abs({_CORR}), 0), 6) AS abs_corr FROM l GROUP BY feature")
def abs_corr_ranking(spark, d):
    return _six(rankings.abs_corr(embedding_long(spark, d)), "abs_corr")


@query(f"""WITH {LONG}, cu AS (SELECT feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM l GROUP BY feature),
b AS (SELECT l.feature, y, len(list_filter(cuts, lambda c: c < value)) AS bin FROM l JOIN cu ON l.feature = cu.feature), n AS (SELECT feature, bin, y, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS nn FROM n)
SELECT feature, round(sum(n / nn * ln(n * nn / (nb * ny))), 4) AS mutual_info FROM w GROUP BY feature""")
def binned_mi_ranking(spark, d):
    return rankings.binned_mutual_information(embedding_long(spark, d)).withColumn("mutual_info", F.round("mutual_info", 4))


_COMBINED = """cb AS (SELECT feature, avg(rank_score) AS es, avg(rank) AS mr, max(rank_score) FILTER (WHERE method = 'variance') AS v, max(rank_score) FILTER (WHERE method = 'peak') AS p,
max(rank_score) FILTER (WHERE method = 'centre') AS c FROM (SELECT feature, method, rank, round(CAST(rank_score AS DOUBLE), 9) AS rank_score FROM nr) GROUP BY feature)"""


@query(f"""WITH {RANKED}, {_COMBINED} SELECT feature, round(es, 6) AS ensemble_score, round(mr, 6) AS mean_rank, round(v, 6) AS score__variance, round(p, 6) AS score__peak, round(c, 6) AS score__centre FROM cb""")
def combined_ranking(spark, d):
    out = _six(rankings.combined_ranking(long_rankings(spark, d), METHODS), "ensemble_score", "mean_rank", *(f"score__{m}" for m in METHODS))
    return out.drop("order")


@query(f"""WITH {RANKED}, w AS (SELECT * FROM (VALUES ('variance', 2.0::DOUBLE), ('peak', 1.0::DOUBLE), ('centre', 1.0::DOUBLE)) t(method, weight))
SELECT feature, round(sum(weight / 4 * CAST(rank_score AS DOUBLE)), 6) AS ensemble_score, round(sum(weight / 4 * rank), 6) AS mean_rank FROM nr JOIN w ON nr.method = w.method GROUP BY feature""")
def weighted_ranking(spark, d):
    weights = spark.createDataFrame([("variance", 2.0), ("peak", 1.0), ("centre", 1.0), ("other", -1.0)], "method string, weight double")
    return _six(rankings.weighted_ranking(long_rankings(spark, d), weights), "ensemble_score", "mean_rank").drop("order")


@query(f"""WITH {RANKED}, t AS (SELECT method, rank_score FROM nr QUALIFY row_number() OVER (PARTITION BY method ORDER BY rank, feature) <= 25), v AS (SELECT method, avg(CAST(rank_score AS DOUBLE)) AS value FROM t GROUP BY method),
h AS (SELECT method, CASE WHEN max(value) OVER () = min(value) OVER () THEN 1.0::DOUBLE ELSE value - min(value) OVER () END AS h FROM v),
w AS (SELECT method, h + 0.05::DOUBLE * greatest(avg(h) OVER (), 1.0::DOUBLE) AS w FROM h) SELECT method, round(w / sum(w) OVER (), 6) AS weight FROM w""")
def train_only_weights(spark, d):
    return _six(rankings.train_only_weights(long_rankings(spark, d)), "weight")


@query(f"""WITH {RANKED}, mb AS (SELECT * FROM (VALUES ('single__variance', 'variance'), ('single__peak', 'peak'), ('single__centre', 'centre'), ('pair__variance__peak', 'variance'), ('pair__variance__peak', 'peak'),
('pair__variance__centre', 'variance'), ('pair__variance__centre', 'centre'), ('pair__peak__centre', 'peak'), ('pair__peak__centre', 'centre'), ('triple__variance__peak__centre', 'variance'),
('triple__variance__peak__centre', 'peak'), ('triple__variance__peak__centre', 'centre')) t(ensemble, method))
SELECT ensemble, feature, round(avg(CAST(rank_score AS DOUBLE)), 6) AS ensemble_score, round(avg(rank), 6) AS mean_rank FROM nr JOIN mb ON nr.method = mb.method GROUP BY ensemble, feature""")
def all_k_ensembles(spark, d):
    return _six(rankings.all_ensembles(long_rankings(spark, d), METHODS), "ensemble_score", "mean_rank").drop("order")


def _variance_order(spark, d) -> DataFrame:
    from pyspark.sql import Window

    raw = raw_rankings(spark, d).where("method = 'variance'")
    return raw.select("feature", F.row_number().over(Window.orderBy(F.desc("raw_score"), "feature")).cast("long").alias("order"))


@query(f"""WITH {RAW}, o AS (SELECT feature, row_number() OVER (ORDER BY raw_score DESC, feature) AS ord FROM raw WHERE method = 'variance'), z AS (SELECT unnest([1, 3, 5, 10, 64]) AS size)
SELECT 'top_' || lpad(CAST(size AS VARCHAR), 2, '0') AS set_name, CAST(size AS BIGINT) AS size, string_agg(feature, ',' ORDER BY ord) AS features FROM o, z WHERE ord <= size GROUP BY size""")
def top_k_sets(spark, d):
    return rankings.prefix_sets(_variance_order(spark, d), [1, 3, 5, 10]).withColumn("features", F.array_join("features", ","))


@query(f"""WITH {LONG}, sg AS (SELECT feature, CASE WHEN coalesce({_CORR}, 0) < 0 THEN -1.0 ELSE 1.0 END AS sign FROM l WHERE id % 2 = 0 GROUP BY feature), t AS (SELECT * FROM l WHERE id % 2 = 1),
r AS (SELECT t.id, count(*) OVER (PARTITION BY t.feature) + 1 - row_number() OVER (PARTITION BY t.feature ORDER BY t.value * sign, t.id) AS pts FROM t JOIN sg ON t.feature = sg.feature),
p AS (SELECT id, avg(CAST(pts AS DOUBLE)) AS points FROM r GROUP BY id)
SELECT id, round((points - min(points) OVER ()) / (max(points) OVER () - min(points) OVER () + 1e-12), 6) AS score FROM p""")
def borda_scores(spark, d):
    long = embedding_long(spark, d)
    return _six(rankings.borda_scores(long.where("id % 2 = 0"), long.where("id % 2 = 1").drop("y")), "score")


@query(f"""WITH {ORDERS}, e AS (SELECT 'a' AS expert, id, p AS score FROM s UNION ALL SELECT 'b', id, 1 - p FROM s), w AS (SELECT * FROM (VALUES ('a', 0.25::DOUBLE), ('b', 0.75::DOUBLE)) t(expert, weight))
SELECT id, round(sum(weight * score), 9) AS score FROM e JOIN w ON e.expert = w.expert GROUP BY id""")
def fused_scores(spark, d):
    s = scored_orders(spark, d)
    experts = s.select(F.lit("a").alias("expert"), "id", F.col("p").alias("score")).unionByName(s.select(F.lit("b").alias("expert"), "id", (1 - F.col("p")).alias("score")))
    weights = rankings.fusion_weights(spark.createDataFrame([("a", 100.0), ("b", 300.0)], "expert string, cv_mean double"))
    return rankings.fused_scores(experts, weights).withColumn("score", F.round("score", 9))


@query(f"""WITH {PREDICTIONS}, x AS (SELECT pipeline_recipe_id AS config, sample_index AS id, score FROM pr), r AS (SELECT id, (rank() OVER (PARTITION BY config ORDER BY score) + (count(*) OVER (PARTITION BY config, score) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY config) AS pct FROM x),
m AS (SELECT id, round(avg(pct), 9) AS mean_rank FROM r GROUP BY id), t AS (SELECT * FROM m ORDER BY mean_rank DESC, id DESC LIMIT 100) SELECT id, round(mean_rank, 6) AS mean_rank FROM t""")
def rank_mean_ensemble(spark, d):
    p = predictions(spark, d).select(F.col("pipeline_recipe_id").alias("config"), F.col("sample_index").alias("id"), "score")
    return _six(rankings.rank_mean_ensemble(p, top=100), "mean_rank").drop("rank")


@query(f"""WITH {RAW}, a AS (SELECT feature, row_number() OVER (ORDER BY raw_score DESC, feature) - 1 AS pa FROM raw WHERE method = 'variance'), b AS (SELECT feature, row_number() OVER (ORDER BY raw_score DESC, feature) - 1 AS pb FROM raw WHERE method = 'peak')
SELECT a.feature, CAST(pa + pb AS BIGINT) AS combined FROM a JOIN b ON a.feature = b.feature""")
def combined_rank_sum(spark, d):
    raw = raw_rankings(spark, d).withColumnRenamed("raw_score", "score")
    return rankings.rank_sum(raw.where("method = 'variance'"), raw.where("method = 'peak'"))


# --- recipes --------------------------------------------------------------------------------------------------------


def _space(spark: SparkSession, d: str) -> DataFrame:
    return recipes.pipeline_recipes(recipes.prescreen_recipes(spark, ordered_methods(spark, d)), recipes.feature_sizes(spark, ranked_sizes(spark, d)), recipes.model_specs(spark, recipes.default_model_specs()))


@query(f"""WITH {PRESCREENS}, {SIZES} SELECT f AS base_model_family, CAST(s AS INTEGER) AS feature_size, CAST(m * ((SELECT count(*) FROM px) + 2) AS BIGINT) AS recipes FROM
(VALUES ('extra_trees', 8), ('random_forest', 6), ('lightgbm', 8), ('xgboost', 8), ('logistic', 6), ('additive', 3), ('ranker', 3)) t(f, m), sz""")
def recipe_space_summary(spark, d):
    return recipes.space_summary(_space(spark, d))


@query(f"""WITH {PRESCREENS}, {SIZES}, n AS (SELECT CAST(((SELECT count(*) FROM px) + 2) * (SELECT count(*) FROM sz) * 42 AS BIGINT) AS n)
SELECT n AS recipes, n AS ids, 'pipe_0000001' AS first_id, 'pipe_' || lpad(CAST(n AS VARCHAR), 7, '0') AS last_id FROM n""")
def recipe_space(spark, d):
    return _space(spark, d).agg(F.count("*").alias("recipes"), F.count_distinct("pipeline_recipe_id").alias("ids"), F.min("pipeline_recipe_id").alias("first_id"), F.max("pipeline_recipe_id").alias("last_id"))


@query(f"WITH {PRESCREENS} SELECT id AS prescreen_recipe_id, name AS prescreen_name, n AS prescreen_method_count FROM px")
def prescreen_recipes(spark, d):
    return recipes.filter_prescreens(recipes.prescreen_recipes(spark, ordered_methods(spark, d)), adaptive=False).select("prescreen_recipe_id", "prescreen_name", "prescreen_method_count")


@query(f"WITH {PRESCREENS} SELECT method, place FROM mo")
def required_methods(spark, d):
    return recipes.required_methods(recipes.prescreen_recipes(spark, ordered_methods(spark, d)).where("NOT adaptive"))


# --- experiment scoring ---------------------------------------------------------------------------------------------

_KEYS = "outer_fold, round_name, pipeline_recipe_id"
_INNER = f"""{PREDICTIONS}, ky AS (SELECT {_KEYS}, sample_index AS id, y_true AS y, score FROM pr), {_curve_sql('ky', 1000, _KEYS)}, {_zero_sql('ky', _KEYS)},
pt AS (SELECT *, 10 * tp - 5 * fp AS gross FROM c0 QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY 10 * tp - 5 * fp DESC, k) = 1),
mt AS (SELECT {_KEYS}, max(feature_size) AS feature_size, count(*) AS n, count(DISTINCT inner_fold) AS inner_folds FROM pr GROUP BY {_KEYS}), {_auc_sql('ky', _KEYS)},
f1 AS (SELECT {_KEYS}, max(coalesce(2.0::DOUBLE * tp / nullif(k + pos, 0), 0)) FILTER (WHERE pos > 0 AND neg > 0) AS f1_score FROM c JOIN (SELECT {_KEYS}, sum(y) AS pos, sum(1 - y) AS neg FROM ky GROUP BY {_KEYS}) USING ({_KEYS}) GROUP BY {_KEYS}),
sc AS (SELECT {_KEYS}, feature_size, n, inner_folds, k AS oof_k, CAST(gross AS BIGINT) AS gross_score, feature_size * 200 AS feature_penalty, CAST(gross - feature_size * 200 AS BIGINT) AS oof_score,
  round(CAST(k AS DOUBLE) / n, 6) AS contact_rate, threshold, round(roc_auc, 6) AS roc_auc, tp, fp, round(f1_score, 6) AS f1_score, 'ok' AS status FROM pt JOIN mt USING ({_KEYS}) LEFT JOIN auc USING ({_KEYS}) LEFT JOIN f1 USING ({_KEYS}))"""


def _scores(spark, d) -> DataFrame:
    return _six(scoring.inner_scores(predictions(spark, d), check=False), "contact_rate", "roc_auc", "f1_score")


@query(f"WITH {_INNER} SELECT * FROM sc")
def inner_oof_scores(spark, d):
    return _scores(spark, d)


_BASE = f"""{PREDICTIONS}, sm AS (SELECT outer_fold, round_name, sample_index, max(y_true) AS y FROM pr GROUP BY ALL), rn AS (SELECT *, row_number() OVER (PARTITION BY outer_fold, round_name ORDER BY sample_index) AS r FROM sm),
t AS (SELECT outer_fold, round_name, count(*) AS n, coalesce(sum(y) FILTER (WHERE r <= 1000), 0) AS tp, coalesce(sum(1 - y) FILTER (WHERE r <= 1000), 0) AS fp, sum(y) AS atp, sum(1 - y) AS afp FROM rn GROUP BY ALL),
v AS (SELECT * FROM (VALUES ('select_all_0', 0, true), ('select_all_1', 1, true), ('select_all_full_0', 0, false), ('select_all_full_1', 1, false)) v(baseline, n_features, legal)),
b0 AS (SELECT outer_fold, round_name, baseline, n, n_features, legal, CASE WHEN legal THEN tp ELSE atp END AS tp, CASE WHEN legal THEN fp ELSE afp END AS fp FROM t, v WHERE legal OR n > 1000),
bl AS (SELECT outer_fold, round_name, baseline, CAST(NULL AS INTEGER) AS random_repeat, CAST(10 * tp - 5 * fp - 200 * n_features AS BIGINT) AS business_score, CAST(tp + fp AS BIGINT) AS k, n, round(CAST(tp + fp AS DOUBLE) / n, 6) AS contact_rate, n_features,
  CAST(200 * n_features AS BIGINT) AS feature_penalty, CAST(10 * tp - 5 * fp AS BIGINT) AS gross_score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(NULL AS DOUBLE) AS f1_score, CAST(NULL AS DOUBLE) AS roc_auc_score, legal,
  CASE WHEN legal THEN 'ok' ELSE 'illegal_max_targets_exceeded' END AS status FROM b0)"""


@query(f"WITH {_BASE} SELECT * FROM bl")
def select_all_baselines(spark, d):
    return _six(scoring.baselines(predictions(spark, d)), "contact_rate")


@query(
    f"""WITH {_INNER}, {_BASE.split(', sm AS', 1)[1].join(['sm AS', ''])} SELECT sc.outer_fold, sc.pipeline_recipe_id, sc.oof_score, a.business_score AS select_all_0_business_score, b.business_score AS select_all_1_business_score,
sc.oof_score > a.business_score AS beats_select_all_0, sc.oof_score > b.business_score AS beats_select_all_1 FROM sc JOIN bl a ON a.outer_fold = sc.outer_fold AND a.baseline = 'select_all_0' JOIN bl b ON b.outer_fold = sc.outer_fold AND b.baseline = 'select_all_1'"""
)
def baseline_merge(spark, d):
    out = scoring.with_baselines(_scores(spark, d), scoring.baselines(predictions(spark, d)))
    return out.select("outer_fold", "pipeline_recipe_id", "oof_score", "select_all_0_business_score", "select_all_1_business_score", "beats_select_all_0", "beats_select_all_1")


_AGGREGATED = f"""{_INNER}, ag AS (SELECT outer_fold, pipeline_recipe_id, count(*) AS runs, avg(CAST(oof_score AS DOUBLE)) AS mean_score, median(CAST(oof_score AS DOUBLE)) AS median_score, min(CAST(oof_score AS DOUBLE)) AS min_score,
max(CAST(oof_score AS DOUBLE)) AS max_score, stddev_samp(CAST(oof_score AS DOUBLE)) AS std_score, max(feature_size) AS feature_size, round(avg(roc_auc), 6) AS mean_roc_auc,
min(inner_folds) AS inner_folds, avg(CAST(oof_k AS DOUBLE)) AS mean_k, round(avg(f1_score), 6) AS mean_f1, round(avg(contact_rate), 6) AS mean_contact_rate, avg(CAST(gross_score AS DOUBLE)) AS mean_gross_score, avg(CAST(feature_penalty AS DOUBLE)) AS mean_feature_penalty FROM sc GROUP BY outer_fold, pipeline_recipe_id),
ar AS (SELECT *, row_number() OVER (PARTITION BY outer_fold ORDER BY mean_score DESC, mean_roc_auc DESC, feature_size, outer_fold, pipeline_recipe_id) AS inner_selection_rank FROM ag),
wr AS (SELECT * EXCLUDE (inner_selection_rank), row_number() OVER (ORDER BY mean_score DESC, mean_roc_auc DESC, feature_size, outer_fold, pipeline_recipe_id) AS inner_selection_rank FROM ar)"""


def _aggregated(spark, d, scope: str = "outer_fold") -> DataFrame:
    return _six(scoring.aggregate_inner(_scores(spark, d), ["outer_fold", "pipeline_recipe_id"], scope=scope), "mean_roc_auc", "mean_contact_rate", "mean_f1")


@query(f"WITH {_AGGREGATED} SELECT * FROM wr")
def aggregate_inner(spark, d):
    return _aggregated(spark, d, "table")


@query(f"WITH {_AGGREGATED} SELECT * FROM ar")
def aggregate_inner_by_fold(spark, d):
    return _aggregated(spark, d)


@query(f"WITH {_AGGREGATED} SELECT outer_fold, pipeline_recipe_id, inner_selection_rank AS selected_rank FROM wr WHERE inner_selection_rank <= 3")
def top_recipes(spark, d):
    return selection.top_recipes(_aggregated(spark, d, "table"), top=3).select("outer_fold", "pipeline_recipe_id", "selected_rank")


@query(f"WITH {_AGGREGATED} SELECT outer_fold, pipeline_recipe_id, inner_selection_rank AS selected_rank FROM ar WHERE inner_selection_rank <= 2")
def top_recipes_by_fold(spark, d):
    return selection.top_recipes(_aggregated(spark, d), top=2, scope="outer_fold").select("outer_fold", "pipeline_recipe_id", "selected_rank")


@query(f"""WITH {_AGGREGATED}, g AS (SELECT pipeline_recipe_id, avg(mean_score) AS global_mean, median(mean_score) AS global_median, min(mean_score) AS global_min, max(mean_score) AS global_max, max(feature_size) AS feature_size,
  count(DISTINCT outer_fold) AS outer_folds, round(avg(mean_roc_auc), 6) AS global_roc_auc FROM ar GROUP BY pipeline_recipe_id),
t AS (SELECT *, row_number() OVER (ORDER BY global_mean DESC, global_min DESC, outer_folds DESC, feature_size, global_roc_auc DESC, pipeline_recipe_id) AS global_rank FROM g QUALIFY global_rank <= 2)
SELECT t.*, outer_fold FROM t, (SELECT DISTINCT outer_fold FROM ar)""")
def global_candidates(spark, d):
    a = _aggregated(spark, d)
    return _six(selection.global_candidates(a, ["pipeline_recipe_id"], a, top=2, least_runs=1), "global_roc_auc")


@query(f"WITH {_AGGREGATED} SELECT outer_fold, pipeline_recipe_id, feature_size FROM ar WHERE (outer_fold, feature_size) IN ((1, 1), (2, 2))")
def pair_restrict(spark, d):
    pairs = spark.createDataFrame([(1, 1), (2, 2)], "outer_fold int, feature_size long")
    return selection.only_pairs(_aggregated(spark, d), pairs, ["outer_fold", "feature_size"]).select("outer_fold", "pipeline_recipe_id", "feature_size")


_OUTER = f"""{PREDICTIONS}, ou AS (SELECT outer_fold, pipeline_recipe_id AS recipe_config_id, sample_index AS id, y_true AS y, score FROM pr), {_curve_sql('ou', 200, 'outer_fold, recipe_config_id')}, {_zero_sql('ou', 'outer_fold, recipe_config_id')},
lm AS (SELECT c0.*, 10 * tp - 5 * fp AS gross FROM c0 WHERE k <= CASE WHEN outer_fold = 1 THEN 100 ELSE 200 END), op AS (SELECT * FROM lm QUALIFY row_number() OVER (PARTITION BY outer_fold, recipe_config_id ORDER BY gross DESC, k) = 1),
os AS (SELECT outer_fold, recipe_config_id, k, tp, fp, threshold, CAST(CASE WHEN recipe_config_id LIKE 'fr1%' THEN 1 ELSE 2 END AS BIGINT) AS feature_size, gross, CASE WHEN outer_fold = 1 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS sc FROM op),
ob AS (SELECT outer_fold, recipe_config_id, k, tp, fp, threshold, feature_size, CAST(gross - feature_size * 200 AS BIGINT) AS unscaled_score, gross * sc - feature_size * 200 AS business_score FROM os)"""


def _outer(spark, d) -> DataFrame:
    p = predictions(spark, d).withColumnRenamed("pipeline_recipe_id", "recipe_config_id")
    sizes = p.groupBy("recipe_config_id").agg(F.max("feature_size").alias("feature_size"))
    return scoring.outer_points(p, sizes, caps={1: 100}, cap=200, scale={1: 5.0})


@query(f"WITH {_OUTER} SELECT * FROM ob")
def rate_matched_rescore(spark, d):
    return _outer(spark, d)


_OUTER_AGG = f"""{_OUTER}, oa AS (SELECT recipe_config_id, count(DISTINCT outer_fold) AS outer_folds, avg(business_score) AS mean_score, median(business_score) AS median_score, min(business_score) AS min_score, max(business_score) AS max_score,
round(stddev_samp(business_score), 6) AS std_score, avg(CAST(k AS DOUBLE)) AS mean_k, median(CAST(k AS DOUBLE)) AS median_k, max(feature_size) AS feature_size FROM ob GROUP BY recipe_config_id),
oz AS (SELECT *, row_number() OVER (ORDER BY mean_score DESC, median_score DESC, outer_folds DESC, std_score, feature_size, recipe_config_id) AS outer_config_rank FROM oa)"""


def _summary(spark, d) -> DataFrame:
    return _six(scoring.aggregate_outer(_outer(spark, d).withColumn("status", F.lit("ok"))), "std_score")


@query(f"WITH {_OUTER_AGG} SELECT * FROM oz")
def aggregate_outer(spark, d):
    return _summary(spark, d)


@query(f"WITH {_OUTER_AGG} SELECT recipe_config_id, outer_config_rank AS finalist_rank, 'stable' AS selection_note FROM oz WHERE outer_folds >= 2 AND outer_config_rank <= 3")
def stable_configs(spark, d):
    return selection.stable_configurations(_summary(spark, d), top=3).select("recipe_config_id", "finalist_rank", "selection_note")


@query(f"""WITH {_OUTER_AGG}, t AS (SELECT *, CASE WHEN feature_size <= 1 THEN 1 ELSE 3 END AS tier FROM oz),
fz AS (SELECT recipe_config_id, tier, row_number() OVER (ORDER BY tier, mean_score DESC, min_score DESC, outer_folds DESC, feature_size, recipe_config_id) AS finalist_rank FROM t)
SELECT * FROM fz WHERE finalist_rank <= 3""")
def cost_aware_configs(spark, d):
    return selection.cost_aware_configurations(_summary(spark, d), top=3, least_folds=2, most_features=1).select("recipe_config_id", "tier", "finalist_rank")


@query(f"""WITH {PREDICTIONS} SELECT DISTINCT outer_fold, pipeline_recipe_id AS recipe_config_id FROM pr WHERE pipeline_recipe_id <> 'fr2__m2' OR outer_fold <> 1""")
def complete_pairs(spark, d):
    p = predictions(spark, d).withColumnRenamed("pipeline_recipe_id", "recipe_config_id")
    outer = p.select("outer_fold", F.col("sample_index").alias("id")).distinct()
    least = p.where("outer_fold = 1").agg(F.min("sample_index").alias("x"))
    return scoring.complete_pairs(p.join(F.broadcast(least)).where("recipe_config_id <> 'fr2__m2' OR outer_fold <> 1 OR sample_index <> x"), outer)


@query(f"""WITH {PREDICTIONS}, ky AS (SELECT pipeline_recipe_id, sample_index AS id, y_true AS y, score FROM pr), {_curve_sql('ky', 1000, 'pipeline_recipe_id')}, b AS (SELECT pipeline_recipe_id, k, {SCORE2} FROM c)
SELECT pipeline_recipe_id, 'ok' AS status, k, business_score FROM b QUALIFY row_number() OVER (PARTITION BY pipeline_recipe_id ORDER BY business_score DESC, k) = 1""")
def pooled_outer_sweep(spark, d):
    return scoring.pooled_best(predictions(spark, d), ["pipeline_recipe_id"], features=2)


@query(f"WITH {PREDICTIONS}, x AS (SELECT * FROM pr UNION ALL SELECT * FROM pr WHERE pipeline_recipe_id = 'fr1__m1' AND sample_index % 100 = 0) SELECT {_KEYS}, sample_index, count(*) AS n FROM x GROUP BY ALL HAVING n > 1")
def duplicate_predictions(spark, d):
    p = predictions(spark, d)
    return scoring.duplicated(p.unionByName(p.where("pipeline_recipe_id = 'fr1__m1' AND sample_index % 100 = 0")))


@query(f"WITH {PREDICTIONS} SELECT sample_index, CAST(2 AS BIGINT) AS labels FROM pr WHERE pipeline_recipe_id = 'fr1__m1' AND sample_index % 100 = 0")
def label_conflicts(spark, d):
    p = predictions(spark, d)
    flip = (F.col("pipeline_recipe_id") == "fr1__m1") & (F.col("sample_index") % 100 == 0)
    return scoring.label_conflicts(p.withColumn("y_true", F.when(flip, 1 - F.col("y_true")).otherwise(F.col("y_true"))))


_VALIDATION = f"""{_INNER}, vs AS (SELECT 'fs_' || substr(pipeline_recipe_id, 3, 1) AS feature_set_id, substr(pipeline_recipe_id, 6) || '_' || outer_fold AS model, CASE WHEN pipeline_recipe_id = 'fr2__m1' THEN 'error' ELSE 'ok' END AS status,
CASE WHEN pipeline_recipe_id <> 'fr2__m1' THEN oof_score END AS score, feature_size AS n_features FROM sc)"""


def _validation(spark, d) -> DataFrame:
    s = _scores(spark, d)
    bad = F.col("pipeline_recipe_id") == "fr2__m1"
    return s.select(
        F.concat(F.lit("fs_"), F.substring("pipeline_recipe_id", 3, 1)).alias("feature_set_id"), F.concat(F.substring("pipeline_recipe_id", 6, 99), F.lit("_"), F.col("outer_fold").cast("string")).alias("model"),
        F.when(bad, "error").otherwise("ok").alias("status"), F.when(~bad, F.col("oof_score")).alias("score"), F.col("feature_size").alias("n_features"),
    )


@query(f"""WITH {_VALIDATION} SELECT feature_set_id, status, score, n_features, CASE WHEN status = 'ok' THEN row_number() OVER (PARTITION BY status ORDER BY score DESC NULLS LAST, n_features, feature_set_id) END AS validation_rank FROM vs""")
def validation_rank(spark, d):
    return scoring.validation_rank(_validation(spark, d)).drop("model")


@query(f"WITH {_VALIDATION} SELECT * FROM vs WHERE status = 'ok' QUALIFY row_number() OVER (PARTITION BY model ORDER BY score DESC NULLS LAST, n_features, feature_set_id, model) = 1")
def best_by_model(spark, d):
    return scoring.best_by(_validation(spark, d), "model")


@query(
    f"WITH {_VALIDATION} SELECT feature_set_id, count(*) AS models, round(avg(CAST(score AS DOUBLE)), 6) AS mean_score, max(CAST(score AS DOUBLE)) AS best_score, min(CAST(score AS DOUBLE)) AS worst_score, round(stddev_samp(CAST(score AS DOUBLE)), 6) AS std_score FROM vs WHERE status = 'ok' GROUP BY feature_set_id"
)
def stability(spark, d):
    return _six(scoring.stability(_validation(spark, d)), "mean_score", "std_score")


# --- candidate sets -------------------------------------------------------------------------------------------------


@query(f"""WITH {RANKED}, o AS (SELECT method AS name, feature, round(CAST(rank_score AS DOUBLE), 9) AS es, row_number() OVER (PARTITION BY method ORDER BY raw_score DESC, feature) AS ord FROM nr), z AS (SELECT unnest([1, 3, 5]) AS size),
c AS (SELECT name, size, list_sort(list(feature)) AS features, round(avg(es), 6) AS heuristic FROM o, z WHERE ord <= size GROUP BY name, size),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY features ORDER BY heuristic DESC, name) = 1)
SELECT name, CAST(size AS BIGINT) AS size, array_to_string(features, ',') AS features, heuristic FROM k""")
def prefix_candidates(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("method").orderBy(F.desc("raw_score"), "feature"))
    ranked = long_rankings(spark, d).select(F.col("method").alias("name"), "feature", place.alias("order"), F.round("rank_score", 9).alias("ensemble_score"))
    out = selection.prefix_candidates(ranked, [1, 3, 5])
    return _six(out.withColumn("features", F.array_join("features", ",")), "heuristic").drop("candidate_id")


_SETS = """fs AS (SELECT 'm_' || CAST(o_orderkey AS VARCHAR) AS origin, o_orderkey % 100 AS rank, CAST(1 + o_orderkey % 2 AS BIGINT) AS n_features,
list_sort(list_distinct(list_filter(['var_' || CAST(o_orderkey % 5 AS VARCHAR), 'var_' || CAST(o_orderkey % 7 AS VARCHAR)], lambda f: f <> 'var_6'))) AS features FROM orders)"""


def _named_sets(spark, d) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.concat(F.lit("['var_"), (key % 5).cast("string"), F.lit("', 'var_"), (key % 7).cast("string"), F.lit("']"))
    return table(spark, d, "orders").select(F.concat(F.lit("m_"), key.cast("string")).alias("origin"), (key % 100).alias("rank"), (1 + key % 2).cast("long").alias("n_features"), text.alias("features"))


@query(f"""WITH {_SETS}, k AS (SELECT * FROM fs WHERE len(features) > 0 QUALIFY row_number() OVER (PARTITION BY features ORDER BY rank, n_features, origin) = 1),
t AS (SELECT *, row_number() OVER (ORDER BY rank, n_features, origin) AS r FROM k) SELECT 'fs_' || lpad(CAST(r AS VARCHAR), 3, '0') AS feature_set_id, origin, array_to_string(features, ',') AS features FROM t WHERE r <= 12""")
def unique_sets(spark, d):
    out = selection.unique_feature_sets(_named_sets(spark, d), [f"var_{k}" for k in range(6)], top=12)
    return out.withColumn("features", F.array_join("features", ","))


@query(f"""WITH {_SETS}, m AS (SELECT CASE WHEN origin LIKE '%1' THEN 0 ELSE 1 END AS source, origin, rank AS place, features FROM fs WHERE len(features) > 0),
k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY features ORDER BY source, place, origin) = 1), t AS (SELECT *, row_number() OVER (ORDER BY source, place, origin) AS r FROM k)
SELECT 'fs_' || lpad(CAST(r AS VARCHAR), 3, '0') AS feature_set_id, origin, array_to_string(features, ',') AS features FROM t WHERE r <= 10""")
def merged_sets(spark, d):
    named = _named_sets(spark, d).select("origin", F.col("rank").alias("place"), F.filter(parsing.names_from_text(F.col("features")), lambda f: f != "var_6").alias("features")).where(F.size("features") > 0)
    out = selection.merged_sets([named.where("origin LIKE '%1'"), named.where("origin NOT LIKE '%1'")], top=10)
    return out.withColumn("features", F.array_join("features", ","))


@query(f"""WITH {_SETS}, e AS (SELECT CAST(rank % 3 AS INTEGER) AS outer_fold, origin, unnest(features) AS feature, generate_subscripts(features, 1) AS pos FROM fs)
SELECT feature, count(*) AS times, count(DISTINCT outer_fold) AS folds, count(DISTINCT origin) AS configs, round(avg(CAST(pos AS DOUBLE)), 6) AS mean_order FROM e GROUP BY feature""")
def feature_frequency(spark, d):
    own = F.filter(parsing.names_from_text(F.col("features")), lambda f: f != "var_6")
    named = _named_sets(spark, d).select((F.col("rank") % 3).cast("int").alias("outer_fold"), F.col("origin").alias("recipe_config_id"), parsing.set_key(own).alias("features"))
    return _six(scoring.feature_frequency(named), "mean_order")


@query(f"""WITH {_INNER}, v AS (SELECT pipeline_recipe_id AS method, max(CAST(oof_score AS DOUBLE)) AS value FROM sc GROUP BY 1),
h AS (SELECT method, CASE WHEN max(value) OVER () = min(value) OVER () THEN 1.0::DOUBLE ELSE value - min(value) OVER () END AS h FROM v),
w AS (SELECT method, h + 0.05::DOUBLE * greatest(avg(h) OVER (), 1.0::DOUBLE) AS w FROM h) SELECT method, round(w / sum(w) OVER (), 6) AS weight FROM w""")
def weights_from_scores(spark, d):
    return _six(rankings.weights_from_scores(_scores(spark, d).withColumnRenamed("pipeline_recipe_id", "method"), score="oof_score"), "weight")


_MATERIALISED = f"""{RANKED}, mt AS (SELECT method, avg(CAST(rank_score AS DOUBLE)) AS value FROM (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY method ORDER BY rank_score DESC, feature) <= 25) GROUP BY method),
a AS (SELECT 'ps_mean_000' || CAST(g AS VARCHAR) AS r, m AS method, 1.0::DOUBLE AS share FROM (VALUES (1, 'variance'), (2, 'peak'), (3, 'centre'), (4, 'variance'), (4, 'peak'), (5, 'variance'), (5, 'centre'), (6, 'peak'), (6, 'centre'),
(7, 'variance'), (7, 'peak'), (7, 'centre')) t(g, m) UNION ALL SELECT r, method, h + 0.05 * greatest(avg(h) OVER (PARTITION BY r), 1.0) FROM (SELECT r, method, CASE WHEN max(value) OVER () = min(value) OVER () THEN 1.0::DOUBLE ELSE value - min(value) OVER () END AS h
FROM mt, (VALUES ('ps_adaptive_weighted'), ('ps_adaptive_top3')) u(r))), w AS (SELECT r, method, share / sum(share) OVER (PARTITION BY r) AS share FROM a),
e AS (SELECT r, feature, sum(share * CAST(rank_score AS DOUBLE)) AS es, sum(share * rank) AS mr FROM nr JOIN w ON nr.method = w.method GROUP BY r, feature)"""


@query(f"WITH {_MATERIALISED} SELECT r AS prescreen_recipe_id, feature, round(es, 6) AS ensemble_score, round(mr, 6) AS mean_rank FROM e")
def materialized_rankings(spark, d):
    whole = pipelines.materialised_rankings(long_rankings(spark, d), recipes.prescreen_recipes(spark, METHODS))
    return _six(whole, "ensemble_score", "mean_rank").drop("order")


# --- feature statistics ---------------------------------------------------------------------------------------------


@query(f"""WITH {LONG}, a AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM l WHERE id % 2 = 0 GROUP BY feature),
b AS (SELECT l.feature, avg(value) AS m, stddev_pop(value) AS s, avg(CASE WHEN value < lo OR value > hi THEN 1.0 ELSE 0.0 END) AS outside FROM l JOIN a ON l.feature = a.feature WHERE id % 2 = 1 GROUP BY l.feature)
SELECT a.feature, round(a.m, 6) AS train_mean, round(a.s, 6) AS train_std, round(b.m, 6) AS test_mean, round(b.s, 6) AS test_std, round(outside, 6) AS outside_share,
round(abs(b.m - a.m) / greatest(sqrt((a.s * a.s + b.s * b.s) / 2), 1e-12), 6) AS smd FROM a JOIN b ON a.feature = b.feature""")
def shift_report(spark, d):
    long = embedding_long(spark, d)
    return _six(features.shift_report(long.where("id % 2 = 0"), long.where("id % 2 = 1")), "train_mean", "train_std", "test_mean", "test_std", "outside_share", "smd")


@query(f"WITH {LONG} SELECT feature, round(var_pop(value), 6) AS variance FROM l GROUP BY feature HAVING var_pop(value) > 0.01")
def variance_filter(spark, d):
    return _six(features.variance_filter(embedding_long(spark, d)), "variance")


@query(f"""WITH {LONG}, t AS (SELECT feature, unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS quantile, unnest(quantile_cont(value, [0.25, 0.5, 0.75])) AS threshold FROM l GROUP BY feature)
SELECT l.feature, quantile, count(*) AS n, CAST(sum(CASE WHEN value >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS ones FROM l JOIN t ON l.feature = t.feature GROUP BY l.feature, quantile""")
def quantile_binarize(spark, d):
    long = embedding_long(spark, d)
    return features.binarised(long, features.quantile_thresholds(long)).groupBy("feature", "quantile").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("ones"))


_PAIR = "CASE WHEN stddev_pop(x) * stddev_pop(y) <> 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END"


@query(f"""WITH w AS (SELECT embedding AS e, CAST(unnest(range(0, 64)) AS INTEGER) AS a FROM embeddings), p AS (SELECT a, CAST(unnest(range(a + 1, 64)) AS INTEGER) AS b, e FROM w),
v AS (SELECT a, b, CAST(e[a + 1] AS DOUBLE) AS x, CAST(e[b + 1] AS DOUBLE) AS y FROM p) SELECT a, b, round({_PAIR}, 6) AS corr FROM v GROUP BY a, b HAVING abs({_PAIR}) >= 0.05""")
def corr_pairs(spark, d):
    return _six(features.correlated_pairs(embedding_rows(spark, d), "features", size=64, least=0.05), "corr")


@query(f"""WITH {LONG}, m AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM l GROUP BY feature), v AS (SELECT id, l.feature, round((value - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 4) AS value FROM l JOIN m ON l.feature = m.feature)
SELECT id, feature, CASE WHEN value = 0 THEN 0.0::DOUBLE ELSE value END AS value FROM v""")
def standardised(spark, d):
    return features.standardised(embedding_long(spark, d).drop("y")).withColumn("value", F.round("value", 4))


@query(f"""WITH {LONG}, m AS (SELECT feature, median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS s FROM l GROUP BY feature),
v AS (SELECT id, l.feature, round((value - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 4) AS value FROM l JOIN m ON l.feature = m.feature)
SELECT id, feature, CASE WHEN value = 0 THEN 0.0::DOUBLE ELSE value END AS value FROM v""")
def robust_scaled(spark, d):
    return features.robust_scaled(embedding_long(spark, d).drop("y")).withColumn("value", F.round("value", 4))


@query(f"WITH {ORDERS} SELECT round(CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) / count(*) FILTER (WHERE y = 1), 6) AS scale_pos_weight FROM s")
def scale_pos_weight(spark, d):
    return _six(features.class_weight(scored_orders(spark, d)), "scale_pos_weight")


_PROFILE = f"""{ORDERS}, pf AS (SELECT grp AS cluster, count(*) AS n, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM s GROUP BY grp),
pl AS (SELECT cluster, n, pos, neg, CAST(pos AS DOUBLE) / n AS rate, CAST(pos AS DOUBLE) / n / (SELECT avg(CAST(y AS DOUBLE)) FROM s) AS lift FROM pf)"""


def _profile(spark, d) -> DataFrame:
    return features.cluster_profile(scored_orders(spark, d).withColumnRenamed("grp", "cluster"))


@query(f"WITH {_PROFILE} SELECT cluster, n, pos, neg, round(rate, 6) AS rate, round(lift, 6) AS lift FROM pl")
def cluster_y_profile(spark, d):
    return _six(_profile(spark, d), "rate", "lift")


@query(f"WITH {_PROFILE} SELECT min(n) AS min_size, max(n) AS max_size, round(CAST(max(n) AS DOUBLE) / min(n), 6) AS imbalance, round(max(rate), 6) AS max_rate, round(min(rate), 6) AS min_rate, round(max(lift), 6) AS max_lift FROM pl")
def cluster_summary(spark, d):
    return _six(features.cluster_summary(_profile(spark, d)), "imbalance", "max_rate", "min_rate", "max_lift")


# --- text artefacts -------------------------------------------------------------------------------------------------


@query("SELECT CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, count(*) AS n FROM events GROUP BY 1")
def parse_json(spark, d):
    return table(spark, d, "events").select(parsing.dict_from_text(F.col("props"))["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS id, 'ps_' || o_orderstatus || '__k_' || lpad(CAST(o_orderkey % 90 AS VARCHAR), 3, '0') || '__m1' AS config_id, 'ps_' || o_orderstatus AS prescreen FROM orders""")
def config_ids(spark, d):
    o = table(spark, d, "orders")
    made = parsing.config_id(F.concat(F.lit("ps_"), F.col("o_orderstatus")), (F.col("o_orderkey") % 90).cast("int"), F.lit("m1"))
    return o.select(F.col("o_orderkey").cast("long").alias("id"), made.alias("config_id"), parsing.prescreen_of(made).alias("prescreen"))


# --- estimators: no SQL gives their numbers ---------------------------------------------------------------------------


@query()
def oof_logistic_curve(spark, d):
    df = embedding_rows(spark, d)
    scores = models.out_of_fold(df, folds.outer_folds(df, n_splits=3), models.logistic(c=0.1))
    return curves.profit_curve(scores, features=64, cap=200, zero=True)


@query()
def oof_calibrated_points(spark, d):
    df = embedding_rows(spark, d)
    scores = models.out_of_fold(df, folds.outer_folds(df, n_splits=3), models.logistic(c=0.1)).select("id", "y", "score")
    return curves.effective_point(models.calibrated(scores, scores), features=64, cap=200)


@query()
def extra_trees_targets(spark, d):
    df = embedding_rows(spark, d)
    return models.select_and_score(df.where("id % 2 = 0"), df.where("id % 2 = 1"), models.extra_trees(trees=32), k=100)


@query()
def kmeans_segment_targets(spark, d):
    df = embedding_rows(spark, d)
    train, test = models.kmeans_clusters(df.where("id % 2 = 0"), df.where("id % 2 = 1"), k=4, restarts=2)
    scored = models.per_cluster_scores(train, test, models.logistic(c=0.1), models.logistic(c=0.1))
    return selection.top_targets(scored, 100)


@query()
def fan_out_blocks(spark, d):
    df = embedding_rows(spark, d)
    fold = df.join(folds.outer_folds(df, n_splits=3).withColumnRenamed("outer_fold", "fold"), "id")
    tasks = spark.createDataFrame([(t, f, p) for t, p in enumerate(([0], [0, 1], [0, 1, 2, 3])) for f in (1, 2, 3)], "task_id long, fold int, places array<int>")
    return scoring.from_blocks(models.evaluate_tasks(fold, tasks, trees=10))


from . import artefacts, fits, stages  # noqa: E402, F401  these register their queries here
