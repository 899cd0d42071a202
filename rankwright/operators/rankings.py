"""Feature rankings: normalising, combining, weighting, and Borda and rank-mean scores of rows.

A long ranking has one row for each (method, feature): raw_score, rank,
rank_score.  These tables are as large as methods times features.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ledger import average_rank, guarded_corr
from ..functions.ranges import placed, quantiles, running_totals


def normalised_ranks(raw: DataFrame) -> DataFrame:
    """feature, method, raw_score -> with rank (ties share the mean) and rank_score in 0..1; null, NaN and
    infinite scores count as 0, a single feature scores 1."""
    inf = float("inf")
    clean = raw.withColumn("raw_score", F.when(F.col("raw_score").isNull() | F.isnan("raw_score") | (F.abs("raw_score") == inf), 0.0).otherwise(F.col("raw_score").cast("double")))
    sized = clean.withColumn("rank", average_rank(F.col("raw_score"), ["method"])).withColumn("_p", F.count("*").over(Window.partitionBy("method")))
    return sized.select("feature", "method", "raw_score", "rank", F.when(F.col("_p") <= 1, 1.0).otherwise(1 - (F.col("rank") - 1) / (F.col("_p") - 1)).alias("rank_score"))


def _require_methods(rankings: DataFrame, methods: Sequence[str]) -> None:
    have = {r.method for r in rankings.select("method").distinct().collect()}  # a handful of names
    if missing := [m for m in methods if m not in have]:
        raise ValueError(f"no ranking by {', '.join(missing)}")


def _ordered(scored: DataFrame) -> DataFrame:
    return scored.withColumn("order", F.row_number().over(Window.orderBy(F.desc("ensemble_score"), "mean_rank", "feature")).cast("long"))  # one row a feature


def combined_ranking(rankings: DataFrame, methods: Sequence[str]) -> DataFrame:
    """feature, ensemble_score (mean rank_score), mean_rank, order, and score__<method> for each."""
    _require_methods(rankings, methods)
    own = rankings.where(F.col("method").isin(*methods))
    pivoted = [F.max(F.when(F.col("method") == m, F.col("rank_score"))).alias(f"score__{m}") for m in methods]
    return _ordered(own.groupBy("feature").agg(F.avg("rank_score").alias("ensemble_score"), F.avg("rank").alias("mean_rank"), *pivoted))


def weighted_ranking(rankings: DataFrame, weights: DataFrame) -> DataFrame:
    """As ``combined_ranking`` with weights (method, weight); those not above 0 are dropped, the others add up to 1."""
    used = weights.where("weight > 0")
    total = used.agg(F.sum("weight").alias("t"))
    shares = used.join(F.broadcast(total)).select("method", (F.col("weight") / F.col("t")).alias("w"))
    joined = rankings.join(F.broadcast(shares), "method")
    return _ordered(joined.groupBy("feature").agg(F.sum(F.col("w") * F.col("rank_score")).alias("ensemble_score"), F.sum(F.col("w") * F.col("rank")).alias("mean_rank")))


def weights_text(weights: DataFrame) -> DataFrame:
    """The weights as text, "method=0.123456" joined by ";" in name order."""
    total = weights.where("weight > 0").agg(F.sum("weight").alias("t"))
    shares = weights.where("weight > 0").join(F.broadcast(total)).select(F.format_string("%s=%.6f", "method", F.col("weight") / F.col("t")).alias("s"))
    return shares.agg(F.array_join(F.array_sort(F.collect_list("s")), ";").alias("weights"))


def floored_weights(values: DataFrame, groups: Sequence[str] = (), *, least: float = 0.05) -> DataFrame:
    """``values`` (method, value, one row a method and group) with weight: what a value lies above the least one (1 for
    all if they are equal), to which ``least`` times its mean, or times 1 if that is more, is added; adding up to 1."""
    whole = Window.partitionBy(*groups)  # as many rows as methods
    low, high = F.min("value").over(whole), F.max("value").over(whole)
    above = values.withColumn("_above", F.when(low == high, 1.0).otherwise(F.col("value") - low))
    raised = above.withColumn("_above", F.col("_above") + least * F.greatest(F.avg("_above").over(whole), F.lit(1.0)))
    return raised.withColumn("weight", F.col("_above") / F.sum("_above").over(whole)).drop("_above")


def weights_from_scores(scores: DataFrame, *, score: str = "score", least: float = 0.05) -> DataFrame:
    """method, weight from the best score of each method; where ``prescreen_method_count`` is known, of methods on their own."""
    if "prescreen_method_count" in scores.columns:
        scores = scores.where("prescreen_method_count = 1")
    best = scores.where(F.col(score).isNotNull()).groupBy("method").agg(F.max(score).cast("double").alias("value"))
    return floored_weights(best, least=least).select("method", "weight")


def top_rank_scores(rankings: DataFrame, *, top: int = 25) -> DataFrame:
    """method, value: the mean of each method's ``top`` best rank scores."""
    best = rankings.withColumn("_r", F.row_number().over(Window.partitionBy("method").orderBy(F.desc("rank_score"), "feature"))).where(F.col("_r") <= top)
    return best.groupBy("method").agg(F.avg("rank_score").alias("value"))


def train_only_weights(rankings: DataFrame, *, top: int = 25, least: float = 0.05) -> DataFrame:
    """method, weight from how high each method's best features score, which no label of a validation row has touched."""
    return floored_weights(top_rank_scores(rankings, top=top), least=least).select("method", "weight")


def all_ensembles(rankings: DataFrame, methods: Sequence[str], sizes: Sequence[int] | None = None) -> DataFrame:
    """combined_ranking of every combination of methods in one job: ensemble, feature, ensemble_score, mean_rank, order."""
    chosen = sizes or range(1, len(methods) + 1)
    rows = [(combination_name(c, len(methods)), m) for k in chosen for c in combinations(methods, k) for m in c]
    members = rankings.sparkSession.createDataFrame(rows, "ensemble string, method string")
    joined = rankings.join(F.broadcast(members), "method")
    scored = joined.groupBy("ensemble", "feature").agg(F.avg("rank_score").alias("ensemble_score"), F.avg("rank").alias("mean_rank"))
    order = Window.partitionBy("ensemble").orderBy(F.desc("ensemble_score"), "mean_rank", "feature")
    return scored.withColumn("order", F.row_number().over(order).cast("long"))


def combination_name(methods: Sequence[str], all_count: int) -> str:
    k = len(methods)
    prefix = "all" if k == all_count and k > 3 else {1: "single", 2: "pair", 3: "triple"}.get(k, f"ensemble_{k}")
    return f"{prefix}__" + "__".join(methods)


def prefix_sets(ranked: DataFrame, sizes: Sequence[int], *, whole: bool = True) -> DataFrame:
    """set_name, size, features: the first ``size`` features by order; with ``whole`` also all of them."""
    n = F.size("all")
    wanted = F.array(*(F.lit(s) for s in sizes))
    listed = ranked.agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "feature"))), lambda x: x["feature"]).alias("all"))
    allowed = F.filter(wanted, lambda s: s <= n)
    every = F.array_sort(F.array_distinct(F.concat(allowed, F.array(n)) if whole else allowed))
    return listed.select("all", F.explode(every).alias("size")).select(F.format_string("top_%02d", "size").alias("set_name"), F.col("size").cast("long").alias("size"), F.slice("all", 1, F.col("size")).alias("features"))


def abs_corr(long: DataFrame) -> DataFrame:
    """feature, abs_corr with the label, from the long view (id, feature, value, y); constant features have 0."""
    return long.groupBy("feature").agg(F.coalesce(F.abs(guarded_corr("value", "y")), F.lit(0.0)).alias("abs_corr"))


def binned_mutual_information(long: DataFrame, *, bins: int = 10) -> DataFrame:
    """feature, mutual_info of quantile bins and the label: a stated stand-in for nearest-neighbour estimators."""
    cuts = quantiles(long, "feature", "value", [k / bins for k in range(1, bins)]).withColumnRenamed("q", "cuts")
    binned = long.join(F.broadcast(cuts), "feature").select("feature", "y", F.size(F.filter("cuts", lambda c: c < F.col("value"))).alias("bin"))
    cells = binned.groupBy("feature", "bin", "y").agg(F.count("*").alias("n"))
    per = cells.withColumns(
        {
            "nb": F.sum("n").over(Window.partitionBy("feature", "bin")),
            "ny": F.sum("n").over(Window.partitionBy("feature", "y")),
            "nn": F.sum("n").over(Window.partitionBy("feature")),
        }
    )
    return per.groupBy("feature").agg(F.sum(F.col("n") / F.col("nn") * F.log(F.col("n").cast("double") * F.col("nn") / (F.col("nb").cast("double") * F.col("ny")))).alias("mutual_info"))


def borda_scores(train: DataFrame, scored: DataFrame, *, directed: bool = True) -> DataFrame:
    """id, score of the rows of ``scored`` (long: id, feature, value): each feature gives n + 1 - rank points by
    its value, taken in the direction of its correlation with the label on ``train`` or, unless ``directed``, as it is;
    the mean over features is brought to 0..1 over the rows that are scored."""
    signs = train.select("feature").distinct().withColumn("sign", F.lit(1.0)) if not directed else train.groupBy("feature").agg(F.when(F.coalesce(guarded_corr("value", "y"), F.lit(0.0)) < 0, -1.0).otherwise(1.0).alias("sign"))
    turned = scored.join(F.broadcast(signs), "feature").withColumn("v", F.col("value") * F.col("sign"))
    sizes = scored.groupBy("feature").agg(F.count("*").alias("n"))
    points = placed(turned.select("id", "feature", "v"), ["feature"], [F.col("v"), F.col("id")], name="r").join(F.broadcast(sizes), "feature").groupBy("id").agg(F.avg((F.col("n") + 1 - F.col("r")).cast("double")).alias("points"))
    ends = points.agg(F.min("points").alias("lo"), F.max("points").alias("hi"))
    return points.join(F.broadcast(ends)).select("id", ((F.col("points") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-12)).alias("score"))


def fused_scores(experts: DataFrame, weights: DataFrame) -> DataFrame:
    """id, score: the weighted sum of the experts' scores (expert, id, score)."""
    return experts.join(F.broadcast(weights), "expert").groupBy("id").agg(F.sum(F.col("weight") * F.col("score")).alias("score"))


def fusion_weights(experts: DataFrame, *, least: float = 0.0) -> DataFrame:
    """expert, weight from cv_mean: raised to ``least``, adding up to 1; equal ones if nothing is above 0."""
    raised = experts.select("expert", F.greatest(F.col("cv_mean").cast("double"), F.lit(least)).alias("w"))
    total = raised.agg(F.sum("w").alias("t"), F.count("*").alias("m"))
    return raised.join(F.broadcast(total)).select("expert", F.when(F.col("t") <= 0, 1.0 / F.col("m")).otherwise(F.col("w") / F.col("t")).alias("weight"))


def rank_mean_ensemble(predictions: DataFrame, *, top: int) -> DataFrame:
    """id, mean_rank, rank of the best ``top`` rows by the mean of the configs' average-rank percentages.

    Configs that miss a row of the table are left out; of fewer than two configs nothing comes out.
    """
    rows = predictions.select("id").distinct().agg(F.count("*").alias("rows"))
    sizes = predictions.groupBy("config").agg(F.count_distinct("id").alias("n")).join(F.broadcast(rows)).where(F.col("n") == F.col("rows"))
    enough = sizes.agg(F.count("*").alias("configs"))
    whole = predictions.join(F.broadcast(sizes.join(F.broadcast(enough)).where("configs >= 2").select("config", "n")), "config")
    # Rows that tie share the mean of their ranks, which follows from the counts by distinct score.
    counts = whole.groupBy("config", F.col("score").alias("s"), "n").agg(F.count("*").alias("ties"))
    ranks = running_totals(counts, "s", ["ties"], groups=["config"], descending=False)
    ranks = ranks.select(F.col("config").alias("c"), "s", ((F.col("cum_ties") - (F.col("ties") - 1) / 2.0) / F.col("n")).alias("pct"))
    share = whole.join(ranks, (F.col("config") == F.col("c")) & F.col("score").eqNullSafe(F.col("s")))
    mean = share.groupBy("id").agg(F.avg("pct").alias("mean_rank")).orderBy(F.desc("mean_rank"), F.desc("id")).limit(top)
    return mean.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_rank"), F.desc("id"))).cast("long"))


def rank_sum(a: DataFrame, b: DataFrame) -> DataFrame:
    """feature, combined: the sum of the 0-based places in two rankings (feature, score)."""
    place = F.row_number().over(Window.orderBy(F.desc("score"), "feature")) - 1  # one row a feature
    one, two = a.select("feature", place.alias("pa")), b.select("feature", place.alias("pb"))
    return one.join(two, "feature").select("feature", (F.col("pa") + F.col("pb")).cast("long").alias("combined"))
