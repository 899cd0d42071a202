"""Inputs of the queries on the provided tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import long_view
from ..operators.rankings import normalised_ranks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y, score, p, grp of every order."""
    price = F.col("o_totalprice").cast("double")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("long").alias("id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"), price.alias("score"),
        F.least(price / F.lit(500000.0), F.lit(1.0)).alias("p"), F.col("o_orderpriority").alias("grp"),
    )


ORDERS = """s AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, CAST(o_totalprice AS DOUBLE) AS score,
  least(CAST(o_totalprice AS DOUBLE) / CAST(500000.0 AS DOUBLE), CAST(1.0 AS DOUBLE)) AS p, o_orderpriority AS grp FROM orders)"""


def by_probability(df: DataFrame) -> DataFrame:
    return df.drop("score").withColumnRenamed("p", "score")


PROBABILITY = ORDERS + ", q AS (SELECT id, y, p AS score, grp FROM s)"

RECIPES = (("fr1__m1", 1), ("fr1__m2", 1), ("fr2__m1", 2), ("fr2__m2", 2))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner predictions of four recipes over two outer and three inner folds of the orders."""
    s = scored_orders(spark, sf_dir)
    scores = (F.col("score"), F.col("score") * (1 + F.pmod("id", F.lit(7))), -F.col("score"), F.col("score") + 1000.0 * F.pmod("id", F.lit(11)))
    each = F.array(*(F.struct(F.lit(r).alias("pipeline_recipe_id"), F.lit(n).cast("long").alias("feature_size"), v.cast("double").alias("score")) for (r, n), v in zip(RECIPES, scores)))
    return s.select(
        (F.pmod("id", F.lit(2)) + 1).cast("int").alias("outer_fold"), (F.pmod(F.floor(F.col("id") / 2), F.lit(3)) + 1).cast("int").alias("inner_fold"), F.lit("r1").alias("round_name"),
        F.col("id").alias("sample_index"), F.col("y").alias("y_true"), F.explode(each).alias("e"), F.lit("ok").alias("status"),
    ).select("outer_fold", "inner_fold", "round_name", "sample_index", "y_true", "e.*", "status")


_PRED = " UNION ALL ".join(
    f"SELECT outer_fold, inner_fold, 'r1' AS round_name, id AS sample_index, y AS y_true, '{r}' AS pipeline_recipe_id, CAST({n} AS BIGINT) AS feature_size, CAST({v} AS DOUBLE) AS score FROM f"
    for (r, n), v in zip(RECIPES, ("score", "score * (1 + id % 7)", "-score", "score + 1000.0 * (id % 11)"))
)
PREDICTIONS = f"{ORDERS}, f AS (SELECT CAST(id % 2 + 1 AS INTEGER) AS outer_fold, CAST((id // 2) % 3 + 1 AS INTEGER) AS inner_fold, * FROM s), pr AS ({_PRED})"


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y, features of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), F.when(F.col("label") < 5, 1).otherwise(0).alias("y"), F.transform("embedding", lambda x: x.cast("double")).alias("features")
    )


def embedding_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_view(embedding_rows(spark, sf_dir), "features", "id", "y")


LONG = """l AS (SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, 'var_' || CAST(generate_subscripts(embedding, 1) - 1 AS VARCHAR) AS feature,
  CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""


def raw_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three simple methods' scores of the embedding features, rounded so that both engines rank alike."""
    stats = embedding_long(spark, sf_dir).groupBy("feature").agg(F.round(F.var_pop("value"), 8).alias("variance"), F.round(F.max("value"), 8).alias("peak"), F.round(F.abs(F.avg("value")), 8).alias("centre"))
    each = F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("raw_score")) for m in ("variance", "peak", "centre")))
    return stats.select("feature", F.explode(each).alias("e")).select("feature", "e.*")


METHODS = ("variance", "peak", "centre")
RAW = f"""{LONG}, st AS (SELECT feature, round(var_pop(value), 8) AS variance, round(max(value), 8) AS peak, round(abs(avg(value)), 8) AS centre FROM l GROUP BY feature),
raw AS (SELECT feature, 'variance' AS method, variance AS raw_score FROM st UNION ALL SELECT feature, 'peak', peak FROM st UNION ALL SELECT feature, 'centre', centre FROM st)"""
RANKED = f"""{RAW}, rk AS (SELECT feature, method, raw_score, rank() OVER (PARTITION BY method ORDER BY raw_score DESC) + (count(*) OVER (PARTITION BY method, raw_score) - 1) / 2.0 AS rank,
  count(*) OVER (PARTITION BY method) AS p FROM raw),
nr AS (SELECT feature, method, raw_score, CAST(rank AS DOUBLE) AS rank, CASE WHEN p <= 1 THEN 1.0 ELSE 1 - (CAST(rank AS DOUBLE) - 1) / (p - 1) END AS rank_score FROM rk)"""


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised_ranks(raw_rankings(spark, sf_dir))


def ordered_methods(spark: SparkSession, sf_dir: str) -> list[str]:
    """The methods by the mean score that they give the features; a row a method."""
    means = raw_rankings(spark, sf_dir).groupBy("method").agg(F.round(F.avg("raw_score"), 6).alias("mean"))
    return [r.method for r in means.orderBy(F.desc("mean"), "method").collect()]


PRESCREENS = f"""{RANKED}, mo AS (SELECT method, row_number() OVER (ORDER BY round(avg(raw_score), 6) DESC, method) AS place FROM nr GROUP BY method),
cb AS (SELECT 'single__' || method AS name, 1 AS n, place AS a, 0 AS b FROM mo UNION ALL SELECT 'pair__' || x.method || '__' || y.method, 2, x.place, y.place FROM mo x JOIN mo y ON x.place < y.place
UNION ALL SELECT 'triple__' || string_agg(method, '__' ORDER BY place), 3, 0, 0 FROM mo), px AS (SELECT 'ps_mean_' || lpad(CAST(row_number() OVER (ORDER BY n, a, b) AS VARCHAR), 4, '0') AS id, name, n FROM cb)"""


def ranked_sizes(spark: SparkSession, sf_dir: str) -> list[int]:
    """The sizes that the ranked features suffice for."""
    n = raw_rankings(spark, sf_dir).agg(F.count_distinct("feature").alias("n")).first().n
    return [s for s in (1, 3, 5, 100) if s <= n]


SIZES = "sz AS (SELECT s FROM (SELECT unnest([1, 3, 5, 100]) AS s) WHERE s <= (SELECT count(DISTINCT feature) FROM nr))"
