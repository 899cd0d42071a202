"""Stratified fold tables, their summaries and their integrity.

Folds are a function of the row, not of a shuffled order: within a label, rows are
ordered by md5(seed:id) and dealt out in turn.  To keep a label with very many rows
out of one task, the order is cut into buckets by the hash's first digits; a
bucket's rows are numbered alone and the sizes of the buckets before it are added.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ledger import ratio, require_columns
from ..functions.multisets import PIECES, multiset_print
from ..functions.ranges import placed


def _dealt(df: DataFrame, strata: list[str], seed: str, n_splits: int) -> DataFrame:
    """``df`` with _fold in 1..n_splits."""
    hashed = df.withColumn("_h", F.md5(F.concat(F.expr(seed), F.lit(":"), F.col("id").cast("string"))))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, 3))
    sizes = hashed.groupBy(*strata, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", "id"))
    numbered = hashed.withColumn("_r", own).join(sizes, [*strata, "_b"])
    return numbered.withColumn("_fold", (F.pmod(F.col("_r") + F.col("_before") - 1, F.lit(n_splits)) + 1).cast("int"))


def outer_folds(df: DataFrame, *, n_splits: int = 5, seed: int = 42) -> DataFrame:
    """id, outer_fold."""
    require_columns(df, ["id", "y"])
    return _dealt(df.select("id", "y"), ["y"], f"'{seed}'", n_splits).select("id", F.col("_fold").alias("outer_fold"))


def inner_folds(df: DataFrame, outer: DataFrame, *, n_splits: int = 5, seed: int = 42) -> DataFrame:
    """outer_fold, id, inner_fold: each outer fold's training rows dealt out anew, with a seed of its own."""
    folds = outer.select(F.col("outer_fold").alias("o")).distinct()
    rows = df.select("id", "y").join(outer, "id").join(F.broadcast(folds), F.col("outer_fold") != F.col("o")).select("id", "y", F.col("o").alias("outer_fold"))
    dealt = _dealt(rows, ["outer_fold", "y"], f"cast({seed} + 1009 * outer_fold as string)", n_splits)
    return dealt.select("outer_fold", "id", F.col("_fold").alias("inner_fold"))


def contiguous_folds(df: DataFrame, *, n_splits: int = 5) -> DataFrame:
    """id, fold: unshuffled blocks within a label, in id order."""
    sizes = df.groupBy("y").agg(F.count("*").alias("n"))
    return placed(df.select("id", "y"), ["y"], [F.col("id")], name="r").join(F.broadcast(sizes), "y").select("id", (F.floor((F.col("r") - 1) * n_splits / F.col("n")) + 1).cast("int").alias("fold"))


def summarise_outer(df: DataFrame, outer: DataFrame) -> DataFrame:
    """Rows, positives and rates of the validation and the training part of each outer fold."""
    per = df.select("id", "y").join(outer, "id").groupBy("outer_fold").agg(F.count("*").alias("val_n"), F.sum(F.col("y").cast("long")).alias("val_pos"))
    return _with_complement(per, Window.partitionBy(), ["outer_fold"])


def summarise_inner(df: DataFrame, inner: DataFrame) -> DataFrame:
    per = df.select("id", "y").join(inner, "id").groupBy("outer_fold", "inner_fold").agg(F.count("*").alias("val_n"), F.sum(F.col("y").cast("long")).alias("val_pos"))
    return _with_complement(per, Window.partitionBy("outer_fold"), ["outer_fold", "inner_fold"])


def _with_complement(per: DataFrame, whole, keys: list[str]) -> DataFrame:
    """``per`` has a row for each fold, so its window is small whatever the table holds."""
    c = per.withColumns({"train_n": F.sum("val_n").over(whole) - F.col("val_n"), "train_pos": F.sum("val_pos").over(whole) - F.col("val_pos")})
    return c.select(*keys, "train_n", "train_pos", ratio(F.col("train_pos"), F.col("train_n")).alias("train_rate"), "val_n", "val_pos", ratio(F.col("val_pos"), F.col("val_n")).alias("val_rate"))


def outer_part(df: DataFrame, outer: DataFrame, fold: int, *, train: bool) -> DataFrame:
    wanted = outer.where(F.col("outer_fold") != fold if train else F.col("outer_fold") == fold)
    return df.join(wanted.select("id"), "id", "left_semi")


def inner_part(df: DataFrame, inner: DataFrame, outer_fold: int, inner_fold: int, *, train: bool) -> DataFrame:
    own = inner.where(F.col("outer_fold") == outer_fold)
    wanted = own.where(F.col("inner_fold") != inner_fold if train else F.col("inner_fold") == inner_fold)
    return df.join(wanted.select("id"), "id", "left_semi")


CHECKS = ("outer_missing", "outer_extra", "outer_repeated", "inner_repeated", "inner_holds_outer_validation", "inner_incomplete")


def split_integrity(outer: DataFrame, inner: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each check: name, violations.  Zero everywhere means that no row leaks.

    The outer folds are held against the rows in one shuffle by id.  The inner training rows of a fold are what the other
    folds hold, which fingerprints tell in one pass without moving the rows (see ``multiset_print``); only where they
    differ, or where the outer folds break, the three inner checks count by joins.  Null ids match nothing.
    """
    spark = rows.sparkSession
    both = rows.select("id", F.lit(1).alias("r"), F.lit(0).alias("o")).unionByName(outer.select("id", F.lit(0).alias("r"), F.lit(1).alias("o")))
    each = both.groupBy("id").agg(F.max("r").alias("r"), F.sum("o").alias("o"))
    alone = F.col("id").isNull()
    counts = each.agg(
        F.sum(F.when((F.col("r") > 0) & ((F.col("o") == 0) | alone), 1)).alias("outer_missing"),
        F.sum(F.when((F.col("r") == 0) | alone, F.col("o"))).alias("outer_extra"),
        F.sum(F.when(F.col("o") > 1, 1)).alias("outer_repeated"),
    ).first().asDict()
    found = {name: int(counts[name] or 0) for name in CHECKS[:3]}
    if not any(found.values()) and _complements(outer, inner):
        return spark.createDataFrame([(name, 0) for name in CHECKS], "name string, violations long")
    out = spark.createDataFrame(list(found.items()), "name string, violations long")
    folds = F.broadcast(outer.select("outer_fold").distinct())  # a row a fold
    wanted = outer.select("id", F.col("outer_fold").alias("own")).join(folds, F.col("own") != F.col("outer_fold"))
    exact = (
        inner.groupBy("outer_fold", "id").agg(F.count("*").alias("c")).where("c > 1"),
        inner.join(outer, ["outer_fold", "id"], "left_semi"),
        wanted.join(inner, ["outer_fold", "id"], "left_anti"),
    )
    for name, df in zip(CHECKS[3:], exact):
        out = out.unionByName(df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations"))
    return out


def _complements(outer: DataFrame, inner: DataFrame) -> bool:
    """Whether the inner rows of each fold are, each once, those of all other outer folds (whose ids are distinct)."""
    names = ["n", "known", *PIECES]

    def prints(df: DataFrame) -> dict:
        return {r.outer_fold: np.array([r[n] for n in names], object) for r in df.groupBy("outer_fold").agg(*multiset_print("id")).collect()}  # a row a fold

    whole, parts = prints(outer), prints(inner)
    total = sum(whole.values(), np.zeros(len(names), object))
    nothing = np.zeros(len(names), object)
    return set(parts) <= set(whole) and all((total - own == parts.get(fold, nothing)).all() for fold, own in whole.items())


def assert_split_integrity(outer: DataFrame, inner: DataFrame, rows: DataFrame) -> None:
    bad = [(r.name, r.violations) for r in split_integrity(outer, inner, rows).collect() if r.violations]
    if bad:
        raise ValueError(f"fold tables break: {bad}")
