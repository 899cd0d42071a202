"""Shared folder, written tables and column helpers for the llm operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import broadcast_if_small, shared_folder, shared_root, written  # noqa: F401

#: White space of all contracts here: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"
#: A key with more than this share of the rows is hot; there are fewer than HOT_KEYS of them, whatever the table.
HOT_KEYS = 10_000


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def whole_row(df: DataFrame) -> Column:
    """A row's own columns as one struct ``_row``, so that names used beside it can't clash with theirs."""
    return F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("_row")


def hot_and_rest(side: DataFrame, weight: str, total: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``side`` (one a key) whose ``weight`` is over total / HOT_KEYS, to be broadcast, and the others.

    Weights add up to ``total`` at most, so that fewer than HOT_KEYS rows are broadcast; no key among the others
    holds enough rows to make one task long.
    """
    hot = F.col(weight) * HOT_KEYS > F.lit(total).cast("long")
    return F.broadcast(side.where(hot)), side.where(~hot)


def join_on_counted(rows: DataFrame, side: DataFrame, key: str | list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``side`` (written, one row a key, with the number of its rows in ``weight``): the rows of
    hot keys stay where they are.  Every key of ``rows`` that ``side`` lacks goes.

    How many keys are hot is counted first: if none is, or no other, one plain join does.
    """
    hot, rest = hot_and_rest(side, weight, total)
    n = side.agg(F.count("*").alias("all"), F.count_if(F.col(weight) * HOT_KEYS > F.lit(total).cast("long")).alias("hot")).first()
    if not n.hot:
        return rows.join(side, key)
    if n.hot == n["all"]:
        return rows.join(F.broadcast(side), key)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def with_texts(docs: DataFrame, text_col: str, change: Callable[[list], list]) -> DataFrame:
    """``docs`` with ``change`` applied to the texts of every Arrow batch; whatever the other columns are called, they stay."""
    place, names = docs.columns.index(text_col), [f"c{k}" for k in range(len(docs.columns))]

    def run(batches):
        for batch in batches:
            field = batch.schema.field(place)
            yield batch.set_column(place, field, pa.array(change(batch.column(place).to_pylist()), field.type))

    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, so that a worker never holds ten thousand long texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
