"""Numbering and adding up in an order, without bringing a group to one task.

A window that numbers the rows of a group, or adds them up, needs the whole group in
one task.  Here the rows are cut into ranges of (groups, order) instead: a range is
worked on alone, and what lies in the ranges before it is added.  A group of any size is
spread over as many tasks as its share of the rows.  So are rows that tie: they are put
in the order of a hash of the whole row, and only rows that are alike in every column
stay together.  Quantiles count equal values first, so that a tie is one row.

The bounds of ranges come from a sample and another run may draw others, so the table is
written with its range numbers to the shared folder, and everything is read from there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_folder


def in_ranges(df: DataFrame, groups: Sequence[str], order: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """``df`` with _part, the number of a row's range of (groups, order)."""
    spark = df.sparkSession
    path = shared_folder(spark, "ranges")
    by = [*(F.col(g) for g in groups), *order, F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))]
    cut = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    marked = cut.withColumn("_part", F.spark_partition_id())
    marked.write.parquet(path)
    return spark.read.schema(marked.schema).parquet(path)


def _with_offsets(marked: DataFrame, groups: Sequence[str], sums: Sequence[Column]) -> DataFrame:
    """``marked`` with _o0, _o1, ...: each of ``sums`` over the earlier ranges of a row's group."""
    totals = marked.groupBy(*groups, "_part").agg(*(s.alias(f"_t{i}") for i, s in enumerate(sums)))
    # A group has a row for each range it reaches: no more than there are tasks.
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_part").alias("_p"), *(F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_o{i}") for i in range(len(sums))))
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        on = on & marked[g].eqNullSafe(offsets[f"_g{i}"])
    return marked.join(offsets, on).drop("_p", *(f"_g{i}" for i in range(len(groups))))


def placed(df: DataFrame, groups: Sequence[str], order: Sequence[Column], *, name: str = "k", ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``, the place (from 1, long) of a row in its group by ``order``, which has to be total.

    Rows that tie in all of ``order`` are numbered in any order.  Null groups are a group; an empty table
    gives an empty result.
    """
    joined = _with_offsets(in_ranges(df, groups, order, ranges), groups, [F.count("*")])
    own = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order))
    return joined.select(*df.columns, (own + F.col("_o0")).cast("long").alias(name))


def running_totals(df: DataFrame, key: str, sums: Sequence[str], *, groups: Sequence[str] = (), descending: bool = True, ranges: int | None = None) -> DataFrame:
    """``df`` (one row for each group and ``key``) with cum_<c> for each column: its total over the rows of the
    group up to and with this one in the order of ``key``.  Null keys come last; null groups are a group; an
    empty table gives an empty result."""
    order = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    joined = _with_offsets(in_ranges(df, groups, [order], ranges), groups, [F.sum(c) for c in sums])
    own = Window.partitionBy(*groups, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*df.columns, *((F.sum(c).over(own) + F.col(f"_o{i}")).alias(f"cum_{c}") for i, c in enumerate(sums)))


def quantiles(df: DataFrame, group: str, value: str, probabilities: Sequence[float]) -> DataFrame:
    """group, q: the exact quantiles of each group's values, interpolated between neighbours, in the order asked for.

    Equal values are counted first, within tasks and then between them, so a value that most rows have is one row.
    The counted values are put in order over ranges, so no group has to fit into a task, and only the ranges that hold
    a quantile are looked through.  Nulls and NaN don't count; a group without values has no row.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    marked = in_ranges(rows.groupBy("_g", "_v").agg(F.count("*").alias("_c")), ["_g"], [F.col("_v")])
    # A group has a row for each range it reaches: no more than there are tasks.
    own = Window.partitionBy("_g").orderBy("_part")
    sizes = marked.groupBy("_g", "_part").agg(F.sum("_c").alias("_s"))
    sizes = sizes.withColumns({"_end": F.sum("_s").over(own.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_s").over(Window.partitionBy("_g"))})
    wanted = sizes.select("_g", "_part", "_s", "_end", "_n", F.posexplode(F.array(*(F.lit(float(p)) for p in probabilities))).alias("_i", "_p"))
    place = F.col("_p") * (F.col("_n") - 1)
    low, part = F.floor(place), place - F.floor(place)
    ends = F.array(F.struct((low + 1).alias("_k"), (1 - part).alias("_w")), F.struct((F.ceil(place) + 1).alias("_k"), part.alias("_w")))
    inside = (F.col("_k") <= F.col("_end")) & (F.col("_k") > F.col("_end") - F.col("_s")) & (F.col("_w") > 0)
    wanted = wanted.select("_g", "_part", "_i", (F.col("_end") - F.col("_s")).alias("_before"), "_end", "_s", F.explode(ends).alias("e")).select("*", "e._k", "e._w").where(inside)
    listed = wanted.groupBy("_g", "_part").agg(F.collect_list(F.struct("_i", (F.col("_k") - F.col("_before")).alias("_k"), "_w")).alias("_asked"))  # two a quantile at most
    within = Window.partitionBy("_g", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = marked.alias("m").join(listed.alias("l"), F.col("m._g").eqNullSafe(F.col("l._g")) & (F.col("m._part") == F.col("l._part"))).select("m._g", "m._part", "_v", "_c", "_asked")
    counted = near.withColumn("_upto", F.sum("_c").over(within))
    hit = F.filter("_asked", lambda a: (a["_k"] <= F.col("_upto")) & (a["_k"] > F.col("_upto") - F.col("_c")))
    picked = counted.select("_g", "_v", F.explode(hit).alias("a")).select("_g", "_v", "a.*")
    each = picked.groupBy("_g", "_i").agg(F.sum(F.col("_v") * F.col("_w")).alias("_q"))
    found = F.array_sort(F.collect_list(F.struct("_i", "_q")))  # as many as are asked for
    return each.groupBy("_g").agg(F.transform(found, lambda x: x["_q"]).alias("q")).withColumnRenamed("_g", group)
