"""Rules every operator shares: nulls, total orders, ranks, guarded statistics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the domain: reward of a hit, cost of a miss, price of a feature, contacts allowed.
HIT_VALUE, MISS_COST, FEATURE_COST, MAX_TARGETS = 10, 5, 200, 1000
BREAK_EVEN = 1.0 / 3.0


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def no_nan(df: DataFrame, *names: str) -> DataFrame:
    """NaN and infinities become null: aggregates then leave them out."""
    inf = float("inf")
    return df.withColumns({n: F.when(~F.isnan(n) & (F.abs(n) != inf), F.col(n)) for n in names})


def best_first(score: str = "score", key: str = "id") -> list[Column]:
    """The total order of all rankings: highest score, then highest key."""
    return [F.col(score).desc_nulls_last(), F.col(key).desc()]


def average_rank(value: Column, groups: Sequence[str] = (), *, descending: bool = True) -> Column:
    """Rank within groups in which ties share the mean of their ranks."""
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    ranked = Window.partitionBy(*groups).orderBy(order)
    ties = Window.partitionBy(*groups, value)
    return F.rank().over(ranked) + (F.count("*").over(ties) - 1) / 2.0


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null where either side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread != 0, F.try_divide(F.covar_pop(x, y), spread))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def profit(tp: Column, fp: Column, features: Column | int = 0, *, hit: float = HIT_VALUE, miss: float = MISS_COST, feature: float = FEATURE_COST) -> Column:
    features = F.lit(features) if not isinstance(features, Column) else features
    return hit * tp - miss * fp - feature * features
