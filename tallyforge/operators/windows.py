"""Analytic operators over time-ordered rows of an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def before(keys: list[str], order: list[str], n: int) -> WindowSpec:
    """The ``n`` rows before the current one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)


def rolling_sum(value: str, keys: list[str], order: list[str], n: int) -> Column:
    """Sum of the last ``n`` values strictly before the row; null without history."""
    return F.sum(value).over(before(keys, order, n))


def ewma(values_oldest_first: Column, half_life: float) -> Column:
    """Weighted mean of an array with weight 0.5^(i / half_life), i counted from its last element."""
    newest = F.reverse(values_oldest_first)
    weighted = F.transform(newest, lambda x, i: F.struct((x * F.pow(F.lit(0.5), i / half_life)).alias("v"), F.pow(F.lit(0.5), i / half_life).alias("w")))
    total = F.aggregate(weighted, F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w")), lambda a, x: F.struct((a.v + x.v).alias("v"), (a.w + x.w).alias("w")))
    return F.when(F.size(newest) > 0, total.v / total.w)


def last_values(value: str, keys: list[str], order: list[str], n: int) -> Column:
    """The last ``n`` values before the row, oldest first; nulls are left out."""
    return F.collect_list(value).over(before(keys, order, n))


def leading_streak(flags_newest_first: Column) -> Column:
    """How many flags hold before the first that doesn't."""
    return F.when(F.array_position(flags_newest_first, False) > 0, F.array_position(flags_newest_first, False) - 1).otherwise(F.size(flags_newest_first)).cast("long")


def shrink(value: Column, n: Column, prior: Column, k: float) -> Column:
    """A rate drawn to its prior as if the prior had been seen ``k`` times."""
    return (n * value + k * prior) / (n + k)


def trailing_sum(value: str, keys: list[str], seconds: Column, days: int, inclusive_now: bool = True) -> Column:
    """Sum over the last ``days`` days by time, both ends included."""
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-days * 86400, 0 if inclusive_now else -1))


def forward_decay(value: str, keys: list[str], order: list[str], n: int, factor: float = 0.84) -> Column:
    """Sum of factor^i times the i-th of the next ``n`` values, the row itself first; nulls keep their place."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, n - 1)
    items = F.collect_list(F.struct(F.col(value).alias("v"))).over(frame)
    return F.aggregate(F.transform(items, lambda x, i: F.coalesce(x["v"] * F.pow(F.lit(factor), i), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)


def percentile_in_group(value: str, keys: list[str]) -> Column:
    """Share of the group whose value is at most the row's."""
    return F.cume_dist().over(Window.partitionBy(*keys).orderBy(value))


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank from 1 where ties share the mean of their places."""
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(ties) - 1) / 2


def rank_award(score: str, keys: list[str], top: int = 3) -> Column:
    """top, top - 1, ... 1 by competition rank of the score, highest first; ties get the same award, then 0."""
    return F.greatest(F.lit(0), F.lit(top + 1) - F.rank().over(Window.partitionBy(*keys).orderBy(F.col(score).desc())))


def decay(days: Column, half_life: float) -> Column:
    """0.5^(days / half_life), where the future counts as now."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), days) / half_life)


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone, fractions included."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def days_between(later: Column, earlier: Column) -> Column:
    return (epoch(later) - epoch(earlier)) / 86400


def banked(made_oldest_first: Column, cap: int = 5) -> Column:
    """Free moves after each period: spend, add one, at most ``cap``; starts with one."""
    return F.aggregate(made_oldest_first, F.lit(1).cast("long"), lambda free, made: F.least(F.lit(cap).cast("long"), F.greatest(F.lit(0).cast("long"), free - made) + 1))


def holdout_keys(df: DataFrame, keys: list[str], last: int = 5) -> DataFrame:
    """``df`` with is_holdout: whether its key is among the last distinct ones.

    The distinct keys (periods, few) are ranked apart and joined back, so the rows aren't sorted in one task.
    """
    recent = df.select(*keys).distinct().orderBy(*(F.col(k).desc() for k in keys)).limit(last).withColumn("is_holdout", F.lit(True))
    return df.join(F.broadcast(recent), keys, "left").withColumn("is_holdout", F.coalesce("is_holdout", F.lit(False)))
