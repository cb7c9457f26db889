"""Point-in-time joins and newest-row selections.

All of them need one shuffle on the entity key. The as-of join sorts facts and probes together and carries the last
fact forward, so it never multiplies rows as an inequality join would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(probes: DataFrame, facts: DataFrame, key: str, probe_ts: str, fact_ts: str, values: list[str], strict: bool = True, prefix: str = "asof_") -> DataFrame:
    """``probes`` with each value of the newest fact of the same key before (or, if not strict, at) the probe's time.

    Facts with a null time or key match nothing; probes without a fact get nulls. Among facts of one time the one with the
    greatest values, compared in order, wins. A null in the newest fact stays null.
    """
    fact = F.struct(*(F.col(v).alias(v) for v in values))
    left = probes.select(F.col(key).alias("__key"), F.col(probe_ts).alias("__ts"), F.lit(0 if strict else 1).alias("__side"), F.struct(*(F.col(c) for c in probes.columns)).alias("__probe"), F.lit(None).cast(facts.select(fact.alias("f")).schema["f"].dataType).alias("__fact"))
    right = facts.filter(F.col(fact_ts).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(fact_ts).alias("__ts"), F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(left.schema["__probe"].dataType).alias("__probe"), fact.alias("__fact"))
    order = Window.partitionBy("__key").orderBy(F.col("__ts").asc_nulls_first(), "__side", "__fact").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = left.unionByName(right).withColumn("__last", F.last("__fact", ignorenulls=True).over(order)).filter("__probe is not null")
    return found.select("__probe.*", *(F.col(f"__last.{v}").alias(prefix + v) for v in values))


def latest_per_group(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The newest rows of each group, ties kept; null keys are a group, rows without a time are in no result.

    Newest times combine before their shuffle, and rows meet them by key and time, so that the rows of a large group spread
    over tasks instead of being sorted in one.
    """
    newest = df.groupBy(*(F.col(k).alias(f"__key{i}") for i, k in enumerate(keys))).agg(F.max(ts).alias("__newest"))
    same = F.col(ts) == F.col("__newest")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    return df.join(newest, same, "left_semi")


def latest_before(df: DataFrame, keys: list[str], ts: str, bound: Column) -> DataFrame:
    """The newest rows of each group strictly before ``bound``, ties kept."""
    return latest_per_group(df.filter(F.col(ts) < bound), keys, ts)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows of each group; Spark stops ranking a group at ``n`` rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def range_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, days: int = 1) -> DataFrame:
    """Pairs of the same key with the right time in [day of left, day + ``days``).

    The day is part of the join key, so pairs meet by an equi-join; each left row is repeated once for each day.
    """
    days_of = left.withColumn("__day", F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_add(F.to_date(left_ts), i))))
    return days_of.join(right.withColumn("__day", F.to_date(right_ts)), [key, "__day"]).drop("__day")
