"""Aggregates: rates, weighted and shared values, distribution summaries and forecast scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import average_rank


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def rate(condition: Column) -> Column:
    """Share of rows for which the condition holds; null counts as not."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def drift(value: str, ts: list[str]) -> Column:
    """Last value less first value over time."""
    at = F.struct(*ts)
    return F.max_by(value, at) - F.min_by(value, at)


def mode_share(df: DataFrame, keys: list[str], kind: str, least_kinds: int = 2) -> DataFrame:
    """Share of the commonest kind of each group that has at least ``least_kinds`` kinds."""
    counts = df.groupBy(*keys, kind).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg((F.max("n") / F.sum("n")).alias("mode_share"), F.count("*").alias("n_kinds")).filter(F.col("n_kinds") >= least_kinds)


def distribution(value: str) -> list[Column]:
    """Mean, population deviation, deciles by linear interpolation, and extremes."""
    p = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), p[0].alias("p10"), p[1].alias("p50"), p[2].alias("p90")]


def error_metrics(predicted: Column, actual: Column) -> list[Column]:
    off = predicted - actual
    return [F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(off).alias("bias")]


def spearman(df: DataFrame, keys: list[str], a: str, b: str, least: int = 3) -> DataFrame:
    """Rank correlation with average ranks for ties; null under ``least`` rows or without variance. Rows with a null drop."""
    ranked = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"__a": average_rank(a, keys), "__b": average_rank(b, keys)})
    agg = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop("__a", "__b").alias("c"), F.stddev_pop("__a").alias("sa"), F.stddev_pop("__b").alias("sb"))
    return agg.select(*keys, "n", F.when(F.col("n") >= least, F.try_divide("c", F.col("sa") * F.col("sb"))).alias("spearman"))


def calibration(df: DataFrame, p: str, hit: str, bins: int = 10) -> DataFrame:
    """Equal bins of predicted probability, the last one closed: n, mean prediction, observed rate and their gap."""
    binned = df.withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(hit).alias("observed")).withColumn("gap", F.abs(F.col("predicted") - F.col("observed")))


def expected_calibration_error(df: DataFrame, p: str, hit: str, bins: int = 10) -> DataFrame:
    return calibration(df, p, hit, bins).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def log_loss(p: Column, hit: Column, clip: float = 1e-9) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip))
    return F.avg(-F.when(hit == 1, F.ln(q)).otherwise(F.ln(1 - q)))


def zero_filled_counts(df: DataFrame, entities: DataFrame, entity: str, period: str, periods: DataFrame) -> DataFrame:
    """Counts for each entity and period, 0 where there is none. Periods are few and are broadcast."""
    counts = df.groupBy(entity, period).agg(F.count("*").alias("n"))
    grid = entities.select(entity).distinct().withColumn("__one", F.lit(1)).join(F.broadcast(periods.select(period).distinct().withColumn("__one", F.lit(1))), "__one").drop("__one")
    return grid.join(counts, [entity, period], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def pivot_last(df: DataFrame, keys: list[str], kind: str, value: str, ts: list[str], kinds: list[str]) -> DataFrame:
    """One column for each kind with the newest value of it."""
    return df.groupBy(*keys).agg(*(F.max_by(value, F.when(F.col(kind) == k, F.struct(*ts))).alias(k) for k in kinds))


def coverage(df: DataFrame, wanted: DataFrame, name: str, value: str) -> DataFrame:
    """Audit of stored features: never written, constant, or varying; ``wanted`` lists the names."""
    seen = df.groupBy(name).agg(F.count(value).alias("n"), F.count_distinct(value).alias("n_distinct"))
    status = F.when(F.col("n").isNull() | (F.col("n") == 0), "never_written").when(F.col("n_distinct") <= 1, "constant").otherwise("ok")
    return wanted.join(seen, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), status.alias("status"))


def shared_by_all(df: DataFrame, group: str, item: str) -> DataFrame:
    """(item, n_groups, shared, unique): how many groups hold an item, in all or in one only."""
    pairs = df.select(group, item).distinct()
    total = pairs.agg(F.count_distinct(group).alias("__groups"))
    return pairs.groupBy(item).agg(F.count("*").alias("n_groups")).join(F.broadcast(total)).select(item, "n_groups", (F.col("n_groups") == F.col("__groups")).alias("shared"), (F.col("n_groups") == 1).alias("unique"))


def bounded_trust(mean_score: Column, n: Column, low: float = 0.3, high: float = 2.0) -> Column:
    """1 + score / 10, in proportion to evidence up to 30 rows, clamped."""
    return F.greatest(F.lit(low), F.least(F.lit(high), 1 + mean_score / 10 * F.least(F.lit(1.0), n / 30)))


def share_of_group(value: str, keys: list[str]) -> Column:
    return F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*keys)))
