"""Look-ups, states and merges of entities over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import top_per_group


def three_valued(asked: DataFrame, sheets: DataFrame, scope: str, entity: str, ts: str, flag: str, out: str) -> DataFrame:
    """``asked`` with the newest flag of its scope and entity: false if the scope has a sheet without it, null if it has none."""
    newest = sheets.groupBy(scope, entity).agg(F.max_by(flag, ts).alias("__flag"))
    known = sheets.select(scope).distinct().withColumn("__sheet", F.lit(True))
    joined = asked.join(newest, [scope, entity], "left").join(known, scope, "left")
    return joined.withColumn(out, F.when(F.col("__sheet"), F.coalesce("__flag", F.lit(False)))).drop("__flag", "__sheet")


def next_rows(rows: DataFrame, entity: str, order: list[str], after: Column, n: int, rank: str = "nth") -> DataFrame:
    """The first ``n`` rows of each entity for which ``after`` holds."""
    return top_per_group(rows.filter(after), [entity], [F.col(c) for c in order], n, rank)


def resolve_states(states: DataFrame, key: str, source: str, visible: list[str], order: list[str]) -> DataFrame:
    """The newest state of each key whose source may be seen."""
    newest = states.filter(F.col(source).isin(*visible)).groupBy(key)
    return newest.agg(F.max_by(F.struct(*(c for c in states.columns if c != key)), F.struct(*order)).alias("__row")).select(key, "__row.*")


def merge_ids(facts: DataFrame, mapping: DataFrame, column: str, keys: list[str], old: str = "old", new: str = "canon") -> DataFrame:
    """``facts`` with ids of merged entities replaced; where that makes keys alike, a row of the entity that stays is kept, else the
    one of the smallest old id."""
    moved = facts.join(mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new")), F.col(column) == F.col("__old"), "left")
    moved = moved.withColumns({"__was": F.col(column), "__moved": F.col("__new").isNotNull(), column: F.coalesce("__new", column)}).drop("__old", "__new")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("__moved", "__was"))
    return moved.withColumn("__n", first).filter("__n = 1").drop("__n", "__was", "__moved")


def find_or_create(wanted: DataFrame, known: DataFrame, name: str, born: str, entity: str) -> DataFrame:
    """``wanted`` with the smallest known entity of its name whose birth date is equal or not known on either side; null where
    one has to be created."""
    other = known.select(F.col(name).alias("__name"), F.col(born).alias("__born"), F.col(entity).alias("__entity"))
    wanted = wanted.withColumn("__row", F.monotonically_increasing_id())
    fits = F.col(born).eqNullSafe(F.col("__born")) | F.col("__born").isNull() | F.col(born).isNull()
    met = wanted.join(other, (F.col(name) == F.col("__name")) & fits).groupBy("__row").agg(F.min("__entity").alias(entity))
    return wanted.join(met, "__row", "left").drop("__row")


def duplicate_entities(rows: DataFrame, entity: str, code: str, name: str, season: str) -> DataFrame:
    """(entity, canon) of entities that share an external code with another one. Entities reachable from two codes are left out;
    the one that stays has a name without digits, then the newest season, then the smallest id."""
    per = rows.groupBy(entity, code).agg(F.max_by(name, season).alias("__name"), F.max(season).alias("__season"))
    clear = per.withColumn("__codes", F.count("*").over(Window.partitionBy(entity))).filter("__codes = 1")
    best = F.min(F.struct(F.col("__name").rlike("[0-9�]").alias("odd"), (-F.col("__season")).alias("age"), F.col(entity).alias("id")))
    groups = clear.groupBy(code).agg(F.count("*").alias("n"), best.alias("best")).filter("n > 1")
    return clear.join(groups, code).select(entity, F.col("best.id").alias("canon")).filter(F.col(entity) != F.col("canon"))


def decayed_by_row(value: str, keys: list[str], order: list[str], factor: float) -> Column:
    """The row's value times factor^i, i counted from the newest row of its group."""
    newest_first = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return F.col(value) * F.pow(F.lit(factor), F.row_number().over(newest_first) - 1)


def best_lineups(picks: DataFrame, squad: str, position: str, utility: str, entity: str, formations: list[tuple[int, int, int]]) -> DataFrame:
    """(squad, formation, total): the line-up of most utility that each squad can field, exact for any utilities.

    For a formation the best are the first of each position, so sums over ranks decide; ties go to the first formation.
    """
    spark = picks.sparkSession
    ranked = picks.withColumn("__n", F.row_number().over(Window.partitionBy(squad, position).orderBy(F.col(utility).desc(), entity)))
    shapes = spark.createDataFrame([(f"{d}-{m}-{f}", p, n) for d, m, f in formations for p, n in (("GK", 1), ("DEF", d), ("MID", m), ("FWD", f))], f"formation string, {position} string, need int")
    fielded = ranked.join(F.broadcast(shapes), position).filter(F.col("__n") <= F.col("need"))
    totals = fielded.groupBy(squad, "formation").agg(F.sum(utility).alias("total"), F.count("*").alias("n")).filter("n = 11")
    best = F.min(F.struct((-F.round("total", 9)).alias("t"), F.col("formation"), F.col("total")))
    return totals.groupBy(squad).agg(best.alias("b")).select(squad, "b.formation", "b.total")


def promotes(new: Column, old: Column, mine: Column, theirs: Column, same_holdout: Column, higher_better: Column) -> Column:
    """Whether a challenger replaces the model in use: yes without one in use, no if it is unmeasured; by scores on the same rows if
    there are any, else by the stored score, which counts only if it is of the same holdout."""
    better = lambda a, b: F.when(higher_better, a > b).otherwise(a < b)
    return F.when(new.isNull(), False).when(mine.isNotNull() & theirs.isNotNull(), better(mine, theirs)).when(old.isNull() | ~same_holdout, True).otherwise(better(new, old))
