"""A registry of point-in-time features, a tall store of their values, and an audit of it.

A feature is a function from a history to a Column; it only sees rows strictly before the row it describes. All
registered features of a history are computed in one pass over one sort of it, then melted to (entity, time, name,
value) rows without nulls.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .operators import windows as W


@dataclass(frozen=True)
class History:
    """Columns of a table of observations: whom, when (with a tie-breaker), what kind, and how much."""

    entity: str
    ts: str
    tie: str
    kind: str
    value: str

    @property
    def keys(self) -> list[str]:
        return [self.entity]

    @property
    def order(self) -> list[str]:
        return [self.ts, self.tie]


@dataclass(frozen=True)
class Feature:
    name: str
    build: Callable[[History], Column]
    group: str
    version: int
    description: str


REGISTRY: dict[str, Feature] = {}


def feature(name: str, group: str, version: int = 1) -> Callable[[Callable[[History], Column]], Callable[[History], Column]]:
    def register(build: Callable[[History], Column]) -> Callable[[History], Column]:
        REGISTRY[name] = Feature(name, build, group, version, (build.__doc__ or "").strip())
        return build

    return register


def _sum_of_last(n: int) -> None:
    @feature(f"value_last{n}", "form")
    def build(h: History) -> Column:
        """Sum of the last values before the row."""
        return W.rolling_sum(h.value, h.keys, h.order, n)


for _n in (1, 3, 5, 10):
    _sum_of_last(_n)


@feature("value_ewma5", "form")
def value_ewma5(h: History) -> Column:
    """Mean of the last 5 values with half-life 3."""
    return W.ewma(W.last_values(h.value, h.keys, h.order, 5), 3.0)


@feature("high_streak", "form")
def high_streak(h: History) -> Column:
    """Values of at least 20 in a row just before the row, of the last 40."""
    return W.leading_streak(F.transform(F.reverse(W.last_values(h.value, h.keys, h.order, 40)), lambda x: x >= 20)).cast("double")


@feature("hit_rate_last10", "form")
def hit_rate_last10(h: History) -> Column:
    """Share of the last 10 values of at least 50, among those of at least 5."""
    return F.avg(F.when(F.col(h.value) >= 5, (F.col(h.value) >= 50).cast("double"))).over(W.before(h.keys, h.order, 10))


@feature("margin_last10", "form")
def margin_last10(h: History) -> Column:
    """Mean distance of the last 10 values to 50, among those of at least 5."""
    return F.avg(F.when(F.col(h.value) >= 5, F.col(h.value) - 50)).over(W.before(h.keys, h.order, 10))


def _seconds(h: History) -> Column:
    return F.floor(W.epoch(F.col(h.ts))).cast("long")


def _trailing(days: int) -> None:
    @feature(f"value_{days}d", "congestion")
    def build(h: History) -> Column:
        """Sum of values in the days before the row."""
        return F.sum(h.value).over(Window.partitionBy(h.entity).orderBy(_seconds(h)).rangeBetween(-days * 86400, -1))


for _n in (7, 14, 21):
    _trailing(_n)


@feature("days_since_last", "congestion")
def days_since_last(h: History) -> Column:
    """Days since the last observation, with fractions."""
    return W.days_between(F.col(h.ts), F.lag(h.ts).over(Window.partitionBy(h.entity).orderBy(*h.order)))


@feature("days_since_first", "congestion")
def days_since_first(h: History) -> Column:
    """Days since the oldest of the last 40 observations."""
    return W.days_between(F.col(h.ts), F.min(h.ts).over(W.before(h.keys, h.order, 40)))


@feature("n_before", "history")
def n_before(h: History) -> Column:
    """Observations before the row, of the last 40."""
    return F.count("*").over(W.before(h.keys, h.order, 40)).cast("double")


@feature("kinds_last10", "history")
def kinds_last10(h: History) -> Column:
    """Different kinds among the last 10 observations."""
    return F.size(F.collect_set(h.kind).over(W.before(h.keys, h.order, 10))).cast("double")


def build_wide(df: DataFrame, h: History, names: list[str] | None = None) -> DataFrame:
    """``df`` with a column for each feature."""
    chosen = [REGISTRY[n] for n in names or sorted(REGISTRY)]
    return df.withColumns({f.name: f.build(h).cast("double") for f in chosen})


def build_tall(df: DataFrame, h: History, names: list[str] | None = None) -> DataFrame:
    """(entity, tie, ts, name, value) of each feature that has a value."""
    names = names or sorted(REGISTRY)
    wide = build_wide(df, h, names).select(h.entity, h.tie, h.ts, *names)
    return wide.unpivot([h.entity, h.tie, h.ts], names, "name", "value").filter("value is not null")


def explain(tall: DataFrame, scope: list[str]) -> DataFrame:
    """Stored values with their percentile among the values of the same feature and scope."""
    return tall.withColumn("percentile", W.percentile_in_group("value", [*scope, "name"]))
