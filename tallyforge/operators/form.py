"""Form of players as window expressions over their own history: rates per 90 minutes, shares, thresholds, duties.

Each takes a frame (the last rows before the one it describes) and column names, so that all features of a history come
from one sort. What isn't known is null.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from .windows import shrink

#: Share of penalties that a first, second and third taker takes, chances by status, weights of sources by kind.
PENALTY_SHARE = {1: 0.9, 2: 0.08, 3: 0.02}
VOTES = {"available": 1.0, "doubtful": 0.5, "injured": 0.0, "suspended": 0.0}
SOURCE_WEIGHT = {"official": 2.0, "club": 1.5, "press": 1.0, "social": 0.6, "forum": 0.8}
OTHER_WEIGHT, PRIOR_MATCHES = 0.5, 5


def started(starts: str, minutes: str) -> Column:
    """A start on the sheet, or an hour played where the sheet is missing."""
    return (F.coalesce(F.col(starts), F.lit(0)) > 0) | (F.coalesce(F.col(minutes), F.lit(0)) >= 60)


def per90(value: Column, minutes: str, w: WindowSpec) -> Column:
    """90 times the sum over played rows by their minutes; null without minutes."""
    played = F.col(minutes) > 0
    return F.try_divide(90.0 * F.sum(F.when(played, value)).over(w), F.sum(F.when(played, F.col(minutes))).over(w))


def shrunk90(value: Column, minutes: str, w: WindowSpec, prior: Column, k: float = PRIOR_MATCHES) -> Column:
    """``per90`` drawn to a prior by the number of whole matches seen; the prior without any."""
    matches = F.coalesce(F.sum(F.when(F.col(minutes) > 0, F.col(minutes))).over(w) / 90.0, F.lit(0.0))
    return F.coalesce(shrink(per90(value, minutes, w), matches, prior, k), prior)


def share(condition: Column, among: Column, w: WindowSpec) -> Column:
    """Share of rows that meet a condition among those that count; null where none counts."""
    return F.avg(F.when(among, condition.cast("double"))).over(w)


def defensive_actions(official: str, parts: list[str], recoveries: str, position: str) -> Column:
    """The official count, or the sum of its parts; recoveries count for all but defenders."""
    total = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts), F.lit(0))
    return F.coalesce(F.col(official), total + F.when(F.col(position) == "DEF", 0).otherwise(F.coalesce(F.col(recoveries), F.lit(0))))


def lookup(key: Column, values: dict, default: Column) -> Column:
    out = default
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def chance_of_playing(chance: Column, status: Column) -> Column:
    """The official chance in percent; without one, 100 for who is available and 0 for all others."""
    return F.coalesce(chance.cast("double"), F.when(status == "available", 100.0).otherwise(0.0))


def price_progress(net: Column, owned_percent: Column) -> Column:
    """Net moves as a share of those that would change a price at this ownership, within -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), net / (owned_percent * 100000 * 0.08 + 1)))


def split_opinion(share_positive: Column, n: Column, least: int = 3) -> Column:
    """1 where calls are split evenly, 0 where all agree; null for fewer than ``least`` calls."""
    return F.when(n >= least, 1 - F.abs(2 * share_positive - 1))
