"""Game rules as column expressions: prices, moves, squads and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rules.
QUOTA = {"GK": 2, "DEF": 5, "MID": 5, "FWD": 3}
LINEUP = {"GK": (1, 1), "DEF": (3, 5), "MID": (2, 5), "FWD": (1, 3)}
GOAL_POINTS = {"GK": 10, "DEF": 6, "MID": 5, "FWD": 4}
ACTIONS_NEEDED = {"DEF": 10}
ACTIONS_NEEDED_ELSE, ACTIONS_POINTS = 12, 2
MOST_PER_CLUB, MOST_FREE, HIT = 3, 5, 4


def by_position(position: Column, values: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(position == name, value).otherwise(out)
    return out


def selling_price(bought: Column, now: Column) -> Column:
    """Half of a gain, rounded down, is kept; a loss counts in full."""
    gain = now - bought
    return F.when(gain <= 0, now).otherwise(bought + F.floor(gain / 2).cast("int"))


def free_next(free: Column, made: Column, unlimited: Column) -> Column:
    left = F.when(unlimited, free).otherwise(F.greatest(F.lit(0), free - made))
    return F.least(F.lit(MOST_FREE), left + 1)


def hit_cost(free: Column, made: Column, unlimited: Column) -> Column:
    return F.when(unlimited, 0).otherwise(HIT * F.greatest(F.lit(0), made - free))


def threshold_points(position: Column, actions: Column) -> Column:
    return F.when(actions >= by_position(position, ACTIONS_NEEDED, ACTIONS_NEEDED_ELSE), ACTIONS_POINTS).otherwise(0)


def points(s: dict[str, Column], position: Column) -> Column:
    """Points of one appearance; a missing or null count is 0. ``defensive`` counts unless ``defensive_points`` is given."""
    n = lambda name: F.coalesce(s[name], F.lit(0)) if name in s else F.lit(0)
    minutes, back = n("minutes"), position.isin("GK", "DEF")
    clean = F.when(minutes >= 60, n("clean_sheets") * F.when(back, 4).when(position == "MID", 1).otherwise(0)).otherwise(0)
    total = F.when(minutes >= 60, 2).when(minutes > 0, 1).otherwise(0) + by_position(position, GOAL_POINTS, 0) * n("goals") + 3 * n("assists") + clean
    total -= F.when(back, F.floor(n("conceded") / 2).cast("int")).otherwise(0)
    total += F.floor(n("saves") / 3).cast("int") + 5 * n("penalties_saved") - 2 * n("penalties_missed") - n("yellow") - 3 * n("red") - 2 * n("own_goals") + n("bonus")
    given = s.get("defensive_points", F.lit(None))
    return total + F.coalesce(given, threshold_points(position, n("defensive")))


def squad_errors(picks: DataFrame, squad: str, position: str, club: str, price: str, budget: int = 1000) -> DataFrame:
    """(squad, errors): what each squad breaks, an empty list if nothing."""
    clubs = picks.groupBy(squad, club).agg(F.count("*").alias("n")).groupBy(squad).agg(F.max("n").alias("most"))
    counts = picks.groupBy(squad).agg(F.count("*").alias("n"), F.sum(price).alias("spend"), *(F.count_if(F.col(position) == p).alias(p) for p in QUOTA))
    tests = [F.when(F.col("n") != sum(QUOTA.values()), "size")] + [F.when(F.col(p) != q, p) for p, q in QUOTA.items()]
    tests += [F.when(F.col("most") > MOST_PER_CLUB, "club"), F.when(F.col("spend") > budget, "budget")]
    return counts.join(clubs, squad).select(squad, F.array_compact(F.array(*tests)).alias("errors"))


def legal_lineup(counts: dict[str, int]) -> bool:
    return sum(counts.values()) == 11 and all(a <= counts.get(p, 0) <= b for p, (a, b) in LINEUP.items())


#: The legal line-ups of ten outfield players as (defenders, midfielders, forwards).
FORMATIONS = tuple((d, m, 10 - d - m) for d in range(3, 6) for m in range(2, 6) if 1 <= 10 - d - m <= 3)


def formation(position: Column) -> tuple[Column, Column]:
    """Of the players in a group: the formation as text, and whether it is legal with its keeper."""
    n = {p: F.count_if(position == p) for p in QUOTA}
    text = F.concat_ws("-", *(n[p].cast("string") for p in ("DEF", "MID", "FWD")))
    return text, (n["GK"] == 1) & text.isin(*("-".join(map(str, f)) for f in FORMATIONS))


def effective_captain(captain: Column, captain_minutes: Column, vice: Column, vice_minutes: Column) -> Column:
    """Who counts twice: the captain, or the vice where only the vice played."""
    return F.when((F.coalesce(captain_minutes, F.lit(0)) == 0) & (F.coalesce(vice_minutes, F.lit(0)) > 0), vice).otherwise(captain)


def expiry_severity(weeks_left: Column) -> Column:
    return F.when(weeks_left <= 2, "critical").when(weeks_left <= 4, "high").otherwise("medium")


def appearance_class(minutes: Column, started: Column) -> Column:
    """0 didn't play, 1 came on, 2 started (or played an hour)."""
    m = F.coalesce(minutes, F.lit(0))
    return F.when(m == 0, 0).when((F.coalesce(started, F.lit(0)) > 0) | (m >= 60), 2).otherwise(1)
