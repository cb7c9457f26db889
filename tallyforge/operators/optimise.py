"""Squad selection under quotas, a budget and a limit for each club."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import LINEUP, MOST_PER_CLUB, QUOTA


def _best_within(pool: pd.DataFrame, budget: int) -> tuple[float, list[int]] | None:
    """The best squad by quota and budget alone: a table over money for each position, joined position by position."""
    total, picks = np.zeros(budget + 1), [[] for _ in range(budget + 1)]
    for position, quota in QUOTA.items():
        rows = pool[pool["position"] == position]
        if len(rows) < quota:
            return None
        best = np.full((quota + 1, budget + 1), -np.inf)
        best[0] = 0
        took = np.zeros((len(rows), quota + 1, budget + 1), bool)
        for i, (price, value) in enumerate(zip(rows["price"], rows["utility"], strict=True)):
            for k in range(quota, 0, -1):
                new = np.full(budget + 1, -np.inf)
                new[price:] = best[k - 1, : budget + 1 - price] + value
                took[i, k] = new > best[k]
                best[k] = np.maximum(best[k], new)
        joined, cut = np.full(budget + 1, -np.inf), np.zeros(budget + 1, int)
        for spend in range(budget + 1):
            if best[quota, spend] > -np.inf:
                new = np.full(budget + 1, -np.inf)
                new[spend:] = total[: budget + 1 - spend] + best[quota, spend]
                better = new > joined
                joined, cut = np.where(better, new, joined), np.where(better, spend, cut)
        ids, after = rows["player_id"].to_numpy(), [None] * (budget + 1)
        prices = rows["price"].to_numpy()
        for money in range(budget + 1):
            if joined[money] > -np.inf:
                chosen, k, m = [], quota, cut[money]
                for i in range(len(rows) - 1, -1, -1):
                    if k and took[i, k, m]:
                        chosen.append(int(ids[i]))
                        m -= prices[i]
                        k -= 1
                after[money] = picks[money - cut[money]] + chosen
        total, picks = joined, after
    top = int(np.argmax(total))
    return (float(total[top]), picks[top]) if total[top] > -np.inf else None


def best_squad(pool: pd.DataFrame, budget: int = 1000) -> tuple[float, list[int]]:
    """Best first search: solve without the club limit, and where a club has too many forbid one of them at a time.

    The bound of a node is exact, so the first squad that keeps the limit is the best one.
    """
    club = dict(zip(pool["player_id"], pool["team_id"], strict=True))
    first = _best_within(pool, budget)
    queue, seen = [(-first[0], [], first[1])] if first else [], {frozenset()}
    while queue:
        value, banned, squad = heapq.heappop(queue)
        counts = pd.Series([club[p] for p in squad]).value_counts()
        if counts.iloc[0] <= MOST_PER_CLUB:
            return -value, sorted(squad)
        for p in squad:
            if club[p] == counts.index[0]:
                out = frozenset([*banned, p])
                if out not in seen:
                    seen.add(out)
                    found = _best_within(pool[~pool["player_id"].isin(out)], budget)
                    if found:
                        heapq.heappush(queue, (-found[0], [*banned, p], found[1]))
    raise ValueError("no squad fits")


def best_lineup(squad: pd.DataFrame) -> list[int]:
    """Best eleven of a squad: the best of each position at every legal formation."""
    ranked = {p: squad[squad["position"] == p].sort_values(["utility", "player_id"], ascending=[False, True]) for p in LINEUP}
    best, chosen = -np.inf, []
    for d in range(LINEUP["DEF"][0], LINEUP["DEF"][1] + 1):
        for m in range(LINEUP["MID"][0], LINEUP["MID"][1] + 1):
            f = 10 - d - m
            if LINEUP["FWD"][0] <= f <= LINEUP["FWD"][1]:
                eleven = pd.concat([ranked[p].head(k) for p, k in (("GK", 1), ("DEF", d), ("MID", m), ("FWD", f))])
                if len(eleven) == 11 and eleven["utility"].sum() > best:
                    best, chosen = eleven["utility"].sum(), eleven["player_id"].tolist()
    return sorted(int(p) for p in chosen)


def undominated(candidates: DataFrame, key: str) -> DataFrame:
    """``candidates`` without those that MOST_PER_CLUB others of their group, position and club match in price and utility.

    A squad that holds such a one has at most MOST_PER_CLUB - 1 more of its club, so one of the others can take its place:
    the best squad's utility stays the same. Of equals the smallest player_id counts as better.
    """
    same = [key, "position", "team_id"]
    best = Window.partitionBy(*same, "price").orderBy(F.col("utility").desc(), "player_id")
    few = candidates.withColumn("__rn", F.row_number().over(best)).filter(F.col("__rn") <= MOST_PER_CLUB)
    before = Window.partitionBy(*same).orderBy("price", F.col("utility").desc(), "player_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = few.withColumn("__before", F.collect_list("utility").over(before))
    beaten = F.size(F.filter("__before", lambda u: u >= F.col("utility"))) >= MOST_PER_CLUB
    return ranked.filter(~beaten).select(candidates.columns)


def select_squads(candidates: DataFrame, key: str, budget: int = 1000) -> DataFrame:
    """(key, player_id, in_lineup, squad_utility): one optimal squad for each group of candidates.

    Only candidates that can change the optimum are gathered; there are at most MOST_PER_CLUB for each group, position, club and price.
    """

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("player_id").reset_index(drop=True)
        value, squad = best_squad(pool, budget)
        lineup = set(best_lineup(pool[pool["player_id"].isin(squad)]))
        return pd.DataFrame({key: pool[key].iloc[0], "player_id": squad, "in_lineup": [p in lineup for p in squad], "squad_utility": value})

    kind = dict(candidates.dtypes)[key]
    return undominated(candidates, key).groupBy(key).applyInPandas(run, f"{key} {kind}, player_id long, in_lineup boolean, squad_utility double")
