"""Multi-period planning of moves by beam search, with a plan that does nothing and one that only waits to compare.

A state is a squad, money and free moves. Each period a state may stay or make one of its best single moves, each
further one costing points beyond the free ones; the best states of a period go on. It is a heuristic: it is exact
only where the beam holds every state.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.rules import HIT, MOST_FREE, MOST_PER_CLUB

DISCOUNT = 0.84


def single_moves(squad: frozenset, bank: int, pool: dict[int, dict], period: int, horizon: int, most: int) -> list[tuple[float, int, int]]:
    """The (gain, out, in) swaps of one position that gain most over the remaining periods and keep club and money rules."""
    worth = lambda p: sum(pool[p]["points"][t] * DISCOUNT ** (t - period) for t in range(period, horizon))
    clubs: dict[int, int] = {}
    for p in squad:
        clubs[pool[p]["team_id"]] = clubs.get(pool[p]["team_id"], 0) + 1
    found = []
    for out in squad:
        for new, row in pool.items():
            if new in squad or row["position"] != pool[out]["position"] or row["price"] > pool[out]["price"] + bank:
                continue
            if clubs.get(row["team_id"], 0) - (pool[out]["team_id"] == row["team_id"]) >= MOST_PER_CLUB:
                continue
            if (gain := worth(new) - worth(out)) > 0:
                found.append((gain, out, new))
    return sorted(found, reverse=True)[:most]


def plan(pool: dict[int, dict], squad: frozenset, bank: int, free: int, horizon: int, beam: int = 20, moves: int = 6) -> tuple[float, list[tuple[int, int, int]]]:
    """(discounted points less hits, moves as (period, out, in)) of the best plan that the beam finds."""
    states = [(0.0, squad, bank, free, ())]
    for t in range(horizon):
        after = []
        for value, now, money, left, done in states:
            options = [(None, now, money, 0)]
            for _, out, new in single_moves(now, money, pool, t, horizon, moves):
                options.append(((t, out, new), now - {out} | {new}, money + pool[out]["price"] - pool[new]["price"], 1))
            for move, then, cash, made in options:
                points = sum(pool[p]["points"][t] for p in then) * DISCOUNT**t - HIT * max(0, made - left)
                after.append((value + points, then, cash, min(MOST_FREE, max(0, left - made) + 1), (*done, move) if move else done))
        best: dict[tuple, tuple] = {}
        for s in sorted(after, key=lambda s: (-s[0], s[4])):
            best.setdefault((s[1], s[3]), s)
        states = list(best.values())[:beam]
    return states[0][0], list(states[0][4])


def plan_squads(candidates: DataFrame, key: str, horizon: int, least_gain: float = 0.0) -> DataFrame:
    """(key, period, out_id, in_id, value, baseline) of each group's plan, if it beats doing nothing by ``least_gain``.

    ``candidates`` has, for each group, player_id, position, team_id, price, points (an array, one for each period) and owned.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        pool = {int(r["player_id"]): {"position": r["position"], "team_id": r["team_id"], "price": int(r["price"]), "points": list(r["points"])} for r in group.sort_values("player_id").to_dict("records")}
        squad = frozenset(int(p) for p in group.loc[group["owned"], "player_id"])
        idle = sum(pool[p]["points"][t] * DISCOUNT**t for p in squad for t in range(horizon))
        value, moves = plan(pool, squad, 0, 1, horizon)
        moves = moves if value - idle > least_gain else []
        return pd.DataFrame({key: [group[key].iloc[0]] * len(moves), "period": [m[0] for m in moves], "out_id": [m[1] for m in moves], "in_id": [m[2] for m in moves], "value": value, "baseline": idle})

    kind = dict(candidates.dtypes)[key]
    return candidates.groupBy(key).applyInPandas(run, f"{key} {kind}, period int, out_id long, in_id long, value double, baseline double")
