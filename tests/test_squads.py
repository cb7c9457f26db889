"""Drafts, swaps, chips, rivals, pushes and substitutions on tables worked out by hand, and against plain replays."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import rules as R
from tallyforge.operators import squads as Q
from tallyforge.operators.asof import latest_per_group
from tallyforge.operators.states import resolve_states

EDIT = "squad int, step int, kind string, player int, price int"
PICK = "squad int, player int, is_captain boolean, is_vice boolean, purchase_price int"


def replayed(base, edits, now):
    """Each squad's open draft after its edits, one after the other."""
    drafts = {}
    for squad, _, kind, player, price in sorted((e for e in edits if e[0] is not None and e[1] is not None and e[2] is not None), key=lambda e: e[1]):
        if kind == "seed":
            drafts[squad] = {p: [c, v, b] for s, p, c, v, b in base if s == squad}
        elif kind == "discard":
            drafts.pop(squad, None)
        elif squad in drafts:
            draft = drafts[squad]
            if kind == "drop":
                draft.pop(player, None)
            elif kind == "add" and player not in draft and now.get(player) is not None:
                draft[player] = [False, False, now[player]]
            elif kind == "price" and player in draft and price is not None and price > 0:
                draft[player][2] = price
            elif kind in ("captain", "vice"):
                for p, row in draft.items():
                    row[("captain", "vice").index(kind)] = p == player
    selling = lambda paid, today: today if today <= paid else paid + (today - paid) // 2
    return {(s, p, c, v, b, selling(b, b if now.get(p) is None else now[p])) for s, draft in drafts.items() for p, (c, v, b) in draft.items()}


@pytest.mark.parametrize("seed", range(6))
def test_drafts_equal_a_replay(spark, seed):
    rng = random.Random(seed)
    base = [(s, p, p == s, p == s + 1, 40 + p) for s in range(6) for p in range(s, s + 5)]
    now = {p: None if p % 7 == 6 else 30 + 3 * p for p in range(12)}
    kinds = ["seed", "discard"] + ["add", "drop", "price", "captain", "vice"] * 4
    edits = [(rng.randrange(7), i, rng.choice(kinds), rng.randrange(14), rng.randrange(-5, 90)) for i in range(400)]
    edits += [(s, -1, "seed", None, None) for s in range(6)] + [(None, 5, "add", 1, 1), (1, None, "drop", 1, 1), (2, 401, None, 3, 1), (3, 402, "add", None, None), (3, 403, "price", 3, None)]
    found = Q.draft_picks(spark.range(6).selectExpr("CAST(id AS INT) AS squad"), spark.createDataFrame(base, PICK), spark.createDataFrame(edits, EDIT), spark.createDataFrame(list(now.items()), "player int, now int"))
    assert {tuple(r) for r in found.collect()} == {r for r in replayed(base, edits, now) if r[0] < 6}
    assert found.count() == len({tuple(r) for r in found.collect()})


def fifteen(squad=0, first=0):
    """A legal squad: (squad, player, position, club, price, utility)."""
    spots = [p for p, n in R.QUOTA.items() for _ in range(n)]
    return [(squad, first + i, p, i % 5, 50, float(100 - i)) for i, p in enumerate(spots)]


def test_a_draft_is_checked_committed_cloned_and_seen(spark):
    squad = fifteen()
    players = spark.createDataFrame([r[1:4] for r in squad] + [(90, "MID", 0), (91, "FWD", None)], "player int, position string, club int")
    pick = [(0, r[1], False, False, 50, 50) for r in squad]
    broken = [(1, r[1], False, False, 50, 50) for r in squad[:-1]] + [(1, 90, False, False, 900, 50)]
    draft = spark.createDataFrame([*pick, *broken], PICK + ", selling_price int")
    opened = spark.createDataFrame([(0,), (1,), (2,)], "squad int")
    checks = Q.checked_drafts(opened, draft, players)
    assert {r.squad: r.errors for r in checks.collect()} == {0: [], 1: ["MID", "FWD", "club", "budget"], 2: ["size", "GK", "DEF", "MID", "FWD"]}
    states = Q.committed(draft, checks, F.lit(7), F.lit(100))
    assert {(r.squad, r.source, r.period) for r in states.collect()} == {(0, "manual", 7)} and states.count() == 15
    copies = Q.cloned(states, spark.createDataFrame([(0, 8), (0, 9), (5, 6)], "squad int, copy int"))
    assert copies.groupBy("squad").count().sort("squad").collect() == [(8, 15), (9, 15)] and copies.columns == states.columns
    # a planned state is newer, and yet it isn't the squad that is owned
    plans = spark.createDataFrame([(1, 0, [4, 5]), (2, 0, [6]), (3, 1, [7])], "plan int, squad int, picks array<int>")
    answers = spark.createDataFrame([(1, 1, False, 10, "no"), (1, 2, True, 11, "ignored"), (2, 1, False, 12, "too dear")], "plan int, step int, accepted boolean, at int, reason string")
    answered, planned = Q.accepted(plans, answers)
    assert sorted(map(tuple, answered.select("plan", "accepted", "answered_at", "reason").collect())) == [(1, True, 11, None), (2, False, 12, "too dear"), (3, None, None, None)]
    assert sorted(map(tuple, planned.collect())) == [(0, 1, "planned", 1, 4), (0, 1, "planned", 2, 5)]
    both = states.select("squad", "source", F.lit(1).alias("at")).distinct().unionByName(planned.select("squad", "source", F.lit(2).alias("at")).distinct())
    assert [r.source for r in resolve_states(both, "squad", "source", ["manual", "sync"], ["at"]).collect()] == ["manual"]
    assert latest_per_group(both, ["squad"], "at").count() == 1


def test_forced_swaps_choose_the_lineup_anew(spark):
    rows = [*fifteen(), (None, 50, "FWD", 4, 50, 200.0), (None, 51, "FWD", 4, 900, 300.0), (None, 52, "MID", 4, 50, 1.0), (None, 53, "FWD", 0, 50, 2.0)]
    players = spark.createDataFrame([r[1:] for r in rows], "player int, position string, club int, price int, utility double")
    picks = spark.createDataFrame([r[:2] for r in fifteen()], "squad int, player int")
    swaps = [(1, 0, 14, 50), (2, 0, 14, 51), (3, 0, 14, 52), (4, 0, 77, 50), (5, 0, 14, 99), (6, 0, 14, 3), (7, 0, None, 50), (8, 0, 14, 53)]
    found = {r.swap: (r.delta, r.note) for r in Q.forced_swaps(picks, spark.createDataFrame(swaps, "swap int, squad int, out_player int, in_player int"), players).collect()}
    # the best before: keeper 100, five defenders 98..94, four midfielders 93..90, forward 88; after it the new forward plays
    # beside the best ten of what is left
    assert found[1] == (200.0 - 88.0, None)
    assert found[2] == (None, "breaks budget") and found[3] == (None, "breaks MID,FWD") and found[8] == (None, "breaks club")
    assert found[4] == (None, "not held") and found[5] == (None, "unknown player") and found[6] == (None, "already held") and found[7] == (None, "unknown player")


def test_chips_are_not_timed_while_all_weeks_are_alike(spark):
    clubs = spark.createDataFrame([(s, c) for s in (1, 2) for c in range(15)], "squad int, club int")
    even = [(w, c, 1) for w in range(1, 6) for c in range(15)]
    used = spark.createDataFrame([(1, "bboost", 2)], "squad int, chip string, week int")
    fixtures = lambda rows: spark.createDataFrame(rows, "week int, club int, n int")
    alike = {(r.squad, r.chip): r for r in Q.chip_calendar(clubs, fixtures(even), [1, 2, 3, 4, 5], used, 19).collect()}
    assert {r.confidence for r in alike.values()} == {"none"} and (1, "bboost") not in alike and alike[2, "bboost"].week == 1
    double = [(w, c, 2 if w == 4 else 0 if w == 5 and c < 9 else 1) for w, c, _ in even]
    forecast = spark.createDataFrame([(2, 9.5), (2, 8.0)], "week int, best double")
    timed = {(r.squad, r.chip): r for r in Q.chip_calendar(clubs, fixtures(double), [1, 2, 3, 4, 5], used, 19, forecast).collect()}
    assert (timed[2, "bboost"].week, timed[2, "bboost"].gain, timed[2, "bboost"].confidence) == (4, 24.0, "high")
    assert (timed[2, "freehit"].week, timed[2, "freehit"].gain, timed[2, "freehit"].second_gain) == (5, 36.0, 0.0)
    assert (timed[2, "3xc"].week, timed[2, "3xc"].second_week, timed[2, "3xc"].confidence) == (4, 2, "high")
    assert (timed[2, "wildcard"].week, timed[2, "wildcard"].confidence) == (1, "low")
    assert Q.chip_calendar(clubs.limit(0), fixtures(even), [1], used, 19).count() == 0


def test_rivals(spark):
    totals = spark.createDataFrame([("a", 1, d, t, 1) for d, t in enumerate([10, 1, 5])] + [("a", 2, d, t, 2) for d, t in enumerate([9, 3, 5])] + [("b", 3, 0, 1, 1)], "league string, squad int, draw int, total int, standing int")
    owned = spark.createDataFrame([(1, 2.0, 100.0), (1, 3.0, 50.0), (2, 4.0, None)], "squad int, deviation double, ownership double")
    found = {r.squad: r for r in Q.against_rivals(totals, owned, "win_league").collect()}
    assert found[1].p_first == found[2].p_first == pytest.approx(2 / 3) and (found[1].place, found[2].place) == (1, 2)
    assert (found[1].rank_risk, found[2].rank_risk, found[3].rank_risk) == (1.5, 4.0, 0.0)
    assert {r.squad: r.place for r in Q.against_rivals(totals, owned, "protect_rank").collect()} == {1: 2, 2: 1, 3: 1}


def test_pushes_are_refused_by_the_first_guard(spark):
    schema = "id int, enabled boolean, period int, confirmation string, dry_run boolean, previewed_at timestamp, asked_at timestamp, entry int, hits int, chip string, has_state boolean, moves array<struct<element_in int, element_out int>>"
    at = "2024-01-01 10:00:00"
    rows = [(1, None, 3, "no", False, None, at, None, 2, "3xc", None), (2, True, 3, "PUSH GW4", False, None, at, None, 0, None, True), (3, True, 3, "PUSH GW3", False, None, at, 5, 0, None, True), (4, True, 3, "PUSH GW3", False, "2024-01-01 09:49:59", at, 5, 0, None, True), (5, True, 3, "PUSH GW3", False, "2024-01-01 09:50:00", at, 5, 0, None, True), (6, True, 3, "PUSH GW3", True, None, at, None, 0, None, True)]
    text = schema.replace("timestamp", "string")
    df = spark.createDataFrame([(*r, [(1, 2)]) for r in rows], text).withColumns({c: F.to_timestamp(c) for c in ("previewed_at", "asked_at")})
    found = {r.id: r for r in Q.push_checks(df).collect()}
    assert [found[i].refusal for i in range(1, 7)] == ["disabled", "confirmation", "no preview", "stale preview", None, "no entry"]
    assert found[1].warnings == ["disabled", "no state", "hit of 8", "plays 3xc"] and found[1].body is None
    assert found[5].body == '{"entry":5,"event":3,"confirmed":true,"transfers":[{"element_in":1,"element_out":2}]}'


def test_pages_end_where_a_page_says_so(spark):
    page = lambda more, ids: '{"standings":{"has_next":%s,"results":[%s]}}' % (str(more).lower(), ",".join('{"entry":%d}' % i for i in ids))
    rows = [(1, None, 1, page(True, range(70))), (1, None, 2, page(True, range(70, 140))), (1, None, 3, page(False, [999])), (2, "x", 1, page(False, [5, 4])), (2, "x", 2, page(False, [6])), (3, "s", 1, page(True, [1])), (4, "x", 1, "{"), (5, "x", 1, None)]
    found = Q.paged_rivals(spark.createDataFrame(rows, "league int, kind string, page int, body string")).sort("league", "place").collect()
    assert [(r.place, r.entry) for r in found if r.league == 1] == [(i + 1, i) for i in range(100)]
    assert [(r.place, r.entry) for r in found if r.league == 2] == [(1, 5), (2, 4)] and {r.league for r in found} == {1, 2}


def test_short_squads_and_missing_minutes_are_substituted_by_the_rules(spark):
    spots = ["GK"] + ["DEF"] * 4 + ["MID"] * 4 + ["FWD"] * 2 + ["GK", "MID", "DEF", "FWD"]
    full = [(1, i, 100 + i, p, None if i == 2 else 90) for i, p in enumerate(spots, 1)]
    short = [(2, i, 200 + i, p, 0) for i, p in enumerate(spots[:9], 1)]
    picks = spark.createDataFrame([*full, *short], "squad_id int, place int, player_id int, position string, minutes int")
    assert Q.substitutions(picks).collect() == [(1, 102, 113)] and Q.substitutions(picks.limit(0)).count() == 0


def test_forced_swaps_make_no_row_for_each_player_of_a_trial(spark):
    """Clubs and utilities that aren't known, unknown picks and squads that aren't there; a swap is one row all the way."""
    rows = fifteen()
    players = [*[list(r[1:]) for r in rows], [60, "FWD", None, 50, 500.0], [61, "FWD", 9, 50, None]]
    for p in players[:3]:
        p[2] = None
    players = spark.createDataFrame([tuple(p) for p in players], "player int, position string, club int, price int, utility double")
    picks = spark.createDataFrame([*[r[:2] for r in rows], (0, 900), (None, 3), (0, None), (1, 60)], "squad int, player int")
    swaps = [(1, 0, 14, 60), (2, 0, 14, 61), (3, 7, 14, 61), (4, 0, 900, 61), (5, 1, 60, 61)]
    plan = Q.forced_swaps(picks, spark.createDataFrame(swaps, "swap int, squad int, out_player int, in_player int"), players)
    found = {r.swap: (r.delta, r.note) for r in plan.collect()}
    # three without a club and a fourth are one too many; a pick that no one knows can be given up, which makes sixteen
    assert found[1] == (None, "breaks club") and found[3] == (None, "not held")
    assert found[4][1].startswith("breaks size") and found[5][1].startswith("breaks size")
    # a forward of unknown worth counts nothing, and another one is fielded
    assert found[2][1] is None and found[2][0] <= 0
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text and "Union" not in text
