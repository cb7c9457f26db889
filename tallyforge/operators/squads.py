"""Squads under edit: drafts and their life cycle, forced swaps, chip calendars, rank among rivals, and what may be pushed.

Everything is keyed by squad and planned as joins and aggregates; no squad's history is gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R

#: Kinds of edits: the first two begin a draft from the set squad, or end it.
SEED, DISCARD, ADD, DROP, PRICE, CAPTAIN, VICE = "seed", "discard", "add", "drop", "price", "captain", "vice"

#: Gains that a chip has in an ordinary week, and the weeks of a season.
BENCH_GAIN, TRIPLE_GAIN, BLANK_GAIN, REBUILD_GAIN, SEASON_WEEKS, ORDINARY = 12.0, 7.0, 4.0, 14.0, 38, 11
HIGH_MARGIN, MEDIUM_MARGIN = 0.3, 0.1

PREVIEW_SECONDS = 600
MOST_RIVALS, MOST_PAGES = 100, 2


def draft_picks(squads: DataFrame, picks: DataFrame, edits: DataFrame, prices: DataFrame) -> DataFrame:
    """(squad, player, is_captain, is_vice, purchase_price, selling_price) of every open draft.

    ``squads``: squad. ``picks``: squad, player, is_captain, is_vice, purchase_price of the set squads. ``edits``: squad, step,
    kind, player, price, steps unique within a squad. ``prices``: player, now.

    A draft is open if its squad's last seed comes after its last discard; only later edits count, and a squad without picks has
    an empty draft. Adding a held player and dropping another change nothing; players without a price of now can't be added. A
    player is bought at the price of now, until an edit names what was paid (more than 0, while the player is held). The armband
    goes to the last edit's player, and to nobody if that player isn't held or was dropped since. Edits with a null step, kind or
    player (where one is needed) change nothing.
    """
    known = edits.filter("squad is not null and step is not null").select("squad", "step", "kind", "player", "price")
    began = known.filter(F.col("kind").isin(SEED, DISCARD)).groupBy("squad").agg(F.max(F.struct("step", "kind")).alias("last"))
    opened = began.filter(F.col("last.kind") == SEED).join(squads.select("squad").distinct(), "squad", "left_semi").select("squad", F.col("last.step").alias("opened"))
    after = known.join(opened, "squad").filter(F.col("step") > F.col("opened"))
    moves = after.filter(F.col("player").isNotNull())
    base = picks.join(opened, "squad").select("squad", "player", "opened", "purchase_price", "is_captain", "is_vice")

    # a player's present spell starts at the first add after the last drop, or at the seed if there was no drop
    dropped = moves.filter(F.col("kind") == DROP).groupBy("squad", "player").agg(F.max("step").alias("dropped"))
    held = base.select("squad", "player", F.col("opened").alias("from"), F.lit(True).alias("own")).distinct()
    addable = moves.filter(F.col("kind") == ADD).join(prices.filter("now is not null").select("player"), "player", "left_semi")
    starts = held.unionByName(addable.select("squad", "player", F.col("step").alias("from"), F.lit(False).alias("own")))
    spell = starts.join(dropped, ["squad", "player"], "left").filter(F.col("dropped").isNull() | (F.col("from") > F.col("dropped")))
    spell = spell.groupBy("squad", "player").agg(F.min(F.struct("from", "own")).alias("s")).select("squad", "player", "s.from", "s.own")

    paid = moves.filter((F.col("kind") == PRICE) & (F.col("price") > 0)).select("squad", "player", F.col("step").alias("at"), "price")
    named = spell.select("squad", "player", "from").join(paid, ["squad", "player"]).filter(F.col("at") > F.col("from")).groupBy("squad", "player").agg(F.max_by("price", "at").alias("paid"))
    once = base.groupBy("squad", "player").agg(F.max("purchase_price").alias("bought"), F.max("is_captain").alias("was_captain"), F.max("is_vice").alias("was_vice"))
    bands = after.filter(F.col("kind").isin(CAPTAIN, VICE)).groupBy("squad").agg(*(F.max(F.when(F.col("kind") == k, F.struct("step", "player"))).alias(f"to_{k}") for k in (CAPTAIN, VICE)))
    rows = spell.join(named, ["squad", "player"], "left").join(once, ["squad", "player"], "left").join(bands, "squad", "left").join(prices.select("player", "now"), "player", "left")

    def wears(kind: str, before: str) -> Column:
        to = F.col(f"to_{kind}")
        anew = (to["player"] == F.col("player")) & (to["step"] > F.col("from"))
        return F.coalesce(F.when(to.isNotNull(), anew).otherwise(F.col("own") & F.col(before)), F.lit(False))

    price = F.coalesce("paid", F.when(F.col("own"), F.col("bought")).otherwise(F.col("now")))
    rows = rows.select("squad", "player", wears(CAPTAIN, "was_captain").alias("is_captain"), wears(VICE, "was_vice").alias("is_vice"), price.alias("purchase_price"), "now")
    return rows.select("squad", "player", "is_captain", "is_vice", "purchase_price", R.selling_price(F.col("purchase_price"), F.coalesce("now", "purchase_price")).alias("selling_price"))


def checked_drafts(opened: DataFrame, draft: DataFrame, players: DataFrame, budget: int = 1000) -> DataFrame:
    """(squad, errors) of every squad in ``opened``; a draft may be illegal while it is edited. ``players``: player, position, club.

    Players without a club aren't counted; a draft without any counted player breaks its size and quotas.
    """
    meta = players.filter("club is not null").select("player", "position", "club")
    found = R.squad_errors(draft.join(meta, "player"), "squad", "position", "club", "purchase_price", budget)
    nobody = F.array(F.lit("size"), *(F.lit(p) for p in R.QUOTA))
    return opened.select("squad").distinct().join(found, "squad", "left").select("squad", F.coalesce("errors", nobody).alias("errors"))


def committed(draft: DataFrame, checks: DataFrame, period: Column, at: Column) -> DataFrame:
    """The picks of drafts without errors, as states that were set by hand."""
    legal = checks.filter(F.size("errors") == 0).select("squad")
    return draft.join(legal, "squad", "left_semi").select("*", F.lit("manual").alias("source"), period.alias("period"), at.alias("captured_at"))


def cloned(picks: DataFrame, copies: DataFrame) -> DataFrame:
    """The picks of each squad under the numbers of its copies. ``copies``: squad, copy; a squad may have several."""
    return copies.select("squad", "copy").join(picks, "squad").drop("squad").withColumnRenamed("copy", "squad").select(picks.columns)


def accepted(plans: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans with each one's last answer (accepted, answered_at, reason), and the picks of accepted ones as planned states, which
    no look-up of the present squad sees. ``plans``: plan, squad, picks (array). ``answers``: plan, step, accepted, at, reason."""
    last = answers.groupBy("plan").agg(F.max_by(F.struct("accepted", F.col("at").alias("answered_at"), F.when(~F.col("accepted"), F.col("reason")).alias("reason")), "step").alias("a"))
    answered = plans.join(last, "plan", "left").select(*plans.columns, "a.accepted", "a.answered_at", "a.reason")
    planned = answered.filter("accepted").select("squad", "plan", F.lit("planned").alias("source"), F.posexplode("picks").alias("place", "player"))
    return answered, planned.withColumn("place", F.col("place") + 1)


def _best_total(squad: Column) -> Column:
    """The utility of the best line-up of a squad, given as an array with position and utility; null if it can field none."""

    def first(position: str, n: int) -> Column:
        best = F.sort_array(F.transform(F.filter(squad, lambda x: x["position"] == position), lambda x: x["utility"]), asc=False)
        return F.when(F.size(best) >= n, F.aggregate(F.slice(best, 1, n), F.lit(0.0), lambda s, u: s + F.coalesce(u.cast("double"), F.lit(0.0))))

    totals = {(p, n): first(p, n) for p, n in {("GK", 1), *((p, f[i]) for f in R.FORMATIONS for i, p in enumerate(("DEF", "MID", "FWD")))}}
    return F.array_max(F.array(*(totals["GK", 1] + totals["DEF", d] + totals["MID", m] + totals["FWD", f] for d, m, f in R.FORMATIONS)))


def _squad_errors(squad: Column, budget: int) -> Column:
    """``R.squad_errors`` of a squad as an array with position, club and price."""
    clubs, most = F.sort_array(F.transform(squad, lambda x: x["club"])), R.MOST_PER_CLUB
    crowded = F.exists(F.sequence(F.lit(0), F.size(squad) - 1), lambda i: (i + most < F.size(clubs)) & F.get(clubs, i).eqNullSafe(F.get(clubs, i + most)))
    spend = F.aggregate(squad, F.lit(0.0), lambda s, x: s + F.coalesce(x["price"].cast("double"), F.lit(0.0)))
    count = lambda p: F.size(F.filter(squad, lambda x: x["position"] == p))
    tests = [F.when(F.size(squad) != sum(R.QUOTA.values()), "size"), *(F.when(count(p) != q, p) for p, q in R.QUOTA.items())]
    return F.array_compact(F.array(*tests, F.when(crowded, "club"), F.when(spend > budget, "budget")))


def forced_swaps(picks: DataFrame, swaps: DataFrame, players: DataFrame, budget: int = 1000) -> DataFrame:
    """(swap, delta, note) of each proposed swap: the line-up is chosen anew with it, and its gain is what is really gained.

    ``picks``: squad, player. ``swaps``: swap, squad, out_player, in_player. ``players``: player, position, club, price, utility.
    ``delta`` is null with a note where a name is unknown or the squad would break a rule. A squad has fifteen places, so it is one
    array of that bound; a swap is tried where it meets its squad, so that no row is made for a player of a trial.
    """
    what = ("position", "club", "price", "utility")
    meta = players.select("player", F.struct(*what).alias("is"))
    listed = picks.filter("squad is not null and player is not null").join(meta, "player", "left").groupBy("squad").agg(F.collect_list(F.struct("player", "is")).alias("held"))
    real = lambda held: F.transform(F.filter(held, lambda x: x["is"].isNotNull()), lambda x: x["is"])
    squads = listed.select("squad", "held", _best_total(real(F.col("held"))).alias("was"))
    has = lambda c: F.coalesce(F.exists("held", lambda x: x["player"] == F.col(c)), F.lit(False))
    asked = swaps.select("swap", "squad", "out_player", "in_player").join(meta.select(F.col("player").alias("in_player"), F.col("is").alias("in_is")), "in_player", "left").join(squads, "squad", "left")
    unclear = F.when(F.col("out_player").isNull() | F.col("in_player").isNull() | F.col("in_is").isNull(), "unknown player").when(~has("out_player"), "not held").when(has("in_player"), "already held")
    rows = asked.withColumn("unclear", unclear)
    trial = F.concat(real(F.filter("held", lambda x: x["player"] != F.col("out_player"))), F.array("in_is"))
    tried = rows.withColumn("trial", F.when(F.col("unclear").isNull(), trial)).select("swap", "unclear", "was", "trial", _squad_errors(F.col("trial"), budget).alias("errors"))
    note = F.when(F.col("unclear").isNotNull(), F.col("unclear")).when(F.size("errors") > 0, F.concat(F.lit("breaks "), F.array_join("errors", ",")))
    noted = tried.withColumn("note", note)
    return noted.select("swap", F.when(F.col("note").isNull(), F.round(_best_total(F.col("trial")) - F.col("was"), 2)).alias("delta"), "note")


def chip_calendar(clubs: DataFrame, fixtures: DataFrame, weeks: list[int], used: DataFrame, halves: int, forecast: DataFrame | None = None) -> DataFrame:
    """(squad, chip, week, gain, second_week, second_gain, confidence): the best week for each chip of each squad.

    ``clubs``: squad, club, a row for each player. ``fixtures``: week, club, n. ``weeks``: the weeks looked at, of one season. ``used``: squad,
    chip, week; a chip that was used is gone for all weeks of that half, the second starting after week ``halves``. ``forecast``:
    week, best of the greatest forecast of a week, if known. A week's fixtures are those of the squad's players; the ordinary
    number is their median. Where all weeks are alike, naming one would be false precision, so that the confidence is none;
    otherwise it follows from the margin over the second. Ties go to the earlier week.
    """
    asked = clubs.groupBy("squad", "club").agg(F.count("*").alias("times"))
    squads = asked.select("squad").distinct()
    grid = squads.withColumn("week", F.explode(F.array(*map(F.lit, weeks))))
    played = asked.join(fixtures.select("week", "club", "n"), "club").groupBy("squad", "week").agg(F.sum(F.col("times") * F.col("n")).alias("n"))
    counts = grid.join(played, ["squad", "week"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    usual = counts.groupBy("squad").agg(F.median("n").alias("usual"), (F.min("n") != F.max("n")).alias("varies")).withColumn("usual", F.when(F.col("usual") == 0, ORDINARY).otherwise(F.col("usual")))
    rows = counts.join(usual, "squad")
    ratio = F.col("n") / F.greatest(F.col("usual"), F.lit(1.0))
    triple = TRIPLE_GAIN * ratio
    if forecast is not None:
        rows = rows.join(forecast.groupBy("week").agg(F.max("best").alias("best")), "week", "left")
        triple = F.coalesce(F.col("best").cast("double"), triple)
    gains = {"bboost": BENCH_GAIN * ratio, "3xc": triple, "freehit": BLANK_GAIN * F.greatest(F.lit(0.0), F.col("usual") - F.col("n")), "wildcard": REBUILD_GAIN * F.greatest(F.lit(0), SEASON_WEEKS - F.col("week")) / SEASON_WEEKS}
    each = rows.select("squad", "week", "varies", F.explode(F.array(*(F.struct(F.lit(c).alias("chip"), F.round(g, 9).alias("gain")) for c, g in gains.items()))).alias("c")).select("squad", "week", "varies", "c.*")
    gone = used.select("squad", "chip", (F.col("week") > halves).alias("later")).distinct()
    free = each.withColumn("later", F.col("week") > halves).join(gone, ["squad", "chip", "later"], "left_anti")
    place = F.row_number().over(Window.partitionBy("squad", "chip").orderBy(F.col("gain").desc(), "week"))
    two = free.withColumn("place", place).filter("place <= 2")
    of = lambda c, i: F.max(F.when(F.col("place") == i, F.col(c)))
    best = two.groupBy("squad", "chip").agg(F.max("varies").alias("varies"), of("week", 1).alias("week"), of("gain", 1).alias("gain"), of("week", 2).alias("second_week"), of("gain", 2).alias("second_gain"))
    margin = (F.col("gain") - F.col("second_gain")) / F.greatest(F.col("gain"), F.lit(1e-6))
    level = F.when(~F.col("varies"), "none").when(F.col("second_gain").isNull() | (F.col("gain") <= 0), "low").when(margin > HIGH_MARGIN, "high").when(margin > MEDIUM_MARGIN, "medium").otherwise("low")
    return best.select("squad", "chip", "week", "gain", "second_week", "second_gain", level.alias("confidence"))


def against_rivals(totals: DataFrame, owned: DataFrame, mode: str) -> DataFrame:
    """(league, squad, p_first, p_hold, mean_rank, rank_risk, place): candidates rescored by how they fare among rivals in joint draws.

    ``totals``: league, squad, draw, total, standing (its place now). ``owned``: squad, deviation, ownership (per cent) of each pick.
    ``mode`` is win_league (chance to be first), protect_rank (chance not to fall below the standing) or maximise_points (mean
    rank). The rank risk is the linear proxy: what all own has little of it. Ranks are counted within a league and a draw.
    """
    draws = totals.withColumn("rank", F.rank().over(Window.partitionBy("league", "draw").orderBy(F.col("total").desc())))
    share = lambda c: F.avg(c.cast("double"))
    fate = draws.groupBy("league", "squad").agg(share(F.col("rank") == 1).alias("p_first"), share(F.col("rank") <= F.col("standing")).alias("p_hold"), F.avg("rank").alias("mean_rank"))
    risk = owned.groupBy("squad").agg(F.sum(F.col("deviation") * (1 - F.coalesce("ownership", F.lit(0.0)) / 100)).alias("rank_risk"))
    score = {"win_league": F.col("p_first"), "protect_rank": F.col("p_hold"), "maximise_points": -F.col("mean_rank")}[mode]
    rows = fate.join(risk, "squad", "left").withColumn("rank_risk", F.coalesce("rank_risk", F.lit(0.0)))
    return rows.select("league", "squad", "p_first", "p_hold", "mean_rank", "rank_risk", F.row_number().over(Window.partitionBy("league").orderBy(F.round(score, 9).desc(), "squad")).alias("place"))


def push_checks(requests: DataFrame) -> DataFrame:
    """``requests`` with refusal (null if all guards hold), warnings and body: what would be sent, as a log keeps it. Nothing is sent.

    ``requests``: enabled, period, confirmation, dry_run, previewed_at, asked_at, entry, hits, chip, has_state, moves (array of in
    and out). Guards are looked at in this order: writing enabled, the exact confirmation, a preview of the last ten minutes unless
    it is a dry run, a linked entry.
    """
    wanted = F.concat(F.lit("PUSH GW"), F.col("period").cast("string"))
    age = F.unix_timestamp(F.col("asked_at").cast("timestamp")) - F.unix_timestamp(F.col("previewed_at").cast("timestamp"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    refusal = F.when(no(F.col("enabled")), "disabled").when(no(F.col("confirmation") == wanted), "confirmation")
    refusal = refusal.when(no(F.col("dry_run")) & F.col("previewed_at").isNull(), "no preview").when(no(F.col("dry_run")) & (age > PREVIEW_SECONDS), "stale preview").when(F.col("entry").isNull(), "no entry")
    hits = F.coalesce("hits", F.lit(0))
    warnings = F.array_compact(F.array(F.when(no(F.col("enabled")), "disabled"), F.when(no(F.col("has_state")), "no state"), F.when(hits > 0, F.concat(F.lit("hit of "), (hits * R.HIT).cast("string"))), F.when(F.col("chip").isNotNull(), F.concat(F.lit("plays "), F.col("chip")))))
    body = F.to_json(F.struct("entry", F.col("period").alias("event"), "chip", F.lit(True).alias("confirmed"), F.col("moves").alias("transfers")))
    return requests.withColumns({"refusal": refusal, "warnings": warnings, "body": F.when(refusal.isNull(), body)})


def paged_rivals(pages: DataFrame) -> DataFrame:
    """(league, place, entry) from pages of standings: up to MOST_PAGES pages, none after the first that says that no more follow,
    and MOST_RIVALS entries. ``pages``: league, kind, page, body (JSON). System leagues (kind s) are left out, and so is a page
    that can't be read."""
    read = F.from_json("body", "standings struct<has_next boolean, results array<struct<entry long>>>")
    rows = pages.filter((F.coalesce("kind", F.lit("")) != "s") & F.col("page").between(1, MOST_PAGES)).select("league", "page", read["standings"].alias("s"))
    ended = rows.groupBy("league").agg(F.min(F.when(~F.coalesce(F.col("s.has_next"), F.lit(False)), F.col("page"))).alias("last"))
    reached = rows.join(ended, "league").filter(F.col("last").isNull() | (F.col("page") <= F.col("last")))
    entries = reached.select("league", "page", F.posexplode("s.results").alias("at", "r")).filter("r.entry is not null")
    place = F.row_number().over(Window.partitionBy("league").orderBy("page", "at"))
    return entries.withColumn("place", place).filter(F.col("place") <= MOST_RIVALS).select("league", "place", F.col("r.entry").alias("entry"))


def substitutions(picks: DataFrame) -> DataFrame:
    """(squad_id, out_id, in_id): of those who didn't play, in order, each is replaced by the first on the bench who did, a keeper
    by a keeper, if the formation stays legal.

    ``picks``: squad_id, place (1 to 15, the bench from 12), player_id, position, minutes. A squad has fifteen places, so it is
    folded as one array of that bound.
    """
    seat = F.struct(F.col("place").alias("place"), F.col("player_id").alias("player_id"), F.col("position").alias("position"), (F.coalesce("minutes", F.lit(0)) > 0).alias("played"))
    squads = picks.groupBy("squad_id").agg(F.array_sort(F.collect_list(seat)).alias("seats"))
    squads = squads.select("squad_id", F.slice("seats", 1, 11).alias("lineup"), F.expr("slice(seats, 12, greatest(size(seats) - 11, 0))").alias("bench"))
    count = lambda p: F.size(F.filter("lineup", lambda s: s["position"] == p)).alias(p)
    counted = [count(p) for p in R.LINEUP]
    start = F.struct(*counted, F.expr("CAST(array() AS ARRAY<STRUCT<out_id BIGINT, in_id BIGINT>>)").alias("moves"))

    def step(state: Column, seat: Column) -> Column:
        used = F.transform(state["moves"], lambda m: m["in_id"])
        after = lambda b, p: state[p] - (seat["position"] == p).cast("int") + (b["position"] == p).cast("int")
        legal = lambda b: reduce(lambda x, y: x & y, (after(b, p).between(low, high) for p, (low, high) in R.LINEUP.items()))
        eleven = reduce(lambda x, y: x + y, (state[p] for p in R.LINEUP)) == 11
        fits = lambda b: b["played"] & ~F.array_contains(used, b["player_id"]) & ((b["position"] == "GK") == (seat["position"] == "GK")) & eleven & legal(b)
        found = F.get(F.filter(F.col("bench"), fits), 0)
        moved = F.array_append(state["moves"], F.struct(seat["player_id"].cast("long").alias("out_id"), found["player_id"].cast("long").alias("in_id")))
        return F.when(seat["played"] | found.isNull(), state).otherwise(F.struct(*(after(found, p).alias(p) for p in R.LINEUP), moved.alias("moves")))

    folded = squads.select("squad_id", F.inline(F.aggregate("lineup", start, step)["moves"]))
    return folded.select(F.col("squad_id").cast("long").alias("squad_id"), "out_id", "in_id")
