"""Drafts, swaps, chip calendars, rivals and pushes on the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import squads as Q
from .base import Plans, table
from .columns import K, events
from .form import GAMES, team_rows
from .reports import SHAPES

plans = Plans()

SPOT = "CASE WHEN {x} <= 1 THEN 'GK' WHEN {x} <= 6 THEN 'DEF' WHEN {x} <= 11 THEN 'MID' ELSE 'FWD' END"
KIND = "CASE WHEN event_id % 50 = 7 THEN 'seed' WHEN event_id % 200 = 33 THEN 'discard' WHEN event_type = 'click' THEN 'add' WHEN event_type = 'error' THEN 'drop' WHEN event_type = 'purchase' THEN 'price' WHEN event_type = 'signup' THEN 'captain' ELSE 'vice' END"

DRAFT = f"""WITH e AS (SELECT user_id AS squad, event_id AS step, {KIND} AS kind, {K} AS player, CAST(floor(value) AS INT) AS price FROM events), now AS (SELECT p_partkey AS player, CASE WHEN p_size <= 45 THEN 40 + p_partkey % 60 END AS now FROM part),
o AS (SELECT squad, max(step) AS opened FROM e WHERE kind IN ('seed', 'discard') GROUP BY 1 HAVING arg_max(kind, step) = 'seed'), a AS (SELECT e.*, opened FROM e JOIN o USING (squad) WHERE step > opened),
b AS (SELECT squad, opened, (squad * 13 + i * 7) % 100 AS player, i, 45 + i AS bought FROM o, (SELECT unnest(range(15)) AS i)),
d AS (SELECT squad, player, max(step) AS gone FROM a WHERE kind = 'drop' GROUP BY 1, 2),
h AS (SELECT squad, player, opened AS since, bought, i FROM b ANTI JOIN d USING (squad, player)),
n AS (SELECT a.squad, a.player, min(a.step) AS since FROM a JOIN now ON now.player = a.player AND now.now IS NOT NULL LEFT JOIN d ON d.squad = a.squad AND d.player = a.player WHERE kind = 'add' AND a.step > coalesce(d.gone, -1) GROUP BY 1, 2),
s AS (SELECT * FROM h UNION ALL SELECT n.squad, n.player, n.since, now.now, NULL FROM n JOIN now USING (player) ANTI JOIN h USING (squad, player)),
q AS (SELECT s.*, (SELECT arg_max(price, step) FROM a WHERE a.squad = s.squad AND a.player = s.player AND kind = 'price' AND price > 0 AND step > since) AS paid,
 (SELECT arg_max({{'player': player, 'step': step}}, step) FROM a WHERE a.squad = s.squad AND kind = 'captain') AS c, (SELECT arg_max({{'player': player, 'step': step}}, step) FROM a WHERE a.squad = s.squad AND kind = 'vice') AS v FROM s),
f AS (SELECT q.squad, q.player, CASE WHEN c IS NULL THEN coalesce(i = 0, false) ELSE c.player = q.player AND c.step > since END AS is_captain, CASE WHEN v IS NULL THEN coalesce(i = 1, false) ELSE v.player = q.player AND v.step > since END AS is_vice, coalesce(paid, bought) AS purchase_price, coalesce(now.now, paid, bought) AS now FROM q LEFT JOIN now USING (player))
"""


def drafts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events as edits of drafts, whose squads have fifteen players to begin with; and the squads."""
    edits = events(spark, sf).select(F.col("user_id").alias("squad"), F.col("event_id").alias("step"), F.expr(KIND).alias("kind"), F.col("k").alias("player"), F.floor("value").cast("int").alias("price"))
    squads = edits.select("squad").distinct()
    place = F.explode(F.sequence(F.lit(0), F.lit(14))).alias("i")
    picks = squads.select("squad", place).select("squad", ((F.col("squad") * 13 + F.col("i") * 7) % 100).alias("player"), (F.col("i") == 0).alias("is_captain"), (F.col("i") == 1).alias("is_vice"), (F.col("i") + 45).alias("purchase_price"))
    prices = table(spark, sf, "part").select(F.col("p_partkey").alias("player"), F.when(F.col("p_size") <= 45, (40 + F.col("p_partkey") % 60).cast("int")).alias("now"))
    return Q.draft_picks(squads, picks, edits, prices), squads


@plans(DRAFT + "SELECT squad, player, is_captain, is_vice, purchase_price, CASE WHEN now <= purchase_price THEN now ELSE purchase_price + (now - purchase_price) // 2 END AS selling_price FROM f")
def o20_draft_life(spark: SparkSession, sf: str) -> DataFrame:
    """Open drafts after all edits since they were seeded, with what each player was bought for and would fetch."""
    return drafts(spark, sf)[0]


@plans(DRAFT + f""", p AS (SELECT squad, purchase_price AS price, {SPOT.format(x='(player % 15)')} AS position, player % 20 AS club FROM f), c AS (SELECT squad, max(n) AS most FROM (SELECT squad, club, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1)
SELECT squad, array_to_string(list_filter([CASE WHEN count(*) <> 15 THEN 'size' END, CASE WHEN count(*) FILTER (position = 'GK') <> 2 THEN 'GK' END, CASE WHEN count(*) FILTER (position = 'DEF') <> 5 THEN 'DEF' END, CASE WHEN count(*) FILTER (position = 'MID') <> 5 THEN 'MID' END, CASE WHEN count(*) FILTER (position = 'FWD') <> 3 THEN 'FWD' END, CASE WHEN max(most) > 3 THEN 'club' END, CASE WHEN sum(price) > 1000 THEN 'budget' END], lambda x: x IS NOT NULL), ',') AS errors FROM p JOIN c USING (squad) GROUP BY 1""")
def o20_draft_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with each open draft; none may be committed before that is mended."""
    draft, _ = drafts(spark, sf)
    players = table(spark, sf, "part").selectExpr("p_partkey AS player", SPOT.format(x="(p_partkey % 15)") + " AS position", "p_partkey % 20 AS club")
    return Q.checked_drafts(draft, draft, players).select("squad", F.array_join("errors", ",").alias("errors"))


FIFTEEN = f"SELECT c_custkey // 15 AS squad, c_custkey AS player, {SPOT.format(x='(c_custkey % 15)')} AS position, (c_custkey // 15 + c_custkey) % 5 AS club, 40 + c_custkey % 30 AS price, CAST(floor(c_acctbal) AS DOUBLE) AS utility FROM customer"


def _lineup_sql(rows: str, key: str) -> str:
    return f"""(SELECT {key}, arg_min(total, (-total, formation)) AS total FROM (SELECT {key}, d || '-' || m || '-' || f AS formation, sum(utility) AS total FROM (SELECT *, row_number() OVER (PARTITION BY {key}, position ORDER BY utility DESC, player) AS n FROM {rows}) r
JOIN {SHAPES} s ON n <= CASE position WHEN 'GK' THEN 1 WHEN 'DEF' THEN d WHEN 'MID' THEN m ELSE f END GROUP BY 1, 2 HAVING count(*) = 11) GROUP BY 1)"""


@plans(f"""WITH p AS ({FIFTEEN}), w AS (SELECT o_orderkey AS swap, o_custkey // 15 AS squad, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 15 ELSE o_custkey END AS out_player, o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 15 * (1 + o_orderkey % 5) END AS in_player FROM orders),
k AS (SELECT w.*, o.squad = w.squad AS holds, i.player IS NOT NULL AS known, i.squad = w.squad AS already FROM w LEFT JOIN p o ON o.player = w.out_player LEFT JOIN p i ON i.player = w.in_player),
t AS (SELECT k.swap, p.* EXCLUDE (squad) FROM k JOIN p ON p.squad = k.squad AND p.player <> k.out_player WHERE holds AND known AND NOT already UNION ALL SELECT k.swap, p.* EXCLUDE (squad) FROM k JOIN p ON p.player = k.in_player WHERE holds AND known AND NOT already),
c AS (SELECT swap, max(n) AS most FROM (SELECT swap, club, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT swap, array_to_string(list_filter([CASE WHEN count(*) <> 15 THEN 'size' END, CASE WHEN count(*) FILTER (position = 'GK') <> 2 THEN 'GK' END, CASE WHEN count(*) FILTER (position = 'DEF') <> 5 THEN 'DEF' END, CASE WHEN count(*) FILTER (position = 'MID') <> 5 THEN 'MID' END, CASE WHEN count(*) FILTER (position = 'FWD') <> 3 THEN 'FWD' END, CASE WHEN max(most) > 3 THEN 'club' END, CASE WHEN sum(price) > 1000 THEN 'budget' END], lambda x: x IS NOT NULL), ',') AS errors FROM t JOIN c USING (swap) GROUP BY 1)
SELECT k.swap, CASE WHEN known AND holds AND NOT already AND errors = '' THEN round(b.total - a.total, 2) END AS delta, CASE WHEN NOT known THEN 'unknown player' WHEN NOT coalesce(holds, false) THEN 'not held' WHEN already THEN 'already held' WHEN errors <> '' THEN 'breaks ' || errors END AS note
FROM k LEFT JOIN e USING (swap) LEFT JOIN {_lineup_sql('t', 'swap')} b USING (swap) LEFT JOIN {_lineup_sql('p', 'squad')} a ON a.squad = k.squad""")
def t17_forced_swaps(spark: SparkSession, sf: str) -> DataFrame:
    """What a proposed swap really gains once the line-up is chosen anew, or why it can't be made."""
    players = table(spark, sf, "customer").selectExpr("c_custkey div 15 AS squad", "c_custkey AS player", SPOT.format(x="(c_custkey % 15)") + " AS position", "(c_custkey div 15 + c_custkey) % 5 AS club", "40 + c_custkey % 30 AS price", "CAST(floor(c_acctbal) AS DOUBLE) AS utility")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    new = c + F.when(k % 3 == 0, 1).otherwise(0) + F.when(k % 13 == 0, 0).otherwise(15 * (1 + k % 5))
    swaps = table(spark, sf, "orders").select(k.alias("swap"), F.floor(c / 15).alias("squad"), F.when(k % 11 == 0, c + 15).otherwise(c).alias("out_player"), new.alias("in_player"))
    return Q.forced_swaps(players.select("squad", "player"), swaps, players)


WEEK = "(month({ts}) - 1) * 3 + least(2, (day({ts}) - 1) {div} 10) + 1"


@plans(GAMES + f""", w AS (SELECT {WEEK.format(ts='ts', div='//')} AS week, team AS club, count(*) AS n FROM s GROUP BY 1, 2), q AS (SELECT s_suppkey AS squad, (s_suppkey * 13 + i * 7) % 25 AS club FROM supplier, (SELECT unnest(range(15)) AS i)),
n AS (SELECT a.squad, a.week, coalesce(b.n, 0) AS n FROM (SELECT s_suppkey AS squad, week FROM supplier, (SELECT unnest(range(1, 39)) AS week)) a LEFT JOIN (SELECT squad, week, sum(n) AS n FROM q JOIN w USING (club) GROUP BY 1, 2) b USING (squad, week)),
u AS (SELECT squad, CASE WHEN median(n) = 0 THEN 11 ELSE median(n) END AS usual, min(n) <> max(n) AS varies FROM n GROUP BY 1),
y AS (SELECT squad, week, varies, unnest([{{'chip': 'bboost', 'gain': round(12.0::DOUBLE * (n / greatest(usual, 1)), 9)}}, {{'chip': '3xc', 'gain': round(7.0::DOUBLE * (n / greatest(usual, 1)), 9)}}, {{'chip': 'freehit', 'gain': round(4.0::DOUBLE * greatest(0, usual - n), 9)}}, {{'chip': 'wildcard', 'gain': round(14.0::DOUBLE * (38 - week) / 38, 9)}}], recursive := true) FROM n JOIN u USING (squad)),
r AS (SELECT *, row_number() OVER (PARTITION BY squad, chip ORDER BY gain DESC, week) AS place FROM y WHERE NOT (chip = 'wildcard' AND squad % 3 = 0 AND week <= 19) AND NOT (chip = 'freehit' AND squad % 4 = 1 AND week > 19)),
z AS (SELECT squad, chip, bool_or(varies) AS varies, max(week) FILTER (place = 1) AS week, max(gain) FILTER (place = 1) AS gain, max(week) FILTER (place = 2) AS second_week, max(gain) FILTER (place = 2) AS second_gain FROM r WHERE place <= 2 GROUP BY 1, 2)
SELECT squad, chip, week, gain, second_week, second_gain, CASE WHEN NOT varies THEN 'none' WHEN second_gain IS NULL OR gain <= 0 THEN 'low' WHEN (gain - second_gain) / greatest(gain, 1e-6) > 0.3 THEN 'high' WHEN (gain - second_gain) / greatest(gain, 1e-6) > 0.1 THEN 'medium' ELSE 'low' END AS confidence FROM z""")
def o09_chip_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """The best week of four chips for each supplier's squad of fifteen nations' players, and how sure that is."""
    fixtures = team_rows(spark, sf).groupBy(F.expr(WEEK.format(ts="ts", div="div")).cast("int").alias("week"), F.col("team").alias("club")).agg(F.count("*").alias("n"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("squad"))
    clubs = suppliers.select("squad", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("i")).select("squad", ((F.col("squad") * 13 + F.col("i") * 7) % 25).alias("club"))
    spent = F.inline(F.array_compact(F.array(F.when(F.col("squad") % 3 == 0, F.struct(F.lit("wildcard").alias("chip"), F.lit(5).alias("week"))), F.when(F.col("squad") % 4 == 1, F.struct(F.lit("freehit").alias("chip"), F.lit(25).alias("week"))))))
    return Q.chip_calendar(clubs, fixtures, list(range(1, 39)), suppliers.select("squad", spent), 19)


@plans("""WITH x AS (SELECT l_partkey AS player, year(l_shipdate) * 12 + month(l_shipdate) AS draw, sum(l_quantity) AS points FROM lineitem GROUP BY 1, 2), p AS (SELECT DISTINCT l_suppkey AS squad, l_partkey AS player FROM lineitem),
s AS (SELECT s_suppkey AS squad, s_nationkey AS league, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS standing FROM supplier), t AS (SELECT league, squad, standing, draw, sum(points) AS total FROM p JOIN s USING (squad) JOIN x USING (player) GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY league, draw ORDER BY total DESC) AS rank FROM t), f AS (SELECT league, squad, avg(CAST(rank = 1 AS INT)) AS p_first, avg(CAST(rank <= standing AS INT)) AS p_hold, avg(rank) AS mean_rank FROM r GROUP BY 1, 2),
o AS (SELECT player, 100.0 * count(*) / (SELECT count(DISTINCT squad) FROM p) AS owned FROM p GROUP BY 1), d AS (SELECT player, stddev_pop(points) AS sd FROM x GROUP BY 1),
k AS (SELECT squad, sum(sd * (1 - owned / 100)) AS risk FROM p JOIN o USING (player) JOIN d USING (player) GROUP BY 1)
SELECT league, squad, round(p_first, 6) AS p_first, round(p_hold, 6) AS p_hold, round(mean_rank, 6) AS mean_rank, round(risk, 5) AS rank_risk, row_number() OVER (PARTITION BY league ORDER BY round(p_hold, 9) DESC, squad) AS place FROM f JOIN k USING (squad)""")
def o13_against_rivals(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as squads of the parts they ship, in leagues of their nation, over the months as joint draws: who keeps its standing."""
    lines = table(spark, sf, "lineitem")
    points = lines.groupBy(F.col("l_partkey").alias("player"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("draw")).agg(F.sum("l_quantity").alias("points"))
    picks = lines.select(F.col("l_suppkey").alias("squad"), F.col("l_partkey").alias("player")).distinct()
    standing = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey"))
    leagues = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("squad"), F.col("s_nationkey").alias("league"), standing.alias("standing"))
    totals = picks.join(leagues, "squad").join(points, "player").groupBy("league", "squad", "standing", "draw").agg(F.sum("points").alias("total"))
    # one row
    n = picks.agg(F.countDistinct("squad").alias("n"))
    owned = picks.groupBy("player").agg(F.count("*").alias("holders")).join(n).select("player", (100 * F.col("holders") / F.col("n")).alias("ownership"))
    spread = points.groupBy("player").agg(F.stddev_pop("points").alias("deviation"))
    found = Q.against_rivals(totals, picks.join(spread, "player").join(owned, "player"), "protect_rank")
    return found.select("league", "squad", *(F.round(c, 6).alias(c) for c in ("p_first", "p_hold", "mean_rank")), F.round("rank_risk", 5).alias("rank_risk"), "place")


@plans("""WITH r AS (SELECT o_orderkey AS request, o_orderkey % 7 <> 0 AS enabled, month(o_orderdate) AS period, CASE WHEN o_orderkey % 5 = 0 THEN 'push' ELSE 'PUSH GW' || month(o_orderdate) END AS confirmation, o_orderkey % 3 = 0 AS dry, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 900 END AS age, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS entry, o_orderkey % 4 AS hits, CASE WHEN o_orderkey % 17 = 0 THEN 'wildcard' END AS chip, o_orderkey % 19 <> 0 AS has_state, o_custkey FROM orders),
f AS (SELECT *, CASE WHEN NOT enabled THEN 'disabled' WHEN confirmation = 'push' THEN 'confirmation' WHEN NOT dry AND age IS NULL THEN 'no preview' WHEN NOT dry AND age > 600 THEN 'stale preview' WHEN entry IS NULL THEN 'no entry' END AS refusal FROM r)
SELECT request, refusal, array_to_string(list_filter([CASE WHEN NOT enabled THEN 'disabled' END, CASE WHEN NOT has_state THEN 'no state' END, CASE WHEN hits > 0 THEN 'hit of ' || hits * 4 END, CASE WHEN chip IS NOT NULL THEN 'plays ' || chip END], lambda x: x IS NOT NULL), ';') AS warnings,
CASE WHEN refusal IS NULL THEN '{"entry":' || entry || ',"event":' || period || CASE WHEN chip IS NOT NULL THEN ',"chip":"' || chip || '"' ELSE '' END || ',"confirmed":true,"transfers":[{"element_in":' || (o_custkey + 1) || ',"element_out":' || o_custkey || '}]}' END AS body FROM f""")
def s29_push_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Requests to push a plan: which guard refuses each, its warnings, and what a log keeps of the rest. Nothing is sent."""
    k, month = F.col("o_orderkey"), F.month("o_orderdate")
    at = F.col("o_orderdate").cast("timestamp")
    previewed = F.when(k % 11 != 0, F.timestamp_seconds(F.unix_timestamp(at) - k % 900))
    move = F.array(F.struct((F.col("o_custkey") + 1).alias("element_in"), F.col("o_custkey").alias("element_out")))
    requests = table(spark, sf, "orders").select(
        k.alias("request"), (k % 7 != 0).alias("enabled"), month.alias("period"), F.when(k % 5 == 0, "push").otherwise(F.concat(F.lit("PUSH GW"), month.cast("string"))).alias("confirmation"), (k % 3 == 0).alias("dry_run"), previewed.alias("previewed_at"), at.alias("asked_at"),
        F.when(k % 13 != 0, F.col("o_custkey")).alias("entry"), (k % 4).alias("hits"), F.when(k % 17 == 0, "wildcard").alias("chip"), (k % 19 != 0).alias("has_state"), move.alias("moves"),
    )
    return Q.push_checks(requests).select("request", "refusal", F.array_join("warnings", ";").alias("warnings"), "body")


@plans("SELECT league, place, entry FROM (SELECT c_nationkey AS league, c_custkey AS entry, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer) WHERE league % 5 <> 4 AND place <= CASE WHEN league % 5 = 3 THEN 50 ELSE 100 END")
def s28_paged_rivals(spark: SparkSession, sf: str) -> DataFrame:
    """Rivals from pages of fifty standings; system leagues are left out, and some leagues say after a page that no more follow."""
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("league"), F.col("c_custkey").alias("entry"), n.alias("n"), F.count("*").over(Window.partitionBy("c_nationkey")).alias("of"))
    paged = rows.withColumn("page", F.ceil(F.col("n") / 50).cast("int")).groupBy("league", "page").agg(F.array_sort(F.collect_list(F.struct("n", "entry"))).alias("rows"), F.max("of").alias("of"))
    more = (F.col("page") * 50 < F.col("of")) & (F.col("league") % 5 != 3)
    body = F.to_json(F.struct(F.struct(more.alias("has_next"), F.transform("rows", lambda r: F.struct(r["entry"].alias("entry"))).alias("results")).alias("standings")))
    return Q.paged_rivals(paged.select("league", F.when(F.col("league") % 5 == 4, "s").otherwise("x").alias("kind"), "page", body.alias("body")))


PLACE = "c_custkey % 15 + 1"
SEAT = f"CASE WHEN {PLACE} IN (1, 12) THEN 'GK' WHEN {PLACE} <= 5 OR {PLACE} = 13 THEN 'DEF' WHEN {PLACE} <= 9 OR {PLACE} = 14 THEN 'MID' ELSE 'FWD' END"
KEEPS = " AND ".join(f"n_{p} - CAST(seat.position = '{p}' AS INT) + CAST(b.position = '{p}' AS INT) BETWEEN {low} AND {high}" for p, (low, high) in Q.R.LINEUP.items())
COUNTS = ", ".join(f"len(list_filter(lineup, lambda x: x.position = '{p}')) AS n_{p}" for p in Q.R.LINEUP)


@plans(f"""WITH RECURSIVE s AS (SELECT c_custkey // 15 AS squad_id, list({{'id': c_custkey, 'position': {SEAT}, 'played': c_acctbal >= 1500}} ORDER BY c_custkey) AS seats FROM customer GROUP BY 1),
r AS (SELECT squad_id, 0 AS i, seats[1:11] AS lineup, seats[12:15] AS bench, CAST(NULL AS BIGINT) AS out_id, CAST(NULL AS BIGINT) AS in_id FROM s
UNION ALL SELECT squad_id, i + 1, CASE WHEN f IS NULL THEN lineup ELSE list_concat(list_concat(lineup[1:i], [f]), lineup[i + 2:11]) END, CASE WHEN f IS NULL THEN bench ELSE list_filter(bench, lambda b: b.id <> f.id) END, CASE WHEN f IS NOT NULL THEN seat.id END, f.id
FROM (SELECT *, CASE WHEN NOT seat.played THEN list_filter(bench, lambda b: b.played AND (b.position = 'GK') = (seat.position = 'GK') AND len(lineup) = 11 AND {KEEPS})[1] END AS f FROM (SELECT *, lineup[i + 1] AS seat, {COUNTS} FROM r WHERE i < len(lineup))))
SELECT squad_id, out_id, in_id FROM r WHERE out_id IS NOT NULL""")
def r07_automatic_substitutions(spark: SparkSession, sf: str) -> DataFrame:
    """Substitutions in squads of fifteen customers each, over all customers."""
    picks = table(spark, sf, "customer").selectExpr("c_custkey div 15 AS squad_id", f"CAST({PLACE} AS INT) AS place", "c_custkey AS player_id", f"{SEAT} AS position", "CAST(CASE WHEN c_acctbal < 1500 THEN 0 ELSE 90 END AS INT) AS minutes")
    return Q.substitutions(picks)
