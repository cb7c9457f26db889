"""Player and team features on the sample tables: order lines as appearances, suppliers as players, events as reports and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import form as P
from ..operators import windows as W
from ..player_features import player_graph
from .base import Plans, table
from .scoring import POSITION

plans = Plans()

#: Stand-ins for what a player does in a match, in SQL that Spark and DuckDB read alike.
COLUMNS = {
    "player": "l_suppkey",
    "ts": "l_shipdate",
    "minutes": "CASE WHEN l_linenumber = 7 THEN 0 ELSE least(90, CAST(l_quantity AS INT) * 2) END",
    "starts": "CASE WHEN l_quantity >= 40 THEN 1 WHEN l_quantity >= 35 THEN NULL ELSE 0 END",
    "goals": "CAST(l_partkey % 3 AS INT)",
    "xg": "l_discount * 8",
    "xa": "l_tax * 6",
    "npxg": "l_discount * 7",
    "shots": "CAST(l_partkey % 6 AS INT)",
    "sot": "CAST(l_partkey % 4 AS INT)",
    "touches_box": "CAST(l_orderkey % 7 AS INT)",
    "big_chances": "CAST(l_orderkey % 3 AS INT)",
    "key_passes": "CAST(l_partkey % 5 AS INT)",
    "official": "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(l_partkey % 16 AS INT) END",
    "cbi": "CAST(l_partkey % 9 AS INT)",
    "tackles": "CAST(l_orderkey % 6 AS INT)",
    "recoveries": "CAST(l_orderkey % 11 AS INT)",
    "bps": "CAST(l_partkey % 37 AS INT)",
    "bonus": "CASE WHEN l_partkey % 4 = 3 THEN CAST(l_orderkey % 4 AS INT) ELSE 0 END",
    "saves": "CAST(l_orderkey % 6 AS INT)",
    "conceded": "CAST(l_partkey % 4 AS INT)",
    "penalties": "CASE WHEN l_partkey % 8 = 0 THEN 1 ELSE 0 END",
    "cards": "CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END",
    "position": POSITION.format(x="l_suppkey"),
}
KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
ORDER = ["ts", *KEYS, "l_extendedprice", "l_discount", "l_tax"]
HISTORY = "WITH h AS (SELECT " + ", ".join([*KEYS, "l_extendedprice", "l_discount", "l_tax", *(f"{e} AS {c}" for c, e in COLUMNS.items())]) + " FROM lineitem)"
WINDOWS = "WINDOW " + ", ".join(f"w{n} AS (PARTITION BY player ORDER BY {', '.join(ORDER)} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (1, 3, 5, 10, 20))


def history(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*KEYS, "l_extendedprice", "l_discount", "l_tax", *(f"{e} AS {c}" for c, e in COLUMNS.items()))


def last(n: int):
    return W.before(["player"], ORDER, n)


def features(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*KEYS, *(F.round(c.cast("double"), 10).alias(n) for n, c in columns.items()))


def sql(**columns: str) -> str:
    return f"{HISTORY} SELECT {', '.join(KEYS)}, " + ", ".join(f"round(CAST({e} AS DOUBLE), 10) AS {n}" for n, e in columns.items()) + f" FROM h {WINDOWS}"


def per90_sql(x: str, w: str) -> str:
    return f"90.0 * sum(CASE WHEN minutes > 0 THEN {x} END) OVER {w} / nullif(sum(CASE WHEN minutes > 0 THEN minutes END) OVER {w}, 0)"


def shrunk_sql(x: str, w: str, prior: str) -> str:
    n = f"coalesce(sum(CASE WHEN minutes > 0 THEN minutes END) OVER {w} / 90.0, 0)"
    return f"coalesce(({n} * ({per90_sql(x, w)}) + 5 * {prior}) / ({n} + 5), {prior})"


@plans(sql(**{f"mins_last{n}": f"sum(minutes) OVER w{n}" for n in (1, 3, 5, 10)}))
def k01_minutes_of_last(spark: SparkSession, sf: str) -> DataFrame:
    return features(history(spark, sf), **{f"mins_last{n}": F.sum("minutes").over(last(n)) for n in (1, 3, 5, 10)})


LAGS = [f"lag(minutes, {i + 1}) OVER (PARTITION BY player ORDER BY {', '.join(ORDER)})" for i in range(5)]


@plans(sql(weighted="(" + " + ".join(f"coalesce({x} * pow(0.5, {i} / 3.0), 0)" for i, x in enumerate(LAGS)) + ") / nullif(" + " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE pow(0.5, {i} / 3.0) END" for i, x in enumerate(LAGS)) + ", 0)"))
def k02_weighted_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return features(history(spark, sf), weighted=W.ewma(W.last_values("minutes", ["player"], ORDER, 5), 3.0))


STARTED = "(coalesce(starts, 0) > 0 OR minutes >= 60)"


@plans(sql(starts_last5=f"count(CASE WHEN {STARTED} THEN 1 END) OVER w5"))
def k03_starts(spark: SparkSession, sf: str) -> DataFrame:
    return features(history(spark, sf), starts_last5=F.count_if(P.started("starts", "minutes")).over(last(5)))


@plans(f"""{HISTORY}, o AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY {', '.join(ORDER)}) AS n FROM h), b AS (SELECT *, max(CASE WHEN NOT {STARTED} THEN n END) OVER (PARTITION BY player ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop FROM o)
SELECT {', '.join(KEYS)}, CAST(least(40, n - 1 - coalesce(stop, 0)) AS DOUBLE) AS start_streak FROM b""")
def k04_start_streak(spark: SparkSession, sf: str) -> DataFrame:
    """Starts in a row before the match, of the last 40: the distance to the last row that was none."""
    w = Window.partitionBy("player").orderBy(*ORDER)
    rows = history(spark, sf).withColumn("n", F.row_number().over(w))
    stop = F.max(F.when(~P.started("starts", "minutes"), F.col("n"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return features(rows, start_streak=F.least(F.lit(40), F.col("n") - 1 - F.coalesce(stop, F.lit(0))))


SUB = "(minutes > 0 AND minutes < 60)"


@plans(sql(sub_rate=f"avg(CASE WHEN {SUB} THEN 1.0 ELSE 0.0 END) OVER w10", sub_on_minute=f"avg(CASE WHEN {SUB} THEN 90 - minutes END) OVER w10"))
def k05_substitutions(spark: SparkSession, sf: str) -> DataFrame:
    sub = (F.col("minutes") > 0) & (F.col("minutes") < 60)
    return features(history(spark, sf), sub_rate=P.share(sub, F.lit(True), last(10)), sub_on_minute=F.avg(F.when(sub, 90 - F.col("minutes"))).over(last(10)))


#: Prior rates per 90 minutes by position.
PRIORS = {"GK": 0.01, "DEF": 0.08, "MID": 0.2, "FWD": 0.4}
PRIOR = "CASE position WHEN 'GK' THEN 0.01 WHEN 'DEF' THEN 0.08 WHEN 'MID' THEN 0.2 ELSE 0.4 END"
EXPECTED = [(f"{x}90_last{n}", x, n) for x in ("xg", "xa", "npxg") for n in (3, 5, 10)]


@plans(sql(**{name: shrunk_sql(x, f"w{n}", PRIOR) for name, x, n in EXPECTED}))
def k06_expected_rates(spark: SparkSession, sf: str) -> DataFrame:
    prior = P.lookup(F.col("position"), PRIORS, F.lit(0.4))
    return features(history(spark, sf), **{name: P.shrunk90(F.col(x), "minutes", last(n), prior) for name, x, n in EXPECTED})


@plans(sql(xgi90_last5=per90_sql("xg + xa", "w5")))
def k07_expected_involvements(spark: SparkSession, sf: str) -> DataFrame:
    return features(history(spark, sf), xgi90_last5=P.per90(F.col("xg") + F.col("xa"), "minutes", last(5)))


VOLUMES = ["shots", "sot", "touches_box", "big_chances", "key_passes"]


@plans(sql(**{f"{x}90": per90_sql(x, "w5") for x in VOLUMES}))
def k08_volumes(spark: SparkSession, sf: str) -> DataFrame:
    return features(history(spark, sf), **{f"{x}90": P.per90(F.col(x), "minutes", last(5)) for x in VOLUMES})


@plans(sql(conversion="sum(goals) OVER w10 / nullif(round(sum(xg) OVER w10, 9), 0)", overperformance="sum(goals - xg) OVER w10"))
def k09_conversion(spark: SparkSession, sf: str) -> DataFrame:
    w = last(10)
    return features(history(spark, sf), conversion=F.try_divide(F.sum("goals").over(w), F.round(F.sum("xg").over(w), 9)), overperformance=F.sum(F.col("goals") - F.col("xg")).over(w))


ACTIONS = "coalesce(official, cbi + tackles + CASE WHEN position = 'DEF' THEN 0 ELSE recoveries END)"
NEEDED = "CASE WHEN position = 'DEF' THEN 10 ELSE 12 END"


def actions() -> Column:
    return P.defensive_actions("official", ["cbi", "tackles"], "recoveries", "position")


@plans(sql(defcon_actions90=shrunk_sql(ACTIONS, "w10", "6.0")))
def k10_defensive_rate(spark: SparkSession, sf: str) -> DataFrame:
    return features(history(spark, sf), defcon_actions90=P.shrunk90(actions(), "minutes", last(10), F.lit(6.0)))


@plans(sql(**{f"hit_rate_last{n}": f"avg(CASE WHEN minutes >= 45 THEN CASE WHEN {ACTIONS} >= {NEEDED} THEN 1.0 ELSE 0.0 END END) OVER w{n}" for n in (5, 10)}, margin=f"avg(CASE WHEN minutes >= 45 THEN {ACTIONS} - {NEEDED} END) OVER w10"))
def k11_threshold_form(spark: SparkSession, sf: str) -> DataFrame:
    needed, counts = F.when(F.col("position") == "DEF", 10).otherwise(12), F.col("minutes") >= 45
    return features(history(spark, sf), **{f"hit_rate_last{n}": P.share(actions() >= needed, counts, last(n)) for n in (5, 10)}, margin=F.avg(F.when(counts, actions() - needed)).over(last(10)))


@plans(sql(bps90_last5=per90_sql("bps", "w5"), bonus_rate_last10="avg(CASE WHEN minutes > 0 THEN CASE WHEN bonus > 0 THEN 1.0 ELSE 0.0 END END) OVER w10"))
def k12_bonus_form(spark: SparkSession, sf: str) -> DataFrame:
    return features(history(spark, sf), bps90_last5=P.per90(F.col("bps"), "minutes", last(5)), bonus_rate_last10=P.share(F.col("bonus") > 0, F.col("minutes") > 0, last(10)))


GRAPH_SQL = {f"mins_last{n}": f"coalesce(sum(minutes) OVER w{n}, 0)" for n in (1, 3, 5, 10)}
GRAPH_SQL |= {name: shrunk_sql(x, f"w{n}", PRIOR) for name, x, n in EXPECTED} | {f"{x}90": per90_sql(x, "w5") for x in VOLUMES}
GRAPH_SQL |= {
    "starts_last5": f"count(CASE WHEN {STARTED} THEN 1 END) OVER w5", "sub_appearance_rate": f"avg(CASE WHEN {SUB} THEN 1.0 ELSE 0.0 END) OVER w10",
    "avg_sub_on_minute": f"coalesce(avg(CASE WHEN {SUB} THEN 90 - minutes END) OVER w10, 70)", "xg_overperformance_last10": "sum(goals - xg) OVER w10", "defcon_actions90": shrunk_sql(ACTIONS, "w10", "6.0"),
    "mins_last5_weighted": "(" + " + ".join(f"coalesce({x} * pow(0.5, {i} / 3.0), 0)" for i, x in enumerate(LAGS)) + ") / nullif(" + " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE pow(0.5, {i} / 3.0) END" for i, x in enumerate(LAGS)) + ", 0)",
    "conversion_ratio": "sum(goals) OVER w10 / nullif(round(sum(xg) OVER w10, 9), 0)", "defcon_margin": f"avg(CASE WHEN minutes >= 45 THEN {ACTIONS} - {NEEDED} END) OVER w10",
    "bps90_last5": f"coalesce({per90_sql('bps', 'w5')}, 0)", "bonus_rate_last10": "avg(CASE WHEN minutes > 0 THEN CASE WHEN bonus > 0 THEN 1.0 ELSE 0.0 END END) OVER w10",
    "saves90": f"CASE WHEN position = 'GK' THEN {per90_sql('saves', 'w5')} ELSE 0 END", "saves_per_shot_faced": "CASE WHEN position = 'GK' THEN sum(saves) OVER w10 / nullif(sum(saves + conceded) OVER w10, 0) END",
    "pens_taken90": per90_sql("penalties", "w20"), "card_rate90": per90_sql("cards", "w10"), "xgi90_last5": per90_sql("xg + xa", "w5"),
} | {f"defcon_hit_rate_last{n}": f"avg(CASE WHEN minutes >= 45 THEN CASE WHEN {ACTIONS} >= {NEEDED} THEN 1.0 ELSE 0.0 END END) OVER w{n}" for n in (5, 10)}
MEANS = ["xgi90_last5", "defcon_hit_rate_last5", "defcon_hit_rate_last10"]
LATER_SQL = {"minutes_trend": "mins_last3 / 3 - mins_last10 / 10", "xg_form": "xg90_last3 / nullif(xg90_last10, 0)", "expected_points_form": "xg90_last3 / nullif(xg90_last10, 0) * 4 + (mins_last3 / 3 - mins_last10 / 10) / 30 + bps90_last5 / 20"}
FLAGS = [f"{n}_missing" for n in ("mins_last5_weighted", "conversion_ratio")]


@plans(f"""{HISTORY}, a AS (SELECT {', '.join(KEYS)}, position, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in GRAPH_SQL.items())} FROM h {WINDOWS}),
b AS (SELECT * REPLACE ({', '.join(f'coalesce({n}, avg({n}) OVER (PARTITION BY position)) AS {n}' for n in MEANS)}) FROM a),
c AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in LATER_SQL.items())}, {', '.join(f'CASE WHEN {n[:-8]} IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS {n}' for n in FLAGS)} FROM b)
SELECT {', '.join(KEYS)}, {', '.join(f'round({n}, 10) AS {n}' for n in [*GRAPH_SQL, *LATER_SQL, *FLAGS])} FROM c""")
def u01_feature_graph(spark: SparkSession, sf: str) -> DataFrame:
    """All form features by the graph, with what stands for missing values."""
    wide, failed = player_graph("player", ORDER).build_wide(history(spark, sf))
    if failed:
        raise ValueError(f"features failed: {failed}")
    return wide.select(*KEYS, *(F.round(c, 10).alias(c) for c in [*GRAPH_SQL, *LATER_SQL, *FLAGS]))


@plans("""SELECT o_orderkey, CASE WHEN TRY_CAST(split_part(s, '-', 1) AS INT) >= 1999 THEN 1 ELSE 0 END AS regime FROM (SELECT o_orderkey, year(o_orderdate) || '-' || substr(CAST(year(o_orderdate) + 1 AS VARCHAR), 3) AS s FROM orders)""")
def k13_season_regime(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a season, written as 1998-99, began under the rules of 1999."""
    year = F.year("o_orderdate")
    season = F.concat_ws("-", year.cast("string"), F.substring((year + 1).cast("string"), 3, 2))
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.split_part(season, F.lit("-"), F.lit(1)).try_cast("int") >= 1999, 1).otherwise(0).alias("regime"))


@plans(sql(saves90=f"CASE WHEN position = 'GK' THEN {per90_sql('saves', 'w5')} ELSE 0 END", saves_per_shot="CASE WHEN position = 'GK' THEN sum(saves) OVER w10 / nullif(sum(saves + conceded) OVER w10, 0) END"))
def k14_saves(spark: SparkSession, sf: str) -> DataFrame:
    keeper, w = F.col("position") == "GK", last(10)
    return features(history(spark, sf), saves90=F.when(keeper, P.per90(F.col("saves"), "minutes", last(5))).otherwise(0.0), saves_per_shot=F.when(keeper, F.try_divide(F.sum("saves").over(w), F.sum(F.col("saves") + F.col("conceded")).over(w))))


DUTY = "SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) % 5 + 1 AS place, event_type AS role FROM events"


@plans(f"""WITH d AS ({DUTY}), m AS (SELECT user_id, min(place) FILTER (role = 'purchase') AS pen, min(place) FILTER (role = 'click') AS corner, min(place) FILTER (role = 'view') AS fk FROM d GROUP BY 1)
SELECT user_id, CASE WHEN pen = 1 THEN 1 ELSE 0 END AS first_taker, CASE pen WHEN 1 THEN 0.9 WHEN 2 THEN 0.08 WHEN 3 THEN 0.02 ELSE 0 END AS pen_share, CASE WHEN corner <= 2 THEN 1 ELSE 0 END AS corner_duty, CASE WHEN fk <= 2 THEN 1 ELSE 0 END AS fk_duty FROM m""")
def k15_set_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Duties by the best place that a player has on the sheets of each role."""
    place = F.get_json_object("props", "$.k").try_cast("int") % 5 + 1
    best = lambda role: F.min(F.when(F.col("event_type") == role, place))
    m = table(spark, sf, "events").groupBy("user_id").agg(best("purchase").alias("pen"), best("click").alias("corner"), best("view").alias("fk"))
    flag = lambda c, n: F.when(c, 1).otherwise(0).alias(n)
    return m.select("user_id", flag(F.col("pen") == 1, "first_taker"), P.lookup(F.col("pen"), P.PENALTY_SHARE, F.lit(0.0)).alias("pen_share"), flag(F.col("corner") <= 2, "corner_duty"), flag(F.col("fk") <= 2, "fk_duty"))


@plans(sql(pens_taken90=per90_sql("penalties", "w20"), card_rate90=per90_sql("cards", "w10")))
def k16_penalties_and_cards(spark: SparkSession, sf: str) -> DataFrame:
    return features(history(spark, sf), pens_taken90=P.per90(F.col("penalties"), "minutes", last(20)), card_rate90=P.per90(F.col("cards"), "minutes", last(10)))


@plans("""WITH f AS (SELECT o_custkey, o_orderkey, o_orderdate, min(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS debut FROM orders)
SELECT o_orderkey, round(date_diff('day', DATE '1990-01-01' + CAST(o_custkey % 3000 AS INT), CAST(o_orderdate AS DATE)) / 365.25, 6) AS age, CAST(date_diff('day', CAST(debut AS DATE), CAST(o_orderdate AS DATE)) AS INT) AS days_since_debut FROM f""")
def k17_age_and_debut(spark: SparkSession, sf: str) -> DataFrame:
    """Age from a date of birth, and days since the oldest of the last 40 matches."""
    w = W.before(["o_custkey"], ["o_orderdate", "o_orderkey"], 40)
    born = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("o_custkey") % 3000).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.datediff("o_orderdate", born) / 365.25, 6).alias("age"), F.datediff("o_orderdate", F.min("o_orderdate").over(w)).alias("days_since_debut"))


# -- teams: orders as matches of two nations


GAMES = """WITH g AS (SELECT o.o_orderkey AS match_id, c.c_nationkey AS home, CAST((c.c_nationkey + 1 + o.o_orderkey % 24) % 25 AS INT) AS away, o.o_orderdate AS ts, CAST(o.o_orderkey % 4 AS INT) AS hg, CAST(o.o_custkey % 3 AS INT) AS ag, o.o_totalprice AS price
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey), s AS (SELECT match_id, home AS team, away AS opponent, ts, hg AS scored, ag AS conceded, 1 AS is_home, price FROM g UNION ALL SELECT match_id, away, home, ts, ag, hg, 0, price FROM g)"""


def team_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each match as seen by either team."""
    from ..operators.joins import two_sides

    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    games = table(spark, sf, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("match_id"), F.col("c_nationkey").alias("home"), F.expr("CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS INT)").alias("away"), F.col("o_orderdate").alias("ts"), (F.col("o_orderkey") % 4).cast("int").alias("hg"), (F.col("o_custkey") % 3).cast("int").alias("ag"), F.col("o_totalprice").alias("price"))
    side = lambda team, other, s, c: {"team": F.col(team), "opponent": F.col(other), "scored": F.col(s), "conceded": F.col(c)}
    return two_sides(games, side("home", "away", "hg", "ag"), side("away", "home", "ag", "hg")).select("match_id", "team", "opponent", "ts", "scored", "conceded", F.col("is_home").cast("int").alias("is_home"), "price")


@plans(GAMES + " SELECT match_id, team, opponent, scored, conceded, is_home FROM s")
def p08_two_team_rows(spark: SparkSession, sf: str) -> DataFrame:
    return team_rows(spark, sf).select("match_id", "team", "opponent", "scored", "conceded", "is_home")


@plans(GAMES + " SELECT team, match_id, CASE WHEN is_home = 1 THEN 'home' ELSE 'away' END AS side, scored - conceded AS margin FROM s WHERE team = 3 OR opponent = 3")
def p03_side_relative(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of one nation from either side, with the margin as that side sees it."""
    rows = team_rows(spark, sf).filter((F.col("team") == 3) | (F.col("opponent") == 3))
    return rows.select("team", "match_id", F.when(F.col("is_home") == 1, "home").otherwise("away").alias("side"), (F.col("scored") - F.col("conceded")).alias("margin"))


STRENGTH = GAMES + """, r AS (SELECT team, avg(scored) AS attack, avg(conceded) AS defence FROM s GROUP BY 1)"""


@plans(STRENGTH + " SELECT s.match_id, s.team, s.is_home, CAST(1 + s.opponent % 5 AS INT) AS difficulty, round(r.attack, 10) AS opponent_attack, round(r.defence, 10) AS opponent_defence FROM s JOIN r ON r.team = s.opponent")
def k18_opponent_ratings(spark: SparkSession, sf: str) -> DataFrame:
    rows = team_rows(spark, sf)
    rating = rows.groupBy(F.col("team").alias("opponent")).agg(F.round(F.avg("scored"), 10).alias("opponent_attack"), F.round(F.avg("conceded"), 10).alias("opponent_defence"))
    return rows.join(rating, "opponent").select("match_id", "team", "is_home", (1 + F.col("opponent") % 5).alias("difficulty"), "opponent_attack", "opponent_defence")


TEAM_ORDER = ["ts", "match_id", "is_home"]
CONCEDED = [f"lag(conceded, {i + 1}) OVER (PARTITION BY team ORDER BY ts, match_id, is_home)" for i in range(10)]


@plans(GAMES + ", f AS (SELECT match_id, team, is_home, avg(CASE WHEN conceded = 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY team ORDER BY ts, match_id, is_home ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS rate, (" + " + ".join(f"coalesce({x} * pow(0.5, {i} / 5.0), 0)" for i, x in enumerate(CONCEDED)) + ") / nullif(" + " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE pow(0.5, {i} / 5.0) END" for i, x in enumerate(CONCEDED)) + ", 0) AS form FROM s) SELECT s.match_id, s.team, round(f.rate, 10) AS clean_sheet_rate, round(f.form, 10) AS conceded_ewma FROM s JOIN f ON f.match_id = s.match_id AND f.team = s.opponent AND f.is_home = 1 - s.is_home")
def k19_opponent_form(spark: SparkSession, sf: str) -> DataFrame:
    """What the opponent conceded in its last ten matches: share without a goal, and a mean with half-life 5."""
    rows = team_rows(spark, sf)
    rate = F.avg((F.col("conceded") == 0).cast("double")).over(W.before(["team"], TEAM_ORDER, 10))
    form = W.ewma(W.last_values("conceded", ["team"], TEAM_ORDER, 10), 5.0)
    known = rows.select("match_id", F.col("team").alias("opponent"), (1 - F.col("is_home")).alias("is_home"), F.round(rate, 10).alias("clean_sheet_rate"), F.round(form, 10).alias("conceded_ewma"))
    return rows.select("match_id", "team", "opponent", "is_home").join(known, ["match_id", "opponent", "is_home"]).select("match_id", "team", "clean_sheet_rate", "conceded_ewma")


@plans(GAMES + """, m AS (SELECT match_id, CASE WHEN match_id % 3 = 0 THEN 0 WHEN match_id % 3 = 1 THEN NULL ELSE price / 200000 END AS market, 1 + (home % 7) / 5.0 AS model, 1 + (away % 7) / 6.0 AS away_model, ag, hg FROM g)
SELECT match_id, round(coalesce(nullif(market, 0), model), 10) AS team_expected, round(away_model, 10) AS opponent_expected, round(exp(-away_model), 10) AS p_clean_sheet FROM m""")
def k20_k21_expected_goals(spark: SparkSession, sf: str) -> DataFrame:
    """The market's rate where there is one that isn't 0, else the model's; chance of no goal by the opponent."""
    home = team_rows(spark, sf).filter("is_home = 1")
    market = F.when(F.col("match_id") % 3 == 0, 0.0).when(F.col("match_id") % 3 == 2, F.col("price") / 200000)
    away = 1 + (F.col("opponent") % 7) / 6.0
    return home.select("match_id", F.round(F.coalesce(F.nullif(market, F.lit(0.0)), 1 + (F.col("team") % 7) / 5.0), 10).alias("team_expected"), F.round(away, 10).alias("opponent_expected"), F.round(F.exp(-away), 10).alias("p_clean_sheet"))


@plans("""WITH p AS (SELECT user_id, event_type, ts, event_id, value, max(ts) OVER (PARTITION BY user_id, event_type) AS newest FROM events), q AS (SELECT * FROM p WHERE epoch_us(newest) - epoch_us(ts) <= 48 * 3600000000)
SELECT user_id, event_type, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS movement FROM q GROUP BY 1, 2""")
def k21_price_movement(spark: SparkSession, sf: str) -> DataFrame:
    """Last less first price of the 48 hours up to the newest."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = table(spark, sf, "events").withColumn("newest", F.max("ts").over(Window.partitionBy("user_id", "event_type"))).filter(micros("newest") - micros("ts") <= 48 * 3_600_000_000)
    at = F.struct("ts", "event_id")
    return rows.groupBy("user_id", "event_type").agg(F.round(F.max_by("value", at) - F.min_by("value", at), 6).alias("movement"))


DAYS = "CAST(epoch(ts) AS BIGINT)"


@plans(GAMES + f""", f AS (SELECT match_id, team, is_home, count(*) OVER (PARTITION BY team ORDER BY {DAYS} RANGE BETWEEN 1 FOLLOWING AND {14 * 86400} FOLLOWING) AS next14, count(CASE WHEN match_id % 6 = 0 THEN 1 END) OVER (PARTITION BY team ORDER BY {DAYS} RANGE BETWEEN 1 FOLLOWING AND {5 * 86400} FOLLOWING) AS cup5, """ + ", ".join(f"lead(match_id, {i}) OVER (PARTITION BY team ORDER BY ts, match_id, is_home) AS n{i}" for i in range(1, 5)) + """ FROM s)
SELECT match_id, team, is_home, next14, CASE WHEN cup5 > 0 THEN 1 ELSE 0 END AS midweek_cup, CAST(CASE WHEN n1 % 6 = 0 THEN n1 WHEN n2 % 6 = 0 THEN n2 WHEN n3 % 6 = 0 THEN n3 WHEN n4 % 6 = 0 THEN n4 END AS BIGINT) AS next_cup FROM f""")
def k27_w19_upcoming(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of the next two weeks, whether a cup match is within five days, and the first cup match of the next four."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    span = lambda days: Window.partitionBy("team").orderBy(seconds).rangeBetween(1, days * 86400)
    cup = F.col("match_id") % 6 == 0
    ahead = F.collect_list("match_id").over(Window.partitionBy("team").orderBy(*TEAM_ORDER).rowsBetween(1, 4))
    return team_rows(spark, sf).select("match_id", "team", "is_home", F.count("*").over(span(14)).alias("next14"), F.when(F.count_if(cup).over(span(5)) > 0, 1).otherwise(0).alias("midweek_cup"), F.get(F.filter(ahead, lambda m: m % 6 == 0), 0).alias("next_cup"))


@plans(GAMES + """, d AS (SELECT match_id, team, opponent, is_home, CAST(date_diff('day', CAST(lag(ts) OVER (PARTITION BY team ORDER BY ts, match_id, is_home) AS DATE), CAST(ts AS DATE)) AS INT) AS rest FROM s)
SELECT a.match_id, a.team, a.rest - b.rest AS rest_difference FROM d a JOIN d b ON b.match_id = a.match_id AND b.team = a.opponent AND b.is_home = 1 - a.is_home""")
def k28_rest_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Days since a team's last match less its opponent's: both sides of a match meet in one group."""
    rest = F.datediff("ts", F.lag("ts").over(Window.partitionBy("team").orderBy(*TEAM_ORDER)))
    rows = team_rows(spark, sf).select("match_id", "team", "is_home", rest.alias("rest"))
    other = rows.select("match_id", (1 - F.col("is_home")).alias("is_home"), F.col("rest").alias("theirs"))
    return rows.join(other, ["match_id", "is_home"]).select("match_id", "team", (F.col("rest") - F.col("theirs")).alias("rest_difference"))


# -- reports, prices and claims: events of a user about a player


REPORTS = "WITH r AS (SELECT user_id AS player, ts, event_id, CASE event_type WHEN 'view' THEN 'available' WHEN 'click' THEN 'doubtful' WHEN 'purchase' THEN 'injured' WHEN 'signup' THEN 'suspended' ELSE 'unknown' END AS status, CASE CAST(json_extract_string(props, '$.k') AS INT) % 6 WHEN 0 THEN 'official' WHEN 1 THEN 'club' WHEN 2 THEN 'press' WHEN 3 THEN 'social' WHEN 4 THEN 'forum' ELSE 'other' END AS source, CASE WHEN value >= 60 THEN NULL ELSE CAST(floor(value) AS INT) END AS chance FROM events), n AS (SELECT player, source, arg_max(status, (ts, event_id)) AS status, arg_max({'c': chance}, (ts, event_id)) AS chance, max(ts) AS ts FROM r GROUP BY 1, 2)"
STATUS = {"view": "available", "click": "doubtful", "purchase": "injured", "signup": "suspended"}
SOURCES = ("official", "club", "press", "social", "forum", "other")


def newest_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The newest report of each source on each player."""
    e = table(spark, sf, "events")
    source = F.element_at(F.array(*map(F.lit, SOURCES)), F.get_json_object("props", "$.k").try_cast("int") % 6 + 1)
    rows = e.select(F.col("user_id").alias("player"), "ts", "event_id", P.lookup(F.col("event_type"), STATUS, F.lit("unknown")).alias("status"), source.alias("source"), F.when(F.col("value") < 60, F.floor("value").cast("int")).alias("chance"))
    return rows.groupBy("player", "source").agg(F.max_by(F.struct("status", "chance"), F.struct("ts", "event_id")).alias("r"), F.max("ts").alias("ts")).select("player", "source", "r.*", "ts")


@plans(REPORTS + " SELECT player, CAST(coalesce(chance.c, CASE WHEN status = 'available' THEN 100 ELSE 0 END) AS DOUBLE) AS chance FROM n WHERE source = 'official'")
def k30_official_chance(spark: SparkSession, sf: str) -> DataFrame:
    return newest_reports(spark, sf).filter("source = 'official'").select("player", P.chance_of_playing(F.col("chance"), F.col("status")).alias("chance"))


VOTED = REPORTS + ", v AS (SELECT player, source, status, chance, ts, CASE status WHEN 'available' THEN 1.0 WHEN 'doubtful' THEN 0.5 WHEN 'injured' THEN 0.0 WHEN 'suspended' THEN 0.0 END AS vote, CASE source WHEN 'official' THEN 2.0 WHEN 'club' THEN 1.5 WHEN 'press' THEN 1.0 WHEN 'social' THEN 0.6 WHEN 'forum' THEN 0.8 ELSE 0.5 END AS weight FROM n)"


def voted(spark: SparkSession, sf: str) -> DataFrame:
    return newest_reports(spark, sf).withColumns({"vote": P.lookup(F.col("status"), P.VOTES, F.lit(None).cast("double")), "weight": P.lookup(F.col("source"), P.SOURCE_WEIGHT, F.lit(P.OTHER_WEIGHT))})


@plans(VOTED + " SELECT player, round(sum(weight * vote) / nullif(sum(CASE WHEN vote IS NOT NULL THEN weight END), 0), 10) AS consensus, round(CASE WHEN count(vote) < 2 THEN 0 ELSE stddev_pop(vote) END, 10) AS disagreement FROM v GROUP BY 1")
def k31_k32_weighted_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted vote of the sources, of which unknown ones abstain, and how far they differ (0 for fewer than two votes)."""
    weight = F.sum(F.when(F.col("vote").isNotNull(), F.col("weight")))
    spread = F.when(F.count("vote") < 2, 0.0).otherwise(F.stddev_pop("vote"))
    return voted(spark, sf).groupBy("player").agg(F.round(F.try_divide(F.sum(F.col("weight") * F.col("vote")), weight), 10).alias("consensus"), F.round(spread, 10).alias("disagreement"))


@plans(REPORTS + " SELECT player, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts) FILTER (status IN ('injured', 'doubtful')))) / 86400e6, 6) AS days_since_injury_report, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts) FILTER (source = 'press'))) / 3600e6, 4) AS press_hours FROM n GROUP BY 1")
def k33_report_recency(spark: SparkSession, sf: str) -> DataFrame:
    now = F.expr("timestamp_ntz'2024-02-01'")
    since = lambda c: W.days_between(now, F.max(F.when(c, F.col("ts"))))
    return newest_reports(spark, sf).groupBy("player").agg(F.round(since(F.col("status").isin("injured", "doubtful")), 6).alias("days_since_injury_report"), F.round(since(F.col("source") == "press") * 24, 4).alias("press_hours"))


@plans(VOTED + " SELECT player, round(sum(weight * vote) / nullif(sum(CASE WHEN vote IS NOT NULL THEN weight END), 0) - max(CASE WHEN source = 'official' THEN coalesce(chance.c, CASE WHEN status = 'available' THEN 100 ELSE 0 END) END) / 100.0, 10) AS gap FROM v GROUP BY 1")
def k34_signal_gap(spark: SparkSession, sf: str) -> DataFrame:
    """How far the consensus is from the official chance."""
    weight = F.sum(F.when(F.col("vote").isNotNull(), F.col("weight")))
    official = F.max(F.when(F.col("source") == "official", P.chance_of_playing(F.col("chance"), F.col("status"))))
    return voted(spark, sf).groupBy("player").agg(F.round(F.try_divide(F.sum(F.col("weight") * F.col("vote")), weight) - official / 100, 10).alias("gap"))


@plans("""WITH s AS (SELECT o_custkey AS provider, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS sheet FROM orders GROUP BY 1), n AS (SELECT count(*) AS providers FROM s JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON l.l_orderkey = s.sheet)
SELECT l.l_suppkey AS player, round(count(DISTINCT s.provider) / max(n.providers), 9) AS predicted FROM s JOIN lineitem l ON l.l_orderkey = s.sheet, n GROUP BY 1""")
def k35_predicted_lineup(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the providers' newest sheets that hold a player."""
    newest = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("provider")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("sheet"))
    named = newest.join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_suppkey").alias("player")), "sheet").select("provider", "player").distinct()
    total = named.select("provider").distinct().agg(F.count("*").alias("providers"))
    return named.groupBy("player").agg(F.count("*").alias("n")).join(total).select("player", F.round(F.col("n") / F.col("providers"), 9).alias("predicted"))


OWNED = "WITH o AS (SELECT user_id AS player, event_type AS scope, value AS pct, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), q AS (SELECT * FROM o WHERE n <= 6)"


@plans(OWNED + """, l AS (SELECT player, arg_max(pct, (ts, event_id)) FILTER (scope = 'view') AS owned, arg_max(pct, (ts, event_id)) FILTER (scope = 'click') AS top, arg_max(pct, (ts, event_id)) FILTER (scope = 'purchase') AS effective, arg_min(pct, (ts, event_id)) FILTER (scope = 'view') AS first FROM q GROUP BY 1)
SELECT player, owned, top, coalesce(effective, owned) AS effective, CASE WHEN owned > 40 THEN 1 WHEN owned IS NOT NULL THEN 0 END AS template, round(owned - first, 6) AS momentum FROM l""")
def k36_ownership(spark: SparkSession, sf: str) -> DataFrame:
    """Newest ownership of each scope among a player's six newest rows."""
    from ..operators.asof import top_per_group

    rows = table(spark, sf, "events").select(F.col("user_id").alias("player"), F.col("event_type").alias("scope"), F.col("value").alias("pct"), "ts", "event_id")
    newest = top_per_group(rows, ["player"], [F.col("ts").desc(), F.col("event_id").desc()], 6)
    at = lambda scope: F.when(F.col("scope") == scope, F.struct("ts", "event_id"))
    of = lambda scope, f=F.max_by: f("pct", at(scope))
    known = newest.groupBy("player").agg(of("view").alias("owned"), of("click").alias("top"), of("purchase").alias("effective"), of("view", F.min_by).alias("first"))
    return known.select("player", "owned", "top", F.coalesce("effective", "owned").alias("effective"), F.when(F.col("owned").isNotNull(), (F.col("owned") > 40).cast("int")).alias("template"), F.round(F.col("owned") - F.col("first"), 6).alias("momentum"))


PRICES = "WITH p AS (SELECT p_partkey AS player, p_size % 4 AS position, p_retailprice / 10 AS price, CAST((p_partkey * 7919) % 200001 - 100000 AS DOUBLE) AS net, (p_partkey % 97) / 2.0 AS owned FROM part)"


def prices(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr("p_partkey AS player", "p_size % 4 AS position", "p_retailprice / 10 AS price", "CAST((p_partkey * 7919) % 200001 - 100000 AS DOUBLE) AS net", "(p_partkey % 97) / 2.0D AS owned")


@plans(PRICES + " SELECT player, price, net, round(greatest(-1, least(1, net / (owned * 100000 * 0.08 + 1))), 6) AS progress, round(avg(x), 9) AS place FROM (SELECT p.*, cume_dist() OVER (PARTITION BY position ORDER BY price) AS x FROM p) GROUP BY ALL")
def k37_k38_price(spark: SparkSession, sf: str) -> DataFrame:
    """Net moves as progress to a price change, and the price's percentile in its position."""
    return prices(spark, sf).select("player", "price", "net", F.round(P.price_progress(F.col("net"), F.col("owned")), 6).alias("progress"), F.round(W.percentile_in_group("price", ["position"]), 9).alias("place"))


@plans(PRICES + " SELECT player, round(cume_dist() OVER (PARTITION BY position ORDER BY net / price) - cume_dist() OVER (PARTITION BY position ORDER BY price), 9) AS value_score, round(cume_dist() OVER (PARTITION BY position ORDER BY net) - cume_dist() OVER (PARTITION BY position ORDER BY owned), 9) AS differential FROM p")
def k39_value_and_differential(spark: SparkSession, sf: str) -> DataFrame:
    """How much better a player places by worth than by price, and by demand than by ownership."""
    place = lambda c: F.cume_dist().over(Window.partitionBy("position").orderBy(c))
    return prices(spark, sf).select("player", F.round(place(F.expr("net / price")) - place(F.col("price")), 9).alias("value_score"), F.round(place(F.col("net")) - place(F.col("owned")), 9).alias("differential"))


CLAIMS = """WITH c AS (SELECT user_id AS player, event_id, ts, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INT) AS k, CASE CAST(json_extract_string(props, '$.k') AS INT) % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS stance, 0.5 + CAST(json_extract_string(props, '$.k') AS INT) % 4 / 2.0 AS trust,
pow(0.5, greatest(0, (epoch_us(TIMESTAMP '2024-01-25') - epoch_us(ts)) / 86400e6) / 3) AS decay FROM events)"""


def claims(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    stance = F.element_at(F.array(F.lit("positive"), F.lit("negative"), F.lit("neutral")), k % 3 + 1)
    age = W.days_between(F.expr("timestamp_ntz'2024-01-25'"), F.col("ts"))
    return table(spark, sf, "events").select(F.col("user_id").alias("player"), "event_id", "ts", F.col("event_type").alias("kind"), k.alias("k"), stance.alias("stance"), (0.5 + k % 4 / 2.0).alias("trust"), W.decay(age, 3.0).alias("decay"))


@plans(CLAIMS + """ SELECT player, round(sum(decay), 5) AS mentions, round(sum(CASE WHEN kind = 'purchase' AND stance = 'positive' THEN decay * trust ELSE 0 END), 5) AS buys, round(sum(CASE WHEN kind = 'error' AND stance <> 'positive' THEN decay * trust ELSE 0 END), 5) AS sells,
round(sum(CASE WHEN kind = 'signup' AND stance = 'positive' THEN decay * trust ELSE 0 END), 5) AS captain, round(sum(CASE WHEN kind = 'click' AND stance <> 'positive' THEN decay * trust ELSE 0 END), 5) AS avoid, CAST(max(CASE WHEN trust >= 2 THEN 1 ELSE 0 END) AS INT) AS tier1 FROM c GROUP BY 1""")
def k40_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Decayed and trusted calls on a player: for a buy or captain in favour, for a sale or avoidance not in favour."""
    worth = F.col("decay") * F.col("trust")
    call = lambda kind, good: F.round(F.sum(F.when((F.col("kind") == kind) & ((F.col("stance") == "positive") == good), worth).otherwise(0.0)), 5)
    return claims(spark, sf).groupBy("player").agg(F.round(F.sum("decay"), 5).alias("mentions"), call("purchase", True).alias("buys"), call("error", False).alias("sells"), call("signup", True).alias("captain"), call("click", False).alias("avoid"), F.max((F.col("trust") >= 2).cast("int")).alias("tier1"))


ONCE = CLAIMS + ", o AS (SELECT *, row_number() OVER (PARTITION BY player, kind, stance, CAST(ts AS DATE) ORDER BY event_id) AS n FROM c), d AS (SELECT * FROM o WHERE n = 1)"


@plans(ONCE + " SELECT player, round(sum(decay * trust * CASE stance WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END) / nullif(sum(decay * trust), 0), 10) AS net_sentiment FROM d GROUP BY 1")
def k41_net_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """Trusted and decayed mean stance, of claims alike in kind, stance and day the first alone."""
    first = F.row_number().over(Window.partitionBy("player", "kind", "stance", F.to_date("ts")).orderBy("event_id"))
    once = claims(spark, sf).withColumn("n", first).filter("n = 1")
    worth, sign = F.col("decay") * F.col("trust"), P.lookup(F.col("stance"), {"positive": 1, "negative": -1}, F.lit(0))
    return once.groupBy("player").agg(F.round(F.try_divide(F.sum(worth * sign), F.sum(worth)), 10).alias("net_sentiment"))


@plans(CLAIMS + ", n AS (SELECT player, count(*) AS n, count(*) FILTER (stance = 'positive') AS pos, count(*) FILTER (stance = 'negative') AS neg, count(*) FILTER (stance = 'neutral') AS neu, count(DISTINCT k) AS channels FROM c GROUP BY 1) SELECT player, CASE WHEN channels >= 2 THEN round(greatest(pos, neg, neu) / n, 10) END AS strength, CASE WHEN n >= 3 THEN round(1 - abs(2 * (pos / n) - 1), 10) END AS disagreement FROM n")
def k42_consensus_strength(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the commonest stance, where at least two channels speak, and how split opinion is."""
    of = lambda s: F.count_if(F.col("stance") == s)
    n = claims(spark, sf).groupBy("player").agg(F.count("*").alias("n"), of("positive").alias("pos"), of("negative").alias("neg"), of("neutral").alias("neu"), F.countDistinct("k").alias("channels"))
    return n.select("player", F.when(F.col("channels") >= 2, F.round(F.greatest("pos", "neg", "neu") / F.col("n"), 10)).alias("strength"), F.round(P.split_opinion(F.col("pos") / F.col("n"), F.col("n")), 10).alias("disagreement"))


@plans(CLAIMS + ", r AS (SELECT player, round(avg(CASE stance WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END), 10) AS sentiment, max(CASE WHEN epoch_us(TIMESTAMP '2024-01-25') - epoch_us(ts) BETWEEN 0 AND 6 * 3600000000 THEN 1 ELSE 0 END) AS breaking, round(count(DISTINCT kind || '/' || stance) / count(*), 10) AS novelty FROM c GROUP BY 1) SELECT player, sentiment, CAST(breaking AS INT) AS breaking, novelty FROM r")
def k43_sentiment_and_news(spark: SparkSession, sf: str) -> DataFrame:
    """Mean stance, whether something is less than six hours old, and how many of the claims say something new."""
    age = F.lit(1706140800000000) - F.unix_micros(F.col("ts").cast("timestamp"))
    sign = P.lookup(F.col("stance"), {"positive": 1.0, "negative": -1.0}, F.lit(0.0))
    return claims(spark, sf).groupBy("player").agg(F.round(F.avg(sign), 10).alias("sentiment"), F.max(age.between(0, 6 * 3_600_000_000).cast("int")).alias("breaking"), F.round(F.countDistinct("kind", "stance") / F.count("*"), 10).alias("novelty"))


@plans("""SELECT s.s_suppkey AS player, CASE WHEN l.n > 0 THEN 1 ELSE 0 END AS odds_present, CASE WHEN e.n > 0 THEN 1 ELSE 0 END AS text_present, CASE WHEN p.n > 0 THEN 1 ELSE 0 END AS ownership_present, CASE WHEN l.shots > 0 THEN 1 ELSE 0 END AS advanced_present FROM supplier s
LEFT JOIN (SELECT l_suppkey, count(*) AS n, sum(l_partkey % 6) AS shots FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) l ON l.l_suppkey = s.s_suppkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) e ON e.user_id = s.s_suppkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE value > 200 GROUP BY 1) p ON p.user_id = s.s_suppkey""")
def k44_blocks_present(spark: SparkSession, sf: str) -> DataFrame:
    """Which blocks of inputs a player has any rows in."""
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("player")).agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("value") > 200).alias("high"))
    lines = table(spark, sf, "lineitem").filter("l_discount > 0.05").groupBy(F.col("l_suppkey").alias("player")).agg(F.count("*").alias("n"), F.sum(F.col("l_partkey") % 6).alias("shots"))
    both = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("player")).join(lines, "player", "left").join(e, "player", "left")
    flag = lambda c, n: F.when(F.col(c) > 0, 1).otherwise(0).alias(n)
    return both.select("player", flag("n", "odds_present"), flag("views", "text_present"), flag("high", "ownership_present"), flag("shots", "advanced_present"))
