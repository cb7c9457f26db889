"""Rules, market and rate models, forecasts and selections on the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import boosting as B
from ..operators import model_store as V
from ..operators import models as M
from ..shared import shared_folder
from .base import Plans, table
from .relational import SIDES, matches

plans = Plans()

POSITION = "CASE {x} % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END"


@plans("""SELECT l_orderkey, l_linenumber, CASE WHEN now <= bought THEN now ELSE bought + (now - bought) // 2 END AS sell FROM
(SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 100) AS INTEGER) AS bought, CAST(floor(l_extendedprice / 100 + l_quantity - 25) AS INTEGER) AS now FROM lineitem)""")
def r01_selling_price(spark: SparkSession, sf: str) -> DataFrame:
    bought, now = F.floor(F.expr("l_extendedprice / 100")).cast("int"), F.floor(F.expr("l_extendedprice / 100 + l_quantity - 25")).cast("int")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R.selling_price(bought, now).alias("sell"))


@plans("""SELECT p_partkey, least(5, CASE WHEN u THEN free ELSE greatest(0, free - made) END + 1) AS free_next, CASE WHEN u THEN 0 ELSE 4 * greatest(0, made - free) END AS cost
FROM (SELECT p_partkey, p_size % 6 AS free, CAST(p_partkey % 7 AS INTEGER) AS made, p_partkey % 5 = 0 AS u FROM part)""")
def r03_moves_and_hits(spark: SparkSession, sf: str) -> DataFrame:
    free, made, unlimited = F.col("p_size") % 6, (F.col("p_partkey") % 7).cast("int"), F.col("p_partkey") % 5 == 0
    return table(spark, sf, "part").select("p_partkey", R.free_next(free, made, unlimited).alias("free_next"), R.hit_cost(free, made, unlimited).alias("cost"))


PICKS = f"""SELECT c_custkey % 100 AS squad, {POSITION.format(x="c_custkey // 100")} AS position, c_nationkey % 8 AS club, CAST(abs(c_acctbal) / 50 AS INTEGER) AS price FROM customer"""


@plans(f"""WITH p AS ({PICKS.replace('CAST(abs(c_acctbal) / 50 AS INTEGER)', 'CAST(floor(abs(c_acctbal) / 50) AS INTEGER)')}), c AS (SELECT squad, max(n) AS most FROM (SELECT squad, club, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT squad, count(*) AS n, sum(price) AS spend, count(*) FILTER (position = 'GK') AS gk, count(*) FILTER (position = 'DEF') AS de, count(*) FILTER (position = 'MID') AS mi, count(*) FILTER (position = 'FWD') AS fw FROM p GROUP BY 1)
SELECT s.squad, array_to_string(list_filter([CASE WHEN n <> 15 THEN 'size' END, CASE WHEN gk <> 2 THEN 'GK' END, CASE WHEN de <> 5 THEN 'DEF' END, CASE WHEN mi <> 5 THEN 'MID' END, CASE WHEN fw <> 3 THEN 'FWD' END,
CASE WHEN most > 3 THEN 'club' END, CASE WHEN spend > 1000 THEN 'budget' END], lambda x: x IS NOT NULL), ',') AS errors FROM s JOIN c ON c.squad = s.squad""")
def r05_validate(spark: SparkSession, sf: str) -> DataFrame:
    picks = table(spark, sf, "customer").selectExpr("c_custkey % 100 AS squad", POSITION.format(x="(c_custkey div 100)") + " AS position", "c_nationkey % 8 AS club", "CAST(floor(abs(c_acctbal) / 50) AS INT) AS price")
    return R.squad_errors(picks, "squad", "position", "club", "price").select("squad", F.array_join("errors", ",").alias("errors"))


STATS = {"minutes": "l_quantity * 2", "goals": "l_linenumber % 3", "assists": "l_suppkey % 2", "clean_sheets": "l_partkey % 2", "conceded": "l_orderkey % 5", "saves": "l_partkey % 9", "yellow": "l_suppkey % 3", "defensive": "l_partkey % 16", "bonus": "l_orderkey % 4"}
POINTS = """CASE WHEN minutes >= 60 THEN 2 WHEN minutes > 0 THEN 1 ELSE 0 END + CASE position WHEN 'GK' THEN 10 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END * goals + 3 * assists
+ CASE WHEN minutes >= 60 THEN CASE WHEN position IN ('GK', 'DEF') THEN 4 WHEN position = 'MID' THEN 1 ELSE 0 END * clean_sheets ELSE 0 END
- CASE WHEN position IN ('GK', 'DEF') THEN conceded // 2 ELSE 0 END + saves // 3 - yellow + bonus + CASE WHEN defensive >= CASE WHEN position = 'DEF' THEN 10 ELSE 12 END THEN 2 ELSE 0 END"""
APPEARANCES = "SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST({e} AS INTEGER) AS {n}" for n, e in STATS.items()) + ", " + POSITION.format(x="l_suppkey") + " AS position FROM lineitem"


def appearances(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", *(f"CAST({e} AS INT) AS {n}" for n, e in STATS.items()), POSITION.format(x="l_suppkey") + " AS position")


@plans(f"SELECT l_orderkey, l_linenumber, {POINTS} AS points FROM ({APPEARANCES})")
def r10_points(spark: SparkSession, sf: str) -> DataFrame:
    return appearances(spark, sf).select("l_orderkey", "l_linenumber", R.points({n: F.col(n) for n in STATS}, F.col("position")).alias("points"))


@plans(f"""WITH p AS (SELECT l_orderkey, l_linenumber, minutes, {POINTS} AS points FROM ({APPEARANCES})), c AS (SELECT l_orderkey, coalesce(min(l_linenumber) FILTER (minutes > 0), 1) AS captain FROM p WHERE l_linenumber <= 2 GROUP BY 1)
SELECT p.l_orderkey, CAST(sum(points * CASE WHEN l_linenumber = coalesce(captain, 1) THEN 2 ELSE 1 END) - 4 * greatest(0, count(*) - 5) AS BIGINT) AS score FROM p LEFT JOIN c ON c.l_orderkey = p.l_orderkey GROUP BY 1""")
def r11_week_score(spark: SparkSession, sf: str) -> DataFrame:
    """The captain's points count twice; the vice stands in where the captain didn't play."""
    scored = appearances(spark, sf).withColumn("points", R.points({n: F.col(n) for n in STATS}, F.col("position")))
    first = Window.partitionBy("l_orderkey")
    captain = F.coalesce(F.min(F.when((F.col("l_linenumber") <= 2) & (F.col("minutes") > 0), F.col("l_linenumber"))).over(first), F.lit(1))
    scored = scored.withColumn("times", F.when(F.col("l_linenumber") == captain, 2).otherwise(1))
    return scored.groupBy("l_orderkey").agg((F.sum(F.col("points") * F.col("times")) - 4 * F.greatest(F.lit(0), F.count("*") - 5)).cast("long").alias("score"))


RATES = SIDES + """, g AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1), h AS (SELECT home AS nation, avg(q) / 50 AS rate FROM m JOIN g ON g.l_orderkey = m.match_id GROUP BY 1)"""


def nation_rates(spark: SparkSession, sf: str) -> DataFrame:
    totals = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    return matches(spark, sf).join(totals, F.col("match_id") == F.col("l_orderkey")).groupBy(F.col("home").alias("nation")).agg((F.avg("q") / 50).alias("rate"))


@plans(RATES + """ SELECT a.nation AS home, b.nation AS away, round(greatest(0.15, least(5, a.rate * 1.2)), 6) AS lh, round(greatest(0.15, least(5, b.rate * 0.9)), 6) AS la FROM h a JOIN h b ON a.nation % 5 = b.nation % 5 AND a.nation <> b.nation""")
def m02_pair_rates(spark: SparkSession, sf: str) -> DataFrame:
    rates = nation_rates(spark, sf).withColumn("pool", F.col("nation") % 5)
    clamp = lambda c, f: F.round(F.greatest(F.lit(0.15), F.least(F.lit(5.0), c * f)), 6)
    a, b = (rates.select("pool", F.col("nation").alias(n), F.col("rate").alias(f"{n}_rate")) for n in ("home", "away"))
    return a.join(b, "pool").filter("home <> away").select("home", "away", clamp(F.col("home_rate"), 1.2).alias("lh"), clamp(F.col("away_rate"), 0.9).alias("la"))


@plans(RATES + """, s AS (SELECT nation, rate AS x, rate * 0.8 AS y, u.h, v.a FROM h, (SELECT unnest(range(10)) AS h) u, (SELECT unnest(range(10)) AS a) v),
c AS (SELECT *, exp(-x) * pow(x, h) / factorial(CAST(h AS INTEGER)) * exp(-y) * pow(y, a) / factorial(CAST(a AS INTEGER)) * CASE WHEN h = 0 AND a = 0 THEN 1 + x * y * 0.05 WHEN h = 0 AND a = 1 THEN 1 - x * 0.05 WHEN h = 1 AND a = 0 THEN 1 - y * 0.05 WHEN h = 1 AND a = 1 THEN 1.05 ELSE 1 END AS p FROM s)
SELECT nation, round(sum(p) FILTER (h > a) / sum(p), 6) AS p_home, round(sum(p) FILTER (h = a) / sum(p), 6) AS p_draw, round(sum(p) FILTER (h + a > 2) / sum(p), 6) AS p_over FROM c GROUP BY 1""")
def m03_score_matrix(spark: SparkSession, sf: str) -> DataFrame:
    pairs = nation_rates(spark, sf).select("nation", F.col("rate").alias("x"), (F.col("rate") * 0.8).alias("y"))
    cells = M.score_matrix(pairs, "x", "y", F.lit(-0.05))
    chance = lambda c, n: F.round(F.sum(F.when(c, F.col("p")).otherwise(0.0)), 6).alias(n)
    return cells.groupBy("nation").agg(chance(F.col("h") > F.col("a"), "p_home"), chance(F.col("h") == F.col("a"), "p_draw"), chance(F.col("h") + F.col("a") > 2, "p_over"))


@plans("""SELECT l_orderkey, l_linenumber, round(CASE WHEN coalesce(l_tax, 0) > 0 THEN pow(l_quantity / 20, 1 - 0.65) * pow(l_tax * 30, 0.65) ELSE l_quantity / 20 END, 6) AS rate FROM lineitem""")
def m04_market_blend(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(M.market_blend(F.expr("l_quantity / 20"), F.expr("l_tax * 30")), 6).alias("rate"))


@plans("""SELECT o_orderkey, round(pow(0.72, (SELECT max(year(o_orderdate)) FROM orders) - year(o_orderdate)), 9) AS weight FROM orders""")
def m08_season_weight(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    newest = orders.agg(F.max("y").alias("newest"))
    return orders.join(F.broadcast(newest)).select("o_orderkey", F.round(M.season_weight(F.col("newest") - F.col("y")), 9).alias("weight"))


@plans("""WITH u AS (SELECT user_id, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END) AS s, avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0 END) AS c, max(value) AS top FROM events GROUP BY 1)
SELECT user_id, round(CASE WHEN top > 300 THEN 0 ELSE s END, 6) AS p_start, round(CASE WHEN top > 300 THEN 0 ELSE least(c, 1 - s) END, 6) AS p_cameo, round(CASE WHEN top > 300 THEN 0 ELSE 78 * s + 19 * least(c, 1 - s) END, 6) AS minutes FROM u""")
def m12_minutes_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    share = lambda kind: F.avg(F.when(F.col("event_type") == kind, 1.0).otherwise(0.0))
    users = table(spark, sf, "events").groupBy("user_id").agg(share("purchase").alias("s"), share("view").alias("c"), F.max("value").alias("top"))
    fit = lambda c: F.when(F.col("top") > 300, 0.0).otherwise(c)
    start, cameo = fit(F.col("s")), fit(F.least(F.col("c"), 1 - F.col("s")))
    return users.select("user_id", F.round(start, 6).alias("p_start"), F.round(cameo, 6).alias("p_cameo"), F.round(78 * start + 19 * cameo, 6).alias("minutes"))


@plans("""SELECT l_orderkey, l_linenumber, round((1 / l_quantity) / sum(1 / l_quantity) OVER (PARTITION BY l_orderkey), 9) AS p FROM lineitem""")
def m14_devig(spark: SparkSession, sf: str) -> DataFrame:
    implied = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr("1 / l_quantity").alias("p"))
    return implied.withColumn("p", F.round(F.col("p") / F.sum("p").over(Window.partitionBy("l_orderkey")), 9))


@plans("""WITH RECURSIVE o AS (SELECT l_orderkey, list(1.0 / l_quantity ORDER BY l_linenumber, 1.0 / l_quantity) AS q FROM lineitem GROUP BY 1), t AS (SELECT l_orderkey, list_transform(q, lambda x: x / list_sum(q) * 1.05) AS p FROM o),
z AS (SELECT l_orderkey, p, list_sum(p) AS total, 0.0::DOUBLE AS z, 0 AS i FROM t UNION ALL SELECT l_orderkey, p, total, CASE WHEN len(p) > 2 THEN greatest(0, least(0.2, (list_sum(list_transform(p, lambda x: sqrt(z * z + 4 * (1 - z) * x * x / total))) - 2) / (len(p) - 2))) ELSE 0 END, i + 1 FROM z WHERE i < 60),
f AS (SELECT l_orderkey, list_transform(p, lambda x: (sqrt(z * z + 4 * (1 - z) * x * x / total) - z) / (2 * (1 - z))) AS v FROM z WHERE i = 60)
SELECT l_orderkey, CAST(unnest(range(len(v))) AS INT) AS place, round(unnest(list_transform(v, lambda x: x / list_sum(v))), 8) AS fair FROM f""")
def m14_devig_shin(spark: SparkSession, sf: str) -> DataFrame:
    """Shin's probabilities of each order's lines, priced by quantity; a margin of 5 % is put on first."""
    implied = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.expr("1.0D / l_quantity").alias("p")))), lambda x: x["p"]).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    priced = implied.withColumn("p", F.transform("p", lambda x: x / total * 1.05))
    return priced.select("l_orderkey", F.posexplode(M.shin(F.col("p"))).alias("place", "fair")).withColumn("fair", F.round("fair", 8))


@plans("WITH m AS (" + plans.sql["m03_score_matrix"] + """), q AS (SELECT nation, round(p_home, 3) AS h, round(p_draw, 3) AS d, round(1 - p_home - p_draw, 3) AS a FROM m), k AS (SELECT i / 20.0 AS r FROM range(4, 81) t(i)), pm AS (SELECT r, n, exp(-r) * pow(r, n) / factorial(CAST(n AS INTEGER)) AS p FROM k, range(9) u(n)),
g AS (SELECT x.r AS lh, y.r AS la, coalesce(sum(x.p * y.p) FILTER (x.n > y.n), 0) AS ph, coalesce(sum(x.p * y.p) FILTER (x.n = y.n), 0) AS pd, coalesce(sum(x.p * y.p) FILTER (x.n < y.n), 0) AS pa FROM pm x, pm y GROUP BY 1, 2)
SELECT nation, lh, la FROM (SELECT nation, lh, la, row_number() OVER (PARTITION BY nation ORDER BY (ph - h) * (ph - h) + (pd - d) * (pd - d) + (pa - a) * (pa - a), lh, la) AS n FROM q, g) WHERE n = 1""")
def m15_market_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of each nation's home matches fitted to their price of a win, a draw and a loss."""
    priced = m03_score_matrix(spark, sf).select("nation", F.round("p_home", 3).alias("h"), F.round("p_draw", 3).alias("d"), F.round(1 - F.col("p_home") - F.col("p_draw"), 3).alias("a"))
    return M.fit_rates(priced, M.rate_grid(spark), "nation", "h", "d", "a")


NB = "WITH s AS (SELECT l_orderkey, avg(l_quantity) / 5 AS m FROM lineitem GROUP BY 1), q AS (SELECT l_orderkey, m, m / (m + 4.0) AS q, pow(4.0 / (m + 4.0), 4.0) AS p0 FROM s)"


@plans(NB + " SELECT l_orderkey, round(1 - p0 * (1 + q * 4 + q * q * 10 + pow(q, 3) * 20 + pow(q, 4) * 35), 6) AS p_five FROM q")
def m16_nb_survival(spark: SparkSession, sf: str) -> DataFrame:
    means = table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.avg("l_quantity") / 5).alias("m"))
    return means.select("l_orderkey", F.round(M.nb_survival(F.col("m"), F.lit(4.0), 5), 6).alias("p_five"))


@plans("""SELECT event_type, round(CASE WHEN var_pop(value) > avg(value) THEN avg(value) * avg(value) / (var_pop(value) - avg(value)) END, 4) AS dispersion FROM events GROUP BY 1""")
def m16_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    m, v = F.avg("value"), F.var_pop("value")
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.when(v > m, m * m / (v - m)), 4).alias("dispersion"))


MEASURES = {
    "chars": "length(text)", "words": "size(split(text, ' '))", "lines": "size(split(text, '\\n'))", "digits": "length(regexp_replace(text, '[^0-9]', '')) / greatest(length(text), 1)",
    "capitals": "length(regexp_replace(text, '[^A-Z]', '')) / greatest(length(text), 1)", "marks": "length(regexp_replace(text, '[A-Za-z0-9\\\\s]', '')) / greatest(length(text), 1)", "distinct_words": "size(array_distinct(split(text, ' '))) / size(split(text, ' '))",
}


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with simple measures of their texts."""
    docs = table(spark, sf, "documents").select("doc_id", *(F.expr(e).cast("double").alias(c) for c, e in MEASURES.items()))
    return table(spark, sf, "labels").join(docs, "doc_id")


def quality_model(spark: SparkSession, sf: str) -> B.Model:
    """Quality by boosted trees; more distinct words may only raise it, more marks only lower it."""
    return B.fit(labelled(spark, sf), list(MEASURES), "quality", 2, F.col("doc_id") % 5 == 0, monotone={"distinct_words": 1, "marks": -1}, rounds=20, patience=4)


@plans()
def m06_tree_model(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrated chances that held-out documents are of good quality."""
    rows = labelled(spark, sf)
    return B.scored(rows, quality_model(spark, sf)).filter("doc_id % 5 = 0").select("doc_id", "quality", F.col("p")[1].alias("p"))


@plans()
def m21_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Features of the quality model by their share of all gain, and whether the guard would refuse one as a text's."""
    first = B.importance(quality_model(spark, sf))
    rows = [(place, f, share, place <= B.TEXT_PLACES and f in ("words", "distinct_words")) for place, (f, share) in enumerate(first, 1)]
    return spark.createDataFrame(rows, "place int, feature string, share double, refused boolean")


@plans()
def m25_m30_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A model that is fitted once, used again, and refitted on all rows with the metrics of its holdout."""
    folder = shared_folder(spark, "models")
    halves = {h: sorted(str(r.k) for r in labelled(spark, sf).filter(F.col("doc_id") % 5 == 0 if h else F.col("doc_id") % 5 > 0).select((F.col("doc_id") % 10).alias("k")).distinct().collect()) for h in (True, False)}
    for _ in range(2):
        version, _ = V.active_or_fit(spark, folder, "quality", lambda: (quality_model(spark, sf), halves[False], halves[True]))
    V.refit_on_all(spark, folder, "quality", version, lambda rounds: B.fit(labelled(spark, sf), list(MEASURES), "quality", 2, F.lit(False), rounds=rounds))
    return V.versions(spark, folder).select("version", "refit_of", "promoted", F.size("trained_on").alias("n_trained"), F.size("holdout").alias("n_holdout"), F.get_json_object("metrics", "$.rounds").cast("int").alias("rounds"))


def players(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as players of matches: a player's chance to start and rates come from its share of quantity."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    q, s = F.col("q"), F.col("l_suppkey")
    return lines.select(F.col("l_orderkey").alias("fixture_id"), s.alias("player_id"), (s % 2).alias("team_id"), F.expr(POSITION.format(x="l_suppkey")).alias("position"), F.least(F.lit(0.95), q / 60).alias("p_start"), F.lit(0.05).alias("p_cameo"), (q / 50).alias("goals90"), (q / 70).alias("assists90"), (4 + s % 9).cast("double").alias("actions90"), F.when(s % 4 == 0, 3.0).otherwise(0.0).alias("saves90"), (10 + q / 5).alias("exp_bps"), (1 + (s % 2 + F.col("l_orderkey") % 3) / 3).alias("team_rate"))


@plans()
def z09_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Simulated points of the players of all fixtures: goals, assists, clean sheets, defence, saves, cards and bonus."""
    from ..operators.simulate import simulate

    return simulate(players(spark, sf))


def squads_in_leagues(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as squads of five suppliers with one captain, in leagues by nation; the least customer of each is one's own."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("league"), F.col("c_custkey").alias("squad"))
    n = table(spark, sf, "supplier").agg(F.count("*").alias("n"))
    own = (F.col("squad") == F.min("squad").over(Window.partitionBy("league"))).alias("own")
    picks = c.select("*", own).join(n).select("league", "squad", "own", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(((F.col("squad") * 13 + i * 7) % F.col("n")).alias("player_id"), F.when(i == 0, 2).otherwise(1).alias("times")))).alias("p"))
    return picks.select("league", "squad", "own", "p.*")


@plans()
def z07_squad_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, spread and deciles of each squad's total over joint draws."""
    from ..operators.simulate import player_draws, squad_distribution

    return squad_distribution(player_draws(players(spark, sf), draws=100), squads_in_leagues(spark, sf).select("squad", "player_id", "times"), "squad")


@plans()
def z08_rival_squads(spark: SparkSession, sf: str) -> DataFrame:
    """How the squads of a league fare against each other, draw by draw."""
    from ..operators.simulate import player_draws, rival_table, squad_draws

    picks = squads_in_leagues(spark, sf)
    totals = squad_draws(player_draws(players(spark, sf), draws=100), picks.select("squad", "player_id", "times"), "squad")
    return rival_table(totals.join(picks.select("league", "squad", "own").distinct(), "squad"), "league", "squad", "own")


@plans()
def o01_squad(spark: SparkSession, sf: str) -> DataFrame:
    """One squad for each part size class, of the parts' value for their price."""
    from ..operators.optimise import select_squads

    value = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("u"))
    parts = table(spark, sf, "part").join(value, F.col("p_partkey") == F.col("l_partkey"))
    pool = parts.selectExpr("p_size % 5 AS pool", "p_partkey AS player_id", POSITION.format(x="p_partkey") + " AS position", "p_partkey % 25 AS team_id", "CAST(40 + p_partkey % 60 AS INT) AS price", "u AS utility")
    return select_squads(pool, "pool")


@plans("""WITH b AS (SELECT l_orderkey, avg(l_quantity) AS e, stddev_pop(l_quantity) AS sd, avg(CASE WHEN l_quantity >= 40 THEN 1.0 ELSE 0 END) AS haul FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(e + 0.1 * sd + 0.5 * 1.8 * haul, 6) AS utility FROM b""")
def o07_utility(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("e"), F.stddev_pop("l_quantity").alias("sd"), F.avg(F.when(F.col("l_quantity") >= 40, 1.0).otherwise(0.0)).alias("haul"))
    return b.select("l_orderkey", F.round(F.col("e") + 0.1 * F.col("sd") + 0.5 * 1.8 * F.col("haul"), 6).alias("utility"))


@plans("""SELECT o_custkey, round(sum(o_totalprice * pow(0.84, i - 1)), 4) AS horizon FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders) WHERE i <= 5 GROUP BY 1""")
def o08_horizon(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.asof import top_per_group

    first = top_per_group(table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 5)
    return first.groupBy("o_custkey").agg(F.round(F.sum(F.col("o_totalprice") * F.pow(F.lit(0.84), F.col("rn") - 1)), 4).alias("horizon"))


@plans("""WITH t AS (SELECT user_id, date_trunc('week', ts) AS w, sum(value) AS g FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(g, 6) DESC, w) AS n FROM t)
SELECT a.user_id, a.w AS week, round(a.g, 6) AS gain, round(a.g - coalesce(b.g, 0), 6) AS margin FROM r a LEFT JOIN r b ON b.user_id = a.user_id AND b.n = 2 WHERE a.n = 1""")
def o09_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """The best week of each user and by how much it beats the second best."""
    weeks = table(spark, sf, "events").groupBy("user_id", F.date_trunc("week", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("week")).agg(F.sum("value").alias("g"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("g", 6)).alias("k"), "week", "g"))), 1, 2)
    top = weeks.groupBy("user_id").agg(best.alias("b"))
    return top.select("user_id", F.col("b")[0]["week"].alias("week"), F.round(F.col("b")[0]["g"], 6).alias("gain"), F.round(F.col("b")[0]["g"] - F.coalesce(F.get("b", 1)["g"], F.lit(0.0)), 6).alias("margin"))
