"""Draws, strengths, plans and drafts on the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import models as M
from ..operators.asof import top_per_group
from ..operators import strengths as ST
from .base import Plans, table
from .columns import K, events
from .form import GAMES, team_rows
from .scoring import POSITION, RATES, nation_rates

plans = Plans()


@plans(RATES + """, s AS (SELECT nation, rate AS x, rate * 0.8 AS y, u.h, v.a FROM h, (SELECT unnest(range(10)) AS h) u, (SELECT unnest(range(10)) AS a) v),
c AS (SELECT nation, h, a, exp(-x) * pow(x, h) / factorial(CAST(h AS INTEGER)) * exp(-y) * pow(y, a) / factorial(CAST(a AS INTEGER)) * CASE WHEN h = 0 AND a = 0 THEN 1 + x * y * 0.05 WHEN h = 0 AND a = 1 THEN 1 - x * 0.05 WHEN h = 1 AND a = 0 THEN 1 - y * 0.05 WHEN h = 1 AND a = 1 THEN 1.05 ELSE 1 END AS p FROM s),
q AS (SELECT nation, h, a, sum(p) OVER (PARTITION BY nation ORDER BY h, a) / sum(p) OVER (PARTITION BY nation) AS upto FROM c), d AS (SELECT nation, draw, ((nation * 7919 + draw * 104729) % 10007 + 0.5) / 10007 AS u FROM h, (SELECT unnest(range(1, 41)) AS draw))
SELECT nation, draw, first(h ORDER BY h, a) AS h, first(a ORDER BY h, a) AS a FROM d JOIN q USING (nation) WHERE upto >= u GROUP BY 1, 2""")
def z01_scoreline_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Joint scores drawn from cumulated chances: of each draw the first score that reaches its number."""
    pairs = nation_rates(spark, sf).select("nation", F.col("rate").alias("x"), (F.col("rate") * 0.8).alias("y"))
    upto = F.sum("p").over(Window.partitionBy("nation").orderBy("h", "a"))
    cells = M.score_matrix(pairs, "x", "y", F.lit(-0.05)).select("nation", "h", "a", upto.alias("upto"))
    listed = cells.groupBy("nation").agg(F.array_sort(F.collect_list(F.struct("upto", "h", "a"))).alias("cells"))
    draws = listed.select("nation", "cells", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("draw"))
    u = ((F.col("nation") * 7919 + F.col("draw") * 104729) % 10007 + 0.5) / 10007
    hit = F.get(F.filter("cells", lambda c: c["upto"] >= u), 0)
    return draws.select("nation", "draw", hit.alias("c")).select("nation", F.col("draw").cast("long").alias("draw"), F.col("c.h").cast("long").alias("h"), F.col("c.a").cast("long").alias("a"))


CUTOFFS = ["1996-01-01", "1997-01-01", "1998-01-01", "1999-01-01", "2000-01-01"]


@plans(GAMES + ", c AS (SELECT CAST(unnest(" + str(CUTOFFS) + ") AS DATE) AS cutoff), w AS (SELECT c.cutoff, s.team, s.scored, s.conceded, pow(0.5, date_diff('day', CAST(s.ts AS DATE), c.cutoff) / 300.0) AS weight FROM s JOIN c ON CAST(s.ts AS DATE) < c.cutoff) SELECT cutoff, team, count(*) AS n, round(sum(weight * scored) / sum(weight), 6) AS attack, round(sum(weight * conceded) / sum(weight), 6) AS defence FROM w GROUP BY 1, 2")
def m23_m28_strength_series(spark: SparkSession, sf: str) -> DataFrame:
    """Time-decayed rates of each team as at each cut-off, from matches before it alone."""
    day = F.to_date("ts")
    later = F.filter(F.array(*(F.lit(c).cast("date") for c in CUTOFFS)), lambda c: c > day)
    rows = team_rows(spark, sf).select("team", "scored", "conceded", day.alias("day"), F.explode(later).alias("cutoff"))
    weight = F.pow(F.lit(0.5), F.datediff("cutoff", "day") / 300)
    rows = rows.withColumn("w", weight)
    mean = lambda c: F.round(F.sum(F.col("w") * F.col(c)) / F.sum("w"), 6)
    return rows.groupBy("cutoff", "team").agg(F.count("*").alias("n"), mean("scored").alias("attack"), mean("conceded").alias("defence"))


FITS = [f"{year}-01-01" for year in range(1996, 2001)]


@plans(GAMES + ", c AS (SELECT CAST(unnest(" + str(FITS) + """) AS TIMESTAMP) AS cutoff), b AS (SELECT c.cutoff, g.*, row_number() OVER (PARTITION BY c.cutoff ORDER BY ts, home, away, hg, ag) AS place, count(*) OVER (PARTITION BY c.cutoff) AS n FROM g JOIN c ON g.ts < c.cutoff),
w AS (SELECT *, pow(0.5, (n - place) / 300.0) AS w FROM b)
SELECT cutoff, home, away, count(*) AS n, round(sum(w), 6) AS w, round(sum(w * hg), 6) AS gh, round(sum(w * ag), 6) AS ga, round(coalesce(sum(w) FILTER (hg = 0 AND ag = 0), 0), 6) AS w00, round(coalesce(sum(w) FILTER (hg = 1 AND ag = 1), 0), 6) AS w11 FROM w GROUP BY 1, 2, 3""")
def m28_decayed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """What the strength fits of five cut-offs need of all matches: decayed sums for each pair of teams."""
    found = ST.decayed_pairs(games(spark, sf), FITS, "ts", "home", "away", "hg", "ag")
    return found.select("cutoff", "home", "away", "n", *(F.round(c, 6).alias(c) for c in ("w", "gh", "ga", "w00", "w11")))


@plans()
def m01_team_strength(spark: SparkSession, sf: str) -> DataFrame:
    """Attack and defence of nations at five cut-offs, each from the matches before it alone."""
    return ST.strength_fits(games(spark, sf), FITS, "ts", "home", "away", "hg", "ag")


def games(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each match of nations, with its score."""
    home = team_rows(spark, sf).filter("is_home = 1")
    return home.select("ts", F.col("team").alias("home"), F.col("opponent").alias("away"), F.col("scored").alias("hg"), F.col("conceded").alias("ag"))


@plans(f"SELECT event_type AS model, max(event_id) FILTER (value > 60) AS active, count(*) AS versions, max(event_id) AS newest FROM (SELECT *, {K} AS k FROM events) GROUP BY 1")
def m22_active_models(spark: SparkSession, sf: str) -> DataFrame:
    """Of all versions of a model, the last that was promoted is in use."""
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.max(F.when(F.col("value") > 60, F.col("event_id"))).alias("active"), F.count("*").alias("versions"), F.max("event_id").alias("newest"))


KINDS = ["click", "error", "purchase", "signup", "view"]


@plans("SELECT user_id, " + ", ".join(f"coalesce(round(avg(value) FILTER (event_type = '{k}' AND value > 30), 6), 'NaN'::DOUBLE) AS {k}" for k in KINDS) + ", CAST(" + " + ".join(f"CASE WHEN count(*) FILTER (event_type = '{k}' AND value > 30) = 0 THEN 1 ELSE 0 END" for k in KINDS) + " AS INT) AS missing FROM events GROUP BY 1")
def m29_model_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """A row of features for each player, NaN where one is missing, and how many are."""
    of = lambda k: F.avg(F.when((F.col("event_type") == k) & (F.col("value") > 30), F.col("value")))
    wide = table(spark, sf, "events").groupBy("user_id").agg(*(F.round(of(k), 6).alias(k) for k in KINDS))
    missing = sum((F.col(k).isNull().cast("int") for k in KINDS), F.lit(0))
    return wide.select("user_id", *(F.coalesce(k, F.lit(float("nan"))).alias(k) for k in KINDS), missing.alias("missing"))


@plans("""WITH p AS (SELECT o_orderkey AS plan, o_custkey AS squad, array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus || l_linenumber)), ',') AS moves FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT plan, squad, first_value(plan) OVER w AS same_as, row_number() OVER w > 1 AS repeats FROM p WINDOW w AS (PARTITION BY squad, moves ORDER BY plan)""")
def o11_identical_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Plans of a squad that make the same moves are marked as the first of them."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("m"))
    moves = table(spark, sf, "orders").join(lines, "o_orderkey").groupBy(F.col("o_orderkey").alias("plan"), F.col("o_custkey").alias("squad")).agg(F.array_join(F.array_sort(F.collect_set("m")), ",").alias("moves"))
    w = Window.partitionBy("squad", "moves").orderBy("plan")
    return moves.select("plan", "squad", F.first("plan").over(w).alias("same_as"), (F.row_number().over(w) > 1).alias("repeats"))


@plans("""WITH r AS (SELECT l_suppkey AS squad, rank() OVER (PARTITION BY l_orderkey ORDER BY q DESC) AS place, q - avg(q) OVER (PARTITION BY l_orderkey) AS lead FROM (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)), a AS (SELECT squad, round(avg(CASE WHEN place = 1 THEN 1.0 ELSE 0.0 END), 9) AS p_first, round(avg(lead), 6) AS lead FROM r GROUP BY 1)
SELECT squad, p_first, lead, row_number() OVER (ORDER BY p_first DESC, lead DESC, squad) AS place FROM a""")
def o13_rank_aware_order(spark: SparkSession, sf: str) -> DataFrame:
    """Squads by their chance to be first among rivals in joint draws, then by their mean lead."""
    q = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_suppkey").alias("squad")).agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("l_orderkey")
    r = q.select("squad", F.rank().over(w.orderBy(F.col("q").desc())).alias("place"), (F.col("q") - F.avg("q").over(w)).alias("lead"))
    a = r.groupBy("squad").agg(F.round(F.avg((F.col("place") == 1).cast("double")), 9).alias("p_first"), F.round(F.avg("lead"), 6).alias("lead"))
    # a row for each squad of the league, as many as suppliers; a range sort would do for more
    return a.select("*", F.row_number().over(Window.orderBy(F.col("p_first").desc(), F.col("lead").desc(), "squad")).alias("place"))


@plans(f"""WITH p AS (SELECT p_size % 10 AS pool, p_partkey, CAST(40 + p_partkey % 60 AS INT) AS price, {POSITION.format(x='p_partkey')} AS position FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY pool, position = 'GK' ORDER BY price, p_partkey) AS n FROM p)
SELECT pool, CAST(sum(price) AS BIGINT) AS cheapest, round(1.25 * sum(price), 2) AS cap FROM r WHERE n <= CASE WHEN position = 'GK' THEN 1 ELSE 3 END GROUP BY 1""")
def o18_bench_cap(spark: SparkSession, sf: str) -> DataFrame:
    """What a bench may cost: a quarter more than the cheapest keeper and three others of a pool."""
    parts = table(spark, sf, "part").selectExpr("p_size % 10 AS pool", "p_partkey", "CAST(40 + p_partkey % 60 AS INT) AS price", POSITION.format(x="p_partkey") + " = 'GK' AS keeper")
    cheapest = top_per_group(parts, ["pool", "keeper"], [F.col("price"), F.col("p_partkey")], 3, "n").filter((F.col("n") == 1) | ~F.col("keeper"))
    return cheapest.groupBy("pool").agg(F.sum("price").alias("cheapest"), F.round(1.25 * F.sum("price"), 2).alias("cap"))


@plans(f"SELECT user_id AS squad, k AS player, price FROM (SELECT user_id, k, arg_max(event_type, (ts, event_id)) AS what, arg_max(value, (ts, event_id)) AS price FROM (SELECT *, {K} AS k FROM events) WHERE event_type IN ('purchase', 'signup', 'error') GROUP BY 1, 2) WHERE what <> 'error'")
def o20_draft_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Drafts after all edits in order: what was added or priced anew and not dropped later."""
    edits = events(spark, sf).filter(F.col("event_type").isin("purchase", "signup", "error"))
    last = edits.groupBy(F.col("user_id").alias("squad"), F.col("k").alias("player")).agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("e"))
    return last.filter("e.event_type <> 'error'").select("squad", "player", F.col("e.value").alias("price"))


@plans("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN 'smith ' || o_custkey END AS out_name, CASE WHEN o_orderkey % 5 <> 4 THEN 'de jong ' || o_orderkey END AS in_name FROM orders")
def t17_swaps(spark: SparkSession, sf: str) -> DataFrame:
    """Swaps as people write them: with an arrow of either kind, with for or to; anything else is none."""
    a, b = F.concat(F.lit("Smith "), F.col("o_custkey").cast("string")), F.concat(F.lit("de Jong "), F.col("o_orderkey").cast("string"))
    k = F.col("o_orderkey") % 5
    said = F.when(k == 0, F.concat(a, F.lit(" -> "), b)).when(k == 1, F.concat(a, F.lit("→"), b)).when(k == 2, F.concat(b, F.lit(" for "), a)).when(k == 3, F.concat(a, F.lit(" to "), b)).otherwise(F.concat(F.lit("hold "), a))
    out, new = T.swap(F.col("said"))
    return table(spark, sf, "orders").select("o_orderkey", said.alias("said")).select("o_orderkey", T.normal_name(out).alias("out_name"), T.normal_name(new).alias("in_name"))




def _spearman_sql(x: str) -> str:
    return f"(SELECT round(corr(rank_x, rank_y), 6) FROM (SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rank_x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rank_y FROM b))"


@plans("WITH b AS (SELECT l_suppkey, round(avg(l_discount), 9) AS d, round(avg(l_tax), 9) AS t, round(avg(l_quantity) / 50, 9) AS q, round(avg(l_extendedprice), 6) AS y FROM lineitem GROUP BY 1) SELECT 'none' AS dropped, " + _spearman_sql("round(d + t + q, 9)") + " AS spearman UNION ALL SELECT 'discount', " + _spearman_sql("round(t + q, 9)") + " UNION ALL SELECT 'tax', " + _spearman_sql("round(d + q, 9)") + " UNION ALL SELECT 'quantity', " + _spearman_sql("round(d + t, 9)"))
def o15_ablations(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation of a forecast with the outcome, whole and with each block of inputs left out."""
    from ..operators.aggregates import spearman

    means = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 9).alias("d"), F.round(F.avg("l_tax"), 9).alias("t"), F.round(F.avg("l_quantity") / 50, 9).alias("q"), F.round(F.avg("l_extendedprice"), 6).alias("y"))
    forecasts = {"none": ("d", "t", "q"), "discount": ("t", "q"), "tax": ("d", "q"), "quantity": ("d", "t")}
    rows = means.select("y", F.inline(F.array(*(F.struct(F.lit(n).alias("dropped"), F.round(sum((F.col(c) for c in cs[1:]), F.col(cs[0])), 9).alias("x")) for n, cs in forecasts.items()))))
    return spearman(rows, ["dropped"], "x", "y").select("dropped", F.round("spearman", 6).alias("spearman"))
