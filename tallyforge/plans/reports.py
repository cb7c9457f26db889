"""Look-ups, states, reports, entities and model bookkeeping on the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import models as M
from ..operators import states as S
from ..operators import windows as W
from ..operators.asof import top_per_group
from .base import Plans, table
from .columns import K, RATE, events, rate_rows
from .form import CLAIMS, GAMES, claims, team_rows
from .scoring import APPEARANCES, POINTS, POSITION, STATS, appearances

plans = Plans()


@plans(GAMES + " SELECT g.match_id, h.n_name AS home_name, a.n_name AS away_name FROM g JOIN nation h ON h.n_nationkey = g.home JOIN nation a ON a.n_nationkey = g.away")
def j06_two_roles(spark: SparkSession, sf: str) -> DataFrame:
    """One dimension in two roles: the names of both teams of a match."""
    names = table(spark, sf, "nation")
    home, away = (names.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(f"{r}_name")) for k, r in (("team", "home"), ("opponent", "away")))
    return team_rows(spark, sf).filter("is_home = 1").join(home, "team").join(away, "opponent").select("match_id", "home_name", "away_name")


@plans("SELECT c_custkey, (SELECT round(sum(o_totalprice), 2) FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01') AS spent, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c")
def j10_correlated_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    late = F.col("o_orderdate") >= F.expr("timestamp_ntz'1998-01-01'")
    sums = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum(F.when(late, F.col("o_totalprice"))), 2).alias("spent"), F.count("*").alias("n"))
    return table(spark, sf, "customer").select("c_custkey").join(sums, "c_custkey", "left").select("c_custkey", "spent", F.coalesce("n", F.lit(0)).alias("n"))


@plans("SELECT l_suppkey, round(sum(l_quantity), 4) AS q, coalesce(max(s_name), 'unknown') AS name FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 9 <> 0) s ON s_suppkey = l_suppkey GROUP BY 1")
def j22_lookup_with_default(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "supplier").filter("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name"))
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 4).alias("q")).join(known, "l_suppkey", "left").withColumn("name", F.coalesce("name", F.lit("unknown")))


@plans("""WITH s AS (SELECT l_orderkey, l_suppkey, arg_max(l_quantity >= 25, (l_shipdate, l_partkey, l_linenumber, l_extendedprice)) AS named FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1, 2), f AS (SELECT DISTINCT l_orderkey FROM s), q AS (SELECT o_orderkey, o_orderkey % 20 AS player FROM orders)
SELECT q.o_orderkey, q.player, CASE WHEN f.l_orderkey IS NOT NULL THEN coalesce(s.named, false) END AS confirmed FROM q LEFT JOIN f ON f.l_orderkey = q.o_orderkey LEFT JOIN s ON s.l_orderkey = q.o_orderkey AND s.l_suppkey = q.player""")
def j26_three_valued_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Named in the newest sheet of a match, not named though there is one, or not known."""
    at = F.struct("l_shipdate", "l_partkey", "l_linenumber", "l_extendedprice")
    sheets = table(spark, sf, "lineitem").filter("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("player"), at.alias("at"), (F.col("l_quantity") >= 25).alias("named"))
    asked = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 20).alias("player"))
    return S.three_valued(asked, sheets, "o_orderkey", "player", "at", "named", "confirmed").select("o_orderkey", "player", "confirmed")


@plans(GAMES + " SELECT team, match_id, opponent, is_home, nth FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY ts, match_id, is_home) AS nth FROM s WHERE ts > TIMESTAMP '1999-06-01') WHERE nth <= 5")
def j27_next_fixtures(spark: SparkSession, sf: str) -> DataFrame:
    after = F.col("ts") > F.expr("timestamp_ntz'1999-06-01'")
    return S.next_rows(team_rows(spark, sf), "team", ["ts", "match_id", "is_home"], after, 5).select("team", "match_id", "opponent", "is_home", "nth")


@plans("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS price, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def j28_newest_row(spark: SparkSession, sf: str) -> DataFrame:
    newest = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by(F.struct("value", "event_id"), F.struct("ts", "event_id")).alias("r"))
    return newest.select("user_id", "event_type", F.col("r.value").alias("price"), "r.event_id")


@plans("SELECT o_orderkey, c_custkey + 1000000 AS external_id, c_custkey AS back, md5(year(o_orderdate) || '/' || c_custkey) AS season_code FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 4 <> 0")
def j29_id_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Internal ids out to external ones and back, and a code for each season."""
    ids = table(spark, sf, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") + 1_000_000).alias("external_id"))
    out = table(spark, sf, "orders").join(ids, "o_custkey").select("o_orderkey", "external_id", F.year("o_orderdate").alias("y"))
    back = ids.withColumnRenamed("o_custkey", "back")
    return out.join(back, "external_id").select("o_orderkey", "external_id", "back", F.md5(F.concat_ws("/", F.col("y").cast("string"), F.col("back").cast("string"))).alias("season_code"))


@plans(CLAIMS + " SELECT player, event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY ts DESC, event_id DESC) AS n FROM c WHERE stance = 'negative' AND ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-25' AND player IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)) WHERE n <= 10")
def j30_claims_against_squad(spark: SparkSession, sf: str) -> DataFrame:
    """The newest ten claims against each player of a squad in the last ten days."""
    squad = table(spark, sf, "supplier").filter("s_nationkey < 12").select(F.col("s_suppkey").alias("player"))
    recent = claims(spark, sf).filter((F.col("stance") == "negative") & (F.col("ts") >= F.expr("timestamp_ntz'2024-01-15'")) & (F.col("ts") < F.expr("timestamp_ntz'2024-01-25'")))
    return top_per_group(recent.join(squad, "player", "left_semi"), ["player"], [F.col("ts").desc(), F.col("event_id").desc()], 10).select("player", "event_id", "kind")


@plans(f"SELECT l_orderkey, CAST(sum(coalesce(CASE WHEN l_linenumber % 3 = 0 THEN bonus * 2 END, {POINTS})) AS BIGINT) AS points FROM ({APPEARANCES}) GROUP BY 1")
def a02_points_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The official total where it is known, else what the rules give."""
    official = F.when(F.col("l_linenumber") % 3 == 0, F.col("bonus") * 2)
    return appearances(spark, sf).groupBy("l_orderkey").agg(F.sum(F.coalesce(official, R.points({n: F.col(n) for n in STATS}, F.col("position")))).cast("long").alias("points"))


@plans("SELECT o_custkey, min(o_orderdate) AS first_order, min(CAST(substr(o_orderpriority, 1, 1) AS INT)) AS best_rank FROM orders GROUP BY 1")
def a06_first_and_best(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"), F.min(F.substring("o_orderpriority", 1, 1).cast("int")).alias("best_rank"))


@plans("SELECT l_orderkey, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(l_quantity) END, 8) AS sd FROM lineitem GROUP BY 1")
def a10_small_group_spread(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.when(F.count("*") < 2, 0.0).otherwise(F.stddev_pop("l_quantity")), 8).alias("sd"))


@plans(f"SELECT event_type AS task, k % 4 AS model, count(*) AS calls, round(sum(value), 4) AS tokens, round(avg(CASE WHEN value < 5 THEN 1.0 ELSE 0.0 END), 9) AS failed, max(ts) AS last_call FROM (SELECT *, {K} AS k FROM events) GROUP BY 1, 2")
def a24_usage_summary(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy(F.col("event_type").alias("task"), (F.col("k") % 4).alias("model")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("tokens"), F.round(F.avg((F.col("value") < 5).cast("double")), 9).alias("failed"), F.max("ts").alias("last_call"))


@plans("SELECT o_custkey, round(avg(o_totalprice), 4) AS mean_total FROM orders WHERE o_orderstatus IN ('F', 'P') AND year(o_orderdate) BETWEEN 1996 AND 1999 AND o_totalprice > 0 GROUP BY 1")
def a26_season_mean(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").filter(F.col("o_orderstatus").isin("F", "P") & F.year("o_orderdate").between(1996, 1999) & (F.col("o_totalprice") > 0))
    return rows.groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 4).alias("mean_total"))


@plans("""WITH d AS (SELECT user_id, 'deadline' AS kind, event_id FROM events WHERE abs((epoch_us(date_trunc('week', ts) + INTERVAL 7 DAY) - epoch_us(ts)) / 3600e6 - 24) <= 0.5 OR abs((epoch_us(date_trunc('week', ts) + INTERVAL 7 DAY) - epoch_us(ts)) / 3600e6 - 2) <= 0.5),
p AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS a, arg_max(event_id, (ts, event_id)) AS b, arg_min(value, (ts, event_id)) AS x, arg_max(value, (ts, event_id)) AS y FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1)
SELECT * FROM d UNION ALL SELECT user_id, 'price', b FROM p WHERE x <> y AND user_id % 2 = 0 UNION ALL SELECT user_id, 'injury', event_id FROM events WHERE event_type = 'error' AND value > 100 AND user_id % 2 = 0""")
def a29_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Deadlines half an hour around a threshold, prices that changed in a day and injuries, of owned players alone."""
    e = table(spark, sf, "events")
    week_end = F.unix_micros(F.expr("date_trunc('week', CAST(ts AS TIMESTAMP)) + INTERVAL 7 DAYS"))
    hours = (week_end - F.unix_micros(F.col("ts").cast("timestamp"))) / 3600e6
    due = e.filter((F.abs(hours - 24) <= 0.5) | (F.abs(hours - 2) <= 0.5)).select("user_id", F.lit("deadline").alias("kind"), "event_id")
    day = e.filter((F.col("event_type") == "view") & (F.col("ts") >= F.expr("timestamp_ntz'2024-01-20'")) & (F.col("ts") < F.expr("timestamp_ntz'2024-01-21'")) & (F.col("user_id") % 2 == 0))
    at = F.struct("ts", "event_id")
    moved = day.groupBy("user_id").agg(F.min_by("value", at).alias("x"), F.max_by("value", at).alias("y"), F.max_by("event_id", at).alias("event_id")).filter("x <> y").select("user_id", F.lit("price").alias("kind"), "event_id")
    hurt = e.filter((F.col("event_type") == "error") & (F.col("value") > 100) & (F.col("user_id") % 2 == 0)).select("user_id", F.lit("injury").alias("kind"), "event_id")
    return due.unionByName(moved).unionByName(hurt)


@plans("SELECT p_partkey, w AS week FROM (SELECT p_partkey, unnest(range(p_size % 38 + 1, least(p_size % 38 + 1 + 4, 38) + 1)) AS w FROM part)")
def a30_planning_horizon(spark: SparkSession, sf: str) -> DataFrame:
    """The next week and up to four more, as far as the season goes."""
    start = F.col("p_size") % 38 + 1
    return table(spark, sf, "part").select("p_partkey", F.explode(F.sequence(start.cast("long"), F.least(start + 4, F.lit(38)).cast("long"))).alias("week"))


@plans("SELECT DISTINCT player FROM (SELECT s_suppkey AS player FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)")
def a31_priority_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Who is watched or owned."""
    watched = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("player"))
    return watched.unionByName(table(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_suppkey").alias("player"))).distinct()


@plans("SELECT o_custkey, max(o_orderdate) FILTER (o_orderdate <= TIMESTAMP '1998-06-01') AS current_deadline, min(o_orderdate) FILTER (o_orderdate > TIMESTAMP '1998-06-01') AS next_deadline, CAST(epoch(min(o_orderdate) FILTER (o_orderdate > TIMESTAMP '1998-06-01')) - epoch(TIMESTAMP '1998-06-01') AS BIGINT) AS seconds_left, CAST(year(min(o_orderdate)) AS INT) AS season FROM orders GROUP BY 1")
def a32_deadlines(spark: SparkSession, sf: str) -> DataFrame:
    """The deadline that is past and the one to come, how long it takes, and the season of the first."""
    at = F.expr("timestamp_ntz'1998-06-01'")
    d = F.col("o_orderdate")
    due = F.min(F.when(d > at, d))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.when(d <= at, d)).alias("current_deadline"), due.alias("next_deadline"), (W.epoch(due) - W.epoch(at)).cast("long").alias("seconds_left"), F.year(F.min(d)).alias("season"))


@plans("SELECT c_nationkey, CAST(sum(coalesce(nullif(CASE WHEN c_custkey % 4 = 0 THEN 0 WHEN c_custkey % 4 > 1 THEN price - 3 END, 0), price)) AS BIGINT) AS squad_value FROM (SELECT *, CAST(floor(abs(c_acctbal) / 50) AS BIGINT) AS price FROM customer) GROUP BY 1")
def a33_squad_value(spark: SparkSession, sf: str) -> DataFrame:
    """What a squad sells for: the price where the selling price is missing or 0."""
    price = F.floor(F.abs("c_acctbal") / 50)
    sell = F.when(F.col("c_custkey") % 4 == 0, 0).when(F.col("c_custkey") % 4 > 1, price - 3)
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.sum(F.coalesce(F.nullif(sell, F.lit(0)), price)).alias("squad_value"))


@plans("SELECT o_orderkey, round(cume_dist() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice), 9) AS percentile FROM orders")
def w08_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.round(W.percentile_in_group("o_totalprice", ["o_orderpriority"]), 9).alias("percentile"))


@plans("""WITH d AS (SELECT o_orderkey % 500 AS fixture, o_orderkey, sim, (o_orderkey * 7919 + sim * 104729) % 1009 + o_totalprice / 1e7 AS bps FROM orders, (SELECT unnest(range(1, 6)) AS sim)), r AS (SELECT *, row_number() OVER (PARTITION BY fixture, sim ORDER BY bps DESC, o_orderkey) AS n FROM d)
SELECT o_orderkey, CAST(sum(CASE WHEN n <= 3 THEN 4 - n ELSE 0 END) AS BIGINT) AS bonus FROM r GROUP BY 1""")
def w11_bonus_by_draw(spark: SparkSession, sf: str) -> DataFrame:
    """Places in each draw of a fixture, three to one points for the first three, added up over draws."""
    draws = table(spark, sf, "orders").select((F.col("o_orderkey") % 500).alias("fixture"), "o_orderkey", "o_totalprice", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("sim"))
    bps = (F.col("o_orderkey") * 7919 + F.col("sim") * 104729) % 1009 + F.col("o_totalprice") / 1e7
    n = F.row_number().over(Window.partitionBy("fixture", "sim").orderBy(bps.desc(), "o_orderkey"))
    return draws.withColumn("n", n).groupBy("o_orderkey").agg(F.sum(F.greatest(F.lit(0), 4 - F.col("n"))).alias("bonus"))


@plans(f"WITH e AS (SELECT *, {K} AS k, row_number() OVER (PARTITION BY user_id, {K} ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id, {K}) AS seen FROM events) SELECT user_id, k, event_id, seen FROM e WHERE n = 1")
def w14_seen_on_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Of stories that are one, the first, and on how many sites it was seen."""
    first = events(spark, sf).groupBy("user_id", "k").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("seen"))
    return first.select("user_id", "k", "event_id", "seen")


@plans("SELECT o_custkey, round(sum(o_totalprice * pow(0.9, n - 1)), 4) AS form FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) GROUP BY 1")
def w17_decay_by_row(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", S.decayed_by_row("o_totalprice", ["o_custkey"], ["o_orderdate", "o_orderkey"], 0.9).alias("x"))
    return rows.groupBy("o_custkey").agg(F.round(F.sum("x"), 4).alias("form"))


@plans("WITH v AS (SELECT event_id, event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events) SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY v ASC NULLS LAST, event_id) AS up, row_number() OVER (PARTITION BY event_type ORDER BY v DESC NULLS FIRST, event_id) AS down FROM v")
def l01_nulls_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Missing values come last upwards and, the order being reversed, first downwards."""
    v = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))
    place = lambda c: F.row_number().over(Window.partitionBy("event_type").orderBy(c, "event_id"))
    return v.select("event_id", place(F.col("v").asc_nulls_last()).alias("up"), place(F.col("v").desc_nulls_first()).alias("down"))


@plans("(SELECT 'top' AS list, l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 15) UNION ALL (SELECT 'worst', l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY round(abs(l_extendedprice / l_quantity - 1500), 6) DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10)")
def l03_top_and_worst(spark: SparkSession, sf: str) -> DataFrame:
    """The fifteen highest forecasts and the ten largest errors."""
    rows, ties = table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"]
    first = lambda name, c, n: rows.orderBy(c.desc(), *ties).limit(n).select(F.lit(name).alias("list"), *ties)
    return first("top", F.col("l_extendedprice"), 15).unionByName(first("worst", F.round(F.abs(F.expr("l_extendedprice / l_quantity - 1500")), 6), 10))


@plans("SELECT o_custkey, o_orderkey, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 4")
def l05_newest_of_each(spark: SparkSession, sf: str) -> DataFrame:
    return top_per_group(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 4, "n").select("o_custkey", "o_orderkey", "n")


@plans(f"SELECT c_custkey // 15 AS squad, c_custkey, row_number() OVER (PARTITION BY c_custkey // 15 ORDER BY ({POSITION.format(x='c_custkey')}) <> 'GK', c_acctbal DESC, c_custkey) AS place FROM customer")
def l07_bench_order(spark: SparkSession, sf: str) -> DataFrame:
    """The keeper first, then by utility."""
    rows = table(spark, sf, "customer").selectExpr("c_custkey div 15 AS squad", "c_custkey", "c_acctbal", POSITION.format(x="c_custkey") + " AS position")
    return rows.select("squad", "c_custkey", F.row_number().over(Window.partitionBy("squad").orderBy(F.col("position") != "GK", F.col("c_acctbal").desc(), "c_custkey")).alias("place"))


@plans("SELECT DISTINCT o_custkey AS squad, player FROM (SELECT o_custkey, l_suppkey AS player FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT c_custkey, c_custkey % 50 FROM customer)")
def x01_union_of_weeks(spark: SparkSession, sf: str) -> DataFrame:
    """Everyone in any week of a squad or in it now."""
    weeks = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("squad"), F.col("l_suppkey").alias("player"))
    now = table(spark, sf, "customer").select(F.col("c_custkey").alias("squad"), (F.col("c_custkey") % 50).alias("player"))
    return weeks.unionByName(now).distinct()


@plans("SELECT l_partkey FROM (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def x03_in_all(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that lines of all return flags have."""
    pairs = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag").distinct()
    total = pairs.agg(F.count_distinct("l_returnflag").alias("flags"))
    return pairs.groupBy("l_partkey").agg(F.count("*").alias("n")).join(total, F.col("n") == F.col("flags")).select("l_partkey")


@plans(f"SELECT user_id, k, arg_max(event_type, (ts, event_id)) AS state, arg_max(value, (ts, event_id)) AS bank, count(DISTINCT date_trunc('hour', ts)) AS saves FROM (SELECT *, {K} AS k FROM events) GROUP BY 1, 2")
def d09_last_state_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Of states saved for one key the last counts; saves within the same hour count as one."""
    last = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("r")
    rows = events(spark, sf).groupBy("user_id", "k").agg(last, F.count_distinct(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("saves"))
    return rows.select("user_id", "k", F.col("r.event_type").alias("state"), F.col("r.value").alias("bank"), "saves")


@plans(f"WITH e AS (SELECT user_id, {K} AS k, event_id, value FROM events), r AS (SELECT user_id, k, arg_max(value, event_id) AS value FROM e GROUP BY 1, 2) SELECT user_id, k, value FROM r UNION ALL SELECT p_partkey + 100000, p_size, p_retailprice FROM part")
def d03_insert_or_replace(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.joins import upsert

    target = table(spark, sf, "part").select((F.col("p_partkey") + 100000).alias("user_id"), F.col("p_size").alias("k"), F.col("p_retailprice").alias("value"))
    return upsert(target, events(spark, sf).select(F.col("user_id").cast("long").alias("user_id"), "k", "value", "event_id"), ["user_id", "k"], ["event_id"])


@plans("""WITH m AS (SELECT s_suppkey AS old, s_suppkey - s_suppkey % 10 AS canon FROM supplier WHERE s_suppkey % 10 BETWEEN 1 AND 3), f AS (SELECT DISTINCT l_suppkey AS player, l_orderkey AS fixture FROM lineitem), j AS (SELECT coalesce(m.canon, f.player) AS player, f.fixture, m.canon IS NOT NULL AS moved, f.player AS was FROM f LEFT JOIN m ON m.old = f.player)
SELECT player, fixture, was FROM (SELECT *, row_number() OVER (PARTITION BY player, fixture ORDER BY moved, was) AS n FROM j) WHERE n = 1""")
def d10_merge_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of merged players go to the one that stays, but for those that it has itself."""
    mapping = table(spark, sf, "supplier").filter("s_suppkey % 10 BETWEEN 1 AND 3").selectExpr("s_suppkey AS old", "s_suppkey - s_suppkey % 10 AS canon")
    facts = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("player"), F.col("l_orderkey").alias("fixture")).distinct().withColumn("was", F.col("player"))
    return S.merge_ids(facts, mapping, "player", ["player", "fixture"])


@plans("""SELECT c_custkey, s_suppkey AS entity, s_suppkey IS NULL AS created FROM (SELECT c_custkey, 'P' || c_custkey % 400 AS name, CASE WHEN c_custkey % 3 <> 0 THEN DATE '1990-01-01' + CAST(c_custkey % 5 AS INT) END AS born FROM customer) c
LEFT JOIN LATERAL (SELECT min(s_suppkey) AS s_suppkey FROM (SELECT s_suppkey, 'P' || s_suppkey AS sname, CASE WHEN s_suppkey % 4 <> 0 THEN DATE '1990-01-01' + CAST(s_suppkey % 5 AS INT) END AS sborn FROM supplier) s WHERE sname = name AND (sborn = born OR sborn IS NULL OR born IS NULL)) ON true""")
def e02_find_or_create(spark: SparkSession, sf: str) -> DataFrame:
    """A person by name and date of birth, which either side may not know."""
    born = lambda c, n: F.when(F.col(c) % n != 0, F.date_add(F.lit("1990-01-01").cast("date"), (F.col(c) % 5).cast("int"))).alias("born")
    known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("name"), born("s_suppkey", 4))
    wanted = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("P"), (F.col("c_custkey") % 400).cast("string")).alias("name"), born("c_custkey", 3))
    return S.find_or_create(wanted, known, "name", "born", "entity").select("c_custkey", "entity", F.col("entity").isNull().alias("created"))


@plans("SELECT e.event_id, s.s_suppkey AS entity, s.s_suppkey IS NULL AS unmapped FROM events e LEFT JOIN (SELECT s_suppkey, 'ext-' || (s_suppkey * 3) AS code FROM supplier WHERE s_suppkey % 6 <> 0) s ON s.code = 'ext-' || e.user_id")
def e01_external_ids(spark: SparkSession, sf: str) -> DataFrame:
    codes = table(spark, sf, "supplier").filter("s_suppkey % 6 <> 0").select(F.col("s_suppkey").alias("entity"), F.concat(F.lit("ext-"), (F.col("s_suppkey") * 3).cast("string")).alias("code"))
    asked = table(spark, sf, "events").select("event_id", F.concat(F.lit("ext-"), F.col("user_id").cast("string")).alias("code"))
    return asked.join(codes, "code", "left").select("event_id", "entity", F.col("entity").isNull().alias("unmapped"))


@plans(r"""WITH n AS (SELECT page_id AS entity, regexp_extract_all(lower(strip_accents(regexp_extract(html, '(?s)<title>(.*?)</title>', 1))), '[a-z0-9]+')[-1] AS surname FROM pages),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+')) AS word FROM documents)
SELECT w.doc_id, n.entity FROM w JOIN n ON n.surname = w.word WHERE length(n.surname) > 2""")
def e05_mention_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    """The entities whose surname, the last word of a page's title, is a word of a text: all entities, by an equi-join on words."""
    tokens = lambda c: F.regexp_extract_all(F.lower(T.strip_accents(c)), F.lit("[a-z0-9]+"), F.lit(0))
    title = tokens(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    names = table(spark, sf, "pages").select(F.col("page_id").alias("entity"), F.try_element_at(title, F.lit(-1)).alias("surname"))
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("surname"))
    return words.join(names.filter(F.length("surname") > 2), "surname").select("doc_id", "entity")


@plans("""WITH p AS (SELECT c_custkey AS entity, 'code' || c_custkey // 3 AS code, CASE WHEN c_custkey % 3 = 0 THEN 'Name ' || c_custkey ELSE 'Name' END AS name, c_custkey % 7 AS season FROM customer UNION ALL SELECT c_custkey, 'code' || (c_custkey + 5) // 3, 'Name', 1 FROM customer WHERE c_custkey % 10 = 0),
g AS (SELECT entity, code, arg_max(name, season) AS name, max(season) AS season FROM p GROUP BY 1, 2), c AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY entity) AS codes FROM g) WHERE codes = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY regexp_matches(name, '[0-9]'), season DESC, entity) AS n FROM c) SELECT b.entity, k.entity AS canon FROM b JOIN b k ON k.code = b.code AND k.n = 1 WHERE b.n > 1""")
def e06_duplicate_entities(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    name = F.when(c % 3 == 0, F.concat(F.lit("Name "), c.cast("string"))).otherwise("Name")
    code = lambda x: F.concat(F.lit("code"), F.floor(x / 3).cast("string"))
    rows = table(spark, sf, "customer")
    seen = rows.select(c.alias("entity"), code(c).alias("code"), name.alias("name"), (c % 7).alias("season"))
    twice = rows.filter(c % 10 == 0).select(c.alias("entity"), code(c + 5).alias("code"), F.lit("Name").alias("name"), F.lit(1).cast("long").alias("season"))
    return S.duplicate_entities(seen.unionByName(twice), "entity", "code", "name", "season")


@plans("SELECT o_orderkey, n_nationkey AS club FROM orders LEFT JOIN (SELECT n_nationkey, 'team nation ' || n_nationkey AS alias FROM nation WHERE n_nationkey % 5 <> 0) n ON alias = 'team nation ' || o_custkey % 25")
def e07_m05_club_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Club names in any spelling, to one key for all seasons."""
    aliases = table(spark, sf, "nation").filter("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("club"), T.normal_name(F.concat(F.lit("Team "), F.translate("n_name", "_", "-"))).alias("alias"))
    seen = table(spark, sf, "orders").select("o_orderkey", T.normal_name(F.concat(F.lit("TEAM  Nation-"), (F.col("o_custkey") % 25).cast("string"))).alias("alias"))
    return seen.join(aliases, "alias", "left").select("o_orderkey", "club")


@plans(CLAIMS + ", k AS (SELECT event_id, player, CASE WHEN kind = 'purchase' AND stance = 'positive' THEN 'buy' WHEN kind = 'error' AND stance <> 'positive' THEN 'sell' WHEN kind = 'signup' AND stance = 'positive' THEN 'captain' WHEN kind = 'click' AND stance <> 'positive' THEN 'avoid' END AS call FROM c) SELECT * FROM k WHERE call IS NOT NULL AND event_id % 7 <> 0")
def t12_calls_from_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims that can be scored later, but for those that already are calls."""
    good = F.col("stance") == "positive"
    call = F.when((F.col("kind") == "purchase") & good, "buy").when((F.col("kind") == "error") & ~good, "sell").when((F.col("kind") == "signup") & good, "captain").when((F.col("kind") == "click") & ~good, "avoid")
    made = table(spark, sf, "events").filter("event_id % 7 = 0").select("event_id")
    return claims(spark, sf).select("event_id", "player", call.alias("call")).filter("call IS NOT NULL").join(made, "event_id", "left_anti")


@plans(CLAIMS + " SELECT c.event_id, p.page_id, p.url || CASE WHEN contains(p.url, '?') THEN '&t=' ELSE '?t=' END || c.k || 's' AS link, row_number() OVER (PARTITION BY p.page_id ORDER BY c.k, c.event_id) AS place FROM c JOIN pages p ON p.page_id = c.k")
def t14_t18_evidence_links(spark: SparkSession, sf: str) -> DataFrame:
    """The claims of each video in order of time, with links to their places."""
    pages = table(spark, sf, "pages").select(F.col("page_id"), "url")
    rows = claims(spark, sf).join(pages, F.col("page_id") == F.col("k"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("k", "event_id"))
    return rows.select("event_id", "page_id", T.deep_link(F.col("url"), F.col("k").cast("double")).alias("link"), place.alias("place"))


@plans("SELECT user_id, adjustment, row_number() OVER (ORDER BY abs(adjustment) DESC, user_id) AS place FROM (SELECT user_id, round(arg_max(value, (ts, event_id)) - 30, 4) AS adjustment FROM events GROUP BY 1) WHERE adjustment <> 0 ORDER BY place LIMIT 50")
def t19_adjustment_report(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty largest adjustments that aren't 0, either way."""
    newest = table(spark, sf, "events").groupBy("user_id").agg(F.round(F.max_by("value", F.struct("ts", "event_id")) - 30, 4).alias("adjustment")).filter("adjustment <> 0")
    top = newest.orderBy(F.abs("adjustment").desc(), "user_id").limit(50)
    return top.select("user_id", "adjustment", F.row_number().over(Window.orderBy(F.abs("adjustment").desc(), "user_id")).alias("place"))


@plans("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL) ORDER BY doc_id DESC LIMIT 64")
def t06_pending_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The newest 64 documents that have no vector yet."""
    done = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf, "documents").select("doc_id").join(done, "doc_id", "left_anti").orderBy(F.col("doc_id").desc()).limit(64)


SQUADS = f"SELECT c_custkey // 60 AS squad, c_custkey, {POSITION.format(x='c_custkey')} AS position, c_acctbal / 100 AS utility FROM customer"
SHAPES = "(SELECT d.x AS d, m.x AS m, 10 - d.x - m.x AS f FROM (SELECT unnest([3, 4, 5]) AS x) d, (SELECT unnest([2, 3, 4, 5]) AS x) m WHERE 10 - d.x - m.x BETWEEN 1 AND 3)"


@plans(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY squad, position ORDER BY utility DESC, c_custkey) AS n FROM ({SQUADS})), t AS (SELECT squad, d || '-' || m || '-' || f AS formation, sum(utility) AS total, count(*) AS players FROM p JOIN {SHAPES} s ON n <= CASE position WHEN 'GK' THEN 1 WHEN 'DEF' THEN d WHEN 'MID' THEN m ELSE f END GROUP BY 1, 2)
SELECT squad, formation, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY squad ORDER BY round(total, 9) DESC, formation) AS k FROM t WHERE players = 11) WHERE k = 1""")
def o02_best_lineup(spark: SparkSession, sf: str) -> DataFrame:
    picks = table(spark, sf, "customer").selectExpr("c_custkey div 60 AS squad", "c_custkey", POSITION.format(x="c_custkey") + " AS position", "c_acctbal / 100 AS utility")
    return S.best_lineups(picks, "squad", "position", "utility", "c_custkey", list(R.FORMATIONS)).withColumn("total", F.round("total", 6))


@plans("""WITH n AS (SELECT squad, arg_max(source, (ts, event_id)) AS source, arg_max(CAST(floor(v) AS BIGINT) % 6, (ts, event_id)) AS free FROM (SELECT user_id AS squad, CASE event_type WHEN 'purchase' THEN 'sync' ELSE 'manual' END AS source, ts, event_id, value AS v FROM events WHERE event_type IN ('purchase', 'view')) GROUP BY 1),
m AS (SELECT user_id AS squad, count(*) % 3 AS made FROM events WHERE event_type = 'click' GROUP BY 1) SELECT n.squad, n.source, greatest(0, n.free - coalesce(m.made, 0)) AS free_left FROM n LEFT JOIN m ON m.squad = n.squad""")
def o17_state_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """What is owned: the newest state from a sync or by hand, drafts and plans aside, and the free moves that are left."""
    source = F.when(F.col("event_type") == "purchase", "sync").when(F.col("event_type") == "view", "manual").when(F.col("event_type") == "click", "draft").otherwise("planned")
    states = table(spark, sf, "events").select(F.col("user_id").alias("squad"), source.alias("source"), "ts", "event_id", (F.floor("value") % 6).alias("free"))
    made = states.filter("source = 'draft'").groupBy("squad").agg((F.count("*") % 3).alias("made"))
    now = S.resolve_states(states, "squad", "source", ["sync", "manual"], ["ts", "event_id"])
    return now.join(made, "squad", "left").select("squad", "source", F.greatest(F.lit(0), F.col("free") - F.coalesce("made", F.lit(0))).alias("free_left"))


@plans(f"""WITH p AS (SELECT l_orderkey AS squad, l_suppkey, l_partkey, l_linenumber, l_quantity AS u, {POSITION.format(x="l_suppkey")} AS position FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY squad ORDER BY u DESC, l_partkey, l_suppkey, l_linenumber) AS n FROM p)
SELECT squad, count(*) FILTER (position = 'DEF') || '-' || count(*) FILTER (position = 'MID') || '-' || count(*) FILTER (position = 'FWD') AS formation, round(sqrt(sum(u * u)), 6) AS spread, max(l_partkey) FILTER (n = 2) AS vice FROM r GROUP BY 1""")
def o19_squad_helpers(spark: SparkSession, sf: str) -> DataFrame:
    """Formation, spread of a sum of independent players, and the vice: the best but for the captain."""
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey AS squad", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity AS u", POSITION.format(x="l_suppkey") + " AS position")
    text, _ = R.formation(F.col("position"))
    second = F.get(F.array_sort(F.collect_list(F.struct((-F.col("u")).alias("u"), "l_partkey", "l_suppkey", "l_linenumber"))), 1)["l_partkey"]
    return rows.groupBy("squad").agg(text.alias("formation"), F.round(F.sqrt(F.sum(F.col("u") * F.col("u"))), 6).alias("spread"), second.alias("vice"))


@plans("SELECT l_orderkey, CASE WHEN n = 0 THEN 'Hold: nothing gains enough' ELSE 'Make ' || n || CASE WHEN n = 1 THEN ' move' ELSE ' moves' END || ' for +' || CAST(g AS BIGINT) || ' points' END AS headline FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS g FROM lineitem GROUP BY 1)")
def o21_headline(spark: SparkSession, sf: str) -> DataFrame:
    made = F.col("l_returnflag") == "R"
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(made).alias("n"), F.coalesce(F.sum(F.when(made, F.col("l_quantity"))), F.lit(0.0)).cast("long").alias("g"))
    text = F.format_string("Make %d %s for +%d points", "n", F.when(F.col("n") == 1, "move").otherwise("moves"), "g")
    return rows.select("l_orderkey", F.when(F.col("n") == 0, "Hold: nothing gains enough").otherwise(text).alias("headline"))


@plans(f"""SELECT event_id, CASE WHEN k % 9 = 0 THEN false WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN value > 45 ELSE value < 45 END WHEN k % 9 = 1 OR k % 9 = 4 THEN true ELSE CASE WHEN k % 2 = 0 THEN value > 40 ELSE value < 40 END END AS promoted FROM (SELECT *, {K} AS k FROM events)""")
def m10_promotion_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Challengers against models in use, some unmeasured, some scored on shared rows, some on another holdout."""
    k, v = F.col("k"), F.col("value")
    new = F.when(k % 9 != 0, v)
    old = F.when(k % 9 != 4, F.lit(40.0))
    mine, theirs = (F.when(k % 3 == 0, x) for x in (v, F.lit(45.0)))
    return events(spark, sf).select("event_id", S.promotes(new, old, mine, theirs, k % 9 != 1, k % 2 == 0).alias("promoted"))


@plans("SELECT o_orderkey, y * 100 + w AS span, CASE WHEN place <= 5 THEN 'holdout' ELSE 'train' END AS part FROM (SELECT *, dense_rank() OVER (ORDER BY y DESC, w DESC) AS place FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS w FROM orders))")
def m09_holdout_span(spark: SparkSession, sf: str) -> DataFrame:
    """The last five periods of all are held out."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("w"))
    return W.holdout_keys(rows, ["y", "w"]).select("o_orderkey", (F.col("y") * 100 + F.col("w")).alias("span"), F.when(F.col("is_holdout"), "holdout").otherwise("train").alias("part"))
