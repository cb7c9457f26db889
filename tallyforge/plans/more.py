"""Further rules, reconciliations and reports on the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins as J
from ..operators import models as M
from ..operators.asof import top_per_group
from .base import Plans, table
from .scoring import nation_rates, RATES

plans = Plans()

CHIPS = ("view", "click", "signup", "purchase")


@plans("""WITH used AS (SELECT DISTINCT user_id, event_type AS chip, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS half FROM events WHERE value > 60)
SELECT u.user_id, h.half, string_agg(c.chip, ',' ORDER BY c.chip) AS available FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest([1, 2]) AS half) h, (SELECT unnest(['view', 'click', 'signup', 'purchase']) AS chip) c
WHERE NOT EXISTS (SELECT 1 FROM used x WHERE x.user_id = u.user_id AND x.half = h.half AND x.chip = c.chip) GROUP BY 1, 2""")
def r04_available_chips(spark: SparkSession, sf: str) -> DataFrame:
    """Each chip can be played once in each half: what is left to each user, where anything is."""
    half = F.when(F.col("ts") < F.expr("timestamp_ntz'2024-01-16'"), 1).otherwise(2)
    played = table(spark, sf, "events").groupBy("user_id").agg(*(F.collect_set(F.when((half == h) & (F.col("value") > 60), F.col("event_type"))).alias(f"h{h}") for h in (1, 2)))
    left = played.select("user_id", F.inline(F.array(*(F.struct(F.lit(h).alias("half"), F.array_sort(F.array_except(F.array(*map(F.lit, CHIPS)), f"h{h}")).alias("a")) for h in (1, 2)))))
    return left.filter(F.size("a") > 0).select("user_id", "half", F.array_join("a", ",").alias("available"))


@plans("""WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS place FROM lineitem) SELECT l_suppkey, count(*) AS n, round(avg(place), 6) AS mean_rank, round(avg(CASE WHEN place = 1 THEN 1.0 ELSE 0 END), 6) AS p_first FROM r GROUP BY 1""")
def z08_rivals(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as joint draws: how each supplier ranks among those of the same draw."""
    place = F.rank().over(Window.partitionBy("l_orderkey").orderBy(F.col("l_quantity").desc()))
    ranked = table(spark, sf, "lineitem").select("l_suppkey", place.alias("place"))
    return ranked.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.avg("place"), 6).alias("mean_rank"), F.round(F.avg(F.when(F.col("place") == 1, 1.0).otherwise(0.0)), 6).alias("p_first"))


@plans("""SELECT user_id, k, paid FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, arg_max(event_type, (ts, event_id)) AS kind, arg_max(value, (ts, event_id)) AS paid FROM events GROUP BY 1, 2) WHERE kind IN ('purchase', 'signup')""")
def s23_replay_log(spark: SparkSession, sf: str) -> DataFrame:
    """What is held now and the price paid for it: the last event of each item, if it is an entry."""
    key = F.get_json_object("props", "$.k").try_cast("long")
    last = table(spark, sf, "events").groupBy("user_id", key.alias("k")).agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("e"))
    return last.filter(F.col("e.event_type").isin("purchase", "signup")).select("user_id", "k", F.col("e.value").alias("paid"))


@plans("""SELECT o.o_orderkey, c.c_custkey, c.c_custkey IS NULL AS unmapped FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) c ON c.c_custkey = o.o_custkey""")
def s22_sync_with_map(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "customer").filter("c_custkey % 7 <> 0").select("c_custkey")
    joined = table(spark, sf, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", "c_custkey", F.col("c_custkey").isNull().alias("unmapped"))


@plans("""SELECT o_orderpriority AS priority, round(median(o_totalprice), 6) AS median_total, round(avg(o_totalprice) FILTER (WHERE year(o_orderdate) BETWEEN 1996 AND 1997 AND o_totalprice > 0 AND o_orderstatus IN ('O', 'F')), 6) AS mean_total FROM orders GROUP BY 1""")
def a17_median_and_filtered_mean(spark: SparkSession, sf: str) -> DataFrame:
    chosen = F.year("o_orderdate").between(1996, 1997) & (F.col("o_totalprice") > 0) & F.col("o_orderstatus").isin("O", "F")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.round(F.percentile("o_totalprice", 0.5), 6).alias("median_total"), F.round(F.avg(F.when(chosen, F.col("o_totalprice"))), 6).alias("mean_total"))


@plans("""SELECT digest, count(*) AS n FROM (SELECT l_orderkey, md5(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey)) AS digest FROM lineitem GROUP BY 1) GROUP BY 1""")
def x05_plan_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",")
    plans_ = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.md5(listed).alias("digest"))
    return plans_.groupBy("digest").agg(F.count("*").alias("n"))


@plans("""SELECT event_id, CASE upper(trim(event_type)) WHEN 'VIEW' THEN 'GK' WHEN 'CLICK' THEN 'DEF' WHEN 'PURCHASE' THEN 'FWD' ELSE 'MID' END AS position, CASE WHEN regexp_matches(event_type, '(sign|purch)') THEN '***' ELSE event_type END AS shown FROM events""")
def p12_normalise_and_redact(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in (("VIEW", "GK"), ("CLICK", "DEF"), ("PURCHASE", "FWD")) for x in pair))
    return table(spark, sf, "events").select("event_id", F.coalesce(names[F.upper(F.trim("event_type"))], F.lit("MID")).alias("position"), F.when(F.col("event_type").rlike("sign|purch"), "***").otherwise(F.col("event_type")).alias("shown"))


@plans("""SELECT event_id, (value::INTEGER // 60) * 60 + (value::INTEGER % 60) AS seconds FROM (SELECT event_id, floor(value) AS value FROM events)""")
def f06_duration(spark: SparkSession, sf: str) -> DataFrame:
    """Durations written as PT#M#S and parsed back."""
    whole = F.floor("value")
    written = F.concat(F.lit("PT"), F.floor(whole / 60).cast("string"), F.lit("M"), (whole % 60).cast("string"), F.lit("S"))
    return table(spark, sf, "events").select("event_id", written.alias("d")).select("event_id", T.parse_duration(F.col("d")).alias("seconds"))


@plans("""SELECT event_id, CAST(date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS DOUBLE) / 365.25 AS years, year(ts) - CASE WHEN month(ts) < 7 THEN 1 ELSE 0 END AS season FROM events""")
def f03_age_and_season(spark: SparkSession, sf: str) -> DataFrame:
    season = F.year("ts") - F.when(F.month("ts") < 7, 1).otherwise(0)
    return table(spark, sf, "events").select("event_id", (F.datediff("ts", F.lit("2000-01-01").cast("date")) / 365.25).alias("years"), season.alias("season"))


@plans("""SELECT user_id, event_type, max(value) AS confidence, arg_min(event_id, (ts, event_id)) AS first_id FROM events GROUP BY 1, 2""")
def d05_keep_max(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("confidence"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"))


@plans("""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 'new' ELSE 'old' END AS snapshot FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0""")
def d08_snapshot_replace(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of the replaced partition go, whether or not the new snapshot has them."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    fresh = orders.filter("o_orderstatus = 'P' and o_orderkey % 2 = 0").withColumn("snapshot", F.lit("new"))
    parts = fresh.select("o_orderstatus").distinct()
    return orders.withColumn("snapshot", F.lit("old")).join(F.broadcast(parts), "o_orderstatus", "left_anti").select("o_orderkey", "o_orderstatus", "snapshot").unionByName(fresh)


@plans("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT user_id, avg(n) AS m, stddev_pop(n) AS sd, arg_max(n, day) AS n FROM d GROUP BY 1)
SELECT user_id, round(CASE WHEN sd > 0 THEN (n - m) / sd ELSE n END, 6) AS z FROM s""")
def k43_volume_zscore(spark: SparkSession, sf: str) -> DataFrame:
    """The newest day's volume against the user's own days; the raw volume where days don't vary."""
    days = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    users = days.groupBy("user_id").agg(F.avg("n").alias("m"), F.stddev_pop("n").alias("sd"), F.max_by("n", "day").alias("n"))
    return users.select("user_id", F.round(F.when(F.col("sd") > 0, (F.col("n") - F.col("m")) / F.col("sd")).otherwise(F.col("n")), 6).alias("z"))


@plans("""WITH s AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, round(arg_min(value, n) FILTER (event_type = 'view'), 6) AS owned, coalesce(arg_min(value, n) FILTER (event_type = 'view') > 40, false) AS is_template FROM s WHERE n <= 6 GROUP BY 1""")
def k36_latest_per_scope(spark: SparkSession, sf: str) -> DataFrame:
    """The newest value of one scope among the newest six rows of any."""
    newest = top_per_group(table(spark, sf, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 6)
    owned = F.min_by("value", F.when(F.col("event_type") == "view", F.col("rn")))
    return newest.groupBy("user_id").agg(owned.alias("v")).select("user_id", F.round("v", 6).alias("owned"), F.coalesce(F.col("v") > 40, F.lit(False)).alias("is_template"))


@plans("""SELECT user_id, round(count(*) / (count(*) + 40.0) * avg(value) + 40.0 / (count(*) + 40.0) * 50, 6) AS blended FROM events GROUP BY 1""")
def m19_blend_with_prior(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("*")
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(n / (n + 40.0) * F.avg("value") + 40.0 / (n + 40.0) * 50, 6).alias("blended"))


@plans(RATES + """, g2 AS (SELECT m.match_id, m.home, least(9, CAST(g.q AS INTEGER) % 5) AS hg, least(9, CAST(g.q AS INTEGER) % 3) AS ag FROM m JOIN g ON g.l_orderkey = m.match_id)
SELECT round(avg(h.rate - hg * ln(h.rate) + ln(factorial(hg)) + h.rate * 0.8 - ag * ln(h.rate * 0.8) + ln(factorial(ag))), 6) AS nll FROM g2 JOIN h ON h.nation = g2.home""")
def m20_scoreline_nll(spark: SparkSession, sf: str) -> DataFrame:
    """Mean negative log-likelihood of scorelines under independent Poisson rates."""
    from .relational import matches

    totals = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("int").alias("q"))
    games = matches(spark, sf).join(totals, F.col("match_id") == F.col("l_orderkey")).select(F.col("home").alias("nation"), (F.col("q") % 5).alias("hg"), (F.col("q") % 3).alias("ag"))
    both = games.join(nation_rates(spark, sf), "nation")
    p = M.poisson(F.col("hg"), F.col("rate")) * M.poisson(F.col("ag"), F.col("rate") * 0.8)
    return both.agg(F.round(F.avg(-F.ln(p)), 6).alias("nll"))


@plans("""SELECT event_type, max(ts) AS last_seen, CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 3600e6) AS BIGINT) AS hours_old, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts)) > 36 * 3600e6 AS is_stale FROM events GROUP BY 1""")
def o12_staleness(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.windows import days_between

    hours = days_between(F.expr("timestamp_ntz'2024-02-01'"), F.max("ts")) * 24
    return table(spark, sf, "events").groupBy("event_type").agg(F.max("ts").alias("last_seen"), F.floor(hours).alias("hours_old"), (hours > 36).alias("is_stale"))


@plans("""WITH b AS (SELECT *, avg(l_extendedprice / l_quantity) OVER (PARTITION BY l_returnflag, CAST(floor(l_discount * 100) AS BIGINT)) AS base FROM lineitem)
SELECT l_suppkey, count(*) AS calls, round(avg(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END * (l_extendedprice / l_quantity - base)), 4) AS score FROM b GROUP BY 1 HAVING count(*) >= 3""")
def o16_scoreboard(spark: SparkSession, sf: str) -> DataFrame:
    """Calls up or down by supplier, scored against the mean of the same bucket."""
    unit = F.expr("l_extendedprice / l_quantity")
    base = F.avg(unit).over(Window.partitionBy("l_returnflag", F.floor(F.col("l_discount") * 100)))
    calls = table(spark, sf, "lineitem").select("l_suppkey", (F.when(F.col("l_linestatus") == "O", 1).otherwise(-1) * (unit - base)).alias("s"))
    return calls.groupBy("l_suppkey").agg(F.count("*").alias("calls"), F.round(F.avg("s"), 4).alias("score")).filter("calls >= 3")


@plans("""SELECT c.c_custkey, CASE WHEN l.quality IS NOT NULL THEN 'both' ELSE 'left' END AS side FROM customer c LEFT JOIN labels l ON l.doc_id = c.c_custkey""")
def x04_two_state_diff(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("c_custkey"), "quality")
    return table(spark, sf, "customer").select("c_custkey").join(labels, "c_custkey", "left").select("c_custkey", F.when(F.col("quality").isNotNull(), "both").otherwise("left").alias("side"))


@plans("""SELECT CAST(l_orderkey AS VARCHAR) AS id, 'book' AS bookmaker, 'h2h' AS market, CAST(l_linenumber AS VARCHAR) AS name, round(1 + l_quantity / 10, 6) AS price, round(1 / (1 + l_quantity / 10), 9) AS implied, round(1 / (1 + l_quantity / 10) / sum(1 / (1 + l_quantity / 10)) OVER (PARTITION BY l_orderkey), 9) AS fair FROM lineitem""")
def s15_odds_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as a nested JSON feed of outcomes, parsed back to implied and margin-free probabilities."""
    from ..sources.readers import odds_rows

    outcome = F.struct(F.col("l_linenumber").cast("string").alias("name"), (1 + F.col("l_quantity") / 10).alias("price"))
    games = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(outcome)).alias("outcomes"))
    market = F.array(F.struct(F.lit("h2h").alias("key"), F.col("outcomes").alias("outcomes")))
    book = F.array(F.struct(F.lit("book").alias("key"), market.alias("markets")))
    feed = games.select(F.to_json(F.array(F.struct(F.col("l_orderkey").cast("string").alias("id"), book.alias("bookmakers")))).alias("payload"))
    rows = odds_rows(feed, "payload")
    return rows.select("id", "bookmaker", "market", "name", *(F.round(c, d).alias(c) for c, d in (("price", 6), ("implied", 9), ("fair", 9))))


@plans("""SELECT p_partkey, p_retailprice AS price, CASE WHEN p_partkey % 4 = 0 THEN coalesce(NULLIF(p_size, 10), -1) ELSE p_size END AS size FROM part""")
def d04_merge_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Prices fill only gaps; sizes are overwritten where the update has one."""
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    changes = parts.filter("p_partkey % 4 = 0").select("p_partkey", F.lit(0.0).alias("price"), F.when(F.col("size") == 10, -1).alias("size"))
    return J.update_join(parts, changes, ["p_partkey"], ["price"], ["size"])


@plans()
def o05_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Moves over three periods in markets of a hundred parts each, all of which are candidates; three of each position are owned.
    The markets are as many as the parts ask for, and each is planned in a task of its own."""
    from ..operators.planner import plan_squads
    from .scoring import POSITION

    parts = table(spark, sf, "part").selectExpr("p_partkey div 100 AS pool", "p_partkey AS player_id", POSITION.format(x="p_partkey") + " AS position", "p_partkey % 25 AS team_id", "CAST(40 + p_partkey % 60 AS INT) AS price", "array(p_partkey % 11, p_partkey % 13, p_partkey % 7) AS points")
    first = F.row_number().over(Window.partitionBy("pool", "position").orderBy("player_id")) <= 3
    return plan_squads(parts.withColumn("owned", first), "pool", 3)
