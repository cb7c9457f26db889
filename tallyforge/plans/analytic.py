"""Windows, folds, point-in-time features and model splits on the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import features as K
from ..operators import asof as P
from ..operators import windows as W
from .base import Plans, table

plans = Plans()
HISTORY = K.History("user_id", "ts", "event_id", "event_type", "value")
ORDERED = "(PARTITION BY user_id ORDER BY ts, event_id"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


@plans(f"""SELECT event_id, round(sum(value) OVER {ORDERED} ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), 6) AS last1, round(sum(value) OVER {ORDERED} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS last3,
round(sum(value) OVER {ORDERED} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS last5, round(sum(value) OVER {ORDERED} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS last10 FROM events""")
def w01_rolling_sum(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", *(F.round(W.rolling_sum("value", ["user_id"], ["ts", "event_id"], n), 6).alias(f"last{n}") for n in (1, 3, 5, 10)))


EWMA = ", ".join(f"lag(value, {i + 1}) OVER w AS v{i}" for i in range(5))
NUM, DEN = (" + ".join(f"CASE WHEN v{i} IS NULL THEN 0 ELSE {x} * pow(0.5, {i} / 3.0) END" for i, x in enumerate(xs)) for xs in (["v0", "v1", "v2", "v3", "v4"], ["1"] * 5))


@plans(f"SELECT event_id, round(({NUM}) / nullif({DEN}, 0), 6) AS form FROM (SELECT event_id, {EWMA} FROM events WINDOW w AS {ORDERED}))")
def w02_ewma(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", F.round(W.ewma(W.last_values("value", ["user_id"], ["ts", "event_id"], 5), 3.0), 6).alias("form"))


@plans(f"""WITH o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, coalesce(min(n) FILTER (WHERE value < 20) - 1, count(*)) AS streak FROM o WHERE n <= 40 GROUP BY 1""")
def w03_streak(spark: SparkSession, sf: str) -> DataFrame:
    newest = P.top_per_group(events(spark, sf), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 40)
    flags = F.transform(F.array_sort(F.collect_list(F.struct("rn", (F.col("value") >= 20).alias("ok")))), lambda x: x["ok"])
    return newest.groupBy("user_id").agg(flags.alias("flags")).select("user_id", W.leading_streak(F.col("flags")).alias("streak"))


@plans("""WITH u AS (SELECT user_id, sum(value) AS s, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1), g AS (SELECT avg(value) AS prior FROM events WHERE event_type = 'purchase')
SELECT user_id, round((n * (s / n) + 5 * prior) / (n + 5), 6) AS rate FROM u, g""")
def w04_shrunk_rate(spark: SparkSession, sf: str) -> DataFrame:
    bought = events(spark, sf).filter("event_type = 'purchase'")
    prior = bought.agg(F.avg("value").alias("prior"))
    users = bought.groupBy("user_id").agg(F.avg("value").alias("v"), F.count("*").alias("n")).join(F.broadcast(prior))
    return users.select("user_id", F.round(W.shrink(F.col("v"), F.col("n"), F.col("prior"), 5), 6).alias("rate"))


@plans(f"""SELECT event_id, round(avg(CASE WHEN value >= 5 THEN CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END END) OVER {ORDERED} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 9) AS hit_rate,
round(avg(CASE WHEN value >= 5 THEN value - 50 END) OVER {ORDERED} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS margin FROM events""")
def w05_hit_rate_margin(spark: SparkSession, sf: str) -> DataFrame:
    return K.build_wide(events(spark, sf), HISTORY, ["hit_rate_last10", "margin_last10"]).select("event_id", F.round("hit_rate_last10", 9).alias("hit_rate"), F.round("margin_last10", 6).alias("margin"))


@plans("""SELECT e.event_id, """ + ", ".join(f"round(sum(value) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) RANGE BETWEEN {d * 86400} PRECEDING AND CURRENT ROW), 6) AS last_{d}d" for d in (7, 14, 21)) + " FROM events e")
def w06_time_range_sums(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.floor(W.epoch(F.col("ts"))).cast("long")
    return events(spark, sf).select("event_id", *(F.round(W.trailing_sum("value", ["user_id"], seconds, d), 6).alias(f"last_{d}d") for d in (7, 14, 21)))


@plans("SELECT event_id, " + ", ".join("round(" + " + ".join(f"coalesce(lead(value, {i}) OVER w, 0) * pow(0.84, {i})" for i in range(n)) + f", 6) AS next{n}" for n in (3, 5, 8)) + f" FROM events WINDOW w AS {ORDERED})")
def w07_forward_decay(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", *(F.round(W.forward_decay("value", ["user_id"], ["ts", "event_id"], n), 6).alias(f"next{n}") for n in (3, 5, 8)))


@plans("SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS avg_rank FROM events")
def w09_average_rank(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", W.average_rank("value", ["event_type"]).alias("avg_rank"))


@plans("SELECT l_orderkey, l_linenumber, greatest(0, 4 - rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC)) AS award FROM lineitem")
def w10_rank_award(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", W.rank_award("l_quantity", ["l_orderkey"]).cast("long").alias("award"))


@plans(f"""SELECT event_id, round(d, 6) AS days, CAST(floor(d) AS BIGINT) AS whole_days FROM (SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER {ORDERED}))) / 86400e6 AS d FROM events)""")
def w12_days_since(spark: SparkSession, sf: str) -> DataFrame:
    since = events(spark, sf).select("event_id", K.days_since_last(HISTORY).alias("d"))
    return since.select("event_id", F.round("d", 6).alias("days"), F.floor("d").alias("whole_days"))


@plans("""SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, arg_min(event_id, (ts, event_id)) AS first_id, count(*) AS seen FROM events GROUP BY 1""")
def w13_first_in_group(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy(F.get_json_object("props", "$.k").try_cast("long").alias("k")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"), F.count("*").alias("seen"))


@plans("""SELECT user_id, list(value ORDER BY ts, event_id) AS spark FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 6 GROUP BY 1""")
def w15_sparkline(spark: SparkSession, sf: str) -> DataFrame:
    newest = P.top_per_group(events(spark, sf), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 6)
    return newest.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("spark"))


@plans("""SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' THEN pow(0.5, greatest(0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400e6) / 3.0) * value ELSE 0 END), 6) AS buys,
round(sum(pow(0.5, greatest(0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400e6) / 3.0)), 6) AS mentions FROM events GROUP BY 1""")
def w16_decayed_sum(spark: SparkSession, sf: str) -> DataFrame:
    weight = W.decay(W.days_between(F.expr("timestamp_ntz'2024-02-01'"), F.col("ts")), 3.0)
    return events(spark, sf).groupBy("user_id").agg(F.round(F.sum(F.when(F.col("event_type") == "purchase", weight * F.col("value")).otherwise(0.0)), 6).alias("buys"), F.round(F.sum(weight), 6).alias("mentions"))


@plans("""WITH RECURSIVE m AS (SELECT user_id, w, count(*) FILTER (WHERE e = 'purchase') AS made FROM (SELECT user_id, date_trunc('week', ts) AS w, event_type AS e FROM events) GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w) AS i FROM m),
f(user_id, i, free) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM n UNION ALL SELECT f.user_id, n.i, least(5, greatest(0, f.free - n.made) + 1) FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
SELECT user_id, arg_max(free, i) AS free FROM f GROUP BY 1""")
def w18_state_fold(spark: SparkSession, sf: str) -> DataFrame:
    weeks = events(spark, sf).groupBy("user_id", F.date_trunc("week", F.col("ts").cast("timestamp")).alias("w")).agg(F.count_if(F.col("event_type") == "purchase").alias("made"))
    folded = weeks.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "made"))), lambda x: x["made"]).alias("made"))
    return folded.select("user_id", W.banked(F.col("made")).alias("free"))


@plans("""WITH k AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders), d AS (SELECT y, m, row_number() OVER (ORDER BY y DESC, m DESC) AS n FROM (SELECT DISTINCT y, m FROM k))
SELECT k.o_orderkey, d.n <= 5 AS is_holdout FROM k JOIN d ON d.y = k.y AND d.m = k.m""")
def w20_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    return W.holdout_keys(keyed, ["y", "m"]).select("o_orderkey", "is_holdout")


@plans(f"""WITH d AS (SELECT *, TIMESTAMP '2024-01-20' AS cut FROM events WHERE ts < TIMESTAMP '2024-01-20'), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM d),
f AS (SELECT user_id, sum(value * pow(0.5, (i - 1) / 3.0)) / sum(pow(0.5, (i - 1) / 3.0)) AS form, count(*) AS n FROM n WHERE i <= 5 GROUP BY 1),
p AS (SELECT user_id, arg_max(value, (ts, event_id)) AS price FROM d WHERE event_type = 'purchase' GROUP BY 1)
SELECT f.user_id, round(form, 6) AS form, n, price, round(cume_dist() OVER (ORDER BY round(form, 6)), 9) AS pct FROM f LEFT JOIN p ON p.user_id = f.user_id""")
def form_at_deadline(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: each user's recency-weighted form, last purchase and standing, as at a deadline."""
    cut = F.expr("timestamp_ntz'2024-01-20'")
    seen = events(spark, sf).filter(F.col("ts") < cut)
    newest = P.top_per_group(seen, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 5)
    weight = F.pow(F.lit(0.5), (F.col("rn") - 1) / 3.0)
    form = newest.groupBy("user_id").agg(F.round(F.sum(F.col("value") * weight) / F.sum(weight), 6).alias("form"), F.count("*").alias("n"))
    price = seen.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("price"))
    # ranks come from the distinct forms and their counts, so all users are never sorted in one task
    levels = form.groupBy("form").agg(F.count("*").alias("c"))
    ranked = levels.withColumn("pct", F.sum("c").over(Window.orderBy("form")) / F.sum("c").over(Window.partitionBy(F.lit(1))))
    return form.join(price, "user_id", "left").join(ranked.select("form", "pct"), "form").select("user_id", "form", "n", "price", F.round("pct", 9).alias("pct"))


@plans(f"""WITH f AS (SELECT user_id, event_id, ts, sum(value) OVER {ORDERED} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS value_last3, (epoch_us(ts) - epoch_us(lag(ts) OVER {ORDERED}))) / 86400e6 AS days_since_last,
CAST(count(*) OVER {ORDERED} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS n_before FROM events)
SELECT user_id, event_id, name, round(value, 6) AS value FROM (UNPIVOT f ON value_last3, days_since_last, n_before INTO NAME name VALUE value)""")
def k46_feature_store(spark: SparkSession, sf: str) -> DataFrame:
    tall = K.build_tall(events(spark, sf), HISTORY, ["value_last3", "days_since_last", "n_before"])
    return tall.select("user_id", "event_id", "name", F.round("value", 6).alias("value"))


@plans(f"""WITH f AS (SELECT event_id, CAST(ts AS DATE) AS day, round(sum(value) OVER {ORDERED} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS value FROM events)
SELECT event_id, value, round(cume_dist() OVER (PARTITION BY day ORDER BY value), 9) AS percentile FROM f WHERE value IS NOT NULL""")
def k47_explain(spark: SparkSession, sf: str) -> DataFrame:
    tall = K.build_tall(events(spark, sf), HISTORY, ["value_last5"]).withColumns({"day": F.to_date("ts"), "value": F.round("value", 6)})
    return K.explain(tall, ["day"]).select("event_id", "value", F.round("percentile", 9).alias("percentile"))


LAST = {n: f"OVER {ORDERED} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (1, 3, 5, 10, 40)}
SECONDS = "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"
FEATURE_SQL = {f"value_last{n}": f"sum(value) {LAST[n]}" for n in (1, 3, 5, 10)}
FEATURE_SQL |= {f"value_{d}d": f"sum(value) OVER (PARTITION BY user_id ORDER BY {SECONDS} RANGE BETWEEN {d * 86400} PRECEDING AND 1 PRECEDING)" for d in (7, 14, 21)}
FEATURE_SQL |= {
    "value_ewma5": f"({NUM}) / nullif({DEN}, 0)",
    "hit_rate_last10": f"avg(CASE WHEN value >= 5 THEN CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END END) {LAST[10]}",
    "margin_last10": f"avg(CASE WHEN value >= 5 THEN value - 50 END) {LAST[10]}",
    "high_streak": "least(40, n - 1 - coalesce(stop, 0))",
    "days_since_last": f"(epoch_us(ts) - epoch_us(lag(ts) OVER {ORDERED}))) / 86400e6",
    "days_since_first": f"(epoch_us(ts) - epoch_us(min(ts) {LAST[40]})) / 86400e6",
    "n_before": f"count(*) {LAST[40]}",
    "kinds_last10": f"coalesce(len(list_distinct(list(event_type) {LAST[10]})), 0)",
}


@plans(f"""WITH o AS (SELECT *, row_number() OVER {ORDERED}) AS n, {EWMA} FROM events WINDOW w AS {ORDERED})), b AS (SELECT *, max(CASE WHEN value < 20 THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop FROM o),
f AS (SELECT user_id, event_id, ts, {', '.join(f'CAST({e} AS DOUBLE) AS {name}' for name, e in FEATURE_SQL.items())} FROM b)
SELECT user_id, event_id, ts, name, round(value, 5) AS value FROM (UNPIVOT f ON {', '.join(FEATURE_SQL)} INTO NAME name VALUE value)""")
def k45_registry(spark: SparkSession, sf: str) -> DataFrame:
    """All registered features of each event, tall."""
    return K.build_tall(events(spark, sf), HISTORY).withColumn("value", F.round("value", 5))


@plans("""SELECT event_id, CASE WHEN isodow(ts) IN (2, 3, 4) THEN 4 WHEN isodow(ts) = 7 THEN 3 ELSE greatest(0, least(2, CAST(floor((hour(ts) - 11) / 3.0) AS INT))) END AS slot FROM events""")
def k24_time_slot(spark: SparkSession, sf: str) -> DataFrame:
    day = F.weekday("ts")  # Monday is 0
    slot = F.when(day.isin(1, 2, 3), 4).when(day == 6, 3).otherwise(F.greatest(F.lit(0), F.least(F.lit(2), F.floor((F.hour("ts") - 11) / 3).cast("int"))))
    return events(spark, sf).select("event_id", slot.alias("slot"))


@plans("""WITH t AS (SELECT user_id, date_trunc('week', ts) AS w, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, w AS week, n, n >= 2 AS is_double, lead(n, 1, 0) OVER (PARTITION BY user_id ORDER BY w) AS next_n FROM t""")
def k23_counts_per_period(spark: SparkSession, sf: str) -> DataFrame:
    weeks = events(spark, sf).groupBy("user_id", F.date_trunc("week", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("week")).agg(F.count("*").alias("n"))
    return weeks.select("user_id", "week", "n", (F.col("n") >= 2).alias("is_double"), F.lead("n", 1, 0).over(Window.partitionBy("user_id").orderBy("week")).alias("next_n"))


@plans("""WITH v AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2), w AS (SELECT *, CASE event_type WHEN 'purchase' THEN 2.0 WHEN 'signup' THEN 1.5 WHEN 'click' THEN 1.0 ELSE 0.5 END AS w FROM v)
SELECT user_id, round(sum(v * w) / sum(w), 6) AS consensus, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(v) END, 6) AS disagreement FROM w GROUP BY 1""")
def k31_consensus(spark: SparkSession, sf: str) -> DataFrame:
    latest = events(spark, sf).filter("ts < timestamp_ntz'2024-01-20'").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    weight = F.expr("CASE event_type WHEN 'purchase' THEN 2.0D WHEN 'signup' THEN 1.5D WHEN 'click' THEN 1.0D ELSE 0.5D END")
    return latest.groupBy("user_id").agg(F.round(F.sum(F.col("v") * weight) / F.sum(weight), 6).alias("consensus"), F.round(F.when(F.count("*") < 2, 0.0).otherwise(F.stddev_pop("v")), 6).alias("disagreement"))
