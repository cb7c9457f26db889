"""Joins, aggregations, set operations and orderings on the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import asof as P
from ..operators import joins as J
from ..operators.vector_index import Search as VectorSearch
from ..operators.vector_index import build_index, nearest_by_tiles
from ..shared import shared_folder
from .base import Plans, table

plans = Plans()


@plans("""SELECT o.o_orderstatus AS status, count(*) AS n_lines, round(sum(l.l_extendedprice * (1 - l.l_discount)), 4) AS revenue
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY 1""")
def j01_fact_dim_join(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n_lines"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 4).alias("revenue"))


@plans("""SELECT r.r_name AS region, n.n_name AS nation, count(*) AS n_lines, round(sum(l.l_extendedprice), 2) AS gross
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1, 2""")
def j02_star_join(spark: SparkSession, sf: str) -> DataFrame:
    # lines are added up to orders, and orders to customers, before the small tables join
    orders = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("g"))
    facts = orders.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    facts = facts.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    facts = facts.groupBy("c_nationkey").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    names = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return facts.join(names, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.sum("n").alias("n_lines"), F.round(F.sum("g"), 2).alias("gross"))


@plans("""SELECT d.doc_id, d.source, l.quality, l.toxic, s.n_docs FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
LEFT JOIN (SELECT source, count(*) AS n_docs FROM documents GROUP BY source) s ON s.source = d.source""")
def j03_left_chain(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    per = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    return docs.join(table(spark, sf, "labels"), "doc_id", "left").join(per, "source", "left").select("doc_id", "source", "quality", "toxic", "n_docs")


@plans("""SELECT e.event_id, c.c_mktsegment AS segment FROM (SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), user_id) AS k FROM events) e
LEFT JOIN customer c ON c.c_custkey = e.k""")
def j04_coalesce_key_join(spark: SparkSession, sf: str) -> DataFrame:
    key = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.col("user_id"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    return table(spark, sf, "events").select("event_id", key.alias("k")).join(customers, "k", "left").select("event_id", "segment")


SIDES = """WITH m AS (SELECT DISTINCT o.o_orderkey AS match_id, c.c_nationkey AS home, s.s_nationkey AS away
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE l.l_linenumber = 1)"""


def matches(spark: SparkSession, sf: str) -> DataFrame:
    """An order as a match: the customer's nation at home, the first line's supplier's nation away."""
    first = table(spark, sf, "lineitem").filter("l_linenumber = 1").join(F.broadcast(table(spark, sf, "supplier")), F.col("l_suppkey") == F.col("s_suppkey"))
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.join(first, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("match_id"), F.col("c_nationkey").alias("home"), F.col("s_nationkey").alias("away")).distinct()


@plans(SIDES + """ SELECT m.match_id, t.n_name AS team, o.n_name AS opponent, x.is_home FROM m,
(SELECT true AS is_home UNION ALL SELECT false) x JOIN nation t ON t.n_nationkey = CASE WHEN x.is_home THEN m.home ELSE m.away END
JOIN nation o ON o.n_nationkey = CASE WHEN x.is_home THEN m.away ELSE m.home END""")
def j05_role_playing_nations(spark: SparkSession, sf: str) -> DataFrame:
    nations = F.broadcast(table(spark, sf, "nation").select("n_nationkey", "n_name"))
    h, a = (nations.withColumnsRenamed({"n_nationkey": k, "n_name": f"{k}_name"}) for k in ("home", "away"))
    both = J.two_sides(matches(spark, sf).join(h, "home").join(a, "away").select("match_id", "home_name", "away_name"), {"team": F.col("home_name"), "opponent": F.col("away_name")}, {"team": F.col("away_name"), "opponent": F.col("home_name")})
    return both.select("match_id", "team", "opponent", "is_home")


@plans("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderdate = m""")
def j07_latest_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return P.latest_per_group(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate")


@plans("""SELECT l_partkey, l_orderkey, l_linenumber, l_shipdate FROM (SELECT *, max(l_shipdate) OVER (PARTITION BY l_partkey) AS m FROM lineitem
WHERE l_shipdate < TIMESTAMP '1998-01-01') WHERE l_shipdate = m""")
def j08_latest_before_bound(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return P.latest_before(lines, ["l_partkey"], "l_shipdate", F.expr("timestamp_ntz'1998-01-01'"))


@plans("""SELECT c.c_custkey, arg_max(o.o_totalprice, (o.o_orderdate, o.o_orderkey)) AS last_total, count(o.o_orderkey) AS n_orders
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1""")
def j09_latest_scalar(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("last_total"), F.count("*").alias("n"))
    return table(spark, sf, "customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "last_total", F.coalesce("n", F.lit(0)).alias("n_orders"))


@plans("""SELECT s.event_id, s.user_id, (SELECT v.value FROM events v WHERE v.user_id = s.user_id AND v.event_type = 'view' AND v.ts < s.ts
ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS asof_value FROM events s WHERE s.event_type = 'signup'""")
def j11_asof_strict(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    views = events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"), "value")
    probes = events.filter("event_type = 'signup'").select("event_id", "user_id", "ts")
    return P.asof_join(probes, views, "user_id", "ts", "seen", ["view_id", "value"]).select("event_id", "user_id", "asof_value")


@plans("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j12_semi(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(urgent, "c_custkey", "left_semi")


@plans("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def j13_anti(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@plans("""SELECT p.event_id AS purchase_id, v.event_id AS view_id FROM events p JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view'
AND v.ts >= date_trunc('day', p.ts) AND v.ts < date_trunc('day', p.ts) + INTERVAL 1 DAY WHERE p.event_type = 'purchase'""")
def j14_day_range_join(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    left = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), "ts")
    right = events.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("seen"))
    return P.range_join(left, right, "user_id", "ts", "seen").select("purchase_id", "view_id")


@plans("""SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON CAST(a.ts AS DATE) = CAST(b.ts AS DATE) AND a.user_id = b.user_id
WHERE a.event_type = 'click' AND b.event_type = 'signup'""")
def j15_date_equality_join(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    a = days.filter("event_type = 'click'").select("day", "user_id", F.col("event_id").alias("first_id"))
    b = days.filter("event_type = 'signup'").select("day", "user_id", F.col("event_id").alias("second_id"))
    return a.join(b, ["day", "user_id"]).select("first_id", "second_id")


@plans("""SELECT p_partkey, p_type, round(cume_dist() OVER (PARTITION BY p_type ORDER BY p_retailprice), 9) AS pct FROM part""")
def j16_percentile_in_group(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.windows import percentile_in_group

    return table(spark, sf, "part").select("p_partkey", "p_type", F.round(percentile_in_group("p_retailprice", ["p_type"]), 9).alias("pct"))


@plans("""SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def j19_containment(spark: SparkSession, sf: str) -> DataFrame:
    return J.contained(table(spark, sf, "benchmark"), table(spark, sf, "documents"), "item_id", "text", "doc_id", "text")


@plans("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS c FROM q JOIN v ON v.vec_id <> q.vec_id)
SELECT query_id, vec_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS rn FROM s) WHERE rn <= 5""")
def j20_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    # the queries are a stated set of one id in a hundred; all rows are compared with them
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    found = nearest_by_tiles(vectors, vectors.filter("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    return found.select(F.col("q").alias("query_id"), F.col("key").alias("vec_id"), "rn")


@plans("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS c FROM q JOIN v ON v.vec_id <> q.vec_id)
SELECT query_id, vec_id, round(c, 9) AS cosine, rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS rn FROM s) WHERE rn <= 10""")
def t07_vector_index(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of one vector in a hundred, from an index of all."""
    vectors, folder = table(spark, sf, "embeddings"), shared_folder(spark, "vectors")
    build_index(vectors, folder, "vec_id", "embedding")
    asked = VectorSearch(spark, folder, vectors.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10, not_itself=True)
    return asked.run().select(F.col("q").alias("query_id"), F.col("key").alias("vec_id"), "cosine", "rn")


@plans("""SELECT l.l_orderkey, l.l_linenumber, o.o_totalprice AS total, l.l_quantity, l.l_discount FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey AND o.o_orderstatus = l.l_linestatus
AND date_trunc('month', o.o_orderdate) = date_trunc('month', l.l_shipdate)""")
def j21_multi_key_merge(spark: SparkSession, sf: str) -> DataFrame:
    month = lambda c: F.date_trunc("month", F.col(c).cast("timestamp"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("s"), month("l_shipdate").alias("m"), "l_linenumber", "l_quantity", "l_discount")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), month("o_orderdate").alias("m"), F.col("o_totalprice").alias("total"))
    return lines.join(orders, ["k", "s", "m"]).select(F.col("k").alias("l_orderkey"), "l_linenumber", "total", "l_quantity", "l_discount")


@plans("""WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders WHERE o_orderstatus = 'O'),
b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders WHERE o_orderstatus = 'F')
SELECT a.o_custkey, a.i AS place, a.o_orderkey AS open_key, b.o_orderkey AS closed_key FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.i = b.i""")
def j23_positional_zip(spark: SparkSession, sf: str) -> DataFrame:
    listed = lambda status: F.transform(F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == status, F.struct("o_orderdate", "o_orderkey")))), lambda x: x["o_orderkey"])
    lists = table(spark, sf, "orders").groupBy("o_custkey").agg(listed("O").alias("open_key"), listed("F").alias("closed_key"))
    zipped = lists.select("o_custkey", F.posexplode(F.arrays_zip("open_key", "closed_key")).alias("i", "z")).filter("z.open_key is not null and z.closed_key is not null")
    return zipped.select("o_custkey", (F.col("i") + 1).cast("long").alias("place"), "z.open_key", "z.closed_key")


@plans("""SELECT d.doc_id, coalesce(l.quality, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END) AS quality, coalesce(CASE WHEN d.n_chars % 2 = 0 THEN 1 END, l.toxic) AS toxic
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""")
def j24_update_join_fill_gaps(spark: SparkSession, sf: str) -> DataFrame:
    source = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("quality"), F.when(F.col("n_chars") % 2 == 0, 1).alias("toxic"))
    return J.update_join(table(spark, sf, "labels"), source, ["doc_id"], fill=["quality"], overwrite=["toxic"])


@plans("""SELECT coalesce(m.canon, e.user_id) AS user_id, count(*) AS n FROM events e LEFT JOIN (SELECT DISTINCT user_id AS old, user_id - 1 AS canon FROM events WHERE user_id % 2 = 1) m
ON m.old = e.user_id GROUP BY 1""")
def j25_id_remap(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id")
    mapping = events.filter("user_id % 2 = 1").distinct().select(F.col("user_id").alias("old"), (F.col("user_id") - 1).alias("canon"))
    return J.remap_ids(events, mapping, "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


@plans("""SELECT o_custkey, round(sum(coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END, 0)), 2) AS total FROM orders GROUP BY 1""")
def a01_sum_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum(F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")), F.lit(0.0))), 2).alias("total"))


@plans("""SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 9) AS high_rate, count(*) FILTER (WHERE value < 10) AS n_low, round(avg(value), 6) AS mean_value
FROM events GROUP BY 1""")
def a03_conditional_rates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(A.rate(F.col("value") > 50), 9).alias("high_rate"), F.count_if(F.col("value") < 10).alias("n_low"), F.round(F.avg("value"), 6).alias("mean_value"))


@plans("""SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 4) AS mean_total, round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1, 2 HAVING count(*) >= 3""")
def a04_having_scoreboard(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_total"), F.round(F.max("o_totalprice"), 2).alias("top")).filter("n >= 3")


@plans("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, count(DISTINCT event_type) <= 1 AS is_constant, min(ts) AS first_ts FROM events GROUP BY 1""")
def a05_distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), (F.count_distinct("event_type") <= 1).alias("is_constant"), F.min("ts").alias("first_ts"))


@plans("""SELECT l_partkey, round(avg(p), 6) AS mean_price FROM (SELECT l_partkey, l_suppkey, l_extendedprice / l_quantity AS p, l_shipdate,
max(l_shipdate) OVER (PARTITION BY l_partkey, l_suppkey) AS m FROM lineitem) WHERE l_shipdate = m GROUP BY 1""")
def a07_mean_of_latest(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", F.expr("l_extendedprice / l_quantity").alias("p"))
    return P.latest_per_group(lines, ["l_partkey", "l_suppkey"], "l_shipdate").groupBy("l_partkey").agg(F.round(F.avg("p"), 6).alias("mean_price"))


@plans("""SELECT user_id, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 9) AS drift FROM events
WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1""")
def a08_first_last_drift(spark: SparkSession, sf: str) -> DataFrame:
    window = table(spark, sf, "events").filter("ts >= timestamp_ntz'2024-01-10' and ts < timestamp_ntz'2024-01-12'")
    return window.groupBy("user_id").agg(F.round(A.drift("value", ["ts", "event_id"]), 9).alias("drift"))


WEIGHT = "CASE event_type WHEN 'purchase' THEN 2.0 WHEN 'signup' THEN 1.5 WHEN 'click' THEN 1.0 ELSE 0.5 END"


@plans(f"SELECT user_id, round(sum(value * {WEIGHT}) / sum({WEIGHT}), 6) AS weighted, round(coalesce(stddev_pop(value), 0), 6) AS spread FROM events GROUP BY 1")
def a09_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    weight = F.expr(WEIGHT).cast("double")
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(A.weighted_mean(F.col("value"), weight), 6).alias("weighted"), F.round(F.stddev_pop("value"), 6).alias("spread"))


@plans("""SELECT user_id, round(max(n) / sum(n), 9) AS mode_share, count(*) AS n_kinds FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 2""")
def a11_mode_share(spark: SparkSession, sf: str) -> DataFrame:
    return A.mode_share(table(spark, sf, "events"), ["user_id"], "event_type").withColumn("mode_share", F.round("mode_share", 9))


@plans("""WITH w AS (SELECT unnest(['view', 'click', 'purchase', 'refund']) AS event_type) SELECT w.event_type, coalesce(s.n, 0) AS n, coalesce(s.d, 0) AS n_distinct,
CASE WHEN s.n IS NULL THEN 'never_written' WHEN s.d <= 1 THEN 'constant' ELSE 'ok' END AS status FROM w LEFT JOIN (SELECT event_type, count(value) AS n, count(DISTINCT value) AS d FROM events GROUP BY 1) s ON s.event_type = w.event_type""")
def a12_coverage_audit(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.createDataFrame([(x,) for x in ("view", "click", "purchase", "refund")], "event_type string")
    return A.coverage(table(spark, sf, "events"), wanted, "event_type", "value")


@plans("""SELECT user_id, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'view') AS view, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'click') AS click,
arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1""")
def a13_pivot_last(spark: SparkSession, sf: str) -> DataFrame:
    return A.pivot_last(table(spark, sf, "events"), ["user_id"], "event_type", "value", ["ts", "event_id"], ["view", "click", "purchase"])


@plans("""WITH b AS (SELECT *, CAST(floor(p_retailprice / 10) AS BIGINT) AS band FROM part) SELECT p_partkey, round(p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_type, band), 6) AS over FROM b""")
def a14_bucket_baseline(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").withColumn("band", F.floor(F.col("p_retailprice") / 10))
    return parts.select("p_partkey", F.round(F.col("p_retailprice") - F.avg("p_retailprice").over(Window.partitionBy("p_type", "band")), 6).alias("over"))


@plans("""SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total, round(sqrt(sum(l_tax * l_tax)), 9) AS sd, max(l_quantity) AS top FROM lineitem GROUP BY 1""")
def a15_double_leg(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.sqrt(F.sum(F.col("l_tax") * F.col("l_tax"))), 9).alias("sd"), F.max("l_quantity").alias("top"))


@plans("""WITH f AS (SELECT c.c_nationkey AS nation, strftime(o.o_orderdate, '%Y-%m') AS month FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)
SELECT n.n_nationkey AS nation, m.month, count(f.nation) AS n FROM nation n CROSS JOIN (SELECT DISTINCT month FROM f) m LEFT JOIN f ON f.nation = n.n_nationkey AND f.month = m.month GROUP BY 1, 2""")
def a16_zero_filled_counts(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return A.zero_filled_counts(facts, table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation")), "nation", "month", facts)


@plans("""SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90,
round(avg(CASE WHEN value >= 100 THEN 1.0 ELSE 0.0 END), 9) AS p_high, round(avg(CASE WHEN value <= 20 THEN 1.0 ELSE 0.0 END), 9) AS p_low FROM events GROUP BY 1""")
def a18_distribution_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "events").groupBy("event_type").agg(*A.distribution("value"), F.round(A.rate(F.col("value") >= 100), 9).alias("p_high"), F.round(A.rate(F.col("value") <= 20), 9).alias("p_low"))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "p10", "p50", "p90")})


LAGGED = "SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS forecast FROM events"


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with the user's previous value as a forecast."""
    lag = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").withColumn("forecast", lag).filter("forecast is not null")


@plans(f"SELECT event_type, count(*) AS n, round(avg(abs(forecast - value)), 6) AS mae, round(sqrt(avg((forecast - value) * (forecast - value))), 6) AS rmse, round(avg(forecast - value), 6) AS bias FROM ({LAGGED}) WHERE forecast IS NOT NULL GROUP BY 1")
def a19_error_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = forecasts(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), *A.error_metrics(F.col("forecast"), F.col("value")))
    return out.withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "bias")})


@plans(f"""WITH f AS (SELECT * FROM ({LAGGED}) WHERE forecast IS NOT NULL), r AS (SELECT event_type,
rank() OVER (PARTITION BY event_type ORDER BY forecast) + (count(*) OVER (PARTITION BY event_type, forecast) - 1) / 2.0 AS a,
rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS b FROM f)
SELECT event_type, count(*) AS n, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""")
def a20_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return A.spearman(forecasts(spark, sf), ["event_type"], "forecast", "value").withColumn("spearman", F.round("spearman", 6))


SCORED = "SELECT l.quality AS hit, least(1.0, d.n_chars / 4000.0) AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("p"))
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("hit")).join(docs, "doc_id")


@plans(f"SELECT least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(hit), 6) AS observed, round(abs(avg(p) - avg(hit)), 6) AS gap FROM ({SCORED}) GROUP BY 1")
def a21_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return A.calibration(scored(spark, sf), "p", "hit").withColumns({c: F.round(c, 6) for c in ("predicted", "observed", "gap")})


@plans(f"SELECT round(sum(n * g) / sum(n), 6) AS ece FROM (SELECT count(*) AS n, abs(avg(p) - avg(hit)) AS g FROM ({SCORED}) GROUP BY least(CAST(floor(p * 10) AS BIGINT), 9))")
def a21_expected_calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    return A.expected_calibration_error(scored(spark, sf), "p", "hit").withColumn("ece", F.round("ece", 6))


@plans(f"SELECT round(avg(-CASE WHEN hit = 1 THEN ln(greatest(least(p, 1 - 1e-9), 1e-9)) ELSE ln(1 - greatest(least(p, 1 - 1e-9), 1e-9)) END), 6) AS log_loss FROM ({SCORED})")
def a22_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).agg(F.round(A.log_loss(F.col("p"), F.col("hit")), 6).alias("log_loss"))


@plans("""WITH v AS (SELECT l_partkey, arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS forecast FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1),
a AS (SELECT l_partkey, avg(l_extendedprice / l_quantity) AS actual FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1),
j AS (SELECT v.l_partkey, forecast, actual FROM v JOIN a ON a.l_partkey = v.l_partkey)
SELECT count(*) AS n, round(avg(abs(forecast - actual)), 6) AS mae, round(sqrt(avg((forecast - actual) * (forecast - actual))), 6) AS rmse, round(avg(forecast - actual), 6) AS bias,
round((SELECT avg(actual) FROM (SELECT actual FROM j ORDER BY forecast DESC, l_partkey LIMIT 15)), 6) AS top15,
avg(abs(forecast - actual)) < avg(abs(actual - (SELECT avg(actual) FROM j))) AS beats_baseline FROM j""")
def a23_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    unit = table(spark, sf, "lineitem").withColumn("unit", F.expr("l_extendedprice / l_quantity"))
    cut = F.expr("timestamp_ntz'1997-01-01'")
    both = unit.groupBy("l_partkey").agg(F.max_by("unit", F.when(F.col("l_shipdate") < cut, F.struct("l_shipdate", "l_orderkey", "l_linenumber"))).alias("forecast"), F.avg(F.when(F.col("l_shipdate") >= cut, F.col("unit"))).alias("actual"))
    both = both.filter("forecast is not null and actual is not null")
    mean = both.agg(F.avg("actual").alias("mean"))
    top = both.orderBy(F.col("forecast").desc(), "l_partkey").limit(15).agg(F.round(F.avg("actual"), 6).alias("top15"))
    scores = both.join(F.broadcast(mean)).agg(F.count("*").alias("n"), *A.error_metrics(F.col("forecast"), F.col("actual")), F.avg(F.abs(F.col("actual") - F.col("mean"))).alias("base"))
    return scores.join(F.broadcast(top)).select("n", *(F.round(c, 6).alias(c) for c in ("mae", "rmse", "bias")), "top15", (F.col("mae") < F.col("base")).alias("beats_baseline"))


@plans("""WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT l_partkey, count(*) AS n_groups, count(*) = (SELECT count(DISTINCT l_suppkey) FROM p) AS shared, count(*) = 1 AS "unique" FROM p GROUP BY 1""")
def a25_shared_unique(spark: SparkSession, sf: str) -> DataFrame:
    return A.shared_by_all(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@plans("""SELECT user_id, round(greatest(0.3, least(2.0, 1 + (avg(value) - 50) / 10 / 10 * least(1.0, count(*) / 30.0))), 9) AS trust FROM events GROUP BY 1""")
def a27_bounded_trust(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(A.bounded_trust((F.avg("value") - 50) / 10, F.count("*")), 9).alias("trust"))


@plans("""SELECT l_orderkey, count(*) AS shots, count(*) FILTER (WHERE l_returnflag = 'R') AS on_target, count(*) FILTER (WHERE l_quantity >= 30) AS big, count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'N') AS penalties FROM lineitem GROUP BY 1""")
def a28_grouped_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("shots"), F.count_if(F.col("l_returnflag") == "R").alias("on_target"), F.count_if(F.col("l_quantity") >= 30).alias("big"), F.count_if((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")).alias("penalties"))


@plans("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 10""")
def l02_paging(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").offset(10).limit(20)


@plans("""WITH u AS (SELECT p_partkey, p_type, p_retailprice, p_size * 1.0 AS utility FROM part) SELECT p_partkey FROM (SELECT p_partkey FROM u ORDER BY utility DESC, p_partkey LIMIT 100)
UNION SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS rn FROM u) WHERE rn <= 5 UNION SELECT p_partkey FROM u WHERE p_partkey IN (1, 2, 3)""")
def l04_prefilter_union(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    best = parts.orderBy(F.col("p_size").desc(), "p_partkey").limit(100)
    cheap = P.top_per_group(parts, ["p_type"], [F.col("p_retailprice"), F.col("p_partkey")], 5)
    return best.select("p_partkey").unionByName(cheap.select("p_partkey")).unionByName(parts.filter("p_partkey in (1, 2, 3)").select("p_partkey")).distinct()


@plans("""SELECT kind, id, seen FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS seen FROM orders UNION ALL SELECT 'line', l_orderkey * 10 + l_linenumber, l_shipdate FROM lineitem
UNION ALL SELECT 'event', event_id, ts FROM events) ORDER BY seen DESC, kind, id LIMIT 50""")
def l06_feed_merge(spark: SparkSession, sf: str) -> DataFrame:
    feed = lambda df, kind, key, at: df.select(F.lit(kind).alias("kind"), key.alias("id"), F.col(at).alias("seen"))
    parts = [feed(table(spark, sf, "orders"), "order", F.col("o_orderkey"), "o_orderdate"), feed(table(spark, sf, "lineitem"), "line", F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_shipdate"), feed(table(spark, sf, "events"), "event", F.col("event_id"), "ts")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy(F.col("seen").desc(), "kind", "id").limit(50)


@plans("""SELECT o_custkey AS id, 'only_urgent' AS side FROM (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')
UNION ALL SELECT o_custkey, 'both' FROM (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')""")
def x02_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    # one pass: which of the two priorities each customer has
    has = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.bool_or(F.col("o_orderpriority") == "5-LOW").alias("low"))
    return has.filter("urgent").select("id", F.when(F.col("low"), "both").otherwise("only_urgent").alias("side"))


@plans("""SELECT n.n_name AS name, round(try_divide, 6) AS value FROM (SELECT c_nationkey, CASE WHEN sum(c_acctbal) = 0 THEN NULL ELSE count(*) / (sum(c_acctbal) / 1000) END AS try_divide FROM customer GROUP BY 1) v JOIN nation n ON n.n_nationkey = v.c_nationkey
WHERE lower(n.n_name) LIKE '%1%'""")
def p10_filtered_value(spark: SparkSession, sf: str) -> DataFrame:
    value = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.try_divide(F.count("*"), F.sum("c_acctbal") / 1000).alias("value"))
    names = table(spark, sf, "nation").filter(F.contains(F.lower("n_name"), F.lit("1")))
    return value.join(F.broadcast(names), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), F.round("value", 6).alias("value"))


@plans("""SELECT c_custkey, c_name, c_acctbal AS acctbal, 'new' AS origin FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_name, c_acctbal - 1, 'old' FROM customer WHERE c_custkey % 3 <> 0""")
def d01_upsert(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_acctbal").alias("acctbal"))
    target = customers.withColumns({"acctbal": F.col("acctbal") - 1, "origin": F.lit("old")})
    changes = customers.filter("c_custkey % 3 = 0").withColumns({"origin": F.lit("new"), "seq": F.lit(2)})
    stale = changes.withColumns({"origin": F.lit("stale"), "seq": F.lit(1)})
    return J.upsert(target, changes.unionByName(stale), ["c_custkey"], ["seq"])


@plans("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'kept' ELSE 'added' END AS origin FROM customer""")
def d02_insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey")
    return J.insert_or_ignore(customers.filter("c_custkey % 2 = 0").withColumn("origin", F.lit("kept")), customers.withColumn("origin", F.lit("added")), ["c_custkey"])


@plans("""SELECT event_type, user_id, count(*) AS occurrences, max(value) AS best FROM events GROUP BY 1, 2""")
def d06_counter_bump(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("occurrences"), F.max("value").alias("best"))


@plans("""SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS supersedes FROM events""")
def d07_supersede(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.lag("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).alias("supersedes"))
