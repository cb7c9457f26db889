"""Filters, projections and scalar functions on the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import models as M
from ..operators import windows as W
from .base import Plans, table
from .scoring import POSITION

plans = Plans()

K = "CAST(json_extract_string(props, '$.k') AS INT)"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))


def where_given(df: DataFrame, **wanted) -> DataFrame:
    """``df`` with an equality filter for each column whose wanted value isn't None."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


@plans("""WITH u AS (SELECT l_suppkey, sum(l_quantity) AS minutes FROM lineitem GROUP BY 1)
SELECT 'fwd' AS asked, p_partkey FROM part WHERE p_size % 4 = 3 AND p_retailprice <= 1200 UNION ALL SELECT 'brand', p_partkey FROM part WHERE p_size % 4 = 1 AND p_brand = 'Brand#2' UNION ALL SELECT 'all', p_partkey FROM part WHERE p_retailprice <= 950""")
def p01_optional_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Three requests for players that set different filters."""
    parts = table(spark, sf, "part").withColumn("position", F.col("p_size") % 4)
    asked = lambda name, most, **w: where_given(parts.filter(F.col("p_retailprice") <= most) if most else parts, **w).select(F.lit(name).alias("asked"), "p_partkey")
    return asked("fwd", 1200, position=3, p_brand=None).unionByName(asked("brand", None, position=1, p_brand="Brand#2")).unionByName(asked("all", 950, position=None))


@plans(f"SELECT event_id, CASE WHEN k % 2 = 0 THEN 'video' WHEN k % 3 = 0 THEN 'social' ELSE 'article' END AS platform FROM (SELECT event_id, {K} AS k FROM events)")
def p04_platform(spark: SparkSession, sf: str) -> DataFrame:
    """What a claim was found on: a video before a post, a post before an article."""
    video, post = F.when(F.col("k") % 2 == 0, F.col("k")), F.when(F.col("k") % 3 == 0, F.col("k"))
    return events(spark, sf).select("event_id", F.when(video.isNotNull(), "video").when(post.isNotNull(), "social").otherwise("article").alias("platform"))


@plans("""SELECT o_custkey, count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS past, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS ahead, max(o_orderdate) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS last_seen FROM orders GROUP BY 1""")
def p05_strict_before(spark: SparkSession, sf: str) -> DataFrame:
    """What is strictly before a time, and what is at it or after it."""
    at = F.expr("timestamp_ntz'1998-01-01'")
    past = F.col("o_orderdate") < at
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(past).alias("past"), F.count_if(~past).alias("ahead"), F.max(F.when(past, F.col("o_orderdate"))).alias("last_seen"))


@plans("""SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1""")
def p06_trailing_window(spark: SparkSession, sf: str) -> DataFrame:
    """The fourteen days before a time: their start counts, the time itself doesn't."""
    at = F.expr("timestamp_ntz'2024-01-25'")
    rows = table(spark, sf, "events").filter((F.col("ts") >= at - F.expr("INTERVAL 14 DAYS")) & (F.col("ts") < at))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@plans("""SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (3, 7, 11)) AND l_returnflag IN ('A', 'R')""")
def p07_membership(spark: SparkSession, sf: str) -> DataFrame:
    chosen = table(spark, sf, "supplier").filter(F.col("s_nationkey").isin(3, 7, 11)).select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin("A", "R")).join(chosen, "l_suppkey", "left_semi").select("l_orderkey", "l_partkey", "l_suppkey")


SETTING = f"SELECT event_id, CASE {K} % 6 WHEN 0 THEN 'true' WHEN 1 THEN CAST({K} AS VARCHAR) WHEN 2 THEN '-0.5' WHEN 3 THEN '[1, 2]' WHEN 4 THEN '{{\"a\": 1}}' ELSE event_type END AS setting FROM events"


@plans(f"SELECT event_id, CASE WHEN regexp_matches(setting, '^(true|false)$') THEN 'boolean' WHEN regexp_matches(setting, '^-?[0-9]+$') THEN 'integer' WHEN regexp_matches(setting, '^-?[0-9]*[.][0-9]+$') THEN 'number' WHEN setting[1] = '[' THEN 'list' WHEN setting[1] = '{{' THEN 'object' ELSE 'text' END AS kind FROM ({SETTING})")
def p09_field_kind(spark: SparkSession, sf: str) -> DataFrame:
    setting = F.when(F.col("k") % 6 == 0, "true").when(F.col("k") % 6 == 1, F.col("k").cast("string")).when(F.col("k") % 6 == 2, "-0.5").when(F.col("k") % 6 == 3, "[1, 2]").when(F.col("k") % 6 == 4, '{"a": 1}').otherwise(F.col("event_type"))
    return events(spark, sf).select("event_id", T.field_kind(setting).alias("kind"))


@plans(f"SELECT event_id, name, CASE WHEN name LIKE '%key' OR name LIKE '%TOKEN' THEN CASE WHEN k % 5 = 0 THEN '' ELSE '***' END ELSE setting END AS shown FROM (SELECT event_id, k, event_type || CASE k % 4 WHEN 0 THEN '_api_key' WHEN 1 THEN '_TOKEN' WHEN 2 THEN '_limit' ELSE '_url' END AS name, CASE WHEN k % 5 = 0 THEN '' ELSE CAST(k AS VARCHAR) END AS setting FROM (SELECT *, {K} AS k FROM events))")
def p11_redact_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Settings whose name says secret are masked, but for empty ones."""
    ending = F.element_at(F.array(*map(F.lit, ("_api_key", "_TOKEN", "_limit", "_url"))), F.col("k") % 4 + 1)
    rows = events(spark, sf).select("event_id", F.concat("event_type", ending).alias("name"), F.when(F.col("k") % 5 == 0, "").otherwise(F.col("k").cast("string")).alias("setting"))
    return rows.select("event_id", "name", T.redacted(F.col("name"), F.col("setting")).alias("shown"))


def merged_settings(*levels):
    """Maps of settings, each level before the ones that it overrides; a null value overrides nothing."""
    out = levels[0]
    for more in levels[1:]:
        out = F.map_zip_with(out, more, lambda _, over, under: F.coalesce(over, under))
    return out


@plans(f"""SELECT event_id, CASE WHEN k % 7 = 0 THEN 9 WHEN k % 3 = 0 THEN k ELSE 5 END AS horizon, CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS risk, CASE WHEN k % 7 = 0 THEN 0 ELSE 4 END AS hits FROM (SELECT *, {K} AS k FROM events)""")
def p13_settings_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """Settings from the request, then the squad, then what holds for all, then the defaults."""
    pair = lambda *kv: F.create_map(*[x if i % 2 else F.lit(x) for i, x in enumerate(kv)])
    none = F.lit(None).cast("int")
    request = pair("horizon", F.when(F.col("k") % 7 == 0, 9), "hits", F.when(F.col("k") % 7 == 0, 0))
    squad = pair("horizon", F.when(F.col("k") % 3 == 0, F.col("k")), "risk", none)
    general = pair("risk", F.when(F.col("event_type") == "purchase", 2))
    defaults = pair("horizon", F.lit(5), "risk", F.lit(1), "hits", F.lit(4))
    rows = events(spark, sf).select("event_id", merged_settings(request, squad, general, defaults).alias("s"))
    return rows.select("event_id", *(F.col("s")[n].alias(n) for n in ("horizon", "risk", "hits")))


@plans("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN CASE l_linenumber % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'away' ELSE 'draw' END WHEN 'N' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'over_2.5' ELSE 'under_2.5' END ELSE 'part ' || l_partkey END AS selection FROM lineitem""")
def p14_selection_label(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of three markets under one set of names."""
    name = F.when(F.col("l_returnflag") == "A", F.element_at(F.array(F.lit("Team H"), F.lit("Team A"), F.lit("Draw")), F.col("l_linenumber") % 3 + 1)).when(F.col("l_returnflag") == "N", F.when(F.col("l_linenumber") % 2 == 0, "Over").otherwise("Under")).otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    market = F.when(F.col("l_returnflag") == "A", "h2h").when(F.col("l_returnflag") == "N", "totals").otherwise("scorer")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", M.selection(market, name, F.lit("Team H"), F.lit("Team A"), F.lit(2.5)).alias("selection"))


@plans(f"SELECT user_id, CASE WHEN k % 2 = 0 THEN event_type ELSE 'chip_' || event_type END AS chip, k AS week, count(*) AS n FROM (SELECT *, {K} AS k FROM events) WHERE k BETWEEN 1 AND 38 AND event_type <> 'error' GROUP BY 1, 2, 3")
def p15_chip_history(spark: SparkSession, sf: str) -> DataFrame:
    """Histories written as JSON in two shapes, (name, gameweek) or (chip, event), read as one; entries of no week or chip go."""
    entry = F.when(F.col("k") % 2 == 0, F.to_json(F.struct(F.col("event_type").alias("name"), F.col("k").alias("gameweek")))).otherwise(F.to_json(F.struct(F.concat(F.lit("chip_"), F.col("event_type")).alias("chip"), F.col("k").alias("event"))))
    written = events(spark, sf).select("user_id", entry.alias("e")).groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list("e"), ","), F.lit("]")).alias("history"))
    read = F.from_json("history", "array<struct<name string, chip string, gameweek int, event int>>")
    one = F.transform(read, lambda x: F.struct(F.coalesce(x["name"], x["chip"]).alias("chip"), F.coalesce(x["gameweek"], x["event"]).alias("week")))
    valid = F.filter(one, lambda x: x["week"].between(1, 38) & ~x["chip"].contains("error"))
    return written.select("user_id", F.inline(valid)).groupBy("user_id", "chip", "week").agg(F.count("*").alias("n"))


@plans(f"SELECT event_id, CASE {K} % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS at_utc FROM events")
def f01_iso_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    """Times written with Z, without a zone, with an offset, and not as times at all."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    written = F.when(F.col("k") % 4 == 0, F.concat(text, F.lit("Z"))).when(F.col("k") % 4 == 1, text).when(F.col("k") % 4 == 2, F.concat(text, F.lit("+02:00"))).otherwise("soon")
    return events(spark, sf).select("event_id", T.iso_timestamp(written).alias("at_utc"))


@plans("SELECT event_id, round(epoch_us(ts) / 86400e6 - 19723, 6) AS days, CAST(floor(epoch_us(ts) / 86400e6 - 19723) AS BIGINT) AS whole_days, round((epoch_us(ts) - 19723 * 86400000000) / 3600e6, 4) AS hours FROM events")
def f02_time_differences(spark: SparkSession, sf: str) -> DataFrame:
    days = W.days_between(F.col("ts"), F.expr("timestamp_ntz'2024-01-01'"))
    return table(spark, sf, "events").select("event_id", F.round(days, 6).alias("days"), F.floor(days).alias("whole_days"), F.round(days * 24, 4).alias("hours"))


@plans("""SELECT event_id, CASE WHEN dow BETWEEN 2 AND 4 THEN 4 WHEN dow = 0 THEN 3 ELSE CAST(greatest(0, least(2, floor((h - 11) / 3.0))) AS INT) END AS slot FROM (SELECT event_id, dayofweek(ts) AS dow, hour(ts) AS h FROM events)""")
def f04_kickoff_slot(spark: SparkSession, sf: str) -> DataFrame:
    """Tuesday to Thursday, Sunday, or by hour."""
    day = F.dayofweek("ts")
    return table(spark, sf, "events").select("event_id", F.when(day.between(3, 5), 4).when(day == 1, 3).otherwise(F.greatest(F.lit(0), F.least(F.lit(2), F.floor((F.hour("ts") - 11) / 3))).cast("int")).alias("slot"))


@plans("SELECT o_orderkey, y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS season, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(y AS INT) END AS start_year FROM (SELECT o_orderkey, year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS y FROM orders)")
def f05_seasons(spark: SparkSession, sf: str) -> DataFrame:
    """The season of a date, written and read back; one in five is written otherwise."""
    year = F.year("o_orderdate") - F.when(F.month("o_orderdate") < 7, 1).otherwise(0)
    rows = table(spark, sf, "orders").select("o_orderkey", T.season_name(year).alias("season"))
    text = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("season "), F.col("season"))).otherwise(F.col("season"))
    return rows.select("o_orderkey", "season", T.season_start(text).alias("start_year"))


@plans(f"SELECT event_id, CASE WHEN k % 3 <> 2 THEN k END AS gameweek, CASE WHEN k % 3 <> 2 THEN round(k / 2.0, 6) END AS percent, CAST(CASE k % 3 WHEN 0 THEN k * 100000 WHEN 1 THEN k * 1000 END AS BIGINT) AS worth FROM (SELECT event_id, {K} AS k FROM events)")
def f07_extracted_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """A week, a percentage and a price out of a title."""
    k = F.col("k")
    amount = F.when(k % 3 == 0, F.concat((k / 10).cast("decimal(9,1)").cast("string"), F.lit("m"))).otherwise(F.concat(k.cast("string"), F.lit("k")))
    title = F.when(k % 3 == 2, "no numbers here").otherwise(F.concat(F.lit("Best picks GW"), k.cast("string"), F.lit(" owned "), (k / 2).cast("decimal(9,1)").cast("string"), F.lit("% at €"), amount))
    read = events(spark, sf).select("event_id", title.alias("t"))
    return read.select("event_id", F.regexp_extract("t", r"GW\s*(\d+)", 1).try_cast("int").alias("gameweek"), F.round(F.regexp_extract("t", r"([0-9.]+)%", 1).try_cast("double"), 6).alias("percent"), T.money(F.regexp_extract("t", "€(.*)$", 1)).alias("worth"))


FULL = "'Élodie O''' || upper(c_mktsegment) || '-Ibáñez  ' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ' Jr' ELSE '' END"


@plans("SELECT c_custkey, 'elodie o' || lower(c_mktsegment) || ' ibanez ' || c_custkey AS plain FROM customer")
def f08_normal_names(spark: SparkSession, sf: str) -> DataFrame:
    full = F.concat(F.lit("Élodie O'"), F.upper("c_mktsegment"), F.lit("-Ibáñez  "), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, " Jr").otherwise(""))
    return table(spark, sf, "customer").select("c_custkey", T.normal_name(T.strip_accents(full)).alias("plain"))


@plans("""SELECT s_suppkey, array_to_string(list_sort(list_distinct(CASE WHEN s_suppkey % 3 = 0 THEN ['smith' || s_suppkey] ELSE ['smith' || s_suppkey, 'anna smith' || s_suppkey, 'a smith' || s_suppkey, 'annie'] END)), ',') AS variants FROM supplier""")
def f09_name_variants(spark: SparkSession, sf: str) -> DataFrame:
    last = F.concat(F.lit("Smith"), F.col("s_suppkey").cast("string"))
    first, web = (F.when(F.col("s_suppkey") % 3 != 0, x) for x in ("Anna", "Annie"))
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(T.name_variants(first, last, web, F.concat_ws(" ", first, last)), ",").alias("variants"))


@plans(f"SELECT event_id, CASE WHEN k % 4 = 3 THEN sha256(lower(event_type) || ' ' || k) ELSE sha256('{{\"items\":[{{\"b\":' || k || '}},1],\"kind\":\"' || event_type || '\"}}') END AS hash FROM (SELECT *, {K} AS k FROM events)")
def f10_payload_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads that differ in the order of keys and in volatile ones have the same hash; text is compared without its spacing."""
    k = F.col("k").cast("string")
    body = F.when(F.col("k") % 4 == 0, F.concat(F.lit('{"kind": "'), F.col("event_type"), F.lit('", "ts": 5, "items": [{"b": '), k, F.lit(', "etag": "x"}, 1]}'))).when(F.col("k") % 4 == 3, F.concat(F.lit("  "), F.upper("event_type"), F.lit(" \n "), k)).otherwise(F.concat(F.lit('{"items":[{"fetched_at":'), F.col("event_id").cast("string"), F.lit(',"b":'), k, F.lit('},1],"kind":"'), F.col("event_type"), F.lit('"}')))
    return events(spark, sf).select("event_id", T.payload_hash(body).alias("hash"))


@plans("SELECT e.event_id, bit_count(xor(e.event_id * 2654435761, e.user_id * 40503)) AS distance FROM events e")
def f12_hamming(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.bit_count((F.col("event_id") * 2654435761).bitwiseXOR(F.col("user_id") * 40503)).alias("distance"))


@plans("SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(5, least(30, l_quantity)), 6) AS clamped, round(CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / (7 - l_linenumber) END, 9) AS ratio, round(CASE WHEN l_tax = 0 THEN NULL ELSE 90 * l_quantity / (l_tax * 1000) END, 6) AS per90 FROM lineitem")
def f13_safe_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.greatest(F.lit(5.0), F.least(F.lit(30.0), q)), 6).alias("clamped"), F.round(F.try_divide(q, 7 - F.col("l_linenumber")), 9).alias("ratio"), F.round(F.try_divide(90 * q, F.col("l_tax") * 1000), 6).alias("per90"))


@plans("SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&t=' ELSE '?t=' END || CAST(floor(page_id * 1.7) AS BIGINT) || 's' AS link FROM pages")
def f14_deep_links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.deep_link(F.col("url"), F.col("page_id") * 1.7).alias("link"))


@plans(f"SELECT event_id, CAST(CASE k % 4 WHEN 0 THEN k WHEN 1 THEN k END AS INT) AS low, CAST(CASE k % 4 WHEN 0 THEN k + 4 WHEN 1 THEN k END AS INT) AS high FROM (SELECT event_id, {K} AS k FROM events)")
def f15_ranges(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k").cast("string")
    text = F.when(F.col("k") % 4 == 0, F.concat(k, F.lit(" - "), (F.col("k") + 4).cast("string"))).when(F.col("k") % 4 == 1, k).when(F.col("k") % 4 == 2, F.concat(k, F.lit("-x"))).otherwise("next")
    rows = events(spark, sf).select("event_id", text.alias("t"))
    low, high = T.int_range(F.col("t"))
    return rows.select("event_id", low.alias("low"), high.alias("high"))


@plans(f"SELECT event_id, CAST(CASE k % 4 WHEN 0 THEN k WHEN 1 THEN k END AS INT) AS whole FROM (SELECT event_id, {K} AS k FROM events)")
def f16_lenient_casts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k").cast("string")
    return events(spark, sf).select("event_id", T.lenient_int(F.when(F.col("k") % 4 == 0, k).when(F.col("k") % 4 == 1, F.concat(k, F.lit(".75"))).when(F.col("k") % 4 == 2, "None").otherwise("")).alias("whole"))


@plans(f"SELECT event_id, CAST(CASE WHEN k % 4 <> 3 THEN k END AS INT) AS claim FROM (SELECT event_id, {K} AS k FROM events)")
def f17_salvaged_json(spark: SparkSession, sf: str) -> DataFrame:
    """The object in an answer: in a fence, bare among words, alone, or broken."""
    obj = F.concat(F.lit('{"claim": '), F.col("k").cast("string"), F.lit("}"))
    said = F.when(F.col("k") % 4 == 0, F.concat(F.lit("Here:\n```json\n"), obj, F.lit("\n```\nHope {this} helps"))).when(F.col("k") % 4 == 1, F.concat(F.lit("Sure! "), obj, F.lit(" is all."))).when(F.col("k") % 4 == 2, obj).otherwise('{"claim": 1')
    return events(spark, sf).select("event_id", F.get_json_object(T.salvaged_json(said), "$.claim").try_cast("int").alias("claim"))


@plans("SELECT event_id, CASE WHEN h <= 2 THEN 'imminent' WHEN h <= 24 THEN 'near' ELSE 'far' END AS proximity FROM (SELECT event_id, (epoch_us(date_trunc('week', ts) + INTERVAL 7 DAY) - epoch_us(ts)) / 3600e6 AS h FROM events)")
def f18_deadline_proximity(spark: SparkSession, sf: str) -> DataFrame:
    """How near the next deadline is, at the turn of the week."""
    next_one = F.expr("date_trunc('week', CAST(ts AS TIMESTAMP)) + INTERVAL 7 DAYS")
    hours = (F.unix_micros(next_one) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3600e6
    return table(spark, sf, "events").select("event_id", F.when(hours <= 2, "imminent").when(hours <= 24, "near").otherwise("far").alias("proximity"))


@plans("""SELECT conv_id, turn, sha256('{"model":"small","role":"' || role || '","turn":' || turn || '}') AS prompt_hash FROM conversations""")
def f19_prompt_hash(spark: SparkSession, sf: str) -> DataFrame:
    """A key of what was asked of which model, whatever order it was given in."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.to_json(F.struct(F.lit("small").alias("model"), "role", "turn")), 256).alias("prompt_hash"))


@plans("SELECT p_partkey, CAST(least(5, greatest(0, p_size % 6 - p_partkey % 7) + 1) AS INT) AS free_next FROM part")
def r02_free_transfers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", R.free_next(F.col("p_size") % 6, (F.col("p_partkey") % 7).cast("int"), F.lit(False)).alias("free_next"))


@plans(f"""WITH c AS (SELECT l_orderkey, count(*) FILTER (p = 'GK') AS gk, count(*) FILTER (p = 'DEF') AS d, count(*) FILTER (p = 'MID') AS m, count(*) FILTER (p = 'FWD') AS f FROM (SELECT l_orderkey, {POSITION.format(x="l_suppkey")} AS p FROM lineitem) GROUP BY 1)
SELECT l_orderkey, d || '-' || m || '-' || f AS formation, gk = 1 AND d BETWEEN 3 AND 5 AND m BETWEEN 2 AND 5 AND f BETWEEN 1 AND 3 AND d + m + f = 10 AS legal FROM c
UNION ALL SELECT -(100 * d.x + 10 * m.x + f.x), d.x || '-' || m.x || '-' || f.x, true FROM (SELECT unnest([3, 4, 5]) AS x) d, (SELECT unnest([2, 3, 4, 5]) AS x) m, (SELECT unnest([1, 2, 3]) AS x) f WHERE d.x + m.x + f.x = 10""")
def r06_formations(spark: SparkSession, sf: str) -> DataFrame:
    """The formation of each order's lines, and all legal ones."""
    text, legal = R.formation(F.col("p"))
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey", POSITION.format(x="l_suppkey") + " AS p").groupBy("l_orderkey").agg(text.alias("formation"), legal.alias("legal"))
    listed = spark.createDataFrame([(-(100 * d + 10 * m + f), f"{d}-{m}-{f}", True) for d, m, f in R.FORMATIONS], "l_orderkey long, formation string, legal boolean")
    return rows.unionByName(listed)


@plans("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN o_custkey + 1 ELSE o_custkey END AS doubled FROM orders")
def r08_effective_captain(spark: SparkSession, sf: str) -> DataFrame:
    minutes = lambda c, n: F.when(F.col(c) % n == 0, 0).otherwise(90)
    return table(spark, sf, "orders").select("o_orderkey", R.effective_captain(F.col("o_custkey"), minutes("o_custkey", 3), F.col("o_custkey") + 1, minutes("o_orderkey", 4)).alias("doubled"))


@plans(f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 16 >= CASE WHEN {POSITION.format(x='l_suppkey')} = 'DEF' THEN 10 ELSE 12 END THEN 2 ELSE 0 END AS points FROM lineitem")
def r09_threshold_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R.threshold_points(F.expr(POSITION.format(x="l_suppkey")), F.col("l_partkey") % 16).alias("points"))


@plans(f"SELECT user_id, k AS week, 20 - k AS weeks_left, CASE WHEN 20 - k <= 2 THEN 'critical' WHEN 20 - k <= 4 THEN 'high' ELSE 'medium' END AS severity, count(*) AS n FROM (SELECT user_id, event_type, {K} AS k FROM events) WHERE k BETWEEN 15 AND 19 GROUP BY 1, 2")
def o10_expiry_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """From week 15 on, how many weeks are left until week 19 ends the first half."""
    left = 20 - F.col("k")
    return events(spark, sf).filter(F.col("k").between(15, 19)).groupBy("user_id", F.col("k").alias("week"), left.alias("weeks_left"), R.expiry_severity(left).alias("severity")).agg(F.count("*").alias("n"))


@plans("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN m = 0 THEN 0 WHEN l_quantity >= 40 OR m >= 60 THEN 2 ELSE 1 END AS label FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_quantity AS INT) * 2 END AS m FROM lineitem)")
def m13_appearance_class(spark: SparkSession, sf: str) -> DataFrame:
    minutes = F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("int") * 2)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R.appearance_class(minutes, (F.col("l_quantity") >= 40).cast("int")).alias("label"))


@plans(f"""WITH e AS (SELECT event_id, k, least(0.6, value / 100) AS s, 0.2 AS c FROM (SELECT *, {K} AS k FROM events)), a AS (SELECT *, CASE WHEN k % 7 = 0 THEN least(c + s, 0.02) / greatest(c + s, 1e-9) ELSE 1 END AS scale FROM e),
b AS (SELECT event_id, k, 1 - (c + s) * scale AS n, c * scale AS c, s * scale AS s, least(0.4, (k % 5) / 8.0) AS blend FROM a), d AS (SELECT *, s * (1 - blend) + (s + c) / 2 * blend AS s2 FROM b), f AS (SELECT *, c * (1 - blend) + (s2 + c) / 2 * blend AS c2 FROM d), g AS (SELECT event_id, k, c2 / (n + c2 + s2) AS c, s2 / (n + c2 + s2) AS s FROM f)
SELECT event_id, round(CASE WHEN k % 11 = 0 THEN 0 WHEN k % 13 = 0 THEN 0.95 WHEN k % 13 = 1 THEN 0.03 ELSE s END, 9) AS p_start, round(CASE WHEN k % 11 = 0 THEN 0 WHEN k % 13 = 0 THEN 0.05 WHEN k % 13 = 1 THEN 0.42 ELSE c END, 9) AS p_cameo,
round(CASE WHEN k % 11 = 0 THEN 0 WHEN k % 13 = 0 THEN 0.95 * 78 + 0.05 * 25 WHEN k % 13 = 1 THEN 0.42 * 19 + 0.03 * 45 ELSE 78 * s + 19 * c END, 9) AS minutes FROM g""")
def m11_minutes_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A forecast of minutes after what is known for sure: suspension, a confirmed line-up, a flag of 0 %, then disagreement."""
    k = F.col("k")
    rows = events(spark, sf).withColumns({"s": F.least(F.lit(0.6), F.col("value") / 100), "c": F.lit(0.2)})
    confirmed = F.when(k % 13 == 0, True).when(k % 13 == 1, False)
    start, cameo, minutes = M.settled_minutes(F.col("s"), F.col("c"), k % 11 == 0, confirmed, F.when(k % 7 == 0, 0.0), (k % 5) / 8.0)
    return rows.select("event_id", F.round(start, 9).alias("p_start"), F.round(cameo, 9).alias("p_cameo"), F.round(minutes, 9).alias("minutes"))


RATE = f"SELECT event_id, event_type, value, {K} AS k, CASE WHEN event_type = 'purchase' THEN 'FWD' WHEN event_type = 'view' THEN 'MID' WHEN event_type = 'click' THEN 'DEF' ELSE 'GK' END AS position FROM events"


def rate_rows(spark: SparkSession, sf: str) -> DataFrame:
    position = F.when(F.col("event_type") == "purchase", "FWD").when(F.col("event_type") == "view", "MID").when(F.col("event_type") == "click", "DEF").otherwise("GK")
    return events(spark, sf).withColumn("position", position)


@plans(f"""SELECT event_id, round(CASE WHEN k % 4 = 0 THEN greatest(0, value / 100 - 0.1) ELSE coalesce(nullif(CASE WHEN k % 4 = 1 THEN value / 200 END, 0), nullif(CASE WHEN k % 4 = 2 THEN value / 300 END, 0), CASE position WHEN 'GK' THEN 0.002 WHEN 'DEF' THEN 0.05 WHEN 'MID' THEN 0.14 ELSE 0.33 END * CASE WHEN k % 8 = 3 THEN 1 ELSE 0.4 + 1.8 * (k / 100.0) END) END, 9) AS goals90 FROM ({RATE})""")
def m17_rate_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    """A model's rate, else what was seen lately, else a prior of the position scaled by the price's percentile."""
    k = F.col("k")
    model = F.when(k % 4 == 0, F.col("value") / 100 - 0.1)
    seen = [F.when(k % 4 == i, F.col("value") / d) for i, d in ((1, 200), (2, 300))]
    return rate_rows(spark, sf).select("event_id", F.round(M.rate_or_prior(model, seen, F.col("position"), F.when(k % 8 != 3, k / 100.0)), 9).alias("goals90"))


@plans(f"SELECT event_id, round(greatest(0, value / 100 * (0.5 + k / 50.0) / 1.42), 9) AS scaled, round(CASE WHEN k % 3 = 0 THEN value / 100 ELSE 0.5 * (value / 100) + 0.5 * -ln(1 - least(0.95, k / 100.0)) END, 9) AS blended FROM ({RATE})")
def m18_m27_fixture_rates(spark: SparkSession, sf: str) -> DataFrame:
    """A rate for this opponent, by the team's expected goals over the mean; and blended with the scorer market's."""
    rate, k = F.col("value") / 100, F.col("k")
    return rate_rows(spark, sf).select("event_id", F.round(M.scale_to_fixture(rate, 0.5 + k / 50.0), 9).alias("scaled"), F.round(M.blend_with_scorer_market(rate, F.when(k % 3 != 0, k / 100.0)), 9).alias("blended"))


@plans("""WITH q AS (SELECT event_id, m, m / (m + 5.0) AS q, pow(5.0 / (m + 5.0), 5.0) AS p0 FROM (SELECT event_id, value / 20 AS m FROM events)) SELECT event_id, round(m, 9) AS expected, round(1 - p0 * (1 + q * 5 + q * q * 15), 8) AS p_three FROM q""")
def m26_expected_count(spark: SparkSession, sf: str) -> DataFrame:
    """An expected count from a rate and minutes, and the chance of three or more."""
    mean = F.col("value") / 20
    return table(spark, sf, "events").select("event_id", F.round(mean, 9).alias("expected"), F.round(M.nb_survival(mean, F.lit(5.0), 3), 8).alias("p_three"))


@plans(f"SELECT event_id, CASE WHEN m > 0 THEN round(least(6, greatest(0, 90.0 * g / greatest(m, 1))), 9) END AS goals_target, CASE WHEN m >= 30 THEN round(least(40, 90.0 * a / m), 9) END AS actions_target, CASE WHEN m > 0 AND position = 'GK' THEN round(90.0 * s / greatest(m, 1), 9) END AS saves_target, round(least(120, greatest(-10, value - 30)), 6) AS bonus_target FROM (SELECT *, k % 91 AS m, k % 3 AS g, k % 17 AS a, k % 6 AS s FROM ({RATE}))")
def m07_m24_training_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Targets of each model on the rows that it learns from; null on others."""
    k = F.col("k")
    m = k % 91
    per90 = lambda x: 90.0 * x / F.greatest(m, F.lit(1))
    target = lambda where, x: F.round(F.when(where, x), 9)
    return rate_rows(spark, sf).select("event_id", target(m > 0, F.least(F.lit(6.0), F.greatest(F.lit(0.0), per90(k % 3)))).alias("goals_target"), target(m >= 30, F.least(F.lit(40.0), per90(k % 17))).alias("actions_target"), target((m > 0) & (F.col("position") == "GK"), per90(k % 6)).alias("saves_target"), F.round(F.least(F.lit(120.0), F.greatest(F.lit(-10.0), F.col("value") - 30)), 6).alias("bonus_target"))
