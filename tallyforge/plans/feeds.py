"""Sources, ingest, accounts of runs, and streams on the sample tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import states as S
from ..sources import ingest as I
from ..sources import readers
from ..streaming import jobs, states
from ..shared import parts_for
from .base import Plans, table
from .columns import K, events
from .form import GAMES, team_rows
from .texts import _checkpoint

plans = Plans()


def _events_raw(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("external"), F.col("props").alias("payload"))


def _events_parsed(rows: DataFrame) -> DataFrame:
    return readers.parse_json(rows, "payload", "k int").filter("parsed.k % 10 <> 0").select("source", "external", "parsed.k")


def _turns_raw(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("external"), F.concat_ws(" ", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("payload"))


def _nothing_parsed(rows: DataFrame) -> DataFrame:
    return rows.filter("payload = ''").select("source", "external")


def _nations_raw(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("external"), F.col("n_name").alias("payload"))


I.connector("props", version=2, parse=_events_parsed)(_events_raw)
I.connector("turns", parse=_nothing_parsed)(_turns_raw)
I.connector("nations")(_nations_raw)


@plans("""WITH p AS (SELECT DISTINCT props, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), c AS (SELECT count(*) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations))
SELECT 'props' AS source, count(*) AS n_docs, count(*) FILTER (k % 10 <> 0) AS n_rows, CASE WHEN count(*) FILTER (k % 10 <> 0) = 0 THEN 'empty' ELSE 'partial' END AS status FROM p UNION ALL SELECT 'turns', n, 0, 'empty' FROM c UNION ALL SELECT 'nations', count(*), 0, 'archived' FROM nation""")
def s01_s13_connectors(spark: SparkSession, sf: str) -> DataFrame:
    """Three registered sources, one of which has no parser: archived once each by content, parsed and reported."""
    reports = []
    for name in ("props", "turns", "nations"):
        source = I.REGISTRY[name]
        rows = I.archived(source, spark, sf)
        if name == "props":  # rows of one content come from many users; the content names them
            rows = rows.withColumn("external", F.col("hash"))
        reports.append(I.run_report(rows, source.parse(rows) if source.parse else None))
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


@plans("""WITH f AS (SELECT DISTINCT sha256(lower(trim(props))) AS hash, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) SELECT hash FROM f WHERE k % 4 IN (0, 1, 2)""")
def s03_reprocess(spark: SparkSession, sf: str) -> DataFrame:
    """What has to be parsed again: not archived, archived by an older parser, or failed."""
    fetched = I.archived(I.REGISTRY["props"], spark, sf)
    k = F.get_json_object("payload", "$.k").try_cast("int") % 4
    stored = fetched.filter(k != 0).select("source", "hash", F.when(k == 1, 1).otherwise(2).alias("parser_version"), F.when(k == 2, "failed").otherwise("ok").alias("status"))
    return I.new_or_stale(fetched, stored).select("hash")


@plans("""SELECT doc_id, octet_length(encode(text)) > 4096 AS apart, CASE WHEN octet_length(encode(text)) > 4096 THEN sha256(text) END AS blob, sha256(text) AS loaded FROM documents""")
def s04_blob_store(spark: SparkSession, sf: str) -> DataFrame:
    """Long texts are stored once by their hash, and every payload is put together again."""
    rows, blobs = I.split_blobs(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 4096)
    back = I.load_payloads(rows, blobs, "doc_id").select("doc_id", F.sha2("payload", 256).alias("loaded"))
    return rows.select("doc_id", F.col("blob").isNotNull().alias("apart"), "blob").join(back, "doc_id")


RUNS = "WITH r AS (SELECT user_id AS source, ts AS started, event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value < 10 THEN 'empty' WHEN value < 20 THEN 'partial' ELSE 'ok' END AS status, CAST(floor(value) AS BIGINT) AS n FROM events)"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") < 10, "empty").when(F.col("value") < 20, "partial").otherwise("ok")
    return table(spark, sf, "events").select(F.col("user_id").alias("source"), F.col("ts").alias("started"), "event_id", status.alias("status"), F.floor("value").alias("n"))


@plans(RUNS + """, w AS (SELECT *, max(CASE WHEN status IN ('ok', 'partial') THEN event_id END) OVER (PARTITION BY source ORDER BY started, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM r)
SELECT source, arg_max(status, (started, event_id)) AS status, arg_max(n, (started, event_id)) AS n, count(*) FILTER (later IS NULL) AS failures, max(started) FILTER (status IN ('ok', 'partial')) AS last_well FROM w GROUP BY 1""")
def s05_source_health(spark: SparkSession, sf: str) -> DataFrame:
    return I.source_health(runs(spark, sf), "source", ["started", "event_id"], "status", "n", ["ok", "partial"])


@plans(RUNS + """, g AS (SELECT *, sum(CASE WHEN status IN ('failed', 'empty') THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY started, event_id) AS grp FROM r) SELECT source, min(started) AS first, count(*) AS n FROM g WHERE status IN ('failed', 'empty') GROUP BY source, grp HAVING count(*) >= 3""")
def v07_silent_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that have given nothing three times in a row or more."""
    return I.silent_runs(runs(spark, sf).withColumn("none", F.col("status").isin("failed", "empty")), "source", ["started", "event_id"], "none", 3)


@plans("""SELECT l_orderkey AS match_id, count(*) AS shots, count(*) FILTER (l_returnflag IN ('A', 'R')) AS on_target, count(*) FILTER (l_discount >= 0.03) AS big_chances, count(*) FILTER (l_linestatus = 'F') AS penalties, round(sum(l_discount) FILTER (l_linestatus <> 'F'), 6) AS npxg FROM lineitem GROUP BY 1""")
def s09_shot_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Shot lists as JSON, one for each match, added up to counts."""
    shot = F.struct(F.when(F.col("l_returnflag").isin("A", "R"), "SavedShot").otherwise("MissedShots").alias("result"), F.when(F.col("l_linestatus") == "F", "Penalty").otherwise("OpenPlay").alias("situation"), F.col("l_discount").alias("xG"))
    feed = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(F.to_json(F.collect_list(shot)).alias("payload"))
    shots = feed.select("match_id", F.inline(F.from_json("payload", "array<struct<result string, situation string, xG double>>")))
    open_play = F.col("situation") != "Penalty"
    return shots.groupBy("match_id").agg(F.count("*").alias("shots"), F.count_if(F.col("result").isin("SavedShot", "Goal")).alias("on_target"), F.count_if(F.col("xG") >= 0.03).alias("big_chances"), F.count_if(~open_play).alias("penalties"), F.round(F.sum(F.when(open_play, F.col("xG"))), 6).alias("npxg"))


@plans("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey ELSE 7 END AS tackles, coalesce(CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey * 2 END, s_nationkey) AS blocks FROM supplier WHERE s_suppkey % 3 = 0 OR true")
def s11_defensive_frame(spark: SparkSession, sf: str) -> DataFrame:
    """A frame of defensive counts: tackles only fill gaps, blocks overwrite where the frame has them."""
    from ..operators.joins import update_join

    s = table(spark, sf, "supplier")
    facts = s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey")).alias("tackles"), F.col("s_nationkey").alias("blocks"))
    frame = s.select("s_suppkey", F.lit(7).alias("tackles"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_nationkey") * 2).alias("blocks"))
    return update_join(facts, frame, ["s_suppkey"], ["tackles"], ["blocks"])


@plans(GAMES + " SELECT match_id, CASE WHEN is_home = 1 THEN 'home' ELSE 'away' END AS side, team, round(6 + scored / 2.0, 3) AS rating FROM s")
def s12_ratings_by_side(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings in a payload with both sides, one row for each."""
    one = lambda c: F.struct(F.col(f"{c}_team").alias("team"), (6 + F.col(f"{c}_scored") / 2).alias("rating")).alias(c)
    home = team_rows(spark, sf).filter("is_home = 1").select("match_id", F.col("team").alias("home_team"), F.col("opponent").alias("away_team"), F.col("scored").alias("home_scored"), F.col("conceded").alias("away_scored"))
    payload = home.select("match_id", F.to_json(F.struct(one("home"), one("away"))).alias("p"))
    read = payload.select("match_id", F.from_json("p", "map<string, struct<team int, rating double>>").alias("m"))
    return read.select("match_id", F.explode("m").alias("side", "r")).select("match_id", "side", "r.team", F.round("r.rating", 3).alias("rating"))


@plans("SELECT l_orderkey AS match_id, CASE WHEN l_orderkey % 2 = 0 THEN 'confirmed' ELSE 'predicted' END AS kind, CASE WHEN l_suppkey % 2 = 0 THEN 'home' ELSE 'away' END AS side, l_suppkey AS player, l_linenumber <= 5 AS starts, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4, 5")
def s14_lineups(spark: SparkSession, sf: str) -> DataFrame:
    """Line-ups of two providers, nested in different ways, in one shape."""
    side = F.when(F.col("l_suppkey") % 2 == 0, "home").otherwise("away")
    rows = table(spark, sf, "lineitem").select("l_orderkey", side.alias("side"), F.col("l_suppkey").alias("id"), (F.col("l_linenumber") <= 5).alias("starts"))
    # as many parts as the rows need, so that a task's lists and counts don't grow with the table; all that follows stays in them
    rows = rows.repartition(parts_for(rows), "l_orderkey")
    confirmed = rows.filter("l_orderkey % 2 = 0").groupBy("l_orderkey", "side").agg(F.collect_list(F.when(F.col("starts"), F.col("id"))).alias("startXI"), F.collect_list(F.when(~F.col("starts"), F.col("id"))).alias("substitutes"))
    confirmed = confirmed.groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct("side", "startXI", "substitutes"))).alias("p"))
    predicted = rows.filter("l_orderkey % 2 = 1").groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(F.struct("side", "id", F.when(F.col("starts"), 11).otherwise(12).alias("type_id"))).alias("lineups"))).alias("p"))
    blocks = confirmed.select("l_orderkey", F.inline(F.from_json("p", "array<struct<side string, startXI array<long>, substitutes array<long>>>")))
    groups = F.array(F.struct(F.lit(True).alias("starts"), F.col("startXI").alias("ids")), F.struct(F.lit(False).alias("starts"), F.col("substitutes").alias("ids")))
    a = blocks.select("l_orderkey", "side", F.inline(groups)).select("l_orderkey", F.lit("confirmed").alias("kind"), "side", F.explode("ids").alias("player"), "starts")
    b = predicted.select("l_orderkey", F.inline(F.from_json("p", "struct<lineups: array<struct<side: string, id: long, type_id: int>>>")["lineups"])).select("l_orderkey", F.lit("predicted").alias("kind"), "side", F.col("id").alias("player"), (F.col("type_id") == 11).alias("starts"))
    # a match is of one kind, so either provider's rows are counted where they lie
    counted = [x.groupBy(F.col("l_orderkey").alias("match_id"), "kind", "side", "player", "starts").agg(F.count("*").alias("n")) for x in (a, b)]
    return counted[0].unionByName(counted[1])


@plans("SELECT page_id, url AS link, 'Story ' || page_id AS title, CASE WHEN page_id % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 10:00:00' + to_hours(CAST(page_id AS INT)) END AS published FROM pages")
def s16_rss_items(spark: SparkSession, sf: str) -> DataFrame:
    """Feeds of items as XML, a third without a date, read back to rows."""
    at = F.date_format(F.expr("timestamp'2024-01-01 10:00:00' + make_interval(0, 0, 0, 0, CAST(page_id AS INT), 0, 0)"), "EEE, dd MMM yyyy HH:mm:ss")
    date = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("<pubDate>"), at, F.lit(" +0000</pubDate>")))
    xml = F.concat(F.lit("<item><guid>"), F.col("page_id").cast("string"), F.lit("</guid><title>Story "), F.col("page_id").cast("string"), F.lit("</title><link>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</link>"), date, F.lit("</item>"))
    read = table(spark, sf, "pages").select(F.from_xml(xml, "guid long, title string, link string, pubDate string").alias("i"))
    return read.select(F.col("i.guid").alias("page_id"), "i.link", "i.title", T.mail_timestamp(F.col("i.pubDate")).cast("timestamp_ntz").alias("published"))


@plans("""WITH c AS (SELECT conv_id, turn, text, ceil(length(text) / 15.0) AS s FROM conversations) SELECT conv_id, turn, CAST(coalesce(sum(s) OVER w, 0) AS BIGINT) AS start_s FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def s17_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Where each part of a transcript begins, at fifteen characters a second."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf, "conversations").withColumn("s", F.ceil(F.length("text") / 15))
    return rows.select("conv_id", "turn", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start_s"))


@plans(f"SELECT event_id, CASE WHEN k % 3 = 0 THEN 'forum' WHEN k % 3 = 1 THEN 'sky' ELSE 'bird' END AS platform, 'u' || user_id AS author, event_type || ' ' || k AS body, CAST(floor(value) AS BIGINT) AS score, date_trunc('second', ts) AS posted FROM (SELECT *, {K} AS k FROM events)")
def s18_s30_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts of three platforms with fields, nesting and times of their own, in one shape."""
    e = events(spark, sf).withColumns({"author": F.concat(F.lit("u"), F.col("user_id").cast("string")), "body": F.concat_ws(" ", "event_type", F.col("k").cast("string")), "score": F.floor("value")})
    t = F.col("ts").cast("timestamp")
    forum = F.to_json(F.struct("event_id", F.struct(F.col("author"), F.col("body").alias("selftext"), F.col("score"), F.unix_seconds(t).alias("created_utc")).alias("data")))
    sky = F.to_json(F.struct("event_id", F.struct(F.struct(F.col("author").alias("handle")).alias("author"), F.struct(F.col("body").alias("text"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt")).alias("record"), F.col("score").alias("likeCount")).alias("post")))
    bird = F.to_json(F.struct("event_id", F.struct(F.struct(F.struct(F.col("author").alias("screen_name"), F.col("body").alias("full_text"), F.col("score").alias("favorite_count"), F.date_format(t, "EEE MMM dd HH:mm:ss Z yyyy").alias("created_at")).alias("legacy")).alias("result")).alias("tweet")))
    raw = e.select((F.col("k") % 3).alias("p"), F.when(F.col("k") % 3 == 0, forum).when(F.col("k") % 3 == 1, sky).otherwise(bird).alias("j"))
    at = lambda path: F.get_json_object("j", path)
    one = lambda p, name, author, body, score, posted: raw.filter(F.col("p") == p).select(at("$.event_id").cast("long").alias("event_id"), F.lit(name).alias("platform"), at(author).alias("author"), at(body).alias("body"), at(score).cast("long").alias("score"), posted.cast("timestamp_ntz").alias("posted"))
    posts = one(0, "forum", "$.data.author", "$.data.selftext", "$.data.score", F.timestamp_seconds(at("$.data.created_utc").cast("long")))
    posts = posts.unionByName(one(1, "sky", "$.post.author.handle", "$.post.record.text", "$.post.likeCount", F.try_to_timestamp(at("$.post.record.createdAt"))))
    return posts.unionByName(one(2, "bird", "$.tweet.result.legacy.screen_name", "$.tweet.result.legacy.full_text", "$.tweet.result.legacy.favorite_count", T.mail_timestamp(at("$.tweet.result.legacy.created_at"))))


@plans(f"""SELECT s.o_orderkey, s.hour, s.temperature FROM (SELECT o_orderkey, h.hour, h.hour * 2 + o_orderkey % 5 AS temperature, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(h.hour - (12 + o_custkey % 9) - 0.4), h.hour) AS n FROM orders, (SELECT unnest([0, 3, 6, 9, 12, 15, 18, 21]) AS hour) h) s WHERE n = 1""")
def s20_nearest_hour(spark: SparkSession, sf: str) -> DataFrame:
    """Of a forecast by the hour, the entry nearest to the kick-off."""
    hours = F.transform(F.array(*map(F.lit, range(0, 24, 3))), lambda h: F.struct(F.abs(h - (12 + F.col("o_custkey") % 9) - 0.4).alias("off"), h.alias("hour"), (h * 2 + F.col("o_orderkey") % 5).alias("temperature")))
    return table(spark, sf, "orders").select("o_orderkey", F.array_min(hours).alias("x")).select("o_orderkey", "x.hour", "x.temperature")


@plans("SELECT region AS n_regionkey, name AS n_name, place, 'takers' AS role FROM (SELECT n_regionkey AS region, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place FROM nation)")
def s20_set_piece_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet with a list of names in each cell, one row for each name with its place."""
    listed = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), ", ").alias("takers"))
    long = listed.unpivot("n_regionkey", ["takers"], "role", "names")
    return long.select("n_regionkey", "role", F.posexplode(F.split("names", ",\\s*")).alias("i", "n_name")).select("n_regionkey", "n_name", (F.col("i") + 1).cast("long").alias("place"), "role")


@plans(f"SELECT event_id, CASE k % 5 WHEN 0 THEN 'suspended' WHEN 1 THEN 'out' WHEN 2 THEN 'doubtful' WHEN 3 THEN 'doubtful' ELSE 'available' END AS status, CAST(CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN greatest(1, k) WHEN 3 THEN 50 ELSE 100 END AS INT) AS chance FROM (SELECT event_id, least(99, {K}) AS k FROM events)")
def s21_status_words(spark: SparkSession, sf: str) -> DataFrame:
    """Free text to a status and a chance in percent."""
    k = F.least(F.lit(99), F.col("k"))
    said = F.when(k % 5 == 0, "Banned for one match").when(k % 5 == 1, "Knee injury, OUT").when(k % 5 == 2, F.concat(F.greatest(F.lit(1), k).cast("string"), F.lit("% chance of playing"))).when(k % 5 == 3, "Doubtful").otherwise("Fit")
    status, chance = readers.status_of(F.col("said"))
    return events(spark, sf).select("event_id", said.alias("said")).select("event_id", status.alias("status"), chance.alias("chance"))


@plans(GAMES + """ SELECT a.match_id, min(f.match_id) AS fixture FROM (SELECT match_id, home, away, CAST(ts AS DATE) + CASE WHEN match_id % 7 = 0 THEN 1 ELSE 0 END AS day FROM g) a
LEFT JOIN g f ON CAST(f.ts AS DATE) = a.day AND f.home = a.home AND f.away = a.away AND a.home % 5 <> 4 GROUP BY 1""")
def s26_match_events_to_fixtures(spark: SparkSession, sf: str) -> DataFrame:
    """Odds events to fixtures: on the same day, between the same clubs by any known name; unknown names match themselves alone."""
    games = team_rows(spark, sf).filter("is_home = 1").select("match_id", "team", "opponent", "ts")
    names = table(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("surface"))
    alias = names.filter("n_nationkey % 5 <> 4").select(F.concat(F.col("surface"), F.lit(" fc")).alias("alias"), F.col("surface").alias("club"))
    label = lambda key, out: names.select(F.col("n_nationkey").alias(key), F.col("surface").alias(out))
    named = games.join(label("team", "home"), "team").join(label("opponent", "away"), "opponent")
    fixtures = named.select(F.col("match_id").alias("fixture"), F.to_date("ts").alias("day"), "home", "away")
    asked = named.select("match_id", F.when(F.col("match_id") % 7 == 0, F.date_add("ts", 1)).otherwise(F.to_date("ts")).alias("day"), F.concat(F.col("home"), F.lit(" fc")).alias("alias"), "away")
    known = asked.join(alias, "alias", "left").select("match_id", "day", F.coalesce("club", "alias").alias("home"), "away")
    return known.join(fixtures, ["day", "home", "away"], "left").groupBy("match_id").agg(F.min("fixture").alias("fixture"))


@plans("SELECT DISTINCT l_suppkey AS player, coalesce(CASE WHEN l_suppkey % 3 <> 0 THEN s_name END, 'team ' || l_suppkey % 7) AS team FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def s27_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """A dimension from the facts: the team by name, or by the season's list where the column is missing."""
    seen = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("player")).distinct()
    by_name = table(spark, sf, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("player"), F.col("s_name").alias("named"))
    listed = spark.range(7).select(F.col("id").alias("code"), F.concat(F.lit("team "), F.col("id").cast("string")).alias("listed"))
    known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("player"))
    return seen.join(known, "player", "left_semi").join(by_name, "player", "left").withColumn("code", F.col("player") % 7).join(listed, "code").select("player", F.coalesce("named", "listed").alias("team"))


@plans("SELECT c_custkey AS squad, CASE WHEN c_custkey % 2 = 0 THEN 'mine' ELSE 'public' END AS kind, CAST(c_nationkey AS INT) AS bank, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey % 6 AS INT) END AS free FROM customer")
def s28_two_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """A squad as its owner sees it, and as others do, in one shape; only the owner sees the free moves."""
    c = table(spark, sf, "customer")
    mine = F.to_json(F.struct(F.struct(F.col("c_nationkey").alias("bank"), (F.col("c_nationkey") % 6).alias("limit")).alias("transfers"), F.col("c_custkey").alias("entry")))
    public = F.to_json(F.struct(F.struct(F.col("c_nationkey").alias("bank")).alias("entry_history"), F.col("c_custkey").alias("entry")))
    raw = c.select(F.when(F.col("c_custkey") % 2 == 0, mine).otherwise(public).alias("j"))
    p = F.from_json("j", "entry long, transfers struct<bank int, `limit` int>, entry_history struct<bank int>")
    return raw.select(p.alias("p")).select(F.col("p.entry").alias("squad"), F.when(F.col("p.transfers").isNotNull(), "mine").otherwise("public").alias("kind"), F.coalesce("p.transfers.bank", "p.entry_history.bank").alias("bank"), F.col("p.transfers.limit").alias("free"))


@plans("""WITH a AS (SELECT DISTINCT o_custkey AS squad, l_suppkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey AS squad, l_suppkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 1),
d AS (SELECT coalesce(a.squad, b.squad) AS squad, a.p AS was, b.p AS now FROM a FULL JOIN b ON a.squad = b.squad AND a.p = b.p)
SELECT squad, count(*) FILTER (now IS NULL) AS n_out, count(*) FILTER (was IS NULL) AS n_in, count(*) FILTER (now IS NULL) <> count(*) FILTER (was IS NULL) AS warns FROM d GROUP BY 1""")
def s29_push_preview(spark: SparkSession, sf: str) -> DataFrame:
    """What would be moved in and out of each squad, with a warning where that doesn't balance. Nothing is pushed anywhere."""
    picks = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    state = lambda r, n: picks.filter(F.col("o_orderkey") % 2 == r).select(F.col("o_custkey").alias("squad"), F.col("l_suppkey").alias("p"), F.lit(True).alias(n)).distinct()
    both = state(0, "was").join(state(1, "now"), ["squad", "p"], "full")
    gone, new = F.count_if(F.col("now").isNull()), F.count_if(F.col("was").isNull())
    return both.groupBy("squad").agg(gone.alias("n_out"), new.alias("n_in"), (gone != new).alias("warns"))


@plans("SELECT s_suppkey, 'https://news.example/search?q=' || replace(replace('\"' || s_name || '\" injury', ' ', '+'), '#', '%23').replace('\"', '%22') AS query FROM supplier WHERE s_acctbal > 0")
def s31_generated_queries(spark: SparkSession, sf: str) -> DataFrame:
    """A search for each watched name, encoded for a link."""
    text = F.format_string('"%s" injury', "s_name")
    return table(spark, sf, "supplier").filter("s_acctbal > 0").select("s_suppkey", F.concat(F.lit("https://news.example/search?q="), F.url_encode(text)).alias("query"))


# -- streams


@plans("SELECT DISTINCT user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def v03_ingest_once(spark: SparkSession, sf: str) -> DataFrame:
    """Each story once from a stream, however often it comes."""
    stream = jobs.read_parquet_stream(spark, sf, "events.parquet").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    once = jobs.ingest_once(stream.select("ts", "user_id", "event_type", "k"), "ts", ["user_id", "event_type", "k"], "60 days")
    return jobs.drain(once, _checkpoint(spark, f"v03-{uuid.uuid4().hex}")).select("user_id", "event_type", "k")


def arrived(spark: SparkSession, sf: str, name: str) -> tuple[str, DataFrame]:
    """A folder for a stream's progress, and events that arrive out of order, in several files."""
    path = _checkpoint(spark, f"{name}-{uuid.uuid4().hex}")
    k = F.get_json_object("props", "$.k").try_cast("long")
    events = table(spark, sf, "events").select("user_id", "ts", F.col("event_id").alias("id"), "event_type", "value", k.alias("k"))
    jobs.arrivals(events, "ts", "user_id", f"{path}/events", ids=("id",))
    return path, jobs.read_parquet_stream(spark, f"{path}/events")


IN_ORDER = """e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_id AS id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, id) >= 43200000 THEN 1 ELSE 0 END AS gap FROM e),
s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ms, id) AS session FROM g)"""


@plans(f"""WITH {IN_ORDER}, m AS (SELECT *, CASE event_type WHEN 'signup' THEN 'deadline' WHEN 'view' THEN 'ingest' WHEN 'purchase' THEN 'prediction' END AS kind, ms // 1000 + k * 600 AS v FROM s),
x AS (SELECT *, max(v) FILTER (kind = 'deadline') OVER w AS deadline, max(v) FILTER (kind = 'ingest') OVER w AS ingest, max(v) FILTER (kind = 'prediction') OVER w AS prediction,
  max(v) OVER (PARTITION BY user_id, session, kind ORDER BY ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM m WINDOW w AS (PARTITION BY user_id, session ORDER BY ms, id))
SELECT user_id, make_timestamp(ms * 1000) AS ts, id, deadline, ingest, prediction FROM x WHERE kind IS NOT NULL AND v IS NOT NULL AND (before IS NULL OR v > before)""")
def v04_change_tick(spark: SparkSession, sf: str) -> DataFrame:
    """A tick for a user whenever a deadline, an ingest or a prediction moves on; twelve idle hours forget what was known."""
    path, stream = arrived(spark, sf, "v04")
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'deadline' WHEN 'view' THEN 'ingest' WHEN 'purchase' THEN 'prediction' END")
    rows = stream.withColumns({"kind": kind, "value": F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("k") * 600})
    ticks = states.in_order(rows, "user_id", ["kind", "value"], "ts long, id long, deadline long, ingest long, prediction long", states.change_tick(["deadline", "ingest", "prediction"]), ["ts"], "12 hours")
    return jobs.drain(ticks, path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@plans(f"""WITH {IN_ORDER}, m AS (SELECT *, value < 50 AS empty FROM s), n AS (SELECT *, sum(CASE WHEN empty THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, session ORDER BY ms, id) AS run FROM m),
r AS (SELECT *, row_number() OVER w AS place, first_value(ms) OVER w AS first_at FROM n WHERE empty WINDOW w AS (PARTITION BY user_id, session, run ORDER BY ms, id))
SELECT user_id, make_timestamp(ms * 1000) AS ts, id, make_timestamp(first_at * 1000) AS first_ts FROM r WHERE place = 3""")
def v07_silent_stream(spark: SparkSession, sf: str) -> DataFrame:
    """An event in the stream when a source has been empty three times in a row, whatever the order of arrival."""
    path, stream = arrived(spark, sf, "v07")
    found = states.in_order(stream.withColumn("empty", F.col("value") < 50), "user_id", ["empty"], "ts long, id long, first_ts long", states.silent(), ["ts", "first_ts"], "12 hours")
    return jobs.drain(found, path).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"))


@plans("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS first FROM events), w AS (SELECT e.user_id, w.start, e.value FROM events e, (SELECT DATE '2023-12-20' + CAST(unnest(range(0, 60)) AS INT) AS start) w WHERE CAST(e.ts AS DATE) >= w.start AND CAST(e.ts AS DATE) < w.start + 7)
SELECT user_id, CAST(start AS TIMESTAMP) AS start, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY 1, 2""")
def v05_look_back(spark: SparkSession, sf: str) -> DataFrame:
    """Sums over the seven days up to each day, as sliding windows of a stream that are written, and freed, when the watermark passes them."""
    path, stream = arrived(spark, sf, "v05")
    found = jobs.drain(jobs.windowed(stream, "ts", ["user_id"], "value", "7 days", "1 day"), path)
    return found.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 6).alias("total"))


@plans("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def v06_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Provisional rows that later ones correct: a stream that updates a table part by part."""
    path = _checkpoint(spark, f"v06-{uuid.uuid4().hex}")
    stream = jobs.read_parquet_stream(spark, sf, "events.parquet").select("user_id", "event_type", "value", "event_id")
    jobs.upsert_batches(stream, f"{path}/table", ["user_id", "event_type"], "event_id", f"{path}/progress", parts=8).awaitTermination()
    return jobs.current(spark, f"{path}/table").select("user_id", "event_type", "value", "event_id")
