"""Archives as data sources and sinks, and batches of several tables, on the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder
from ..sources import archive_source, batches
from ..sources.seasons import read_seasons, voted
from .base import Plans, table

plans = Plans()


@plans("""SELECT source, count(*) AS n, min(doc_id) AS first_id, CAST(sum(length(text)) AS BIGINT) AS letters FROM documents WHERE source IN ('src1', 'src3', 'src13') GROUP BY 1""")
def u02_archive_source(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written to an archive and read back by source; the condition goes to the files."""
    archive_source.register(spark)
    folder = shared_folder(spark, "archive")
    docs = table(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("external"), F.lit(None).cast("timestamp").alias("ts"), F.col("text").alias("payload"))
    docs.write.format("tallyforge_archive").mode("append").save(folder)
    found = spark.read.format("tallyforge_archive").load(folder).filter(F.col("source").isin("src1", "src3", "src13"))
    return found.groupBy("source").agg(F.count("*").alias("n"), F.min(F.col("external").cast("long")).alias("first_id"), F.sum(F.length("payload")).alias("letters"))


@plans("""SELECT event_type AS source, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2""")
def s24_stream_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as a stream from one archive and written to another, then counted from a day on."""
    archive_source.register(spark)
    first, second, checkpoint = (shared_folder(spark, name) for name in ("archive", "archive", "stream"))
    events = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("external"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("payload"))
    events.write.format("tallyforge_archive").mode("append").save(first)
    stream = spark.readStream.format("tallyforge_archive").load(first)
    stream.writeStream.format("tallyforge_archive").option("path", second).option("stream", "copy").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.format("tallyforge_archive").load(second).filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp"))
    return found.groupBy("source", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@plans("""WITH e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS b FROM events)
SELECT user_id, CAST(min(b) AS BIGINT) AS batch, count(*) AS n_facts, round(sum(value), 6) AS total FROM e GROUP BY 1""")
def u05_deferred_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches of events: facts, and the users whom no batch before had, which can only be told from the tables themselves."""
    folder = shared_folder(spark, "batches")
    events = table(spark, sf, "events").withColumn("b", F.expr("CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END"))

    def new_users(tables: batches.Tables) -> dict[str, DataFrame]:
        users, known = tables("facts").select("user_id").distinct(), tables("users")
        return {"users": users if known is None else users.join(known, "user_id", "left_anti")}

    for number in range(3):
        batches.commit_batch(spark, folder, number, {"facts": events.filter(F.col("b") == number).select("event_id", "user_id", "value")}, [new_users])
    facts = batches.read_table(spark, folder, "facts").groupBy("user_id").agg(F.count("*").alias("n_facts"), F.round(F.sum("value"), 6).alias("total"))
    return batches.read_table(spark, folder, "users").join(facts, "user_id").select("user_id", "batch", "n_facts", "total")


def season_files(spark: SparkSession, sf: str) -> str:
    """Lines of orders as season files: three generations of columns, some values that aren't numbers, and cells beyond the header."""
    folder = shared_folder(spark, "seasons")
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).withColumn("year", F.year("o_orderdate"))
    minutes = F.when(F.col("l_partkey") % 50 == 0, "n/a").otherwise(F.format_string("%.1f", "l_quantity"))
    wrong = F.when(F.col("l_linenumber") >= 4, 1).otherwise(0)
    text = {"element": F.col("l_suppkey"), "fixture": F.col("l_orderkey"), "line": F.col("l_linenumber"), "minutes": minutes, "home_goals": F.col("l_orderkey") % 5 + wrong, "team": F.concat(F.lit('club, "'), (F.col("l_suppkey") % 9).cast("string"), F.lit('"')), "influence": F.col("l_tax")}
    generations = [("year < 1996", ["line", "element", "fixture", "minutes", "home_goals"]), ("year between 1996 and 1998", ["element", "fixture", "line", "mins", "home_goals", "team"]), ("year > 1998", ["team", "influence", "element", "minutes", "line", "fixture", "home_goals"])]
    for number, (years, names) in enumerate(generations):
        chosen = rows.filter(years).select(*(text["minutes" if n == "mins" else n].cast("string").alias(n) for n in names), "year")
        chosen.write.option("header", True).option("escape", '"').partitionBy("year").csv(f"{folder}/{number}")
    return folder


SEASON_COLUMNS = {"element": "int", "fixture": "long", "line": "int", "minutes": "int", "home_goals": "int", "team": "string"}


def seasons_read(spark: SparkSession, sf: str) -> DataFrame:
    return read_seasons(spark, season_files(spark, sf), SEASON_COLUMNS, "element", {"minutes": ["mins"]})


SEASON_SQL = """WITH r AS (SELECT l_suppkey AS element, l_orderkey AS fixture, l_linenumber AS line, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS minutes, CAST(l_orderkey % 5 + CASE WHEN l_linenumber >= 4 THEN 1 ELSE 0 END AS INTEGER) AS home_goals,
CASE WHEN year(o_orderdate) >= 1996 THEN 'club, "' || l_suppkey % 9 || '"' END AS team, l_partkey % 50 = 0 AS bad, year(o_orderdate) > 1998 AS late FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


@plans(SEASON_SQL + " SELECT element, fixture, line, minutes, home_goals, team, (bad OR late) AS has_rescued, CASE WHEN bad THEN 'n/a' END AS bad_minutes FROM r")
def s08_season_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of several seasons with differing columns in one read; what doesn't fit is rescued."""
    rows = seasons_read(spark, sf)
    return rows.select(*SEASON_COLUMNS, F.col("rescued").isNotNull().alias("has_rescued"), F.get_json_object("rescued", "$.minutes").alias("bad_minutes"))


@plans(SEASON_SQL + """, v AS (SELECT fixture, home_goals, count(*) AS n FROM r GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY fixture ORDER BY n DESC, home_goals) AS rn, sum(n) OVER (PARTITION BY fixture) AS n_rows FROM v)
SELECT fixture, home_goals, CAST(n_rows AS BIGINT) AS n_rows, round(n / n_rows, 9) AS agreement FROM w WHERE rn = 1""")
def s08_voted_fixtures(spark: SparkSession, sf: str) -> DataFrame:
    """Fixtures rebuilt from players' rows, which don't all agree on the score."""
    return voted(seasons_read(spark, sf), ["fixture"], ["home_goals"]).withColumn("agreement", F.round("agreement", 9))
