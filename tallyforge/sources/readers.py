"""Readers and parsers for nested JSON, lenient CSV, HTML tables and layered sources, and an idempotent archive."""

from __future__ import annotations

from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import content_hash


def read_csv_lenient(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A CSV with a header where values that don't fit their type are null; columns not in the file are null."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*((F.col(c).try_cast("double").try_cast(t) if t in ("int", "long") else F.col(c).try_cast(t)).alias(c) if c in raw.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))


def parse_json(docs: DataFrame, payload: str, ddl: str, name: str = "parsed") -> DataFrame:
    """``docs`` with the payload parsed by a schema; what doesn't parse is null."""
    return docs.withColumn(name, F.from_json(payload, ddl))


def odds_rows(feed: DataFrame, payload: str) -> DataFrame:
    """One row for each outcome of events x bookmakers x markets, with the implied and the margin-free probability."""
    ddl = "struct<id: string, bookmakers: array<struct<key: string, markets: array<struct<key: string, outcomes: array<struct<name: string, price: double>>>>>>>"
    parsed = feed.select(F.from_json(payload, f"array<{ddl}>").alias("events"))
    rows = parsed.select(F.inline("events")).select("id", F.inline("bookmakers")).withColumnRenamed("key", "bookmaker").select("id", "bookmaker", F.inline("markets")).withColumnRenamed("key", "market")
    total = F.aggregate("outcomes", F.lit(0.0), lambda s, o: s + F.coalesce(F.try_divide(F.lit(1.0), o.price), F.lit(0.0)))
    return rows.withColumn("total", total).select("id", "bookmaker", "market", "total", F.inline("outcomes")).withColumn("implied", F.try_divide(F.lit(1.0), "price")).withColumn("fair", F.try_divide("implied", "total")).drop("total")


class _Rows(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows, self.row, self.cell = [], None, None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            self.rows.append(self.row)
            self.row = None


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def html_rows(pages: pd.Series) -> pd.Series:
    """Cells of all table rows of a page."""

    def rows(page):
        parser = _Rows()
        parser.feed(page or "")
        return parser.rows

    return pages.map(rows)


def first_that_has(layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first layer, by order, that has any for a key."""
    ranked = reduce(lambda a, b: a.unionByName(b), [df.withColumn("__layer", F.lit(i)) for i, df in enumerate(layers)])
    best = ranked.groupBy(*keys).agg(F.min("__layer").alias("__best"))
    return ranked.join(best, keys).filter("__layer = __best").drop("__layer", "__best")


def archive(docs: DataFrame, source: str, external: str, payload: str, order: str) -> DataFrame:
    """Each distinct content of a source once: its hash, how often it was seen, and the one that it supersedes.

    A new content of the same external id points to the one before it.
    """
    hashed = docs.withColumn("hash", content_hash(F.col(payload)))
    seen = hashed.groupBy(source, "hash").agg(F.count("*").alias("seen_count"), F.min(order).alias("first_seen"), F.min_by(external, order).alias(external))
    from pyspark.sql import Window

    return seen.withColumn("supersedes", F.lag("first_seen").over(Window.partitionBy(source, external).orderBy("first_seen")))


def status_of(text: Column) -> tuple[Column, Column]:
    """Availability from free text: a status word and a chance in percent."""
    low = F.lower(text)
    percent = F.regexp_extract(text, r"(\d{1,3})\s*%", 1).try_cast("int")
    status = F.when(low.rlike("suspend|ban"), "suspended").when(low.rlike("out|injur"), "out").when(low.rlike("doubt") | percent.between(1, 99), "doubtful").otherwise("available")
    return status, F.coalesce(percent, F.when(status.isin("out", "suspended"), 0).when(status == "doubtful", 50).otherwise(100))
