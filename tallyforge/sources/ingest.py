"""Connectors: what a source gives as raw documents, how they are archived once, parsed, parsed again, and accounted for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash

#: Payloads of more bytes than this are stored beside the archive, by their hash.
INLINE_BYTES = 64 * 1024


@dataclass(frozen=True)
class Connector:
    """A source: ``fetch`` gives (external, payload) rows, ``parse`` turns archived rows into rows of its own, or is missing."""

    name: str
    fetch: Callable[[SparkSession, str], DataFrame]
    parse: Callable[[DataFrame], DataFrame] | None = None
    version: int = 1


REGISTRY: dict[str, Connector] = {}


def connector(name: str, version: int = 1, parse: Callable[[DataFrame], DataFrame] | None = None):
    """Register a fetch function as a source."""

    def register(fetch: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        REGISTRY[name] = Connector(name, fetch, parse, version)
        return fetch

    return register


def archived(source: Connector, spark: SparkSession, folder: str) -> DataFrame:
    """(source, external, hash, payload, parser_version) of each distinct payload of a source."""
    raw = source.fetch(spark, folder).withColumns({"source": F.lit(source.name), "hash": content_hash(F.col("payload"))})
    rows = raw.groupBy("source", "hash").agg(F.min_by(F.struct("external", "payload"), "external").alias("r"))
    return rows.select("source", "r.external", "hash", "r.payload", F.lit(source.version).alias("parser_version"))


def new_or_stale(fetched: DataFrame, archive: DataFrame) -> DataFrame:
    """Fetched rows that the archive doesn't have, or has by an older parser or with a failure."""
    done = archive.filter("status = 'ok'").select("source", "hash", F.col("parser_version").alias("__done"))
    both = fetched.join(done, ["source", "hash"], "left")
    return both.filter(F.col("__done").isNull() | (F.col("__done") < F.col("parser_version"))).drop("__done")


def run_report(archived_rows: DataFrame, parsed: DataFrame | None) -> DataFrame:
    """(source, n_docs, n_rows, status) of one run: empty without documents, partial where some gave no row."""
    docs = archived_rows.groupBy("source").agg(F.count("*").alias("n_docs"))
    if parsed is None:
        return docs.select("source", "n_docs", F.lit(0).cast("long").alias("n_rows"), F.lit("archived").alias("status"))
    rows = parsed.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_distinct("external").alias("__given"))
    joined = docs.join(rows, "source", "left").withColumns({"n_rows": F.coalesce("n_rows", F.lit(0)), "__given": F.coalesce("__given", F.lit(0))})
    status = F.when(F.col("n_rows") == 0, "empty").when(F.col("__given") < F.col("n_docs"), "partial").otherwise("ok")
    return joined.select("source", "n_docs", "n_rows", status.alias("status"))


def split_blobs(docs: DataFrame, key: str, payload: str, inline_bytes: int = INLINE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, blobs): short payloads stay in their rows, longer ones are stored once each by their hash."""
    size, ref = F.octet_length(payload), F.sha2(F.col(payload), 256)
    small = F.coalesce(size <= inline_bytes, F.lit(True))
    rows = docs.select(key, F.when(small, F.col(payload)).alias("inline"), F.when(~small, ref).alias("blob"))
    blobs = docs.filter(~small).select(ref.alias("blob"), F.col(payload).alias("payload")).dropDuplicates(["blob"])
    return rows, blobs


def load_payloads(rows: DataFrame, blobs: DataFrame, key: str) -> DataFrame:
    """The inverse of ``split_blobs``: (key, payload).

    Rows with their payload inside meet no blob, so their payloads aren't shuffled.
    """
    apart = rows.filter(F.col("blob").isNotNull()).join(blobs, "blob", "left").select(key, "payload")
    return rows.filter(F.col("blob").isNull()).select(key, F.col("inline").alias("payload")).unionByName(apart)


def source_health(runs: DataFrame, source: str, started: list[str], status: str, rows: str, ok: list[str]) -> DataFrame:
    """The last run of each source, when it last was well, and how many runs have failed or been empty since."""
    at = F.struct(*started)
    well = F.col(status).isin(*ok)
    last_well = F.max(F.when(well, at)).over(Window.partitionBy(source))
    marked = runs.withColumns({"__at": at, "__since": last_well.isNull() | (at > last_well)})
    agg = marked.groupBy(source).agg(F.max_by(F.struct(status, rows), "__at").alias("r"), F.count_if(F.col("__since")).alias("failures"), F.max(F.when(well, F.col(started[0]))).alias("last_well"))
    return agg.select(source, f"r.{status}", f"r.{rows}", "failures", "last_well")


def silent_runs(runs: DataFrame, source: str, order: list[str], empty: str, least: int) -> DataFrame:
    """(source, first, n): stretches of at least ``least`` empty runs in a row."""
    w = Window.partitionBy(source).orderBy(*order)
    marked = runs.withColumn("__group", F.sum(F.when(F.col(empty), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs_of = marked.filter(F.col(empty)).groupBy(source, "__group").agg(F.min(order[0]).alias("first"), F.count("*").alias("n"))
    return runs_of.filter(F.col("n") >= least).select(source, "first", "n")
