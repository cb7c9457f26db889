"""Structured Streaming: idempotent ingest, windowed counts and a change tick. Windows with watermarks go beyond the
reference behaviour, which only looks back over stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet_stream(spark: SparkSession, folder: str, name: str = "*.parquet", files: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder that have this name, oldest first."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name).parquet(folder)


def ingest_once(stream: DataFrame, ts: str, key: list[str], late: str = "7 days") -> DataFrame:
    """Each key once, however often it arrives within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, ts: str, keys: list[str], value: str, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are left out."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return timed.groupBy(window, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, to Parquet with a checkpoint beside it, and read the result."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/data")


def arrivals(rows: DataFrame, ts: str, key: str, folder: str, chunks: int = 4, jitter: int = 6, ids: tuple[str, ...] = ()) -> None:
    """Write rows as they would arrive: in ``chunks`` files, up to ``jitter`` hours out of order, and a last file with one row of
    key -1 (and -1 in ``ids``) a year later, which lets the watermark pass all others."""
    moved = F.unix_timestamp(F.col(ts).cast("timestamp")) + F.pmod(F.xxhash64(*rows.columns), F.lit(jitter * 3600))
    low, high = rows.agg(F.min(moved), F.max(moved)).first()
    if low is not None:
        for i in range(chunks):
            at = F.floor((moved - low) * chunks / (high - low + 1))
            rows.filter(at == i).coalesce(1).write.mode("append").parquet(folder)
    names = {key, *ids}
    last = [F.lit(-1).cast(t).alias(c) if c in names else F.expr("TIMESTAMP '2100-01-01' + INTERVAL 1 YEAR").cast(t).alias(c) if c == ts else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]
    rows.sparkSession.range(1).select(*last).write.mode("append").parquet(folder)


def current(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The rows of a table that ``upsert_batches`` keeps: of each part the newest batch (earlier than ``before``)."""
    rows = spark.read.parquet(target)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    newest = rows.select("part", "batch").distinct().groupBy("part").agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(newest), ["part", "batch"]).drop("batch")


def upsert_batches(stream: DataFrame, target: str, keys: list[str], order: str, checkpoint: str, parts: int = 64):
    """Merge each micro-batch into a Parquet table: of each key the row with the greatest ``order`` stays.

    Keys are dealt into ``parts``, and a batch writes a new version of the parts that it touches, all others staying as
    they are. It reads only versions of earlier batches, so that a batch that is run again gives the same rows.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        if number:
            rows = rows.unionByName(current(spark, target, number).join(F.broadcast(rows.select("part").distinct()), "part", "left_semi"))
        others = [c for c in batch.columns if c not in keys]
        last = rows.groupBy("part", *keys).agg(F.max_by(F.struct(*others), order).alias("__row")).select("part", *keys, "__row.*")
        last.write.mode("overwrite").partitionBy("part").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
