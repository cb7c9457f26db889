"""Several tables from one batch, all or nothing, with work that is deferred until the batch's rows are there.

A batch writes the rows of each table into a folder of its own. Deferred functions run next: they are given the tables as they will be after
the batch, earlier batches included, and give further rows, such as entities that aren't known yet. Last, the batch's account (table, folder,
rows) is renamed into the log. Tables are read through the log, so a batch that fails anywhere before that leaves nothing to be seen,
and one that is run again with a number that the log has does nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import exists

ACCOUNT = "table string, path string, n_rows long, batch long"
Tables = Callable[[str], DataFrame | None]
Deferred = Callable[[Tables], dict[str, DataFrame]]


def account(spark: SparkSession, folder: str) -> DataFrame:
    """(table, path, n_rows, batch) of all that has been committed."""
    if not exists(spark, f"{folder}/_log"):
        return spark.createDataFrame([], ACCOUNT)
    return spark.read.schema(ACCOUNT).parquet(f"{folder}/_log")


def _union(spark: SparkSession, places: list[tuple[int, str]]) -> DataFrame | None:
    """Rows of several folders with their batch; columns that a folder doesn't have are null."""
    out = None
    for batch, path in places:
        rows = spark.read.parquet(path).withColumn("batch", F.lit(batch).cast("long"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """All committed rows of a table with their batch, or None if there was none."""
    found = account(spark, folder).filter(F.col("table") == table).select("batch", "path").collect()
    return _union(spark, sorted((r.batch, r.path) for r in found))


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of the last batch."""
    order = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def commit_batch(spark: SparkSession, folder: str, batch: int, tables: dict[str, DataFrame], deferred: Iterable[Deferred] = ()) -> bool:
    """Write a batch; False if the log has it already. Tables without rows are in the account with 0 rows."""
    before = account(spark, folder).select("table", "path", "batch").collect()
    if any(r.batch == batch for r in before):
        return False
    places: dict[str, list[tuple[int, str]]] = {}
    for r in sorted(before, key=lambda r: r.batch):
        places.setdefault(r.table, []).append((r.batch, r.path))
    attempt, mine = uuid.uuid4().hex, []

    def write(table: str, rows: DataFrame) -> None:
        path = f"{folder}/{table}/{batch:012d}-{attempt}-{len(mine)}"
        rows.write.parquet(path)
        mine.append((table, path, spark.read.parquet(path).count(), batch))
        places.setdefault(table, []).append((batch, path))

    for table, rows in tables.items():
        write(table, rows)
    for later in deferred:
        for table, rows in later(lambda name: _union(spark, places.get(name, []))).items():
            write(table, rows)
    draft = f"{folder}/_drafts/{attempt}"
    spark.createDataFrame(mine, ACCOUNT).coalesce(1).write.parquet(draft)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{folder}/_log"))
    # the rename puts the account as one file under the batch's name, which fails where there is one already
    part = next(f.getPath() for f in files.listStatus(path(draft)) if f.getPath().getName().endswith(".parquet"))
    if not files.rename(part, path(f"{folder}/_log/{batch:012d}.parquet")):
        return False
    files.delete(path(draft), True)
    return True


def stream_batches(stream: DataFrame, folder: str, checkpoint: str, parse: Callable[[DataFrame], dict[str, DataFrame]], deferred: Iterable[Deferred] = ()):
    """Run a stream over what is there now; each micro-batch is parsed into tables and committed under its number."""

    def write(rows: DataFrame, number: int) -> None:
        kept = rows.persist()
        commit_batch(rows.sparkSession, folder, number, parse(kept), deferred)
        kept.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
