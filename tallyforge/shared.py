"""Tables that a job writes for itself in the folder that the driver and all executors share, and sides small enough to broadcast."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that is broadcast at most, and bytes that a row of such a side is taken to have.
BROADCAST_ROWS = 200_000
#: Narrow rows of a part that one task groups, about.
PART_ROWS = 250_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyforge-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/tallyforge-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, which cuts its lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def forget(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete tables (or folders) that nothing reads any more."""
    for t in tables:
        where = spark._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.written_to)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, which are counted; else as it is, for a shuffled join.

    For narrow sides (keys and numbers) only.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def parts_for(df: DataFrame, rows: int = PART_ROWS) -> int:
    """Shuffle partitions for ``df``, whose rows are counted: about ``rows`` in each, and not fewer than the session has."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-df.count() // rows))
