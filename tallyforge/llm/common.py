"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; a temporary folder is made only where that is unset
    and all runs on one machine, as in tests. On a cluster without that setting this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyforge-"))
        set_dir = spark.sparkContext.getCheckpointDir()
    return set_dir.rstrip("/")


def write_table(df: DataFrame, name: str, **options: str) -> str:
    """Write ``df`` as a table in the shared folder and return its path."""
    path = f"{shared_dir(df.sparkSession)}/tallyforge-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it in the shared folder and read it back."""
    path = write_table(df, name)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and nothing reads any more."""
    for frame in frames:
        delete_path(spark, frame.written_to)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit words so that every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded_words(n: int, seed: int) -> np.ndarray:
    """``n`` well-mixed 64-bit words that depend on ``seed`` alone."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


def utf8_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column without a copy; nulls have length 0."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), ends.astype(np.int64)
