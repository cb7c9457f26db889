"""Line dedup by overlapping three-line windows that repeat anywhere in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialize

WINDOW = 3


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """A row for each run of ``window`` consecutive lines, with a 128-bit hash of it."""
    for batch in batches:
        hashes, sizes = [], []
        for text in batch.column(2):
            lines = [hashlib.blake2b(x, digest_size=16).digest() for x in (text.as_py() or "").encode().split(b"\n")]
            n = max(0, len(lines) - window + 1)
            hashes += [hashlib.blake2b(b"".join(lines[i : i + window]), digest_size=16).digest() for i in range(n)]
            sizes.append(n)
        rows = np.repeat(np.arange(batch.num_rows), sizes)
        pos = np.arange(len(rows)) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes) if sizes else rows
        words = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
        yield pa.record_batch({"doc_id": batch.column(0).take(pa.array(rows)), "text_key": batch.column(1).take(pa.array(rows)), "pos": pa.array(pos, pa.int32()), "a": pa.array(words[:, 0].copy()), "b": pa.array(words[:, 1].copy())})


def repeated_positions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, pos) of each window (by its first line, from 0) that occurred before.

    Occurrences are ordered by doc_id, then text_key (a hash of the text), then place; the first one is left out.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), F.col(text).alias("text"))
    rows = materialize(rows.mapInArrow(partial(_windows, window=window), "doc_id long, text_key long, pos int, a long, b long"), "windows")
    first = rows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "text_key", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    # written, so that the join is between plain shuffles and a very common window's rows can be dealt to several tasks
    again = rows.join(materialize(first, "first"), ["a", "b"])
    return again.filter(~F.struct("doc_id", "text_key", "pos").eqNullSafe(F.col("first"))).select("doc_id", "text_key", "pos")


def _cut(batches: Iterator[pa.RecordBatch], text: str, window: int, names: list[str], counts: list[str]) -> Iterator[pa.RecordBatch]:
    """Texts without their covered lines; the last column has the places of later windows, or null."""
    for batch in batches:
        texts, places = batch.column(batch.schema.get_field_index(text)), batch.column(batch.num_columns - 1)
        n_lines = pc.if_else(pc.is_valid(texts), pc.add(pc.count_substring(texts.fill_null(""), "\n"), 1), 0)
        hit = pc.is_valid(places)
        removed, changed = np.zeros(batch.num_rows, np.int64), []
        for i in np.flatnonzero(hit.to_numpy(zero_copy_only=False)):
            covered = {p + k for p in places[i].as_py() for k in range(window)}
            lines = texts[i].as_py().split("\n")
            removed[i] = len(covered)
            changed.append("\n".join([x for k, x in enumerate(lines) if k not in covered]))
        new = {text: pc.replace_with_mask(texts, hit, pa.array(changed, texts.type)), **dict(zip(counts, (n_lines.cast(pa.int64()), pa.array(removed)), strict=False))}
        yield pa.record_batch([new[c] if c in new else batch.column(batch.schema.get_field_index(c)) for c in names], names=names)


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_counts: bool = True) -> DataFrame:
    """``docs`` with the lines of later occurrences of repeated windows taken out of ``text``.

    Adds n_lines and n_removed (replacing columns of these names), or nothing without ``with_counts``. A line goes when any later occurrence
    covers it. Texts of fewer than ``window`` lines stay as they are, null too (0 lines). Rows repeated with
    the same doc_id and text count as one document for positions; both keep what it keeps. Rows whose lines all go
    stay, with an empty text. An empty table gives no rows.
    """
    places, of_doc, of_text, here, this = (free_name(docs, f"__{name}") for name in ("gone", "doc", "key", "id", "of"))
    gone = repeated_positions(docs, doc_id, text, window).groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias(places))
    gone = gone.select(F.col("doc_id").alias(of_doc), F.col("text_key").alias(of_text), places)
    keys = docs.withColumns({here: F.col(doc_id).cast("long"), this: F.xxhash64(F.coalesce(text, F.lit("")))})
    both = keys.join(gone, F.col(here).eqNullSafe(F.col(of_doc)) & (F.col(this) == F.col(of_text)), "left").select(*docs.columns, places)
    counts = ["n_lines", "n_removed"] if with_counts else []
    schema = T.StructType([f for f in docs.schema if f.name not in counts] + [T.StructField(c, T.LongType()) for c in counts])
    return both.mapInArrow(partial(_cut, text=text, window=window, names=schema.names, counts=counts), schema)
