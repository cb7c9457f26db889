"""Vectors as a few bytes: a codebook for each part of the dimensions, searched by partial distances.

Components are scaled to integers, so that codebooks, codes and errors are exact and don't depend on how the rows are dealt
out. Each round assigns in tasks and adds up, in each task, the parts of an entry; only these sums are shuffled,
and the driver holds no more than the codebooks, 256 entries of a vector's length.

The search for a part's nearest entry takes the dimensions in descending variance of the codebook. A mask drops entries
once their accumulated distance strictly exceeds the best complete distance so far, which is known from the entry that
leads after the first dimension and is improved when a quarter and half of the dimensions are done.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors whose pairs with all entries are held at a time.
BLOCK = 1024
#: Scaled components stay below this, so that distances and sums are exact in 64 bits.
LARGEST = 1 << 24


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector the nearest entry (the lower of two), its squared distance, and how many terms were added up."""
    order = np.argsort(-book.var(axis=0), kind="stable")
    vectors, book = np.ascontiguousarray(vectors[:, order]), np.ascontiguousarray(book[:, order])
    index, distance, added, width = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64), 0, book.shape[1]
    for at in range(0, len(vectors), BLOCK) if width else ():
        x = vectors[at : at + BLOCK]
        first = (x[:, :1] - book[None, :, 0]) ** 2
        added += first.size
        lead = first.argmin(axis=1)
        best = ((x - book[lead]) ** 2).sum(axis=1)
        i, e = np.nonzero(first <= best[:, None])
        total = first[i, e]
        for d in range(1, width):
            total += (x[i, d] - book[e, d]) ** 2
            added += len(i)
            if d + 1 in (width // 4, width // 2):
                begins = np.flatnonzero(np.diff(i, prepend=-1))
                low = np.minimum.reduceat(total, begins)
                leads = np.flatnonzero(total == low[i])
                leads = leads[np.flatnonzero(np.diff(i[leads], prepend=-1))]
                best = np.minimum(best, ((x - book[e[leads]]) ** 2).sum(axis=1))
            alive = total <= best[i]
            i, e, total = i[alive], e[alive], total[alive]
        low = np.minimum.reduceat(total, np.flatnonzero(np.diff(i, prepend=-1)))
        hits = np.flatnonzero(total == low[i])
        hits = hits[np.flatnonzero(np.diff(i[hits], prepend=-1))]
        index[at : at + BLOCK], distance[at : at + BLOCK] = e[hits], total[hits]
    return index, distance, added


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """For each entry that a task's rows are assigned to: how many, and then the sums of their components."""
    sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
    for batch in batches:
        if not batch.num_rows:
            continue
        for p, x in enumerate(np.split(_matrix(batch.column(0)), len(books), axis=1)):
            index, _, _ = nearest(x, books[p])
            np.add.at(sums[p], index, x)
            counts[p] += np.bincount(index, minlength=len(books[p]))
    for p, (s, n) in enumerate(zip(sums, counts, strict=True)):
        used = np.flatnonzero(n)
        yield pa.record_batch({"part": pa.array([p] * len(used), pa.int32()), "entry": pa.array(used, pa.int32()), "sums": pa.array(list(np.column_stack([n, s])[used]), pa.list_(pa.int64()))})


def _codes(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        error, digits = np.zeros(batch.num_rows, np.int64), []
        for x, book in zip(np.split(_matrix(batch.column(2)), len(books), axis=1), books, strict=True):
            index, distance, _ = nearest(x, book)
            error += distance
            digits.append(index)
        codes = np.stack(digits, axis=1).astype(np.uint8)
        yield pa.record_batch({"vec_id": batch.column(0), "label": batch.column(1), "code": pa.array([bytes(c).hex() for c in codes], pa.string()), "error": pa.array(error)})


def scaled_vectors(vectors: DataFrame, vec_id: str, embedding: str, label: str, parts: int, scale: int) -> DataFrame:
    """(vec_id, label, v) of the rows whose vector holds finite components only, scaled to integers and of one length.

    Shorter vectors count as followed by zeros up to the longest one, rounded up to a multiple of ``parts``. A scaled
    component of 2^24 or more is an error, as distances would leave 64 bits.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    too_large = F.raise_error(F.lit(f"a component times {scale} isn't below {LARGEST}")).cast("long")
    whole = F.transform("x", lambda x: F.when(F.abs(x) * scale < LARGEST, F.floor(x * scale).cast("long")).otherwise(too_large))
    rows = rows.filter(F.col("x").isNotNull() & F.coalesce(finite, F.lit(False)))
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    width = -(-max(longest, 1) // parts) * parts
    return rows.select("vec_id", "label", F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("v"))


def train_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part: the first ``entries`` vectors by id, then ``rounds`` rounds of assigning and taking floored means."""
    first = [r.v for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    if not first:
        return []
    books = np.split(np.array(first, np.int64), parts, axis=1)
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(partial(_sums, books=books), "part int, entry int, sums array<long>")
        totals = sums.select("part", "entry", F.posexplode("sums").alias("pos", "s")).groupBy("part", "entry", "pos").agg(F.sum("s").alias("s"))
        totals = totals.groupBy("part", "entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda t: t["s"]).alias("sums"))
        books = [b.copy() for b in books]
        for r in totals.collect():
            books[r.part][r.entry] = np.array(r.sums[1:], np.int64) // r.sums[0]
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of each vector that isn't dropped, and the codebooks.

    Vectors that are null or hold null or non-finite components are dropped. Equal ids are ordered by their vectors and null
    ids come last where the codebooks start; repeated rows count each time. With fewer than ``entries`` vectors the
    codebooks have as many entries. Empty vectors count as zeros. An empty table gives no rows and no codebooks.
    """
    if entries > 256:
        raise ValueError("a code has one byte for each part")
    rows = materialize(scaled_vectors(vectors, vec_id, embedding, label, parts, scale), "scaled")
    books = train_codebooks(rows, parts, entries, rounds)
    schema = [f for f in rows.schema if f.name != "v"]
    codes = rows.mapInArrow(partial(_codes, books=books), "vec_id long, label " + schema[1].dataType.simpleString() + ", code string, error long")
    codes = materialize(codes, "codes")
    discard(vectors.sparkSession, rows)
    return codes, books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the sum of errors over equal labels; nulls are one label."""
    of = materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label_errors")
    return codes.join(of, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
