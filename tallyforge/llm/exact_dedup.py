"""Exact dedup by content-defined chunk recipes.

Each text is cut where a rolling hash of the last 32 bytes says so, hence at the same places in equal
texts. A chunk's identifier is a 128-bit digest; all distinct (identifier, bytes) pairs meet once to
verify that no identifier stands for two contents. A text is then its ordered list of identifiers, and
equal lists mean equal texts, so long texts are not moved again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, seeded_words, utf8_views

GEAR = (seeded_words(256, 9) >> np.uint64(32)).astype(np.uint32)
LEAST, MEAN_BITS, MOST = 1024, 12, 32768
#: Digests of several contents that the driver takes; with more of them, digests of twice the length are used.
MOST_UNSAFE = 10_000


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text; an empty text has none."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    ends, last = [], 0
    for cut in np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1:
        while cut - last > MOST:
            last += MOST
            ends.append(last)
        if cut - last >= LEAST:
            last = int(cut)
            ends.append(last)
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return ends + [n] if n > last else ends


def _chunks(column: pa.Array) -> Iterator[list[bytes]]:
    data, at = utf8_views(column)
    for a, b in zip(at[:-1], at[1:], strict=True):
        text = data[a:b]
        cuts = [0, *chunk_ends(text)]
        yield [text[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.sha256(chunk).digest()[:size]


def _chunk_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {c for chunks in _chunks(batch.column(0)) for c in chunks}
        yield pa.record_batch({"digest": pa.array([_digest(c, size) for c in found], pa.binary()), "chunk": pa.array(list(found), pa.binary())})


def _recipe_rows(batches: Iterator[pa.RecordBatch], size: int, unsafe: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        recipes, shas = [], []
        for chunks in _chunks(batch.column(1)):
            sha = hashlib.sha256()
            for c in chunks:
                sha.update(c)
            ids = [_digest(c, size) for c in chunks]
            recipes.append([c if d in unsafe else d for c, d in zip(chunks, ids, strict=True)] if unsafe else ids)
            shas.append(sha.hexdigest())
        yield pa.record_batch({"doc_id": batch.column(0), "recipe": pa.array(recipes, pa.list_(pa.binary())), "text_sha256": pa.array(shas, pa.string())})


def unverified_digests(docs: DataFrame, text: str = "text", digest_bytes: int = 16) -> DataFrame:
    """Digests that stand for more than one chunk content (none is to be expected at 128 bits)."""
    chunks = docs.select(text).mapInArrow(partial(_chunk_rows, size=digest_bytes), "digest binary, chunk binary").distinct()
    return chunks.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_bytes: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; null counts as empty, and all empty texts form one group.
    Of equal texts the largest doc_id stays. A row that is repeated with its doc_id counts in group_size each
    time, and each repeat of the largest id is marked kept. Null doc_ids are smaller than any other. Other columns
    are not read. An empty table gives no rows. Chunks whose digest isn't unique take part with their bytes.
    """
    while True:
        found = unverified_digests(docs, text, digest_bytes).limit(MOST_UNSAFE + 1).collect()
        if len(found) <= MOST_UNSAFE:
            break
        digest_bytes *= 2
    unsafe = frozenset(bytes(r.digest) for r in found)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.mapInArrow(partial(_recipe_rows, size=digest_bytes, unsafe=unsafe), "doc_id long, recipe array<binary>, text_sha256 string")
    rows = materialize(rows, "recipes")
    groups = rows.groupBy("recipe").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).filter("n > 1")
    # written, so that the join is between plain shuffles and a very large group's rows can be dealt to several tasks
    groups = materialize(groups, "groups")
    return rows.join(groups, "recipe", "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("last")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("last"))).alias("kept"),
        "text_sha256",
    )
