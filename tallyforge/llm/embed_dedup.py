"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Equal vectors of a label collapse first. Those that remain are dealt into tiles, and each pair of tiles of a label
meets once: vectors are scaled to unit length and quantised to int8, the tile product of the integers is exact in
floating point, and the norm of each vector's quantisation error bounds how far a product can be from the
cosine. Only pairs that could reach the threshold are computed again in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import connected_components

#: Most vectors and most components of a tile; vectors whose products are made at a time.
TILE, TILE_WORDS, BLOCK, THRESHOLD = 4096, 1 << 18, 1024, 0.93
#: Allows for rounding in the double arithmetic of the bounds themselves.
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and the norms of the errors of unit vectors."""
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    codes = np.rint(unit / scale)
    return codes.astype(np.int8), scale[:, 0], np.linalg.norm(unit - codes * scale, axis=1)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, exactly, so that the largest component of each is about 1 and no norm over- or underflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def linked_pairs(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs whose cosine in double precision reaches the threshold, and how many pairs were recomputed."""
    left, right = scaled(left), scaled(right)
    norms = [np.linalg.norm(x, axis=1) for x in (left, right)]
    (qa, sa, ea), (qb, sb, eb) = (quantise(x / n[:, None]) for x, n in zip((left, right), norms, strict=True))
    exact = np.float32 if 127 * 127 * left.shape[1] < 1 << 24 else np.float64
    found_i, found_j, recomputed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for a in range(0, len(left), BLOCK):
        for b in range(0, len(right), BLOCK):
            at, to = slice(a, a + BLOCK), slice(b, b + BLOCK)
            product = (qa[at].astype(exact) @ qb[to].astype(exact).T) * sa[at, None] * sb[None, to]
            i, j = np.nonzero(product + (ea[at, None] + (1 + ea[at, None]) * eb[None, to] + SLACK) >= threshold)
            i, j = i + a, j + b
            recomputed += len(i)
            for k in range(0, len(i), 1 << 16):
                x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                keep = np.einsum("ij,ij->i", left[x], right[y]) / (norms[0][x] * norms[1][y]) >= threshold
                found_i.append(x[keep])
                found_j.append(y[keep])
    return np.concatenate(found_i), np.concatenate(found_j), recomputed


def pack_vectors(vectors: np.ndarray) -> bytes:
    """A tile's vectors as 32-bit floats where these hold them exactly, else as doubles; the first byte tells which."""
    with np.errstate(over="ignore"):
        small = vectors.astype(np.float32)
    return b"4" + small.tobytes() if (small == vectors).all() else b"8" + vectors.tobytes()


def unpack_vectors(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if raw[:1] == b"4" else np.float64, offset=1).reshape(n, -1).astype(np.float64)


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a tile (the input is sorted by it) become one row with packed columns."""
    key, held = None, []

    def packed() -> pa.RecordBatch:
        label, tile, dim = key
        vectors = np.concatenate([v for *_, v in held])
        return pa.record_batch({"label": pa.array([label], pa.string()), "tile": pa.array([tile], pa.int32()), "dim": pa.array([dim], pa.int32()), "nodes": pa.array([np.concatenate([r for r, *_ in held]).tobytes()], pa.binary()), "counts": pa.array([np.concatenate([c for _, c, _ in held]).tobytes()], pa.binary()), "vectors": pa.array([pack_vectors(vectors)], pa.binary())})

    for batch in batches:
        keys = list(zip(*(batch.column(n).to_pylist() for n in ("label", "tile", "dim")), strict=True))
        starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if held and keys[a] != key:
                yield packed()
                held = []
            key, part = keys[a], batch.slice(a, b - a)
            values = part.column(part.schema.get_field_index("vector")).flatten().to_numpy(zero_copy_only=False)
            held.append((part.column("node").to_numpy(), part.column("n").to_numpy(), values.reshape(b - a, -1)))
    if held:
        yield packed()


def _products(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            nodes, counts = (np.frombuffer(row[k], np.int64) for k in ("nodes", "counts"))
            vectors = unpack_vectors(row["vectors"], len(nodes))
            if row["tile"] == row["tile2"]:
                i, j, _ = linked_pairs(vectors, vectors, threshold)
                i, j = i[i < j], j[i < j]
            else:
                nodes2, counts2 = (np.frombuffer(row[k], np.int64) for k in ("nodes2", "counts2"))
                i, j, _ = linked_pairs(vectors, unpack_vectors(row["vectors2"], len(nodes2)), threshold)
                j = j + len(nodes)
                nodes, counts = np.concatenate([nodes, nodes2]), np.concatenate([counts, counts2])
            links = np.zeros(len(nodes), np.int64)
            np.add.at(links, i, counts[j])
            np.add.at(links, j, counts[i])
            root = local_roots(i, j, nodes)
            some = np.flatnonzero(links)
            yield pa.record_batch({"node": nodes[some], "links": links[some], "root": root[some]})


def local_roots(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each node the smallest id of its component under the edges (i, j)."""
    root = ids.copy()
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (root == before).all():
            break
    return root


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors``.

    Two vectors link when their labels are equal and not null, their lengths are equal, and their cosine in double
    precision is at least ``threshold``. Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing and are their own component, as does a row with a null id (whose component is null).
    Repeated rows count as further vectors, and rows that share an id link by their own vectors. An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    key = [F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(3), "vector").alias("k2")]
    same = ["label", "k1", "k2"]
    groups = rows.filter(valid).select("*", *key).groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    groups = materialize(groups.select("*", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("node")), "vectors")
    tiles = groups.groupBy("label", "dim").agg(F.ceil(F.greatest(F.count("*") / tile, F.sum("dim") / TILE_WORDS)).cast("int").alias("tiles"))
    dealt = groups.join(tiles, ["label", "dim"]).withColumn("tile", F.pmod("k1", F.col("tiles")).cast("int")).select("label", "tile", "dim", "node", "n", "vector")
    packed = dealt.repartition("label", "dim", "tile").sortWithinPartitions("label", "dim", "tile", "node").mapInArrow(_tile, "label string, tile int, dim int, nodes binary, counts binary, vectors binary")
    packed = materialize(packed, "tiles")
    names = packed.select("label", "dim", "tile")
    other = names.withColumnRenamed("tile", "tile2")
    pairs = names.join(other, ["label", "dim"]).filter("tile <= tile2")
    second = packed.select("label", "dim", F.col("tile").alias("tile2"), *(F.col(c).alias(c + "2") for c in ("nodes", "counts", "vectors")))
    met = pairs.join(packed, ["label", "dim", "tile"]).join(second, ["label", "dim", "tile2"])
    found = materialize(met.mapInArrow(partial(_products, threshold=threshold), "node long, links long, root long"), "links")
    discard(vectors.sparkSession, packed)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = materialize(connected_components(found, "node", "root"), "components")
    lowest = parts.join(groups.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("lowest"))
    known = groups.select(*same, "node", "rep", "n").join(links, "node", "left").join(parts.join(lowest, "component").select("node", "lowest"), "node", "left")
    out = rows.withColumn("label", F.when(valid, F.col("label"))).select("vec_id", "label", *key).join(known, same, "left")
    component = F.coalesce("lowest", "rep", "vec_id")
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
