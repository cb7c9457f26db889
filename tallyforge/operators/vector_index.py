"""A vector index that gives exact nearest neighbours by cosine: lists around centres, pruned by the triangle inequality.

Centres are fitted on a bounded sample; every vector is in the list of its nearest centre, with its distance to it. Vectors count by direction, as
points of the unit sphere, where the greatest cosine is the least distance. A query reads its nearest lists first, which gives a k-th
distance. No point of a list whose centre is farther than that plus the list's radius can be nearer, so such lists aren't read, nor are
points in the others whose distance to the centre differs by more from the query's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import forget, written
from .asof import top_per_group
from .joins import cosine

#: Rows that centres are fitted on at most (in expectation, chosen by a hash of the key), and rounds of the fit.
SAMPLE, ROUNDS, FIRST_LISTS, SLACK = 20_000, 8, 2, 1e-5
#: Lists at most, unless more are asked for: their centres go to every task.
MOST_LISTS = 4096
#: Vectors and queries of a tile, queries of a product, and what a cosine by matrix product may be off, with the rounding to nine digits on both sides.
TILE, ASKED, STEP, NEAR = 8192, 1024, 128, 1.1e-9


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / size
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _centres(points: np.ndarray, lists: int) -> np.ndarray:
    """Centres by k-means from points as far apart as can be found in their order."""
    chosen, far = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(lists, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
    centres = points[chosen]
    for _ in range(ROUNDS):
        near = (points @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        for i in np.unique(near):
            centres[i] = points[near == i].mean(axis=0)
    return centres


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _assign(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = _unit(_matrix(batch.column(1), batch.num_rows))
        near = (unit @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        away = np.linalg.norm(unit - centres[near], axis=1)
        yield pa.record_batch({"key": batch.column(0), "list": pa.array(near, pa.int32()), "away": pa.array(away), "unit": pa.array(list(unit), pa.list_(pa.float64()))})


def _usable(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("key").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))


def build_index(vectors: DataFrame, folder: str, key: str, embedding: str, lists: int | None = None, sample: int = SAMPLE) -> None:
    """Write the index: a folder of points for each list, and the centres with their lists' radii and sizes.

    Vectors that are null, zero, or hold null or non-finite components aren't indexed; all others are, and have one length. Without
    ``lists`` there are about as many as the square root of the vectors, 4,096 at most.
    """
    spark, rows = vectors.sparkSession, _usable(vectors, key, embedding)
    n, least, most = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} components")
    chosen = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < min(1 << 30, (1 << 30) * sample // max(1, n)))
    points = chosen.orderBy("key", "v").select("v").toArrow()
    centres = _centres(_unit(_matrix(points["v"].combine_chunks(), points.num_rows)), lists or min(MOST_LISTS, max(1, round(n**0.5)))) if points.num_rows else np.zeros((1, most or 1))
    placed = rows.mapInArrow(partial(_assign, centres=centres), "key long, list int, away double, unit array<double>")
    placed.repartition("list").write.partitionBy("list").parquet(f"{folder}/points")
    held = spark.read.schema("key long, away double, list int").parquet(f"{folder}/points") if n else spark.createDataFrame([], "key long, away double, list int")
    of = {r["list"]: r for r in held.groupBy("list").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()}
    spark.createDataFrame([(i, centres[i].tolist(), r.radius, r.n) for i, r in sorted(of.items())], "list int, centre array<double>, radius double, n long").coalesce(1).write.parquet(f"{folder}/centres")


def _to_centres(batches: Iterator[pa.RecordBatch], centres: np.ndarray, lists: list[int], radius: list[float], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """(q, list, radius, n, to_centre) of each query and list."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            units = _matrix(part.column(1), part.num_rows)
            away = np.stack([np.linalg.norm(centres - u, axis=1) for u in units])
            repeat = lambda x: pa.array(np.tile(x, part.num_rows))  # noqa: B023, E731
            yield pa.record_batch({"q": part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), len(lists)))), "list": repeat(np.array(lists, np.int32)), "radius": repeat(np.array(radius, float)), "n": repeat(np.array(sizes, np.int64)), "to_centre": pa.array(away.ravel())})


def _met_in_lists(batches: Iterator[pa.RecordBatch], k: int, not_itself: bool) -> Iterator[pa.RecordBatch]:
    """(q, key, d) of the points of a list that may be among the k nearest of some queries by the rounded cosine, and that the bounds don't leave out."""
    for batch in batches:
        for row in range(batch.num_rows):
            asked, units, to_centre, most, keys, away, points = (batch.column(i)[row].values for i in range(7))
            asked, to_centre, most, keys, away = (x.to_numpy() for x in (asked, to_centre, most, keys, away))
            q, v = (x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for x, n in ((units, len(asked)), (points, len(keys))))
            for low in range(0, len(asked), STEP):
                here = slice(low, low + STEP)
                near = q[here] @ v.T
                near[np.abs(to_centre[here, None] - away[None, :]) > most[here, None]] = -np.inf
                if not_itself:
                    near[asked[here, None] == keys[None, :]] = -np.inf
                least = np.partition(near, -k, axis=1)[:, -k, None] if near.shape[1] > k else np.full((len(near), 1), -2.0)
                i, j = np.nonzero(near >= np.maximum(least - NEAR, -2.0))
                i += low
                for first in range(0, len(i), TILE):
                    at, to = i[first : first + TILE], j[first : first + TILE]
                    d = np.zeros(len(at))
                    for x, y in zip(q[at].T, v[to].T, strict=True):
                        d += (x - y) * (x - y)
                    yield pa.record_batch({"q": asked[at], "key": keys[to], "d": np.sqrt(d)})


class Search:
    """One search for a set of queries; ``lists`` tells afterwards which lists each query read."""

    def __init__(self, spark: SparkSession, folder: str, queries: DataFrame, key: str, embedding: str, k: int, not_itself: bool = False):
        self.spark, self.folder, self.k, self.not_itself = spark, folder, k, not_itself
        self.queries = written(_usable(queries, key, embedding).select(F.col("key").alias("q"), self._unit_of("v").alias("u")), "queries")
        self.asked = self.queries.count()
        self.centres = spark.read.parquet(f"{folder}/centres").orderBy("list").collect()

    @staticmethod
    def _unit_of(v: str) -> Column:
        top = F.array_max(F.transform(v, lambda x: F.abs(x)))
        scaled = F.transform(v, lambda x: x / top)
        return F.transform(scaled, lambda x: x / F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, y: s + y * y)))

    def _met(self, pairs: DataFrame) -> DataFrame:
        """(q, key, distance) of the points of (q, list, to_centre, kth) that the bounds don't leave out and that may be among the k nearest.

        Tiles of a list's points and of the queries that read it are multiplied, and about k rows a query leave a tile.
        """
        points = self.spark.read.schema("key long, away double, unit array<double>, list int").parquet(f"{self.folder}/points")
        parts, blocks = (max(1, -(-n // size)) for n, size in ((max((r.n for r in self.centres), default=0), TILE), (self.asked, ASKED)))
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        tiles = points.groupBy("list", dealt("key", parts).alias("part")).agg(F.collect_list(F.struct("key", "away", "unit")).alias("p"))
        asking = pairs.join(self.queries, "q").withColumn("most", F.coalesce("kth", F.lit(float("inf"))) + SLACK)
        asking = asking.groupBy("list", dealt("q", blocks).alias("block")).agg(F.collect_list(F.struct("q", "u", "to_centre", "most")).alias("a"))
        met = asking.join(tiles, "list").repartition(min(2000, max(1, len(self.centres)) * parts * blocks), "list", "part", "block")
        met = met.select("a.q", "a.u", "a.to_centre", "a.most", "p.key", "p.away", "p.unit")
        return met.mapInArrow(partial(_met_in_lists, k=self.k, not_itself=self.not_itself), "q long, key long, d double")

    def run(self) -> DataFrame:
        """(q, key, cosine, rn): the k nearest of each query, equal cosines (to nine digits) by key."""
        order = Window.partitionBy("q").orderBy("to_centre", "list")
        lists = [r["list"] for r in self.centres]
        known = partial(_to_centres, centres=np.array([r.centre for r in self.centres]), lists=lists, radius=[r.radius for r in self.centres], sizes=[r.n for r in self.centres])
        schema = "q long, list int, radius double, n long, to_centre double"
        pairs = self.queries.select("q", "u").mapInArrow(known, schema) if lists else self.spark.createDataFrame([], schema)
        pairs = written(pairs.withColumn("place", F.row_number().over(order)), "lists")
        begun = written(self._met(pairs.filter(F.col("place") <= FIRST_LISTS).withColumn("kth", F.lit(None).cast("double"))), "near")
        ranked = begun.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy("d")))
        kth = ranked.filter(F.col("rn") == self.k).select("q", F.col("d").alias("kth"))
        self.lists = written(pairs.join(kth, "q", "left").withColumn("read", (F.col("place") <= FIRST_LISTS) | F.col("kth").isNull() | (F.col("to_centre") - F.col("radius") <= F.col("kth") + SLACK)), "lists")
        rest = self._met(self.lists.filter(F.col("read") & (F.col("place") > FIRST_LISTS)))
        cosine = F.round(1 - F.col("d") * F.col("d") / 2, 9)
        both = begun.unionByName(rest).select("q", "key", cosine.alias("cosine"))
        out = written(both.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "key"))).filter(F.col("rn") <= self.k), "found")
        forget(self.spark, pairs, begun, self.queries)
        return out


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b, added up component by component in order, as a fold over arrays does."""
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def _nearest_of_tile(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """For each query of a tile the vectors of the other tile that may be among its k nearest by the rounded cosine, then key."""
    for batch in batches:
        for row in range(batch.num_rows):
            asked, units, keys, points = (batch.column(i)[row].values for i in range(4))
            asked, keys = asked.to_numpy(), keys.to_numpy()
            q, v = (x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for x, n in ((units, len(asked)), (points, len(keys))))
            # of equal vectors those with the k + 1 smallest keys are enough, as one may be the query itself
            order = np.argsort(keys, kind="stable")
            keys, v = keys[order], v[order]
            _, of = np.unique(v, axis=0, return_inverse=True)
            by = np.argsort(of.ravel(), kind="stable")
            group = of.ravel()[by]
            place = np.arange(len(by)) - np.searchsorted(group, group)
            few = np.sort(by[place <= k])
            keys, v = keys[few], v[few]
            near = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
            near[asked[:, None] == keys[None, :]] = -np.inf
            least = np.partition(near, -k, axis=1)[:, -k, None] if near.shape[1] > k else np.full((len(asked), 1), -2.0)
            i, j = np.nonzero(near >= np.maximum(least - NEAR, -2.0))
            yield pa.record_batch({"q": asked[i], "key": keys[j], "cosine": _cosines(q[i], v[j])})


def nearest_by_tiles(vectors: DataFrame, queries: DataFrame, key: str, embedding: str, k: int) -> DataFrame:
    """(q, key, cosine, rn): the k nearest other vectors of each query by brute force, equal cosines (to nine digits) by key.

    Tiles of queries meet tiles of vectors and are multiplied, and a few rows for each query leave a tile; the products grow with queries
    times vectors. Vectors that are null, zero, beyond what squares can hold, or hold null or non-finite components meet all others one by one, with
    what ``cosine`` makes of them, nulls last. All others have one length. Keys are unique; rows without one are left out.
    """
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)) & F.exists("v", lambda x: F.abs(x) > 1e-150)
    whole = [df.select(F.col(key).cast("long").alias("key"), F.col(embedding).cast("array<double>").alias("v")).filter("key is not null") for df in (queries, vectors)]
    usable, others = ([df.filter(c) for df in whole] for c in (F.coalesce(fine, F.lit(False)), ~F.coalesce(fine, F.lit(False))))
    n, least, most = usable[1].agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} components")

    def packed(rows: DataFrame, tiles: int, names: tuple[str, str, str]) -> DataFrame:
        dealt = rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(tiles)).alias(names[0])).agg(F.collect_list(F.struct("key", "v")).alias("x"))
        return dealt.select(names[0], F.col("x.key").alias(names[1]), F.col("x.v").alias(names[2]))

    tiles = [max(1, -(-count // size)) for count, size in ((usable[0].count(), ASKED), (n, TILE))]
    asked, points = packed(usable[0], tiles[0], ("one", "asked", "units")), packed(usable[1], tiles[1], ("two", "keys", "points"))
    met = asked.withColumn("two", F.explode(F.sequence(F.lit(0), F.lit(tiles[1] - 1)))).join(points, "two")
    met = met.repartition(min(2000, tiles[0] * tiles[1]), "one", "two").select("asked", "units", "keys", "points")
    found = met.mapInArrow(partial(_nearest_of_tile, k=k), "q long, key long, cosine double")
    for left, right in ((whole[0], others[1]), (others[0], usable[1])):
        both = left.select(F.col("key").alias("q"), F.col("v").alias("u")).join(right, F.col("q") != F.col("key"))
        found = found.unionByName(both.select("q", "key", cosine(F.col("u"), F.col("v")).alias("cosine")))
    return top_per_group(found.withColumn("cosine", F.round("cosine", 9)), ["q"], [F.desc("cosine"), F.col("key")], k)
