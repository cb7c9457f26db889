"""Joins beyond the plain equi-join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import broadcast_if_small, written


def update_join(target: DataFrame, source: DataFrame, keys: list[str], fill: list[str], overwrite: list[str]) -> DataFrame:
    """``target`` with columns taken from ``source``: those of ``fill`` only where null, those of ``overwrite`` always
    where the source has a value. Source keys must be unique."""
    renamed = source.select(*keys, *(F.col(c).alias(f"__new_{c}") for c in [*fill, *overwrite]))
    joined = target.join(renamed, keys, "left")
    changes = {c: F.coalesce(F.col(c), F.col(f"__new_{c}")) for c in fill} | {c: F.coalesce(F.col(f"__new_{c}"), F.col(c)) for c in overwrite}
    return joined.withColumns(changes).select(target.columns)


def two_sides(df: DataFrame, home: dict[str, Column], away: dict[str, Column], side: str = "is_home") -> DataFrame:
    """Each row as two, seen from either side; both dicts name the same new columns."""
    keep = [c for c in df.columns if c not in home]
    row = lambda of, first: F.struct(F.lit(first).alias(side), *(c.alias(n) for n, c in of.items()))
    return df.select(*keep, F.inline(F.array(row(home, True), row(away, False))))


def near_hashes(left: DataFrame, right: DataFrame, most: int = 14, width: int = 64) -> DataFrame:
    """(h, g, distance) of the distinct hashes (column h) of either side that differ in at most ``most`` bits, equal ones included.

    The ``width`` low bits are cut into bands, a third as many as most + 1 and two at least. Hashes so near differ in at most two bits of some band, so
    each left hash looks up its bands with up to two bits flipped (395 keys for 14 of 60 bits) and each right hash stands
    under its bands as they are (5 keys). For evenly spread hashes one pair of ten meets at 14 of 60 bits, and fewer at lower distances.
    """
    bands = max(2, -(-(most + 1) // 3))
    edges = [round(width * i / bands) for i in range(bands + 1)]
    part = lambda c, a, b: F.shiftrightunsigned(c, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))

    def keys(k: int, a: int, b: int) -> Column:
        ones = [1 << i for i in range(b - a)]
        flips = sorted({0, *ones, *(x | y for x in ones for y in ones)} if most >= 2 else {0, *ones} if most else {0})
        return F.transform(F.lit(flips).cast("array<bigint>"), lambda m: F.struct(F.lit(k).alias("band"), part("h", a, b).bitwiseXOR(m).alias("part")))

    looked = F.concat(*(keys(k, a, b) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]))))
    probes = left.select("h").distinct().select("h", F.explode(looked).alias("x")).select("h", "x.band", "x.part")
    stands = right.select(F.col("h").alias("g")).distinct().select("g", F.posexplode(F.array(*(part("g", a, b) for a, b in zip(edges[:-1], edges[1:])))).alias("band", "part"))
    distance = F.bit_count(F.col("h").bitwiseXOR(F.col("g")))
    return probes.join(stands, ["band", "part"]).filter(distance <= most).select("h", "g", distance.alias("distance")).distinct()


#: Rows of a tile of ``hamming_pairs``, and of one step in it.
TILE, STEP = 2048, 64


def _near_in_tiles(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Pairs of two tiles' rows that differ in at most ``most`` bits; of a tile with itself each pair once.

    A tile is collected once for either side, its rows in any order, so a tile with itself is the left list alone.
    """
    for batch in batches:
        for k in range(batch.num_rows):
            one, two, left, right, a, b = (batch.column(i)[k] for i in range(6))
            if one == two:
                right, b = left, a
            x, y = (h.values.to_numpy(zero_copy_only=False).view(np.uint64) for h in (left, right))
            for low in range(0, len(x), STEP):
                distance = np.bitwise_count(x[low : low + STEP, None] ^ y[None, :])
                near = distance <= most
                i, j = np.nonzero(np.triu(near, low + 1) if one == two else near)
                yield pa.record_batch({"a": a.values.take(pa.array(i + low)), "b": b.values.take(pa.array(j)), "distance": pa.array(distance[i, j].astype(np.int32))})


def hamming_pairs(df: DataFrame, key: str, bits: str, most: int = 14, width: int = 64, tile: int = TILE) -> DataFrame:
    """Pairs (key less than other) whose hashes differ in at most ``most`` bits. Keys are unique; nulls pair with nothing.

    Where so many bits may differ, a tenth of all pairs would meet in some band (see ``near_hashes``) and be rows of a join. Tiles of
    ``tile`` rows are compared by brute force instead: only tiles are shuffled, and only pairs that are near become rows.
    The comparisons grow with the square of the rows, as the pairs themselves do.
    """
    rows = df.select(F.col(key).alias("a"), F.col(bits).cast("long").alias("h")).filter("a is not null and h is not null").distinct()
    n = rows.count()
    tiles = max(1, -(-n // tile))
    packed = rows.groupBy(F.pmod(F.xxhash64("a", "h"), F.lit(tiles)).cast("int").alias("t")).agg(F.collect_list(F.struct("h", "a")).alias("x"))
    packed = packed.select("t", F.col("x.h").alias("h"), F.col("x.a").alias("a"))
    first = packed.select(F.col("t").alias("one"), F.col("h").alias("left"), F.col("a").alias("a"), F.explode(F.sequence("t", F.lit(tiles - 1))).alias("two"))
    second = packed.select(F.col("t").alias("two"), F.col("h").alias("right"), F.col("a").alias("b"))
    met = first.join(second, "two").select("one", "two", "left", "right", "a", "b").repartition(min(2000, tiles * (tiles + 1) // 2), "one", "two")
    kind = dict(rows.dtypes)["a"]
    near = met.mapInArrow(partial(_near_in_tiles, most=most), f"a {kind}, b {kind}, distance int")
    return near.filter("a <> b").select(F.least("a", "b").alias(key), F.greatest("a", "b").alias(f"other_{key}"), "distance")


def contained(needles: DataFrame, texts: DataFrame, needle_key: str, needle: str, text_key: str, text: str, words: int = 5) -> DataFrame:
    """(needle, text) keys where the needle occurs in the text as a substring.

    Pieces between single spaces or newlines that aren't the needle's first or last are whole in any text that holds it.
    Candidates share the first ``words`` of these as an n-gram, or the first two where there are fewer; only keys and hashes of
    n-grams meet in that join, which few needles' n-grams are broadcast for, and the texts of the few that met are looked at afterwards. Needles without two inner pieces are tried
    on every text. The substring test decides.
    """
    pieces = lambda c: F.transform(F.split(c, "[ \n]"), lambda w: F.xxhash64(w))
    asked = needles.select(F.col(needle_key).alias("__n"), F.col(needle).alias("__needle"), pieces(F.col(needle)).alias("__pieces")).withColumn("__inner", F.size("__pieces") - 2)
    seen = texts.select(F.col(text_key).alias("__t"), F.col(text).alias("__text"))
    split = seen.select("__t", pieces(F.col("__text")).alias("__pieces"))

    def anchored(width: int, chosen: DataFrame) -> DataFrame:
        first = chosen.select("__n", F.xxhash64(F.slice("__pieces", 2, width)).alias("__gram"))
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("__pieces") - width + 1))
        grams = F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.slice("__pieces", i, width))))
        return split.select("__t", F.explode(grams).alias("__gram")).join(broadcast_if_small(first), "__gram").select("__t", "__n")

    least = min(2, words)
    met = anchored(words, asked.filter(F.col("__inner") >= words))
    if words > least:
        met = met.unionByName(anchored(least, asked.filter((F.col("__inner") >= least) & (F.col("__inner") < words))))
    # few met as a rule: with their needles they go to where the texts lie
    met = written(met.distinct(), "met")
    both = seen.join(broadcast_if_small(met), "__t").join(asked.select("__n", "__needle"), "__n").filter(F.contains("__text", "__needle"))
    short = asked.filter(F.col("__inner") < least).select("__n", "__needle").join(seen, F.contains("__text", "__needle"))
    return both.select("__n", "__t").unionByName(short.select("__n", "__t")).select(F.col("__n").alias(needle_key), F.col("__t").alias(text_key)).distinct()


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def remap_ids(df: DataFrame, mapping: DataFrame, column: str, old: str = "old", new: str = "canon") -> DataFrame:
    """``df`` with ids of merged entities replaced by the one that stays."""
    moves = mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return df.join(moves, F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``target`` with rows inserted or replaced; of several changes to a key the last in ``order`` counts."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in target.columns if c not in keys)), F.struct(*order)).alias("__row")).select(*keys, "__row.*")
    return target.join(last, keys, "left_anti").unionByName(last.select(target.columns))


def insert_or_ignore(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(changes.join(target, keys, "left_anti").dropDuplicates(keys).select(target.columns))
