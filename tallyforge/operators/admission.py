"""Near-duplicate admission in time order: a document is admitted unless an admitted one of the days before is nearly the same.

Whether a document is admitted depends on those before it, so documents go in blocks of bounded size, in order of time. Those of a
block are compared with the admitted ones of the days before it, in tiles by brute force over many tasks; what is near one
is dropped at once, and the rest of the block is decided in order by one task. Near pairs are never rows: the comparisons
are as many as the documents times those admitted in a look-back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import forget, shared_folder, written

#: Documents of a block, and of one of its tiles.
BLOCK, TILE = 32_768, 2048
#: Documents of a tile that are compared at once.
STEP = 64
PLACED = "pos long, at long, until long, h long, old boolean"


def _first_near(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """For each of a tile's documents the first admitted one of the other tile that is near and in its look-back, if there is one."""
    for batch in batches:
        for k in range(batch.num_rows):
            pos, at, h, ends, admitted, known = (batch.column(i)[k].values.to_numpy(zero_copy_only=False) for i in range(6))
            order = np.argsort(admitted)
            ends, admitted, known = ends[order], admitted[order], known[order]
            for low in range(0, len(h), STEP):
                part = slice(low, low + STEP)
                near = (np.bitwise_count(h[part, None] ^ known[None, :]) <= most) & (ends[None, :] > at[part, None])
                hit = np.flatnonzero(near.any(axis=1))
                yield pa.record_batch({"pos": pos[part][hit], "first": admitted[near[hit].argmax(axis=1)]})


def _decide(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A block's documents in order, first null: those that are near no admitted one so far are admitted, others get the first such. Those that
    have a first already, and old ones, stay as they are."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    pos, at, until, h, old, first = (table[c].to_numpy() for c in ("pos", "at", "until", "h", "old", "known"))
    open_ = np.isnan(first) if first.dtype.kind == "f" else np.zeros(len(pos), bool)
    out = table["known"].to_pylist()
    known, ends, places, n = np.empty(len(pos), h.dtype), np.empty(len(pos), until.dtype), np.empty(len(pos), np.int64), 0
    for i in np.flatnonzero(open_ | old):
        if not old[i]:
            near = (np.bitwise_count(known[:n] ^ h[i]) <= most) & (ends[:n] > at[i])
            if near.any():
                out[i] = int(places[near.argmax()])
                continue
        known[n], ends[n], places[n] = h[i], until[i], pos[i]
        n += 1
    yield pa.record_batch([*(table[c].combine_chunks() for c in ("pos", "at", "until", "h", "old")), pa.array(out, pa.int64())], names=["pos", "at", "until", "h", "old", "first"])


def _micros(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Times as numbers, in whatever zone."""
    for batch in batches:
        yield pa.record_batch([c.cast(pa.int64()) if name in ("at", "until") else c for name, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)


def admissions(docs: DataFrame, key: str, ts: str, bits: str, days: int = 7, most: int = 14, width: int = 64, standing: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(key, ts, bits, admitted, first_id) of each document.

    Documents go in order of time, then key. One is dropped if an admitted document less than ``days`` days before it has a hash that
    differs in at most ``most`` bits; first_id is the earliest of these, and null for admitted documents. Documents without a hash
    or a time are near nothing and admitted. Keys are unique.

    ``standing`` is the answer for documents that came before, in an earlier call: what lies before the earliest new document stands, all from
    there on is decided again. So documents that come late, in whatever batches, give the answer of one batch; a key that is already
    known keeps its first row. Hashes have ``width`` bits; all 64 are compared. ``block`` bounds what is decided at once.
    """
    spark = docs.sparkSession
    fresh = docs.select(F.col(key).alias("k"), F.col(ts).alias("t"), F.col(bits).alias("h"))
    made, before, since = [], None, None
    if standing is not None:
        old = standing.select(F.col(key).alias("k"), F.col(ts).alias("t"), F.col(bits).alias("h"), "admitted", "first_id")
        fresh = fresh.join(old.select("k"), "k", "left_anti")
        since = fresh.filter(F.col("t").isNotNull() & F.col("h").isNotNull()).agg(F.min("t")).first()[0]
        stands = F.lit(True) if since is None else F.col("t").isNull() | F.col("h").isNull() | (F.col("t") < F.lit(since))
        before = written(old.filter(stands), "stands")
        fresh = fresh.unionByName(old.filter(~stands).select("k", "t", "h"))
        made.append(before)
    rows = written(fresh, "fresh")
    made.append(rows)
    near_days = F.expr(f"INTERVAL {days} DAYS")
    usable = rows.filter(F.col("t").isNotNull() & F.col("h").isNotNull()).select("k", "t", "h", F.lit(False).alias("old"))
    if before is not None and since is not None:
        reach = before.filter(F.col("admitted") & F.col("t").isNotNull() & F.col("h").isNotNull() & (F.col("t") + near_days > F.lit(since)))
        usable = usable.unionByName(reach.select("k", "t", "h", F.lit(True).alias("old")))
    # places in order of time; a place's upper bits are its part's number
    time = F.col("t") if dict(usable.dtypes)["t"].startswith("timestamp") else F.col("t").cast("timestamp_ntz")
    parts = usable.repartitionByRange(max(1, -(-4 * usable.count() // block)), "t", "k").sortWithinPartitions("t", "k")
    parts = parts.select(F.monotonically_increasing_id().alias("pos"), time.alias("at"), (time + near_days).alias("until"), F.col("h").cast("long").alias("h"), "old", "k")
    placed = written(parts.mapInArrow(_micros, f"{PLACED}, k {dict(rows.dtypes)['k']}"), "placed")
    made.append(placed)
    blocks: list[list] = []
    for n, low, high, start, end in placed.groupBy(F.shiftright("pos", 33)).agg(F.count("*"), F.min("pos").alias("low"), F.max("pos"), F.min("at"), F.max("until")).orderBy("low").select("count(1)", "low", "max(pos)", "min(at)", "max(until)").collect():
        if blocks and blocks[-1][0] + n <= block:
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1], high, blocks[-1][3], max(blocks[-1][4], end)]
        else:
            blocks.append([n, low, high, start, end])
    folder, schema = shared_folder(spark, "decided"), f"{PLACED}, first long, block int"
    made.append(folder)
    for i, (n, low, high, start, _) in enumerate(blocks):
        here = placed.filter(F.col("pos").between(low, high)).select("pos", "at", "until", "h", "old")
        earlier = [j for j in range(i) if blocks[j][4] > start]
        if earlier:
            known = spark.read.schema(schema).parquet(*(f"{folder}/{j}" for j in earlier)).filter(F.col("first").isNull() & (F.col("until") > start))
            pool = known.groupBy("block").agg(F.collect_list(F.struct("until", "pos", "h")).alias("y")).select("block", F.col("y.until").alias("ends"), F.col("y.pos").alias("admitted"), F.col("y.h").alias("known"))
            tiles = here.filter(~F.col("old")).groupBy(F.pmod(F.xxhash64("pos"), F.lit(-(-n // TILE))).alias("tile")).agg(F.collect_list(F.struct("pos", "at", "h")).alias("x"))
            tiles = tiles.select("tile", "x.pos", "x.at", "x.h", F.explode(F.lit(earlier)).alias("block")).join(pool, "block")
            met = tiles.repartition("tile", "block").select("pos", "at", "h", "ends", "admitted", "known").mapInArrow(partial(_first_near, most=most), "pos long, first long")
            here = here.join(met.groupBy("pos").agg(F.min("first").alias("known")), "pos", "left")
        else:
            here = here.withColumn("known", F.lit(None).cast("long"))
        decided = here.repartition(1).sortWithinPartitions("pos").mapInArrow(partial(_decide, most=most), f"{PLACED}, first long")
        decided.withColumn("block", F.lit(i)).write.parquet(f"{folder}/{i}")
    keys = placed.select("pos", "k")
    firsts = spark.read.schema(schema).parquet(*(f"{folder}/{i}" for i in range(len(blocks)))) if blocks else keys.filter("false").withColumn("first", F.col("pos"))
    firsts = firsts.filter(F.col("first").isNotNull()).select("pos", "first")
    dropped = firsts.join(keys, "pos").select("k", "first").join(keys.select(F.col("pos").alias("first"), F.col("k").alias("first_id")), "first").select("k", "first_id")
    decided = rows.join(dropped, "k", "left").select("k", "t", "h", F.col("first_id").isNull().alias("admitted"), "first_id")
    out = written(decided if before is None else before.unionByName(decided), "admissions")
    forget(spark, *made)
    return out.select(F.col("k").alias(key), F.col("t").alias(ts), F.col("h").alias(bits), "admitted", "first_id")
