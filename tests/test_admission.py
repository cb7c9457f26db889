"""Hamming look-ups and admission in time order, against loops over all pairs."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest

from tallyforge.operators.admission import admissions
from tallyforge.operators.joins import _near_in_tiles, hamming_pairs, near_hashes

SCHEMA = "k long, t timestamp_ntz, h long"
START = datetime(2024, 3, 1)


def folded(rows, days=7, most=14):
    out, kept = {}, []
    for k, t, h in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[1], r[0])):
        hits = [a for a in kept if a[0] > t - timedelta(days=days) and ((a[2] ^ h) & (1 << 64) - 1).bit_count() <= most]
        if hits:
            out[k] = (False, min(hits)[1])
        else:
            kept.append((t, k, h))
            out[k] = (True, None)
    return out | {k: (True, None) for k, t, h in rows if t is None or h is None}


def story(seed, n=220, width=60):
    rng = random.Random(seed)
    bases = [rng.getrandbits(width) for _ in range(8)]
    rows = []
    for i in range(n):
        h = rng.choice(bases) if rng.random() < 0.8 else rng.getrandbits(width)
        for _ in range(rng.choice([0, 0, 3, 7, 10, 15])):
            h ^= 1 << rng.randrange(width)
        rows.append((i, START + timedelta(hours=rng.randrange(24 * 25)), h))
    rows += [(1000 + i, START + timedelta(days=i * 3.5), bases[0]) for i in range(8)]
    return [*rows, (2000, None, bases[0]), (2001, START, None), (2002, START, bases[1]), (2003, START, bases[1]), (2004, START + timedelta(days=7), bases[1])]


def answer(df):
    return {r.k: (r.admitted, r.first_id) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_admissions(spark, seed):
    rows = story(seed)
    got = answer(admissions(spark.createDataFrame(rows, SCHEMA).repartition(3), "k", "t", "h", width=60))
    assert got == folded(rows)
    assert sum(not a for a, _ in got.values()) > 30 and got[2003] == (False, 2002)


def test_late_batches_give_the_answer_of_one(spark):
    rows = story(3, 120)
    rng = random.Random(4)
    rng.shuffle(rows)
    standing = None
    for part in (rows[:70], rows[70:75], [], rows[60:]):
        standing = admissions(spark.createDataFrame(part, SCHEMA), "k", "t", "h", width=60, standing=standing)
    assert answer(standing) == folded(rows)


def test_admissions_of_copies_need_no_pairs(spark):
    """A thousand copies in a week are dropped by one aggregate; with shorter look-back the first of each day stays."""
    rows = [(i, START + timedelta(minutes=10 * i), 5) for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sum(a for a, _ in answer(admissions(df, "k", "t", "h")).values()) == 1
    assert answer(admissions(df, "k", "t", "h", days=1)) == folded(rows, 1)
    assert admissions(df.limit(0), "k", "t", "h").count() == 0


@pytest.mark.parametrize(("most", "width"), [(0, 64), (1, 64), (3, 60), (14, 60), (14, 64), (20, 64)])
def test_near_hashes(spark, most, width):
    rng = random.Random(most)
    base = [rng.getrandbits(width) for _ in range(12)]
    hashes = base + [b ^ sum(1 << i for i in rng.sample(range(width), rng.randrange(most + 3))) for b in base for _ in range(8)]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(signed)], "k long, h long")
    got = {(r.h, r.g, r.distance) for r in near_hashes(df, df, most, width).collect()}
    far = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert got == {(a, b, far(a, b)) for a in signed for b in signed if far(a, b) <= most}
    pairs = {(r.k, r.other_k) for r in hamming_pairs(df, "k", "h", most, width).collect()}
    assert pairs == {(i, j) for i, a in enumerate(signed) for j, b in enumerate(signed) if i < j and far(a, b) <= most}


def test_hamming_pairs_are_compared_in_tiles(spark):
    """Pairs within and across tiles, each once, without rows for pairs that only meet in a band."""
    rng = random.Random(4)
    rows = [(k, rng.getrandbits(60) & rng.getrandbits(60)) for k in range(90)] + [(90, None), (91, 5), (92, 5)]
    df = spark.createDataFrame(rows, "k long, h long")
    got = hamming_pairs(df, "k", "h", 20, 60, tile=16)
    want = sorted((a, b, (x ^ y).bit_count()) for a, x in rows for b, y in rows if a < b and None not in (x, y) and (x ^ y).bit_count() <= 20)
    assert want and sorted(map(tuple, got.collect())) == want
    assert "part" not in got._jdf.queryExecution().optimizedPlan().toString().split()


def test_hamming_pairs_of_a_tile_that_was_collected_in_two_orders():
    """Shuffled rows arrive in any order, so both lists of a tile with itself need not agree."""
    row = {"one": [0], "two": [0], "left": [[1, 3, 7]], "right": [[7, 1, 3]], "a": [[10, 11, 12]], "b": [[12, 10, 11]]}
    got = [tuple(r.values()) for batch in _near_in_tiles(iter([pa.RecordBatch.from_pydict(row)]), 1) for r in batch.to_pylist()]
    assert sorted((min(a, b), max(a, b), d) for a, b, d in got) == [(10, 11, 1), (11, 12, 1)]


@pytest.mark.parametrize("block", [1, 30])
def test_admissions_in_small_blocks(spark, block):
    """Documents of many blocks, compared with the admitted ones of those before; late batches too."""
    rows = story(5, 150 if block > 1 else 12)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert answer(admissions(df, "k", "t", "h", width=60, block=block)) == folded(rows)
    standing = admissions(df.filter("k % 3 <> 1"), "k", "t", "h", width=60, block=block)
    assert answer(admissions(df.filter("k % 3 = 1"), "k", "t", "h", width=60, standing=standing, block=block)) == folded(rows)
