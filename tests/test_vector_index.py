"""The vector index against all pairs in numpy, and how much of it a search reads."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators.vector_index import Search, build_index
from tallyforge.shared import shared_folder

SCHEMA = "k long, e array<float>, cosine string"


def clustered(seed, n=600, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(15, dim)) * 3
    points = (centres[rng.integers(15, size=n)] + 0.25 * rng.normal(size=(n, dim))) * rng.uniform(0.1, 50, (n, 1))
    rows = [(i, [float(x) for x in p.astype(np.float32)], None) for i, p in enumerate(points)]
    return rows + [(n, rows[3][1], None), (n + 1, [x * 2 for x in rows[3][1]], None)]


def nearest(rows, queries, k, not_itself):
    keys = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for key, q in queries:
        q = np.array(q, np.float64)
        c = np.round(x @ (q / np.linalg.norm(q)), 9)
        order = [i for i in np.lexsort((keys, -c)) if not (not_itself and keys[i] == key)][:k]
        out |= {(key, int(keys[i]), round(float(c[i]), 6), j + 1) for j, i in enumerate(order)}
    return out


@pytest.mark.parametrize(("not_itself", "k"), [(True, 5), (False, 40)])
def test_searches_are_exact(spark, not_itself, k):
    rows = clustered(4)
    odd = [(9000, None, None), (9001, [0.0] * 12, None), (9002, [float("nan")] * 12, None), (None, rows[0][1], None)]
    folder = shared_folder(spark, "vectors")
    build_index(spark.createDataFrame(rows + odd, SCHEMA).repartition(3), folder, "k", "e", lists=20)
    asked = [r for r in rows if r[0] % 37 == 0 or r[0] >= 600]
    search = Search(spark, folder, spark.createDataFrame(asked + odd, SCHEMA), "k", "e", k, not_itself)
    got = {(r.q, r.key, round(r.cosine, 6), r.rn) for r in search.run().collect()}
    assert got == nearest(rows, [(r[0], r[1]) for r in asked], k, not_itself)
    if k == 5:
        read, all_of = search.lists.agg(F.sum(F.when(F.col("read"), F.col("n"))), F.sum("n")).first()
        assert read < 0.5 * all_of
    assert spark.read.parquet(f"{folder}/points").count() == len(rows)


def test_a_small_sample_still_indexes_every_row(spark):
    rows = clustered(7, 400)
    folder = shared_folder(spark, "vectors")
    build_index(spark.createDataFrame(rows, SCHEMA), folder, "k", "e", sample=40)
    search = Search(spark, folder, spark.createDataFrame(rows[:9], SCHEMA), "k", "e", 3)
    assert {(r.q, r.key, round(r.cosine, 6), r.rn) for r in search.run().collect()} == nearest(rows, [(r[0], r[1]) for r in rows[:9]], 3, False)


def test_empty_and_uneven_tables(spark):
    folder = shared_folder(spark, "vectors")
    none = spark.createDataFrame([], SCHEMA)
    build_index(none, folder, "k", "e")
    assert Search(spark, folder, none, "k", "e", 3).run().count() == 0
    with pytest.raises(ValueError, match="2 to 3"):
        build_index(spark.createDataFrame([(1, [1.0, 2.0], None), (2, [1.0, 2.0, 3.0], None)], SCHEMA), shared_folder(spark, "vectors"), "k", "e")


def test_nearest_by_tiles(spark, monkeypatch):
    """Copies, ties, vectors without a direction and several tiles, as by the cosines of all pairs; no row for each pair leaves a tile."""
    from tallyforge.operators import vector_index as V
    from tallyforge.operators.joins import cosine

    rows = [(k, e) for k, e, _ in clustered(6, 300)] + [(400 + i, [1.0] * 12) for i in range(40)] + [(500, None), (501, [0.0] * 12), (502, [float("nan")] * 12), (503, [None] * 12), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "k long, e array<float>")
    monkeypatch.setattr(V, "TILE", 100)
    monkeypatch.setattr(V, "ASKED", 20)
    asked = df.filter("k % 10 = 0 or k > 499")
    got = V.nearest_by_tiles(df, asked, "k", "e", 4).collect()
    pairs = df.join(asked.select(F.col("k").alias("q"), F.col("e").alias("u")), F.col("k") != F.col("q"))
    pairs = pairs.withColumn("c", F.round(cosine(F.col("u"), F.col("e")), 9))
    want = pairs.withColumn("rn", F.row_number().over(V.Window.partitionBy("q").orderBy(F.desc("c"), "k"))).filter("rn <= 4").select("q", "k", "c", "rn").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str(tuple(r)) for r in want)
    usable = df.filter("k < 499")
    plan = V.nearest_by_tiles(usable, usable, "k", "e", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan or "mapInArrow" in plan or "_nearest_of_tile" in plan


def test_lists_are_searched_in_tiles(spark, monkeypatch):
    """Several tiles of a list and blocks of queries give what one gives; about k rows a query leave a tile, not a row for each point."""
    from tallyforge.operators import vector_index as V

    for name, value in (("TILE", 16), ("ASKED", 5), ("STEP", 2)):
        monkeypatch.setattr(V, name, value)
    rows = clustered(8, 300)
    folder = shared_folder(spark, "vectors")
    build_index(spark.createDataFrame(rows, SCHEMA), folder, "k", "e", lists=4)
    asked = [r for r in rows if r[0] % 23 == 0 or r[0] >= 300]
    search = Search(spark, folder, spark.createDataFrame(asked, SCHEMA), "k", "e", 3, True)
    every = search.queries.select("q", F.explode(F.array(*map(F.lit, range(4)))).alias("list")).selectExpr("q", "list", "0D AS to_centre", "CAST(NULL AS DOUBLE) AS kth")
    assert search._met(every).count() <= len(asked) * (3 + 1) * (300 // 16 + 8)
    got = {(r.q, r.key, round(r.cosine, 6), r.rn) for r in search.run().collect()}
    assert got == nearest(rows, [(r[0], r[1]) for r in asked], 3, True)
