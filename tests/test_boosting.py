"""Boosting over histograms: constraints, early stop, calibration, importance, and versions with their provenance."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import boosting as B
from tallyforge.operators import model_store as V
from tallyforge.shared import shared_folder


def table(spark, n=1500, seed=3):
    rng = np.random.default_rng(seed)
    a, b, noise = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    three = np.digitize(a + 0.3 * rng.normal(size=n), [-0.6, 0.6])
    two = (rng.random(n) < 1 / (1 + np.exp(-(2 * a - 1.5 * b + 0.8 * a * b)))).astype(int)
    rows = [(i, None if i % 37 == 0 else float(a[i]), float("nan") if i % 41 == 0 else float(b[i]), float(noise[i]), int(three[i]), None if i % 97 == 0 else int(two[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, a double, b double, noise double, three int, two int")


@pytest.fixture(scope="module")
def binary(spark):
    rows = table(spark)
    return rows, B.fit(rows, ["a", "b", "noise"], "two", 2, F.col("id") % 4 == 0, monotone={"a": 1, "b": -1}, rounds=24, patience=4)


def test_two_classes_with_constraints(spark, binary):
    rows, model = binary
    assert 3 < model.metrics["rounds"] <= 24 and model.metrics["loss"] < 0.5 and model.metrics["ece"] < 0.08
    got = B.scored(rows, model).filter("id % 4 = 0 and two is not null").select("two", F.col("p")[1].alias("p")).toPandas()
    loss = -np.log(np.where(got.two == 1, got.p, 1 - got.p)).mean()
    assert loss == pytest.approx(model.metrics["loss"], abs=1e-9)
    # on a grid the probability only rises with a and only falls with b, whatever the others are
    steps = [float(x) for x in np.linspace(-3, 3, 25)]
    grid = spark.createDataFrame([(x, y, z) for x in steps for y in steps for z in (-1.0, 1.0)], "a double, b double, noise double")
    p = np.array([r.p[1] for r in B.scored(grid, model).collect()]).reshape(25, 25, 2)
    assert (np.diff(p, axis=0) >= -1e-12).all() and (np.diff(p, axis=1) <= 1e-12).all() and p.max() - p.min() > 0.6


def test_without_the_constraint_the_grid_can_fall(spark, binary):
    rows, _ = binary
    flipped = B.fit(rows, ["a", "b", "noise"], "two", 2, F.lit(False), monotone={"a": -1}, rounds=3)
    assert "a" not in dict(B.importance(flipped)) and flipped.metrics == {"rounds": 3}


def test_three_classes(spark):
    rows = table(spark, 900, 5)
    model = B.fit(rows, ["a", "b", "noise"], "three", 3, F.col("id") % 5 == 0, monotone={"a": {0: -1, 2: 1}}, rounds=12, patience=3)
    got = B.scored(rows, model).filter("id % 5 = 0").select("three", "p").toPandas()
    p = np.stack(got.p)
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == got.three).mean() > 0.75
    assert B.importance(model)[0][0] == "a" and sum(g for _, g in B.importance(model)) == pytest.approx(1)
    again = B.scored(rows, B.Model.from_json(model.to_json())).filter("id % 5 = 0").select("p").toPandas()
    assert np.allclose(np.stack(again.p), p)


def test_a_fit_ends_when_the_holdout_gets_worse(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, float(rng.normal()), int(rng.integers(2))) for i in range(400)], "id int, x double, y int")
    assert B.fit(rows, ["x"], "y", 2, F.col("id") % 2 == 0, rounds=40, patience=2).metrics["rounds"] < 10
    with pytest.raises(ValueError, match="no labelled rows"):
        B.fit(rows.limit(0), ["x"], "y", 2, F.lit(False))


def test_text_may_not_dominate(binary):
    _, model = binary
    names = [f for f, _ in B.importance(model)]
    assert set(names[:2]) == {"a", "b"}
    B.refuse_text_dominance(model, {"noise"}, 2)
    with pytest.raises(B.TextDominates, match="b among the first 3"):
        B.refuse_text_dominance(model, {"b"})


def test_versions_and_provenance(spark, binary):
    rows, model = binary
    folder = shared_folder(spark, "models")
    fits = []

    def fit():
        fits.append(1)
        return model, ["w1", "w2"], ["w3"]

    assert V.active(spark, folder, "m") is None
    assert V.active_or_fit(spark, folder, "m", fit)[0] == 1 and V.active_or_fit(spark, folder, "m", fit)[0] == 1 and len(fits) == 1
    V.save(spark, folder, "m", model, ["w1"], ["w2"], False)
    assert V.active(spark, folder, "m")[0] == 1
    seen = []

    def on_all(rounds):
        seen.append(rounds)
        return B.fit(rows, ["a", "b"], "two", 2, F.lit(False), rounds=2)

    assert V.refit_on_all(spark, folder, "m", 1, on_all) == 3
    last = V.versions(spark, folder).filter("version = 3").first()
    assert seen == [model.metrics["rounds"]] and last.trained_on == ["w1", "w2", "w3"] and last.holdout == ["w3"] and last.refit_of == 1
    version, refit = V.active(spark, folder, "m")
    assert version == 3 and refit.metrics == model.metrics and len(refit.trees) == 2
    with pytest.raises(ValueError, match="no version 9"):
        V.refit_on_all(spark, folder, "m", 9, on_all)
