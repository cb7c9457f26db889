"""Order of features, what stands for missing values, and builders that fail alone."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyforge.feature_graph import Graph
from tallyforge.operators import windows as W
from tallyforge.player_features import player_graph


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, 1, "a", 2.0), (1, 2, "a", None), (1, 3, "a", 6.0), (2, 1, "b", 4.0), (2, 2, None, 8.0), (3, 1, None, None)], "who int, at int, pos string, v double")


def graph():
    g, over = Graph(["pos"]), (["who"], ["at"])
    last = lambda: F.sum("v").over(W.before(["who"], ["at"], 1))
    g.feature("before", ["v"], "x", over=over)(last)
    for strategy, prior in (("zero", None), ("positional_mean", None), ("shrink_to_prior", 9.0), ("indicator", None)):
        g.feature(f"before_{strategy}", ["v"], "x", strategy, prior, over)(last)
    g.feature("twice", ["before_zero"], "y", version=3, description="two times")(lambda: F.col("before_zero") * 2)
    g.feature("twice_more", ["twice", "before_shrink_to_prior"], "y")(lambda: F.col("twice") + F.col("before_shrink_to_prior"))
    return g


def test_levels_and_strategies(spark, rows):
    g = graph()
    assert [[f.name for f in level] for level in g.levels(["twice_more"])] == [["before_shrink_to_prior", "before_zero"], ["twice"], ["twice_more"]]
    wide, failed = g.build_wide(rows)
    assert not failed
    got = {(r.who, r.at): r for r in wide.collect()}
    assert [got[1, i].before for i in (1, 2, 3)] == [None, 2.0, None] and [got[1, i].before_zero for i in (1, 2, 3)] == [0.0, 2.0, 0.0]
    assert got[1, 3].before_shrink_to_prior == 9.0 and got[1, 3].before_indicator_missing == 1.0 and got[1, 2].before_indicator_missing == 0.0
    # the mean of the position, of null as a position of its own; a position without any value has none
    assert [got[k].before_positional_mean for k in ((1, 1), (3, 1), (2, 2), (2, 1))] == [2.0, 4.0, 4.0, None]
    assert got[1, 2].twice == 4.0 and got[1, 3].twice_more == 9.0
    assert "__" not in "".join(wide.columns) and wide.count() == 6
    tall, _ = g.build_tall(rows, ["who", "at"], ["twice", "before_indicator"])
    assert {(r.who, r.at, r.name, r.version, r.value) for r in tall.filter("who = 1 and at = 2").collect()} == {(1, 2, "twice", 3, 4.0), (1, 2, "before_zero", 1, 2.0), (1, 2, "before_indicator", 1, 2.0), (1, 2, "before_indicator_missing", 1, 0.0)}
    assert g.by_group()["y"][0] == {"name": "twice", "version": 3, "missing": "nan", "needs": ["before_zero"], "description": "two times"}


def test_a_failing_builder_nulls_its_own_column_only(spark, rows):
    g = graph()
    g.feature("unknown_column", ["nowhere"], "z", "zero")(lambda: F.col("nowhere"))
    g.feature("not_named", ["v"], "z")(lambda: F.col("v") + F.col("at"))
    g.feature("raises", ["v"], "z")(lambda: 1 / 0)
    g.feature("after_it", ["raises", "before_zero"], "z")(lambda: F.col("raises") + F.col("before_zero"))
    wide, failed = g.build_wide(rows)
    assert set(failed) == {"unknown_column", "not_named", "raises"} and "division" in failed["raises"]
    got = {(r.who, r.at): r for r in wide.collect()}[1, 2]
    assert (got.unknown_column, got.not_named, got.raises, got.after_it, got.twice) == (0.0, None, None, None, 4.0)


def test_registration_and_cycles():
    g = Graph()
    with pytest.raises(ValueError, match="no strategy"):
        g.feature("x", [], "g", "guess")
    with pytest.raises(ValueError, match="prior"):
        g.feature("x", [], "g", "shrink_to_prior")
    g.feature("a", ["b"], "g")(lambda: F.col("b"))
    g.feature("b", ["a"], "g")(lambda: F.col("a"))
    with pytest.raises(ValueError, match="need each other: a, b"):
        g.levels()


def test_one_shuffle_for_all_windows_of_a_history(spark):
    columns = "player int, ts int, minutes int, starts int, position string, goals int, xg double, xa double, npxg double, shots int, sot int, touches_box int, big_chances int, key_passes int, official int, cbi int, tackles int, recoveries int, bps int, bonus int, saves int, conceded int, penalties int, cards int"
    g = player_graph("player", ["ts"])
    means = [n for n, f in g.features.items() if f.missing == "positional_mean"]
    wide, failed = g.build_wide(spark.createDataFrame([], columns), [n for n in g.features if n not in means])
    assert not failed and len(g.features) == 38
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
