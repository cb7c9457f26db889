"""Form features of players in the graph, over the columns of a match history; all look at matches strictly before the one they describe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .feature_graph import Graph
from .operators import form as P
from .operators import windows as W

#: Prior rates per 90 minutes by position.
PRIORS = {"GK": 0.01, "DEF": 0.08, "MID": 0.2, "FWD": 0.4}


def player_graph(player: str, order: list[str]) -> Graph:
    """The graph for a history by ``player``, in this order, with columns as named in the builders' needs."""
    graph, over = Graph(["position"]), ([player], order)
    last = lambda n: W.before([player], order, n)

    def add(name: str, needs: list[str], group: str, build: Callable[[], Column], missing: str = "nan", prior: float | None = None) -> None:
        graph.feature(name, needs, group, missing, prior, over)(build)

    for n in (1, 3, 5, 10):
        add(f"mins_last{n}", ["minutes"], "minutes", lambda n=n: F.sum("minutes").over(last(n)), "zero")
    add("mins_last5_weighted", ["minutes"], "minutes", lambda: W.ewma(W.last_values("minutes", [player], order, 5), 3.0), "indicator")
    add("starts_last5", ["starts", "minutes"], "minutes", lambda: F.count_if(P.started("starts", "minutes")).over(last(5)), "zero")
    sub = lambda: (F.col("minutes") > 0) & (F.col("minutes") < 60)
    add("sub_appearance_rate", ["minutes"], "minutes", lambda: P.share(sub(), F.lit(True), last(10)))
    add("avg_sub_on_minute", ["minutes"], "minutes", lambda: F.avg(F.when(sub(), 90 - F.col("minutes"))).over(last(10)), "shrink_to_prior", 70.0)
    prior = lambda: P.lookup(F.col("position"), PRIORS, F.lit(0.4))
    for x in ("xg", "xa", "npxg"):
        for n in (3, 5, 10):
            add(f"{x}90_last{n}", [x, "minutes", "position"], "attack", lambda x=x, n=n: P.shrunk90(F.col(x), "minutes", last(n), prior()))
    add("xgi90_last5", ["xg", "xa", "minutes"], "attack", lambda: P.per90(F.col("xg") + F.col("xa"), "minutes", last(5)), "positional_mean")
    for x in ("shots", "sot", "touches_box", "big_chances", "key_passes"):
        add(f"{x}90", [x, "minutes"], "attack", lambda x=x: P.per90(F.col(x), "minutes", last(5)))
    add("conversion_ratio", ["goals", "xg"], "attack", lambda: F.try_divide(F.sum("goals").over(last(10)), F.round(F.sum("xg").over(last(10)), 9)), "indicator")
    add("xg_overperformance_last10", ["goals", "xg"], "attack", lambda: F.sum(F.col("goals") - F.col("xg")).over(last(10)))
    defence = ["official", "cbi", "tackles", "recoveries", "position", "minutes"]
    actions = lambda: P.defensive_actions("official", ["cbi", "tackles"], "recoveries", "position")
    needed = lambda: F.when(F.col("position") == "DEF", 10).otherwise(12)
    add("defcon_actions90", defence, "defence", lambda: P.shrunk90(actions(), "minutes", last(10), F.lit(6.0)))
    for n in (5, 10):
        add(f"defcon_hit_rate_last{n}", defence, "defence", lambda n=n: P.share(actions() >= needed(), F.col("minutes") >= 45, last(n)), "positional_mean")
    add("defcon_margin", defence, "defence", lambda: F.avg(F.when(F.col("minutes") >= 45, actions() - needed())).over(last(10)))
    add("bps90_last5", ["bps", "minutes"], "bonus", lambda: P.per90(F.col("bps"), "minutes", last(5)), "zero")
    add("bonus_rate_last10", ["bonus", "minutes"], "bonus", lambda: P.share(F.col("bonus") > 0, F.col("minutes") > 0, last(10)))
    keeper = lambda: F.col("position") == "GK"
    add("saves90", ["saves", "minutes", "position"], "keeping", lambda: F.when(keeper(), P.per90(F.col("saves"), "minutes", last(5))).otherwise(0.0))
    add("saves_per_shot_faced", ["saves", "conceded", "position"], "keeping", lambda: F.when(keeper(), F.try_divide(F.sum("saves").over(last(10)), F.sum(F.col("saves") + F.col("conceded")).over(last(10)))))
    add("pens_taken90", ["penalties", "minutes"], "set_pieces", lambda: P.per90(F.col("penalties"), "minutes", last(20)))
    add("card_rate90", ["cards", "minutes"], "discipline", lambda: P.per90(F.col("cards"), "minutes", last(10)))
    # these need other features
    add("minutes_trend", ["mins_last3", "mins_last10"], "minutes", lambda: F.col("mins_last3") / 3 - F.col("mins_last10") / 10)
    add("xg_form", ["xg90_last3", "xg90_last10"], "attack", lambda: F.try_divide(F.col("xg90_last3"), F.col("xg90_last10")))
    add("expected_points_form", ["xg_form", "minutes_trend", "bps90_last5"], "form", lambda: F.col("xg_form") * 4 + F.col("minutes_trend") / 30 + F.col("bps90_last5") / 20)
    return graph
