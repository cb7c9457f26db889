"""Attack and defence of teams by a time-decayed Poisson model with a correction for low scores, at many cut-offs at once.

A side's mean goals are exp(base + home + attack - the other's defence) at home, and without home away, within bounds; 0-0, 0-1, 1-0 and 1-1 are
corrected by rho. Matches before a cut-off weigh 0.5 ^ (matches since / half-life), and a ridge draws strengths to 0.

All that a fit needs of the matches are decayed sums for each pair of teams, so matches are read once, for all cut-offs together. Each sweep
updates the attacks, then the defences, then base, home and rho of all cut-offs by Newton steps, each from sums over a team's or a
cut-off's pairs: joins and aggregates, whose size is that of the pairs. No match on or after a cut-off is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import broadcast_if_small, forget, written

#: Half-life in matches, ridge, bounds of the parameters and of mean goals, and where the fit starts.
HALF_LIFE, RIDGE, LEAST_MATCHES = 300.0, 1.0, 40
STRENGTH_BOUND, HOME_BOUNDS, RHO_BOUNDS, BASE_BOUNDS, GOALS_BOUNDS = 2.0, (0.0, 0.8), (-0.25, 0.25), (-1.0, 1.5), (0.05, 8.0)
START = {"base": 0.15, "home_adv": 0.26, "rho": -0.05}
SWEEPS, TOLERANCE = 40, 1e-6


def _within(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def decayed_pairs(matches: DataFrame, cutoffs: list, ts: str, home: str, away: str, home_goals: str, away_goals: str, half_life: float = HALF_LIFE) -> DataFrame:
    """Sums for each (cutoff, home, away) of the matches before the cut-off: weight, goals, and the weights of low scores.

    Matches are ordered by time, those of one time by their teams and scores. Rows with a null are left out.
    """
    cutoffs = sorted(cutoffs)
    rows = matches.select(F.col(ts).alias("t"), F.col(home).alias("home"), F.col(away).alias("away"), F.col(home_goals).cast("double").alias("hg"), F.col(away_goals).cast("double").alias("ag")).dropna()
    listed = F.array(*(F.lit(c) for c in cutoffs)).cast(f"array<{dict(rows.dtypes)['t']}>")
    # a match's place is that of its day among all days, which are few, and then within its day
    days = rows.groupBy(F.to_date("t").alias("day")).agg(F.count("*").alias("n"))
    before = days.withColumn("before", F.sum("n").over(Window.orderBy("day")) - F.col("n")).select("day", "before")
    order = Window.partitionBy("day").orderBy("t", "home", "away", "hg", "ag")
    placed = rows.withColumn("day", F.to_date("t")).join(broadcast_if_small(before), "day").withColumn("place", F.col("before") + F.row_number().over(order))
    first = F.size(F.filter(listed, lambda c: c <= F.col("t")))
    placed = placed.withColumn("first", first).filter(F.col("first") < len(cutoffs))
    known = placed.groupBy("first").agg(F.count("*").alias("n")).collect()
    totals = [sum(r.n for r in known if r["first"] <= i) for i in range(len(cutoffs))]
    each = placed.withColumn("i", F.explode(F.sequence(F.col("first"), F.lit(len(cutoffs) - 1))))
    n = F.get(F.array(*(F.lit(float(x)) for x in totals)), F.col("i"))
    w = F.pow(F.lit(0.5), (n - F.col("place")) / half_life)
    low = lambda h, a: F.sum(F.when((F.col("hg") == h) & (F.col("ag") == a), F.col("w")).otherwise(0.0))
    sums = each.withColumn("w", w).groupBy("i", "home", "away").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("hg")).alias("gh"), F.sum(F.col("w") * F.col("ag")).alias("ga"), *(low(h, a).alias(f"w{h}{a}") for h in (0, 1) for a in (0, 1)))
    return sums.withColumn("cutoff", F.get(listed, F.col("i"))).drop("i")


def _rates(pairs: DataFrame, teams: DataFrame, all_of: DataFrame) -> DataFrame:
    """Pairs with mean goals, and what each side's logarithm of mean goals would gain from one more: residuals ``rh`` and ``ra``."""
    side = lambda c: teams.select("cutoff", F.col("team").alias(c), F.col("attack").alias(f"{c}_attack"), F.col("defence").alias(f"{c}_defence"))
    met = pairs.join(side("home"), ["cutoff", "home"]).join(side("away"), ["cutoff", "away"]).join(broadcast_if_small(all_of), "cutoff")
    lh = _within(F.exp(F.col("base") + F.col("home_adv") + F.col("home_attack") - F.col("away_defence")), *GOALS_BOUNDS)
    la = _within(F.exp(F.col("base") + F.col("away_attack") - F.col("home_defence")), *GOALS_BOUNDS)
    met = met.withColumns({"lh": lh, "la": la})
    lh, la, rho = F.col("lh"), F.col("la"), F.col("rho")
    both = -F.col("w00") * lh * la * rho / (1 - lh * la * rho)
    return met.withColumns({"rh": F.col("gh") - F.col("w") * lh + both + F.col("w01") * lh * rho / (1 + lh * rho), "ra": F.col("ga") - F.col("w") * la + both + F.col("w10") * la * rho / (1 + la * rho)})


def _steps(rates: DataFrame, teams: DataFrame, kind: str, ridge: float) -> DataFrame:
    """``teams`` after a Newton step of each team's attack, or of its defence."""
    parts = (("home", "rh", "lh"), ("away", "ra", "la")) if kind == "attack" else (("away", "rh", "lh"), ("home", "ra", "la"))
    sign = 1.0 if kind == "attack" else -1.0
    rows = rates.select("cutoff", F.inline(F.array(*(F.struct(F.col(t).alias("team"), (sign * F.col(r)).alias("g"), (F.col("w") * F.col(m)).alias("h")) for t, r, m in parts))))
    sums = rows.groupBy("cutoff", "team").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    moved = F.col(kind) + (F.col("g") - 2 * ridge * F.col(kind)) / (F.col("h") + 2 * ridge)
    return teams.join(sums, ["cutoff", "team"]).withColumn(kind, _within(moved, -STRENGTH_BOUND, STRENGTH_BOUND)).select("cutoff", "team", "attack", "defence")


def _all_of(rates: DataFrame, all_of: DataFrame) -> DataFrame:
    """``all_of`` after a Newton step of base and home advantage together, and one of rho."""
    lh, la, rho = F.col("lh"), F.col("la"), F.col("rho")
    parts = [(F.col("w00"), -lh * la, 1 - lh * la * rho), (F.col("w01"), lh, 1 + lh * rho), (F.col("w10"), la, 1 + la * rho), (F.col("w11"), F.lit(-1.0), 1 - rho)]
    slope, bend = sum(w * d / t for w, d, t in parts), sum(w * d * d / (t * t) for w, d, t in parts)
    sums = rates.groupBy("cutoff").agg(F.sum(F.col("rh") + F.col("ra")).alias("gb"), F.sum("rh").alias("gm"), F.sum(F.col("w") * (lh + la)).alias("hb"), F.sum(F.col("w") * lh).alias("hm"), F.sum(slope).alias("slope"), F.sum(bend).alias("bend"))
    # the second derivatives are [[hb, hm], [hm, hm]]
    met = all_of.join(sums, "cutoff")
    away = F.col("hb") - F.col("hm")
    base = F.col("base") + F.try_divide(F.col("gb") - F.col("gm"), away)
    home = F.col("home_adv") + F.try_divide(F.col("gm"), F.col("hm")) - F.try_divide(F.col("gb") - F.col("gm"), away)
    moved = {"base": _within(base, *BASE_BOUNDS), "home_adv": _within(home, *HOME_BOUNDS), "rho": _within(rho + F.coalesce(F.try_divide(F.col("slope"), F.col("bend")), F.lit(0.0)), *RHO_BOUNDS)}
    return met.select("cutoff", *(c.alias(k) for k, c in moved.items()))


def _centred(teams: DataFrame, all_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean attack and mean defence moved into base, which changes no rate and lessens the ridge's cost."""
    means = teams.groupBy("cutoff").agg(F.avg("attack").alias("ma"), F.avg("defence").alias("md"))
    base = _within(F.col("base") + F.col("ma") - F.col("md"), *BASE_BOUNDS)
    moved = all_of.join(means, "cutoff").withColumn("moved", F.col("base") + F.col("ma") - F.col("md") == base)
    shift = broadcast_if_small(moved.filter("moved").select("cutoff", "ma", "md"))
    shifted = teams.join(shift, "cutoff", "left").select("cutoff", "team", (F.col("attack") - F.coalesce("ma", F.lit(0.0))).alias("attack"), (F.col("defence") - F.coalesce("md", F.lit(0.0))).alias("defence"))
    return shifted, moved.select("cutoff", F.when(F.col("moved"), base).otherwise(F.col("base")).alias("base"), "home_adv", "rho")


def strength_fits(matches: DataFrame, cutoffs: list, ts: str, home: str, away: str, home_goals: str, away_goals: str, half_life: float = HALF_LIFE, ridge: float = RIDGE, least: int = LEAST_MATCHES) -> DataFrame:
    """(cutoff, team, attack, defence, home_adv, rho, base, n_matches) of each cut-off and team that played before it.

    Cut-offs with fewer than ``least`` matches before them have no rows: the caller takes a mean team. Attack and defence are centred on 0. The fit ends
    when no parameter moves by more than 1e-6, or after 40 sweeps.
    """
    spark = matches.sparkSession
    pairs = decayed_pairs(matches, cutoffs, ts, home, away, home_goals, away_goals, half_life)
    enough = Window.partitionBy("cutoff")
    pairs = written(pairs.withColumn("n_matches", F.sum("n").over(enough)).filter(F.col("n_matches") >= least), "pairs")
    teams = pairs.select("cutoff", F.explode(F.array("home", "away")).alias("team")).distinct()
    teams = written(teams.select("cutoff", "team", F.lit(0.0).alias("attack"), F.lit(0.0).alias("defence")), "teams")
    all_of = written(pairs.select("cutoff").distinct().select("cutoff", *(F.lit(v).alias(k) for k, v in START.items())), "all")
    for _ in range(SWEEPS):
        next_teams = _steps(_rates(pairs, teams, all_of), teams, "attack", ridge)
        next_teams = written(_steps(_rates(pairs, next_teams, all_of), next_teams, "defence", ridge), "teams")
        next_all = _all_of(_rates(pairs, next_teams, all_of), all_of)
        next_teams, next_all = (written(x, "strengths") for x in _centred(next_teams, next_all))
        away_from = lambda new, old, keys, names: new.join(old.select(*keys, *(F.col(n).alias(f"__{n}") for n in names)), keys).agg(F.max(F.greatest(*(F.abs(F.col(n) - F.col(f"__{n}")) for n in names)))).first()[0] or 0.0
        moved = max(away_from(next_teams, teams, ["cutoff", "team"], ["attack", "defence"]), away_from(next_all, all_of, ["cutoff"], list(START)))
        forget(spark, teams, all_of)
        teams, all_of = next_teams, next_all
        if moved <= TOLERANCE:
            break
    counts = pairs.select("cutoff", "n_matches").distinct()
    out = written(teams.join(all_of, "cutoff").join(counts, "cutoff").select("cutoff", "team", "attack", "defence", "home_adv", "rho", "base", "n_matches"), "fits")
    forget(spark, pairs, teams, all_of)
    return out
