"""Strengths at several cut-offs against a dense fit of the same likelihood in numpy."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import strengths as S

START = datetime(2023, 8, 1)
TEAMS = [f"t{i}" for i in range(8)]


@pytest.fixture(scope="module")
def played():
    rng = np.random.default_rng(5)
    attack, defence = rng.normal(0, 0.35, 8), rng.normal(0, 0.25, 8)
    rows = []
    for i in range(260):
        h, a = rng.choice(8, 2, replace=False)
        hg, ag = rng.poisson(np.exp(0.15 + 0.25 + attack[h] - defence[a])), rng.poisson(np.exp(0.15 + attack[a] - defence[h]))
        rows.append((START + timedelta(hours=7 * i), TEAMS[h], TEAMS[a], int(hg), int(ag)))
    return rows


def loss(params, rows, half_life, ridge):
    """Penalised negative log-likelihood of matches in order, and its gradient by central differences."""
    n = len(TEAMS)
    h, a = (np.array([TEAMS.index(r[k]) for r in rows]) for k in (1, 2))
    hs, as_ = (np.array([r[k] for r in rows], float) for k in (3, 4))
    w = 0.5 ** ((len(rows) - 1 - np.arange(len(rows))) / half_life)

    def value(p):
        attack, defence, home, rho, base = p[:n], p[n : 2 * n], p[-3], p[-2], p[-1]
        lh, la = np.exp(base + home + attack[h] - defence[a]).clip(0.05, 8), np.exp(base + attack[a] - defence[h]).clip(0.05, 8)
        tau = np.ones(len(rows))
        low = hs + 2 * as_
        small = (hs < 2) & (as_ < 2)
        for code, t in ((0, 1 - lh * la * rho), (2, 1 + lh * rho), (1, 1 + la * rho), (3, np.full(len(rows), 1 - rho))):
            tau = np.where(small & (low == code), t, tau)
        return -(w * (hs * np.log(lh) - lh + as_ * np.log(la) - la + np.log(tau.clip(1e-6)))).sum() + ridge * (attack**2 + defence**2).sum()

    steps = np.eye(len(params)) * 1e-5
    return value(params), np.array([(value(params + s) - value(params - s)) / 2e-5 for s in steps])


def dense_fit(rows, half_life, ridge):
    n = len(TEAMS)
    low, high = np.array([-2.0] * 2 * n + [0, -0.25, -1]), np.array([2.0] * 2 * n + [0.8, 0.25, 1.5])
    p = np.array([0.0] * 2 * n + [0.26, -0.05, 0.15])
    at, grad = loss(p, rows, half_life, ridge)
    rate = 0.01
    for _ in range(3000):
        q = np.clip(p - rate * grad, low, high)
        then, grad_then = loss(q, rows, half_life, ridge)
        if then < at:
            p, at, grad, rate = q, then, grad_then, rate * 1.2
        else:
            rate /= 2
            if rate < 1e-9:
                break
    return at


@pytest.mark.parametrize(("half_life", "ridge"), [(60.0, 1.0), (300.0, 0.2)])
def test_fits_are_as_good_as_a_dense_one(spark, played, half_life, ridge):
    cuts = [START + timedelta(days=d) for d in (5, 40, 100)]
    df = spark.createDataFrame([*played, (None, "t0", "t1", 9, 9), (START, "t0", "t1", None, 9)], "t timestamp_ntz, h string, a string, hg int, ag int").repartition(3)
    rows = S.strength_fits(df, cuts, "t", "h", "a", "hg", "ag", half_life, ridge).collect()
    assert {r.cutoff for r in rows} == set(cuts[1:])
    for cut in cuts[1:]:
        seen = [r for r in played if r[0] < cut]
        of = {r.team: r for r in rows if r.cutoff == cut}
        one = next(iter(of.values()))
        assert one.n_matches == len(seen) and abs(sum(r.attack for r in of.values())) < 1e-6
        fitted = np.array([of[t].attack for t in TEAMS] + [of[t].defence for t in TEAMS] + [one.home_adv, one.rho, one.base])
        assert -0.25 <= one.rho <= 0.25 and 0 <= one.home_adv <= 0.8
        assert loss(fitted, seen, half_life, ridge)[0] <= dense_fit(seen, half_life, ridge) + 1e-4


def test_no_later_match_counts(spark, played):
    cut = START + timedelta(days=40)
    schema = "t timestamp_ntz, h string, a string, hg int, ag int"
    wild = [(r[0], r[1], r[2], 7, 0) if r[0] >= cut else r for r in played]
    one, other = (S.strength_fits(spark.createDataFrame(x, schema), [cut], "t", "h", "a", "hg", "ag").orderBy("team").collect() for x in (played, wild))
    assert one == other and len(one) == 8


def test_few_matches_and_none(spark, played):
    df = spark.createDataFrame(played[:30], "t timestamp_ntz, h string, a string, hg int, ag int")
    assert S.strength_fits(df, [START + timedelta(days=400)], "t", "h", "a", "hg", "ag").count() == 0
    assert S.strength_fits(df.limit(0), [START], "t", "h", "a", "hg", "ag").count() == 0
    pairs = S.decayed_pairs(df, [START + timedelta(days=400)], "t", "h", "a", "hg", "ag", 10.0)
    want = sum(0.5 ** ((29 - i) / 10) * r[3] for i, r in enumerate(played[:30]))
    assert pairs.agg(F.sum("gh")).first()[0] == pytest.approx(want)
