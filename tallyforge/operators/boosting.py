"""Gradient boosting over histograms, with monotone constraints, early stop, calibration and importance by gain.

Features are cut at quantiles into bins once. For each level of a round's trees one aggregate sums gradients by class, node, feature and bin, and
only these histograms, whose number the settings bound, come to the driver, which picks the splits. A tree is a column expression of
the bins, so rows move to their nodes and take their new scores where they are; every few rounds they are written, which cuts the plan.

A missing value (null or NaN) has a bin of its own below all others. Where a feature may only raise (1) or lower (-1) a class's score, splits that
would do otherwise are left out, and a split's middle bounds all that lies under it.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import forget, written

BINS, DEPTH, RATE, ROUNDS, PATIENCE, RIDGE, LEAST_ROWS, LEAST_GAIN, WRITE_EVERY = 32, 3, 0.15, 60, 8, 1.0, 20, 1e-6, 4
TEMPERATURES = tuple(float(x) for x in np.geomspace(0.5, 3.0, 25))
#: Features from texts may not be among this many first ones by gain.
TEXT_PLACES, LISTED = 3, 12


@dataclass
class Model:
    features: list[str]
    classes: int
    edges: list[list[float]]
    base: list[float]
    #: For each round and class a tree: {"feature", "bin", "gain", "left", "right"} or {"value"}.
    trees: list[list[dict]] = field(default_factory=list)
    temperature: float = 1.0
    metrics: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Model:
        return Model(**json.loads(text))


def _bin(c: Column, edges: list[float]) -> Column:
    """0 for a missing value, else 1 and how many edges lie below."""
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x), 0).otherwise(1 + F.size(F.filter(F.lit(edges).cast("array<double>"), lambda e: e < x)))


def _value(tree: dict, bins: Column) -> Column:
    if "value" in tree:
        return F.lit(tree["value"])
    return F.when(F.get(bins, F.lit(tree["feature"])) <= tree["bin"], _value(tree["left"], bins)).otherwise(_value(tree["right"], bins))


def _node(tree: dict, bins: Column, number: int = 1) -> Column:
    """The number of the leaf that a row is in; children of n are 2 n and 2 n + 1."""
    if "value" in tree:
        return F.lit(number)
    return F.when(F.get(bins, F.lit(tree["feature"])) <= tree["bin"], _node(tree["left"], bins, 2 * number)).otherwise(_node(tree["right"], bins, 2 * number + 1))


def probabilities(scores: Column, classes: int, temperature: float = 1.0) -> Column:
    """Array of a probability for each class."""
    if classes == 2:
        p = 1 / (1 + F.exp(-F.get(scores, F.lit(0)) / temperature))
        return F.array(1 - p, p)
    top = F.array_max(scores)
    each = F.transform(scores, lambda s: F.exp((s - top) / temperature))
    return F.transform(each, lambda e: e / F.aggregate(each, F.lit(0.0), lambda a, x: a + x))


def scored(rows: DataFrame, model: Model, name: str = "p") -> DataFrame:
    """``rows`` with an array of calibrated probabilities, from the features by their names."""
    bins = F.array(*(_bin(F.col(f), e) for f, e in zip(model.features, model.edges, strict=True)))
    scores = F.array(*(sum((_value(r[c], F.col("__bins")) for r in model.trees), F.lit(b)) for c, b in enumerate(model.base)))
    out = rows.withColumn("__bins", bins).withColumn("__scores", scores)
    return out.withColumn(name, probabilities(F.col("__scores"), model.classes, model.temperature)).drop("__bins", "__scores")


def _grow(hist: np.ndarray, bounds: dict, node: int, constraints: list[int], depth_left: int) -> dict:
    """The best split of a node's histogram (feature, bin, [g, h, n]) as a tree of two leaves, or a leaf."""
    g, h, _ = hist[0].sum(axis=0)
    low, high = bounds[node]
    weigh = lambda a, b: np.clip(-a / (b + RIDGE), low, high)
    worth = lambda a, b, w: -(2 * a * w + (b + RIDGE) * w * w)
    leaf = {"value": float(weigh(g, h))}
    if not depth_left:
        return leaf
    best = None
    for f in range(len(hist)):
        left = hist[f].cumsum(axis=0)[:-1]
        right = hist[f].sum(axis=0) - left
        wl, wr = weigh(left[:, 0], left[:, 1]), weigh(right[:, 0], right[:, 1])
        gain = worth(left[:, 0], left[:, 1], wl) + worth(right[:, 0], right[:, 1], wr) - worth(g, h, weigh(g, h))
        allowed = (left[:, 2] >= LEAST_ROWS) & (right[:, 2] >= LEAST_ROWS) & (constraints[f] * (wr - wl) >= 0)
        gain = np.where(allowed, gain, -np.inf)
        at = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[at] > LEAST_GAIN and (best is None or gain[at] > best["gain"]):
            best = {"feature": f, "bin": at, "gain": float(gain[at]), "left": {"value": float(wl[at])}, "right": {"value": float(wr[at])}}
    if best is None:
        return leaf
    middle = (best["left"]["value"] + best["right"]["value"]) / 2
    sign = constraints[best["feature"]]
    bounds[2 * node] = (low, min(high, middle)) if sign > 0 else (max(low, middle), high) if sign < 0 else (low, high)
    bounds[2 * node + 1] = (max(low, middle), high) if sign > 0 else (low, min(high, middle)) if sign < 0 else (low, high)
    return best


def _leaves(tree: dict, number: int = 1) -> list[tuple[int, dict]]:
    return [(number, tree)] if "value" in tree else _leaves(tree["left"], 2 * number) + _leaves(tree["right"], 2 * number + 1)


def _scaled(tree: dict, rate: float) -> dict:
    if "value" in tree:
        return {"value": tree["value"] * rate}
    return {**tree, "left": _scaled(tree["left"], rate), "right": _scaled(tree["right"], rate)}


def _loss(rows: DataFrame, classes: int, temperatures: tuple[float, ...]) -> list[float]:
    """Mean logarithmic loss of the rows at each temperature."""
    p = lambda t: F.get(probabilities(F.col("f"), classes, t), F.col("y"))
    found = rows.agg(*(F.sum(-F.col("w") * F.log(F.greatest(p(t), F.lit(1e-12)))).alias(f"l{i}") for i, t in enumerate(temperatures)), F.sum("w").alias("w")).first()
    return [float(found[f"l{i}"] or 0.0) / (found["w"] or 1.0) for i in range(len(temperatures))]


def calibration_error(rows: DataFrame, p: Column, hit: Column, weight: Column, bins: int = 10) -> float:
    """Expected calibration error over equal bins, the last one closed."""
    at = F.least(F.floor(p * bins), F.lit(bins - 1))
    found = rows.groupBy(at.alias("b")).agg(F.sum(weight).alias("w"), F.sum(weight * p).alias("p"), F.sum(weight * hit.cast("double")).alias("y")).collect()
    total = sum(r.w for r in found)
    return sum(abs(r.p - r.y) for r in found) / total if total else 0.0


def fit(rows: DataFrame, features: list[str], label: str, classes: int, holdout: Column, weight: Column | None = None, monotone: dict[str, int | dict[int, int]] | None = None, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, patience: int = PATIENCE) -> Model:
    """Learn from the rows that aren't held out; rounds end when the held-out loss hasn't fallen for ``patience`` rounds.

    Labels are 0 to classes - 1, rows with a null label are left out. ``monotone`` gives 1 or -1 for a feature: of the score of class 1 of two classes, or
    for more classes as {class: sign}. Without held-out rows all rounds are done and the temperature is 1. The model's metrics have the
    rounds, the held-out loss and, for class 1, the calibration error before and after the temperature.
    """
    y, hold = F.col(label).cast("int"), F.coalesce(holdout, F.lit(False))
    kept = rows.filter(y.isNotNull())
    quantiles = kept.filter(~hold).agg(*(F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), [i / bins for i in range(1, bins)], 10_000).alias(f"q{i}") for i, f in enumerate(features))).first()
    edges = [sorted(set(quantiles[f"q{i}"] or [])) for i in range(len(features))]
    binned = F.array(*(_bin(F.col(f), e) for f, e in zip(features, edges, strict=True)))
    base = kept.select(y.alias("y"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"), hold.alias("hold"), binned.alias("bins"))
    base = written(base, "binned")
    known = {r.y: r.w for r in base.filter("not hold").groupBy("y").agg(F.sum("w").alias("w")).collect()}
    total = sum(known.values())
    if not total:
        raise ValueError("no labelled rows to learn from")
    share = [max(known.get(c, 0.0), 1e-3) / total for c in range(classes)]
    start = [float(np.log(share[1] / share[0]))] if classes == 2 else [float(np.log(s)) for s in share]
    outputs = len(start)
    signs = [[(s.get(c, 0) if isinstance(s := (monotone or {}).get(f, 0), dict) else s) for f in features] for c in range(outputs)]
    model = Model(list(features), classes, edges, start)
    now, kept_tables = base.withColumn("f", F.lit(start).cast("array<double>")), [base]
    has_hold = not base.filter("hold").isEmpty()
    best_loss, best_rounds = (_loss(now.filter("hold"), classes, (1.0,))[0] if has_hold else np.inf), 0
    width = max(len(e) for e in edges) + 2
    for number in range(rounds):
        trees = [{"value": 0.0} for _ in range(outputs)]
        bounds = [{1: (-np.inf, np.inf)} for _ in range(outputs)]
        p = probabilities(F.col("f"), classes)
        for level in range(depth + 1):
            slope = lambda c: (F.get(F.col("p"), F.lit(c if outputs > 1 else 1)), (F.col("y") == (c if outputs > 1 else 1)).cast("double"))
            each = [F.struct(F.lit(c).alias("c"), _node(trees[c], F.col("bins")).alias("node"), (F.col("w") * (slope(c)[0] - slope(c)[1])).alias("g"), (F.col("w") * slope(c)[0] * (1 - slope(c)[0])).alias("h")) for c in range(outputs)]
            grads = now.filter("not hold").withColumn("p", p).select("bins", F.inline(F.array(*each))).filter(F.col("node") >= 1 << level)
            sums = grads.select("c", "node", "g", "h", F.posexplode("bins").alias("feature", "bin")).groupBy("c", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
            hists: dict[tuple[int, int], np.ndarray] = {}
            for r in sums.collect():
                hists.setdefault((r.c, r.node), np.zeros((len(features), width, 3)))[r.feature, r.bin] = (r.g, r.h, r.n)
            for c in range(outputs):
                for node, leaf in _leaves(trees[c]):
                    if node >> level == 1 and (c, node) in hists:
                        grown = _grow(hists[c, node], bounds[c], node, signs[c], depth - level)
                        leaf.clear()
                        leaf.update(grown)
            if level == depth or all("value" in leaf and node < 2 << level for c in range(outputs) for node, leaf in _leaves(trees[c])):
                break
        trees = [_scaled(t, rate) for t in trees]
        model.trees.append(trees)
        now = now.withColumn("f", F.array(*(F.get("f", F.lit(c)) + _value(trees[c], F.col("bins")) for c in range(outputs))))
        if number % WRITE_EVERY == WRITE_EVERY - 1:
            now = written(now, "scores")
            kept_tables.append(now)
        if has_hold:
            loss = _loss(now.filter("hold"), classes, (1.0,))[0]
            if loss < best_loss - 1e-6:
                best_loss, best_rounds = loss, number + 1
            elif number + 1 - best_rounds >= patience:
                break
        if all("value" in t and not t["value"] for t in trees):
            break
    if has_hold:
        model.trees = model.trees[:best_rounds]
        final = base.filter("hold").withColumn("f", F.array(*(sum((_value(r[c], F.col("bins")) for r in model.trees), F.lit(b)) for c, b in enumerate(start))))
        final = written(final, "held")
        kept_tables.append(final)
        losses = _loss(final, classes, TEMPERATURES)
        model.temperature = TEMPERATURES[int(np.argmin(losses))]
        error = lambda t: calibration_error(final, F.get(probabilities(F.col("f"), classes, t), F.lit(1)), F.col("y") == 1, F.col("w"))
        model.metrics = {"loss": min(losses), "loss_uncalibrated": best_loss, "ece": error(model.temperature), "ece_uncalibrated": error(1.0)}
    model.metrics["rounds"] = len(model.trees)
    forget(rows.sparkSession, *kept_tables)
    return model


def importance(model: Model, listed: int = LISTED) -> list[tuple[str, float]]:
    """(feature, share of all gain), the first ``listed`` of those that any tree splits at."""
    gains: dict[str, float] = {}

    def add(tree: dict) -> None:
        if "feature" in tree:
            gains[model.features[tree["feature"]]] = gains.get(model.features[tree["feature"]], 0.0) + tree["gain"]
            add(tree["left"])
            add(tree["right"])

    for trees in model.trees:
        for tree in trees:
            add(tree)
    total = sum(gains.values())
    return sorted(((f, g / total) for f, g in gains.items()), key=lambda x: (-x[1], x[0]))[:listed]


class TextDominates(ValueError):
    """A model leans on texts more than it may."""


def refuse_text_dominance(model: Model, text_features: set[str], places: int = TEXT_PLACES) -> None:
    first = [f for f, _ in importance(model)[:places]]
    found = [f for f in first if f in text_features]
    if found:
        raise TextDominates(f"{', '.join(found)} among the first {places} by gain")
