"""Mixing overlapping sources to target weights by a min-cost flow.

Documents with the same set of sources form a pattern. Patterns and sources that overlap make up the flow networks, one
for each connected group of sources, solved in tasks: each pattern offers its words once at a low cost and again, up to
MOST_COPIES times, at growing cost, and routes them to the quotas of its sources. The flow gives each pattern a number of
words to take; a threshold on a seeded hash of each document, refined digit by digit from aggregated sums, then selects
documents to that number. Sources, patterns and thresholds stay tables, so their number isn't bounded; a connected group of
overlapping sources is solved in one task.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialize, shuffle_partitions
from .components import connected_components

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST_COPIES = 1.5, 2
#: The hash is refined by this many digits of so many bits.
DIGITS, DIGIT_BITS = 4, 9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """``sources`` (source, a unique key in code point order, and size) with the words that each shall give, as target.

    Weights repeat in order of source; none gets more than ``most`` times its size, and what is over is shared again by weight.
    Places in the order come from a range partitioning and a small table of the partitions' sizes.
    """
    dealt = materialize(sources.repartitionByRange(shuffle_partitions(sources.sparkSession), "source").withColumn("part", F.spark_partition_id()), "sources")
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy("part").count().select("part", before.alias("before"))
    nth = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int"))
    ranked = dealt.join(parts, "part").select("source", "size", weight.alias("weight"), (most * F.col("size")).cast("double").alias("cap"))
    ranked = materialize(ranked, "sources")
    # each round closes the sources that the unit would take beyond their caps, which only raises the unit for the rest
    unit, closed = 0.0, -1
    while True:
        over = F.col("cap") < unit * F.col("weight")
        row = ranked.agg(F.count_if(over).alias("closed"), F.sum(F.when(over, F.col("cap"))).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.sum("size").alias("size")).first()
        if row.closed == closed or not row.open:
            break
        unit, closed = (share * row["size"] - (row.capped or 0.0)) / row.open, row.closed
    return ranked.select("source", "size", F.least("cap", unit * F.col("weight") if row.open else F.col("cap")).alias("target"))


@dataclass
class _Arc:
    to: int
    room: float
    cost: float
    back: int


def route(supply: dict[tuple, float], quota: dict, most_copies: int = MOST_COPIES) -> dict[tuple, float]:
    """Words to take of each pattern (a tuple of sources): a maximum flow to the quotas of least convex cost.

    The k-th use of a pattern's words costs 2 k - 1 each, so all are used once before any is used again
    where the quotas allow it.
    """
    patterns, sources = sorted(supply), sorted(quota)
    begin, end = 0, 1 + len(patterns) + len(sources)
    arcs: list[list[_Arc]] = [[] for _ in range(end + 1)]

    def link(a: int, b: int, room: float, cost: float) -> None:
        arcs[a].append(_Arc(b, room, cost, len(arcs[b])))
        arcs[b].append(_Arc(a, 0.0, -cost, len(arcs[a]) - 1))

    place = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    for i, p in enumerate(patterns, 1):
        for k in range(most_copies):
            link(begin, i, float(supply[p]), 2.0 * k + 1)
        for s in p:
            link(i, place[s], float("inf"), 0.0)
    for s in sources:
        link(place[s], end, float(quota[s]), 0.0)
    least = 1e-9 * max(1.0, sum(quota.values()))
    while True:
        cost, via, queue, queued = {begin: 0.0}, {}, deque([begin]), {begin}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for k, arc in enumerate(arcs[a]):
                if arc.room > least and cost[a] + arc.cost < cost.get(arc.to, float("inf")) - 1e-12:
                    cost[arc.to], via[arc.to] = cost[a] + arc.cost, (a, k)
                    if arc.to not in queued:
                        queue.append(arc.to)
                        queued.add(arc.to)
        if end not in cost:
            break
        path, at = [], end
        while at != begin:
            a, k = via[at]
            path.append(arcs[a][k])
            at = a
        push = min(arc.room for arc in path)
        for arc in path:
            arc.room -= push
            arcs[arc.to][arc.back].room += push
    return {p: sum(arcs[arc.to][arc.back].room for arc in arcs[begin] if arc.to == i) for i, p in enumerate(patterns, 1)}


def _solve(rows: pa.Table, most_copies: int) -> pa.Table:
    patterns = [tuple(p) for p in rows["pattern"].to_pylist()]
    targets = rows["targets"].to_pylist()
    flow = route(dict(zip(patterns, rows["size"].to_pylist(), strict=True)), {s: t for p, ts in zip(patterns, targets, strict=True) for s, t in zip(p, ts, strict=True)}, most_copies)
    return pa.table({"pattern": rows["pattern"], "flow": pa.array([flow[p] for p in patterns], pa.float64())})


def _flows(patterns: DataFrame, targets: DataFrame, most_copies: int, overlapping: bool) -> DataFrame:
    """``patterns`` (pattern, size) with source_size and target, summed over their sources, and their flow."""
    each = patterns.select("pattern", F.col("size").alias("words"), F.explode("pattern").alias("source")).join(targets, "source")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("source", "target"))), lambda x: x["target"])
    known = each.groupBy("pattern").agg(F.first("words").alias("words"), F.sum("size").alias("source_size"), F.sum("target").alias("target"), listed.alias("targets"))
    known = materialize(known.withColumn("node", F.xxhash64(F.element_at("pattern", 1))), "patterns")
    group = F.col("node")
    if overlapping:
        # sources that some pattern holds together are one network
        ids = F.transform("pattern", lambda s: F.xxhash64(s))
        pairs = known.filter(F.size("pattern") > 1).select(F.element_at(ids, 1).alias("a"), F.explode(ids).alias("b"))
        known = known.join(connected_components(pairs), "node", "left")
        group = F.coalesce("component", "node")

    def solve(rows: pa.Table) -> pa.Table:
        return _solve(rows, most_copies)

    flows = known.select(group.alias("group"), "pattern", F.col("words").alias("size"), "targets").groupBy("group").applyInArrow(solve, "pattern array<string>, flow double")
    return known.select("pattern", F.col("words").alias("size"), "source_size", "target").join(flows, "pattern")


def _thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with the hash below which the sizes of a pattern's documents come nearest to its rest.

    Each round sums the sizes by the next digit of the hash, inside the digits found so far, and stops at the digit
    where the sum would pass the rest: at most 2^DIGIT_BITS sums of a pattern meet in one task.
    """
    state = plan.withColumn("prefix", F.lit(0).cast("long"))
    for k in range(DIGITS):
        low, enough = 63 - DIGIT_BITS * (k + 1), 0.5 if k == DIGITS - 1 else 1.0
        inside = rows.join(state.select("pattern", "rest", "prefix"), "pattern").filter(F.shiftright("hash", low + DIGIT_BITS) == F.col("prefix"))
        sums = inside.groupBy("pattern", "rest", F.shiftright("hash", low).alias("digit")).agg(F.sum("size").alias("sum"))
        before = F.coalesce(F.sum("sum").over(Window.partitionBy("pattern").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        walk = sums.withColumn("before", before).withColumn("passed", F.col("before") + F.col("sum") * enough > F.col("rest"))
        found = walk.groupBy("pattern").agg(F.min(F.when(F.col("passed"), F.struct("digit", "before"))).alias("stop"), F.max("digit").alias("last"), F.sum("sum").alias("all"))
        none = F.col("last").isNull()
        prefix = F.when(none, F.col("prefix") * (1 << DIGIT_BITS)).otherwise(F.coalesce("stop.digit", F.col("last") + 1))
        rest = F.when(none, F.col("rest")).otherwise(F.col("rest") - F.coalesce("stop.before", "all"))
        state = materialize(state.join(found, "pattern", "left").withColumns({"prefix": prefix, "rest": rest}).select(state.columns), "thresholds")
    scale = 63 - DIGIT_BITS * DIGITS
    whole = F.col("prefix") >= F.lit(1 << (DIGIT_BITS * DIGITS))
    return state.withColumn("threshold", F.when(whole, F.lit((1 << 63) - 1)).otherwise(F.col("prefix") * F.lit(1 << scale)))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_copies: int = MOST_COPIES, seed: int = 5) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, and the row's hash, for each row of ``docs``.

    ``source`` holds a name or an array of names (overlapping sources; a null or empty one is a source of its own,
    last in order). A null text has size 0. source_size and target are summed over a row's sources. Rows that
    agree in doc_id and text are taken together. An empty table gives no rows. Other columns are not read.
    """
    overlapping = isinstance(docs.schema[source].dataType, T.ArrayType)
    # a mark before each name, so that no name can be taken for the null source, which comes last
    marked = lambda x: F.when(x.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), x))
    members = F.array_sort(F.array_distinct(F.transform(F.when(F.size(source) > 0, F.col(source)).otherwise(F.array(F.lit(None).cast("string"))), marked))) if overlapping else F.array(marked(F.col(source)))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), members.alias("pattern"), word_count(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.col(doc_id).cast("long"), F.xxhash64(text)).bitwiseAND(F.lit((1 << 63) - 1)).alias("hash"))
    rows = materialize(rows, "sizes")
    patterns = materialize(rows.groupBy("pattern").agg(F.sum("size").alias("size")), "patterns")
    targets = source_targets(patterns.select(F.explode("pattern").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("size")), weights, share, most_copies)
    flows = _flows(patterns, targets, most_copies, overlapping)
    whole = F.when(F.col("size") > 0, F.least(F.lit(most_copies), F.floor(F.col("flow") / F.col("size")))).otherwise(0).cast("long")
    plan = flows.withColumn("whole", whole).withColumn("rest", F.when(F.col("size") > 0, F.col("flow") - F.col("whole") * F.col("size")).otherwise(0.0))
    plan = materialize(plan.select("pattern", "source_size", "target", "whole", "rest"), "plan")
    copies = F.col("whole") + F.when(F.col("whole") < most_copies, (F.col("hash") < F.col("threshold")).cast("long")).otherwise(0)
    return rows.join(_thresholds(rows, plan), "pattern").withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "hash")


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 5, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them, with the columns of ``docs``."""
    key = F.xxhash64(F.lit(seed), F.col(doc_id).cast("long"), F.xxhash64(text)).bitwiseAND(F.lit((1 << 63) - 1))
    at, of, taken, copies, n = (free_name(docs, f"__{name}") for name in ("key", "id", "hash", "copies", "n"))
    plan = mix(docs, doc_id, text, seed=seed, **options).filter("copies > 0").select(F.col("doc_id").alias(of), F.col("hash").alias(taken), F.col("copies").alias(copies)).distinct()
    keyed = docs.withColumn(at, key).join(plan, F.col(doc_id).cast("long").eqNullSafe(F.col(of)) & (F.col(at) == F.col(taken)))
    return keyed.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*docs.columns)
