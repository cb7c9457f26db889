"""N-gram Jaccard self-join by chosen paths.

A text is the set of its five-word shingles. In each run a set picks a few shingles at random, by a hash that all sets
share, and lands in the bucket of each; a bucket that is too large is split again the same way, by further
shared shingles. Small buckets are compared by brute force. The runs are as many as the target recall needs: with a
mean of BRANCH * J shared picks on each level, a pair misses a run with the extinction probability of a branching process.
The sketch is the same in all runs, so what it loses counts too: J is taken as the sketches show it, for sets of which one
holds the other, where their agreement deviates most from J.

Sets are sampled and compared by bottom-k sketches (a uniform, coordinated sample of a set), and what comes out is
candidate groups, as edges to pivots and never all pairs of a group. In a large bucket some members act as
pivots first: all that are near a pivot join its group, and those that are very near are done, as whatever is similar to
them is near the pivot too. A bucket whose members are all of one group is done as well, and one of which few aren't
is settled by those few as pivots. Only other buckets split on, by further shared shingles, until they are small; with
what pivots join taken out, members share less than BRANCH's inverse and each level has fewer rows than the one before.
Last, within each candidate group, tiles of whole sets are multiplied for exact intersections; that alone decides links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, mix64, seeded_words
from .components import connected_components
from .embed_dedup import local_roots
from .shingles import shingle_sets

SIMILARITY, RECALL = 0.8, 0.999
SKETCH, BRANCH, SMALL, LATER, PIVOTS = 128, 2.0, 256, 4, 64
#: Most sets and most tokens of a tile.
TILE, TILE_TOKENS = 512, 1 << 16
#: Share of a sketch that agrees with a pivot's, for a set that is very near it; and the chance that the sketches of a pair
#: of the wanted similarity agree too little to be a candidate.
VERY_NEAR, LOST = 0.75, 1e-6


def agreements(similarity: float, sketch: int = SKETCH) -> np.ndarray:
    """Chances that 0, 1, ... tokens of two sketches agree, for a pair of this similarity of which one holds the other."""
    return np.array([math.comb(sketch, k) * similarity**k * (1 - similarity) ** (sketch - k) for k in range(sketch + 1)])


def least_agreement(similarity: float, sketch: int = SKETCH, lost: float = LOST) -> float:
    """Share of agreeing tokens that all pairs of this similarity reach but for a part of ``lost`` at most.

    Sets of up to ``sketch`` tokens are whole in their sketches and agree in more than their similarity. In the bottom of
    the union of larger ones each token is shared with that chance, and both sketches hold those that are.
    """
    return int(np.searchsorted(np.cumsum(agreements(similarity, sketch)), lost, "right")) / sketch


def near_agreement(candidate: float) -> float:
    """Share of a pivot's sketch with which a set is near it, so that all candidates of a set very near it are.

    They lack at most 1 - candidate of the tokens that the set shares with the pivot, whatever their sketches hold else.
    """
    return VERY_NEAR + candidate - 1


def runs_needed(similarity: float, recall: float, branch: float = BRANCH, sketch: int = 0) -> int:
    """Runs after which a pair of this similarity has met with the given probability, however deep buckets split.

    With ``sketch``, the mean over how far sketches of so many tokens agree; too small an agreement is a miss in all runs.
    """
    shares, chances = np.array([similarity]), np.ones(1)
    if sketch:
        shares, chances = np.arange(sketch + 1) / sketch, agreements(similarity, sketch)
    missed = np.zeros(len(shares))
    for _ in range(200):
        missed = np.exp(branch * shares * (missed - 1))
    if sketch:
        missed[shares < least_agreement(similarity, sketch)] = 1
    runs = 1
    while (chances * missed**runs).sum() > 1 - recall:
        runs += 1
        if runs > 1000:
            raise ValueError("no number of runs reaches this recall")
    return runs


def picks(tokens: np.ndarray, sizes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, path) of the tokens that their sets pick: ``seeds`` is the path so far of each token's set."""
    with np.errstate(over="ignore"):
        rolled = mix64(tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ seeds)
        chosen = np.flatnonzero((rolled >> np.uint64(11)).astype(np.float64) * 2.0**-53 * sizes < BRANCH)
        return chosen, mix64(seeds[chosen] + rolled[chosen] + np.uint64(1)).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch], runs: int) -> Iterator[pa.RecordBatch]:
    """Each text's set as a key and a sketch, with the paths that it picks, those of the first run in front."""
    seeds = seeded_words(runs, 31)
    for batch in batches:
        keys, sizes, sketches = [], [], []
        for whole in shingle_sets(batch.column(2)):
            keys.append(hashlib.blake2b(whole.tobytes(), digest_size=16).digest())
            sizes.append(len(whole))
            sketches.append(whole[:SKETCH].astype(np.uint32))
        lengths = np.array([len(s) for s in sketches], np.int64)
        tokens = np.concatenate(sketches) if sketches else np.zeros(0, np.uint32)
        of = np.repeat(np.arange(len(sketches)), lengths)
        found = [picks(tokens, lengths[of], np.full(len(tokens), s)) for s in seeds]
        rows, paths = np.concatenate([of[i] for i, _ in found]), np.concatenate([p for _, p in found])
        order = np.argsort(rows, kind="stable")
        offsets = np.searchsorted(rows[order], np.arange(len(sketches) + 1)).astype(np.int32)
        first_run = np.bincount(of[found[0][0]], minlength=len(sketches)).astype(np.int32)
        yield pa.record_batch({"doc_id": batch.column(0), "key": batch.column(1), "set_key": pa.array(keys, pa.binary()), "size": pa.array(sizes, pa.int64()), "sketch": pa.array([s.tobytes() for s in sketches], pa.binary()), "first_run": pa.array(first_run), "paths": pa.ListArray.from_arrays(pa.array(offsets), pa.array(paths[order]))})


def _agree(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shares of the larger sketch that two sketches have in common, for all of left against all of right."""
    _, index = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    counts = common(index, [len(x) for x in left], [len(x) for x in right])
    a, b = (np.array([max(1, len(x)) for x in side]) for side in (left, right))
    return counts / np.maximum(a[:, None], b[None, :])


def common(index: np.ndarray, left: list[int], right: list[int], columns: int = 2048) -> np.ndarray:
    """Sizes of intersections; ``index`` numbers the tokens of the sets of left, then right, one set after another."""
    rows = np.repeat(np.arange(len(left) + len(right)), [*left, *right])
    n, cut = len(left), int(sum(left))
    # only tokens on both sides count, numbered anew
    sides = np.intersect1d(index[:cut], index[cut:])
    at = np.searchsorted(sides, index)
    shared = (at < len(sides)) & (sides[np.minimum(at, max(0, len(sides) - 1))] == index) if len(sides) else np.zeros(len(index), bool)
    rows, at = rows[shared], at[shared]
    out = np.zeros((n, len(right)), np.float32)
    for low in range(0, len(sides), columns):
        here = (at >= low) & (at < low + columns)
        ones = np.zeros((n + len(right), min(columns, len(sides) - low)), np.float32)
        ones[rows[here], at[here] - low] = 1
        out += ones[:n] @ ones[n:].T
    return out


def _edges(a: np.ndarray, b: np.ndarray) -> pa.Table:
    off = np.flatnonzero(a != b)
    none = lambda kind: pa.array([None] * len(off), kind)
    return pa.table({"a": pa.array(a[off], pa.int64()), "b": pa.array(b[off], pa.int64()), "path": none(pa.list_(pa.int64())), "root": none(pa.int64())})


def _opened(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Nodes, roots (of what has none, the node itself as a negative number) and sketches."""
    nodes = rows["node"].to_numpy()
    roots = np.where(rows["root"].is_valid().to_numpy(zero_copy_only=False), rows["root"].fill_null(0).to_numpy(), -1 - nodes)
    return nodes, roots, [np.frombuffer(x, np.uint32) for x in rows["sketch"].to_pylist()]


def _small_bucket(rows: pa.Table, candidate: float) -> pa.Table:
    nodes, roots, sketches = _opened(rows)
    near = (_agree(sketches, sketches) >= candidate) & (roots[:, None] != roots[None, :])
    i, j = np.nonzero(np.triu(near, 1))
    return _edges(nodes, local_roots(i, j, nodes))


def _large_bucket(rows: pa.Table, candidate: float, split: bool) -> pa.Table:
    """A tile of a bucket against the bucket's pivots.

    Where the pivots are all that isn't of the bucket's main group (``whole``), whatever agrees as a candidate joins, and that
    settles the bucket. Else what is near a pivot joins the pivot's group, and what isn't very near one is split on.
    """
    pivot, whole = rows["pivot"].to_numpy(zero_copy_only=False).astype(bool), rows["whole"][0].as_py()
    nodes, roots, sketches = _opened(rows)
    members, pivots = np.flatnonzero(~pivot), np.flatnonzero(pivot)
    if not len(members):
        return _edges(nodes[:0], nodes[:0])
    agree = _agree([sketches[i] for i in members], [sketches[i] for i in pivots]) if len(pivots) else np.zeros((len(members), 0))
    # a group is its root here, so that a member brings no edge that its group has already
    groups = np.where(roots < 0, nodes, roots)
    if whole:
        i, j = np.nonzero((agree >= candidate) & (roots[members][:, None] != roots[pivots][None, :]))
        met = np.unique(np.stack([groups[members[i]], groups[pivots[j]]]), axis=1)
        ids, at = np.unique(met, return_inverse=True)
        return _edges(ids, local_roots(*at.reshape(met.shape), ids))
    near = near_agreement(candidate)
    # pivots near each other are one group; all tiles of a bucket see the same pivots
    i, j = np.nonzero(_agree(*[[sketches[k] for k in pivots]] * 2) >= near) if len(pivots) else (pivots, pivots)
    labels = local_roots(i, j, groups[pivots])
    i, j = np.nonzero(agree >= near)
    joins = np.unique(np.stack([groups[members[i]], labels[j]]), axis=1)
    edges = _edges(*joins)
    left = np.flatnonzero(~(agree >= VERY_NEAR).any(axis=1))
    if not split or not len(left):
        return edges
    root = roots[members[left]]
    if len(pivots):
        best = agree[left].argmax(axis=1)
        root = np.where(agree[left, best] >= near, labels[best], root)
    of_left = [sketches[members[k]] for k in left]
    tokens, lengths = np.concatenate(of_left), np.array(list(map(len, of_left)))
    of = np.repeat(np.arange(len(left)), lengths)
    at, paths = picks(tokens, lengths[of], np.full(len(tokens), np.array(rows["path"][0].as_py(), np.int64).view(np.uint64)))
    # one row for each set that picks something, with all its paths; picks are in the order of sets
    some, first = np.unique(of[at], return_index=True)
    paths = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(paths, pa.int64()))
    split_on = pa.table({"a": pa.array(nodes[members[left[some]]], pa.int64()), "b": pa.array([None] * len(some), pa.int64()), "path": paths, "root": pa.array(root[some], pa.int64(), mask=root[some] < 0)})
    return pa.concat_tables([edges, split_on])


#: An edge, or a set (a) that splits on, with the paths that it picks and its root.
EDGES = "a long, b long, path array<long>, root long"


def _sizes(rows: DataFrame, least: int) -> DataFrame:
    """path, n, main (root of the bucket's main group) and others (how many aren't of it) of the buckets in ``rows`` (node, path,
    root) that have more than ``least`` rows and aren't of one group."""
    shares = rows.groupBy("path", "root").agg(F.count("*").alias("n"))
    main = F.max(F.when(F.col("root").isNotNull(), F.struct("n", "root")))
    sizes = shares.groupBy("path").agg(F.sum("n").alias("n"), main.alias("main"))
    sizes = sizes.select("path", "n", F.col("main.root").alias("main"), (F.col("n") - F.coalesce("main.n", F.lit(0))).alias("others"))
    # written, so that the join with it is between plain shuffles and a hot bucket's rows can be dealt to several tasks
    return materialize(sizes.filter((F.col("n") > least) & (F.col("others") > 0)), "buckets")


def _compare_large(large: DataFrame, sketches: DataFrame, small: int, candidate: float, split: bool) -> DataFrame:
    """Edges, and rows for smaller buckets, of buckets of more than ``small``."""
    large = large.withColumn("tiles", F.ceil(F.col("n") / small).cast("int")).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int")).join(sketches, "node")
    whole = F.col("others") <= small
    other = F.col("root").isNull() | (F.col("root") != F.col("main"))
    drawn = F.pmod(F.xxhash64("node", "path"), F.lit(1 << 40)) < (F.lit(float(PIVOTS << 40)) / F.col("others"))
    columns = ["path", "tile", "node", "root", "sketch", whole.alias("whole")]
    pivots = large.filter(other & (whole | drawn)).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    both = large.select(*columns, F.lit(False).alias("pivot")).unionByName(pivots.select(*columns, F.lit(True).alias("pivot")))

    def compare(rows: pa.Table) -> pa.Table:
        return _large_bucket(rows, candidate, split)

    return materialize(both.groupBy("path", "tile").applyInArrow(compare, EDGES), "candidates")


def candidate_edges(sets: DataFrame, small: int = SMALL, similarity: float = SIMILARITY) -> DataFrame:
    """Edges (a, b), never all pairs of a group, between sets that may be similar; ``sets`` has node, sketch, first_run and paths.

    First the large buckets of the first run are compared with pivots, and what they join into one group has a root:
    buckets of one root have nothing left to find. So a group of near copies costs rows in proportion to it. All runs follow,
    each large bucket splitting further until the rest is small.
    """
    sketches, candidate = sets.select("node", "sketch"), least_agreement(similarity)
    spark, found, used = sets.sparkSession, [], []

    def small_bucket(rows: pa.Table) -> pa.Table:
        return _small_bucket(rows, candidate)

    no_root = F.lit(None).cast("long").alias("root")
    rows = sets.select("node", F.explode("paths").alias("path"), no_root)
    sizes = _sizes(rows, 1)
    used.append(sizes)
    if not sizes.filter(F.col("n") > small).isEmpty():
        first = sets.select("node", F.explode(F.slice("paths", F.lit(1), F.col("first_run"))).alias("path"), no_root)
        out = _compare_large(first.join(sizes.filter(F.col("n") > small), "path"), sketches, small, candidate, split=False)
        found.append(out.select("a", "b"))
        groups = materialize(connected_components(found[0]), "groups")
        # roots meet the sets before their paths are dealt out: one row for each set
        rooted = sets.select("node", "paths").join(groups.select("node", F.col("component").alias("root")), "node", "left")
        rows = rooted.select("node", F.explode("paths").alias("path"), "root")
        sizes = _sizes(rows, 1)
        used += [out, groups, sizes]
    limit = small
    while True:
        here = materialize(rows.join(sizes, "path"), "paths")
        few = here.filter(F.col("n") <= limit).join(sketches, "node").select("path", "node", "root", "sketch").groupBy("path").applyInArrow(small_bucket, EDGES)
        few = materialize(few.select("a", "b"), "candidates")
        used += [here, few]
        found.append(few)
        large = here.filter(F.col("n") > limit)
        if large.isEmpty():
            break
        # what is split off is little, and a larger bucket of it is compared by brute force sooner than split again
        limit = LATER * small
        out = _compare_large(large, sketches, small, candidate, split=True)
        used.append(out)
        found.append(out.filter("path is null").select("a", "b"))
        rows = out.filter("path is not null").select(F.col("a").alias("node"), F.explode("path").alias("path"), "root")
        sizes = _sizes(rows, 1)
        used.append(sizes)
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    edges = materialize(edges.distinct(), "candidates")
    discard(spark, *used)
    return edges


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, band and tile become one row for each tile, with its texts' sets."""
    key, held = None, []

    def packed() -> pa.RecordBatch:
        group, band, tile = key
        sets = [s for *_, s in held]
        words = {"nodes": [x for x, *_ in held], "counts": [c for _, c, _ in held], "sizes": list(map(len, sets))}
        return pa.record_batch({"group": pa.array([group], pa.int64()), "band": pa.array([band], pa.int32()), "tile": pa.array([tile], pa.int32()), **{k: pa.array([np.array(v, np.int64).tobytes()], pa.binary()) for k, v in words.items()}, "tokens": pa.array([np.concatenate(sets).tobytes()], pa.binary())})

    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in range(5))
        for (group, band, tile, node, n), tokens in zip(zip(*columns, strict=True), shingle_sets(batch.column(5)), strict=True):
            if held and (group, band, tile) != key:
                yield packed()
                held = []
            key = (group, band, tile)
            held.append((node, n, tokens))
    if held:
        yield packed()


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            sides = []
            for s in ("", "2"):
                sides.append({c: np.frombuffer(row[c + s], t) for c, t in (("nodes", np.int64), ("counts", np.int64), ("sizes", np.int64), ("tokens", np.uint64))})
            left, right = sides
            _, index = np.unique(np.concatenate([left["tokens"], right["tokens"]]), return_inverse=True)
            both = common(index, left["sizes"].tolist(), right["sizes"].tolist()).astype(np.float64)
            union = left["sizes"][:, None] + right["sizes"][None, :] - both
            i, j = np.nonzero(both >= similarity * union - 1e-9)
            if (row["band"], row["tile"]) == (row["band2"], row["tile2"]):
                i, j = i[i < j], j[i < j]
                nodes, counts = left["nodes"], left["counts"]
            else:
                j = j + len(left["nodes"])
                nodes, counts = (np.concatenate([left[c], right[c]]) for c in ("nodes", "counts"))
            links = np.zeros(len(nodes), np.int64)
            np.add.at(links, i, counts[j])
            np.add.at(links, j, counts[i])
            some = np.flatnonzero(links)
            yield pa.record_batch({"node": nodes[some], "links": links[some], "root": local_roots(i, j, nodes)[some]})


def _links(sets: DataFrame, groups: DataFrame, texts: DataFrame, similarity: float, tile: int) -> DataFrame:
    """(node, links, root) of nodes in tiles that are linked: exact intersections within candidate groups.

    Sets of a group are dealt into bands by size, so wide that similar sets are in the same band or in neighbouring ones,
    and into tiles of a bounded number of sets and of tokens (a longer set is a tile of its own).
    """
    band = F.floor(F.log(F.col("size").cast("double")) / math.log((1 + 1e-6) / min(similarity, 0.99))).cast("int")
    sized = materialize(sets.join(groups, "node").select("group", band.alias("band"), "node", "n", "size", "doc_id", "key"), "sized")
    tiles = sized.groupBy("group", "band").agg(F.ceil(F.greatest(F.count("*") / tile, F.sum("size") / TILE_TOKENS)).cast("int").alias("tiles")).filter("tiles > 1")
    dealt = sized.join(materialize(tiles, "bands"), ["group", "band"], "left").withColumn("tile", F.pmod(F.xxhash64("node"), F.coalesce("tiles", F.lit(1))).cast("int"))
    # one row for each set: that of its smallest doc_id, so that no text that many documents have meets in one task
    chosen = dealt.select("group", "band", "tile", "node", "n", "doc_id", "key")
    rows = texts.join(chosen, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("group", "band", "tile", "node", "n", "text")
    packed = rows.repartition("group", "band", "tile").sortWithinPartitions("group", "band", "tile", "node").mapInArrow(_tile, "group long, band int, tile int, nodes binary, counts binary, sizes binary, tokens binary")
    packed = materialize(packed, "tiles")
    names = packed.select("group", "band", "tile")
    second = names.select("group", F.col("band").alias("band2"), F.col("tile").alias("tile2"), F.explode(F.array(F.col("band") - 1, F.col("band"))).alias("band"))
    pairs = names.join(second, ["group", "band"]).filter("band < band2 or tile <= tile2")
    other = packed.select("group", F.col("band").alias("band2"), F.col("tile").alias("tile2"), *(F.col(c).alias(c + "2") for c in ("nodes", "counts", "sizes", "tokens")))
    met = pairs.join(packed, ["group", "band", "tile"]).join(other, ["group", "band2", "tile2"])
    found = materialize(met.mapInArrow(partial(_verify, similarity=similarity), "node long, links long, root long"), "links")
    discard(sets.sparkSession, packed, sized)
    return found


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, small: int = SMALL, tile: int = TILE, with_keys: bool = False) -> DataFrame:
    """doc_id, n_links, class_id, kept for each row of ``docs``; ``with_keys`` adds text_key (16 bytes of the text's SHA-256) and class_key,
    a number that rows of one class share and no other class has (null where a row links with nothing by rule).

    Documents link when the Jaccard similarity of their shingle sets is at least ``similarity``; n_links counts other
    documents linked directly, equal ones included, and class_id is the smallest doc_id that links reach. Words are
    runs of bytes other than ASCII white space, with A to Z as a to z; a text of one to four words has a single shingle.
    Texts without a word (null, empty) and rows without a doc_id link with nothing. Repeated rows count as further
    documents, and rows that share a doc_id link by their own texts. ``small`` and ``tile`` bound what one task compares at
    once. kept marks the document that stands for its class. Other columns are not read. An empty table gives no rows.
    """
    key = F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    run = partial(_sketches, runs=runs_needed(similarity, recall, sketch=SKETCH))
    sketched = materialize(rows.mapInArrow(run, "doc_id long, key binary, set_key binary, size long, sketch binary, first_run int, paths array<long>"), "sketches")
    usable = sketched.filter("doc_id is not null and size > 0")
    least = F.min(F.struct("doc_id", "key")).alias("least")
    sets = usable.groupBy("set_key").agg(least, F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("size", "sketch", "first_run", "paths")))
    sets = materialize(sets.select("*", "least.*", F.monotonically_increasing_id().alias("node")).drop("least"), "sets")
    groups = connected_components(candidate_edges(sets, small, similarity)).withColumnRenamed("component", "group")
    groups = materialize(groups, "groups")
    found = _links(sets, groups, rows, similarity, tile)
    discard(docs.sparkSession, groups)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = materialize(connected_components(found, "node", "root"), "classes")
    lowest = classes.join(sets.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(lowest, "component").select("node", "class_id", "component")
    known = sets.select("set_key", "node", F.col("doc_id").alias("least_id"), "n").join(links, "node", "left").join(classes, "node", "left").withColumn("class_key", F.coalesce("component", "node")).drop("node", "component")
    out = sketched.select("doc_id", F.col("key").alias("text_key"), F.when(F.col("doc_id").isNotNull() & (F.col("size") > 0), F.col("set_key")).alias("set_key")).join(known, "set_key", "left")
    class_id = F.coalesce("class_id", "least_id", "doc_id")
    columns = ["doc_id", (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).cast("long").alias("n_links"), class_id.alias("class_id"), F.col("doc_id").eqNullSafe(class_id).alias("kept")]
    return out.select(*columns, *(["text_key", "class_key"] if with_keys else []))
