"""Ranked lexical search over inverted treaps.

Documents are dealt into shards of a few MB of text. In a shard each term has a treap: its postings in order of
the document (the search order of the tree), with links that put the greatest impact of any range on top (the heap order;
equal impacts are ordered by a hash, so that the tree stays shallow). A row of the index is one treap.

A query's treaps are traversed at once, from the interval of all documents: the sum of the terms' top impacts in an
interval bounds the score of each document in it. The interval of the greatest bound is split at the document of its
greatest impact, for which each treap is searched; intervals with few postings are scored at once. An interval whose bound
is below the k-th score found so far is pruned with all its subtrees. Each shard gives its k best, and
the k best of these are the answer.

Impacts hold all of a score but the term's weight, which comes from the number of documents with the term when a
query is asked. Scores are integers, so neither shards nor their order show in the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, mix64, utf8_views
from .runs import byte_runs, gather

SHARD_BYTES = 12 << 20
#: Postings of an interval that are scored at once instead of being split further.
LEAF = 4096
#: Queries that meet a shard together; bytes of terms and weights that are broadcast; shards to a task where they aren't.
BLOCK, BROADCAST_BYTES, SALTED = 256, 8 << 20, 64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters and digits of ASCII, and all bytes of other characters.
TERM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def term_codes(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms, the number of each occurrence's term, and of its text."""
    starts, stops = byte_runs(data, np.unique(ends), TERM)
    lengths = stops - starts
    kept = LOWER[data[gather(starts, lengths)]]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(ends, starts, "right")


# -- the index


def _nearest_greater(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it, in its own list, whose key is greater, or -1. Keys of a list differ."""
    before = np.arange(-1, len(key) - 1)
    before[first] = -1
    todo = np.flatnonzero(before >= 0)
    todo = todo[key[before[todo]] < key[todo]]
    while len(todo):
        before[todo] = before[before[todo]]
        todo = todo[before[todo] >= 0]
        todo = todo[key[before[todo]] < key[todo]]
    return before


def treap_links(impact: np.ndarray, docs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right child of each posting (-1: none) and the root of each list; lists begin at ``first``."""
    n = len(impact)
    key = impact.astype(np.uint64) << np.uint64(32) | (mix64(docs.astype(np.uint64) + np.uint64(1)) >> np.uint64(32))
    left, right = np.full(n, -1), np.full(n, -1)
    if not n:
        return left, right, np.zeros(0, np.int64)
    before = _nearest_greater(key, first)
    after = _nearest_greater(key[::-1], n - np.append(first[1:], n))
    after = np.where(after < 0, -1, n - 1 - after)[::-1]
    is_right = (before >= 0) & ((after < 0) | (key[before] < key[after]))
    is_left = (after >= 0) & ~is_right
    right[before[is_right]] = np.flatnonzero(is_right)
    left[after[is_left]] = np.flatnonzero(is_left)
    return left, right, np.flatnonzero((before < 0) & (after < 0))


def _blobs(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary for each list of ``values``, without a copy."""
    offsets = np.append(first, len(values)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


INDEX_DDL = "shard long, term binary, n long, docs binary, impacts binary, left binary, right binary, ids array<long>"


def _shard_rows(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

    def rows() -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        data = np.concatenate([texts[i] for i in order])
        terms, of, doc = term_codes(data, np.cumsum([len(texts[i]) for i in order]))
        sizes = np.bincount(doc, minlength=len(order))
        norm = np.array([10 + 90 * int(s) * n_docs // max(1, n_terms) for s in sizes], np.int64)
        keys, tf = np.unique(of * len(order) + doc, return_counts=True)
        term, doc = np.divmod(keys, len(order))
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * norm[doc])
        first = np.searchsorted(term, np.arange(len(terms)))
        left, right, roots = treap_links(impact, doc, first)
        count = np.diff(np.append(first, len(doc)))
        base, small = np.repeat(first, count), len(order) < 1 << 15
        link = lambda x: _blobs(np.where(x < 0, -1, x - base).astype(np.int16 if small else np.int32), first)
        nulls = pa.nulls(len(terms), pa.list_(pa.int64()))
        columns = [pa.array(np.full(len(terms), shard)), terms, pa.array(count), _blobs(doc.astype(np.uint16 if small else np.uint32), first), _blobs(impact.astype(np.uint32), first), link(left), link(right), nulls]
        names = ["shard", "term", "n", "docs", "impacts", "left", "right", "ids"]
        for at in range(0, len(terms), 1 << 16):
            yield pa.record_batch([c.slice(at, 1 << 16) for c in columns], names=names)
        empty = pa.array([b""], pa.binary())
        yield pa.record_batch([pa.array([shard]), empty, pa.array([0]), empty, empty, empty, empty, pa.array([[ids[i] for i in order]], pa.list_(pa.int64()))], names=names)

    for batch in batches:
        data, at = utf8_views(batch.column(1))
        for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
            ids.append(doc_id)
            texts.append(data[a:b].copy())
            size += int(b - a)
            if size >= shard_bytes:
                yield from rows()
                ids, texts, size, shard = [], [], 0, shard + 1
    if ids:
        yield from rows()


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8_views(batch.column(0))
        data, ends = data[at[0] : at[-1]], at[1:] - at[0]
        starts, _ = byte_runs(data, np.unique(ends), TERM)
        counts = np.bincount(np.searchsorted(ends, starts, "right"), minlength=batch.num_rows)
        yield pa.record_batch({"n_docs": pa.array([int((counts > 0).sum())], pa.int64()), "n_terms": pa.array([int(counts.sum())], pa.int64())})


def treap_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """The index as a table in the shared folder, and the number of documents with at least one term.

    A row is a treap: shard, term (lower-case UTF-8), n postings, docs (numbers of documents within the shard, ascending), impacts, left
    and right (children's places). The row of the empty term has the shard's doc_ids, in ascending order, null last.
    """
    totals = docs.select(text).mapInArrow(_totals, "n_docs long, n_terms long").agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).first()
    n_docs, n_terms = totals.d or 0, totals.t or 0
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    index = rows.mapInArrow(partial(_shard_rows, n_docs=n_docs, n_terms=n_terms, shard_bytes=shard_bytes), INDEX_DDL)
    return materialize(index, "treaps"), n_docs


# -- the search


class Treaps:
    """The treaps of one shard, one after another; contributions are impacts times weights."""

    def __init__(self, docs: list[np.ndarray], impacts: list[np.ndarray], weights: list[int], left: list[np.ndarray], right: list[np.ndarray]):
        count = np.array([len(d) for d in docs], np.int64)
        self.begin = np.cumsum(count) - count
        self.end = self.begin + count
        shift = np.repeat(self.begin, count)
        self.docs = np.concatenate(docs).astype(np.int64)
        self.value = np.concatenate([i.astype(np.int64) * w for i, w in zip(impacts, weights, strict=True)])
        self.left, self.right = (np.where(x < 0, -1, x + shift) for x in (np.concatenate(s).astype(np.int64) for s in (left, right)))
        linked = np.zeros(len(self.docs), bool)
        for child in (self.left, self.right):
            linked[child[child >= 0]] = True
        self.root = np.flatnonzero(~linked)

    def split(self, node: np.ndarray, end: np.ndarray, doc: int) -> np.ndarray:
        """For each treap the first posting of ``doc`` or a later document, searched from ``node`` down."""
        at, now, live = end.copy(), node.copy(), np.arange(len(node))
        while len(live):
            here = now[live]
            up = self.docs[here] >= doc
            at[live[up]] = np.minimum(here[up], end[live[up]])
            now[live] = np.where(up, self.left[here], self.right[here])
            live = live[now[live] >= 0]
        return at

    def top(self, node: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The posting of greatest impact in [begin, end), which isn't empty, searched from ``node`` down."""
        now = node.copy()
        while True:
            below, above = now < begin, now >= end
            if not (below | above).any():
                return now
            now = np.where(below, self.right[now], np.where(above, self.left[now], now))

    def best(self, terms: np.ndarray, k: int, leaf: int = LEAF) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, document), equal scores by document, and how many postings were scored or searched for."""
        found: list[tuple[int, int]] = []
        scored = 0

        def offer(score: int, doc: int) -> None:
            if score > 0 and (len(found) < k or (score, -doc) > found[0]):
                (heapq.heappush if len(found) < k else heapq.heapreplace)(found, (score, -doc))

        node, begin, end = self.root[terms], self.begin[terms], self.end[terms]
        heap = [(-int(self.value[node].sum()), 0, node, begin, end)] if len(terms) else []
        made = 1
        while heap:
            bound, _, node, begin, end = heapq.heappop(heap)
            if not bound or len(found) == k and -bound < found[0][0]:
                break
            if int((end - begin).sum()) <= leaf:
                at = gather(begin, end - begin)
                scored += len(at)
                docs = self.docs[at]
                low = int(docs.min())
                sums = np.bincount(docs - low, weights=self.value[at])
                least = found[0][0] if len(found) == k else 1
                hits = np.flatnonzero(sums >= least)
                if len(hits) > k:
                    hits = hits[np.lexsort((hits, -sums[hits]))[:k]]
                for h in hits.tolist():
                    offer(int(sums[h]), h + low)
                continue
            doc = int(self.docs[node[self.value[node].argmax()]])
            middle = self.split(node, end, doc)
            inside = np.minimum(middle, end - 1)
            hit = (middle < end) & (self.docs[inside] == doc)
            scored += len(node)
            offer(int(self.value[inside[hit]].sum()), doc)
            for a, b in ((begin, middle), (middle + hit, end)):
                some = a < b
                if some.any():
                    a, b = a[some], b[some]
                    top = self.top(node[some], a, b)
                    heapq.heappush(heap, (-int(self.value[top].sum()), made, top, a, b))
                    made += 1
        return sorted(((s, -d) for s, d in found), key=lambda x: (-x[0], x[1])), scored


def _search(rows: pa.Table, k: int) -> pa.Table:
    """The k best documents of one shard for each query of a block."""
    out: dict[str, list] = {"item_id": [], "doc_id": [], "score": []}
    ids, treaps, of = None, [], {}
    for row in rows.to_pylist():
        if row["ids"] is not None:
            ids = row["ids"]
            continue
        for item in row["items"]:
            of.setdefault(item["item_id"], []).append(len(treaps))
        wide = len(row["docs"]) == 4 * row["n"]
        treaps.append((np.frombuffer(row["docs"], np.uint32 if wide else np.uint16), np.frombuffer(row["impacts"], np.uint32), row["weight"], *(np.frombuffer(row[c], np.int32 if wide else np.int16) for c in ("left", "right"))))
    if treaps:
        shard = Treaps(*map(list, zip(*treaps, strict=True)))
        for item_id, terms in of.items():
            for score, doc in shard.best(np.array(terms), k)[0]:
                out["item_id"].append(item_id)
                out["doc_id"].append(ids[doc])
                out["score"].append(score)
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8_views(batch.column(1))
        terms, of, row = term_codes(data[at[0] : at[-1]], at[1:] - at[0])
        keys = np.unique(row * max(1, len(terms)) + of)
        row, of = np.divmod(keys, max(1, len(terms)))
        yield pa.record_batch({"item_id": batch.column(0).take(pa.array(row)), "term": terms.take(pa.array(of))})


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", query: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: for each item its k documents of highest score above 0, equal scores by ascending doc_id.

    Null and empty texts have no term: such documents are never found and count for nothing, such items find nothing. Rows of documents that
    repeat a doc_id are documents of their own; rows of items that share an item_id (null too) are one item with the terms of all. A null
    doc_id comes after all others. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    index, n_docs = treap_index(docs, doc_id, text, shard_bytes)
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(query).alias("text")).mapInArrow(_item_terms, "item_id long, term binary").distinct()
    asked = materialize(asked, "terms")
    stats = asked.agg(F.count_distinct(F.coalesce("item_id", F.lit(-1))).alias("items"), (F.sum(F.octet_length("term")) + 64 * F.count("*")).alias("bytes")).first()
    small = (stats.bytes or 0) <= BROADCAST_BYTES
    near = F.broadcast if small else lambda df: df
    block = F.pmod(F.xxhash64("item_id"), F.lit(-(-(stats.items or 1) // BLOCK))).alias("block")
    spread = index.select("term", "n").join(near(asked.select("term").distinct()), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2 * n_docs + 2).cast("double")) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    wanted = asked.join(spread, "term").groupBy(block, "term").agg(F.first(weight).alias("weight"), F.collect_list(F.struct("item_id")).alias("items"))
    heads = asked.select(block).distinct().select("block", F.lit(b"").alias("term"), F.lit(0).cast("long").alias("weight"), F.array().cast("array<struct<item_id:bigint>>").alias("items"))
    wanted = materialize(wanted.unionByName(heads), "wanted")
    if small:
        met = index.join(F.broadcast(wanted), "term")
    else:
        salts = 1 + index.filter(F.octet_length("term") == 0).count() // SALTED
        dealt = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = index.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(salts)).cast("int")).join(dealt, ["term", "salt"])

    def search(rows: pa.Table) -> pa.Table:
        return _search(rows, k)

    met = met.select("block", "shard", "weight", "n", "docs", "impacts", "left", "right", "ids", "items")
    best = materialize(met.groupBy("block", "shard").applyInArrow(search, "item_id long, doc_id long, score long"), "best")
    discard(spark, index, asked, wanted)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
