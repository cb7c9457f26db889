"""Treap search, vector codes and repeated windows against brute force, on rows with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm.runs import SEGMENT, SPACE, RunHashes, byte_runs
from tallyforge.llm.substring_dedup import level_lengths, substring_dedup
from tallyforge.llm.treaps import Treaps, ranked_search, term_codes, treap_links
from tallyforge.llm.vector_codes import compress_vectors, nearest, with_label_errors

DOCS = "doc_id long, text string, score long, rank string, v string"


def prose(rng: random.Random, n: int, size: int = 300) -> str:
    return " ".join(f"w{int(size * rng.random() ** 3)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    passage = prose(rng, 50, 10**6)
    texts = [None, "", "...", "Ünï ünï ÜNÏ x9 X9_x9", passage, passage, prose(rng, 30) + "\n" + passage + "\t" + prose(rng, 40), "same " * 90, "x" * 5000]
    texts += [prose(rng, 34, 10**6), " ".join(["a", "b"] * 40), prose(rng, 60)] + [prose(rng, rng.randrange(200)) for _ in range(60)]
    texts += [passage.replace(" ", "\r\n ", 20), passage.upper(), prose(rng, 6000)]
    out = [(i, t, 1, "r", None) for i, t in enumerate(texts)]
    return [*out, out[4], out[30], (30, "other w1 text", None, None, None), (None, passage, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_byte_runs_and_hashes():
    texts = [b"", b" a bb", b"bb", b"\tccc d\n", b"", b"y" * (SEGMENT + 5), b"y" * (SEGMENT + 5) + b" " + b"y" * (SEGMENT + 4)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts, stops = byte_runs(data, ends, ~SPACE)
    words = [data[a:b].tobytes() for a, b in zip(starts, stops, strict=True)]
    assert words == [w for t in texts for w in t.split()]
    hashes = RunHashes(5).of(data, starts, stops)
    assert len(set(hashes.tolist())) == len(set(words)) and hashes[1] == hashes[2]
    assert len(byte_runs(data[:0], ends[:1], ~SPACE)[0]) == 0


# -- ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def ranked(rows, items, k=10):
    found = [(r[0], Counter(terms(r[1]))) for r in rows]
    found = [(d, c) for d, c in found if c]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for item_id, text in items:
        asked.setdefault(item_id, set()).update(terms(text))
    out = []
    for item_id, of in asked.items():
        scores = []
        for doc_id, c in found:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in of if t in c)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out += [(item_id, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize("shard_bytes", [1, 2000, 1 << 20])
def test_ranked_search(spark, docs, rows, shard_bytes):
    rng = random.Random(3)
    items = [(1, "w1 w1 W0"), (2, None), (3, ""), (4, "ünï x9"), (5, rows[4][1]), (6, "unknown"), (None, "w5 w7"), (7, prose(rng, 80)), (1, "w9"), (8, "other same"), (9, "w0")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search(docs, table, shard_bytes=shard_bytes).collect())
    assert got == ranked(rows, items)
    assert (4, 1, 3) in {r[:3] for r in got}


def test_ranked_search_over_many_items_without_broadcast(spark, docs, rows, monkeypatch):
    import tallyforge.llm.treaps as treaps

    rng = random.Random(6)
    items = [(i, prose(rng, 6)) for i in range(50)]
    monkeypatch.setattr(treaps, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(treaps, "BLOCK", 7)
    monkeypatch.setattr(treaps, "SALTED", 2)
    got = ranked_search(docs, spark.createDataFrame(items, "item_id long, text string"), k=4, shard_bytes=3000)
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()) == ranked(rows, items, 4)


def test_ranked_search_of_empty_tables(spark, docs):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert ranked_search(none, items).count() == 0 and ranked_search(docs, items).count() == 0
    assert ranked_search(none, spark.createDataFrame([(1, "a")], items.schema)).count() == 0
    assert ranked_search(spark.createDataFrame([(1, None), (2, "!")], items.schema).toDF("doc_id", "text"), spark.createDataFrame([(1, "a")], items.schema)).count() == 0


def _treaps(rng, n_docs, sizes, weights):
    lists = [np.sort(rng.choice(n_docs, s, replace=False)) for s in sizes]
    impacts = [(rng.pareto(1.5, len(d)) * 50).astype(np.int64) + 1 for d in lists]
    first = np.cumsum([0, *sizes[:-1]])
    left, right, roots = treap_links(np.concatenate(impacts), np.concatenate(lists), first)
    local = lambda x, a, s: np.where(x[a : a + s] < 0, -1, x[a : a + s] - a)
    return lists, impacts, roots, Treaps(lists, impacts, weights, [local(left, a, s) for a, s in zip(first, sizes, strict=True)], [local(right, a, s) for a, s in zip(first, sizes, strict=True)])


def test_treap_order_and_pruning():
    rng = np.random.default_rng(2)
    sizes, weights = [30000, 20000, 9000, 400, 1], [3, 40, 100, 900, 5000]
    lists, impacts, roots, treaps = _treaps(rng, 60000, sizes, weights)
    assert (treaps.root == roots).all()
    for child, side in ((treaps.left, -1), (treaps.right, 1)):
        at = np.flatnonzero(child >= 0)
        assert (np.sign(treaps.docs[child[at]] - treaps.docs[at]) == side).all() and (treaps.value[child[at]] <= treaps.value[at]).all()
    scores = np.zeros(60000, np.int64)
    for d, i, w in zip(lists, impacts, weights, strict=True):
        scores[d] += i * w
    want = sorted(((int(s), d) for d, s in enumerate(scores) if s), key=lambda x: (-x[0], x[1]))[:10]
    for leaf in (1, 64, 4096):
        got, scored = treaps.best(np.arange(5), 10, leaf)
        assert got == want
        if leaf == 64:
            # fewer than a quarter of the postings are looked at
            assert scored < sum(sizes) / 4


def test_treap_links_of_equal_and_falling_impacts():
    for impact in (np.full(3000, 7), np.arange(3000)[::-1], np.arange(3000)):
        left, right, roots = treap_links(impact, np.arange(3000), np.array([0, 1000]))
        assert len(roots) == 2 and (left >= 0).sum() + (right >= 0).sum() == 2998


def test_term_codes():
    texts = ["", "Ab aB", "é1-É1", "", "ab"]
    raw = [t.encode() for t in texts]
    found, of, doc = term_codes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(t) for t in raw]))
    assert [(found[int(o)].as_py().decode(), int(d)) for o, d in zip(of, doc, strict=True)] == [("ab", 1), ("ab", 1), ("é1", 2), ("É1", 2), ("ab", 4)]


# -- vector codes


def test_nearest_drops_entries_early():
    rng = np.random.default_rng(4)
    book = rng.integers(-400, 400, (256, 16))
    book[9] = book[3]
    x = np.concatenate([book[rng.integers(0, 256, 900)] + rng.integers(-60, 60, (900, 16)), book[[9, 3]]])
    all_pairs = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    index, distance, added = nearest(x, book)
    assert (index == all_pairs.argmin(axis=1)).all() and (distance == all_pairs.min(axis=1)).all() and index[-2] == 3
    assert added < len(x) * 256 * 16 / 2


def coded(rows, parts=4, entries=256, rounds=4):
    kept = [(i, tuple(v or ()), lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return Counter()
    width = -(-max(max(len(v) for _, v, _ in kept), 1) // parts)
    kept = sorted(((i is None, i or 0, [math.floor(1024 * x) for x in v] + [0] * (width * parts - len(v)), i, lab) for i, v, lab in kept), key=lambda r: r[:3])
    cut = lambda v, p: np.array(v[p * width : (p + 1) * width])
    books = [[cut(r[2], p) for r in kept[:entries]] for p in range(parts)]
    pick = lambda v, p: min(((int(((cut(v, p) - e) ** 2).sum()), k) for k, e in enumerate(books[p])))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for r in kept:
                of.setdefault(pick(r[2], p)[1], []).append(cut(r[2], p))
            for k, found in of.items():
                books[p][k] = np.array([int(s) // len(found) for s in np.sum(found, axis=0)])
    out = [(r[3], r[4], [pick(r[2], p) for p in range(parts)]) for r in kept]
    errors = Counter()
    for _, lab, found in out:
        errors[lab] += sum(d for d, _ in found)
    return Counter((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), errors[lab]) for i, lab, found in out)


def test_vector_codes(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)], [1, 1, 1, 2, None][i % 5]) for i in range(60)]
    rows += [rows[5], rows[5], (5, [0.5] * 8, 1), (None, [0.1] * 8, 2), (None, None, 1), (70, None, None), (71, [1.0] * 7 + [None], 1), (72, [float("nan")] * 8, 1), (73, [float("inf")] * 8, 1), (74, [], 3), (75, [0.25, -1.0], None), (76, [-0.0] * 8, 2)]
    for entries in (256, 12):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"error": F.lit(1), "v": F.lit("x"), "code": F.lit(2)}).repartition(3)
        codes, books = compress_vectors(table, entries=entries)
        got = with_label_errors(codes).select("vec_id", "code", "error", "label_error")
        assert Counter(map(tuple, got.collect())) == coded(rows, entries=entries)
        assert len(books) == 4 and books[0].shape == (min(entries, 67), 2)


def test_vector_codes_of_an_empty_table(spark):
    none = spark.createDataFrame([(1, None, None)], "vec_id long, embedding array<float>, label int")
    codes, books = compress_vectors(none)
    assert with_label_errors(codes).count() == 0 and books == []
    assert compress_vectors(none.limit(0))[0].count() == 0


# -- repeated windows


def windowed(rows, window=35):
    texts = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = Counter()
    for doc_id, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out[doc_id, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)] += 1
    return out


def test_level_lengths():
    assert level_lengths(35) == [9, 18, 35] and level_lengths(3) == [3] and level_lengths(16) == [8, 16]
    assert all(b <= 2 * a for n in range(1, 200) for a, b in zip(level_lengths(n)[:-1], level_lengths(n)[1:], strict=True))


@pytest.mark.parametrize(("window", "part_bytes"), [(35, 8 << 20), (35, 1), (3, 500), (16, 3000), (70, 100)])
def test_substring_dedup(docs, rows, window, part_bytes):
    want = windowed(rows, window)
    assert Counter(map(tuple, substring_dedup(docs, window=window, part_bytes=part_bytes).collect())) == want
    if window == 35:
        assert sum(k[3] for k in want) > 200


def test_substring_dedup_ends_early_and_takes_empty_tables(spark, docs):
    assert substring_dedup(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(99))), (2, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_dedup(alone).collect()) == [0, 0]


def test_a_passage_of_all_documents_is_one_name_a_part(spark):
    """A part sends each distinct window once, so the rows and names that a hot passage sends don't grow with its occurrences."""
    from functools import partial

    from tallyforge.llm.substring_dedup import _pack, _send

    passage = " ".join(f"p{i}" for i in range(40))
    sent = {}
    for n in (200, 400):
        table = pa.record_batch({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array([f"{passage} z{i}" for i in range(n)])})
        df = spark.createDataFrame(table.to_pandas()).coalesce(1)
        parts = df.mapInArrow(partial(_pack, part_bytes=1 << 20), "part long, ids array<long>, lengths binary, z binary, words long")
        out = parts.mapInArrow(partial(_send, lengths=[35], sizes=[12], ranges=1), "range int, part long, n long, high binary, low binary, twice binary")
        sent[n] = out.agg(F.sum("n")).first()[0]
    assert sent[400] == sent[200] + 200
