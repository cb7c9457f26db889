"""The kept lexical index against scores computed one by one."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import lexical_index as L
from tallyforge.operators import search as S
from tallyforge.shared import shared_folder

DOCS = "doc_id long, text string"


def words(text):
    return [w for w in re.sub("[^a-z0-9 ]+", " ", (text or "").lower()).split(" ") if w]


def bm25(docs, queries, k, k1=1.2, b=0.75):
    of = {d: Counter(words(t)) for d, t in docs}
    mean = sum(sum(c.values()) for c in of.values()) / len(of)
    df = Counter(w for c in of.values() for w in c)
    out = set()
    for q, text in queries:
        scores = []
        for d, c in of.items():
            found = [t for t in set(words(text)) if t in c]
            if found:
                size = sum(c.values())
                scores.append((-round(sum(math.log(1 + (len(of) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * size / mean)) for t in found), 6), d))
        out |= {(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted(scores)[:k])}
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{int(400 * rng.random() ** 3)}" for _ in range(n))
    docs = [(i, prose(rng.randrange(1, 60))) for i in range(600)] + [(600, None), (601, "..."), (602, "W1 w1, w1!"), (603, docs_tie := "tie tie here"), (604, docs_tie)]
    passage = "rare gems lie in this passage of words w0 w1 w2"
    docs += [(700 + i, passage + " " + prose(i)) for i in range(6)]
    queries = [(1, passage), (2, "w1 w5"), (3, "tie"), (4, "unknown"), (5, None), (6, prose(30)), (7, "W399 w398")]
    return docs, queries


def rows(found):
    return {(r.q, r.doc, r.score, r.rn) for r in found.collect()}


def test_batches_are_searched_as_one_corpus(spark, corpus):
    docs, queries = corpus
    folder = shared_folder(spark, "index")
    asked = spark.createDataFrame(queries, "q long, query string")
    for name, part in (("a", docs[:250]), ("b", docs[250:260]), ("c", docs[260:])):
        L.add_batch(spark.createDataFrame(part, DOCS), folder, name, "doc_id", "text")
    assert rows(L.search(spark, folder, asked, "q", "query", 5)) == bm25(docs, queries, 5)
    # a batch sent again, and documents that are known, change nothing; new ones are added
    L.add_batch(spark.createDataFrame(docs[250:260], DOCS), folder, "b", "doc_id", "text")
    L.add_batch(spark.createDataFrame([(3, "w1 w1 w1"), (900, "w5 gems")], DOCS), folder, "d", "doc_id", "text")
    assert rows(L.search(spark, folder, asked, "q", "query", 5)) == bm25([*docs, (900, "w5 gems")], queries, 5)
    assert L.documents(spark, folder).count() == len(docs) + 1


def test_a_batch_without_totals_is_not_seen(spark, corpus, monkeypatch):
    docs, queries = corpus
    folder = shared_folder(spark, "index")
    asked = spark.createDataFrame(queries, "q long, query string")
    L.add_batch(spark.createDataFrame(docs[:300], DOCS), folder, "a", "doc_id", "text")
    with monkeypatch.context() as m:
        m.setattr(L, "_bucket", lambda term: F.raise_error(F.lit("lost")).cast("int"))
        with pytest.raises(Exception, match="lost"):
            L.add_batch(spark.createDataFrame(docs[300:], DOCS), folder, "b", "doc_id", "text")
    assert rows(L.search(spark, folder, asked, "q", "query", 5)) == bm25(docs[:300], queries, 5)
    L.add_batch(spark.createDataFrame(docs[300:], DOCS), folder, "b", "doc_id", "text")
    assert rows(L.search(spark, folder, asked, "q", "query", 5)) == bm25(docs, queries, 5)


def test_fewer_postings_are_read_than_exist(spark, corpus):
    docs, queries = corpus
    folder = shared_folder(spark, "index")
    L.add_batch(spark.createDataFrame(docs, DOCS), folder, "a", "doc_id", "text", range_docs=8)
    asked = L.Search(spark, folder, spark.createDataFrame(queries[:1], "q long, query string"), "q", "query", 3)
    assert rows(asked.run()) == bm25(docs, queries[:1], 3)
    read, all_of = asked.blocks.agg(F.sum(F.when(F.col("read"), F.col("n"))), F.sum("n")).first()
    assert read < 0.35 * all_of
    asked.forget()


def test_block_maxima_hold_for_any_mean(spark, corpus):
    docs, _ = corpus
    folder = shared_folder(spark, "index")
    L.add_batch(spark.createDataFrame(docs, DOCS), folder, "a", "doc_id", "text")
    for block in L.postings(spark, folder).collect():
        assert list(block.docs) == sorted(block.docs) and block.docs[0] == 0 and block.n == len(block.docs)
        for mean in (1.0, 30.0, 500.0):
            part = lambda tf, size: tf / (tf + 1.2 * (0.25 + 0.75 * size / mean))  # noqa: B023, E731
            assert max(part(t.tf, t.size) for t in block.tops) == max(map(part, block.tfs, block.sizes))


def test_index_of_no_documents(spark):
    folder = shared_folder(spark, "index")
    L.add_batch(spark.createDataFrame([], DOCS), folder, "a", "doc_id", "text")
    assert L.search(spark, folder, spark.createDataFrame([(1, "a")], "q long, query string"), "q", "query", 3).count() == 0


@pytest.mark.parametrize(("asked", "cells"), [(256, 1 << 22), (2, 500)])
def test_scan_of_documents_without_an_index(spark, corpus, monkeypatch, asked, cells):
    """In one pass and block, and in several of both; no word becomes a row."""
    docs, queries = corpus
    monkeypatch.setattr(S, "CELLS", cells)
    tables = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(queries, "q long, query string")
    found = S.bm25_scan(*tables, "doc_id", "text", "q", "query", 5, asked=asked)
    assert rows(found) == bm25(docs, queries, 5)
    assert "Explode" not in found._jdf.queryExecution().optimizedPlan().toString().title()
    assert S.bm25_scan(tables[0].limit(0), tables[1], "doc_id", "text", "q", "query", 5).count() == 0
