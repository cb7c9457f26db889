"""The pipeline's stages on a small table, one after another."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    make = lambda n: " ".join(rng.choice("the and house water green tree of river stone".split()) + str(rng.randrange(50)) for _ in range(n))
    block = "a line of text\nanother line of text\nthird line of text"
    base = make(60)
    texts = [base, base.replace(base.split()[30], "edit", 1), block + "\n" + make(30), make(30) + "\n" + block, None, "12 + 34"] + [make(40) for _ in range(30)]
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs):
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language", "lines", "near_duplicates", "mixture", "tokens"]
    kept = stage["language"](spark, docs, "")
    assert kept.columns == NAMES
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {4, 5}
    lines = stage["lines"](spark, kept, "").cache()
    assert lines.columns == NAMES
    texts = {r.doc_id: r for r in lines.collect()}
    assert "another line of text" in texts[2].text and "another line of text" not in texts[3].text
    assert all(r.n_chars == len(r.text) for r in texts.values())
    near = stage["near_duplicates"](spark, lines, "").cache()
    assert near.columns == NAMES
    assert set(texts) - {r.doc_id for r in near.collect()} == {1}
    mixed = stage["mixture"](spark, near, "").cache()
    assert mixed.columns == NAMES
    times = [r["count"] for r in mixed.groupBy("doc_id").count().collect()]
    assert max(times) == 2 and 1.3 * near.count() < mixed.count() < 1.7 * near.count()
    tokens = stage["tokens"](spark, mixed, "")
    assert tokens.count() == mixed.count()


def test_stages_with_odd_rows(spark, docs):
    """Null ids and texts, repeated rows, empty and long texts, and columns with the names that stages use themselves."""
    first = docs.first()
    more = [tuple(first), tuple(first), (None, "the house and the water of the river", "en", None, 4), (900, None, None, None, None), (901, "", "en", "s1", 0), (902, "house river " * 30_000, "en", "s1", 1)]
    clash = {c: F.lit("own") for c in ("__dropped", "__key", "__id", "__of", "__gone", "n_lines", "n_removed", "hash", "copies", "lang_pred")}
    odd = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumns(clash)
    stage = dict(corpus_pipeline.STAGES)
    out = odd
    for name in ("language", "lines", "near_duplicates", "mixture"):
        out = stage[name](spark, out, "").cache()
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert rows and all(r[c] == "own" for r in rows for c in clash), name
        copies = sum(r.doc_id == first.doc_id for r in rows)
        # of the rows that repeat doc_id and text the near-duplicate stage keeps one
        assert copies == {"language": 3, "lines": 3, "near_duplicates": 1}.get(name, copies)
        assert any(r.doc_id is None for r in rows) or name == "mixture"
        assert any(r.doc_id == 902 for r in rows) or name == "mixture"
        assert stage[name](spark, odd.limit(0), "").count() == 0
    assert stage["tokens"](spark, out, "").count() == out.count()
    assert stage["tokens"](spark, odd.limit(0), "").count() == 0


def test_run_is_the_stages_one_after_another(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = docs
    for _, stage in corpus_pipeline.STAGES:
        want = stage(spark, want, "").cache()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) and len(got) > 30


def test_near_duplicates_with_repeated_ids_against_brute_force(spark):
    """Rows that share a doc_id fall or stay by their own texts; repeats stay once; null ids and texts without words stay."""
    rng = random.Random(7)
    make = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    edit = lambda t: " ".join([*t.split()[:-1], f"x{rng.randrange(99)}"])
    t, u, alone = make(60), make(60), make(50)
    rows = [(1, t), (5, edit(t)), (5, u), (7, t), (9, edit(u)), (9, alone), (9, alone), (9, alone), (3, None), (3, None), (4, ""), (None, t), (None, t)]
    for i in range(30):
        base = make(40)
        rows += [(rng.randrange(12), base)] * rng.choice([1, 1, 2]) + [(rng.randrange(12), edit(base)) for _ in range(rng.randrange(3))]

    def grams(text):
        w = (text or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(text) for _, text in rows]
    usable = [i for i, (d, _) in enumerate(rows) if d is not None and sets[i]]
    root = {i: i for i in usable}
    for _ in usable:
        for i in usable:
            for j in usable:
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    classes = {}
    for i in usable:
        classes.setdefault(root[i], set()).add((rows[i][0], hashlib.sha256(rows[i][1].encode()).digest(), rows[i][1]))
    want = sorted([(d, text) for d, _, text in map(min, classes.values())] + [r for i, r in enumerate(rows) if i not in root], key=str)
    docs = spark.createDataFrame([(d, text, "en", "s", 1) for d, text in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want
    assert (5, u) in want and (9, alone) in want
