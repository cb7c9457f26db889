"""The operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tallyforge.llm.bitplane import crc32_joined, pack_block, read_index, read_segments, unpack_block, write_ids
from tallyforge.llm.bpe import DuckBpe, bpe_decode, bpe_encode, read_ranks
from tallyforge.llm.components import connected_components
from tallyforge.llm.embed_dedup import near_vectors
from tallyforge.llm.exact_dedup import chunk_ends, exact_dedup
from tallyforge.llm.langid import identify_language, keep_identified
from tallyforge.llm.line_dedup import line_dedup
from tallyforge.llm.mixing import mix, mixed_rows, route, source_targets
from tallyforge.llm.ngram_join import SKETCH, _large_bucket, least_agreement, ngram_join, picks, runs_needed
from tallyforge.llm.pieces import split_texts
from tallyforge.llm.pii import find_pii, redact
from tallyforge.llm.shingles import shingle_sets
from tallyforge.llm.suffix_dedup import COVER, V, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, hash long"


def words(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base, passage = words(rng, 80), words(rng, 60)
    near = base.split()
    near[40] = "changed"
    texts = [None, "", "a", "four words are here", base, base, " ".join(near), passage + " " + words(rng, 50), words(rng, 40) + "\n" + passage, "x" * 3000, "né " * 200 + "日本", "1 " * 400]
    texts += ["one line here\ntwo line here\nthree line here\nfour line here\nfive", "zero\none line here\ntwo line here\nthree line here\nother\n\n\n\n\n"]
    texts += [words(rng, 30) for _ in range(12)] + [words(rng, 9000, 5000)]
    out = [(i, t, ["en", "de", None][i % 3], [None, "b", "a", "b"][i % 4], None if t is None else len(t), "clash", 7) for i, t in enumerate(texts)]
    return [*out, out[4], (None, base, None, None, 1, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_dedup(docs, rows):
    assert {(a - b) % V for a in COVER for b in COVER} == set(range(V))
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[i : i + 200] for _, t in raw for i in range(len(t) - 199))
    want = Counter()
    for doc_id, t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    assert Counter(map(tuple, suffix_dedup(docs).collect())) == want
    assert sum(k[2] for k in want) > 3000


def shingles(text):
    found = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


@pytest.mark.parametrize("small", [256, 3])
def test_ngram_join(docs, rows, small):
    sets = [(r[0], shingles(r[1])) for r in rows]
    near = lambda a, b: a and b and len(a & b) >= 0.8 * len(a | b)
    want, root = Counter(), {r[0]: r[0] for r in rows if r[0] is not None}
    linked = [[j for j, (y, b) in enumerate(sets) if i != j and x is not None and y is not None and near(a, b)] for i, (x, a) in enumerate(sets)]
    for _ in rows:
        for i, others in enumerate(linked):
            for j in others:
                root[sets[i][0]] = root[sets[j][0]] = min(root[sets[i][0]], root[sets[j][0]])
    for (doc_id, _), others in zip(sets, linked, strict=True):
        of = root.get(doc_id)
        want[doc_id, len(others), of, of == doc_id] += 1
    assert Counter(map(tuple, ngram_join(docs, small=small, tile=small).collect())) == want
    assert root[6] == 4


def test_runs_needed():
    assert runs_needed(0.8, 0.999, branch=2.5) == 5 and runs_needed(0.8, 0.999, branch=2.0) == 7
    assert runs_needed(0.9, 0.99) <= runs_needed(0.8, 0.999)


def test_ngram_join_finds_long_contained_texts(spark):
    """Pairs at 0.80 to 0.82 whose sketches agree in less than 0.72 by chance: a text and its start."""
    rng, texts, want = random.Random(8), [], 0
    while want < 12:
        whole = [f"w{rng.randrange(10**6)}" for _ in range(404)]
        pair = [" ".join(whole), " ".join(whole[: 4 + rng.randrange(320, 329)])]
        a, b = (set(s[:SKETCH].tolist()) for s in shingle_sets(pa.array(pair)))
        if len(a & b) < 0.72 * SKETCH:
            assert 0.8 * len(shingles(pair[0])) <= len(shingles(pair[1])) <= 0.82 * len(shingles(pair[0]))
            texts, want = texts + pair, want + 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.n_links, r.class_id) for r in ngram_join(docs).collect()} == {(i, 1, i - i % 2) for i in range(2 * want)}


def test_ngram_join_with_repeated_ids_and_empty_table(spark, empty):
    rng = random.Random(5)
    a, b = words(rng, 60, 10**6), words(rng, 60, 10**6)
    edit = lambda t: " ".join([*t.split()[:-1], "x"])
    df = spark.createDataFrame([(1, a), (2, edit(a)), (1, b), (3, edit(b))], "doc_id long, text string")
    assert Counter(map(tuple, ngram_join(df).collect())) == Counter([(1, 1, 1, True), (2, 1, 1, False), (1, 1, 1, True), (3, 1, 1, False)])
    assert ngram_join(empty).count() == 0


def test_roots_meet_sets_before_their_paths(spark, monkeypatch):
    """Once a large bucket has given roots, the outer join with them has a row for each set, not for each path of a set."""
    from tallyforge.llm import ngram_join as N

    seen, sizes = [], N._sizes
    monkeypatch.setattr(N, "_sizes", lambda rows, least: (seen.append(rows), sizes(rows, least))[1])
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base, f"x{k}"]) for k in range(60)]
    assert {r.n_links for r in N.ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), small=40, tile=64).collect()} == {59}
    plans = [rows._jdf.queryExecution().analyzed().toString() for rows in seen]
    joined = [p for p in plans if "LeftOuter" in p]
    assert joined and all(-1 < p.find("Generate explode") < p.find("LeftOuter") for p in joined)


def test_ngram_join_of_a_large_group(spark):
    """Copies of one text with some words changed in each, in buckets far over the limit, against exact sets; some copies are
    changed too much to be near any pivot."""
    rng = random.Random(12)
    base = words(rng, 60, 10**6).split()
    texts = []
    for i in range(420):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 4, 9, 14])):
            copy[rng.randrange(60)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    sets = [shingles(t) for t in texts]
    links, root = [0] * len(sets), list(range(len(sets)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    for _ in sets:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), small=40, tile=64).collect()}
    assert sum(links) > 1000 and got == {i: (links[i], root[i]) for i in range(len(sets))}


def test_large_bucket_keeps_neighbours_of_what_a_pivot_settles():
    """1 is settled by the pivot 0; 2 is like 1 but just less near the pivot, and must join their group."""
    cut = least_agreement(0.8)
    gone = SKETCH - round(cut * SKETCH)
    pivot, settled = np.arange(SKETCH), np.arange(SKETCH // 4, SKETCH // 4 + SKETCH)
    like = np.concatenate([settled[gone:], np.arange(1000, 1000 + gone)])
    assert len(np.intersect1d(settled, like)) == cut * SKETCH
    rows = [(0, pivot, True), (0, pivot, False), (1, settled, False), (2, like, False)]
    table = pa.table({"path": [5] * 4, "tile": [0] * 4, "node": [r for r, *_ in rows], "root": pa.array([None] * 4, pa.int64()), "sketch": [s.astype(np.uint32).tobytes() for _, s, _ in rows], "whole": [False] * 4, "pivot": [p for *_, p in rows]})
    edges = _large_bucket(table, cut, True).to_pylist()
    assert {(e["a"], e["b"]) for e in edges if e["path"] is None} == {(1, 0), (2, 0)}
    assert runs_needed(0.8, 0.999, sketch=SKETCH) >= runs_needed(0.8, 0.999)


def luhn(s):
    return sum(d - 9 * (d > 9) for d in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(s)))) % 10 == 0


def base_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii(spark, empty):
    rng = random.Random(2)
    bits = ["@", "a", "b.c", ".", "1", "22", "255", "256", "4111 1111 1111 1111", "4111111111111111", "+", "+1 (555) 123-4567", "-", " ", "x@y.z", "é", "1.2.3.4", "%"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(400)] + [None, "", "9" * 50_000, "a" * 50_000 + "@", "1.2.3.4." * 500]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = base_pii(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), t
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(w[0] == k for w in want) for k in ("email", "ip", "card", "phone")]
    words_near = ["The hotel desk 555-123-4567", "basically 555-123-4567", "order ticket tel 555-123-4567", "tel 555-123-4567"]
    near = [r.spans for r in find_pii(spark.createDataFrame(list(enumerate(words_near)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert near == ["", "", "", "tel:4:16"]
    twice = spark.createDataFrame([(1, "a@b.c", 5, "x"), (1, "a@b.c", 5, "x")], "doc_id long, text string, n_email long, spans string")
    assert [tuple(r)[:2] for r in find_pii(twice).collect()] == [(1, 1)] * 2
    more = ["IBAN DE89370400440532013000 please", "DE89370400440532013001", "my ssn is 123-45-6789", "123-45-6789", "call 555-123-4567 now"]
    spans = [r.spans for r in find_pii(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert spans == ["iban:5:27", "", "ssn:10:21", "", "tel:5:17"]
    assert redact(more[0], spans[0]) == "IBAN <iban> please"
    assert find_pii(empty).count() == 0


def test_line_dedup(docs, rows, empty):
    seen, want = set(), Counter()
    texts = {}
    for doc_id, text in sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            gone |= {i, i + 1, i + 2} if window in seen else set()
            seen.add(window)
        texts[doc_id, text] = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)
    for r in rows:
        want[r[0], texts[r[0], r[1]][0], texts[r[0], r[1]][1], r[5]] += 1
    got = line_dedup(docs)
    assert Counter(map(tuple, got.select("doc_id", "text", "n_removed", "kept").collect())) == want
    assert sum(k[2] for k in want) >= 5
    assert line_dedup(empty).count() == 0
    clash = docs.withColumns({c: F.lit(9) for c in ("__gone", "__doc", "__key", "__id", "__of", "n_lines")})
    cut = line_dedup(clash, with_counts=False)
    assert cut.columns == clash.columns
    assert Counter((r.doc_id, r.text) for r in cut.filter("n_lines = 9 and __gone = 9").collect()) == Counter(k[:2] for k in want.elements())


def test_targets_and_flow(spark):
    sources = spark.createDataFrame([("0a", 10), ("0b", 100), ("1", 50)], "source string, size long")
    target = {r.source: r.target for r in source_targets(sources).collect()}
    assert target["0a"] == 20 and abs(sum(target.values()) - 240) < 1e-9
    assert target["0b"] / target["1"] == pytest.approx(2)
    many = [(f"{i:05}", 1 + i * i % 97) for i in range(3000)]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(many, "source string, size long").repartition(5)).collect()}
    weight, open_, left, want = {s: (5.0, 2.0, 1.0)[i % 3] for i, (s, _) in enumerate(many)}, dict(many), 1.5 * sum(n for _, n in many), {}
    while over := [s for s in open_ if left / sum(weight[x] for x in open_) * weight[s] > 2 * open_[s]]:
        want |= {s: 2.0 * open_.pop(s) for s in over}
        left = 1.5 * sum(n for _, n in many) - sum(want.values())
    want |= {s: left / sum(weight[x] for x in open_) * weight[s] for s in open_}
    assert got == pytest.approx(want)
    flow = route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 18, "b": 12})
    assert sum(flow.values()) == pytest.approx(30) and all(x <= 20 for x in flow.values())
    # a word is used again only where the first uses are spent
    assert flow == pytest.approx({("a",): 10, ("a", "b"): 10, ("b",): 10})


def test_mix(spark, docs, rows, empty):
    plan = mix(docs).collect()
    assert len(plan) == len(rows)
    sizes = Counter(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)
    assert Counter(r["size"] for r in plan) == sizes
    assert all(r.taken <= 2 * r["size"] for r in plan)
    rng = random.Random(8)
    many = [(i, words(rng, rng.randrange(1, 40)), rng.choice(["x", "y", "y", "y", "z", None])) for i in range(3000)]
    df = spark.createDataFrame(many, "doc_id long, text string, source string")
    plan = mix(df).collect()
    assert sorted(map(tuple, plan)) == sorted(map(tuple, mix(df.repartition(5)).collect()))
    taken, target = defaultdict(int), {}
    name = {i: s for i, _, s in many}
    for r in plan:
        taken[name[r.doc_id]] += r.taken
        target[name[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    assert sum(r.copies for r in plan) == mixed_rows(df).count()
    overlap = spark.createDataFrame([(i, "a b c", ["p", "q"] if i % 3 else ["p"]) for i in range(90)] + [(100, "x y", ["\U0010ffff"]), (101, "x y", [None]), (102, "x y", [])], "doc_id long, text string, source array<string>")
    plan = mix(overlap, weights=(1.0,)).collect()
    assert sorted(plan) == sorted(mix(overlap.repartition(7), weights=(1.0,)).collect())
    # the quotas of p and q, 336 words each, take all 270 words twice
    assert sum(r.taken for r in plan if r.doc_id < 100) == pytest.approx(2 * 270, abs=3)
    size = {r.doc_id: r.source_size for r in plan}
    assert size[100] == 2 and size[101] == size[102] == 4 and size[0] == 270 and size[1] == 450
    clash = df.limit(50).withColumns({c: F.lit("own") for c in ("__key", "__id", "__hash", "__copies", "__n", "size", "hash")})
    assert mixed_rows(clash).columns == clash.columns and {r["__key"] for r in mixed_rows(clash).collect()} == {"own"}
    assert mix(empty).count() == 0


def test_blocks():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.zeros(5, np.uint32), rng.integers(0, 50257, 1000), rng.integers(0, 2**32, 77, dtype=np.uint64).astype(np.uint32)):
        assert (unpack_block(pack_block(ids.astype(np.uint32))) == ids).all()
    parts = [b"", b"abc", b"x" * 999, b"12"]
    assert crc32_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_token_files(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = Counter(), 0
    ids = [np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in order]
    files = write_ids(docs, path, public_tokenizers.PATTERN, 2, block=64)
    got = sorted(read_index(spark, files, 64).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in order]
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = Counter((r[0], len(i), zlib.crc32(i.tobytes())) for r, i in zip(order, ids, strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    parts = sorted(read_segments(spark, files, 64, with_ids=True).collect(), key=lambda r: (r.shard, r.local, r.number))
    back = defaultdict(list)
    for r in parts:
        back[r.doc_id] += r.ids
    assert back[26] == next(i.tolist() for r, i in zip(order, ids, strict=True) if r[0] == 26)
    assert read_index(spark, write_ids(empty, path, public_tokenizers.PATTERN, 2)).count() == 0


def test_token_files_with_added_tokens(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a < |endoftext|> b", "<|endoftext", "b<|endoftext|><|endoftext|>  c\n"]
    ids = [np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for t in texts]
    got = read_index(spark, write_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, public_tokenizers.PATTERN, 2)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(i), zlib.crc32(i.tobytes())) for i in ids]


def test_pieces_of_all_code_points_are_the_librarys():
    from tokenizers import Tokenizer

    from tallyforge.llm.bitplane import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), Encoder(path, public_tokenizers.PATTERN)
    assert own.by_piece
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} 1{c}{c}" for c in points[i : i + 2000]) for i in range(0, len(points), 2000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_pieces():
    import regex

    find = regex.compile(public_tokenizers.PATTERN).findall
    rng = random.Random(3)
    some = ["'", "s", "t", "r", "e", "v", "l", "m", "d", " ", "  ", "\n", "\t", " ", "1", "é", "!", "日", "٣", "\x1c", "S"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    assert split_texts(texts) == [find(t) for t in texts]


def test_bpe(spark, docs, rows):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    got = bpe_encode(docs, path, public_tokenizers.PATTERN, with_ids=True)
    assert Counter(map(tuple, got.drop("ids").collect())) == want
    back = {r.doc_id: bytes(r.decoded) for r in bpe_decode(got.filter("doc_id is not null"), path).collect()}
    assert back == {r[0]: (r[1] or "").encode() for r in rows if r[0] is not None}
    rng = random.Random(1)
    pieces = list({"".join(rng.choice("abcdeé日0123 $") for _ in range(rng.randint(1, 130))) for _ in range(500)} | {"a" * 3000, " " * 333, "\n" * 99})
    assert DuckBpe(ranks).encode([p.encode() for p in pieces]) == [library._core_bpe.encode_single_piece(p.encode()) for p in pieces]
    assert base64.b64decode("YQ==") in ranks


def test_language(spark, docs, empty, rows):
    rng = random.Random(6)
    vocab = {"aa": ["the", "and", "house", "water"], "bb": ["der", "und", "haus", "wasser"], "cc": ["le", "et", "maison", "eau"]}
    many = [(i, " ".join(rng.choice(vocab[k]) for _ in range(20)), k) for i in range(300) for k in [rng.choice(list(vocab))]]
    many += [(1000, None, "aa"), (1001, "12 34 !!", "bb"), (1002, "und wasser", None)]
    got = {r.doc_id: r for r in identify_language(spark.createDataFrame(many, "doc_id long, text string, lang string")).collect()}
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].rejected
    assert got[1002].lang_pred == "bb"
    held = [(i, k) for i, _, k in many[:300] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].held_out and got[i].lang_pred == k for i, k in held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in identify_language(spark.createDataFrame(many, "doc_id long, text string, lang string").withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))).collect()} == {"und"}
    assert identify_language(empty).count() == 0
    kept = keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {r[0] for r in rows if r[1] and r[0] == 4}
    assert all(any(c.isalpha() for c in r.text) for r in kept.collect())


def test_exact_dedup(docs, rows, empty):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    last = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((r[0], last[t], len(groups[t]), r[0] == last[t], hashlib.sha256(t.encode()).hexdigest()) for r in rows for t in [r[1] or ""])
    for size in (16, 1):  # identifiers of one byte stand for many contents, which then count in full
        assert Counter(map(tuple, exact_dedup(docs, digest_bytes=size).collect())) == want
    assert exact_dedup(empty).count() == 0
    data = np.frombuffer(random.Random(1).randbytes(200_000), np.uint8)
    ends = chunk_ends(data)
    assert ends[-1] == len(data) and len(ends) > 10
    assert {e + 7 for e in chunk_ends(data)} & set(chunk_ends(np.concatenate([data[:7], data])))


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    rows = [(i, (base[i % 30] + rng.normal(0, 0.12, 8)).tolist(), i % 2) for i in range(120)]
    rows += [(200, [0.0] * 8, 0), (201, None, 0), (202, [1.0] * 7 + [None], 0), (203, [float("nan")] * 8, 0), (204, [float("inf")] * 8, 1), (205, base[0].tolist(), None), (None, base[0].tolist(), 0), (206, [], 0)]
    rows += [rows[4], (207, rows[4][1], 0), (208, [2 * x for x in rows[5][1]], 1), (209, [1.0, 2.0], 0), (210, [1.0, 2.1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    ok = lambda v: bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links, root = [0] * len(rows), {r[0]: r[0] for r in rows}
    pairs = []
    for i, (a, x, k) in enumerate(rows):
        for j, (b, y, m) in enumerate(rows):
            if i < j and k is not None and k == m and a is not None and b is not None and ok(x) and ok(y) and len(x) == len(y):
                x_, y_ = np.array(x), np.array(y)
                if x_ @ y_ / (np.linalg.norm(x_) * np.linalg.norm(y_)) >= 0.93:
                    pairs.append((a, b))
                    links[i] += 1
                    links[j] += 1
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = Counter((r[0], n, root[r[0]], r[0] == root[r[0]]) for r, n in zip(rows, links, strict=True))
    for tile in (1024, 7):
        assert Counter(map(tuple, near_vectors(df, tile=tile).collect())) == want
    assert sum(links) > 40
    again = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (1, [0.0, 1.0], 0), (3, [0.1, 1.0], 0)], df.schema)
    assert Counter(map(tuple, near_vectors(again).collect())) == Counter([(1, 1, 1, True), (2, 1, 1, False), (1, 1, 1, True), (3, 1, 1, False)])
    far = [(i, [x * s, y * s], 0) for i, (x, y, s) in enumerate([(1.0, 2.0, 1e200), (1.0, 2.1, 1e200), (1.0, 2.0, 1e-200), (1.0, 2.1, 5e-310), (-2.0, 1.0, 1.0)])]
    assert [r.n_links for r in near_vectors(spark.createDataFrame(far, df.schema)).orderBy("vec_id").collect()] == [3, 3, 3, 3, 0]
    assert near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}


def removed_by_brute_force(texts: list[bytes]) -> list[int]:
    starts = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    gone = []
    for t in texts:
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if starts[t[i : i + 200]] > 1:
                covered[i : i + 200] = True
        gone.append(int(covered.sum()))
    return gone


def test_a_passage_in_every_text_costs_a_part_one_entry_for_each_name(spark):
    from tallyforge.llm import suffix_dedup as S

    rng = random.Random(5)
    passage = "".join(rng.choices("abcdef gh", k=450))
    own = ["".join(rng.choices("ijklmnop q", k=rng.randrange(0, 900))) for _ in range(40)]
    # in every text, in some twice, in some cut short; two texts repeat only themselves
    texts = [passage[: 450 - i % 3 * 100] + t + (passage if i % 7 == 0 else "") for i, t in enumerate(own)] + ["xy" * 150, own[7] * 2, "", "x" * 199]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in S.suffix_dedup(docs.repartition(4)).collect()}
    assert [found[i] for i in range(len(texts))] == removed_by_brute_force([t.encode() for t in texts])

    def entries(copies: int) -> int:
        data = passage.encode() * copies
        row = {"part": 1, "lengths": np.array([450] * copies, np.int64).tobytes(), "z": zstandard.compress(data)}
        return sum(sum(b["n"].to_pylist()) for b in S._send([pa.RecordBatch.from_pylist([row])], 1, 3))

    # a text's places have 133 offsets to the cover, so that no more names than places of one text can be sent
    assert entries(400) <= 450 and entries(4000) <= 450


def test_large_buckets_join_groups_and_not_their_members():
    """Members of one group that meet an outsider make one edge, and none to pivots of their own group."""
    sketch = np.arange(100, dtype=np.uint32).tobytes()
    rows = [(7, n, None if n == 90 else 3, sketch, False, n == 90) for n in range(3, 91)]
    columns = ["path", "node", "root", "sketch", "pivot", "whole"]
    for whole, pivots in ((True, [(7, 90, None, sketch, True, True)]), (False, [(7, 90, None, sketch, True, False), (7, 20, 3, sketch, True, False)])):
        table = [(p, n, r, s, pivot, whole) for p, n, r, s, pivot, _ in [*rows, *pivots]]
        made = _large_bucket(pa.table(dict(zip(columns, map(list, zip(*table)), strict=True))).cast(pa.schema([("path", pa.int64()), ("node", pa.int64()), ("root", pa.int64()), ("sketch", pa.binary()), ("pivot", pa.bool_()), ("whole", pa.bool_())])), 0.5, split=True)
        assert [(r["a"], r["b"]) for r in made.to_pylist()] == [(90, 3)]


def test_a_set_that_splits_on_is_one_row_with_all_its_paths():
    """Sets that no pivot settles leave a large bucket once each, however many shingles they pick."""
    rows = [(7, n, None, np.arange(n * 200, n * 200 + 100, dtype=np.uint32).tobytes(), False, False) for n in range(60)]
    columns = ["path", "node", "root", "sketch", "pivot", "whole"]
    kinds = pa.schema([("path", pa.int64()), ("node", pa.int64()), ("root", pa.int64()), ("sketch", pa.binary()), ("pivot", pa.bool_()), ("whole", pa.bool_())])
    made = _large_bucket(pa.table(dict(zip(columns, map(list, zip(*rows)), strict=True))).cast(kinds), 0.5, split=True).to_pylist()
    wanted = {}
    for _, n, _, sketch, *_ in rows:
        tokens = np.frombuffer(sketch, np.uint32)
        if len(paths := picks(tokens, np.full(100, 100), np.full(100, 7, np.uint64))[1]):
            wanted[n] = paths.tolist()
    assert max(map(len, wanted.values())) > 1
    assert [(r["a"], r["path"]) for r in made] == sorted(wanted.items()) and all(r["b"] is None and r["root"] is None for r in made)
