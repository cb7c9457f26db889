"""Repeated 200-byte strings by a difference cover of suffix positions, sorted and named in rounds.

A suffix array is only needed to a depth of 200 bytes here, so the difference cover has a large modulus. Of any two
positions, at some offset below V = 133 both are sampled, because the differences of COVER take every value
modulo V. Hence two equal 200-byte strings share a sampled tuple of 200 - 132 = 68 bytes.

1. Sort the sampled tuples of all texts (as fingerprints, ranges of which are dealt to tasks) and compare
   neighbours: a tuple that occurs once is done with.
2. Recurse on the names that repeat: each sampled suffix is named again by its tuple and its whole context, the 332
   bytes that hold every 200-byte string around the tuple. Suffixes that agree in that repeat as a whole.
3. Merge the suffixes that aren't sampled: where one tuple has several contexts, one suffix of each context puts its
   200-byte strings, at all offsets, in order, and equal neighbours are repeated.

Equal texts are collapsed first and repeat by definition. Texts are packed into parts of a few MB, a bucketed table,
so that each round joins the answers of the last to the texts without moving the texts again. A part sends each name
once, with a mark if it holds it again, so that a string which very many texts share costs a range one entry for each
part instead of one for each place. Fingerprints are polynomial hashes: 48 bits in the first round, which only filters,
then 128 and 96 bits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, discard, materialize, mix64, seeded_words, shared_dir, shuffle_partitions

LENGTH = 200
#: A perfect difference set modulo 133 (every remainder but 0 is one difference of two members).
V, COVER = 133, (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
TUPLE = LENGTH - V + 1
PART_BYTES, SEGMENT = 4 << 20, 1 << 20
#: Names in a range that one task sorts.
RANGE_NAMES = 1_000_000
FILTER_BITS = np.uint64(16)


class Fingerprints:
    """Polynomial hashes modulo 2^64 of substrings, over a table of random words for the bytes."""

    def __init__(self, seed: int):
        self.table = seeded_words(256, seed)
        base = int(seeded_words(1, seed + 77)[0]) | 1
        self.up, self.down = (self._powers(b) for b in (base, pow(base, -1, 1 << 64)))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        steps = np.full(SEGMENT + 2 * LENGTH + V + 1, np.uint64(base))
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]; starts ascend and no substring is longer than LENGTH + V."""
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            low = int(starts[at])
            to = int(np.searchsorted(starts, low + SEGMENT))
            piece = data[low : int(ends[at:to].max())]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(self.table[piece] * self.up[: len(piece)], out=sums[1:])
            s = starts[at:to] - low
            out[at:to] = (sums[ends[at:to] - low] - sums[s]) * self.down[s]
            at = to
        return mix64(out)


class Part:
    """Some whole texts, one after another, with what the rounds derive from them."""

    def __init__(self, row: dict):
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["z"], max_output_size=max(1, int(self.lengths.sum()))), np.uint8)
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths
        self.first, self.second = (Fingerprints(s) for s in (1, 2)) if not _SHARED else _SHARED
        if not _SHARED:
            _SHARED[:] = [self.first, self.second]

    def samples(self) -> None:
        """Sampled positions whose tuple lies within its text, in order of the tuples' names."""
        at = (np.arange(0, len(self.data), V)[:, None] + np.array(COVER)).ravel()
        at = at[at < len(self.data)]
        text = np.searchsorted(self.ends, at, "right")
        whole = (at + TUPLE <= self.ends[text]) & (self.lengths[text] >= LENGTH)
        at, text = at[whole], text[whole]
        names = self.first.of(self.data, at, at + TUPLE)
        order = np.lexsort((at, names >> FILTER_BITS))
        self.at, self.text, self.names = at[order], text[order], names[order]
        self.runs = run_starts((self.names >> FILTER_BITS,))

    def keep(self, flags: np.ndarray) -> None:
        """Keep samples whose name repeats, in order of name, context and place."""
        at, text, names = self.at[flags], self.text[flags], self.names[flags]
        order = np.argsort(at)
        at, text, names = at[order], text[order], names[order]
        low, high = np.maximum(at - (V - 1), self.begins[text]), np.minimum(at + LENGTH, self.ends[text])
        context = self.second.of(self.data, low, high) ^ mix64(((at - low) << 32 | (high - at)).astype(np.uint64))
        order = np.lexsort((at, context, names))
        self.at, self.text, self.names, self.context = at[order], text[order], names[order], context[order]
        self.runs = run_starts((self.names, self.context))

    def windows_of(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the strings that hold the flagged samples' tuples."""
        at, text = self.at[flags], self.text[flags]
        return np.maximum(at - (V - 1), self.begins[text]), np.minimum(at, self.ends[text] - LENGTH)

    def merge(self, flags: np.ndarray) -> None:
        """The strings to compare, in order of their fingerprints."""
        low, high = self.windows_of(flags)
        marks = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(marks, low, 1)
        np.add.at(marks, high + 1, -1)
        starts = np.flatnonzero(np.cumsum(marks[:-1]))
        h1, h2 = (f.of(self.data, starts, starts + LENGTH) for f in (self.first, self.second))
        h2 >>= np.uint64(32)
        order = np.lexsort((starts, h2, h1))
        self.starts, self.h1, self.h2 = starts[order], h1[order], h2[order]
        self.again = run_starts((self.h1, self.h2))


_SHARED: list[Fingerprints] = []


def run_starts(words: tuple[np.ndarray, ...]) -> np.ndarray:
    """Where a run of equal words begins; the words are in order."""
    new = np.ones(len(words[0]), bool)
    if len(new):
        new[1:] = np.any([w[1:] != w[:-1] for w in words], axis=0)
    return new


def of_runs(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Flags of runs, for each of their members."""
    return flags[np.cumsum(starts) - 1]


def pack_words(words: np.ndarray, size: int = 8) -> bytes:
    """Words as byte planes: in sorted order the high planes hardly take space."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes())


def unpack_words(raw: bytes, n: int, size: int = 8) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(1, n * size)), np.uint8).reshape(size, n).T
    return out.view("<u8")[:, 0]


def pack_bits(bits: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes())


def unpack_flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(1, n)), np.uint8), count=n).astype(bool)


def unpack_bits(answers: list[dict] | None, column: str) -> np.ndarray:
    """A part's flags, joined over its ranges in order."""
    parts = [unpack_flags(a[column], a["n"]) for a in sorted(answers or [], key=lambda a: a["range"])]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


# -- texts into parts


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [x.as_py() for x in batch.column(1)]
        yield pa.record_batch({"key": batch.column(0), "n": pa.array(map(len, texts), pa.int64()), "z": pa.array(map(pack.compress, texts), pa.binary())})


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, unpack, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
    held: list[tuple[bytes, int, int, bytes]] = []

    def packed() -> pa.RecordBatch:
        return pa.record_batch({"part": pa.array([number], pa.int64()), "keys": pa.array([b"".join(k for k, *_ in held)], pa.binary()), "copies": pa.array([np.array([min(c, 2) for _, c, _, _ in held], np.uint8).tobytes()], pa.binary()), "lengths": pa.array([np.array([n for _, _, n, _ in held], np.int64).tobytes()], pa.binary()), "z": pa.array([pack.compress(b"".join(t for *_, t in held))], pa.binary()), "size": pa.array([sum(n for _, _, n, _ in held)], pa.int64())})

    size = 0
    for batch in batches:
        for key, copies, n, z in zip(*batch.columns, strict=True):
            n = n.as_py()
            held.append((key.as_py(), copies.as_py(), n, unpack.decompress(z.as_py(), max_output_size=max(1, n))))
            size += n
            if size >= PART_BYTES:
                yield packed()
                held, size, number = [], 0, number + 1
    if held:
        yield packed()


# -- rounds: what a part sends to the ranges, and what a range answers


def _ranges(high: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of ascending 64-bit words."""
    of = ((high >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(of)) + 1 if len(of) else []
    edges = [0, *cuts, len(of)] if len(of) else [0]
    return [(int(of[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def prepared(row: dict, until: int) -> Part:
    """A part with the answers of the rounds before ``until`` applied."""
    part = Part(row)
    part.samples()
    if until > 1:
        part.keep(of_runs(unpack_bits(row["answers1"], "flags"), part.runs))
    if until > 2:
        # of a run its first suffix stands for all
        part.merge(of_runs(unpack_bits(row["answers2"], "more"), part.runs) & part.runs)
    return part


def _send(batches: Iterator[pa.RecordBatch], stage: int, ranges: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            part = prepared(row, stage)
            if stage == 1:
                words, sizes, starts = (part.names >> FILTER_BITS << FILTER_BITS,), (8,), part.runs
            elif stage == 2:
                words, sizes, starts = (part.names, part.context), (8, 8), part.runs
            else:
                words, sizes, starts = (part.h1, part.h2), (8, 4), part.again
            sent = tuple(w[starts] for w in words)
            twice = np.diff(np.append(np.flatnonzero(starts), len(starts))) > 1
            cuts = _ranges(sent[0], ranges)
            blobs = [[pack_words(w[a:b] if stage > 1 else w[a:b] >> FILTER_BITS, 6 if stage == 1 else s) for w, s in zip(sent, sizes, strict=True)] for _, a, b in cuts]
            yield pa.record_batch({"range": pa.array([r for r, *_ in cuts], pa.int32()), "part": pa.array([row["part"]] * len(cuts), pa.int64()), "n": pa.array([b - a for _, a, b in cuts], pa.int64()), "w1": pa.array([x[0] for x in blobs], pa.binary()), "w2": pa.array([x[1] if len(x) > 1 else b"" for x in blobs], pa.binary()), "twice": pa.array([pack_bits(twice[a:b]) for _, a, b in cuts], pa.binary())})


def _answer(rows: pa.Table, stage: int) -> pa.Table:
    """Sort what a range got from all parts, compare neighbours, and send each part its flags."""
    n = rows["n"].to_pylist()
    w1 = np.concatenate([unpack_words(x, k, 6 if stage == 1 else 8) for x, k in zip(rows["w1"].to_pylist(), n, strict=True)])
    if stage == 1:
        order = np.argsort(w1, kind="stable")
        same = w1[order][1:] == w1[order][:-1]
    else:
        w2 = np.concatenate([unpack_words(x, k, 8 if stage == 2 else 4) for x, k in zip(rows["w2"].to_pylist(), n, strict=True)])
        order = np.lexsort((w2, w1))
        same_name = w1[order][1:] == w1[order][:-1]
        same = same_name & (w2[order][1:] == w2[order][:-1])
    flags, more = np.zeros(len(w1), bool), np.zeros(len(w1), bool)
    flags[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    flags |= np.concatenate([unpack_flags(x, k) for x, k in zip(rows["twice"].to_pylist(), n, strict=True)])
    if stage == 2 and len(w1):
        # one suffix of each context stands for it where its name has other contexts too
        leads = np.concatenate([[True], ~same])
        name = np.cumsum(np.concatenate([[True], ~same_name])) - 1
        contexts = np.bincount(name, weights=leads)
        more[order] = leads & (contexts[name] > 1)
    edges = np.cumsum([0, *n])
    cut = lambda bits: pa.array([pack_bits(bits[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
    return pa.table({"part": rows["part"].cast(pa.int64()), "range": rows["range"].cast(pa.int32()), "n": pa.array(n, pa.int64()), "flags": cut(flags), "more": cut(more)})


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            part = prepared(row, 3)
            marks = np.zeros(len(part.data) + LENGTH + 1, np.int32)
            low, high = part.windows_of(of_runs(unpack_bits(row["answers2"], "flags"), part.runs))
            np.add.at(marks, low, 1)
            np.add.at(marks, high + LENGTH, -1)
            again = part.starts[of_runs(unpack_bits(row["answers3"], "flags"), part.again)]
            marks[again] += 1
            marks[again + LENGTH] -= 1
            covered = np.cumsum(marks[: len(part.data)]) > 0
            for begin, end, copies in zip(part.begins, part.ends, row["copies"], strict=True):
                if copies > 1 and end - begin >= LENGTH:
                    covered[begin:end] = True
            out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept_sha256": []}
            for begin, end in zip(part.begins, part.ends, strict=True):
                gone = covered[begin:end]
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                out["kept_sha256"].append(hashlib.sha256(part.data[begin:end][~gone]).hexdigest())
            keys = [row["keys"][i : i + 16] for i in range(0, len(row["keys"]), 16)]
            yield pa.record_batch({"key": pa.array(keys, pa.binary()), "n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())})


ANSWER_DDL = "part long, range int, n long, flags binary, more binary"


def _round(parts: DataFrame, stage: int, ranges: int) -> DataFrame:
    """Answers of one round, a row for each part."""
    sent = parts.mapInArrow(partial(_send, stage=stage, ranges=ranges), "range int, part long, n long, w1 binary, w2 binary, twice binary")

    def answer(rows: pa.Table) -> pa.Table:
        return _answer(rows, stage)

    answers = sent.groupBy("range").applyInArrow(answer, ANSWER_DDL)
    return materialize(answers.groupBy("part").agg(F.collect_list(F.struct("range", "n", "flags", "more")).alias(f"answers{stage}")), "answers")


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``.

    Every byte of the UTF-8 text that is covered by a 200-byte string which also starts anywhere else, in this text or
    another, is removed; strings are judged on the input. Texts under 200 bytes, empty and null (counted as empty) ones
    lose nothing. Equal texts of 200 bytes or more, and repeated rows, lose all. n_spans counts maximal runs of
    removed bytes. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    whole = F.coalesce(text, F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("key"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.cast("binary").alias("raw"))
    texts = rows.select("key", "raw").mapInArrow(_squeeze, "key binary, n long, z binary")
    texts = texts.groupBy("key").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("z").alias("z")).select("key", "copies", "n", "z")
    packed = texts.mapInArrow(_pack, "part long, keys binary, copies binary, lengths binary, z binary, size long")
    name = f"tallyforge_parts_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/{name}"
    packed.write.bucketBy(shuffle_partitions(spark), "part").option("path", at).option("compression", "none").saveAsTable(name)
    parts = spark.table(name)
    total = parts.agg(F.sum("size")).first()[0] or 0
    ranges = 1 + int(total * len(COVER) / V / RANGE_NAMES)
    one = _round(parts, 1, ranges)
    parts = parts.join(one.hint("merge"), "part", "left")
    two = _round(parts, 2, ranges)
    parts = parts.join(two.hint("merge"), "part", "left")
    three = _round(parts, 3, ranges)
    parts = parts.join(three.hint("merge"), "part", "left")
    found = materialize(parts.mapInArrow(_finish, "key binary, n_removed long, n_spans long, kept_sha256 string"), "removed")
    discard(spark, one, two, three)
    spark.sql(f"DROP TABLE {name}")
    delete_path(spark, at)
    return rows.select("doc_id", "key", "n_bytes").join(found, "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
