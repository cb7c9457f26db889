"""Repeated windows of 35 words by level-wise doubling.

Windows of a few words come first. Those of one level that occur once are done with; a window of up to twice the
length is a candidate of the next level where its first and its last words are repeated windows of the level before.
The levels end at the wanted length (9, 18 and 35 words), or when no candidate survives.

Documents are packed into parts of a few MB, a bucketed table, so that each level joins the answers of the last to the
texts without moving the texts. Of a part each distinct window is sent once, with a mark if the part holds it more than
once, so a passage of very many documents is one name in each part. Names of the levels before the last only
filter, and have ten bits more than their number needs; those of the last decide, with twenty bits more than twice that.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, discard, materialize, mix64, shared_dir, shuffle_partitions, utf8_views
from .runs import SPACE, RunHashes, byte_runs
from .suffix_dedup import pack_bits, pack_words, unpack_bits, unpack_words

WINDOW = 35
#: Levels are halved while they are at least this long.
HALVED = 16
PART_BYTES, RANGE_NAMES = 8 << 20, 2_000_000
HASHES: list[RunHashes] = [RunHashes(31), RunHashes(32)]
WORD = ~SPACE


def level_lengths(window: int = WINDOW) -> list[int]:
    """Lengths of the levels, each at most twice the one before; the last one is ``window``."""
    out = [window]
    while out[0] >= HALVED:
        out.insert(0, (out[0] + 1) // 2)
    return out


def name_bytes(names: int, last: bool) -> int:
    """Bytes of a window's name, so that ``names`` of them hardly ever agree by chance."""
    bits = math.log2(max(2, names))
    return min(16, math.ceil((2 * bits + 20 if last else bits + 10) / 8)) if last else min(8, math.ceil((bits + 10) / 8))


class WordPart:
    """Some whole texts, their words, and the names of windows of words."""

    def __init__(self, row: dict):
        lengths = np.frombuffer(row["lengths"], np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(row["z"], max_output_size=max(1, int(lengths.sum())))
        self.data = np.frombuffer(self.raw, np.uint8)
        self.ends = np.cumsum(lengths)
        self.starts, self.stops = byte_runs(self.data, self.ends[lengths > 0], WORD)
        #: First word of each text, and one past the last.
        self.first, self.last = np.searchsorted(self.starts, self.ends - lengths), np.searchsorted(self.starts, self.ends)
        self.left = np.repeat(self.last, self.last - self.first) - np.arange(len(self.starts))
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def names(self, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        """64-bit names of the windows of ``length`` words that begin at ``at``."""
        base = HASHES[which].base * 5 | 1
        if which not in self.sums:
            words = HASHES[which].of(self.data, self.starts, self.stops)
            up, down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(words), np.uint64(b)), dtype=np.uint64)]) for b in (base % (1 << 64), pow(base, -1, 1 << 64)))
            self.sums[which] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)]), down
        sums, down = self.sums[which]
        return mix64((sums[at + length] - sums[at]) * down[at])

    def distinct(self, at: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names of ``size`` bytes (as two words), how often each occurs, and each window's name by number."""
        high = self.names(at, length) >> np.uint64(8 * max(0, 8 - size))
        if size <= 8:
            names, inverse, counts = np.unique(high, return_inverse=True, return_counts=True)
            return names, np.zeros(len(names), np.uint64), counts, inverse
        low = self.names(at, length, 1) >> np.uint64(8 * (16 - size))
        order = np.lexsort((low, high))
        new = np.concatenate([[True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])])[: len(order)]
        number = np.cumsum(new) - 1
        inverse = np.empty(len(order), np.int64)
        inverse[order] = number
        return high[order][new], low[order][new], np.bincount(number), inverse

    def candidates(self, lengths: list[int], answers: list[np.ndarray], sizes: list[int]) -> np.ndarray:
        """Windows of the level after ``answers`` whose first and last words repeat; after the last level, the windows that repeat."""
        at = np.flatnonzero(self.left >= lengths[0])
        for level, flags in enumerate(answers):
            inverse = self.distinct(at, lengths[level], sizes[level])[3]
            at = at[flags[inverse]]
            if level + 1 < len(lengths):
                again = np.zeros(len(self.starts), bool)
                again[at] = True
                longer = lengths[level + 1]
                at = at[self.left[at] >= longer]
                at = at[again[at + longer - lengths[level]]]
        return at


def _pack(batches: Iterator[pa.RecordBatch], part_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
    ids, texts, size = [], [], 0

    def packed() -> pa.RecordBatch:
        lengths = np.array([len(t) for t in texts], np.int64)
        return pa.record_batch({"part": pa.array([number], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "lengths": pa.array([lengths.tobytes()], pa.binary()), "z": pa.array([pack.compress(b"".join(texts))], pa.binary()), "words": pa.array([sum(len(t.split()) for t in texts)], pa.int64())})

    for batch in batches:
        data, at = utf8_views(batch.column(1))
        for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
            ids.append(doc_id)
            texts.append(data[a:b].tobytes())
            size += int(b - a)
            if size >= part_bytes:
                yield packed()
                ids, texts, size, number = [], [], 0, number + 1
    if ids:
        yield packed()


def _answers(row: dict, level: int) -> list[np.ndarray]:
    return [unpack_bits(row[f"answers{k}"], "flags") for k in range(level)]


def _send(batches: Iterator[pa.RecordBatch], lengths: list[int], sizes: list[int], ranges: int) -> Iterator[pa.RecordBatch]:
    level = len(sizes) - 1
    bounds = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64) >> np.uint64(8 * max(0, 8 - sizes[level]))
    for batch in batches:
        for row in batch.to_pylist():
            part = WordPart(row)
            at = part.candidates(lengths, _answers(row, level), sizes)
            high, low, counts, _ = part.distinct(at, lengths[level], sizes[level])
            edges = [0, *np.searchsorted(high, bounds).tolist(), len(high)]
            cuts = [(r, a, b) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            yield pa.record_batch(
                {
                    "range": pa.array([r for r, *_ in cuts], pa.int32()),
                    "part": pa.array([row["part"]] * len(cuts), pa.int64()),
                    "n": pa.array([b - a for _, a, b in cuts], pa.int64()),
                    "high": pa.array([pack_words(high[a:b], min(8, sizes[level])) for _, a, b in cuts], pa.binary()),
                    "low": pa.array([pack_words(low[a:b], sizes[level] - 8) if sizes[level] > 8 else b"" for _, a, b in cuts], pa.binary()),
                    "twice": pa.array([pack_bits(counts[a:b] > 1) for _, a, b in cuts], pa.binary()),
                }
            )


def _answer(rows: pa.Table, size: int) -> pa.Table:
    """Sort what a range got from all parts, compare neighbours, and send each part its flags."""
    n = rows["n"].to_pylist()
    words = lambda column, width: np.concatenate([unpack_words(x, k, width) for x, k in zip(rows[column].to_pylist(), n, strict=True)])
    high = words("high", min(8, size))
    twice = np.concatenate([unpack_bits([{"range": 0, "n": k, "twice": x}], "twice") for x, k in zip(rows["twice"].to_pylist(), n, strict=True)])
    if size > 8:
        low = words("low", size - 8)
        order = np.lexsort((low, high))
        same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    else:
        order = np.argsort(high, kind="stable")
        same = high[order][1:] == high[order][:-1]
    flags = np.empty(len(high), bool)
    flags[order] = twice[order] | np.concatenate([same, [False]]) | np.concatenate([[False], same])
    edges = np.cumsum([0, *n])
    cuts = list(zip(edges[:-1], edges[1:], strict=True))
    return pa.table({"part": rows["part"].cast(pa.int64()), "range": rows["range"].cast(pa.int32()), "n": pa.array(n, pa.int64()), "alive": pa.array([int(flags[a:b].sum()) for a, b in cuts], pa.int64()), "flags": pa.array([pack_bits(flags[a:b]) for a, b in cuts], pa.binary())})


def _answering(size: int) -> Callable[[pa.Table], pa.Table]:
    def answer(rows: pa.Table) -> pa.Table:
        return _answer(rows, size)

    return answer


def _finish(batches: Iterator[pa.RecordBatch], lengths: list[int], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            part = WordPart(row)
            covered = np.zeros(len(part.starts), bool)
            if len(sizes) == len(lengths):
                at = part.candidates(lengths, _answers(row, len(sizes)), sizes)
                marks = np.zeros(len(part.starts) + 1, np.int32)
                marks[at] += 1
                marks[at + lengths[-1]] -= 1
                covered = np.cumsum(marks[:-1]) > 0
            begins, texts, removed = np.concatenate([[0], part.ends[:-1]]), [], []
            for a, b, i, j in zip(begins.tolist(), part.ends.tolist(), part.first.tolist(), part.last.tolist(), strict=True):
                gone = covered[i:j]
                removed.append(int(gone.sum()))
                texts.append(b" ".join(compress(part.raw[a:b].split(), (~gone).tolist())))
            yield pa.record_batch({"doc_id": pa.array(row["ids"], pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(part.last - part.first, pa.int64()), "n_removed": pa.array(removed, pa.int64())})


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, text, n_words, n_removed for each row of ``docs``; text has the kept words, joined by one space.

    Words are maximal runs of other bytes than ASCII white space. Each word goes that is covered by a window of ``window`` words
    which also starts anywhere else, in this text or another; windows are judged on the input. A null text has no
    words, as an empty one, and gives an empty text; texts under ``window`` words keep all. Repeated rows are further
    documents, so equal texts of ``window`` words or more lose all, whatever their ids; a null doc_id stays null. An empty
    table gives no rows; other columns are not read. A part that a task loses is made again from the bucketed table.
    """
    spark, lengths = docs.sparkSession, level_lengths(window)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    packed = rows.mapInArrow(partial(_pack, part_bytes=part_bytes), "part long, ids array<long>, lengths binary, z binary, words long")
    name = f"tallyforge_words_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/{name}"
    packed.write.bucketBy(shuffle_partitions(spark), "part").option("path", at).option("compression", "none").saveAsTable(name)
    parts = spark.table(name)
    bound, sizes, answered = parts.agg(F.sum("words")).first()[0] or 0, [], []
    for level in range(len(lengths)):
        sizes.append(name_bytes(bound, level + 1 == len(lengths)))
        sent = parts.mapInArrow(partial(_send, lengths=lengths, sizes=list(sizes), ranges=1 + bound // RANGE_NAMES), "range int, part long, n long, high binary, low binary, twice binary")
        answers = sent.groupBy("range").applyInArrow(_answering(sizes[-1]), "part long, range int, n long, alive long, flags binary")
        answers = answers.groupBy("part").agg(F.sum("alive").alias("alive"), F.collect_list(F.struct("range", "n", "flags")).alias(f"answers{level}"))
        answered.append(materialize(answers, "answers"))
        if not answered[-1].agg(F.sum("alive")).first()[0]:
            sizes = []
            break
        parts = parts.join(answered[-1].drop("alive").hint("merge"), "part", "left")
    found = materialize(parts.mapInArrow(partial(_finish, lengths=lengths, sizes=list(sizes)), "doc_id long, text string, n_words long, n_removed long"), "kept")
    discard(spark, *answered)
    spark.sql(f"DROP TABLE {name}")
    delete_path(spark, at)
    return found
