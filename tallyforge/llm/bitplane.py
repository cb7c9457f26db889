"""Token ids in a binary file format: bit planes of fixed-size id blocks, zstandard frames, a chunk index.

The ids of the corpus, in ascending doc_id order, are cut into shards by ranges of doc_id and, within a shard, into
blocks of BLOCK ids. A block is stored plane by plane: plane k holds bit k of every id, packed eight to a byte,
as one zstandard frame; planes above the block's largest id are left out. A block's header is its chunk index:
magic, ids, planes and the length of each frame, little-endian. Blocks are rows of a table in the shared
folder, beside a table that gives each document's place, so any store that Spark writes to can hold them.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import text_groups
from .common import shuffle_partitions, write_table
from .pieces import Recent, split_texts

MAGIC, BLOCK, LEVEL, GROUP_CHARS = b"TFBP", 1 << 16, 3, 1_000_000
HEAD = "<4sIB"


def pack_block(ids: np.ndarray, level: int = LEVEL) -> bytes:
    """One block of unsigned 32-bit ids as header and frames; the inverse of ``unpack_block``."""
    ids = np.ascontiguousarray(ids, "<u4")
    planes = int(ids.max(initial=0)).bit_length()
    pack = zstandard.ZstdCompressor(level=level).compress
    frames = [pack(np.packbits((ids >> np.uint32(k) & np.uint32(1)).astype(np.uint8)).tobytes()) for k in range(planes)]
    return struct.pack(HEAD, MAGIC, len(ids), planes) + struct.pack(f"<{planes}I", *map(len, frames)) + b"".join(frames)


def unpack_block(block: bytes) -> np.ndarray:
    magic, n, planes = struct.unpack_from(HEAD, block)
    if magic != MAGIC:
        raise ValueError("not a block of bit planes")
    lengths = struct.unpack_from(f"<{planes}I", block, struct.calcsize(HEAD))
    ids, at, unpack = np.zeros(n, "<u4"), struct.calcsize(HEAD) + 4 * planes, zstandard.ZstdDecompressor().decompress
    for k, length in enumerate(lengths):
        plane = unpack(block[at : at + length])
        ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype("<u4") << np.uint32(k)
        at += length
    return ids


def byte_letters() -> dict[int, int]:
    """The public byte alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: b if b in printable else 256 + others.index(b) for b in range(256)}


class Encoder:
    """The tokenizers library over texts, as little-endian ids.

    With a plain byte-level tokenizer the library's merges run once for each distinct piece of the pattern. Any other
    tokenizer encodes whole texts, as does any tokenizer a text that holds one of its added tokens.
    """

    def __init__(self, tokenizer_path: str, pattern: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(tokenizer_path, encoding="utf-8") as f:
            self.tokenizer = Tokenizer.from_str(f.read())
        before = self.tokenizer.pre_tokenizer
        self.by_piece = isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space and self.tokenizer.normalizer is None and pattern == PATTERN
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge, self.letters, self.known = self.tokenizer.model.tokenize, byte_letters(), Recent()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        apart = [i for i, t in enumerate(texts) if not self.by_piece or any(x in t for x in self.added)]
        found = dict(zip(apart, self.whole([texts[i] for i in apart]) if apart else [], strict=True))
        pieces = split_texts([t for i, t in enumerate(texts) if i not in found])
        for piece in self.known.missing(set().union(*pieces)):
            self.known.now[piece] = array("I", [t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()
        of, rest = self.known.now.__getitem__, iter(pieces)
        for i in range(len(texts)):
            yield found[i] if i in found else b"".join(map(of, next(rest)))


#: A block with its place and its documents: their ids, how many of the block's ids each has, and the start of the first within the shard.
SHARD = pa.schema([("shard", pa.int32()), ("number", pa.int64()), ("n", pa.int64()), ("first_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("block", pa.binary())])
SHARD_DDL = "shard int, number long, n long, first_start long, doc_ids array<long>, lengths array<long>, block binary"


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(tokenizer_path: str, pattern: str) -> Encoder:
    """This Python worker's encoder; it outlives a task, and knows one tokenizer at a time."""
    key = tokenizer_path, pattern
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


class _Writer:
    """Cuts one shard's ids into blocks."""

    def __init__(self, shard: int, size: int):
        self.shard, self.size, self.number, self.start = shard, size, 0, 0
        self._open(0)

    def _open(self, first_start: int) -> None:
        self.first_start, self.raw, self.docs, self.lengths = first_start, bytearray(), [], []

    def add(self, doc_id: int | None, raw: bytes) -> Iterator[dict]:
        at = 0
        while at < len(raw):
            part = raw[at : at + 4 * self.size - len(self.raw)]
            self.raw += part
            self.docs.append(doc_id)
            self.lengths.append(len(part) // 4)
            at += len(part)
            if len(self.raw) == 4 * self.size:
                yield self.close()
                self._open(self.start if at < len(raw) else self.start + len(raw) // 4)
        self.start += len(raw) // 4

    def close(self) -> dict:
        row = {"shard": self.shard, "number": self.number, "n": len(self.raw) // 4, "first_start": self.first_start, "doc_ids": self.docs, "lengths": self.lengths, "block": pack_block(np.frombuffer(bytes(self.raw), "<u4"))}
        self.number += 1
        return row


def _shard_rows(batches: Iterator[pa.RecordBatch], tokenizer_path: str, pattern: str, end_id: int, block: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    writer, encode = _Writer(TaskContext.get().partitionId(), block), encoder(tokenizer_path, pattern)
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        ids = iter(batch.column(0).to_pylist())
        for group in text_groups(batch.column(1), GROUP_CHARS):
            for raw in encode(group):
                yield from (pa.RecordBatch.from_pylist([row], schema=SHARD) for row in writer.add(next(ids), raw + end))
    if writer.raw:
        yield pa.RecordBatch.from_pylist([writer.close()], schema=SHARD)


def write_ids(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> str:
    """Encode each whole text, append ``end_id``, write all in ascending doc_id order; returns the files' path.

    Null texts are empty and get the end id alone; null doc_ids come first; rows that share a doc_id are ordered
    by text, and repeated rows stay. An empty table gives no blocks. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "text")
    run = partial(_shard_rows, tokenizer_path=tokenizer_path, pattern=pattern, end_id=end_id, block=block)
    return write_table(rows.mapInArrow(run, SHARD_DDL), "ids", compression="none")


def _segments(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The documents' parts in each block, with the crc32 of each part's ids."""
    for batch in batches:
        for row in batch.to_pylist():
            raw = unpack_block(row["block"])
            ends = np.cumsum([0, *row["lengths"]])
            starts = [row["first_start"], *(row["number"] * row["size"] + ends[1:-1]).tolist()]
            parts = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            n = len(parts)
            more = {"ids": pa.array([p.astype("<i8") for p in parts], pa.list_(pa.int64()))} if with_ids else {}
            yield pa.record_batch({"shard": pa.array([row["shard"]] * n, pa.int32()), "local": pa.array(starts, pa.int64()), "doc_id": pa.array(row["doc_ids"], pa.int64()), "number": pa.array([row["number"]] * n, pa.int64()), "crc": pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()), "n": pa.array(row["lengths"], pa.int64()), **more})


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """crc32 of a concatenation from the (crc32, bytes) of its parts, by arithmetic on polynomials over GF(2)."""

    def times(a: int, b: int) -> int:
        out = 0
        for k in range(31, -1, -1):
            if a >> k & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    crc = 0
    for part, size in parts:
        power, square, e = 1 << 31, 1 << 30, 8 * size
        while e:
            power = times(power, square) if e & 1 else power
            square, e = times(square, square), e >> 1
        crc = times(power, crc) ^ part
    return crc


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = None
    for batch in batches:
        at = batch.schema.get_field_index("parts") if at is None else at
        crcs = [crc32_joined([(p["crc"], 4 * p["n"]) for p in sorted(parts, key=lambda p: p["number"])]) if len(parts) > 1 else parts[0]["crc"] for parts in batch.column(at).to_pylist()]
        yield pa.record_batch([*batch.columns[:at], pa.array(crcs, pa.int64())], names=[*batch.schema.names[:at], "ids_crc32"])


def read_segments(spark: SparkSession, path: str, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """Parts of documents as the blocks hold them: shard, local (the document's start in it), doc_id, number (of the
    block), crc, n, and ids on demand. A document's ids are those of its parts in order of number."""
    files = spark.read.schema(SHARD_DDL).parquet(path).withColumn("size", F.lit(block).cast("long"))
    return files.mapInArrow(partial(_segments, with_ids=with_ids), "shard int, local long, doc_id long, number long, crc long, n long" + ", ids array<long>" * with_ids)


def read_index(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the ids in the files.

    A document that spans blocks is never gathered: the crc32 of its parts are combined.
    """
    files = spark.read.schema(SHARD_DDL).parquet(path)
    # a row for each shard, of which there are as many as shuffle partitions
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).select("shard", "base")
    docs = read_segments(spark, path, block).groupBy("shard", "local", "doc_id").agg(F.sum("n").alias("n_tokens"), F.collect_list(F.struct("number", "crc", "n")).alias("parts"))
    docs = docs.join(F.broadcast(shards), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "parts")
    return docs.mapInArrow(_fold, "doc_id long, start long, n_tokens long, ids_crc32 long")
