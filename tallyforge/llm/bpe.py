"""Byte-level BPE by recursive DuckDB queries, one small database for each Python worker.

A text is split by a pattern into pieces. The pieces that a worker hasn't met before become token-position rows,
which a query joins with the merge table, and a recursion contracts the leftmost minimum-rank pair of every
unfinished piece in each round, until no pair can merge. Long pieces would need too many rounds: there all places
of the minimum-rank pair contract in the same round where they don't overlap (a pair that a merge makes never ranks
lower, so the result is the same). Decoding joins ids with the vocabulary and concatenates in order of position.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import duckdb
import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Recent, split_texts

#: Characters of text that a worker splits at a time.
GROUP_CHARS = 1_000_000
MEMORY = "300MB"

#: Pieces of more bytes are long.
LONG = 96

#: ``start`` has a row for each position of a piece, ``words`` each piece's byte tokens in order. A merge's rank is its token's id.
ENCODE = """
WITH RECURSIVE step(piece, toks, ranks, low) AS (
  -- ranks[i] is the rank of the pair that begins at i, so the last one never merges
  SELECT w.piece, w.toks, r.ranks, r.low FROM words w JOIN (
    SELECT s.piece, list(coalesce(m.rank, 2147483647) ORDER BY s.pos) AS ranks, coalesce(min(m.rank), 2147483647) AS low
    FROM start s LEFT JOIN merges m ON m.a = s.tok AND m.b = s.next_tok GROUP BY s.piece
  ) r ON r.piece = w.piece
  UNION ALL
  SELECT piece, toks, ranks, list_min(ranks) FROM (
    SELECT p.piece,
           toks[:nth - 1] || [low] || toks[nth + 2:] AS toks,
           CASE WHEN nth > 1 THEN ranks[:nth - 2] || [coalesce(l.rank, 2147483647)] ELSE [] END
             || [coalesce(r.rank, 2147483647)] || ranks[nth + 2:] AS ranks
    FROM (SELECT *, list_position(ranks, low) AS nth FROM step WHERE low < 2147483647) p
    LEFT JOIN merges l ON l.a = p.toks[nth - 1] AND l.b = low
    LEFT JOIN merges r ON r.a = low AND r.b = p.toks[nth + 2]
  )
)
SELECT piece, toks FROM step WHERE low = 2147483647
"""

ENCODE_LONG = """
WITH RECURSIVE step(piece, pos, tok, live) AS (
  SELECT piece, pos, tok, true FROM start
  UNION ALL
  (
  WITH pair AS (
    SELECT s.piece, s.pos, s.tok, m.rank,
           row_number() OVER w AS nth, lead(s.pos) OVER w AS next_pos
    FROM (SELECT *, lead(tok) OVER (PARTITION BY piece ORDER BY pos) AS next_tok FROM step WHERE live) s
    LEFT JOIN merges m ON m.a = s.tok AND m.b = s.next_tok
    WINDOW w AS (PARTITION BY s.piece ORDER BY s.pos)
  ), least AS (
    SELECT *, min(rank) OVER (PARTITION BY piece) AS low FROM pair
  ), hit AS (
    -- neighbouring hits (as in aaa) form runs; every other one of a run merges, from its left
    SELECT piece, pos, next_pos, rank, row_number() OVER (PARTITION BY piece, run ORDER BY nth) % 2 = 1 AS merges
    FROM (SELECT *, nth - row_number() OVER (PARTITION BY piece ORDER BY nth) AS run FROM least WHERE rank = low)
  )
  SELECT l.piece, l.pos, coalesce(h.rank, l.tok), l.low IS NOT NULL
  FROM least l
  LEFT JOIN hit h ON h.piece = l.piece AND h.pos = l.pos AND h.merges
  LEFT JOIN hit g ON g.piece = l.piece AND g.next_pos = l.pos AND g.merges
  WHERE g.piece IS NULL
  )
)
SELECT piece, list(tok ORDER BY pos) AS ids FROM step WHERE NOT live GROUP BY piece
"""

DECODE = """
SELECT i.seq, string_agg(v.hex, '' ORDER BY i.pos) AS hex
FROM ids i JOIN vocab v ON v.id = i.id GROUP BY i.seq
"""

#: What is kept of encoded pieces: ids as text, and the bytes that they decode to. With one thread, an aggregate takes rows in
#: the order of its input, which is sorted once and not group by group.
DIGEST = """
SELECT e.piece, array_to_string(e.toks, ' ') AS ids, d.raw
FROM encoded e JOIN (
  SELECT piece, from_hex(string_agg(hex, '')) AS raw FROM (
    SELECT i.piece, i.pos, v.hex
    FROM (SELECT piece, unnest(toks) AS id, generate_subscripts(toks, 1) AS pos FROM encoded) i
    JOIN vocab v ON v.id = i.id ORDER BY i.piece, i.pos
  ) GROUP BY piece
) d ON d.piece = e.piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class DuckBpe:
    """Encodes and decodes with a rank table in an in-memory DuckDB of one thread."""

    def __init__(self, ranks: dict[bytes, int]):
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY})
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        merges: dict[str, list[int]] = {"a": [], "b": [], "rank": []}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    for column, value in zip(merges.values(), (a, b, rank), strict=True):
                        column.append(value)
        vocab = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]})
        self._load("merges", pa.table({k: pa.array(v, pa.int32()) for k, v in merges.items()}))
        self._load("vocab", vocab)

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    @staticmethod
    def _positions(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Number and position of each row, for sequences of these sizes one after another."""
        number = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        starts = np.cumsum([0, *sizes[:-1]]) if sizes else np.zeros(0, np.int64)
        return number, (np.arange(len(number)) - np.repeat(starts, sizes)).astype(np.int32)

    def _encode(self, pieces: list[bytes]) -> None:
        """Fill the table ``encoded`` with (piece, toks) of each piece, by its place."""
        self.db.execute("CREATE OR REPLACE TABLE encoded (piece INTEGER, toks INTEGER[])")
        for query, some in ((ENCODE, [i for i, p in enumerate(pieces) if len(p) <= LONG]), (ENCODE_LONG, [i for i, p in enumerate(pieces) if len(p) > LONG])):
            if some:
                sizes = [len(pieces[i]) for i in some]
                number, pos = self._positions(sizes)
                tok = self.byte_ids[np.frombuffer(b"".join([pieces[i] for i in some]), np.uint8)]
                next_tok = np.append(np.where(number[1:] == number[:-1], tok[1:], -1), -1).astype(np.int32)
                self._load("start", pa.table({"piece": np.array(some, np.int32)[number], "pos": pos, "tok": tok, "next_tok": next_tok}))
                self._load("words", pa.table({"piece": np.array(some, np.int32), "toks": pa.ListArray.from_arrays(np.cumsum([0, *sizes], dtype=np.int32), tok)}))
                self.db.execute(f"INSERT INTO encoded {query}")

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; pieces are not empty."""
        self._encode(pieces)
        return [ids for (ids,) in self.db.execute("SELECT toks FROM encoded ORDER BY piece").fetchall()]

    def digest(self, pieces: list[bytes]) -> Iterator[tuple[int, str, bytes]]:
        """(place, ids as text, decoded bytes) of each piece, in any order."""
        self._encode(pieces)
        got = self.db.sql(DIGEST).to_arrow_table()
        for name in ("encoded", "start", "words"):
            self.db.execute(f"DROP TABLE IF EXISTS {name}")
        return zip(*(c.to_pylist() for c in got.columns), strict=True)

    def decode(self, sequences: list[list[int]]) -> list[bytes]:
        """Bytes of each sequence of ids."""
        number, pos = self._positions([len(s) for s in sequences])
        ids = np.fromiter((t for s in sequences for t in s), np.int32, len(number))
        self._load("ids", pa.table({"seq": number, "pos": pos, "id": ids}))
        got = self.db.sql(DECODE).to_arrow_table()
        found = dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
        return [bytes.fromhex(found.get(i, "")) for i in range(len(sequences))]


class PieceTable:
    """What a worker knows of pieces: (ids as text, the bytes that decoding the ids gave)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bpe, self.known = DuckBpe(ranks), Recent()

    def learn(self, pieces: set[str]) -> dict[str, tuple[str, bytes]]:
        new = self.known.missing(pieces)
        raw = [p.encode() for p in new]
        for i, ids, decoded in self.bpe.digest(raw) if new else ():
            if decoded != raw[i]:
                raise ValueError(f"{raw[i]!r} decodes to {decoded!r}")
            self.known.now[new[i]] = ids, decoded
        return self.known.now


_TABLES: dict[str, PieceTable] = {}


def piece_table(ranks_path: str, ranks) -> PieceTable:
    """This Python worker's table for a rank file; it outlives a task, and knows one rank file at a time."""
    if ranks_path not in _TABLES:
        _TABLES.clear()
        _TABLES[ranks_path] = PieceTable(ranks.value)
    return _TABLES[ranks_path]


def splitter(pattern: str) -> Callable[[list[str]], list[list[str]]]:
    """A function from texts to their pieces; the public pattern has a quicker equal."""
    if pattern == PATTERN:
        return split_texts
    find = regex.compile(pattern).findall
    return lambda texts: [find(t) for t in texts]


def text_groups(column: pa.Array, most: int = GROUP_CHARS) -> Iterator[list[str]]:
    """Consecutive texts (null as empty) in groups of about ``most`` characters, at least one text each."""
    group, size = [], 0
    for text in column:
        group.append(text.as_py() or "")
        size += len(group[-1])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _rows(batches: Iterator[pa.RecordBatch], ranks_path: str, ranks, pattern: str, full: bool) -> Iterator[pa.RecordBatch]:
    split, known = splitter(pattern), piece_table(ranks_path, ranks)
    for batch in batches:
        counts, ids, shas, back = [], [], [], []
        for group in text_groups(batch.column(1)):
            split_group = split(group)
            of = known.learn(set().union(*split_group)).__getitem__
            for pieces in split_group:
                texts, decoded = zip(*map(of, pieces), strict=True) if pieces else ((), ())
                joined = " ".join(texts)
                counts.append(joined.count(" ") + 1 if pieces else 0)
                shas.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(b"".join(decoded)).hexdigest())
                if full:
                    ids.append([int(x) for x in joined.split()])
        more = {"ids": pa.array(ids, pa.list_(pa.int32()))} if full else {}
        yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(back, pa.string()), **more})


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, on demand) of each whole text.

    A null or empty text has no ids. Repeated rows give repeated rows; other columns are not read. The rank file
    is read by the driver and broadcast: its size is fixed by the vocabulary. ``pattern`` must match every
    character of a text in some piece, as the public patterns do.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(partial(_rows, ranks_path=ranks_path, ranks=ranks, pattern=pattern, full=with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def bpe_decode(encoded: DataFrame, ranks_path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and bytes of each row's ids; null ids give no bytes."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = DuckBpe(ranks.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.record_batch({"doc_id": part.column(0), "decoded": pa.array(bpe.decode([x or [] for x in part.column(1).to_pylist()]), pa.binary())})

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(decode, "doc_id long, decoded binary")
