"""Words and terms of many texts at once: maximal runs of bytes of a class, and their fingerprints, in numpy."""

from __future__ import annotations

import numpy as np

from .common import mix64, seeded_words

SEGMENT = 1 << 20
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def byte_runs(data: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes b with inside[b]; texts end at ``ends`` and no run crosses one."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flag = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = True
    edge[ends] = True
    before, after = np.concatenate([[False], flag[:-1]]), np.concatenate([flag[1:], [False]])
    return np.flatnonzero(flag & (~before | edge[:-1])), np.flatnonzero(flag & (~after | edge[1:])) + 1


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges that begin at ``starts``, one range after another."""
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(int(lengths.sum()))


class RunHashes:
    """64-bit fingerprints of runs of bytes: polynomials modulo 2^64 over a table of random words for the bytes."""

    def __init__(self, seed: int):
        self.table = seeded_words(256, seed)
        self.base = int(seeded_words(1, seed + 77)[0]) | 1
        self.up = np.ones(1, np.uint64)

    def powers(self, n: int) -> np.ndarray:
        if len(self.up) < n:
            self.up = np.full(max(n, 64), np.uint64(self.base))
            self.up[0] = 1
            self.up = np.cumprod(self.up, dtype=np.uint64)
        return self.up

    def of(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Fingerprints of data[start:stop], none of which is empty; both ascend."""
        out, at = np.empty(len(starts), np.uint64), 0
        lengths = stops - starts
        with np.errstate(over="ignore"):
            while at < len(starts):
                if lengths[at] > SEGMENT:
                    total = 0
                    for k in range(int(starts[at]), int(stops[at]), SEGMENT):
                        piece = self.table[data[k : min(k + SEGMENT, int(stops[at]))]]
                        total += int((piece * self.powers(SEGMENT)[: len(piece)]).sum()) * pow(self.base, k - int(starts[at]), 1 << 64)
                    out[at] = np.uint64((total + int(lengths[at])) % (1 << 64))
                    at += 1
                    continue
                to = max(at + 1, int(np.searchsorted(stops, starts[at] + SEGMENT, "right")))
                size = lengths[at:to]
                first = np.cumsum(size) - size
                within = np.arange(int(size.sum())) - np.repeat(first, size)
                values = self.table[data[gather(starts[at:to], size)]] * self.powers(int(size.max()))[within]
                out[at:to] = np.add.reduceat(values, first) + size.astype(np.uint64)
                at = to
        return mix64(out)
