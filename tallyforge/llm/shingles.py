"""Sets of word shingles as 64-bit fingerprints, computed for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mix64, seeded_words, utf8_views

WIDTH = 5
SEGMENT = 1 << 20
BYTES = seeded_words(256, 21)
#: Letters A to Z count as a to z.
BYTES[65:91] = BYTES[97:123]
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BASE = int(seeded_words(1, 22)[0]) | 1
PLACES = seeded_words(WIDTH, 23) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, np.uint64(base & (1 << 64) - 1))
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def word_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word (a run of bytes that aren't ASCII white space); texts begin at ``begins``."""
    gap = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[begins[begins <= len(data)]] = True
    before = np.concatenate([[True], gap[:-1]]) | edge[:-1]
    after = np.concatenate([gap[1:], [True]]) | edge[1:]
    after[-1:] = True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    out, at = np.empty(len(starts), np.uint64), 0
    up = down = np.zeros(0, np.uint64)
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + SEGMENT, "right")))
        size = int(ends[to - 1]) - low
        if size >= len(up):
            up, down = _powers(BASE, size + 1), _powers(pow(BASE, -1, 1 << 64), size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(BYTES[data[low : low + size]] * up[:size], out=sums[1:])
        s = starts[at:to] - low
        out[at:to] = (sums[ends[at:to] - low] - sums[s]) * down[s] + (ends[at:to] - starts[at:to]).astype(np.uint64)
        at = to
    return mix64(out), starts


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, ascending. A text of 1 to 4 words has one, of all its words."""
    data, at = utf8_views(column)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SEGMENT, "right")) - 1)
        words, starts = word_hashes(data[at[i] : at[j]], at[i : j + 1] - at[i])
        first = np.searchsorted(starts, at[i : j + 1] - at[i])
        whole = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
        for k, place in enumerate(PLACES):
            whole += words[k : k + len(whole)] * place
        whole = mix64(whole)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= WIDTH:
                yield np.unique(whole[a : b - WIDTH + 1])
            else:
                yield mix64((words[a:b] * PLACES[: b - a]).sum(keepdims=True)) if b > a else np.zeros(0, np.uint64)
        i = j
