"""The public byte-level pattern's pieces of many texts at once, from classes of characters in numpy.

The pattern takes a contraction ('s 't 're 've 'm 'll 'd), a run of letters, of numbers, or of other visible characters,
each with one space before it if there is one, or white space. Its cuts depend only on the classes of nearby
characters, so they are found with array operations; ``split_texts`` equals the pattern's findall.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

import numpy as np
import regex

#: Pieces that a Python worker remembers in each of two generations.
GENERATION = 120_000

LETTER, NUMBER, OTHER, WHITE, BREAK = range(5)
#: What follows the apostrophe of a contraction.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
SENTINEL = 0x110000


@cache
def classes() -> np.ndarray:
    """The class of each code point, by the regular expression library's own tables."""
    table = np.full(SENTINEL + 1, OTHER, np.uint8)
    for low in range(0, SENTINEL, 1 << 16):
        points = [chr(c) for c in range(low, low + (1 << 16)) if not 0xD800 <= c < 0xE000]
        text = "".join(points)
        for code, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
            for m in regex.finditer(pattern, text):
                a, b = ord(text[m.start()]), ord(text[m.end() - 1])
                table[a : b + 1] = np.where((np.arange(a, b + 1) >= 0xD800) & (np.arange(a, b + 1) < 0xE000), OTHER, code)
    table[SENTINEL] = BREAK
    return table


def cuts(points: np.ndarray) -> np.ndarray:
    """Where pieces begin in code points that end in a sentinel; a sentinel stands between texts."""
    kind = classes()[points]
    n = len(points)
    before = np.concatenate([[BREAK], kind[:-1]]).astype(np.uint8)
    after = np.concatenate([kind[1:], [BREAK]]).astype(np.uint8)
    white = kind == WHITE
    # the last of some white space before a visible character: a plain space joins that character, another stands alone
    last_white = white & (after != WHITE) & (after != BREAK)
    joins = last_white & (points == 32)
    begin = (kind != before) | last_white | (kind == BREAK)
    # where a space joined, the run after it doesn't begin a piece of its own
    joined = np.concatenate([[False], joins[:-1]])
    begin &= ~joined
    # contractions begin where a run of others would, at an apostrophe
    marks = np.flatnonzero((points == 39) & begin & (after == LETTER))
    for ending in ENDINGS:
        size = len(ending)
        near = marks[marks + size < n]
        hit = near[np.all([points[near + 1 + k] == ord(c) for k, c in enumerate(ending)], axis=0)]
        begin[hit + 1] = False
        begin[hit + 1 + size] = True
        marks = np.setdiff1d(marks, hit, assume_unique=True)
    return np.flatnonzero(begin)


def split_texts(texts: list[str]) -> list[list[str]]:
    """The pieces of each text, in order."""
    if not texts:
        return []
    whole = "\n".join(texts) + "\n"
    points = np.frombuffer(whole.encode("utf-32-le"), "<u4").copy()
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    points[ends] = SENTINEL
    at = cuts(points)
    edges = at.tolist()
    pieces = [whole[a:b] for a, b in zip(edges, [*edges[1:], len(whole)], strict=True)]
    # each text's last cut is its sentinel
    out, first = [], 0
    for last in np.searchsorted(at, ends).tolist():
        out.append(pieces[first:last])
        first = last + 1
    return out


class Recent:
    """What is known of the pieces met lately: those of the present generation and of the one before.

    What is used goes on to the present generation, so common pieces stay known and rare ones are forgotten.
    """

    def __init__(self, most: int = GENERATION):
        self.most, self.now, self.before = most, {}, {}

    def missing(self, pieces: Iterable[str]) -> list[str]:
        """The pieces to add to ``now``; afterwards all of ``pieces`` are to be found there."""
        if len(self.now) > self.most:
            self.now, self.before = {}, self.now
        out = []
        for p in pieces:
            if p not in self.now:
                if p in self.before:
                    self.now[p] = self.before[p]
                else:
                    out.append(p)
        return out
