"""Codes of words, kept for reuse: a worker codes each distinct word once.

Words are looked up by two 64-bit hashes in an open table in numpy, all words of a batch at once; long words, which are rare,
are coded each time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .common import ragged

#: Words of more bytes are not kept.
LONG = 256


@lru_cache(maxsize=2)
def _constants(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(1, 1 << 62)) * 2 + 1
    powers, inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    return values, powers, inverse


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each range of bytes."""
    values, powers, inverse = _constants(seed, 1 << max(19, int(len(buf)).bit_length()))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * powers[: len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


class WordPool:
    """encode: from a list of distinct words (bytes) to their codes in one array and the number of codes of each.

    Holds `most` words about, then starts anew: memory is bounded, results are the same.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 1_200_000):
        self.encode, self.most = encode, most
        self._clear(1 << 16)

    def _clear(self, slots: int) -> None:
        self.first, self.second, self.row = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.n, self.used = 0, 0
        self.codes, self.start, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The row of each word, -1 if it isn't there."""
        mask = np.uint64(len(self.row) - 1)
        out, live, slot = np.full(len(a), -1, np.int64), np.arange(len(a)), (a & mask).astype(np.int64)
        while len(live):
            row = self.row[slot]
            hit = (row >= 0) & (self.first[slot] == a[live]) & (self.second[slot] == b[live])
            out[live[hit]] = row[hit]
            on = (row >= 0) & ~hit
            live, slot = live[on], (slot[on] + 1) & int(mask)
        return out

    def _place(self, a: np.ndarray, b: np.ndarray, rows: np.ndarray) -> None:
        """Enters words that are distinct and not there."""
        mask = len(self.row) - 1
        live, slot = np.arange(len(a)), (a & np.uint64(mask)).astype(np.int64)
        while len(live):
            free = self.row[slot] < 0
            self.row[slot[free]] = rows[live[free]]
            won = self.row[slot] == rows[live]
            self.first[slot[won]], self.second[slot[won]] = a[live[won]], b[live[won]]
            live, slot = live[~won], (slot[~won] + 1) & mask

    def _add(self, a: np.ndarray, b: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> None:
        m = len(a)
        if 2 * (self.n + m) > len(self.row):
            keep = np.flatnonzero(self.row >= 0)
            old = self.first[keep], self.second[keep], self.row[keep]
            slots = 1 << (2 * (self.n + m)).bit_length()
            self.first, self.second, self.row = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
            self._place(*old)
        grown = lambda x, n: x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x) // 2), x.dtype)])
        self.codes, self.start, self.count = grown(self.codes, self.used + len(codes)), grown(self.start, self.n + m), grown(self.count, self.n + m)
        self.codes[self.used : self.used + len(codes)] = codes
        self.count[self.n : self.n + m] = counts
        self.start[self.n : self.n + m] = self.used + np.cumsum(counts) - counts
        self._place(a, b, np.arange(self.n, self.n + m, dtype=np.int32))
        self.n += m
        self.used += len(codes)

    def code(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of the words buf[starts[i]:ends[i]] in turn, and the number of each."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.n > self.most:
            self._clear(1 << 16)
        a, b = range_hashes(buf, starts, ends, 1), range_hashes(buf, starts, ends, 2)
        row = self._find(a, b)
        short = ends - starts <= LONG
        missing = np.flatnonzero((row < 0) & short)
        if len(missing):
            _, at = np.unique(a[missing], return_index=True)
            at = missing[at]
            codes, counts = self.encode([buf[s:e].tobytes() for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            self._add(a[at], b[at], codes, counts)
            row[missing] = self._find(a[missing], b[missing])
        rest = np.flatnonzero(row < 0)  # long words, and one of two whose first hashes are equal
        if not len(rest):
            counts = self.count[row].astype(np.int64)
            return self.codes[ragged(self.start[row], counts)], counts
        codes, more = self.encode([buf[s:e].tobytes() for s, e in zip(starts[rest].tolist(), ends[rest].tolist())])
        counts, start = self.count[row].astype(np.int64), self.start[row]
        counts[rest] = more
        start[rest] = self.used + np.cumsum(more) - more
        return np.concatenate([self.codes[: self.used], codes.astype(np.uint32)])[ragged(start, counts)], counts
