"""Elias-Fano coded monotone sequences with vectorised successor search."""

from __future__ import annotations

import numpy as np

#: Queries answered at once.
STEP = 1 << 15


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers.

    The low bits of each value are packed; the high parts are a bit vector in which value i
    sets bit high + i. Counts of ones before each 64-bit word make select a binary search.
    All parts are plain arrays, so a level can be written to a file and mapped.
    """

    def __init__(self, values: np.ndarray | None = None, parts: dict[str, np.ndarray] | None = None):
        if parts is None:
            parts = self._encode(np.asarray(values, np.uint64))
        self.head, self.low, self.high, self.ones = parts["head"], parts["low"], parts["high"], parts["ones"]
        self.n, self.bits = int(self.head[0]), int(self.head[1])

    def parts(self) -> dict[str, np.ndarray]:
        return {"head": self.head, "low": self.low, "high": self.high, "ones": self.ones}

    @staticmethod
    def _encode(v: np.ndarray) -> dict[str, np.ndarray]:
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits and n:
            x = v & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, x << shift)
            over = (shift + np.uint64(bits)) > 64
            np.bitwise_or.at(low, word[over] + 1, x[over] >> (np.uint64(64) - shift[over]))
        place = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (int(place[-1]) + 2 if n else 2) // 64 + 1
        marks = np.zeros(size * 64, np.uint8)
        marks[place] = 1
        high = np.packbits(marks, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return {"head": np.array([n, bits], np.int64), "low": low, "high": high, "ones": ones}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = self.low[word] >> shift
        over = shift > 0
        x[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return x & np.uint64((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Bit position of the k-th one or zero, counted from 0."""
        before = self.ones if one else np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.clip(np.searchsorted(before, k, side="right") - 1, 0, len(self.high) - 1)
        x = self.high[word] if one else ~self.high[word]
        bits = np.unpackbits(x.reshape(-1, 1).view(np.uint8), axis=1, bitorder="little")
        reached = np.cumsum(bits, axis=1, dtype=np.uint8) > (k - before[word])[:, None]
        return word * 64 + reached.argmax(axis=1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``."""
        out = np.empty(len(i), np.uint64)
        for lo in range(0, len(i), STEP):
            part = np.asarray(i[lo : lo + STEP], np.int64)
            high = (self._select(part, True) - part).astype(np.uint64)
            out[lo : lo + STEP] = (high << np.uint64(self.bits)) | self._low(part)
        return out

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first value not below each x (n if none), and whether it equals x."""
        x = np.asarray(x, np.uint64)
        at, equal = np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        if not self.n:
            return at, equal
        top = int(self.get(np.array([self.n - 1]))[0])
        for lo in range(0, len(x), STEP):
            q = x[lo : lo + STEP]
            inside = np.flatnonzero(q <= np.uint64(top))
            h = (q[inside] >> np.uint64(self.bits)).astype(np.int64)
            low = q[inside] & np.uint64((1 << self.bits) - 1)
            # Values with high part h lie between its zero and the one before it.
            begin = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - np.maximum(h - 1, 0), 0)
            end = np.minimum(self._select(h, False) - h, self.n)
            here = begin.copy()
            live = np.flatnonzero(here < end)
            while len(live):
                smaller = self._low(here[live]) < low[live]
                live = live[smaller]
                here[live] += 1
                live = live[here[live] < end[live]]
            hit = np.flatnonzero(here < end)
            same = np.zeros(len(inside), bool)
            same[hit] = self._low(here[hit]) == low[hit]
            at[lo + inside] = here
            equal[lo + inside] = same
        return at, equal
