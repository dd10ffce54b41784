"""Compressed FM-index over a sequence of symbols.

Ranks come from a wavelet matrix of packed bits; the suffix array is only made for building.  What
is kept for a symbol is log2(kinds) bits with their counts, a byte of common prefix, and for each
length at which matches were cut a bit and the places of the bits set.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.append(bits, np.zeros(64 - len(bits) % 64, bool)), bitorder="little")
        self.words = packed.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    """Levels of the symbols' bits, the highest first; each level is ordered by the bits above it."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        now = symbols
        for shift in range(max(1, int(kinds - 1).bit_length()) - 1, -1, -1):
            bits = ((now >> shift) & 1).astype(bool)
            self.levels.append((shift, BitVector(bits), int(len(now) - bits.sum())))
            now = np.concatenate([now[~bits], now[bits]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first ``i`` symbols equal ``symbol``."""
        lo, hi = np.zeros_like(i), i
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            a, b = bits.ones(lo).astype(i.dtype), bits.ones(hi).astype(i.dtype)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo


class FMIndex:
    """Index for patterns of up to ``depth`` symbols.

    ``text`` holds symbols from 1; 0 separates its parts and is in no pattern.  Suffixes are
    sorted by their first ``depth`` (255 at most) symbols, which is all that intervals of such
    patterns need, by prefix doubling.
    """

    def __init__(self, text: np.ndarray, depth: int):
        if depth > 255:
            raise ValueError("common prefixes are kept as bytes")
        n = len(text)
        self.n, self.depth = n, depth
        ranks = {1: text.astype(np.int32)}

        def at(step: int, i: np.ndarray) -> np.ndarray:
            r = ranks[step]
            return np.where(i < n, r[np.minimum(i, n - 1)] + 1, 0)

        def joined(a: int, b: int) -> np.ndarray:
            key = ranks[a].astype(np.int64) * (n + 2 + int(ranks[1].max(initial=0))) + at(b, np.arange(n) + a)
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int32)
            new[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
            return new

        step = 1
        while 2 * step <= depth:
            ranks[2 * step] = joined(step, step)
            step *= 2
        full, rest = ranks[step], depth - step
        reached, part = step, step
        while rest:
            while part > rest:
                part //= 2
            ranks[0] = full
            key = full.astype(np.int64) * (n + 2 + int(ranks[1].max(initial=0))) + at(part, np.arange(n) + reached)
            order = np.argsort(key, kind="stable")
            full = np.empty(n, np.int32)
            full[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
            reached, rest = reached + part, rest - part
        ranks.pop(0, None)
        sa = np.argsort(full, kind="stable").astype(np.int64)
        # common prefixes of neighbours, up to depth
        lcp = np.zeros(n + 1, np.uint8)
        a, b = sa[:-1], sa[1:]
        got = np.zeros(max(n - 1, 0), np.int64)
        s = step
        while s:
            for _ in range(2 if s == step else 1):
                x, y = at(s, a + got), at(s, b + got)
                got += np.where((x == y) & (x > 0), s, 0)
            s //= 2
        lcp[1:n] = np.minimum(got, depth)
        self.lcp = lcp  # of each suffix and the one before it; 0 at either end
        ranks.clear()
        self.kinds = int(text.max(initial=0)) + 1
        counts = np.bincount(text, minlength=self.kinds)
        self.smaller = np.cumsum(counts) - counts
        last = np.append(text, 0)[sa - 1]
        last[sa == 0] = 0
        # text[-1] stands for an end mark; as 0 is in no pattern, it disturbs no rank
        self.bwt = WaveletMatrix(last.astype(np.int64), self.kinds)
        self._bounds: dict[int, tuple[BitVector, np.ndarray]] = {}

    def bounds(self, d: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For places ``i`` in suffix order the interval of suffixes that share the first ``d`` > 0 symbols."""
        if d not in self._bounds:
            first = self.lcp[: self.n] < d
            first[:1] = True
            self._bounds[d] = BitVector(first), np.append(np.flatnonzero(first), self.n).astype(np.int32)
        bits, starts = self._bounds[d]
        group = bits.ones(i + 1)
        return starts[group - 1], starts[group]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``symbol`` put before them."""
        c = self.smaller[symbol]
        return c + self.bwt.rank(symbol, lo), c + self.bwt.rank(symbol, hi)

    def matching_statistics(self, sequences: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol of the sequences the longest match that starts there, up to ``depth``,
        and the start of its interval.

        All sequences (``lengths`` symbols from ``starts``; symbols of 1 and on, those the text
        lacks as ``kinds`` or more) are streamed at once, from their last symbol to their first.
        Where a match can't be extended it is cut to its parent interval.
        """
        length, place = np.zeros(len(sequences), np.int32), np.zeros(len(sequences), np.int64)
        order = np.argsort(-lengths, kind="stable")
        starts, ends = starts[order], (starts + lengths)[order]
        lengths = lengths[order]
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.n)
        m = np.zeros(len(starts), np.int64)
        for step in range(int(lengths.max(initial=0))):
            lanes = np.arange(int(np.searchsorted(-lengths, -step, "left")))  # those longer than step
            at = ends[lanes] - 1 - step
            c = sequences[at]
            full = lanes[m[lanes] == self.depth]
            if len(full):
                lo[full], hi[full] = self.bounds(self.depth - 1, lo[full]) if self.depth > 1 else (0, self.n)
                m[full] = self.depth - 1
            todo = lanes
            known = c < self.kinds
            gone = lanes[~known]
            lo[gone], hi[gone], m[gone] = 0, self.n, 0
            todo = lanes[known]
            while len(todo):
                a, b = self.extend(c[todo], lo[todo], hi[todo])
                fits = a < b
                ok = todo[fits]
                lo[ok], hi[ok] = a[fits], b[fits]
                m[ok] += 1
                todo = todo[~fits]
                stuck = m[todo] == 0  # not even the symbol alone
                todo = todo[~stuck]
                if len(todo):
                    up = np.maximum(self.lcp[lo[todo]], self.lcp[hi[todo]]).astype(np.int64)
                    up = np.minimum(up, m[todo] - 1)
                    for d in np.unique(up).tolist():
                        own = todo[up == d]
                        if d:
                            lo[own], hi[own] = self.bounds(d, lo[own])
                        else:
                            lo[own], hi[own] = 0, self.n
                        m[own] = d
            length[at], place[at] = m[lanes], lo[lanes]
        return length, place
