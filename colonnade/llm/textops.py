"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which for UTF-8
is the pattern ``[^\\x20\\x09-\\x0D]+``.  Everything here works on whole texts.

Hashes take a key, drawn anew by :func:`fresh_key` for each run of an operator, so that no
text can be made to hold different words with one hash; what the operators return doesn't
hang on the key.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = pow(0x9E3779B97F4A7C15 | 1, 3, 1 << 64)
_INV = pow(_BASE, -1, 1 << 64)
IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_BLOCKWISE = 256  # bytes; longer words are hashed one by one


def fresh_key() -> int:
    return secrets.randbits(64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        n = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INV)):
            p = np.full(n, base, U64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``most`` bytes; a longer text gets its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of rows i..j: start and end bytes, and first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = IS_WORD[data]
        n = len(data)
        start, end = inside.copy(), inside.copy()
        if n:
            start[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            cut = offsets[:-1][(offsets[:-1] < n) & (offsets[1:] > offsets[:-1])]
            start[cut] = inside[cut]
            end[cut[cut > 0] - 1] = inside[cut[cut > 0] - 1]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, key: int) -> np.ndarray:
        """A 64-bit hash of each word's bytes: blocks of eight are mixed in one after the other."""
        size = self.end - self.start
        data = np.append(self.data, np.zeros(8, np.uint8))
        blocks = np.ndarray(len(data) - 7, "<u8", data.data, strides=(1,))  # the eight bytes from each place
        h = mix(size.astype(U64) * U64(0xD6E8FEB86659FD93) ^ U64(key))
        long = np.flatnonzero(size > _BLOCKWISE)
        todo, at, left = slice(None), self.start, np.where(size > _BLOCKWISE, 0, size)
        while len(at):
            h[todo] = mix((h[todo] ^ (blocks[at] & _LOW_BYTES[np.minimum(left, 8)])) * U64(0x9FB21C651E98DF25))
            more = np.flatnonzero(left > 8)
            todo, at, left = more if isinstance(todo, slice) else todo[more], at[more] + 8, left[more] - 8
        for i in long.tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]].data, digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
        return h


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, row borders not regarded; len(words)-k+1 of them."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    h = np.zeros(m, U64)
    for i in range(k):
        h = h * U64(0xFF51AFD7ED558CCD) + words[i : i + m]
    return mix(h)


def shingle_sets(words: Words, k: int, key: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles.

    A row with 1 to k-1 words has its whole sequence as its only shingle; a row
    without words has none.
    """
    h = words.hashes(key)
    grams = gram_hashes(h, k)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.array([_short(h[a:b])], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def _short(h: np.ndarray) -> int:
    x = len(h) * 0x51ED270B7F4A7C15
    for v in h.tolist():
        x = (x * 0xFF51AFD7ED558CCD + v) % (1 << 64)
    return x % (1 << 64)
