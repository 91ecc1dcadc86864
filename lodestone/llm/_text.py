"""Whole-batch text primitives: UTF-8 buffers, words and Rabin-Karp hashes.

Everything here works on one contiguous UTF-8 buffer holding many documents,
so that a batch costs a handful of NumPy passes instead of a Python loop.

Hashes are polynomials modulo the prime 2**31 - 1, two for each family: 62 bits. Families share no
base, down to the words' own bytes, so two of them make 124 bits. Different texts of n bytes
or words collide in a polynomial for n bases at most (modulo a power of two, some texts collide for all of them).
Bases follow from a key; callers that must not be misled by made-up texts draw one.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes 0x20 and 0x09-0x0D separate words; every other byte belongs to one.
IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

PRIME = (1 << 31) - 1
_P, _BITS = np.uint64(PRIME), np.uint64(31)
#: Text handled at once, which bounds the arrays beside it; a longer document is handled alone.
CHUNK_BYTES = 1 << 19
#: Words or windows hashed at once, and the longest word that is hashed as a polynomial.
_STEP, _LONG_WORD = 1 << 15, 1 << 16


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _fold(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime; takes ``x`` over."""
    for _ in range(2):
        high = x >> _BITS
        x &= _P
        x += high
    x[x >= _P] -= _P
    return x


class _Powers:
    """Powers of a base and of its inverse modulo the prime, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.n = base, pow(base, -1, PRIME), 0
        self.up = self.down = np.ones(0, dtype=np.uint32)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            self.up, self.down = (self._table(b, size) for b in (self.base, self.inverse))
            self.n = size
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        out = np.empty(size, dtype=np.uint32)
        out[0], done, step = 1, 1, base
        while done < size:
            out[done : 2 * done] = _fold(out[:done].astype(np.uint64) * np.uint64(step))
            step, done = step * step % PRIME, 2 * done
        return out


@lru_cache(maxsize=8)
def _bases(use: str, family: int, key: int) -> tuple[_Powers, _Powers]:
    """The two bases of a family, in [2**16, prime)."""
    raw = hashlib.blake2b(f"{use} {family} {key}".encode(), digest_size=16).digest()
    return tuple(_Powers((1 << 16) + int.from_bytes(raw[i : i + 8], "little") % (PRIME - (1 << 16))) for i in (0, 8))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as ``(bytes, offsets)``; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the machine: workers live long, and their largest batch would stay with them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes, one document at least; memory is released after the last."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop
    release()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each document's first word index."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~IS_SEPARATOR[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    cuts = offsets[1:][offsets[1:] > 0] - 1
    after[cuts] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0, key: int = 0) -> np.ndarray:
    """A 62-bit Rabin-Karp hash of each byte span; spans are in order."""
    out = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        low = starts[a]
        b = min(max(int(np.searchsorted(ends, low + _LONG_WORD, side="right")), a + 1), len(starts))
        if ends[a] - low > _LONG_WORD:
            raw = hashlib.blake2b(data[low : ends[a]].tobytes(), digest_size=8, key=f"{family} {key}".encode()).digest()
            out[a] = int.from_bytes(raw, "little") >> 2
        else:
            values = data[low : ends[b - 1]].astype(np.uint64) + np.uint64(1)
            first, last = starts[a:b] - low, ends[a:b] - low
            out[a:b] = _joined(_bases("bytes", family, key), (values, values), first, last)
        a = b
    return out


def _joined(bases: tuple[_Powers, _Powers], values: tuple[np.ndarray, np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Both polynomials of ``values[first:last]``, 31 bits each, in one number; values are less than 2**31."""
    halves = []
    for powers, v in zip(bases, values, strict=True):
        up, down = powers.get(len(v))
        sums = np.zeros(len(v) + 1, dtype=np.uint64)
        terms = v * up
        np.cumsum(terms if v.itemsize and int(v.max(initial=0)) < 1 << 10 else _fold(terms), out=sums[1:])
        halves.append(_fold(_fold(sums[last] - sums[first]) * down[first]))
    return halves[0] << _BITS | halves[1]


def window_hashes(values: np.ndarray, starts: np.ndarray, width: np.ndarray | int, family: int = 0, key: int = 0) -> np.ndarray:
    """A Rabin-Karp hash of ``values[s : s + width]`` for each start, in order: 62 bits spread over 64."""
    out = np.empty(len(starts), dtype=np.uint64)
    ends = starts + width
    for a in range(0, len(starts), _STEP):
        first, last = starts[a : a + _STEP], ends[a : a + _STEP]
        low, high = int(first[0]), int(last.max())
        mixed = mix64(values[low:high])
        parts = _fold(mixed & np.uint64((1 << 32) - 1)), _fold(mixed >> np.uint64(32))
        out[a : a + _STEP] = _joined(_bases("words", family, key), parts, first - low, last - low)
    return mix64(out)


def window_starts(firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window of ``width`` words inside one document, and its document."""
    counts = np.maximum(np.diff(firsts) - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    return firsts[:-1][owner] + ranks(counts), owner


def ranks(counts: np.ndarray) -> np.ndarray:
    """``0..c-1`` for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles and each document's first; a shorter document is one shingle."""
    starts, ends, firsts = words(data, offsets)
    values = span_hashes(data, starts, ends, family)
    n = np.diff(firsts)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    owner = np.repeat(np.arange(len(n)), counts)
    at = firsts[:-1][owner] + ranks(counts)
    return window_hashes(values, at, np.minimum(n[owner], width), family), np.concatenate([[0], np.cumsum(counts)])
