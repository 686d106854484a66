"""Vectorised word and shingle hashing over Arrow text columns.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D). All
of a chunk's words are hashed at once: a polynomial over the UTF-8 bytes
(modulo 2**64) is taken from prefix sums and then mixed, so no Python code
runs per word. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20                       # bytes hashed at once; one longer text is its own chunk
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_KEPT = CHUNK + 1                      # powers kept by a worker; a longer text makes its own

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    found = _POWERS
    if len(found[0]) < n:
        found = []
        for base in (_BASE, _INVERSE):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            found.append(np.cumprod(steps, out=steps))
        if n <= _KEPT:
            _POWERS[:] = found
    return found[0][:n], found[1][:n]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of ``mask`` that stays within a text."""
    n = len(mask)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | first[1:n]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | first[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the polynomial's terms before each byte, inverse powers): what span hashes are made of."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    return sums, inverse


def span_hasher(data: np.ndarray, prefix=None):
    """(starts, ends) -> 64-bit hash of each byte span of ``data``."""
    sums, inverse = prefix or prefix_sums(data)
    return lambda start, end: mix((sums[end] - sums[start]) * inverse[start]
                                  + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hasher(data)(start, end)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, bounds) of a chunk's words; bounds cut them by text."""
    start, end = runs(~SPACE[data], offsets)
    return hash_spans(data, start, end), start, end, np.searchsorted(start, offsets)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (callers cut at text bounds)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[:len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = out * _BASE + hashes[k:len(hashes) - n + 1 + k]
    return mix(out + np.uint64(n))


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """Per text, its sorted distinct ``n``-word shingle hashes.

    A-Z are lower-cased. A text of fewer than ``n`` words has its whole
    sequence as one shingle; a text without words has none.
    """
    for lo, hi, data, offsets in chunks(column):
        data = LOWER[data]
        hashes, _, _, bounds = words(data, offsets)
        grams = ngrams(hashes, n)
        for k in range(hi - lo):
            a, b = bounds[k], bounds[k + 1]
            if b - a >= n:
                yield np.unique(grams[a:b - n + 1])
            elif b > a:
                yield ngrams(hashes[a:b], int(b - a))
            else:
                yield hashes[:0]


_CLASS = np.full(256, 2, np.uint8)            # 0 space, 1 word, 2 punctuation
_CLASS[SPACE] = 0
_CLASS[0x80:] = 1
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _CLASS[_a:_b] = 1
SHAPES = 6                                    # see tokens()


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, shapes, bounds) of runs of word bytes and of punctuation.

    Shapes: 0 lower case, 1 capitalised, 2 all capitals, 3 digits only, 4 one
    punctuation mark, 5 a longer run of marks.
    """
    cls = _CLASS[data]
    n = len(cls)
    turn = np.ones(n + 1, bool)
    turn[1:n] = cls[1:] != cls[:-1]
    turn[offsets] = True
    cut = np.flatnonzero(turn)
    start, end = cut[:-1], cut[1:]
    held = cls[start] != 0
    start, end = start[held], end[held]
    count = lambda mask: (lambda c: c[end] - c[start])(np.concatenate([[0], np.cumsum(mask)]))
    size = end - start
    upper = count((data >= 0x41) & (data < 0x5B))
    lower = count((data >= 0x61) & (data < 0x7B))
    digit = count((data >= 0x30) & (data < 0x3A))
    mark = cls[start] == 2
    shape = np.where(mark, np.where(size > 1, 5, 4),
                     np.where(digit == size, 3, np.where((upper > 1) & (lower == 0), 2, np.where(upper > 0, 1, 0))))
    return start, end, shape, np.searchsorted(start, offsets)
