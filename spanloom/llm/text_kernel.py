"""Vectorised word hashing over Arrow string columns.

A *word* is a maximal run of bytes outside ``{0x20, 0x09..0x0D}``; A-Z count as a-z.  Words become 64-bit
hashes without being materialised as Python strings: each byte is mapped through a fixed random table, a
polynomial prefix sum modulo 2**64 gives every word's hash from two array look-ups, and a splitmix finaliser
spreads the bits.  Texts are handled in chunks of about ``CHUNK`` bytes (one longer text is a chunk of its
own), so the memory needed follows the chunk or the longest single text, never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise, modulo 2**64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, CHUNK), base, np.uint64)
            steps[0] = 1
            _POW[k] = np.cumprod(steps)
    return _POW[0], _POW[1]


def text_chunks(column: pa.Array | pa.ChunkedArray, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, bytes, offsets)``; null texts are empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk, "right")) - 1)
        end = min(end, n)
        yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a chunk, and for each text the index of its first word (n + 1 values)."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    space = _SPACE[raw]
    before = np.empty(len(raw), bool)
    before[0], before[1:] = True, space[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[firsts] = True
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = True, space[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = True
    np.logical_not(space, out=space)
    starts, ends = np.flatnonzero(space & before), np.flatnonzero(space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One uint64 for each word; equal (lower-cased) words have equal values."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[raw] * up[: len(raw)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashed_texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, word hashes, index of each text's first word)`` chunk by chunk."""
    with np.errstate(over="ignore"):
        for row, raw, offsets in text_chunks(column):
            starts, ends, first = word_spans(raw, offsets)
            yield row, word_hashes(raw, starts, ends), first


_STEP = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; a shorter text is one shingle, no words are none."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        k = min(n, width)
        total = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            total += words[j : n - k + 1 + j] * _STEP[j]
        return np.unique(mix64(total))


def digest(values: np.ndarray) -> bytes:
    """16 bytes that stand for a sorted set."""
    return blake2b(values.tobytes(), digest_size=16).digest()
