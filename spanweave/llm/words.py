"""Vectorised words, 5-word shingles and hashes over Arrow string columns.

Words are maximal runs of characters outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased.  All
of it works on the UTF-8 bytes: those separators are single bytes that never occur inside
another character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; bounds the memory of a Python worker.
PIECE_BYTES = 1 << 20
#: The same where numbers of eight bytes are made of every byte or word, some ten of them at a time.
WORD_BYTES = 1 << 18
SHINGLE = 5

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Second meaning of a word: every ASCII character but letters and digits separates.
_NO_LETTER = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_LOWER = _BYTE[_LOWER]
_MULT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    if off is None or not len(col):
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        col = batch.column(column)
        _, off = string_bytes(col)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def _power(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), np.uint64(_BASE))], dtype=np.uint64)


_POW = _power(256)


def powers(n: int) -> np.ndarray:
    """The first ``n`` or more powers of the base."""
    return _POW if n <= len(_POW) else _power(n)


def _spans(data: np.ndarray, cuts: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of words of one piece; ``cuts`` are positions where rows start."""
    solid = ~gaps[data]
    if not solid.any():
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = ~solid[:-1]
    first[cuts] = True
    starts = np.flatnonzero(solid & first)
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = ~solid[1:]
    last[cuts[cuts > 0] - 1] = True
    ends = np.flatnonzero(solid & last) + 1
    lengths = ends - starts
    table = powers(int(lengths.max()))
    at = np.cumsum(lengths) - lengths
    where = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    parts = _BYTE_LOWER[data[solid]] * table[where]
    return mix(np.add.reduceat(parts, at) + lengths.astype(np.uint64)), starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts and ends of all words, and the n + 1 word offsets of the rows."""
    hashes, starts, ends, at, n = [], [], [], 0, len(data)
    gaps = _NO_LETTER if letters else _SPACE
    while at < n:
        end = min(n, at + PIECE_BYTES)
        if end < n:
            stop = np.searchsorted(offsets, end, "right") - 1
            if offsets[stop] > at:
                end = int(offsets[stop])
            else:
                gap = np.flatnonzero(gaps[data[at:end]])
                while not len(gap) and end < n:
                    more = min(n, end + PIECE_BYTES)
                    gap = np.flatnonzero(gaps[data[end:more]]) + (end - at)
                    end = more
                if len(gap):
                    end = at + int(gap[-1]) + 1
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        h, s, e = _spans(data[at:end], np.unique(inside), gaps)
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = end
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    starts = join(starts, np.int64)
    return join(hashes, np.uint64), starts, join(ends, np.int64), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``k`` words, by its first word; shorter by k - 1 than ``words``."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total += words[i : len(words) - k + 1 + i] * _MULT[i]
    return mix(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row: the whole text as one if it has under k words; none without words."""
    words, _, _, at = word_hashes(data, offsets)
    grams = shingle_hashes(words, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield mix(np.array([(words[a:b] * _MULT[8 : 8 + b - a]).sum() + np.uint64(b - a)], np.uint64))
        else:
            yield np.empty(0, np.uint64)
