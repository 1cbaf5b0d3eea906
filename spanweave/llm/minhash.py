"""HyperMinHash signatures of hash sets, their bands and similarity estimates.

A set's 64-bit hashes fall into 256 buckets by their top bits.  A bucket's register keeps
the smallest of its hashes in short: the number of its leading zeros (6 bits) and the
mantissa bits after its leading one (10 bits).  Empty buckets copy a bucket found by a fixed
chain of probes, the same for every set, so that each register of two sets still agrees with
the probability of their Jaccard similarity (plus rare collisions, corrected in ``estimate``).
"""

from __future__ import annotations

import numpy as np

from .words import mix

BUCKETS = 256
LZ_BITS, MANTISSA_BITS = 6, 10
_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(56)
_TRIES = 4096
_PROBE = (mix(np.arange(_TRIES * BUCKETS, dtype=np.uint64) + np.uint64(77)) >> np.uint64(56)).astype(np.int64).reshape(_TRIES, BUCKETS)
_BAND_MULT = np.random.default_rng(11).integers(1, 2**63, BUCKETS, dtype=np.uint64) | np.uint64(1)


def _registers(rest: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of values whose 56 used bits stand at the top."""
    _, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 62).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    return ((zeros << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BUCKETS`` registers for each sorted set of distinct hashes; no set may be empty."""
    low = np.zeros((len(sets), BUCKETS), np.uint64)
    full = np.zeros((len(sets), BUCKETS), bool)
    for i, hashes in enumerate(sets):
        at = np.searchsorted(hashes, _EDGES)
        there = np.diff(np.r_[at, len(hashes)]) > 0
        full[i] = there
        low[i, there] = hashes[at[there]]
    out = _registers(low << np.uint64(8))
    own = out.copy()
    rows, cols = np.nonzero(~full)
    for t in range(_TRIES):
        if not len(rows):
            return out
        source = _PROBE[t, cols]
        good = full[rows, source]
        out[rows[good], cols[good]] = own[rows[good], source[good]]
        rows, cols = rows[~good], cols[~good]
    first = full.argmax(axis=1)
    out[rows, cols] = own[rows, first[rows]]
    return out


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` registers; the band's number is part of it."""
    used = registers[:, : bands * rows].astype(np.uint64) * _BAND_MULT[: bands * rows]
    return mix(used.reshape(len(registers), bands, rows).sum(axis=2) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _zeros_law(n: np.ndarray) -> np.ndarray:
    """Probability of each number of leading zeros of the smallest of ``n / BUCKETS`` uniform values."""
    share = np.maximum(1.0, n / BUCKETS)[:, None]
    steps = 2.0 ** -np.arange(0, 57)[None, :]
    below = 1 - np.exp(share * np.log1p(-np.minimum(steps, 1 - 1e-16)))
    return below[:, :-1] - below[:, 1:]


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers: the share that agrees, less what chance collisions of short registers add."""
    same = (a == b).mean(axis=1)
    chance = (_zeros_law(n_a) * _zeros_law(n_b)).sum(axis=1) * 2.0**-MANTISSA_BITS
    return np.clip((same - chance) / (1 - chance), 0, 1)
